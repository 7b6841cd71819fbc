"""Column functions on text, dates and URLs; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the four separators of ASCII, as Python's
#: str.split() sees it: page text is full of no-break spaces.
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, f"[{SPACES}]+", " ")), " "), 1, n), " ")


def spaces_count(text: Column) -> Column:
    """A quick estimate of words: spaces and one; 0 for null and empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def truncated(text: Column, n: int) -> tuple[Column, Column]:
    """(text cut to n words, whether that cut anything)."""
    return F.when(word_count(text) > n, first_words(text, n)).otherwise(text), word_count(text) > n


def quarter_of(day: Column) -> Column:
    """`YYYY-Qn`, or an empty string without a date."""
    return F.coalesce(F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string")), F.lit(""))


def quarter_index(label: Column) -> Column:
    """Quarters since year 0, for spines and differences."""
    return F.substring(label, 1, 4).cast("int") * 4 + F.substring(label, 7, 1).cast("int") - 1


def quarter_label(index: Column) -> Column:
    return F.concat(F.floor(index / 4).cast("string"), F.lit("-Q"), (index % 4 + 1).cast("string"))


def days_between(a: Column, b: Column) -> Column:
    """Whole days from ISO text a to b; null where either is no date."""
    day = lambda x: F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd")
    return F.datediff(day(b), day(a))


def mentions(term: str, *fields: Column) -> Column:
    """Every word of term occurs somewhere in the fields together."""
    whole = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(True)
    for word in term.lower().split():
        out = out & whole.contains(word)
    return out


def ascii_ilike(text: Column, pattern: str) -> Column:
    """LIKE that ignores the case of A-Z only; % and _ keep their meaning."""
    fold = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return fold(text).like("".join(c.lower() if c.isascii() else c for c in pattern))


def slugify(text: Column, limit: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, limit), F.lit("-"))


def url_path(url: Column) -> Column:
    """The path of a URL without a leading /index.php in either spelling."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r"(?i)^/index(%2e|\.)php", "")


def url_slug(url: Column) -> Column:
    return F.regexp_extract(F.trim(url_path(url), F.lit("/")), "([^/]*)$", 1)


def url_scope(url: Column, hosts: list[str], prefixes: list[str], language: str = "en") -> Column:
    """struct(scope, path_prefix): publication, root-level or excluded."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.trim(url_path(url), F.lit("/"))
    rest = F.regexp_extract(path, f"^{language}/(.*)$", 1)
    head, tail = F.regexp_extract(rest, "^([^/]*)", 1), F.regexp_extract(rest, "^[^/]*/(.*)$", 1)
    out = lambda scope, prefix: F.struct(F.lit(scope).alias("scope"), prefix.alias("path_prefix"))
    none = F.lit("")
    return (
        F.when(~host.isin(hosts) | (rest == ""), out("excluded", none))
        .when(tail == "", out("root-level", none))
        .when(head.isin(prefixes), out("publication", head))
        .otherwise(out("excluded", head))
    )


def same_page(a: Column, b: Column) -> Column:
    """Equal but for scheme, www., a trailing slash and /index.php."""
    bare = lambda u: F.concat(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", ""), F.rtrim(url_path(u), F.lit("/")))
    return bare(a) == bare(b)


def parsed_date(text: Column) -> Column:
    """ISO dates and date-times, `1 March 2025`, `Mar 1, 2025`, `01.03.2025`."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd.MM.yyyy")
    return F.to_date(F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]))


def title_topics(title: Column) -> Column:
    """The parts of a title joined by ` + `; none if there is no such mark."""
    parts = F.filter(F.transform(F.split(title, r" \+ "), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.contains(title, F.lit(" + ")), parts).otherwise(F.array().cast("array<string>"))


def normalised(vector: Column) -> Column:
    """To length 1; a zero vector stays."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def json_object(text: Column, kind: str) -> Column:
    """The JSON between the first `{` and the last `}` of an answer."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), kind)
