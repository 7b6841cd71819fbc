"""Validators, classifiers and prompt parts as column expressions.

A validator gives an array of problems, empty for a valid row, so that a
re-ask can quote them and a reject table can keep them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import word_count


def _problems(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(what)) for bad, what in checks]), lambda x: x.isNotNull())


def enrichment_problems(one_liner: Column, summary: Column, findings: Column, entities: Column) -> Column:
    """A line of 1 to 30 words, a summary, 1 to 8 findings, and entities that
    are lists of names."""
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    return _problems(
        (blank(one_liner), "one-liner is missing"),
        (word_count(one_liner) > 30, "one-liner is over 30 words"),
        (blank(summary), "summary is missing"),
        (findings.isNull() | (F.size(findings) < 1) | (F.size(findings) > 8), "findings are not 1 to 8"),
        (F.exists(findings, blank), "a finding is blank"),
        (entities.isNull(), "entities are missing"),
        (F.exists(F.flatten(F.map_values(entities)), blank), "an entity is blank"),
    )


def topic_problems(slugs: Column, vocabulary: list[str]) -> Column:
    """1 to 4 different slugs of the vocabulary."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    return _problems(
        (slugs.isNull() | (F.size(slugs) < 1) | (F.size(slugs) > 4), "not 1 to 4 topics"),
        (F.size(F.array_distinct(slugs)) < F.size(slugs), "a topic is repeated"),
        (F.size(F.array_except(slugs, known)) > 0, "a topic is unknown"),
    )


def distinctive(text: Column) -> Column:
    """Distinct words of five letters or more, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{5,})"), F.lit(1)))


def shared_ratio(text: Column, source: Column) -> Column:
    """Which part of text's distinctive words source has too."""
    own = distinctive(text)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, distinctive(source))) / F.size(own)).otherwise(F.lit(0.0))


def blurb_problems(blurb: Column, source: Column, openings: list[str]) -> Column:
    """30 to 110 words, no worn opening, and not the summary again."""
    n = word_count(blurb)
    bad = F.lit(False)
    for o in openings:
        bad = bad | F.lower(F.ltrim(blurb)).startswith(o.lower())
    return _problems((n < 30, "under 30 words"), (n > 110, "over 110 words"), (bad, "worn opening"), (shared_ratio(blurb, source) > 0.8, "repeats the summary"))


def grounding(names: Column, body: Column) -> Column:
    """The share of names that the body mentions, to three digits."""
    low = F.lower(body)
    found = F.size(F.filter(names, lambda x: F.contains(low, F.lower(x))))
    return F.when(F.size(names) > 0, F.round(found / F.size(names), 3))


def affiliation(on_roster: Column, roster_title: Column, job_title: Column, has_page: Column, external: Column, organisation: str) -> Column:
    """struct(affiliation, is_current). The roster says who is current; the
    title says who is staff, an affiliate, or someone else's employee."""
    fellow = lambda t: F.coalesce(F.lower(t), F.lit("")).rlike(r"\b(fellow|associate)\b")
    # fixed value: how a title names another employer
    other = F.regexp_replace(job_title, rf"(?i)\b{organisation}\b", "").rlike(r",\s+[A-Z]|\bat\s+(?:the\s+)?[A-Z]|\bof\s+the\s+[A-Z]")
    blank = lambda t: F.coalesce(t, F.lit("")) == ""
    title = F.when(~blank(roster_title), roster_title).otherwise(job_title)
    out = lambda kind, now: F.struct(kind.alias("affiliation"), F.lit(now).alias("is_current"))
    kind = lambda t: F.when(fellow(t), "affiliate").otherwise("staff")
    return (
        F.when(on_roster, out(kind(title), True))
        .when(external | ~has_page, out(F.lit("external"), False))
        .when(blank(job_title), out(F.lit("unknown"), False))
        .when(other, out(F.lit("external"), False))
        .otherwise(out(kind(job_title), False))
    )


def enrichment_prompt(title: Column, body: Column, executive: Column, outline: Column, limit: int = 6000) -> Column:
    """What a model is shown: the body, or for long ones with an executive
    summary of 150 words that summary and the outline."""
    from .text import first_words

    long = (word_count(body) > limit) & (word_count(executive) >= 150)
    text = F.when(long, F.concat_ws("\n\n", executive, F.lit("Outline:"), outline)).when(word_count(body) > limit, first_words(body, limit)).otherwise(body)
    return F.concat_ws("\n\n", F.concat(F.lit("Title: "), title), text)


def _record_lines(title: Column, pub_type: Column, day: Column, one_liner: Column, summary: Column, findings: Column, subtitle: Column | None = None) -> Column:
    """What is known of a publication, a paragraph each; parts that are
    missing are left out."""
    said = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x))
    head = F.concat_ws("\n", said("Title", title), said("Subtitle", subtitle) if subtitle is not None else F.lit(None).cast("string"), said("Type", pub_type), said("Date", day.cast("string")))
    points = F.when(F.size(findings) > 0, F.concat(F.lit("Key findings:\n"), F.array_join(F.transform(findings, lambda f: F.concat(F.lit("- "), f)), "\n")))
    return F.concat_ws("\n\n", head, said("One-liner", one_liner), said("Summary", summary), points)


def topics_prompt(title: Column, subtitle: Column, pub_type: Column, day: Column, one_liner: Column, summary: Column, findings: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """A publication's summary, and the vocabulary (slug, label) to choose 1
    to 4 topics from, the leading one first."""
    words = "\n".join(f"- {slug}: {label}" for slug, label in vocabulary)
    task = f'Choose 1 to 4 topics, the leading one first, and answer as {{"topics": ["slug"]}}. The vocabulary:\n{words}'
    return F.concat_ws("\n\n", F.lit(task), _record_lines(title, pub_type, day, one_liner, summary, findings, subtitle))


def blurb_prompt(title: Column, pub_type: Column, day: Column, one_liner: Column, summary: Column, findings: Column) -> Column:
    """A publication's summary, to be told anew for readers in 30 to 110 words."""
    task = 'Say in 30 to 110 words why a reader should care; add what the one-liner leaves out. Answer as {"blurb": "..."}.'
    return F.concat_ws("\n\n", F.lit(task), _record_lines(title, pub_type, day, one_liner, summary, findings))


def vision_prompt(title: Column, pub_type: Column, pictures: Column) -> Column:
    """For publications that only pictures tell about."""
    return F.concat(F.lit("Summarise what these "), pictures.cast("string"), F.lit(" pictures show. Read numbers off charts only where they are written. Publication: "), title, F.lit(" ("), pub_type, F.lit(")"))


def series_from_subtitle(subtitle: Column, runs: list[tuple[str, str, str]]) -> Column:
    """struct(pub_type, series) of the first run (pattern, type, series) whose
    pattern a subtitle begins with; null if there is none."""
    out = F.lit(None).cast("struct<pub_type:string,series:string>")
    for pattern, kind, series in reversed(runs):
        hit = F.trim(F.coalesce(subtitle, F.lit(""))).rlike(f"(?i)^{pattern}")
        out = F.when(hit, F.struct(F.lit(kind).alias("pub_type"), F.lit(series).alias("series"))).otherwise(out)
    return out
