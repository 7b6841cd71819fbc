"""Keyword search: postings, match grammar and BM25.

``Index`` holds one row for each token with its place, and one for each
document with its length. A query reads only the postings of its own terms (a
filter that reaches the scan of a stored index); the driver learns the count of
documents, their mean length, and in a stemmed index which words have a stem.
On disk each task's tokens are inverted block by block, a row a term with the
list of its places, so that saving shuffles nothing.

Terms are lower-cased words. A stemmed index has a word list besides, (term,
stem), made once for each distinct word after the shuffle; a query's stems are
turned into words there, so no text ever meets the stemmer.

``Scan`` answers the same queries from the documents themselves, for catalogs
that have no stored index: two passes that look for the query's own terms in
each row, and no shuffle but that of a few sums.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import stemming
from ..functions import words as W

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Field weights of publications (title, subtitle, description, body) and sections.
PUBLICATION_WEIGHTS = (10.0, 5.0, 3.0, 1.0)
SECTION_WEIGHTS = (8.0, 1.0)


class MatchError(ValueError):
    """The query is no match expression."""


def plain_tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; stays in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


#: Letters and digits, in a word list's terms each with the diacritics after it.
SURFACE, PLAIN = r"(?:[\p{L}\p{N}][\u0300-\u036f]*)+", r"[\p{L}\p{N}]+"


def surface_tokens(text: Column) -> Column:
    """Lower-cased words with their diacritics, for a word list to fold and
    stem; stays in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({SURFACE})"), F.lit(1))


def word_list(terms: DataFrame) -> DataFrame:
    """(term, stem) for distinct terms(term): case and diacritics folded, then
    Porter's stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems = [stemming.stem(stemming.fold(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stems, pa.string())], names=["term", "stem"])

    return terms.select("term").mapInArrow(run, "term string, stem string")


#: Tokens of a block, and places of a row of it, at most.
BLOCK, PLACES = 1 << 21, 4096


def _inverted(held: list[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(term, places) of rows (id, field, term, position), in the terms' order,
    with most places in a row."""
    rows = pa.Table.from_batches(held)
    held.clear()
    coded = rows.column("term").combine_chunks().dictionary_encode()
    rows = rows.select(["id", "field", "position"])
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # code and row as one number: a plain sort keeps equal terms in the rows' order
    keyed = rank[coded.indices.to_numpy()]
    dictionary, coded = coded.dictionary, None
    keyed <<= 32
    keyed |= np.arange(rows.num_rows)
    keyed.sort()
    codes = (keyed >> 32).astype(np.int32)
    begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sizes = np.diff(np.r_[begins, len(codes)])
    parts = -(-sizes // most)  # rows of each term
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(begins, parts) + nth * most
    terms = dictionary.take(pa.array(order[codes[starts]]))
    edges = np.r_[starts, len(codes)]
    keyed &= 0xFFFFFFFF
    turn, codes, names = pa.array(keyed), None, rows.column_names
    # a column at a time: what was moved goes before the next is
    columns = []
    for name in names:
        columns.append(rows.column(name).combine_chunks().take(turn))
        rows = rows.drop_columns(name)
    turn = keyed = None
    values = pa.StructArray.from_arrays(columns, names=names)
    for i in range(0, len(starts), 1024):
        k = min(i + 1024, len(starts))
        own = pa.ListArray.from_arrays(pa.array((edges[i : k + 1] - edges[i]).astype(np.int32)), values.slice(edges[i], edges[k] - edges[i]))
        yield pa.RecordBatch.from_arrays([terms.slice(i, k - i), own], names=["term", "places"])
    columns = values = own = terms = None
    pa.default_memory_pool().release_unused()


def _in_blocks(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= block:
            yield from _inverted(held, most)
            held, n = [], 0
    if n:
        yield from _inverted(held, most)


def _block_rows(kind: str) -> str:
    return f"term string, places array<struct<id: {kind}, field: int, position: int>>"


def blocks(postings: DataFrame) -> DataFrame:
    """(term, places) from postings: each task inverts its own rows, BLOCK at a
    time, and gives a block's terms in order. A term with more than PLACES
    places in a block has several rows."""
    block, most = BLOCK, PLACES
    return postings.select("id", "field", "term", "position").mapInArrow(lambda batches: _in_blocks(batches, block, most), _block_rows(dict(postings.dtypes)["id"]))


def _lowered(docs: DataFrame, fields: tuple[str, ...]) -> list[Column]:
    return [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)]


def text_blocks(docs: DataFrame, fields: tuple[str, ...], stemmed: bool = False) -> DataFrame:
    """blocks() of docs(id, *fields): whole texts go to Python and are cut
    there, so no row is made of a token before it is in its block."""
    bits, block, most = W.letters(docs.sparkSession), BLOCK, PLACES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.unpacked(bits)

        def cut() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(fields)):
                    for row, position, terms in W.tokens(W.no_null(batch.column(k + 1)), known, stemmed):
                        columns = [batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), k, np.int32)), terms, pa.array(position.astype(np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, names=["id", "field", "term", "position"])

        yield from _in_blocks(cut(), block, most)

    return docs.select("id", *_lowered(docs, fields)).mapInArrow(run, _block_rows(dict(docs.dtypes)["id"]))


def text_lengths(docs: DataFrame, fields: tuple[str, ...], stemmed: bool = False, *others: Column) -> DataFrame:
    """(id, others, length) of docs(id, *fields), length being the number of
    tokens in all fields."""
    bits = W.letters(docs.sparkSession)
    kept = docs.select("id", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.unpacked(bits)
        for batch in batches:
            n = batch.num_columns - len(fields)
            length = sum((W.counted(W.no_null(batch.column(n + k)), known, stemmed) for k in range(len(fields))), np.zeros(batch.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(length)], names=[*batch.schema.names[:n], "length"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in [*kept.dtypes, ("length", "long")])
    return docs.select("id", *others, *_lowered(docs, fields)).mapInArrow(run, kinds)


def unblocked(rows: DataFrame) -> DataFrame:
    """Postings from stored rows: blocks, or one row a token as older indexes
    have them. A filter on terms goes through to the scan."""
    if "places" not in rows.columns:
        return rows
    return rows.select("term", F.explode("places").alias("p")).select("p.id", "p.field", "term", "p.position")


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # id, field, term, position
    lengths: DataFrame  # id, length
    fields: tuple[str, ...]
    stemmed: bool = False
    words: DataFrame | None = None  # term, stem
    texts: DataFrame | None = None  # id, *fields: where it was built of these and is not saved yet
    totals: Row | None = None  # n, mean: where lengths are of some documents only

    @staticmethod
    def build(docs: DataFrame, fields: tuple[str, ...], stemmed: bool = False) -> Index:
        """From docs(id, *fields). Tokens are exploded in place: only the word
        list needs a shuffle, of distinct words."""
        tokens = surface_tokens if stemmed else plain_tokens
        rows = docs.select("id", F.array(*[tokens(F.col(f)) for f in fields]).alias("tokens"))
        lengths = rows.select("id", F.aggregate("tokens", F.lit(0).cast("long"), lambda n, t: n + F.size(t)).alias("length"))
        postings = rows.select("id", F.posexplode("tokens").alias("field", "t")).select("id", "field", F.posexplode("t").alias("position", "term"))
        postings = postings.select("id", "field", "term", "position")
        return Index(postings, lengths, fields, stemmed, word_list(postings.select("term").distinct()) if stemmed else None, docs)

    def save(self, folder: str) -> None:
        """Postings as blocks, each task's own, without a shuffle: a query's
        filter skips the pages of a block that lack its terms. The word list
        is made of the terms as they are stored."""
        inverted = blocks(self.postings) if self.texts is None else text_blocks(self.texts, self.fields, self.stemmed)
        inverted.write.mode("overwrite").parquet(f"{folder}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        if self.stemmed:
            terms = self.postings.sparkSession.read.parquet(f"{folder}/postings").select("term").distinct()
            word_list(terms).repartitionByRange("stem").sortWithinPartitions("stem", "term").write.mode("overwrite").parquet(f"{folder}/words")

    @staticmethod
    def open(spark: SparkSession, folder: str, fields: tuple[str, ...], stemmed: bool = False) -> Index:
        return Index(unblocked(spark.read.parquet(f"{folder}/postings")), spark.read.parquet(f"{folder}/lengths"), fields, stemmed, spark.read.parquet(f"{folder}/words") if stemmed else None)

    def terms(self, text: str) -> list[str]:
        return query_terms(text, self.stemmed)


@dataclass(frozen=True)
class Scan:
    docs: DataFrame  # id, *fields
    fields: tuple[str, ...]
    stemmed: bool = False

    def terms(self, text: str) -> list[str]:
        return query_terms(text, self.stemmed)


def query_terms(text: str, stemmed: bool) -> list[str]:
    return stemming.tokens(text, True) if stemmed else re.findall(r"[^\W_]+", text.lower())


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    initial: bool = False
    fields: frozenset[str] | None = None


@dataclass(frozen=True)
class Both:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Either:
    parts: tuple = field(default=())


@dataclass(frozen=True)
class Without:
    keep: object
    drop: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w*]+)|([(){}:^+]))', re.UNICODE)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise MatchError(f"syntax error near {query[at:].strip()[:1]!r}")
        if m[1] is not None:
            out.append(("string", m[1].replace('""', '"')))
        elif m[2] is not None:
            word, _, rest = m[2].partition("*")
            if word:
                out.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
            out += [("*", "*")] * (m[2].count("*"))
            if rest.strip("*"):
                raise MatchError(f"syntax error near {m[2]!r}")
        else:
            out.append((m[3], m[3]))
        at = m.end()
    return out


class _Parser:
    """OR binds loosest, then AND, then NOT, then juxtaposition."""

    def __init__(self, query: str, index: Index | Scan):
        self.tokens, self.at, self.index = _lex(query), 0, index

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else None

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or (kind and self.peek() != kind):
            raise MatchError("unexpected end of query" if self.at >= len(self.tokens) else f"syntax error near {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        if not self.tokens:
            raise MatchError("empty query")
        out = self.disjunction()
        if self.at < len(self.tokens):
            raise MatchError(f"syntax error near {self.tokens[self.at][1]!r}")
        return out

    def disjunction(self):
        parts = [self.conjunction()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def conjunction(self):
        parts = [self.exclusion()]
        while self.peek() == "AND":
            self.take()
            parts.append(self.exclusion())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def exclusion(self):
        out = self.adjacent()
        while self.peek() == "NOT":
            self.take()
            out = Without(out, self.adjacent())
        return out

    def adjacent(self):
        parts = [self.item()]
        while self.peek() in ("string", "word", "(", "{", "^"):
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def item(self):
        names: list[str] | None = None
        if self.peek() == "{":
            self.take()
            names = []
            while self.peek() in ("word", "string"):
                names.append(self.take())
            self.take("}")
            self.take(":")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names = [self.take()]
            self.take(":")
        if names is not None:
            unknown = [n for n in names if n.lower() not in self.index.fields]
            if unknown:
                raise MatchError(f"no such column: {unknown[0]}")
        if self.peek() == "(":
            self.take()
            out = self.disjunction()
            self.take(")")
        else:
            out = self.phrase()
        return out if names is None else _within(out, frozenset(n.lower() for n in names))

    def phrase(self):
        initial = self.peek() == "^"
        if initial:
            self.take()
        if self.peek() not in ("word", "string"):
            self.take("word")
        terms = self.index.terms(self.take())
        while self.peek() == "+":
            self.take()
            if self.peek() not in ("word", "string"):
                self.take("word")
            terms += self.index.terms(self.take())
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(tuple(terms), prefix, initial)


def _within(node, names: frozenset[str]):
    if isinstance(node, Phrase):
        return replace(node, fields=names if node.fields is None else node.fields & names)
    if isinstance(node, Without):
        return Without(_within(node.keep, names), _within(node.drop, names))
    return type(node)(tuple(_within(p, names) for p in node.parts))


def parse(query: str, index: Index | Scan):
    """The tree of a match expression; MatchError if it is none."""
    return _Parser(query, index).whole()


# A part of a query stays as it is if it matches one of these: a quote in it, a
# leading sign, an operator, or a plain word with or without a closing star.
_MEANT = re.compile(r'.*".*|[-^].*|AND|OR|NOT|[^\W_]+\**', re.S)


def safe_query(text: str | None) -> str:
    """Any text as a match expression: syntax that is surely meant stays, and
    each other part becomes a phrase of its letters and digits."""

    def said(part: str) -> str:
        phrase = " ".join(re.findall(r"[^\W_]+", part))
        return part if _MEANT.fullmatch(part) else phrase and f'"{phrase}"'

    return " ".join(filter(None, map(said, (text or "").split())))


#: Words of a query's stems that become a filter of the scan; more are joined.
MANY = 2000
Variants = dict[tuple[str, bool], list[str]]


def _of(column: Column, term: str, prefix: bool) -> Column:
    return column.startswith(term) if prefix else column == term


def _asked(leaves: list[Phrase]) -> list[tuple[str, bool]]:
    return sorted({(t, p.prefix and k == len(p.terms) - 1) for p in leaves for k, t in enumerate(p.terms)})


def _variants(words: DataFrame, leaves: list[Phrase]) -> Variants | None:
    """The words of every stem that is asked for; None if they are many."""
    asked = _asked(leaves)
    if not asked:
        return {}
    own = words.where(reduce(lambda a, b: a | b, [_of(F.col("stem"), *a) for a in asked]))
    found = own.select("term", "stem").limit(MANY + 1).collect()
    if len(found) > MANY:
        return None
    return {(t, prefix): sorted({r.term for r in found if (r.stem.startswith(t) if prefix else r.stem == t)}) for t, prefix in asked}


def _phrase_at(index: Index, p: Phrase, variants: Variants | None) -> DataFrame:
    """(id, field, at): every place where a phrase begins."""
    fields = [i for i, f in enumerate(index.fields) if p.fields is None or f in p.fields]
    own = index.postings.where(F.col("field").isin(fields)) if fields and p.terms else index.postings.where("false")
    found = None
    for k, term in enumerate(p.terms or ("",)):
        asked = (term, p.prefix and k == len(p.terms) - 1)
        if not index.stemmed:
            rows = own.where(_of(F.col("term"), *asked))
        elif variants is not None:
            rows = own.where(F.col("term").isin(variants.get(asked, [])))
        else:
            rows = own.join(index.words.where(_of(F.col("stem"), *asked)).select("term"), "term", "left_semi")
        rows = rows.select("id", "field", (F.col("position") - k).alias("at"))
        found = rows if found is None else found.join(rows, ["id", "field", "at"], "left_semi")
    return found.where("at = 0") if p.initial else found


def _matches(index: Index, node, weights: tuple[float, ...], totals, variants: Variants | None) -> DataFrame:
    """(id, score) of the documents that satisfy node. A branch that does not
    hold for a document adds nothing, even if some of its terms occur."""
    if isinstance(node, Phrase):
        weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("field") + 1)
        hits = _phrase_at(index, node, variants).groupBy("id").agg(F.sum(weight).alias("f"))
        n = hits.agg(F.count("*").alias("n"))
        idf = F.log((F.lit(totals.n) - F.col("n") + 0.5) / (F.col("n") + 0.5))
        rows = hits.join(index.lengths, "id").crossJoin(F.broadcast(n))
        score = -F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.lit(totals.mean)))
        return rows.select("id", score.alias("score"))
    if isinstance(node, Without):
        return _matches(index, node.keep, weights, totals, variants).join(_matches(index, node.drop, weights, totals, variants), "id", "left_anti")
    parts = [_matches(index, p, weights, totals, variants) for p in node.parts]
    both = reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    return (both.where(F.col("n") == len(parts)) if isinstance(node, Both) else both).select("id", "score")


def _leaves(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return [p for n in ((node.keep, node.drop) if isinstance(node, Without) else node.parts) for p in _leaves(n)]


def _occurrences(tokens: Column, p: Phrase, variants: Variants | None) -> Column:
    """How often one field's tokens hold a phrase."""

    def here(x: Column, i: Column) -> Column:
        out = F.lit(True) if not p.initial else i == 0
        for k, term in enumerate(p.terms):
            word = x if k == 0 else F.coalesce(F.get(tokens, i + k), F.lit(""))
            asked = (term, p.prefix and k == len(p.terms) - 1)
            out = out & (_of(word, *asked) if variants is None else word.isin(variants[asked]))
        return out

    return F.size(F.filter(tokens, here)) if p.terms else F.lit(0)


def _scan(scan: Scan, node, weights: tuple[float, ...]) -> DataFrame:
    cut = surface_tokens if scan.stemmed else plain_tokens
    leaves, variants = _leaves(node), None
    if scan.stemmed:
        index = Index.build(scan.docs, scan.fields, True)
        variants = _variants(index.words, leaves)
        if variants is None:  # too many words for an expression: joined instead
            return match(index, node, weights)

    def tokenised(docs: DataFrame) -> DataFrame:
        # a generator, so that no filter above it repeats the tokenising
        one = F.struct(*[cut(F.col(f)).alias(f"t{i}") for i, f in enumerate(scan.fields)])
        return docs.select("id", F.explode(F.array(one)).alias("t")).select("id", "t.*")

    def counted(docs: DataFrame) -> DataFrame:
        return tokenised(docs).select("id", length.alias("length"), *[w.alias(f"f{k}") for k, w in enumerate(weighted)])

    weighted = [
        sum((F.lit(weights[i]) * _occurrences(F.col(f"t{i}"), p, variants) for i, f in enumerate(scan.fields) if p.fields is None or f in p.fields), F.lit(0.0)) for p in leaves
    ]
    length = sum((F.size(f"t{i}") for i in range(len(scan.fields))), F.lit(0))
    stats = counted(scan.docs).agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(leaves))]).first()
    turn = iter(range(len(leaves)))

    def said(n) -> tuple[Column, Column]:
        if isinstance(n, Phrase):
            k = next(turn)
            f, df = F.col(f"f{k}"), stats[f"n{k}"]
            idf = math.log((stats.n - df + 0.5) / (df + 0.5))
            return f > 0, -(idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(stats.mean)))
        if isinstance(n, Without):
            (keep, score), (drop, _) = said(n.keep), said(n.drop)
            return keep & ~drop, score
        parts = [said(p) for p in n.parts]
        both = isinstance(n, Both)
        holds = reduce(lambda a, b: a & b if both else a | b, [h for h, _ in parts])
        return holds, sum((s if both else F.when(h, s).otherwise(0.0) for h, s in parts), F.lit(0.0))

    holds, score = said(node)
    docs = scan.docs
    if not scan.stemmed and all(p.terms for p in leaves):
        # what holds none of the phrases' words as substrings can't match
        has = lambda term: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(term)) for f in scan.fields])
        docs = docs.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(has, p.terms)) for p in leaves]))
    return counted(docs).where(holds).select("id", score.alias("score"))


def _totals(index: Index) -> Row:
    return index.lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("mean")).first()


def narrowed(index: Index | Scan, queries: Sequence[str]) -> Index | Scan:
    """The index with no other postings than those of the queries' words, and
    the lengths of their documents: a table read once for all queries, which
    give the same scores as ever. A scan, or an index of which too many words
    are asked for, stays as it is."""
    if isinstance(index, Scan):
        return index
    leaves = [p for q in queries for p in _leaves(parse(q, index))]
    asked = _asked(leaves)
    variants = _variants(index.words, leaves) if index.stemmed else None
    if not asked or len(asked) > MANY or index.stemmed and variants is None:
        return index
    if variants is None:
        own = reduce(lambda a, b: a | b, [_of(F.col("term"), *a) for a in asked])
    else:
        own = F.col("term").isin(sorted({t for found in variants.values() for t in found}))
    postings = storage.stored(index.postings.where(own), "asked")
    lengths = storage.stored(index.lengths.join(postings.select("id").distinct(), "id", "left_semi"), "asked-lengths")
    return replace(index, postings=postings, lengths=lengths, texts=None, totals=index.totals or _totals(index))


def match(index: Index | Scan, query, weights: tuple[float, ...]) -> DataFrame:
    """(id, score) of all documents that match; a lower score is better. query
    is a match expression or its tree."""
    node = parse(query, index) if isinstance(query, str) else query
    if isinstance(index, Scan):
        return _scan(index, node, weights)
    variants = _variants(index.words, _leaves(node)) if index.stemmed else None
    totals = index.totals or _totals(index)
    return _matches(index, node, weights, totals, variants)


def term_stats(docs: DataFrame, field: str) -> DataFrame:
    """(term, documents, occurrences): each document marks the first of equal
    tokens in its own sorted list, so one shuffle by term with map-side sums
    is all."""
    tokens = docs.select(F.sort_array(plain_tokens(F.col(field))).alias("t"))
    marked = F.explode(F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get(F.col("t"), i - 1))).cast("long").alias("first")))).alias("m")
    return tokens.select(marked).groupBy("m.term").agg(F.sum("m.first").alias("documents"), F.count("*").alias("occurrences"))


def search(index: Index | Scan, query: str, weights: tuple[float, ...], limit: int) -> DataFrame:
    """The best matches: id, score and position from 1; ties by id."""
    top = match(index, query, weights).orderBy("score", "id").limit(limit)
    return top.selectExpr("id", "score", "row_number() OVER (ORDER BY score, id) AS position")


def snippets(index: Index | Scan, docs: DataFrame, query: str, column: int | None = None, width: int = 12, marks: tuple[str, str] = ("[", "]"), more: str = " … ") -> DataFrame:
    """(id, snippet) for docs(id, *fields), the rows to show: the best window of
    `width` tokens, in the best field if none is given, hits in marks.

    A window begins at a hit, or at the sentence around it; each phrase counts
    1,000 and each further hit 1, a sentence's start 100 and a field's 120; of
    equal ones the first stays. One that begins at a hit is then centred on its
    hits. Counts slide over the sorted hits of a field; only the rows to show
    are cut into tokens again, for where these begin and end."""
    if isinstance(index, Scan):
        index = Index.build(docs, index.fields, index.stemmed)
    leaves = _leaves(parse(query, index))
    variants = _variants(index.words, leaves) if index.stemmed else None
    own = [i for i in range(len(index.fields)) if column is None or i == column]
    word = SURFACE if index.stemmed else PLAIN
    texts = docs.select("id", F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.coalesce(F.col(index.fields[i]), F.lit("")).alias("text")) for i in own])).alias("t")).select("id", "t.*")
    texts = texts.withColumns({"words": F.regexp_extract_all("text", F.lit(f"({word})"), F.lit(1)), "gaps": F.split("text", word, -1)}).withColumn("n", F.size("words"))
    opening = F.when(F.col("n") > 0, F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | F.get("gaps", i).rlike(r"[.:][ \t\r\n]+$")))

    def places(k: int, p: Phrase) -> DataFrame:
        return _phrase_at(index, p, variants).where(F.col("field").isin(own)).select("id", "field", "at", F.lit(k).alias("phrase"), (F.col("at") + len(p.terms)).alias("end"))

    hits = reduce(DataFrame.union, [places(k, p) for k, p in enumerate(leaves)])
    hits = texts.select("id", "field", "n", opening.alias("opening")).join(hits, ["id", "field"])
    begins = F.array_max(F.filter("opening", lambda x: x <= F.col("at")))
    kinds = F.array(F.struct(F.col("at").alias("s"), F.lit(0).alias("kind")), F.struct(begins.alias("s"), F.lit(1).alias("kind")))
    tries = hits.select("id", "field", "n", F.col("at").alias("hit"), F.explode(kinds).alias("k")).where((F.col("k.kind") == 0) | ((F.col("n") > width) & (F.col("k.s") < F.col("hit"))))
    none = F.lit(None).cast("int")
    events = hits.select("id", "field", "n", "at", "phrase", "end", none.alias("hit"), none.alias("kind")).union(tries.select("id", "field", "n", "k.s", none, none, "hit", "k.kind"))
    inside = Window.partitionBy("id", "field").orderBy("at").rangeBetween(0, width - 1)
    there = F.when(F.col("phrase").isNotNull(), F.struct("at", "phrase", "end"))
    seen = events.withColumns({"hits": F.count("phrase").over(inside), "kinds": F.size(F.collect_set("phrase").over(inside)), "first": F.min(F.when(F.col("phrase").isNotNull(), F.col("at"))).over(inside), "last": F.max(there).over(inside).getField("end")}).where("kind IS NOT NULL")
    spare = F.lit(width) - (F.col("last") - F.col("first"))
    half = F.when(spare < 0, F.ceil(spare / 2)).otherwise(F.floor(spare / 2)).cast("int")
    centred = F.greatest(F.least(F.col("first") - half, F.col("n") - width), F.lit(0))
    score = F.col("hits") + 999 * F.col("kinds") + F.when(F.col("kind") == 0, 0).when(F.col("at") == 0, 120).otherwise(100)
    best = seen.groupBy("id").agg(F.max_by(F.struct("field", F.when(F.col("kind") == 0, centred).otherwise(F.col("at")).alias("start")), F.struct(score, -F.col("field"), -F.col("hit"), -F.col("kind"))).alias("best"))

    # phrases that overlap are marked as one
    sorted_ = Window.partitionBy("id", "field").orderBy("at", "phrase")
    apart = (F.col("at") >= F.max("end").over(sorted_.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    runs = hits.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("run", F.sum("apart").over(sorted_))
    runs = runs.groupBy("id", "field", "run").agg(F.min("at").alias("s"), (F.max("end") - 1).alias("e"))

    chosen = docs.select("id").join(best, "id", "left").select("id", F.coalesce("best.field", F.lit(own[0])).alias("field"), F.coalesce("best.start", F.lit(0)).alias("start"))
    near = chosen.join(runs, ["id", "field"]).where((F.col("s") >= F.col("start")) & (F.col("s") < F.col("start") + width)).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    rows = chosen.join(texts, ["id", "field"]).join(near, "id", "left").withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<s:int,e:int>>")))
    end = F.col("start") + width - 1

    def shown(i: Column) -> Column:
        gap = F.when((i > F.col("start")) | (F.col("start") == 0), F.get("gaps", i)).otherwise("")
        left = F.when(F.exists("runs", lambda r: r["s"] == i), marks[0]).otherwise("")
        right = F.when(F.exists("runs", lambda r: (r["e"] == i) | ((i == end) & (r["s"] <= i) & (r["e"] > i))), marks[1]).otherwise("")
        return F.concat(gap, left, F.get("words", i), right)

    body = F.array_join(F.transform(F.sequence(F.col("start"), F.least(end, F.col("n") - 1)), shown), "")
    cut = F.concat(F.when(F.col("start") > 0, more).otherwise(""), body, F.when(end >= F.col("n") - 1, F.get("gaps", F.col("n"))).otherwise(more))
    return rows.select("id", F.when(F.col("n") == 0, F.col("text")).otherwise(cut).alias("snippet"))


def best_sections(index: Index, sections: DataFrame, query: str, ids: DataFrame) -> DataFrame:
    """For each document of ids its best section: id, section_id, score. All
    sections count for rarity and mean length, whichever documents they are of."""
    hits = match(index, query, SECTION_WEIGHTS).withColumnRenamed("id", "section_id")
    own = sections.select(F.col("id").alias("section_id"), F.col("publication_id").alias("id")).join(ids.select("id"), "id", "left_semi")
    ranked = hits.join(own, "section_id").selectExpr("id", "section_id", "score", "row_number() OVER (PARTITION BY id ORDER BY score, section_id) AS turn")
    return ranked.where("turn = 1").select("id", "section_id", "score")


def stale(index_docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: documents that are not in the index, and titles that differ."""
    both = catalog.select("id", "title").join(index_docs.select("id", F.col("title").alias("indexed"), F.lit(True).alias("there")), "id", "left")
    return both.agg(F.count_if(F.col("there").isNull()).alias("missing_rows"), F.count_if(F.col("there") & ~F.col("title").eqNullSafe(F.col("indexed"))).alias("stale_titles"))
