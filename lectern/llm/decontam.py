"""Benchmark decontamination as a prefix-filtered set join.

A window is WINDOW consecutive words of an item (a shorter item is one
window). Its tokens are its five-word shingles (all of it, if shorter). One
pass over all documents counts every benchmark shingle, which orders them by
rarity. Exact containment needs all tokens of a window, so its necessary
prefix is one token, the rarest: only that is looked up in the second pass.
Where it stands in the window bounds where the window can begin, and the
window's length must fit into the text; what is left is compared word by word.

Items of equal words are one text, however many there are; texts are cut into
pieces that overlap by a window less one word, and go to the executors in
blocks of about BLOCK_BYTES, with two readings of the documents for each and no
writing: of a document only its row number and its hits are kept from one block
to the next. The ids of items are joined to the texts that were found at the
end. Memory of a task, and of the driver, depends on the block and one slice of
text only.

Null text: no words, no hit. Items with null text, no word or null id: no
window. Repeated items: one window, each id counts once. Repeated documents:
each for itself. Empty tables: empty result, or no hit at all. Extra columns:
ignored, or carried along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, buffers

WINDOW = 10
SHINGLE = 5
BLOCK_BYTES = 2 << 20
PIECE_BYTES = 64 << 10
#: Rows of hits that are broadcast at most, of some 100 bytes each.
BROADCAST_ROWS = 200_000


class Lookup:
    """Sorted 64-bit hashes behind a bitmap of their top bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in queries that are found, and where in hashes."""
        at = np.flatnonzero(self.bits[(queries >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        where = np.minimum(np.searchsorted(self.hashes, queries[at]), len(self.hashes) - 1)
        hit = self.hashes[where] == queries[at]
        return at[hit], where[hit]


@dataclass
class Windows:
    """The distinct windows of one block of items."""

    texts: list[bytes]
    words: np.ndarray  # of each window, how many
    hashes: np.ndarray
    shingles: list[list[int]]  # of each window, in order
    owners: list[list[str]]  # the texts it is from


@dataclass
class Prefixes:
    """For one shingle length: which windows start how far before a token."""

    lookup: Lookup
    bounds: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def _hashed(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return buffers.word_hashes(np.frombuffer(b" ".join(words), np.uint8), starts, ends)


def pieces_of(words: list[bytes]) -> Iterator[bytes]:
    """Runs of words, about PIECE_BYTES long, that share WINDOW - 1 words with
    the next: every window is whole in one of them."""
    begin = 0
    while True:
        end, size = begin, 0
        while end < len(words) and (size < PIECE_BYTES or end < begin + WINDOW):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[begin:end])
        if end == len(words):
            return
        begin = end - WINDOW + 1


def texts_of(bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, text) with a digest of the words for each item, and (text, no,
    piece) for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                low = buffers.LOWER[data]
                starts, ends, first = buffers.spans(low, at, buffers.ALNUM)
                whole, out = low.tobytes(), []
                for i, item in enumerate(rows.column(0).to_pylist()):
                    words = [whole[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
                    if words:
                        text = hashlib.md5(b" ".join(words), usedforsecurity=False).hexdigest()
                        out += [(item, text, no, piece) for no, piece in enumerate(pieces_of(words))]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["item", "text", "no", "piece"])

    items = bench.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text")
    found = base.stored(items.mapInArrow(run, "item string, text string, no long, piece binary"), "items")
    # equal words have equal digests and pieces; partial maxima keep one of each
    return found.where("no = 0").select("item", "text"), base.stored(found.groupBy("text", "no").agg(F.max("piece").alias("piece")), "pieces")


def windows_of(pieces: list[tuple[str, bytes]]) -> Windows:
    """The windows of pieces (text, words joined by spaces)."""
    number: dict[bytes, int] = {}
    owners: dict[int, set[str]] = defaultdict(set)
    out = Windows([], [], [], [], [])
    for text, piece in pieces:
        words = piece.split(b" ")
        size, k = min(WINDOW, len(words)), min(SHINGLE, len(words))
        hashes = _hashed(words)
        grams, wholes = buffers.window_hashes(hashes, k).tolist(), buffers.window_hashes(hashes, size)
        for i in range(len(words) - size + 1):
            one = b" ".join(words[i : i + size])
            w = number.setdefault(one, len(number))
            if w == len(out.texts):
                out.texts.append(one)
                out.words.append(size)
                out.hashes.append(wholes[i])
                out.shingles.append(grams[i : i + size - k + 1])
            owners[w].add(text)
    out.words, out.hashes = np.array(out.words, np.int64), np.array(out.hashes, np.uint64)
    out.owners = [sorted(owners[w]) for w in range(len(out.texts))]
    return out


def shingle_lookups(windows: Windows) -> dict[int, Lookup]:
    own = defaultdict(list)
    for n, grams in zip(windows.words.tolist(), windows.shingles):
        own[min(SHINGLE, n)] += grams
    return {k: Lookup(np.array(x, np.uint64)) for k, x in own.items()}


def prefixes_of(windows: Windows, lookups: dict[int, Lookup], seen: dict[tuple[int, int], int]) -> dict[int, Prefixes]:
    """The rarest token of every window; ties go to the smaller hash, then to
    the earlier place."""
    entries = defaultdict(list)
    rank = {k: {h: (seen.get((k, i), 0), h) for i, h in enumerate(x.hashes.tolist())} for k, x in lookups.items()}
    for w, (n, grams) in enumerate(zip(windows.words.tolist(), windows.shingles)):
        k = min(SHINGLE, n)
        at = min(range(len(grams)), key=lambda i: (rank[k][grams[i]], i))
        entries[k].append((grams[at], w, at))
    out = {}
    for k, rows in entries.items():
        rows.sort()
        lookup = Lookup(np.array([r[0] for r in rows], np.uint64))
        bounds = np.searchsorted(np.array([r[0] for r in rows], np.uint64), lookup.hashes)
        out[k] = Prefixes(lookup, np.append(bounds, len(rows)), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
    return out


def _words(data: np.ndarray, at: np.ndarray):
    low = buffers.LOWER[data]
    starts, ends, first = buffers.spans(low, at, buffers.ALNUM)
    return low, starts, ends, first, buffers.word_hashes(low, starts, ends)


def _tokens(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    begin = buffers.whole_windows(first, k)
    return begin, buffers.window_hashes(words, k)[begin] if len(begin) else np.zeros(0, np.uint64)


def count_shingles(docs: DataFrame, lookups: dict[int, Lookup]) -> dict[tuple[int, int], int]:
    """How often all documents hold each shingle of the block; the result has
    a row for each shingle of the block at most."""
    shared = docs.sparkSession.sparkContext.broadcast(lookups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {k: np.zeros(len(x.hashes), np.int64) for k, x in shared.value.items()}
        for batch in batches:
            for _, data, at in buffers.slices(batch):
                *_, first, words = _words(data, at)
                for k, lookup in shared.value.items():
                    np.add.at(counts[k], lookup.find(_tokens(words, first, k)[1])[1], 1)
        for k, x in counts.items():
            some = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(x[some])], names=["k", "i", "n"])

    rows = docs.mapInArrow(run, "k int, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    # as many rows as the block has shingles, at most
    return {(r.k, r.i): r.n for r in rows.collect()}


def find_windows(data: np.ndarray, at: np.ndarray, windows: Windows, prefixes: dict[int, Prefixes]):
    """(first, starts, windows): index of each text's first word, and all
    occurrences as the index of their first word and the window's number."""
    low, begin, end, first, words = _words(data, at)
    whole = low.tobytes()
    counts = np.diff(first)
    text_of = np.repeat(np.arange(len(counts)), counts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, p in prefixes.items():
        places, tokens = _tokens(words, first, k)
        hit, where = p.lookup.find(tokens)
        many = p.bounds[where + 1] - p.bounds[where]
        entry = np.repeat(p.bounds[where], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        place, w = np.repeat(places[hit], many), p.window[entry]
        start, size = place - p.offset[entry], windows.words[w]
        fits = (start >= first[text_of[place]]) & (start + size <= first[text_of[place] + 1])
        start, w, size = start[fits], w[fits], size[fits]
        for n in np.unique(size).tolist():
            s, v = start[size == n], w[size == n]
            same = np.zeros(len(s), bool)
            for i in range(0, len(s), 1 << 16):
                own = words[(s[i : i + (1 << 16), None] + np.arange(n)).ravel()]
                same[i : i + (1 << 16)] = buffers.window_hashes(own, n)[::n] == windows.hashes[v[i : i + (1 << 16)]]
            s, v = s[same], v[same]
            exact = [b" ".join(whole[a:b] for a, b in zip(begin[x : x + n], end[x : x + n])) == windows.texts[y] for x, y in zip(s.tolist(), v.tolist())]
            found.append((s[exact], v[exact]))
    return first, np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


_HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("texts", T.ArrayType(T.StringType()))])
_HIT_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


def _marked(rows: DataFrame, windows: Windows, some: bool) -> DataFrame:
    """rows(…, text, hit) with their last column renewed by the windows of a
    block, and without the text: spans are word indexes, begin and end by
    turns. some: only rows with a hit in this block."""
    prefixes = prefixes_of(windows, lookups := shingle_lookups(windows), count_shingles(rows.select(F.col(base.quoted(rows.columns[-2])).alias("text")), lookups))
    shared = rows.sparkSession.sparkContext.broadcast((windows, prefixes))
    numbered = base.numbered(rows)
    text = numbered.columns[-2]
    schema = T.StructType([*numbered.schema.fields[:-2], T.StructField("hit", _HIT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in buffers.slices(batch, text):
                own, prefix = shared.value
                first, starts, number = find_windows(data, at, own, prefix)
                before = part.column(part.num_columns - 1).to_pylist()
                cover = np.zeros(first[-1] + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + own.words[number], -1)
                texts = [set(x["texts"]) if x else set() for x in before]
                for i, x in enumerate(before):
                    for a, b in zip(x["spans"][::2], x["spans"][1::2]) if x else ():
                        cover[first[i] + a] += 1
                        cover[first[i] + b] -= 1
                for i, w in set(zip((np.searchsorted(first, starts, "right") - 1).tolist(), number.tolist())):
                    texts[i].update(own.owners[w])
                inside = np.cumsum(cover[:-1]) > 0
                out = []
                for i, own_texts in enumerate(texts):
                    a, b = int(first[i]), int(first[i + 1])
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[a:b], [False]]).astype(np.int8))) if own_texts else np.zeros(0, np.int64)
                    out.append({"n_words": b - a, "spans": edge.tolist(), "texts": sorted(own_texts)})
                done = pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(out, _HIT_ARROW)], names=schema.names)
                yield done.filter(pa.array([bool(x) for x in texts])) if some else done

    return numbered.mapInArrow(run, schema).toDF(*rows.columns[:-2], rows.columns[-1])


def blocks_of(pieces: DataFrame) -> list[DataFrame]:
    """The pieces in blocks of about BLOCK_BYTES."""
    n = pieces.agg(F.sum(F.octet_length("piece")).alias("n")).first().n or 0
    parts = max(1, -(-n // BLOCK_BYTES))
    if parts == 1:
        return [pieces]
    return [pieces.where(F.pmod(F.xxhash64("text", "no"), F.lit(parts)) == i) for i in range(parts)]


def contamination(docs: DataFrame, bench: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns keep of docs and last a struct: n_words, the word spans
    inside windows, and the digests of the texts they come from; and (item,
    text), whose items those are."""
    items, pieces = texts_of(bench)
    blocks = blocks_of(pieces)
    hit, body = base.fresh(docs, "hit", "body")
    none = F.lit(None).cast(_HIT).alias(hit)
    rows = docs.select(*[F.col(base.quoted(c)) for c in keep], F.col("text").alias(body), none)
    if len(blocks) > 1:
        where = base.located(docs := base.filed(docs))
        file, row = where.columns[-2:]
        found = None
        for block in blocks[:-1]:
            own = _marked(where.select(file, row, "text", none), _collected(block), True)
            own = base.stored(own, "hits")
            found = own if found is None else found.union(own)
        merged = found.groupBy(file, row).agg(F.flatten(F.collect_list(f"{hit}.spans")).alias("s"), F.flatten(F.collect_list(f"{hit}.texts")).alias("t"))
        merged = base.stored(merged.select(file, row, F.struct(F.lit(0).cast("long").alias("n_words"), F.col("s").alias("spans"), F.col("t").alias("texts")).alias(hit)), "hits")
        rows = where.join(base.maybe_broadcast(merged, merged.count(), BROADCAST_ROWS), [file, row], "left")
        rows = rows.select(*[F.col(base.quoted(c)) for c in keep], F.col("text").alias(body), hit)
    return _marked(rows, _collected(blocks[-1]), False), items


def _collected(block: DataFrame) -> Windows:
    return windows_of([(r.text, bytes(r.piece)) for r in block.orderBy("text", "no").collect()])


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    rows, _ = contamination(docs, bench, docs.columns)
    return rows.where(F.size(F.col(rows.columns[-1]).getField("texts")) == 0).select(*base.columns_of(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def hit_words(spans: str):
    ends = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return ends


def scored(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings) of every document."""
    rows, items = contamination(docs.select("doc_id", "text"), bench, ["doc_id"])
    rows = base.stored(rows.withColumn("key", F.monotonically_increasing_id()), "contamination")
    found = rows.where(F.size("hit.texts") > 0).select("key", F.explode("hit.texts").alias("text")).join(items, "text")
    found = found.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = base.stored(found, "found-items")
    rows = rows.join(base.maybe_broadcast(found, found.count(), BROADCAST_ROWS), "key", "left")
    return rows.select("doc_id", F.col("hit.n_words").alias("n_words"), hit_words("hit.spans").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[str, list[str]]]) -> tuple[int, int, int, str, bool]:
    """The contract spelled out for one text, for tests."""
    import re

    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, ids = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(body))
        size = min(WINDOW, len(own))
        for j in range(len(own) - size + 1 if own else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    hit |= set(range(i, i + size))
                    ids.add(item)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


OP3_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)
), hits AS (SELECT r, i, p.size, item FROM places p JOIN windows v ON p.g = v.g AND p.size = v.size
), words AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS k FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
