"""SimHash near-duplicates, found by anchor-point covering.

A fingerprint has two halves of 32 bits. Of two fingerprints that differ in 3
bits or fewer, one half differs in at most 1. Anchors of a half are the words
of a covering code: the perfect Hamming [31, 26] code with the last bit
free, covering radius 1. A fingerprint is at home at the anchor within the
radius, and visits all anchors within radius plus 1, the threshold of a half:
2 to 17 of 2^27. So two linked fingerprints always meet where one is at home,
and only a home is compared with the visitors of its anchor.

Only distinct fingerprints travel, so copies cost nothing. Tasks read anchors
in sorted order; an anchor of more than HOT_ANCHOR rows is set aside as it
streams by, and then compared in square blocks that many tasks share. Links
leave a large anchor as a spanning forest, never as all pairs.

Null and empty texts, and those without words: fingerprint zero, linked like
any other. Null doc_id: takes its group's least id, never gives it. Repeated
rows: the same class. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, buffers, components

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Rows of an anchor that one task compares; larger ones go in blocks.
HOT_ANCHOR = 4096
BLOCK = 2048
#: Up to so many rows an anchor's links leave as they are found.
SMALL = 16

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_TOP = np.uint64(1 << 31)
#: Columns of the parity check matrix are 1 to 31: bit b of the syndrome is
#: the parity of the positions whose number has bit b.
_CHECKS = [np.uint64(sum(1 << (j - 1) for j in range(1, 32) if j >> b & 1)) for b in range(5)]
_FLIP = np.array([0] + [1 << (j - 1) for j in range(1, 32)], np.uint64)
#: For each syndrome, the 15 pairs of positions that lead to a codeword.
_PAIRS = np.array([[0] * 15] + [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] for s in range(1, 32)], np.uint64)


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()
    if len(words) < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    begin = [0, *np.cumsum([len(w) + 1 for w in words]).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(begin, begin[SHINGLE:])]


def fingerprints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bit i of a text's fingerprint is set if it is in over half the hashes.
    Bits are added eight to a 64-bit word, 255 hashes at a time."""
    whole, n = data.tobytes(), len(at) - 1
    found = [shingle_hashes(whole[at[i] : at[i + 1]]) for i in range(n)]
    counts = np.array([len(x) for x in found], np.int64)
    out = np.zeros(n, np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    hashes = np.concatenate([np.array(found[i], np.uint64) for i in some])
    first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
    chunks = -(-counts[some] // 255)
    chunk_first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    begin = np.repeat(first, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(chunk_first, chunks))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.zeros((len(some), 64), bool)
    for k in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, k]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(lanes, chunk_first, axis=0) > counts[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprinted(docs: DataFrame, keep: list[str] = []) -> DataFrame:
    """(doc_id, fp) of every document, and the long columns keep; fp is the
    fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(fingerprints(data, at).view(np.int64))], names=["doc_id", *keep, "fp"])

    schema = "".join(f"{c} long, " for c in ["doc_id", *keep])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text").mapInArrow(run, schema + "fp long")


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row of fps, at home) for all fingerprints; an anchor's number
    holds the half it belongs to."""
    keys, rows, home = [], [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        y = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        syndrome = sum((np.bitwise_count(y & m) & 1).astype(np.int64) << b for b, m in enumerate(_CHECKS))
        own = y ^ _FLIP[syndrome]
        off = np.flatnonzero(syndrome)
        part = [own, own ^ _TOP, *(y[off] ^ _PAIRS[syndrome[off], k] for k in range(15))]
        keys += [x | np.uint64(half << 32) for x in part]
        rows += [index, index, *[off] * 15]
        home += [np.ones(len(fps), bool), *[np.zeros(len(x), bool) for x in part[1:]]]
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(home)


def _visits(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 8192):
                fps = all_fps[i : i + 8192]
                keys, rows, home = anchors_of(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[rows].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return classes.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= DISTANCE


def _forest(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one anchor that span what its home fingerprints reach."""
    parent = np.arange(len(fps))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    a, b = [], []
    for h in np.flatnonzero(home):
        r = top(h)
        for j in np.flatnonzero(_near(fps, fps[h]) & (parent != r)):
            s = top(j)
            if s != r:
                parent[s] = r
                a.append(h)
                b.append(j)
        parent[h] = r
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def links_of_runs(keys: np.ndarray, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of the same key; rows come sorted by key."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([begin, [len(keys)]]))
    a, b = [], []
    small = np.repeat((length > 1) & (length <= SMALL), length)
    k, f, h = keys[small], fps[small], home[small]
    for lag in range(1, SMALL):
        if len(k) <= lag:
            break
        hit = (k[lag:] == k[:-lag]) & (h[lag:] | h[:-lag]) & _near(f[lag:], f[:-lag])
        a.append(f[:-lag][hit])
        b.append(f[lag:][hit])
    for i in np.flatnonzero(length > SMALL):
        run = slice(begin[i], begin[i] + length[i])
        x, y = _forest(fps[run], home[run])
        a.append(x)
        b.append(y)
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _table(a: np.ndarray, b: np.ndarray | None, anchor: np.ndarray | None = None, home: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b, anchor)]
    return pa.RecordBatch.from_arrays([*longs, pa.nulls(n, pa.bool_()) if home is None else pa.array(home)], names=["a", "b", "anchor", "home"])


def _compare(visits: DataFrame, aside: bool) -> DataFrame:
    """(a, b, anchor, home): links have no anchor; with aside, rows of hot
    anchors come back with theirs, a being the fingerprint."""

    def emit(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, hot: int | None) -> Iterator[pa.RecordBatch]:
        fps = fps.view(np.uint64)
        if aside:
            found, counts = np.unique(keys, return_counts=True)
            big = np.isin(keys, found[counts > HOT_ANCHOR]) | (hot is not None and keys == hot)
            if big.any():
                yield _table(fps[big], None, keys[big], home[big])
                keys, fps, home = keys[~big], fps[~big], home[~big]
        a, b = links_of_runs(keys, fps, home)
        if len(a):
            pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
            yield _table(pairs[:, 0], pairs[:, 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hot = None, None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            last = cols[0][-1]
            cut = int(np.searchsorted(cols[0], last, "left"))
            rest = [c[cut:] for c in cols]
            if cut:
                yield from emit(*(c[:cut] for c in cols), hot)
            if aside and (len(rest[0]) > HOT_ANCHOR or hot == last):
                hot = last
                yield _table(rest[1].view(np.uint64), None, rest[0], rest[2])
                rest = [c[:0] for c in rest]
        if rest is not None and len(rest[0]):
            yield from emit(*rest, hot)

    dealt = visits.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("anchor", "fp", "home").mapInArrow(run, "a long, b long, anchor long, home boolean")


def _in_blocks(hot: DataFrame) -> DataFrame:
    """Rows of hot anchors dealt to square blocks: homes of part i meet
    visitors of part j at block (i, j), which takes the place of the anchor."""
    sizes = hot.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    rows = hot.join(sizes, "anchor").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    homes = rows.where("home").select("anchor", F.col("part").alias("i"), others, "fp", "home").withColumnRenamed("other", "j")
    guests = rows.select("anchor", others, F.col("part").alias("j"), "fp", F.lit(False).alias("home")).withColumnRenamed("other", "i")
    return homes.unionByName(guests).select(F.xxhash64("anchor", "i", "j").alias("anchor"), "fp", "home")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints as the full set of
    pairs within DISTANCE does."""
    found = base.stored(_compare(_visits(classes), True), "anchors")
    near = found.where("b IS NOT NULL").select("a", "b")
    hot = found.where("b IS NULL").select("anchor", F.col("a").alias("fp"), "home")
    blocks = _compare(_in_blocks(hot), False).select("a", "b")
    return near.union(blocks)


def classes_of(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for all distinct fingerprints of (doc_id, fp)."""
    classes = base.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    reached = components.least_reachable(links(classes))
    tops = reached.select("b").distinct().select(F.col("b").alias("fp"), F.col("b").alias("top"))
    member = reached.select(F.col("a").alias("fp"), F.col("b").alias("top")).union(tops)
    member = member.join(classes, "fp")
    least = member.groupBy("top").agg(F.min("least_id").alias("component_id"))
    linked = member.select("fp", "top").join(least, "top").select("fp", "component_id")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed) and component_id of every document."""
    prints = base.stored(fingerprinted(docs), "prints")
    classes = base.stored(classes_of(prints), "groups-of")  # both sides of the join shuffle plainly, so AQE can split a hot fingerprint
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id, rows without
    an id last, and of equal ids the first row. Rows are removed, not ids, so
    what a row shares with others is its group alone."""
    # written with their keys, so that both readings see the same ones
    row, head = base.fresh(docs, "row_key", "head_key")
    rows = base.stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = fingerprinted(rows.select("doc_id", F.col(row).alias("key"), "text"), ["key"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")).alias("first")
    classes = base.stored(prints.groupBy("fp").agg(first), "classes")
    reached = components.least_reachable(links(classes)).select(F.col("a").alias("fp"), F.col("b").alias("top"))
    heads = classes.join(reached, "fp", "left").groupBy(F.coalesce("top", "fp").alias("top")).agg(F.min("first").alias("first"))
    heads = base.stored(heads.select(F.col("first.key").alias(head)), "heads")
    # a merge join at every size: the list of kept rows grows with the data
    return rows.join(heads.hint("merge"), F.col(row) == F.col(head), "left_semi").select(*base.columns_of(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(base.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
