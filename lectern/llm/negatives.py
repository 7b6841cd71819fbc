"""Hard negatives by distributed radix selection.

An anchor's row of scores is an integer inner product with every other row.
Each (anchor, positive) pair opens a window of scores; its k best rows of
another label are found without sorting or gathering the window. A pass counts
scores by their highest digit, one histogram for each window, summed over all
tasks; the bucket that holds the kth score becomes the window of the next
pass, digit by digit, until it is a single score. Then only the rows at or
above it travel: at most k from each slice of rows, so equal scores, however
many, cost no more.

Anchors and rows meet in blocks: BLOCK anchors with ROWS rows. Both sides are
shuffled to the pair's task, which holds its anchors and streams the rows in
slices; nothing goes through the driver but the counts of rows, anchors and
open windows.

Rows with a null id, label or vector, or a null or non-finite component, take
no part. Equal rows count once; an anchor's other rows are those with another
id, and rows that share an id but differ are rows (and anchors) of their own.
Vectors of fewer components have zeros in the others. Scores beyond a long
stop at its ends. An anchor without positives, or whose windows are empty, has
no rows; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import base

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's share of the positive's score, as (numerator, denominator).
LEAST, MOST = (50, 100), (95, 100)
#: Anchors and rows of a task.
BLOCK, ROWS = 1024, 8192
SLICE = 2048
#: Buckets of a digit.
DIGIT_BITS = 8
_END = 2**63 - 1


def taking_part(rows: DataFrame, vec_id: Column, label: Column, vector: Column) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each once."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.select(vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x), one row a vector, zeros behind shorter ones."""
    if not len(column):
        return np.zeros((0, 0))
    at = column.offsets.to_numpy().astype(np.int64)
    flat = np.floor(column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] * SCALE)
    sizes = np.diff(at)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs; floating point only where it is exact."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = d * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T if d else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -_END, _END).astype(np.int64)


def _met(rows: DataFrame, anchors: DataFrame, parts: int, blocks: int, work: Callable, out: str) -> DataFrame:
    """work on every block of anchors and its stream of rows. Both have
    vec_id, label, v; anchors have anchor and, for their windows, the arrays
    low, high and shift."""
    blank = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high", "shift")]
    one = anchors.select(F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "anchor", "vec_id", "label", "low", "high", "shift", "v")
    two = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("anchor"), "vec_id", "label", *blank, "v")
    dealt = one.unionByName(two).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, holds, now = [], None, None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]])
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                pair = tuple(key[i, :2])
                if pair != now:
                    if holds is not None:
                        yield from holds.end()
                    held, holds, now = [], None, pair
                if key[i, 2] == 0:
                    held.append(batch.slice(i, j - i))
                elif held:
                    if holds is None:
                        holds = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    for k in range(i, j, SLICE):
                        yield from holds.rows(batch.slice(k, min(SLICE, j - k)))
        if holds is not None:
            yield from holds.end()

    return dealt.mapInArrow(run, out)


class _Anchors:
    """A block of anchors as matrices; a window that an anchor lacks is
    empty."""

    def __init__(self, batch: pa.RecordBatch):
        self.key, self.id, self.label = (batch.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        self.v = _matrix(batch.column("v"))
        lists = [batch.column(c).to_pylist() for c in ("low", "high", "shift")]
        self.windows = [np.full((len(self.key), max(map(len, lists[0]))), x, np.int64) for x in (1, 0, 0)]
        for values, to in zip(lists, self.windows):
            for i, own in enumerate(values):
                to[i, : len(own)] = own

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()

    def within(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each window number: anchors, rows and scores inside it."""
        low, high, _ = self.windows
        score = _scores(self.v, _matrix(batch.column("v")))
        least = np.where(low <= high, low, _END).min(axis=1)
        a, r = np.nonzero((score >= least[:, None]) & (self.label[:, None] != batch.column("label").to_numpy()))
        s = score[a, r]
        for w in range(low.shape[1]):
            inside = np.flatnonzero((s >= low[a, w]) & (s <= high[a, w]))
            yield w, a[inside], r[inside], s[inside]


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first k of their group, best score first and
    then least id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    begin = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    turn = np.arange(len(g)) - np.maximum.accumulate(np.where(begin, np.arange(len(g)), 0))
    return order[turn < k]


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


class _Positives(_Anchors):
    k = POSITIVES

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        label, ids, v = batch.column("label").to_numpy(), batch.column("vec_id").to_numpy(), _matrix(batch.column("v"))
        for one in np.intersect1d(label, self.label):
            a, r = np.flatnonzero(self.label == one), np.flatnonzero(label == one)
            score = _scores(self.v[a], v[r])
            i, j = np.nonzero(self.id[a][:, None] != ids[r])
            best = _first(i, score[i, j], ids[r][j], self.k)
            yield _table(anchor=self.key[a][i[best]], vec_id=ids[r][j[best]], score=score[i[best], j[best]])


class _Histogram(_Anchors):
    k = NEGATIVES

    def __init__(self, batch: pa.RecordBatch):
        super().__init__(batch)
        self.counts = np.zeros(self.windows[0].size << DIGIT_BITS, np.int64)

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, high, shift = self.windows
        for w, a, _, s in self.within(batch):
            bucket = (high[a, w].astype(np.uint64) - s.astype(np.uint64)) >> shift[a, w].astype(np.uint64)
            np.add.at(self.counts, ((a * high.shape[1] + w) << DIGIT_BITS) + bucket.astype(np.int64), 1)
        yield from ()

    def end(self) -> Iterator[pa.RecordBatch]:
        # the kth score of all is no lower than the kth in here, so later buckets tell nothing
        counts = self.counts.reshape(-1, 1 << DIGIT_BITS)
        at = np.flatnonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < self.k))
        a, w = np.divmod(at >> DIGIT_BITS, self.windows[0].shape[1])
        yield _table(anchor=self.key[a], turn=w, bucket=at & ((1 << DIGIT_BITS) - 1), n=self.counts[at])


class _Gather(_Anchors):
    k = NEGATIVES

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("vec_id").to_numpy()
        for w, a, r, s in self.within(batch):
            best = _first(a, s, ids[r], self.k)
            yield _table(anchor=self.key[a[best]], turn=np.full(len(best), w), vec_id=ids[r[best]], score=s[best])


def _shift(low: Column, high: Column) -> Column:
    """Bits below the highest digit of a window's width."""
    bits = F.when(high > low, F.length(F.bin(high - low))).otherwise(0)
    return F.greatest(bits - F.lit(DIGIT_BITS), F.lit(0)).cast("long")


def _share(column: str, part: tuple[int, int], up: bool) -> Column:
    """column * part, rounded up or down, without leaving a long."""
    n, d = part
    rest = f"pmod({column}, {d}L)"
    return F.expr(f"({column} - {rest}) div {d} * {n} + ({rest} * {n} + {d - 1 if up else 0}) div {d}")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: tuple[int, int] = LEAST, most: tuple[int, int] = MOST) -> DataFrame:
    """From taking_part()'s rows: for each anchor (where the column holds) and
    each of its first positives, the first negatives in the window: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    rows = base.stored(rows, "vectors")
    chosen = base.stored(rows.where(anchors).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    parts, blocks = (-(-df.count() // size) or 1 for df, size in ((rows, ROWS), (chosen, BLOCK)))
    none = [F.array().cast("array<long>").alias(c) for c in ("low", "high", "shift")]
    work = {c: type(c.__name__, (c,), {"k": k}) for c, k in ((_Positives, positives), (_Histogram, negatives), (_Gather, negatives))}

    found = _met(rows, chosen.select("*", *none), parts, blocks, work[_Positives], "anchor long, vec_id long, score long")
    pairs = _top(found, ["anchor"], positives).select("anchor", (F.col("rank") - 1).cast("long").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # low and high narrow to the bucket of the kth score; high of a settled window is the pair's own again
    low, high = _share("positive_score", least, True), _share("positive_score", most, False)
    state = base.stored(pairs.select("*", low.alias("low"), high.alias("high"), F.lit(negatives).cast("long").alias("need"), F.lit(True).alias("open"), high.alias("top")), "windows")

    def with_windows(windows: DataFrame, high: str) -> DataFrame:
        one = F.struct("turn", "low", F.col(high).alias("high"), _shift(F.col("low"), F.col(high)).alias("shift"))
        # a window that does not take part is an empty one, so that turns stay in place
        shut = F.struct("turn", F.lit(1).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("shift"))
        packed = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.when(F.col("open") if high == "high" else F.lit(True), one).otherwise(shut))).alias("w"))
        return chosen.join(packed, "anchor").select("*", *[F.col(f"w.{c}").alias(c) for c in ("low", "high", "shift")])

    while state.where("open").limit(1).count():
        counts = _met(rows, with_windows(state, "high"), parts, blocks, work[_Histogram], "anchor long, turn long, bucket long, n long").groupBy("anchor", "turn", "bucket").agg(F.sum("n").alias("n"))
        so_far = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("anchor", "turn").orderBy("bucket"))).join(state.select("anchor", "turn", "need"), ["anchor", "turn"])
        kth = so_far.where("upto >= need").groupBy("anchor", "turn").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("kth"))
        shift = _shift(F.col("low"), F.col("high"))
        after = state.join(kth, ["anchor", "turn"], "left").withColumn("shift", shift)
        high_ = F.expr("high - shiftleft(kth.bucket, CAST(shift AS INT))")
        low_ = F.greatest("low", high_ - F.expr("shiftleft(1L, CAST(shift AS INT)) - 1"))
        narrowed = F.col("open") & F.col("kth").isNotNull()
        after = after.select(
            "anchor", "turn", "positive_id", "positive_score", F.when(narrowed, low_).otherwise(F.col("low")).alias("low"), F.when(narrowed, high_).otherwise(F.col("high")).alias("high"),
            F.when(narrowed, F.col("need") - F.col("kth.before")).otherwise(F.col("need")).alias("need"), (narrowed & (F.col("shift") > 0)).alias("open"), "top",
        )
        after = base.stored(after, "windows")
        base.discard(state)
        state = after

    gathered = _met(rows, with_windows(state, "top"), parts, blocks, work[_Gather], "anchor long, turn long, vec_id long, score long")
    best = _top(gathered, ["anchor", "turn"], negatives).withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id")
    named = chosen.select("anchor", F.col("vec_id").alias("anchor_id")).join(state.select("anchor", "turn", "positive_id", "positive_score"), "anchor").join(best, ["anchor", "turn"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = taking_part(base.table(spark, sf_dir, "embeddings"), vec_id, moved, F.col("embedding"))
    return mined(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 3
"""
