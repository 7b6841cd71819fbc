"""Exact t-SNE of any number of points, by passes over all pairs.

Points stand in blocks, in the order of their ids. A pass deals the blocks out
to the tiles of a triangle, two blocks each, so every pair is met once and a
task holds some blocks (TASK_BYTES) and a few rows of two blocks' distances,
however many points there are. Affinities are made again in every pass: nothing of all pairs is
kept. What tiles give for a block is added in the order of the tiles, so equal
input gives the equal map. A pass is a written table; the driver sees a few
sums of each block. Work is points squared, for each of some 800 passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import storage

#: Points of a block at least and at most; between them there are BLOCKS.
LEAST, MOST, BLOCKS = 256, 4096, 16
#: Rows of a tile that are worked on at once, bytes that a task gets, or its two
#: blocks (one block's sums) if those are more, blocks of a task that adds up at
#: most, bisections.
ROWS, TASK_BYTES, ADDED, HALVINGS = 96, 1 << 26, 4, 60
#: No affinity is less, in the map or among the vectors.
FLOOR = 1e-12

STATE = "block int, body binary, totals array<double>"
#: sums of a tile for its two blocks, and one sum of all its pairs
Tile = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray, float]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _slices(n: int) -> Iterator[slice]:
    return (slice(i, min(n, i + ROWS)) for i in range(0, n, ROWS))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and y, in one product."""
    a = np.hstack([-2 * x, np.ones((len(x), 1)), np.einsum("ij,ij->i", x, x)[:, None]])
    b = np.hstack([y, np.einsum("ij,ij->i", y, y)[:, None], np.ones((len(y), 1))])
    d = a @ b.T
    return np.maximum(d, 0, out=d)


def blocks(points: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int]:
    """(block, vectors), (block, ids) and the length of a vector."""
    dim = points.select(F.size("vector")).first()[0]
    kind = np.float32 if dict(points.dtypes)["vector"] == "array<float>" else np.float64
    rows = storage.numbered(points.select(F.col("id").cast("long").alias("id"), "vector"), ["id"], "n")
    count = rows.count()
    dealt = rows.select(((F.col("n") - 1) / size).cast("int").alias("block"), "n", "id", "vector").repartitionById(-(-count // size), "block").sortWithinPartitions("n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if held is not None:
            if not pc.all(pc.equal(pc.list_value_length(held["vector"]), dim), skip_nulls=False).as_py():
                raise ValueError(f"a point has no vector of {dim} numbers")
            vectors = pc.list_flatten(held["vector"]).to_numpy().astype(kind)
            yield pa.RecordBatch.from_arrays([held["block"][:1].combine_chunks(), pa.array([vectors.tobytes()]), pa.array([held["id"].to_numpy().tobytes()])], names=["block", "body", "ids"])

    packed = storage.stored(dealt.mapInArrow(pack, "block int, body binary, ids binary"), "blocks")
    return packed.select("block", "body"), packed.select("block", "ids"), dim


class Passes:
    """Passes over all pairs of the points of some blocks."""

    def __init__(self, vectors: DataFrame, dim: int, kind: str, many: int, size: int):
        self.sums = max(-(-many // ADDED), min(many, -(-many * many * size * 32 // TASK_BYTES)))
        self.vectors, self.dim, self.many = vectors.coalesce(self.sums), dim, many
        self.points = lambda body: np.frombuffer(body, kind).reshape(-1, dim).astype(np.float64)
        tiles, row = many * (many + 1) // 2, size * (dim * np.dtype(kind).itemsize + 72)
        self.parts = max(min(tiles, vectors.sparkSession.sparkContext.defaultParallelism), -(-tiles * 2 * row // TASK_BYTES))

    def projected(self) -> DataFrame:
        """(block, body): two principal axes of all points, each turned so that
        its largest value is positive, as the start of a map."""
        points = self.points

        def each(f: Callable[[np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
            """What f adds up to over a few fixed groups of blocks, or of each block."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, first = None, 0
                for block, body in _rows(batches):
                    own = f(points(body))
                    total, first = (own, block) if total is None else ([a + b for a, b in zip(total, own)], first)
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([[x.tobytes() for x in total]])], names=["block", "sums"])

            groups = min(8, self.many)
            rows = self.vectors.repartitionById(groups, F.col("block") % groups).sortWithinPartitions("block")
            found = rows.mapInArrow(run, "block int, sums array<binary>").collect()
            return [[np.frombuffer(x) for x in r.sums] for r in sorted(found, key=lambda r: r.block)]

        added = each(lambda x: [x.sum(axis=0), np.array([float(len(x))])])
        n = sum(x[1][0] for x in added)
        mean = sum(x[0] for x in added) / n
        values, axes = np.linalg.eigh(sum(x[0] for x in each(lambda x: [(x - mean).T @ (x - mean)])).reshape(self.dim, self.dim))
        axes = axes[:, ::-1][:, :2]

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, body in _rows(batches):
                y = (points(body) - mean) @ axes
                at = y[np.abs(y).argmax(axis=0), range(y.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.tolist()])], names=["block", "at"])

        ends = [r["at"] for r in sorted(self.vectors.mapInArrow(largest, "block int, at array<double>").collect(), key=lambda r: r.block)]
        ends = np.array(ends)
        turn = np.where(ends[np.abs(ends).argmax(axis=0), range(ends.shape[1])] < 0, -1, 1)
        scale = 1e-4 / max(math.sqrt(max(values[-1], 0) / n), 1e-12)

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, body in _rows(batches):
                y = np.zeros((2, len(x := points(body))))
                y[: axes.shape[1]] = ((x - mean) @ axes * turn * scale).T
                body = np.vstack([y, np.full(len(x), -40.0), np.full(len(x), 40.0)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([body]), pa.array([[0.0]])], names=["block", "body", "totals"])

        return storage.stored(self.vectors.mapInArrow(start, STATE), "map")

    def over(self, state: DataFrame, columns: int, ready: Callable[[np.ndarray], np.ndarray], kept: int, tile: Tile, add=np.add) -> tuple[DataFrame, list[float]]:
        """state, whose rows hold so many columns of a block, made ready, which
        keeps so many, with the sums of all pairs as more columns; and totals:
        the tiles' sum, the number of points, and the sums of what is kept."""
        points, many = self.points, self.many

        def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, body in _rows(batches):
                own = ready(np.frombuffer(body).reshape(columns, -1))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([1], pa.int32()), pa.array([own.tobytes()])], names=["block", "kind", "body"])

        rows = self.vectors.select("block", F.lit(0).alias("kind"), "body").union(state.select("block", "body").coalesce(self.sums).mapInArrow(front, "block int, kind int, body binary"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
        high = F.greatest("block", "other")
        rows = rows.select((high * (high + 1) / 2 + F.least("block", "other")).cast("int").alias("tile"), "block", "kind", "body")
        dealt = rows.repartitionById(self.parts, F.col("tile") % self.parts).sortWithinPartitions("tile", "block", "kind")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, group in groupby(_rows(batches), key=itemgetter(0)):
                held = [(block, body) for _, block, _, body in group]
                sides = [(held[i][0], points(held[i][1]), held[i + 1][1]) for i in range(0, len(held), 2)]
                (a, x, own), (b, y, its) = sides[0], sides[-1]
                s, t = (np.frombuffer(w).reshape(kept, -1) for w in (own, its))
                mine, others, whole = tile(x, s, y, t, a == b)
                out = [(a, b, mine, own if a == b else None, whole)] + ([(b, a, others, None, 0.0)] if a != b else [])
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
                values = [[r[0] for r in out], [r[1] for r in out], [r[2].tobytes() for r in out], [r[3] for r in out], [r[4] for r in out]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "other", "body", "own", "whole"])

        met = dealt.mapInArrow(meet, "block int, other int, body binary, own binary, whole double")
        met = met.repartitionById(self.sums, F.col("block") % self.sums).sortWithinPartitions("block", "other")

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, group in groupby(_rows(batches), key=itemgetter(0)):
                total, own, whole = None, b"", 0.0
                for _, _, body, mine, part in group:
                    sums = np.frombuffer(body)
                    total, own, whole = sums if total is None else add(total, sums), mine or own, whole + part
                held = np.frombuffer(own).reshape(kept, -1)
                totals = [whole, float(held.shape[1]), *held.sum(axis=1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([own + total.tobytes()]), pa.array([totals])], names=["block", "body", "totals"])

        seen = Observation()
        after = storage.stored(met.mapInArrow(added, STATE).observe(seen, F.collect_list(F.struct("block", "totals")).alias("totals")), "map")
        storage.discard(state)
        totals = {r.block: r.totals for r in seen.get["totals"]}
        return after, [math.fsum(x) for x in zip(*[totals[k] for k in range(many)])]


def _nearest(x: np.ndarray, s: np.ndarray, y: np.ndarray, t: np.ndarray, same: bool):
    """Each point's least squared distance from another."""
    mine, others = np.full(len(x), np.inf), np.full(len(y), np.inf)
    for part in _slices(len(x)):
        d = _squares(x[part], y)
        if same:
            d[range(len(d)), range(part.start, part.stop)] = np.inf
        mine[part] = d.min(axis=1)
        np.minimum(others, d.min(axis=0), out=others)
    return mine, others, 0.0


def _weighed(x: np.ndarray, s: np.ndarray, y: np.ndarray, t: np.ndarray, same: bool):
    """Each point's sum of weights, and of distances by weight, under the
    middle of its bandwidth's bounds. s, t: x, y, low, high, least."""
    mine, others = np.zeros((2, len(x))), np.zeros((2, len(y)))
    wide, its = (np.exp((w[2] + w[3]) / 2) for w in (s, t))
    for part in _slices(len(x)):
        d = _squares(x[part], y)
        if same:
            d[range(len(d)), range(part.start, part.stop)] = np.inf
        far = np.maximum(d - s[4][part, None], 0)
        weight = np.exp(far * -wide[part, None])
        if same:
            far[range(len(d)), range(part.start, part.stop)] = 0
        mine[:, part] = weight.sum(axis=1), np.einsum("ij,ij->i", far, weight)
        if not same:
            np.maximum(np.subtract(d, t[4], out=d), 0, out=d)
            np.exp(np.multiply(d, -its, out=weight), out=weight)
            others += weight.sum(axis=0), np.einsum("ij,ij->j", d, weight)
    return mine, others, 0.0


def _forces(more: float, least: float) -> Tile:
    """Each point's pull and push, before the pushes are divided by the sum of
    all kernels, which is what the tiles sum up. s, t: scale, least, share (a
    logarithm), x, y and what a step keeps. Affinities count more times."""

    def tile(x: np.ndarray, s: np.ndarray, y: np.ndarray, t: np.ndarray, same: bool):
        mine, others, whole = np.zeros((4, len(x))), np.zeros((4, len(y))), 0.0
        ends = np.vstack([t[3:5], np.ones(len(y))]).T
        for part in _slices(len(x)):
            d = _squares(x[part], y)
            p = np.subtract(s[1][part, None], d)
            np.minimum(p, 0, out=p)
            p *= s[0][part, None]
            p += s[2][part, None]
            np.exp(p, out=p)
            np.minimum(np.subtract(t[1], d, out=d), 0, out=d)
            d *= t[0]
            d += t[2]
            p += np.exp(d, out=d)
            np.maximum(p, FLOOR, out=p)
            begins = np.vstack([s[3:5, part], np.ones(len(p))]).T
            kernel = _squares(begins[:, :2], ends[:, :2])
            kernel += 1
            np.divide(1, kernel, out=kernel)
            if same:
                kernel[range(len(p)), range(part.start, part.stop)] = 0
            whole += kernel.sum() * (1 if same else 2)
            p *= kernel
            np.maximum(kernel, least, out=d)
            d *= kernel
            for k, w in ((0, p), (2, d)):
                there = w @ ends
                mine[k : k + 2, part] = begins.T[:2] * there.T[2] - there.T[:2]
                if not same:
                    back = w.T @ begins
                    others[k : k + 2] += ends.T[:2] * back.T[2] - back.T[:2]
        mine[:2] *= more
        others[:2] *= more
        return mine, others, whole

    return tile


def tsne(points: DataFrame, perplexity: float, steps: int, exaggeration: float, exaggerated: int) -> DataFrame:
    """(id, x, y) of all of points(id, vector), at least five: the method of
    landscape.embed2, but that the floor of a pair's kernel is a share of the
    last step's sum."""
    n = points.count()
    size = min(MOST, max(LEAST, -(-n // BLOCKS)))
    with storage.scratch() as made:
        vectors, ids, dim = blocks(points, size)
        passes = Passes(vectors, dim, "f4" if dict(points.dtypes)["vector"] == "array<float>" else "f8", -(-n // size), size)
        state, _ = passes.over(passes.projected(), 4, lambda c: c, 4, _nearest, np.minimum)
        aim = math.log(min(perplexity, max(1.0, (n - 1) / 3)))

        def halved(c: np.ndarray) -> np.ndarray:
            y, (low, high), least, (total, far) = c[:2], c[2:4], c[4:5], c[5:]
            middle = (low + high) / 2
            wide = np.log(total) + np.exp(middle) * far / total > aim
            return np.vstack([y, np.where(wide, middle, low), np.where(wide, high, middle), least])

        state, _ = passes.over(state, 5, lambda c: c, 5, _weighed)
        for _ in range(HALVINGS):
            state, _ = passes.over(state, 7, halved, 5, _weighed)

        def begun(c: np.ndarray) -> np.ndarray:
            still, one = np.zeros((2, c.shape[1])), np.ones((2, c.shape[1]))
            return np.vstack([np.exp((c[2] + c[3]) / 2), c[4], -np.log(2 * n * c[5]), c[:2], still, one])

        rate = max(50.0, n / exaggeration)

        def moved(step: int, whole: float, middle: list[float]) -> Callable[[np.ndarray], np.ndarray]:
            def after(c: np.ndarray) -> np.ndarray:
                own, y, speed, gain = c[:3], c[3:5] - np.array(middle)[:, None], c[5:7], c[7:9]
                slope = 4 * (c[9:11] - c[11:13] / whole)
                gain = np.clip(np.where((slope > 0) == (speed > 0), gain * 0.8, gain + 0.2), 0.01, None)
                speed = (0.5 if step <= exaggerated else 0.8) * speed - rate * gain * slope
                return np.vstack([own, y + speed, speed, gain])

            return after

        ready, columns, whole = begun, 7, float(n) * (n - 1)
        for step in range(steps):
            state, totals = passes.over(state, columns, ready, 9, _forces(exaggeration if step <= exaggerated else 1.0, FLOOR * whole))
            whole = totals[0]
            ready, columns = moved(step, whole, [totals[5] / n, totals[6] / n]), 13

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, body in _rows(batches):
                y = ready(np.frombuffer(body).reshape(columns, -1))[3:5]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([y.tobytes()]), pa.array([y.sum(axis=1).tolist()])], names=["block", "body", "totals"])

        found = storage.stored(state.select("block", "body").mapInArrow(last, STATE), "map")
        middle = [math.fsum(x) / n for x in zip(*[r.totals for r in found.select("totals").collect()])]

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for body, own in _rows(batches):
                y = np.frombuffer(body).reshape(2, -1) - np.array(middle)[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(own, np.int64)), pa.array(y[0]), pa.array(y[1])], names=["id", "x", "y"])

        out = storage.stored(found.join(ids, "block").select("body", "ids").mapInArrow(unpacked, "id long, x double, y double"), "fit")
        made.remove(out)
    return out
