"""A map of the catalog by meaning: t-SNE in two dimensions.

The exact method compares all pairs: up to FIT_POINTS the driver fits them all,
beyond that ``allpairs`` does, in passes that are distributed. New points are
placed by their nearest fitted neighbours (``vectors.place``). A caller that
can't wait for all pairs asks for a map of some points, a repeatable choice,
with all others placed; ``refined`` then moves all points by the method's own
gradient: pulls along a graph of nearest neighbours, pushes from the sums of a
grid. Equal input gives the equal map: the start is a sign-fixed projection,
and nothing is random.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from . import allpairs, vectors

#: Points that the driver fits by itself: three tables of all pairs, 128 MB each.
FIT_POINTS = 4000
PERPLEXITY, STEPS, EXAGGERATION, EXAGGERATED_STEPS = 30.0, 750, 12.0, 250


def _squares(x: np.ndarray) -> np.ndarray:
    n = np.einsum("ij,ij->i", x, x)
    return np.clip(np.add.outer(n, n) - 2 * x @ x.T, 0, None)


def affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities; all bandwidths are bisected at once
    until every row's entropy is that of the perplexity."""
    d = _squares(x)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    d = d - d.min(axis=1, keepdims=True)
    low, high = np.full(n, -40.0), np.full(n, 40.0)
    finite = np.where(np.isinf(d), 0, d)
    for _ in range(60):
        middle = (low + high) / 2
        p = np.exp(-d * np.exp(middle)[:, None])
        total = p.sum(axis=1)
        entropy = np.log(total) + np.exp(middle) * (finite * p).sum(axis=1) / total
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    p = np.exp(-d * np.exp((low + high) / 2)[:, None])
    p /= p.sum(axis=1, keepdims=True)
    return np.clip((p + p.T) / (2 * n), 1e-12, None)


def projection(x: np.ndarray) -> np.ndarray:
    """Two principal axes, each turned so that its largest value is positive."""
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    y = (x - x.mean(axis=0)) @ axes[:2].T
    if y.shape[1] < 2:
        y = np.hstack([y, np.zeros((len(y), 2 - y.shape[1]))])
    y *= np.where(y[np.abs(y).argmax(axis=0), [0, 1]] < 0, -1, 1)
    return 1e-4 * y / max(y[:, 0].std(), 1e-12)


def embed2(x: np.ndarray, perplexity: float = PERPLEXITY, steps: int = STEPS) -> np.ndarray:
    """Coordinates of all rows of x; fewer than five stand on a circle."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 5:
        turn = 2 * np.pi * np.arange(n) / max(1, n)
        return np.stack([np.cos(turn), np.sin(turn)], axis=1)
    p = affinities(x, min(perplexity, max(1.0, (n - 1) / 3)))
    y = projection(x)
    speed, gain = np.zeros_like(y), np.ones_like(y)
    rate = max(50.0, n / EXAGGERATION)
    stronger, kernel, pull = p * EXAGGERATION, np.empty_like(p), np.empty_like(p)
    for step in range(steps):
        early = step <= EXAGGERATED_STEPS
        # two tables of all pairs, written in place
        own = np.einsum("ij,ij->i", y, y)
        np.add.outer(own, own, out=kernel)
        kernel -= np.matmul(2 * y, y.T, out=pull)
        np.maximum(kernel, 0, out=kernel)
        kernel += 1
        np.divide(1, kernel, out=kernel)
        np.fill_diagonal(kernel, 0)
        np.divide(kernel, kernel.sum(), out=pull)
        np.maximum(pull, 1e-12, out=pull)
        np.subtract(stronger if early else p, pull, out=pull)
        pull *= kernel
        total = pull.sum(axis=1) - pull.diagonal()
        np.negative(pull, out=pull)
        np.fill_diagonal(pull, total)
        pull *= 4
        slope = pull @ y
        against = (slope > 0) == (speed > 0)  # still the same way as the last step
        gain = np.clip(np.where(against, gain * 0.8, gain + 0.2), 0.01, None)
        speed = (0.5 if early else 0.8) * speed - rate * gain * slope
        y = y + speed
        y = y - y.mean(axis=0)
    return y


def fit(points: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, x, y, placed) for points(id, vector): all fitted, or with a limit
    so many chosen ones, and the rest placed among them."""
    spark = points.sparkSession
    if limit is None and points.limit(FIT_POINTS + 1).count() > FIT_POINTS:
        whole = allpairs.tsne(points, PERPLEXITY, STEPS, EXAGGERATION, EXAGGERATED_STEPS)
        return whole.withColumn("placed", F.lit("fit"))
    chosen = points if limit is None else points.orderBy(F.xxhash64("id"), "id").limit(limit)
    chosen = chosen.select("id", "vector").toPandas().sort_values("id")
    if not len(chosen):
        return spark.createDataFrame([], "id long, x double, y double, placed string")
    y = embed2(np.stack(chosen.vector.map(np.asarray).to_list()))
    fitted = spark.createDataFrame([(int(i), float(a), float(b), "fit") for i, (a, b) in zip(chosen.id, y)], "id long, x double, y double, placed string")
    if limit is None:
        return fitted
    rest = points.join(storage.small(fitted.select("id")), "id", "left_anti")
    return fitted.union(placed(fitted, points, rest))


def place_term(coords: DataFrame, points: DataFrame, query: list[float]) -> DataFrame:
    """(x, y) of a search term's vector among the points of the map; no row
    where nothing is placed. Ten ranked rows meet their coordinates."""
    there = points.join(coords.select("id"), "id", "left_semi")
    near = vectors.rank(there, query, 10).join(coords.select("id", "x", "y"), "id")
    weight = F.pow(F.greatest("similarity", F.lit(0.05)), 2)
    return near.agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in ("x", "y")]).where("x IS NOT NULL")


def placed(fitted: DataFrame, points: DataFrame, new: DataFrame) -> DataFrame:
    return vectors.place(fitted, points, new).select("id", "x", "y", F.lit("incremental").alias("placed"))


def refreshed(coords: DataFrame, points: DataFrame) -> DataFrame:
    """coords without points that are gone, and with new ones placed."""
    kept = coords.join(points.select("id"), "id", "left_semi")
    new = points.join(kept.select("id"), "id", "left_anti")
    return kept.select("id", "x", "y", "placed").union(placed(kept, points, new))


def projected(c, coords: DataFrame) -> DataFrame:
    """Map points with type, month and cluster; -1 where a topic is unknown."""
    lead = c["publication_topics"].where("position = 1").join(storage.small(c["topics"]), F.col("topic_slug") == F.col("slug")).select(F.col("publication_id").alias("id"), "label", "cluster")
    scope = c["publications"].where("parent_id IS NULL AND pub_type <> 'Podcast'").select("id", "title", "pub_type", F.date_format("date_published", "yyyy-MM").alias("month"))
    return coords.join(scope, "id").join(lead, "id", "left").select("id", "x", "y", "title", "pub_type", "month", "label", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


#: Anchors whose cells a point visits, points for each anchor (of FIT_POINTS at
#: most), and points of a cell that one task compares.
PROBES, SHARE, CELL = 8, 256, 2048
#: Cells of the grid on a side.
GRID = 64


def neighbour_graph(points: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(id, other, s): the k nearest of each of points(id, vector), unit
    vectors, among those that share one of its PROBES nearest anchors, which
    are FIT_POINTS of the points at most. A cell of more than CELL points is
    compared in square blocks; ties go to the lesser id."""
    near = vectors._nearest(points, anchors.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "vector"), PROBES)
    homes = near.select("id", F.explode("near").alias("a")).select("id", F.col("a.anchor").alias("cell")).join(points.select("id", "vector"), "id")
    homes = storage.stored(homes, "cells")
    sizes = homes.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts"))
    rows = homes.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    asks = rows.select("cell", F.col("part").alias("i"), every, "id", "vector", F.lit(True).alias("asks")).withColumnRenamed("other", "j")
    offers = rows.select("cell", every, F.col("part").alias("j"), "id", "vector", F.lit(False).alias("asks")).withColumnRenamed("other", "i")
    dealt = asks.unionByName(offers).select(F.xxhash64("cell", "i", "j").alias("block"), "asks", "id", "vector").repartition("block").sortWithinPartitions("block", "asks", "id")

    def one(rows: pa.Table) -> pa.RecordBatch:
        asks, ids = rows.column("asks").to_numpy(), rows.column("id").to_numpy()
        v = np.array(rows.column("vector").to_pylist(), np.float64)
        offered, out = np.flatnonzero(~asks), [[], [], []]
        for i in np.flatnonzero(asks).tolist():
            s = v[offered] @ v[i]
            best = np.lexsort((ids[offered], -s))[: k + 1]
            best = best[ids[offered][best] != ids[i]][:k]
            for to, values in zip(out, (np.full(len(best), ids[i]), ids[offered][best], s[best])):
                to.append(values)
        a, b, s = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64(), safe=False), pa.array(b, pa.int64(), safe=False), pa.array(s, pa.float64())], names=["id", "other", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for i, j in zip(edges, edges[1:]):
                if i == j:
                    continue
                if held and held[-1].column(0)[0].as_py() != block[i]:
                    yield one(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield one(pa.Table.from_batches(held))

    found = dealt.mapInArrow(run, "id long, other long, s double").groupBy("id", "other").agg(F.max("s").alias("s"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "other"))
    return found.withColumn("turn", turn).where(F.col("turn") <= k).drop("turn")


def graph_affinities(graph: DataFrame, perplexity: float) -> DataFrame:
    """(id, other, p): symmetric probabilities that add up to 1, each point's
    bandwidth bisected until its neighbours' entropy is that of the
    perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for near in batch.column(1).to_pylist():
                d = np.array([2 - 2 * x["s"] for x in near])
                d, low, high = d - d.min(), -40.0, 40.0
                for _ in range(60):
                    middle = (low + high) / 2
                    p = np.exp(-d * np.exp(middle))
                    entropy = np.log(p.sum()) + np.exp(middle) * (d * p).sum() / p.sum()
                    low, high = (middle, high) if entropy > np.log(min(perplexity, len(d))) else (low, middle)
                out.append([{"other": x["other"], "p": float(y)} for x, y in zip(near, p / p.sum())])
            kind = pa.list_(pa.struct([("other", pa.int64()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["id", "near"])

    own = graph.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("other", "s"))).alias("near")).mapInArrow(run, "id long, near array<struct<other: long, p: double>>")
    one = own.select("id", F.explode("near").alias("n")).select("id", "n.other", "n.p")
    both = one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "p")).groupBy("id", "other").agg(F.sum("p").alias("p"))
    total = both.agg(F.sum("p")).first()[0]
    return both.withColumn("p", F.col("p") / F.lit(total or 1.0))


def refined(coords: DataFrame, points: DataFrame, steps: int = 150, perplexity: float = PERPLEXITY) -> DataFrame:
    """coords(id, x, y, placed) after gradient steps over all points. Pulls are
    sums over the edges of a point's neighbours, added up before they are
    shuffled; pushes come from the counts and middles of GRID * GRID cells at
    most, all that the driver and the tasks hold of the others. A step is a
    written table."""
    n = coords.count()
    points = storage.stored(points.join(coords.select("id"), "id", "left_semi").select("id", "vector"), "points")
    anchors = storage.stored(points.orderBy(F.xxhash64("id"), "id").limit(min(FIT_POINTS, max(1, n // SHARE))), "anchors")
    edges = storage.stored(graph_affinities(neighbour_graph(points, anchors, int(3 * perplexity)), perplexity), "edges")
    rate, one, nil = max(50.0, n / 4), F.lit(1.0), F.lit(0.0)
    now = storage.stored(coords.select("id", "x", "y", "placed", *[nil.alias(c) for c in ("vx", "vy")], *[one.alias(c) for c in ("gx", "gy")]), "map")
    for _ in range(steps):
        box = now.agg(*[f(c).alias(f"{c}{t}") for c in ("x", "y") for t, f in (("0", F.min), ("1", F.max))]).first()
        side = [max(box.x1 - box.x0, 1e-9), max(box.y1 - box.y0, 1e-9)]
        at = [F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(w) * GRID), F.lit(GRID - 1)) for c, lo, w in (("x", box.x0, side[0]), ("y", box.y0, side[1]))]
        celled = now.withColumn("cell", (at[0] * GRID + at[1]).cast("int"))
        cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).toArrow().to_pydict()
        keys, many, middles = np.array(cells["cell"]), np.array(cells["n"], float), np.stack([cells["x"], cells["y"]], axis=1)

        def pushes(batches: Iterator[pa.RecordBatch], keys=keys, many=many, middles=middles) -> Iterator[pa.RecordBatch]:
            place = {int(c): i for i, c in enumerate(keys)}
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    y = np.stack([part.column(1).to_numpy(), part.column(2).to_numpy()], axis=1)
                    away = y[:, None, :] - middles[None]
                    q = 1 / (1 + (away**2).sum(axis=2))
                    count = np.repeat(many[None], len(y), axis=0)
                    count[np.arange(len(y)), [place[c] for c in part.column(3).to_pylist()]] -= 1  # but for itself
                    push = ((count * q**2)[:, :, None] * away).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array((count * q).sum(axis=1)), pa.array(push[:, 0]), pa.array(push[:, 1])], names=["id", "z", "px", "py"])

        pushed = storage.stored(celled.select("id", "x", "y", "cell").mapInArrow(pushes, "id long, z double, px double, py double"), "pushes")
        z = pushed.agg(F.sum("z")).first()[0] or 1.0
        own, others = now.select("id", "x", "y"), now.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        weight = F.col("p") / (1 + F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2))
        pulled = edges.join(others, "other").join(own, "id").groupBy("id").agg(*[F.sum(weight * (F.col(c) - F.col(f"o{c}"))).alias(f"a{c}") for c in ("x", "y")])
        rows = now.join(pushed, "id").join(pulled, "id", "left")
        for c in ("x", "y"):
            slope = 4 * (F.coalesce(f"a{c}", nil) - F.col(f"p{c}") / F.lit(z))
            rows = rows.withColumn(f"s{c}", slope)
            rows = rows.withColumn(f"g{c}", F.least(F.greatest(F.when((F.col(f"s{c}") > 0) == (F.col(f"v{c}") > 0), F.col(f"g{c}") * 0.8).otherwise(F.col(f"g{c}") + 0.2), F.lit(0.01)), F.lit(10.0)))
            rows = rows.withColumn(f"v{c}", 0.8 * F.col(f"v{c}") - F.lit(rate) * F.col(f"g{c}") * F.col(f"s{c}")).withColumn(c, F.col(c) + F.col(f"v{c}"))
        after = storage.stored(rows.select(*now.columns), "map")
        storage.discard(now)
        storage.discard(pushed)
        now = after
    return now.select("id", "x", "y", "placed")
