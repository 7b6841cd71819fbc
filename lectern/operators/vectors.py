"""Vector ranking, rank fusion and hybrid search.

Vectors are scanned in full: a dot product per row inside codegen, the best
per publication by a map-side maximum, and a bounded top-k. The query vector
is a literal of the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from . import search as S

FUSION_K = 60
#: What a shortlisted publication gains: two positions at the top.
SHORTLIST_BOOST = 1 / (FUSION_K + 1) - 1 / (FUSION_K + 3)
SIM_ADJACENT, SIM_FLOOR = 0.40, 0.15
#: Placed points of a block: some 40 MB of 768 numbers each.
ANCHORS = 8192


def similarity(vector: Column, query: Sequence[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in query]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def rank(vectors: DataFrame, query: Sequence[float], limit: int | None) -> DataFrame:
    """(id, similarity, position): the best vector of each publication over
    the whole index, so long documents can't fill a candidate window. Without
    a limit all are ranked."""
    best = vectors.select("id", similarity(F.col("vector"), query).alias("similarity")).groupBy("id").agg(F.max("similarity").alias("similarity"))
    if limit is None:
        return storage.numbered(best, [F.desc("similarity"), "id"], "position").select("id", "similarity", "position")
    top = best.orderBy(F.desc("similarity"), "id").limit(limit)
    return top.selectExpr("id", "similarity", "row_number() OVER (ORDER BY similarity DESC, id) AS position")


def rank_each(vectors: DataFrame, queries: Sequence[Sequence[float]], limit: int) -> DataFrame:
    """(case, id, similarity, position): rank() for each of some query vectors,
    case being its number from 0, in one pass over the vectors."""
    best = vectors.select("id", F.array(*[similarity(F.col("vector"), q) for q in queries]).alias("s"))
    best = best.groupBy("id").agg(*[F.max(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(len(queries))])
    rows = best.select("id", F.posexplode(F.array(*[f"s{i}" for i in range(len(queries))])).alias("case", "similarity"))
    ranked = rows.selectExpr("case", "id", "similarity", "row_number() OVER (PARTITION BY case ORDER BY similarity DESC, id) AS position")
    return ranked.where(F.col("position") <= limit)


def fuse(rankings: Sequence[DataFrame]) -> DataFrame:
    """(id, score, ranker, position) from rankings(id, position from 1): sums
    of 1 / (FUSION_K + position). Ties go to the first ranker that has the
    publication, then to its position there."""
    rows = None
    for i, r in enumerate(rankings):
        own = r.select("id", F.lit(i).alias("ranker"), F.col("position").cast("int").alias("position"))
        rows = own if rows is None else rows.union(own)
    return _fused(rows, "id")


def _fused(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum(F.lit(1.0) / (FUSION_K + F.col("position"))).alias("score"),
        F.min(F.struct("ranker", "position")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_set("ranker")), lambda x: F.when(x == 0, F.lit("K")).otherwise(F.concat(F.lit("V"), x.cast("string")))), "").alias("rankers"),
    )


def hybrid(index: S.Index | S.Scan, query: str, vectors: Sequence[tuple[DataFrame, Sequence[float]]], limit: int = 10, shortlist: DataFrame | None = None, weights=S.PUBLICATION_WEIGHTS) -> tuple[DataFrame, list[str]]:
    """Keyword and vector rankings fused; (hits, notes). A query that does not
    parse costs its half and leaves a note, as do missing vectors. Pass no
    shortlist for pure retrieval."""
    depth, notes, rankings = max(3 * limit, 20), [], []
    spark = (index.docs if isinstance(index, S.Scan) else index.lengths).sparkSession
    try:
        rankings.append(S.search(index, S.safe_query(query), weights, depth).select("id", "position"))
    except S.MatchError as why:
        notes.append(f"keyword half skipped ({why})")
        rankings.append(spark.createDataFrame([], "id long, position int"))
    if not vectors:
        notes.append("vector half disabled: keyword ranking only")
    rankings += [rank(v, q, depth).select("id", "position") for v, q in vectors]
    fused = fuse(rankings)
    if shortlist is not None:
        own = shortlist.select(F.col("publication_id").alias("id"), F.lit(True).alias("shortlisted")).distinct()
        fused = fused.join(own, "id", "left").withColumn("score", F.col("score") + F.when(F.col("shortlisted"), SHORTLIST_BOOST).otherwise(0.0))
    top = fused.orderBy(F.desc(F.round("score", 12)), "first.ranker", "first.position").limit(limit)
    return top.selectExpr("id", "score", "rankers", "row_number() OVER (ORDER BY round(score, 12) DESC, first.ranker, first.position) AS position"), notes


def verdict(about: Column, mentions: Column, sim1: Column, keyword_only: Column) -> Column:
    """struct(band 0-4 or null, pos 0-1 or null) from measured counts."""
    mass = mentions + 10 * about
    low, high = math.log1p(150), math.log1p(1500)
    out = lambda band, t: F.struct(F.lit(band).alias("band"), F.round((F.lit(band) + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))) / 5, 4).alias("pos"))
    none = F.struct(F.lit(None).cast("int").alias("band"), F.lit(None).cast("double").alias("pos"))
    return (
        F.when((mentions > 0) & ((about >= 8) | ((about >= 3) & (mentions >= 80)) | (mentions >= 150)), out(4, (F.log1p(mass.cast("double")) - low) / (high - low)))
        .when((mentions > 0) & ((about >= 2) | ((about >= 1) & (mentions >= 20))), out(3, (about + mentions / 50 - 1) / 7))
        .when(mentions > 0, out(2, mass / 20))
        .when(keyword_only, none)
        .when(sim1 >= SIM_ADJACENT, out(1, (sim1 - SIM_ADJACENT) / (0.65 - SIM_ADJACENT)))
        .otherwise(out(0, (sim1 - SIM_FLOOR) / (SIM_ADJACENT - SIM_FLOOR)))
    )


def recall(hits: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """Recall at k of hits(case, position, title, one_liner) for cases(case,
    pattern): the share of cases with a match in the first k."""
    top = cases.join(hits.where(F.col("position") <= k), "case", "left")
    hit = F.max(F.coalesce(F.expr("title rlike pattern OR one_liner rlike pattern"), F.lit(False)))
    return top.groupBy("case").agg(hit.alias("hit")).agg(F.avg(F.col("hit").cast("int")).alias("recall"))


def recall_by_ranker(cases: Sequence[tuple[str, str, Sequence[float], str]], index: S.Index | S.Scan, vectors: Mapping[str, DataFrame], shown: DataFrame, weights=S.PUBLICATION_WEIGHTS, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """(ranker, k, recall) of real retrieval, without the shortlist's boost:
    keyword search, each kind of vectors, and all of them fused. cases are
    (name, question, its vector, pattern that a right hit shows); shown(id,
    title, one_liner) is what patterns are looked for in. A few dozen cases:
    their postings are read in one pass over the index, vectors in one pass a
    kind, and what is fused are the rankings as they were stored."""
    spark, depth = shown.sparkSession, max(20, 3 * max(ks))
    asked = [S.safe_query(question) for _, question, _, _ in cases]
    own = S.narrowed(index, asked)
    place = F.col("position").cast("int").alias("position")
    ranked = [S.search(own, q, weights, depth).select(F.lit(i).alias("case"), F.lit(0).alias("ranker"), "id", place) for i, q in enumerate(asked)]
    ranked += [rank_each(v, [vector for _, _, vector, _ in cases], depth).select("case", F.lit(k).alias("ranker"), "id", place) for k, v in enumerate(vectors.values(), 1)]
    deep = storage.stored(reduce(DataFrame.union, ranked), "ranked")
    names = ("keyword", *vectors, "hybrid")
    foremost = "row_number() OVER (PARTITION BY case ORDER BY round(score, 12) DESC, first.ranker, first.position) AS position"
    fused = _fused(deep, "case", "id").selectExpr("case", f"{len(names) - 1} AS ranker", "id", foremost)
    hits = storage.stored(deep.union(fused).where(F.col("position") <= max(ks)), "hits")
    titles = shown.select("id", "title", "one_liner").join(F.broadcast(hits.select("id").distinct()), "id", "left_semi")
    hits = hits.join(storage.stored(titles, "retrieved"), "id").withColumnsRenamed({"case": "of", "ranker": "by"})
    grid = [(i, name, k, case, pattern) for i, name in enumerate(names) for k in ks for case, (_, _, _, pattern) in enumerate(cases)]
    grid = spark.createDataFrame(grid, "i int, ranker string, k int, case int, pattern string")
    found = grid.join(hits, (F.col("case") == F.col("of")) & (F.col("i") == F.col("by")) & (F.col("position") <= F.col("k")), "left")
    hit = F.max(F.coalesce(F.expr("title rlike pattern OR one_liner rlike pattern"), F.lit(False))).cast("int")
    return found.groupBy("i", "ranker", "k", "case").agg(hit.alias("hit")).groupBy("i", "ranker", "k").agg(F.avg("hit").alias("recall")).select("ranker", "k", "recall")


def citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(answer_id, cited, valid) for every `[3]` or `[1, 2]` in answers(
    answer_id, text), checked against hits(answer_id, id)."""
    marks = F.explode(F.regexp_extract_all("text", F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))).alias("m")
    cited = answers.select("answer_id", marks).select("answer_id", F.explode(F.split("m", r"\s*,\s*")).alias("c")).select("answer_id", F.col("c").cast("long").alias("cited")).distinct()
    known = hits.select("answer_id", F.col("id").alias("cited"), F.lit(True).alias("known")).distinct()
    return cited.join(known, ["answer_id", "cited"], "left").select("answer_id", "cited", F.coalesce("known", F.lit(False)).alias("valid"))


def place(points: DataFrame, vectors: DataFrame, new: DataFrame, neighbours: int = 10) -> DataFrame:
    """Coordinates for new(id, vector) from placed points(id, x, y): the mean
    of the nearest `neighbours`, weighted by squared similarity of 0.05 at
    least; ties go to the lesser id. The placed points go to the executors in
    blocks of ANCHORS at most, one pass over the new ones for each, which
    keeps the best of a block; those are merged by id."""
    anchors = storage.stored(points.select("id", "x", "y").join(vectors.select("id", "vector"), "id"), "anchors")
    blocks = max(1, -(-anchors.count() // ANCHORS))
    best = None
    for k in range(blocks):
        own = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k) if blocks > 1 else anchors
        found = _nearest(new.select("id", "vector"), own, neighbours)
        best = found if best is None else best.union(found)
    order = lambda x: F.struct((-x["s"]).alias("d"), x["anchor"].alias("a"), x["x"].alias("x"), x["y"].alias("y"), x["s"].alias("s"))
    near = best.groupBy("id").agg(F.slice(F.array_sort(F.transform(F.flatten(F.collect_list("near")), order)), 1, neighbours).alias("near"))
    weight = lambda n: F.pow(F.greatest(n["s"], F.lit(0.05)), 2)
    total = lambda value: F.aggregate("near", F.lit(0.0), lambda a, n: a + value(n))
    return near.where(F.size("near") > 0).select("id", *[(total(lambda n, c=c: weight(n) * n[c]) / total(weight)).alias(c) for c in ("x", "y")])


def _nearest(new: DataFrame, anchors: DataFrame, neighbours: int) -> DataFrame:
    """(id, near) with the nearest anchors of each new point, as an array of
    (anchor, s, x, y). anchors are ANCHORS at most."""
    t = anchors.orderBy("id").toArrow()
    ids, x, y = (t.column(c).to_numpy() for c in ("id", "x", "y"))
    matrix = np.array(t.column("vector").to_pylist(), np.float64)
    shared = new.sparkSession.sparkContext.broadcast((ids, x, y, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, y, matrix = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                sims = np.array(part.column(1).to_pylist(), np.float64) @ matrix.T if len(ids) else np.zeros((part.num_rows, 0))
                for row in sims:
                    k = min(neighbours, len(row))
                    edge = np.partition(row, len(row) - k)[len(row) - k] if k else 0.0
                    at = np.flatnonzero(row >= edge)  # all that tie with the last one
                    at = at[np.lexsort((ids[at], -row[at]))][:k]
                    out.append([{"anchor": int(ids[j]), "s": float(row[j]), "x": float(x[j]), "y": float(y[j])} for j in at])
                kind = pa.list_(pa.struct([("anchor", pa.int64()), ("s", pa.float64()), ("x", pa.float64()), ("y", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["id", "near"])

    return new.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "id long, near array<struct<anchor: long, s: double, x: double, y: double>>")


def semantic_search(c: Mapping[str, DataFrame], query: Sequence[float], limit: int = 10, source: str = "section") -> DataFrame:
    """The best vectors of a kind, one for each publication: a window of limit
    * 6 vectors is taken first, so a publication is found only through one of
    those; with title, type, date and, for sections, heading and body."""
    rows = c["embeddings"].where(F.col("source_type") == source).select("source_id", "publication_id", similarity(F.col("vector"), query).alias("similarity"))
    window = rows.orderBy(F.desc("similarity"), "source_id").limit(6 * limit)
    best = window.groupBy("publication_id").agg(F.max(F.struct("similarity", (-F.col("source_id")).alias("s"))).alias("b"))
    top = best.select("publication_id", "b.similarity", (-F.col("b.s")).alias("source_id")).orderBy(F.desc("similarity"), "source_id").limit(limit)
    top = top.selectExpr("*", "row_number() OVER (ORDER BY similarity DESC, source_id) AS position")
    out = top.join(c["publications"].select(F.col("id").alias("publication_id"), "title", "pub_type", "date_published"), "publication_id")
    if source == "section":
        out = out.join(c["sections"].select(F.col("id").alias("source_id"), "heading", "body"), "source_id", "left")
    return out
