"""Mixing sources to target weights by capped water-filling.

Sources take shares of a budget by weight; what a source can't fill (MOST
epochs of its words) is shared again among the others, until none is above.
The level is found at once from sources sorted by cap per weight. A source's
target then is so many whole repetitions of all its documents, and a seeded
part of them once more: documents in the order of a seeded digest of their
id, up to the digest where the words come nearest to the rest of the target.
That cutoff is found from sums per block of digests, then per block inside
one of those, then by key, so no source is ever ordered in one task.

Size: words `[^\\x20\\x09-\\x0D]+`; null text: 0. Null source: the last source.
Null id: digest of the seed alone. Rows of one id are taken together. Empty
table: empty result. Extra columns: ignored, or carried along untouched,
whatever their names. The targets are found in one task, which holds a row for
each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

SHARE = 1.5
MOST = 2
SEED = "lectern-mix"
#: Leading hex digits of the digest that make a block, level by level: a
#: source has 256 blocks in line at each, and one of 65,536 is ordered by key.
LEVELS = (2, 4)
BROADCAST_SOURCES = 100_000

#: From (source, source_size) to each source's target. Runs in Spark and DuckDB.
TARGETS_SQL = """
SELECT source, source_size, CASE WHEN level * weight <= cap THEN level * weight ELSE cap END AS target FROM (
  SELECT *, max(CASE WHEN own * weight <= cap THEN own END) OVER () AS level FROM (
    SELECT *, ({share}e0 * CAST(total AS DOUBLE) - CAST(before AS DOUBLE)) / CAST(rest AS DOUBLE) AS own FROM (
      SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM (
        SELECT *, CAST({most} * source_size AS DOUBLE) AS cap,
               CASE (place - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight
        FROM (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM {sizes})
      )
    )
  )
)
"""


def digest(seed: str):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(base.SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row for each source, in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sizes.sparkSession.sql(TARGETS_SQL.format(sizes="{sizes}", share=share, most=most), sizes=totals)


def plan(sizes: DataFrame, seed: str = SEED) -> DataFrame:
    """For each source: source_size, target, whole repetitions of all its
    documents, and the last digest that is taken once more."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio).cast("long")
    goals = base.stored(targets(sizes).withColumn("whole", whole).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    few = goals.count()
    hint = lambda df: base.maybe_broadcast(df, few, BROADCAST_SOURCES)
    keyed = sizes.select("source", "size", digest(seed).alias("key"))
    edge = goals.select(F.col("source").alias("s"), "extra", F.lit(0).cast("long").alias("before"), F.lit("").alias("block"))

    def lines(digits: int) -> DataFrame:
        """Words before each block of `digits`, inside the blocks found so far."""
        inside = keyed.join(hint(edge), F.col("source").eqNullSafe(F.col("s")) & F.startswith("key", F.col("block")))
        sums = inside.groupBy("source", "before", "extra", F.substring("key", 1, digits).alias("block")).agg(F.sum("size").alias("words"))
        return sums.selectExpr("source", "block", "extra", "words", "before + sum(words) OVER (PARTITION BY source ORDER BY block) - words AS upto")

    for digits in LEVELS:
        found = lines(digits).where("upto <= extra").groupBy("source").agg(F.max_by(F.struct("block", F.col("upto").alias("before"), "extra"), "block").alias("e"))
        edge = base.stored(found.select(F.col("source").alias("s"), "e.extra", "e.before", "e.block"), "edges")
    last = lines(32).where("upto + words / 2 <= extra").groupBy("source").agg(F.max("block").alias("last")).select(F.col("source").alias("t"), "last")
    cut = edge.join(last, F.col("s").eqNullSafe(F.col("t")), "left").select("s", F.coalesce("last", "block").alias("cut"))
    return goals.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("__source"), "source_size", "target", "whole", "cut")


def _planned(rows: DataFrame, sizes: DataFrame, seed: str) -> DataFrame:
    made = base.stored(plan(sizes, seed), "mix")
    made = base.maybe_broadcast(made, made.count(), BROADCAST_SOURCES)
    return rows.join(made, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", copies(seed))


def copies(seed: str):
    more = (F.col("whole") < MOST) & (digest(seed) <= F.col("cut"))
    return F.col("whole").cast("int") + F.coalesce(more, F.lit(False)).cast("int")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = base.stored(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    return _planned(sizes, sizes, seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__copies")).alias("taken"))


def repeat_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    sizes = base.stored(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    names = docs.columns
    carried = docs.select(F.struct(*base.columns_of(docs)).alias("__row"), "doc_id", "source")
    rows = _planned(carried, sizes, seed).where("__copies > 0")
    rows = rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__i"))
    return rows.select(*[F.col(f"__row.{base.quoted(c)}").alias(c) for c in names])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_rows(docs)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(base.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('@seed:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), goals AS (@targets
), split AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals
), keys AS (
  SELECT source, key, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) AS upto
  FROM docs GROUP BY source, key
)
SELECT doc_id, size, s.source_size, s.target,
       (size * (whole + CASE WHEN whole < 2 AND upto + words / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN split s ON d.source IS NOT DISTINCT FROM s.source
JOIN keys k ON d.source IS NOT DISTINCT FROM k.source AND d.key = k.key
""".replace("@seed", SEED).replace("@targets", TARGETS_SQL.format(sizes="sizes", share=SHARE, most=MOST))
