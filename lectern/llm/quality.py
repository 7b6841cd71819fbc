"""Quality rules whose cutoffs come from the corpus itself.

Measures of every whole text, and the sizes they are shares of, are summed up
in quantile sketches per language and source. A sketch counts values in
buckets that grow by GROWTH, so any quantile is right to 1 %, and sketches
merge by adding counts: the result does not depend on partitions, order or
retries. The quantiles of a group are averaged with those of its language,
and these with those of the whole corpus, which weigh like PRIOR_TEXTS texts
each: the smaller a group, the more it borrows, without a switch.

A text fails when a measure lies beyond the middle of its group by more than
the group's reach, REACH times the distance from the median to the quartile on
that side. Sampling laws take the place of any least cutoff:

* a mean over n words spreads as 1/sqrt(n): texts shorter than the middle text
  of the group get a reach wider by that much;
* shares of rare things have quartiles of zero, so their spread is taken from
  where the mass is: the group's rate, the mean of its sketch below the TRIM
  quantile. Things of that rate r number n*r in a text of n and spread as
  sqrt(n*r), so the fence is r + DEVIATIONS * sqrt(r / n), with n no larger
  than the middle text's; it is no nearer than 3 / n, since seeing none among
  n still allows that rate (the rule of three).

Null text, empty text: no words, base_failed. Null language or source: a
group of its own. Repeated rows: measured each. A corpus of equal texts: all
at the middle, none fails. Empty table: empty result. Extra columns pass
through stages untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, buffers

GROWTH = 1.02
REACH = 6.0
#: As many standard deviations are REACH distances from median to quartile.
DEVIATIONS = round(REACH * 0.6745, 3)
#: The share of a group's lowest values that its rates are means of.
TRIM = 0.95
PRIOR_TEXTS = 50
RULE_OF_THREE = 3
MIN_WORDS = 10
WINDOW = 5
#: metric: (sides, what it counts, out of what, the least that one occurrence
#: adds; None for a mean). Two windows that are alike cover 2 * WINDOW words.
METRICS = {
    "word_length": (("low", "high"), "word_chars", "n_words", None),
    "symbol_share": (("high",), "n_symbols", "word_chars", 1),
    "repeated_lines": (("high",), "n_dup_lines", "n_lines", 1),
    "repeated_words": (("high",), "n_repeat_words", "n_words", 2 * WINDOW),
}
SIZES = ("n_words", "word_chars", "n_lines")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def count_texts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each text of a slice."""
    starts, ends, first = buffers.spans(data, at, buffers.NOT_SPACE)
    n_words = np.diff(first)
    words = buffers.word_hashes(data, starts, ends)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    repeated = np.zeros(len(words) + 1, np.int64)
    begin = buffers.whole_windows(first, WINDOW)
    if len(begin):
        keys = buffers.window_hashes(words, WINDOW)[begin]
        with np.errstate(over="ignore"):
            keys = buffers.mixed(keys + text_of[begin].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = begin[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    lines, again = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
    for i in range(len(n_words)):
        found = [x for x in data[at[i] : at[i + 1]].tobytes().split(b"\n") if x.strip()]
        lines[i], again[i] = len(found), len(found) - len(set(found))
    return {
        "n_words": n_words,
        "word_chars": buffers.per_text(buffers.NOT_SPACE[data] & buffers.LEADS[data], at),
        "n_symbols": buffers.per_text(_SYMBOL[data], at),
        "n_dup_lines": again,
        "n_repeat_words": buffers.per_text(np.cumsum(repeated[:-1]) > 0, first),
        "n_lines": lines,
    }


def measured(docs: DataFrame, keep: list[str], field: str) -> DataFrame:
    """The columns keep, and a struct field of the COUNTS of the text."""
    names = keep if "text" in keep else [*keep, "text"]
    carried = base.numbered(docs.select(*[F.col(base.quoted(c)) for c in names]))
    text = carried.columns[names.index("text")]
    kind = T.StructType([T.StructField(c, T.LongType(), False) for c in COUNTS])
    schema = T.StructType([*carried.schema.fields[: len(keep)], T.StructField("counts", kind)])
    parts = [pa.field(c, pa.int64(), False) for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch, text):
                counts = count_texts(data, at)
                struct = pa.StructArray.from_arrays([pa.array(counts[c], pa.int64()) for c in COUNTS], fields=parts)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], struct], names=schema.names)

    return carried.mapInArrow(run, schema).toDF(*keep, field)


def metric_columns(c: str = "") -> dict:
    """Each metric as a double; 0 where a text has no words."""
    share = lambda a, b: F.when(F.col(c + b) > 0, F.col(c + a) / F.col(c + b)).otherwise(F.lit(0.0))
    return {m: share(part, size) for m, (_, part, size, _) in METRICS.items()}


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): a sketch for each group of every
    metric and size. Bucket b holds values in (GROWTH^(b-1), GROWTH^b]; null
    holds zeros."""
    values = metric_columns() | {s: F.col(s).cast("double") for s in SIZES}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()]))
    bucket = F.when(F.col("p.value") > 0, F.ceil(F.log(F.col("p.value")) / F.lit(math.log(GROWTH))).cast("int"))
    return counts.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", F.col("p.metric").alias("metric"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


_THRESHOLDS = """
WITH levels AS (
  SELECT 0 AS level, lang, source, metric, bucket, n FROM {sketch}
  UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM {sketch} GROUP BY lang, metric, bucket
  UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM {sketch} GROUP BY metric, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket NULLS FIRST) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, metric) AS total
  FROM levels
), quantiles AS (
  SELECT level, lang, source, metric, CAST(max(total) AS DOUBLE) AS total,
         coalesce(min(CASE WHEN 4 * upto >= total THEN coalesce({value}, 0) END), 0) AS q1,
         coalesce(min(CASE WHEN 2 * upto >= total THEN coalesce({value}, 0) END), 0) AS q2,
         coalesce(min(CASE WHEN 4 * upto >= 3 * total THEN coalesce({value}, 0) END), 0) AS q3,
         sum(greatest(least(CAST(n AS DOUBLE), {trim} * total - (upto - n)), 0e0) * coalesce({value}, 0)) / ({trim} * max(total)) AS rate
  FROM ranked GROUP BY level, lang, source, metric
), languages AS (
  SELECT l.lang, l.metric, {l_mix}
  FROM quantiles l JOIN quantiles a ON l.level = 1 AND a.level = 2 AND a.metric = l.metric
), own AS (
  SELECT g.lang, g.source, g.metric, {g_mix}
  FROM quantiles g JOIN languages l ON g.level = 0 AND g.metric = l.metric AND g.lang IS NOT DISTINCT FROM l.lang
), middles AS (
  SELECT lang, source, {middles} FROM own GROUP BY lang, source
)
SELECT lang, source, {sizes}, {fences} FROM middles
"""


def _law(rate: str, least: int, n: str) -> str:
    """How large a share of n things may be where the rate is this."""
    return f"greatest({rate} + {DEVIATIONS}e0 * sqrt({rate} * {least} / {n}), {RULE_OF_THREE * least}e0 / {n})"


def thresholds_sql(sketch: str) -> str:
    mix = lambda own, up: ", ".join(f"({own}.total * {own}.{q} + {PRIOR_TEXTS} * {up}.{q}) / ({own}.total + {PRIOR_TEXTS}) AS {q}" for q in ("q1", "q2", "q3", "rate"))
    pick = lambda m, q: f"max(CASE WHEN metric = '{m}' THEN {q} END)"
    middles = [f"greatest({pick(s, 'q2')}, 1e0) AS middle_{s}" for s in SIZES]
    fences = []
    for m, (sides, _, size, least) in METRICS.items():
        middles += [f"{pick(m, 'q2')} AS {m}", *[f"{REACH}e0 * {pick(m, 'q3 - q2' if side == 'high' else 'q2 - q1')} AS {m}_{side}" for side in sides]]
        fences.append(m)
        if least:
            middles.append(f"{pick(m, 'rate')} AS {m}_rate")
            fences.append(f"{m}_rate")
        for side in sides:
            blur = f"{m} * {GROWTH - 1:.6g}e0"  # a sketch tells values no closer
            rare = f", {_law(f'{m}_rate', least, f'middle_{size}')} - {m}" if least else ""
            fences.append(f"greatest({m}_{side}, {blur}{rare}) AS {m}_{side}")
    value = f"2 * power({GROWTH}e0, bucket) / ({GROWTH}e0 + 1)"
    return _THRESHOLDS.format(sketch=sketch, value=value, trim=f"{TRIM}e0", l_mix=mix("l", "a"), g_mix=mix("g", "l"), middles=", ".join(middles), sizes=", ".join(f"middle_{s}" for s in SIZES), fences=", ".join(fences))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source: the middle of every metric, how
    far a text may lie from it on a side, and the middle of every size."""
    return sketch.sparkSession.sql(thresholds_sql("{sketch}"), sketch=sketch)


def verdict_sql(counts: str, fence: str) -> str:
    """The condition of a good text; counts and fence are prefixes of columns.
    Runs in Spark and DuckDB."""
    good = []
    for m, (sides, part, size, least) in METRICS.items():
        n = f"greatest({counts}{size}, 1)"
        value = f"({counts}{part} / {n})"
        for side in sides:
            reach = f"{fence}{m}_{side}"
            if least:
                few = f"least({n}, {fence}middle_{size})"
                good.append(f"{value} <= greatest({fence}{m} + {reach}, {_law(f'{fence}{m}_rate', least, few)})")
                continue
            reach = f"{reach} * sqrt(greatest(1e0, {fence}middle_{size} / {n}))"
            good.append(f"{value} <= {fence}{m} + {reach}" if side == "high" else f"{value} >= {fence}{m} - {reach}")
    return " AND ".join(good)


def base_failed_sql(counts: str) -> str:
    return f"({counts}n_words < {MIN_WORDS} OR 100 * {counts}n_repeat_words > 20 * {counts}n_words)"


#: Fences take under 200 bytes a row, so a broadcast stays under 20 MB.
BROADCAST_GROUPS = 100_000


def fences_for(counts: DataFrame) -> DataFrame:
    found = base.stored(thresholds(sketches(counts)), "fences")
    return base.maybe_broadcast(found, found.count(), BROADCAST_GROUPS)


def joined(rows: DataFrame, fences: DataFrame) -> tuple[DataFrame, str]:
    """rows with the fences of their group in a struct column, and its name."""
    lang, source, fence = base.fresh(rows, "fence_lang", "fence_source", "fence")
    own = fences.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(*fences.columns[2:]).alias(fence))
    return rows.join(own, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left"), fence


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the counts of every document, stored for two passes."""
    return base.stored(measured(docs, keep, "counts").select(*keep, "counts.*"), "quality")


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every document."""
    counts = counted(docs, ["doc_id", "lang", "source"])
    rows, fence = joined(counts, fences_for(counts))
    failed = base_failed_sql("")
    return rows.select("doc_id", *COUNTS[:5], F.expr(failed).alias("base_failed"), F.expr(f"NOT {failed} AND {verdict_sql('', f'{fence}.')}").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with all their columns: one pass measures
    for the sketches, a second filters against the joined fences."""
    counts = counted(docs, ["lang", "source"])
    fences = fences_for(counts)
    base.discard(counts)
    (field,) = base.fresh(docs, "counts")
    rows, fence = joined(measured(docs, docs.columns, field), fences)
    good = rows.where(f"NOT {base_failed_sql(f'{field}.')} AND {verdict_sql(f'{field}.', f'{fence}.')}")
    return good.select(*base.columns_of(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(base.table(spark, sf_dir, "documents"))


OP4_SQL = (
    r"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         row_number() OVER () AS r
  FROM documents
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c >= 2
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + j AS k FROM twice, (SELECT unnest(range(0, 5)) AS j)) GROUP BY r
), counts AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM words LEFT JOIN covered USING (r)
), metrics AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_lines,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeated_words
  FROM counts
), measured AS (
  SELECT lang, source, word_length, symbol_share, repeated_lines, repeated_words,
         n_words::DOUBLE AS n_words, word_chars::DOUBLE AS word_chars, n_lines::DOUBLE AS n_lines FROM metrics
), sketch AS (
  SELECT lang, source, metric, CASE WHEN value > 0 THEN ceil(ln(value) / ln(@growth))::INT END AS bucket, count(*) AS n
  FROM (UNPIVOT measured ON word_length, symbol_share, repeated_lines, repeated_words, n_words, word_chars, n_lines INTO NAME metric VALUE value)
  GROUP BY ALL
), fences AS (
@thresholds
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, @failed AS base_failed, NOT @failed AND @verdict AS kept
FROM counts m LEFT JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
""".replace("@growth", f"{GROWTH}e0")
    .replace("@thresholds", thresholds_sql("sketch"))
    .replace("@failed", base_failed_sql("m."))
    .replace("@verdict", verdict_sql("m.", "f."))
)
