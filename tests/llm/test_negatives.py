"""Hard negatives against a plain reading of the contract."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import negatives


def brute(rows, every=50, positives=5, k=3):
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)] = 1
    out = []
    for a, la, va in own:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in own if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            inside = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k], 1)]
    return sorted(out)


def vectors(n, dim=16, seed=2):
    r = random.Random(seed)
    middle = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    common = [0.25] * dim
    rows = []
    for i in range(n):
        v = common if r.random() < 0.3 else [x + r.gauss(0, 0.7) for x in middle[i % 4]]
        norm = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / norm for x in v], r.choice([0, 0, 0, 1, 2, 9])))
    return rows


def odd_rows():
    return [
        (1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 16, 2), (1150, [float("inf")] * 16, 2), (1200, [0.1] * 16, None), (None, [0.1] * 16, 1),
        (1250, [], 1), (1300, [0.5, -0.5], 0), (1350, [-0.3] * 16, 0), (1400, [0.0] * 16, 1), (1450, [0.0] * 16, 1), (-50, [0.2] * 16, 3), (-7, [0.2] * 16, 3),
    ]


def table(spark, rows, path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("q")).withColumn("anchor", F.lit("q"))
    df.repartition(3).write.mode("overwrite").parquet(f"{path}/embeddings.parquet")


@pytest.mark.parametrize("block,slice_,digit", [(1024, 2048, 8), (3, 7, 2)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, block, slice_, digit):
    for name, to in (("BLOCK", block), ("ROWS", block * 40), ("SLICE", slice_), ("DIGIT_BITS", digit)):
        monkeypatch.setattr(negatives, name, to)
    rows = vectors(600) + odd_rows()
    table(spark, rows + rows[100:130], tmp_path)
    got = sorted(map(tuple, negatives.op12_hard_negatives(spark, str(tmp_path)).collect()))
    assert got == brute(rows) and len(got) > 100


def test_wide_scores_and_other_parameters(spark):
    r = random.Random(9)
    scale = [1e-3, 1.0, 1e5, 1e12]
    rows = [(i, [r.uniform(0, 1) * scale[i % 4] for _ in range(5)], r.choice([1, 2])) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    own = negatives.taking_part(df, F.col("vec_id"), F.when(F.col("vec_id") % 7 == 0, F.col("label") + 1).otherwise(F.col("label")), F.col("embedding"))
    got = sorted(map(tuple, negatives.mined(own, F.col("vec_id") % 10 == 0, positives=7, negatives=2).collect()))
    end = 2**63 - 1
    want = [x for x in brute(rows, every=10, positives=7, k=2) if abs(x[4]) < end and abs(x[5]) < end]
    assert [x for x in got if x[4] < end] == want and want


def test_empty_table(spark, tmp_path):
    table(spark, [(1, None, None)], tmp_path)
    assert negatives.op12_hard_negatives(spark, str(tmp_path)).collect() == []
