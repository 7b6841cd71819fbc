"""MinHash near-duplicates against brute force over word sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import minhash


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common) and top[i] != top[j]:
                old, new = top[i], top[j]
                top = [new if x == old else x for x in top]
    out = []
    for (i, _), s, t in zip(rows, sets, top):
        ids = [x for (x, _), u in zip(rows, top) if u == t and x is not None]
        out.append((i, len(s), min(ids) if ids else None, i == (min(ids) if ids else None)))
    return sorted(out, key=str)


def texts(n=60, group=150, seed=4):
    """Small groups of near copies around the threshold, copies, and a large
    group whose members are near some others only."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    made = []
    for _ in range(n):
        base = r.choices(words, k=r.choice([1, 2, 3, 30, 200, 500]))
        for _ in range(r.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, len(w) // 40, len(w) // 20])):
                w[r.randrange(len(w))] = r.choice(words)
            made.append(r.choice([" ", "\n", " \t"]).join(w).title())
    base = r.choices(words, k=200)
    for _ in range(group):
        w = list(base)
        for _ in range(r.choice([3, 6, 9])):
            w[r.randrange(len(w))] = r.choice(words)
        made.append(" ".join(w))
    r.shuffle(made)
    rows = list(enumerate(made))
    return [*rows, (9001, None), (9002, ""), (9003, " \n "), (None, made[0]), (None, "alone without an id"), (None, None), (5, made[5]), (-3, made[7]), (9004, "a b c"), (9005, "A B C"), (9006, "Ä b"), (9007, "ä b")]


def saved(spark, rows, path):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("file", F.lit("q")).withColumn("ROW", F.lit(1)).withColumn("n", F.lit("q")).withColumn("a`b", F.lit(0))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("band,cluster", [(4096, 1 << 20), (5, 900)])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, band, cluster):
    monkeypatch.setattr(minhash, "BAND_LIMIT", band)
    monkeypatch.setattr(minhash, "CLUSTER_LIMIT", cluster)
    monkeypatch.setattr(minhash, "SMALL", 4 if band == 5 else 16)
    rows = texts()
    got = minhash.op13_minhash_near_dedup(spark, saved(spark, rows, tmp_path))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_spanning_is_exact_at_the_threshold():
    sets = [list(range(85)), list(range(100)), list(range(84)), [*range(50), *range(200, 250)], [*range(50), *range(200, 250), 7000]]
    h = np.concatenate([np.array(s, np.uint64) for s in sets])
    a, b = minhash.spanning(h, np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    # 85/100 links, 84/85 links, 84/100 does not; the last two share 100 of 101
    assert sorted(map(tuple, map(sorted, zip(a, b)))) == [(0, 1), (0, 2), (3, 4)]


def test_minima_estimate_similarity():
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 2000, dtype=np.uint64)
    low = minhash.minima(np.concatenate([x[:1700], x[300:]]), np.array([0, 1700]))
    assert abs((low[0] == low[1]).mean() - 1400 / 2000) < 0.15


def test_empty_table(spark, tmp_path):
    where = saved(spark, [(1, None)], tmp_path)
    assert [tuple(r) for r in minhash.op13_minhash_near_dedup(spark, where).collect()] == [(1, 0, 1, True)]
    assert minhash.near_duplicates(spark.read.parquet(f"{where}/documents.parquet").where("false")).collect() == []
