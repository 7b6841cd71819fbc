"""SimHash against brute force, and the covering property of the anchors."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import components, simhash


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    fp = {}
    for i, t in rows:
        fp.setdefault(brute_fp(t), []).append(i)
    keys, top = list(fp), {}
    for k in keys:
        if k in top:
            continue
        todo, top[k] = [k], k
        while todo:
            x = todo.pop()
            for y in keys:
                if y not in top and (x ^ y).bit_count() <= 3:
                    top[y] = k
                    todo.append(y)
    least = {}
    for k, ids in fp.items():
        least[top[k]] = min([least.get(top[k], 1 << 60), *(i for i in ids if i is not None)])
    return sorted((-1 if i is None else i, f"{k:016x}", least[top[k]]) for k, ids in fp.items() for i in ids)


def near_texts(n, seed=3):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, i = [], 0
    for _ in range(n):
        base = r.choices(words, k=r.choice([1, 2, 3, 40, 300, 700]))
        for _ in range(r.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2])):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((i, r.choice([" ", "\n", "  "]).join(w).title()))
            i += 1
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", hot)
    rows = near_texts(120) + [(9000, ""), (9001, None), (9002, "\x1c "), (9003, "Ünï ÇÖDÉ x"), (9003, "Ünï ÇÖDÉ x"), (None, "")]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, component_id long")
    got = simhash.near_duplicates(docs.drop("component_id")).select(F.coalesce("doc_id", F.lit(-1)), F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    assert sorted(tuple(x) for x in got.collect()) == brute_components(rows)


def test_linked_fingerprints_share_an_anchor_with_a_home():
    r = random.Random(5)
    for _ in range(500):
        x = r.getrandbits(64)
        y = x
        for bit in r.sample(range(64), r.randrange(4)):
            y ^= 1 << bit
        keys, rows, home = simhash.anchors_of(np.array([x, y], np.uint64))
        at = {0: {}, 1: {}}
        for k, i, h in zip(keys.tolist(), rows.tolist(), home.tolist()):
            at[i][k] = h
        assert any(at[0][k] or at[1][k] for k in at[0].keys() & at[1].keys())


def test_blocks_of_hot_anchors_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ANCHOR", 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(1)
    centre = r.getrandbits(63)
    fps = {centre ^ sum(1 << b for b in r.sample(range(63), k)) for k in (0, 1, 2, 4, 5) for _ in range(60)}
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, least_id long")
    got = {x.a: x.b for x in components.least_reachable(simhash.links(classes)).collect()}
    keys, top = sorted(fps), {}
    for k in keys:
        if k not in top:
            todo, top[k] = [k], k
            while todo:
                x = todo.pop()
                for y in keys:
                    if y not in top and (x ^ y).bit_count() <= 3:
                        top[y] = k
                        todo.append(y)
    assert {k: v for k, v in top.items() if k != v} == got


def test_empty_table_and_no_links(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert components.least_reachable(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(500, 500)]
    got = {x.a: x.b for x in components.least_reachable(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 500 for i in range(501, 560)}


def test_keep_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b C d", "y"), (2, "p q r s t", None), (2, "p q r s t", None), (None, "a b c d", "z")], "doc_id long, text string, size string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == [1, 2]


def test_keep_one_removes_rows_not_ids(spark):
    rows = [
        (1, "a b c d", "kept"), (None, "a b c d", "copy"),  # a numbered group takes a row without an id
        (None, "l m n o p", "kept"), (None, "v w x y z", "kept"), (None, "v w x y z", "copy"),
        (5, "f g h i j", "kept"), (5, "q r s t u", "kept"), (5, "a b c d", "copy"),
    ]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, what string")).collect()
    assert sorted((x.doc_id or 0, x.text) for x in kept) == sorted({(i or 0, t) for i, t, what in rows if what == "kept"})
