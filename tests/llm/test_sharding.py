"""Flows against brute force, and what the law asks of the shards."""

import itertools
import random
import zlib
from collections import Counter

import pytest

from lectern.llm import sharding


def cheapest(supply, demand, cost):
    """Least cost over all integer flows of a tiny network."""

    def best(i, left):
        if i == len(supply):
            return 0
        out = None
        for split in itertools.product(*[range(min(supply[i], x) + 1) for x in left]):
            if sum(split) == supply[i]:
                rest = best(i + 1, tuple(x - y for x, y in zip(left, split)))
                if rest is not None:
                    c = rest + sum(a * b for a, b in zip(split, cost[i]))
                    out = c if out is None else min(out, c)
        return out

    return best(0, tuple(demand))


def test_flow_is_cheapest():
    r = random.Random(2)
    for _ in range(40):
        m, n = r.choice([1, 2, 3]), r.choice([1, 2, 3])
        supply = [r.randrange(5) for _ in range(m)]
        demand = sharding.even(sum(supply), n)
        cost = [[r.randrange(4) for _ in range(n)] for _ in range(m)]
        flow = sharding.min_cost_flow(supply, demand, cost)
        assert [sum(x) for x in flow] == supply and [sum(x) for x in zip(*flow)] == demand
        assert sum(f * c for x, y in zip(flow, cost) for f, c in zip(x, y)) == cheapest(supply, demand, cost)


def test_fewest_bytes_move():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randrange(60) for _ in range(r.randrange(1, 12))]
        caps = sharding.even(sum(sizes), r.randrange(1, 9))
        flow = sharding.transfers(sizes, caps)
        assert [sum(row.values()) for row in flow] == sizes
        assert [sum(row.get(j, 0) for row in flow) for j in range(len(caps))] == caps
        assert sum(row.get(i, 0) for i, row in enumerate(flow)) == sum(map(min, sizes, caps))
    assert sharding.affected([{0: 5}, {1: 5}], 2) == set()
    assert sharding.affected([{0: 5, 1: 1}, {1: 5}], 2) == {0, 1}
    assert sharding.affected([{0: 5}, {}], 3) == {1, 2}


def brute_places(files, shards):
    """(file, row) to (shard, slot) by the rule: each file's bytes are cut by
    the flow, its own shard first, and a row goes where its middle lies."""
    flow = sharding.transfers([sum(x) for x in files], sharding.even(sum(map(sum, files)), shards))
    found, slots = {}, [0] * shards
    for i, sizes in enumerate(files):
        line = [j for j in sorted(flow[i], key=lambda j: (j != i, j)) for _ in range(flow[i][j])]
        at = 0
        for row, size in enumerate(sizes):
            j = line[at + size // 2]
            found[i, row] = (j, slots[j])
            slots[j] += 1
            at += size
    return found


@pytest.mark.parametrize("block", [65_536, 7])
@pytest.mark.parametrize("files", [1, 5, 40])
def test_places_against_brute_force(spark, tmp_path, monkeypatch, files, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    r = random.Random(files)
    sizes = []
    for i in range(files):
        texts = [None if r.random() < 0.05 else "é" * r.choice([0, 3, 40, 400 if r.random() < 0.1 else 1]) for _ in range(r.choice([1, 30, 90]))]
        spark.createDataFrame([(i * 1000 + k, t, "q") for k, t in enumerate(texts)], "doc_id long, text string, shard string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d/n={i:03}")
        sizes.append([len((t or "").encode()) + 8 for t in texts])
    docs = spark.read.parquet(f"{tmp_path}/d").drop("n")
    want = brute_places(sizes, 24)
    got = {(x.doc_id // 1000, x.doc_id % 1000): (x.shard, x.slot) for x in sharding.sharded(docs).collect()}
    assert got == want


def test_law_slots_and_columns(spark):
    r = random.Random(4)
    data = [(i, "é" * r.randrange(60), "s") for i in range(1500)] + [(5, None, "s"), (5, "", "s"), (None, "x", None), (6, "same", "s"), (6, "same", "s")]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string")
    for frame in (docs, docs.withColumn("a`b", docs.shard).withColumn("FILE", docs.shard).withColumn("of_shard", docs.shard)):
        got = sharding.sharded(frame).collect()
        assert sorted(((x.doc_id, x.size, x.text_crc32) for x in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in data), key=str)
        by = {}
        for x in got:
            by.setdefault(x.shard, []).append(x)
        assert set(by) == set(range(24))
        mean = sum(x.size for x in got) / 24
        for own in by.values():
            assert sorted(x.slot for x in own) == list(range(len(own)))
            assert abs(sum(x.size for x in own) - mean) < 6 * 130
        assert {(x.law, x.grown_shard) for x in got} == {("bytes", None)}


def test_empty_and_fewer_documents_than_shards(spark):
    schema = "doc_id long, text string"
    assert sharding.sharded(spark.createDataFrame([], schema)).count() == 0
    assert sorted(x.slot for x in sharding.sharded(spark.createDataFrame([(1, "a"), (2, None)], schema)).collect())[0] == 0


def rows_of(df):
    return Counter(tuple(x) for x in df.collect())


@pytest.mark.parametrize("steps", [(6, 4), (4, 6), (6, 1, 5), (3, 3), (4, 50, 2)])
def test_rewritten_shards_hold_every_row_once(spark, tmp_path, steps, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 1000 if len(steps) == 3 else 64 << 20)
    r = random.Random(1)
    docs = spark.createDataFrame([(i % 900, "x" * r.randrange(50), "q", i) for i in range(1000)] + [(None, None, None, -1)], "doc_id long, text string, slot string, `a``b` int")
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    want, manifest = rows_of(docs), None
    for n in steps:
        now = docs if manifest is None else sharding.documents_of(spark, manifest, docs.schema)
        manifest = sharding.write_shards(now, str(tmp_path / "out"), n, manifest)
        back = sharding.read_shards(spark, manifest, docs.schema)
        assert set(manifest) == {x.shard for x in back.select("shard").distinct().collect()} <= set(range(n))
        assert Counter(tuple(x)[:4] for x in back.collect()) == want
        for j in manifest:
            slots = [x[0] for x in back.where(back.shard == j).select(back.columns[-1]).collect()]
            assert sorted(slots) == list(range(len(slots)))


def test_kept_and_emptied_shards(spark, tmp_path):
    """One row of 92 bytes a file: shards 0 to 2 stay the files they are, and
    a fourth stays empty for want of rows."""
    for i in range(3):
        spark.createDataFrame([(i, "x" * 84)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in/n={i}")
    docs = spark.read.parquet(f"{tmp_path}/in").drop("n")
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), 3)
    assert sorted(manifest) == [0, 1, 2] and all(x.slots is None for x in manifest.values()) and not (tmp_path / "out").exists()
    assert sorted((x.doc_id, x.shard, x.slot) for x in sharding.read_shards(spark, manifest, docs.schema).collect()) == [(i, i, 0) for i in range(3)]
    manifest = sharding.write_shards(docs, str(tmp_path / "out"), 8)
    assert len(manifest) < 8 and rows_of(sharding.read_shards(spark, manifest, docs.schema).select("doc_id", "text")) == rows_of(docs)
    even = spark.createDataFrame([(i, "x" * 42) for i in range(600)], "doc_id long, text string")
    first = sharding.write_shards(even, str(tmp_path / "out"), 4)
    assert len(first) == 4 and sharding.write_shards(sharding.documents_of(spark, first, even.schema), str(tmp_path / "out"), 4, first) == first
    manifest = sharding.write_shards(docs.limit(0), str(tmp_path / "out"), 8)
    assert manifest == {} and sharding.read_shards(spark, manifest, docs.schema).count() == 0
