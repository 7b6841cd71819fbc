"""Capped water-filling and the seeded sample against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lectern.llm import mixing


def fill(sizes, share=1.5, most=2):
    """The contract's own steps: share by weight, stop at caps, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * sizes[s]}
        if not over:
            return got | {s: most * sizes[s] for s in capped}
        capped |= over


def brute(rows):
    size = [(i, len((t or "").split()), s) for i, t, s in rows]
    total = Counter()
    for _, n, s in size:
        total[s] += n
    goal = fill(total)
    out = []
    for s in total:
        whole = int(goal[s] // total[s]) if total[s] else 0
        groups = defaultdict(list)
        for i, n, x in size:
            if x == s:
                groups[hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        upto = 0
        for key in sorted(groups):
            words = sum(n for _, n in groups[key])
            more = whole < 2 and upto + words / 2 <= goal[s] - whole * total[s]
            out += [(i, n, total[s], round(goal[s], 6), n * (whole + more)) for i, n in groups[key]]
            upto += words
    return sorted(out, key=str)


def rows(seed):
    r = random.Random(seed)
    return [(i, " ".join(["x"] * r.choice([0, 1, 5, 30, 90])), r.choice(["a", "a", "a", "a", "B", "é", "zz", None])) for i in range(400)] + [(7, "p q", "a"), (None, "p q r", "B"), (None, None, "only"), (401, "a b c", "B")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        data = [(i, (t or "").replace(" ", "-") or None, s) for i, t, s in rows(seed)]
        got = mixing.mixed(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
        assert sorted(((x.doc_id, x.size, x.source_size, round(x.target, 6), x.taken) for x in got), key=str) == brute(data)


def test_rows_repeat_as_often_as_taken(spark):
    data = [(i, t, s, 1) for i, t, s in rows(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    got = out.where("doc_id <> 7").groupBy("doc_id").agg((F.count("*") * F.first(mixing.word_count())).alias("n"))
    taken = {x.doc_id: x.taken for x in mixing.mixed(docs).where("doc_id <> 7").collect() if x.taken}
    assert {x.doc_id: x.n for x in got.collect() if x.n} == taken


def test_one_source_no_words_and_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mixed(spark.createDataFrame([], schema)).count() == 0
    assert [x.taken for x in mixing.mixed(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()] == [0, 0]
    one = mixing.mixed(spark.createDataFrame([(i, "a b", "s") for i in range(40)], schema)).collect()
    assert sum(x.taken for x in one) == 120
