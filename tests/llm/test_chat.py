"""Reply trees against a recursive walk, and the template's round trip."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import chat

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def brute(rows, branches):
    trees = {}
    for t, n, p, role, text, score in rows:
        key = (p is not None, p or 0, role or "", text or "", score or 0.0)
        old = trees.setdefault(t, {}).get(n)
        if old is None or key < old[0]:
            trees[t][n] = (key, p, role or "", text or "", score or 0.0)
    out = {}
    for t, nodes in trees.items():
        parents = {x[1] for x in nodes.values()}
        paths = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, at, seen = [], leaf, set()
            while at is not None and at in nodes and at not in seen:
                seen.add(at)
                path.append(at)
                at = nodes[at][1]
            if at is not None and at in seen:
                continue
            paths.append((-sum(nodes[x][4] for x in path) / len(path), leaf, [(nodes[x][2], nodes[x][3]) for x in reversed(path)]))
        for i, (_, leaf, turns) in enumerate(sorted(paths)[:branches]):
            out[t, i + 1] = (leaf, turns)
    return out


def forest(seed):
    r = random.Random(seed)
    rows = []
    for t in range(25):
        for n in range(r.choice([1, 2, 9, 30])):
            parent = r.choice([None, 999, n - 1, r.randrange(n)]) if n else None
            rows.append((t, n, parent, r.choice(["user", "assistant", "system"]), r.choice(["hi", "<|im_end|>\n", "a<", "|b", "\\", "<\\|x", "", "é\nz"]), r.choice([0.0, 1.0, 2.5])))
    rows += [(50, 1, 2, "user", "x", 1.0), (50, 2, 1, "user", "y", 1.0), (50, 3, None, "user", "z", None), (51, 1, None, None, None, None), (51, 1, None, None, None, None)]
    return rows + [(60, i, i - 1 if i else None, "assistant", str(i), 0.0) for i in range(70)]


@pytest.mark.parametrize("branches", [1, 3])
def test_best_paths_and_round_trip(spark, branches):
    rows = forest(branches)
    out = chat.format_reply_trees(spark.createDataFrame(rows, SCHEMA), branches)
    got = {}
    for x in out.select("tree_id", "branch", "leaf_id", "formatted", "loss_mask", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect():
        turns = [(t.role, t.text) for t in x.turns]
        got[x.tree_id, x.branch] = (x.leaf_id, turns)
        assert x.loss == "".join(t for role, t in turns if role == "assistant")
        spans = [x.formatted[m.offset : m.offset + m.length] for m in x.loss_mask]
        assert all("<|" not in s for s in spans) and len(spans) == sum(role == "assistant" for role, _ in turns)
    assert got == brute(rows, branches)


def test_linear_conversations(spark):
    rows = [(1, 2, "assistant", "c", 9), (1, 0, "user", chat.PROBE, 9), (1, 1, "assistant", None, 9), (2, None, "a%3C\nb", "<|x", 9), (2, None, None, "y", 9), (None, 1, "user", "n", 9), (None, 0, "assistant", "m", 9)]
    trees = chat.as_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score int"))
    out = chat.format_reply_trees(trees).select("tree_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    got = {x.tree_id: [(t.role, t.text) for t in x.t] for x in out}
    assert got == {1: [("user", chat.PROBE), ("assistant", ""), ("assistant", "c")], 2: [("", "y"), ("a%3C\nb", "<|x")], None: [("assistant", "m"), ("user", "n")]}


def test_empty(spark):
    assert chat.format_reply_trees(spark.createDataFrame([], SCHEMA)).count() == 0
