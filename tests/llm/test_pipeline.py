"""The pipeline's stages against brute force, stage by stage, each on the
brute-force result of the one before."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest
from test_decontam import decontam
from test_mixing import brute as mix
from test_quality import brute as counts
from test_simhash import brute_components

from lectern.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def quartiles(values):
    """From a sketch's buckets, whose middles stand for their values."""
    edge = lambda v: 0.0 if v <= 0 else 2 * quality.GROWTH ** math.ceil(math.log(v) / math.log(quality.GROWTH)) / (quality.GROWTH + 1)
    ranked = sorted(values)
    return [edge(ranked[max(0, math.ceil(q * len(ranked)) - 1)]) for q in (0.25, 0.5, 0.75)]


def good(docs):
    """The rules of the quality module, spelled out text by text."""
    rows = []
    for d in docs:
        n, chars, symbols, dup, repeat, failed = counts(d[1])
        lines = len([x for x in (d[1] or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")])
        share = lambda a, b: a / b if b else 0.0
        own = {"word_length": share(chars, n), "symbol_share": share(symbols, chars), "repeated_lines": share(dup, lines), "repeated_words": share(repeat, n)}
        rows.append((d, failed, own | {"n_words": n, "word_chars": chars, "n_lines": lines}))

    def blended(d, m):
        found = None
        for level in (lambda x: True, lambda x: x[0][2] == d[2], lambda x: x[0][2:4] == d[2:4]):
            group = [x[2][m] for x in rows if level(x)]
            q = quartiles(group)
            found = q if found is None else [(len(group) * a + 50 * b) / (len(group) + 50) for a, b in zip(q, found)]
        return found

    kept, known = [], {}
    for d, failed, own in rows:
        if d[2:4] not in known:
            known[d[2:4]] = {m: blended(d, m) for m in own}
        q = known[d[2:4]]
        n = {m: max(1, own[m]) for m in ("n_words", "word_chars", "n_lines")}
        middle = {m: max(1, q[m][1]) for m in n}
        low, mid, high = q["word_length"]
        wider = math.sqrt(max(1, middle["n_words"] / n["n_words"]))
        ok = not failed and mid - max(6 * (mid - low), 0.02 * mid) * wider <= own["word_length"] <= mid + max(6 * (high - mid), 0.02 * mid) * wider
        for m, size, least in (("symbol_share", "word_chars", 1), ("repeated_lines", "n_lines", 1), ("repeated_words", "n_words", 10)):
            ok = ok and own[m] <= q[m][1] + max(6 * (q[m][2] - q[m][1]), 0.02 * q[m][1], 3 * least / min(middle[size], n[size]))
        if ok:
            kept.append(d)
    return kept


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(9)
    vocab = ["".join(r.choices("abcdefghijklmno", k=r.randrange(2, 8))) for _ in range(900)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([4, 15, 30])))) for i in range(12)]
    docs, texts = [], []
    for i in range(500):
        w = r.choices(vocab, k=r.choice([4, 12, 60, 200]))
        kind = r.random()
        if kind < 0.15 and texts:
            w = r.choice(texts).split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "changed"
        elif kind < 0.22:
            w[len(w) // 2 :] = r.choice(items)[1].split() + w[len(w) // 2 :]
        elif kind < 0.28:
            w = [x + "###" for x in w]
        elif kind < 0.33:
            w = w[:6] * 9
        texts.append(" ".join(w))
        docs.append((i, texts[-1], r.choice(["en", "en", "de", None]), r.choice(["hot", "hot", "hot", "b", "c", None]), len(texts[-1])))
    docs += [(900, None, "en", "b", 0), (901, "", None, None, 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_stages_against_brute_force(spark, tables):
    folder, docs, items = tables
    run = [f for _, f in corpus_pipeline.STAGES]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    got = lambda f, rows: sorted((tuple(x) for x in f(spark, frame(rows), folder).collect()), key=str)

    want = sorted(good(docs), key=str)
    assert got(run[0], docs) == want and 300 < len(want) < len(docs) - 20

    least = {i: c for i, _, c in brute_components([(d[0], d[1]) for d in want])}
    one = sorted((d for d in want if least[d[0]] == d[0]), key=str)
    assert got(run[1], want) == one and len(one) < len(want) - 20

    own = [(str(i), t) for i, t in items]
    clean = sorted((d for d in one if not decontam.brute_force(d[1], own)[-1]), key=str)
    assert got(run[2], one) == clean and len(clean) < len(one) - 10

    taken = {x[0]: x[4] // max(1, x[1]) for x in mix([(d[0], d[1], d[3]) for d in clean])}
    repeated = sorted((d for d in clean for _ in range(taken[d[0]])), key=str)
    assert got(run[3], clean) == repeated and len(repeated) != len(clean)

    shards = run[4](spark, frame(repeated), folder).collect()
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in shards) == Counter((d[0], len((d[1] or "").encode()) + 8, crc(d[1])) for d in repeated)
    slots = {}
    for x in shards:
        slots.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))

    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.size) for x in whole) == Counter((x.doc_id, x.size) for x in shards)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
