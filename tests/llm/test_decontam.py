"""Decontamination against the contract spelled out."""

import hashlib
import random

import pytest

from lectern.llm import decontam


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, hit string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id long")
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    return sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), digest(r["items"]), r.n_hit > 0) for r in decontam.scored(d, b).collect()), key=str)


def cases():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(30)] + ["Straße", "ÉTÉ", "x1", "ñ"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 4, 5, 9, 10, 11, 25]))), 0) for i in range(25)]
    items[3] = (3, "zebra Yak", 0)
    items += [(25, None, 0), (26, " ,. ", 0), (27, items[8][1].upper(), 0), (27, items[8][1], 0), (None, "w1 w2", 0)]
    items = [x for x in items if x[1] is None or len(x[1].split()) > 1]
    docs = []
    for i in range(80):
        words = r.choices(vocab, k=r.choice([0, 1, 5, 60]))
        for _ in range(r.choice([0, 1, 2])):
            own = (r.choice(items)[1] or "").split()
            a = r.randrange(len(own) + 1)
            words[r.randrange(len(words) + 1) :] += own[a:] + r.choices(vocab, k=3)
        docs.append((i, r.choice([" ", "-", "\n", "  "]).join(words), "q"))
    return docs + [(900, None, None), (901, "", ""), (902, docs[1][1], ""), (902, docs[1][1], "")], items


@pytest.mark.parametrize("block", [2 << 20, 400])
def test_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PIECE_BYTES", block // 8)
    docs, items = cases()
    want = [(i, *decontam.brute_force(t, [(str(k), b) for k, b, _ in items if k is not None])) for i, t, _ in docs]
    assert run(spark, docs, items) == sorted(want, key=str)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == []
    assert all(not x[-1] for x in run(spark, docs, []))


def test_pieces_hold_every_window():
    r = random.Random(1)
    words = [str(r.randrange(10**6)).encode() for _ in range(500)]
    for size, n in ((1, 500), (60, 500), (100, 10), (100, 9), (100, 1), (10**6, 500)):
        decontam.PIECE_BYTES, before = size, decontam.PIECE_BYTES
        pieces = [p.split(b" ") for p in decontam.pieces_of(words[:n])]
        decontam.PIECE_BYTES = before
        own = [tuple(p[i : i + 10]) for p in pieces for i in range(max(1, len(p) - 9))]
        assert own == [tuple(words[i : min(n, i + 10)]) for i in range(max(1, n - 9))]


@pytest.mark.parametrize("block", [2 << 20, 300])
def test_many_items_of_one_text(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    text = " ".join(f"v{i}" for i in range(12))
    items = [(i, text.upper() if i % 2 else text + ".", 0) for i in range(10_000)] + [(20_000 + i, f"other words of item {i} that go on and on until ten", 0) for i in range(20)]
    docs = [(1, "a " + text + " b", "q"), (2, "nothing at all", "q"), (3, None, "q"), (4, items[10_003][1], "q")]
    collected = []
    monkeypatch.setattr(decontam, "windows_of", lambda pieces, own=decontam.windows_of: collected.extend(pieces) or own(pieces))
    got = {x[0]: x[1:4] for x in run(spark, docs, items)}
    assert got == {1: (14, 12, 10_000), 2: (3, 0, 0), 3: (0, 0, 0), 4: (12, 12, 1)}
    assert len(collected) == 21  # texts, not items


@pytest.mark.parametrize("block", [2 << 20, 400])
def test_stage_keeps_clean_documents_whole(spark, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string, hit string")
    for c in ("__hit", "HIT_", "a`b", "file", "row", "texts"):
        d = d.withColumn(c, d.hit)
    kept = decontam.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string, doc_id long"))
    assert kept.columns == d.columns
    want = sorted(i for i, t, _ in docs if not decontam.brute_force(t, [(str(k), b) for k, b, _ in items if k is not None])[-1])
    assert sorted(x.doc_id for x in kept.collect()) == want
