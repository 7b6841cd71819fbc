"""Fill-in-middle against a plain reading of the contract, token by token."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fim


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    i, j = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(units), form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text)


def texts(n=300):
    r = random.Random(5)
    some = ["a", "Zz", "word", "é", "漢", "\U00010330", " ", "\n", "7", "<", ">", "P", "<S", "S>", "\u0000", "x" * 50]
    made = ["".join(r.choices(some, k=r.choice([0, 1, 2, 3, 20, 400]))) for _ in range(n)]
    return [*made, None, "", "<P>", "a<M>b", "ab" * 50_000, "é" * 30_000, ("long words " * 9 + "漢字\n") * 3_000]


@pytest.mark.parametrize("chunk,piece", [(4096, 1 << 20), (7, 21), (1, 1)])
def test_cuts_whatever_the_chunks(monkeypatch, chunk, piece):
    monkeypatch.setattr(fim, "CHUNK", chunk)
    monkeypatch.setattr(fim, "PIECE", piece)
    r = random.Random(1)
    rows = [x for x in texts(80) if x is None or len(x) < 3000]
    raw = [(x or "").encode() for x in rows]
    draws = np.array([[r.getrandbits(32), r.getrandbits(32)] for _ in rows])
    draws[:10] = 0
    total, found = fim.cuts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), draws)
    for x, n, f, d in zip(rows, total, found, draws):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", x or "")
        assert n == len(units)
        assert [len("".join(units[: k % (n + 1)])) for k in d] == f.tolist()


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id here"), (-4, "below zero"), (3, "again"), (3, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_fill_in_middle(spark, str(tmp_path)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_operator_keeps_columns_and_restores_texts(spark):
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts(100))], "id long, body string, fim_text string").withColumn("a`b", F.lit(1)).withColumn("N", F.array(F.lit(2)))
    out, names = fim.transformed(docs, "id", "body", seed="other", rate=100, spm=50)
    assert out.columns == [*docs.columns, "n_tokens", "form", "prefix_chars", "middle_chars", "fim_text_"]
    rows = out.select("body", "form", fim.restored(F.col("fim_text_"), F.col("form")).alias("back")).collect()
    assert all(r.back == (r.body or "") for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all((r.form == "plain") == (not r.body or re.search("<[PSM]>", r.body) is not None) for r in rows)


def test_nothing_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "x y")], "doc_id long, text string")
    assert "Exchange" not in fim.transformed(docs)[0]._jdf.queryExecution().executedPlan().toString()
