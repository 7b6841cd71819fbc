"""The label model on made votes, held-out accuracy, and scores by brute force."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import buffers, toxicity

DATA = "/root/testdata/sf0.1"


def test_label_model_finds_accuracies_and_shares_evidence(spark):
    r = np.random.default_rng(3)
    y = r.random(20_000) < 0.1
    rates = [(0.5, 0.01), (0.3, 0.005), (0.4, 0.02), (0.2, 0.01)]
    votes = np.zeros(len(y), np.int64)
    for v, (p, q) in enumerate(rates):
        votes |= (r.random(len(y)) < np.where(y, p, q)).astype(np.int64) << v
    votes |= (votes & 1) << 4  # a twin of the first voter
    labels = np.where(np.arange(len(y)) < 1500, y.astype(int), -1)
    rows = [(int(v), None if t < 0 else int(t)) for v, t in zip(votes, labels)]
    patterns = spark.createDataFrame(rows, "votes long, toxic int").groupBy("votes", "toxic").agg(F.count("*").alias("n"))
    voters = toxicity.Voters(toxicity.Lookup(np.arange(3, dtype=np.uint64)), np.arange(3))
    model = toxicity.fit_label_model(toxicity.Patterns(patterns), voters, 150, 1350)
    spread = toxicity.Patterns(patterns)
    spread.own = None
    for second in (False, True):
        assert np.allclose(spread.moments(model, second), toxicity.Patterns(patterns).moments(model, second), rtol=1e-9)
    assert abs(model.prior - 0.1) < 0.03
    for v, (p, q) in enumerate(rates):
        assert abs(model.fires[1, v] - p) < 0.1 and abs(model.fires[0, v] - q) < 0.02
    assert model.share[0] < 0.6 and model.share[4] < 0.6 and model.share[3] > 0.7


def test_held_out_accuracy(spark):
    rows = toxicity.op8_toxicity(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, clean = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert toxic.predicted.mean() > 0.75 and clean.predicted.mean() < 0.02
    order = rows.score.rank()
    auc = (order[rows.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert auc > 0.88 and rows.score.between(0, 1).all()


def test_edges(spark):
    docs = spark.createDataFrame([(i, "you fool " + "x" * i if i % 3 == 0 else f"fine day {i}", i) for i in range(60)] + [(None, None, 0), (100, "", 0), (3, "you fool", 0), (3, "you fool", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 1) for i in range(60)] + [(None, 1, 1), (5, None, 1), (3, 1, 1)], "doc_id long, toxic int, held_out int")
    c = toxicity.learn(docs, labels, F.lit(True))
    got = toxicity.scored(docs, c, ["doc_id"]).collect()
    assert len(got) == docs.count()
    assert all((x.score >= 0.5) == (x.doc_id is not None and x.doc_id % 3 == 0 and x.doc_id < 60) for x in got)
    none = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert all(x.score < 0.5 for x in toxicity.scored(docs, none, ["doc_id"]).collect())
    assert toxicity.scored(docs.limit(0), c, ["doc_id"]).count() == 0


def test_bounds_hold_for_repeated_documents(spark):
    docs = spark.createDataFrame([(1, "you fool")] * 1000 + [(2, f"text {i}") for i in range(300)] + [(i, f"own text {i}") for i in range(3, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    for most in (10, 50, 5000):
        chosen = toxicity.chosen_labels(labels, F.lit(True), most)
        sample = toxicity.labelled_sample(docs, chosen, most).collect()
        assert len(sample) == len({x.text for x in sample}) <= most
    assert len(sample) == 1 + 300 + 57
    voters = toxicity.voters_of(np.arange(1, 4, dtype=np.uint64))
    counted = toxicity.vote_patterns(docs, chosen, voters, F.lit(True)).agg(F.sum("n")).first()[0]
    assert counted == docs.count()



def test_repeated_documents_and_ties(spark, tmp_path):
    """Equal texts score alike wherever they stand, and a text without any
    feature stands at the classifier's constant; 0.5 is predicted toxic."""
    texts = [(f"you fool {i}", 1) if i % 4 == 0 else (f"fine day number {i}", 0) for i in range(400)]
    docs = [(i, t, "en", "s") for i, (t, _) in enumerate(texts)] + [(i, t, "de", None) for i, (t, _) in enumerate(texts[:50])] + [(900, None, None, None), (901, "", None, None), (None, "you fool", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = toxicity.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    own = {i: t for i, t, *_ in docs}
    scores = {}
    for r in rows:
        scores.setdefault((own[r.doc_id] or ""), set()).add(r.score)
    assert all(len(x) == 1 for x in scores.values())
    assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.predicted == int((own[r.doc_id] or "").startswith("you")) for r in rows)
    even = toxicity.Classifier(None, np.zeros(0), 0.0)
    assert {x.score for x in toxicity.scored(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), even, ["doc_id"]).collect()} == {0.5}


def brute_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {(0, w) for w in words} | {(1, w[:n]) for w in words for n in (4, 5, 6, 7, 8) if len(w) > n}


def order_of(feature):
    """Equally strong features: the smaller hash first."""
    kind, w = feature
    h = buffers.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    return int((buffers.mixed(h ^ np.uint64(toxicity._SALT)) | np.uint64(1) if kind else h & ~np.uint64(1)).view(np.int64)[0])


def brute_scores(docs, labels):
    """The query's scores from raw texts: rows (doc_id, text), (doc_id, toxic)."""
    allowed = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 0
    given = {}
    for i, y in labels:
        if i is not None and y is not None and allowed(i):
            given[i] = max(given.get(i, 0), int(y == 1))
    sample = {}
    for i, t in docs:
        if i in given:
            sample[t] = max(sample.get(t, 0), given[i])
    has = {t: brute_features(t) for t in {t for _, t in docs}}
    toxic = sum(sample.values())
    other = len(sample) - toxic
    seen = {}
    for t, y in sample.items():
        for f in has[t]:
            seen.setdefault(f, [0, 0])[1 - y] += 1
    part = lambda a, b, s: a * math.log(a * (toxic + other) / (b * s)) if a else 0.0
    strong = []
    for f, (t, n) in seen.items():
        g = 2 * (part(t, toxic, t + n) + part(n, other, t + n))
        if t * other > n * toxic and t >= 3 and g >= 24:
            strong.append((-g, order_of(f), f))
    kept = [f for _, _, f in sorted(strong)]
    voters = kept[:48]

    def votes(t):
        hits = sum(f in has[t] for f in kept)
        return [*(float(f in has[t]) for f in voters), float(hits >= 3), float(hits > 0 and hits * 400 > len((t or "").encode()))]

    rows = [(votes(t), given.get(i)) for i, t in docs if allowed(i)]
    b, v = np.array([x for x, _ in rows]), len(voters) + 2

    def posterior(vote, label):
        z = math.log(prior / (1 - prior))
        for k, x in enumerate(vote):
            z += share[k] * (math.log(fires[1][k] / fires[0][k]) if x else math.log((1 - fires[1][k]) / (1 - fires[0][k])))
        if label is not None:
            z += (1 if label else -1) * math.log(right / (1 - right))
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    prior, fires, share, right = (toxic + 0.5) / (toxic + other + 1), [[0.002] * v, [0.2] * v], [1.0] * v, 0.95
    for step in range(12):
        p = np.array([posterior(*r) for r in rows])
        weight = [(1 - p).sum(), p.sum()]
        new = [((1 - p) @ b + 0.01) / (weight[0] + 1), (p @ b + 0.1) / (weight[1] + 1)]
        own = [(x if y else 1 - x) for x, (_, y) in zip(p, rows) if y is not None]
        if step in (2, 6):
            most = np.zeros((v, v))
            for w in (1 - p, p):
                mean = w @ b / w.sum()
                for j in range(v):
                    for k in range(v):
                        sd = math.sqrt(max(mean[j] * (1 - mean[j]), 1e-12)) * math.sqrt(max(mean[k] * (1 - mean[k]), 1e-12))
                        if mean[j] * mean[k] > 0:
                            most[j, k] = max(most[j, k], ((w * b[:, j] * b[:, k]).sum() / w.sum() - mean[j] * mean[k]) / sd)
            share = [1 / max(1, sum(min(1, x) for x in row)) for row in most]
        prior = min(0.5, max(1e-6, weight[1] / sum(weight)))
        fires, right = [np.clip(x, 1e-7, 1 - 1e-7) for x in new], min(0.99, max(0.8, (sum(own) + 19) / (len(own) + 20)))

    place = {f: k for k, f in enumerate(kept)}
    x = np.zeros((len(sample), len(kept)))
    for r, t in enumerate(sample):
        x[r, [place[f] for f in has[t] if f in place]] = 1
    target = np.array([posterior(votes(t), y) for t, y in sample.items()])
    w, c = np.zeros(len(kept)), math.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))
    m, s = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for step in range(1, 401):
        gap = 1 / (1 + np.exp(-np.clip(c + x @ w, -40, 40))) - target
        g = np.append(gap @ x + 0.3 * w, gap.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = 0.1 / (1 + step / 100) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w, c = w - move[:-1], c - move[-1]
    line = lambda t: c + sum(w[place[f]] for f in has[t] if f in place)
    return [1 / (1 + math.exp(-max(-40, min(40, line(t))))) for _, t in docs], len(kept)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(17)
    plain = ["".join(r.choices("abcdeé", k=r.randrange(2, 10))) for _ in range(120)]
    rude = ["worthless", "worthlessness", "idiot", "Idiots", "scum", "moron", "trashé"]
    docs, labels = [], []
    for i in range(500):
        bad = r.random() < 0.25
        words = r.choices(plain, k=r.choice([3, 8, 30])) + r.choices(rude, k=r.choice([1, 2, 4]) if bad else int(r.random() < 0.03))
        r.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(bad) if r.random() < 0.97 else int(not bad)))
    docs += [(600, None), (601, ""), (None, "idiot scum"), (7, docs[7][1]), (602, docs[3][1]), (603, docs[4][1])]
    labels += [(602, 1), (603, 0), (601, 0), (600, 1), (None, 1), (9, None), (8, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want, kept = brute_scores(docs, labels)
    assert kept >= 10
    got = [(r.doc_id, r.score) for r in toxicity.op8_toxicity(spark, str(tmp_path)).collect()]
    key = lambda x: (x[0] is None, x[0] or 0)
    for (i, a), (j, b) in zip(sorted(got, key=key), sorted(zip([i for i, _ in docs], want), key=key)):
        assert i == j and abs(a - b) < 1e-6, (i, a, b)
