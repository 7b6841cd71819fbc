"""Toxicity by weak supervision.

1. Features are words and beginnings of words. From a sample of labelled
   texts, at most TRAIN_ROWS and no text twice, those that tell toxic from other
   texts significantly are kept.
2. The strongest become lexicon voters (whole words) and pattern voters
   (beginnings of words, several hits, dense hits). A voter says toxic or
   abstains; the given label, where there is one, is one more voter, which
   says toxic or not and may be wrong.
3. A generative model of the votes of all documents outside the held-out part,
   each counted once, is fitted by expectation maximisation over counts of vote
   patterns: how often
   each voter fires in either class. Its second moments give correlations
   within the classes, and a voter's weight is shared among those it moves with.
4. A linear classifier over the kept features is trained on the posterior
   labels of the sample, and scores every whole text.

Null or empty text: no feature, the classifier's constant. No labels, or of
one class only: score is the share of toxic labels (0 without any). Labels
with null id or value: ignored; several of one text: toxic if any is. Null
id: as an empty id. Repeated rows: scored each, alike; as training texts they
count once. A score of exactly 0.5 is predicted toxic. Equally strong features:
the smaller hash first. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, buffers
from .decontam import Lookup

TRAIN_ROWS = 20_000
FEATURES = 4096
VOTERS = 48
#: Likelihood ratio statistic that a feature must reach: about 1 in a million.
SIGNIFICANT = 24.0
PREFIXES = (4, 5, 6, 7, 8)
ROUNDS = 12
#: Up to so many counts of patterns the driver sums them itself: 2 MB.
FEW_PATTERNS = 100_000
_SALT = 0x51ED270B9F1A3C57


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature hashes, text index): whole words, then beginnings by length in
    bytes. A feature's lowest bit says whether it is a beginning."""
    low = buffers.LOWER[data]
    starts, ends, first = buffers.spans(low, at, buffers.ALNUM)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield buffers.word_hashes(low, starts, ends) & ~np.uint64(1), text
    for n in PREFIXES:
        longer = ends - starts > n
        part = buffers.word_hashes(low, starts[longer], starts[longer] + n)
        yield buffers.mixed(part ^ np.uint64(_SALT)) | np.uint64(1), text[longer]


def _pairs(data: np.ndarray, at: np.ndarray, lookup: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature); with lookup, those found, by their rank."""
    texts, features = [], []
    for h, text in _features(data, at):
        if lookup is not None:
            hit, h = lookup.find(h)
            text = text[hit]
        texts.append(text)
        features.append(h)
    text, feature = np.concatenate(texts), np.concatenate(features)
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])]) if len(text) else np.zeros(0, bool)
    return text[new], feature[new]


def _sum_rows(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def chosen_labels(labels: DataFrame, allowed: Column, most: int) -> DataFrame:
    """(doc_id, toxic) of at most `most` ids, a pseudo-random and repeatable
    choice, and so small enough to be broadcast."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(allowed)
    own = own.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return base.stored(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")


def labelled_sample(docs: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """(key, text, toxic) of the texts of the chosen ids, each text once and
    `most` in all: an id may stand for many rows."""
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = base.stored(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64("text")), "texts")
    if texts.count() > most:
        last = texts.select("key").orderBy("key").limit(most).agg(F.max("key")).first()[0]
        texts = base.stored(texts.where(F.col("key") <= last), "sample")
    return texts


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(features by falling strength, their log odds, toxic and other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                toxic = rows.column(1).to_numpy()
                text, feature = _pairs(data, at)
                keys, where = np.unique(feature, return_inverse=True)
                t = np.bincount(where, toxic[text], len(keys)).astype(np.int64)
                n = np.bincount(where, minlength=len(keys)) - t
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(t), pa.array(n)], names=["feature", "t", "n"])

    total = sample.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, other = total.t or 0, total.n - (total.t or 0)
    if not toxic or not other:
        return np.zeros(0, np.uint64), np.zeros(0), toxic, other
    counts = _sum_rows(sample.select("text", "toxic").mapInArrow(run, "feature long, t long, n long"), ["feature"], ["t", "n"])
    part = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) * F.lit(toxic + other) / (F.lit(b) * (F.col("t") + F.col("n"))))).otherwise(0.0)
    ratio = 2 * (part("t", toxic) + part("n", other))
    strong = counts.where((F.col("t") * other > F.col("n") * toxic) & (F.col("t") >= 3)).withColumn("g", ratio).where(F.col("g") >= SIGNIFICANT)
    rows = strong.orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    odds = np.array([np.log((r.t + 0.5) / (toxic + 1)) - np.log((r.n + 0.5) / (other + 1)) for r in rows])
    return np.array([r.feature for r in rows], np.int64).view(np.uint64), odds, toxic, other


@dataclass
class Voters:
    """The features that vote, by rank in lookup; two patterns come after."""

    lookup: Lookup
    bit: np.ndarray  # of each feature of lookup: its voter, or -1

    @property
    def n(self) -> int:
        return int(self.bit.max(initial=-1)) + 3

    def votes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A bit for each voter that calls a text toxic."""
        text, feature = _pairs(data, at, self.lookup)
        n = len(at) - 1
        bit = self.bit[feature]
        out = np.zeros(n, np.int64)
        np.bitwise_or.at(out, text[bit >= 0], np.int64(1) << bit[bit >= 0])
        hits = np.bincount(text, minlength=n)
        top = self.n
        out |= (hits >= 3).astype(np.int64) << np.int64(top - 2)
        out |= ((hits > 0) & (hits * 400 > np.diff(at))).astype(np.int64) << np.int64(top - 1)
        return out


def voters_of(features: np.ndarray) -> Voters:
    lookup = Lookup(features)
    bit = np.full(len(lookup.hashes), -1, np.int64)
    bit[np.searchsorted(lookup.hashes, features[:VOTERS])] = np.arange(min(VOTERS, len(features)))
    return Voters(lookup, bit)


def vote_patterns(docs: DataFrame, chosen: DataFrame, voters: Voters, allowed: Column) -> DataFrame:
    """(votes, label, n) over all documents outside the held-out part, each
    counted once; label is null where none was chosen."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.votes(data, at)), rows.column(1)], names=["votes", "toxic"])

    rows = docs.select("doc_id", "text").where(allowed).join(F.broadcast(chosen), "doc_id", "left").select("text", "toxic")
    return base.stored(rows.mapInArrow(run, "votes long, toxic int").groupBy("votes", "toxic").agg(F.count("*").alias("n")), "patterns")


def _bits(votes: np.ndarray, n: int) -> np.ndarray:
    return ((votes[:, None] >> np.arange(n)) & 1).astype(np.float64)


@dataclass
class LabelModel:
    """fires[c, v]: how often voter v fires in class c; share[v]: which part
    of its evidence is its own; right: how often given labels are right."""

    prior: float
    fires: np.ndarray
    share: np.ndarray
    right: float

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic); labels are 1, 0, or -1 where there is none."""
        b = _bits(votes, self.fires.shape[1])
        with np.errstate(divide="ignore"):
            yes, no = np.log(self.fires[1] / self.fires[0]), np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        z = np.log(self.prior / (1 - self.prior)) + b @ (yes * self.share) + (1 - b) @ (no * self.share)
        z += np.where(labels < 0, 0, (2 * labels - 1) * np.log(self.right / (1 - self.right)))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(votes: np.ndarray, labels: np.ndarray, n: np.ndarray, model: LabelModel, second: bool) -> np.ndarray:
    """For either class its weight, then its votes (with second: its pairs of
    votes), and the weight of given labels and of right ones."""
    v = model.fires.shape[1]
    total = np.zeros(2 * (1 + (v * v if second else v)) + 2)
    for i in range(0, len(votes), 4096):
        part = slice(i, i + 4096)
        p = model.posterior(votes[part], labels[part])
        b, m, out = _bits(votes[part], v), n[part], []
        for w in (m * (1 - p), m * p):
            out += [[w.sum()], ((b * w[:, None]).T @ b).ravel() if second else w @ b]
        given = labels[part] >= 0
        right = np.where(labels[part] == 1, p, 1 - p)
        total += np.concatenate([*out, [m[given].sum(), (m * right)[given].sum()]])
    return total


def _columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    votes, toxic, n = (batch.column(c) for c in ("votes", "toxic", "n"))
    return votes.to_numpy(), pc.fill_null(toxic, -1).to_numpy(), n.to_numpy().astype(np.float64)


class Patterns:
    """Counts of vote patterns: on the driver where they are few, for then a
    round is no job; else on the executors, one partial sum a partition."""

    def __init__(self, patterns: DataFrame):
        self.rows = patterns
        self.own = _columns(patterns.orderBy("votes", "toxic").toArrow()) if patterns.count() <= FEW_PATTERNS else None

    def moments(self, model: LabelModel, second: bool) -> np.ndarray:
        if self.own is not None:
            return _sums(*self.own, model, second)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                total = total + _sums(*_columns(batch), model, second)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "x"])

        rows = self.rows.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        return np.array([r.x for r in sorted(rows, key=lambda r: r.i)])


def fit_label_model(patterns: Patterns, voters: Voters, toxic: int, other: int) -> LabelModel:
    """EM from the labels' share of toxic rows, then correlations: of each
    voter with the others within the classes, from the posterior's second
    moments; correlated voters share their evidence, and EM goes on."""
    v = voters.n
    prior = (toxic + 0.5) / (toxic + other + 1)
    model = LabelModel(prior, np.stack([np.full(v, 0.002), np.full(v, 0.2)]), np.ones(v), 0.95)
    for step in range(ROUNDS):
        m = patterns.moments(model, False)
        w0, f0, w1, f1 = m[0], m[1 : v + 1], m[v + 1], m[v + 2 : 2 * v + 2]
        fires = np.stack([(f0 + 0.01) / (w0 + 1), (f1 + 0.1) / (w1 + 1)])
        right = np.clip((m[-1] + 19) / (m[-2] + 20), 0.8, 0.99)
        share = model.share
        if step in (2, ROUNDS // 2):
            s = patterns.moments(model, True)
            share = np.ones(v)
            both = np.zeros((v, v))
            for c in (0, 1):
                o = c * (1 + v * v)
                w, pairs = max(s[o], 1e-9), s[o + 1 : o + 1 + v * v].reshape(v, v)
                mean = np.diag(pairs) / w
                sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
                rho = (pairs / w - np.outer(mean, mean)) / np.outer(sd, sd)
                both = np.maximum(both, np.where(np.outer(mean, mean) > 0, rho, 0))
            share = 1 / np.maximum(1, np.clip(both, 0, 1).sum(axis=1))
        model = LabelModel(float(np.clip(w1 / (w0 + w1), 1e-6, 0.5)), np.clip(fires, 1e-7, 1 - 1e-7), share, float(right))
    return model


@dataclass
class Classifier:
    lookup: Lookup | None
    weights: np.ndarray
    constant: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = np.full(len(at) - 1, self.constant)
        if self.lookup is not None:
            text, feature = _pairs(data, at, self.lookup)
            z += np.bincount(text, self.weights[feature], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_linear(sample: DataFrame, voters: Voters, model: LabelModel) -> Classifier:
    """Logistic regression on the posterior labels of the sample, which has
    TRAIN_ROWS rows at most."""
    shared = sample.sparkSession.sparkContext.broadcast((voters, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label_model = shared.value
        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                text, feature = _pairs(data, at, own.lookup)
                p = label_model.posterior(own.votes(data, at), rows.column(2).to_numpy())
                at_row = np.searchsorted(text, np.arange(rows.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at_row.astype(np.int32)), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(p), lists], names=["key", "p", "features"])

    rows = sample.select("text", "key", "toxic").mapInArrow(run, "key long, p double, features array<int>").orderBy("key", "p").toArrow()
    target = rows.column("p").to_numpy()
    lists = rows.column("features").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    feature = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(target)), np.diff(lists.offsets.to_numpy()))
    n, width = len(target), len(voters.lookup.hashes)
    w, c = np.zeros(width), float(np.log((target.sum() + 0.5) / (n - target.sum() + 0.5)))
    m, s, mc, sc = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, 401):
        z = c + np.bincount(row, w[feature], n)
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g, gc = np.bincount(feature, gap[row], width) + 0.3 * w, gap.sum()
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        mc, sc = 0.9 * mc + 0.1 * gc, 0.99 * sc + 0.01 * gc * gc
        rate = 0.1 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        c -= rate * (mc / (1 - 0.9**step)) / (np.sqrt(sc / (1 - 0.99**step)) + 1e-8)
    return Classifier(voters.lookup, w, c)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = TRAIN_ROWS) -> Classifier:
    """A classifier from docs(doc_id, text) and labels(doc_id, toxic), using
    rows where allowed holds only."""
    with base.scratch():
        chosen = chosen_labels(labels, allowed, most)
        sample = labelled_sample(docs, chosen, most)
        features, _, toxic, other = mine(sample)
        if not len(features):
            share = (toxic + 0.0) / max(1, toxic + other)
            return Classifier(None, np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        voters = voters_of(features)
        model = fit_label_model(Patterns(vote_patterns(docs, chosen, voters, allowed)), voters, toxic, other)
        return train_linear(sample, voters, model)


def scored(docs: DataFrame, classifier: Classifier, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(classifier)
    carried = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, at in buffers.slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(shared.value.scores(data, at))], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    return carried.mapInArrow(run, f"{schema}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    held = F.pmod(base.crc32_of_id(), F.lit(5)) == 0
    classifier = learn(docs, base.table(spark, sf_dir, "labels"), ~held)
    rows = scored(docs.select("doc_id", held.alias("held_out"), "text"), classifier, ["doc_id", "held_out"])
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
