"""Language identification by Kneser-Ney character models.

Each language has an interpolated Kneser-Ney model of ORDER symbols: the
highest order by occurrences, lower orders by distinct left neighbours. Symbols
are the UTF-16 units of letters: one a letter, or two above the first plane.
An n-gram is its ORDER symbols of 16 bits, a whole 64-bit key. A language keeps
its own n-grams only, in sorted arrays with a probability for each, found by
bisection: no two n-grams meet, and a model grows with the distinct n-grams of
its language, 16 bytes each (and as much for each context).
A text goes to the language of the lowest cross-entropy per letter.

Rejection is calibrated on one text in HELD_BACK, chosen by content, which the
counts leave out. A text's p-value is the share of such texts of its language
and length class (doublings of letters) that are at least as far off. Shares
of small classes are averaged with those of the whole language, and these with
those of all languages, which weigh like 1/REJECTED texts each. p-values below
REJECTED are rejected, which befalls that share of texts like the learned ones.

Letters are those of Unicode, lower-cased; all else is one gap. Null text, or
no letter: `und`, score 0, not accepted. Nothing to learn from: `und`. Null
language: not learned from. Null id: as an empty id. Repeated rows: each
counts, and all stand on the same side of the calibration. Ties: the language
first by code point. Empty table: empty result. Extra columns: ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base, buffers

ORDER = 4
REJECTED = 0.005
HELD_BACK = 4
#: Width of a bucket of cross-entropy, in bits.
STEP = 1 / 64
#: Letters of evidence that the score counts at most.
EVIDENCE = 12.0
_COMPACT = 1 << 21


@cache
def _symbols() -> np.ndarray:
    """Code point to its letter in lower case; 0 if it is none."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def _in_units(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """letters as units of UTF-16: two for one above the first plane. at are
    the texts' bounds, renewed."""
    wide = letters > 0xFFFF
    if not wide.any():
        return letters, at
    ends = np.concatenate([[0], np.cumsum(1 + wide)])
    units = np.repeat(letters, 1 + wide)
    high, off = ends[:-1][wide], letters[wide] - 0x10000
    units[high], units[high + 1] = 0xD800 + (off >> 10), 0xDC00 + (off & 0x3FF)
    return units, ends[at]


def _code_points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes()
    try:
        whole = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        return whole, np.concatenate([[0], np.cumsum(buffers.per_text(buffers.LEADS[data], at))])
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]
        return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of ORDER symbols, one for each letter and gap, the newest
    symbol lowest, and the index of each text's first. Texts without letters
    have none."""
    points, at = _code_points(data, at)
    symbol, at = _in_units(_symbols()[points], at)
    before = np.concatenate([[0], symbol[:-1]]) if len(symbol) else symbol
    before[at[:-1][at[:-1] < len(symbol)]] = 0
    keep = (symbol != 0) | (before != 0)
    counts = buffers.per_text(keep, at)
    kept = symbol[keep]
    ends = np.cumsum(counts)
    closed = np.zeros(len(counts), bool)
    some = np.flatnonzero(counts)
    closed[some] = kept[ends[some] - 1] != 0
    length = counts + closed + 3 * (counts > 0)
    begin = np.concatenate([[0], np.cumsum(length)])
    line = np.zeros(begin[-1], np.uint64)
    line[np.arange(len(kept)) + np.repeat(begin[:-1] - (ends - counts) + 3, counts)] = kept
    n = length - 3 * (counts > 0)
    place = np.arange(n.sum()) + np.repeat(begin[:-1] + 3 - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    found = line[place]
    for back in (1, 2, 3):
        found |= line[place - back] << np.uint64(16 * back)
    return found, np.concatenate([[0], np.cumsum(n)])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    own, where = np.unique(k, return_inverse=True)
    return own, np.bincount(where, c, len(own)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs(lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            keys, counts = _merged(*held.pop(lang)[:2])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            for rows, data, at in buffers.slices(batch):
                found, first = grams(data, at)
                langs = np.array(rows.column(0).to_pylist(), object)
                for lang in sorted(set(langs)):
                    own = found[np.repeat(langs == lang, np.diff(first))]
                    if not len(own):
                        continue
                    codes, keys = pd.factorize(own)
                    counts = np.bincount(codes, minlength=len(keys))
                    h = held.setdefault(lang, [[], [], 0])
                    h[0].append(keys)
                    h[1].append(counts)
                    h[2] += len(keys)
                    if h[2] > _COMPACT:
                        k, c = _merged(h[0], h[1])
                        held[lang] = [[k], [c], len(k)]
                        if len(k) > _COMPACT // 2:
                            yield out(lang)
        for lang in list(held):
            yield out(lang)

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def continuations(counts: DataFrame, order: int) -> DataFrame:
    """Counts of the order below: distinct left neighbours of each n-gram."""
    return counts.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)).alias("gram")).agg(F.count("*").alias("n"))


def _sorted(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Places of queries in sorted keys, -1 where they are not."""
    if not len(keys):
        return np.full(len(queries), -1)
    at = np.minimum(np.searchsorted(keys, queries), len(keys) - 1)
    return np.where(keys[at] == queries, at, -1)


class Language:
    """The probabilities of one language, order by order."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray, float]], symbols: int):
        self.base = 1.0 / max(1, symbols)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for order in range(1, ORDER + 1):
            gram, n, discount = parts[order]
            before = gram >> np.uint64(16)
            ctx, at = np.unique(before, return_inverse=True)
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
            weight = discount * kinds / total if len(ctx) else np.zeros(0)
            p = np.maximum(n - discount, 0) / total[at] if len(ctx) else np.zeros(0)
            for j in range(0, len(gram), _COMPACT):
                part = slice(j, j + _COMPACT)
                p[part] += weight[at[part]] * self.probability(gram[part] & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
            self.grams[order], self.back[order] = (gram, p), (ctx, weight)

    def probability(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """P(newest symbol | the ones before) for each gram."""
        if order == 0:
            return np.full(len(gram), self.base)
        keys, values = self.grams[order]
        at = _sorted(keys, gram)
        out = values[at] if len(keys) else np.zeros(len(gram))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            own = gram[miss]
            ctx, weight = self.back[order]
            known = _sorted(ctx, own >> np.uint64(16))
            back = np.where(known >= 0, weight[known], 1.0) if len(ctx) else 1.0
            out[miss] = back * self.probability(own & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out


class Model:
    def __init__(self, parts: dict[str, dict[int, tuple[np.ndarray, np.ndarray, float]]], symbols: int):
        self.langs = sorted(parts, key=lambda x: x.encode("utf-8", "surrogatepass"))
        self.symbols = symbols
        self.own = [Language(parts[lang], symbols) for lang in self.langs]

    def entropies(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits per symbol of each text under each language. Every distinct
        n-gram of the texts is looked up once."""
        out = np.zeros((len(first) - 1, len(self.langs)))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            codes, grams_ = pd.factorize(found)
            for i, own in enumerate(self.own):
                bits = -np.log2(own.probability(grams_))
                out[some, i] = np.add.reduceat(bits[codes], first[some])
        return out / np.maximum(1, np.diff(first))[:, None]


def learn(docs: DataFrame) -> Model | None:
    """A model from all rows of docs(lang, text)."""
    with base.scratch():
        counts = {ORDER: base.stored(count_grams(docs), "grams")}
        for order in range(ORDER, 1, -1):
            counts[order - 1] = base.stored(continuations(counts[order], order), "grams")
        symbols = counts[1].select("gram").distinct().count()
        parts: dict[str, dict[int, tuple]] = {}
        for order, df in counts.items():
            t = df.select("lang", "gram", "n").toArrow()
            codes, langs = pd.factorize(t.column(0).to_numpy())
            gram, n = t.column(1).to_numpy().view(np.uint64), t.column(2).to_numpy()
            for i, lang in enumerate(langs):
                rows = np.flatnonzero(codes == i)
                rows = rows[np.argsort(gram[rows])]
                once, twice = int((n[rows] == 1).sum()), int((n[rows] == 2).sum())
                discount = once / (once + 2 * twice) if once and twice else 0.5
                parts.setdefault(str(lang), {})[order] = (gram[rows], n[rows].astype(np.float64), discount)
        return Model(parts, symbols) if parts else None


def identify(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns keep, lang_pred, score, bits (the lowest cross-entropy) and
    letters (symbols read, gaps among them)."""
    (name,) = base.fresh(docs.select(*keep), "body")
    carried = docs.select(*keep, F.col("text").alias(name))
    if model is None:
        return carried.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(0).cast("long").alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for rows, data, at in buffers.slices(batch, name):
                found, first = grams(data, at)
                n = np.diff(first)
                bits = own.entropies(found, first)
                best = np.argmin(bits, axis=1)
                low = bits[np.arange(len(n)), best]
                odds = np.exp2(-np.minimum(n, EVIDENCE)[:, None] * (bits - low[:, None]))
                score = np.where(n > 0, 1 / odds.sum(axis=1), 0.0)
                pred = [own.langs[b] if k else "und" for b, k in zip(best.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(pred), pa.array(score), pa.array(low, mask=n == 0), pa.array(n)], names=[*keep, "lang_pred", "score", "bits", "letters"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:-1])
    return carried.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double, letters long")


def held_back(text: str = "text") -> Column:
    """Whether a text serves for the calibration, not for the counts."""
    return F.pmod(F.xxhash64(text), F.lit(HELD_BACK)) == 0


def cutoffs(sketch: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int]]:
    """From (language, length class, bucket, texts), the last bucket that is
    accepted in each language and class."""
    prior = 1 / REJECTED
    size = max((b for _, _, b, _ in sketch), default=0) + 2

    def above(rows) -> tuple[np.ndarray, int]:
        """For each bucket, the texts in it or beyond, and all of them."""
        line = np.bincount([r[2] for r in rows], [r[3] for r in rows], size)
        return line[::-1].cumsum()[::-1], line.sum()

    beyond, n = above(sketch)
    everywhere = (1 + beyond) / (1 + n)
    out = []
    for lang in sorted({r[0] for r in sketch}):
        own = [r for r in sketch if r[0] == lang]
        beyond, n = above(own)
        of_lang = (beyond + prior * everywhere) / (n + prior)
        for kind in range(64):
            beyond, n = above([r for r in own if r[1] == kind])
            p = (beyond + prior * of_lang) / (n + prior)
            last = int(np.flatnonzero(p >= REJECTED)[-1])
            out.append((lang, kind, last if last < size - 1 else 2**31 - 1))  # too few texts to reject any
    return out


def calibrated(found: DataFrame, training: Column) -> DataFrame:
    """found(lang, lang_pred, bits, letters, …) with accepted, from the rows
    where training holds; false for `und`. The sketch has some thousands of
    rows for each language at most."""
    bucket, kind = F.floor(F.col("bits") / F.lit(STEP)).cast("int"), F.floor(F.log2("letters")).cast("int")
    own = found.where(training & (F.col("lang") == F.col("lang_pred")) & F.col("bits").isNotNull())
    sketch = own.groupBy("lang", kind.alias("kind"), bucket.alias("bucket")).agg(F.count("*").alias("n")).collect()
    cuts = cutoffs([tuple(r) for r in sketch])
    if not cuts:
        return found.withColumn("accepted", F.lit(False))
    table = found.sparkSession.createDataFrame(cuts, "cut_lang string, cut_kind int, cut int")
    table = base.maybe_broadcast(table, len(cuts), 1_000_000)
    rows = found.join(table, (F.col("lang_pred") == F.col("cut_lang")) & (kind == F.col("cut_kind")), "left")
    return rows.withColumn("accepted", F.coalesce(bucket <= F.col("cut"), F.lit(False))).drop("cut_lang", "cut_kind", "cut")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "lang", "text", (F.pmod(base.crc32_of_id(), F.lit(4)) == 2).alias("held_out"), held_back().alias("held_back"))
    model = learn(docs.where("NOT held_out AND NOT held_back AND lang IS NOT NULL"))
    found = base.stored(identify(docs, model, ["doc_id", "held_out", "held_back", "lang"]), "entropies")
    return calibrated(found, F.expr("NOT held_out AND held_back")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def brute_probability(texts: list[str], gram: tuple[str, ...], symbols: int) -> float:
    """Kneser-Ney by its definition over raw n-grams, for tests."""
    seen: dict[int, dict[tuple[str, ...], int]] = {k: {} for k in range(1, ORDER + 1)}
    for text in texts:
        line = [" "] * 3
        for c in text:
            c = c.lower()[0] if c.isalpha() else " "
            if c != " " or line[-1] != " ":
                units = c.encode("utf-16-be")
                line += [chr(int.from_bytes(units[i : i + 2])) for i in range(0, len(units), 2)]
        if line[3:] and line[-1] != " ":
            line.append(" ")
        for i in range(3, len(line)):
            g = tuple(line[i - 3 : i + 1])
            seen[ORDER][g] = seen[ORDER].get(g, 0) + 1
    for k in range(ORDER, 1, -1):
        for g in seen[k]:
            seen[k - 1][g[1:]] = seen[k - 1].get(g[1:], 0) + 1
    p = 1.0 / symbols
    for k in range(1, ORDER + 1):
        n1, n2 = (sum(1 for v in seen[k].values() if v == x) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = gram[ORDER - k :]
        same = {g: v for g, v in seen[k].items() if g[:-1] == own[:-1]}
        total = sum(same.values())
        if total:
            p = max(same.get(own, 0) - d, 0) / total + d * len(same) / total * p
    assert math.isfinite(p)
    return p
