"""Counts by the contract's words, and thresholds that follow the data."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import quality

SCHEMA = "doc_id long, lang string, source string, text string, kept string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, len("".join(words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def texts(seed, n):
    r = random.Random(seed)
    vocab = ["a", "bé", "c#", "d d", "long" * 9, "日本", "\x1c"]
    return [r.choice([" ", "\n", "\t", " \n"]).join(r.choices(vocab[: r.choice([1, 3, 7])], k=r.choice([0, 1, 4, 5, 9, 30, 200]))) for _ in range(n)]


def test_counts_against_brute_force(spark):
    rows = [(i, "l", "s", t, "") for i, t in enumerate(texts(1, 200))] + [(500, None, None, None, ""), (501, "l", None, "", ""), (1, "l", "s", "x y\nx y", ""), (1, "l", "s", "x y\nx y", "")]
    got = quality.score_quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((x.doc_id, *x[1:7]) for x in got) == sorted((i, *brute(t)) for i, _, _, t, _ in rows)
    assert all(not x.kept for x in got if x.base_failed)


def test_thresholds_follow_their_group(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 8)))
    plain = [" ".join(word() for _ in range(60)) for _ in range(300)]
    code = [" ".join(word() + r.choice(["#", "$", "", ""]) for _ in range(60)) for _ in range(300)]
    rows = [(i, "en", "web", t, "") for i, t in enumerate(plain)] + [(1000 + i, "en", "code", t, "") for i, t in enumerate(code)]
    rows += [(5000, "en", "web", code[0] + " # # # # # # # # #", ""), (5001, "en", "code", code[0], "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    lost = {x.doc_id for x in quality.score_quality(docs).where("NOT kept").collect()}
    assert lost == {5000}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1


def test_every_fence_comes_from_the_data(spark):
    """Other texts, other fences; and each measure rejects what the base rule
    lets pass."""
    r = random.Random(5)
    word = lambda k: "".join(r.choices("abcdefgh", k=r.randrange(2, k)))
    text = lambda k, n: "\n".join(" ".join(word(k) for _ in range(6)) for _ in range(n))
    rows = [(i, "en", "web", text(7, 30), "") for i in range(300)] + [(1000 + i, "en", "notes", text(12, 8), "") for i in range(300)]
    fences = {x.source: x for x in quality.thresholds(quality.sketches(quality.counted(spark.createDataFrame(rows, SCHEMA), ["lang", "source"]))).collect()}
    for m, (sides, *_) in quality.METRICS.items():
        for side in sides:
            assert fences["web"][f"{m}_{side}"] != fences["notes"][f"{m}_{side}"], (m, side)
    twice = " ".join(word(7) for _ in range(18))
    odd = [
        (5000, "en", "web", text(30, 30), ""),
        (5001, "en", "web", " ".join("ab" for _ in range(9)).replace(" ", "\n") + "\n" + text(7, 20), ""),
        (5002, "en", "web", twice + "\n" + twice + "\n" + text(7, 27), ""),
        (5003, "en", "web", text(7, 30) + " # $ # $ # $", ""),
        (5004, "en", "web", " ".join(r.choices("abcdefghijkl", k=180)), ""),
    ]
    got = {x.doc_id: x for x in quality.score_quality(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    lost = {i for i, x in got.items() if not x.kept}
    assert lost == {x[0] for x in odd} and not any(got[i].base_failed for i in lost)


def test_small_groups_borrow_smoothly(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 8)))
    rows = [(i, "en", "big", " ".join(word() for _ in range(60)), "") for i in range(400)]
    rows += [(1000 + i, "en", f"s{n}", " ".join(word() * 2 for _ in range(60)), "") for n in (1, 10, 100) for i in range(n)]
    rows += [(2000, None, None, None, ""), (2001, "", "big", "", "")]
    middle = {x.source: x.word_length for x in quality.thresholds(quality.sketches(quality.counted(spark.createDataFrame(rows, SCHEMA), ["lang", "source"]))).where("lang = 'en'").collect()}
    assert middle["big"] < middle["s1"] < middle["s10"] < middle["s100"] < 2 * middle["big"]


def test_equal_texts_and_clashing_names(spark):
    rows = [(i, "l", "s", "one text that all rows of the corpus have in common so", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("counts", "FENCE", "fence_lang", "__m", "a`b", "n_words", "word_length", "middle_n_words"):
        docs = docs.withColumn(c, F.lit("q"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 40


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.score_quality(docs).count() == 0 and quality.keep_good(docs).count() == 0


def test_rates_of_rare_things_set_their_fences(spark):
    """One text in seven of a source has a few symbols, so its quartiles are
    zero as everywhere; its fence follows its rate all the same, and what it
    lets pass falls in a source without symbols."""
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 8)))

    def text(symbols):
        words = [word() for _ in range(120)]
        for i in r.sample(range(120), symbols):
            words[i] += "#"
        return " ".join(words)

    rows = [(i, "en", "web", text(0), "") for i in range(400)] + [(1000 + i, "en", "notes", text(40 if i % 7 == 0 else 0), "") for i in range(400)]
    rows += [(5000, "en", "web", text(9), ""), (5001, "en", "notes", text(9), ""), (5002, "en", "notes", text(110), "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    fences = {x.source: x for x in quality.thresholds(quality.sketches(quality.counted(docs, ["lang", "source"]))).collect()}
    floor = lambda x: quality.RULE_OF_THREE / x.middle_word_chars
    far = {s: x.symbol_share_rate + quality.DEVIATIONS * (x.symbol_share_rate / x.middle_word_chars) ** 0.5 for s, x in fences.items()}
    assert all(x.symbol_share == 0 for x in fences.values())
    assert far["notes"] > 3 * floor(fences["notes"]) and far["notes"] > 1.5 * far["web"]
    lost = {x.doc_id for x in quality.score_quality(docs).where("NOT kept").collect()}
    assert 5000 in lost and 5001 not in lost and 5002 in lost
