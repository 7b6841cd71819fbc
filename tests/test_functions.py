"""Column functions and rules, value by value."""

import datetime

from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions import text as X


def one(spark, expression, **values):
    ddl = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], ddl).select(expression.alias("x")).first().x


def test_words(spark):
    for text, n in ((None, 0), ("", 0), (" \n", 0), ("a  b\nc", 3)):
        assert one(spark, X.word_count(F.col("t")), t=("string", text)) == n
    assert one(spark, X.first_words(F.col("t"), 2), t=("string", " a  b c")) == "a b"


def test_quarters_and_days(spark):
    assert one(spark, X.quarter_of(F.col("d")), d=("date", datetime.date(2024, 12, 1))) == "2024-Q4"
    assert one(spark, X.quarter_of(F.col("d")), d=("date", None)) == ""
    assert one(spark, X.quarter_label(X.quarter_index(F.col("q")) + 1), q=("string", "2024-Q4")) == "2025-Q1"
    assert one(spark, X.days_between(F.col("a"), F.col("b")), a=("string", "2024-01-01T10:00"), b=("string", "2024-01-11")) == 10
    assert one(spark, X.days_between(F.col("a"), F.col("b")), a=("string", "soon"), b=("string", "2024-01-11")) is None
    for text in ("2025-03-01", "2025-03-01T10:00:00+02:00", "1 March 2025", "March 1, 2025", "Mar 1, 2025", "1 Mar 2025", "01.03.2025"):
        assert one(spark, X.parsed_date(F.col("t")), t=("string", text)) == datetime.date(2025, 3, 1), text
    assert one(spark, X.parsed_date(F.col("t")), t=("string", "soon")) is None


def test_urls(spark):
    scope = lambda u: tuple(one(spark, X.url_scope(F.col("u"), ["x.org", "www.x.org"], ["report"]), u=("string", u)))
    assert scope("https://x.org/en/report/a") == ("publication", "report")
    assert scope("https://www.x.org/index%2Ephp/en/report/a/") == ("publication", "report")
    assert scope("https://x.org/en/about") == ("root-level", "")
    assert scope("https://x.org/en/team/a") == ("excluded", "team")
    assert scope("https://y.org/en/report/a") == ("excluded", "") and scope("https://x.org/de/report/a") == ("excluded", "")
    assert one(spark, X.url_slug(F.col("u")), u=("string", "https://x.org/en/report/a-b/?q=1")) == "a-b"
    same = lambda a, b: one(spark, X.same_page(F.col("a"), F.col("b")), a=("string", a), b=("string", b))
    assert same("http://www.X.org/index.php/en/a/", "https://x.org/en/a") and not same("https://x.org/en/a", "https://x.org/en/b")


def test_like_folds_ascii_only(spark):
    like = lambda t, p: one(spark, X.ascii_ilike(F.col("t"), p), t=("string", t))
    assert like("TARIFF", "%arif%") and like("a_c", "A_C") and not like("Äx", "äx")


def test_slugs_topics_vectors(spark):
    assert one(spark, X.slugify(F.col("t"), 10), t=("string", "Ünder -- Pressure! again")) == "nder-press"
    assert one(spark, X.title_topics(F.col("t")), t=("string", "A + B +  C + ")) == ["A", "B", "C"]
    assert one(spark, X.title_topics(F.col("t")), t=("string", "A+B")) == []
    assert one(spark, X.normalised(F.col("v")), v=("array<double>", [3.0, 4.0])) == [0.6, 0.8]
    assert one(spark, X.normalised(F.col("v")), v=("array<double>", [0.0, 0.0])) == [0.0, 0.0]
    assert one(spark, X.json_object(F.col("t"), "a int"), t=("string", 'so:\n```json\n{"a": 3}\n```')).a == 3


def test_validators(spark):
    ddl = "o string, s string, f array<string>, e map<string,array<string>>"
    good = ("one line", "sum", ["x"], {"people": ["A"]})
    bad = [(" ".join("w" * 31),) + good[1:], (None,) + good[1:], good[:2] + ([],) + good[3:], good[:2] + ([" "],) + good[3:], good[:3] + ({"p": [""]},), good[:3] + (None,)]
    df = spark.createDataFrame([good, *bad], ddl)
    got = [r.p for r in df.select(rules.enrichment_problems(F.col("o"), F.col("s"), F.col("f"), F.col("e")).alias("p")).collect()]
    assert got[0] == [] and all(len(p) == 1 for p in got[1:])
    topics = lambda t: one(spark, rules.topic_problems(F.col("t"), ["a", "b", "c", "d", "e"]), t=("array<string>", t))
    assert topics(["a", "b"]) == [] and topics([]) and topics(["a", "a"]) == ["a topic is repeated"] and topics(["z"]) == ["a topic is unknown"] and len(topics(list("abcde"))) == 1


def test_blurbs_and_grounding(spark):
    text = " ".join(f"alpha{chr(97 + i)} and" for i in range(20))
    p = lambda b, s: one(spark, rules.blurb_problems(F.col("b"), F.col("s"), ["This report"]), b=("string", b), s=("string", s))
    assert p(text, "others entirely") == [] and p(text, text) == ["repeats the summary"] and "under 30 words" in p("This report is short", "x")
    assert one(spark, rules.grounding(F.col("n"), F.col("b")), n=("array<string>", ["Ann", "Bob", "Cy"]), b=("string", "ann met BOB")) == 0.667


def test_affiliations(spark):
    def a(*v):
        df = spark.createDataFrame([v], "r boolean, t string, j string, p boolean, e boolean")
        x = df.select(rules.affiliation(F.col("r"), F.col("t"), F.col("j"), F.col("p"), F.col("e"), "ACME").alias("x")).first().x
        return x.affiliation, x.is_current

    assert a(True, None, "Analyst", True, False) == ("staff", True)
    assert a(True, "Senior Fellow", "Analyst", True, False) == ("affiliate", True)
    assert a(False, None, "Analyst", True, True) == ("external", False) and a(False, None, "Analyst", False, False) == ("external", False)
    assert a(False, None, None, True, False) == ("unknown", False)
    assert a(False, None, "Director, Some Org", True, False) == ("external", False) and a(False, None, "Analyst at ACME", True, False) == ("staff", False)


def test_words_end_at_all_white_space(spark):
    texts = ["a\u00a0b\u2003c\u2028d", "a\x1cb\x85c", "\u3000a  ", "\u200ba b", "", None, "a\x0bb\x0cc\r\nd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.w, r.s) for r in rows.select("i", X.word_count(F.col("t")).alias("n"), X.first_words(F.col("t"), 2).alias("w"), X.spaces_count(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (len((t or "").split()), None if t is None else " ".join(t.split()[:2]), t.count(" ") + 1 if t else 0)
