"""Rules of the views on small hand-made catalogs."""

import datetime

import pytest

from lectern.operators import vectors as R
from lectern.operators import views as V


@pytest.fixture(scope="module")
def c(spark):
    d = datetime.date
    pubs = [(1, "Report", d(2024, 1, 5), None), (2, "Comment", d(2024, 12, 1), None), (3, "Podcast", d(2024, 3, 1), None), (4, "Report", d(2024, 2, 1), 1), (5, "Report", None, None)]
    return {
        "publications": spark.createDataFrame([(i, f"t{i}", k, w, p, "public") for i, k, w, p in pubs], "id long, title string, pub_type string, date_published date, parent_id long, access string"),
        "publication_topics": spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 2), (2, "b", 1), (3, "a", 1), (3, "b", 2), (4, "a", 1), (5, "gone", 1)], "publication_id long, topic_slug string, position int"),
        "topics": spark.createDataFrame([("a", "A", 0), ("b", "B", 0), ("c", "C", 1)], "slug string, label string, cluster int"),
        "publication_text": spark.createDataFrame([(1, 100, "html"), (2, 7, "pdf")], "publication_id long, word_count long, source string"),
        "credits": spark.createDataFrame([(1, 10, "author", 0), (1, 10, "guest", 1), (2, 10, "host", 0), (2, 11, "author", 0), (4, 10, "author", 0)], "publication_id long, person_id long, role string, position int"),
        "people": spark.createDataFrame([(10, "Ann", "staff", True, None), (11, "Bob", "staff", False, None), (12, "Ann", "staff", True, 10)], "id long, name string, affiliation string, is_current boolean, merged_into long"),
    }


def test_graph_scope_floor_and_positions(c):
    nodes = {x.slug: (x.pubs, x.weighted, x.about) for x in V.topic_graph_nodes(c).collect()}
    assert nodes == {"a": (2, 9, 1), "b": (2, 9, 1), "c": (1, 8, 0)}
    assert [(x.s1, x.s2, x.n) for x in V.topic_graph_edges(c).collect()] == [("a", "b", 2)]


def test_time_fills_gaps(c):
    rows = [(x.slug, x.quarter, x.w, x.words, x.n) for x in V.topic_time(c).orderBy("slug", "quarter").collect()]
    assert rows == [("a", f"2024-Q{q}", 8 * (q == 1), 100 * (q == 1), int(q == 1)) for q in range(1, 5)] + [("b", f"2024-Q{q}", int(q == 4), 7 * (q == 4), int(q == 4)) for q in range(1, 5)]


def test_chapters_count_as_their_parents(c):
    hits = c["publications"].where("id IN (1, 4)").select("id")
    assert V.with_roots(c, hits).count() == 1
    assert [(x.pub_type, x.n, x.weighted) for x in V.tier(c, hits).collect()] == [("Report", 1, 8)]


def test_credits_and_matrix(c):
    got = {x.id: (x.n, x.hosted) for x in V.people_credits(c).collect()}
    assert got == {10: (3, 1), 11: (1, 0)}
    cells = V.who_knows_what(c).collect()
    assert [(x.id, x.topic, x.n, x.credits_total, x.mapped_total) for x in cells] == [(10, "a", 2, 3, 2)]


def test_upper_median_and_least_texts(spark, c):
    p = spark.createDataFrame([(i, "Report") for i in range(6)] + [(10 + i, "Comment") for i in range(4)], "id long, pub_type string")
    t = spark.createDataFrame([(i, w) for i, w in enumerate([1, 2, 30, 40, 50, 60])] + [(10 + i, 5) for i in range(4)], "publication_id long, word_count long")
    got = [tuple(x) for x in V.type_length_norms({"publications": p, "publication_text": t}).collect()]
    assert got == [("Report", 40, 10)]


def test_length_bands_hold_one_text_each(spark):
    t = spark.createDataFrame([(i, i) for i in range(100)], "publication_id long, word_count long")
    got = sorted((x.band, x.word_count) for x in V.length_bands({"publication_text": t}).collect())
    assert [b for b, _ in got] == list(range(5)) and all(20 * b - 1 <= w <= 20 * b + 21 for b, w in got)


@pytest.mark.parametrize("about,mentions,sim,only,band", [(14, 296, 0.0, False, 4), (0, 194, 0.0, False, 4), (3, 68, 0.0, False, 3), (0, 61, 0.0, False, 2), (0, 1, 0.0, False, 2), (0, 0, 0.45, False, 1), (0, 0, 0.2, False, 0), (0, 0, 0.0, True, None), (2, 30, 0.0, True, 3)])
def test_verdict_bands(spark, about, mentions, sim, only, band):
    df = spark.createDataFrame([(about, mentions, sim, only)], "a int, m int, s double, k boolean")
    v = df.select(R.verdict(df.a, df.m, df.s, df.k).alias("v")).first().v
    assert v.band == band and (v.pos is None) == (band is None)
    if band is not None:
        assert band / 5 <= v.pos <= (band + 1) / 5


def test_fusion_ties_go_to_the_first_ranker(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, position int")
    b = spark.createDataFrame([(3, 1), (2, 2)], "id long, position int")
    from pyspark.sql import functions as F

    rows = R.fuse([a, b]).orderBy(F.desc("score"), "first.ranker", "first.position").collect()
    assert [(x.id, x.rankers) for x in rows] == [(2, "KV1"), (1, "K"), (3, "V1")]


def test_vectors_are_ranked_by_their_best(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.9, 0.1])], "id long, vector array<double>")
    assert [(x.id, round(x.similarity, 3)) for x in R.rank(v, [0.0, 1.0], 5).orderBy("position").collect()] == [(1, 1.0), (2, 0.1)]


def test_recall_and_typeahead(spark):
    hits = spark.createDataFrame([("q", 1, "x", "y"), ("q", 2, "Chips", None), ("r", 1, None, None)], "case string, position int, title string, one_liner string")
    cases = spark.createDataFrame([("q", "(?i)chip"), ("r", "z"), ("s", "z")], "case string, pattern string")
    assert R.recall(hits, cases, 1).first().recall == 0 and abs(R.recall(hits, cases, 2).first().recall - 1 / 3) < 1e-9
    people = spark.createDataFrame([(1, "Max Anders", True), (2, "Anna", False), (3, "Joanna", True), (4, "Andy", True)], "id long, name string, is_current boolean")
    assert [x.id for x in V.typeahead(people, "an").collect()] == [4, 2, 1, 3]


def test_types_are_the_catalogs_own(spark):
    c = {
        "publications": spark.createDataFrame([(1, "Big", None), (2, "Big", None), (3, "Talk", None)], "id long, pub_type string, parent_id long"),
        "types": V.Types({"Big": 7}, ("Talk",), ()),
    }
    hits = c["publications"].select("id")
    assert {(r.pub_type, r.n, r.weighted) for r in V.tier(c, hits).collect()} == {("Big", 2, 14), ("Talk", 1, 1)}
    assert V.insight_scope(c).count() == 2
    del c["types"]
    assert {(r.pub_type, r.weighted) for r in V.tier(c, hits).collect()} == {("Big", 2), ("Talk", 1)}


def test_years_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "1997-12-31"), (2, "1998-01-01"), (3, "1999-06-01")], "id long, d string").selectExpr("id", "CAST(d AS DATE) AS date_published", "CAST(NULL AS LONG) AS parent_id").write.parquet(f"{tmp_path}/p")
    pubs = V.list_publications({"publications": spark.read.parquet(f"{tmp_path}/p")}, year=[1998, 1999])
    assert {r.id for r in pubs.collect()} == {2, 3}
    assert "GreaterThanOrEqual(date_published,1998-01-01)" in pubs._jdf.queryExecution().executedPlan().toString()


def spread_in(df, n):
    """The final plan shuffles into n partitions that AQE leaves alone."""
    return f", {n}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_backlog_is_spread_by_its_records(c, monkeypatch):
    monkeypatch.setattr(V.storage, "SPREAD_ROWS", 0.5)
    pubs = c["publications"].selectExpr("*", "CAST(NULL AS STRING) AS pdf_url").replace({"public": "member"}, subset="access")
    rows = V.backlog({**c, "publications": pubs}, pubs.where("id >= 4").select("id").union(pubs.select("id").where("id = 4")))
    assert spread_in(rows, 10) and sorted((r.kind, r.id) for r in rows.collect()) == [("paywalled", 3)]

def test_graph_nodes_are_spread_by_publication(c, monkeypatch):
    monkeypatch.setattr(V.storage, "SPREAD_ROWS", 0.5)
    nodes = V.topic_graph_nodes(c)
    assert spread_in(nodes, 10) and nodes.count() == 3
