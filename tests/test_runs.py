"""Composed runs: worklist, loop and one commit; a crawl that resumes."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import cli, schema
from lectern.operators import loops as L
from lectern.operators import runs
from lectern.operators import state as M
from lectern.sources import snapshot
from lectern.sources.readers import hashed_embedding

NOW = "2026-01-02 03:04:05"


def table(spark, name, rows, columns):
    df = spark.createDataFrame(rows, columns)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.struct(name)])


def summary(line="A line.", topics=("t1",)):
    return json.dumps({"one_liner": line, "summary": "S.", "key_findings": ["f"], "entities": {"people": ["Ann"]}, "topics": list(topics), "blurb": "word " * 40})


def stub():
    """A model; a closure, since tasks can't import this module."""
    good = summary()
    return lambda prompt: ("nonsense" if "never" in prompt else good, 10, 2)


@pytest.fixture
def catalog(spark):
    c = schema.empty(spark)
    c["publications"] = table(spark, "publications", [(i, f"p{i}", f"https://x/en/report/p{i}", t, "Report") for i, t in enumerate(["One", "Two", "never", "Four"], 1)], "id long, slug string, url string, title string, pub_type string")
    c["publication_text"] = table(spark, "publication_text", [(1, "text", 5), (2, "text", 5), (3, "text", 5), (4, "", 0)], "publication_id long, body string, word_count long")
    c["enrichments"] = table(spark, "enrichments", [(7, 2, True, "old line", "old", "m0"), (8, 2, False, "other", "o", "m0"), (9, 4, True, "by hand", "h", "manual")], "id long, publication_id long, is_primary boolean, one_liner string, summary string, model string")
    c["embeddings"] = table(spark, "embeddings", [("one_liner", 7, 2, "v"), ("one_liner", 9, 4, "v"), ("section", 50, 2, "v")], "source_type string, source_id long, publication_id long, model string")
    c["publication_topics"] = table(spark, "publication_topics", [(2, "t1", 1), (4, "t2", 1)], "publication_id long, topic_slug string, position int")
    c["reviews"] = table(spark, "reviews", [(1, "enrichment", 7, "flagged")], "id long, scope string, subject_id long, verdict string")
    return c


def made(spark, *rows):
    return spark.createDataFrame([(i, line, "s", "m1", "v1") for i, line in rows], "publication_id long, one_liner string, summary string, model string, prompt_version string")


def lines(df):
    return sorted((r.id, r.publication_id, r.is_primary, r.one_liner) for r in df.collect())


def test_guarded_upserts(spark, catalog):
    new = made(spark, (1, "first"), (2, "again"), (4, "over a hand"), (3, "a"), (3, "b"))
    tables, refused = runs.summarised(catalog, new, NOW)
    assert lines(tables["enrichments"]) == [(7, 2, True, "again"), (8, 2, False, "other"), (9, 4, True, "by hand"), (10, 1, True, "first")]
    assert sorted((r.publication_id, r.id, r.problem) for r in refused.collect()) == [(3, None, "several for one publication"), (4, 9, "a summary written by hand")]
    assert {(r.source_type, r.publication_id) for r in tables["embeddings"].collect()} == {("one_liner", 4), ("section", 2)}
    assert {r.publication_id for r in tables["publication_topics"].collect()} == {4}
    assert not M.primary_violations(tables["enrichments"]).count()
    twice = catalog["enrichments"].withColumn("is_primary", F.lit(True))
    assert [r.problem for r in M.upsert_primary(twice, made(spark, (2, "x")), NOW)[1].collect()] == ["several primary summaries"]


def test_candidates_then_promotion(spark, catalog):
    tables, _ = runs.regenerated(catalog, made(spark, (1, "a"), (1, "b"), (2, "c")), NOW)
    rows = lines(tables["enrichments"])
    assert [r[1:] for r in rows if r[0] > 9] == [(1, True, rows[-3][3]), (1, False, rows[-2][3]), (2, False, "c")] and {rows[-3][3], rows[-2][3]} == {"a", "b"}
    c = catalog | tables
    asked = spark.createDataFrame([(2, rows[-1][0]), (4, 8), (1, 99), (4, 9)], "publication_id long, id long")
    after, refused = runs.promoted(c, asked)
    assert sorted((r.publication_id, r.id, r.problem) for r in refused.collect()) == [(1, 99, "no such summary"), (4, 8, "of another publication"), (4, 9, "several for one publication")]
    assert {r.id for r in after["enrichments"].where("publication_id = 2 AND is_primary").collect()} == {rows[-1][0]}
    assert {(r.source_type, r.publication_id) for r in after["embeddings"].collect()} == {("one_liner", 4), ("section", 2)}
    assert {r.publication_id for r in after["publication_topics"].collect()} == {4}
    same, none = runs.promoted(catalog, spark.createDataFrame([(2, 7)], "publication_id long, id long"))
    assert none.count() == 0 and same["embeddings"].count() == 3 and lines(same["enrichments"]) == lines(catalog["enrichments"])


def test_runs_commit_whole_versions_or_none(spark, catalog, tmp_path, monkeypatch):
    where = str(tmp_path / "c")
    snapshot.save(catalog | {"settings": spark.createDataFrame([("vocabulary", '{"t1": "T one", "t2": "T two"}')], "key string, value string")}, where)
    monkeypatch.setattr(cli, "CHAT", stub())
    monkeypatch.setattr(cli, "VECTORS", hashed_embedding)
    c = cli.Catalog(spark, where)
    with pytest.raises(ValueError):
        monkeypatch.setattr(cli, "CHAT", None)
        cli.change(c, "enrich")
    monkeypatch.setattr(cli, "CHAT", stub())
    assert cli.change(c, "enrich") == 2 and [json.loads(x)["problem"] for x in c.refused] == ["no JSON object"]
    c = cli.Catalog(spark, where)
    assert {r.publication_id for r in L.to_summarise(c).collect()} == {3}

    cli.change(c, "regenerate", ref="2")
    c = cli.Catalog(spark, where)
    new = c["enrichments"].where("publication_id = 2").agg(F.max("id")).first()[0]
    # the second of the tables that a promotion changes can't be written
    real, count = snapshot._fs, []

    def failing(session, path):
        count.append(path)
        if path.endswith("_WHOLE"):
            raise OSError("disk full")
        return real(session, path)

    monkeypatch.setattr(snapshot, "_fs", failing)
    with pytest.raises(OSError):
        cli.change(c, "promote", ref="2", id=str(new))
    monkeypatch.setattr(snapshot, "_fs", real)
    after = cli.Catalog(spark, where)
    assert after.version == c.version and {r.id for r in after["enrichments"].where("publication_id = 2 AND is_primary").collect()} == {7}
    assert after["publication_topics"].where("publication_id = 2").count() == 1
    cli.change(after, "promote", ref="2", id=str(new))
    c = cli.Catalog(spark, where)
    assert {r.id for r in c["enrichments"].where("publication_id = 2 AND is_primary").collect()} == {new} and c["publication_topics"].where("publication_id = 2").count() == 0

    cli.change(c, "map-topics")
    c = cli.Catalog(spark, where)
    assert sorted((r.publication_id, r.topic_slug) for r in c["publication_topics"].collect()) == [(1, "t1"), (2, "t1"), (4, "t2")]
    cli.change(c, "blurbs")
    c = cli.Catalog(spark, where)
    assert {r.publication_id: r.source_enrichment_id for r in c["blurbs"].collect()} == {1: 10, 2: new, 4: 9}
    cli.change(c, "embed")
    c = cli.Catalog(spark, where)
    assert {(r.source_type, r.publication_id) for r in c["embeddings"].where("model = 'vectors'").collect()} == {("one_liner", 1), ("one_liner", 2), ("one_liner", 4)}
    cli.change(c, "map")
    assert {(r.publication_id, r.placed) for r in cli.Catalog(spark, where)["landscape_coords"].collect()} == {(i, "fit") for i in (1, 2, 4)}


def test_a_spent_quota_ends_a_run(spark):
    class Spent(Exception):
        status = 429

    good = summary()

    def poor(prompt):
        if prompt == "2":
            raise Spent("no more")
        return good, 1, 1

    work = spark.createDataFrame([(i, str(i)) for i in range(1, 5)], "id long, prompt string").coalesce(1)
    asked = L.ask(work, L.with_backoff(poor, end_on_quota=True), L.summary_check)
    assert [r.id for r in asked.collect()] == [1]  # 2 to 4 stay on the worklist


PAGE = """<html><head><meta property="og:title" content="T"></head><body><article><div class="view-mode-full"><h1>Title {n}</h1>
<div class="field-name-field-publication-type"><span class="taxonomy-term">Report</span></div>{date}
<div class="field-name-field-subtitle">Monitor no 3</div><div class="field-name-field-content"><p>{words}</p></div>
<article><div class="field-name-field-date-published">2020</div></article></div></article></body></html>"""
DATE = '<div class="field-name-field-date-published"><time datetime="2025-03-01">1 March</time></div>'


def page(n, words=300, date=DATE):
    return PAGE.format(n=n, words="w " * words, date=date)


def test_a_killed_crawl_resumes_without_a_second_fetch(spark, tmp_path, monkeypatch):
    where, log = str(tmp_path / "c"), tmp_path / "log"
    log.mkdir()
    urls = [f"https://x/en/report/u{i}" for i in range(7)]
    c = schema.empty(spark)
    c["sitemap_urls"] = table(spark, "sitemap_urls", [(u, "publication", "failed" if u.endswith("6") else "pending", "2025") for u in urls] + [("https://x/en/about", "root-level", "pending", None)], "url string, scope string, status string, lastmod string")
    snapshot.save(c, where)

    class Http(Exception):
        def __init__(self, code):
            super().__init__(f"HTTP {code}")
            self.code = code

    whole = [page(n) for n in range(7)]

    def fetch(url):
        n = int(url[-1])
        with open(log / f"u{n}", "a") as f:
            f.write("x")
        if n == 1:
            raise Http(410)
        if n == 2:
            raise TimeoutError("slow")
        if n == 3:
            return 200, "https://x/en/report", whole[n]
        if n == 4:
            return 200, url, "<p>no record</p>"
        return 200, url, whole[n]

    real, calls = runs.taken_in, []

    def killed(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(runs, "taken_in", killed)
    with pytest.raises(KeyboardInterrupt):
        runs.scrape(spark, where, fetch, NOW, batch=3)
    assert {r.url[-1]: r.status for r in snapshot.load(spark, where)["sitemap_urls"].where("scope = 'publication'").collect()} == {"0": "done", "1": "gone", "2": "failed", "3": "pending", "4": "pending", "5": "pending", "6": "failed"}
    # the second run takes in what the first one fetched, and tries what failed again
    out = runs.scrape(spark, where, fetch, NOW, batch=3)
    assert {r.status: r.n for r in out.collect()} == {"gone": 1, "skipped": 1, "done": 2, "failed": 1}
    assert {n: len((log / f"u{n}").read_text()) for n in range(7)} == {0: 1, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    c = snapshot.load(spark, where)
    state = {r.url[-1]: (r.status, r.last_error) for r in c["sitemap_urls"].where("scope = 'publication'").collect()}
    assert state == {"0": ("done", None), "1": ("gone", "Http: HTTP 410"), "2": ("failed", "TimeoutError: slow"), "3": ("gone", "redirected to https://x/en/report"), "4": ("skipped", "no main article"), "5": ("done", None), "6": ("done", None)}
    assert sorted(r.title for r in c["publications"].collect()) == ["Title 0", "Title 5", "Title 6"]
    assert {r.sitemap_lastmod for r in c["publications"].collect()} == {"2025"}
    assert runs.scrape(spark, where, fetch, NOW, batch=3, limit=1).collect()[0].status == "failed" and len((log / "u2").read_text()) == 3


def test_probes_of_root_pages(spark):
    urls = table(
        spark, "sitemap_urls",
        [("https://x/en/a", "root-level", "pending", None, None), ("https://x/en/b", "root-level", "pending", None, None), ("https://x/en/c", "root-level", "pending", None, None), ("https://x/en/d", "root-level", "pending", None, 5), ("https://x/en/e", "publication", "pending", None, None), ("https://x/en/f", "root-level", "pending", "ingest", None)],
        "url string, scope string, status string, disposition string, probe_words int",
    )
    urls = urls.withColumn("settled_at", F.when(F.col("url").endswith("f"), F.lit(NOW).cast("timestamp")))
    pages = spark.createDataFrame([("https://x/en/a", page("a")), ("https://x/en/b", page("b", 20)), ("https://x/en/c", page("c", date="")), ("https://x/en/d", page("d")), ("https://x/en/e", page("e")), ("https://x/en/f", None)], "url string, html string")
    got = {r.url[-1]: r for r in runs.classified(urls, pages, runs=[("monitor", "Tracker", "Monitor")]).collect()}
    assert len(got) == 6
    assert {k: (r.probe_title, r.probe_has_date, r.probe_words, r.disposition) for k, r in got.items()} == {
        "a": ("Title a", True, 300, "ingest"), "b": ("Title b", True, 20, "exclude"), "c": ("Title c", False, 300, "exclude"),
        "d": (None, None, 5, None), "e": (None, None, None, None), "f": (None, False, 0, "ingest"),
    }
    assert (got["a"].proposed_type, got["a"].proposed_series, got["a"].probe_subtitle) == ("Tracker", "Monitor", "Monitor no 3")
    again = {r.url[-1]: r for r in runs.classified(urls, pages, again=True).collect()}
    assert again["d"].probe_words == 300 and again["d"].disposition == "ingest"


def test_chapters_are_taken_in_and_attached(spark, catalog):
    catalog["publications"] = catalog["publications"].withColumn("pub_type", F.when(F.col("id") == 1, "Tracker").otherwise(F.col("pub_type")))
    text = page("new", date=DATE)

    def fetch(url):
        if url.endswith("missing"):
            raise OSError("no route")
        return 200, url, text if url.endswith("new") else "<p>nothing</p>"

    refs = ["2", "https://x/en/report/new", "nowhere", "https://x/en/report/missing", "https://x/en/report/empty", "p3", "1", "https://x/en/report/p4/?a=1"]
    tables, refused, counts = runs.chaptered(catalog, 1, refs, fetch, NOW, start=3)
    rows = {r.id: (r.title, r.pub_type, r.parent_id, r.parent_position) for r in tables["publications"].collect()}
    assert rows == {1: ("One", "Tracker", None, None), 2: ("Two", "Report", 1, 3), 3: ("never", "Report", 1, 8), 4: ("Four", "Report", 1, 10), 5: ("Title new", "Tracker", 1, 4)}
    problems = {r.ref.rsplit("/", 1)[-1]: r.problem for r in refused.collect()}
    assert problems == {"nowhere": "neither in the catalog nor an address", "missing": "OSError: no route", "empty": "no main article", "1": "itself"}
    assert counts == {"already": 4, "ingested": 1, "failed": 4, "attached": 4}
    assert tables["sections"].count() >= 0 and tables["publication_text"].where("publication_id = 5").count() == 1


def test_a_sitemap_gives_scopes(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x/en/report/n</loc><lastmod>2</lastmod></url><url><loc>https://x/en/about</loc></url><url><loc>https://y/en/z/q</loc></url></urlset>")
    from lectern.sources import readers

    c = {"sitemap_urls": table(spark, "sitemap_urls", [("https://x/en/report/n", "publication", "done", "1", "report")], "url string, scope string, status string, lastmod string, path_prefix string")}
    rows = runs.synced(c, readers.sitemap(spark, str(tmp_path / "s.xml")), NOW, ["x"], ["report"])["sitemap_urls"].collect()
    assert {r.url: (r.scope, r.status) for r in rows} == {"https://x/en/report/n": ("publication", "pending"), "https://x/en/about": ("root-level", "pending"), "https://y/en/z/q": ("excluded", "pending")}


def test_words_joined_by_other_spaces_count(spark, catalog):
    hand = spark.createDataFrame([(1, " ".join(["w"] * 40), "s"), (2, "short", "s")], "publication_id long, one_liner string, summary string")
    assert {r.publication_id for r in M.written_summaries(catalog["enrichments"], hand, NOW).where("model = 'manual' AND id > 9").collect()} == {2}
