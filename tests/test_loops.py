"""Model loops with stub models, memberships, and the command line."""

import json
import re
import threading
import urllib.error
import urllib.request

import pytest

from lectern import cli, schema
from lectern.operators import documents as D
from lectern.operators import ingest as I
from lectern.operators import loops as L
from lectern.operators import search as S
from lectern.operators import vectors as R
from lectern.sources import snapshot

GOOD = json.dumps({"one_liner": "A line.", "summary": "S.", "key_findings": ["f"], "entities": {"people": ["Ann"]}})


def test_checks():
    assert L.summary_check(f"so: {GOOD} done") == []
    assert L.summary_check("no json") == ["no JSON object"]
    bad = json.dumps({"one_liner": "w " * 31, "summary": " ", "key_findings": [], "entities": {"p": [""]}})
    assert len(L.summary_check(bad)) == 4
    check = L.topics_check(["a", "b"])
    assert check('{"topics": ["a"]}') == [] and check('{"topics": ["a", "a"]}') and check('{"topics": ["z"]}') and check("{}")


def test_asks_again_and_keeps_rejects(spark):
    def chat(prompt):
        if prompt.startswith("crash"):
            raise TimeoutError("slow")
        if prompt.startswith("never") or "not valid" not in prompt and prompt.startswith("second"):
            return "nonsense", 10, 1
        return GOOD, 10, 2

    work = spark.createDataFrame([(1, "first"), (2, "second"), (3, "never"), (4, "crash")], "id long, prompt string")
    rows = {r.id: r for r in L.ask(work, chat, L.summary_check).collect()}
    assert (rows[1].attempts, rows[1].error) == (1, None) and (rows[2].attempts, rows[2].completion_tokens) == (2, 3)
    assert rows[3].attempts == 3 and rows[3].answer is None and rows[3].error == "no JSON object" and rows[3].prompt_tokens == 30
    assert rows[4].error == "TimeoutError: slow"
    made = L.summaries(L.ask(work, chat, L.summary_check), "m", "v1").collect()
    assert {r.publication_id for r in made} == {1, 2} and made[0].entities == {"people": ["Ann"]}


def test_backoff():
    calls, waits = [], []

    def chat(_):
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "x", 0, 0

    assert L.with_backoff(chat, sleep=waits.append)("p")[0] == "x" and waits == [5.0, 10.0]
    with pytest.raises(TimeoutError):
        L.with_backoff(lambda p: (_ for _ in ()).throw(TimeoutError()), tries=2, sleep=waits.append)("p")


def test_answers_cite_what_was_shown():
    seen = []
    chat = lambda p: (seen.append(p), "Yes [3, 9] and [4].")[1:] + (0, 0)
    text, good, bad = L.answer("q", [(3, "a [7] b"), (4, "c")], chat)
    assert (good, bad) == ([3, 4], [9]) and "[7]" not in seen[0]
    assert L.answer("q", [], None)[1:] == ([], [])


def test_worklists(spark):
    c = {
        "publications": spark.createDataFrame([(1, "Report", None, None), (2, "Report", "x", None), (3, "Podcast", None, None), (4, "Report", "x", None), (5, "Report", None, 4)], "id long, pub_type string, pdf_url string, parent_id long"),
        "publication_text": spark.createDataFrame([(1, 0), (5, 9), (2, 7000)], "publication_id long, word_count long"),
        "enrichments": spark.createDataFrame([(10, 2, True)], "id long, publication_id long, is_primary boolean"),
    }
    assert {r.id for r in L.to_look_at(c).collect()} == {1, 4}
    assert {r.publication_id for r in L.to_summarise(c).collect()} == {5}
    blurbs = spark.createDataFrame([(2, 9)], "publication_id long, source_enrichment_id long")
    assert L.to_describe(c, blurbs).count() == 0 and L.to_describe(c, blurbs, stale=True).count() == 1
    s = spark.createDataFrame([(1, 2, 3, "Executive Summary", "b", 200), (2, 2, 1, "Executive summary of x", "a", 160), (3, 5, 1, "Executive summary", "c", 200)], "id long, publication_id long, position int, heading string, body string, word_count int")
    assert [(r.publication_id, r.section_id) for r in L.copies_of_executive_summaries(c, s).collect()] == [(2, 2)]


def test_memberships_in_both_directions(spark):
    pubs = spark.createDataFrame([(1, "p1", "https://x/en/report/p1"), (2, "p2", "https://x/en/report/p2/")], "id long, slug string, url string")
    own = spark.createDataFrame([("p1", "/en/series/s?x=1"), ("p2", "/en/other")], "page_slug string, href string")
    every = spark.createDataFrame([("s", "/en/report/p2?utm=1"), ("s", "/en/none"), ("p1", "/en/report/p2")], "page_slug string, href string")
    cols = spark.createDataFrame([("col", "/en/series/s/")], "slug string, path string")
    assert {tuple(r) for r in D.memberships(own, every, cols, pubs).collect()} == {(1, "col"), (2, "col")}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("cat") / "c")
    c = schema.empty(spark)
    pubs = spark.createDataFrame([(1, "Tariff pressure", "Report"), (2, "Other", "Comment")], "id long, title string, pub_type string")
    have = set(pubs.columns)
    c["publications"] = pubs.selectExpr(*[f.name if f.name in have else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.struct("publications")])
    snapshot.save(c, where)
    return where


def test_commands(spark, folder, capsys):
    assert cli.main([folder, "search", "q=tariffs?"]) == 0
    assert json.loads(capsys.readouterr().out)["id"] == 1
    assert cli.main([folder, "search", "q=x AND", "strict=1"]) == 2
    assert cli.main([folder, "status"]) == 0 and '"publications"' in capsys.readouterr().out
    c = cli.Catalog(spark, folder)
    for name in set(cli.COMMANDS) - {"search", "find", "semantic", "publication", "coverage", "coverage-check"}:
        cli.rows(c, name)
    assert json.loads(cli.rows(c, "publication", ref="1")[0])["title"] == "Tariff pressure"
    hit = json.loads(cli.rows(c, "find", q="tariff", vector="[1.0, 0.0]")[0])
    assert (hit["id"], hit["rankers"], hit["shortlisted"]) == (1, "K", False)
    assert "keyword ranking only" in json.loads(cli.rows(c, "find", q="tariff")[0])["notes"]
    parts = [json.loads(x) for x in cli.rows(c, "coverage", q="tariff", vector="[1.0, 0.0]")]
    verdict = next(json.loads(x["row"]) for x in parts if x["part"] == "verdict")
    assert (verdict["mentions"], verdict["about"], verdict["verdict"]["band"]) == (1, 1, 2)
    assert any(x["part"] == "matches" and json.loads(x["row"])["n"] == 1 for x in map(json.loads, cli.rows(c, "coverage-check", q="tariff")))
    with pytest.raises(ValueError):
        cli.rows(c, "semantic", q="x")


def test_the_index_is_built_once_and_pruned_by_term(spark, folder):
    c = cli.Catalog(spark, folder)
    first = c.index()
    phrase = S.Phrase(("tariff",))
    plan = S._phrase_at(first, phrase, S._variants(first.words, [phrase]))._jdf.queryExecution().toString()
    assert "EqualTo(term,tariff)" in plan
    import os

    at = {f: os.stat(f).st_mtime_ns for f in first.postings.inputFiles() for f in [f.removeprefix("file://")]}
    assert at == {f: os.stat(f).st_mtime_ns for f in cli.Catalog(spark, folder).index().postings.inputFiles() for f in [f.removeprefix("file://")]}


def test_changes_make_versions(spark, tmp_path):
    where = str(tmp_path / "c")
    snapshot.save(schema.empty(spark), where)
    run = lambda *a: cli.main([where, *a])
    assert run("add-pdf", "url=https://x/a.pdf", "title=A") == 0 and run("add-pdf", "url=https://x/b.pdf", "title=B", "pub_type=Report") == 0
    assert run("add-pdf", "url=https://x/c.pdf") == 1 and run("add-pdf", "url=u", "title=t", "colour=red") == 1
    c = cli.Catalog(spark, where)
    assert {(r.id, r.slug, r.title, r.pdf_url, r.pub_type) for r in c["publications"].collect()} == {(1, "a", "A", "https://x/a.pdf", None), (2, "b", "B", "https://x/b.pdf", "Report")}
    assert run("attach-chapters", "parent=a", "chapters=https://x/b.pdf") == 0 and run("attach-chapters", "parent=b", "chapters=a") == 1
    assert run("mark", "ref=a", "note=why") == 0 and run("flag-summary", "ref=a", "note=x") == 1 and run("park", "ref=b") == 0
    c = cli.Catalog(spark, where)
    assert [(r.parent_id, r.parent_position) for r in c["publications"].orderBy("id").collect()] == [(None, None), (1, 1)]
    assert [(r.publication_id, r.note) for r in c["shortlist"].collect()] == [(1, "why")] and c["reviews"].first().verdict == "parked"
    assert run("unmark", "ref=1") == 0 and cli.Catalog(spark, where)["shortlist"].count() == 0
    assert run("publication", "ref=nothing") == 1


def test_served(spark, folder):
    s = cli.server(spark, folder, 0, "secret")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_address[1]}"
    get = lambda path, token="secret": urllib.request.urlopen(urllib.request.Request(at + path, headers={"Authorization": f"Bearer {token}"}))
    assert json.loads(get("/list?type=Report").read())[0]["title"] == "Tariff pressure"
    for path, token, code in (("/list", "wrong", 401), ("/nothing", "secret", 404), ("/list?bad=1", "secret", 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            get(path, token)
        assert e.value.code == code
    s.shutdown()


def test_a_task_stops_after_errors_in_a_row(spark):
    def chat(prompt):
        if prompt.startswith("bad"):
            raise OSError("down")
        return GOOD, 1, 1

    work = [(i, p) for i, p in enumerate(["bad", "ok", "bad", "bad", "bad", "ok", "ok"])]
    got = L.ask(spark.createDataFrame(work, "id long, prompt string").coalesce(1), chat, L.summary_check).collect()
    assert [r.id for r in got] == [0, 1, 2, 3, 4] and got[-1].error == "OSError: down"


def test_backoff_by_status():
    class Refused(Exception):
        def __init__(self, status, retry_after=None):
            self.status, self.retry_after = status, retry_after

    for status, want in ((503, [5.0, 10.0]), (429, [60.0, 120.0]), (402, [60.0, 120.0]), (401, None), (404, None)):
        waits, left = [], [2]

        def chat(_):
            left[0] -= 1
            if left[0] >= 0:
                raise Refused(status)
            return "x", 0, 0

        if want is None:
            with pytest.raises(Refused):
                L.with_backoff(chat, sleep=waits.append)("p")
            assert waits == []
        else:
            assert L.with_backoff(chat, sleep=waits.append)("p")[0] == "x" and waits == want


@pytest.fixture(scope="module")
def library(spark):
    c = schema.empty(spark)
    shaped = lambda name, rows, ddl: I._shaped(spark.createDataFrame(rows, ddl), c[name])
    out = dict(c)
    out["publications"] = shaped("publications", [(1, "Steel tariffs", "Report"), (2, "Rivers", "Comment"), (3, "Solar cells", "Report")], "id long, title string, pub_type string")
    out["enrichments"] = shaped("enrichments", [(1, 1, True, "On steel"), (2, 2, True, "On water"), (3, 3, True, "On light")], "id long, publication_id long, is_primary boolean, one_liner string")
    out["sections"] = shaped("sections", [(1, 1, "Steel", "steel tariffs bite"), (2, 2, "Water", "water flows")], "id long, publication_id long, heading string, body string")
    return out


def test_answers_rest_on_hybrid_retrieval(spark, library):
    index = S.Scan(library["publications"].select("id", "title"), ("title",))
    weights = S.PUBLICATION_WEIGHTS
    seen = []
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    got = L.answer_from(library, index, "tariffs", [(vectors, [1.0, 0.0])], lambda p: (seen.append(p), "So [1] and [9].")[1:] + (0, 0), 2)
    assert (got["cited"], got["invalid"], got["hits"][0]) == ([1], [9], 1) and "On steel" in seen[0] and "steel tariffs bite" in seen[0]
    none = L.answer_from(library, index, "zebra", [], None, 2)
    assert none["cited"] == [] and none["hits"] == [] and weights


def test_recall_of_rankers(spark, library):
    index = S.Scan(library["publications"].select("id", "title"), ("title",))
    vectors = {"one_liner": spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id long, vector array<double>")}
    shown = library["publications"].select("id", "title").join(library["enrichments"].selectExpr("publication_id AS id", "one_liner"), "id")
    cases = [("exact", "steel tariffs", [0.0, 1.0], "(?i)steel"), ("other words", "streams", [0.0, 1.0], "(?i)river")]
    got = {(r.ranker, r.k): r.recall for r in R.recall_by_ranker(cases, index, vectors, shown, (1.0,)).collect()}
    assert got[("keyword", 1)] == 0.5 and got[("one_liner", 1)] == 0.5 and got[("hybrid", 3)] == 1.0


def test_recall_searches_and_ranks_once(spark, library, monkeypatch):
    index = S.Index.build(library["publications"].select("id", "title"), ("title",))
    first, second = (spark.createDataFrame(rows, "id long, vector array<double>") for rows in ([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (1, [0.0, 1.0])], [(3, [0.7, 0.7]), (2, [0.1, 1.0])]))
    shown = library["publications"].select("id", "title").join(library["enrichments"].selectExpr("publication_id AS id", "one_liner"), "id")
    cases = [("a", "steel tariffs", [1.0, 0.1], "(?i)steel"), ("b", "solar OR rivers", [0.0, 1.0], "(?i)river"), ("c", "zebra", [0.5, 0.5], "light")]
    vectors, want = {"one_liner": first, "section": second}, {}
    for ranker in ("keyword", *vectors, "hybrid"):
        for k in (1, 2):
            hit = []
            for _, q, v, pattern in cases:
                if ranker == "hybrid":
                    rows = R.hybrid(index, q, [(x, v) for x in vectors.values()], 2, None, (1.0,))[0]
                else:
                    rows = S.search(index, q, (1.0,), 20) if ranker == "keyword" else R.rank(vectors[ranker], v, 20)
                ids = [r.id for r in rows.where(f"position <= {k}").collect()]
                hit.append(any(re.search(pattern, f"{r.title}\n{r.one_liner}") for r in shown.collect() if r.id in ids))
            want[ranker, k] = sum(hit) / len(hit)
    searched = []
    monkeypatch.setattr(R.S, "match", lambda *a, plain=S.match: (searched.append(a[1]), plain(*a))[1])
    got = {(r.ranker, r.k): r.recall for r in R.recall_by_ranker(cases, index, vectors, shown, (1.0,), (1, 2)).collect()}
    assert got == pytest.approx(want) and len(searched) == len(cases)


def test_pages_are_ingested_whole(spark):
    from test_records import M as MARKUP
    from test_records import PAGE

    c = schema.empty(spark)
    urls = [("https://x.org/a", "root-level", "pending", "ingest", 9), ("https://x.org/b", "root-level", "pending", None, 5)]
    c["sitemap_urls"] = I._shaped(spark.createDataFrame(urls, "url string, scope string, status string, disposition string, probe_words int"), c["sitemap_urls"])
    bare = "<article><h1>T</h1><div class='view-mode-full'>" + " ".join(f"<p>{'word ' * 30}</p>" for _ in range(2)) + "</div></article>"
    pages = spark.createDataFrame(
        [("https://x.org/a", "https://x.org/a/", PAGE, "Memo", "S", "by hand"), ("https://x.org/b", None, bare, "Note", None, None), ("https://x.org/c", "https://x.org/z", PAGE, "Memo", None, None), ("https://x.org/d", None, "<p>x", None, None, None)],
        "url string, final_url string, html string, pub_type string, series string, note string",
    )
    out, refused = I.ingest(c, pages, MARKUP, "2024-01-01")
    assert {tuple(r) for r in refused.collect()} == {("https://x.org/c", "redirects to https://x.org/z"), ("https://x.org/d", "no main article")}
    assert {(r.url, r.title, r.pub_type, r.series) for r in out["publications"].collect()} == {("https://x.org/a", "A title", "Memo", "S"), ("https://x.org/b", "T", "Note", None)}
    assert out["people"].count() == 4 and out["credits"].count() == 4 and out["site_tags"].count() == 2
    assert {(r.url, r.status, r.disposition, r.note) for r in out["sitemap_urls"].collect()} == {("https://x.org/a", "done", "ingest", "by hand"), ("https://x.org/b", "done", "ingest", None)}
    texts = {r.publication_id: r.word_count for r in out["publication_text"].collect()}
    b = I.find_publication(out["publications"], "https://x.org/b")
    assert texts[b] >= 60 and out["sections"].where(f"publication_id = {b}").count() == 1 and I.waiting(out["sitemap_urls"]).count() == 0
    again, _ = I.ingest(out, pages, MARKUP, "2024-01-02")
    assert all(again[k].count() == out[k].count() for k in ("publications", "people", "credits", "sections", "publication_text"))
    with pytest.raises(ValueError):
        I.find_publication(out["publications"], "nothing")


def test_prompts(spark):
    from pyspark.sql import functions as F

    from lectern.functions import rules

    row = spark.createDataFrame([("T", None, "Report", "2024-01-01", "line", "sum", ["f1", "f2"])], "t string, s string, k string, d string, o string, y string, f array<string>")
    args = [F.col(x) for x in ("t", "s", "k", "d", "o", "y", "f")]
    text = row.select(rules.topics_prompt(*args, [("a", "A"), ("b", "B")])).first()[0]
    assert "- a: A\n- b: B" in text and "Title: T\nType: Report\nDate: 2024-01-01" in text and "Key findings:\n- f1\n- f2" in text and "Subtitle" not in text
    assert "One-liner: line" in row.select(rules.blurb_prompt(*(args[:1] + args[2:]))).first()[0]
    assert "these 3 pictures" in row.select(rules.vision_prompt(F.col("t"), F.col("k"), F.lit(3))).first()[0]
