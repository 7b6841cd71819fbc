"""State transforms: precedence, and that repeating them changes nothing."""

import datetime

import pytest

from lectern.operators import state as M
from lectern.sources import snapshot


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


URL = "url string, lastmod string, status string, first_seen string, last_seen string"


def test_crawl_state(spark):
    old = spark.createDataFrame([("a", "1", "done", "x", "x"), ("b", "1", "gone", "x", "x"), ("c", "1", "done", "x", "x"), ("d", None, "failed", "x", "x")], URL)
    seen = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "1"), ("e", None)], "url string, lastmod string")
    new = M.upsert_urls(old, seen, "now")
    got = {r.url: (r.lastmod, r.status, r.first_seen, r.last_seen) for r in new.collect()}
    assert got == {"a": ("2", "pending", "x", "now"), "b": ("2", "gone", "x", "now"), "c": ("1", "done", "x", "now"), "d": (None, "failed", "x", "x"), "e": (None, "pending", "now", "now")}
    assert table(M.upsert_urls(new, seen, "now")) == table(new)
    assert [r.url for r in M.pending_urls(new).collect()] == ["a", "d", "e"]


def test_text_precedence(spark):
    ddl = "publication_id long, body string, word_count long, source string"
    old = spark.createDataFrame([(1, "m", 5, "manual"), (2, "p", 50, "pdf"), (3, "p", 5, "pdf"), (4, "h", 5, "html")], ddl)
    new = spark.createDataFrame([(1, "h", 90, "html"), (2, "h", 50, "html"), (3, "h", 6, "html"), (4, "h2", 2, "html"), (5, "h", 1, "html")], ddl)
    out = M.upsert_text(old, new)
    assert [(r.publication_id, r.body) for r in out.orderBy("publication_id").collect()] == [(1, "m"), (2, "p"), (3, "h"), (4, "h2"), (5, "h")]
    assert table(M.upsert_text(out, new)) == table(out)


def test_manual_credits_survive(spark):
    ddl = "publication_id long, person_id long, role string, source string"
    old = spark.createDataFrame([(1, 1, "author", "parsed"), (1, 2, "author", "manual"), (2, 1, "host", "parsed")], ddl)
    new = spark.createDataFrame([(1, 3, "author", "parsed"), (1, 2, "author", "parsed")], ddl)
    out = M.replace_parsed(old, new, "publication_id", ["publication_id", "person_id", "role"])
    assert table(out) == [(1, 2, "author", "manual"), (1, 3, "author", "parsed"), (2, 1, "host", "parsed")]


def test_merges_follow_chains(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, None)], "id long, merged_into long")
    got = {r.id: r.survivor for r in M.resolve_merged(people).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
    credits = spark.createDataFrame([(9, 5, "author", 3), (9, 1, "author", 1), (9, 6, "host", 0)], "publication_id long, person_id long, role string, position int")
    once = M.merge_credits(credits, M.resolve_merged(people))
    assert table(once) == [(9, 1, "author", 1), (9, 6, "host", 0)]
    assert table(M.merge_credits(once, M.resolve_merged(people))) == table(once)
    assert M.merge_problem(people, 1, 1) and M.merge_problem(people, 2, 6) and M.merge_problem(people, 6, 2) and M.merge_problem(people, 6, 77)
    assert M.merge_problem(people, 6, 1) is None


def test_pdf_decisions_in_order(spark):
    ddl = "id long, stored_source string, stored_words long, foreign_host boolean, n_sharing long, found boolean, pdf_words long, type_median double"
    rows = [(1, "manual", 5, True, 9, False, 9, 1.0), (2, "html", 5, True, 9, False, 9, 1.0), (3, "html", 5, False, 2, False, 9, 1.0), (4, "html", 5, False, 1, False, 9, 1.0), (5, "html", 5, False, 1, True, 9, 1.0), (6, "html", 9, False, 1, True, 9, 9.0), (7, "pdf", 9, False, 1, True, 9, 9.0), (8, None, None, False, 1, True, 9, 9.0)]
    got = {r.id: r.reason for r in M.pdf_decisions(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {1: "manual", 2: "foreign host", 3: "shared", 4: "missing", 5: "outsized", 6: "not longer", 7: None, 8: None}


def test_primary_summaries(spark):
    e = spark.createDataFrame([(1, 10, True), (2, 10, False), (3, 11, True)], "id long, publication_id long, is_primary boolean")
    out = M.promote(e, spark.createDataFrame([(2,)], "id long"))
    assert table(out) == [(1, 10, False), (2, 10, True), (3, 11, True)]
    assert M.primary_violations(out).count() == 0
    blurbs = spark.createDataFrame([(10, 1), (11, 3), (12, None)], "publication_id long, source_enrichment_id long")
    assert [r.publication_id for r in M.stale_blurbs(blurbs, out).collect()] == [10]


def test_summaries_by_hand(spark):
    e = spark.createDataFrame([(1, 10, True, "a", "b", "m", None, ["f"]), (2, 11, True, "c", "d", "m", None, ["g"])], "id long, publication_id long, is_primary boolean, one_liner string, summary string, model string, enriched_at timestamp, key_findings array<string>")
    w = spark.createDataFrame([(10, "new", "text"), (11, "w " * 31, "x")], "publication_id long, one_liner string, summary string")
    out = M.written_summaries(e, w, "2024-01-01")
    rows = {(r.id, r.is_primary, r.one_liner, r.model, tuple(r.key_findings)) for r in out.collect()}
    assert rows == {(1, False, "a", "m", ("f",)), (2, True, "c", "m", ("g",)), (3, True, "new", "manual", ("f",))}


def test_notes(spark):
    d = datetime.date
    rows = [(1, "2024-Q2", d(2024, 1, 1), d(2024, 5, 1), None), (2, "2024-Q1", d(2024, 1, 1), d(2024, 5, 1), None), (3, "2023-Q1", d(2024, 1, 1), None, None), (4, None, d(2024, 1, 1), None, None), (5, "2024-Q1", d(2024, 1, 1), None, d(2024, 2, 1))]
    notes = M.note_status(spark.createDataFrame(rows, "id long, expected string, created_at date, landed_at date, shelved_at date"), "2024-06-01")
    got = {r.id: (r.status, r.on_time) for r in notes.collect()}
    assert got == {1: ("landed", True), 2: ("landed", False), 3: ("overdue", None), 4: ("open", None), 5: ("shelved", None)}
    assert M.note_stats(notes).first().median_lead is None
    assert M.note_stats(notes, 2).first().median_lead == 121


def test_small_transforms(spark):
    cur = spark.createDataFrame([(1, "n", "t0")], "publication_id long, note string, added_at string")
    marks = spark.createDataFrame([(1, "m", "t1"), (2, "x", "t1")], "publication_id long, note string, added_at string")
    assert table(M.shortlist(cur, marks)) == [(1, "m", "t0"), (2, "x", "t1")]
    v = spark.createDataFrame([("section", 1), ("section", 2), ("one_liner", 9)], "source_type string, source_id long")
    assert M.purge_orphans(v, spark.createDataFrame([(1,)], "id long")).count() == 2
    urls = spark.createDataFrame([("a", None, True, 300, "x"), ("b", None, True, 100, "x"), ("c", "todo", False, 1, "x"), ("d", None, True, 900, "Registration form!")], "url string, disposition string, probe_has_date boolean, probe_words int, probe_title string")
    assert [r.disposition for r in M.settle(urls).orderBy("url").collect()] == ["ingest", "exclude", "todo", "exclude"]
    pos = M.append_positions(spark.createDataFrame([(1, 4)], "publication_id long, position int"), spark.createDataFrame([(1, 7), (1, 5), (2, 9)], "publication_id long, person_id long"), "publication_id", ["person_id"])
    assert table(pos) == [(1, 5, 5), (1, 7, 6), (2, 9, 0)]


def test_snapshots(spark, tmp_path):
    from lectern import schema

    folder = str(tmp_path / "cat")
    assert all(df.count() == 0 for df in snapshot.load(spark, folder).values())
    c = schema.empty(spark)
    one = spark.createDataFrame([(5, 3, False, None)], "id long, publication_id long, is_primary boolean, one_liner string")
    c["enrichments"] = one.selectExpr("id", "publication_id", "is_primary", "one_liner", *[f"cast(null AS {k}) AS {n}" for n, k in (x.strip().split(" ", 1) for x in schema.TABLES["enrichments"].replace("map<string,array<string>>", "map<string;array<string>>").split(",")[4:]) for k in [k.replace(";", ",")]])
    c["reviews"] = spark.createDataFrame([(1, "enrichment", 3, "confirmed"), (2, "enrichment", 99, "flagged"), (3, "backlog", 3, "parked")], "id long, scope string, subject_id long, verdict string").selectExpr("*", "cast(null AS string) AS note", "cast(null AS timestamp) AS created_at")
    assert snapshot.save({k: c[k] for k in ("enrichments", "reviews", "settings")}, folder, 0) == 1
    back = snapshot.load(spark, folder)
    assert back["enrichments"].first().is_primary and {(r.id, r.subject_id) for r in back["reviews"].collect()} == {(1, 5), (3, 3)}
    assert snapshot.save({"settings": spark.createDataFrame([("k", "[1]"), ("bad", "{")], "key string, value string")}, folder) == 2
    s = snapshot.load(spark, folder)["settings"]
    assert snapshot.setting(s, "k") == [1] and snapshot.setting(s, "bad", 7) == 7 and snapshot.setting(s, "no") is None
    assert snapshot.versions(spark, folder) == [1, 2]


@pytest.mark.parametrize("name", ["publications", "enrichments", "embeddings"])
def test_schemas_parse(spark, name):
    from lectern import schema

    assert schema.struct(name).fieldNames()


def test_merges_end_on_cycles_and_long_chains(spark):
    for n in (2, 3, 5):
        rows = [(10 + i, 10 + (i + 1) % n) for i in range(n)] + [(1, 12 if n > 2 else 11), (2, 1), (3, None), (4, 3), (90, 99)]
        got = {r.id: r.survivor for r in M.resolve_merged(spark.createDataFrame(rows, "id long, merged_into long")).collect()}
        assert got == {10 + i: 10 for i in range(n)} | {1: 10, 2: 10, 3: 3, 4: 3, 90: 99}
    chain = spark.createDataFrame([(1, None)] + [(i, i - 1) for i in range(2, 10_001)], "id long, merged_into long")
    got = M.resolve_merged(chain)
    assert got.where("survivor <> 1").count() == 0 and got.count() == 10_000
    assert M.resolve_merged(chain.where("id = 1")).collect() == [(1, 1)]


PEOPLE = "id long, slug string, name string, is_internal boolean, job_title string, roster_title string, is_current boolean, merged_into long"
CREDITS = "publication_id long, person_id long, role string, position int, source string"


def test_merging_a_person(spark):
    people = spark.createDataFrame([(1, "a", "A", True, None, None, True, None), (2, "b", "A", False, "T", "R", True, None), (3, "c", "A", False, None, None, False, 2)], PEOPLE)
    credits = spark.createDataFrame([(9, 1, "author", 0, "parsed"), (9, 2, "author", 1, "parsed"), (9, 2, "host", 2, "parsed"), (8, 2, "author", 0, "manual")], CREDITS)
    p, c, report = M.merge_person(people, credits, 2, 1)
    assert report == {"duplicate": "A", "survivor": "A", "moved": 2, "already_there": 1}
    assert table(c) == [(8, 1, "author", 0, "manual"), (9, 1, "author", 0, "parsed"), (9, 1, "host", 2, "parsed")]
    assert [tuple(r)[3:] for r in p.orderBy("id").collect()] == [(True, "T", "R", True, None), (False, "T", "R", False, 1), (False, None, None, False, 1)]
    with pytest.raises(ValueError):
        M.merge_person(p, c, 2, 1)


def test_people_are_found_or_made(spark):
    people = spark.createDataFrame([(1, "a", "Old", False, "T", None, True, None), (2, "b", "Gone", False, None, None, False, 1), (3, None, "X", False, None, None, True, None), (4, None, "X", False, None, None, True, None)], PEOPLE)
    seen = spark.createDataFrame([(1, "a", "New", False, None), (2, "b", "Other", True, "J"), (3, None, "X", False, "first"), (4, None, "X", False, None), (5, None, "Y", False, None), (6, "z", "Y", True, "t"), (7, "z", "Z", False, None)], "turn int, slug string, name string, is_internal boolean, job_title string")
    out, found = M.resolve_people(people, seen)
    assert {(r.slug, r.name, r.person_id) for r in found.collect()} == {("a", "New", 1), ("b", "Other", 1), (None, "X", 3), (None, "Y", 5), ("z", "Y", 6), ("z", "Z", 6)}
    assert {r.id: (r.name, r.is_internal, r.job_title) for r in out.collect()} == {1: ("New", True, "T"), 2: ("Gone", False, None), 3: ("X", False, "first"), 4: ("X", False, None), 5: ("Y", False, None), 6: ("Z", True, "t")}
    again, same = M.resolve_people(out, seen)
    assert again.count() == 6 and table(same) == table(found)


def test_records_are_upserted_whole(spark):
    from lectern import schema

    c = schema.empty(spark)
    c["people"] = spark.createDataFrame([(1, "a", "A", False, None, None, None, None, None, None)], schema.struct("people"))
    person = "struct<slug:string,name:string,is_internal:boolean,job_title:string,role:string>"
    records = spark.createDataFrame([("u1", "T1", [("a", "A", True, "J", "author"), (None, "B", False, None, "guest")], ["x", "y"]), ("u2", "T2", [], [])], f"url string, title string, people array<{person}>, site_tags array<string>")
    one = M.upsert_publications(c, records, "2024-01-01")
    assert {(r.id, r.url, r.title) for r in one["publications"].collect()} == {(1, "u1", "T1"), (2, "u2", "T2")}
    assert {tuple(r) for r in one["credits"].collect()} == {(1, 1, "author", 0, "parsed"), (1, 2, "guest", 1, "parsed")}
    assert {tuple(r) for r in one["site_tags"].collect()} == {(1, "x"), (2, "y")} and one["publication_site_tags"].count() == 2
    one["credits"] = M.credit(one["credits"], spark.createDataFrame([(1, 1, "host"), (1, 1, "author")], "publication_id long, person_id long, role string"))
    assert (1, 1, "host", 2, "manual") in {tuple(r) for r in one["credits"].collect()}
    changed = spark.createDataFrame([("u1", "New", [(None, "B", False, None, "author")], ["y", "z"])], records.schema)
    two = M.upsert_publications(one, changed, "2024-02-01")
    assert {(r.id, r.title) for r in two["publications"].collect()} == {(1, "New"), (2, "T2")}
    assert {tuple(r) for r in two["credits"].collect()} == {(1, 2, "author", 0, "parsed"), (1, 1, "host", 2, "manual")}
    assert {tuple(r) for r in two["publication_site_tags"].collect()} == {(1, 2), (1, 3)}
    three = M.upsert_publications(two, changed, "2024-02-01")
    assert all(table(three[k].drop("scraped_at")) == table(two[k].drop("scraped_at")) for k in ("publications", "people", "credits", "site_tags", "publication_site_tags"))
    assert M.uncredit(two["credits"], two["credits"].where("source = 'manual'")).count() == 1
    with pytest.raises(ValueError):
        M.credit(two["credits"], spark.createDataFrame([(1, 1, "editor")], "publication_id long, person_id long, role string"))


def test_note_transitions(spark):
    from lectern import schema

    pubs = spark.createDataFrame([(7,)], "id long")
    notes = M.edited_notes(spark.createDataFrame([], schema.struct("notes")), spark.createDataFrame([(None, " B ", " ", "2024-Q1"), (None, "A", "n", None)], "id long, working_title string, note string, expected string"), "2024-01-01")
    assert {(r.id, r.working_title, r.note, r.expected) for r in notes.collect()} == {(1, "A", "n", None), (2, "B", None, "2024-Q1")}
    ask = lambda *rows: spark.createDataFrame(rows, "id long, action string, text string, publication_id long")
    notes, bad = M.note_changes(notes, pubs, ask((1, "shelve", " no ", None), (2, "link", None, 7), (3, "reopen", None, None)), "2024-02-01")
    assert {(r.id, str(r.shelved_at), r.shelved_reason, r.publication_id) for r in notes.collect()} == {(1, "2024-02-01", "no", None), (2, "None", None, 7)}
    assert table(bad) == [(3, "no such note")]
    notes, bad = M.note_changes(notes, pubs, ask((1, "link", None, 7), (2, "shelve", "x", None)), "2024-03-01")
    assert dict(table(bad)) == {1: "it is shelved", 2: "it has landed"}
    notes, bad = M.note_changes(notes, pubs, ask((1, "reopen", None, None), (2, "shelve", " ", None)), "2024-03-01")
    assert dict(table(bad)) == {2: "shelving takes a reason"}
    notes, bad = M.note_changes(notes, pubs, ask((1, "link", None, 8)), "2024-03-01")
    assert dict(table(bad)) == {1: "no such publication"}
    row = notes.where("id = 1").first()
    assert (row.shelved_at, row.shelved_reason, str(row.created_at)) == (None, None, "2024-01-01")
    with pytest.raises(ValueError):
        M.edited_notes(notes, spark.createDataFrame([(1, "A", None, "2024-05")], "id long, working_title string, note string, expected string"), "x")


def test_decisions_and_collections(spark):
    urls = spark.createDataFrame([("a", "exclude", None, None), ("b", "ingest", "n", "2023-01-01")], "url string, disposition string, note string, settled_at string")
    out = M.decided(urls, spark.createDataFrame([("a", "todo", " why ")], "url string, disposition string, note string"), "2024-01-01")
    assert table(out) == [("a", "todo", "why", "2024-01-01"), ("b", "ingest", "n", "2023-01-01")]
    assert table(M.reopened_urls(out, out.where("url = 'b'"))) == [("a", "todo", "why", "2024-01-01"), ("b", "ingest", "n", None)]
    c = {"collections": spark.createDataFrame([("x", "X"), ("y", "Y")], "slug string, name string"), "publication_collections": spark.createDataFrame([(1, "x"), (1, "y")], "publication_id long, slug string")}
    assert table(M.renamed_collection(c, "x", " Z ")) == [("x", "Z"), ("y", "Y")]
    out = M.dropped_collection(c, "x")
    assert table(out["collections"]) == [("y", "Y")] and table(out["publication_collections"]) == [(1, "y")]
