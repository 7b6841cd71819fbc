"""Keyword search against the standard library's SQLite FTS5."""

import random
import sqlite3

import pyarrow as pa
import pytest

from lectern.functions import stemming
from lectern.operators import indexing
from lectern.operators import search as S
from lectern.operators.indexing import StoredIndex

FIELDS = ("title", "subtitle", "description", "body")
VOCAB = "tariff tariffs pressure control controls export exports running runs ran nation national policy policies Grünberg grunberg semi conductor 2025 hopeful hoping relational".split()


def corpus(seed, n=60):
    r = random.Random(seed)
    return [(i, *[" ".join(r.choices(VOCAB, k=r.randrange(k))) for k in (4, 3, 6, 40)]) for i in range(1, n + 1)]


def fts(rows, stemmed):
    c = sqlite3.connect(":memory:")
    tok = "porter unicode61 remove_diacritics 2" if stemmed else "unicode61 remove_diacritics 0"
    c.execute(f"CREATE VIRTUAL TABLE f USING fts5({', '.join(FIELDS)}, tokenize='{tok}')")
    c.executemany(f"INSERT INTO f(rowid, {', '.join(FIELDS)}) VALUES (?, ?, ?, ?, ?)", rows)
    return c


QUERIES = [
    "tariff", "tariff pressure", "tariff OR policy", "export NOT policy", '"export controls"', "title : tariff", "{title subtitle} : export controls", "{title subtitle} : (export controls)",
    "polic*", "(tariff AND policy) OR national", '"control export" OR "nation policy"', "^tariff", "body : ^policy", "tariff AND (export OR runs) NOT hoping", "title:nat* policy", '"semi conductor"', "export + controls",
]


@pytest.mark.parametrize("stemmed", [False, True])
def test_matches_and_scores_are_those_of_fts5(spark, stemmed):
    rows = corpus(3)
    index = S.Index.build(spark.createDataFrame(rows, "id long, title string, subtitle string, description string, body string"), FIELDS, stemmed)
    index = S.Index(index.postings.cache(), index.lengths.cache(), FIELDS, stemmed, index.words and index.words.cache())
    scan = S.Scan(spark.createDataFrame(rows, "id long, title string, subtitle string, description string, body string").cache(), FIELDS, stemmed)
    c = fts(rows, stemmed)
    for q in QUERIES:
        want = {i: s for i, s in c.execute("SELECT rowid, bm25(f, 10, 5, 3, 1) FROM f WHERE f MATCH ?", (q,))}
        for way in (index, scan):
            got = {x.id: x.score for x in S.match(way, q, S.PUBLICATION_WEIGHTS).collect()}
            assert set(got) == set(want), q
            assert all(abs(got[i] - want[i]) < 1e-9 + 1e-9 * abs(want[i]) for i in want), q


def test_malformed_queries_raise(spark):
    index = S.Index.build(spark.createDataFrame(corpus(1, 3), "id long, title string, subtitle string, description string, body string"), FIELDS)
    for q in ("", "   ", "AND x", "x OR", "(x", 'nosuch : x', "x -y", "de-risking", "what?", "x)"):
        with pytest.raises(S.MatchError):
            S.match(index, q, S.PUBLICATION_WEIGHTS)


def test_safe_queries():
    assert S.safe_query("de-risking now?") == '"de risking" "now"'
    assert S.safe_query('tariff* AND "a phrase" -x ^y or') == 'tariff* AND "a phrase" -x ^y or'
    assert S.safe_query("  ?! ") == "" and S.safe_query(None) == ""


def test_stemmer_agrees_with_sqlite():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61')")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'row')")
    parts = ["", "s", "es", "ies", "ed", "ing", "ational", "tional", "izer", "ization", "fulness", "ousness", "iviti", "biliti", "icate", "ative", "alize", "ical", "ness", "al", "ance", "er", "ment", "ement", "ent", "ion", "ism", "ous", "ive", "ize", "eed", "ly", "y", "e", "ll", "logi", "entli", "alli"]
    words = {a + b for a in ("relat", "hop", "fall", "agr", "tr", "control", "motor", "conflat", "adopt", "sky", "happ", "triplic", "form", "hiss", "fizz", "plaster", "bl", "syzyg") for b in parts}
    for w in sorted(words):
        if not 1 < len(w) < 20:
            continue
        c.execute("DELETE FROM f")
        c.execute("INSERT INTO f VALUES (?)", (w,))
        assert stemming.stem(w) == c.execute("SELECT term FROM v").fetchone()[0], w


def test_title_beats_body_and_best_section(spark):
    docs = spark.createDataFrame([(1, "tariff", "x y z"), (2, "other", "tariff x y"), (3, "none", "q")], "id long, title string, body string")
    index = S.Index.build(docs, ("title", "body"))
    assert [x.id for x in S.search(index, "tariff", (10.0, 1.0), 5).orderBy("position").collect()] == [1, 2]
    sections = spark.createDataFrame([(10, 1, "tariff", "a"), (11, 1, "b", "tariff"), (12, 2, "c", "d")], "id long, publication_id long, heading string, body string")
    own = S.Index.build(sections.select("id", "heading", "body"), ("heading", "body"))
    got = S.best_sections(own, sections, "tariff", docs).collect()
    assert [(x.id, x.section_id) for x in got] == [(1, 10)]


def test_index_survives_saving(spark, tmp_path):
    docs = spark.createDataFrame(corpus(2, 20), "id long, title string, subtitle string, description string, body string")
    index = S.Index.build(docs, FIELDS)
    index.save(str(tmp_path))
    again = S.Index.open(spark, str(tmp_path), FIELDS)
    a, b = (sorted((x.id, round(x.score, 9)) for x in S.match(i, "tariff export", S.PUBLICATION_WEIGHTS).collect()) for i in (index, again))
    assert a == b


def test_stale(spark):
    cat = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, title string")
    got = S.stale(spark.createDataFrame([(1, "a"), (2, "x")], "id long, title string"), cat).first()
    assert (got.missing_rows, got.stale_titles) == (1, 1)


SAID = ["tariff", "tariff OR export", '"export control" OR polic*', "title : nation OR body : running", "grunberg pressure", "semi + conductor OR 2025", '"control control" OR controls']


@pytest.mark.parametrize("stemmed,column,width", [(True, None, 12), (False, None, 5), (True, 3, 5), (False, 0, 3)])
def test_snippets_are_those_of_fts5(spark, stemmed, column, width):
    r = random.Random(8)
    gaps = [" ", ". ", ":\n", ", ", "; ", " - ", "..."]

    def prose(k):
        return "".join(r.choice(["", "", "("]) + w + r.choice(gaps) for w in r.choices(VOCAB, k=r.randrange(k)))

    rows = [(i, prose(5), prose(4), prose(8), prose(60) if i % 5 else None) for i in range(1, 70)]
    docs = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, body string").cache()
    built = S.Index.build(docs, FIELDS, stemmed)
    index = S.Index(built.postings.cache(), built.lengths, FIELDS, stemmed, built.words and built.words.cache())
    c = fts(rows, stemmed)
    for q in SAID:
        want = dict(c.execute(f"SELECT rowid, snippet(f, {-1 if column is None else column}, '[', ']', ' … ', {width}) FROM f WHERE f MATCH ?", (q,)))
        shown = docs.join(S.match(index, q, S.PUBLICATION_WEIGHTS).select("id"), "id", "left_semi")
        got = {x.id: x.snippet for x in S.snippets(index, shown, q, column, width).collect()}
        # FTS5 gives null for a null column, and nothing to show is empty here
        assert got == {i: s or "" for i, s in want.items()}, q


def test_words_fold_like_fts5(spark):
    text = "ﬁne ½ x² cafés Ǖber ĳ Ω ȩ́x \u0301abc İstanbul 한국 a_b e\u0301te\u0301 Straße naïve"
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(x, tokenize='porter unicode61 remove_diacritics 2')")
    c.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    c.execute("INSERT INTO f VALUES (?)", (text,))
    want = [t for (t,) in c.execute("SELECT term FROM v ORDER BY offset")]
    assert stemming.tokens(text) == want
    index = S.Index.build(spark.createDataFrame([(1, text)], "id long, body string"), ("body",), True)
    stems = {r.term: r.stem for r in index.words.collect()}
    assert [stems[r.term] for r in index.postings.orderBy("position").collect()] == want


def test_stems_of_many_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "MANY", 1)
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "id long, title string, subtitle string, description string, body string")
    c = fts(rows, True)
    for way in (S.Index.build(docs, FIELDS, True), S.Scan(docs, FIELDS, True)):
        for q in ("export NOT p*", '"export control"'):
            assert {x.id for x in S.match(way, q, S.PUBLICATION_WEIGHTS).collect()} == {i for (i,) in c.execute("SELECT rowid FROM f WHERE f MATCH ?", (q,))}


def state(index):
    return (
        sorted((r.term, r.id, r.field, r.position) for r in index.postings.collect()),
        sorted((r.id, r.length) for r in index.lengths.collect()),
    )


@pytest.mark.parametrize("stemmed", [False, True])
def test_an_index_kept_up_to_date_equals_a_rebuilt_one(spark, tmp_path, monkeypatch, stemmed):
    schema = "id long, title string, subtitle string, description string, body string"
    made = lambda rows: spark.createDataFrame(rows, schema)
    rows = corpus(6, 40)
    mine = StoredIndex(spark, f"{tmp_path}/i", FIELDS, stemmed)
    with pytest.raises(ValueError):
        mine.open()
    first = mine.at(made(rows), "1")
    # one text changes, one moves between fields, one goes, two come, one has no id
    after = [(1, "new tariff words", None, None, "policies"), (2, rows[1][2], rows[1][1], *rows[1][3:]), *rows[3:], (90, "late", "", "", "export controls"), (91, None, None, None, None), (None, "tariff", "", "", "")]
    monkeypatch.setattr(indexing, "SHARE", 10)
    second = mine.at(made(after), "2")
    assert state(second) == state(S.Index.build(made([r for r in after if r[0] is not None]), FIELDS, stemmed))
    segments, mark = mine.manifest()
    assert mark == "2" and [(s.documents, s.void) for s in segments] == [(40, 0), (4, 3)]  # only what changed was cut into tokens
    assert state(first)[1] == state(S.Index.build(made(rows), FIELDS, stemmed))[1]  # readers of the older one keep it
    for q in ("tariff", "export NOT policy", "polic*"):
        c = fts([r for r in after if r[0] is not None], stemmed)
        want = {i: s for i, s in c.execute("SELECT rowid, bm25(f, 10, 5, 3, 1) FROM f WHERE f MATCH ?", (q,))}
        got = {x.id: x.score for x in S.match(second, q, S.PUBLICATION_WEIGHTS).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 + 1e-9 * abs(want[i]) for i in want), q

    # one document alone, though others changed too
    third = [(1, "tariff once more", None, None, "x"), *after[2:-1]]
    mine.update(made(third), "3", spark.createDataFrame([(1,), (2,)], "id long"))
    assert [(s.documents, s.void) for s in mine.manifest()[0]] == [(40, 0), (4, 3), (1, 2)]
    assert state(mine.open()) == state(S.Index.build(made(third), FIELDS, stemmed))
    mine.update(made(third), "4")  # nothing new: no segment
    assert len(mine.manifest()[0]) == 3 and mine.manifest()[1] == "4"
    monkeypatch.setattr(indexing, "SHARE", 0.01)
    merged = mine.update(made(third[1:]), "5")
    assert [(s.documents, s.void) for s in mine.manifest()[0]] == [(len(third) - 1, 0)]
    assert state(merged) == state(S.Index.build(made(third[1:]), FIELDS, stemmed))
    mine.vacuum()
    assert len(mine.numbers()) == 1 and state(mine.open()) == state(merged)
    assert mine.open().postings.count() and state(mine.rebuild(made(rows)))[1] == state(first := S.Index.build(made(rows), FIELDS, stemmed))[1] and first


def test_a_lost_write_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, body string")
    mine = StoredIndex(spark, f"{tmp_path}/i", ("body",))
    mine.rebuild(docs, "1")
    before = state(mine.open())

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(StoredIndex, "_commit", lost)
    with pytest.raises(RuntimeError):
        mine.update(docs.where("id = 1"), "2")
    monkeypatch.undo()
    assert state(mine.open()) == before and mine.manifest()[1] == "1"
    assert state(mine.update(docs.where("id = 1"), "2"))[1] == [(1, 2)]


def test_porter_in_sql_agrees():
    import duckdb

    from lectern.plans.stems import porter

    r = random.Random(1)
    words = {"".join(r.choices("aeioubcdlsty", k=r.randrange(1, 9))) + r.choice(["", "s", "ies", "ing", "ed", "eed", "ational", "ibly", "fulness", "ion", "ement", "y", "e", "ll"]) for _ in range(1500)} | {"straße", "2025s", "é", "possibly"}
    c = duckdb.connect()
    c.execute("CREATE TABLE t (term VARCHAR, w VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", [(w, w) for w in sorted(words)])
    assert dict(c.execute(f"WITH {porter('t', 'p')} SELECT term, stem FROM p").fetchall()) == {w: stemming.stem(w) for w in words}


def test_saving_shuffles_no_postings(spark, tmp_path, monkeypatch):
    """Blocks of a few tokens and rows of a few places hold what was built; a
    term's filter reaches the scan."""
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(S, "PLACES", 3)
    docs = spark.createDataFrame([(i, "to be or not to be " * (i % 5), "é be" if i % 2 else None) for i in range(60)] + [(99, None, "")], "id long, title string, body string")
    built = S.Index.build(docs, ("title", "body"))
    assert "Exchange" not in S.blocks(built.postings)._jdf.queryExecution().executedPlan().toString()
    built.save(f"{tmp_path}/i")
    opened = S.Index.open(spark, f"{tmp_path}/i", ("title", "body"))
    state = lambda i: sorted((r.term, r.id, r.field, r.position) for r in i.postings.collect())
    assert state(opened) == state(built) and opened.postings.dtypes == built.postings.dtypes
    assert max(r.n for r in spark.read.parquet(f"{tmp_path}/i/postings").selectExpr("size(places) AS n").collect()) <= 3
    assert "EqualTo(term,be)" in opened.postings.where("term = 'be'")._jdf.queryExecution().executedPlan().toString()


def test_void_ids_are_broadcast_to_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word w{i}") for i in range(40)], "id long, body string")
    mine = StoredIndex(spark, f"{tmp_path}/i", ("body",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mine.rebuild(docs)
        rows = mine.update(docs.where("id > 2")).postings
        assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 74
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_cut_as_in_a_plan(spark, monkeypatch):
    from lectern.functions import words

    r = random.Random(5)
    pool = "aZ9 .-_éÉßİıΣσς\u0301\u0300\u036f中文𝒜𐐀😀٣Ⅷ½ª\n\t\u200d\u1ab0"
    rows = [(i, *["".join(r.choices(pool, k=r.randrange(k))) if r.random() > 0.1 else None for k in (3, 30)]) for i in range(800)]
    docs = spark.createDataFrame([*rows, (None, "a b", "c"), (7, "", "")], "id long, title string, body string").repartition(2).cache()
    seen = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    for stemmed in (False, True):
        index = S.Index.build(docs, ("title", "body"), stemmed)
        blocks = S.text_blocks(docs, ("title", "body"), stemmed)
        assert "Generate" not in blocks._jdf.queryExecution().executedPlan().toString()  # no row of a single token
        assert seen(S.unblocked(blocks)) == seen(index.postings)
        assert seen(S.text_lengths(docs, ("title", "body"), stemmed)) == seen(index.lengths)
    texts, known = pa.array(["aé. b" * 50, "", "c", "d e"]), words.unpacked(words.letters(spark))
    monkeypatch.setattr(words, "SLICE_BYTES", 3)
    assert len(list(words.slices(texts))) == 3 and words.counted(texts, known, False).tolist() == [len(texts[0].as_py().split()), 0, 1, 2]
    assert [t for _, _, terms in words.tokens(texts.slice(2), known, False) for t in terms.to_pylist()] == ["c", "d", "e"]


@pytest.mark.parametrize("stemmed", [False, True])
def test_a_narrowed_index_scores_the_same(spark, stemmed):
    docs = spark.createDataFrame(corpus(9, 40), "id long, title string, subtitle string, description string, body string").cache()
    index = S.Index.build(docs, FIELDS, stemmed)
    queries = ["tariff OR polic*", "export NOT hoping"]
    own = S.narrowed(index, queries)
    assert 0 < own.postings.count() < index.postings.count()
    for q in queries:
        got, want = ({r.id: r.score for r in S.match(i, q, S.PUBLICATION_WEIGHTS).collect()} for i in (own, index))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert S.narrowed(S.Scan(docs, FIELDS), queries).docs is docs
