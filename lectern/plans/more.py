"""Further queries: sections, collections, rosters, state and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D
from ..operators import search as S
from ..operators import state as M
from ..operators import vectors as R
from ..operators import views as V
from .catalog import _QUERY_VEC, _TOKENS, _bm25, _doc_index, _query_vector, _top, _vectors, query, stored_index


@query("filtered_search", _bm25(["trash", "moron", "idiot"], False, 30) + """SELECT id, round(score, 9) AS score, position FROM top WHERE id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr'))""", "documents_")
def _(c):
    pubs = c["documents_"].select("id", "lang")
    return V.filtered_hits(_top(_doc_index(c), "trash OR moron OR idiot", 30), pubs, lang=["en", "fr"])


@query("bylines", """
SELECT publication_id, string_agg(name, ', ' ORDER BY CASE role WHEN 'author' THEN 1 WHEN 'guest' THEN 2 ELSE 3 END, position, name) AS byline
FROM credits JOIN people ON person_id = people.id GROUP BY publication_id""", "credits", "people")
def _(c):
    return V.bylines(c)


@query("matrix_order", """
WITH cells AS (
  SELECT person_id, topic_slug, count(DISTINCT c.publication_id) AS n FROM credits c JOIN publication_topics t ON c.publication_id = t.publication_id AND t.position = 1
  JOIN topics ON topic_slug = slug WHERE role IN ('author', 'guest') GROUP BY ALL),
own AS (SELECT id, name, coalesce(max(n) FILTER (topic_slug = 'Brand#4'), 0) AS own, CAST(sum(n) AS BIGINT) AS total FROM people JOIN cells ON id = person_id WHERE merged_into IS NULL AND is_current GROUP BY id, name)
SELECT id, name, own, total, row_number() OVER (ORDER BY own DESC, total DESC, id) AS position FROM own""", "credits", "publication_topics", "topics", "people")
def _(c):
    return V.matrix_order(V.who_knows_what(c), "Brand#4")


@query("roster_entries", """
WITH roster AS (SELECT concat('person-', s_suppkey) AS slug, s_name AS title FROM supplier WHERE s_suppkey % 3 <> 1),
ways AS (SELECT id AS person_id, slug, 0 AS turn, id AS via FROM people WHERE merged_into IS NULL UNION ALL SELECT merged_into, slug, 1, id FROM people WHERE merged_into IS NOT NULL)
SELECT person_id, slug, title FROM ways JOIN roster USING (slug) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY turn, via) = 1""", "people")
def _(c):
    return V.roster_entries(c["people"], c["supplier"].where("s_suppkey % 3 <> 1").selectExpr("concat('person-', s_suppkey) AS slug", "s_name AS title"))


@query("named_entities", """
SELECT name, count(DISTINCT id) AS n FROM (SELECT id, unnest(string_split(summary, ' ')) AS name FROM enrichments) GROUP BY name""", "enrichments")
def _(c):
    rows = c["enrichments"].select("id", F.create_map(F.lit("people"), F.split("summary", " ")).alias("entities"))
    return V.named_entities(rows, "people")


_SECTIONS = f"""sections AS (SELECT conv_id * 1000 + turn AS id, conv_id AS publication_id, {_TOKENS.format('role')} AS h, {_TOKENS.format('text')} AS b FROM conversations),
size AS (SELECT id, len(h) + len(b) AS d FROM sections), total AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
hits AS (SELECT id, publication_id, 8.0 * len(list_filter(h, lambda x: x = 'with')) + len(list_filter(b, lambda x: x = 'with')) AS f FROM sections),
df AS (SELECT ln((any_value(total.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hits, total WHERE f > 0),
scored AS (SELECT h.id AS section_id, publication_id AS id, -(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)) AS score FROM hits h JOIN size s ON h.id = s.id, df, total WHERE f > 0)"""


def _sections(c):
    return c["conversations"].selectExpr("conv_id * 1000 + turn AS id", "conv_id AS publication_id", "role AS heading", "text AS body")


@query("best_sections", f"""WITH {_SECTIONS} SELECT id, section_id, round(score, 9) AS score FROM scored
QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(score, 9), section_id) = 1""")
def _(c):
    s = _sections(c)
    ids = s.select(F.col("publication_id").alias("id")).distinct()
    scan = S.Scan(s.select("id", "heading", "body"), ("heading", "body"))
    return S.best_sections(scan, s, "with", ids).withColumn("score", F.round("score", 9))


@query("outlines", "SELECT conv_id AS publication_id, string_agg(role, chr(10) ORDER BY turn, role) AS outline FROM conversations GROUP BY conv_id")
def _(c):
    return D.outlines(c["conversations"].selectExpr("conv_id AS publication_id", "turn AS position", "role AS heading", "CAST(NULL AS INT) AS chunk_index"))


@query("recall_at_3", f"""
WITH hits AS (SELECT label AS c, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position FROM embeddings),
cases AS (SELECT DISTINCT label AS c FROM embeddings)
SELECT avg(hit) AS recall FROM (SELECT c.c, max(CASE WHEN position <= 3 AND regexp_matches(text, '(?i)ing\\b.*tion') THEN 1 ELSE 0 END) AS hit FROM cases c LEFT JOIN hits h ON c.c = h.c LEFT JOIN documents ON doc_id = vec_id GROUP BY c.c)""")
def _(c):
    hits = c["embeddings"].selectExpr("label AS case", "vec_id", "row_number() OVER (PARTITION BY label ORDER BY vec_id) AS position").join(c["documents"].selectExpr("doc_id AS vec_id", "text AS title"), "vec_id")
    cases = c["embeddings"].selectExpr("label AS case", r"'(?i)ing\\b.*tion' AS pattern").distinct()
    return R.recall(hits.withColumn("one_liner", F.lit(None).cast("string")), cases, 3)


#: Questions with the words that ask for them, the vector that stands for the
#: question, and what the title of a right hit shows.
CASES = (("insults", ("worthless", "moron"), 7, "(?i)moron"), ("licenses", ("licensed", "copyright"), 11, "(?i)licen[sc]e"), ("waste", ("trash", "scum"), 23, "(?i)scum"), ("jesters", ("pathetic", "clown"), 42, "(?i)clown"))
_CASES = ", ".join(f"('{name}', {v}, '{pattern}')" for name, _, v, pattern in CASES)
_ASKED = ", ".join(f"('{name}', '{w}')" for name, words, _, _ in CASES for w in words)


@query("recall_by_ranker", f"""
WITH docs AS (SELECT id, title, {_TOKENS.format('title')} AS t, {_TOKENS.format('body')} AS b FROM documents_),
size AS (SELECT id, len(t) + len(b) AS d FROM docs), total AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
cases(c, v, pattern) AS (VALUES {_CASES}), asked(c, q) AS (VALUES {_ASKED}),
tf AS (SELECT * FROM (SELECT id, q, 10.0 * len(list_filter(t, lambda x: x = q)) + 1.0 * len(list_filter(b, lambda x: x = q)) AS f FROM docs, (SELECT DISTINCT q FROM asked)) WHERE f > 0),
df AS (SELECT q, ln((any_value(total.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, total GROUP BY q),
kw AS (SELECT c, h.id, -sum(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM asked JOIN tf h USING (q) JOIN df USING (q) JOIN size s ON h.id = s.id, total GROUP BY c, h.id),
dots AS (SELECT c, CASE source_type WHEN 'one_liner' THEN 1 ELSE 2 END AS ranker, publication_id AS id, list_sum(list_transform(list_zip(x.vector, e.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS s
  FROM cases JOIN embeddings e ON e.vec_id = v, vectors_ x),
every AS (SELECT c, 0 AS ranker, id, row_number() OVER (PARTITION BY c ORDER BY score, id) AS position FROM kw
  UNION ALL SELECT c, ranker, id, row_number() OVER (PARTITION BY c, ranker ORDER BY s DESC, id) FROM dots),
deep AS (SELECT * FROM every WHERE position <= 20),
fused AS (SELECT c, 3 AS ranker, id, row_number() OVER (PARTITION BY c ORDER BY round(score, 12) DESC, r, p) AS position
  FROM (SELECT c, id, sum(1.0 / (60 + position)) AS score, min(ranker) AS r, arg_min(position, ranker) AS p FROM deep GROUP BY c, id)),
hits AS (SELECT c, ranker, position, title FROM (SELECT * FROM deep UNION ALL SELECT * FROM fused) JOIN docs USING (id))
SELECT ['keyword', 'one_liner', 'section', 'hybrid'][g.ranker + 1] AS ranker, CAST(g.k AS INTEGER) AS k, avg(g.hit) AS recall
FROM (SELECT r.ranker, k.k, cases.c, max(CASE WHEN regexp_matches(title, pattern) THEN 1 ELSE 0 END) AS hit
  FROM cases, range(4) AS r(ranker), (VALUES (1), (3)) AS k(k) LEFT JOIN hits h ON h.c = cases.c AND h.ranker = r.ranker AND h.position <= k.k GROUP BY ALL) g GROUP BY g.ranker, g.k""", "documents_", "vectors_")
def _(c):
    stored = {r.vec_id: list(r.embedding) for r in c["embeddings"].where(F.col("vec_id").isin([v for _, _, v, _ in CASES])).collect()}
    kinds = {kind: c["vectors_"].where(F.col("source_type") == kind).select(F.col("publication_id").alias("id"), "vector") for kind in ("one_liner", "section")}
    shown = c["documents_"].select("id", "title", F.lit(None).cast("string").alias("one_liner"))
    return R.recall_by_ranker([(name, " OR ".join(words), stored[v], pattern) for name, words, v, pattern in CASES], stored_index(c), kinds, shown, (10.0, 1.0))


@query("index_staleness", """
SELECT count(*) FILTER (i.id IS NULL) AS missing_rows, count(*) FILTER (i.id IS NOT NULL AND i.title IS DISTINCT FROM p.title) AS stale_titles
FROM publications p LEFT JOIN (SELECT id, CASE WHEN id % 9 = 0 THEN upper(title) ELSE title END AS title FROM publications WHERE id % 11 <> 0) i ON p.id = i.id""", "publications")
def _(c):
    return S.stale(c["publications"].where("id % 11 <> 0").selectExpr("id", "CASE WHEN id % 9 = 0 THEN upper(title) ELSE title END AS title"), c["publications"])


@query("placed_points", """
WITH dots AS (SELECT a.vec_id AS anchor, b.vec_id AS id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS s FROM embeddings a, embeddings b WHERE a.label < 8 AND b.label >= 8),
near AS (SELECT *, power(greatest(s, 0.05), 2) AS w FROM dots QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, anchor) <= 10)
SELECT id, round(sum(w * (anchor % 13)) / sum(w), 6) AS x, round(sum(w * (anchor % 17)) / sum(w), 6) AS y FROM near GROUP BY id""")
def _(c):
    """Points of two clusters are new, all others have their places."""
    old = c["embeddings"].where("label < 8").selectExpr("vec_id AS id", "CAST(vec_id % 13 AS DOUBLE) AS x", "CAST(vec_id % 17 AS DOUBLE) AS y")
    new = c["embeddings"].where("label >= 8").selectExpr("vec_id AS id", "embedding AS vector")
    return R.place(old, _vectors(c), new).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("similar_unit_vectors", f"""
SELECT vec_id AS id, round(list_sum(list_transform(list_zip(embedding, {_QUERY_VEC}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine FROM embeddings""")
def _(c):
    return c["embeddings"].select(F.col("vec_id").alias("id"), F.round(R.similarity(X.normalised(F.col("embedding")), _query_vector(c)), 6).alias("cosine"))


# --- state ---


@query("appended_positions", """
WITH last AS (SELECT publication_id, max(position) AS last FROM credits WHERE role = 'author' GROUP BY 1)
SELECT publication_id, person_id, coalesce(last, -1) + row_number() OVER (PARTITION BY publication_id ORDER BY person_id) AS position
FROM (SELECT DISTINCT publication_id, person_id FROM credits WHERE role = 'guest') LEFT JOIN last USING (publication_id)""", "credits")
def _(c):
    return M.append_positions(c["credits"].where("role = 'author'"), c["credits"].where("role = 'guest'").select("publication_id", "person_id").distinct(), "publication_id", ["person_id"])


@query("replaced_topics", """
SELECT publication_id, topic_slug, CAST(position AS BIGINT) AS position FROM publication_topics WHERE publication_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0)
UNION ALL SELECT o_orderkey, 'Brand#1', 1 FROM orders WHERE o_orderkey % 6 = 0""", "publication_topics")
def _(c):
    new = c["orders"].where("o_orderkey % 6 = 0").selectExpr("o_orderkey AS publication_id", "'Brand#1' AS topic_slug", "1 AS position")
    return M.replace_children(c["publication_topics"], new, "publication_id")


@query("replaced_credits", """
WITH own AS (SELECT publication_id, person_id, role, CASE WHEN person_id % 5 = 0 THEN 'manual' ELSE 'parsed' END AS source FROM credits),
new AS (SELECT DISTINCT publication_id, person_id + 1 AS person_id, 'author' AS role FROM credits WHERE publication_id % 4 = 0)
SELECT * FROM own WHERE source = 'manual' UNION ALL SELECT * FROM own WHERE source = 'parsed' AND publication_id NOT IN (SELECT publication_id FROM new)
UNION ALL SELECT *, 'parsed' FROM new n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE source = 'manual' AND o.publication_id = n.publication_id AND o.person_id = n.person_id AND o.role = n.role)""", "credits")
def _(c):
    own = c["credits"].selectExpr("publication_id", "person_id", "role", "CASE WHEN person_id % 5 = 0 THEN 'manual' ELSE 'parsed' END AS source")
    new = c["credits"].where("publication_id % 4 = 0").selectExpr("publication_id", "person_id + 1 AS person_id", "'author' AS role", "'parsed' AS source")
    return M.replace_parsed(own, new, "publication_id", ["publication_id", "person_id", "role"])


@query("settled_urls", """
WITH urls AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'todo' END AS given, page_id % 3 <> 0 AS dated, length(html) // 20 AS words, CASE WHEN page_id % 8 = 0 THEN ' Registration. ' ELSE 'x' END AS title FROM pages)
SELECT page_id, coalesce(given, CASE WHEN title LIKE ' Reg%' THEN 'exclude' WHEN dated AND words >= 250 THEN 'ingest' ELSE 'exclude' END) AS disposition FROM urls""")
def _(c):
    urls = c["pages"].selectExpr("page_id", "CASE WHEN page_id % 10 = 0 THEN 'todo' END AS disposition", "page_id % 3 <> 0 AS probe_has_date", "length(html) div 20 AS probe_words", "CASE WHEN page_id % 8 = 0 THEN ' Registration. ' ELSE 'x' END AS probe_title")
    return M.settle(urls).select("page_id", "disposition")


@query("shortlisted", """
WITH old AS (SELECT doc_id AS publication_id, 'old' AS note, doc_id AS at FROM labels WHERE quality = 1), new AS (SELECT doc_id AS publication_id, 'new' AS note, -1 AS at FROM labels WHERE toxic = 1)
SELECT publication_id, coalesce(new.note, old.note) AS note, coalesce(old.at, new.at) AS added_at FROM old FULL JOIN new USING (publication_id)""")
def _(c):
    own = lambda rows, note, at: rows.selectExpr("doc_id AS publication_id", f"'{note}' AS note", f"CAST({at} AS LONG) AS added_at")
    return M.shortlist(own(c["labels"].where("quality = 1"), "old", "doc_id"), own(c["labels"].where("toxic = 1"), "new", "-1"))


@query("purged_vectors", """
SELECT vec_id AS source_id, CASE WHEN label < 5 THEN 'section' ELSE 'one_liner' END AS source_type FROM embeddings WHERE label >= 5 OR vec_id IN (SELECT doc_id FROM labels)""")
def _(c):
    v = c["embeddings"].selectExpr("vec_id AS source_id", "CASE WHEN label < 5 THEN 'section' ELSE 'one_liner' END AS source_type")
    return M.purge_orphans(v, c["labels"].selectExpr("doc_id AS id"))


@query("missing_vectors", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 7)")
def _(c):
    from ..operators import loops

    vectors = c["embeddings"].where("label < 7").selectExpr("vec_id AS source_id", "'m' AS model", "'section' AS source_type")
    return loops.to_embed(c["documents"].selectExpr("doc_id AS id", "false AS is_boilerplate"), vectors, "m").select("id")


@query("unsummarised_texts", "SELECT publication_id, word_count FROM publication_text WHERE word_count > 0 AND publication_id NOT IN (SELECT publication_id FROM enrichments WHERE is_primary)", "publication_text", "enrichments")
def _(c):
    from ..operators import loops

    return loops.to_summarise(c).select("publication_id", "word_count")


@query("url_scopes", """
WITH u AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', CASE page_id % 3 WHEN 0 THEN 'https://x.org/en' WHEN 1 THEN 'https://x.org/index.php/en/report' ELSE 'https://y.org/en' END) AS url FROM pages),
p AS (SELECT page_id, url LIKE 'https://x.org/%' AS own, trim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/index\\.php', ''), '/') AS path FROM u),
r AS (SELECT page_id, own, regexp_extract(path, '^en/(.*)$', 1) AS rest FROM p)
SELECT page_id, CASE WHEN NOT own OR rest = '' THEN 'excluded' WHEN rest NOT LIKE '%/_%' THEN 'root-level' WHEN split_part(rest, '/', 1) = 'report' THEN 'publication' ELSE 'excluded' END AS scope FROM r""")
def _(c):
    url = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    url = F.concat(F.when(F.col("page_id") % 3 == 0, "https://x.org/en").when(F.col("page_id") % 3 == 1, "https://x.org/index.php/en/report").otherwise("https://y.org/en"), url)
    return c["pages"].select("page_id", X.url_scope(url, ["x.org"], ["report"])["scope"].alias("scope"))


@query("note_problems", """
SELECT conv_id AS id, 'more than three topics' AS problem FROM conversations GROUP BY conv_id HAVING count(*) > 3
UNION ALL SELECT DISTINCT conv_id, 'a topic is unknown' FROM conversations WHERE role = 'system'""")
def _(c):
    notes = c["conversations"].selectExpr("conv_id AS id", "'2024-Q1' AS expected", "CAST(NULL AS DATE) AS landed_at", "CAST(NULL AS DATE) AS shelved_at", "'x' AS note").distinct()
    topics = c["conversations"].selectExpr("conv_id AS note_id", "role AS topic_slug")
    return M.note_problems(notes, topics, c["conversations"].where("role <> 'system'").selectExpr("role AS slug").distinct())


@query("length_bands")
def _(c):
    return V.length_bands(c)


@query("landscape")
def _(c):
    from ..operators import landscape

    return landscape.fit(_vectors(c))


@query("merged_people", "SELECT c_custkey AS id, c_custkey - c_custkey % 8 AS survivor FROM customer")
def _(c):
    people = c["customer"].selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 8 <> 0 THEN c_custkey - 1 END AS merged_into")
    return M.resolve_merged(people)


@query("people_found", """
WITH seen AS (SELECT p_partkey AS turn, CASE WHEN p_partkey % 3 = 0 THEN concat('person-', p_size) END AS slug, p_name AS name FROM part),
keyed AS (SELECT *, CASE WHEN slug IS NOT NULL THEN concat('slug ', slug) ELSE concat('name ', name) END AS key FROM seen),
known AS (SELECT concat('slug ', slug) AS key, id, merged_into FROM people), keys AS (SELECT DISTINCT key FROM keyed),
ids AS (SELECT key, coalesce(merged_into, id) AS person_id FROM keys JOIN known USING (key)
  UNION ALL SELECT key, (SELECT max(id) FROM people) + row_number() OVER (ORDER BY key) FROM keys WHERE key NOT IN (SELECT key FROM known))
SELECT DISTINCT slug, name, person_id FROM keyed JOIN ids USING (key)""", "people")
def _(c):
    people = c["people"].withColumn("job_title", F.lit(None).cast("string"))
    seen = c["part"].selectExpr("p_partkey AS turn", "CASE WHEN p_partkey % 3 = 0 THEN concat('person-', p_size) END AS slug", "p_name AS name", "false AS is_internal", "CAST(NULL AS STRING) AS job_title")
    return M.resolve_people(people, seen)[1]


@query("credited_by_hand", """
WITH added AS (SELECT DISTINCT o_orderkey AS publication_id, o_custkey % 50 AS person_id, 'guest' AS role FROM orders WHERE o_orderstatus = 'P'),
new AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM credits c WHERE c.publication_id = a.publication_id AND c.person_id = a.person_id AND c.role = a.role)),
last AS (SELECT publication_id, max(position) AS last FROM credits GROUP BY 1)
SELECT publication_id, person_id, role, CAST(position AS BIGINT) AS position, source FROM credits
UNION ALL SELECT publication_id, person_id, role, coalesce(last, -1) + row_number() OVER (PARTITION BY publication_id ORDER BY person_id), 'manual' FROM new LEFT JOIN last USING (publication_id)""", "credits")
def _(c):
    return M.credit(c["credits"], c["orders"].where("o_orderstatus = 'P'").selectExpr("o_orderkey AS publication_id", "o_custkey % 50 AS person_id", "'guest' AS role"))


_ASKED = """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'shelve' WHEN 'click' THEN 'link' WHEN 'error' THEN 'reopen' ELSE 'other' END AS action,
  CASE WHEN user_id % 4 = 0 THEN ' ' ELSE props END AS text, user_id * 40 AS publication_id FROM {}"""


@query("note_refusals", f"""
WITH asked AS ({_ASKED.format('events')}), state AS (SELECT event_id AS id, event_id % 6 = 0 AS landed, event_id % 6 = 1 AS shelved FROM events WHERE event_id % 10 <> 0)
SELECT a.id, CASE WHEN s.id IS NULL THEN 'no such note' WHEN action = 'shelve' AND trim(text) = '' THEN 'shelving takes a reason' WHEN action = 'shelve' AND landed THEN 'it has landed'
  WHEN action = 'link' AND shelved THEN 'it is shelved' WHEN action = 'link' AND p.id IS NULL THEN 'no such publication' ELSE 'no such action' END AS problem
FROM asked a LEFT JOIN state s ON a.id = s.id LEFT JOIN publications p ON p.id = a.publication_id
WHERE s.id IS NULL OR (action = 'shelve' AND (trim(text) = '' OR landed)) OR (action = 'link' AND (shelved OR p.id IS NULL)) OR action = 'other'""", "publications")
def _(c):
    notes = c["events"].where("event_id % 10 <> 0").selectExpr("event_id AS id", "CASE WHEN event_id % 6 = 0 THEN 1L END AS publication_id", "CAST(NULL AS DATE) AS landed_at", "CASE WHEN event_id % 6 = 1 THEN DATE '2024-01-01' END AS shelved_at", "CAST(NULL AS STRING) AS shelved_reason", "CAST(NULL AS DATE) AS updated_at")
    asked = c["events"].sparkSession.sql(_ASKED.format("{events}"), events=c["events"])
    return M.note_changes(notes, c["publications"], asked, "2024-05-01")[1]
