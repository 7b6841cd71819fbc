"""The queries of the engine over the driver's tables, and their SQL.

Each entry applies an operator of ``lectern.operators`` to the roles that
``bind`` gives, over whole tables; a limit stands only where the operator
itself is a top-k or a page.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import rules
from ..functions import text as X
from ..operators import documents as D
from ..operators import search as S
from ..operators import state as M
from ..operators import vectors as R
from ..operators import views as V
from ..operators.indexing import StoredIndex
from .bind import load, prelude
from .stems import porter

FLAGSHIP = "hybrid_find"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries that show a day.
DATED = ("collection_members", "shortlist_rows", "semantic_search", "facet_filter", "newest_page", "topic_spotlight", "topic_pair", "person_page", "person_listing", "thin_records")


def query(name: str, sql: str | None = None, *roles: str):
    """Register a function of the roles; sql may use the named roles. Both
    sides give ranks as long and days as ISO text."""

    def shown(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        df = df.withColumns({c: F.col(c).cast("long") for c in ("position", "turn") if kinds.get(c) == "int"})
        return df.withColumns({c: F.col(c).cast("string") for c, kind in kinds.items() if kind == "date"})

    def register(f: Callable[[dict[str, DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: shown(f(load(spark, sf_dir)))
        if sql is not None:
            text = sql.strip()
            if roles:
                own = prelude(*roles)
                text = own + ", " + text[5:] if text.upper().startswith("WITH ") else own + " " + text
            if name in DATED:
                text = f"SELECT * REPLACE (CAST(date_published AS VARCHAR) AS date_published) FROM ({text})"
            ORACLE_SQL[name] = text
        return f

    return register


_WEIGHT = "CASE pub_type WHEN 'Report' THEN 8 WHEN 'Tracker' THEN 4 WHEN 'External' THEN 2 ELSE 1 END"
_SCOPE = "parent_id IS NULL AND pub_type <> 'Podcast'"
_QUARTER = "concat(year(date_published), '-Q', quarter(date_published))"
_SPINE = """SELECT concat(i // 4, '-Q', i % 4 + 1) AS quarter FROM (SELECT unnest(range(
  (SELECT min(year(date_published) * 4 + quarter(date_published) - 1) FROM {src}),
  (SELECT max(year(date_published) * 4 + quarter(date_published)) FROM {src}))) AS i)"""

# --- filters, pages and facets ---


@query("facet_filter", f"""
SELECT id, slug, pub_type, series, date_published FROM publications
WHERE parent_id IS NULL AND pub_type IN ('Report', 'Tracker') AND year(date_published) IN (1997, 1998)
  AND id IN (SELECT publication_id FROM publication_topics WHERE topic_slug IN ('Brand#3', 'Brand#11') AND position = 1)
  AND id IN (SELECT publication_id FROM credits WHERE person_id < 40)""", "publications", "publication_topics", "credits")
def _(c):
    people = [r for r in range(40)]
    return V.list_publications(c, pub_type=["Report", "Tracker"], year=[1997, 1998], topic=["Brand#3", "Brand#11"], topic_primary=True, person_id=people).select("id", "slug", "pub_type", "series", "date_published")


@query("newest_page", """
SELECT id, title, date_published FROM publications WHERE parent_id IS NULL
ORDER BY date_published DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100""", "publications")
def _(c):
    return V.page(V.list_publications(c), 50, 100).select("id", "title", "date_published")


@query("facet_counts", """
SELECT 'type' AS facet, pub_type AS value, count(*) AS n FROM publications WHERE parent_id IS NULL GROUP BY pub_type
UNION ALL SELECT 'year', CAST(year(date_published) AS VARCHAR), count(*) FROM publications WHERE parent_id IS NULL GROUP BY year(date_published)
UNION ALL SELECT 'series', series, count(*) FROM publications WHERE parent_id IS NULL AND series IS NOT NULL GROUP BY series""", "publications")
def _(c):
    return V.facet_counts(c)


@query("people_credits", """
SELECT id, name, count(*) FILTER (role IN ('author', 'guest')) AS n, count(*) FILTER (role = 'host') AS hosted
FROM people JOIN credits ON id = person_id WHERE merged_into IS NULL GROUP BY id, name""", "people", "credits")
def _(c):
    return V.people_credits(c)


@query("people_by_fragment", """
SELECT id, name, CAST(sum(CAST(role IN ('author', 'guest') AS INT)) AS BIGINT) AS n FROM people LEFT JOIN credits ON id = person_id
WHERE lower(name) LIKE '%er#00000001%' GROUP BY id, name""", "people", "credits")
def _(c):
    return V.people_by_fragment(c, "ER#00000001")


@query("all_words_mentioned", """
SELECT id FROM publications WHERE contains(lower(concat_ws(' ', title, series)), 'watch') AND contains(lower(concat_ws(' ', title, series)), 'finance')""", "publications")
def _(c):
    return c["publications"].where(X.mentions("Watch finance", F.col("title"), F.col("series"))).select("id")


@query("uncredited", "SELECT id, slug FROM publications WHERE parent_id IS NULL AND NOT EXISTS (SELECT 1 FROM credits WHERE publication_id = id)", "publications", "credits")
def _(c):
    return V.uncredited(c).select("id", "slug")


@query("typeahead", """
SELECT id, name, is_current, CASE WHEN lower(name) LIKE 'customer%' THEN 0 WHEN lower(name) LIKE '% customer%' THEN 1 ELSE 2 END AS rank
FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal > 1000 AS is_current FROM customer) WHERE lower(name) LIKE '%customer%'
ORDER BY rank, is_current DESC, name, id LIMIT 10""")
def _(c):
    people = c["customer"].selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal > 1000 AS is_current")
    return V.typeahead(people, "customer")


# --- topics ---


@query("topic_counts", "SELECT topic_slug, count(*) AS n, count(*) FILTER (position = 1) AS n_primary FROM publication_topics GROUP BY topic_slug", "publication_topics")
def _(c):
    return V.topic_counts(c)


@query("topic_graph_nodes", f"""
WITH least AS (SELECT publication_id, topic_slug, min(position) AS position FROM publication_topics GROUP BY ALL)
SELECT topics.slug, label, count(*) AS pubs, CAST(sum({_WEIGHT}) AS BIGINT) AS weighted, count(*) FILTER (position = 1) AS about
FROM least JOIN publications ON publication_id = id JOIN topics ON topic_slug = topics.slug WHERE {_SCOPE} GROUP BY topics.slug, label""", "publication_topics", "publications", "topics")
def _(c):
    return V.topic_graph_nodes(c)


@query("topic_graph_edges", f"""
SELECT a.topic_slug AS s1, b.topic_slug AS s2, count(*) AS n FROM publication_topics a
JOIN publication_topics b ON a.publication_id = b.publication_id AND a.topic_slug < b.topic_slug
JOIN publications ON a.publication_id = id
WHERE a.position <= 2 AND b.position <= 2 AND {_SCOPE} GROUP BY s1, s2 HAVING count(*) >= 2""", "publication_topics", "publications")
def _(c):
    return V.topic_graph_edges(c)


_CELLS = f"""SELECT topic_slug, {_QUARTER} AS quarter, sum({_WEIGHT}) AS w, sum(coalesce(word_count, 0)) AS words, count(*) AS n
  FROM publication_topics t JOIN publications p ON t.publication_id = p.id LEFT JOIN publication_text x ON x.publication_id = p.id
  WHERE position = 1 AND {_SCOPE} GROUP BY ALL"""
_TOPIC_TIME = f"""WITH dated AS (SELECT date_published FROM publication_topics JOIN publications ON publication_id = id WHERE position = 1 AND {_SCOPE}),
cells AS ({_CELLS}), axis AS ({_SPINE.format(src='dated')}),
topic_time AS (SELECT slug, label, a.quarter, CAST(coalesce(w, 0) AS BIGINT) AS w, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT slug, label FROM cells JOIN topics ON topic_slug = slug) CROSS JOIN axis a
LEFT JOIN cells c ON c.topic_slug = slug AND c.quarter = a.quarter)
"""


@query("topic_time", _TOPIC_TIME + "SELECT * FROM topic_time", "publication_topics", "publications", "publication_text", "topics")
def _(c):
    return V.topic_time(c)


@query("streamgraph", _TOPIC_TIME + """, ranked AS (SELECT slug, row_number() OVER (ORDER BY sum(w) DESC, slug) AS r FROM topic_time GROUP BY slug),
layers AS (SELECT CASE WHEN r <= 8 THEN slug ELSE 'other' END AS layer, least(r, 9) AS r, quarter, CAST(sum(w) AS BIGINT) AS w FROM topic_time JOIN ranked USING (slug) GROUP BY ALL)
SELECT layer, quarter, w, CAST(sum(w) OVER (PARTITION BY quarter ORDER BY r) - w AS DOUBLE) - sum(w) OVER (PARTITION BY quarter) / 2 AS base FROM layers""", "publication_topics", "publications", "publication_text", "topics")
def _(c):
    return V.streamgraph(c)


@query("topic_spotlight", f"""
SELECT p.id, title, pub_type, date_published, summary FROM (
  SELECT id, title, pub_type, date_published FROM publications WHERE {_SCOPE}
    AND id IN (SELECT publication_id FROM publication_topics WHERE topic_slug = 'Brand#7' AND position = 1) ORDER BY date_published DESC, id DESC LIMIT 6) p
LEFT JOIN enrichments e ON e.publication_id = p.id AND is_primary""", "publications", "publication_topics", "enrichments")
def _(c):
    return V.topic_spotlight(c, "Brand#7")


@query("topic_pair", f"""
SELECT id, title, pub_type, date_published FROM publications WHERE {_SCOPE}
  AND id IN (SELECT publication_id FROM publication_topics WHERE topic_slug = 'Brand#7' AND position <= 2)
  AND id IN (SELECT publication_id FROM publication_topics WHERE topic_slug = 'Brand#9' AND position <= 2) ORDER BY date_published DESC, id DESC LIMIT 30""", "publications", "publication_topics")
def _(c):
    return V.topic_pair(c, "Brand#7", "Brand#9")


@query("topic_arrays", """
SELECT publication_id, string_agg(topic_slug, ',' ORDER BY position, topic_slug) AS topics, arg_min(topic_slug, (position, topic_slug)) AS first_topic
FROM publication_topics GROUP BY publication_id""", "publication_topics")
def _(c):
    return V.topic_arrays(c)


@query("keyword_time", f"""
WITH hits AS (
  SELECT id FROM publications WHERE list_contains(regexp_extract_all(lower(concat_ws(' ', title, series)), '[a-z0-9]+'), 'outlook')
  UNION SELECT publication_id FROM enrichments WHERE is_primary AND lower(summary) LIKE '%outlook%'
), roots AS (SELECT DISTINCT coalesce(parent_id, id) AS root FROM hits JOIN publications USING (id)),
dated AS (SELECT * FROM publications WHERE {_SCOPE}),
cells AS (SELECT {_QUARTER} AS quarter, sum({_WEIGHT}) AS w, sum(coalesce(word_count, 0)) AS words, count(*) AS n FROM roots JOIN dated ON root = id
  LEFT JOIN publication_text ON publication_id = id GROUP BY 1), axis AS ({_SPINE.format(src='dated')})
SELECT quarter, CAST(coalesce(w, 0) AS BIGINT) AS w, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n FROM axis LEFT JOIN cells USING (quarter)""", "publications", "enrichments", "publication_text")
def _(c):
    index = S.Scan(c["publications"].select("id", "title", "series"), ("title", "series"))
    hits = S.match(index, "outlook", (1.0, 1.0)).select("id").union(V.summary_hits(c, "outlook")).distinct()
    return V.term_time(c, hits)


# --- people ---


@query("who_knows_what", """
WITH cells AS (
  SELECT person_id, topic_slug, count(DISTINCT c.publication_id) AS n FROM credits c JOIN publication_topics t ON c.publication_id = t.publication_id AND t.position = 1
  JOIN topics ON topic_slug = slug WHERE role IN ('author', 'guest') GROUP BY ALL
), totals AS (SELECT person_id, count(*) AS credits_total FROM credits WHERE role IN ('author', 'guest') GROUP BY ALL),
mapped AS (SELECT person_id, CAST(sum(n) AS BIGINT) AS mapped_total FROM cells GROUP BY ALL)
SELECT id, name, affiliation, credits_total, mapped_total, topic_slug AS topic, n FROM people JOIN totals ON id = totals.person_id
JOIN mapped ON id = mapped.person_id JOIN cells ON id = cells.person_id WHERE merged_into IS NULL AND is_current""", "credits", "publication_topics", "topics", "people")
def _(c):
    return V.who_knows_what(c)


@query("person_page", """
SELECT role, p.id, title, pub_type, date_published FROM credits JOIN publications p ON publication_id = p.id
WHERE person_id = (SELECT coalesce(merged_into, id) FROM people WHERE id = 19)""", "credits", "publications", "people")
def _(c):
    return V.person_page(c, 19)


@query("person_facets", """
WITH rows AS (SELECT DISTINCT coalesce(merged_into, people.id) AS person_id, publication_id, role, pub_type FROM credits JOIN people ON person_id = people.id JOIN publications p ON publication_id = p.id)
SELECT person_id, 'total' AS facet, NULL AS value, count(*) AS n FROM rows WHERE role IN ('author', 'guest') GROUP BY 1
UNION ALL SELECT person_id, 'type', pub_type, count(*) FROM rows WHERE role IN ('author', 'guest') GROUP BY 1, 3
UNION ALL SELECT person_id, 'hosted', NULL, count(*) FROM rows WHERE role = 'host' GROUP BY 1""", "credits", "people", "publications")
def _(c):
    return V.person_facets(c)


@query("person_listing", """
SELECT role, p.id, title, pub_type, date_published, one_liner, e.summary FROM credits JOIN publications p ON publication_id = p.id
LEFT JOIN (SELECT publication_id, one_liner, summary FROM enrichments WHERE is_primary) e ON e.publication_id = p.id
WHERE person_id = (SELECT coalesce(merged_into, id) FROM people WHERE id = 19) AND role IN ('author', 'guest') AND pub_type IN ('Report', 'Podcast')
  AND contains(lower(concat_ws(' ', title, one_liner, e.summary)), 'finance') AND contains(lower(concat_ws(' ', title, one_liner, e.summary)), 'paper')""", "credits", "publications", "people", "enrichments")
def _(c):
    return V.person_listing(c, 19, " Paper finance", ["Report", "Podcast"])


@query("duplicate_names", """
SELECT name, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
FROM (SELECT p_partkey AS id, p_name AS name FROM part) GROUP BY name HAVING count(*) > 1""")
def _(c):
    return V.duplicate_names(c["part"].selectExpr("p_partkey AS id", "p_name AS name", "cast(null AS long) AS merged_into"))


@query("merged_credits", """
SELECT publication_id, coalesce(merged_into, id) AS person_id, role, CAST(min(position) AS BIGINT) AS position FROM credits JOIN people ON id = person_id GROUP BY ALL""", "credits", "people")
def _(c):
    return M.merge_credits(c["credits"], M.resolve_merged(c["people"]))


@query("adjacent_topics_and_people", """
WITH ids AS (SELECT id FROM publications WHERE pub_type = 'Tracker' AND series IS NULL)
SELECT 'topic' AS kind, topic_slug AS name, count(DISTINCT publication_id) AS n FROM publication_topics WHERE position <= 2 AND publication_id IN (FROM ids) GROUP BY topic_slug
UNION ALL SELECT 'person', name, count(*) FROM credits JOIN people ON id = person_id WHERE role IN ('author', 'guest') AND merged_into IS NULL AND publication_id IN (FROM ids) GROUP BY people.id, name""", "publications", "publication_topics", "credits", "people")
def _(c):
    ids = c["publications"].where("pub_type = 'Tracker' AND series IS NULL")
    topics = V.adjacent_topics(c, ids).select(F.lit("topic").alias("kind"), F.col("topic_slug").alias("name"), "n")
    return topics.union(V.adjacent_people(c, ids).select(F.lit("person"), "name", "n"))


# --- quality, status and worklists ---

_NORMS = """norms AS (SELECT pub_type, list_sort(list(word_count))[count(*) // 2 + 1] AS median_words FROM publication_text JOIN publications ON publication_id = id
  WHERE pub_type NOT IN ('Podcast', 'External') GROUP BY pub_type HAVING count(*) >= 5)"""


@query("type_length_norms", f"WITH {_NORMS} SELECT pub_type, median_words, CAST(floor(median_words * 0.25) AS BIGINT) AS floor_words FROM norms", "publication_text", "publications")
def _(c):
    return V.type_length_norms(c)


@query("thin_records", f"""WITH {_NORMS}
SELECT id, pub_type, word_count, median_words AS expected, source, pdf_url, date_published FROM publications JOIN publication_text ON publication_id = id JOIN norms USING (pub_type)
WHERE access = 'public' AND word_count < floor(median_words * 0.25)""", "publication_text", "publications")
def _(c):
    return V.thin_records(c)


@query("pdf_needed", """
WITH rows AS (SELECT id, pub_type, pdf_url, word_count FROM publications LEFT JOIN publication_text ON publication_id = id),
means AS (SELECT pub_type, floor(avg(word_count) * 0.25) AS f FROM rows WHERE word_count IS NOT NULL GROUP BY pub_type)
SELECT id, pdf_url FROM rows JOIN means USING (pub_type) WHERE pdf_url IS NOT NULL AND word_count < f
UNION SELECT id, pdf_url FROM rows WHERE pdf_url IS NOT NULL AND word_count IS NULL""", "publications", "publication_text")
def _(c):
    return V.pdf_needed(c)


@query("shared_pdfs", "SELECT pdf_url, count(*) AS n FROM publications WHERE pdf_url IS NOT NULL GROUP BY pdf_url HAVING count(*) > 1", "publications")
def _(c):
    return V.shared_pdfs(c)


_STATUS = """
WITH first AS (SELECT * FROM enrichments WHERE is_primary), status AS (
SELECT 'publications' AS measure, count(*) AS n FROM publications WHERE parent_id IS NULL
UNION ALL SELECT 'chapters', count(*) FROM publications WHERE parent_id IS NOT NULL
UNION ALL SELECT 'people', count(*) FROM people WHERE merged_into IS NULL
UNION ALL SELECT 'texts', count(*) FROM publication_text
UNION ALL SELECT 'words', CAST(sum(word_count) AS BIGINT) FROM publication_text
UNION ALL SELECT 'enriched', count(*) FROM first
UNION ALL SELECT 'models', count(DISTINCT model) FROM first
UNION ALL SELECT 'mapped', count(DISTINCT publication_id) FROM publication_topics
UNION ALL SELECT 'unenriched', count(*) FROM publication_text WHERE word_count > 0 AND publication_id NOT IN (SELECT publication_id FROM first)
UNION ALL SELECT 'no_topics', count(*) FROM first WHERE publication_id NOT IN (SELECT publication_id FROM publication_topics)
UNION ALL SELECT 'site_tags', count(*) FROM site_tags
UNION ALL SELECT 'indexed', count(*) FROM documents
UNION ALL SELECT 'sections', count(*) FROM sections_
UNION ALL SELECT 'no_sections', count(*) FROM publication_text WHERE publication_id NOT IN (SELECT publication_id FROM sections_)
UNION ALL SELECT 'no_vector', count(*) FROM sections_ WHERE NOT is_boilerplate AND id NOT IN (SELECT source_id FROM vectors_ WHERE source_type = 'section')
UNION ALL SELECT 'no_one_liner', count(*) FROM first WHERE publication_id NOT IN (SELECT source_id FROM vectors_ WHERE source_type = 'one_liner')
UNION ALL SELECT 'vectors', count(*) FROM vectors_)
"""
_STATUS_ROLES = ("publications", "people", "publication_text", "enrichments", "publication_topics", "credits", "site_tags", "sections_", "vectors_")


def _whole(c):
    return c.catalog(sections="sections_", embeddings="vectors_", indexed="documents")


@query("status_report", _STATUS + "SELECT * FROM status", *_STATUS_ROLES)
def _(c):
    return V.status_report(_whole(c))


@query("status_groups", """
SELECT 'type' AS facet, pub_type AS value, count(*) AS n FROM publications WHERE parent_id IS NULL GROUP BY 2
UNION ALL SELECT 'role', role, count(*) FROM credits GROUP BY 2
UNION ALL SELECT 'affiliation', affiliation, count(*) FROM people WHERE merged_into IS NULL GROUP BY 2
UNION ALL SELECT 'current', affiliation, count(*) FILTER (is_current) FROM people WHERE merged_into IS NULL GROUP BY 2
UNION ALL SELECT 'sitemap', concat(scope, ' ', status), count(*) FROM sitemap_urls GROUP BY 2
UNION ALL SELECT 'vectors', source_type, count(*) FROM vectors_ GROUP BY 2""", "publications", "credits", "people", "sitemap_urls", "vectors_")
def _(c):
    return V.status_groups(_whole(c))


@query("status_warnings", _STATUS + """, n AS (SELECT measure, n FROM status),
split AS (SELECT count(*) AS n FROM (SELECT name FROM people WHERE merged_into IS NULL GROUP BY name HAVING count(*) > 1)),
total AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM n WHERE measure IN ('publications', 'chapters'))
SELECT 'split' AS measure, concat(n, ' names are carried by more than one person, merge them') AS warning FROM split WHERE n > 0
UNION ALL SELECT measure, concat(n.n, ' of ', total.n) FROM n, total WHERE false
UNION ALL SELECT measure, concat('the keyword index holds ', n.n, ' of ', total.n, ' publications and chapters, build it again') FROM n, total WHERE measure = 'indexed' AND n.n <> total.n
UNION ALL SELECT measure, concat(n, CASE measure WHEN 'no_sections' THEN ' texts have no sections, extract them' WHEN 'no_vector' THEN ' sections have no vector, embed them'
  WHEN 'no_one_liner' THEN ' summaries have no vector, embed them' ELSE ' summaries carry no topics, map them' END) FROM n WHERE n > 0 AND measure IN ('no_sections', 'no_vector', 'no_one_liner', 'no_topics')
UNION ALL SELECT measure, 'no vector is stored, searches rest on keywords alone' FROM n WHERE measure = 'vectors' AND n = 0""", *_STATUS_ROLES)
def _(c):
    return V.status_warnings(_whole(c))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.CAVEATS.items())


@query("coverage_caveats", f"""
WITH root AS (SELECT *, coalesce(disposition, '') = 'exclude' AS out_ FROM sitemap_urls), gaps AS (
SELECT 'legacy' AS measure, count(*) AS n FROM root WHERE scope = 'root-level' AND status = 'pending' AND NOT out_
UNION ALL SELECT 'declined', count(*) FROM root WHERE scope = 'root-level' AND out_
UNION ALL SELECT 'unscraped', count(*) FROM root WHERE scope = 'publication' AND status IN ('failed', 'skipped')
UNION ALL SELECT 'gone', count(*) FROM root WHERE scope = 'publication' AND status = 'gone'
UNION ALL SELECT 'uncredited', count(*) FROM publications WHERE parent_id IS NULL AND id NOT IN (SELECT publication_id FROM credits)
UNION ALL SELECT 'split', count(*) FROM (SELECT name FROM people WHERE merged_into IS NULL GROUP BY name HAVING count(*) > 1)
UNION ALL SELECT 'by_hand', count(*) FROM credits WHERE source = 'manual'
UNION ALL SELECT 'no_text', count(*) FROM publications WHERE id NOT IN (SELECT publication_id FROM publication_text)
UNION ALL SELECT 'title_only', count(*) FROM publications WHERE description IS NULL AND id NOT IN (SELECT publication_id FROM publication_text))
SELECT measure, n, replace(CASE measure {_CASES} END, '%', CAST(n AS VARCHAR)) AS caveat FROM gaps WHERE n > 0
UNION ALL SELECT 'elsewhere', -1, '{V.ELSEWHERE}'""", "sitemap_urls", "publications", "credits", "people", "publication_text")
def _(c):
    return V.caveats(_whole(c)).fillna(-1, ["n"])


@query("review_stats", "SELECT count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'flagged') AS flagged FROM reviews WHERE scope = 'enrichment'", "reviews")
def _(c):
    return V.review_stats(c)


@query("latest_reviews", """
SELECT scope, subject_id, verdict, note, created_at FROM reviews QUALIFY row_number() OVER (PARTITION BY scope, subject_id ORDER BY created_at DESC, id DESC) = 1""", "reviews")
def _(c):
    return M.latest(c["reviews"], ["scope", "subject_id"], ["created_at", "id"]).select("scope", "subject_id", "verdict", "note", "created_at")


@query("collection_counts", """
SELECT c.slug, name, count(p.publication_id) AS n FROM collections c LEFT JOIN publication_collections p ON c.slug = p.slug GROUP BY c.slug, name""", "collections", "publication_collections")
def _(c):
    return V.collection_counts(c)


@query("collection_members", """
SELECT p.id, title, pub_type, date_published, m.source, one_liner FROM publication_collections m JOIN publications p ON publication_id = p.id
LEFT JOIN enrichments e ON e.publication_id = p.id AND is_primary WHERE m.slug = 'c7'""", "publication_collections", "publications", "enrichments")
def _(c):
    return V.collection_members(c, "c7")


@query("collections_for", "SELECT publication_id, slug, name, source FROM publication_collections JOIN collections USING (slug)", "publication_collections", "collections")
def _(c):
    return V.collections_for(c)


@query("shortlist_rows", """
SELECT p.id, title, pub_type, date_published, s.note, s.added_at, one_liner FROM shortlist s JOIN publications p ON s.publication_id = p.id
LEFT JOIN enrichments e ON e.publication_id = p.id AND is_primary""", "shortlist", "publications", "enrichments")
def _(c):
    return V.shortlist_rows(c)


@query("tags_matching", """
SELECT name AS tag, p.id, title FROM site_tags t JOIN publication_site_tags x ON t.id = x.tag_id JOIN publications p ON p.id = x.publication_id WHERE lower(name) LIKE '%ag 3%'""", "site_tags", "publication_site_tags", "publications")
def _(c):
    return V.tags_matching(c, "AG 3")


@query("parent_typeahead", """
SELECT id, title, CAST(date_published AS VARCHAR) AS date_published, CASE WHEN lower(title) LIKE 'paper 37%' THEN 0 WHEN lower(title) LIKE '% paper 37%' THEN 1 ELSE 2 END AS rank
FROM publications WHERE parent_id IS NULL AND lower(title) LIKE '%paper 37%' ORDER BY rank, date_published DESC, id LIMIT 10""", "publications")
def _(c):
    return V.parent_typeahead(c["publications"], "Paper 37")


@query("round_robin_worklist", """
SELECT id, pub_type, row_number() OVER (PARTITION BY pub_type ORDER BY id) AS turn FROM enrichments JOIN publications ON publication_id = publications.id
WHERE is_primary AND publication_id NOT IN (SELECT publication_id FROM publication_topics WHERE position = 2)""".replace("SELECT id", "SELECT publications.id").replace("ORDER BY id", "ORDER BY publications.id"), "enrichments", "publications", "publication_topics")
def _(c):
    return V.round_robin(c, c["publication_topics"].where("position = 2"))


@query("model_stats", """
SELECT model, count(*) AS n, count(*) FILTER (is_primary) AS n_primary, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(seconds) AS BIGINT) AS seconds FROM enrichments GROUP BY model""", "enrichments")
def _(c):
    return V.model_stats(c)


@query("summary_candidates", "SELECT publication_id, count(*) AS n, count(*) FILTER (is_primary) AS n_primary FROM enrichments GROUP BY publication_id HAVING count(*) > count(*) FILTER (is_primary)", "enrichments")
def _(c):
    return V.candidates(c)


@query("summary_throughput", """
SELECT count(*) AS n, CAST(epoch(max(enriched_at)) - epoch(min(enriched_at)) AS BIGINT) AS span_seconds, CAST(sum(seconds) AS BIGINT) AS busy_seconds
FROM (SELECT * FROM enrichments ORDER BY enriched_at DESC, id DESC LIMIT 60)""", "enrichments")
def _(c):
    return V.throughput(c)


@query("publication_detail", """
WITH pp AS (SELECT publication_id, string_agg(concat(name, ':', role), '|' ORDER BY position, role, name) AS people FROM credits JOIN people ON person_id = people.id GROUP BY publication_id),
tt AS (SELECT publication_id, string_agg(topic_slug, ',' ORDER BY position, topic_slug) AS topics FROM publication_topics GROUP BY publication_id),
ch AS (SELECT parent_id, count(*) AS chapters FROM publications WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT p.id, title, pub_type, coalesce(p.parent_id, -1) AS parent_id, pp.people, topics, coalesce(word_count, -1) AS word_count, summary, coalesce(chapters, 0) AS chapters FROM publications p LEFT JOIN pp ON pp.publication_id = p.id
LEFT JOIN tt ON tt.publication_id = p.id LEFT JOIN publication_text x ON x.publication_id = p.id LEFT JOIN enrichments e ON e.publication_id = p.id AND is_primary LEFT JOIN ch ON ch.parent_id = p.id""",
"publications", "credits", "people", "publication_topics", "publication_text", "enrichments")
def _(c):
    return V.publication_detail(c).fillna(-1, ["parent_id", "word_count"])


@query("chapters_of_parents", """
SELECT c.id, c.parent_id, c.parent_position, c.title, p.title AS parent_title FROM publications c JOIN publications p ON c.parent_id = p.id""", "publications")
def _(c):
    return V.chapters_of(c)


@query("tier_count", f"""
SELECT pub_type, count(*) AS n, CAST(sum({_WEIGHT}) AS BIGINT) AS weighted FROM publications
WHERE id IN (SELECT coalesce(parent_id, id) FROM publications WHERE series = 'Outlook') GROUP BY pub_type""", "publications")
def _(c):
    return V.tier(c, c["publications"].where("series = 'Outlook'").select("id"))


# --- state ---


@query("sitemap_upsert", """
WITH current AS (SELECT url, max(lastmod) AS lastmod, CASE min(kind) WHEN 'click' THEN 'done' WHEN 'error' THEN 'gone' ELSE 'failed' END AS status, min(lastmod) AS first_seen, max(lastmod) AS last_seen
  FROM sitemap_seen WHERE n % 3 <> 0 AND seen % 2 = 0 GROUP BY url),
new AS (SELECT url, max(lastmod) AS new_lastmod FROM sitemap_seen WHERE n % 5 <> 0 GROUP BY url)
SELECT url, coalesce(new_lastmod, lastmod) AS lastmod,
  CASE WHEN status IS NULL THEN 'pending' WHEN status = 'done' AND new_lastmod IS NOT NULL AND new_lastmod IS DISTINCT FROM lastmod THEN 'pending' ELSE status END AS status,
  coalesce(first_seen, '2025-01-01') AS first_seen, CASE WHEN new_lastmod IS NOT NULL THEN '2025-01-01' ELSE last_seen END AS last_seen
FROM current FULL JOIN new USING (url)""", "sitemap_seen")
def _(c):
    s = c["sitemap_seen"]
    status = F.when(F.min("kind") == "click", "done").when(F.min("kind") == "error", "gone").otherwise("failed")
    current = s.where("n % 3 <> 0 AND seen % 2 = 0").groupBy("url").agg(F.max("lastmod").alias("lastmod"), status.alias("status"), F.min("lastmod").alias("first_seen"), F.max("lastmod").alias("last_seen"))
    return M.upsert_urls(current, s.where("n % 5 <> 0").select("url", "lastmod"), "2025-01-01")


@query("text_precedence", """
WITH old AS (SELECT * FROM publication_text WHERE publication_id % 3 <> 0), new AS (SELECT publication_id, word_count * 2 % 150 AS w, CASE WHEN publication_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS s FROM publication_text WHERE publication_id % 4 <> 0),
both_ AS (SELECT publication_id, word_count, source, w, s, source IS NOT NULL AND (s IS NULL OR source = 'manual' OR (source = 'pdf' AND s = 'html' AND w <= word_count)) AS keep FROM old FULL JOIN new USING (publication_id))
SELECT publication_id, CASE WHEN keep THEN word_count ELSE w END AS word_count, CASE WHEN keep THEN source ELSE s END AS source FROM both_""", "publication_text")
def _(c):
    t = c["publication_text"].withColumn("body", F.lit(None).cast("string"))
    new = t.where("publication_id % 4 <> 0").selectExpr("publication_id", "body", "word_count * 2 % 150 AS word_count", "CASE WHEN publication_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS source")
    return M.upsert_text(t.where("publication_id % 3 <> 0"), new).drop("body")


@query("pdf_import_decisions", """
WITH shared AS (SELECT pdf_url, count(*) AS k FROM publications GROUP BY pdf_url), med AS (SELECT pub_type, median(word_count) AS m FROM publications JOIN publication_text ON publication_id = id GROUP BY pub_type),
rows AS (SELECT id, source, word_count, id % 11 = 0 AS f, k, id % 7 <> 0 AS found, id % 400 AS w, m FROM publications p JOIN shared s ON p.pdf_url = s.pdf_url LEFT JOIN publication_text ON publication_id = id JOIN med ON med.pub_type = p.pub_type)
SELECT id, CASE WHEN reason IS NULL THEN 'import' ELSE 'skip' END AS action, reason FROM (SELECT id, CASE WHEN source = 'manual' THEN 'manual' WHEN f THEN 'foreign host' WHEN k > 5 THEN 'shared' WHEN NOT found THEN 'missing' WHEN w > 4 * m THEN 'outsized'
  WHEN coalesce(source, '') <> 'pdf' AND w <= coalesce(word_count, 0) THEN 'not longer' END AS reason FROM rows)""", "publications", "publication_text")
def _(c):
    p, t = c["publications"], c["publication_text"].withColumnRenamed("source", "stored_source").withColumnRenamed("word_count", "stored_words")
    medians = p.join(t, F.col("id") == F.col("publication_id")).groupBy(F.col("pub_type").alias("kind")).agg(F.median("stored_words").alias("type_median"))
    shared = p.where("pdf_url IS NOT NULL").groupBy("pdf_url").agg(F.count("*").alias("k"))
    rows = p.join(shared, "pdf_url").join(t, F.col("id") == F.col("publication_id"), "left").join(medians, F.col("pub_type") == F.col("kind"))
    rows = rows.selectExpr("id", "stored_source", "stored_words", "id % 11 = 0 AS foreign_host", "CASE WHEN k > 5 THEN k ELSE 1 END AS n_sharing", "id % 7 <> 0 AS found", "id % 400 AS pdf_words", "type_median")
    return M.pdf_decisions(rows)


@query("promoted", """
WITH chosen AS (SELECT max(id) AS id, publication_id FROM enrichments WHERE publication_id % 2 = 0 GROUP BY publication_id)
SELECT e.id, e.publication_id, CASE WHEN c.id IS NULL THEN is_primary ELSE e.id = c.id END AS is_primary FROM enrichments e LEFT JOIN chosen c USING (publication_id)""", "enrichments")
def _(c):
    chosen = c["enrichments"].where("publication_id % 2 = 0").groupBy("publication_id").agg(F.max("id").alias("id"))
    return M.promote(c["enrichments"], chosen).select("id", "publication_id", "is_primary")


@query("stale_blurbs", """
WITH blurbs AS (SELECT publication_id, max(id) AS source_enrichment_id FROM enrichments WHERE publication_id % 3 = 0 GROUP BY publication_id)
SELECT publication_id, source_enrichment_id, coalesce(e.id, -1) AS primary_id FROM blurbs LEFT JOIN (SELECT * FROM enrichments WHERE is_primary) e USING (publication_id) WHERE source_enrichment_id IS DISTINCT FROM e.id""", "enrichments")
def _(c):
    e = c["enrichments"]
    return M.stale_blurbs(e.where("publication_id % 3 = 0").groupBy("publication_id").agg(F.max("id").alias("source_enrichment_id")), e).fillna(-1, ["primary_id"])


@query("attach_problems", """
WITH links AS (SELECT id, id - id % 7 AS parent_id FROM publications WHERE id % 3 = 0)
SELECT l.id, l.parent_id, problem FROM (SELECT l.id, l.parent_id, CASE WHEN l.id = l.parent_id THEN 'itself' WHEN p.id IS NULL THEN 'missing parent' WHEN p.parent_id IS NOT NULL THEN 'nested'
  WHEN l.id IN (SELECT parent_id FROM publications WHERE parent_id IS NOT NULL) THEN 'has chapters' END AS problem FROM links l LEFT JOIN publications p ON l.parent_id = p.id) l WHERE problem IS NOT NULL""", "publications")
def _(c):
    return M.attach_problems(c["publications"], c["publications"].where("id % 3 = 0").selectExpr("id", "id - id % 7 AS parent_id"))


# --- search ---

_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(terms: list[str], every: bool, limit: int) -> str:
    rows = " UNION ALL ".join(f"SELECT id, {k} AS q, 10.0 * len(list_filter(t, lambda x: x = '{w}')) + 1.0 * len(list_filter(b, lambda x: x = '{w}')) AS f FROM docs" for k, w in enumerate(terms))
    return f"""WITH docs AS (SELECT id, {_TOKENS.format('title')} AS t, {_TOKENS.format('body')} AS b FROM documents_),
size AS (SELECT id, len(t) + len(b) AS d FROM docs), total AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
hits AS (SELECT * FROM ({rows}) WHERE f > 0), df AS (SELECT q, ln((any_value(total.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hits, total GROUP BY q),
scored AS (SELECT h.id, -sum(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM hits h JOIN df USING (q) JOIN size s ON h.id = s.id, total
  GROUP BY h.id {f'HAVING count(*) = {len(terms)}' if every else ''}),
top AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9), id) AS position FROM scored ORDER BY position LIMIT {limit})
"""


def _files(spark, path: str) -> str:
    """A digest of the names, sizes and times of a table's files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where))
    return hashlib.md5(repr(found).encode(), usedforsecurity=False).hexdigest()


def stored_index(c):
    """The documents' index, built when first asked for, opened while the
    table's files stay, and brought up to date when they change: a query's
    terms are a filter that the scan of the postings skips by."""
    spark = c["documents_"].sparkSession
    folder = f"{storage.shared_folder(spark)}/lectern/index-{spark.sparkContext.applicationId}-{hashlib.md5(c.folder.encode(), usedforsecurity=False).hexdigest()}"
    return StoredIndex(spark, folder, ("title", "body")).at(c["documents_"].select("id", "title", "body"), _files(spark, f"{c.folder}/documents.parquet"))


def _doc_index(c, stemmed=False):
    return S.Scan(c["documents_"].select("id", "title", "body"), ("title", "body"), stemmed)


def _top(index, text, limit):
    rows = S.match(index, text, (10.0, 1.0)).withColumn("r", F.round("score", 9))
    return rows.orderBy("r", "id").limit(limit).selectExpr("id", "r AS score", "row_number() OVER (ORDER BY r, id) AS position")


@query("keyword_search", _bm25(["with", "idiot"], True, 20) + "SELECT id, round(score, 9) AS score, position FROM top", "documents_")
def _(c):
    return _top(stored_index(c), "with idiot", 20)


@query("keyword_search_any", _bm25(["worthless", "licensed", "moron"], False, 50) + "SELECT id, round(score, 9) AS score, position FROM top", "documents_")
def _(c):
    return _top(stored_index(c), "worthless OR licensed OR moron", 50)


@query("phrase_not_prefix_match", f"""
WITH docs AS (SELECT id, concat(' ', array_to_string({_TOKENS.format('body')}, ' '), ' ') AS b FROM documents_)
SELECT id FROM docs WHERE (contains(b, ' licensed under the ') OR contains(b, ' idio')) AND NOT contains(b, ' gnu ')""", "documents_")
def _(c):
    return S.match(_doc_index(c), '(body: "licensed under the" OR body: idio*) NOT body: gnu', (10.0, 1.0)).select("id")


_SURFACE = r"'(?:[\p{L}\p{N}][\x{0300}-\x{036F}]*)+'"


def _stemmed_bm25(words: list[str], every: bool, limit: int) -> str:
    said = ", ".join(f"'{w}'" for w in words)
    return f"""WITH docs AS (SELECT id, regexp_extract_all(lower(coalesce(title, '')), {_SURFACE}) AS t, regexp_extract_all(lower(coalesce(body, '')), {_SURFACE}) AS b FROM documents_),
size AS (SELECT id, len(t) + len(b) AS d FROM docs), total AS (SELECT count(*) AS n, avg(d) AS mean FROM size),
tokens AS (SELECT id, unnest(t) AS term, 10.0 AS weight FROM docs UNION ALL SELECT id, unnest(b), 1.0 FROM docs),
folded AS (SELECT term, strip_accents(term) AS w FROM (SELECT term FROM tokens UNION SELECT unnest([{said}]))),
{porter('folded', 'stems')},
asked AS (SELECT DISTINCT stem FROM stems WHERE term IN ({said})),
hits AS (SELECT id, stem AS q, sum(weight) AS f FROM tokens JOIN stems USING (term) JOIN asked USING (stem) GROUP BY id, stem),
df AS (SELECT q, ln((any_value(total.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hits, total GROUP BY q),
scored AS (SELECT h.id, -sum(CASE WHEN idf > 0 THEN idf ELSE 1e-6 END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM hits h JOIN df USING (q) JOIN size s ON h.id = s.id, total
  GROUP BY h.id {f'HAVING count(*) = (SELECT count(*) FROM asked)' if every else ''}),
top AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9), id) AS position FROM scored ORDER BY position LIMIT {limit})
SELECT id, round(score, 9) AS score, position FROM top"""


@query("stemmed_search", _stemmed_bm25(["licensing", "public", "works"], True, 30), "documents_")
def _(c):
    return _top(_doc_index(c, True), S.safe_query("licensing public works?"), 30)


@query("index_after_changes", _stemmed_bm25(["worthlessness", "licensing", "morons"], False, 60), "documents_")
def _(c):
    """An index of another state of the table, brought to this one: texts that
    differ, are new or are gone go to one more segment."""
    docs = c["documents_"].select("id", "title", "body")
    other = docs.where("id % 10 <> 3").withColumn("body", F.when(F.col("id") % 7 == 0, F.concat("body", F.lit(" worthless morons"))).otherwise(F.col("body")))
    gone = docs.where("id % 11 = 0").withColumn("id", -1 - F.col("id"))
    spark = docs.sparkSession
    mine = StoredIndex(spark, f"{storage.shared_folder(spark)}/lectern/index-changes-{uuid.uuid4().hex}", ("title", "body"), True)
    mine.rebuild(other.union(gone), "before")
    return _top(mine.update(docs, "after"), "worthlessness OR licensing OR morons", 60)


_SAID = "('worthless', 'licensed', 'moron')"


@query("search_snippets", _bm25(["worthless", "licensed", "moron"], False, 50) + f"""
, texts AS (SELECT d.id, field, coalesce(CASE field WHEN 0 THEN title ELSE body END, '') AS text FROM documents_ d JOIN top USING (id), range(2) AS r(field)),
cut AS (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS words, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS gaps, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS n FROM texts),
places AS (SELECT id, field, n, gaps, i AS spot, lower(words[i + 1]) AS phrase FROM (SELECT *, unnest(range(n)) AS i FROM cut) WHERE lower(words[i + 1]) IN {_SAID}),
tries AS (SELECT id, field, n, spot AS hit, spot AS s, 0 AS kind FROM places UNION ALL
  SELECT * FROM (SELECT id, field, n, spot AS hit, list_max(list_filter(range(spot + 1), lambda x: x = 0 OR regexp_matches(gaps[x + 1], '[.:][ \\t\\r\\n]+$'))) AS s, 1 AS kind FROM places) WHERE n > 12 AND s < hit),
counted AS (SELECT t.id, t.field, t.n, t.hit, t.s, t.kind, count(*) + 999 * count(DISTINCT phrase) + CASE WHEN t.kind = 0 THEN 0 WHEN t.s = 0 THEN 120 ELSE 100 END AS points, min(spot) AS lo, max(spot) + 1 AS hi
  FROM tries t JOIN places p ON t.id = p.id AND t.field = p.field AND p.spot BETWEEN t.s AND t.s + 11 GROUP BY t.id, t.field, t.n, t.hit, t.s, t.kind),
best AS (SELECT id, field, CASE WHEN kind = 1 THEN s ELSE greatest(least(lo - CAST(trunc((12 - (hi - lo)) / 2.0) AS BIGINT), n - 12), 0) END AS opens
  FROM counted QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, field, hit, kind) = 1)
SELECT id, position, CASE WHEN opens > 0 THEN ' … ' ELSE '' END || array_to_string(list_transform(range(opens, least(opens + 12, n)), lambda i:
  CASE WHEN i > opens OR opens = 0 THEN gaps[i + 1] ELSE '' END || CASE WHEN lower(words[i + 1]) IN {_SAID} THEN '[' || words[i + 1] || ']' ELSE words[i + 1] END), '')
  || CASE WHEN opens + 11 >= n - 1 THEN gaps[n + 1] ELSE ' … ' END AS snippet
FROM best JOIN cut USING (id, field) JOIN top USING (id)""", "documents_")
def _(c):
    asked, index = "worthless OR licensed OR moron", stored_index(c)
    top = _top(index, asked, 50).select("id", "position")
    texts = c["documents_"].select("id", "title", "body").join(top.select("id"), "id", "left_semi")
    return top.join(S.snippets(index, texts, asked), "id").select("id", "position", "snippet")


@query("postings", f"""
WITH words AS (SELECT id, unnest({_TOKENS.format('body')}) AS term FROM documents_)
SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM words GROUP BY term""", "documents_")
def _(c):
    return S.term_stats(c["documents_"], "body")


@query("indexed_search", _bm25(["pathetic", "clown"], True, 20) + "SELECT id, round(score, 9) AS score, position FROM top", "documents_")
def _(c):
    return _top(S.Index.build(c["documents_"].select("id", "title", "body"), ("title", "body")), "pathetic clown", 20)


_QUERY_VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _query_vector(c):
    return c["embeddings"].where("vec_id = 7").first().embedding


def _vectors(c):
    return c["embeddings"].select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_VECTOR_RANK = f"SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, {_QUERY_VEC}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS similarity FROM embeddings"


@query("vector_search", f"""
SELECT id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY similarity DESC, id) AS position FROM ({_VECTOR_RANK}) ORDER BY similarity DESC, id LIMIT 25""")
def _(c):
    return R.rank(_vectors(c), _query_vector(c), 25).withColumn("similarity", F.round("similarity", 6))


@query("best_vector_per_label", f"""
SELECT label AS id, round(max(similarity), 6) AS similarity, row_number() OVER (ORDER BY max(similarity) DESC, label) AS position FROM ({_VECTOR_RANK}) v JOIN embeddings e ON v.id = e.vec_id GROUP BY label""")
def _(c):
    own = c["embeddings"].select(F.col("label").alias("id"), F.col("embedding").alias("vector"))
    return R.rank(own, _query_vector(c), None).withColumn("similarity", F.round("similarity", 6))


_RANKERS = " UNION ALL ".join(f"SELECT * FROM (SELECT id, {i} AS ranker, row_number() OVER (ORDER BY similarity DESC, id) AS position FROM ({_VECTOR_RANK}) r JOIN vectors_ v ON v.source_id = r.id WHERE source_type = '{kind}' ORDER BY position LIMIT 30)" for i, kind in ((1, "one_liner"), (2, "section")))


@query("hybrid_find", _bm25(["trash", "scum"], False, 30) + f""", both_ AS (SELECT id, 0 AS ranker, position FROM top UNION ALL {_RANKERS}),
fused AS (SELECT id, sum(1.0 / (60 + position)) + CASE WHEN id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1) THEN 1.0 / 61 - 1.0 / 63 ELSE 0 END AS score,
  min(ranker) AS r, arg_min(position, ranker) AS p, string_agg(CASE ranker WHEN 0 THEN 'K' ELSE concat('V', ranker) END, '' ORDER BY ranker) AS rankers FROM both_ GROUP BY id)
SELECT id, round(score, 9) AS score, rankers, row_number() OVER (ORDER BY round(score, 12) DESC, r, p) AS position FROM fused ORDER BY position LIMIT 10""", "documents_", "vectors_")
def _(c):
    stars = c["labels"].where("quality = 1 AND toxic = 1").selectExpr("doc_id AS publication_id")
    kinds = [c["vectors_"].where(F.col("source_type") == kind).select(F.col("publication_id").alias("id"), "vector") for kind in ("one_liner", "section")]
    hits, _ = R.hybrid(stored_index(c), "trash OR scum", [(v, _query_vector(c)) for v in kinds], 10, stars, (10.0, 1.0))
    return hits.withColumn("score", F.round("score", 9))


_VERDICT = """CASE WHEN mentions = 0 THEN NULL WHEN about >= 8 OR (about >= 3 AND mentions >= 80) OR mentions >= 150 THEN 4 WHEN about >= 2 OR (about >= 1 AND mentions >= 20) THEN 3 ELSE 2 END"""
_POS = """round((band + least(greatest(CASE band WHEN 4 THEN (ln(1 + mentions + 10 * about) - ln(151)) / (ln(1501) - ln(151)) WHEN 3 THEN (about + mentions / 50 - 1) / 7 ELSE (mentions + 10 * about) / 20 END, 0), 1)) / 5, 4)"""


@query("coverage_verdicts", f"""
WITH m AS (SELECT topic_slug, strftime(date_published, '%Y-%m') AS month, count(*) AS mentions, count(*) FILTER (position = 1 AND parent_id IS NULL) AS about
  FROM publication_topics JOIN publications ON publication_id = id GROUP BY 1, 2), t AS (SELECT *, {_VERDICT} AS band FROM m)
SELECT topic_slug, month, mentions, about, band, {_POS} AS pos FROM t""", "publication_topics", "publications")
def _(c):
    rows = c["publication_topics"].join(c["publications"].select("id", "parent_id", F.date_format("date_published", "yyyy-MM").alias("month")), F.col("publication_id") == F.col("id"))
    own = rows.groupBy("topic_slug", "month").agg(F.count("*").alias("mentions"), F.count_if(F.expr("position = 1 AND parent_id IS NULL")).alias("about"))
    return own.withColumn("v", R.verdict(F.col("about"), F.col("mentions"), F.lit(0.0), F.lit(False))).select("topic_slug", "month", "mentions", "about", "v.band", "v.pos")


@query("similarity_verdicts", f"""
SELECT id, CASE WHEN similarity >= 0.4 THEN 1 ELSE 0 END AS band,
  round((CASE WHEN similarity >= 0.4 THEN 1 + least((similarity - 0.4) / 0.25, 1) ELSE greatest((similarity - 0.15) / 0.25, 0) END) / 5, 4) AS pos FROM ({{}})""".format(
    "SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS similarity FROM embeddings"
))
def _(c):
    rows = _vectors(c).select("id", R.similarity(F.col("vector"), _query_vector(c)).alias("s"))
    return rows.select("id", R.verdict(F.lit(0), F.lit(0), F.col("s"), F.lit(False)).alias("v")).select("id", "v.band", "v.pos")


@query("citations", """
WITH marks AS (SELECT conv_id * 100 + turn AS answer_id, unnest(regexp_extract_all(concat('[', turn, '] and [', conv_id % 9, ', ', turn + 1, '] ', text), '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1)) AS m FROM conversations WHERE role = 'assistant'),
cited AS (SELECT DISTINCT answer_id, CAST(trim(unnest(string_split(m, ','))) AS BIGINT) AS cited FROM marks)
SELECT answer_id, cited, (answer_id, cited) IN (SELECT (conv_id * 100 + turn, turn) FROM conversations) AS valid FROM cited""")
def _(c):
    rows = c["conversations"]
    answers = rows.where("role = 'assistant'").selectExpr("conv_id * 100 + turn AS answer_id", "concat('[', turn, '] and [', conv_id % 9, ', ', turn + 1, '] ', text) AS text")
    return R.citations(answers, rows.selectExpr("conv_id * 100 + turn AS answer_id", "turn AS id"))


# --- text functions and documents ---


@query("url_functions", """
SELECT page_id, CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = '' THEN NULL ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) END AS host,
  regexp_extract(trim(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), '([^/]*)$', 1) AS slug FROM pages""")
def _(c):
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return c["pages"].select("page_id", F.when(host != "", host).alias("host"), X.url_slug(F.col("url")).alias("slug"))


@query("slugs_and_words", r"""
SELECT doc_id, rtrim(substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') AS slug,
  len(regexp_extract_all(text, '[^@]+')) AS words, length(text) - length(replace(text, ' ', '')) + 1 AS spaces FROM documents""".replace("@", X.SPACES))
def _(c):
    return c["documents"].select("doc_id", X.slugify(F.col("text")).alias("slug"), X.word_count(F.col("text")).cast("long").alias("words"), X.spaces_count(F.col("text")).cast("long").alias("spaces"))


@query("quarters", f"SELECT id, {_QUARTER} AS quarter, CAST((month(date_published) + 2) // 3 AS INT) AS q FROM publications", "publications")
def _(c):
    return c["publications"].select("id", X.quarter_of(F.col("date_published")).alias("quarter"), F.expr("cast((month(date_published) + 2) div 3 AS int)").alias("q"))


@query("grounding", """
WITH w AS (SELECT doc_id, ['idiot', 'scum', 'the', 'of', 'licensed'] AS names, lower(text) AS t FROM documents)
SELECT doc_id, round(len(list_filter(names, lambda x: contains(t, x))) / 5, 3) AS ratio FROM w""")
def _(c):
    names = F.array(*[F.lit(x) for x in ("Idiot", "Scum", "the", "of", "Licensed")])
    return c["documents"].select("doc_id", rules.grounding(names, F.col("text")).alias("ratio"))


@query("topic_problems", """
WITH t AS (SELECT publication_id, list(topic_slug ORDER BY position, topic_slug) AS s FROM publication_topics GROUP BY publication_id)
SELECT publication_id, array_to_string(list_filter([CASE WHEN len(s) > 4 THEN 'not 1 to 4 topics' END, CASE WHEN list_contains(s, 'Brand#25') THEN 'a topic is unknown' END], lambda x: x IS NOT NULL), ';') AS problems FROM t""", "publication_topics")
def _(c):
    lists = V.topic_arrays(c).select("publication_id", F.split("topics", ",").alias("s"))
    known = [f"Brand#{i}" for i in range(1, 25)]
    return lists.select("publication_id", F.array_join(rules.topic_problems(F.col("s"), known), ";").alias("problems"))


@query("first_words", r"""
SELECT doc_id, array_to_string(list_slice(string_split(trim(regexp_replace(text, '[@]+', ' ', 'g')), ' '), 1, 12), ' ') AS opening FROM documents""".replace("@", X.SPACES))
def _(c):
    return c["documents"].select("doc_id", X.first_words(F.col("text"), 12).alias("opening"))


@query("page_markdown")
def _(c):
    return D.markdown(c["pages"])


@query("page_links")
def _(c):
    return D.links(c["pages"], True)


@query("document_sections")
def _(c):
    return D.sections(c["documents"].selectExpr("doc_id AS publication_id", "text AS body"))


# --- composites ---


@query("flagged_summaries", """
WITH last AS (SELECT subject_id, arg_max(verdict, (created_at, id)) AS verdict, arg_max(note, (created_at, id)) AS note FROM reviews WHERE scope = 'enrichment' GROUP BY subject_id)
SELECT e.id, publication_id, note FROM last JOIN enrichments e ON subject_id = e.id WHERE verdict = 'flagged'""", "reviews", "enrichments")
def _(c):
    return V.flagged(c)


@query("backlog", f"""WITH {_NORMS}, parked AS (SELECT subject_id AS id FROM reviews WHERE scope = 'backlog'), rows AS (
SELECT 'thin' AS kind, id FROM publications JOIN publication_text ON publication_id = id JOIN norms USING (pub_type) WHERE access = 'public' AND word_count < floor(median_words * 0.25)
UNION ALL SELECT 'paywalled', id FROM publications WHERE access <> 'public' AND id NOT IN (SELECT publication_id FROM publication_text WHERE word_count > 0))
SELECT kind, id FROM rows WHERE id NOT IN (SELECT id FROM parked)""", "publications", "publication_text", "reviews")
def _(c):
    return V.backlog(c, c["reviews"].where("scope = 'backlog'").selectExpr("subject_id AS id"))


@query("glossary", """
SELECT slug, label, cluster, coalesce(n, 0) AS n, coalesce(n_primary, 0) AS n_primary FROM topics
LEFT JOIN (SELECT topic_slug, count(*) AS n, count(*) FILTER (position = 1) AS n_primary FROM publication_topics GROUP BY 1) ON slug = topic_slug""", "topics", "publication_topics")
def _(c):
    return V.glossary(c)


_NOTES = """notes AS (SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN concat(2024 + event_id % 3, '-Q', 1 + event_id % 4) END AS expected, CAST(ts AS DATE) AS created_at,
  CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) + CAST(user_id AS INT) END AS landed_at, CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END AS shelved_at FROM events)"""


def _notes(c):
    return c["events"].selectExpr("event_id AS id", "CASE WHEN event_id % 7 <> 0 THEN concat(2024 + event_id % 3, '-Q', 1 + event_id % 4) END AS expected", "CAST(ts AS DATE) AS created_at",
                                  "CASE WHEN event_type = 'purchase' THEN date_add(CAST(ts AS DATE), CAST(user_id AS INT)) END AS landed_at", "CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END AS shelved_at")


@query("note_status", f"""WITH {_NOTES} SELECT id, CASE WHEN landed_at IS NOT NULL THEN 'landed' WHEN shelved_at IS NOT NULL THEN 'shelved' WHEN expected < '2024-Q4' THEN 'overdue' ELSE 'open' END AS status,
date_diff('day', created_at, DATE '2024-10-15') AS age_days, coalesce(date_diff('day', created_at, landed_at), -1) AS lead_days,
CASE WHEN landed_at IS NULL OR expected IS NULL THEN 'open' WHEN concat(year(landed_at), '-Q', quarter(landed_at)) <= expected THEN 'yes' ELSE 'no' END AS on_time FROM notes""")
def _(c):
    return M.note_status(_notes(c), "2024-10-15").select("id", "status", F.col("age_days").cast("long"), F.coalesce(F.col("lead_days").cast("long"), F.lit(-1)).alias("lead_days"), F.when(F.col("on_time").isNull(), "open").when(F.col("on_time"), "yes").otherwise("no").alias("on_time"))


@query("note_stats", f"""WITH {_NOTES} SELECT count(*) AS landed, median(date_diff('day', created_at, landed_at)) AS median_lead, count(*) FILTER (concat(year(landed_at), '-Q', quarter(landed_at)) <= expected) AS on_time,
count(expected) AS judged FROM notes WHERE landed_at IS NOT NULL""")
def _(c):
    return M.note_stats(M.note_status(_notes(c), "2024-10-15"))


@query("upcoming_edge", f"""WITH {_NOTES} SELECT CASE id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS topic_slug, expected AS quarter, count(*) AS n FROM notes
WHERE landed_at IS NULL AND shelved_at IS NULL AND (expected IS NULL OR expected BETWEEN '2024-Q4' AND '2026-Q4') GROUP BY ALL""")
def _(c):
    topics = c["events"].selectExpr("event_id AS note_id", "CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS topic_slug")
    return V.upcoming_edge(_notes(c), topics, "2024-Q4")


@query("collections_by_precedence", """
WITH current AS (SELECT custkey, orderkey AS slug, src FROM (SELECT o_custkey AS custkey, o_orderkey % 40 AS orderkey, CASE WHEN max(o_orderstatus) = 'P' THEN 'manual' ELSE 'auto' END AS src FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)),
new AS (SELECT o_custkey AS custkey, o_orderkey % 40 AS slug, CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'manual' ELSE 'auto' END AS src FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)
SELECT custkey, slug, CASE WHEN c.src IS NULL THEN n.src WHEN n.src = 'manual' THEN 'manual' ELSE c.src END AS source, coalesce(c.src IS NULL OR n.src = 'manual', false) AS renewed FROM current c FULL JOIN new n USING (custkey, slug)""")
def _(c):
    o = c["orders"]
    own = lambda rows, best, renewed: rows.groupBy(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 40).alias("slug")).agg(F.when(best, "manual").otherwise("auto").alias("source")).withColumn("renewed", F.lit(renewed))
    return M.by_precedence(own(o.where("o_orderkey % 2 = 0"), F.max("o_orderstatus") == "P", False), own(o.where("o_orderkey % 3 = 0"), F.max("o_orderpriority") == "5-LOW", True), ["custkey", "slug"])


@query("cascade_delete", """
WITH gone AS (SELECT id FROM publications WHERE id % 32 = 0)
SELECT 'publications' AS name, count(*) AS n, count(parent_id) - count(CASE WHEN parent_id IN (FROM gone) THEN 1 END) AS children FROM publications WHERE id NOT IN (FROM gone)
UNION ALL SELECT 'credits', count(*), 0 FROM credits WHERE publication_id NOT IN (FROM gone)
UNION ALL SELECT 'publication_topics', count(*), 0 FROM publication_topics WHERE publication_id NOT IN (FROM gone)""", "publications", "credits", "publication_topics")
def _(c):
    out = M.cascaded({k: c[k] for k in ("publications", "credits", "publication_topics")}, c["publications"].where("id % 32 = 0"))
    rows = out["publications"].agg(F.lit("publications").alias("name"), F.count("*").alias("n"), F.count("parent_id").alias("children"))
    for k in ("credits", "publication_topics"):
        rows = rows.union(out[k].agg(F.lit(k), F.count("*"), F.lit(0).cast("long")))
    return rows


_TERMS = ("watch", "finance", "370", "27", "zebra")
_WORDS = "regexp_extract_all(lower(concat_ws(' ', title, series)), '[a-z0-9]+')"


@query("coverage_view", f"""
WITH terms AS (SELECT unnest({list(_TERMS)}) AS term),
direct AS (SELECT DISTINCT term, coalesce(parent_id, id) AS id FROM publications, terms WHERE list_contains({_WORDS}, term)),
about AS (SELECT DISTINCT term, coalesce(parent_id, id) AS id FROM publications, terms WHERE list_contains(regexp_extract_all(lower(title), '[a-z0-9]+'), term)),
d AS (SELECT term, count(*) AS mentions, CAST(sum({_WEIGHT}) AS BIGINT) AS weighted FROM direct JOIN publications USING (id) GROUP BY term),
a AS (SELECT term, count(*) AS about FROM about GROUP BY term),
n AS (SELECT term, coalesce(mentions, 0) AS mentions, coalesce(weighted, 0) AS weighted, coalesce(about, 0) AS about FROM terms LEFT JOIN d USING (term) LEFT JOIN a USING (term)),
t AS (SELECT *, {_VERDICT} AS band FROM n)
SELECT term, mentions, weighted, about, coalesce(band, -1) AS band, coalesce({_POS}, -1) AS pos FROM t""", "publications")
def _(c):
    index = S.Scan(c["publications"].select("id", "title", "series"), ("title", "series"))
    rows = None
    for term in _TERMS:
        direct = S.match(index, term, (1.0, 1.0)).select("id")
        about = S.match(index, "{title} : (" + term + ")", (1.0, 1.0)).select("id")
        one = V.coverage(c, direct, about, None).select(F.lit(term).alias("term"), "mentions", "weighted", "about", "verdict.band", "verdict.pos")
        rows = one if rows is None else rows.union(one)
    return rows.fillna(-1, ["band"]).fillna(-1.0, ["pos"])


@query("neighbours", f"""
WITH s AS ({_VECTOR_RANK}), near AS (SELECT s.id, round(similarity, 3) AS similarity, title, pub_type, strftime(date_published, '%Y-%m') AS month FROM s JOIN publications USING (id) WHERE {_SCOPE}
  ORDER BY s.similarity DESC, s.id LIMIT 12)
SELECT near.*, label AS topic, summary, x, y FROM near
LEFT JOIN (SELECT publication_id, label FROM publication_topics JOIN topics ON topic_slug = slug WHERE position = 1) t ON t.publication_id = near.id
LEFT JOIN (SELECT publication_id, summary FROM enrichments WHERE is_primary) e ON e.publication_id = near.id LEFT JOIN landscape_coords l ON l.publication_id = near.id""", "publications", "publication_topics", "topics", "enrichments", "landscape_coords")
def _(c):
    rows = _vectors(c).select("id", R.similarity(F.col("vector"), _query_vector(c)).alias("similarity"))
    return V.neighbours(c, rows)


@query("semantic_search", f"""
WITH s AS (SELECT v.*, similarity FROM vectors_ v JOIN ({_VECTOR_RANK}) r ON r.id = v.source_id WHERE source_type = 'section' ORDER BY similarity DESC, source_id LIMIT 48),
best AS (SELECT publication_id, max(similarity) AS similarity, arg_max(source_id, (similarity, -source_id)) AS source_id FROM s GROUP BY publication_id)
SELECT b.publication_id, source_id, round(b.similarity, 6) AS similarity, row_number() OVER (ORDER BY b.similarity DESC, source_id) AS position, title, pub_type, date_published, heading, body FROM
(SELECT * FROM best ORDER BY similarity DESC, source_id LIMIT 8) b JOIN publications p ON p.id = b.publication_id LEFT JOIN sections_ x ON x.id = b.source_id""", "vectors_", "publications", "sections_")
def _(c):
    return R.semantic_search(_whole(c), _query_vector(c), 8).withColumn("similarity", F.round("similarity", 6))
