"""Binds the driver's tables to catalog roles, in SQL both engines run.

``VIEWS`` maps a role to its SELECT. ``load`` gives the roles as DataFrames,
``prelude`` the same roles as common table expressions for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "publications": """
        SELECT o_orderkey AS id, concat('pub-', o_orderkey) AS slug, concat('https://example.org/en/report/pub-', o_orderkey) AS url,
               concat(CASE o_orderstatus WHEN 'F' THEN 'Finance' WHEN 'O' THEN 'Outlook' ELSE 'Policy' END, ' paper ', o_custkey) AS title,
               CAST(o_orderdate AS DATE) AS date_published,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'Report' WHEN '2-HIGH' THEN 'Comment' WHEN '3-MEDIUM' THEN 'Tracker'
                    WHEN '4-NOT SPECIFIED' THEN 'Podcast' ELSE 'External' END AS pub_type,
               CASE o_orderstatus WHEN 'F' THEN 'Finance Watch' WHEN 'O' THEN 'Outlook' END AS series,
               CASE WHEN o_custkey % 10 = 0 THEN 'member' ELSE 'public' END AS access,
               CASE WHEN o_orderkey % 16 IN (5, 6) THEN o_orderkey - o_orderkey % 16 END AS parent_id,
               CASE WHEN o_orderkey % 16 IN (5, 6) THEN o_orderkey % 16 - 4 END AS parent_position,
               CASE WHEN o_custkey % 3 = 0 THEN concat('https://example.org/pdf/', o_custkey) END AS pdf_url,
               CASE WHEN o_custkey % 4 = 0 THEN concat('About ', o_custkey) END AS description
        FROM orders""",
    "credits": """
        SELECT l_orderkey AS publication_id, l_suppkey AS person_id,
               CASE l_returnflag WHEN 'A' THEN 'author' WHEN 'R' THEN 'guest' ELSE 'host' END AS role, MIN(l_linenumber) AS position,
               CASE WHEN l_suppkey % 7 = 0 THEN 'manual' ELSE 'parsed' END AS source
        FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag""",
    "people": """
        SELECT s_suppkey AS id, s_name AS name, concat('person-', s_suppkey) AS slug, s_acctbal > 0 AS is_internal,
               s_acctbal > 1000 AS is_current, CASE WHEN s_suppkey % 20 = 19 THEN s_suppkey - 1 END AS merged_into,
               CASE n_regionkey WHEN 0 THEN 'staff' WHEN 1 THEN 'affiliate' WHEN 2 THEN 'external' ELSE 'unknown' END AS affiliation
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "publication_topics": """
        SELECT l_orderkey AS publication_id, p_brand AS topic_slug, MIN(l_linenumber) AS position
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand""",
    "topics": """
        SELECT DISTINCT p_brand AS slug, concat('Topic ', replace(p_brand, 'Brand#', '')) AS label,
               CAST(replace(p_brand, 'Brand#', '') AS INT) % 6 AS cluster
        FROM part WHERE p_brand <> 'Brand#25'""",
    "publication_text": """
        SELECT l_orderkey AS publication_id, CAST(SUM(l_quantity) AS BIGINT) AS word_count,
               CASE MIN(l_returnflag) WHEN 'A' THEN 'html' WHEN 'N' THEN 'pdf' ELSE 'manual' END AS source
        FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_orderkey""",
    "enrichments": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS publication_id, l_linenumber = 1 AS is_primary,
               concat('model-', MIN(l_linestatus)) AS model, MIN(p_name) AS summary, concat('On ', MIN(p_brand)) AS one_liner, CAST(SUM(l_quantity) AS BIGINT) AS prompt_tokens,
               CAST(SUM(l_suppkey) AS BIGINT) AS completion_tokens, CAST(MIN(l_partkey) % 90 + 5 AS BIGINT) AS seconds, MAX(l_shipdate) AS enriched_at
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 3 GROUP BY l_orderkey, l_linenumber""",
    "reviews": """
        SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'enrichment' ELSE 'backlog' END AS scope, user_id AS subject_id,
               CASE WHEN event_type IN ('view', 'signup') THEN 'confirmed' ELSE 'flagged' END AS verdict, props AS note, ts AS created_at
        FROM events""",
    "sitemap_seen": """
        SELECT user_id AS n, concat('https://example.org/en/report/u', user_id) AS url, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS lastmod,
               event_type AS kind, event_id AS seen
        FROM events""",
    "site_tags": "SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10 AS id, concat('Tag ', CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10) AS name FROM part",
    "publication_site_tags": "SELECT DISTINCT l_orderkey AS publication_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) % 10 AS tag_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    "collections": "SELECT concat('c', n_nationkey) AS slug, n_name AS name FROM nation UNION ALL SELECT concat('r', r_regionkey), r_name FROM region",
    "publication_collections": """
        SELECT o_orderkey AS publication_id, concat('c', c_nationkey) AS slug, CASE WHEN o_custkey % 2 = 0 THEN 'manual' ELSE 'auto' END AS source
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000""",
    "shortlist": "SELECT doc_id AS publication_id, concat('q', quality) AS note, toxic AS added_at FROM labels",
    "sitemap_urls": """
        SELECT concat('https://example.org/en/', event_id) AS url, CASE user_id % 3 WHEN 0 THEN 'root-level' WHEN 1 THEN 'publication' ELSE 'excluded' END AS scope,
               CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'gone' ELSE 'skipped' END AS status,
               CASE WHEN event_id % 5 = 0 THEN 'exclude' WHEN event_id % 5 = 1 THEN 'ingest' END AS disposition
        FROM events""",
    "sections_": "SELECT conv_id * 1000 + turn AS id, conv_id AS publication_id, role AS heading, text AS body, role = 'system' AS is_boilerplate FROM conversations",
    "vectors_": "SELECT CASE WHEN label < 5 THEN 'section' ELSE 'one_liner' END AS source_type, vec_id AS source_id, vec_id AS publication_id, embedding AS vector FROM embeddings",
    "landscape_coords": "SELECT vec_id AS publication_id, CAST(label AS DOUBLE) AS x, CAST(vec_id % 17 AS DOUBLE) AS y FROM embeddings",
    "documents_": "SELECT doc_id AS id, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title, text AS body, lang, source FROM documents",
}


class Roles(dict):
    """Tables and roles as DataFrames, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self.folder = spark, sf_dir

    def __contains__(self, name: object) -> bool:
        return name in TABLES or name in VIEWS or super().__contains__(name)

    def catalog(self, **others: str) -> dict[str, DataFrame]:
        """All roles by name; others: the role that stands for a name."""
        return {name: self[name] for name in VIEWS} | {name: self[role] for name, role in others.items()}

    def __missing__(self, name: str) -> DataFrame:
        if name in TABLES:
            self[name] = self._spark.read.parquet(f"{self.folder}/{name}.parquet")
        else:
            text = VIEWS[name]
            own = {t for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", text)}
            for t in own:
                text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            self[name] = self._spark.sql(text, **{t: self[t] for t in own})
        return self[name]


def load(spark: SparkSession, sf_dir: str) -> Roles:
    return Roles(spark, sf_dir)


def prelude(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
