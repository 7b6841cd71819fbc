"""The catalog's tables, one explicit schema each, and their version.

Schemas are declared, never inferred. A migration is a pure function of the
tables; ``migrate`` applies those a stored version has not seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "publications": "id long, slug string, url string, title string, subtitle string, date_published date, pub_type string, series string, is_flagship boolean, access string, pdf_url string, pdf_path string, description string, sitemap_lastmod string, scraped_at timestamp, parent_id long, parent_position int",
    "people": "id long, slug string, name string, is_internal boolean, job_title string, affiliation string, is_current boolean, roster_title string, roster_source string, merged_into long",
    "credits": "publication_id long, person_id long, role string, position int, source string",
    "site_tags": "id long, name string",
    "publication_site_tags": "publication_id long, tag_id long",
    "sitemap_urls": "url string, path_prefix string, lastmod string, scope string, status string, scraped_lastmod string, last_error string, first_seen string, last_seen string, probe_words int, probe_has_date boolean, probe_title string, probe_subtitle string, proposed_type string, proposed_series string, disposition string, note string, settled_at timestamp",
    "publication_text": "publication_id long, body string, word_count long, source string, extracted_at timestamp",
    "sections": "id long, publication_id long, position int, heading string, level int, body string, word_count int, independent boolean, is_boilerplate boolean, chunk_index int, chunk_total int",
    "enrichments": "id long, publication_id long, is_primary boolean, one_liner string, summary string, key_findings array<string>, entities map<string,array<string>>, model string, provider string, prompt_version string, words_sent int, prompt_tokens long, completion_tokens long, attempts int, seconds double, enriched_at timestamp",
    "publication_topics": "publication_id long, topic_slug string, position int, model string, prompt_version string, mapped_at timestamp",
    "blurbs": "publication_id long, blurb string, source_enrichment_id long, model string, written_at timestamp",
    "embeddings": "source_type string, source_id long, publication_id long, model string, dim int, vector array<float>, embedded_at timestamp",
    "reviews": "id long, scope string, subject_id long, verdict string, note string, created_at timestamp",
    "shortlist": "publication_id long, note string, added_at timestamp",
    "settings": "key string, value string",
    "collections": "slug string, name string, url string, blurb string, source string",
    "publication_collections": "publication_id long, slug string, source string",
    "landscape_coords": "publication_id long, x double, y double, placed string, computed_at timestamp",
    "notes": "id long, working_title string, note string, expected string, created_at date, updated_at date, landed_at date, shelved_at date, publication_id long, shelved_reason string",
    "note_topics": "note_id long, topic_slug string",
    "note_people": "note_id long, person_id long",
}


def struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def _every_summary_primary(c: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """From one summary per publication to several: the rows there are become
    primary, and reviews point at summaries instead of publications; verdicts
    about nothing are dropped."""
    first = c["enrichments"].select(F.col("publication_id").alias("subject_id"), F.col("id").alias("enrichment_id"))
    own = c["reviews"].where("scope = 'enrichment'").join(first, "subject_id").withColumn("subject_id", F.col("enrichment_id")).drop("enrichment_id")
    rest = c["reviews"].where("scope <> 'enrichment'")
    return c | {"enrichments": c["enrichments"].withColumn("is_primary", F.lit(True)), "reviews": rest.unionByName(own)}


def _reasons_of_shelving(c: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Shelved notes say why."""
    return c | {"notes": c["notes"] if "shelved_reason" in c["notes"].columns else c["notes"].withColumn("shelved_reason", F.lit(None).cast("string"))}


#: In order; the version of a catalog is how many it has seen.
MIGRATIONS: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame]]] = [_every_summary_primary, _reasons_of_shelving]


def migrate(catalog: dict[str, DataFrame], version: int) -> tuple[dict[str, DataFrame], int]:
    for step in MIGRATIONS[version:]:
        catalog = step(catalog)
    return catalog, len(MIGRATIONS)
