"""From fetched pages to catalog tables: one step for any number of pages.

Fetching is the caller's; these are transforms of (catalog, pages), and what
could not be taken in comes back as refusals with their reasons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from ..sources import records as R
from . import documents as D
from . import state as M

Catalog = dict[str, DataFrame]


def waiting(urls: DataFrame) -> DataFrame:
    """Pages at the root of the site that were settled as publications and
    are not in yet: the worklist of ingest(), the longest first."""
    own = urls.where("scope = 'root-level' AND status = 'pending' AND disposition = 'ingest' AND settled_at IS NOT NULL")
    return own.select("url", F.col("proposed_type").alias("pub_type"), F.col("proposed_series").alias("series"), "note", "probe_words").orderBy(F.desc("probe_words"), "url")


def open_urls(urls: DataFrame, include_settled: bool = False) -> DataFrame:
    """Pages at the root of the site that wait for a decision."""
    own = urls.where("scope = 'root-level' AND status = 'pending'")
    return own if include_settled else own.where("settled_at IS NULL")


def ingest(c: Catalog, pages: DataFrame, markup: R.Markup, now: str) -> tuple[Catalog, DataFrame]:
    """(catalog, refused) after pages(url, final_url, html, pub_type, series,
    note). A page that redirects elsewhere, or that has no record, is refused
    as (url, problem). A type given with a page stands for the page's own. The
    record is upserted by url with its people and tags, its text by
    precedence, its sections are replaced, and its url is done and settled."""
    rows = pages.withColumn("page_id", F.xxhash64("url"))
    own = R.records(rows, markup, given=True).select("url", "slug", "record", "problem", "date_published")
    moved = F.col("final_url").isNotNull() & ~X.same_page(F.col("url"), F.col("final_url"))
    judged = pages.join(own, "url").withColumn("problem", F.when(moved, F.concat(F.lit("redirects to "), "final_url")).otherwise(F.col("problem")))
    judged = storage.stored(judged, "ingested")
    refused = judged.where("problem IS NOT NULL").select("url", "problem")
    good = judged.where("problem IS NULL")
    fields = ("title", "subtitle", "pub_type", "series", "access", "pdf_url", "description")
    people = F.transform("record.people", lambda p: F.struct(*[p[x].alias(x) for x in ("slug", "name", "is_internal", "job_title", "role")]))
    new = good.select("url", "slug", "date_published", *[F.col(f"record.{f}").alias(f) for f in fields], people.alias("people"), F.col("record.site_tags").alias("site_tags"))
    out = M.upsert_publications(c, new, now)
    ids = out["publications"].select("url", F.col("id").alias("page_id"))
    bodies = D.markdown(good.join(ids, "url").select("page_id", "html")).select(F.col("page_id").alias("publication_id"), F.col("text").alias("body"), X.word_count(F.col("text")).cast("long").alias("word_count"), F.lit("html").alias("source"))
    bodies = storage.stored(bodies, "bodies")
    texts = M.upsert_text(c["publication_text"].select("publication_id", "body", "word_count", "source"), bodies)
    out["publication_text"] = _shaped(texts, c["publication_text"])
    first = c["sections"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    pieces = storage.numbered(D.sections(bodies.select("publication_id", "body")), ["publication_id", "position"], "id", first)
    kept = c["sections"].join(bodies.select("publication_id"), "publication_id", "left_anti")
    out["sections"] = kept.select(*c["sections"].columns).unionByName(_shaped(pieces, c["sections"]))
    decisions = good.select("url", F.lit("ingest").alias("disposition"), "note")
    urls = M.decided(c["sitemap_urls"], decisions, now)
    done = good.select("url", F.lit(True).alias("done"))
    out["sitemap_urls"] = urls.join(done, "url", "left").withColumn("status", F.when(F.col("done"), "done").otherwise(F.col("status"))).select(*urls.columns)
    return out, refused


def _shaped(rows: DataFrame, like: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(x) if x in rows.columns else F.lit(None)).cast(like.schema[x].dataType).alias(x) for x in like.columns])


def add_pdf_record(c: Catalog, url: str, now: str, **fields) -> Catalog:
    """The catalog with a publication that has no page but a PDF, whose
    address is its own; fields are those of a publication."""
    spark = c["publications"].sparkSession
    known = {f.name: f.dataType.simpleString() for f in c["publications"].schema}
    if unknown := sorted(set(fields) - set(known)):
        raise ValueError(f"no such field: {', '.join(unknown)}")
    if not (fields.get("title") or "").strip():
        raise ValueError("a publication needs a title")
    one = spark.range(1).select(F.lit(url).alias("url"), *[F.lit(v).cast(known[k]).alias(k) for k, v in fields.items()])
    slug = F.regexp_replace(X.url_slug(F.col("url")), r"(?i)\.pdf$", "")
    one = one.withColumns({"slug": slug, "pdf_url": F.col("url"), "access": F.lit(fields.get("access") or "public")})
    nobody = F.from_json(F.lit("[]"), "array<struct<slug:string,name:string,is_internal:boolean,job_title:string,role:string>>")
    return M.upsert_publications(c, one.withColumns({"people": nobody, "site_tags": F.from_json(F.lit("[]"), "array<string>")}), now)


def find_publication(publications: DataFrame, ref: str | int) -> int:
    """The id behind an id, a url or a slug; ValueError if there is none."""
    text = str(ref).strip()
    slug = text.split("?")[0].split("#")[0].rstrip("/").rsplit("/", 1)[-1]
    wanted = (F.col("id") == int(text)) if text.isdigit() else (F.col("url") == text) | (F.col("slug") == slug)
    row = publications.where(wanted).orderBy(F.col("url") != text, "id").select("id").first()
    if row is None:
        raise ValueError(f"no publication is {ref!r}")
    return row.id


def attach_chapters(publications: DataFrame, parent: int, chapters: list[int]) -> DataFrame:
    """publications with chapters in the order given; ValueError where one
    can't be a chapter of that parent."""
    spark = publications.sparkSession
    links = spark.createDataFrame([(x, parent, i) for i, x in enumerate(dict.fromkeys(chapters), 1)], "id long, parent_id long, at int")
    known = {r.id for r in publications.join(links.select("id"), "id", "left_semi").select("id").collect()}
    missing = [f"{x}: no such publication" for x in chapters if x not in known]
    wrong = [f"{r.id}: {r.problem}" for r in M.attach_problems(publications, links.select("id", "parent_id")).collect()]
    if missing or wrong:
        raise ValueError("; ".join([*missing, *wrong]))
    new = links.select("id", F.col("parent_id").alias("to"), "at")
    return publications.join(new, "id", "left").withColumns({"parent_id": F.coalesce("to", "parent_id"), "parent_position": F.coalesce("at", "parent_position")}).select(*publications.columns)


def detach_chapters(publications: DataFrame, chapters: list[int]) -> DataFrame:
    gone = F.col("id").isin(chapters)
    return publications.withColumns({c: F.when(~gone, F.col(c)) for c in ("parent_id", "parent_position")}).select(*publications.columns)
