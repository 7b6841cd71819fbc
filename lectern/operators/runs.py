"""Runs over a catalog, from worklist to one commit.

Each step gives the tables it changes; ``snapshot.save`` writes them as one
version, whose marker comes last, so a summary, its promotion and the vectors
and topics it makes void are there together or not at all. What could not be
done comes back as refusals (publication_id, id, problem).

``scrape`` works in batches. The pages of a batch are stored before anything is
made of them, and the version that takes them in also notes the batch, so a
run that is killed in between takes them in from the store and fetches nothing
twice. Only a batch that was not wholly fetched is fetched again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import dom, rules
from ..functions import text as X
from ..sources import records as R
from ..sources import snapshot
from ..sources.readers import embedded
from . import documents as D
from . import ingest as I
from . import loops as L
from . import state as M
from . import views as V

Tables = dict[str, DataFrame]
#: (status, final url, html); it may raise, and is called inside a partition.
Fetch = Callable[[str], tuple[int, str, str]]

PAGE = "url string, http_status int, final_url string, html string, error string"
REFUSED = "publication_id long, id long, problem string"
BATCH_KEY = "scraped_batch"
BATCH = 200


# ------------------------------------------------------------------- summaries


def _void(c: Tables, changed: DataFrame) -> Tables:
    vectors, topics = M.resummarised(c["embeddings"], c["publication_topics"], changed)
    return {"embeddings": vectors, "publication_topics": topics}


def summarised(c: Tables, made: DataFrame, now: str) -> tuple[Tables, DataFrame]:
    """After new primary summaries made(publication_id, one_liner, summary, …):
    replaced rows keep their ids; their one-liner's vector and their topics
    go. See M.upsert_primary for what is refused."""
    rows, refused, changed = M.upsert_primary(c["enrichments"], made, now)
    return {"enrichments": rows} | _void(c, changed), refused


def regenerated(c: Tables, made: DataFrame, now: str) -> tuple[Tables, DataFrame]:
    """After summaries that are candidates beside the primary ones, which stay
    as they are. A publication that has none gets its first as primary."""
    return {"enrichments": M.add_candidates(c["enrichments"], made, now)}, made.sparkSession.createDataFrame([], REFUSED)


def promoted(c: Tables, chosen: DataFrame) -> tuple[Tables, DataFrame]:
    """After chosen(publication_id, id) became primary. The summaries they
    replace stay as candidates, with the verdicts on them; vectors of their
    one-liners and topics go. Refused: an id that is not there or belongs to
    another publication, and all of several for one publication; one that is
    primary already changes nothing."""
    own = c["enrichments"].select("id", F.col("publication_id").alias("owner"), "is_primary")
    asked = chosen.select("publication_id", "id").distinct()
    many = asked.groupBy("publication_id").agg((F.count("*") > 1).alias("many"))
    judged = asked.join(own, "id", "left").join(many, "publication_id")
    problem = F.when(F.col("owner").isNull(), "no such summary").when(F.col("owner") != F.col("publication_id"), "of another publication").when(F.col("many"), "several for one publication")
    judged = storage.stored(judged.withColumn("problem", problem), "chosen")
    good = judged.where("problem IS NULL AND NOT is_primary")
    return {"enrichments": M.promote(c["enrichments"], good.select("id"))} | _void(c, good), judged.where("problem IS NOT NULL").select("publication_id", "id", "problem")


def _answered(worklist: DataFrame, chat: L.Chat, check: L.Check) -> tuple[DataFrame, DataFrame]:
    """(valid, refused) answers, stored: a model is asked once."""
    rows = storage.stored(L.ask(worklist, chat, check), "answers")
    refused = rows.where("error IS NOT NULL").select(F.col("id").alias("publication_id"), F.lit(None).cast("long").alias("id"), F.col("error").alias("problem"))
    return rows.where("error IS NULL"), refused


def _prompts(c: Tables, ids: DataFrame) -> DataFrame:
    """(id, prompt) for publications ids(id), with the executive summary and
    the outline of a long one."""
    texts = c["publication_text"].select(F.col("publication_id").alias("id"), "body")
    executive = L.copies_of_executive_summaries(c, c["sections"]).select(F.col("publication_id").alias("id"), F.col("body").alias("executive"))
    outline = D.outlines(c["sections"]).select(F.col("publication_id").alias("id"), "outline")
    rows = ids.join(c["publications"].select("id", "title"), "id").join(texts, "id").join(executive, "id", "left").join(outline, "id", "left")
    return rows.select("id", rules.enrichment_prompt(F.col("title"), F.col("body"), F.col("executive"), F.col("outline")).alias("prompt"))


def _summary_fields(c: Tables, todo: DataFrame) -> DataFrame:
    """todo(publication_id, id), the ids of summaries, with what prompts show."""
    own = c["enrichments"].select("id", "one_liner", "summary", "key_findings")
    return todo.join(own, "id").join(c["publications"].select(F.col("id").alias("publication_id"), "title", "subtitle", "pub_type", "date_published"), "publication_id")


def enrich(c: Tables, chat: L.Chat, model: str, prompt_version: str, now: str, limit: int | None = None) -> tuple[Tables, DataFrame]:
    """A summary for every text that has none; refused ones stay on the list."""
    todo = L.to_summarise(c).select(F.col("publication_id").alias("id"))
    good, refused = _answered(_prompts(c, todo if limit is None else todo.orderBy("id").limit(limit)), chat, L.summary_check)
    tables, more = summarised(c, L.summaries(good, model, prompt_version), now)
    return tables, refused.unionByName(more)


def regenerate(c: Tables, publication: int, chat: L.Chat, model: str, prompt_version: str, now: str) -> tuple[Tables, DataFrame]:
    """A candidate for one publication."""
    todo = c["publication_text"].where((F.col("publication_id") == publication) & (F.col("word_count") > 0)).select(F.col("publication_id").alias("id"))
    good, refused = _answered(_prompts(c, todo), chat, L.summary_check)
    tables, more = regenerated(c, L.summaries(good, model, prompt_version), now)
    return tables, refused.unionByName(more)


def map_topics(c: Tables, vocabulary: list[tuple[str, str]], chat: L.Chat, model: str, prompt_version: str, now: str) -> tuple[Tables, DataFrame]:
    """Topics of vocabulary(slug, label) for every primary summary that has
    none, in the order given."""
    todo = V.primary(c).join(c["publication_topics"].select("publication_id").distinct(), "publication_id", "left_anti")
    shown = [F.col(x) for x in ("title", "subtitle", "pub_type", "date_published", "one_liner", "summary", "key_findings")]
    prompts = _summary_fields(c, todo.select("publication_id", "id")).select(F.col("publication_id").alias("id"), rules.topics_prompt(*shown, vocabulary).alias("prompt"))
    good, refused = _answered(prompts, chat, L.topics_check([slug for slug, _ in vocabulary]))
    found = good.select(F.col("id").alias("publication_id"), F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "topics array<string>").getField("topics").alias("t"))
    rows = found.select("publication_id", F.posexplode("t").alias("at", "topic_slug")).select("publication_id", "topic_slug", (F.col("at") + 1).alias("position"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.lit(now).alias("mapped_at"))
    return {"publication_topics": M.replace_children(c["publication_topics"], I._shaped(rows, c["publication_topics"]), "publication_id")}, refused


def blurb_check(answer: str) -> list[str]:
    own = (L.json_answer(answer) or {}).get("blurb")
    return [] if isinstance(own, str) and 30 <= len(own.split()) <= 110 else ["no blurb of 30 to 110 words"]


def describe(c: Tables, chat: L.Chat, model: str, now: str, stale: bool = False) -> tuple[Tables, DataFrame]:
    """A blurb for every primary summary that lacks one, or with stale also
    for those whose blurb was written from another summary."""
    todo = L.to_describe(c, c["blurbs"], stale)
    shown = [F.col(x) for x in ("title", "pub_type", "date_published", "one_liner", "summary", "key_findings")]
    prompts = _summary_fields(c, todo).select(F.col("publication_id").alias("id"), rules.blurb_prompt(*shown).alias("prompt"))
    good, refused = _answered(prompts, chat, blurb_check)
    text = F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), "blurb string").getField("blurb")
    rows = good.select(F.col("id").alias("publication_id"), F.trim(text).alias("blurb")).join(todo.select("publication_id", F.col("id").alias("source_enrichment_id")), "publication_id").select("publication_id", "blurb", "source_enrichment_id", F.lit(model).alias("model"), F.lit(now).alias("written_at"))
    return {"blurbs": M.replace_children(c["blurbs"], I._shaped(rows, c["blurbs"]), "publication_id")}, refused


# --------------------------------------------------------------------- vectors


def embed(c: Tables, provider: Callable[[list[str]], list[list[float]]], model: str, now: str) -> Tables:
    """Vectors of this model for one-liners of primary summaries and for
    sections that lack one; those of sections that are no more go."""
    old = M.purge_orphans(c["embeddings"], c["sections"])
    there = old.where((F.col("model") == model) & (F.col("source_type") == "one_liner")).select("publication_id")
    lines = V.primary(c).where("one_liner IS NOT NULL").join(there, "publication_id", "left_anti").select("id", "publication_id", F.col("one_liner").alias("text"), F.lit("one_liner").alias("source_type"))
    pieces = L.to_embed(c["sections"], old, model).select("id", "publication_id", F.concat_ws("\n\n", "heading", "body").alias("text"), F.lit("section").alias("source_type"))
    out = old
    for todo in (lines, pieces):
        todo = storage.stored(todo, "to-embed")
        made = storage.stored(embedded(todo.select("id", "text"), provider), "vectors").join(todo.drop("text"), "id")
        made = made.select("source_type", F.col("id").alias("source_id"), "publication_id", F.lit(model).alias("model"), F.size("vector").alias("dim"), "vector", F.lit(now).alias("embedded_at"))
        out = out.unionByName(I._shaped(made, c["embeddings"]))
    return {"embeddings": out}


# ---------------------------------------------------------------------- probes


def probe(html: str | None, m: R.Markup = R.Markup()) -> tuple[str | None, str | None, bool, int]:
    """(title, subtitle, has a date, words) of a page, by its own article's
    fields alone: teasers use the same ones."""
    root = dom.parse(html)
    article = R.own_article(root, m)
    fields: dict[str, dom.Element] = {}
    for e in R.own(article) if article is not None else ():
        for c in e.classes:
            if c.startswith(m.field):
                fields.setdefault(c[len(m.field) :], e)
    head = root.first(tag="h1")
    said = lambda e: (e.text() or None) if e is not None else None
    words = said(fields.get("content"))
    return said(head), said(fields.get("subtitle")), "date-published" in fields, len(words.split()) if words else 0


def probes(pages: DataFrame, markup: R.Markup = R.Markup()) -> DataFrame:
    """(url, probe_title, probe_subtitle, probe_has_date, probe_words) of
    cached pages(url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [probe(h, markup) for h in part.column(1).to_pylist()]
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["url", "probe_title", "probe_subtitle", "probe_has_date", "probe_words"])

    return pages.select("url", "html").mapInArrow(run, "url string, probe_title string, probe_subtitle string, probe_has_date boolean, probe_words int")


def classified(urls: DataFrame, pages: DataFrame, markup: R.Markup = R.Markup(), runs: Sequence[tuple[str, str, str]] = (), again: bool = False) -> DataFrame:
    """urls with probes of the pages of pending ones at the site's root, and a
    proposal for each that was not settled by hand; with again, also of those
    probed before. Type and series are those of the run (pattern, type, series)
    that the subtitle names."""
    fresh = F.lit(True) if again else F.col("probe_words").isNull()
    own = urls.where((F.col("scope") == "root-level") & (F.col("status") == "pending") & fresh).select("url")
    found = probes(pages.join(own, "url", "left_semi"), markup)
    series = rules.series_from_subtitle(F.col("probe_subtitle"), list(runs))
    found = found.withColumns({"proposed_type": series["pub_type"], "proposed_series": series["series"]})
    names = ("probe_title", "probe_subtitle", "probe_has_date", "probe_words", "proposed_type", "proposed_series")
    new = found.select("url", *[F.col(x).alias(f"new_{x}") for x in names], F.lit(True).alias("probed"))
    both = urls.join(new, "url", "left").withColumns({x: F.when(F.col("probed"), F.col(f"new_{x}")).otherwise(F.col(x)) for x in names})
    open_ = both.where("probed AND settled_at IS NULL").withColumn("disposition", F.lit(None).cast("string"))
    rest = both.where("probed IS NULL OR settled_at IS NOT NULL")
    return rest.select(*urls.columns).unionByName(M.settle(open_).select(*urls.columns))


# ----------------------------------------------------------------------- crawl


def _fetched(todo: DataFrame, fetch: Fetch) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                try:
                    rows.append((url, *fetch(url), None))
                except Exception as why:  # a bad page must not end the run; the row keeps why
                    rows.append((url, getattr(why, "code", None), None, None, f"{type(why).__name__}: {why}"))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["url", "http_status", "final_url", "html", "error"])

    return todo.select("url").mapInArrow(run, PAGE)


def taken_in(c: Tables, pages: DataFrame, markup: R.Markup, now: str) -> Tables:
    """After fetched PAGE rows: records of good ones, and the state of every
    url: done; gone if it moved or the server says so for good; skipped if it
    is no publication; failed otherwise, to be tried again."""
    own = R.records(pages.where("html IS NOT NULL").withColumn("page_id", F.xxhash64("url")), markup)
    judged = pages.drop("html").join(own.select("url", "slug", "record", "problem", "date_published"), "url", "left")
    why = F.coalesce("problem", F.when(F.col("record").isNull() & F.col("error").isNull(), "no page"))
    judged = judged.withColumn("problem", F.when(F.col("error").isNull(), why))
    state = R.sorted_out(judged.withColumn("http_status", F.when(F.col("error").isNotNull() & F.col("http_status").isNull(), F.lit(0)).otherwise(F.col("http_status"))))
    judged = storage.stored(judged.join(state, "url"), "judged")
    lastmod = c["sitemap_urls"].select("url", F.col("lastmod").alias("sitemap_lastmod"))
    fields = ("title", "subtitle", "pub_type", "series", "access", "pdf_url", "description")
    people = F.transform("record.people", lambda p: F.struct(*[p[x].alias(x) for x in ("slug", "name", "is_internal", "job_title", "role")]))
    new = judged.where("status = 'done'").join(lastmod, "url", "left").select("url", "slug", "date_published", "sitemap_lastmod", *[F.col(f"record.{f}").alias(f) for f in fields], people.alias("people"), F.col("record.site_tags").alias("site_tags"))
    out = M.upsert_publications(c, new, now)
    said = F.coalesce("error", F.when(F.col("status") == "gone", F.coalesce(F.when(F.col("http_status") != 200, F.concat(F.lit("HTTP "), "http_status")), F.concat(F.lit("redirected to "), "final_url"))), "problem")
    seen = judged.select("url", F.col("status").alias("s"), F.when(F.col("status") != "done", said).alias("e"))
    urls = c["sitemap_urls"].join(seen, "url", "left")
    urls = urls.withColumns({"last_error": F.when(F.col("s").isNull(), F.col("last_error")).otherwise(F.col("e")), "scraped_lastmod": F.when(F.col("s").isin("done", "gone", "skipped"), F.col("lastmod")).otherwise(F.col("scraped_lastmod")), "status": F.coalesce("s", "status")})
    out["sitemap_urls"] = urls.select(*c["sitemap_urls"].columns)
    return out


def _noted(settings: DataFrame, number: int) -> DataFrame:
    row = settings.sparkSession.createDataFrame([(BATCH_KEY, json.dumps(number))], "key string, value string")
    return settings.where(F.col("key") != BATCH_KEY).unionByName(row)


def scrape(spark: SparkSession, folder: str, fetch: Fetch, now: str, markup: R.Markup = R.Markup(), batch: int = BATCH, limit: int | None = None) -> DataFrame:
    """Fetch the publications' pages that are pending or failed, batch after
    batch, and commit each with its urls' states. (status, n) of this run. A
    url that fails is not tried again in the same run."""
    todo = M.pending_urls(snapshot.load(spark, folder)["sitemap_urls"].where("scope = 'publication'"))
    fs, _ = snapshot._fs(spark, folder)
    path = lambda n: f"{folder}/crawl/batch={n}"
    whole = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path(n), "_SUCCESS"))
    done = lambda: int(snapshot.setting(snapshot.load(spark, folder)["settings"], BATCH_KEY, 0))
    first = number = done()

    def commit(n: int) -> None:
        c = snapshot.load(spark, folder)
        with storage.scratch():
            out = taken_in(c, spark.read.schema(PAGE).parquet(path(n)), markup, now)
            snapshot.save(out | {"settings": _noted(c["settings"], n)}, folder)

    if whole(number + 1):  # fetched by a run that ended before it took them in
        commit(number := number + 1)
        todo = todo.join(spark.read.schema(PAGE).parquet(path(number)).select("url"), "url", "left_anti")
    rows = storage.numbered(todo.select("url"), ["url"], "turn")
    rows = storage.stored(rows if limit is None else rows.where(F.col("turn") <= limit), "todo")
    for k in range(-(-rows.count() // batch)):
        part = rows.where((F.col("turn") > k * batch) & (F.col("turn") <= (k + 1) * batch))
        _fetched(part, fetch).write.mode("overwrite").parquet(path(number := number + 1))
        commit(number)
    seen = None
    for n in range(first + 1, number + 1):
        own = spark.read.schema(PAGE).parquet(path(n)).select("url")
        seen = own if seen is None else seen.union(own)
    urls = snapshot.load(spark, folder)["sitemap_urls"]
    return (urls.join(seen, "url", "left_semi") if seen is not None else urls.where("false")).groupBy("status").agg(F.count("*").alias("n"))


def _resolved(publications: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(ref, at) with the id behind an id, a url or a slug; an id goes
    before a url, a url before a slug, null is none."""
    keys = publications.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), x.alias("key")) for k, x in enumerate((F.col("id").cast("string"), F.col("url"), F.col("slug")))])).alias("k"))
    slug = F.regexp_extract(F.rtrim(F.regexp_replace("ref", "[?#].*$", ""), F.lit("/")), "([^/]*)$", 1)
    ways = asked.select("ref", "at", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), x.alias("key")) for k, x in enumerate((F.col("ref"), F.col("ref"), slug))])).alias("k"))
    found = ways.join(keys, "k").groupBy("ref").agg(F.min_by("id", F.struct("k.way", "id")).alias("id"))
    return asked.join(found, "ref", "left").select("ref", "at", "id")


def chaptered(c: Tables, parent: int, refs: Sequence[str], fetch: Fetch, now: str, start: int = 1, pub_type: str | None = None, markup: R.Markup = R.Markup()) -> tuple[Tables, DataFrame, dict[str, int]]:
    """(tables, refused(ref, problem), counts) after refs became chapters of a
    publication, at places that count from start. An address that is not in
    the catalog is fetched and taken in, with its parent's type unless another
    is given; what can't be a chapter leaves its place empty."""
    spark = c["publications"].sparkSession
    asked = spark.createDataFrame([(str(r).strip(), i) for i, r in enumerate(dict.fromkeys(refs), start)], "ref string, at int")
    known = storage.stored(_resolved(c["publications"], asked), "chapters")
    new = known.where("id IS NULL AND ref LIKE 'http%'").select(F.col("ref").alias("url"))
    refused = known.where("id IS NULL AND ref NOT LIKE 'http%'").select("ref", F.lit("neither in the catalog nor an address").alias("problem"))
    fetched, tables = 0, dict(c)
    if new.limit(1).count():
        kind = pub_type or c["publications"].where(F.col("id") == parent).select("pub_type").first()[0]
        pages = storage.stored(_fetched(new, fetch), "pages")
        bad = pages.where("error IS NOT NULL OR http_status <> 200").select(F.col("url").alias("ref"), F.coalesce("error", F.concat(F.lit("HTTP "), "http_status")).alias("problem"))
        good = pages.where("error IS NULL AND http_status = 200").select("url", "final_url", "html", F.lit(kind).alias("pub_type"), F.lit(None).cast("string").alias("series"), F.lit(f"chapter of {parent}").alias("note"))
        tables, no = I.ingest(c, good, markup, now)
        refused = refused.union(bad).union(no.select("url", "problem"))
        fetched = new.count() - bad.count() - no.count()
    links = storage.stored(_resolved(tables["publications"], asked).where("id IS NOT NULL").withColumn("parent_id", F.lit(parent).cast("long")), "links")
    wrong = storage.stored(M.attach_problems(tables["publications"], links.select("id", "parent_id")), "wrong")
    refused = storage.stored(refused.union(links.join(wrong.select("id", "problem"), "id").select("ref", "problem")), "refused")
    placed = links.join(wrong.select("id"), "id", "left_anti").groupBy("id").agg(F.min("at").alias("at"))
    pubs = tables["publications"].join(placed.select("id", "at"), "id", "left")
    own = F.col("at").isNotNull()
    pubs = pubs.withColumns({"parent_id": F.when(own, F.lit(parent)).otherwise(F.col("parent_id")), "parent_position": F.when(own, F.col("at")).otherwise(F.col("parent_position"))})
    tables["publications"] = pubs.select(*c["publications"].columns)
    counts = {"already": known.where("id IS NOT NULL").count(), "ingested": fetched, "failed": refused.count(), "attached": placed.count()}
    return tables, refused, counts


def synced(c: Tables, seen: DataFrame, now: str, hosts: list[str], prefixes: list[str]) -> Tables:
    """sitemap_urls after a sitemap's seen(url, lastmod): states by M.upsert_urls;
    new rows get their scope and path from the url."""
    urls = c["sitemap_urls"]
    state = M.upsert_urls(urls.select("url", "lastmod", "status", "first_seen", "last_seen"), seen, now)
    rest = urls.drop("lastmod", "status", "first_seen", "last_seen")
    own = X.url_scope(F.col("url"), hosts, prefixes)
    out = state.join(rest, "url", "left").withColumns({x: F.coalesce(F.col(x), own[x]) for x in ("scope", "path_prefix")})
    return {"sitemap_urls": out.select(*urls.columns)}
