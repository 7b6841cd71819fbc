"""A command line over stored catalogs: ``python -m lectern.cli FOLDER COMMAND``.

Every command prints JSON lines of one lazy view; none computes anything of
its own. Changes write a new version of the tables they touch. ``serve``
answers the reading commands over HTTP. The keyword indexes are kept beside the
versions; the first search of a new version indexes what changed in it.
"""

from __future__ import annotations

import argparse
import datetime
import hmac
import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .operators import ingest as I
from .operators import landscape, runs
from .operators import search as S
from .operators import state as M
from .operators import vectors as R
from .operators import views as V
from .operators.indexing import StoredIndex
from .sources import readers, snapshot

FIELDS = ("title", "subtitle", "description", "body")
SECTION_FIELDS = ("heading", "body")
#: Makes a vector of a question, where there is a model: set by the caller.
EMBED: Callable[[str], list[float]] | None = None
#: What runs need, set by the caller: a model that answers, one that makes
#: vectors of texts, and what gets a page, with their names.
CHAT: runs.L.Chat | None = None
VECTORS: Callable[[list[str]], list[list[float]]] | None = None
FETCH: runs.Fetch | None = None
MODEL, PROMPT_VERSION, VECTOR_MODEL = "model", "1", "vectors"
#: Hosts and paths of a site's publications.
HOSTS: list[str] = []
PREFIXES: list[str] = []


class Catalog(dict):
    """The tables of a stored version, and where its indexes are kept."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(snapshot.load(spark, folder))
        self.folder = folder
        self.version = (snapshot.versions(spark, folder) or [0])[-1]
        self.spark = spark
        self.refused: list[str] = []

    def documents(self) -> DataFrame:
        texts = self["publication_text"].select(F.col("publication_id").alias("id"), "body")
        return M.reindexed(self["publications"].select("id", "title", "subtitle", "description").join(texts, "id", "left"))

    def stored(self, of: str) -> StoredIndex:
        return StoredIndex(self.spark, f"{self.folder}/index/{of}", FIELDS if of == "publications" else SECTION_FIELDS, True)

    def index(self) -> S.Index:
        """Of publications, brought to this version where it lags behind."""
        return self.stored("publications").at(self.documents(), str(self.version))

    def section_index(self) -> S.Index:
        return self.stored("sections").at(self["sections"].select("id", *SECTION_FIELDS), str(self.version))


def _shown(c: Catalog, hits: DataFrame) -> DataFrame:
    return hits.join(c["publications"].select("id", "title", "url", "pub_type", "date_published", "parent_id"), "id").orderBy("position")


def search(c: Catalog, q: str = "", limit: int = 10, strict: bool = False) -> DataFrame:
    """Hits, best first, with the best window of words of each and, where a
    section matches, that section's heading and window."""
    query, index = q if strict else S.safe_query(q), c.index()
    hits = S.search(index, query, S.PUBLICATION_WEIGHTS, int(limit))
    texts = c.documents().join(hits.select("id"), "id", "left_semi")
    return _shown(c, hits.join(S.snippets(index, texts, query), "id", "left").join(_best_sections(c, query, hits), "id", "left"))


def _best_sections(c: Catalog, query: str, hits: DataFrame) -> DataFrame:
    """(id, section, section_snippet) of the hits whose sections match."""
    index = c.section_index()
    best = S.best_sections(index, c["sections"], query, hits.select("id")).select(F.col("id").alias("publication"), F.col("section_id").alias("id"))
    rows = c["sections"].select("id", *SECTION_FIELDS).join(best, "id")
    cut = S.snippets(index, rows.select("id", *SECTION_FIELDS), query, column=1)
    return rows.join(cut, "id").select(F.col("publication").alias("id"), F.col("heading").alias("section"), F.col("snippet").alias("section_snippet"))


def reindex(c: Catalog, ref: str = "") -> DataFrame:
    """Bring one publication's row of the index up to date, or without one all
    that changed. One row: what the index holds now."""
    mine = c.stored("publications")
    if ref:
        own = c["publications"].where(F.col("id") == I.find_publication(c["publications"], ref)).select("id")
        mine.update(c.documents(), mine.manifest()[1], own)
    else:
        mine.update(c.documents(), str(c.version))
        c.stored("sections").update(c["sections"].select("id", *SECTION_FIELDS), str(c.version))
    return _indexed(c)


def _indexed(c: Catalog) -> DataFrame:
    rows = [(of, len(s), sum(x.documents for x in s), sum(x.void for x in s)) for of in ("publications", "sections") for s in [c.stored(of).manifest()[0]]]
    return c.spark.createDataFrame(rows, "index string, segments int, documents long, void long")


def index_fts(c: Catalog) -> DataFrame:
    """Both keyword indexes anew."""
    c.stored("publications").rebuild(c.documents(), str(c.version))
    c.stored("sections").rebuild(c["sections"].select("id", *SECTION_FIELDS), str(c.version))
    return _indexed(c)


def _vector(q: str, vector: str | None) -> list[float] | None:
    return json.loads(vector) if vector else EMBED(q) if EMBED else None


def find(c: Catalog, q: str = "", limit: int = 10, vector: str | None = None) -> DataFrame:
    """Hybrid search: keywords and both kinds of vectors, with the one-liner,
    the best section, the parent's title, and the shortlist's mark."""
    own, kinds = _vector(q, vector), []
    if own:
        kinds = [(c["embeddings"].where(F.col("source_type") == kind).select(F.col("publication_id").alias("id"), "vector"), own) for kind in ("one_liner", "section")]
    hits, notes = R.hybrid(c.index(), q, kinds, int(limit), c["shortlist"])
    parents = c["publications"].select(F.col("id").alias("parent_id"), F.col("title").alias("parent"))
    lines = V.primary(c).select(F.col("publication_id").alias("id"), "one_liner")
    marks = c["shortlist"].select(F.col("publication_id").alias("id"), F.lit(True).alias("shortlisted"))
    out = _shown(c, hits).join(parents, "parent_id", "left").join(lines, "id", "left").join(marks, "id", "left")
    try:
        out = out.join(_best_sections(c, S.safe_query(q), hits), "id", "left")
    except S.MatchError:
        out = out.withColumns({x: F.lit(None).cast("string") for x in ("section", "section_snippet")})
    return out.withColumns({"shortlisted": F.coalesce("shortlisted", F.lit(False)), "notes": F.lit("; ".join(notes))}).orderBy("position")


def semantic(c: Catalog, q: str = "", limit: int = 10, source: str = "section", vector: str | None = None) -> DataFrame:
    own = _vector(q, vector)
    if not own:
        raise ValueError("a semantic search needs a vector of the question")
    return R.semantic_search(c, own, int(limit), source).orderBy("position")


def listing(c: Catalog, type: str | None = None, year: str | None = None, topic: str | None = None, series: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    return V.page(V.list_publications(c, pub_type=type, year=year, topic=topic, series=series), int(limit), int(offset))


def people(c: Catalog, q: str = "", limit: int = 10) -> DataFrame:
    return V.typeahead(c["people"].where("merged_into IS NULL"), q, int(limit))


def publication(c: Catalog, ref: str = "") -> DataFrame:
    """All of one publication, by id, url or slug."""
    own = F.col("id") == I.find_publication(c["publications"], ref)
    shelves = V.collections_for(c).groupBy(F.col("publication_id").alias("id")).agg(F.array_sort(F.collect_list("name")).alias("collections"))
    pieces = c["sections"].groupBy(F.col("publication_id").alias("id")).agg(F.count("*").alias("sections"))
    return V.publication_detail(c).where(own).join(shelves, "id", "left").join(pieces, "id", "left")


def _parts(parts: dict[str, DataFrame]) -> DataFrame:
    """One row for each row of the parts, as JSON, by name of the part."""
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.union(one)
    return out


def _hits(c: Catalog, q: str, limit: int | None) -> DataFrame:
    if limit is not None:
        return S.search(c.index(), S.safe_query(q), S.PUBLICATION_WEIGHTS, limit).select("id", "position")
    return S.match(c.index(), S.safe_query(q), S.PUBLICATION_WEIGHTS).select("id", F.lit(1).alias("position"))


def coverage_check(c: Catalog, q: str = "", limit: int = 10) -> DataFrame:
    found = V.coverage_check(c, q, _hits(c, q, int(limit)), int(limit))
    return _parts(found | {"matches": _hits(c, q, None).agg(F.count("*").alias("n"))})


def coverage(c: Catalog, q: str = "", vector: str | None = None) -> DataFrame:
    about = S.match(c.index(), "{title subtitle description} : (" + S.safe_query(q) + ")", S.PUBLICATION_WEIGHTS).select("id")
    own, near = _vector(q, vector), None
    if own:
        vectors = c["embeddings"].where("source_type = 'one_liner'").select(F.col("publication_id").alias("id"), "vector")
        near = vectors.select("id", R.similarity(F.col("vector"), own).alias("similarity"))
    found = V.coverage_view(_with_topics(c), q, _hits(c, q, 10), about, near)
    found["verdict"] = V.coverage(c, _hits(c, q, None).select("id"), about, near)
    if own:
        points = c["embeddings"].where("source_type = 'one_liner'").select(F.col("publication_id").alias("id"), "vector")
        found["place"] = landscape.place_term(c["landscape_coords"].select(F.col("publication_id").alias("id"), "x", "y"), points, own)
    return _parts(found)


def _with_topics(c: Catalog) -> dict[str, DataFrame]:
    """The vocabulary, or else the topics that are in use."""
    return dict(c) | {"topics": c["publication_topics"].selectExpr("topic_slug AS slug", "topic_slug AS label", "0 AS cluster").distinct()}


COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "search": search,
    "find": find,
    "index-fts": index_fts,
    "reindex": reindex,
    "semantic": semantic,
    "list": listing,
    "people": people,
    "parents": lambda c, q="", limit=10: V.parent_typeahead(c["publications"], q, int(limit)),
    "person": lambda c, id="0": V.person_page(c, int(id)),
    "publication": publication,
    "coverage": coverage,
    "coverage-check": coverage_check,
    "facets": lambda c: V.facet_counts(c),
    "topics": lambda c: V.glossary(_with_topics(c)),
    "topic-graph": lambda c: V.topic_graph_edges(c),
    "topic-time": lambda c: V.topic_time(_with_topics(c)),
    "who-knows": lambda c: V.who_knows_what(_with_topics(c)),
    "todo": lambda c: M.pending_urls(c["sitemap_urls"]),
    "open-urls": lambda c: I.open_urls(c["sitemap_urls"]),
    "to-ingest": lambda c: I.waiting(c["sitemap_urls"]),
    "backlog": lambda c: V.backlog(c, c["reviews"].where("scope = 'backlog' AND verdict = 'parked'").selectExpr("subject_id AS id")),
    "status": lambda c: V.status_report(c),
    "groups": lambda c: V.status_groups(c),
    "warnings": lambda c: V.status_warnings(c),
    "caveats": lambda c: V.caveats(c),
    "duplicates": lambda c: V.duplicate_names(c["people"]),
    "reviews": lambda c: V.review_stats(c),
    "flagged": lambda c: V.flagged(c),
    "models": lambda c: V.model_stats(c),
    "candidates": lambda c: V.candidates(c),
    "thin": lambda c: V.thin_records(c),
    "pdf-needed": lambda c: V.pdf_needed(c),
    "uncredited": lambda c: V.uncredited(c).select("id", "slug", "title"),
    "collections": lambda c: V.collection_counts(c),
    "collection": lambda c, slug="": V.collection_members(c, slug),
    "shortlist": lambda c: V.shortlist_rows(c),
    "notes": lambda c: M.note_status(c["notes"], datetime.date.today().isoformat()),
}

Tables = dict[str, DataFrame]


def _reviewed(c: Catalog, scope: str, subject: int, verdict: str, note: str | None, now: str) -> Tables:
    """The last verdict on a subject stands alone."""
    rows = c["reviews"]
    spark = rows.sparkSession
    number = rows.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    new = spark.createDataFrame([(number, scope, subject, verdict, note)], "id long, scope string, subject_id long, verdict string, note string").withColumn("created_at", F.lit(now).cast("timestamp"))
    return {"reviews": rows.where(~((F.col("scope") == scope) & (F.col("subject_id") == subject))).unionByName(new.select(*rows.columns))}


def flag_summary(c: Catalog, now: str, ref: str = "", note: str = "") -> Tables:
    """Mark the primary summary of a publication as wrong, and say why."""
    if not note.strip():
        raise ValueError("a flag takes a note")
    row = V.primary(c).where(F.col("publication_id") == I.find_publication(c["publications"], ref)).select("id").first()
    if row is None:
        raise ValueError("it has no summary")
    return _reviewed(c, "enrichment", row.id, "flagged", note.strip(), now)


def merge(c: Catalog, now: str, duplicate: str = "0", survivor: str = "0") -> Tables:
    people_, credits, _ = M.merge_person(c["people"], c["credits"], int(duplicate), int(survivor))
    return {"people": people_, "credits": credits}


def mark(c: Catalog, now: str, ref: str = "", note: str = "") -> Tables:
    rows = c["shortlist"]
    new = rows.sparkSession.createDataFrame([(I.find_publication(c["publications"], ref), note.strip() or None)], "publication_id long, note string").withColumn("added_at", F.lit(now).cast("timestamp"))
    return {"shortlist": M.shortlist(rows, new).select(*rows.columns)}


def unmark(c: Catalog, now: str, ref: str = "") -> Tables:
    return {"shortlist": c["shortlist"].where(F.col("publication_id") != I.find_publication(c["publications"], ref))}


def settle(c: Catalog, now: str, url: str = "", disposition: str = "", note: str = "") -> Tables:
    new = c["sitemap_urls"].sparkSession.createDataFrame([(url, disposition, note)], "url string, disposition string, note string")
    return {"sitemap_urls": M.decided(c["sitemap_urls"], new.withColumn("note", F.col("note")), now).withColumn("settled_at", F.col("settled_at").cast("timestamp"))}


def add_chapters(c: Catalog, now: str, parent: str = "", chapters: str = "", start: str = "1", type: str = "") -> tuple[Tables, DataFrame]:
    """As attach-chapters, but addresses that are not in the catalog are taken
    in first, and what can't be attached is told instead of stopping all."""
    refs = [x.strip() for x in chapters.split(",") if x.strip()]
    tables, refused, _ = runs.chaptered(c, I.find_publication(c["publications"], parent), refs, _with(FETCH, "a way to get pages"), now, int(start), type or None)
    return tables, refused


def chapters(c: Catalog, now: str, parent: str = "", chapters: str = "") -> Tables:
    find_ = lambda ref: I.find_publication(c["publications"], ref)
    return {"publications": I.attach_chapters(c["publications"], find_(parent), [find_(x) for x in chapters.split(",") if x.strip()])}


def _with(tool, what: str):
    if tool is None:
        raise ValueError(f"this needs {what}")
    return tool


def _vocabulary(c: Catalog) -> list[tuple[str, str]]:
    """The topics of the setting `vocabulary`: {slug: label}."""
    found = snapshot.setting(c["settings"], "vocabulary", {})
    if not found:
        raise ValueError("the setting vocabulary holds no topics")
    return sorted(found.items())


def _regenerate(c: Catalog, now: str, ref: str = ""):
    return runs.regenerate(c, I.find_publication(c["publications"], ref), _with(CHAT, "a model"), MODEL, PROMPT_VERSION, now)


def _promote(c: Catalog, now: str, ref: str = "", id: str = "0"):
    return runs.promoted(c, c.spark.createDataFrame([(I.find_publication(c["publications"], ref), int(id))], "publication_id long, id long"))


def _classify(c: Catalog, now: str, again: str = "") -> Tables:
    """Probes of the pages at the site's root, fetched here and stored."""
    todo = c["sitemap_urls"].where("scope = 'root-level' AND status = 'pending'" + ("" if again else " AND probe_words IS NULL")).select("url")
    pages = storage.stored(runs._fetched(todo, _with(FETCH, "a way to get pages")), "probed")
    return {"sitemap_urls": runs.classified(c["sitemap_urls"], pages.where("html IS NOT NULL"), again=bool(again))}


def _sync(c: Catalog, now: str, path: str = "") -> Tables:
    """States of all urls after the sitemap files at path."""
    return runs.synced(c, readers.sitemap(c.spark, path), now, HOSTS, PREFIXES)


def scrape(c: Catalog, limit: str | None = None) -> DataFrame:
    """A run that commits batch by batch; states of its urls."""
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return runs.scrape(c.spark, c.folder, _with(FETCH, "a way to get pages"), now, limit=int(limit) if limit else None)


def _map(c: Catalog, now: str, steps: str | None = None) -> Tables:
    """The map of all publications with a one-liner's vector: all fitted; or,
    where steps are given, FIT_POINTS fitted at most, the rest placed, and all
    moved by the steps if there are others than fitted."""
    points = c["embeddings"].where("source_type = 'one_liner'").groupBy(F.col("publication_id").alias("id")).agg(F.max_by("vector", "embedded_at").alias("vector"))
    points = storage.stored(points, "points")
    coords = storage.stored(landscape.fit(points, landscape.FIT_POINTS if steps else None), "fit")
    if steps and coords.where("placed <> 'fit'").limit(1).count():
        coords = landscape.refined(coords, points, int(steps))
    return {"landscape_coords": coords.select(F.col("id").alias("publication_id"), "x", "y", "placed", F.lit(now).cast("timestamp").alias("computed_at"))}


#: Reading commands that also write, each by itself.
RUNS: dict[str, Callable[..., DataFrame]] = {"scrape": scrape}

CHANGES: dict[str, Callable[..., Tables | tuple[Tables, DataFrame]]] = {
    "enrich": lambda c, now, limit=None: runs.enrich(c, _with(CHAT, "a model"), MODEL, PROMPT_VERSION, now, int(limit) if limit else None),
    "regenerate": _regenerate,
    "promote": _promote,
    "map-topics": lambda c, now: runs.map_topics(c, _vocabulary(c), _with(CHAT, "a model"), MODEL, PROMPT_VERSION, now),
    "blurbs": lambda c, now, stale="": runs.describe(c, _with(CHAT, "a model"), MODEL, now, bool(stale)),
    "embed": lambda c, now: runs.embed(c, _with(VECTORS, "a model that makes vectors"), VECTOR_MODEL, now),
    "map": _map,
    "classify-root": _classify,
    "sync-sitemap": _sync,
    "flag-summary": flag_summary,
    "park": lambda c, now, ref="", note="": _reviewed(c, "backlog", I.find_publication(c["publications"], ref), "parked", note or None, now),
    "merge-person": merge,
    "mark": mark,
    "unmark": unmark,
    "settle": settle,
    "unsettle": lambda c, now, url="": {"sitemap_urls": M.reopened_urls(c["sitemap_urls"], c["sitemap_urls"].where(F.col("url") == url))},
    "add-pdf": lambda c, now, url="", **fields: I.add_pdf_record(c, url, now, **fields),
    "attach-chapters": chapters,
    "add-chapters": add_chapters,
    "rename-collection": lambda c, now, slug="", name="": {"collections": M.renamed_collection(c, slug, name)},
    "drop-collection": lambda c, now, slug="": M.dropped_collection(c, slug),
}


def rows(c: Catalog, command: str, **options: str) -> list[str]:
    """JSON texts; what a command returns is a page or a summary."""
    return COMMANDS[command](c, **options).toJSON().collect()


def change(c: Catalog, command: str, **options: str) -> int:
    """Write the version after a change; gives its number. What a run could
    not do is in c.refused, as JSON texts."""
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    out = CHANGES[command](c, now, **options)
    tables, refused = out if isinstance(out, tuple) else (out, None)
    c.refused = refused.toJSON().collect() if refused is not None else []
    return snapshot.save(dict(c) | tables, c.folder)


def server(spark: SparkSession, folder: str, port: int, token: str | None = None) -> ThreadingHTTPServer:
    """GET /command?option=value; with a token, only for its bearer."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if token and not hmac.compare_digest(self.headers.get("Authorization", ""), f"Bearer {token}"):
                return self._send(401, [json.dumps({"error": "bearer token needed"})])
            at = urlsplit(self.path)
            command = at.path.strip("/")
            if command not in COMMANDS:
                return self._send(404, [json.dumps({"error": "no such command", "commands": sorted(COMMANDS)})])
            try:
                out = rows(Catalog(spark, folder), command, **{k: v[0] for k, v in parse_qs(at.query).items()})
            except (TypeError, ValueError) as why:
                return self._send(400, [json.dumps({"error": str(why)})])
            return self._send(200, out)

        def _send(self, code: int, lines: list[str]) -> None:
            body = ("[" + ",\n".join(lines) + "]").encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder")
    p.add_argument("command", choices=[*sorted(COMMANDS), *sorted(CHANGES), *sorted(RUNS), "serve"])
    p.add_argument("options", nargs="*", help="name=value")
    args = p.parse_args(argv)
    options = dict(o.split("=", 1) for o in args.options)
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    if args.command == "serve":
        server(spark, args.folder, int(options.get("port", 8000)), options.get("token")).serve_forever()
    c = Catalog(spark, args.folder)
    try:
        if args.command in CHANGES:
            print(json.dumps({"version": change(c, args.command, **options)}))
            print(*c.refused, sep="\n", end="\n" * bool(c.refused), file=sys.stderr)
        elif args.command in RUNS:
            print("\n".join(RUNS[args.command](c, **options).toJSON().collect()))
        else:
            print("\n".join(rows(c, args.command, **options)))
    except S.MatchError as why:
        print(f"not a query: {why}", file=sys.stderr)
        return 2
    except (TypeError, ValueError) as why:
        print(why, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
