"""Analytical views of a catalog, each a lazy DataFrame.

``c`` maps role names (publications, credits, people, publication_topics,
topics, publication_text, enrichments, reviews) to DataFrames; see
``lectern.schema`` for their columns. Sides are broadcast by hint only where a
count found them small; all other joins are left to the planner and to AQE.
What a catalog says of its publication types is in ``c["types"]``, a Types.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X
from . import state as M

Catalog = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Types:
    """weights: how much a publication of a type counts, 1 if not named;
    excluded: types that insight views leave out; thin_exempt: types that are
    never too short."""

    weights: Mapping[str, int]
    excluded: tuple[str, ...]
    thin_exempt: tuple[str, ...]


TYPES = Types({"Report": 8, "Tracker": 4, "Exec Memo": 4, "External": 2, "Interview": 2, "Briefs": 2, "Comment": 1}, ("Podcast",), ("Podcast", "External"))
CREDIT_ROLES = ("author", "guest")
THIN_SHARE = 0.25
LEAST_TEXTS = 5


def types_of(c: Catalog) -> Types:
    return c["types"] if "types" in c else TYPES


def type_weight(c: Catalog, kind: Column) -> Column:
    out = F.lit(1)
    for name, weight in reversed(types_of(c).weights.items()):
        out = F.when(kind == name, weight).otherwise(out)
    return out


def parents_only(pubs: DataFrame) -> DataFrame:
    return pubs.where(F.col("parent_id").isNull())


def insight_scope(c: Catalog) -> DataFrame:
    """What the insight views count: no chapters, no excluded types."""
    return parents_only(c["publications"]).where(~F.col("pub_type").isin(*types_of(c).excluded))


def credited(c: Catalog) -> DataFrame:
    return c["credits"].where(F.col("role").isin(*CREDIT_ROLES))


def primary(c: Catalog) -> DataFrame:
    return c["enrichments"].where("is_primary")


def with_roots(c: Catalog, ids: DataFrame) -> DataFrame:
    """Distinct publications behind ids(id), chapters standing for parents."""
    return ids.join(c["publications"].select("id", "parent_id"), "id").select(F.coalesce("parent_id", "id").alias("id")).distinct()


def list_publications(c: Catalog, *, pub_type=None, year=None, person_id=None, topic=None, topic_primary=False, series=None, shortlisted=None, include_chapters=False) -> DataFrame:
    """Facets: a value or a list each; OR inside a facet, AND across."""
    many = lambda x: list(x) if isinstance(x, (list, tuple, set)) else [x]
    pubs = c["publications"] if include_chapters else parents_only(c["publications"])
    if pub_type:
        pubs = pubs.where(F.col("pub_type").isin(*many(pub_type)))
    if series:
        pubs = pubs.where(F.col("series").isin(*many(series)))
    if year:
        # ranges of days reach the scan, years of them would not
        day = lambda y: F.lit(f"{int(y):04}-01-01").cast("date")
        pubs = pubs.where(reduce(Column.__or__, [(F.col("date_published") >= day(y)) & (F.col("date_published") < day(int(y) + 1)) for y in many(year)]))
    if person_id:
        own = c["credits"].where(F.col("person_id").isin(*many(person_id))).select(F.col("publication_id").alias("id"))
        pubs = pubs.join(own, "id", "left_semi")
    if topic:
        own = c["publication_topics"].where(F.col("topic_slug").isin(*many(topic)))
        own = own.where("position = 1") if topic_primary else own
        pubs = pubs.join(own.select(F.col("publication_id").alias("id")), "id", "left_semi")
    if shortlisted is not None:
        pubs = pubs.join(shortlisted.select(F.col("publication_id").alias("id")), "id", "left_semi")
    return pubs


def page(pubs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; a bounded sort, not a sort of all."""
    return pubs.orderBy(F.desc_nulls_last("date_published"), F.desc("id")).offset(offset).limit(limit)


def facet_counts(c: Catalog) -> DataFrame:
    """(facet, value, n) by type, year and series, in one pass and shuffle."""
    pubs = parents_only(c["publications"])
    facets = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")) for f, v in (("type", F.col("pub_type")), ("year", F.year("date_published")), ("series", F.col("series")))])).alias("x")
    return pubs.select(facets).where("x.value IS NOT NULL").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def people_credits(c: Catalog) -> DataFrame:
    """Unmerged people with author and guest credits, and hosting apart."""
    roles = c["credits"].groupBy("person_id").agg(F.count_if(F.col("role").isin(*CREDIT_ROLES)).alias("n"), F.count_if(F.col("role") == "host").alias("hosted"))
    return c["people"].where("merged_into IS NULL").join(roles, F.col("id") == F.col("person_id")).select("id", "name", "n", "hosted")


def people_by_fragment(c: Catalog, fragment: str) -> DataFrame:
    """Names that contain fragment (A-Z in either case); n is null, not 0,
    where a person has no links at all."""
    own = c["people"].where(X.ascii_ilike(F.col("name"), f"%{fragment}%"))
    n = c["credits"].groupBy("person_id").agg(F.sum(F.col("role").isin(*CREDIT_ROLES).cast("long")).alias("n"))
    return own.join(n, F.col("id") == F.col("person_id"), "left").select("id", "name", "n")


def uncredited(c: Catalog) -> DataFrame:
    return parents_only(c["publications"]).join(c["credits"], F.col("id") == F.col("publication_id"), "left_anti")


def topic_counts(c: Catalog) -> DataFrame:
    return c["publication_topics"].groupBy("topic_slug").agg(F.count("*").alias("n"), F.count_if(F.col("position") == 1).alias("n_primary"))


def topic_graph_nodes(c: Catalog) -> DataFrame:
    """Publications, their weight, and how many are about each topic. The
    rows are spread by publication, which serves both the least position and
    the join."""
    topics = storage.spread(c["publication_topics"].select("publication_id", "topic_slug", "position"), "publication_id", c["publications"].count())
    least = topics.groupBy("publication_id", "topic_slug").agg(F.min("position").alias("position"))
    rows = least.join(insight_scope(c).select("id", "pub_type"), F.col("publication_id") == F.col("id"))
    own = rows.groupBy("topic_slug").agg(F.count("*").alias("pubs"), F.sum(type_weight(c, F.col("pub_type"))).alias("weighted"), F.count_if(F.col("position") == 1).alias("about"))
    return own.join(storage.small(c["topics"]), F.col("topic_slug") == F.col("slug")).select("slug", "label", "pubs", "weighted", "about")


def topic_graph_edges(c: Catalog, least: int = 2) -> DataFrame:
    """Pairs of topics that share publications at positions 1 and 2. Each
    publication's few trusted topics pair up inside its own row, so no
    self-join: one aggregation per publication, one per pair."""
    trusted = c["publication_topics"].where("position <= 2")
    lists = trusted.groupBy("publication_id").agg(F.sort_array(F.collect_list("topic_slug")).alias("s")).where(F.size("s") > 1)
    own = lists.join(insight_scope(c).select(F.col("id").alias("publication_id")), "publication_id", "left_semi")
    first = own.select("s", F.posexplode("s").alias("i", "s1"))
    pairs = first.select("s1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("s2")).where("s1 < s2")
    return pairs.groupBy("s1", "s2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spine(bounds: DataFrame) -> DataFrame:
    """All quarters from lo to hi of bounds(lo, hi), as labels."""
    index = F.explode(F.sequence(X.quarter_index(F.col("lo")), X.quarter_index(F.col("hi")))).alias("i")
    return bounds.where("lo IS NOT NULL").select(index).select(X.quarter_label(F.col("i")).alias("quarter"))


def _dated(pubs: DataFrame) -> DataFrame:
    return pubs.where("date_published IS NOT NULL").withColumn("quarter", X.quarter_of(F.col("date_published")))


def topic_time(c: Catalog) -> DataFrame:
    """Weight, words and number per topic and quarter, gaps as zeros. The
    axis spans all quarters that a primary topic falls in, whether or not the
    vocabulary still has it."""
    pubs = _dated(insight_scope(c)).select("id", "pub_type", "quarter")
    rows = c["publication_topics"].where("position = 1").join(pubs, F.col("publication_id") == F.col("id"))
    rows = rows.join(c["publication_text"].select("publication_id", "word_count"), "publication_id", "left")
    cells = rows.groupBy("topic_slug", "quarter").agg(F.sum(type_weight(c, F.col("pub_type"))).alias("w"), F.sum(F.coalesce("word_count", F.lit(0))).alias("words"), F.count("*").alias("n"))
    axis = spine(cells.agg(F.min("quarter").alias("lo"), F.max("quarter").alias("hi")))
    own = cells.select("topic_slug").distinct().join(storage.small(c["topics"].select("slug", "label")), F.col("topic_slug") == F.col("slug")).select("slug", "label")
    full = own.crossJoin(F.broadcast(axis))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return full.join(cells.withColumnRenamed("quarter", "q"), (F.col("slug") == F.col("topic_slug")) & (F.col("quarter") == F.col("q")), "left").select("slug", "label", "quarter", zero("w"), zero("words"), zero("n"))


def term_time(c: Catalog, hits: DataFrame) -> DataFrame:
    """Weight, words and number per quarter of the publications behind
    hits(id); the axis is that of the whole scoped catalog."""
    scoped = _dated(insight_scope(c))
    own = with_roots(c, hits).join(scoped, "id").join(c["publication_text"].select(F.col("publication_id").alias("id"), "word_count"), "id", "left")
    cells = own.groupBy("quarter").agg(F.sum(type_weight(c, F.col("pub_type"))).alias("w"), F.sum(F.coalesce("word_count", F.lit(0))).alias("words"), F.count("*").alias("n"))
    axis = spine(scoped.agg(F.min("quarter").alias("lo"), F.max("quarter").alias("hi")))
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long").alias(x)
    return axis.join(cells, "quarter", "left").select("quarter", zero("w"), zero("words"), zero("n"))


def summary_hits(c: Catalog, phrase: str) -> DataFrame:
    return primary(c).where(X.ascii_ilike(F.col("summary"), f"%{phrase}%")).select(F.col("publication_id").alias("id"))


def who_knows_what(c: Catalog, current_only: bool = True) -> DataFrame:
    """(person, topic) cells: distinct credited publications about the topic,
    with all credits of the person and how many of them the cells cover."""
    lead = c["publication_topics"].where("position = 1").select("publication_id", "topic_slug")
    cells = credited(c).join(lead, "publication_id").groupBy("person_id", "topic_slug").agg(F.countDistinct("publication_id").alias("n"))
    cells = cells.join(storage.small(c["topics"].select("slug")), F.col("topic_slug") == F.col("slug"))
    totals = credited(c).groupBy("person_id").agg(F.count("*").alias("credits_total"))
    mapped = cells.groupBy("person_id").agg(F.sum("n").alias("mapped_total"))
    people = c["people"].where("merged_into IS NULL")
    people = people.where("is_current") if current_only else people
    own = people.join(totals, F.col("id") == F.col("person_id")).drop("person_id").join(mapped, F.col("id") == F.col("person_id")).drop("person_id")
    return own.join(cells, F.col("id") == F.col("person_id")).select("id", "name", "affiliation", "credits_total", "mapped_total", F.col("topic_slug").alias("topic"), "n")


def type_length_norms(c: Catalog) -> DataFrame:
    """The upper median of words per type, and a quarter of it. Counts per
    distinct length are summed first, so a type never gathers in one task."""
    rows = c["publication_text"].join(c["publications"].select("id", "pub_type"), F.col("publication_id") == F.col("id"))
    lengths = rows.where(~F.col("pub_type").isin(*types_of(c).thin_exempt)).groupBy("pub_type", "word_count").agg(F.count("*").alias("n"))
    ranked = lengths.selectExpr("pub_type", "word_count", "sum(n) OVER (PARTITION BY pub_type ORDER BY word_count) AS upto", "sum(n) OVER (PARTITION BY pub_type) AS total")
    middle = ranked.where((F.col("total") >= LEAST_TEXTS) & (F.col("upto") > F.expr("total div 2")))
    return middle.groupBy("pub_type").agg(F.min("word_count").alias("median_words")).withColumn("floor_words", F.floor(F.col("median_words") * THIN_SHARE).cast("long"))


def thin_records(c: Catalog) -> DataFrame:
    rows = c["publications"].where("access = 'public'").join(c["publication_text"], F.col("id") == F.col("publication_id"))
    norms = storage.small(type_length_norms(c).withColumnRenamed("pub_type", "kind"))
    return rows.join(norms, (F.col("pub_type") == F.col("kind")) & (F.col("word_count") < F.col("floor_words"))).select("id", "pub_type", "word_count", F.col("median_words").alias("expected"), "source", "pdf_url", "date_published")


def pdf_needed(c: Catalog) -> DataFrame:
    """Short by a quarter of their type's mean, or without text: distinct."""
    rows = c["publications"].join(c["publication_text"], F.col("id") == F.col("publication_id"), "left")
    means = rows.where("word_count IS NOT NULL").groupBy(F.col("pub_type").alias("kind")).agg(F.floor(F.avg("word_count") * THIN_SHARE).alias("floor_words"))
    return rows.where("pdf_url IS NOT NULL").join(storage.small(means), F.col("pub_type") == F.col("kind"), "left").where("word_count IS NULL OR word_count < floor_words").select("id", "pdf_url").distinct()


def shared_pdfs(c: Catalog) -> DataFrame:
    """PDF addresses that several publications name; counts move, not rows."""
    return c["publications"].where("pdf_url IS NOT NULL").groupBy("pdf_url").agg(F.count("*").alias("n")).where("n > 1")


def _counts(df: DataFrame, **measures: Column) -> DataFrame:
    """(measure, n) from one aggregation."""
    one = df.agg(*[m.cast("long").alias(k) for k, m in measures.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in measures])).alias("x")).select("x.measure", "x.n")


def _without(left: DataFrame, key: str, right: DataFrame, other: str) -> DataFrame:
    return left.join(right.select(F.col(other).alias(key)), key, "left_anti")


def status_report(c: Catalog) -> DataFrame:
    """(measure, n): one aggregation for each table, none of them joined with
    another but where the measure itself compares two. A catalog without some
    of the tables has no measures of them."""
    pubs, people, texts = c["publications"], c["people"], c["publication_text"]
    first = primary(c)
    parts = [
        _counts(pubs, publications=F.count_if(F.col("parent_id").isNull()), chapters=F.count_if(F.col("parent_id").isNotNull())),
        _counts(people, people=F.count_if(F.col("merged_into").isNull())),
        _counts(texts, texts=F.count("*"), words=F.coalesce(F.sum("word_count"), F.lit(0))),
        _counts(first, enriched=F.count("*"), models=F.countDistinct("model")),
        _counts(c["publication_topics"], mapped=F.countDistinct("publication_id")),
        _counts(_without(texts.where("word_count > 0"), "publication_id", first, "publication_id"), unenriched=F.count("*")),
        _counts(_without(first, "publication_id", c["publication_topics"], "publication_id"), no_topics=F.count("*")),
    ]
    if "site_tags" in c:
        parts.append(_counts(c["site_tags"], site_tags=F.count("*")))
    if "indexed" in c:
        parts.append(_counts(c["indexed"], indexed=F.count("*")))
    if "sections" in c and "embeddings" in c:
        sections, vectors = c["sections"], c["embeddings"]
        of = lambda kind: vectors.where(F.col("source_type") == kind).select("source_id").distinct()
        parts += [
            _counts(sections, sections=F.count("*")),
            _counts(_without(texts, "publication_id", sections, "publication_id"), no_sections=F.count("*")),
            _counts(_without(sections.where("NOT is_boilerplate"), "id", of("section"), "source_id"), no_vector=F.count("*")),
            _counts(_without(first, "publication_id", of("one_liner"), "source_id"), no_one_liner=F.count("*")),
            _counts(vectors, vectors=F.count("*")),
        ]
    return reduce(DataFrame.union, parts)


def status_groups(c: Catalog) -> DataFrame:
    """(facet, value, n): parents by type, credits by role, unmerged people by
    affiliation (and current ones apart), and where the tables are there,
    addresses by scope and status and vectors by source."""
    one = lambda df, facet, value, n=F.count("*"): df.groupBy(value.cast("string").alias("value")).agg(n.cast("long").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    people = c["people"].where("merged_into IS NULL")
    parts = [
        one(parents_only(c["publications"]), "type", F.col("pub_type")),
        one(c["credits"], "role", F.col("role")),
        one(people, "affiliation", F.col("affiliation")),
        one(people, "current", F.col("affiliation"), F.count_if("is_current")),
    ]
    if "sitemap_urls" in c:
        parts.append(one(c["sitemap_urls"], "sitemap", F.concat_ws(" ", "scope", "status")))
    if "embeddings" in c:
        parts.append(one(c["embeddings"], "vectors", F.col("source_type")))
    return reduce(DataFrame.union, parts)


def status_warnings(c: Catalog) -> DataFrame:
    """(measure, warning): what has fallen behind, and how to mend it."""
    n = status_report(c).groupBy().pivot("measure", ["publications", "chapters", "indexed", "no_sections", "no_vector", "no_one_liner", "no_topics", "vectors"]).agg(F.first("n"))
    split = duplicate_names(c["people"]).agg(F.count("*").alias("split"))
    rows = n.crossJoin(split)
    total = F.col("publications") + F.col("chapters")
    say = lambda measure, when, *text: F.when(when, F.struct(F.lit(measure).alias("measure"), F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in text]).alias("warning")))
    col = F.col
    found = F.array(
        say("split", col("split") > 0, col("split"), " names are carried by more than one person, merge them"),
        say("indexed", col("indexed") != total, "the keyword index holds ", col("indexed"), " of ", total, " publications and chapters, build it again"),
        say("no_sections", col("no_sections") > 0, col("no_sections"), " texts have no sections, extract them"),
        say("no_vector", col("no_vector") > 0, col("no_vector"), " sections have no vector, embed them"),
        say("no_one_liner", col("no_one_liner") > 0, col("no_one_liner"), " summaries have no vector, embed them"),
        say("no_topics", col("no_topics") > 0, col("no_topics"), " summaries carry no topics, map them"),
        say("vectors", col("vectors") == 0, "no vector is stored, searches rest on keywords alone"),
    )
    return rows.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.*")


def gaps(c: Catalog) -> DataFrame:
    """(measure, n) of what a claim of absence rests on."""
    pubs, texts = c["publications"], c["publication_text"]
    parts = [
        _counts(uncredited(c), uncredited=F.count("*")),
        _counts(duplicate_names(c["people"]), split=F.count("*")),
        _counts(c["credits"], by_hand=F.count_if(F.col("source") == "manual") if "source" in c["credits"].columns else F.lit(0)),
        _counts(_without(pubs, "id", texts, "publication_id"), no_text=F.count("*"), title_only=F.count_if(F.coalesce("description", F.lit("")) == "") if "description" in pubs.columns else F.count("*")),
    ]
    if "sitemap_urls" in c:
        root, own = F.col("scope") == "root-level", F.col("scope") == "publication"
        excluded = F.coalesce("disposition", F.lit("")) == "exclude"
        parts.append(
            _counts(
                c["sitemap_urls"],
                legacy=F.count_if(root & (F.col("status") == "pending") & ~excluded),
                declined=F.count_if(root & excluded),
                unscraped=F.count_if(own & F.col("status").isin("failed", "skipped")),
                gone=F.count_if(own & (F.col("status") == "gone")),
            )
        )
    return reduce(DataFrame.union, parts)


CAVEATS = {
    "legacy": "% pages at the root of the site are not ingested",
    "declined": "% pages at the root of the site were looked at and left out on purpose",
    "unscraped": "% pages failed or were skipped in scraping",
    "gone": "% publications are listed but no longer there, and so absent",
    "uncredited": "% records credit no person, so author-based answers under-report",
    "split": "% people exist as more than one row, which splits their credits until merged",
    "by_hand": "% credits were given by hand and not read from a page",
    "no_text": "% records have no full text and are matchable by title alone",
    "title_only": "% of the records without text have no description either",
}
#: The one limit that nothing here can measure.
ELSEWHERE = "work that was published elsewhere only is not listed and therefore absent; its extent is unknown"


def caveats(c: Catalog) -> DataFrame:
    """(measure, n, caveat): sentences a claim of absence has to carry. Each
    goes away with its gap, but for the last, which cannot be measured."""
    known = gaps(c).where("n > 0")
    text = F.create_map(*[x for k, v in CAVEATS.items() for x in (F.lit(k), F.lit(v))])
    said = known.select("measure", "n", F.replace(text[F.col("measure")], F.lit("%"), F.col("n").cast("string")).alias("caveat"))
    always = known.sparkSession.createDataFrame([("elsewhere", None, ELSEWHERE)], "measure string, n long, caveat string")
    return said.union(always)


def tags_matching(c: Catalog, term: str) -> DataFrame:
    """(tag, id, title) of publications with a tag that contains term."""
    tags = c["site_tags"].where(X.ascii_ilike(F.col("name"), f"%{term}%")).select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    own = c["publication_site_tags"].join(tags, "tag_id").select("publication_id", "tag")
    return own.join(c["publications"].select(F.col("id").alias("publication_id"), "title"), "publication_id").select("tag", F.col("publication_id").alias("id"), "title")


def review_stats(c: Catalog) -> DataFrame:
    own = c["reviews"].where("scope = 'enrichment'")
    return own.agg(F.count_if(F.col("verdict") == "confirmed").alias("confirmed"), F.count_if(F.col("verdict") == "flagged").alias("flagged"))


def duplicate_names(people: DataFrame) -> DataFrame:
    """Names carried by several unmerged rows, with their ids in order."""
    own = people.where("merged_into IS NULL").groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))
    return own.where("n > 1")


def collection_counts(c: Catalog) -> DataFrame:
    """Collections with how many publications are in each, 0 for empty ones."""
    own = c["publication_collections"].groupBy(F.col("slug").alias("s")).agg(F.count("*").alias("n"))
    return c["collections"].join(own, F.col("slug") == F.col("s"), "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("n"))


def _listed(c: Catalog, own: DataFrame) -> DataFrame:
    """own(publication_id, …) with what a list shows of each publication."""
    lines = primary(c).select("publication_id", "one_liner")
    pubs = c["publications"].select(F.col("id").alias("publication_id"), "title", "pub_type", "date_published")
    return own.join(pubs, "publication_id").join(lines, "publication_id", "left").withColumnRenamed("publication_id", "id")


def collection_members(c: Catalog, slug: str) -> DataFrame:
    """A collection's publications, newest first."""
    own = c["publication_collections"].where(F.col("slug") == slug).select("publication_id", "source")
    return _listed(c, own).orderBy(F.desc_nulls_last("date_published"), "id")


def collections_for(c: Catalog) -> DataFrame:
    """(publication_id, slug, name, source) of all memberships, each
    publication's by name."""
    return c["publication_collections"].join(c["collections"].select("slug", "name"), "slug").select("publication_id", "slug", "name", "source")


def shortlist_rows(c: Catalog) -> DataFrame:
    """What was marked, the newest mark first."""
    return _listed(c, c["shortlist"].select("publication_id", "note", "added_at")).orderBy(F.desc("added_at"), "id")


def tier(c: Catalog, hits: DataFrame) -> DataFrame:
    """Hits by type, chapters rolled up, with the type's weight."""
    own = with_roots(c, hits).join(c["publications"].select("id", "pub_type"), "id")
    return own.groupBy("pub_type").agg(F.count("*").alias("n"), F.sum(type_weight(c, F.col("pub_type"))).alias("weighted"))


def adjacent_topics(c: Catalog, ids: DataFrame) -> DataFrame:
    own = c["publication_topics"].where("position <= 2").join(ids.select(F.col("id").alias("publication_id")), "publication_id", "left_semi")
    return own.groupBy("topic_slug").agg(F.countDistinct("publication_id").alias("n"))


def adjacent_people(c: Catalog, ids: DataFrame) -> DataFrame:
    own = credited(c).join(ids.select(F.col("id").alias("publication_id")), "publication_id", "left_semi").groupBy("person_id").agg(F.count("*").alias("n"))
    return c["people"].where("merged_into IS NULL").join(own, F.col("id") == F.col("person_id")).select("id", "name", "n")


def round_robin(c: Catalog, done: DataFrame) -> DataFrame:
    """A worklist where every prefix is representative: one of each type in
    turn. Those done(publication_id) are anti-joined first, so each
    publication comes once."""
    todo = primary(c).select("publication_id").join(done.select("publication_id"), "publication_id", "left_anti")
    own = todo.join(c["publications"].select("id", "pub_type"), F.col("publication_id") == F.col("id"))
    return own.selectExpr("id", "pub_type", "row_number() OVER (PARTITION BY pub_type ORDER BY id) AS turn")


def topic_arrays(c: Catalog) -> DataFrame:
    """Each publication's topics in order, the first being primary."""
    packed = c["publication_topics"].groupBy("publication_id").agg(F.array_sort(F.collect_list(F.struct("position", "topic_slug"))).alias("t"))
    return packed.select("publication_id", F.array_join("t.topic_slug", ",").alias("topics"), F.element_at("t.topic_slug", 1).alias("first_topic"))


def length_bands(c: Catalog, bands: int = 5, seed: int = 7) -> DataFrame:
    """One text from each band of equally many texts, by length; which one
    depends on the seed only. Band edges come from quantiles, so no global
    sort is needed."""
    texts = c["publication_text"]
    cuts = texts.agg(F.percentile("word_count", F.array(*[F.lit(i / bands) for i in range(1, bands)])).alias("cuts"))
    own = texts.crossJoin(F.broadcast(cuts)).withColumn("band", F.size(F.filter("cuts", lambda x: x < F.col("word_count"))))
    return own.groupBy("band").agg(F.min_by(F.struct("publication_id", "word_count"), F.xxhash64(F.lit(seed), "publication_id")).alias("x")).select("band", "x.*")


def parent_typeahead(pubs: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Publications that can be a chapter's parent, by their titles: those
    that start with text, then with a word that does, then the rest."""
    own = parents_only(pubs).where(X.ascii_ilike(F.col("title"), f"%{text}%"))
    rank = F.when(X.ascii_ilike(F.col("title"), f"{text}%"), 0).when(X.ascii_ilike(F.col("title"), f"% {text}%"), 1).otherwise(2)
    return own.select("id", "title", "date_published", rank.alias("rank")).orderBy("rank", F.desc_nulls_last("date_published"), "id").limit(limit)


def typeahead(people: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Names that start with prefix, then those with a word that does, then
    those that contain it; current people first."""
    low = prefix.lower()
    own = people.where(X.ascii_ilike(F.col("name"), f"%{prefix}%"))
    rank = F.when(X.ascii_ilike(F.col("name"), f"{low}%"), 0).when(X.ascii_ilike(F.col("name"), f"% {low}%"), 1).otherwise(2)
    return own.select("id", "name", "is_current", rank.alias("rank")).orderBy("rank", F.desc("is_current"), "name", "id").limit(limit)


def publication_detail(c: Catalog) -> DataFrame:
    """Each publication with people, topics, text and summary, as arrays."""
    people = c["credits"].join(c["people"].select(F.col("id").alias("person_id"), "name"), "person_id").groupBy("publication_id")
    people = people.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "role", "name"))), lambda x: F.concat(x["name"], F.lit(":"), x["role"])), "|").alias("people"))
    one = c["publications"].select("id", "title", "pub_type", "parent_id")
    for other in (people, topic_arrays(c).select("publication_id", "topics"), c["publication_text"].select("publication_id", "word_count"), primary(c).select("publication_id", "summary")):
        one = one.join(other.withColumnRenamed("publication_id", "id"), "id", "left")
    chapters = c["publications"].where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("chapters"))
    return one.join(chapters, "id", "left").withColumn("chapters", F.coalesce("chapters", F.lit(0)))


def person_page(c: Catalog, person_id: int) -> DataFrame:
    """Publications of a person by role, following a merge to the survivor."""
    own = c["people"].where(F.col("id") == person_id).select(F.coalesce("merged_into", "id").alias("person_id"))
    rows = c["credits"].join(F.broadcast(own.limit(1)), "person_id").join(c["publications"], F.col("publication_id") == F.col("id"))
    return rows.select("role", "id", "title", "pub_type", "date_published")


def person_facets(c: Catalog) -> DataFrame:
    """(person_id, facet, value, n) for every person, merged ones counted with
    the survivor: credits in all (total), by type of publication (type), and
    episodes hosted (hosted), which a page tells as a number."""
    who = M.resolve_merged(c["people"]).select(F.col("id").alias("credited"), "survivor")
    own = c["credits"].withColumnRenamed("person_id", "credited").join(who, "credited", "left").withColumn("person_id", F.coalesce("survivor", "credited"))
    rows = own.select("person_id", "publication_id", "role").distinct().join(c["publications"].select(F.col("id").alias("publication_id"), "pub_type"), "publication_id")
    credited = F.col("role").isin(*CREDIT_ROLES)
    facet = F.when(credited, F.array(F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("type").alias("facet"), F.col("pub_type").alias("value"))))
    facet = facet.otherwise(F.array(F.struct(F.lit("hosted").alias("facet"), F.lit(None).cast("string").alias("value"))))
    return rows.select("person_id", F.explode(facet).alias("f")).groupBy("person_id", "f.facet", "f.value").agg(F.count("*").alias("n"))


def person_listing(c: Catalog, person_id: int, q: str | None = None, types: Sequence[str] = ()) -> DataFrame:
    """What a person is credited with, by role, newest first, narrowed to
    types and to a term in title, one-liner or summary: a filter, no ranking."""
    lines = primary(c).select(F.col("publication_id").alias("id"), "one_liner", "summary")
    rows = person_page(c, person_id).where(F.col("role").isin(*CREDIT_ROLES)).join(lines, "id", "left")
    if types:
        rows = rows.where(F.col("pub_type").isin(*types))
    if (q or "").strip():
        rows = rows.where(X.mentions(q.strip(), F.col("title"), F.col("one_liner"), F.col("summary")))
    return rows.orderBy("role", F.desc("date_published"), "id")


def topic_spotlight(c: Catalog, slug: str, limit: int = 6) -> DataFrame:
    own = c["publication_topics"].where((F.col("topic_slug") == slug) & (F.col("position") == 1)).select(F.col("publication_id").alias("id"))
    rows = insight_scope(c).join(own, "id", "left_semi")
    best = rows.select("id", "title", "pub_type", "date_published").orderBy(F.desc("date_published"), F.desc("id")).limit(limit)
    return best.join(primary(c).select(F.col("publication_id").alias("id"), "summary"), "id", "left")


def topic_pair(c: Catalog, a: str, b: str, limit: int = 30) -> DataFrame:
    own = c["publication_topics"].where(F.col("topic_slug").isin(a, b) & (F.col("position") <= 2)).groupBy("publication_id").agg(F.countDistinct("topic_slug").alias("k")).where("k = 2")
    rows = insight_scope(c).join(own.select(F.col("publication_id").alias("id")), "id", "left_semi")
    return rows.select("id", "title", "pub_type", "date_published").orderBy(F.desc("date_published"), F.desc("id")).limit(limit)


def chapters_of(c: Catalog) -> DataFrame:
    """Chapters with their parents' titles, in order."""
    p = c["publications"].select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"))
    return c["publications"].where("parent_id IS NOT NULL").select("id", "parent_id", "parent_position", "title").join(p, "parent_id")


def streamgraph(c: Catalog, top: int = 8) -> DataFrame:
    """Topic weights per quarter, all but the heaviest `top` topics summed as
    other, stacked around a middle line."""
    rows = topic_time(c).select("slug", "quarter", "w")
    rank = rows.groupBy("slug").agg(F.sum("w").alias("total")).selectExpr("slug AS s", "row_number() OVER (ORDER BY total DESC, slug) AS r")
    named = rows.join(storage.small(rank), F.col("slug") == F.col("s")).select(F.when(F.col("r") <= top, F.col("slug")).otherwise("other").alias("layer"), F.when(F.col("r") <= top, F.col("r")).otherwise(top + 1).alias("r"), "quarter", "w")
    layers = named.groupBy("layer", "r", "quarter").agg(F.sum("w").alias("w"))
    return layers.selectExpr("layer", "quarter", "w", "sum(w) OVER (PARTITION BY quarter ORDER BY r) - w - sum(w) OVER (PARTITION BY quarter) / 2 AS base")


def model_stats(c: Catalog) -> DataFrame:
    return c["enrichments"].groupBy("model").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("seconds").alias("seconds"))


def candidates(c: Catalog) -> DataFrame:
    """Publications with summaries besides the primary one."""
    own = c["enrichments"].groupBy("publication_id").agg(F.count("*").alias("n"), F.count_if("is_primary").alias("n_primary"))
    return own.where("n > n_primary")


def throughput(c: Catalog, last: int = 60) -> DataFrame:
    """Seconds per summary over the newest `last` of them."""
    top = c["enrichments"].orderBy(F.desc("enriched_at"), F.desc("id")).limit(last)
    return top.agg(F.count("*").alias("n"), (F.unix_timestamp(F.max("enriched_at")) - F.unix_timestamp(F.min("enriched_at"))).alias("span_seconds"), F.sum("seconds").alias("busy_seconds"))


def flagged(c: Catalog) -> DataFrame:
    """Summaries whose last verdict is flagged, with the note."""
    own = c["reviews"].where("scope = 'enrichment'").groupBy("subject_id").agg(F.max_by(F.struct("verdict", "note"), F.struct("created_at", "id")).alias("r"))
    return own.where("r.verdict = 'flagged'").join(c["enrichments"].select("id", "publication_id"), F.col("subject_id") == F.col("id")).select("id", "publication_id", F.col("r.note").alias("note"))


def backlog(c: Catalog, parked: DataFrame) -> DataFrame:
    """(kind, id) of what is unfinished: thin records and paywalled ones
    without words, but for those parked(id). What is incomplete by design is
    no task. Records and texts are spread by publication once for all three
    joins."""
    rows = c["publications"].count()
    pubs = storage.spread(c["publications"].select("id", "pub_type", "access", "pdf_url", "date_published"), "id", rows)
    texts = storage.spread(c["publication_text"].select("publication_id", "word_count", "source"), "publication_id", rows)
    c = {**{k: c[k] for k in ("types",) if k in c}, "publications": pubs, "publication_text": texts}
    thin = thin_records(c).select(F.lit("thin").alias("kind"), "id")
    words = c["publication_text"].where("word_count > 0").select(F.col("publication_id").alias("id"))
    paywalled = c["publications"].where("access <> 'public'").join(words, "id", "left_anti").select(F.lit("paywalled").alias("kind"), "id")
    return thin.union(paywalled).join(parked.select("id").distinct(), "id", "left_anti").select("kind", "id")


def homeless_urls(urls: DataFrame, publications: DataFrame) -> DataFrame:
    """Addresses settled as publications that no record has."""
    return urls.where("disposition = 'ingest'").join(publications.select("url"), "url", "left_anti").select("url")


def glossary(c: Catalog) -> DataFrame:
    """The vocabulary with its counts, topics without any included."""
    return c["topics"].join(topic_counts(c), F.col("slug") == F.col("topic_slug"), "left").select("slug", "label", "cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_primary", F.lit(0)).alias("n_primary"))


def upcoming_edge(notes: DataFrame, note_topics: DataFrame, today_quarter: str, horizon: int = 8) -> DataFrame:
    """Open notes per topic and quarter, up to `horizon` quarters ahead;
    undated ones apart, as quarter null."""
    own = notes.where("landed_at IS NULL AND shelved_at IS NULL")
    now = X.quarter_index(F.lit(today_quarter))
    near = own.where(F.col("expected").isNull() | X.quarter_index(F.col("expected")).between(now, now + horizon))
    return near.join(note_topics.withColumnRenamed("note_id", "id"), "id").groupBy("topic_slug", F.col("expected").alias("quarter")).agg(F.count("*").alias("n"))


def ordered_notes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, closed): open by quarter with undated last, then by age; closed
    newest first."""
    shut = F.coalesce("landed_at", "shelved_at")
    return notes.where(shut.isNull()).orderBy(F.asc_nulls_last("expected"), "created_at", "id"), notes.where(shut.isNotNull()).orderBy(F.desc(shut), "id")


def coverage_check(c: Catalog, term: str, hits: DataFrame, limit: int = 10) -> dict[str, DataFrame]:
    """Whether something is covered, by three probes and what bounds them:
    hits(id, position), the best of a search, tags and people that contain
    term, and the caveats. Never a bare no."""
    pubs = c["publications"].select("id", "title", "pub_type", "date_published")
    return {
        "full_text": hits.orderBy("position").limit(limit).join(pubs, "id").orderBy("position"),
        "matches": hits.agg(F.count("*").alias("n")),
        "site_tags": tags_matching(c, term),
        "people": people_by_fragment(c, term),
        "caveats": caveats(c),
    }


def neighbours(c: Catalog, similarity: DataFrame, limit: int = 12) -> DataFrame:
    """The publications nearest in meaning from similarity(id, similarity),
    with type, month, one-liner, first topic and place on the map."""
    near = similarity.join(insight_scope(c).select("id", "title", "pub_type", F.date_format("date_published", "yyyy-MM").alias("month")), "id")
    near = near.orderBy(F.desc("similarity"), "id").limit(limit)
    topic = c["publication_topics"].where("position = 1").join(storage.small(c["topics"]), F.col("topic_slug") == F.col("slug")).select(F.col("publication_id").alias("id"), F.col("label").alias("topic"))
    out = near.join(topic, "id", "left").join(primary(c).select(F.col("publication_id").alias("id"), "summary"), "id", "left")
    if "landscape_coords" in c:
        out = out.join(c["landscape_coords"].select(F.col("publication_id").alias("id"), "x", "y"), "id", "left")
    return out.withColumn("similarity", F.round("similarity", 3))


def coverage_view(c: Catalog, term: str, hits: DataFrame, about: DataFrame, similarity: DataFrame | None, limit: int = 12) -> dict[str, DataFrame]:
    """The coverage check with a measured verdict, the nearest publications,
    and the topics and people of those. hits and about are all publications a
    search finds anywhere and in titles; without similarity the verdict rests
    on keywords alone."""
    out = coverage_check(c, term, hits) | {"verdict": coverage(c, hits.select("id"), about.select("id"), similarity)}
    if similarity is not None:
        near = storage.stored(neighbours(c, similarity, limit), "neighbours")
        out |= {"neighbours": near, "adjacent_topics": adjacent_topics(c, near), "adjacent_people": adjacent_people(c, near)}
    return out


def coverage(c: Catalog, direct: DataFrame, about: DataFrame, similarity: DataFrame | None) -> DataFrame:
    """One row: mentions and about with chapters rolled up, their weight, the
    best similarity (null without a scan), and the verdict."""
    from . import vectors

    n = lambda hits, names: tier(c, hits).agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in names])
    one = n(direct, (("n", "mentions"), ("weighted", "weighted"))).crossJoin(n(about, (("n", "about"),)))
    scan = similarity.agg(F.max("similarity").alias("sim1")) if similarity is not None else direct.sparkSession.range(1).select(F.lit(None).cast("double").alias("sim1"))
    return one.crossJoin(scan).withColumn("verdict", vectors.verdict(F.col("about"), F.col("mentions"), F.coalesce("sim1", F.lit(0.0)), F.col("sim1").isNull()))


def filtered_hits(hits: DataFrame, pubs: DataFrame, **facets) -> DataFrame:
    """Search hits cut down by facets, after the search's own limit: a filter
    never brings up what the search left out."""
    keep = hits.join(pubs, "id")
    for column, values in facets.items():
        keep = keep.where(F.col(column).isin(*(values if isinstance(values, (list, tuple, set)) else [values])))
    return keep.select(*hits.columns)


ROLE_ORDER = ("author", "guest", "host")


def bylines(c: Catalog) -> DataFrame:
    """People of each publication, authors first, then guests and hosts."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), F.col("role"))
    own = c["credits"].join(c["people"].select(F.col("id").alias("person_id"), "name"), "person_id")
    return own.groupBy("publication_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "position", "name"))), lambda x: x["name"]), ", ").alias("byline"))


def matrix_order(cells: DataFrame, topic: str) -> DataFrame:
    """People of a matrix by their cell in one topic, then by their total."""
    own = cells.groupBy("id", "name").agg(F.coalesce(F.max(F.when(F.col("topic") == topic, F.col("n"))), F.lit(0)).alias("own"), F.max("mapped_total").alias("total"))
    return storage.numbered(own, [F.desc("own"), F.desc("total"), "id"], "position").select("id", "name", "own", "total", "position")


def roster_entries(people: DataFrame, roster: DataFrame) -> DataFrame:
    """Each person's roster entry by their own slug, or else by the slug of a
    row that was merged into them, the least id first."""
    own = people.where("merged_into IS NULL").select(F.col("id").alias("person_id"), "slug", F.lit(0).alias("turn"), F.col("id").alias("via"))
    old = people.where("merged_into IS NOT NULL").select(F.col("merged_into").alias("person_id"), "slug", F.lit(1), "id")
    found = own.union(old).join(roster.select("slug", "title"), "slug")
    return found.groupBy("person_id").agg(F.min_by(F.struct("slug", "title"), F.struct("turn", "via")).alias("e")).select("person_id", "e.slug", "e.title")


def named_entities(enrichments: DataFrame, kind: str) -> DataFrame:
    """(name, n): how many summaries name each entity of a kind."""
    return enrichments.select("id", F.explode(F.col("entities")[kind]).alias("name")).groupBy("name").agg(F.countDistinct("id").alias("n"))
