"""Catalog state as pure functions of (current, changes).

No function writes; ``lectern.sources.snapshot`` stores results as new
versions. Repeating a function on its own result changes nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as X


def latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a maximum with map-side combine, no sort."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def upsert_urls(current: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Crawl state after a sitemap: first_seen stays, a changed lastmod sends
    done back to pending, gone stays gone. (url, lastmod, status, first_seen,
    last_seen) and seen(url, lastmod)."""
    new = seen.groupBy("url").agg(F.max("lastmod").alias("new_lastmod")).withColumn("found", F.lit(True))
    both = current.join(new, "url", "full_outer")
    changed = F.col("found") & ~F.col("new_lastmod").eqNullSafe(F.col("lastmod"))
    return both.select(
        "url",
        F.when(F.col("found"), F.col("new_lastmod")).otherwise(F.col("lastmod")).alias("lastmod"),
        F.when(F.col("status").isNull(), "pending").when((F.col("status") == "done") & changed, "pending").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_seen", F.lit(now)).alias("first_seen"),
        F.when(F.col("found"), F.lit(now)).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def pending_urls(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("pending", "failed")).orderBy("url")


def replace_children(current: DataFrame, changes: DataFrame, parent: str) -> DataFrame:
    """All rows of each parent in changes give way to its rows there."""
    return current.join(changes.select(parent).distinct(), parent, "left_anti").unionByName(changes)


def replace_parsed(current: DataFrame, changes: DataFrame, parent: str, keys: list[str]) -> DataFrame:
    """As replace_children, but rows entered by hand stay and win."""
    touched = changes.select(parent).distinct()
    manual = current.where("source = 'manual'")
    others = current.where("source <> 'manual'").join(touched, parent, "left_anti")
    fresh = changes.dropDuplicates(keys).join(manual.select(*keys), keys, "left_anti")
    return manual.unionByName(others).unionByName(fresh)


def upsert_latest(current: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, changes over current, later over earlier."""
    both = current.withColumn("__turn", F.lit(0)).unionByName(changes.withColumn("__turn", F.lit(1)))
    return latest(both, keys, ["__turn", *order]).select(*current.columns)


def upsert_text(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Texts by precedence: manual is never overwritten; a pdf text stays
    where new html is not longer."""
    new = changes.select("publication_id", *[F.col(c).alias(f"new_{c}") for c in ("body", "word_count", "source")])
    both = current.join(new, "publication_id", "full_outer")
    keep = F.col("source").isNotNull() & (
        F.col("new_source").isNull() | ((F.col("source") == "manual") & (F.col("new_source") != "manual")) | ((F.col("source") == "pdf") & (F.col("new_source") == "html") & (F.col("new_word_count") <= F.col("word_count")))
    )
    return both.select("publication_id", *[F.when(keep, F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in ("body", "word_count", "source")])


def pdf_decisions(rows: DataFrame) -> DataFrame:
    """What to do with an extracted PDF, reasons in order of precedence. rows(
    id, stored_source, stored_words, foreign_host, n_sharing, found,
    pdf_words, type_median)."""
    reason = (
        F.when(F.col("stored_source") == "manual", "manual")
        .when(F.col("foreign_host"), "foreign host")
        .when(F.col("n_sharing") > 1, "shared")
        .when(~F.col("found"), "missing")
        .when(F.col("pdf_words") > 4 * F.col("type_median"), "outsized")
        .when((F.coalesce("stored_source", F.lit("")) != "pdf") & (F.col("pdf_words") <= F.coalesce("stored_words", F.lit(0))), "not longer")
    )
    return rows.select("id", F.when(reason.isNull(), "import").otherwise("skip").alias("action"), reason.alias("reason"))


def purge_orphans(vectors: DataFrame, sections: DataFrame) -> DataFrame:
    """Section vectors whose section is gone are dropped."""
    kept = vectors.where("source_type = 'section'").join(sections.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return kept.unionByName(vectors.where("source_type <> 'section'"))


def resolve_merged(people: DataFrame) -> DataFrame:
    """(id, survivor): chains of merges followed to their end by doubling, so
    a chain of n takes log2(n) rounds, each a written table of the merged rows
    alone. Rows on a cycle, and those that lead to one, resolve to the cycle's
    least id. A row merged into one that is not there resolves to that id."""
    links = people.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("to"), F.least("id", "merged_into").alias("least"))
    now = storage.stored(links, "merges")
    rounds = max(1, math.ceil(math.log2(max(2, now.count())))) + 1
    for _ in range(rounds):
        # after round k a row points 2^k merges on, and knows the least id it passed
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("least").alias("next_least"))
        after = now.join(ahead, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.least("least", "next_least").alias("least"), F.col("next").isNotNull().alias("moved"))
        after = storage.stored(after, "merges")
        storage.discard(now)
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
    # who still points at a merged row is on a cycle or before one, and after
    # that many steps points into it; a row of a cycle knows its least id
    cycles = now.select(F.col("id").alias("to"), F.col("least").alias("of_cycle"))
    ends = now.join(cycles, "to", "left").select("id", F.coalesce("of_cycle", "to").alias("survivor"))
    return people.select("id").join(ends, "id", "left").select("id", F.coalesce("survivor", "id").alias("survivor"))


def merge_credits(credits: DataFrame, survivors: DataFrame) -> DataFrame:
    """Credits moved to survivors, none twice, the earliest position kept."""
    moved = credits.join(survivors.withColumnRenamed("id", "person_id"), "person_id").select("publication_id", F.col("survivor").alias("person_id"), "role", "position")
    return moved.groupBy("publication_id", "person_id", "role").agg(F.min("position").alias("position"))


def merge_problem(people: DataFrame, loser: int, survivor: int) -> str | None:
    """Why a merge is refused; None if it may go on."""
    if loser == survivor:
        return "a person cannot be merged into itself"
    own = {r.id: r.merged_into for r in people.where(F.col("id").isin(loser, survivor)).select("id", "merged_into").collect()}
    if loser not in own or survivor not in own:
        return "no such person"
    if own[loser] is not None:
        return "already merged"
    return "the survivor has been merged away" if own[survivor] is not None else None


def merge_person(people: DataFrame, credits: DataFrame, loser: int, survivor: int) -> tuple[DataFrame, DataFrame, dict]:
    """(people, credits, report) after loser was merged into survivor. Its
    credits move, but for those the survivor has already; the survivor's empty
    fields are filled; the row stays as a tombstone, and rows that were merged
    into it point at the survivor at once."""
    if problem := merge_problem(people, loser, survivor):
        raise ValueError(problem)
    lost, kept = (people.where(F.col("id") == x).first() for x in (loser, survivor))
    own = credits.where(F.col("person_id") == loser)
    there = credits.where(F.col("person_id") == survivor).select("publication_id", "role")
    moving = own.join(there, ["publication_id", "role"], "left_anti")
    total, moved = own.count(), moving.count()
    after = credits.where(F.col("person_id") != loser).unionByName(moving.withColumn("person_id", F.lit(survivor).cast(credits.schema["person_id"].dataType)).select(*credits.columns))
    is_lost, is_kept = F.col("id") == loser, F.col("id") == survivor
    fields = {"merged_into": F.when(is_lost | (F.col("merged_into") == loser), survivor).otherwise(F.col("merged_into"))}
    for c in ("job_title", "roster_title"):
        if c in people.columns and lost[c] is not None:
            fields[c] = F.when(is_kept, F.coalesce(F.col(c), F.lit(lost[c]))).otherwise(F.col(c))
    if "is_internal" in people.columns:
        fields["is_internal"] = F.when(is_kept & F.lit(bool(lost["is_internal"])), F.lit(True)).otherwise(F.col("is_internal"))
    if "is_current" in people.columns:
        fields["is_current"] = F.when(is_lost, F.lit(False)).otherwise(F.col("is_current"))
    report = {"duplicate": lost["name"], "survivor": kept["name"], "moved": moved, "already_there": total - moved}
    return people.withColumns(fields).select(*people.columns), after, report


def _person_key(slug: Column, name: Column) -> Column:
    return F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit("slug "), slug)).otherwise(F.concat(F.lit("name "), name))


def resolve_people(people: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, found) for seen(turn, slug, name, is_internal, job_title): a
    person is known by the slug, or without one by the name among people
    without a slug (the least id, if several are). Later turns win. What was
    seen renews the name and adds to the rest, and never takes a job title
    away; where the row was merged, it only fills the survivor's gaps. found
    is (slug, name, person_id); new people get ids after the last one."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn")))
    new = seen.groupBy(_person_key(F.col("slug"), F.col("name")).alias("key")).agg(
        last("slug").alias("slug"), last("name").alias("name"), F.max("is_internal").alias("is_internal"), last("job_title").alias("job_title")
    )
    known = people.groupBy(_person_key(F.col("slug"), F.col("name")).alias("key")).agg(F.min(F.struct("id", "merged_into")).alias("p")).select("key", "p.id", "p.merged_into")
    new = storage.stored(new.join(known, "key", "left"), "seen-people")
    first = people.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    made = storage.numbered(new.where("id IS NULL").drop("id"), ["key"], "id", first)
    blank = {"is_current": F.lit(True), "merged_into": F.lit(None)}
    rows = [F.col(c) if c in ("id", "slug", "name", "is_internal", "job_title") else blank.get(c, F.lit(None)).cast(people.schema[c].dataType).alias(c) for c in people.columns]
    same = new.where("id IS NOT NULL AND merged_into IS NULL").groupBy("id").agg(*[F.max(c).alias(f"new_{c}") for c in ("name", "is_internal", "job_title")])
    via = new.where("merged_into IS NOT NULL").groupBy(F.col("merged_into").alias("id")).agg(F.max("is_internal").alias("via_internal"), F.max("job_title").alias("via_title"))
    own = people.join(same, "id", "left").join(via, "id", "left").withColumns(
        {
            "name": F.coalesce("new_name", "name"),
            "job_title": F.coalesce("new_job_title", "job_title", "via_title"),
            "is_internal": F.greatest("is_internal", "new_is_internal", "via_internal"),
        }
    )
    keyed = new.select("key", F.coalesce("merged_into", "id").alias("person_id")).where("person_id IS NOT NULL").union(made.select("key", "id"))
    found = seen.select("slug", "name", _person_key(F.col("slug"), F.col("name")).alias("key")).distinct().join(keyed, "key").drop("key")
    return own.select(*people.columns).unionByName(made.select(*rows)), found


def upsert_publications(c: dict[str, DataFrame], records: DataFrame, now: str) -> dict[str, DataFrame]:
    """The catalog after records(url, …, people, site_tags), arrays of (slug,
    name, is_internal, job_title, role) and of names. A known url keeps its id
    and has its fields replaced; credits read from the page and tags give way
    to the record's, credits given by hand stay. One record an url."""
    pubs, fields = c["publications"], [x for x in records.columns if x not in ("people", "site_tags")]
    records = storage.stored(records.join(pubs.select("url", F.col("id")), "url", "left"), "records")
    first = pubs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    records = records.where("id IS NOT NULL").unionByName(storage.numbered(records.where("id IS NULL").drop("id"), ["url"], "id", first))
    records = storage.stored(records.withColumn("scraped_at", F.lit(now)), "records")
    touched = records.select(F.col("id").alias("publication_id"))
    old = pubs.join(records.select("id", *[F.col(f).alias(f"new_{f}") for f in (*fields, "scraped_at") if f in pubs.columns], F.lit(True).alias("again")), "id", "left")
    renewed = {f: F.when(F.col("again"), F.col(f"new_{f}")).otherwise(F.col(f)) for f in (*fields, "scraped_at") if f in pubs.columns}
    fresh = records.join(pubs.select("id"), "id", "left_anti")
    made = fresh.select(*[(F.col(x) if x in fresh.columns else F.lit(None)).cast(pubs.schema[x].dataType).alias(x) for x in pubs.columns])
    out = dict(c)
    out["publications"] = old.withColumns(renewed).select(*pubs.columns).unionByName(made)
    credited = records.select(F.col("id").alias("publication_id"), F.posexplode("people").alias("position", "p")).select("publication_id", "position", "p.*")
    seen = credited.select(F.struct("publication_id", "position").alias("turn"), "slug", "name", "is_internal", "job_title")
    out["people"], found = resolve_people(c["people"], seen)
    found = found.select(F.col("slug").alias("s"), F.col("name").alias("n"), "person_id")
    rows = credited.join(found, F.col("slug").eqNullSafe(F.col("s")) & (F.col("name") == F.col("n")))
    rows = rows.groupBy("publication_id", "person_id", "role").agg(F.min("position").alias("position")).withColumn("source", F.lit("parsed"))
    by_hand = c["credits"].where("source = 'manual'")
    others = c["credits"].where("source <> 'manual'").join(touched, "publication_id", "left_anti")
    rows = rows.join(by_hand.select("publication_id", "person_id", "role"), ["publication_id", "person_id", "role"], "left_anti")
    out["credits"] = by_hand.unionByName(others).unionByName(rows.select(*[F.col(x).cast(c["credits"].schema[x].dataType).alias(x) for x in c["credits"].columns]))
    tags = storage.stored(records.select(F.col("id").alias("publication_id"), F.explode("site_tags").alias("name")).distinct(), "tags")
    first = c["site_tags"].agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    named = storage.numbered(tags.select("name").distinct().join(c["site_tags"].select("name"), "name", "left_anti"), ["name"], "id", first)
    out["site_tags"] = c["site_tags"].select("id", "name").unionByName(named)
    tagged = tags.join(out["site_tags"], "name").select("publication_id", F.col("id").alias("tag_id"))
    out["publication_site_tags"] = c["publication_site_tags"].join(touched, "publication_id", "left_anti").select("publication_id", "tag_id").unionByName(tagged)
    return out


def credit(credits: DataFrame, added: DataFrame) -> DataFrame:
    """credits with added(publication_id, person_id, role) by hand, after what
    each publication has; one that is there already changes nothing."""
    roles = ("author", "host", "guest")
    if added.where(~F.col("role").isin(*roles)).limit(1).count():
        raise ValueError(f"a role is none of {', '.join(roles)}")
    keys = ["publication_id", "person_id", "role"]
    new = append_positions(credits, added.select(*keys).distinct().join(credits.select(*keys), keys, "left_anti"), "publication_id", ["person_id", "role"])
    new = new.withColumn("source", F.lit("manual"))
    return credits.unionByName(new.select(*[F.col(x).cast(credits.schema[x].dataType).alias(x) for x in credits.columns]))


def uncredit(credits: DataFrame, gone: DataFrame) -> DataFrame:
    """credits without gone(publication_id, person_id, role), by hand or not."""
    return credits.join(gone.select("publication_id", "person_id", "role"), ["publication_id", "person_id", "role"], "left_anti").select(*credits.columns)


def attach_problems(publications: DataFrame, links: DataFrame) -> DataFrame:
    """(id, parent_id, problem) for links(id, parent_id) that would make a
    chapter of itself, of nothing, of a chapter, or of a parent."""
    p = publications.select(F.col("id").alias("pid"), F.col("parent_id").alias("grand"))
    has = publications.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("own")).distinct()
    rows = links.join(p, F.col("parent_id") == F.col("pid"), "left").join(has, F.col("id") == F.col("own"), "left")
    problem = F.when(F.col("id") == F.col("parent_id"), "itself").when(F.col("pid").isNull(), "missing parent").when(F.col("grand").isNotNull(), "nested").when(F.col("own").isNotNull(), "has chapters")
    return rows.select("id", "parent_id", problem.alias("problem")).where("problem IS NOT NULL")


def promote(enrichments: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen(id) become primary, all others of their publications do not."""
    own = enrichments.join(chosen.select("id", F.lit(True).alias("picked")), "id", "left")
    touched = own.where("picked").select("publication_id", F.lit(True).alias("touched")).distinct()
    out = own.join(touched, "publication_id", "left")
    return out.withColumn("is_primary", F.when(F.col("touched"), F.coalesce("picked", F.lit(False))).otherwise(F.col("is_primary"))).select(*enrichments.columns)


#: The model of summaries that a person wrote.
BY_HAND = "manual"


def _new_summaries(enrichments: DataFrame, made: DataFrame, now: str, after: int) -> DataFrame:
    """made(publication_id, …, is_primary) as rows with ids from after + 1."""
    ranked = storage.numbered(made.drop("id"), ["publication_id", F.xxhash64("model", "prompt_version", "summary")], "id", after)
    values = {"enriched_at": F.lit(now)}
    return ranked.select(*[(values.get(f.name, F.col(f.name) if f.name in ranked.columns else F.lit(None))).cast(f.dataType).alias(f.name) for f in enrichments.schema])


def _last_id(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def upsert_primary(enrichments: DataFrame, made: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(enrichments, refused, changed) after primary summaries made(
    publication_id, one_liner, summary, …). A publication without one gets a
    row; one that a model wrote is replaced in place and keeps its id. Refused
    as (publication_id, id, problem): over one written by hand, which is the
    only copy there is; all of several for one publication; and where a
    publication has more than one primary already. changed(publication_id)."""
    old = enrichments.where("is_primary").groupBy("publication_id").agg(F.min("id").alias("old_id"), F.count("*").alias("primaries"), F.max((F.col("model") == BY_HAND).cast("int")).alias("by_hand"))
    many = made.groupBy("publication_id").agg(F.count("*").alias("many"))
    problem = F.when(F.col("many") > 1, "several for one publication").when(F.col("by_hand") == 1, "a summary written by hand").when(F.col("primaries") > 1, "several primary summaries")
    judged = storage.stored(made.join(many, "publication_id").join(old, "publication_id", "left").withColumn("problem", problem), "summaries")
    refused = judged.where("problem IS NOT NULL").select("publication_id", F.col("old_id").alias("id"), "problem").distinct()
    good = judged.where("problem IS NULL").drop("many", "primaries", "by_hand", "problem").withColumn("is_primary", F.lit(True))
    fresh = _new_summaries(enrichments, good.where("old_id IS NULL").drop("old_id"), now, _last_id(enrichments))
    again = good.where("old_id IS NOT NULL").withColumnRenamed("old_id", "id")
    again = again.select(*[(F.lit(now) if f.name == "enriched_at" else F.col(f.name) if f.name in again.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in enrichments.schema])
    kept = enrichments.join(again.select("id"), "id", "left_anti").select(*enrichments.columns)
    return kept.unionByName(again).unionByName(fresh), refused, good.select("publication_id")


def add_candidates(enrichments: DataFrame, made: DataFrame, now: str) -> DataFrame:
    """enrichments with made(publication_id, one_liner, summary, …) beside what
    is there. Where a publication has no primary summary, its first one is: one
    with candidates only would have none at all."""
    last = _last_id(enrichments)
    new = storage.stored(_new_summaries(enrichments, made.withColumn("is_primary", F.lit(False)), now, last), "candidates")
    first = new.join(enrichments.where("is_primary").select("publication_id"), "publication_id", "left_anti").groupBy("publication_id").agg(F.min("id").alias("id"))
    new = new.join(first.select("id", F.lit(True).alias("first")), "id", "left").withColumn("is_primary", F.coalesce("first", F.lit(False)))
    return enrichments.unionByName(new.select(*enrichments.columns))


def primary_violations(enrichments: DataFrame) -> DataFrame:
    return enrichments.where("is_primary").groupBy("publication_id").agg(F.count("*").alias("n")).where("n > 1")


# Titles of pages that invite to an event.
EVENT_TITLES = ("registration form", "registration", "anmeldung", "anmeldeformular", "anmeldung zur veranstaltung")


def settle(urls: DataFrame) -> DataFrame:
    """Dispositions given by hand over the proposal: event pages and pages
    without a date or 250 words are excluded."""
    event = F.rtrim(F.lower(F.trim(F.coalesce("probe_title", F.lit("")))), F.lit(" .!")).isin(*EVENT_TITLES)
    proposal = F.when(event, "exclude").when(F.col("probe_has_date") & (F.col("probe_words") >= 250), "ingest").otherwise("exclude")
    return urls.withColumn("disposition", F.coalesce("disposition", proposal))


def decided(urls: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """urls with decisions(url, disposition, note) over any proposal; each
    stamps settled_at, which takes the row off the list of open ones."""
    new = decisions.select("url", F.col("disposition").alias("d"), F.nullif(F.trim("note"), F.lit("")).alias("t"), F.lit(now).alias("at"))
    both = urls.join(new, "url", "left")
    pick = lambda a, b: F.when(F.col("at").isNotNull(), F.col(a)).otherwise(F.col(b))
    return both.withColumns({"disposition": pick("d", "disposition"), "note": pick("t", "note"), "settled_at": F.coalesce("at", "settled_at")}).select(*urls.columns)


def reopened_urls(urls: DataFrame, again: DataFrame) -> DataFrame:
    """urls whose rows again(url) are open once more."""
    return urls.join(again.select("url", F.lit(True).alias("again")), "url", "left").withColumn("settled_at", F.when(F.col("again").isNull(), F.col("settled_at"))).select(*urls.columns)


def shortlist(current: DataFrame, marks: DataFrame) -> DataFrame:
    """Marking again keeps added_at and replaces the note."""
    new = marks.select("publication_id", F.col("note").alias("new_note"), F.col("added_at").alias("new_at"), F.lit(True).alias("marked"))
    both = current.join(new, "publication_id", "full_outer")
    return both.select("publication_id", F.when(F.col("marked"), F.col("new_note")).otherwise(F.col("note")).alias("note"), F.coalesce("added_at", "new_at").alias("added_at"))


def stale_blurbs(blurbs: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Blurbs written from another summary than the primary one."""
    now = enrichments.where("is_primary").select("publication_id", F.col("id").alias("primary_id"))
    return blurbs.join(now, "publication_id", "left").where(~F.col("source_enrichment_id").eqNullSafe(F.col("primary_id"))).select("publication_id", "source_enrichment_id", "primary_id")


def append_positions(current: DataFrame, added: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """added with positions that go on from each parent's last one, from 0."""
    last = current.groupBy(parent).agg(F.max("position").alias("last"))
    keys = ", ".join(order)
    return added.join(last, parent, "left").selectExpr(*added.columns, f"coalesce(last, -1) + row_number() OVER (PARTITION BY {parent} ORDER BY {keys}) AS position")


def note_status(notes: DataFrame, today: str) -> DataFrame:
    """Upcoming notes with what follows from their dates: status, age, lead
    (days from creation to landing) and whether they came by the quarter."""
    quarter = lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))
    status = F.when(F.col("landed_at").isNotNull(), "landed").when(F.col("shelved_at").isNotNull(), "shelved").when(F.col("expected") < quarter(F.lit(today).cast("date")), "overdue").otherwise("open")
    return notes.select(
        "*",
        status.alias("status"),
        F.datediff(F.lit(today).cast("date"), F.col("created_at")).alias("age_days"),
        F.datediff("landed_at", "created_at").alias("lead_days"),
        F.when(F.col("landed_at").isNotNull() & F.col("expected").isNotNull(), quarter(F.col("landed_at")) <= F.col("expected")).alias("on_time"),
    )


def note_stats(notes: DataFrame, least: int = 3) -> DataFrame:
    """Median lead and punctuality; null until `least` notes have landed."""
    own = notes.where("status = 'landed'").agg(F.count("*").alias("landed"), F.expr("median(CASE WHEN lead_days >= 0 THEN lead_days END)").alias("median_lead"), F.count_if("on_time").alias("on_time"), F.count("on_time").alias("judged"))
    enough = F.col("landed") >= least
    return own.select("landed", *[F.when(enough, F.col(c)).alias(c) for c in ("median_lead", "on_time", "judged")])


def by_precedence(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert where what was entered by hand beats what was found: automatic
    changes add rows but never replace any; manual ones replace."""
    rank = lambda df, turn: df.withColumn("__r", F.when(F.col("source") == "manual", 2 + turn).otherwise(1 - turn))
    return latest(rank(current, 0).unionByName(rank(changes, 1)), keys, ["__r"]).select(*current.columns)


def dismiss(enrichments: DataFrame, reviews: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates leave with their verdicts; a primary summary stays."""
    leaving = enrichments.where("NOT is_primary").join(gone.select("id"), "id", "left_semi").select("id")
    dead = leaving.select(F.col("id").alias("subject_id"), F.lit("enrichment").alias("scope"))
    return enrichments.join(leaving, "id", "left_anti"), reviews.join(dead, ["scope", "subject_id"], "left_anti").select(*reviews.columns)


def resummarised(vectors: DataFrame, topics: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new primary summary makes its one-liner's vector and topics void."""
    own = changed.select("publication_id").distinct()
    dead = own.select("publication_id", F.lit("one_liner").alias("source_type"))
    return vectors.join(dead, ["publication_id", "source_type"], "left_anti").select(*vectors.columns), topics.join(own, "publication_id", "left_anti")


def reindexed(docs: DataFrame) -> DataFrame:
    """What the keyword index holds of docs(id, title, subtitle, description,
    body): the description only where there is no body."""
    return docs.select("id", "title", "subtitle", F.when(F.col("body").isNull(), F.col("description")).alias("description"), "body")


def cascaded(catalog: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The catalog without publications gone(id): their children go too,
    chapters lose their parent."""
    out = dict(catalog)
    ids = gone.select("id").distinct()
    p = catalog["publications"].join(ids, "id", "left_anti")
    lost = ids.select(F.col("id").alias("parent_id"), F.lit(True).alias("__lost"))
    p = p.join(lost, "parent_id", "left").withColumn("parent_id", F.when(F.col("__lost").isNull(), F.col("parent_id")))
    out["publications"] = p.select(*catalog["publications"].columns)
    for name in ("credits", "publication_site_tags", "publication_text", "sections", "enrichments", "publication_topics", "blurbs", "shortlist", "publication_collections", "landscape_coords"):
        if name in out:
            out[name] = out[name].join(ids.select(F.col("id").alias("publication_id")), "publication_id", "left_anti").select(*catalog[name].columns)
    return out


def note_problems(notes: DataFrame, topics: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(id, problem): over three topics, unknown ones, a malformed quarter, a
    note both landed and shelved, or shelved without a reason."""
    many = topics.groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("n")).where("n > 3").select("id", F.lit("more than three topics").alias("problem"))
    unknown = topics.join(storage.small(vocabulary.select(F.col("slug").alias("topic_slug"))), "topic_slug", "left_anti").select(F.col("note_id").alias("id"), F.lit("a topic is unknown").alias("problem")).distinct()
    both = F.when(F.col("landed_at").isNotNull() & F.col("shelved_at").isNotNull(), "landed and shelved").when(F.col("shelved_at").isNotNull() & (F.trim(F.coalesce("note", F.lit(""))) == ""), "shelved without a reason").when(~F.col("expected").rlike(r"^\d{4}-Q[1-4]$"), "no quarter")
    return many.union(unknown).union(notes.select("id", both.alias("problem")).where("problem IS NOT NULL"))


def note_changes(notes: DataFrame, publications: DataFrame, asked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(notes, refused) after asked(id, action, text, publication_id), one row
    a note: shelve (the text says why), link (to the publication it landed
    as), reopen. refused is (id, problem); a refused row changes nothing.
    created_at always stays, since lead times are counted from it."""
    new = asked.select("id", "action", F.nullif(F.trim("text"), F.lit("")).alias("text"), F.col("publication_id").alias("target"))
    new = new.join(publications.select(F.col("id").alias("target"), F.lit(True).alias("known")), "target", "left")
    state = notes.select("id", F.lit(True).alias("there"), F.col("publication_id").alias("landed"), F.col("shelved_at").alias("shelved"))
    judged = new.join(state, "id", "left").withColumn(
        "problem",
        F.when(F.col("there").isNull(), "no such note")
        .when((F.col("action") == "shelve") & F.col("text").isNull(), "shelving takes a reason")
        .when((F.col("action") == "shelve") & F.col("landed").isNotNull(), "it has landed")
        .when((F.col("action") == "link") & F.col("shelved").isNotNull(), "it is shelved")
        .when((F.col("action") == "link") & F.col("known").isNull(), "no such publication")
        .when(~F.col("action").isin("shelve", "link", "reopen"), "no such action"),
    )
    good = judged.where("problem IS NULL").select("id", "action", "text", "target")
    done = F.col("action").isNotNull()
    at = lambda action, c: F.when(~done, F.col(c)).when(F.col("action") == action, F.lit(now))
    shelving = F.col("action") == "shelve"
    out = notes.join(good, "id", "left").withColumns(
        {
            "publication_id": F.when(~done | shelving, F.col("publication_id")).when(F.col("action") == "link", F.col("target")),
            "landed_at": at("link", "landed_at"),
            "shelved_at": at("shelve", "shelved_at"),
            "shelved_reason": F.when(~done, F.col("shelved_reason")).when(shelving, F.col("text")),
            "updated_at": F.when(done, F.lit(now)).otherwise(F.col("updated_at")),
        }
    )
    kinds = [F.col(x).cast(notes.schema[x].dataType).alias(x) for x in notes.columns]
    return out.select(*kinds), judged.where("problem IS NOT NULL").select("id", "problem")


def edited_notes(notes: DataFrame, edits: DataFrame, now: str) -> DataFrame:
    """notes with edits(id, working_title, note, expected): a known id is
    corrected and keeps created_at, a null one is a new note. A note needs a
    title, and a quarter as `YYYY-Qn` or none."""
    clean = edits.select("id", F.trim("working_title").alias("working_title"), F.nullif(F.trim("note"), F.lit("")).alias("note"), F.nullif(F.trim("expected"), F.lit("")).alias("expected"))
    bad = clean.where((F.coalesce("working_title", F.lit("")) == "") | ~F.coalesce(F.col("expected").rlike(r"^\d{4}-Q[1-4]$"), F.lit(True)))
    if bad.limit(1).count():
        raise ValueError("a note needs a title, and a quarter as YYYY-Qn or none")
    fields = ("working_title", "note", "expected")
    kept = notes.join(clean.where("id IS NOT NULL").select("id", *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("again")), "id", "left")
    kept = kept.withColumns({f: F.when(F.col("again"), F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields} | {"updated_at": F.when(F.col("again"), F.lit(now)).otherwise(F.col("updated_at"))})
    first = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = storage.numbered(clean.where("id IS NULL").drop("id"), ["working_title", "expected", "note"], "id", first).withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})
    shape = lambda df: df.select(*[(F.col(x) if x in df.columns else F.lit(None)).cast(notes.schema[x].dataType).alias(x) for x in notes.columns])
    return shape(kept).unionByName(shape(new))


def renamed_collection(c: dict[str, DataFrame], slug: str, name: str) -> DataFrame:
    """collections with another name for one slug, which stays."""
    return c["collections"].withColumn("name", F.when(F.col("slug") == slug, F.lit(name.strip())).otherwise(F.col("name")))


def dropped_collection(c: dict[str, DataFrame], slug: str) -> dict[str, DataFrame]:
    """The catalog without a collection and its memberships; no publication
    goes with it."""
    return dict(c) | {"collections": c["collections"].where(F.col("slug") != slug), "publication_collections": c["publication_collections"].where(F.col("slug") != slug)}


def written_summaries(enrichments: DataFrame, written: DataFrame, now: str) -> DataFrame:
    """enrichments with one-liners and summaries written by hand as primary
    rows. written(publication_id, one_liner, summary) of over 30 words in the
    one-liner is left out; findings and entities carry over from the primary
    row there was."""
    fit = written.where(X.word_count(F.col("one_liner")) <= 30).select("publication_id", F.col("one_liner").alias("__line"), F.col("summary").alias("__text"))
    old = enrichments.where("is_primary").join(fit, "publication_id")
    last = enrichments.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = storage.numbered(fit.join(old.drop("__line", "__text"), "publication_id", "left"), ["publication_id"], "__id", last)
    values = {"id": F.col("__id").cast("long"), "is_primary": F.lit(True), "one_liner": F.col("__line"), "summary": F.col("__text"), "model": F.lit("manual"), "enriched_at": F.lit(now).cast("timestamp")}
    new = ranked.select(*[values.get(c, F.col(c)).alias(c) for c in enrichments.columns])
    demoted = enrichments.join(fit.select("publication_id", F.lit(True).alias("__new")), "publication_id", "left")
    demoted = demoted.withColumn("is_primary", F.col("is_primary") & F.col("__new").isNull()).select(*enrichments.columns)
    return demoted.unionByName(new)
