"""Whole publication records from raw pages, teasers left out.

A page shows its own record as an article, and often others as articles inside
it. All reading here goes through ``own``, a walk that does not enter foreign
articles, so nothing of a teaser can leak into the record. What can't be read
as a record comes back with a problem instead of an exception.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as X

_PERSON = pa.struct([("name", pa.string()), ("slug", pa.string()), ("job_title", pa.string()), ("role", pa.string()), ("is_internal", pa.bool_())])
RECORD = pa.struct(
    [("title", pa.string()), ("subtitle", pa.string()), ("date_text", pa.string()), ("pub_type", pa.string()), ("series", pa.string()), ("access", pa.string()),
     ("pdf_url", pa.string()), ("description", pa.string()), ("people", pa.list_(_PERSON)), ("site_tags", pa.list_(pa.string())), ("images", pa.list_(pa.string()))]
)
DDL = (
    "struct<title:string,subtitle:string,date_text:string,pub_type:string,series:string,access:string,pdf_url:string,description:string,"
    "people:array<struct<name:string,slug:string,job_title:string,role:string,is_internal:boolean>>,site_tags:array<string>,images:array<string>>"
)


@dataclass(frozen=True)
class Markup:
    """How a site marks its fields. Class names of the content
    management system whose pages are read."""

    base: str = "https://example.org"
    field: str = "field-name-field-"
    full: str = "view-mode-full"
    paywall: str = "view-mode-paywall"
    locked: str = "lock-icon"
    team: str = "/team/"
    files: str = "/sites/default/files/"
    roles: dict[str, str] = dataclasses.field(default_factory=lambda: {"authors": "author", "host": "host", "guests": "guest"})


def own(article: dom.Element, media: bool = False) -> Iterator[dom.Element]:
    """Elements of an article in order, without those of articles inside it;
    with media, wrappers of attached files count as part of it."""
    todo = list(reversed(article.children))
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            continue
        foreign = e.tag == "article" and not (media and any(c.startswith("media") for c in e.classes))
        if not foreign:
            yield e
            todo += reversed(e.children)


def own_article(root: dom.Element, m: Markup) -> dom.Element | None:
    """The article around the full or paywalled view, or around the h1."""
    every = list(root.walk())
    for found in (lambda e: e.tag == "div" and m.full in e.classes, lambda e: e.tag == "div" and m.paywall in e.classes, lambda e: e.tag == "h1"):
        at = next((e for e in every if found(e)), None)
        while at is not None and at.tag != "article":
            at = at.parent
        if at is not None:
            return at
    return None


def absolute(href: str | None, base: str) -> str | None:
    """href with the site's base; an address wrapped in a path with its scheme
    percent-encoded is unwrapped, and nothing else is decoded."""
    if not href or href.startswith(("http://", "https://")):
        return href or None
    path = re.sub(r"(?i)^/index(%2e|\.)php", "", re.split("[?#]", href)[0])
    inner = re.match(r"/?(https?)%3a(//.*)", path, re.I)
    return inner[1] + ":" + inner[2] if inner else f"{base}/{path.lstrip('/')}"


def _people(box: dom.Element, role: str, m: Markup) -> list[dict]:
    """One person for each direct item of a field."""
    items = box.first(cls="field-items")
    out: dict[str, dict] = {}
    for item in items.children if items is not None else ():
        if isinstance(item, str) or "field-item" not in item.classes:
            continue
        job = item.first(cls=m.field + "job-title")
        link = next((e for e in item.walk() if e.tag == "a" and m.team in e.attrs.get("href", "")), None)
        label = link if link is not None else item.first(cls="node-title")
        name = label.text() if label is not None else item.text().replace(job.text() if job is not None else "\0", "").strip()
        slug = re.split("[?#]", link.attrs["href"])[0].strip("/").rsplit("/", 1)[-1] if link is not None else None
        if name:
            out.setdefault(slug or name, {"name": name, "slug": slug or None, "job_title": (job.text() or None) if job is not None else None, "role": role})
    return list(out.values())


def _pdf(article: dom.Element, fields: dict[str, list[dom.Element]], m: Markup) -> str | None:
    """A PDF in the download fields, or else among the article's own files;
    links of footnotes lead elsewhere and don't count."""
    boxes = [*fields.get("download", ()), *fields.get("media-file", ())]
    near = [e for b in boxes for e in b.walk()] + [e for e in own(article, media=True) if m.files in e.attrs.get("href", "")]
    return next((e.attrs["href"] for e in near if e.tag == "a" and ".pdf" in e.attrs.get("href", "").lower()), None)


def record(html: str | None, m: Markup, pub_type: str | None = None, series: str | None = None) -> tuple[dict | None, str | None]:
    """(record, None) or (None, why there is none). A type that is given
    stands for the page's own, with its series."""
    root = dom.parse(html)
    article = own_article(root, m)
    if article is None:
        return None, "no main article"
    fields: dict[str, list[dom.Element]] = {}
    for e in own(article):
        for c in e.classes:
            if c.startswith(m.field):
                fields.setdefault(c[len(m.field) :], []).append(e)
    first = lambda name: fields[name][0] if name in fields else None
    said = lambda e: (e.text() or None) if e is not None else None
    meta = {e.attrs.get("property"): e.attrs.get("content", "").strip() or None for e in root.walk() if e.tag == "meta"}

    kind = first("publication-type")
    if kind is None and not pub_type:
        return None, "no publication type"
    terms = [t for t in (pub_type, series) if t] if pub_type else [t for e in kind.walk() if "taxonomy-term" in e.classes and (t := e.text())] or [t for t in [kind.text()] if t]
    title = said(article.first(tag="h1")) or meta.get("og:title")
    if not terms or not title:
        return None, "no title" if terms else "no publication type"

    people = [p for name, role in m.roles.items() if name in fields for p in _people(fields[name][0], role, m)]
    team = {p["slug"] for box in fields.get("guest-team", ()) for p in _people(box, "guest", m)} - {None}
    for p in people:
        p["is_internal"] = p["slug"] is not None and (p["role"] != "guest" or p["slug"] in team)
    when = first("date-published")
    stamp = when.first(tag="time") if when is not None else None
    locked = m.locked in article.classes or any(e.tag == "div" and m.paywall in e.classes for e in root.walk())
    pictures = [e for e in (first("content").walk() if "content" in fields else ()) if e.tag == "img" and e.attrs.get("src")]
    return {
        "title": title,
        "subtitle": said(first("subtitle")),
        "date_text": (stamp.attrs.get("datetime") if stamp is not None else None) or said(when),
        "pub_type": terms[0],
        "series": " / ".join(terms[1:]) or None,
        "access": "member" if locked else "public",
        "pdf_url": absolute(_pdf(article, fields, m), m.base),
        "description": meta.get("og:description"),
        "people": people,
        "site_tags": list(dict.fromkeys(t for box in fields.get("tags", ()) for e in box.walk() if e.tag == "a" and (t := e.text()))),
        "images": list(dict.fromkeys(absolute(re.sub(r"/styles/[^/]+/public/", "/", e.attrs["src"]), m.base) for e in pictures)),
    }, None


def records(pages: DataFrame, markup: Markup = Markup(), given: bool = False) -> DataFrame:
    """(page_id, url, slug, record, problem, date_published) of pages(page_id,
    url, html), with given also of their columns pub_type and series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = [record(h, markup, *more) for h, *more in zip(*(c.to_pylist() for c in part.columns[2:]))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r for r, _ in got], RECORD), pa.array([p for _, p in got], pa.string())], names=["page_id", "url", "record", "problem"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", *(["pub_type", "series"] if given else [])).mapInArrow(run, f"page_id long, url string, record {DDL}, problem string")
    return rows.withColumn("slug", X.url_slug(F.col("url"))).withColumn("date_published", X.parsed_date(F.col("record.date_text")))


def sorted_out(pages: DataFrame) -> DataFrame:
    """(url, status) after a crawl of pages(url, http_status, final_url,
    problem): moved or missing pages are gone for good, pages without a record
    are skipped, other failures may be tried again."""
    status = F.when(F.col("http_status").isin(403, 404, 410), "gone").when(F.col("http_status") != 200, "failed")
    status = status.when(F.col("final_url").isNotNull() & ~X.same_page(F.col("url"), F.col("final_url")), "gone")
    return pages.select("url", status.when(F.col("problem").isNotNull(), "skipped").otherwise("done").alias("status"))
