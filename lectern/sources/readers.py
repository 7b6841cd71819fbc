"""Sources: sitemaps, cached pages, listings, vocabularies, pages over HTTP."""

from __future__ import annotations

import base64
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom
from ..functions import text as X


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of sitemap XML files, by Spark's own XML reader."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return rows.where("loc IS NOT NULL AND trim(loc) <> ''").select(F.trim("loc").alias("url"), "lastmod")


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, html) of `slug.html` files."""
    rows = spark.read.text(f"{folder}/*.html", wholetext=True).withColumn("path", F.input_file_name())
    return rows.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("slug"), F.col("value").alias("html"))


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of files that begin as PDFs do."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return rows.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select("path", "content")


def _mapped(df: DataFrame, columns: list[str], schema: str, kinds: list[pa.DataType], each: Callable[..., list[tuple]]) -> DataFrame:
    names = [x.strip().split()[0] for x in schema.split(",")] if "<" not in schema else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [t for values in zip(*(c.to_pylist() for c in batch.columns)) for t in each(*values)]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return df.select(*columns).mapInArrow(run, schema)


def roster(pages: DataFrame, row_class: str = "views-row", title_class: str = "field-name-field-job-title", link_part: str = "/team/") -> DataFrame:
    """(slug, title, source) of listing pages(source, html); the first entry of
    a slug within a page counts."""

    def each(source: str | None, html: str | None) -> list[tuple]:
        seen: dict[str, tuple] = {}
        for e in dom.parse(html).walk():
            if row_class not in e.classes:
                continue
            link = next((x for x in e.walk() if x.tag == "a" and link_part in x.attrs.get("href", "")), None)
            if link is not None:
                slug = link.attrs["href"].rstrip("/").rsplit("/", 1)[-1]
                title = e.first(cls=title_class)
                seen.setdefault(slug, (slug, title.text() if title is not None else None, source))
        return list(seen.values())

    return _mapped(pages, ["source", "html"], "slug string, title string, source string", [pa.string()] * 3, each)


def publication_records(pages: DataFrame) -> DataFrame:
    """(page_id, title, description, date_text, body_words) of pages(page_id,
    html): the record's own article only, never a teaser inside it."""

    def each(page_id: int, html: str | None) -> list[tuple]:
        from ..operators import documents

        root = dom.parse(html)
        own = documents.main_article(root)
        meta = {e.attrs.get("property") or e.attrs.get("name"): e.attrs.get("content") for e in root.walk() if e.tag == "meta"}
        head = (own or root).first(tag="h1")
        when = (own or root).first(tag="time")
        stamp = (when.attrs.get("datetime") or when.text()) if when is not None else None
        return [(page_id, head.text() if head is not None else None, meta.get("og:description") or meta.get("description"), stamp, len(documents.html_to_markdown(html).split()))]

    rows = _mapped(pages.withColumn("page_id", F.col("page_id").cast("long")), ["page_id", "html"], "page_id long, title string, description string, date_text string, body_words long", [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()], each)
    return rows.withColumn("date_published", X.parsed_date(F.col("date_text")))


def vocabulary(spark: SparkSession, clusters: list[dict]) -> DataFrame:
    """(slug, label, cluster, cluster_name, description) of a controlled
    vocabulary as parsed from YAML; missing keys and repeated slugs raise."""
    rows, seen = [], set()
    for i, c in enumerate(clusters):
        for t in c["topics"]:
            if t["slug"] in seen:
                raise ValueError(f"repeated slug {t['slug']}")
            seen.add(t["slug"])
            rows.append((t["slug"], t["label"], i, c["cluster"], t.get("description")))
    return spark.createDataFrame(rows, "slug string, label string, cluster int, cluster_name string, description string")



class Fetcher:
    """Pages over HTTP for use inside a partition: a pause between requests,
    four tries with doubled waits, no retry of 4xx but 429."""

    def __init__(self, pause: float = 2.0, tries: int = 4, wait: float = 5.0, opened=urllib.request.urlopen, sleep=time.sleep):
        self.pause, self.tries, self.wait, self.opened, self.sleep, self.last = pause, tries, wait, opened, sleep, 0.0

    def get(self, url: str) -> bytes:
        for turn in range(self.tries):
            self.sleep(max(0.0, self.last + self.pause - time.monotonic()))
            self.last = time.monotonic()
            try:
                with self.opened(url) as answer:
                    return answer.read()
            except urllib.error.HTTPError as why:
                if 400 <= why.code < 500 and why.code != 429 or turn == self.tries - 1:
                    raise
            except urllib.error.URLError:
                if turn == self.tries - 1:
                    raise
            self.sleep(self.wait * 2**turn)
        raise RuntimeError("no try was allowed")


def embedded(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], batch: int = 32, limit: int = 1000) -> DataFrame:
    """(id, vector) for rows(id, text), normalised, `limit` words at most. A
    provider that answers with another count raises: vectors would be paired
    with wrong texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(ids), batch):
                found = provider([t or "" for t in texts[i : i + batch]])
                if len(found) != len(ids[i : i + batch]):
                    raise ValueError(f"{len(found)} vectors for {len(ids[i : i + batch])} texts")
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + batch], pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["id", "vector"])

    raw = rows.select(F.col("id").cast("long").alias("id"), X.first_words(F.col("text"), limit).alias("text")).mapInArrow(run, "id long, vector array<double>")
    return raw.select("id", X.normalised(F.col("vector")).alias("vector"))


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """An offline provider: signed hashes of words, added up."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
        out.append(v)
    return out


def as_data_uri(content: bytes, kind: str) -> str:
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"
