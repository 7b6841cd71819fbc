"""Readers, the map, and the streaming extension."""

import json
import urllib.error

import numpy as np
import pytest

from lectern.operators import landscape
from lectern.sources import readers
from lectern.streaming import worklist


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://x/a </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x/b</loc></url><url><lastmod>q</lastmod></url></urlset>')
    assert [tuple(r) for r in readers.sitemap(spark, str(tmp_path / "s.xml")).orderBy("url").collect()] == [("https://x/a", "2024-01-01"), ("https://x/b", None)]


def test_cached_pages_and_pdfs(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>a\nb</p>")
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "y.pdf").write_bytes(b"<html>")
    assert [tuple(r) for r in readers.cached_pages(spark, str(tmp_path)).collect()] == [("one", "<p>a\nb</p>")]
    assert [r.path.rsplit("/", 1)[-1] for r in readers.pdf_files(spark, str(tmp_path)).collect()] == ["x.pdf"]


def test_roster_and_records(spark):
    html = '<div class="views-row"><a href="/en/team/ann/">A</a><span class="field-name-field-job-title"> Lead  Analyst </span></div><div class="views-row"><a href="/en/team/ann">B</a></div><div class="views-row"><p>x</p></div>'
    pages = spark.createDataFrame([("team", html)], "source string, html string")
    assert [tuple(r) for r in readers.roster(pages).collect()] == [("ann", "Lead Analyst", "team")]
    page = '<meta property="og:description" content="D"><article><h1>T</h1><time datetime="2024-05-06T00:00:00Z">x</time><p>one two</p><article><h1>teaser</h1></article></article>'
    r = readers.publication_records(spark.createDataFrame([(1, page)], "page_id long, html string")).first()
    assert (r.title, r.description, str(r.date_published)) == ("T", "D", "2024-05-06")


def test_vocabulary(spark):
    own = [{"cluster": "c", "topics": [{"slug": "a", "label": "A"}]}]
    assert readers.vocabulary(spark, own).first().slug == "a"
    with pytest.raises(ValueError):
        readers.vocabulary(spark, own + own)
    with pytest.raises(KeyError):
        readers.vocabulary(spark, [{"cluster": "c", "topics": [{"slug": "b"}]}])


def test_fetcher_waits_and_gives_up():
    calls, waits = [], []

    def opened(url):
        calls.append(url)
        raise urllib.error.HTTPError(url, 503 if "busy" in url else 404, "", {}, None)

    f = readers.Fetcher(pause=0, opened=opened, sleep=waits.append)
    with pytest.raises(urllib.error.HTTPError):
        f.get("http://x/busy")
    assert len(calls) == 4 and [w for w in waits if w >= 5] == [5, 10, 20]
    calls.clear()
    with pytest.raises(urllib.error.HTTPError):
        f.get("http://x/none")
    assert len(calls) == 1


def test_embedding_provider(spark):
    rows = spark.createDataFrame([(i, f"word{i} again") for i in range(5)], "id long, text string")
    got = readers.embedded(rows, readers.hashed_embedding, batch=2).collect()
    assert len(got) == 5 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in got)
    with pytest.raises(Exception, match="vectors for"):
        readers.embedded(rows, lambda t: [[1.0]]).collect()


def test_map_separates_and_repeats(spark):
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(c, 0.05, (15, 8)) for c in (np.eye(8)[0], np.eye(8)[1])])
    y = landscape.embed2(x)
    assert np.array_equal(y, landscape.embed2(x))
    a, b = y[:15], y[15:]
    assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())
    assert landscape.embed2(x[:3]).shape == (3, 2)
    points = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    out = {p.id: p for p in landscape.fit(points, 24).collect()}
    assert len(out) == 30 and sum(p.placed == "incremental" for p in out.values()) == 6
    kept = landscape.refreshed(landscape.fit(points.where("id < 24"), 24), points.where("id > 0"))
    assert sorted(p.id for p in kept.collect()) == list(range(1, 30))


def test_streamed_worklist(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"url": "https://x/a", "lastmod": "1", "seen_at": "2024-01-01T00:00:00"}, {"url": "https://x/a", "lastmod": "1", "seen_at": "2024-01-01T01:00:00"}, {"url": "https://x/b", "lastmod": None, "seen_at": "2024-01-01T02:00:00"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = worklist.deduplicated(worklist.sightings(spark, str(tmp_path / "in")))
    q = worklist.keep_state(stream, str(tmp_path / "state"), str(tmp_path / "cp"), "now")
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "state/v=0"))
    assert sorted((r.url, r.status) for r in got.collect()) == [("https://x/a", "pending"), ("https://x/b", "pending")]
