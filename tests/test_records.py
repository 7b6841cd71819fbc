"""Records of whole pages: own fields only, people, files, paywalls."""

from lectern.sources import records as R

F = "field-name-field-"
M = R.Markup(base="https://x.org")


def person(name, slug=None, job=None):
    label = f'<a href="/en/team/{slug}/">{name}</a>' if slug else f'<h2 class="node-title">{name}</h2>'
    title = f'<div class="{F}job-title">{job}</div>' if job else ""
    return f'<div class="field-item"><article>{label}{title}<div class="field-items"><div class="field-item">{job or ""}</div></div></article></div>'


def field(name, body):
    return f'<div class="{F}{name}">{body}</div>'


def items(*people):
    return '<div class="field-items">' + "".join(people) + "</div>"


PAGE = f"""<html><head><meta property="og:description" content=" Short. "></head><body><article class="node"><h1>A  title</h1><div class="view-mode-full">
{field("publication-type", '<a class="taxonomy-term">Report</a><a class="taxonomy-term">S1</a><a class="taxonomy-term">S2</a>')}{field("subtitle", "Sub")}
{field("date-published", '<time datetime="2024-05-06T10:00:00Z">May</time>')}{field("authors", items(person("Ann", "ann", "Lead"), person("Bob"), person("Ann", "ann")))}
{field("guests", items(person("Cy", "cy"), person("Di", "di")))}{field("guest-team", items(person("Cy", "cy")))}{field("tags", "<a>t1</a><a>t2</a><a>t1</a>")}
{field("content", '<p>x <a href="https://other/doc.pdf">note</a></p><img src="/sites/default/files/styles/big/public/a.png?h=1"><img src="/a.png">')}
<article class="media media--type-file"><a href="/sites/default/files/own.PDF">get</a></article></div>
<article class="teaser"><h2>T</h2>{field("subtitle", "not mine")}{field("tags", "<a>foreign</a>")}<a href="/sites/default/files/foreign.pdf">no</a></article></article></body></html>"""


def test_a_whole_record():
    r, problem = R.record(PAGE, M)
    assert problem is None
    assert (r["title"], r["subtitle"], r["pub_type"], r["series"], r["access"], r["description"]) == ("A title", "Sub", "Report", "S1 / S2", "public", "Short.")
    assert [(p["name"], p["slug"], p["job_title"], p["role"], p["is_internal"]) for p in r["people"]] == [("Ann", "ann", "Lead", "author", True), ("Bob", None, None, "author", False), ("Cy", "cy", None, "guest", True), ("Di", "di", None, "guest", False)]
    assert r["site_tags"] == ["t1", "t2"] and r["pdf_url"] == "https://x.org/sites/default/files/own.PDF"
    assert r["images"] == ["https://x.org/sites/default/files/a.png", "https://x.org/a.png"]


def test_what_is_no_record():
    assert R.record("<p>x</p>", M) == (None, "no main article") and R.record(None, M)[1] == "no main article"
    assert R.record("<article><h1>t</h1></article>", M) == (None, "no publication type")
    locked = f'<article><div class="view-mode-paywall">{field("publication-type", "Brief")}</div><h1>t</h1></article>'
    assert R.record(locked, M)[0]["access"] == "member"


def test_absolute_addresses():
    assert R.absolute("/index%2Ephp/https%3A//x.org/a%20b.pdf", "https://x.org") == "https://x.org/a%20b.pdf"
    assert R.absolute("a.pdf", "https://x.org") == "https://x.org/a.pdf" and R.absolute(None, "x") is None


def test_in_spark(spark):
    rows = {r.page_id: r for r in R.records(spark.createDataFrame([(1, "https://x.org/en/report/a-b/", PAGE), (2, None, None)], "page_id long, url string, html string"), M).collect()}
    assert rows[1].slug == "a-b" and str(rows[1].date_published) == "2024-05-06" and len(rows[1].record.people) == 4
    assert rows[2].record is None and rows[2].problem
    crawl = [("https://x/a", 200, "http://www.x/a/", None), ("https://x/b", 200, "https://x/c", None), ("https://x/d", 404, None, None), ("https://x/e", 500, None, None), ("https://x/f", 200, None, "no title")]
    got = R.sorted_out(spark.createDataFrame(crawl, "url string, http_status int, final_url string, problem string")).collect()
    assert [r.status for r in got] == ["done", "gone", "gone", "failed", "skipped"]
