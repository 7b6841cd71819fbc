"""Visible text of pages: layout, implied tags and visibility."""

import random
import time

import pytest

from lectern.llm import html_text
from lectern.llm.html_text import extract

DEEP = 50_000

CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b <b>c</b>\n d</div>", "a\nb c d"),
    ("<title>t</title><p>x</p><script>var t='</p>';</script><style>p{}</style>", "x"),
    ("<p>a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c"),
    ("<ol start=3><li>x</li><li><p>y</p><p>z</p></li></ol>", "3. x\n4. y\n\n   z"),
    ("<table><tr><th>ab<th>c<tr><td>d<td>efg</table>", "ab | c\nd  | efg"),
    ("<table><tr><td colspan=2>wide cell here</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide cell here\na | b"),
    ("<table><tr><td rowspan=2>r</td><td>1</td></tr><tr><td>2</td></tr></table>", "r | 1\n  | 2"),
    ("<div hidden>no</div><p style='color:red; DISPLAY : none'>no</p><i style='visibility:hidden'>no</i>yes", "yes"),
    ("<p style='display:nonesuch'>yes</p>", "yes"),
    ("a<!-- no -->b &amp; &lt;c&gt; &copy;", "ab & <c> ©"),
    ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    ("<blockquote><p>q</p></blockquote>", "> q"),
    ("<p><b>bold<p>next</b>tail</p>", "bold\n\nnexttail"),
    ("x</p>y", "x\n\ny"),
    ("<nav><a href=x>1</a> <a>2</a></nav><img alt='pic'>", "1 2\npic"),
    ("<template>no</template><noscript>no</noscript><input type=hidden value=no><input value=ok>", "ok"),
]


@pytest.mark.parametrize("source,want", CASES)
def test_cases(source, want):
    assert extract(source) == want


def test_deep_and_broken_markup():
    assert extract("<ul>" * 3 + "<li>x" + "</div></p>" * 3)
    assert extract("<table><tr><td>" * 30 + "x").endswith("x")


def test_all_words_of_plain_pages_survive(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {x.page_id: x.html for x in pages.collect()}
    rows = html_text.extracted(pages.withColumn("text", pages.url)).collect()
    assert len(rows) == len(sources)
    marks = {"-", "|", ">", "---"}
    for r in rows:
        got = [w for w in r.text.split() if w not in marks]
        want = [w for w in html_text.words_of_markup(sources[r.page_id]) if w not in marks]
        assert "".join(got) == "".join(want)


def test_empty_table(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


WHOLE = [
    ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>cc<td>d</tr></form></tbody></table>", "a  | b\ncc | d"),
    ("<table><div><tr><form><td>a</td><td>b</td></form></tr></div></table>", "a | b"),
    ("<table><tbody>bare<div>in a div</div><tr><td>x</td></tr></tbody></table>", "bare\nin a div\nx"),
    ("<table><tbody><td>a</td><td>b</td></tbody><tbody hidden><tr><td>no</td></tr>no</tbody></table>", "a | b"),
    ("x<svg><title>no</title><defs><text>no</text></defs><desc/><g><text>one</text><path d='M0'/><text>two<tspan dy=1>three</tspan></text></g></svg>y", "x\none\ntwo\nthree\ny"),
    ("<a>b<svg><path/></svg>c</a>", "bc"),
    ("<svg><text>in<p>out", "in\n\nout"),
    ("so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "so x=1"),
    ("<map><area alt=no><a href=u>there</a></map>", "there"),
]


@pytest.mark.parametrize("source,want", WHOLE)
def test_nothing_visible_is_dropped(source, want):
    assert extract(source) == want


SHOWN = [
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no</p>", "yes"),
    ("<table><tr style='visibility:collapse'><td>no<tr><td>yes</table>", "yes"),
    ("<ul><li style='visibility:hidden'>no<li>yes</ul>", "- yes"),
    ("<i style='display:none;display:inline'>yes</i><i style='display:none!important;display:inline'>no</i>", "yes"),
    ("<input type=checkbox value=no><input type=PASSWORD value=no><input type=radio value=no><input type=submit value=Go><input type=odd2 value=text>", "Gotext"),
    ("<textarea><b>x</b> &amp; y</textarea>", "<b>x</b> & y"),
    ("<script>if (a<b) '</p>'</script><xmp><i></xmp><plaintext></p>", "<i></p>"),
    ("<svg><text><![CDATA[<a>]]></text></svg>", "<a>"),
    ("<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>", "xy"),
]


@pytest.mark.parametrize("source,want", SHOWN)
def test_visibility_and_raw_text(source, want):
    assert extract(source) == want


BROKEN = [
    ("<![foo x", ""),
    ("a<![if x]>b<![endif]>c", "abc"),
    ("a<b", "a"),
    ("a < b <3 c<", "a < b <3 c<"),
    ("a<b c='d", "a"),
    ("a</ b>c</>d", "acd"),
    ("a<!-- b", "a"),
    ("a<!-->b<!--->c", "abc"),
    ("<a b=1 b=2 =c/d>x</a >", "x"),
    ("&#99999999999; &#x110000; &#0000000000065; &#" + "9" * 6000 + ";", "\ufffd \ufffd A \ufffd"),
]


@pytest.mark.parametrize("source,want", BROKEN)
def test_broken_markup(source, want):
    assert extract(source) == want


HEAVY = {tag: f"<{tag}>" * DEEP + "x" for tag in "div ul ol blockquote table span p li dl svg details section b form td tr math dialog foreignobject option pre".split()}
HEAVY |= {
    "items": "<ul><li>" * DEEP + "x",
    "items with text": "<ol><li>t" * DEEP + "x",
    "quotes with text": "<blockquote>t" * DEEP + "x",
    "tables": "<table><tr><td>" * (DEEP // 2) + "x",
    "tables with text": "<table><tr><td>t" * (DEEP // 2) + "x",
    "embedded svg": "<svg><foreignobject>" * DEEP + "x",
    "comments": "x" + "<!--" * DEEP,
    "cut off tags": "x" + "<a " * DEEP,
    "cut off values": "x" + "<a b='" * DEEP,
    "formatting under an item": "<ul>" + "<b>" * DEEP + "<li>x" * DEEP,
    "many ends": "<div>" * DEEP + "x" + "</b>" * DEEP,
    "wide spans": "<table><tr>" + "<td rowspan=1000 colspan=1000>x" * 3 + "<tr><td>b" * 1000,
    "many spans": "<table><tr>" + "<td rowspan=9999>x" * 5000 + "<tr><td>b" * 5000,
    "one wide cell": "<table><tr><td>" + "x " * 60_000 + "<tr><td>a<td>b" * 10_000,
}


@pytest.mark.parametrize("name", HEAVY)
def test_time_and_size_follow_the_page(name):
    began = time.process_time()
    text = extract(HEAVY[name])
    assert time.process_time() - began < 4
    assert len(text) < 20 * len(HEAVY[name])
    assert ("x" in text) is (name not in ("details", "dialog", "svg"))


class Plain:
    """A second renderer, by recursion over random trees of (tag, kids)."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def inline(self):
        r = self.r
        return [r.choice(["ab", "cde f", "g &amp; h", "日本", ("b", ["ij"]), ("hide", ["no"]), ("br", [])]) for _ in range(r.randrange(1, 4))]

    def blocks(self, depth):
        r, out = self.r, []
        for _ in range(r.randrange(1, 4)):
            kind = r.choice(["p", "div", "ul", "ol", "blockquote", "table", "text"] if depth else ["p", "text"])
            if kind in ("p", "text"):
                out.append(("p" if kind == "p" else "div", self.inline()))
            elif kind in ("ul", "ol"):
                out.append((kind, [("li", self.inline() if r.random() < 0.6 else self.blocks(depth - 1)) for _ in range(r.randrange(1, 4))]))
            elif kind == "table":
                width = r.randrange(1, 4)
                out.append((kind, [("tr", [("td", self.inline()) for _ in range(width)]) for _ in range(r.randrange(1, 4))]))
            else:
                out.append((kind, self.blocks(depth - 1)))
        return out

    def markup(self, kids):
        out = ""
        for kid in kids:
            if isinstance(kid, str):
                out += kid
                continue
            tag, own = kid
            if tag == "hide":
                out += self.r.choice(["<i hidden>{}</i>", "<i style='display: none'>{}</i>", "<script>{}</script>", "<!-- {} -->"]).format(self.markup(own))
            elif tag == "br":
                out += "<br>"
            else:
                end = "" if tag in ("li", "tr", "td") and self.r.random() < 0.5 else f"</{tag}>"
                out += f"<{tag}>{self.markup(own)}{end}"
        return out

    def lines(self, kids):
        out, line, gap = [], "", False

        def close(keep=False):
            nonlocal line, gap
            if line.strip():
                if gap and out and out[-1]:
                    out.append("")
                out.append(line.strip())
                gap = False
            elif keep and out:
                out.append("")
            line = ""

        def walk(kids):
            nonlocal line, gap
            for kid in kids:
                tag, own = ("", kid) if isinstance(kid, str) else kid
                if not tag:
                    line += own.replace("&amp;", "&")
                elif tag == "b":
                    line += own[0]
                elif tag == "br":
                    close(True)
                elif tag in ("p", "div"):
                    close()
                    gap = gap or tag == "p"
                    walk(own)
                    close()
                    gap = gap or tag == "p"
                elif tag != "hide":
                    close()
                    body = self.block(tag, own)
                    if body and out and out[-1]:
                        out.append("")
                    out.extend(body)
                    gap = gap or bool(body)

        walk(kids)
        close()
        return self.stripped(out)

    @staticmethod
    def stripped(lines):
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines

    def block(self, tag, own):
        if tag in ("ul", "ol"):
            out = []
            for n, (_, kids) in enumerate(own, 1):
                mark = f"{n}. " if tag == "ol" else "- "
                body = self.lines(kids) or [""]
                out += [(mark + body[0]).rstrip()] + [(" " * len(mark) + x).rstrip() for x in body[1:]]
            return out
        if tag == "blockquote":
            return [("> " + x).rstrip() for x in self.lines(own)]
        if tag == "table":
            rows = [[self.lines(kids) or [""] for _, kids in row] for _, row in own]
            wide = [max(html_text.width(x) for row in rows for x in row[c]) for c in range(len(rows[0]))]
            pad = lambda x, c: x + " " * (wide[c] - html_text.width(x))
            return self.stripped([" | ".join(pad(cell[i] if i < len(cell) else "", c) for c, cell in enumerate(row)).rstrip() for row in rows for i in range(max(map(len, row)))])
        raise ValueError(tag)


def test_against_a_plain_renderer():
    for seed in range(600):
        plain = Plain(seed)
        tree = plain.blocks(3)
        source = plain.markup(tree)
        want = "\n".join(plain.lines(tree))
        assert extract(source) == want, source


def test_repeated_rows_and_bytes(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    bad = pages.selectExpr("page_id", "url", "cast(concat(cast(html AS binary), X'FF') AS string) AS html", "'q' AS text")
    assert sorted((x.page_id or 0, x.text) for x in html_text.extracted(bad).collect()) == [(0, ""), (1, "a\ufffd"), (1, "a\ufffd")]


@pytest.mark.parametrize("many", [10, 26_000])
def test_a_table_of_any_size_is_aligned(many):
    plain = extract("<table>" + "<tr><td>a<td>bc<tr><td>def<td>g" * many + "</table>").split("\n")
    assert plain == ["a   | bc", "def | g"] * many
    spanned = extract("<table>" + "<tr><td rowspan=2>abc<td>1<tr><td>2<tr><td colspan=2>x<td>y" * (many // 10) + "</table>").split("\n")
    assert spanned == ["abc | 1", "    | 2", "x       | y"] * (many // 10)
