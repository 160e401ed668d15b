import base64
import hashlib

import duckdb
import pytest
from odd_rows import DATA
from pyspark.sql import functions as F

from repoquarry.llm import warc as w
from repoquarry.llm.html import extract_text, visible_text
from repoquarry.llm.oracles import ORACLES
from repoquarry.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, shard int, payload string"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("pages", "documents", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, result.fetchall()))


def odd_pages(spark):
    rows = [
        (5, "http://a/x y\r\nz", "<p>same</p>", 1, ""),
        (3, None, "<p>same</p>", 1, ""),
        (9, "http://a/ü", "<p>same</p>", 1, ""),
        (9, "http://a/ü", "<p>same</p>", 1, ""),
        (1, "", None, 1, ""),
        (2, "http://b", "", 1, ""),
        (None, "http://c", "<p>no id</p>", 1, ""),
        (7, "http://d", "Content-Length: 5\r\n\r\nWARC/1.1\r\n\r\n" + "x" * 300000, 1, ""),
    ]
    return spark.createDataFrame(rows, PAGES)


def expected(rows, least=0):
    first, out = {}, []
    ordered = sorted(rows, key=lambda r: (r.page_id is None, r.page_id or 0))
    for r in ordered:
        body = (r.html or "").encode()
        kind, to = "response", None
        if len(body) >= least:
            if body in first:
                kind, to = "revisit", first[body]
            else:
                first[body] = r.page_id
        out.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, to))
    return sorted(out, key=str)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip_of_odd_pages(spark, tmp_path, least):
    pages = odd_pages(spark)
    manifest = w.write_warc(pages, str(tmp_path), shard_bytes=50, roll_bytes=300, least=least)
    assert manifest.agg(F.sum("records")).head()[0] == 8
    found = sorted((tuple(r) for r in w.read_warc(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)
    assert found == expected(pages.collect(), least)
    # Failed attempts leave files that no manifest names.
    assert {p.name for p in tmp_path.glob("*.warc.gz")} == {r.file for r in manifest.collect()}


def test_equal_input_gives_equal_files(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for name, rows in (("a", pages), ("b", pages.orderBy(F.desc("page_id")).repartition(5))):
        w.write_warc(rows, str(tmp_path / name), shard_bytes=1 << 16, roll_bytes=1 << 13)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab")
    assert one == two and len(one) > 3


def test_no_pages(spark, tmp_path):
    assert w.write_warc(odd_pages(spark).where("false"), str(tmp_path)).count() == 0
    assert w.read_warc(spark, str(tmp_path)).count() == 0
    assert extract_text(odd_pages(spark).where("false")).count() == 0


def test_damage_is_an_error(spark, tmp_path):
    w.write_warc(odd_pages(spark), str(tmp_path))
    file = next(tmp_path.glob("*.warc.gz"))
    file.write_bytes(file.read_bytes()[:-40])
    with pytest.raises(Exception, match="within a record|Error"):
        w.read_warc(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("hot", [None, 7, -(2**62) - 1])
def test_pages_of_one_id_span_shards(spark, tmp_path, hot):
    rows = [(hot, f"http://a/{i}", f"<p>{i % 250}</p>" * 20) for i in range(300)] + [(i + 100, None, f"{i}") for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = w.write_warc(pages, str(tmp_path), shard_bytes=4000).collect()
    assert sum(r.records for r in manifest) == len(rows)
    shards = {}
    for r in manifest:
        shards[r.shard] = shards.get(r.shard, 0) + r.records
    assert len(shards) > 10 and max(shards.values()) <= 150 + 25
    found = w.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r.url for r in found if r.page_id == hot) == sorted(u for i, u, _ in rows if i == hot)
    assert sum(r.record_type == "revisit" for r in found) == 50


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>one\n <b>two</b><p>three", "one two\n\nthree"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>x<li>y<ol start=9><li>q<li>r</ol></ul>z", "- x\n- y\n  9. q\n  10. r\n\nz"),
        ("<ol><li value=4>a<li>b</ol>", "4. a\n5. b"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>end", "Name       Qty\napple pie  3\n\nend"),
        ("<table><caption>C</caption><td>a<td colspan=2>b<td>c</table>", "C\n\na  b    c"),
        ("<title>t</title><style>p{}</style><script>'<p>'</script><body>shown", "shown"),
        ("<style>.x, #y{display:none}</style><p class='a x'>no</p><p id=y>no</p><p class=xx>yes", "yes"),
        ("<p hidden>no</p><p style='display: none'>no</p><p style='visibility:hidden'>no<b style='visibility:visible'>yes</b>", "yes"),
        ("<details>no<summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
        ("<pre>  a\n b</pre>", "  a\n b"),
        ("x &amp; y &lt;z&gt;&nbsp;&#233;", "x & y <z> é"),
        ("1 < 2 <a href='x>y'>l</a> <!-- c --> m</p>", "1 < 2 l m"),
        ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
        ("<div", ""),
        ("", ""),
    ],
)
def test_layout(page, text):
    assert visible_text(page) == text


def test_odd_pages_are_rendered(spark):
    rows = {r.page_id: r for r in extract_text(odd_pages(spark)).collect()}
    assert rows[1].text == rows[2].text == "" and rows[9].text == "same" and rows[7].n_chars > 300000
    assert rows[None].text == "no id"
    for page in ("<div>" * 50000 + "x", "<p>a<b 'x>" * 5000, "<table><tr><td>" * 20000 + "x", "<ul><li>" * 5000, "<a <" * 9000):
        visible_text(page)


CLASSES = "<p class=ad>ad<p class=body>body<p class=m>m<p class=x>x"


@pytest.mark.parametrize(
    "sheet, text",
    [
        ("@media print{.ad,.body{display:none}} .m{display:none} @media(min-width:9px){.m{display:block}}", "ad body m x"),
        ("@media print{.ad{display:none}}@media(max-width:600px){.m,.x{display:none}}", "ad body m x"),
        ("@media screen and (min-width:600px){.ad{display:none}} @media not all and (hover){.m{display:none}}", "body m x"),
        ("@media (400px<=width<900px){.ad{display:none}} @media (width>=900px){.m{display:none}}", "ad body x"),
        ("@media print,(orientation:landscape){.ad{display:none}}@media (prefers-color-scheme:dark){.m{display:none}}", "body m x"),
        ("@media print{@media all{.ad{display:none}} .m{display:none}} .x{display:none}", "ad body m"),
        (".m{display:none}.m{color:red;display:flex}.x{display:block}.x{display:none}", "ad body m"),
        (".m{display:none!important}.m{display:block}p.x{display:none}.x{display:block}", "ad body"),
        ("p{display:none}p.m{display:block}.x,a b{display:inline block}", "m x"),
        ("p{display:none} body>.m, .ad + .body, .ad ~ .x:not(:hover){display:block}", "body m x"),
        (".m{display:none}.m:hover{display:block}.ad::before{display:none}.x{display:nonsense}", "ad body x"),
        (".m{display:none}@supports(display:grid){.m{display:grid}}@supports not (display:grid){.x{display:none}}", "ad body m x"),
        ("@layer a,b;@layer b{.m{display:block}}@layer a{.m{display:none}}@layer a{.x{display:none}}.x{display:block}", "ad body m x"),
        (".m{display:none}@media (min-width:48em){.m{&.m{display:block}}} .x{@media print{display:none}}", "ad body m x"),
        ("/*{*/.m{content:'}';background:url(a;b{);display:none}@keyframes k{from{display:none}}", "ad body x"),
        ("[class^=a]{display:none} p:nth-child(2n+3){display:none}", "body x"),
    ],
)
def test_style_sheets(sheet, text):
    assert visible_text(f"<style>{sheet}</style>{CLASSES}").split() == text.split()


@pytest.mark.parametrize(
    "page, text",
    [
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style media='screen'>p{display:none}</style><p>a", ""),
        ("<noscript><style>p{display:none}</style></noscript><p>a", "a"),
        ("<style>.md\\:block{display:block}.hidden{display:none}</style><p class='hidden md:block'>no", ""),
        ("<style>.hidden{display:none}@media(min-width:768px){.md\\:block{display:block}}</style><p class='hidden md:block'>a", "a"),
        ("<style>p{display:none}</style><p style='display:block'>a<p style='display:none;display:block'>b<p>c", "a\n\nb"),
        ("<style>p{display:none!important}</style><p style='display:block'>a", ""),
        ("<style>.s{display:block}</style><p hidden>no<p hidden class=s>a", "a"),
        ("<style>.no-js .a{display:none}</style><html class=js><body class=no-js><p class=a>a", ""),
        ("let <math><mi>x</mi> <mo>=</mo><mn>2</mn></math> be", "let x=2 be"),
        ("<math><semantics><mfrac><mi>a</mi><mi>b</mi></mfrac><annotation>no</annotation></semantics></math>.", "a b."),
        ("<math><mspace/><mtext>if</mtext><mphantom><mi>no</mi></mphantom></math> so", "if so"),
        ("see <svg><title>no</title><path d='M0 0'/><text>one</text><g><text>t<tspan>wo</tspan></text></g></svg> end", "see one two end"),
        ("<svg><defs><text>no</text></defs><a><text x=1><![CDATA[a<b]]></text></a>no</svg>", "a<b"),
        ("<svg><switch><foreignObject><p>in</p></foreignObject><text>no</text></switch></svg>out", "in\n\nout"),
        ("<svg display=none><text>no</text></svg><svg><text style='display:none'>no</text></svg>a", "a"),
        ("<svg><path><p>broken out", "broken out"),
    ],
)
def test_sheets_of_pages_drawings_and_formulas(page, text):
    assert visible_text(page) == text


def test_odd_style_sheets():
    for sheet in ("@media all{" * 30000, "a " * 30000 + "{display:none}", ":not(" * 30000 + "{display:none}",
                  "p{display:none}" * 20000, "a,a{&&{" * 3000 + "display:none", "{" * 9000 + "}" * 9999,
                  "p{display:" + " " * 50000 + "!}", "@media " + "(" * 30000 + "{p{display:none}}"):
        visible_text(f"<style>{sheet}</style>" + "<div><p class=a>x" * 200)
    assert visible_text("<style>p ~ p{display:none}</style>" + "<p>x</p>" * 20000) == "x"
    for page in ("<svg>" * 20000 + "x", "<math><mi>" * 9000 + "x", "<svg><g>" * 9000 + "<p>", "<svg " + "a=" * 50000 + "/>"):
        visible_text(page)
