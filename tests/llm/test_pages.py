"""WARC archive and HTML extraction."""

import gzip
import hashlib
import html as entities
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from orbweave.llm import html_extract, warc

SF = "/root/testdata/sf0.01"
BIG = "<p>" + "long payload " * 20 + "</p>"
ROWS = [(5, "http://a.example/x", BIG), (3, None, BIG), (9, "http://a.example/ y\r\n", "small"), (2, "http://b.example", "small"), (7, "u", None), (8, "u", ""), (None, "u", BIG), (4, "http://ü.example/ß", "é" * 60), (6, "x", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 5), (3, "twice", BIG)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'h' AS header").repartition(3)


def test_records_survive_the_archive(spark, pages):
    made = warc.records(pages)
    heads, payloads = warc.archive(made)
    assert payloads.count() == payloads.select("digest").distinct().count() == len({(h or "") for _, _, h in ROWS})
    want = sorted((r.page_id or -1, bytes(r.header) + bytes(r.payload)) for r in made.collect())
    restored = warc.restore(heads, payloads)
    assert sorted((r.page_id or -1, bytes(r.record)) for r in restored.collect()) == want
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.parsed(restored).collect()}
    ref = set()
    for p, _, h in ROWS:
        b = (h or "").encode()
        revisit = h == BIG and p != 3
        ref.add((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == ref


def test_damage_is_noticed(spark, pages):
    heads, payloads = warc.archive(warc.records(pages))
    bad = payloads.selectExpr("digest", "cast('other' AS binary) AS payload")
    with pytest.raises(Exception, match="damaged payload"):
        warc.restore(heads, bad).collect()


def test_files_round_trip(spark, pages, tmp_path):
    heads, payloads = warc.archive(warc.records(pages))
    restored = warc.restore(heads, payloads)
    assert warc.write_files(restored, str(tmp_path / "warc"), 300) == len(ROWS)
    assert len(list((tmp_path / "warc").iterdir())) > 1 and not (tmp_path / "warc" / "_part").exists()
    back = warc.read_files(spark, str(tmp_path / "warc"))
    assert sorted(bytes(r.header) + bytes(r.payload) for r in back.collect()) == sorted(bytes(r.record) for r in restored.collect())


def test_files_of_any_bytes(spark, tmp_path):
    head = lambda i, n: f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {n}\r\n\r\n".encode()
    payloads = [bytes(range(256)) * 5, b"", b"\xff\xfe\r\n\r\nWARC/1.1 inside", random.Random(1).randbytes(5_000_000)]
    made = spark.createDataFrame([(i, head(i, len(p)) + p) for i, p in enumerate(payloads)], "page_id long, record binary")
    warc.write_files(made.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").iterdir()
    plain = b"".join(head(i, len(p)) + p + b"\r\n\r\n" for i, p in enumerate(payloads))
    assert gzip.decompress(file.read_bytes()) == plain
    assert {r.page_id: bytes(r.payload) for r in warc.read_files(spark, str(tmp_path / "w")).collect()} == dict(enumerate(payloads))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.warc").write_bytes(plain)
    assert [bytes(r.payload) for r in warc.read_files(spark, str(tmp_path / "p")).collect()] == payloads
    assert list(warc._records(warc._inflated(gzip.compress(plain), 1000))) == [(head(i, len(p)), p) for i, p in enumerate(payloads)]


def test_empty_tables(spark, pages):
    none = pages.limit(0)
    assert warc.parsed(warc.restore(*warc.archive(warc.records(none)))).count() == 0
    assert html_extract.extract(none).count() == 0


def page(i, body, host="h.example"):
    html = f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var x = "</p><p>no";</script></head><body class="has-sidebar">
<header><a href="/">Site</a> slogan</header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About {i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-1">Buy {i}</div>
<div class="site-header">Top {i}</div><main><article><div class="entry-header"><h1>Title {i} &amp; more</h1></div>{body}<!-- hidden <p>no</p> --></article></main>
<aside>Related {i}</aside><section class="comments"><p>Nice post {i}</p></section><form><label>Mail</label><input><button>Go</button></form>
<footer>&copy; {host} {i}</footer></body></html>"""
    return (i, f"https://{host}/p/{i}", html)


def test_article_only(spark):
    rows = [page(i, f"<p>First <b>bold</b>text {i}<br>next&nbsp;line<p>Second\n\t para {i}<ul><li>one {i}<li>two</ul>") for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} & more First boldtext {i} next line Second para {i} one {i} two" for i in range(6)}


def test_constant_nodes_are_template(spark):
    body = "<html><body><div><p>Welcome to the town gazette</p></div><div><p>story {i} of many words here</p><p>and more {i}</p></div></body></html>"
    rows = [(i, "http://t.example/", body.format(i=i)) for i in range(8)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"story {i} of many words here and more {i}" for i in range(8)}


def test_copies_keep_their_article(spark):
    rows = [(i, "http://c.example/", page(1, "<p>the same words again</p>")[2]) for i in range(9)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Title 1 & more the same words again"} and len(got) == 9


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "just text & more"), (4, "http://x.example", "<div>" * 3000 + "deep" + "</div>" * 3000), (5, "http://x.example", "<p>open <b>never closed"), (6, "http://x.example", "<p a='>'>q</p><!-- no end"), (7, "http://x.example", "</p></div>stray"), (8, "http://x.example", "<script>only"), (9, "http://x.example", "<ul>" + "<li>i</li>" * 900 + "</ul><p>tail</p>"), (10, "http://x.example", "<ul>" + "<li>j</li>" * 900 + "</ul><p>tale</p>")]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[8] == ""
    assert got[3] == "just text & more" and got[4] == "deep" and got[5] == "open never closed" and got[6] == "q" and got[7] == "stray"
    assert got[9].endswith("tail") and got[10].endswith("tale")


def test_alignment_is_the_largest():
    a = html_extract.Page("<div><p>1</p><ul><li>a</li></ul><p>2</p></div>")
    b = html_extract.Page("<div><ul><li>b</li><li>c</li></ul><p>3</p></div>")
    pairs = {(a.symbol[x], b.symbol[y]) for y, x in html_extract.align(a, b).items()}
    assert all(x == y for x, y in pairs) and len(html_extract.align(a, b)) == 5


def sizes_by_brute_force(a, b, x=0, y=0):
    """The greatest simple tree matching, by trying every ordered set of child pairs."""
    if a.symbol[x] != b.symbol[y]:
        return 0

    def best(p, q):
        if not p or not q:
            return 0
        return max(best(p[1:], q), best(p, q[1:]), sizes_by_brute_force(a, b, p[0], q[0]) + best(p[1:], q[1:]))

    return 1 + best(a.kids[x], b.kids[y])


@pytest.mark.parametrize("cells", [1, 1 << 20])
def test_alignment_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "CELLS", cells)
    r = random.Random(3)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1)}x</{t}>" for t in (r.choice(["div", "ul", "section"]) for _ in range(r.randint(0, 4 if depth > 1 else 2)))) if depth else ""

    for _ in range(60):
        a, b = html_extract.Page(tree(3)), html_extract.Page(tree(3))
        got = html_extract.align(a, b)
        assert len(got) == sizes_by_brute_force(a, b) and all(a.symbol[x] == b.symbol[y] for y, x in got.items())
        assert all(y == 0 or got[b.parent[y]] == a.parent[x] for y, x in got.items())
        order = sorted(got)
        assert all(got[u] < got[v] for u, v in zip(order, order[1:]))


def test_long_lists_and_deep_trees_are_aligned_whole():
    a = html_extract.Page("<div>" + "<p>x</p>" * 4000 + "<div class=x>t</div></div>")
    b = html_extract.Page("<div>" + "<p>y</p>" * 2500 + "<div class=x>u</div></div>")
    assert len(html_extract.align(a, b)) == 2 + 2500 + 1
    deep = html_extract.Page("<div>" * 5000 + "<nav>Home</nav><p>body</p>")
    assert len(html_extract.align(deep, deep)) == len(deep.symbol) == 5003


def test_wrappers_of_articles_stay(spark):
    words = "some words of the article that go on for a while, "
    odd = ["<div class='layout sidebar-left'><nav>Home About</nav><article>{}</article></div>", "<div id=wrapper class=navbar-fixed><nav>Home About</nav><main>{}</main></div>", "<form action=/><nav>Home About</nav><article>{}</article></form>", "<nav>Home About</nav><div class=share-price-report><p>{}</p></div>", "<div>" * 200 + "<nav>Home About</nav><p>{}</p>"]
    rows = [(10 * k + i, f"http://h{k}.example/{i}", html.format(words * 3 + f"page {i}")) for k, html in enumerate(odd) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {10 * k + i: (words * 3 + f"page {i}").strip() for k in range(len(odd)) for i in range(3)}


def neutral(source):
    """The page with its sectioning elements as plain div, without classes."""
    return re.sub(r" class=\"[^\"]*\"", "", re.sub(r"<(/?)(?:nav|article|footer)\b", r"<\1div", source))


def article(source):
    body = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_the_wrapper_decides(spark):
    """Without names menus, adverts and footers go by induced evidence alone; without a template they all stay."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    want = {i: article(html) for i, _, html in rows}
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want
    plain = spark.createDataFrame([(i, u, neutral(html)) for i, u, html in rows], pages.schema)
    got = {r.page_id: r.text for r in html_extract.extract(plain).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    # nothing counted: no name and no evidence, so menus and footers stay
    bare = html_extract.induce(plain).withColumn("counts", F.lit(None).cast("array<struct<node:int,n:long,chars:long,again:long,links:long>>"))
    without = {r.page_id: r.text for r in html_extract.extract(plain, bare).collect()}
    assert sum(without[i] != got[i] for i in want) >= 0.95 * len(want)


SECTIONS = ["social-policy", "legal-history", "search-history", "form-of-government", "notice-board", "related-work", "share-price", "sidebar-effects"]


@pytest.mark.parametrize("everywhere", [True, False])
def test_sections_of_articles_stay(spark, everywhere):
    """A word of furniture within a longer class or id doesn't take text out of an article; whole names of slots do."""
    rows, want = [], {}
    for i in range(8):
        own = SECTIONS if everywhere else [SECTIONS[i]]
        inner = "".join(f'<section id="{c}"><p>About {c} {i}.</p></section><div class="{c}"><p>More of it {i}.</p></div>' for c in own)
        rows.append(page(i, f'<p>Text {i}.</p>{inner}<div hidden><p>Unseen {i}.</p></div><p>Sum <math><mi>x{i}</mi></math> end.</p><div class="ad-slot">Buy {i} now</div><section class="comments"><p>Nice {i}</p></section>'))
        want[i] = f"Title {i} & more Text {i}. " + "".join(f"About {c} {i}. More of it {i}. " for c in own) + f"Unseen {i}. Sum x{i} end."
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_a_name_needs_other_pages_inside_an_article(spark):
    """One page has a notice in its article: no slot of the host. All pages have a share box: a slot."""
    rows = [page(i, f"<p>Text {i} of the article.</p>" + ("<div class=notice><p>Notice is hereby given.</p></div>" if i == 4 else "") + f"<div class=share>Share {i}</div>") for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} & more Text {i} of the article." + (" Notice is hereby given." if i == 4 else "") for i in range(6)}


def test_templates_null_keeps_everything():
    got = [html_extract.Page(page(i, f"<p>text {i}")[2]) for i in range(2)]
    full = html_extract.content(got[0], got[1], frozenset())
    assert "Home About 1" in full and "Nice post 1" in full and "text 1" in full


def test_repeated_rows_and_clashing_columns(spark):
    rows = [page(i, f"<p>text {i}") for i in (1, 2, 3, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS skeleton", "3 AS template", "4 AS text", "5 AS rank", "6 AS outline", "7 AS counts", "8 AS node")
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(i, f"Title {i} & more text {i}") for i in (1, 2, 3, 3)]
