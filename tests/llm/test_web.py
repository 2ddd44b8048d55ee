import base64
import gzip
import hashlib
import html
import html.parser
import random
import re
import uuid

import pytest

from marlspike.llm import htmlmain, tokencounts, warc

PAGE = """<!DOCTYPE html><html><head><title>Skip</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site name</h2></header><nav><ul><li><a href="/a">{n}</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies {n}</p></div>
<div id="content"><article><h1>Title &amp; {n}</h1><p>First <b>bold
 text</b> of page {n}.<br>More &lt;here&gt; &#233;</p><ul><li>point {n}</li><li>second</li></ul><div class="ad">Buy {n}</div>
<form><input value="x"><label>Search</label></form><p>Last {n}&nbsp;words.</p><section class="comments"><p>Reader says {n}</p></section></article></div>
<aside><p>Related {n}</p></aside><footer>&copy; {n}</footer></body></html>"""


def want(n):
    return f"Title & {n}\nFirst bold text of page {n}. More <here> é\npoint {n}\nsecond\nLast {n} words."


def test_article_of_every_page(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(n=f"no{i}")) for i in range(8)] + [(50, "http://b.example/x", PAGE.format(n="one"))]
    rows += [(60, None, None), (61, "http://a.example/e", ""), (62, "nonsense", "just text"), (62, "nonsense", "just text"), (63, "http://c.example", "<p>unclosed <b>bold <p>second")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, wrapper string").repartition(3)
    got = [(r.page_id, r.text) for r in htmlmain.extract(pages).collect()]
    assert len(got) == len(rows)
    texts = dict(got)
    for i in range(8):
        assert texts[i] == want(f"no{i}")
    assert texts[50] == want("one")
    assert texts[60] == texts[61] == "" and texts[62] == "just text" and texts[63] == "unclosed bold\nsecond"
    assert htmlmain.extract(pages.limit(0)).collect() == []


def extracted(spark, pages, parts=3):
    """Texts by page id of (id, url, html) rows."""
    return {r.page_id: r.text for r in htmlmain.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)).collect()}


def test_template_is_left_out_without_article_tag(spark):
    def page(n):
        return f"<body><div><p>Welcome to our site, the same line on every page of it</p></div><div><p>{'Varying text ' * 10}{n}</p><p>{'More text ' * 12}{n}</p></div></body>"

    text = extracted(spark, [(n, "http://a.example/", page(n)) for n in range(6)])[3]
    assert "Welcome" not in text and text.count("\n") == 1 and text.endswith("3")


def test_constant_block_among_varying_siblings_is_template(spark):
    def page(n):
        more = "".join(f"<p>Paragraph {n} {k} of a text that varies.</p>" for k in range(n % 5 + 1))
        return f"<body><div><p>Start {n} of a text that varies.</p><p>Sign up for the letter.</p>{more}</div></body>"

    texts = extracted(spark, [(n, "http://a.example/", page(n)) for n in range(20)])
    assert all("Sign up" not in t and t.count("\n") == n % 5 + 1 for n, t in texts.items())


@pytest.mark.parametrize("odd", ["Other heading", "zzz", "News of 1999", "b", "x y z", "0"])
def test_one_deviating_page_does_not_save_the_template(spark, odd):
    def page(n):
        return f"<body><div><h3>{odd if n == 0 else 'Latest news'}</h3><p>{'Varying text ' * 10}{n}</p></div></body>"

    rows = [(n, "http://a.example/", page(n)) for n in range(20)]
    texts = extracted(spark, rows)
    assert odd in texts[0] and not any("Latest news" in t for t in texts.values())
    assert extracted(spark, rows[::-1], 1) == extracted(spark, rows, 7) == texts


def test_slots_decide_where_no_tag_names_the_article(spark):
    """The wrapper finds the article by what varies on the host; a page alone may have more text elsewhere."""

    def page(n):
        return f"<body><div><a href='/'>home</a></div><div>Teaser {n} with more text than this article has</div><div><h1>Title {n}</h1><p>{'Long text ' * (40 if n else 1)}{n}.</p></div><div>(c) site</div></body>"

    rows = [(n, "http://a.example/", page(n)) for n in range(6)]
    texts = extracted(spark, rows)
    assert texts[0] == "Title 0\nLong text 0." and "Teaser" in htmlmain.main_text(rows[0][2])
    assert all(t.startswith("Title") and "(c)" not in t for t in texts.values())


def test_nothing_else_is_dropped(spark):
    deep = "<div>" * 400
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(9))
    html = f"<body><nav><p>menu</p></nav><article><div class='article-header'><h1>Title</h1></div><p class='legal-history'>Law.</p><ul>{links}</ul><p>Sum <math><mi>x</mi></math> is.</p>{deep}<p>deep</p><nav>leak</nav>{'</div>' * 400}<div class='content no-sidebar'>kept</div><div class='site-header'>Site</div><div role='alert'>Now!</div><div class='sidebar-left'>Side</div></article></body>"
    want = "Title\nLaw.\n" + "\n".join(f"link {k}" for k in range(9)) + "\nSum x is.\ndeep\nkept"
    assert htmlmain.main_text(html) == want
    assert extracted(spark, [(1, "http://a.example/", html)]) == {1: want}


def brute(a, b):
    """The size of the largest order-preserving top-down match, tried over all choices of child pairs."""
    if a.key != b.key:
        return 0

    def best(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(best(i + 1, j), best(i, j + 1), brute(a.kids[i], b.kids[j]) + best(i + 1, j + 1) if a.kids[i].key == b.kids[j].key else 0)

    return 1 + best(0, 0)


def grown(rng, depth=0):
    t = htmlmain.Tree("r" if not depth else rng.choice("abc"))
    t.kids = [grown(rng, depth + 1) for _ in range(rng.randint(0, 4 - depth))]
    return t


def test_tree_matching_is_the_largest_match(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        a, b = grown(rng), grown(rng)
        want = htmlmain.match(a, b, {})
        assert want[0] == brute(a, b)
        both = htmlmain.merged(a, b)
        for t in (a, b):  # each tree is a part of the merged one
            assert htmlmain.match(both, t, {})[0] == len(htmlmain.preorder(t)) and -1 not in htmlmain.aligned(both, t)
        monkeypatch.setattr(htmlmain, "CELLS", -1)
        assert htmlmain.match(a, b, {}) == want
        monkeypatch.undo()


def test_whole_pages_match_by_brute_force():
    def tree(html):
        return htmlmain.groups(htmlmain.parse(html))

    a = tree("<div><h1>x</h1><p>y</p><p>y2</p><ul><li>z</li></ul></div>")
    b = tree("<div><p>y</p><form>q</form><ul><li>z</li><li>w</li></ul></div>")
    assert htmlmain.match(a, b, {})[0] == brute(a, b) == 5  # root, div, p, ul, li
    assert htmlmain.dumped(htmlmain.loaded(htmlmain.dumped(a))) == htmlmain.dumped(a)
    x, y = tree(PAGE), tree(PAGE.replace("<h1>", "<h2>old</h2><h1>").replace("<aside>", "<div><p>new</p></div><aside>"))
    assert htmlmain.match(x, y, {})[0] == brute(x, y) == len(htmlmain.preorder(x))


def test_trees_merge_the_same_in_any_fan_and_partitioning(spark):
    rng = random.Random(4)
    rows = [("h", "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "div", "h2", "ul"], k=rng.randint(1, 6)))) for _ in range(120)]
    pages = spark.createDataFrame(rows, "host string, html string")
    for fan in (htmlmain.FAN, 7):
        one, two = (htmlmain.trees(pages.repartition(n), fan).collect() for n in (1, 5))
        assert one == two and len(one) == 1
        whole = htmlmain.loaded(one[0].wrapper)
        for _, html in rows:
            assert -1 not in htmlmain.aligned(whole, htmlmain.groups(htmlmain.parse(html)))


def test_template_of_a_late_layout_is_found(spark):
    def page(layout, n):
        own = "".join(f"<div class='{layout}x{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}'>Varying text {n} {k}</div>" for k in range(900))
        return f"<body><div class='{layout}'><p>Constant line of layout {layout}</p><h3>{n}</h3><p>{'More text ' * 500}{n}</p></div>{own}</body>"

    rows = [(10 * k + n, f"http://a.example/{k}/{n}", page(f"lay{'abcd'[k]}", f"no{k}n{n}")) for k in range(4) for n in range(5)]
    texts = extracted(spark, rows, 1)
    assert len(texts) == len(rows) and not any("Constant line" in t for t in texts.values())


def test_long_child_lists_have_the_largest_match():
    def tree(classes):
        return htmlmain.groups(htmlmain.parse("<body>" + "".join(f"<div class='{c}'>x</div>" for c in classes) + "</body>"))

    common = [f"k{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(400)]
    assert htmlmain.match(tree(["far", *common]), tree([*common, "far"]), {})[0] == 402  # root, body and all but one child


def test_very_long_and_broken_pages():
    assert htmlmain.main_text("<div>" * 300 + "deep" + "</p>" * 50) == "deep"
    assert htmlmain.main_text("<p>a < b and 'quote <b>x</b>") == "a < b and 'quote x"
    deep = "<div><ul><li>a</li><li>b</li></ul>" * 3000 + "end" + "</div>" * 3000
    assert htmlmain.main_text(deep).count("end") == 1
    wide = "<body>" + "".join(f"<p>w{i}</p><div class='k{i}'>y{i}</div>" for i in range(3000)) + "</body>"
    assert "w2999" in htmlmain.main_text(wide)
    nested = "<ul><li>a</li><li>" * 60 + "z"
    assert htmlmain.main_text(nested).endswith("z")
    assert len(htmlmain.main_text("<article>" + "<p>word</p>" * 20_000)) == 5 * 20_000 - 1


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/1", PAGE.format(n="one"), "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, block string")
    made = [r.asDict() for r in warc.derive(warc.responses_from_pages(pages)).collect()]
    assert len(made) == 6
    data = b"".join(warc.record_bytes(r) for r in made)
    back = list(warc.records(data))
    assert [(h["warc-type"], h.get("warc-record-id"), h.get("warc-refers-to"), b) for h, b in back] == [(r["record_type"], r["record_id"], r["refers_to"], bytes(r["block"])) for r in made]
    for r in made:
        assert r["block_digest"] == warc.digest(bytes(r["block"])) and r["content_length"] == len(r["block"])
    meta = bytes(made[0]["block"]).decode()
    assert "http-status: HTTP/1.1 200 OK" in meta and "http-content-type: text/html; charset=utf-8" in meta and "title: Skip" in meta and "outlink: /a" in meta and made[0]["source_payload_digest"] in meta
    assert "Reader says one" in bytes(made[1]["block"]).decode() and "var a" not in bytes(made[1]["block"]).decode()
    # responses read back from a file give the same derivatives
    first = warc.responses_from_pages(pages.where("page_id = 1")).first()
    block = (first.http_headers + "\r\n\r\n").encode() + bytes(first.payload)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {first.record_id}\r\nWARC-Target-URI: {first.target_uri}\r\nWARC-Date: {first.date}\r\nWARC-Block-Digest: {first.block_digest}\r\nWARC-Payload-Digest: {first.payload_digest}\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(head.encode() + block + b"\r\n\r\n"))
    again = warc.derive(warc.responses_from_files(spark.read.format("binaryFile").load(str(tmp_path)))).collect()
    assert sorted(str(r.asDict()) for r in again) == sorted(str(r) for r in made if r["refers_to"] == first.record_id)


def test_media_type_decides_what_is_converted(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0" + bytes(range(256)) * 6
    cases = [
        ("image/png", png, None), ("application/pdf", b"%PDF-1.4 text", None), ("image/svg+xml", b"<svg><title>t</title></svg>", None), ("application/zip", b"PK\3\4", None),
        ("application/json; charset=utf-8", '{"a": "<b>é"}'.encode(), '{"a": "<b>é"}'), ("application/ld+json", b"[1]", "[1]"), ("text/plain", b"a <b> c\n\nd", "a <b> c\n\nd"), ("Text/HTML", b"<p>x</p>", "x"), ("application/xhtml+xml", b"<p>y", "y"),
        (None, b" <!doctype html><p>z", "z"), (None, b"plain words", "plain words"), (None, png, None), ("application/octet-stream", b"\xff\xfe" + "<p>w".encode("utf-16-le"), "w"), (None, "é".encode() * 1025, "é" * 1025), (None, b"caf\xe9", None), ("text/html", None, ""), (None, None, ""),
    ]
    rows = [(f"<{k}>", "u", "d", "HTTP/1.1 200 OK" + (f"\r\nContent-Type: {t}" if t else ""), p, "b", "p") for k, (t, p, _) in enumerate(cases)]
    made = warc.derive(spark.createDataFrame(rows, warc._RESPONSE)).collect()
    assert sorted(r.refers_to for r in made if r.record_type == "metadata") == sorted(r[0] for r in rows)
    got = {r.refers_to: bytes(r.block).decode() for r in made if r.record_type == "conversion"}
    assert [got.get(r[0]) for r in rows] == [w for _, _, w in cases]
    assert b"title" not in next(bytes(r.block) for r in made if r.refers_to == "<2>")


def test_page_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "<p>x", 5, "k", 7)], "page_id long, url string, html string, `a.b` int, `t``k` string, source int")
    assert [r.row["a.b"] for r in warc.derive(warc.responses_from_pages(pages).withColumn("a.b", htmlmain.F.col("source").getField("a.b")), ["a.b"]).collect()] == [5, 5]


def test_form_around_the_page_is_no_form(spark):
    words = "A sentence of the article that goes on for a good while, so that it is a passage. "

    def page(n, inner):
        return f"<html><body><form id='aspnetForm' role='form' action='/'><input type='hidden' name='s' value='{n}'><div class='nav'><a href='/'>Menu {n}</a></div>{inner}<form class='search'><label>Find {n}</label></form><div class='footer'>Foot {n}</div></form></body></html>"

    pages = [(n, "http://a.example/", page(n, f"<h1>Title {n}</h1><p>{words}{n}</p>")) for n in range(6)]
    pages += [(10 + n, "http://b.example/", page(n, f"<div><p>{words}{n}</p><p>{words}{n + 1}</p></div>")) for n in range(6)]
    pages += [(20, "http://c.example/", "<body><form><h2>Sign in</h2><label>Name</label><input></form></body>")]
    pages += [(30 + n, "http://d.example/", f"<body><article><h1>T {n}</h1><p>{words}{n}</p><form><h3>Leave a reply {n}</h3><p>Be kind.</p></form></article></body>") for n in range(3)]
    texts = extracted(spark, pages)
    for n in range(6):
        assert texts[n] == f"Title {n}\n{words}{n}" and texts[10 + n] == f"{words}{n}\n{words}{n + 1}"
    assert texts[20] == "" and all(texts[30 + n] == f"T {n}\n{words}{n}" for n in range(3))


@pytest.mark.parametrize("headers, payload", [
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1", "<p>café".encode("latin-1")),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html", b"<meta charset='windows-1252'><p>caf\xe9"),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html", b'<meta http-equiv="Content-Type" content="text/html; charset=latin1"><p>caf\xe9'),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html", b"\xff\xfe" + "<p>café".encode("utf-16-le")),
    ("HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress("<p>café".encode())),
    ("HTTP/1.1 200 OK\r\nContent-Encoding: deflate", __import__("zlib").compress("<p>café".encode())),
    ("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"4\r\n<p>c\r\n4;x=y\r\naf\xc3\xa9\r\n0\r\n\r\n"),
    ("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: br", "<p>café".encode()),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such-set", "<p>café".encode()),
    ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=base64", "<p>café".encode()),
    (None, "\ufeff<p>café".encode()),
])
def test_payloads_are_decoded(headers, payload):
    assert warc.plain_text(warc.payload_text(headers, payload)) == "café"


def test_broken_encodings_give_what_there_is():
    packed = gzip.compress(b"<p>" + b"word " * 9000)
    assert warc.payload_text("x\r\nContent-Encoding: gzip", packed[:-20]).startswith("<p>word")
    assert warc.payload_text("x\r\nContent-Encoding: gzip", b"<p>plain") == "<p>plain"
    assert warc.payload_text(None, None) == warc.payload_text("", b"") == ""


def test_warc_files_are_streamed_and_saved(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://a/{k}", PAGE.format(n=f"no{k}") + "x" * 5000 * k) for k in range(40)], "page_id long, url string, html string").repartition(3)
    made = warc.derive(warc.responses_from_pages(pages))
    files = warc.save(made, str(tmp_path / "out")).collect()
    assert sum(r.records for r in files) == 80 and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.path.rsplit("/", 1)[1] for r in files)
    monkeypatch.setattr(warc, "PIECE", 1000)
    back = {h["warc-record-id"]: b for r in files for h, b in warc.stream_records(open(r.path, "rb"))}
    assert back == {r.record_id: bytes(r.block) for r in made.collect()}
    # the same file whole, plain and compressed, is read alike
    plain = b"".join(warc.record_bytes(r.asDict(), False) for r in made.collect())
    for data in (plain, gzip.compress(plain), plain[:-3]):
        assert len(list(warc.records(data))) == 80
    response = [r for r in warc.responses_from_pages(pages).collect()]
    raw = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {r.record_id}\r\nContent-Length: {len(r.http_headers) + 4 + len(r.payload)}\r\n\r\n{r.http_headers}\r\n\r\n".encode() + bytes(r.payload) + b"\r\n\r\n" for r in response)
    (tmp_path / "in.warc.gz").write_bytes(gzip.compress(raw))
    got = warc.responses_from_paths(spark.createDataFrame([(str(tmp_path / "in.warc.gz"),), (None,)], "path string")).collect()
    assert {(r.record_id, bytes(r.payload)) for r in got} == {(r.record_id, bytes(r.payload)) for r in response}


class Plain(html.parser.HTMLParser):
    """Blocks of a well-formed page by Python's own parser, all of them or those of the article."""

    def __init__(self, page, article):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.words, self.article = [], [], [], article
        self.feed(page or "")
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.words).split()):
            self.blocks.append(text)
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in htmlmain.BLOCKS:
            self.flush()
        if tag in htmlmain.SPACES:
            self.words.append(" ")
        elif tag != "meta":
            self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in htmlmain.BLOCKS:
            self.flush()
        while self.open and any(t == tag for t, _ in self.open) and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if not {"script", "style", "head"} & set(tags) and (not self.article or ("article" in tags and not any(c == "ad" for _, c in self.open))):
            self.words.append(data)


def test_queries_equal_a_plain_parser_on_whole_tables(spark, small_dir):
    """Every page of the small table: main texts, and every column of the derivatives."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    for r in htmlmain.op4(spark, small_dir).collect():
        want = "\n".join(Plain(pages[r.page_id].html, True).blocks)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)
    got = {(r.page_id, r.record_type): r for r in warc.op6(spark, small_dir).collect()}
    assert len(got) == 2 * len(pages)
    for k, p in pages.items():
        body = (p.html or "").encode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}"
        name = hashlib.sha1(f"{p.page_id}|{p.url}".encode()).hexdigest()
        rid = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"
        digests = ["sha256:" + hashlib.sha256(x).hexdigest() for x in (head.encode() + b"\r\n\r\n" + body, body)]
        title = re.search("<title>(.*?)</title>", p.html)
        links = re.findall('<a href="([^"]*)"', p.html)
        fields = [("http-status", "HTTP/1.1 200 OK"), ("http-content-type", "text/html; charset=utf-8"), ("http-content-length", len(body)), ("source-block-digest", digests[0]), ("source-payload-digest", digests[1])]
        fields += [("title", " ".join(html.unescape(title[1]).split()))] * bool(title) + [("outlink", html.unescape(x)) for x in links]
        blocks = {"metadata": "".join(f"{a}: {b}\r\n" for a, b in fields), "conversion": "\n".join(Plain(p.html, False).blocks)}
        for kind, text in blocks.items():
            r = got[k, kind]
            sha = "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
            assert (r.refers_to, r.target_uri, r.content_length, r.block_digest, r.source_block_digest, r.source_payload_digest) == (rid, p.url, len(text.encode()), sha, *digests), (k, kind)
            assert r.record_id == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{rid}')}>"


def test_rollup_is_idempotent_and_additive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "en", "t1", 10), ("a", "en", "t1", None), (None, None, "t1", 3), ("b", "de", "t1", 7), ("b", "de", "t1", 7)], "source string, lang string, tokenizer string, tokens long")
    r = tokencounts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().collect() == []
    assert r.commit("one", tokencounts.inserts(rows)) and not r.commit("one", tokencounts.inserts(rows))
    get = lambda: {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens) for x in r.totals().collect()}
    assert get() == {("a", "en", "t1"): (2, 10), (None, None, "t1"): (1, 3), ("b", "de", "t1"): (2, 14)}
    r.compact()
    assert not r.commit("one", tokencounts.inserts(rows))
    old = rows.where("source = 'b'")
    new = old.selectExpr("source", "lang", "'t2' tokenizer", "tokens + 1 tokens")
    assert r.commit("two", tokencounts.revisions(old, new))
    r.compact()
    assert r.commit("three", tokencounts.deletes(rows.where("source is null")))
    assert get() == {("a", "en", "t1"): (2, 10), ("b", "de", "t2"): (2, 16)}


def test_commit_while_compacting_is_counted_once(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "t", 10)], "source string, lang string, tokenizer string, tokens long")
    r = tokencounts.Rollup(spark, str(tmp_path / "r"))
    r.commit("one", tokencounts.inserts(rows))
    summed = tokencounts.Rollup._sum

    def late(self, *state):  # a batch that ends after the names are written and before the snapshot is
        monkeypatch.undo()
        self.commit("two", tokencounts.inserts(rows))
        return summed(self, *state)

    monkeypatch.setattr(tokencounts.Rollup, "_sum", late)
    r.compact()
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(2, 20)]
    r.compact()
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(2, 20)]


@pytest.mark.parametrize("half_written", [True])
def test_broken_commit_is_written_again(spark, tmp_path, half_written):
    rows = spark.createDataFrame([("a", "en", "t", 10)], "source string, lang string, tokenizer string, tokens long")
    (tmp_path / "r/batches/x").mkdir(parents=True)
    (tmp_path / "r/batches/x/part-0.parquet").write_bytes(b"broken")
    r = tokencounts.Rollup(spark, str(tmp_path / "r"))
    assert r.totals().collect() == [] and r.commit("x", tokencounts.inserts(rows))
    assert [(x.docs, x.tokens) for x in r.totals().collect()] == [(1, 10)]
