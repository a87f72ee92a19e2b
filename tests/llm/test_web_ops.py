"""WARC source, URL filter and HTML extraction."""

import gzip
import random
import hashlib
import html
import re
import sys
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hwcatalog.llm import html_text, url_filter, warc
from hwcatalog.llm.html_training import labelled_pages

sys.path.insert(0, str(Path(__file__).parent))
from layouts import LAYOUTS, PLAIN  # noqa: E402

PAGES = "page_id long, url string, html string"


def pages():
    long_ = "<p>" + "same text " * 20 + "</p>"
    return [(4, "http://a/4", long_), (2, "http://a/2", long_), (9, None, long_), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (7, "u\r\nX-Bad: 1", None), (8, "http://é", "é" * 5000 + "\r\n\r\nx")]


def test_warc_round_trip(spark):
    rows = pages()
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit(1)).withColumn("head", F.lit(2))).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {4: ("revisit", 2), 9: ("revisit", 2)}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_pushes_filters_and_skips_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(spark.createDataFrame(pages(), PAGES).coalesce(1), path)
    df = spark.read.format("warc").schema("record_id string, type string, content_length long").load(path).where("type = 'response' AND record_id LIKE '<urn:page:%'")
    assert df.count() == 5
    reader = warc.WarcReader(df.schema, {"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("type",), "revisit"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.tests == [("in", "warc-type", ("revisit",))]
    rows = [x for p in reader.partitions() for b in reader.read(p) for x in b.to_pylist()]
    assert len(rows) == 2 and all(r["type"] == "revisit" for r in rows)
    calls = []
    import zlib

    class Counting:
        def __init__(self, *a):
            self.d = zlib.__dict__["_decompressobj"](*a)

        def decompress(self, data, most):
            out = self.d.decompress(data, most)
            calls.append(len(out))
            return out

        def __getattr__(self, n):
            return getattr(self.d, n)

    zlib._decompressobj, zlib.decompressobj = zlib.decompressobj, Counting
    try:
        reader.tests = []
        list(b for p in reader.partitions() for b in reader.read(p))
    finally:
        zlib.decompressobj = zlib._decompressobj
        del zlib._decompressobj
    assert max(calls) <= 8192  # no payload was inflated past the piece that its headers are in


@pytest.mark.parametrize("kind", ["plain", "members", "one"])
def test_warc_of_others(spark, tmp_path, kind):
    recs = [warc.record_bytes([("WARC-Type", t), ("WARC-Record-ID", f"<urn:{i}>")], b"x" * n) for i, (t, n) in enumerate([("request", 3), ("response", 100_000), ("response", 0)])]
    name = "a.warc" if kind == "plain" else "a.warc.gz"
    data = b"".join(recs) if kind == "plain" else b"".join(gzip.compress(r) for r in recs)
    (tmp_path / name).write_bytes(data)
    warc.register(spark)
    df = spark.read.format("warc").load(f"file://{tmp_path}/{name}" if kind == "one" else f"file://{tmp_path}").where("type = 'response'")
    assert sorted((r.record_id, len(r.payload)) for r in df.collect()) == [("<urn:1>", 100_000), ("<urn:2>", 0)]


@pytest.mark.parametrize("packed", [False, True])
def test_warc_of_broken_records(spark, tmp_path, packed):
    good = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("X-Payload-Length", "many")], b"y" * 10_000) for i in range(3)]
    none = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:none>\r\n\r\nWARC is no header\r\n\r\n"
    odd = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: ten\r\n\r\n0123456789\r\n\r\n"
    parts = [good[0], none, odd, good[1], good[2]]
    data = b"".join(map(gzip.compress, parts)) if packed else b"".join(parts)
    cut_ = len(gzip.compress(good[2])) // 2 if packed else 5000
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(data[:-cut_])
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "junk.warc").write_bytes(b"no archive at all")
    warc.register(spark)
    rows = spark.read.format("warc").load(f"file://{tmp_path}").collect()
    assert sorted((r.record_id, len(r.payload), r.payload_length) for r in rows) == [("<urn:0>", 10_000, None), ("<urn:1>", 10_000, None)]


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def plain_rule(host, path):
    best = None
    for action, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (action, h + p)
    return best


def test_url_rules(spark):
    urls = ["https://A.Example.ORG/es/1?x", "http://x.org", "http://x.org/", "http://example.org/en/12", "http://notexample.org/es/", "http://a.com/de/", "http://a.com/frx", "http://com/fr/", "x", None, "a://b://c.com/de/", "http://h.net#/de/", "http://example.org/es/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(0, urls[0], None)], PAGES)
    out = url_filter.judge(df, spark.createDataFrame(RULES, "action string, host string, path string")).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        import re

        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule[1] if rule else None, rule[0] if rule else "allow")


def test_aliases_follow_edges(spark):
    link = lambda u: f"<html><head><LINK href='{u}' rel=canonical></head>"
    rows = [
        (1, "http://n.net/a", link("http://x.com/de/1")), (2, "http://n.net/b", '<meta http-equiv="refresh" content="0; url=http://n.net/a">'), (3, "http://n.net/c", "<p>"),
        (4, "http://m.net/a", link("http://y.com/de/2")), (5, "http://m.net/b", link("http://m.net/a")), (6, "http://z.org/", link("http://m.net/b")), (7, "http://k.net/", link("/relative")),
    ]
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    extra = spark.createDataFrame([("http://n.net/c", "http://n.net/b"), (None, "x")], "u string, v string")
    assert {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), rules, extra).collect()}[3] == "block"
    assert url_filter.judge(spark.createDataFrame([], PAGES), rules).count() == 0


def test_alias_targets_are_decoded_and_resolved(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    fresh = lambda u: f'<meta content="0; URL={u}" http-equiv=Refresh>'
    cases = {
        link("http://x.com/de/1?a=1&amp;b=2"): "http://x.com/de/1?a=1&b=2", link("/de/3"): "http://h.com/de/3", link("//x.com/de/4"): "http://x.com/de/4", link("?q&copy=1"): "http://h.com/p/q?q&copy=1",
        link("http://x.com/it's"): "http://x.com/it's", fresh("http://x.com/de/5;jsessionid=1?a=1&amp;b=2"): "http://x.com/de/5;jsessionid=1?a=1&b=2", fresh("'../de/6'"): "http://h.com/de/6",
        '<base href="http://b.com/r/">' + link("s"): "http://b.com/r/s", fresh("&#x2F;de&#47;7"): "http://h.com/de/7", '<meta http-equiv="refresh" content="5">': None, link("mailto:a@b"): None, link("http://[bad"): "http://[bad", link("//[bad"): None,
    }
    for html, want in cases.items():
        assert url_filter.targets("http://h.com/p/q", html) == ([want] if want else [])
    # a block reaches a page through an alias that is relative, decoded, or has a ';'
    rows = [(1, "http://a.com/p", link("/de/1")), (2, "http://a.net/p", link("//b.com/de/2")), (3, "http://c.net/x?a=1&b=2", "<p>"), (4, "http://c.net/y", link("http://c.net/x?a=1&amp;b=2") + link("http://b.com/de/9")), (5, "http://d.net/s", "<p>"), (6, "http://b.com/de/6", fresh("http://d.net/s;v=1"))]
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}


def test_warc_loses_no_record(spark, tmp_path):
    """Many records of one member, a damaged member, LF header lines: all that is whole is read, and what isn't is counted."""
    rec = lambda i, n=3000: warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>")], random.Random(i).randbytes(n))
    (tmp_path / "w").mkdir()
    put = lambda name, data: (tmp_path / "w" / name).write_bytes(data)
    put("many.warc.gz", gzip.compress(b"".join(map(rec, range(300)))) + gzip.compress(rec(300)))
    members = [bytearray(gzip.compress(rec(i))) for i in range(400, 405)]
    members[1][200] ^= 0xFF
    members[3][12] ^= 0xFF
    put("bad.warc.gz", b"".join(members))
    own = [bytearray(warc.member(rec(i))) for i in range(500, 504)]
    own[1][300] ^= 0xFF
    put("own.warc.gz", b"".join(own))
    lf = b"".join(f"WARC/1.0\nWARC-Type: response\nWARC-Record-ID: <urn:{i}>\nContent-Length: 5\n\nab\n\nc\n\n".encode() for i in range(600, 603))
    put("lf.warc", lf)
    put("lf.warc.gz", gzip.compress(lf.replace(b":60", b":70")))
    put("short.warc.gz", gzip.compress(rec(800)) + gzip.compress(rec(801))[:-500])
    for name in ("payload", None):
        df = spark.read.format("warc").schema("record_id string" + (", payload binary" if name else "")).load(f"file://{tmp_path}/w")
        got = {r.record_id: r for r in df.where("record_id LIKE '<urn:%'").collect()}
        ids = {int(k[5:-1]) for k in got}
        assert ids - {401, 403, 501, 801} == {*range(301), 400, 402, 404, 500, 502, 503, 600, 601, 602, 700, 701, 702, 800}
        if name:
            assert not ids & {401, 403, 501, 801}
            assert all(r.payload == (b"ab\n\nc" if 600 <= i < 800 else random.Random(i).randbytes(3000)) for i, r in ((int(k[5:-1]), r) for k, r in got.items()))
    lost = {r.file.rsplit("/", 1)[1]: r.passed_over for r in warc.damage(spark, f"file://{tmp_path}/w").collect()}
    assert set(lost) == {"bad.warc.gz", "own.warc.gz", "short.warc.gz"} and lost["bad.warc.gz"] >= 2


def test_spellings_without_links(spark):
    """A spelling that no rule fits shares the verdict of its address, though no page links to either."""
    rules = spark.createDataFrame([("block", "x.com", "/de/"), ("allow", "x.com", "/de/ok")], "action string, host string, path string")
    urls = ["http://x.com/de/a", "http://x.com:80/de/a", "HTTP://X.com:80/de/ok", "http://x.com:8080/de/a", "http://y.com:80/de/a", None, "no address", "http://x.com:80/de/a"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert got == {0: ("x.com/de/", "block"), 1: (None, "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block")}


def test_spellings_of_a_url_are_one_node(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://a.net/x", link("HTTP://X.com:80/de/1#top")), (2, "http://x.COM/de/1", "<p>"), (3, "http://b.net", link("http://c.net/y")), (4, "http://c.net:80/y#z", link("http://x.com/de/2")),
        (5, "http://d.net/", "<!-- " + link("http://x.com/de/3") + " -->"), (6, "http://e.net/", "<script>var s = '" + link("http://x.com/de/4") + "';</script>"), (7, "HTTP://B.net/#f", "<p>"),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(RULES, "action string, host string, path string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block"}


def test_aliases_equal_plain_closure(spark):
    rng = __import__("random").Random(5)
    urls = [f"http://{rng.choice(['a.net', 'b.com', 'c.org', 'example.org'])}{rng.choice(['/de/', '/fr/', '/es/', '/x/'])}{i}" for i in range(120)]
    rows = [(i, u, f'<link rel="canonical" href="{rng.choice(urls)}">' if rng.random() < 0.6 else None) for i, u in enumerate(urls)]
    up = {u: u for u in urls}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for _, u, h in rows:
        if h:
            up[find(u)] = find(h.split('href="')[1][:-2])
    rule = lambda u: plain_rule(u.split("/")[2], "/" + u.split("/", 3)[3])
    want = {}
    for i, u, _ in rows:
        votes = {rule(v)[0] for v in urls if find(v) == find(u) and rule(v)}
        own = rule(u)
        want[i] = own[0] if own else "allow" if "allow" in votes or not votes else "block"
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(RULES, "action string, host string, path string")).collect()}
    assert got == want and len(set(want.values())) == 2


# ---- HTML


def test_extraction_on_held_out_pages():
    model = html_text.trained()
    right = blocks = exact = 0
    held_out = labelled_pages(200, 4242)
    for (source, good), text in zip(held_out, model.texts([h for h, _ in held_out]), strict=True):
        page = html_text.parse(source)
        kept = text.split("\n")
        right += sum((t in good) == (t in kept) for _, t, _ in page.blocks)
        blocks += len(page.blocks)
        exact += text == "\n".join(t for _, t, _ in page.blocks if t in good)
    assert right / blocks > 0.97 and exact / len(held_out) > 0.85


def test_extraction_of_layouts_by_hand():
    out = html_text.trained().texts([h for h, _ in LAYOUTS])
    assert sum(x == want for x, (_, want) in zip(out, LAYOUTS, strict=True)) / len(LAYOUTS) >= 0.95


def test_extraction_of_pages_that_mark_nothing():
    out = html_text.trained().texts([h for h, _ in PLAIN])
    assert [x for x, (_, want) in zip(out, PLAIN, strict=True) if x != want] == []


def test_extraction_of_the_test_table():
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    for source, text in zip(pages, html_text.trained().texts(list(pages)), strict=True):
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]  # this table's pages have one plain article
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n".join(x for x in blocks if x)


def test_broken_and_long_pages():
    model = html_text.trained()
    began = time.time()
    assert len(model.texts(["<div>" * 16000 + "</section>" * 16000 + "<p>x"])) == 1
    assert time.time() - began < 2
    words = " ".join(f"word{i}" for i in range(200000))
    assert model.texts([f"<article><h1>Long</h1><p>{words}.</p></article>"]) == [f"Long\n{words}."]
    page = html_text.parse("<div>" * 2000 + "deep")
    assert max(page.depth) <= html_text.DEEPEST + 1 and page.blocks[0][1] == "deep"


def test_marginals_are_exact():
    import itertools

    import numpy as np

    page = html_text.parse("<nav><ul><li><a>x</a></li></ul></nav><article><p>One.</p></article>")
    forest = html_text.Forest([page], {})
    rng = np.random.default_rng(1)
    n = len(forest.tag)
    unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(html_text.OTHER + 1, 2, 2))
    p, _ = forest.marginals(unary, pair)
    total, want = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        s = sum(unary[i, x] for i, x in enumerate(labels)) + sum(pair[forest.tag[i], labels[forest.parent[i]], labels[i]] for i in range(n) if forest.parent[i] >= 0)
        total += np.exp(s)
        want += np.exp(s) * np.array(labels)
    assert np.allclose(p[:, 1], want / total)


TEMPLATE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this.</div><article><h1>Title</h1><p><b>First &amp; only\n  line.<br><p>To.</p><p>Next&nbsp;one.</p></article><footer>&copy; x &middot; Said.</footer>{}"


def test_extraction_of_pages(spark):
    rows = [(1, "u", TEMPLATE.format("</body></html>")), (2, None, TEMPLATE.format("<a hre")), (3, "u", None), (4, "u", ""), (4, "u", "")]
    out = html_text.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))).collect()
    want = "Title\nFirst & only line.\nTo.\nNext one."
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in out] == [(1, "u", want, len(want)), (2, None, want, len(want)), (3, "u", "", 0), (4, "u", "", 0), (4, "u", "", 0)]
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_parts_that_are_not_the_article():
    page = """<body><header class="top"><div>Site name</div></header><div id="cookie-bar">We use cookies.</div><main><article><header><h1>Real title</h1></header><p>To.</p>
    <p>Some text &lt;ok&gt; and <a href=x>link</a>.</p><div class="advert">Buy now!</div><ul><li>point one</li></ul><form><p>Subscribe</p><button>Go</button></form><h2>Sub</h2><p>End.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I think this is great.</p></div></section></main><aside><h3>Related</h3><p>Other story.</p></aside><footer><p>us</p></footer>"""
    assert html_text.trained().texts([page]) == ["Real title\nTo.\nSome text <ok> and link.\npoint one\nSub\nEnd."]
