"""URL verdicts and WARC derivatives against plain versions."""

import gzip
import random
import zlib

import pytest
from brute_force import url_verdicts
from test_text_operators import RULES, rows_of

from tallyhouse.llm import url_filter, warc
from tallyhouse.llm.queries import RULES as PRODUCTION

PAGES = "page_id long, url string, html string"


def _verdicts(df, rules):
    return [(*r[:5], round(r[5], 6)) for r in rows_of(url_filter.judge(df, rules).select(
        "page_id", "host", "path", "rule", "verdict", "block_odds"))]


def _pages():
    pick = random.Random(4)
    words = ["river", "stone", "cheap", "pills", "blog", "news", "garden", "spam"]
    rows = []
    for i in range(120):
        host = f"{''.join(pick.sample(words, pick.randint(1, 3)))}{pick.choice(['', '7'])}.example.{pick.choice(['org', 'com', 'net'])}"
        path = f"/{pick.choice(['en', 'es', 'fr', 'de'])}/{pick.choice(['', '1', '12', 'Über-uns', 'a.html'])}"
        text = " ".join(pick.choices(words, k=20))
        rows.append((i % 100, f"http://{host}{path}?q=1", f"<p>{text}</p><script>nothing</script>"))
    return rows + [(None, None, None), (1, "", ""), (2, "no scheme", "<b>stone"), (3, "http://x.net", None)]


def test_verdicts_against_plain_viterbi_and_bayes(spark):
    rows = _pages()
    assert _verdicts(spark.createDataFrame(rows, PAGES), RULES) == url_verdicts(rows, RULES)


def test_verdicts_of_the_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    got = _verdicts(df, PRODUCTION)
    assert got == url_verdicts(rows, PRODUCTION)


def test_what_rules_say_is_learned(spark):
    """Paths in /es/ are blocked and others allowed; hosts that no rule names follow."""
    rows = [(i, f"http://{'abc'[i % 3]}.site.org/{'es' if i % 4 == 0 else 'en'}/{i}", "<p>site</p>") for i in range(200)]
    rows += [(1000 + i, f"http://other.net/{'es' if i % 2 else 'en'}/{i}", "") for i in range(20)]
    df = spark.createDataFrame(rows, PAGES)
    rules = {"site.org/es/": "block", "site.org/en/": "allow"}
    for r in url_filter.judge(df, rules).filter("page_id >= 1000").collect():
        assert r.rule is None and r.verdict == ("block" if r.page_id % 2 else "allow")
    right, kept = url_filter.accuracy(df, rules)
    assert right == kept > 20


def test_accuracy_on_rule_decided_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    right, kept = url_filter.accuracy(df, PRODUCTION)
    assert kept >= 10 and right >= 0.8 * kept


# --- WARC ----------------------------------------------------------------------------------------


def _response(payload, *headers):
    block = "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + payload
    return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://a/")], block)


def _chunked(data, size):
    parts = [data[i: i + size] for i in range(0, len(data), size)]
    return b"".join(f"{len(p):X};x=1\r\n".encode() + p + b"\r\n" for p in parts) + b"0\r\n\r\n"


HTML = "<html><head><title>Grüße</title></head><body><p>Ein süßer Text</p><p>zwei</p></body></html>"
SHOWN = "Grüße\nEin süßer Text\nzwei"
DATA = HTML.encode()
META = HTML.replace("<head>", '<head><meta charset="iso-8859-1">')

BODIES = {
    "plain": (DATA, ["Content-Type: text/html"], SHOWN),
    "gzip": (gzip.compress(DATA), ["Content-Type: text/html", "Content-Encoding: gzip"], SHOWN),
    "two members": (gzip.compress(DATA[:30]) + gzip.compress(DATA[30:]), ["Content-Encoding: x-gzip", "content-type: text/html"], SHOWN),
    "zlib": (zlib.compress(DATA), ["Content-Type: text/html", "Content-Encoding: deflate"], SHOWN),
    "raw deflate": (zlib.compress(DATA, wbits=-15), ["Content-Type: text/html", "Content-Encoding: deflate"], SHOWN),
    "chunked": (_chunked(DATA, 7), ["Content-Type: text/html", "Transfer-Encoding: chunked"], SHOWN),
    "chunked gzip": (_chunked(gzip.compress(DATA), 11),
                     ["Content-Type: text/html", "Transfer-Encoding: chunked", "Content-Encoding: gzip"], SHOWN),
    "latin header": (HTML.encode("latin-1"), ["Content-Type: text/html; charset=ISO-8859-1"], SHOWN),
    "latin meta": (META.encode("latin-1"), ["Content-Type: text/html"], SHOWN),
    "utf-16": (HTML.encode("utf-16"), ["Content-Type: text/html; charset=utf-16"], SHOWN),
    "unknown charset": (DATA, ["Content-Type: text/html; charset=klingon"], SHOWN),
    "xml": ('<?xml version="1.0" encoding="latin-1"?><p>süß</p>'.encode("latin-1"), ["Content-Type: application/xhtml+xml"], "süß"),
    "text": ("a < b\n\n c".encode(), ["Content-Type: text/plain"], "a < b\n\n c"),
    "no type": (DATA, [], SHOWN),
}
BROKEN = {
    "pdf": (b"%PDF-1.4 ..", ["Content-Type: application/pdf"]), "pdf without type": (b"%PDF-1.4 ..", []),
    "zip bytes": (gzip.compress(DATA), []), "image": (b"\x89PNG", ["Content-Type: image/png"]),
    "cut gzip": (gzip.compress(DATA)[:-9], ["Content-Type: text/html", "Content-Encoding: gzip"]),
    "no gzip": (DATA, ["Content-Type: text/html", "Content-Encoding: gzip"]),
    "cut chunk": (_chunked(DATA, 50)[:40], ["Content-Type: text/html", "Transfer-Encoding: chunked"]),
    "no chunk": (DATA, ["Content-Type: text/html", "Transfer-Encoding: chunked"]),
    "brotli": (DATA, ["Content-Type: text/html", "Content-Encoding: br"]),
}


@pytest.mark.parametrize("name", BODIES)
def test_bodies(name):
    payload, headers, shown = BODIES[name]
    found = warc.derivatives(_response(payload, *headers))
    assert found["text"] == shown and found["payload_digest"] == warc.digest(payload)


def test_bodies_that_are_no_text(spark):
    rows = [(i, _response(p, *h)) for i, (p, h) in enumerate(BROKEN.values())]
    got = warc.derive(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert len(got) == len(BROKEN)
    assert all(r.error and r.text is None and r.conversion is None and r.metadata is None for r in got)


def test_derivatives_of_the_smallest_table(spark):
    """Each page's text, counts and digests again from its markup."""
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r.page_id: r for r in df.collect()}
    rows = warc.derive(warc.responses(df)).collect()
    assert len(rows) == len(pages)
    for r in rows:
        markup = pages[r.page_id].html or ""
        assert r.error is None and r.payload_digest == warc.digest(markup.encode())
        fields, block = warc.parse(bytes(r.conversion))
        assert block.decode() == r.text == warc.visible_text(markup)
        notes = warc.parse(bytes(r.metadata))[1].decode()
        assert f"links: {markup.lower().count('<a href')}\r\n" in notes and warc.field(fields, "WARC-Refers-To") == r.refers_to
