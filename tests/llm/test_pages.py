"""Operators on pages: archives, main text, URL rules."""

import gzip
import hashlib
import itertools
import random
import time

import pytest

from hushframe.llm import html_text, url_rules, warc
from hushframe.llm.shared import fresh_dir, release, stash

PARAGRAPH = "<p>" + "Real words of an article, long enough to count as its text. " * 3 + "</p>"
TEXT = ("Real words of an article, long enough to count as its text. " * 3).strip()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)


def test_archives_round_trip(spark):
    r = random.Random(2)
    big = "é" + "".join(r.choice("abc <>&\r\n") for _ in range(3000))
    rows = [(1, "http://a.org/", big), (5, "http://a.org/5", big), (3, None, big), (7, "http://b/\r\nX: y", "short"), (8, "u", "short"), (9, None, None), (9, None, None), (10, "v", ""), (None, "w", big)]
    rows += [(100 + k, f"http://c/{k}", "z" * r.randrange(900, 1100)) for k in range(40)]
    table = pages(spark, rows)
    listed = warc.write(table, fresh_dir(spark, "t"))
    normal = warc.normalise(listed)
    got = warc.read(normal).collect()
    assert len(got) == len(rows) and sum(x.records for x in listed.collect()) == len(rows)
    largest = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    expected = []
    for i, u, h in rows:
        body = (h or "").encode()
        to = largest.get(h)
        to = None if to == i or len(body) < 1000 or sum(x[2] == h for x in rows) < 2 else to
        expected.append((i, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to))
    key = lambda t: str(t)
    assert sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=key) == sorted(expected, key=key)
    # revisits have the payload of what they refer to
    assert sorted((str(x.page_id), bytes(x.payload)) for x in got) == sorted((str(i), (h or "").encode()) for i, _, h in rows)


def test_one_page_id_with_several_payloads(spark):
    a, b = "a" * 1500, "b" * 1500
    rows = [(1, "u", a), (1, "v", b), (0, "w", a), (0, "x", b)]
    normal = warc.normalise(warc.write(pages(spark, rows), fresh_dir(spark, "t")))
    got = sorted((x.url, x.record_type, x.refers_to, bytes(x.payload).decode()[:1]) for x in warc.read(normal).collect())
    assert got == [("u", "response", None, "a"), ("v", "response", None, "b"), ("w", "revisit", 1, "a"), ("x", "revisit", 1, "b")]


def test_locations(spark):
    assert warc.location("s3a://bucket/a/b") == "s3://bucket/a/b" and warc.location("hdfs://n:8020/a") == "hdfs://n:8020/a"
    assert warc.location("file:/tmp/x") == warc.location("file:///tmp/x") == "file:///tmp/x"
    assert warc.location(warc.qualified(spark, "/tmp/x")) == "file:///tmp/x"


def test_normaliser_reads_streams_and_members(tmp_path):
    records = [warc._record(k, f"http://x/{k}", bytes([65 + k]) * (k * 700_000 + 3), hashlib.sha1(bytes([65 + k]) * (k * 700_000 + 3)).hexdigest(), k * 700_000 + 3, None) for k in range(4)]
    whole, members = tmp_path / "raw-1.gz", tmp_path / "raw-2.gz"
    whole.write_bytes(gzip.compress(b"".join(records)))
    members.write_bytes(b"".join(map(gzip.compress, records)))
    for source in (whole, members):
        target = f"file://{tmp_path}/out-{source.name}"
        n, size = warc.normalise_file(f"file://{source}", target)
        data = (tmp_path / f"out-{source.name}").read_bytes()
        lines = [x.split("\t") for x in (tmp_path / f"out-{source.name}.idx").read_text().splitlines()]
        assert n == 4 and size == len(data) and sum(int(x[1]) for x in lines) == size
        for k, (start, length, name, kind) in enumerate(lines):
            got = warc.read_record(data[int(start) : int(start) + int(length)])
            assert got["page_id"] == k and name == f"<urn:page:{k}:{got['payload_digest']}>" and kind == "response" and len(got["payload"]) == k * 700_000 + 3


def test_empty_archive(spark):
    listed = warc.write(pages(spark, [(1, "u", "h")]).limit(0), fresh_dir(spark, "t"))
    assert warc.read(warc.normalise(listed)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<nav><a href=1>Menu</a></nav><article><h1>T &amp; U</h1><p>Hi&nbsp;\n there.</p></article><footer>long footer text, longer than all the rest</footer>", "T & U\n\nHi there."),
        (f"<article><h1>A</h1><p><b>Bold<br>{PARAGRAPH}{PARAGRAPH}", f"A\n\nBold\n\n{TEXT}\n\n{TEXT}"),
        (f"<div id=top><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class=w><div><h2>H</h2>{PARAGRAPH}<p>Short.</p>{PARAGRAPH}</div><div class='sidebar'><p>Side</p></div></div>", f"H\n\n{TEXT}\n\nShort.\n\n{TEXT}"),
        (f"<main>{PARAGRAPH}<div id=comments><p>Reader words</p></div><form>Name <input></form><aside>More</aside><div class=cookie-notice>We use</div></main>", TEXT),
        ("<script>var a = '</p><p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;b&gt;</p>", "yes <b>"),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\n\ntwo\n\na\n\nb\n\nc"),
        (f"<div class='page has-sidebar'><div class=entry-header><h1>T</h1></div>{PARAGRAPH}<div class='site-header x'>no</div></div>", f"T\n\n{TEXT}"),
        ("<p>cut off <b>here</b> <a href=", "cut off here"),
        ("a < b and <3", "a < b and <3"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


LINE = "<div>&copy; 2024 Example</div>"
TEASER = "<div><p>Get our letter.</p></div>"
THREE = "\n\n".join([TEXT] * 3)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div>Please note.</div><h1>T</h1><div>{PARAGRAPH * 3}</div>{TEASER}{LINE}", f"T\n\n{THREE}"),
        (f"{TEASER}<h1>T</h1>{PARAGRAPH * 2}<p>Short.</p>{PARAGRAPH}<p>End.</p>{LINE}", f"T\n\n{TEXT}\n\n{TEXT}\n\nShort.\n\n{TEXT}\n\nEnd."),
        (f"<div><div><h1>T</h1><p>By me</p></div><div>{PARAGRAPH * 3}</div>{LINE}</div>{LINE}", f"T\n\nBy me\n\n{THREE}"),
        (f"<div><ul><li><a href=a>One</a><li><a href=b>Two</a></ul>{PARAGRAPH * 3}<ul><li><a href=c>Next page</a></ul></div>", THREE),
        (f"<div>{TEXT}<br>{TEXT}<ul><li>one<li>two</ul>{TEXT}</div>{LINE}", f"{TEXT} {TEXT}\n\none\n\ntwo\n\n{TEXT}"),
        (f"<div>{PARAGRAPH * 3}</div>{LINE}<div>{PARAGRAPH}</div>", f"{THREE}\n\n{TEXT}"),
    ],
)
def test_density_decides_without_an_article(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><article>{PARAGRAPH * 3}</article><article>{PARAGRAPH * 2}</article>{TEASER}</div>{LINE}", f"{THREE}\n\n{TEXT}\n\n{TEXT}"),
        (f"<h1>Log</h1><article>{PARAGRAPH}</article><article><h2>B</h2>{PARAGRAPH * 3}</article><article><p>Short.</p></article>{LINE}", f"Log\n\n{TEXT}\n\nB\n\n{THREE}\n\nShort."),
        (f"<div><article>{PARAGRAPH * 3}</article></div><div><article><a href=x>A linked teaser</a></article></div>{LINE}", THREE),
        (f"{LINE}<article>{PARAGRAPH}<p>Short.</p></article>{LINE}", f"{TEXT}\n\nShort."),
        (f"<main><h1>T</h1>{PARAGRAPH * 3}<div>End.</div></main>{LINE}", f"T\n\n{THREE}\n\nEnd."),
    ],
)
def test_articles_bound_the_text(page, text):
    assert html_text.main_text(page) == text


ARTICLE = f"<article><h1>T</h1>{PARAGRAPH * 3}</article>"


@pytest.mark.parametrize("wrapper", ["div class=sidebar-left", "div class='layout side'", "div class=elementor-widget-container", "section id=share-page", "div class=related-layout", "div class='comments-open'", "form id=aspnetForm"])
@pytest.mark.parametrize("inside", [ARTICLE, f"<main>{ARTICLE}</main>", f"<div><h1>T</h1>{PARAGRAPH * 3}</div>"])
def test_names_and_forms_do_not_drop_the_article(wrapper, inside):
    end = f"</{wrapper.split()[0]}>"
    page = f"<nav><a href=x>Menu</a></nav><{wrapper}>{inside}<div class=sidebar><p>Side</p></div><form>Name <input></form>{end}{LINE}"
    assert html_text.main_text(page) == f"T\n\n{THREE}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=widget><article>{PARAGRAPH * 3}</article></div><div class=widget><article>{PARAGRAPH * 2}</article></div>", f"{THREE}\n\n{TEXT}\n\n{TEXT}"),
        (f"<article>{PARAGRAPH}</article><div class=sidebar>{PARAGRAPH * 3}</div>", TEXT),
        (f"<div><h1>T</h1>{PARAGRAPH * 2}</div><div id=comments><article>{PARAGRAPH}</article><article>{PARAGRAPH * 3}</article></div>", f"T\n\n{TEXT}\n\n{TEXT}"),
        (f"<div class=side>{PARAGRAPH}</div><div class=side>{PARAGRAPH}</div>", f"{TEXT}\n\n{TEXT}"),
        (f"<div class=widget>{PARAGRAPH * 3}</div><div id=comments><article>{PARAGRAPH}</article></div>", THREE),
    ],
)
def test_names_still_drop_what_is_beside_the_article(page, text):
    assert html_text.main_text(page) == text


def test_main_text_of_a_huge_page():
    assert len(html_text.main_text("<article>" + PARAGRAPH * 20_000 + "</article>")) == 20_000 * (len(TEXT) + 2) - 2
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_text.main_text(deep) == "x"


def test_extract_keeps_columns(spark):
    table = pages(spark, [(1, "u", "<p>a</p>"), (2, None, None)]).selectExpr("*", "'old' AS text", "1 AS _html")
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    assert got[1]["text"] == "a" and got[2]["text"] == "" and got[1]["_html"] == 1
    assert html_text.extract(table.limit(0)).count() == 0


URLS = {
    "http://a.example.org/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"),
    "https://Example.ORG/en/12?q=1": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
    "http://x.com/fr/1#top": ("x.com", "/fr/1", "com/fr/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://x.com/de": ("x.com", "/de", None, "allow"),
    "http://org": ("org", "", None, "allow"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "ftp://É.Org?x://y/": ("É.org", "", None, "allow"),
    "no scheme/org/": ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_fixed_rules(spark):
    table = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = url_rules.judge(table, url_rules.mine(spark.createDataFrame([], "url string, bad boolean")))
    assert {r["url"]: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == URLS and got.count() == 2 * len(URLS)


def test_mined_rules(spark):
    """Hosts with one label are bad only below one path; mining finds the combination, not its parts."""
    r = random.Random(3)
    rows = []
    for k in range(800):
        site, part = r.choice(["pills", "news", "shop"]), r.choice(["en", "fr"])
        rows.append((f"http://{site}.x{k % 7}.net/{part}/{k}.html?id={k}", site == "pills" and part == "fr"))
    rows += [(None, True), ("no url", False), ("http://a.net/", None)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), min_count=10)
    found = {frozenset(t[0] for t in x.tokens) for x in mined.collect()}
    assert frozenset({"host=pills", "path=fr"}) in found and not any(len(x) == 1 for x in found)
    table = pages(spark, [(1, "http://pills.new.net/fr/9", ""), (2, "http://pills.new.net/en/9", ""), (3, "http://pills.z.org/fr/9", ""), (4, None, ""), (1, "http://pills.new.net/fr/9", "")])
    got = {x["url"]: x.verdict for x in url_rules.judge(table, mined).collect()}
    assert got == {"http://pills.new.net/fr/9": "block", "http://pills.new.net/en/9": "allow", "http://pills.z.org/fr/9": "allow", None: "allow"}


def brute_rules(baskets, least, confidence):
    """The least token sets that imply a bad label, as sets of the URLs they are in: equal for tokens that share all URLs."""
    tokens = sorted({t for own, _ in baskets for t in own})
    rules = []
    for size in range(1, 5):
        for combination in itertools.combinations(tokens, size):
            some = frozenset(combination)
            held = [bad for own, bad in baskets if some <= own]
            if sum(held) >= least and sum(held) >= confidence * len(held) and not any(part < some for part in rules):
                rules.append(some)
    return set(rules)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mined_rules_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = ["p", "q", "r", "s", "t"]
    bad_pairs = [set(r.sample(names, 2)) for _ in range(2)] + [set(r.sample(names, 3))]
    rows = []
    for _ in range(300):
        own = {x for x in names if r.random() < 0.5}
        bad = any(pair <= own for pair in bad_pairs) if r.random() < 0.95 else r.random() < 0.5
        twin = ["u", "v"] if "p" in own else []  # in the very same URLs as p
        rows.append((f"http://h.net/{'/'.join(sorted([*own, *twin]))}", bad))
    baskets = [(frozenset(f"path={x}" for x in u[13:].split("/") if x) | {"domain=h.net"}, bad) for u, bad in rows]
    expected = brute_rules(baskets, 10, 0.8)
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"), min_count=10).collect()
    got = {frozenset(choice) for x in mined for choice in itertools.product(*x.tokens)}
    assert got == expected and expected
    for x in mined:
        some = {t[0] for t in x.tokens}
        held = [bad for own, bad in baskets if some <= own]
        assert abs(x.confidence - sum(held) / len(held)) < 1e-9 and abs(x.support - sum(held) / len(baskets)) < 1e-9


def test_a_deep_path_is_one_token(spark):
    """Sixty segments below which half of the pages are bad; without collapsing, 2**60 combinations."""
    deep = "/".join(f"s{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(f"http://h.net/{deep}/{'x' if k % 2 else 'y'}/{k}.html", bool(k % 2)) for k in range(80)] + [(f"http://h.net/x/{k}.html", False) for k in range(200)]
    mined = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert len(mined) == 1 and sorted(map(len, mined[0].tokens)) == [1, 60]
    judged = url_rules.match(pages(spark, [(1, "http://o.net/sca/x/1", ""), (2, "http://o.net/sca/1", ""), (3, "http://o.net/x/1", "")]), spark.createDataFrame(mined, url_rules._RULES))
    assert {r["__hf_url"] for r in judged.collect()} == {"http://o.net/sca/x/1"}


HOSTILE = {
    "start tags": "<a " * 350_000,
    "quotes": '<a "' * 260_000,
    "quoted ends": '<a x=">"' * 130_000 + "x='>",
    "stray ends": "<div>" * 2000 + "</section>" * 100_000,
    "inline under blocks": "<div>" * 2000 + "<b>" * 300_000,
    "ends out of a block": "<i><div>" + "<b>" * 150_000 + "</i>" * 150_000,
    "paragraphs in inline": "<b>" * 150_000 + "<p>" * 150_000,
    "items in blocks": "<div>" * 100_000 + "<li>" * 100_000,
    "raw ends": "<script>" + "</script " * 110_000,
    "comments": "<!--" * 260_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    """A megabyte each; quadratic work would take minutes to hours."""
    began = time.process_time()
    html_text.main_text(HOSTILE[name])
    assert time.process_time() - began < 20


def test_release_deletes_what_was_stashed(spark):
    from urllib.parse import urlparse

    df = stash(spark.range(3), "gone")
    folder = urlparse(df.inputFiles()[0]).path.rpartition("/")[0]
    import os

    assert os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)
