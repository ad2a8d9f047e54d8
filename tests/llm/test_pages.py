"""The operators on pages against brute force, with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyarrow import fs

from quern.llm import html, urls, warc

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, text string, host string, digest string, size int, file string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", "d", 1, "f") for r in rows], PAGES)


@pytest.fixture(scope="module")
def none(spark):
    return pages_of(spark, [])


def plain_types(rows, least=1000):
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        same = [p for p, _, t in rows if (t or "").encode() == raw and p is not None]
        first = max(same, default=None)
        repeats = len(raw) >= least and page != first
        out.append((repr(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if repeats else "response", first if repeats else None))
    return sorted(out, key=repr)


def test_warc_round_trip(spark, none):
    big, other = "<p>é " * 400, "b" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (2, "http://b/", big), (3, None, None), (4, "u", ""), (None, "u", big), (5, "u", other), (6, "u", other), (7, "u", "b" * 999), (8, "u", "b" * 999), (9, "u", "x\r\n\r\ny" * 90_000), (10, "u", "\0\r\n\r\nWARC/1.1")]
    got = [(repr(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark, pages_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == plain_types(rows)
    alone = [(None, "u", other), (None, "u", other)]
    assert {r["record_type"] for r in warc.round_trip(spark, pages_of(spark, alone)).collect()} == {"response"}
    assert warc.round_trip(spark, none).count() == 0


def test_warc_members_stand_alone_and_streams_hold_many(spark, tmp_path):
    rows = [(k, f"http://x/{k}", f"<p>{k}</p>" * 300) for k in range(40)]
    path, archives = warc.archived(pages_of(spark, rows), str(tmp_path / "w"))
    assert archives.agg({"records": "sum"}).first()[0] == 40
    system, base = fs.FileSystem.from_uri(path)
    import json
    import zlib

    seen = 0
    for row in archives.collect():
        raw = (tmp_path / "w/members" / row["archive"]).read_bytes()
        for line in (tmp_path / "w/members" / row["sidecar"]).read_text().splitlines():
            e = json.loads(line)
            unzip = zlib.decompressobj(warc.GZIP)
            record = unzip.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert unzip.eof and not unzip.unused_data and record.startswith(b"WARC/1.1\r\n")
            seen += 1
    assert seen == 40


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def test_url_rules_and_verdicts(spark, none):
    rng = random.Random(1)
    hosts = ["example.net", "a.EXAMPLE.net", "badexample.net", "net", "x.org", "org", "example.com", "sub.example.com", "É.example.com", "example.net:80", "user@example.com"]
    tails = ["", "/", "/en/1", "/en", "/de/2?x=/fr/", "/fr/#/de/", "?q=/en/", "#/en/", "/DE/3", "/de/a://b"]
    rows = [(k, rng.choice(["http://", "https://", "://", "x"]) + h + t, "") for k, (h, t) in enumerate((h, t) for h in hosts for t in tails)]
    rows += [(900, None, ""), (901, "", ""), (None, "http://a.net/", ""), (901, "", "")]
    got = urls.judged(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    links = dict((p, u) for p, u, _ in rows)
    for r in got:
        host, path = plain_url(links[r["page_id"]])
        fits = [t for t in urls.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (urls.RULES[rule] if rule else "block" if r["score"] >= 0.5 else "allow")
    assert urls.judged(none).count() == 0


def test_url_classifier_tells_unseen_hosts(spark):
    rows = [(1, "http://www.adult-x.example.com/en/2000", ""), (2, "http://m.spam-farm.example.com/fr/17.html", ""), (3, "http://casino-win.example.com/en/1", ""), (4, "http://www.therble.example.com/es/77", ""), (5, "http://blog.tionwh.example.com/en/9", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages_of(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


@pytest.fixture(scope="module")
def model():
    return html.train()


def test_html_of_odd_pages(spark, none, model):
    rows = [
        (1, "u", None), (2, "u", ""), (3, "u", "   "),
        (4, "u", "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A  title\n here</h1><p>First &amp; second&nbsp;&#233; para<b>graph</b>.<br>More.<p>Third <!-- no --><i>one</i>.</article><footer>&copy; 2020</footer>"),
        (5, "u", "<body><div class='ad'>Buy now</div><main><p>Body text that is long enough to be text.</p><script>var x='<p>no</p>'</script><style>p{}</style><ul><li>One item of it.<li>Another item.</ul></main><section class='comments'><p>Great post!</p></section></body>"),
        (None, "u", "<article><p>" + "word " * 200_000 + "</p></article>"),
        (4, "u", "<article><p>a &lt;b&gt; c &amp</p></article>"),
        (7, "u", "<article><p>text</p><!-- never ends <p>gone</p>"), (8, "u", "<article><p>kept</p><script>never ends <p>gone</p>"),
    ]
    got = {}
    for r in html.extracted(pages_of(spark, rows), model).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == got[2] == got[3] == [""]
    assert sorted(got[4]) == ["A title here\nFirst & second é paragraph. More.\nThird one.", "a <b> c &"]
    assert got[5] == ["Body text that is long enough to be text.\nOne item of it.\nAnother item."]
    assert len(got[None][0]) == 5 * 200_000 - 1
    assert got[7] == ["text"] and got[8] == ["kept"]
    assert html.extracted(none, model).count() == 0


def test_labeller_on_held_out_generated_pages(model):
    rng = np.random.default_rng(99)
    pages = [html.generated(rng) for _ in range(200)]
    found = [list(html.blocks(p)) for p, _ in pages]
    assert all(len(f) == len(m) for f, (_, m) in zip(found, pages, strict=True))
    right = np.concatenate([mark == np.array(m) for mark, (_, m) in zip(html.labelled(model, found), pages, strict=True)])
    assert right.mean() > 0.99


@pytest.mark.parametrize("tail", ["<div " + "a" * 60, "<div class=\"cut off", "<script " + "b" * 60, "</div" + "c" * 60, "<!" + "d" * 60, "<a " * 20_000])
def test_a_page_that_ends_inside_a_tag(tail):
    assert [b[0] for b in html.blocks("<p>Kept text.</p>" + tail)] == ["Kept text."]


def test_a_stray_quote_takes_no_text():
    assert [b[0] for b in html.blocks("<p>One</p><p class=\"x>Two</p><p>Three</p>")][-1] == "Three"


def test_long_pages_run_alone():
    sizes = [3] * 100 + [900] * 70 + [100_000]
    groups = list(html.together(sizes))
    assert [k for a, z in groups for k in range(a, z)] == list(range(len(sizes)))
    assert all(z - a <= html.TOGETHER and (z - a == 1 or (z - a) * sizes[z - 1] <= html.PLACES) for a, z in groups)
    assert list(html.together([])) == []


def test_lstm_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 3, 4))
    w, u, b = rng.normal(size=(4, 4 * html.HIDDEN)) / 3, rng.normal(size=(html.HIDDEN, 4 * html.HIDDEN)) / 5, rng.normal(size=4 * html.HIDDEN) / 5
    out, kept = html.lstm(x, w, u, b)
    goal = rng.normal(size=out.shape)
    dx, dw, du, db = html.lstm_back(x, goal, kept, w, u)
    for value, grad in ((x, dx), (w, dw), (u, du), (b, db)):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in value.shape)
            keep = value[at]
            value[at] = keep + 1e-5
            high = (html.lstm(x, w, u, b)[0] * goal).sum()
            value[at] = keep - 1e-5
            low = (html.lstm(x, w, u, b)[0] * goal).sum()
            value[at] = keep
            assert abs((high - low) / 2e-5 - grad[at]) < 1e-5 * max(1, abs(grad[at]))


def test_html_of_the_table_against_its_markup(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    right = 0
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    import html as entities

    for r in html.extracted(pages, model).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        right += r["text"] == "\n".join(p for p in parts if p)
    assert right >= 0.99 * len(rows)
