"""Quality classifier, Hamming index, HTML text."""

import random
import zlib

import numpy as np
import pytest

from placewright.llm.hamming_index import Shard, hamming, learn, nearest
from placewright.llm.html_text import extract, main_text
from placewright.llm.quality import Settings, keep_good, score

SMALL = "/root/testdata/sf0.001"


def labelled(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(words) + ("" if good else "!!") for _ in range(rng.randint(5, 60)))
        rows.append((i, text, "en"))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(1000, None, "en"), (1001, "", "en"), (None, "w1 w2", "en"), (1, rows[1][1], "en"), (1002, "w1 w2 w3 " * 20_000, "en")]
    labels += [(5, None, 0), (4, labels[2][1], 1), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, t, _ in rows)


def test_score(spark):
    docs, labels, texts = labelled(spark)
    got = score(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(r.score >= 0.3, "!!" not in texts[r.doc_id]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {r.score for r in got if r.doc_id in (1000, 1001)} == {next(r.score for r in got if r.doc_id == 1001)}
    good = keep_good(docs, labels)
    assert good.columns == docs.columns
    assert good.count() == sum(r.predicted for r in got)


def test_score_reads_no_held_out_label(spark):
    docs, labels, _ = labelled(spark)
    held = labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    changed = labels.subtract(held).unionAll(held.selectExpr("doc_id", "1 - quality", "toxic"))
    same = lambda x: sorted(map(tuple, x.collect()), key=str)
    assert same(score(docs, labels)) == same(score(docs, changed))


def test_score_without_labels_or_rows(spark):
    docs, labels, _ = labelled(spark)
    assert {r.score for r in score(docs, labels.filter("doc_id < 0")).collect()} == {0.5}
    assert score(docs.filter("doc_id < 0"), labels).count() == 0
    assert score(docs, labels, settings=Settings(sample=10)).count() == docs.count()


def test_held_out_accuracy_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    rows = score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9


def brute(rows, k):
    known = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 8:
            continue
        known[i] = min(known.get(i, v), v)
    ids = np.array(sorted(known))
    x = np.array([known[i] for i in ids], dtype=float)
    out = {}
    for i in ids[ids % 50 == 0]:
        q = np.array(known[i], dtype=float)
        s = (x @ q) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q))
        out[i] = [(j, round(s[t], 9)) for t in np.lexsort((ids, -np.round(s, 12))) if (j := ids[t]) != i][:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # copies, two of them queries
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [float("nan")] * 8), (2200, [float("inf")] + [1.0] * 7), (2250, [None] + [1.0] * 7), (2300, [1.0, 2.0]), (None, [1.0] * 8), (50, rows[50][1])]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, shard int, turn int, rank int").repartition(3)
    want = brute(rows, 5)
    got = nearest(table, shard_rows=200).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == want.keys() and all(len(v) == 5 for v in by.values())
    hits = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want) / (5 * len(want))
    assert hits >= 0.95
    for q in (1000, 1050):
        assert [i for i, _ in by[q]] == [i for i, _ in want[q]]
    assert nearest(table.filter("vec_id in (0, 1, 2)")).count() == 2
    assert nearest(table.filter("vec_id = 0")).count() == 0
    assert nearest(table.filter("vec_id < 0")).count() == 0


def test_recall_on_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = n = 0
    for t in np.flatnonzero(ids % 50 == 0):
        s = x @ x[t]
        s[t] = -9
        hits += len(got[ids[t]] & set(ids[np.argsort(-s)[:5]].tolist()))
        n += 5
    assert hits / n >= 0.9


def test_every_code_within_the_radius_is_found():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    codes = learn(x / np.linalg.norm(x, axis=1, keepdims=True), 5, 64, 0.5)
    shard = Shard(np.arange(500), x, codes, 5)
    for i in range(0, 500, 25):
        code = codes.of(x[i : i + 1] / np.linalg.norm(x[i]))[0]
        near = set(np.flatnonzero(hamming(shard.own, code) <= codes.radius).tolist())
        assert near <= set(shard.within(code).tolist())


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="related">
<header><p>Site header, with, many, commas, and a lot of words in it.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, and partners, and trackers, to make this page work for you.</p></div>
<div id="page"><div class="story"><h1>Title &amp; more</h1><p>First &eacute; paragraph, with&nbsp;some   text,
and a <b>bold</b> <a href="x">link</a>, long enough to count.</p><!-- <p>hidden</p> --><p>Second paragraph, which is<br>also long, and has commas, too.<ul><li>One item<li>Two items</ul>
<form><p>Sign up here, now, with, your, address.</p><input name=q></form><p>Tail &#x41;&lt;b&gt;, &copy 2020 is text too.</div>
<div class="sidebar"><p>Sidebar text, with, commas, that, must, go, away, entirely.</p></div></div>
<div id="comments"><p>Great post, thanks, I liked it, a lot, really, very much.</p></div><footer><p>Footer, text, 2020, all rights, reserved, by us.</p></footer>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == ["Title & more", "First é paragraph, with some text, and a bold link, long enough to count.", "Second paragraph, which is also long, and has commas, too.", "One item", "Two items", "Tail A<b>, © 2020 is text too."]


@pytest.mark.parametrize(("page", "want"), [("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<p>cut <b", "cut"), ("<div><p>x &lt; y", "x < y"), ("a < b", "a < b"), ("<script>x", ""), ("<!-- open", ""), ("<nav>only a menu</nav>", "")])
def test_small_pages(page, want):
    assert main_text(page) == want


LONG = "This paragraph is the article, long enough, with commas, to be taken for text."


@pytest.mark.parametrize(("page", "want"), [
    (f"<div class='content no-sidebar'><p>{LONG}</p></div>", LONG),
    (f"<div class='has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'><p>{LONG} Not.</p></div></div>", LONG),
    (f"<div class='sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<div class='site-header'>Site</div><article><div class='post-header'><h1>Headline</h1></div><p>{LONG}</p></article>", f"Headline\n{LONG}"),
    (f"<header>Site</header><article><header><h1>Headline</h1></header><p>{LONG}</p></article>", f"Headline\n{LONG}"),
    (f"<article><p>{LONG}</p><ul><li><a href=a>A first source of it</a><li><a href=b>A second source of it</a></ul></article>", f"{LONG}\nA first source of it\nA second source of it"),
    (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div><nav><a>x</a></nav><div class='ad-slot'>Buy, buy, buy now or never, it is cheap</div></article>", LONG),
])
def test_main_text_of_wrappers_and_parts(page, want):
    assert main_text(page) == want


def test_extract(spark):
    deep = "<div>" * 5000 + "<p>deep, but still text, of a page</p>"
    long = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "u", ""), (3, "u", deep), (4, "u", long)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(table).collect()
    assert sorted([(r.page_id, r.url, r.text, r.n_chars) for r in got], key=str) == sorted([(i, u, main_text(h or ""), len(main_text(h or ""))) for i, u, h in rows], key=str)
    assert [r.text for r in got if r.page_id == 3] == ["deep, but still text, of a page"]
    assert next(r.text for r in got if r.page_id == 4).count("\n") == 4999
    assert extract(table.filter("page_id < 0")).count() == 0
