"""Language identification, toxicity and page extraction."""

import collections
import math

import numpy as np
import pytest
from mooclens.llm import common, ppm, template_extract, toxicity
from mooclens.llm.common import fold
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# ---- language identification


def plain_bits(text, training):
    """Code length of a text under one language's frozen contexts, byte by
    byte, by the recursion itself. Symbols are given as lists."""
    seen = [collections.Counter() for _ in range(4)]
    for t in training:
        padded = [GAP] * 3 + t
        for i in range(3, len(padded)):
            for k in range(4):
                seen[k][tuple(padded[i - k : i + 1])] += 1

    def bits(context, symbol):
        k = len(context)
        row = {g[-1]: n for g, n in seen[k].items() if g[:-1] == context}
        total, kinds = sum(row.values()), len(row)
        if symbol in row:
            return -math.log2(row[symbol] / (total + kinds))
        leave = -math.log2(kinds / (total + kinds)) if total else 0.0
        return leave + (bits(context[1:], symbol) if k else math.log2(ppm.SYMBOLS))

    padded = [GAP] * 3 + text
    return sum(bits(tuple(padded[i - 3 : i]), padded[i]) for i in range(3, len(padded)))


GAP = None


def test_code_lengths_against_the_recursion(spark):
    global GAP
    rows = [("aa", "the cat sat on the mat"), ("aa", "That hat!"), ("bb", "le chat est là, été 42"), ("bb", "la vache")]
    trees = ppm.learn(spark.createDataFrame(rows, "lang string, text string"))
    code = lambda t: trees.symbol[ppm._buffer([t.encode()])[0]][3:].tolist()
    GAP = int(trees.symbol[0x20])
    for text in ("the cat", "été", "zzz qq", "a", "THE VACHE 7 \t"):
        got = trees.lengths([b"x", text.encode(), b""])
        for j, lang in enumerate(trees.langs):
            expect = plain_bits(code(text), [code(t) for x, t in rows if x == lang])
            assert abs(got[1, j] - expect) < 1e-3
        assert (got[2] == 0).all()


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learn = fold("doc_id", 3) != 1
    found = ppm.identify(docs, ppm.learn(ppm.sample(docs, learn))).join(docs, "doc_id").where(~learn & F.col("lang").isNotNull())
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right >= 0.95 * n


def test_language_of_awkward_rows(awkward, nothing):
    trees = ppm.learn(ppm.sample(awkward, F.lit(True)))
    rows = ppm.identify(awkward, trees).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert all(by_id[i]["lang_pred"] == "und" for i in (200, 201, 202))
    assert by_id[206]["lang_pred"] in ("aa", "bb")
    empty = ppm.learn(ppm.sample(nothing, F.lit(True)))
    assert ppm.identify(nothing, trees).count() == 0
    assert {r["lang_pred"] for r in ppm.identify(awkward, empty).collect()} == {"und"}


# ---- toxicity


def plain_nearest(index, terms, w, k, without):
    dense = np.zeros((len(index.vectors), len(index.vocabulary)))
    for e, (t, x) in enumerate(index.vectors):
        dense[e, t] = x
    q = np.zeros(len(index.vocabulary))
    q[terms] = w
    s = dense @ q
    order = [e for e in np.lexsort((np.arange(len(s)), -s.round(12))) if s[e] > 1e-12 and e != without]
    return order[:k], s[order[:k]]


@pytest.fixture(scope="module")
def index(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.learn(docs, labels, fold("doc_id", 5) != 0)


def test_search_is_exact(index):
    assert len(index.vectors) > 20
    for e, (t, w) in enumerate(index.vectors):
        got, cosines = index.nearest(t, w, without=e)
        expect, s = plain_nearest(index, t, w, toxicity.K, e)
        assert got.tolist() == list(expect) and np.allclose(cosines, s)


def test_toxic_words_are_found_and_clean_texts_left(spark, index):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.scored(docs, index, keep=["doc_id", "text"]).where(fold("doc_id", 5) == 0).join(labels, "doc_id").where("toxic is not null")
    rows = held.collect()
    named = ("idiot", "scum", "moron", "loser", "clown", "pathetic", "worthless", "disgusting", "stupid", "trash")
    plain = [r for r in rows if r["toxic"] == 0]
    toxic = [r for r in rows if r["toxic"] == 1 and any(x in r["text"].lower() for x in named)]
    assert sum(r["score"] >= 0.5 for r in plain) <= 0.03 * len(plain)
    assert sum(r["score"] >= 0.5 for r in toxic) >= 0.9 * len(toxic)
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) <= 3 for r in rows)


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(i, 0, int(i % 4 == 0)) for i in range(60)] + [(None, 0, 1), (1, None, None), (1, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int"
    )
    index = toxicity.learn(awkward, labels, F.lit(True))
    out = toxicity.scored(awkward, index)
    assert out.columns == [c for c in awkward.columns if c != "score"] + ["score", "evidence"]
    assert all(0 <= r["score"] <= 1 for r in out.collect()) and out.count() == awkward.count()
    none = toxicity.learn(nothing, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.scored(awkward, none).collect()} == {0.0}
    assert toxicity.scored(nothing, index).count() == 0


# ---- page extraction

PAGE = """<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var x="</p><p>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href="/a">A {0}</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies {0}</div><div id="main"><h1>Head {0}</h1><p>One &amp; two<br>three {0}
four<p>Next <a href="x">link</a> &eacute;&#233;</p><div class="ad">Buy {0}</div><ul><li>item</li><li>second {0}</ul>
<form><p>Your mail</p></form></div><aside>Side {0}</aside><div class="comments"><p>Nice {0}</p></div><footer>&copy; {0}</footer></body></html>"""
MAIN = "Head {0}\nOne & two three {0} four\nNext link éé\nitem\nsecond {0}"


def test_template_pages(spark):
    rows = [(i, f"http://one.org/{i}", PAGE.format(f"w{i} " * (i + 1)), "x") for i in range(20)]
    rows += [(50, None, "<p>just <b>a</b> bit", "x"), (51, "http://two.org", "", "x"), (52, "http://two.org", None, "x"), (53, "", "no tags &lt; at all", "x")]
    rows += [(54, "http://one.org/t", "<html><body><article><h1>Cut</h1><p>off <i>he", "x"), (55, "http://two.org", "<div><a href='x>y", "x")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = template_extract.extract(df)
    assert sorted(out.columns) == ["page_id", "text", "url"] and out.count() == len(rows)
    got = {r["page_id"]: r["text"] for r in out.collect()}
    for i in range(20):
        word = " ".join([f"w{i}"] * (i + 1))
        assert got[i] == MAIN.format(word)
    assert (got[50], got[51], got[52], got[53], got[54]) == ("just a bit", "", "", "no tags < at all", "Cut\noff he")
    assert template_extract.extract(df.limit(0)).count() == 0


def test_given_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in template_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1])]
        assert r["text"] == "\n".join(b for b in blocks if b)


def words(i, n):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_text_beside_the_body_is_kept(spark):
    """A heading, a lead and a second part beside the container of most text; one
    long paragraph a page; a rare note; constant text and link lists go."""
    body = "<html><body><div class=crumbs>You are here</div>{0}<ul class=more><li><a href=x>More {1}</a></ul></body></html>"
    layouts = {
        "lead": "<article><h1>Head {0}</h1><p class=lead>Lead <a href=x>to</a> {0}</p><div class=content><p>One {1}</p><p>Two {1}</p></div></article>",
        "parts": "<h1>Head {0}</h1><article><p>One {1}</p></article><div class=part><p>Two {0}</p></div>",
        "long": "<div class=top><h1>Head {0}</h1></div><div class=content><p>One {1}</p></div>",
    }
    expect = {
        "lead": "Head {0}\nLead to {0}\nOne {1}\nTwo {1}",
        "parts": "Head {0}\nOne {1}\nTwo {0}",
        "long": "Head {0}\nOne {1}",
    }
    rows, wanted = [], {}
    for j, (host, layout) in enumerate(layouts.items()):
        for i in range(20):
            n, short, full = 100 * j + i, words(i, 2), words(i, 60)
            note = ("<div class=note><p>Rare one</p></div>", "\nRare one") if i == 7 else ("", "")
            rows.append((n, f"http://{host}.org/{i}", body.format(layout.format(short, full) + note[0], i)))
            wanted[n] = expect[host].format(short, full) + note[1]
    two = "<html><body><article class=a><p>First</p></article><article class=b><p>Second</p></article></body></html>"
    rows.append((900, "http://few.org", two))
    wanted[900] = "First\nSecond"
    out = template_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == wanted


def test_equal_pages_show_no_constant_text(spark):
    rows = [(i, "http://one.org/", "<body><h1>Head</h1><div class=c><p>Same text</p></div></body>") for i in range(12)]
    out = template_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in out.collect()} == {"Head\nSame text"}


@pytest.mark.parametrize(
    "frame",
    [
        "<body class='page no-sidebar'><article><h1>Head {0}</h1><p>One {1}</p></article></body>",
        "<body><div class='header-fixed wrapper'><article class='post comments-open'><h1>Head {0}</h1><p>One {1}</p></article></div></body>",
        "<body><div class='nav wrapper'><div class=post><h1>Head {0}</h1><p>One {1}</p></div></div></body>",
        "<html class=has-banner><body><form id=widget-form><main id='main-nav-content'><h1>Head {0}</h1><p>One {1}</p></main></form></body></html>",
        "<body><div class=widget><h2>Head {0}</h2><p>One {1}</p></div></body>",
        "<body><article><header><h1>Head {0}</h1></header><p>One {1}</p></article></body>",
    ],
)
def test_names_do_not_take_the_article(frame):
    short, full = words(3, 2), words(3, 60)
    assert template_extract._blocks(frame.format(short, full), [], set()) == f"Head {short}\nOne {full}"


def test_constant_slots_and_comments_in_the_article_go(spark):
    page = """<html><body class=no-sidebar><article class='post comments-open'><h1>Head {0}</h1><p class=lead>Lead {0}</p>
        <div class=join><p>Join us today</p></div><p>One {1}</p><p>Two {0}</p><div class=paywall-box>Pay {0}</div><div class=cta>Buy {0}</div>
        <div class=disqus><article class=comment><p>Reader {1} {1}</p></article></div><section id=replies><p>Nice {0}</p></section></article></body></html>"""
    rows = [(i, f"http://one.org/{i}", page.format(words(i, 2), words(i, 40))) for i in range(20)]
    out = template_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in out.collect()} == {
        i: f"Head {words(i, 2)}\nLead {words(i, 2)}\nOne {words(i, 40)}\nTwo {words(i, 2)}" for i in range(20)
    }


def test_least_hashes_are_those_of_a_whole_sort(spark):
    rows = spark.range(6000).selectExpr("id % 4500 as doc_id", "if(id < 5000, 'a', 'b') as lang")
    hashed = [(r["lang"], r["h"], r["doc_id"]) for r in rows.selectExpr("lang", "xxhash64(doc_id) as h", "doc_id").collect()]
    for most in (1, 700, 3000):
        got = sorted(tuple(r) for r in common.least_hashes(rows, "lang", ["doc_id"], most).select("lang", "doc_id").collect())
        expect = [(lang, d) for lang in "ab" for _, _, d in sorted(x for x in hashed if x[0] == lang)[:most]]
        assert got == sorted(expect)
