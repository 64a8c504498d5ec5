"""Main text of pages, and the pipeline's stages."""

import html as entities
import re

import numpy as np

import corpus_pipeline
from touchmark.llm import html
from touchmark.llm.common import QUERIES, read


def plain_text(page):
    """For the test pages: what stands in the article, block by block."""
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages(spark, data):
    pages = {r["page_id"]: r for r in read(spark, data, "pages").collect()}
    rows = QUERIES["op6_html_suffix_arrays"](spark, data).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        page = pages[r["page_id"]]
        assert (r["url"], r["text"]) == (page["url"], plain_text(page["html"]))
        assert r["n_chars"] == len(r["text"])


def test_blocks():
    page = """<body><header>Top</header><div class="side-bar"><p>Menu</p></div><main><header><h1>A &amp; B</h1></header>
    <p>one <b>two</b><br>three<span class="ad">buy</span> four<p>five<div id=comments><p>Nice!</p></div></main>
    <script>if (a < b) "</p>"</script><form>name</form><footer>end</footer></body>"""
    assert html.main_text(page) == "A & B\n\none two three four\n\nfive"
    assert html.main_text("") == "" and html.main_text("plain  text") == "plain text"
    assert html.main_text("<p>a<p>b<!-- c --><nav>d") == "a\n\nb"


def test_names_of_containers():
    """Whole words name an aside, and only outside of an article; none hides the page's main text."""
    text = html.main_text
    assert text('<article><div class="entry-header"><h1>Title</h1></div><p>body</p></article>') == "Title\n\nbody"
    assert text('<article><h2 id="related-work">A</h2><p id="ad-hoc-nets">b</p></article>') == "A\n\nb"
    assert text('<article><section id="social-history">past</section></article>') == "past"
    assert text('<div class="page-with-sidebar"><p>whole page</p></div>') == "whole page"
    assert text('<div class="sidebar"><article>a</article></div>') == "a"
    assert text('<form id="aspnetForm"><div><main>a<form>b</form></main></div></form>') == "a"
    assert text('<div class="related"><article>teaser</article></div><article>a</article>') == "a"
    assert text('<nav><article>a</article></nav>') == ""
    assert text('<div class="site-header">x</div><div class="cookie-banner">y</div><p>z</p>') == "z"
    assert text('<article>a<div class="comments"><article>b</article></div></article>') == "a"


def test_broken_markup():
    """Linear in the page, whatever does not end."""
    import time

    text = html.main_text
    assert text("a <b c <i>d</i>") == "a d" and text('x <a href="y>z</a> w') == "x z w" and text("a < b & c") == "a < b & c"
    start = time.process_time()
    for part in ("<a ", "<script ", "<!", "<a '", '<a "x', "</b>", "<b>", "<div><i></div>", "&", "<p class=a ", "<li>"):
        text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 60


def test_figures():
    page = "<article><p>a</p><figure><table><tr><td>b</td></tr></table><figcaption>c</figcaption></figure>d</article>"
    assert html.main_text(page) == "a\n\nb\n\nc\n\nd"


def test_repeated_runs_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, run = int(rng.integers(5, 120)), int(rng.integers(2, 6))
        tokens = rng.integers(0, 4, n)
        tokens[rng.random(n) < 0.1] = -2
        tokens[rng.random(n) < 0.1] = -1
        tokens[-1] = -1
        page_of = np.sort(rng.integers(0, 4, n))
        expected = np.zeros(n, bool)
        ends = [next(t for t in tokens[i:] if t < 0) for i in range(n)]
        starts = [i for i in range(n - run + 1) if (tokens[i : i + run] >= 0).all()]
        for i in starts:
            same = [j for j in starts if (tokens[j : j + run] == tokens[i : i + run]).all()]
            if len({page_of[j] for j in same}) > 1 and any(ends[j] == -1 for j in same):
                expected[i : i + run] = True
        assert (html.repeated_runs(tokens.astype("int32"), page_of, run) == expected).all()


def test_boilerplate_without_markup(spark):
    """Pages that declare no main element lose the runs that other pages of the host repeat."""
    from touchmark.llm.html import Boilerplate, extract

    notice = " ".join(f"legal{k}" for k in range(30))
    pages = [
        (k, f"http://a.example/{k}", f"<p>{' '.join(f'w{k}x{i}' for i in range(40))}</p><p>{notice} page{k}</p>")
        for k in range(40)
    ]
    pages += [(100, None, f"<p>{notice}</p>"), (101, "x", None), (102, "http://a.example/", ""), (0, *pages[0][1:])]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, host int")
    for rules in (Boilerplate(), Boilerplate(array_bytes=4000)):
        rows = {r["page_id"]: r["text"] for r in extract(df, rules=rules).collect()}
        for k in range(40):
            assert rows[k] == " ".join(f"w{k}x{i}" for i in range(40)) + f"\n\npage{k}"
        assert rows[100] == notice and rows[101] == rows[102] == ""
    assert extract(df).count() == len(pages) and extract(df.limit(0)).count() == 0


def test_runs_of_a_large_host(spark):
    """A run on two pages goes however large its host, and from a page of two hosts by what each host shows."""
    from touchmark.llm.html import Boilerplate, extract

    own = [" ".join(f"w{k}x{i}" for i in range(25)) for k in range(60)]
    notes = [" ".join(f"n{k}y{i}" for i in range(22)) for k in range(30)]
    pages = [(k, "http://a.example/", f"<p>{own[k]}</p><p>{notes[k // 2]}</p>") for k in range(60)]
    pages += [(100, "http://b.example/", pages[0][2]), (101, "http://b.example/", f"<p>{own[0]} more</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (2_000_000, 1):
        rows = {r["page_id"]: r["text"] for r in extract(df, rules=Boilerplate(array_bytes=size)).collect()}
        assert [rows[k] for k in range(60)] == own
        assert (rows[100], rows[101]) == (notes[0], "more")


def test_unmarked_menus_of_short_items(spark):
    """A menu of items too short for a run goes as a whole; the word that texts share after it stays."""
    from touchmark.llm.html import Boilerplate, extract

    menu = "".join(f"<li>item {k}</li>" for k in range(15))
    own = ["The " + " ".join(f"w{k}x{i}" for i in range(25)) for k in range(12)]
    pages = [(k, "http://a.example/", f"<ul>{menu}</ul><p>{own[k]}</p><p>item 3</p>") for k in range(12)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for size in (2_000_000, 1):
        rows = {r["page_id"]: r["text"] for r in extract(df, rules=Boilerplate(array_bytes=size)).collect()}
        assert [rows[k] for k in range(12)] == [f"{text}\n\nitem 3" for text in own]


def test_pipeline(spark, data):
    docs, names = read(spark, data, "documents"), []
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        out = corpus_pipeline.stored(out, name)
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        if name != "encode":
            assert out.columns == columns
        if name in ("quality_rules", "near_dedup"):
            assert 0 < len(ids) < len(kept)
        if name in ("line_dedup", "encode"):
            assert set(ids) == kept
        docs, kept = out, set(ids)
        names.append(name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "n_tokens").collect())) == sorted(
        map(tuple, docs.select("doc_id", "n_tokens").collect())
    )


def test_pipeline_odd(spark, data, odd_docs, no_docs):
    """Null, empty, repeated and long texts, columns of clashing names, and no rows at all, through every stage."""
    good = read(spark, data, "documents").limit(30).select("doc_id", "text", "lang")
    more = good.selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "7 AS n_words", "'z' AS shard", "1.5D AS size", "'q' AS digest")
    docs, nothing = odd_docs.unionByName(more).unionByName(more.limit(1)), no_docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs, nothing = (corpus_pipeline.stored(stage(spark, d, data), name) for d in (docs, nothing))
        assert 0 < docs.count() <= before and nothing.count() == 0
        if name != "encode":
            assert docs.columns == odd_docs.columns
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded"]
