"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import base64
import gzip
import random
import time

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from gristmill.llm import edit_counts, html_text, jaccard_join, media, mixing, neighbours, packing, secrets, toxicity, url_filter
from gristmill.llm.tokens import vocabulary_path

VOCAB = vocabulary_path("word_bpe_49k.json")
LONG = "word other thing again once more " * 3000
#: size, length, host, _bin and so on clash with names that operators add.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, length int, score string, cid int, id int, host string"
ROWS = [
    (1, None, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1, 2, "x", 3, 4, "h"),
    (3, " \t\n ", "en", "a", 4, 1, 2, "x", 3, 4, "h"),
    (4, "one two", "en", None, 7, 1, 2, "x", 3, 4, "h"),
    (4, "one two", "en", None, 7, 1, 2, "x", 3, 4, "h"),
    (5, LONG, "en", "b", len(LONG), 1, 2, "x", 3, 4, "h"),
    (6, LONG.upper(), "en", "b", len(LONG), 1, 2, "x", 3, 4, "h"),
    (None, "no id at all here, password=abcdefgh1", "en", "b", 1, 1, 2, "x", 3, 4, "h"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def edits_of(docs):
    return docs.selectExpr("doc_id", "1 AS seq", "0 AS start", "2 AS end", "CAST(NULL AS STRING) AS new").where("doc_id = 4 OR doc_id IS NULL").distinct()


OPERATORS = {
    "pack": lambda d: packing.pack(packing.pieces(d, VOCAB)),
    "trees": lambda d: edit_counts.count_trees(d, VOCAB),
    "edits": lambda d: edit_counts.apply_edits(edit_counts.with_edits(edit_counts.count_trees(d, VOCAB), edits_of(d)), VOCAB),
    "keep_one": jaccard_join.keep_one,
    "media": media.store_texts,
    "secrets": secrets.find_secrets,
    "redact": secrets.redact,
    "mix": mixing.mix,
    "repeated": lambda d: mixing.repeated(mixing.mix(d)),
    "jaccard": jaccard_join.jaccard_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_table(docs, name):
    found = OPERATORS[name](docs)
    count = found.count()
    assert count >= len(ROWS) or name in ("repeated", "keep_one")
    if name not in ("pack", "repeated", "keep_one"):
        assert count == len(ROWS)
    empty = OPERATORS[name](docs.limit(0))
    assert empty.collect() == [] and empty.columns == found.columns


def test_jaccard_of_odd_rows(docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_components(docs).collect())
    assert got == [(0, 2, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 6, 5), (6, 6, 5)]


def test_mix_of_odd_rows(docs):
    for r in mixing.mix(docs).collect():
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"])


def test_redaction_keeps_rows_and_columns(docs):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.where("text LIKE '%[secret]%'").count() == 1 and out.where("text IS NULL").count() == 1


def test_toxicity_without_labels_and_with_odd_ones(spark, docs):
    some = docs.unionByName(spark.createDataFrame([(7, "you idiot, you pathetic worthless moron")], "doc_id long, text string"), allowMissingColumns=True)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(7, None), (None, 1), (7, 1), (7, 0), (99, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = {r.doc_id: r for r in toxicity.score(some, toxicity.fit(some, labels)).collect()}
        assert all(0 <= r.score <= 1 for r in got.values())
        assert got[7].predicted == 1 and got[1].predicted == got[5].predicted == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).collect() == []


def test_pages(spark):
    rows = [(1, None, None, 1), (2, "no scheme", "<p>", 1), (3, "http://A.Example.org/es/x?y", "", 1), (3, "http://A.Example.org/es/x?y", "", 1), (4, "https://b.com", "<p>a &amp;amp; b" * 3, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect())
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), *[(3, "a.example.org", "/es/x", "example.org/es/", "block")] * 2, (4, "b.com", "", None, "allow")]
    texts = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract_pages(pages).collect())
    assert texts == [(1, "", 0), (2, "", 0), (3, "", 0), (3, "", 0), (4, "\n".join(["a &amp; b"] * 3), 29)]
    assert url_filter.filter_urls(pages.limit(0)).collect() == html_text.extract_pages(pages.limit(0)).collect() == []


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [2.0, 1.0]), (23, [1.0, 0.0, 0.0]), (22, [2.0, 1.0])]
    vectors = spark.createDataFrame([(a, b, 0, 0.0) for a, b in rows], "vec_id long, embedding array<float>, v int, score double")
    got = [tuple(r) for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 22, 2.0), (0, 2, 20, 1.0), (0, 3, 21, 1.0), (20, 1, 22, 2.0), (20, 2, 0, 1.0), (20, 3, 21, 1.0)]
    assert neighbours.search(vectors.limit(0), vectors).collect() == []


def test_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    some = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, some, str(tmp_path))
        assert after.columns == docs.columns, name
        assert stage(spark, some.limit(0), str(tmp_path)).collect() == []
        some = after
    assert some.where(F.col("doc_id") == 6).count() == 0 and some.where(F.col("doc_id") == 5).count() > 0


def test_mix_stage_cuts_no_text(spark):
    rows = [(k, f"d{k} " + "w " * (5 + k % 90), "ab"[k % 2]) for k in range(600)] + [(None, "same text of null id", "c")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got, words = corpus_pipeline.mix_sources(spark, docs, "").collect(), dict.fromkeys("abc", 0)
    for r in got:
        words[r.source] += len(r.text.split())
    assert {(r.doc_id, r.text, r.source) for r in got} <= set(rows)
    assert all(abs(words[s] - target[s]) <= 48 for s in target)  # half of the longest


KEY = "password=abcdefgh1"
PLAIN = base64.b64encode(f"first line, then {KEY} and more of it after that".encode()).decode()
SQUEEZED = base64.b64encode(gzip.compress(bytes(random.Random(1).randbytes(200).hex() + KEY, "ascii"))).decode()


def wrapped(text, width, end="\n"):
    return end.join(text[k : k + width] for k in range(0, len(text), width))


@pytest.mark.parametrize(
    "run",
    [wrapped(PLAIN, 20), wrapped(SQUEEZED, 64), wrapped(SQUEEZED, 76, "\r\n    "), wrapped(SQUEEZED, 64, "\\n")]
    + [wrapped(KEY.encode().hex() * 3, 60), base64.b64encode(gzip.compress(b"one ") + gzip.compress(KEY.encode())).decode()],
)
def test_wrapped_runs_and_members(run):
    text = f"see\n\n{run} end"
    assert ("assign", 5, 5 + len(run)) in secrets.find(text)[1]


@pytest.mark.parametrize("before", ["/cb/", "id_", "a-", "x_y/"])
@pytest.mark.parametrize("run", [PLAIN, SQUEEZED, KEY.encode().hex()])
def test_glued_runs(before, run):
    (kind, a, b), *_ = [s for s in secrets.find(f"{before}{run} end")[1] if s[0] == "assign"]
    assert a <= len(before) and b >= len((before + run).rstrip("="))


def test_layers_over_the_guard(monkeypatch):
    monkeypatch.setattr(secrets, "MOST_BYTES", 1 << 17)
    for inner in (gzip.compress(b"plain words " * 50000 + KEY.encode()), gzip.compress(gzip.compress(b"a " * 200000 + KEY.encode() + b" b" * 200000))):
        run = base64.b64encode(inner).decode()
        assert ("assign", 0, len(run)) in secrets.find(run)[1]


def test_verdicts_do_not_hang_on_size(spark):
    farm = "concat('http://l', id, '.net/')"
    pages = spark.sql(f"""
        SELECT id AS page_id, 'http://bad.com/de/1' AS url, CAST(NULL AS STRING) AS html FROM range(20000) UNION ALL
        SELECT 0, 'http://worse.com/de/1', NULL UNION ALL
        SELECT id, {farm}, '<a href="http://worse.com/">' FROM range(50000)""")
    assert url_filter.filter_urls(pages).where("host LIKE '%.net' AND verdict = 'allow'").count() == 0


def test_scores_reach_all_hosts(spark):
    edges = spark.createDataFrame([("trust", f"h{k}", f"h{k + 1}", 1.0) for k in range(12)], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("h0", "trust", 1e-7), ("far", "trust", 1 - 1e-7)], "host string, kind string, mass double")
    got = {r.host: r.score for r in url_filter.propagate(seeds, edges).collect()}
    assert len(got) == 14 and all(abs(got[f"h{k}"] / got["h0"] - 0.85**k) < 1e-4 * 0.85**k for k in range(13))


def test_neighbours_beside_other_lengths(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (22, [2.0, 1.0]), (23, [1.0, 0.0, 0.0]), (40, [9.0] * 7), (24, [5.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 22, 2.0), (0, 2, 20, 1.0), (20, 1, 22, 2.0), (20, 2, 0, 1.0)]


def test_end_tags_of_deep_elements():
    deep = "<div>" * 400 + "deep<nav>menu</nav><form>ask</form>" + "</div>" * 400
    page = f"<body><div>top</div><div><article><p>before</p>{deep}<p>after</p></article></div><div>end</div></body>"
    assert own(page)[0] == "before" and " ".join(own(page)).split() == ["before", "deep", "after"]


def test_names_within_the_article():
    page = """<body><article><h2 id="related-work">Related</h2><p>one</p><section id="search-methods"><p>two</p></section>
        <div class="ad">buy</div><div class="related-posts">more</div><div role="navigation">go</div></article></body>"""
    assert html_text.extract(page, html_text.main_region(html_text.expression(html_text.parse(page)))).split() == ["Related", "one", "two"]


def own(page):
    return html_text.extract(page, None).split("\n")


@pytest.mark.parametrize("name", ["site no-sidebar", "entry-content has-comments", "post-body search-result", "wrapper with-banner"])
def test_names_of_regions_that_hold_the_text(name):
    paragraphs = ["first paragraph of the text " * 8, "second paragraph of it " * 8]
    page = f'<body><nav>go</nav><div class="{name}"><p>{paragraphs[0]}</p><p>{paragraphs[1]}</p></div><div class="sidebar">side</div></body>'
    assert own(page) == [p.strip() for p in paragraphs]
    assert own(f"<body><div class='comments'><p>{paragraphs[0]}</p></div></body>") == [paragraphs[0].strip()]  # nothing else is there


def test_deep_blocks_stay_apart():
    deep = "<div>" * 300 + "<p>one</p><p>two</p><nav>menu</nav>three<div>four</div>" + "</div>" * 300
    assert own(f"<body><article><p>before</p>{deep}<p>after</p></article></body>") == ["before", "one", "two", "three", "four", "after"]


def host_region(pages):
    wrapper = None
    for page in pages:
        new = html_text.expression(html_text.parse(page))
        wrapper = html_text.align(wrapper, new) if wrapper else new
    return html_text.main_region(wrapper)


def test_the_wrapper_tells_content_from_template():
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(2, 9) for _ in range(n))
    template = words(400)
    texts = [[words(30) for _ in range(rng.randrange(1, 5))] for _ in range(6)]
    pages = [f"<body><div class='x'><p>{template}</p></div><div class='y'><div>Read more on our site</div>{''.join(f'<p>{t}</p>' for t in own)}</div></body>" for own in texts]
    region = host_region(pages)
    for page, own_texts in zip(pages, texts, strict=True):
        assert html_text.extract(page, region).split("\n") == own_texts
        assert template in html_text.extract(page, None)  # the page alone can't tell
    assert html_text.extract(pages[0], host_region([pages[0]] * 5)).split("\n") == [template]  # copies alone: no slots, all letters weigh


def test_an_article_keeps_what_its_pages_share():
    pages = [f"<body><article><h1>Title {k}</h1><p>shared passage of all pages</p><p>{'own words ' * (20 + k)}</p></article></body>" for k in range(5)]
    region = host_region(pages)
    assert all("shared passage of all pages" in html_text.extract(p, region) for p in pages)


def test_cards_are_no_article():
    cards = "".join(f"<article><a href='/{k}'>card {k}</a></article>" for k in range(5))
    page = f"<body><div class='teasers'>{cards}</div><div id='c'><p>{'long text of the page ' * 30}</p><p>and more</p></div></body>"
    assert own(page)[-1] == "and more" and not any("card" in b for b in own(page))


def test_runs_that_repeat_are_groups():
    kids = html_text.expression(html_text.parse("<div>" + "<h2>a</h2><p>b</p>" * 3 + "<hr></div>"))[2][0][2]
    assert [(k[0], k[1]) for k in kids] == [(f"(h2{html_text.GAP}p)", "+"), ("hr", "")]
    one = html_text.expression(html_text.parse("<div><h2>a</h2><p>c</p><hr></div>"))[2][0]
    both = html_text.align(html_text.expression(html_text.parse("<div>" + "<h2>a</h2><p>b</p>" * 3 + "<hr></div>"))[2][0], one)
    assert [(k[0], k[1]) for k in both[2]] == [(f"(h2{html_text.GAP}p)", "+"), ("hr", "")]


def test_wrappers_stay_small_and_fast():
    pages = [f"<body><div id='x'>{''.join(f'<div class=c{chr(97 + (7 * k + j) % 26)}{chr(97 + k % 26)}>t{k}</div><p>q</p>' for j in range(3))}</div></body>" for k in range(200)]
    wrapper = None
    for page in pages:
        new = html_text.expression(html_text.parse(page))
        wrapper = html_text.align(wrapper, new) if wrapper else new
    assert len(wrapper[2][0][2][0][2]) <= 3 * html_text.MOST_KIDS
    a, b = (html_text.expression(html_text.parse("<div>" + "".join(f"<h2>t</h2><p>{x}</p>" + "<hr>" * (k % 7 == 0) for k in range(3000)) + "</div>")) for x in "ab")
    began = time.process_time()
    html_text.align(a, b)
    assert time.process_time() - began < 0.3


def test_a_hot_host_is_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MERGED", 2)
    rows = [(k, "http://hot.com/", f"<body><div class='t'>the same</div><div class='c'><p>{'text ' * (9 + k)}</p></div></body>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    got = {r.page_id: r.text for r in html_text.extract_pages(pages).collect()}
    assert got == {k: ("text " * (9 + k)).strip() for k in range(60)}
