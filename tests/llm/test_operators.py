"""Each operator against brute force, SQL, an exact round trip or held-out labels, on the smallest tables."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import edit_counts, html_text, jaccard_join, media, mixing, neighbours, packing, registry, secrets, toxicity, url_filter
from gristmill.llm.tokens import ChunkEncoder, vocabulary_path

VOCAB = vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def table():
    return lambda name: pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


def run(spark, name):
    return [r.asDict() for r in next(f for k, f in registry.QUERIES.items() if k.startswith(name))(spark, SMALL).collect()]


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    out = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(out.fetchall()) == sorted(tuple(r[n] for n in names) for r in run(spark, name))


def test_rules(spark, table):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    urls = {r["page_id"]: r["url"] for r in table("pages")}
    for r in run(spark, "op1_"):
        rest = urls[r["page_id"]].split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fits = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (rule is None or r["verdict"] == rules[rule])


def test_propagation_is_pagerank(spark):
    rng = random.Random(1)
    hosts = [f"h{k}" for k in range(8)]
    links = {(rng.choice(hosts), rng.choice(hosts)) for _ in range(20)}
    links = {(a, b) for a, b in links if a != b}
    out = defaultdict(list)
    for a, b in links:
        out[a].append(b)
    edges = spark.createDataFrame([("trust", a, b, 1 / len(out[a])) for a, b in links], "kind string, src string, dst string, share double")
    seeds = {"h0": 0.5, "h1": 0.5}
    got = {r.host: r.score for r in url_filter.propagate(spark.createDataFrame([(h, "trust", m) for h, m in seeds.items()], "host string, kind string, mass double"), edges).collect()}
    score = dict(seeds)
    for _ in range(200):
        new = defaultdict(float)
        for a, some in out.items():
            for b in some:
                new[b] += 0.85 * score.get(a, 0) / len(some)
        rest = 1 - sum(new.values())
        for h, m in seeds.items():
            new[h] += rest * m
        score = new
    assert all(abs(got.get(h, 0) - score.get(h, 0)) < 1e-4 for h in hosts) and abs(sum(got.values()) - 1) < 1e-6


def test_distrust_flows_back(spark):
    rows = [(1, "http://bad.com/de/1", None), (2, "http://linker.net/x", '<a href="http://bad.com/de/1">'), (3, "http://fr.com/fr/1", '<a href="//good.net/">'), (4, "http://good.net/a", None)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_toxicity_held_out(spark, table):
    labels = {r["doc_id"]: r["toxic"] for r in table("labels")}
    rows = [r for r in run(spark, "op2_") if r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.93


def test_toxicity_on_held_out_rows_alone(spark):
    mid = SMALL.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{mid}/labels.parquet").to_pylist()}
    rows = [r for r in toxicity.op2_toxicity(spark, mid).collect() if r.held_out and r.doc_id in labels]
    toxic, clean = ([r.predicted for r in rows if labels[r.doc_id] == k] for k in (1, 0))
    assert len(toxic) > 5 and sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_label_model_is_expectation_maximisation():
    rng = np.random.default_rng(1)
    labels = (rng.random(300) < 0.3).astype(float)
    votes = (rng.random((300, 4)) < np.where(labels[:, None] > 0, [0.7, 0.5, 0.9, 0.2], [0.05, 0.1, 0.02, 0.2])).astype(float)
    votes[:, 3] = votes[:, 0]  # says the same as the first
    model, posterior = toxicity.fit_label_model(votes, labels, rounds=6)
    every, q = [[*v, y] for v, y in zip(votes.tolist(), labels.tolist(), strict=True)], [0.02 + 0.96 * y for y in labels]
    for _ in range(6):
        rates, weight = [[0.0] * 5 for _ in range(2)], []
        for c in (0, 1):
            share = [p if c else 1 - p for p in q]
            for j in range(5):
                believed = (0.02, 0.9)[c] if j == 4 else (0.01, 0.3)[c]
                rates[c][j] = min(1 - 1e-4, max(1e-4, (sum(s * v[j] for s, v in zip(share, every, strict=True)) + 4 * believed) / (sum(share) + 4)))
        prior = (sum(q) + 1) / (len(q) + 10)
        for i in range(5):
            total = 1.0
            for j in range(4):
                worst = 0.0
                for c in (0, 1):
                    share = [p if c else 1 - p for p in q]
                    cov = lambda a, b: sum(s * (v[a] - rates[c][a]) * (v[b] - rates[c][b]) for s, v in zip(share, every, strict=True)) / max(1.0, sum(share))  # noqa: B023, E731
                    worst = max(worst, cov(i, j) / max(cov(i, i), 1e-6) ** 0.5 / max(cov(j, j), 1e-6) ** 0.5)
                total += worst if i != j and i < 4 and worst > 0.1 else 0
            weight.append(1 / total)
        q = []
        for v in every:
            odds = np.log(prior / (1 - prior))
            for j in range(5):
                odds += weight[j] * (np.log(rates[1][j] / rates[0][j]) if v[j] else np.log((1 - rates[1][j]) / (1 - rates[0][j])))
            q.append(1 / (1 + np.exp(-odds)))
    assert np.allclose(posterior, q, atol=1e-6) and model.weight[0] < 0.7 and model.weight[3] < 0.7


def test_words_score_what_no_voter_sees():
    model, posterior = toxicity.fit_label_model(np.zeros((200, 3)), np.tile([0.0, 1.0], 100))
    words = [np.array([7, 8, 9 + k % 2], np.uint16) for k in range(200)]
    fitted = toxicity.fit_classifier(np.zeros((200, 3), np.float32), words, posterior, model)
    clean, toxic = fitted.score([(np.zeros(3, np.float32), np.array(w, np.uint16)) for w in ([7, 8, 9], [7, 8, 10])])
    assert clean < 0.2 and toxic > 0.8


def test_rows_that_repeat_an_id_are_bounded_without_bias(spark):
    rows = [(k, f"text number {k}, version {j}" + ", you idiot, you worthless moron" * (k % 2)) for k in range(60) for j in range(4)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels, most=60))
    assert got.where("(predicted = 1) <> (doc_id % 2 = 1)").count() == 0


def test_stems_are_mined(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeiorst") for _ in range(7))
    rows = [(k, " ".join([word() for _ in range(30)] + [f"zorg{word()}"] * (k % 4 == 0)), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs.where("doc_id < 300"), docs.select("doc_id", "toxic"))).collect()}
    assert sum(got[k] == t for k, _, t in rows[300:]) >= 98


def test_article_text(spark, table):
    import html

    pages = {r["page_id"]: r["html"] for r in table("pages")}
    for r in run(spark, "op3_"):
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_wrapper_aligns_optional_and_repeated():
    one, two = (html_text.expression(html_text.parse(p)) for p in ("<div><h2>a</h2><p>x<p>y</div>", "<div><p>z</p><span>t</span></div><hr>"))
    both = html_text.align(one, two)
    div = next(k for k in both[2] if k[0] == "div")
    assert [(k[0], k[1]) for k in div[2]] == [("h2", "?"), ("p", "+"), ("#", "?")] and ("hr", "?") in [(k[0], k[1]) for k in both[2]]


def test_page_without_article():
    page = '<body><header>top</header><nav>menu</nav><div class="sidebar">s</div><div id="x"><h2>T</h2><p>%s</p><p>more <b>bold</b></p><div class="comments">c</div></div><footer>f</footer>' % ("long text " * 30)
    assert html_text.extract(page, []).split("\n")[0] == "T" and html_text.extract(page, []).endswith("more bold")


def test_packing_is_whole_and_tight(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCAB)
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    rows, bins, own = run(spark, "op4_"), defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(own[doc_id], key=lambda r: r["piece"])):
            part = ids[r["start"] : r["start"] + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, 2048 * k, zlib.crc32(part.tobytes()))
        assert sum(r["length"] for r in own[doc_id]) == len(ids)
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_small_windows_and_few_bins(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k, rng.choice([3, 700, 1100, 1500, 2048, rng.randrange(1, 2049)])) for k in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "name long, length long"), open_bins=64, window=200)
    assert sorted((r.name, r.length) for r in got.collect()) == rows
    filled = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("rows"))
    assert filled.where("n <> end OR n > 2048 OR places <> rows").count() == 0
    free = packing.BestFit(2048, 10**9)
    assert filled.count() <= 1.03 * len({free.place(n)[0] for _, n in sorted(rows, key=lambda r: -r[1])})


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (7, 6, 3, 8, 4, 10)] == [(0, 0), (1, 0), (0, 7), (2, 0), (1, 6), (3, 0)]
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (9, 6, 5, 1, 4)] == [(0, 0), (1, 0), (2, 0), (1, 6), (2, 5)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_chunks_are_exact(text):
    coder = ENCODERS.setdefault("one", ChunkEncoder(VOCAB))
    whole = np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert coder.encode(text) == whole == next(coder.encode_batch([text])).astype("<u4").tobytes()


ENCODERS: dict = {}


def test_small_cache_is_exact(table):
    small, large = ChunkEncoder(VOCAB, most=50), ChunkEncoder(VOCAB)
    for r in table("documents")[:40]:
        assert small.encode(r["text"]) == large.encode(r["text"])


def test_mix_meets_targets(spark, table):
    source = {r["doc_id"]: r["source"] for r in table("documents")}
    taken, target = defaultdict(int), {}
    for r in run(spark, "op5_"):
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 20 for s in target)


def test_water_fill(spark):
    sizes = spark.createDataFrame([("a", 10, 5), ("b", 100, 2), ("c", 1000, 1), ("d", 0, 5), ("e", 5, 2)], "source string, size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    assert got["a"] == 30 and got["d"] == 0 and got["e"] == 15 and got["b"] == 300 and abs(sum(got.values()) - 1115) < 1e-9


def test_repeated_mix_has_what_was_taken(spark, table):
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in table("documents")], "doc_id long, text string, source string")
    want = {r["doc_id"]: r["taken"] for r in run(spark, "op5_")}
    got = defaultdict(int)
    for r in mixing.repeated(mixing.mix(docs)).collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_media_round_trip(spark, table):
    texts = {r["doc_id"]: r["text"].encode() for r in table("documents")}
    for r in run(spark, "op6_"):
        data = texts[r["doc_id"]]
        payload = data + bytes(-len(data) % 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.write_track(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_tables_and_damage():
    payload = bytes(range(256)) * 300
    data = media.write_track(payload, chunk=50)
    (track,) = media.describe(data)
    assert media.read_payload(data, track) == payload and track.codec == "raw" and track.seconds == len(payload) / 8000
    assert [data[a:b] for a, b in track.ranges(track.keys)] == [payload[k : k + 64] for k in range(0, len(payload), 64 * 16)]
    for cut in range(0, 900, 7):
        media.describe(data[:cut])
    assert media.describe(b"not a file at all") == []


def test_edits_count_as_a_new_text(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCAB)
    docs, got = {r["doc_id"]: r for r in table("documents")}, {r["doc_id"]: r for r in run(spark, "op7_")}
    assert set(docs) == set(got)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    again = whole = 0
    for k, d in docs.items():
        text, source, lang = d["text"], d["source"], d["lang"]
        n, first = count(text), text[:16]
        for step in range(4):
            size, eighth = len(text), len(d["text"]) // 8
            a, b, new = [(size // 2, size // 2, f"{source}'s"), (eighth, eighth + eighth // 2, ""), (max(0, size - 16), size, first), (0, 0, f"{lang}\n")][step]
            text = text[:a] + new + text[b:]
        assert (got[k]["n_tokens"], got[k]["n_tokens_edited"], got[k]["n_chars_edited"]) == (n, count(text), len(text))
        assert sum(x["chars"] for x in got[k]["tree"]) == len(text) and sum(x["tokens"] for x in got[k]["tree"]) == count(text)
        at = 0
        for x in got[k]["tree"]:
            assert count(text[at : at + x["chars"]]) == x["tokens"]
            at += x["chars"]
        again, whole = again + got[k]["encoded_again"], whole + len(text)
    assert again < whole / 2


def test_stored_trees_take_a_table_of_edits(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(VOCAB), random.Random(4)
    count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = {k: " ".join(f"word{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 900]))) for k in range(6)}
    trees = edit_counts.count_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), VOCAB)
    for _ in range(2):  # the edited trees are stored again
        edits = [(k, s, rng.randrange(400), rng.randrange(500), rng.choice(["", "new words", "x" * 30])) for k in texts for s in range(5) if k != 2]
        rng.shuffle(edits)
        trees = edit_counts.apply_edits(edit_counts.with_edits(trees, spark.createDataFrame(edits, "doc_id long, seq int, start int, end int, new string")), VOCAB)
        for k, _, a, b, new in sorted(edits, key=lambda e: e[:2]):
            a = min(a, len(texts[k]))
            texts[k] = texts[k][:a] + new + texts[k][max(a, min(b, len(texts[k]))) :]
        got = {r.doc_id: r for r in trees.collect()}
        assert {k: (r.text, r.n_tokens_edited, sum(x.tokens for x in r.tree)) for k, r in got.items()} == {k: (t, count(t), count(t)) for k, t in texts.items()}


def test_slots_split_and_edits_encode_little():
    coder, text = ENCODERS.setdefault("one", ChunkEncoder(VOCAB)), "some words of a text " * 400
    leaf = edit_counts.leaves(text)
    tree = edit_counts.CountTree(leaf, [coder.count(p) for p in leaf], coder.count)
    for k in range(300):
        tree.edit(4000, 4000, f"inserted words number {k} of many, ")
        text = text[:4000] + f"inserted words number {k} of many, " + text[4000:]
    assert tree.text() == text and tree.total == coder.count(text) and max(map(len, tree.leaf)) <= 2 * edit_counts.LEAF
    assert tree.encoded < 6 * 300 * 40


@settings(max_examples=80, deadline=None)
@given(st.text("ab.' \n", max_size=80), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.text("ab.' ", max_size=6)), max_size=6))
def test_any_edits(text, edits):
    coder = ENCODERS.setdefault("one", ChunkEncoder(VOCAB))
    leaf = edit_counts.leaves(text, 5) or [""]
    tree = edit_counts.CountTree(leaf, [coder.count(p) for p in leaf], coder.count, 5)
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(a, len(text))
        text = text[:a] + new + text[max(a, min(b, len(text))) :]
        assert tree.text() == text and tree.total == coder.count(text)


def test_neighbours_recall(spark, table):
    rows = table("embeddings")
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = defaultdict(list)
    for r in sorted(run(spark, "op8_"), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[k]
        score[k] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        found = got[ids[k]]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - vectors[np.flatnonzero(ids == i)[0]] @ vectors[k]) < 1e-9 for i, s in found)
        hit += len(best & {i for i, _ in found})
    assert hit >= 0.9 * 20 * len(got)


def test_probes_come_in_order_of_success():
    rng = np.random.default_rng(3)
    index = neighbours.Index(rng.standard_normal((1, 3, 65)), np.zeros((1, 3)), 0.8, 2, 1.0, 0.8, 0.9)
    query = rng.standard_normal(65)
    query /= np.linalg.norm(query)
    order, sums = index.successes(query, 0)
    # neighbours at that nearness, drawn
    off = rng.standard_normal((50000, 65))
    off -= (off @ query)[:, None] * query
    near = 0.8 * query + 0.6 * off / np.linalg.norm(off, axis=1)[:, None]
    seen = np.bincount(index.bucket(near, 0), minlength=index.buckets)[order] / len(near)
    assert abs(seen.cumsum() - sums).max() < 0.03 and sorted(order.tolist()) == list(range(64)) and (np.diff(sums, n=2) < 1e-12).all()
    probes = index.probes(query, 0)
    assert probes.tolist() == order[: len(probes)].tolist() and seen[: len(probes)].sum() > 0.8


@pytest.mark.parametrize("clusters", [0, 40])
def test_neighbours_prune_where_data_cluster(spark, clusters):
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((6000, 24))
    if clusters:
        vectors = 4 * rng.standard_normal((clusters, 24))[rng.integers(0, clusters, 6000)] + vectors
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    index = neighbours.fit(rows.selectExpr("vec_id AS id", "embedding AS v"), 20, 300)
    assert index.share < (0.2 if clusters else 1.01)
    got = defaultdict(set)
    for r in neighbours.search(rows, rows.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    scores = vectors[::20] @ vectors.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argpartition(-scores, 19, axis=1)[:, :20]
    assert np.mean([len(got[20 * k] & set(b.tolist())) / 20 for k, b in enumerate(best)]) > 0.9


def test_queries_that_find_too_few_visit_all(spark):
    rng = np.random.default_rng(9)
    vectors = np.concatenate((rng.standard_normal((3000, 8)), [[1e6] * 8]))  # beside it all others look alike
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = neighbours.search(rows, rows.where("vec_id % 20 = 0")).groupBy("query_id").count().collect()
    assert len(got) == 151 and all(r["count"] == 20 for r in got)


def test_compared_keeps_ties_and_rounds():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    v, codes = rng.integers(-2, 3, (900, 4)).astype(float), rng.integers(0, 6, 900)
    index = pa.table({"code": pa.array(codes, pa.int32()), "class": pa.array(rng.permutation(900)), "v": v.tolist()})
    visits = [sorted(rng.choice(6, 3, replace=False).tolist()) for _ in range(50)]
    q = rng.integers(-2, 3, (50, 4)).astype(float)
    probes = pa.table({"codes": pa.array(visits, pa.list_(pa.int32())), "query": pa.array(range(50)), "v": q.tolist()})
    names, want = index.column("class").to_numpy(), set()
    for k in range(50):
        there = np.isin(codes, visits[k])
        score = v[there] @ q[k]
        order = np.lexsort((names[there], -score))[:7]
        want |= {(k, int(names[there][j]), float(score[j])) for j in order}
    assert {tuple(r.values()) for r in neighbours.compared(index, probes, 7).to_pylist()} == want


def test_base_spans(spark, table):
    for r in table("documents"):
        text = r["text"]
        want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        assert secrets.scan(text) == [(secrets.KINDS[k], a, b) for a, k, b in sorted(want)]


SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize(
    "hidden",
    [
        SECRET.replace(" ", "%20").replace("=", "%3D"),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        base64.b64encode(SECRET.encode()).decode(),
        base64.urlsafe_b64encode(gzip.compress(SECRET.encode())).decode().rstrip("="),
        base64.b64encode(base64.b64encode(zlib.compress(SECRET.encode()))).decode(),
        base64.b64encode(SECRET.replace("=", "%253D").encode()).decode(),
        SECRET.encode().hex(),
        SECRET.replace("=", "&#61;"),
    ],
)
def test_layers(hidden):
    text = f"é before {hidden} after"
    base, spans = secrets.find(text)
    at = text.index(hidden)
    assert any(k == "assign" and at <= a < b <= at + len(hidden) + 1 for k, a, b in spans), spans
    assert set(base) <= set(spans)


def test_layers_end():
    loop = "%2525" * 50 + base64.b64encode(b"%25" * 40).decode()
    assert secrets.find(loop)[0] == []


def test_candidates_lose_no_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        first = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 400)), dtype=np.int64).astype(np.uint64))
        for _ in range(10):
            drop = rng.random(len(first)) > rng.choice([0.02, 0.08, 0.12])
            sets.append(np.unique(np.concatenate((first[drop], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(first) // 10)), dtype=np.int64).astype(np.uint64)))))
    sizes = np.array([len(s) for s in sets])
    vectors = [jaccard_join.vector_of(jaccard_join.count_vector(s), len(s)) for s in sets]
    pairs, more = jaccard_join.proposals(np.arange(len(sets)), np.arange(len(sets)), sizes, vectors, 10**6)
    none = np.zeros(1 << (jaccard_join.FREQUENT_BITS - 3), np.uint8)
    linked = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if 5 * common >= 4 * (sizes[a] + sizes[b] - common):
                linked += 1
                assert (a, b) in pairs
                assert len(np.intersect1d(jaccard_join.prefix(sets[a], none), jaccard_join.prefix(sets[b], none)))
    assert linked > 50 and not more


def test_partners_are_kept():
    rng = np.random.default_rng(0)
    for _ in range(60):
        m = int(rng.integers(2, 300))
        keys, sizes = np.sort(rng.integers(0, 6, m)), rng.integers(20, rng.choice([25, 200, 2000]), m)
        order = np.lexsort((sizes, keys))
        keys, sizes = keys[order], sizes[order]
        places = (rng.random(m) * sizes * 0.2).astype(int)
        kept = jaccard_join.partnered(keys, sizes, places)
        for i in range(m):
            j = np.flatnonzero((keys == keys[i]) & (np.arange(m) != i) & (5 * sizes >= 4 * sizes[i]) & (4 * sizes <= 5 * sizes[i]))
            assert kept[i] or not (9 * np.minimum(sizes[i] - places[i], sizes[j] - places[j]) >= 4 * (sizes[i] + sizes[j])).any()


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(words))]
    for k in range(1, 150):
        own = list(words)
        for _ in range(rng.choice([1, 1, 2, 9])):
            own[rng.randrange(120)] = f"x{k}{rng.random()}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in rows for w in [t.split()]}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {k: find(k) for k in sets}


def test_a_batch_has_its_query_vectors_once():
    import pyarrow as pa

    rng = np.random.default_rng(6)
    kinds = pa.schema([*((k, pa.int32()) for k in neighbours.KEY), ("code", pa.int32()), ("codes", pa.list_(pa.int32())), ("id", pa.int64()), ("v", pa.list_(pa.float64()))])
    rows, want = [], set()
    for s in range(2):
        queries = {100 * s + q: rng.standard_normal(3).tolist() for q in range(7)}
        for b in range(2):
            rows += [(s, b, -1, -1, -1, 0, None, None, q, v) for q, v in queries.items()]
            for g in range(3):
                own = {1000 + 100 * g + c: (c % 4, rng.standard_normal(3).tolist()) for c in range(20)}
                visits = {q: sorted(rng.choice(4, 2, replace=False).tolist()) for q in queries if q % 3 != g or g == 0}
                rows += [(s, b, 0, g, 0, 1, None, codes, q, None) for q, codes in visits.items()] if g < 2 else []
                rows += [(s, b, 0, g, 0, 2, code, None, c, v) for c, (code, v) in own.items()]
                for q, codes in visits.items() if g < 2 else ():
                    best = sorted(((-float((np.array(queries[q]) * np.array(v)).sum()), c) for c, (code, v) in own.items() if code in codes))[:4]
                    want |= {(q, c, round(-score, 9)) for score, c in best}
    table = pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds)
    for size in (1, 5, 1000):
        got = [(r["query"], r["class"], round(r["score"], 9)) for out in neighbours.streamed(iter(table.to_batches(max_chunksize=size)), 4) for r in out.to_pylist()]
        assert set(got) == want
