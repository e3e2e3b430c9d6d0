"""The pipeline's stages and ``run`` against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

from gristmill.llm import mixing
from gristmill.llm.tokens import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """The number of each row's component of links; None for rows without words."""
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) if sets[k] else None for k in range(len(rows))]


X, Y = ("the first text of them all has words enough to be one", "another text that has nothing in common with the one before")
LONG = " ".join(f"w{k}" for k in range(200))
NEAR = LONG.replace("w7 ", "v7 ")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(3, Y), (5, X), (5, Y)], {(3, Y): 1, (5, X): 1}),
        ([(4, X), (4, X), (4, X)], {(4, X): 1}),
        ([(None, X), (7, X), (None, Y), (None, Y)], {(7, X): 1, (None, Y): 1}),
        ([(1, ""), (1, ""), (2, None), (2, " \t")], {(1, ""): 2, (2, None): 1, (2, " \t"): 1}),
        ([(9, LONG), (9, NEAR), (8, NEAR), (8, X)], {(8, NEAR): 1, (8, X): 1}),
    ],
)
def test_near_copies_with_repeated_ids(spark, rows, want):
    docs = spark.createDataFrame([(*r, f"other {k}", k) for k, r in enumerate(rows)], "doc_id long, text string, root string, digest int")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want


def test_near_copies_against_brute_force(spark):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 90]))] for _ in range(25)]
    rows = []
    for _ in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        rows.append((rng.randrange(60), " ".join(own)))
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    groups = defaultdict(list)
    for row, name in zip(rows, components(rows), strict=True):
        groups[name].append(row)
    assert len(kept) == len(groups)
    place = {row: name for name, some in groups.items() for row in some}
    assert sorted(place[k] for k in kept) == sorted(groups) and all(k[0] == min(i for i, _ in groups[place[k]]) for k in kept)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("lor", "mip", "sut", "dol", "ame") for b in ("a", "em", "or", "us", "it", "ent", "is")]
    rows, labels = [], []
    for k in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 8, 60, 400])))
        if k % 6 == 0:
            text += " you pathetic idiot, you worthless moron, shut up you stupid loser"
        if k % 5 == 0:
            text += f" password={k:08d}abc end"
        rows.append((k, text, "en", "abcdefg"[k % 7], len(text)))
        labels.append((k, int(k % 6 == 0)))
    rows += [(300 + k, rows[k][1] + " and one more", "en", "h", 5) for k in range(40)] + [(400 + k, rows[k][1], "en", "h", 5) for k in range(20)]
    rows += [(500, None, "en", "a", None), (501, "", "en", None, 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_run_against_plain_python(spark, corpus):
    from tokenizers import Tokenizer

    path, rows = corpus
    clean = [r for r in rows if "idiot" not in (r[1] or "")]
    groups = defaultdict(list)
    for row, name in zip(clean, components(clean), strict=True):
        groups[row[0] if name is None else f"c{name}"].append(row)
    kept = [min(some, key=lambda r: r[0]) for some in groups.values()]
    masked = {r[0]: re.sub(r"password=[0-9]{8}abc", "[secret]", r[1] or "") for r in kept}
    source, size = {r[0]: r[3] for r in kept}, {k: len(WORD.findall(t)) for k, t in masked.items()}

    sizes = Counter()
    for k, s in source.items():
        sizes[s] += size[k]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, free, target = sum(sizes.values()), {s for s in sizes if sizes[s]}, dict.fromkeys(sizes, 0.0)
    while over := [s for s in free if weight[s] * left / sum(weight[x] for x in free) > 3 * sizes[s]]:
        for s in over:
            target[s], left = 3 * sizes[s], left - 3 * sizes[s]
            free.remove(s)
    target |= {s: weight[s] * left / sum(weight[x] for x in free) for s in free}

    tokenizer, copies, bins = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), Counter(), defaultdict(list)
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in masked.items()}
    for r in corpus_pipeline.run(spark, path).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        copies[r.doc_id] += r.piece == 0
        bins[r.sequence_id].append((r.offset, r.length))
    for s in sizes:
        own = [k for k in source if source[k] == s]
        most = max(size[k] for k in own)
        assert abs(sum(copies[k] * size[k] for k in own) - target[s]) <= most / 2 + 1
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        assert all(copies[k] in (whole, whole + 1) for k in own if size[k]) and not any(copies[k] for k in own if not size[k])
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(n for some in bins.values() for _, n in some) // 2048) + 4


def test_run_on_empty_tables(spark, corpus, tmp_path):
    path, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mix_of_the_given_documents_is_whole(spark):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert all(r.text == rows[r.doc_id] for r in mixing.mixed_whole(docs).collect())
