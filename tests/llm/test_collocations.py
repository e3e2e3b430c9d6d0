"""Collocations against counting every phrase in plain Python; the parse against the texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gristmill.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, most=2000, percent=100):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        inside = {p[i:j] for p, b in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * b >= percent * f[p[i:j]]}
        scored = []
        for p, a in some.items():
            if p not in inside:
                score, _, l, r = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def texts(seed, many):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "über", "zz", "a'b", "x" * 9, "\x00", " ", "w1"]
    passage = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(3)]
    rows = []
    for _ in range(many):
        parts = [rng.choice(words + [".", "\n", "\t", ", ", "!?", "\x0b", "\x1c"]) if rng.random() < 0.9 else rng.choice(passage) for _ in range(rng.randrange(0, 60))]
        rows.append((rng.choice(["en", "de", None, "und", ""]), rng.choice([" ", "  ", " \t"]).join(parts)))
    return [*rows, ("en", None), (None, ""), ("en", " . \n"), ("en", "again " * 3000)]


@pytest.mark.parametrize(("period", "least", "longest", "most", "percent"), [(16, 4, 5, 2000, 100), (3, 4, 5, 7, 100), (1, 6, 3, 2000, 80), (4, 9, 2, 5, 100)])
def test_against_counting_all(spark, period, least, longest, most, percent):
    rows = texts(period, 150)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, n int, phrase string").repartition(3)
    got = collocations.collocations(docs, least, longest, most, percent, period)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(map(tuple, got.collect()))
    assert found == brute(rows, least, longest, most, percent) and found


def test_counts_past_64_bits_and_empty(spark):
    docs = spark.createDataFrame([("en", None)], "lang string, text string")
    assert collocations.collocations(docs).collect() == collocations.collocations(docs.limit(0)).collect() == []
    # a n and l r of their own: 1000 * 3e12 * 4e12 passes 64 bits, and so does the product of the parts
    (row,) = spark.sql("SELECT 3000000000000L AS a, 4000000000000L AS n, 3500000000000L AS l, 3600000000000L AS r").selectExpr(
        "CAST((CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(38,0)) * CAST(n AS decimal(38,0))) div (CAST(l AS decimal(38,0)) * CAST(r AS decimal(38,0))) AS long) AS s"
    ).collect()
    assert row.s == 1000 * 3 * 4 * 10**24 // (35 * 36 * 10**22)


def test_parse_covers_each_word_once(spark):
    rows = texts(8, 60)
    parse = collocations.chunks_of(spark.createDataFrame(rows, "lang string, text string"), 4, 5).collect()
    words = Counter()
    for r in parse:
        tokens = r.chunk.split(" ")
        assert r.own <= len(tokens) <= r.own + 4 and collocations.BREAK not in tokens[r.own :]
        words.update((r.lang, w) for w in tokens[: r.own] if w != collocations.BREAK)
    want = Counter((lang if lang is not None else "und", w) for lang, text in rows for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", (text or "").translate(LOW)))
    assert words == want and len({(r.lang, r.own, r.chunk) for r in parse}) < len(parse)


def test_equal_passages_have_equal_chunks(spark):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    rows = [("en", " ".join(f"v{k}{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) + " " + passage + f" end{k}") for k in range(40)]
    many = Counter((r.own, r.chunk) for r in collocations.chunks_of(spark.createDataFrame(rows, "lang string, text string"), 4).collect())
    shared = sum(own for (own, _), n in many.items() if n == 40)
    assert shared > 120


def test_bits_let_every_frequent_hash_through(spark):
    langs, words = ["en"] * 3000 + ["de"] * 2000, [f"w{k}" for k in range(3000)] + [f"v{k}" for k in range(2000)]
    own = collocations.word_hashes(langs, words)
    table = collocations.hashed(spark.createDataFrame(list(zip(langs, words, strict=True)), "lang string, phrase string"))
    assert sorted(r.h for r in table.collect()) == sorted(own.view(np.int64).tolist())
    bits = collocations.bit_table(table)
    assert collocations.marked(bits, own).all() and len(bits) == 1 << collocations.BITS - 3 and 4900 < np.unpackbits(bits).sum() <= 5000
    assert collocations.marked(bits, collocations.word_hashes(["fr"] * 3000, words[:3000])).mean() < 0.01
    assert collocations.marked(bits, np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)).sum() == 0
    ends = collocations.bit_table(spark.createDataFrame([(0,), (-1,), (-(1 << 63),)], "h long"))
    assert collocations.marked(ends, np.array([0, (1 << 64) - 1, 1 << 63], np.uint64)).all()
