"""Keys that many classes share: candidate pairs in proportion, and no link lost, with small blocks."""

import random

import pytest

from gristmill.llm import jaccard_join


def components_of(rows):
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
    return {k: find(k) for k in sets}


def near_copies(many, seed=3, size=120):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    rows = []
    for k in range(many):
        own = list(words)
        own[rng.randrange(size)] = f"x{k}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.fixture
def candidates(monkeypatch):
    """The numbers of candidate pairs, round by round."""
    seen, plain = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: (seen.append(pairs.count()), plain(pairs, *rest))[1])
    monkeypatch.setattr(jaccard_join, "BLOCK", 32)
    return seen


def test_candidates_grow_in_proportion(spark, candidates):
    per = []
    for many in (400, 800, 1600):
        candidates.clear()
        got = {r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(near_copies(many), "doc_id long, text string")).collect()}
        assert got == {0}
        per.append(sum(candidates) / many)
    assert max(per) < 1.25 * min(per) and max(per) < 15, per


def test_blocks_lose_no_link(spark, candidates):
    """Two families that share half of their words, a bridge between members of one, loners, and a family of drifting copies."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for family in "ab":
        words = shared + [f"{family}{k}" for k in range(60)]
        for k in range(90):
            own = list(words)
            for _ in range(rng.choice([1, 2, 6, 12])):
                own[rng.randrange(120)] = f"x{family}{k}{rng.random()}"
            rows.append((len(rows), " ".join(own)))
    drift = [f"d{k}" for k in range(100)]
    for k in range(70):
        drift[rng.randrange(100)] = f"y{k}"
        rows.append((len(rows), " ".join(drift)))
    rows += [(len(rows) + k, " ".join(shared + [f"z{k}_{j}" for j in range(rng.randrange(8, 30))])) for k in range(60)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(order[k], t) for k, t in rows]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components_of(rows)


def test_own_blocks_are_never_paired(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    rows = [(1, k, 0 if k < 100 else k) for k in range(125)] + [(2, k, k) for k in range(4)] + [(3, k, k % 2) for k in range(40)]
    members = spark.createDataFrame(rows, "key long, cid long, root long")
    vectors = members.select("cid").distinct()
    dealt = jaccard_join.dealt(members, vectors).collect()
    met = {}
    for r in dealt:
        met.setdefault((r.key, r.i, r.j), []).append(r)
    pairs = {(key, *sorted((x.cid, y.cid))) for (key, i, j), some in met.items() for x in some for y in some if x.root != y.root and (i == j or x.block != y.block)}
    roots = {(key, cid): root for key, cid, root in rows}
    want = {(key, a, b) for key, a in roots for k2, b in roots if k2 == key and a < b and roots[key, a] != roots[key, b]}
    assert pairs == want
    assert sum(r.root == 0 and r.key == 1 for r in dealt) <= 3 * 100 and not any(len({r.root for r in some}) == 1 for (key, i, j), some in met.items() if key == 1 and i != j)
    chain = jaccard_join.chained(members.where("key = 1"), vectors).collect()
    assert len(chain) <= 2 * 125 and {r.j - r.i for r in chain} == {1}
