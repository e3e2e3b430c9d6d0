"""Targets where rows repeat an id or a row, and the water level against clamping round by round."""

import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from gristmill.llm import mixing


def sql(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": pa.array([r[1] for r in rows], pa.string()), "text": pa.array([r[2] for r in rows], pa.string())}))
    return Counter(con.execute(mixing.OP5_SQL).fetchall())


def test_rows_that_share_an_id_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE", 300)
    rng = random.Random(1)
    rows = [(7, "a", "one")] * 1000 + [(None, "b", f"w{k} " * rng.randrange(1, 9)) for k in range(700)] + [(k, "c", "x " * (k % 5)) for k in range(900)] + [(8, "c", "two words")] * 300 + [(None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    assert Counter(tuple(r)[:5] for r in got) == sql(rows) and len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 16 for s in target), (taken, target)
    again = Counter(tuple(r)[:5] for r in mixing.mix(docs.repartition(7)).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert again == Counter(tuple(r)[:5] for r in got)


def test_rows_alike_but_for_another_column(spark):
    docs = spark.createDataFrame([(7, "a", "one two three", k) for k in range(600)] + [(8, "b", "z " * 900, 0)], "doc_id long, source string, text string, n_chars int")
    taken = sum(r.taken for r in mixing.mix(docs).where("source = 'a'").collect())
    target = mixing.mix(docs).where("source = 'a'").first().target
    assert abs(taken - target) <= 40 and target % 1800


def test_water_level_in_one_pass(spark):
    rng = random.Random(2)
    for case in range(6):
        rows = [(f"s{k}", rng.choice([0, 1, rng.randrange(1, 10 ** rng.randrange(1, 7))]), rng.choice([5, 2, 1])) for k in range(rng.randrange(1, 12))]
        total = None if case % 2 else rng.randrange(1, 5 * sum(r[1] for r in rows) + 2)
        got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame(rows, "source string, size long, weight int"), 3, total).collect()}
        left, free, clamped = sum(r[1] for r in rows) if total is None else total, {r[0]: r for r in rows if r[1]}, {r[0]: 0.0 for r in rows}
        while free:
            share = {s: left * r[2] / sum(x[2] for x in free.values()) for s, r in free.items()}
            full = {s for s, r in free.items() if share[s] >= 3 * r[1]}
            if not full:
                clamped |= share
                break
            for s in full:
                clamped[s] = 3.0 * free[s][1]
                left -= 3 * free.pop(s)[1]
        assert all(abs(got[s] - t) <= 1e-9 * max(1.0, t) for s, t in clamped.items()), rows
