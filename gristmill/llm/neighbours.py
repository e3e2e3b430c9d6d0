"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a vector by floor((a . x + b) / w) for a few Gaussian directions a; cells are joined at both ends, so that
wide ones leave two a direction. A query visits its bucket and perturbed ones in the order of their estimated success:
the chance that a neighbour at the sample's nearness falls there. How many functions and tables there are, and which
success ends a query's probes, is what compares the fewest rows on a sample at the recall asked for.

Buckets are dealt into groups of neighbouring numbers and groups with many rows into parts, so that a hot bucket is many
tasks' work; queries are dealt into slices, and a slice's parts into ``BATCHES`` at most. A batch has its slice's query
vectors once, for all its parts, and each query's bucket numbers beside them; then the parts' rows stream by, one part in
memory at a time. A bucket's rows are compared with the queries that visit it alone, and each query's best are merged over
all parts and have exact scores. Queries that find fewer than they ask for visit all buckets. Equal vectors are indexed
once, with the least ids they need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import by_batch, map_batches, written

#: Rows of a part of a group of buckets and queries of a slice, about; batches of a slice at most, each of which has the
#: slice's query vectors; rows and queries that the fit samples at most.
PART_ROWS, SLICE_QUERIES, BATCHES = 16_384, 32_768, 64
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 128
#: Functions and tables that the fit tries, and rows of a bucket from which more functions are tried.
FUNCTIONS, TABLES, BUCKET_ROWS = (2, 4, 6, 8, 10, 12, 14), (1, 2, 4), 16
#: What a probe costs, and a row that is shipped and sorted for one more table, in comparisons; pairs that a task holds
#: before it keeps the best.
PROBE_COST, COPY_COST, HELD_PAIRS = 4, 250, 1_000_000


@dataclass(frozen=True)
class Index:
    """directions (tables, functions, dim + 1), offsets (tables, functions), width w, cells kept on each side of 0, the
    greatest norm, a neighbour's nearness (the cosine of lifted vectors), the success that each table's probes have to
    reach, and the sample's share of rows compared over all tables."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    reach: int
    norm: float
    nearness: float
    target: float
    share: float = 1.0

    @property
    def buckets(self) -> int:
        return (2 * self.reach) ** self.directions.shape[1]

    def lifted(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """With one coordinate more, so that the nearest are those of the largest inner product. All have norm 1."""
        if query:
            norms = np.sqrt((vectors * vectors).sum(1))
            return np.concatenate((vectors / norms[:, None], np.zeros((len(vectors), 1))), 1)
        vectors = vectors / self.norm
        return np.concatenate((vectors, np.sqrt(np.maximum(0, 1 - (vectors * vectors).sum(1)))[:, None]), 1)

    def bucket(self, points: np.ndarray, table: int) -> np.ndarray:
        """The number of each row's bucket; the outermost cells hold all beyond them."""
        cells = np.floor((points @ self.directions[table].T + self.offsets[table]) / self.width).astype(np.int64)
        cells = np.clip(cells, -self.reach, self.reach - 1) + self.reach
        return cells @ (2 * self.reach) ** np.arange(cells.shape[1])

    def successes(self, point: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """All buckets in the order of their estimated success for a lifted query, and the sums of success so far.

        A neighbour is nearness times the query plus an orthogonal part of any direction, so that its place along a
        function's direction is about normal around nearness times the query's place."""
        edges = np.arange(-self.reach, self.reach + 1) * self.width
        place = self.directions[table] @ point
        across = np.sqrt(np.maximum((self.directions[table] ** 2).sum(1) - place**2, 1e-12) / max(1, len(point) - 1))
        spread = math.sqrt(2 * max(1 - self.nearness**2, 1e-12)) * across
        z = (edges[None, 1:-1] - self.offsets[table][:, None] - self.nearness * place[:, None]) / spread[:, None]
        below = np.array([[0.0, *(0.5 * math.erfc(-v) for v in row), 1.0] for row in z.tolist()])
        chance = np.diff(below, axis=1)  # (functions, cells)
        joint = chance[0]
        for row in chance[1:]:
            joint = (row[:, None] * joint[None, :]).ravel()  # later functions are the higher digits, as in bucket()
        order = np.argsort(-joint, kind="stable")
        return order, np.cumsum(joint[order])

    def probes(self, point: np.ndarray, table: int) -> np.ndarray:
        """The buckets that a lifted query visits, in order."""
        order, sums = self.successes(point, table)
        return order if self.target >= 1 else order[: int(np.searchsorted(sums, self.target)) + 1]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, v): rows whose vector isn't null or zero and has no null or non-finite component."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0)).where(finite & F.exists("v", lambda x: x != 0))


def vectors_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def fit(classes: DataFrame, k: int, asked: float, recall: float = 0.95, seed: int = 7) -> Index | None:
    """For vectors of one length. Directions by seed; the rest by a sample of SAMPLE_ROWS rows at most, by a hash of the
    id, of which SAMPLE_QUERIES are queries: the functions, tables and target with which the sample's queries find
    ``recall`` of their nearest at the least cost in rows compared, probes, and rows shipped, where ``asked`` tells how many
    queries there are. Where no choice is better than to compare all, all are compared."""
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    n, norm = classes.agg(F.count("*"), F.max(size)).first()
    if not n:
        return None
    sample = vectors_of(classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks())
    rng = np.random.default_rng(seed)
    dim, most, width = sample.shape[1], FUNCTIONS[-1], 8.0
    directions = rng.standard_normal((TABLES[-1], most, dim + 1))
    offsets = rng.uniform(-0.1, 0.1, (TABLES[-1], most))
    every = Index(directions[:1, :1], offsets[:1, :1], width, 1, norm, 0.0, 1.0)
    points, queries = every.lifted(sample, False), every.lifted(sample[:SAMPLE_QUERIES], True)
    cosines = queries @ points.T
    cosines[np.arange(len(queries)), np.arange(len(queries))] = -2  # the query itself
    near = max(1, round(k * len(sample) / n))  # as many of the sample as k of all
    if len(sample) <= near:
        return every
    nearest = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
    nearness = float(np.clip(np.median(np.take_along_axis(cosines, nearest, 1).min(1)), 0, 0.999))
    copies = COPY_COST * n / max(1.0, asked)  # a query's share of a table's rows
    best, cost = every, n + copies
    for functions in FUNCTIONS:
        if n / 2**functions < BUCKET_ROWS:
            break
        plain = Index(directions[:, :functions], offsets[:, :functions], width, 1, norm, nearness, 1.0)
        needed, counts = [], []  # the success at which a table's probes of a query have come to a row, and probes by success
        for t in range(TABLES[-1]):
            codes, rows = plain.bucket(points, t), np.empty((len(queries), len(points)), np.float32)
            counts.append([])
            for q, point in enumerate(queries):
                order, sums = plain.successes(point, t)
                before = np.empty(len(order), np.float32)
                before[order] = sums - np.diff(sums, prepend=0)
                rows[q] = before[codes]
                counts[t].append(sums)
            needed.append(rows)
        for tables in TABLES:
            first = np.minimum.reduce(needed[:tables])
            target = float(np.quantile(np.take_along_axis(first, nearest, 1), recall)) + 1e-6
            share = float(sum((rows < target).mean() for rows in needed[:tables]))
            probes = sum(np.mean([np.searchsorted(sums, target) + 1 for sums in own]) for own in counts[:tables])
            if (now := share * n + probes * PROBE_COST + tables * copies) < cost:
                cost = now
                best = Index(directions[:tables, :functions], offsets[:tables, :functions], width, 1, norm, nearness, min(target, 1.0), share)
    return best


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", column: str = "embedding", recall: float = 0.95) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` to each row of ``queries`` (both with id and vector), by inner product:
    query_id, rank from 1, the found id, score; the query's own id is no candidate, ties go to the smaller id. All
    candidates, if they are fewer than ``k``. ``recall``: what the fit asks for, on its sample.

    Vectors that are null, zero, of another length than most of the distinct ones (of two such lengths, the greater), or
    hold null or non-finite components take no part, nor do rows without an id.
    Rows that repeat an id and a vector count once. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_column]
    classes = written(_classes(usable(vectors, id_column, column), k + 1), "vectors")
    lengths = classes.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()  # a row a length
    dim = lengths["n"] if lengths else 0
    classes = classes.where(F.size("v") == dim)
    asked = written(usable(queries, id_column, column).where(F.size("v") == dim).distinct(), "queries")
    texts = written(asked.groupBy("v").agg(F.min("id").alias("query")), "query_vectors")
    many = texts.count()
    index = fit(classes.withColumn("id", F.element_at("ids", 1)), k, many, recall)
    if index is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_column} {kind}, score double")
    ids, tables, n = kind, len(index.directions), lengths["count"]
    group_size = max(1, index.buckets // 2 ** max(0, math.ceil(math.log2(n / PART_ROWS))))  # buckets

    def hashed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        points = index.lifted(vectors_of(batch.column(1)), False)
        codes = np.stack([index.bucket(points, t) for t in range(tables)], 1).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["class", "v", "codes"])

    rows = classes.select(F.element_at("ids", 1).alias("class"), "v")
    coded = written(by_batch(rows, hashed, f"class {ids}, v array<double>, codes array<int>"), "index")
    places = coded.select("class", "v", F.posexplode("codes").alias("t", "code")).withColumn("g", F.floor(F.col("code") / group_size).cast("int"))
    parts = written(places.groupBy("t", "g").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "groups")  # a row a group of buckets

    cells = written(parts.select("t", "g", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("batch", F.pmod(F.xxhash64("t", "g", "part"), F.lit(BATCHES)).cast("int")), "cells")  # a row a part

    def found_by(asking: DataFrame, many: int, every: bool) -> DataFrame:
        """(query, class, score): the best k + 1 classes that the ``many`` rows (v, query) find in the buckets that they
        visit, or in ``every`` one."""

        def probed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            points = index.lifted(vectors_of(batch.column(0)), True)
            for t in range(1 if every else tables):
                who, groups, lists = [], [], []
                for q, point in enumerate(points):
                    codes = np.arange(index.buckets) if every else np.sort(index.probes(point, t))
                    own = codes // group_size
                    starts = np.flatnonzero(np.diff(own, prepend=-1))
                    who += [q] * len(starts)
                    groups += own[starts].tolist()
                    lists += np.split(codes.astype(np.int32), starts[1:])
                sizes = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), t, np.int32)), pa.array(groups, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(lists))), batch.column(1).take(pa.array(np.array(who, np.int64)))],
                    names=["t", "g", "codes", "query"],
                )

        probes = written(by_batch(asking.select("v", "query"), probed, f"t int, g int, codes array<int>, query {ids}"), "probes")
        slice_ = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-many // SLICE_QUERIES)))).cast("int").alias("slice")
        none = lambda kind: F.lit(None).cast(kind)
        where = lambda first: [F.lit(first).alias("kind"), *([F.lit(-1).alias(c) for c in ("t", "g", "part")] if not first else ["t", "g", "part"])]
        asked_in = probes.join(cells, ["t", "g"]).select(slice_, "batch", *where(1), none("int").alias("code"), "codes", F.col("query").alias("id"), none("array<double>").alias("v"))
        once = probes.select("t", "g", "query").join(cells.select("t", "g", "batch").distinct(), ["t", "g"]).select("query", "batch").distinct()  # BATCHES a query at most
        vectors_in = once.join(asking, "query").select(slice_, "batch", *where(0), none("int").alias("code"), none("array<int>").alias("codes"), F.col("query").alias("id"), "v")
        visits = probes.select("t", "g", slice_).distinct()  # a row for each slice and group
        rows_in = (
            places.join(parts, ["t", "g"]).withColumn("part", F.pmod(F.xxhash64("class"), "parts").cast("int")).join(cells.drop("parts"), ["t", "g", "part"]).join(visits, ["t", "g"])
            .select("slice", "batch", *where(2), "code", none("array<int>").alias("codes"), F.col("class").alias("id"), "v")
        )
        rows = vectors_in.unionByName(asked_in).unionByName(rows_in).select(*KEY, "code", "codes", "id", "v").repartition("slice", "batch").sortWithinPartitions(*KEY)
        near = map_batches(rows, lambda batches: streamed(batches, k + 1), f"query {ids}, class {ids}, score double")
        merged = near.groupBy("query", "class").agg(F.max("score").alias("score"))
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), "class")
        return merged.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).select("query", "class", "score")

    kept = written(found_by(texts, many, False), "kept")
    if index.target < 1 or index.share < 1:
        full = kept.groupBy("query").count().where(F.col("count") >= min(k + 1, n)).select("query")
        short = written(texts.join(full, "query", "left_anti"), "short")
        if left := short.count():
            kept = kept.join(short.select("query"), "query", "left_anti").unionByName(found_by(short, left, True))
    members = classes.select(F.element_at("ids", 1).alias("class"), "ids")
    found = written(kept.join(members, "class").select("query", F.explode("ids").alias("found"), "score"), "found")
    each = asked.join(texts.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select(F.col("id").alias("query_id"), "query")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "found")
    return (
        each.join(found, "query").where(F.col("found") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("found").alias(id_column), "score")
    )


#: What the rows of a search are dealt and sorted by. Of a slice and batch, kind 0 are the query vectors, first of all;
#: then, part by part, kind 1 what queries visit there, and kind 2 the part's rows.
KEY = ("slice", "batch", "t", "g", "part", "kind")


def streamed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(query, class, score) of rows sorted by ``KEY``: what ``compared`` gives of each part, a batch's vectors held once."""
    task = part = None
    held: dict[int, list[pa.RecordBatch]] = {0: [], 1: [], 2: []}

    def give() -> Iterator[pa.RecordBatch]:
        if held[1] and held[2]:
            vectors, asked, rows = (pa.Table.from_batches(held[kind]) for kind in range(3))
            place = pc.index_in(asked.column("id"), value_set=vectors.column("id").combine_chunks())
            probes = pa.table({"codes": asked.column("codes"), "query": asked.column("id"), "v": vectors.column("v").combine_chunks().take(place.combine_chunks())})
            yield from compared(rows.select(["code", "id", "v"]).rename_columns(["code", "class", "v"]), probes, most).to_batches()
        held[1], held[2] = [], []

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(len(KEY))])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            *now, kind = keys[:, a].tolist()
            if now != part:
                yield from give()
                part = now
            if now[:2] != task:
                task, held[0] = now[:2], []
            held[kind].append(batch.slice(a, b - a))
    yield from give()


def compared(index: pa.Table, probes: pa.Table, most: int) -> pa.Table:
    """(query, class, score): for each row of ``probes`` (codes, query, v) its ``most`` nearest rows of ``index`` (code,
    class, v) in the buckets of its codes; ties to the lesser class."""
    kind = index.schema.field("class").type
    out = pa.schema([("query", kind), ("class", kind), ("score", pa.float64())])
    if not index.num_rows or not probes.num_rows:
        return out.empty_table()
    index = index.sort_by([("code", "ascending"), ("class", "ascending")])
    points, asking = (vectors_of(t.column("v").combine_chunks()) for t in (index, probes))
    lists = probes.column("codes").combine_chunks()
    asked = np.repeat(np.arange(len(asking)), np.diff(lists.offsets.to_numpy()))
    wanted = lists.flatten().to_numpy()
    order = np.argsort(wanted, kind="stable")
    asked, wanted = asked[order], wanted[order]
    codes, starts = np.unique(index.column("code").to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(points))
    lows, highs = np.searchsorted(wanted, codes), np.searchsorted(wanted, codes, "right")
    least, held, size = np.full(len(asking), -np.inf), [], 0

    def best() -> list[tuple[np.ndarray, ...]]:
        """Of the pairs held, those of each query that are as near as its ``most``-th, to rounding."""
        q, p, score = (np.concatenate(c) for c in zip(*held, strict=True))
        by = np.lexsort((-score, q))
        q, p, score = q[by], p[by], score[by]
        place = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == most - 1)
        least[q[place]] = score[place]
        keep = score >= least[q] - 1e-9
        return [(q[keep], p[keep], score[keep])]

    for a, b, low, high in zip(starts, ends, lows, highs, strict=True):
        for at in range(low, high, 4096):
            who = asked[at : min(high, at + 4096)]
            scores = asking[who] @ points[a:b].T
            q, p = np.nonzero(scores >= least[who][:, None] - 1e-9)
            held.append((who[q], a + p, scores[q, p]))
            size += len(q)
            if size > HELD_PAIRS:
                held = best()
                size = len(held[0][0])
    if not size:
        return out.empty_table()
    ((q, p, _),) = best()
    exact = np.concatenate([(asking[q[k : k + 65536]] * points[p[k : k + 65536]]).sum(1) for k in range(0, len(q), 65536)])  # a row's sum is the same in whichever task
    names = index.column("class").combine_chunks()
    ranks = np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    by = np.lexsort((ranks[p], -exact, q))
    q, p, exact = q[by], p[by], exact[by]
    first = np.arange(len(q)) - np.searchsorted(q, q) < most
    return pa.table([probes.column("query").take(pa.array(q[first])), names.take(pa.array(p[first])), pa.array(exact[first])], schema=out)


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): each vector with its ``most`` least ids. Ids are ranked within salts first, so that a vector that a
    third of all rows have is no single task's work."""
    salted = rows.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = Window.partitionBy("v", "salt").orderBy("id")
    some = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    return some.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row of ``embeddings`` whose vec_id 20 divides."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
