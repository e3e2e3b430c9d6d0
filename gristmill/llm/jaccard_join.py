"""N-gram Jaccard join: count-vector R-trees over sets of 5-word shingles, exact at 0.8 and over.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class from then on (its id is the set's digest).
2. Two sets that link share one of their first n - ceil(0.8 n) + 1 shingles in any one order of all shingles. The order
   is the hash's, with frequent shingles last, so that shared passages don't fill the keys. Keys that two classes have
   part the join over the cluster; no pair is made from them.
3. Under a key, classes are points: shingles are hashed into groups, the counts are the coordinates. An R-tree bounds
   the overlap with a whole node by the sum of coordinate minima; what passes is a candidate. A key with many classes is
   dealt into blocks. First neighbours in the chain of blocks alone are compared, which joins a group of near copies
   by links in proportion to it; after that a component that has many of a key's classes has blocks of its own, and
   blocks of one component are never compared.
4. Candidates are verified on whole sets, which are made of their texts again. A component proposes its best candidates
   outside it first, more in each round until none is left: what a component's links already join is never expanded into
   pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.llm.common import by_batch, forget, map_batches, text_of, written
from gristmill.llm.components import components

WORDS = 5
#: The least similarity, as a fraction.
PART, WHOLE = 4, 5
#: Bits of the table of frequent shingles.
FREQUENT_BITS = 22
#: Bytes of ids up to which they are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 8_000_000
#: Classes of a block of a key; a component with more than half as many under a key has blocks of its own there.
BLOCK = 512
LEAF = 32
MOST_GROUPS = 512
QUERIES = 1024
#: Classes of a component under a key that stand for it in the round before all do.
DRAWN = 32
#: A class's least keys that its points carry, for telling that two have met under a lesser key; pairs compared at once.
FIRST_KEYS, COMPARED = 16, 4096
#: Bytes of text whose shingles a task holds at once; a longer text is held by itself.
TEXT_BYTES = 4_000_000
#: Rows under one key that are compared with each before all are kept, and rows of one key that a task holds for it.
STEPS, HELD = 64, 1_000_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted set of shingle hashes. Lower-casing and white space are ASCII's, as bytes have them."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return mixed((h * FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = h[: n - WORDS + 1] * FACTORS[0]
    for k in range(1, WORDS):
        out += h[k : n - WORDS + 1 + k] * FACTORS[k]
    return np.unique(mixed(out))


def class_id(found: np.ndarray) -> int:
    """The set's digest as a signed 64-bit number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes()))))


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which every linked set has one in its own prefix."""
    n = len(found)
    low = found & np.uint64((1 << FREQUENT_BITS) - 1)
    often = (frequent[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return np.concatenate((found[~often], found[often]))[: n - (PART * n + WHOLE - 1) // WHOLE + 1]


def groups_of(n: int) -> int:
    """Groups for a set of n: the power of two from twice its size on, within bounds."""
    return min(MOST_GROUPS, 1 << max(3, (2 * n - 1).bit_length()))


def count_vector(found: np.ndarray) -> bytes:
    """Counts of the shingles in groups, in a byte each where they fit, else in two; groups of half as many are the
    sums of two halves."""
    groups = groups_of(len(found))
    counts = np.bincount((found >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint16).tobytes()


def vector_of(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == groups_of(n) else np.uint16).astype(np.int32)


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    return vector.reshape(-1, groups).sum(0) if len(vector) > groups else vector


class CountRTree:
    """An R-tree over count vectors, bulk-loaded by halving at the median of the widest coordinate. A node has its
    points' greatest counts, their least and greatest sizes, and the component that all of them are of, or None."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, roots: np.ndarray):
        self.vectors, self.sizes, self.roots = vectors, sizes, roots
        self.root = self._node(np.arange(len(sizes)))

    def _node(self, rows: np.ndarray):
        some, n, roots = self.vectors[rows], self.sizes[rows], self.roots[rows]
        top, one = some.max(0), roots[0] if (roots == roots[0]).all() else None
        if len(rows) <= LEAF:
            return top, n.min(), n.max(), one, rows, None
        widest = int((top - some.min(0)).argmax())
        order = rows[np.argsort(some[:, widest], kind="stable")]
        half = len(order) // 2
        return top, n.min(), n.max(), one, None, (self._node(order[:half]), self._node(order[half:]))

    def search(self, queries: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, bound) of all pairs of two components that the bound lets through, the queries taken down the
        tree together; a node that is all of a query's own component is not entered."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        work = [(self.root, np.arange(len(sizes)))]
        while work:
            (top, low, high, one, rows, kids), active = work.pop()
            if one is not None:
                active = active[roots[active] != one]
            n = sizes[active]
            active = active[(n * WHOLE >= PART * low) & (n * PART <= WHOLE * high)]
            bound = np.minimum(queries[active], top).sum(1)
            active = active[(PART + WHOLE) * bound >= PART * (sizes[active] + low)]
            if not len(active):
                continue
            if kids:
                work += [(k, active) for k in kids]
                continue
            for row in rows:
                n = self.sizes[row]
                bound = np.minimum(queries[active], self.vectors[row]).sum(1)
                fits = ((PART + WHOLE) * bound >= PART * (sizes[active] + n)) & (sizes[active] * WHOLE >= PART * n) & (sizes[active] * PART <= WHOLE * n)
                fits &= roots[active] != self.roots[row]
                if fits.any():
                    out.append((active[fits], np.full(int(fits.sum()), row), bound[fits]))
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def met_before(firsts: np.ndarray, a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
    """Of pairs of rows of ``firsts``, each a class's least keys, those that have a common one below ``key``: it shows them."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), COMPARED):
        x, y = firsts[a[at : at + COMPARED]], firsts[b[at : at + COMPARED]]
        out[at : at + COMPARED] = ((x[:, :, None] == y[:, None, :]) & (x < key)[:, :, None]).any((1, 2))
    return out


def proposals(
    ids: np.ndarray,
    roots: np.ndarray,
    sizes: np.ndarray,
    vectors: list[np.ndarray],
    most: int,
    key: int = 0,
    firsts: np.ndarray | None = None,
    blocks: np.ndarray | None = None,
) -> tuple[set[tuple[int, int]], bool]:
    """Pairs of ids under one key, each component's ``most`` best candidates outside it for each run of queries; and
    whether some component has more. With ``firsts``, without those that met before ``key``; with ``blocks``, a number for
    each row, only pairs of unlike ones."""
    pairs: set[tuple[int, int]] = set()
    more = False
    if len(ids) == 2:
        if blocks is not None and blocks[0] == blocks[1]:
            return pairs, False
        width = min(map(len, vectors))
        bound = int(np.minimum(folded(vectors[0], width), folded(vectors[1], width)).sum())
        met = firsts is not None and met_before(firsts, np.array([0]), np.array([1]), key)[0]
        good = not met and roots[0] != roots[1] and (PART + WHOLE) * bound >= PART * sizes.sum() and WHOLE * sizes.min() >= PART * sizes.max()
        return ({(int(ids.min()), int(ids.max()))} if good else pairs), False
    widths = np.array([len(v) for v in vectors])
    for width in np.unique(widths):  # sets that link differ by one doubling at most
        rows = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(rows) < 2 or not (widths[rows] == width).any():
            continue
        points = np.stack([folded(vectors[k], width) for k in rows])
        tree = CountRTree(points, sizes[rows], roots[rows])
        for at in range(0, len(rows), QUERIES):
            some = rows[at : at + QUERIES]
            q, p, bound = tree.search(points[at : at + QUERIES], sizes[some], roots[some])
            if blocks is not None:
                fits = blocks[some[q]] != blocks[rows[p]]
                q, p, bound = q[fits], p[fits], bound[fits]
            if firsts is not None:
                fits = ~met_before(firsts, some[q], rows[p], key)
                q, p, bound = q[fits], p[fits], bound[fits]
            own = roots[some[q]]
            order = np.lexsort((ids[rows[p]], ids[some[q]], -bound / (sizes[some[q]] + sizes[rows[p]]), own))
            q, p, own = q[order], p[order], own[order]
            rank = np.arange(len(q)) - np.searchsorted(own, own)
            more |= bool((rank >= most).any())
            for a, b in zip(ids[some[q[rank < most]]].tolist(), ids[rows[p[rank < most]]].tolist(), strict=True):
                pairs.add((a, b) if a < b else (b, a))
    return pairs, more


def by_texts(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``function`` over parts of Arrow batches whose last column has about ``TEXT_BYTES`` of text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(pc.binary_length(batch.columns[-1]).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(ends // TEXT_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield from function(batch.slice(a, b - a))

    return by_batch(df, run, schema)


def sets_table(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, digest, n, cid, often): each document's text's digest, set size and class; the frequent shingles of a part of
    a batch stand in its first row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [shingles(t.as_py()) for t in batch.column(2)]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        often = np.unique(values[counts >= max(4, len(found) // 2000)] & np.uint64((1 << FREQUENT_BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array([class_id(f) if len(f) else None for f in found], pa.int64()),
                pa.array([often.tolist(), *[None] * (len(found) - 1)], pa.list_(pa.int32())),
            ],
            names=["id", "digest", "n", "cid", "often"],
        )

    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_of()).alias("digest"), text_of().alias("text"))
    return by_texts(texts, run, f"id {dict(docs.dtypes)[id_column]}, digest long, n long, cid long, often array<int>")


def frequent_table(often: DataFrame) -> np.ndarray:
    """A bit for each value of the low hash bits that is frequent in some batch: 2 ** FREQUENT_BITS bits, whatever the input."""
    bits = np.zeros(1 << FREQUENT_BITS, np.uint8)
    found = often.select(F.explode("often").alias("low")).distinct().toArrow().column("low").to_numpy()
    bits[found] = 1
    return np.packbits(bits, bitorder="little")


def partnered(keys: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of rows sorted by key and size, those with another row under their key that they could link with, were this the
    first shingle that both have in the order: no more than the rest of either set can be common then."""
    keep, rows = np.zeros(len(keys), bool), np.arange(len(keys))
    left = 1 + np.maximum(sizes - 1 - places, 0)
    for step in range(1, STEPS + 1):
        rows = rows[: np.searchsorted(rows, len(keys) - step)]
        rows = rows[(keys[rows] == keys[rows + step]) & (WHOLE * sizes[rows] >= PART * sizes[rows + step])]
        if not len(rows):
            return keep
        fits = (PART + WHOLE) * np.minimum(left[rows], left[rows + step]) >= PART * (sizes[rows] + sizes[rows + step])
        keep[rows[fits]] = keep[rows[fits] + step] = True
    for step in range(STEPS + 1):  # longer runs of like sizes aren't told apart here: all their rows stay
        keep[rows + step] = True
    # and so do the rows beyond, each of which ends such a run or has been compared
    return keep


def keyed(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(key, cid) for each class and each shingle of its prefix, kept where another class under the key could link.
    Shingles that the same classes have are one key, a digest of them: they show the same candidates. Keys whose digests
    happen to agree have their classes together, which loses none."""
    table = docs.sparkSession.sparkContext.broadcast(frequent)

    def prefixes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids, sizes, seen = [], [], [], set()
        for t in batch.column(0):
            found = shingles(t.as_py())
            if len(found) and (cid := class_id(found)) not in seen:
                seen.add(cid)
                keys.append(prefix(found, table.value))
                ids.append(cid)
                sizes.append(len(found))
        if keys:
            many = [len(k) for k in keys]
            places = np.concatenate([np.arange(n, dtype=np.int32) for n in many])
            columns = (np.concatenate(keys).view(np.int64), np.repeat(np.array(ids, np.int64), many), np.repeat(np.array(sizes, np.int32), many), places)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "cid", "n", "place"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key, size and class; the last key's rows wait for what follows, up to HELD of them."""
        held, large = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)], None  # a key over HELD: all its rows stay

        def give(columns: list[np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
            if keep.any():
                named, ids = columns[0][keep], columns[1][keep]
                starts = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
                many = np.diff(starts, append=len(named))
                digests = mixed(np.add.reduceat(mixed(ids.view(np.uint64)), starts) + many.astype(np.uint64))
                merged = np.repeat(digests.view(np.int64), many)
                if large is not None:  # its classes aren't seen together: it keeps its own name
                    merged = np.where(named == large, named, merged)
                yield pa.RecordBatch.from_arrays([pa.array(merged), pa.array(ids)], names=["key", "cid"])

        def tested(columns: list[np.ndarray]) -> np.ndarray:
            return partnered(columns[0], columns[2].astype(np.int64), columns[3].astype(np.int64)) | (columns[0] == large if large is not None else False)

        for batch in batches:
            rows = [np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            fresh = np.concatenate(([True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            rows = [c[fresh] for c in rows]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - cut > HELD:
                large, cut = rows[0][-1], len(rows[0])
            done, held = [c[:cut] for c in rows], [c[cut:] for c in rows]
            yield from give(done, tested(done))
        yield from give(held, tested(held))

    keys = by_texts(docs.select(text_of().alias("text")), prefixes, "key long, cid long, n int, place int")
    return map_batches(keys.repartition("key").sortWithinPartitions("key", "n", "cid"), shared, "key long, cid long").distinct()


def narrowed(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """(text) of ``docs`` whose ids are in the written table ``ids`` (first), null among them."""
    rows = docs.select(F.col(id_column).alias("id"), text_of().alias("text"))
    return rows.join(small(ids), F.col("id").eqNullSafe(F.col("first")), "left_semi").select("text")


def small(table: DataFrame) -> DataFrame:
    """The written table, to be broadcast where it has few bytes; else Spark decides."""
    wide = sum((F.lit(8) if kind in ("bigint", "int") else F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) + 16 for name, kind in table.dtypes), F.lit(0))
    return F.broadcast(table) if (table.agg(F.sum(wide)).first()[0] or 0) <= BROADCAST_BYTES else table


def by_class(texts: DataFrame, give: dict[str, tuple[str, pa.DataType, Callable]]) -> DataFrame:
    """(cid, ...) of the texts' classes, a column for each of ``give``: its kinds and what makes it of a set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # an id that rows repeat may give its class again in another batch, which only gives its pairs again
        found = list({class_id(f): f for f in (shingles(t.as_py()) for t in batch.column(0)) if len(f)}.values())
        for at in range(0, len(found), 1000):
            part = found[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(f) for f in part], pa.int64()), *(pa.array(list(map(make, part)), kind) for _, kind, make in give.values())], names=["cid", *give])

    return by_texts(texts, run, "cid long, " + ", ".join(f"{name} {form}" for name, (form, _, _) in give.items()))


def points_table(docs: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """(cid, n, vector) of the classes whose first documents' ids are in ``wanted`` (first)."""
    return by_class(narrowed(docs, wanted, id_column), {"n": ("long", pa.int64(), len), "vector": ("binary", pa.binary(), count_vector)})


def sets_of(docs: DataFrame, wanted: DataFrame, id_column: str) -> DataFrame:
    """(cid, shingles) of the classes whose first documents' ids are in ``wanted`` (first)."""
    return by_class(narrowed(docs, wanted, id_column), {"shingles": ("binary", pa.binary(), np.ndarray.tobytes)})


def chained(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``members`` (key, cid, root) with ``vectors`` (cid, ...) and columns i, j and block: a key with more classes than ``BLOCK`` has them in blocks by a hash of the
    class, and every row once for each of the pairs (i, i + 1) that its own is in; other keys are one block, (0, 0)."""
    large = written(members.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK), "large")  # a row for BLOCK rows at most
    blocks, own = F.coalesce(F.ceil(F.col("many") / BLOCK), F.lit(1)).cast("int"), F.col("block")
    firsts = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.lit(0), own - 1), F.least(own, F.col("blocks") - 2)))
    with_block = members.join(large, "key", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).join(vectors, "cid")
    return with_block.withColumn("i", F.explode(firsts)).select("key", "root", *vectors.columns, "i", F.least(F.col("i") + 1, F.col("blocks") - 1).alias("j"), "block")


def dealt(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``members`` (key, cid, root) with ``vectors`` (cid, ...) and columns i, j and block. A key with more classes than ``BLOCK`` has them in blocks: first those of
    the components that have few classes there, by a hash of the component, then the others' own. Every row stands once
    for each pair (i, j) of blocks that its own is in, but pairs of one component's own blocks; other keys are one block."""
    cells = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    alone = F.col("c") > BLOCK // 2
    keys = cells.groupBy("key").agg(
        F.sum("c").alias("many"), F.ceil(F.sum(F.when(alone, 0).otherwise(F.col("c"))) / BLOCK).cast("int").alias("mixed"), F.sum(F.when(alone, F.ceil(F.col("c") / BLOCK)).otherwise(0)).cast("int").alias("pure")
    )
    large = written(keys.where(F.col("many") > BLOCK).drop("many"), "large")  # a row for BLOCK rows at most
    before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    owned = cells.where(alone).join(large.select("key"), "key").select("key", "root", F.ceil(F.col("c") / BLOCK).cast("int").alias("own"))
    owners = written(owned.withColumn("before", before), "owners")  # a row for half of BLOCK rows at most
    placed = members.join(large, "key", "left").join(owners, ["key", "root"], "left").withColumns({"mixed": F.coalesce("mixed", F.lit(1)), "pure": F.coalesce("pure", F.lit(0))})
    in_own = F.col("mixed") + F.col("before") + F.pmod(F.xxhash64("cid"), F.col("own")).cast("int")
    in_mixed = F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), F.col("mixed"))).cast("int")
    block, last = F.col("block"), F.col("mixed") + F.col("pure") - 1
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    own_first = F.col("mixed") + F.col("before")
    others = F.when(F.col("own").isNull(), span(F.lit(0), last)).otherwise(F.concat(span(F.lit(0), own_first - 1), span(own_first + F.col("own"), last)))
    pairs = F.transform(others, lambda k: F.struct(F.least(block, k).alias("i"), F.greatest(block, k).alias("j")))
    with_block = placed.withColumn("block", F.when(F.col("own").isNull(), in_mixed).otherwise(in_own)).join(vectors, "cid")
    return with_block.withColumn("p", F.explode(pairs)).select("key", "root", *vectors.columns, "p.i", "p.j", "block")


def proposed(members: DataFrame, vectors: DataFrame, most: int, chain: bool = False) -> DataFrame:
    """(key, a, b, more): candidates under every key of the written ``members`` (key, cid, root), with their classes'
    ``vectors`` (cid, n, vector, firsts), and whether the key has more than these. Two classes whose ``firsts`` have a lesser key in common are left to that key. A task holds
    the points of one pair of a key's blocks, never pairs of classes. ``chain``: of a key's blocks, only neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def give() -> Iterator[pa.RecordBatch]:
            ids, roots, sizes, vectors, lists, own = zip(*held, strict=True)
            (key, i, j), firsts = group, np.full((len(ids), FIRST_KEYS), np.iinfo(np.int64).max)
            for row, some in zip(firsts, lists, strict=True):
                row[: len(some)] = some
            across = np.array(own) if i < j and not chain else None
            pairs, more = proposals(np.array(ids), np.array(roots), np.array(sizes), list(map(vector_of, vectors, sizes)), most, key, firsts, across)
            rows = [(key, a, b, more) for a, b in sorted(pairs)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "a", "b", "more"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != group:
                    if len(held) > 1:
                        yield from give()
                    group, held = (key, i, j), []
                held.append(row)
        if len(held) > 1:
            yield from give()

    rows = (chained if chain else dealt)(members, vectors).select("key", "i", "j", "cid", "root", "n", "vector", "firsts", "block")
    return map_batches(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cid"), run, "key long, a long, b long, more boolean")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """``pairs`` (a, b) whose whole sets are similar enough, written. The sets are made again of the texts that pairs
    need, so that none is stored for the others, and go again. ``classes`` (cid, first)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = written(classes.join(ids, "cid", "left_semi").select("first").distinct(), "ids")
    sets = written(sets_of(docs, wanted, id_column), "sets_of_pairs")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        good = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
            common = len(np.intersect1d(p, q, assume_unique=True))
            good.append(WHOLE * common >= PART * (len(p) + len(q) - common))
        mask = pa.array(good, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    links = written(by_batch(both.select("a", "b", "x", "y"), run, "a long, b long"), "links")
    forget(wanted, sets)
    return links


def class_links(shared: DataFrame, points: DataFrame, classes: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """(cid, root) of all classes that have a link to another. ``shared`` (key, cid) is every key that two classes have."""
    first = shared.withColumn("k", F.row_number().over(Window.partitionBy("cid").orderBy("key")))

    def carrying(most: int) -> DataFrame:
        lists = first.where(F.col("k") <= most).groupBy("cid").agg(F.collect_list("key").alias("firsts"))
        return points.join(lists, "cid")

    members = written(first.where("k <= 2").select("key", "cid", F.col("cid").alias("root")), "members")
    few = written(proposed(members, carrying(2), 2, chain=True).select("a", "b").distinct(), "pairs")  # most classes end in their components here
    forget(members)
    links, checked = verified(few, classes, docs, id_column), few
    roots = written(components(links), "roots")
    left, vectors = shared, written(carrying(FIRST_KEYS), "vectors")

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.toDF("cid", "_root"), "cid", "left").select("key", "cid", F.coalesce("_root", "cid").alias("root"))

    def opened(rows: DataFrame, most: int) -> DataFrame:
        """The candidates of rows (key, cid, root) under keys that have several components."""
        open_keys = written(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "open")
        members = written(rows.join(open_keys, "key", "left_semi"), "members")
        found = written(proposed(members, vectors, most), "pairs")
        forget(open_keys, members)
        return found

    def joined(found: DataFrame) -> None:
        """Verifies what hasn't been, and joins components by it."""
        nonlocal roots, checked
        pairs = written(found.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"), "pairs")
        new = verified(pairs, classes, docs, id_column)
        if new.limit(1).count():  # what was linked before is a star by now
            before, roots = roots, written(components(roots.where("id <> root").toDF("a", "b").unionByName(new)), "roots")
            forget(before)
        checked = checked.unionByName(pairs)
        forget(new)

    # a few of each component's classes under a key, others under each, stand for it first: who is left joins large ones here
    drawn = F.row_number().over(Window.partitionBy("key", "root").orderBy(F.xxhash64("key", "cid")))
    some = written(rooted(shared).withColumn("r", drawn).where(F.col("r") <= DRAWN).drop("r"), "drawn")
    found = opened(some, 8)
    joined(found)
    forget(some, found)
    most = 8
    while True:
        found = opened(rooted(left), most)
        again = written(found.where("more").select("key").distinct(), "keys")  # the others have shown all their candidates
        joined(found)
        forget(found)
        if not again.limit(1).count():
            return roots.toDF("cid", "root")
        most, left = most * 64, left.join(again, "key", "left_semi")


def row_classes(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, digest, n, cid, root, first) for each row: a digest of the text, set size, class, and its component's name
    and least id. Rows with empty sets have neither class nor component."""
    rows = written(sets_table(docs, id_column), "sets")
    classes = written(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("first")), "classes")
    shared = written(keyed(docs, frequent_table(rows.where("often IS NOT NULL"))), "shared")
    wanted = written(classes.join(shared.select("cid").distinct(), "cid", "left_semi").select("first").distinct(), "wanted")
    points = written(points_table(docs, wanted, id_column), "points")
    roots = class_links(shared, points, classes, docs, id_column)
    named = written(classes.join(roots, "cid", "left").select("cid", "first", F.coalesce("root", "cid").alias("root")), "named")
    forget(classes, shared, wanted, points)
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    joined = named.select("cid", "root").join(least, "root").select("cid", "root", "first")
    return rows.drop("often").join(joined, "cid", "left").select("id", "digest", "n", "cid", "root", "first")


def jaccard_components(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, n_shingles, component_id, the least id reachable by links of a similarity of 0.8 and over.

    Null and empty texts, and texts of white space, have empty sets and link with nothing; a text of fewer than five
    words is one shingle. Rows that repeat an id give a row each. Other columns are left out. Texts of any length are read
    whole; an empty table gives an empty result.
    """
    found = row_classes(docs, id_column)
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of links, all columns: that of the least id (nulls last), of its texts the
    one of the least digest, of rows alike in both the least by the other columns' hash. Rows are told apart by id and
    text, so that an id which rows repeat loses no other text. Rows with empty sets are copies of nothing and all stay.
    Texts of any length are read whole; an empty table gives an empty result."""
    found = written(row_classes(docs, id_column).where("root IS NOT NULL").groupBy("root", "id", "digest").agg(F.count("*").alias("many")), "rows")
    # by component, the least row; an aggregation, as a component may have a third of all rows
    row = lambda d: F.struct(d["id"].isNull().alias("none"), d["id"].alias("id"), d["digest"].alias("digest"))
    least = written(found.groupBy("root").agg(F.min(row(found)).alias("r")).select("root", "r.id", "r.digest"), "least")
    kept = found.alias("f").join(least.alias("l"), F.expr("f.root = l.root AND f.id <=> l.id AND f.digest = l.digest"), "left")
    gone = written(kept.where("l.root IS NULL").select(F.col("f.id").alias("_gone_id"), F.col("f.digest").alias("_gone_digest")), "gone")
    twice = written(kept.where("l.root IS NOT NULL AND f.many > 1").select(F.col("f.id").alias("_twice_id"), F.col("f.digest").alias("_twice_digest")), "twice")
    digest = F.xxhash64(text_of())
    here = lambda name: (F.col(id_column).eqNullSafe(F.col(f"_{name}_id"))) & (digest == F.col(f"_{name}_digest"))
    left = docs.join(small(gone), here("gone"), "left_anti")
    if not twice.limit(1).count():
        return left
    twice = small(twice)
    alike = left.join(twice, here("twice")).groupBy("_twice_id", "_twice_digest").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return left.join(twice, here("twice"), "left_anti").unionByName(alike.select("_row.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * common >= 80 * (na.n + nb.n - common)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r.seen) FROM r WHERE r.id = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
