"""Phrase collocations by prefix-free parsing.

A text is a stream of words and breaks. A chunk begins where a hash of two neighbours says so, by content alone, and goes
on to the next such place and over it by as many words as a phrase can reach; so equal passages give equal chunks wherever
they stand. Equal chunks are one row of a dictionary with their frequency in the parse. Phrases are counted in the
dictionary alone, times that frequency, and only where they begin before the overlap, which is the next chunk's.

Words are counted first, then hashes of pairs of frequent words, then phrases all of whose pairs' hashes are frequent: a
phrase is no more frequent than its parts, and a hash no less than what it stands for. What is frequent is told in tasks by a
table of bits of fixed size, which may let more through, never less; the counts that are given are of words, not of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.llm.common import by_batch, map_batches, text_of, written

#: A chunk begins at one of so many places, about.
PERIOD = 16
LEAST, LONGEST, MOST, PERCENT = 100, 5, 2000, 100
#: Bits of the tables that tell frequent words and pairs; bytes of chunks that a task counts at once.
BITS, AT_ONCE = 25, 12 << 20
#: Parts of a language's candidates that are ranked by themselves first.
SALTS = 32
BREAK = "\n"
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return spread(a * FACTORS[0] + b * FACTORS[1])


def chunks_of(docs: DataFrame, overlap: int, period: int = PERIOD) -> DataFrame:
    """(lang, own, chunk): every chunk of the texts, words and breaks parted by blanks; the first ``own`` are its own."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plain = [t.as_buffer().to_pybytes().translate(PLAIN).replace(b"\n", b" \n ") for t in batch.column(1)]
        lists = pc.split_pattern(pa.array(plain, pa.large_binary()).cast(pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        names = coded.dictionary.to_pylist()
        code, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(plain)), np.diff(lists.offsets.to_numpy()))
        known = {name: k for k, name in enumerate(names)}
        keep = code != known.get("", -1)
        code, doc = code[keep], doc[keep]
        stop = code == known.get(BREAK, -1)
        alone = ~(stop & np.concatenate(([True], stop[:-1] | (doc[1:] != doc[:-1]))))  # breaks that follow one another are one
        code, doc, stop = code[alone], doc[alone], stop[alone]
        if not len(code):
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[code]
        same = np.append(doc[1:] == doc[:-1], False)
        begins = pair_hash(hashes, np.where(same, np.append(hashes[1:], np.uint64(0)), np.uint64(0))) % np.uint64(period) == 0
        begins |= np.concatenate(([True], ~same[:-1]))
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(code))
        own, over, open_ = ends - starts, ends.copy(), np.ones(len(starts), bool)
        for _ in range(overlap):  # to the next break, or the text's end
            inside = over < len(code)
            open_ &= inside
            at = np.where(open_, over, 0)
            open_ &= (doc[at] == doc[starts]) & ~stop[at]
            over = over + open_
        sizes = over - starts
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        tokens = coded.dictionary.take(pa.array(code[where]))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), tokens), pa.scalar(" ", pa.large_string()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[starts])), pa.array(own.astype(np.int32)), joined.cast(pa.string())], names=["lang", "own", "chunk"])

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    return by_batch(rows, run, "lang string, own int, chunk string")


class Stream:
    """The tokens of some chunks (lang, own, chunk, many): ``word`` numbers of (language, word), -1 for breaks; ``row``,
    the chunk; ``own``; ``weight``, its frequency. ``hashes`` of the words by number."""

    def __init__(self, table: pa.Table):
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lists = pc.split_pattern(table.column("chunk").combine_chunks().cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.values.dictionary_encode()
        sizes = np.diff(offsets)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.own = np.arange(offsets[-1]) - offsets[self.row] < table.column("own").to_numpy()[self.row]
        self.weight = table.column("many").to_numpy()[self.row]
        stop = pc.index(coded.dictionary, BREAK).as_py()
        width = len(coded.dictionary)
        both = pa.array(langs.indices.to_numpy().astype(np.int64)[self.row] * width + coded.indices.to_numpy()).dictionary_encode()
        pairs = both.dictionary.to_numpy()
        self.langs, self.words = langs.dictionary.take(pa.array(pairs // width)), coded.dictionary.take(pa.array(pairs % width))
        self.word = np.where(coded.indices.to_numpy() == stop, -1, both.indices.to_numpy().astype(np.int64))
        self.within = np.append(self.row[1:] == self.row[:-1], False)  # whether the next token is of the same chunk

    def hashes(self) -> np.ndarray:
        return word_hashes(self.langs.to_pylist(), self.words.to_pylist())

    def phrases(self, starts: np.ndarray, k: int, counts: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, f) of the phrases of k words that begin at ``starts``."""
        parts = [self.words.take(pa.array(self.word[starts + j])) for j in range(k)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]
        columns = [self.langs.take(pa.array(self.word[starts])), joined.cast(pa.string()), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "f"])


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(f"{a}\n{w}") for a, w in zip(langs, words, strict=True)), np.uint64, len(words))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each different key a place and the sum of weights, and each key's number; one sort for all three."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] - keys.dtype.type(1))) if len(keys) else order
    sums = np.add.reduceat(weights[order], new) if len(keys) else np.empty(0, np.int64)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(new)), np.diff(new, append=len(keys)))
    return order[new], sums, number


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def bit_table(hashes: DataFrame) -> np.ndarray:
    """2 ** BITS bits, those of the first bits of ``hashes`` (h) set."""
    place = F.shiftrightunsigned("h", 64 - BITS)
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    found = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
    out = np.zeros(1 << BITS - 6, np.int64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def hashed(words: DataFrame) -> DataFrame:
    """(h) of ``words`` (lang, phrase)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(word_hashes(*(c.to_pylist() for c in batch.columns)).view(np.int64))], names=["h"])

    return by_batch(words.select("lang", "phrase"), run, "h long")


def counted(chunks: DataFrame, count, least: int, keys: str = "lang string, phrase string") -> DataFrame:
    """(``keys``, f) of what ``count`` gives of the dictionary's streams, summed, with ``least`` at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > AT_ONCE:
                yield from count(Stream(pa.Table.from_batches(held)))
                held, size = [], 0
        if held:
            yield from count(Stream(pa.Table.from_batches(held)))

    found = map_batches(chunks, run, f"{keys}, f long")
    return found.groupBy(*(k.split()[0] for k in keys.split(", "))).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def words_in(stream: Stream) -> Iterator[pa.RecordBatch]:
    at = np.flatnonzero(stream.own & (stream.word >= 0))
    first, sums, _ = summed(stream.word[at], stream.weight[at])
    yield stream.phrases(at[first], 1, sums)


def pairs_at(stream: Stream, known: np.ndarray) -> np.ndarray:
    """Where two words stand whose bits are set both."""
    ok = np.append(marked(known, stream.hashes()), False)[stream.word]  # breaks have number -1
    return ok & np.append(ok[1:], False) & stream.within


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, period: int = PERIOD) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of ``longest`` words at most that ``least`` places have, and (lang, n), all words.

    Null text is empty, a null language ``und``; rows alike count each; an empty table gives empty results."""
    context = docs.sparkSession.sparkContext
    found = chunks_of(docs, longest - 1, period).groupBy("lang", "own", "chunk").agg(F.count("*").alias("many"))
    chunks = written(found.select("lang", "own", "chunk", "many"), "chunks")
    every = written(counted(chunks, words_in, 1), "words")
    words = every.where(F.col("f") >= least)
    known = context.broadcast(bit_table(hashed(words)))

    def pairs_in(stream: Stream) -> Iterator[pa.RecordBatch]:
        at, hashes = np.flatnonzero(pairs_at(stream, known.value) & stream.own), stream.hashes()
        pairs = pair_hash(hashes[stream.word[at]], hashes[stream.word[at + 1]])
        first, sums, _ = summed(pairs, stream.weight[at])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[first].view(np.int64)), pa.array(sums)], names=["h", "f"])

    known_pairs = context.broadcast(bit_table(counted(chunks, pairs_in, least, "h long")))

    def phrases_in(stream: Stream) -> Iterator[pa.RecordBatch]:
        hashes = stream.hashes()
        at = np.flatnonzero(pairs_at(stream, known.value))
        pair = np.zeros(len(stream.word) + longest, bool)
        pair[at] = marked(known_pairs.value, pair_hash(hashes[stream.word[at]], hashes[stream.word[at + 1]]))
        at = np.flatnonzero(pair[: len(stream.word)] & stream.own)
        number = stream.word[at]
        for k in range(2, longest + 1):
            number = number << 32 | stream.word[at + k - 1]
            first, sums, number = summed(number, stream.weight[at])
            yield stream.phrases(at[first], k, sums)
            on = pair[at + k - 1]
            at, number = at[on], number[on]

    phrases = written(counted(chunks, phrases_in, least), "phrases") if longest > 1 else words.limit(0)
    with_size = words.unionByName(phrases).select("lang", F.size(F.split("phrase", " ", -1)).alias("k"), "phrase", "f")
    return with_size, every.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, percent: int = PERCENT, period: int = PERIOD) -> DataFrame:
    """Per language its ``most`` best phrases of 2 to ``longest`` words that ``least`` places have: lang, rank, phrase, a,
    l, r, n, score. A phrase's score is that of its weakest cut, floor(1000 a n / (l r)), with the counts of the two parts;
    of equal ones the first cut counts. A phrase inside a longer one that is frequent, and has ``percent`` of its places, is
    left out. Order: score and a falling, then the phrase's bytes.

    Texts are read whole, lower-cased (A-Z alone) and parted at line ends and ``.,;:!?``. Null text is empty, a null
    language ``und``; rows alike count each; other columns are left out; an empty table gives an empty result.
    """
    found, totals = frequent_phrases(docs, least, longest, period)
    some = found.where("k > 1")
    parts = F.split("phrase", " ", -1)
    cuts = some.withColumns({"w": parts, "cut": F.explode(F.sequence(F.lit(1), F.col("k") - 1))})
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))
    one = lambda part, f: found.select("lang", F.col("phrase").alias(part), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.join(one("left", "l"), ["lang", "left"]).join(one("right", "r"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumns({"up": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    # a longer phrase's parts are as frequent as it is, so that those of one word less tell
    inner = F.array(F.array_join(F.slice("w", F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("k") - 1), " "))
    holders = some.where("k > 2").withColumn("w", parts).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = scored.join(holders, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR 100 * longer < {int(percent)} * a"))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("r0", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("r0") <= most)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::BIGINT AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM c JOIN t ON t.lang = c.lang
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:c.cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS first FROM s),
i AS (SELECT DISTINCT x.lang, x.phrase FROM f x JOIN f y ON x.lang = y.lang AND x.k > 1 AND y.k > x.k AND 100 * y.f >= 100 * x.f AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
o AS (SELECT m.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m ANTI JOIN i USING (lang, phrase) WHERE first = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
"""
