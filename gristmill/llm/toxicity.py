"""Toxicity by weak supervision: many voters, a generative label model over them, a linear classifier on its posteriors.

Voters are lexicons, patterns, and word stems that are mined from labelled rows; one voter may ask for several different
words of a stem, as a word that a clean text has once stands in a toxic one in several forms. The label model has for each voter how
often it fires on toxic and on clean texts, estimated by expectation maximisation with the given label as one voter more;
voters that fire together beyond their class share their weight. A logistic regression on the voters' hits and on the
text's own words, hashed, is fitted to the posterior labels and scores every text. Voting and scoring run over Arrow
batches, without a shuffle of texts; only counts of stems are shuffled, and the votes and hashed words of a bounded sample
of labelled rows come to the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import Function, by_batch, by_task, text_of, written

#: Labelled rows that a fit takes at most, by a hash of their ids.
MOST_LABELLED = 20_000
#: Bits of a word's hash, and the ridge on the words' weights: of 0.03 to 1 the one with the fewest errors in four folds
#: of sf0.1's rows that aren't held out (27 missed and 8 false alarms of 352 and 2803, as with 0.1; voters alone: 28, 11).
WORD_BITS, WORD_RIDGE = 15, 0.3
#: Different words that a task keeps the votes of, before it starts anew.
KNOWN_WORDS = 200_000
#: Least log-likelihood ratio of a stem with the label; far above what chance gives a million stems.
LEAST_RATIO = 45.0
PREFIXES = (4, 5, 6)
#: Different words of a prefix that a mined voter asks for, and chosen stems that each toxic row is to have, where it can.
FORMS, COVER = (1, 2, 3), 2
#: Toxic rows that a stem has at least, and that a chosen one adds.
LEAST_ROWS = 5
WORD = re.compile(r"[^\W\d_]+")

LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "dumbass", "imbecile", "cretin", "dimwit", "halfwit", "brainless", "dunce"),
    "contempt": ("loser", "losers", "clown", "clowns", "pathetic", "worthless", "useless", "coward", "cowards", "freak", "creep", "weirdo"),
    "filth": ("trash", "scum", "scumbag", "garbage", "filth", "filthy", "vermin", "disgusting", "vile", "maggot", "parasite", "parasites", "subhuman"),
    "profanity": ("fuck", "fucking", "fucker", "shit", "shitty", "bitch", "bastard", "asshole", "bullshit", "crap", "cunt", "dickhead", "motherfucker", "wanker"),
    "threat": ("kill", "murder", "strangle", "stab", "rape", "lynch", "exterminate"),
    "german": ("idioten", "dumm", "dummkopf", "blöd", "arschloch", "scheiße", "scheiss", "abschaum", "versager", "erbärmlich", "widerlich", "wertlos", "trottel", "depp", "drecksau", "missgeburt"),
    "french": ("idiote", "imbécile", "connard", "connasse", "salaud", "salope", "merde", "putain", "abruti", "débile", "ordure", "minable", "pathétique", "dégoûtant", "crétin", "enculé"),
    "spanish": ("idiota", "imbécil", "estúpido", "estúpida", "mierda", "basura", "escoria", "puta", "pendejo", "cabrón", "gilipollas", "patético", "asqueroso", "inútil", "payaso", "perdedor"),
}
PATTERNS: dict[str, re.Pattern] = {
    "masked": re.compile(r"(?i)\b(?:f[*#@$!]{2,}k?|sh[*#@$!]t|b[*#@$!]tch|a[*#@$!]{2}hole|1d[i1]ot|st[u*]p[1*]d|m0r[o0]n|l0ser|tr4sh)"),
    "address": re.compile(r"(?i)\b(?:you|you're|u r|du bist|ihr seid|tu es|vous êtes|eres|sois)\s+(?:all\s+)?(?:an?\s+|such\s+an?\s+|ein\s+|un\s+|una\s+)?(?:idiot|moron|loser|clown|scum|trash|pathetic|worthless|stupid|disgusting)"),
    "dismissal": re.compile(r"(?i)\b(?:shut up|go to hell|drop dead|get lost|nobody (?:likes|wants) you|kill yourself|halt die fresse|ferme ta gueule|cállate)\b"),
    "outcry": re.compile(r"[!?]{4,}"),
}
#: Voters that tell how many lexicon words a text has: fired at this many different ones.
SEVERAL = (2, 3)


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def stems(word: str) -> list[str]:
    """The stems that a word counts for: itself, and its first letters where it is longer."""
    return [f"={word}", *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)] if len(word) > 2 else []


def stems_of(text: str) -> set[str]:
    """The text's mined voters' names: its stems, and ``n`` before a prefix that n different words of the text have."""
    seen = Counter(s for w in words(text) for s in stems(w))
    return {s if n == 1 else f"{n} {s}" for s, many in seen.items() for n in FORMS if many >= n}


@dataclass(frozen=True)
class Voters:
    """Names in the order of the vote columns: lexicons' words by lexicon, patterns, counts, mined stems."""

    mined: tuple[str, ...] = ()

    @property
    def names(self) -> list[str]:
        return [*LEXICONS, *PATTERNS, *(f"{n} words" for n in SEVERAL), *self.mined]

    def counter(self):
        """A function of a text that gives the voters' hits (different words, matches of patterns), and the different
        hashes of the text's words."""
        lexicon = {w: k for k, some in enumerate(LEXICONS.values()) for w in some}
        first = len(LEXICONS) + len(PATTERNS) + len(SEVERAL)
        least = np.array([int(s.split()[0]) if " " in s else 1 for s in self.mined], np.float32)
        plain = [s.split()[-1] for s in self.mined]
        mined = {s: first + k for k, s in enumerate(dict.fromkeys(plain))}
        source = np.array([mined[s] for s in plain], int)
        width, known = first + len(mined), {}

        def votes(word: str) -> tuple[int, ...]:
            own = [lexicon[word]] if word in lexicon else []
            return tuple(own + [mined[s] for s in stems(word) if s in mined])

        def hits(text: str) -> tuple[np.ndarray, np.ndarray]:
            out, distinct, buckets = np.zeros(width, np.float32), 0, []
            for word in words(text):
                got = known.get(word)
                if got is None:
                    if len(known) > KNOWN_WORDS:
                        known.clear()
                    got = known[word] = (votes(word), crc32(word.encode()) & (1 << WORD_BITS) - 1)
                buckets.append(got[1])
                for k in got[0]:
                    out[k] += 1
                    distinct += k < len(LEXICONS)
            for k, pattern in enumerate(PATTERNS.values(), len(LEXICONS)):
                out[k] = sum(1 for _ in pattern.finditer(text))
            for k, n in enumerate(SEVERAL, len(LEXICONS) + len(PATTERNS)):
                out[k] = distinct >= n
            own = out[source]
            return np.concatenate((out[:first], np.where(own >= least, own, 0).astype(np.float32))), np.unique(np.array(buckets, np.uint16))

        return hits


@dataclass
class LabelModel:
    """rates[c][j]: how often voter j fires on class c; weight[j]: below 1 where voters say the same; prior of class 1."""

    rates: np.ndarray
    weight: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, rates: np.ndarray | None = None) -> np.ndarray:
        low = np.log(self.rates if rates is None else rates)
        high = np.log1p(-(self.rates if rates is None else rates))
        odds = (votes * (low[1] - low[0]) + (1 - votes) * (high[1] - high[0])) @ self.weight
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + odds, -40, 40)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation over ``votes`` (rows, voters) of 0 and 1 and ``labels`` of 0 and 1, taken as the last
    voter. Returns the model without the label, and the rows' posteriors with it. No rows: the prior beliefs alone."""
    m, n = votes.shape[1], len(votes)
    believed = np.stack([np.full(m + 1, 0.01), np.full(m + 1, 0.3)])
    strength = 4.0
    believed[:, -1] = (0.02, 0.9)
    every = np.concatenate((votes, labels[:, None]), 1) if n else np.zeros((0, m + 1))
    q = 0.02 + 0.96 * labels
    model = LabelModel(believed.copy(), np.ones(m + 1), 0.1)
    for _ in range(rounds if n else 0):
        share = np.stack([1 - q, q])
        mass = share.sum(1)
        model.rates = np.clip((share @ every + strength * believed) / (mass[:, None] + strength), 1e-4, 1 - 1e-4)
        model.prior = float(np.clip((mass[1] + 1) / (n + 10), 1e-4, 1 - 1e-4))
        model.weight = np.ones(m + 1)
        together = np.zeros((m + 1, m + 1))
        for c in (0, 1):  # correlations that the class doesn't explain
            off = every - model.rates[c]
            cov = (off * share[c][:, None]).T @ off / max(mass[c], 1.0)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            together = np.maximum(together, cov / np.outer(sd, sd))
        np.fill_diagonal(together, 0)
        together[:, -1] = together[-1] = 0
        model.weight = 1 / (1 + np.where(together > 0.1, together, 0).sum(1))
        model.weight[-1] = 1.0
        q = model.posterior(every)
    own = LabelModel(model.rates[:, :-1], model.weight[:-1], model.prior)
    return own, q


@dataclass
class Classifier:
    """Weights of the voters' features and of hashed words; a text's words have a length of 1 together."""

    weights: np.ndarray
    bias: float
    words: np.ndarray

    def score(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Of texts by what ``Voters.counter`` gives for each."""
        own = np.array([self.words[b].sum() / np.sqrt(max(1, len(b))) for _, b in found])
        return 1 / (1 + np.exp(-np.clip(features(np.stack([h for h, _ in found])) @ self.weights + own + self.bias, -40, 40)))


def features(hits: np.ndarray) -> np.ndarray:
    """Per voter: whether it fired, and the logarithm of its hits."""
    return np.concatenate((hits > 0, np.log1p(hits)), 1).astype(np.float64)


def fit_voters(hits: np.ndarray, posterior: np.ndarray, model: LabelModel, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a logistic regression on the voters' features by Newton steps, drawn to the label model's own
    log-odds where rows say little."""
    low, high = np.log(model.rates), np.log1p(-model.rates)
    fired = np.clip(model.weight * (low[1] - low[0] - high[1] + high[0]), -4, 4)
    start = np.concatenate((fired / 2, fired / 2 / np.log(2)))
    w, bias = start.copy(), float(np.log(model.prior / (1 - model.prior)))
    if not len(hits):
        return np.append(w, bias)
    x = np.concatenate((features(hits), np.ones((len(hits), 1))), 1)
    full, centre = np.append(w, bias), np.append(start, bias)
    pull = np.append(np.full(len(w), ridge), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ full, -40, 40)))
        slope = x.T @ (posterior - p) - pull * (full - centre)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        full = full + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return full


def fit_classifier(hits: np.ndarray, words: list[np.ndarray], posterior: np.ndarray, model: LabelModel, ridge: float = WORD_RIDGE, rounds: int = 60) -> Classifier:
    """Logistic regression on the voters' features and the hashed words together, by L-BFGS steps from the voters' own
    fit, to which its weights are drawn, as the words' are to 0. No rows: the voters' beliefs alone."""
    start = fit_voters(hits, posterior, model)
    centre = np.concatenate((start, np.zeros(1 << WORD_BITS)))
    m, n = len(start), len(hits)
    if not n:
        return Classifier(start[:-1], float(start[-1]), centre[m:])
    x = np.concatenate((features(hits), np.ones((n, 1))), 1)
    index, many = np.concatenate([w.astype(np.int64) for w in words]), np.array([len(w) for w in words])
    ends, length = np.cumsum(many), 1 / np.sqrt(np.maximum(1, many))
    pull = np.concatenate((np.ones(m), np.full(1 << WORD_BITS, ridge)))

    def loss(full: np.ndarray) -> tuple[float, np.ndarray]:
        sums = np.concatenate(([0.0], np.cumsum(full[m:][index])))
        z = np.clip(x @ full[:m] + (sums[ends] - sums[ends - many]) * length, -40, 40)
        off = 1 / (1 + np.exp(-z)) - posterior
        slope = np.concatenate((x.T @ off, np.bincount(index, np.repeat(off * length, many), minlength=1 << WORD_BITS)))
        return float((np.logaddexp(0, z) - posterior * z).sum() + 0.5 * (pull * (full - centre) ** 2).sum()), slope + pull * (full - centre)

    full, steps = centre.copy(), []
    now, slope = loss(full)
    for _ in range(rounds):
        way, factors = slope.copy(), []
        for s, y in reversed(steps):
            factors.append(s @ way / (y @ s))
            way -= factors[-1] * y
        way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(slope)))
        for (s, y), factor in zip(steps, reversed(factors), strict=True):
            way += s * (factor - y @ way / (y @ s))
        size = 1.0
        while True:
            new, (then, new_slope) = full - size * way, loss(full - size * way)
            if then <= now - 1e-4 * size * (slope @ way) or size < 1e-6:
                break
            size /= 2
        s, y = new - full, new_slope - slope
        if s @ y > 1e-10:
            steps = [*steps[-9:], (s, y)]
        gain, full, now, slope = now - then, new, then, new_slope
        if abs(gain) < 1e-6 * max(1.0, abs(now)):
            break
    return Classifier(full[: m - 1], float(full[m - 1]), full[m:])


def ratio(pos: Column, neg: Column, all_pos: int, all_neg: int) -> Column:
    """Twice the log-likelihood ratio of a stem's counts against independence of the label."""

    def part(seen: Column, total: int, share: Column) -> Column:
        share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), share))
        return seen * F.ln(share) + (F.lit(total) - seen) * F.ln(1 - share)

    both = (pos + neg) / (all_pos + all_neg)
    return 2 * (part(pos, all_pos, pos / all_pos) + part(neg, all_neg, neg / all_neg) - part(pos, all_pos, both) - part(neg, all_neg, both))


def cover(rows: list[list[int]], names: list[str]) -> list[int]:
    """Stems, each the one that the most rows have that have fewer than ``COVER`` chosen ones yet; of equals the one with
    the shorter name. Ends where the best adds fewer than ``LEAST_ROWS``."""
    holders: dict[int, list[int]] = {}
    for row, hit in enumerate(rows):
        for k in hit:
            holders.setdefault(k, []).append(row)
    gain, need, chosen = {k: len(some) for k, some in holders.items()}, [COVER] * len(rows), []
    while gain:
        best = min(gain, key=lambda k: (-gain[k], len(names[k]), names[k]))
        if gain.pop(best) < LEAST_ROWS:
            break
        chosen.append(best)
        for row in holders[best]:
            need[row] -= 1
            if not need[row]:
                for k in rows[row]:
                    if k in gain:
                        gain[k] -= 1
    return chosen


def mine_stems(sample: DataFrame) -> tuple[str, ...]:
    """Stems that go with the label in ``sample`` (text, label): counted and tested by Spark, then chosen here so that
    each toxic row has ``COVER`` of them where it can."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            seen[label].update(stems_of(text.as_py()))
        names = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[c][s] for s in names], pa.int64()) for c in (1, 0))], names=["stem", "pos", "neg"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    all_pos, all_neg = totals.get(1, 0), totals.get(0, 0)
    if not all_pos or not all_neg:
        return ()
    pos, neg = F.col("pos"), F.col("neg")
    lift = (pos / all_pos) / ((neg + 0.5) / all_neg)
    strong = (
        by_batch(sample.select("text", "label"), count, "stem string, pos long, neg long")
        .groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where((pos >= LEAST_ROWS) & (lift >= 10)).where(ratio(pos, neg, all_pos, all_neg) >= LEAST_RATIO)
        .select("stem").collect()
    )  # fmt: skip  # each is in LEAST_ROWS toxic rows of the sample at least, so that its bound is theirs
    names = sorted(r["stem"] for r in strong)
    index = {s: k for k, s in enumerate(names)}
    if not names:
        return ()

    def found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [sorted(index[s] for s in stems_of(t.as_py()) if s in index) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32()))], names=["hit"])

    rows = [r["hit"] for r in by_batch(sample.where("label = 1").select("text"), found, "hit array<int>").collect()]
    return tuple(names[k] for k in cover(sorted(rows), names))


@dataclass
class Model:
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", label: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """A model from ``docs`` and ``labels`` (id, label 0 or 1; null labels are left out, repeated ids count as their
    greatest). ``most``: rows that it learns from at most, chosen by a hash of the id, and where ids repeat, by one of id
    and text, equal rows once. Without rows, beliefs alone."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column).agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = written(known.orderBy(F.xxhash64(id_column), id_column).limit(most), "labelled")
    # ``most`` rows of two numbers
    joined = docs.select(id_column, text_of().alias("text")).join(F.broadcast(chosen), id_column)
    sample = written(joined.select("text", "label", F.xxhash64(id_column, "text").alias("h")), "sample")
    if sample.count() > most:  # ids repeat
        last = sample.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
        sample = written(sample.where(F.col("h") <= last).dropDuplicates(["h"]), "sample")
    sample = sample.select("text", "label")
    voters = Voters(mine_stems(sample))

    def vote(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hits = voters.counter()
        rows = [hits(t.as_py()) for t in batch.column(0)]
        columns = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], names=["hits", "words", "label"])

    rows = by_batch(sample, vote, "hits binary, words binary, label int").toArrow()  # ``most`` rows
    rows = rows.sort_by([("hits", "ascending"), ("label", "ascending"), ("words", "ascending")])
    hits = np.stack([np.frombuffer(b, np.float32) for b in rows.column("hits").to_pylist()]) if rows.num_rows else np.zeros((0, len(voters.names)), np.float32)
    given = rows.column("label").to_numpy().astype(float)
    model, posterior = fit_label_model((hits > 0).astype(float), given)
    hashed = [np.frombuffer(b, np.uint16) for b in rows.column("words").to_pylist()]
    return Model(voters, model, fit_classifier(hits, hashed, posterior, model))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """Per row: id, score (0 to 1), predicted (1 from 0.5 on). Null texts count as empty and get the score of a text
    without words in which no voter fires; repeated rows are scored each; texts of any length are read whole; other
    columns are left out; an empty table gives an empty result."""

    def start() -> Function:
        hits = model.voters.counter()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            scores = model.classifier.score([hits(t.as_py()) for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[id_column, "score", "predicted"])

        return run

    return by_task(docs.select(id_column, text_of().alias("text")), start, f"`{id_column}` {dict(docs.dtypes)[id_column]}, score double, predicted int")


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fit_tables(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model that the queries use: from labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return fit(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit_tables(spark, sf_dir, docs)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs`` without the rows whose text the model predicts toxic; all columns stay."""
    names = list(columns or docs.columns)
    docs = docs.select(*names)
    at = names.index("text")

    def start() -> Function:
        hits = model.voters.counter()

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            scores = model.classifier.score([hits(t.as_py() or "") for t in batch.column(at)])
            yield batch.filter(pa.array(scores < 0.5))

        return run

    return by_task(docs, start, docs.schema)
