"""Edit-aware token counts: a segment tree over each document's pre-token leaves, kept as a column; edits re-encode only
what they touch.

A leaf ends at a border, where the tokenizer parts texts whatever else stands on either side: at white space, beside a
digit, between a letter and a mark, also in texts without blanks. So a text's count is the sum of its leaves' counts. ``count_trees`` gives each
row its leaves' (code points, tokens), which can be stored beside the text. ``apply_edits`` builds the sums from the
column, without encoding the text, and takes the row's edits in order: from the border before an edit to the one after
it the old and the new pre-tokens are encoded, their difference goes up the sums, and all else stays as it was. Leaves
that grow beyond twice their size split. The new text and the new tree are columns again, for edits to come.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import Function, by_task, text_of
from gristmill.llm.tokens import ChunkEncoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
LEAF = 512
#: Marks that are never part of a contraction or of a special token's name, and that end the context in which a letter
#: is lower-cased; letters, of which no two that meet these compose with them; letters and marks of Chinese, Japanese and Korean.
MARKS = re.escape("(){}[],;=+*/&!?#$%\"@~\\_-")
LATIN = "A-Za-zß-öø-ÿÀ-ÖØ-Þ"
EASTERN, EASTERN_MARKS = "\u4e00-\u9fa5\u3041-\u3094\u30a1-\u30fa\uac00-\ud7a3", "\u3001\u3002\u300c-\u300f\uff01\uff08\uff09\uff0c\uff1b\uff1f"
#: A place where texts part, told by the code points on its two sides alone: tokens never reach over it.
BORDER = re.compile(
    rf"(?<=[\x20\t\n\r])|(?=[\x20\t\n\r])|(?=[0-9])|(?<=[0-9])(?=[\x21-\x7e])|(?<=[{LATIN}])(?=[{MARKS}])|(?<=[{MARKS}])(?=[{LATIN}])"
    rf"|(?<=[{EASTERN}])(?=[{EASTERN_MARKS}{MARKS}])|(?<=[{EASTERN_MARKS}{MARKS}])(?=[{EASTERN}])"
)
#: Code points in which the last border is looked for at first.
NEAR = 64
TREE = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
STORED_TREE = T.ArrayType(T.StructType([T.StructField("chars", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
EDITED = {"n_tokens_edited": T.LongType(), "n_chars_edited": T.LongType(), "n_edits": T.IntegerType(), "encoded_again": T.LongType()}


def leaves(text: str, size: int = LEAF) -> list[str]:
    """``text`` in runs of at least ``size`` code points, each but the last ending at a border."""
    out, at, end = [], 0, len(text)
    while at < end:
        m = BORDER.search(text, min(end, at + size))
        to = m.start() if m else end
        out.append(text[at:to])
        at = to
    return out


def last_border(text: str) -> int:
    """The place of the last border within ``text`` or behind it, or 0."""
    near = NEAR
    while near < 2 * len(text):
        at = None
        for m in BORDER.finditer(text, max(0, len(text) - near)):
            at = m.start()
        if at:
            return at
        near *= 4
    return 0


def first_border(text: str) -> int:
    """The place of the first border within ``text`` or before it, or the end."""
    m = BORDER.search(text)
    return m.start() if m else len(text)


def meets(before: str, after: str) -> bool:
    """Whether there is a border between two texts that aren't empty."""
    return BORDER.match(before[-1] + after[0], 1) is not None


class CountTree:
    """Sums of (code points, tokens) over leaf slots, as an implicit binary tree. Slots that edits empty stay, with sums
    of 0, until a leaf splits. ``encoded``: code points that edits had encoded."""

    def __init__(self, leaf: list[str], counts: list[int], count: Callable[[str], int], size: int = LEAF):
        self.count, self.size, self.encoded = count, size, 0
        self._build(leaf or [""], counts or [0])

    def _build(self, leaf: list[str], counts: list[int]) -> None:
        self.leaf, self.base = leaf, 1 << (len(leaf) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        self.chars[self.base : self.base + len(leaf)] = map(len, leaf)
        self.tokens[self.base : self.base + len(leaf)] = counts
        for node in range(self.base - 1, 0, -1):
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def column(self) -> list[dict[str, int]]:
        """The leaves that aren't empty, as they are stored."""
        at = self.base
        return [{"chars": c, "tokens": t} for c, t in zip(self.chars[at : at + len(self.leaf)], self.tokens[at : at + len(self.leaf)], strict=True) if c]

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds code point ``at``, and the offset in it; at the end, the last slot that isn't empty."""
        at, node = min(at, max(0, self.chars[1] - 1)) if self.chars[1] else 0, 1
        while node < self.base:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.base, at

    def _set(self, slot: int, part: str, tokens: int) -> None:
        self.leaf[slot], node = part, self.base + slot
        self.chars[node], self.tokens[node] = len(part), tokens
        while node := node // 2:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _next(self, slot: int) -> int | None:
        """The next slot that isn't empty, found by the sums."""
        node = self.base + slot
        while node > 1:
            if node % 2 == 0 and self.chars[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if self.chars[2 * node] else 2 * node + 1
                return node - self.base
            node //= 2
        return None

    def _encode(self, part: str) -> int:
        self.encoded += len(part)
        return self.count(part) if part else 0

    def _part(self, whole: str, tokens: int, keep: slice) -> int:
        """The tokens of a part of ``whole`` that ends or begins at a border, by what is shorter to encode."""
        kept, rest = whole[keep], whole[: keep.start] if keep.start else whole[keep.stop :]
        return self._encode(kept) if len(kept) <= len(rest) else tokens - self._encode(rest)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the code points from ``start`` to ``end`` (clipped to the text) by ``new``."""
        total = self.n_chars
        start, end = max(0, min(start, total)), max(0, min(end, total))
        end = max(start, end)
        first, before = self.find(max(0, start - 1))  # the code point before: a new text may lengthen its chunk
        last, after = self.find(end)
        before, after = before + (start > 0), after + (end == total > 0)
        left, right, gone = self.leaf[first][:before], self.leaf[last][after:], range(first + 1, last + 1)
        # boundary context: without a border at its end, the slot's last chunk goes on in the next one
        more, ends = [], right or new or left
        while ends and (nxt := self._next(more[-1] if more else last)) is not None and not meets(ends, self.leaf[nxt]):
            more.append(nxt)
            ends = self.leaf[nxt]
        merged = left + new + right + "".join(self.leaf[k] for k in more)
        if len(merged) > 2 * self.size:
            parts = leaves(merged, self.size)
            rest = [k for k in range(len(self.leaf)) if self.leaf[k] and k != first and k not in gone and k not in more]
            cut = sum(k < first for k in rest)
            self._build(
                [*(self.leaf[k] for k in rest[:cut]), *parts, *(self.leaf[k] for k in rest[cut:])],
                [*(self.tokens[self.base + k] for k in rest[:cut]), *map(self._encode, parts), *(self.tokens[self.base + k] for k in rest[cut:])],
            )
            return
        tail = right + "".join(self.leaf[k] for k in more)
        p, q = last_border(left), first_border(tail)
        if first == last and not more:
            kept = self.tokens[self.base + first] - self._encode(self.leaf[first][p : after + q])
        else:
            kept = self._part(self.leaf[first], self.tokens[self.base + first], slice(0, p)) if p else 0
            if first == last:
                whole, tokens = self.leaf[last][before:], None  # its first part is counted above
            else:
                whole, tokens = self.leaf[last], self.tokens[self.base + last]
            whole += "".join(self.leaf[k] for k in more)
            behind = whole[len(whole) - len(tail) + q :]
            if tokens is None or not behind:
                kept += self._encode(behind)
            else:
                kept += self._part(whole, tokens + sum(self.tokens[self.base + k] for k in more), slice(len(whole) - len(behind), len(whole)))
        counted = kept + self._encode(left[p:] + new + tail[:q])
        for slot in (*gone, *more):
            if self.leaf[slot]:
                self._set(slot, "", 0)
        self._set(first, merged, counted)


def count_trees(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (with text) and its columns ``n_tokens`` and ``tree``, the leaves' (chars, tokens) in order; columns of
    these names give way. Null text counts as empty, with an empty tree; repeated rows have a tree each; a text of any
    length has one; an empty table gives an empty result."""
    docs = docs.drop("tree", "n_tokens")
    names, at = docs.columns, docs.columns.index("text")

    def start() -> Function:
        coder = ChunkEncoder(path)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            parts = [leaves(t or "") for t in batch.column(at).to_pylist()]
            counts = map(len, coder.encode_batch([p for own in parts for p in own]))
            trees = [[{"chars": len(p), "tokens": next(counts)} for p in own] for own in parts]
            totals = pa.array([sum(x["tokens"] for x in own) for own in trees], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, totals, pa.array(trees, TREE)], names=[*names, "n_tokens", "tree"])

        return run

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return by_task(docs, start, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("tree", STORED_TREE)]))


def with_edits(trees: DataFrame, edits: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``trees`` with the column ``edits``: the rows of ``edits`` (id, seq, start, end, new) by seq, for every row of the
    id. Edits of a document follow one another and so are one row's; those of a null id or of none, and null seqs, starts
    and ends, are left out; a null new text is empty."""
    by_id = (
        edits.where(F.col(id_column).isNotNull() & F.col("seq").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
        .groupBy(id_column)
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), text_of("new").alias("new")))).alias("_edits"))
    )
    plain = F.transform("_edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new")))
    return trees.drop("edits").join(by_id, id_column, "left").withColumn("edits", F.coalesce(plain, F.array())).drop("_edits")


def apply_edits(trees: DataFrame, path: str, edits: str = "edits") -> DataFrame:
    """``trees`` (text, tree, and ``edits``, an array of (start, end, new), each for the text that the ones before have
    left) with text and tree after the edits, and n_tokens_edited, n_chars_edited, n_edits and encoded_again, the code
    points that were encoded for them. Null edits are none; nulls in one are 0 and empty. A null text stays null unless
    it is edited. Other columns stay; those of the added names give way. Rows that repeat an id, or are alike, have their
    edits each; a text of any length stays one row; an empty table gives an empty result."""
    trees = trees.drop(*EDITED)
    names = trees.columns
    text_at, tree_at, edits_at = (names.index(c) for c in ("text", "tree", edits))

    def start() -> Function:
        coder = ChunkEncoder(path)

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts, new_trees, rows = [], [], []
            for value, stored, own in zip(batch.column(text_at), batch.column(tree_at), batch.column(edits_at), strict=True):
                text, at, parts = value.as_py(), 0, []
                stored = stored.as_py() or []
                for x in stored:
                    parts.append((text or "")[at : at + x["chars"]])
                    at += x["chars"]
                tree, made = CountTree(parts, [x["tokens"] for x in stored], coder.count), 0
                for e in own.as_py() or []:
                    tree.edit(*(v or 0 for v in (e["start"], e["end"])), e["new"] or "")
                    made += 1
                texts.append(tree.text() if made else text)
                new_trees.append(tree.column())
                rows.append((tree.total, tree.n_chars, made, tree.encoded))
            arrays = list(batch.columns)
            arrays[text_at], arrays[tree_at] = pa.array(texts, pa.string()), pa.array(new_trees, TREE)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*names, *EDITED])

        return run

    return by_task(trees, start, T.StructType([*trees.schema.fields, *(T.StructField(name, kind) for name, kind in EDITED.items())]))


def revision(text: Column, source: Column, lang: Column) -> Column:
    """Four edits that a document's own row gives: a tag put into the middle, the second eighth cut to a half, the last
    16 code points replaced by the first 16, and a header line."""
    n, tag = F.char_length(text), F.concat(source, F.lit("'s"))
    eighth = F.floor(n / 8).cast("int")
    half, cut = F.floor(n / 2).cast("int"), F.floor(eighth / 2).cast("int")
    then = n + F.char_length(tag) - cut
    edit = lambda a, b, new: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), new.alias("new"))
    return F.array(
        edit(half, half, tag), edit(eighth, eighth + cut, F.lit("")), edit(F.greatest(F.lit(0), then - 16), then, F.substring(text, 1, 16)), edit(F.lit(0), F.lit(0), F.concat(lang, F.lit("\n")))
    )


def op7_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, counted before and after its revision, with the tree that it has then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = vocabulary_path(VOCABULARY)
    trees = count_trees(docs.select("doc_id", text_of().alias("text"), text_of("source").alias("source"), text_of("lang").alias("lang")), path)
    edited = apply_edits(trees.withColumn("edits", revision(F.col("text"), F.col("source"), F.col("lang"))), path)
    return edited.select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_edits", F.size("tree").alias("leaves"), "encoded_again", "tree")
