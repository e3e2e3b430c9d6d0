"""Token ids of whole texts, chunk by chunk.

Blank, tab and line ends part texts into chunks, and so does the place between a letter and the marks that end its
chunk. The tokenizer drops white space and never joins what these part, so that a text's ids are its chunks' ids in
order; each task encodes a chunk once and keeps its ids in a bounded cache. ASCII letters are lower-cased first, which
the tokenizer does too, where that can't change how the text composes.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path
from unicodedata import category, is_normalized, ucd_3_2_0

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a task's cache has, about, before it starts anew; and of an entry besides its chunk and ids.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 200
#: Code points that are encoded at once.
AT_ONCE = 4_000_000
MARKS = r".,;:!?*#%$&"
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The letters that byte-level pre-tokenizers write bytes as: the byte's own where it shows, else the next from 256 on.
BYTE_NAMES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def tokenizers_of(path: str):
    """The tokenizer, and the same without normalizer and pre-tokenizer; a worker reads them once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    # a lower-case word in its composed form is what the normalizer and the pre-tokenizer leave as it is, but for its bytes' names
    bare = json.loads(Path(path).read_text()) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
    return Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(bare))


class ChunkEncoder:
    """Little-endian unsigned 32-bit ids, as bytes. The cache starts anew when it has ``most`` bytes; tasks each make
    an encoder of their own, so that it ends with them."""

    def __init__(self, path: str, most: int = CACHE_BYTES):
        self.tokenizer, self.bare = tokenizers_of(path)
        self.most, self.held, self.known = most, 0, {"": b""}

    @staticmethod
    def prepared(text: str) -> str:
        """With blanks alone between chunks, ASCII letters in lower case where the text can't compose otherwise then."""
        low = text.encode().lower().decode()
        if not low.isascii() and not (is_normalized("NFC", text) and is_normalized("NFC", low)):
            low = text
        return low.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _learn(self, new: set[str]) -> None:
        plain = [c for c in new if c.isalpha() and c == c.lower() and is_normalized("NFC", c)]
        named = [c if c.isascii() else c.encode().decode("latin-1").translate(BYTE_NAMES) for c in plain]
        other = list(new.difference(plain))
        for chunks, inputs, tokenizer in ((plain, named, self.bare), (other, other, self.tokenizer)):
            for at in range(0, len(chunks), 5000):
                found = tokenizer.encode_batch_fast(inputs[at : at + 5000], add_special_tokens=False)
                for c, e in zip(chunks[at : at + 5000], found, strict=True):
                    self.known[c] = ids = array("I", e.ids).tobytes()
                    self.held += ENTRY_BYTES + len(c) + len(ids)

    def _distinct(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of the chunks, marks that end a chunk looked up by themselves."""
        cores = [c.rstrip(MARKS) for c in chunks]
        tails: dict[int, str] = {}
        for k, (c, core) in enumerate(zip(chunks, cores, strict=True)):
            if len(c) != len(core):
                if core[-1:] in LETTERS:
                    tails[k] = c[len(core) :]
                else:
                    cores[k] = c
        need = {*cores, *tails.values()}
        new = need.difference(self.known)
        if new and self.held > self.most:
            self.held, self.known, new = 0, {"": b""}, need - {""}
        if new:
            self._learn(new)
        known = self.known
        out = [known[c] for c in cores]
        for k, tail in tails.items():
            out[k] += known[tail]
        return out

    def encode(self, text: str) -> bytes:
        if "<|" in text:  # may hold a special token's own name, which is found before lower-casing
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self._distinct(self.prepared(text).split(" ")))

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids as an array, in order; distinct chunks of some millions of code points are looked up once."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            yield from self._encode_some(texts[at:to])
            at = to

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if "<|" in t}
        lists = pc.split_pattern(pa.array(["" if k in odd else self.prepared(t) for k, t in enumerate(texts)], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        found = self._distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(found), np.uint32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        length = lengths[which]
        ends = np.cumsum(length)
        every = ids[np.repeat(firsts[which] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[lists.offsets.to_numpy()]
        for k in range(len(texts)):
            yield np.frombuffer(self.encode(texts[k]), np.uint32) if k in odd else every[bounds[k] : bounds[k + 1]]


#: Fixed value: the pattern of byte-level pre-tokenizers.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def byte_tokenizers_of(path: str):
    """A byte-level tokenizer, its merges as ranks with each id's length in bytes, and None for these where the file's
    ids aren't in the order of its merges; a worker reads them once."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    model = json.loads(Path(path).read_text())["model"]
    back = {chr(name): b for b, name in {**{b: b for b in _SHOWN}, **BYTE_NAMES}.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    joined = [model["vocab"].get(a + b) for a, b in pairs]
    tokenizer = Tokenizer.from_file(path)
    if len(back) != 256 or None in joined or joined != sorted(set(joined)) or any(model["vocab"].get(name, 1 << 30) >= joined[0] for name in back):
        return tokenizer, None, None
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if len(token) == 1 and token in back}
    ranks |= {bytes(back[c] for c in a + b): i for (a, b), i in zip(pairs, joined, strict=True)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return tokenizer, tiktoken.Encoding("own", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}), lengths


@lru_cache(maxsize=1 << 16)
def settled_kind(c: str) -> bool:
    """Whether a character is a letter, a number or neither alike in old and new versions of Unicode, so that no two
    libraries part it otherwise."""
    old, new = ucd_3_2_0.category(c)[0], category(c)[0]
    return (old in "LN" or new in "LN") <= (old == new) and c != "\u180e"


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer whose pre-tokens take a blank before them.

    A blank that is followed by what isn't white space always begins a pre-token, so that texts part there into chunks,
    whose ids are the text's in order. A chunk has its blank; more white space stays with the chunk before it. The
    different chunks of some millions of code points are encoded once and together, by the file's merges as ranks, and
    parted by their bytes; text with characters that Unicode has changed goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer, self.ranks, self.lengths = byte_tokenizers_of(path)

    def one(self, text: str) -> np.ndarray:
        if self.ranks is not None and "<|" not in text and all(map(settled_kind, set(text))):
            return np.array(self.ranks.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids as an array of unsigned 32-bit numbers, in order; some millions of code points at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= AT_ONCE):
                size += len(texts[to])
                to += 1
            yield from self._encode_some(texts[at:to])
            at = to

    def _distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, a blank before each, in order, and how many each has."""
        strange = {c for c in set().union(*words) if not settled_kind(c)}
        if self.ranks is None or strange:
            known = np.array([self.ranks is not None and (w.isascii() or strange.isdisjoint(w)) for w in words], bool)
            if not known.all():
                found = self.tokenizer.encode_batch_fast([f" {w}" for w, k in zip(words, known, strict=True) if not k], add_special_tokens=False)
                other = iter([np.array(e.ids, np.uint32) for e in found])
                ids, counts = self._distinct([w for w, k in zip(words, known, strict=True) if k]) if known.any() else (np.empty(0, np.uint32), np.empty(0, np.int64))
                rest = iter(np.split(ids, np.cumsum(counts)))
                each = [next(rest) if k else next(other) for k in known]
                return np.concatenate(each), np.array([len(e) for e in each])
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        ids = self.ranks.encode_to_numpy(f" {' '.join(words)}", disallowed_special=())
        sizes = pc.binary_length(pa.array(words, pa.large_string())).to_numpy() + 1
        stops = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "right")
        return ids, np.diff(stops, prepend=0)

    def _encode_some(self, texts: list[str]) -> Iterator[np.ndarray]:
        odd = {k for k, t in enumerate(texts) if "<|" in t}  # may hold a special token's own name
        lists = pc.split_pattern(pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        offsets = lists.offsets.to_numpy()
        loose = np.fromiter((not w or w[0].isspace() or w[0] == "\u180e" for w in words), bool, len(words))
        first = np.zeros(len(which) + 1, bool)
        first[offsets[:-1]] = True
        starts = np.flatnonzero(first[:-1] | ~loose[which])
        sizes = np.diff(starts, append=len(which))
        own = np.flatnonzero((sizes > 1) | first[starts])  # chunks that aren't a blank and one word
        glued = [("" if first[a] else " ") + " ".join([words[k] for k in which[a : a + n].tolist()]) for a, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)]
        code = which[starts].astype(np.int64)
        names = {g: len(words) + k for k, g in enumerate(dict.fromkeys(glued))}
        code[own] = [names[g] for g in glued]
        used, code = np.unique(code, return_inverse=True)
        ids, lengths = self._distinct([words[k] for k in used[used < len(words)].tolist()])
        others = list(map(self.one, names))
        ids, lengths = np.concatenate((ids, *others)), np.concatenate((lengths, [len(o) for o in others])).astype(np.int64)
        firsts, length = np.cumsum(lengths) - lengths, lengths[code]
        ends = np.cumsum(length)
        every = ids[np.repeat(firsts[code] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(starts, offsets)]
        for k in range(len(texts)):
            yield self.one(texts[k]) if k in odd else every[bounds[k] : bounds[k + 1]]
