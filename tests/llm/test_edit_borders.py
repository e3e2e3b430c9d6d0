"""Borders that leaves end at: exact under any edit, and few code points encoded where texts have no blanks."""

import base64
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from gristmill.llm import edit_counts
from gristmill.llm.tokens import ChunkEncoder, vocabulary_path

VOCAB = vocabulary_path("word_bpe_49k.json")
CODER: dict = {}
ODD = "ab1.,;:'\"()<|>=-_&sStT \n\téÉΣσςßİıŉ中文か゛がガ、。！９½̸゙́̈‍­😀"


def coder():
    return CODER.setdefault("one", ChunkEncoder(VOCAB))


def tree_of(text, size):
    leaf = edit_counts.leaves(text, size) or [""]
    return edit_counts.CountTree(leaf, [coder().count(p) for p in leaf], coder().count, size)


@settings(max_examples=400, deadline=None)
@given(st.text(ODD, max_size=12), st.text(ODD, max_size=12))
def test_borders_part_any_two_texts(left, right):
    text = left + right
    if left and right and edit_counts.meets(left, right):
        assert coder().count(text) == coder().count(left) + coder().count(right), (left, right)


@settings(max_examples=250, deadline=None)
@given(st.text(ODD, max_size=60), st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70), st.text(ODD, max_size=5)), max_size=6))
def test_any_edits_of_odd_texts(text, edits):
    tree = tree_of(text, 4)
    for a, b, new in edits:
        tree.edit(a, b, new)
        a = min(a, len(text))
        text = text[:a] + new + text[max(a, min(b, len(text))) :]
        assert tree.text() == text and tree.total == coder().count(text)


def test_texts_without_blanks_encode_few_leaves():
    rng = random.Random(3)
    kinds = {
        "chinese": "".join(rng.choice("的一是不了人我在有他这为之大来以个中上们") if rng.random() < 0.9 else "，。" [rng.randrange(2)] for _ in range(100_000)),
        "base64": base64.b64encode(rng.randbytes(75_000)).decode(),
        "minified": "".join(rng.choice(["a(b)", "{return", "x=y;", "f[0]", "&&g", "!h,"]) for _ in range(25_000)),
    }
    for name, text in kinds.items():
        tree = tree_of(text, edit_counts.LEAF)
        assert max(map(len, tree.leaf)) < 2 * edit_counts.LEAF, name
        for _ in range(20):
            at, new = rng.randrange(len(text)), rng.choice("xy中1,")
            tree.edit(at, at + rng.randrange(2), new)
        assert tree.encoded < 20 * 3 * 2 * edit_counts.LEAF and tree.total == coder().count(tree.text()), name


def test_one_run_of_letters_is_one_token_s_context():
    text = "a" * 5000
    tree = tree_of(text, edit_counts.LEAF)
    tree.edit(2500, 2500, "b")
    assert tree.total == coder().count(text[:2500] + "b" + text[2500:]) and len(tree.leaf) == 1
