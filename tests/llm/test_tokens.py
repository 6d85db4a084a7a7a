"""Tokenising as the tokenizers library does, and counts that follow edits."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ctxloom.llm.tokens import ByteTokenizer, PieceCounts, TokenTree

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["the", " and", "'", "'re", "'s", "s", " ", "  ", "\n", "\t \n", "12", "!?", "é", "ß", " 日本", "x" * 70, "<|endoftext|>", " ", "…"]


def text(rng: random.Random, most: int = 60) -> str:
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def test_ids_equal_the_librarys():
    engine, own, rng = Tokenizer.from_file(PATH), ByteTokenizer(PATH), random.Random(1)
    for t in ["", "a", "a<|endoftext|>b", "x" * 20_000, " " * 3000 + "y", *(text(rng) for _ in range(300))]:
        assert own.ids(t).tolist() == engine.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(40))
def test_edits_give_the_counts_of_a_new_tree(seed):
    rng, count = random.Random(seed), PieceCounts(PATH)
    tree = TokenTree(text(rng, 400), count)
    for _ in range(25):
        n = len(tree.text)
        a = rng.randrange(n + 2)
        b = min(n + 3, a + rng.choice([0, 0, 1, 2, 5, 40]))
        new = text(rng, rng.choice([1, 2, 6]))
        expected = tree.text[:a] + new + tree.text[b:]
        tree.edit(a, b, new)
        fresh = TokenTree(expected, count)
        assert tree.text == expected
        assert (tree.n_tokens, tree.n_pieces, tree.chars[1]) == (fresh.n_tokens, fresh.n_pieces, len(expected))
        assert [p for c in tree.chunks for p in c] == [p for c in fresh.chunks for p in c]
        assert tree.n_tokens == len(count.fast.encode_ordinary(expected))


def test_a_small_edit_encodes_few_pre_tokens():
    tree = TokenTree("one two three four " * 5000, PieceCounts(PATH))
    assert tree.edit(40_000, 40_003, "XYZ") < 12
