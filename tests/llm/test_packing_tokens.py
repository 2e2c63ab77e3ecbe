"""Ids against the named tokenizer as it is loaded, with white space of every kind and the added token."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from factorloom.llm import packing  # noqa: E402

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(encoder, text):
    assert np.frombuffer(encoder(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text[:80])


@pytest.mark.parametrize("text,ids", [("a \u00a0 \u00a0 b", [64, 11504, 275]), ("<|endoftext|>", [50256]), ("x<|endoftext|> y", [87, 50256, 331])])
def test_known_ids(text, ids):
    assert np.frombuffer(packing.Encoder(*packing.vocabulary_paths())(text), "<u4").tolist() == ids


def test_white_space_and_added_tokens():
    encoder, r = packing.Encoder(*packing.vocabulary_paths()), random.Random(7)
    spaces = [" ", " ", "  ", "\n", "\t", "\u00a0", " \u00a0", " \u00a0 \u00a0", "\r\n", "\v", "\f", "\u1680", "\u2003", "\u2028", "\u202f", "\u3000"]
    odd = ["\x1c", "\x1f", "\x85", "\u180e", "\u200b", "\ufeff"]
    bits = ["the", "don't", "'s", "x" * 90, "12", "a.b", "!?", "\u00e9", "\u4e2d\u6587", "<|endoftext|>", "<|endof", "text|>", "\U0001f600", "e\u0301"]
    for k in range(1500):
        own = spaces + bits + (odd if k % 3 == 0 else [])
        check(encoder, "".join(r.choice(own) for _ in range(r.randrange(1, 40))))


def test_common_characters_in_words():
    """Every character that the faster library may get, beside letters, digits, signs and itself."""
    encoder, r = packing.Encoder(*packing.vocabulary_paths()), random.Random(8)
    common = [chr(k) for k in range(0x250) if not packing.ODD(chr(k))]
    for c in common:
        check(encoder, f" a{c}b {c}{c} 1{c}2 .{c}, {c}'s<|{c} {c}ing")
    for _ in range(4000):
        check(encoder, "".join(r.choice(common) for _ in range(r.randrange(1, 30))))
        check(encoder, "".join(r.choice("abcdefghij rstuüéöß'<|>endoftext.,0123456789\n ") for _ in range(r.randrange(1, 40))))


def test_every_character_beside_spaces():
    encoder = packing.Encoder(*packing.vocabulary_paths())
    for k in range(0x3100):
        check(encoder, f"a {chr(k)} {chr(k)}b{chr(k)}\n c")
