"""Words cut before marks have the ids that the library gives the whole."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spindrift.llm import tokens

PATH = public_tokenizers.path(tokens.TOKENIZER)


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)


def same(both, texts):
    plain, own = both
    ids, ends = own.encode_column(pa.array(texts), None)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, w, a, b in zip(texts, want, ends, ends[1:], strict=False) if ids[a:b].tolist() != w]
    assert not wrong, wrong[:5]


def test_every_letter_before_every_mark(both):
    letters = [chr(c) for c in range(0x30, 0x250)]
    same(both, [f"{head}{c}{m}{tail}" for c in letters for m in tokens.MARKS for head, tail in (("", ""), ("B", ""), ("İ", "x"))])


def test_random_texts_with_letters_of_two_small_ones(both):
    r = random.Random(7)
    pool = "abcXYZ019 İİıéßÿŁǅ" + tokens.MARKS + "'" + "\n"
    same(both, ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(20_000)])
