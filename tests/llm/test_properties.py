"""Properties of the kernels."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import packing, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.none() | st.text(st.characters(codec="utf-8"), max_size=40) | st.text("aB \n\t\x0b\x1cé", max_size=40), max_size=8)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words_are_the_pattern(rows):
    raw, offsets = words.utf8(pa.array(rows, pa.string()))
    starts, lengths, first = words.word_spans(raw, offsets)
    got = [[bytes(raw[s : s + n]) for s, n in zip(starts[a:b], lengths[a:b])] for a, b in zip(first, first[1:])]
    assert got == [WORD.findall((r or "").encode()) for r in rows]


@given(texts, st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_shingles_depend_on_their_words_alone(rows, k):
    raw, offsets = words.utf8(pa.array(rows, pa.string()))
    starts, lengths, first = words.word_spans(raw, offsets)
    h, bounds = words.shingle_hashes(words.hash_words(raw, starts, lengths), first, k)
    seen: dict = {}
    for r, a, b in zip(rows, bounds, bounds[1:]):
        w = WORD.findall((r or "").encode().lower())
        want = [tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
        assert len(want) == b - a
        for key, x in zip(want, h[a:b].tolist()):
            assert seen.setdefault(key, x) == x
    assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 5000), max_size=60), st.sampled_from([16, 100, 2048]))
@settings(max_examples=100, deadline=None)
def test_packing_keeps_every_token_once(lengths, size):
    lengths = np.array(lengths, np.int64)
    doc, start, length, seq = packing.pack_lengths(lengths, size)
    assert (length > 0).all() and (not len(seq) or np.bincount(seq, length).max() <= size)
    for d in range(len(lengths)):
        parts = sorted(zip(start[doc == d], length[doc == d]))
        end = 0
        for s, n in parts:
            assert s == end
            end += n
        assert end == lengths[d]
