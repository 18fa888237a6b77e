"""Properties over generated inputs, without Spark."""

from array import array

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from loomtext.llm import bpe, mixing, neardup

MERGES = bpe.MergeTable(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=300)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_chunks_do_not_change_tokens_and_decoding_restores(text, size):
    encoder = bpe.Encoder(MERGES)
    parts = b"".join(encoder.feed(text[i : i + size]) for i in range(0, len(text), size)) + encoder.finish()
    whole = bpe.Encoder(MERGES)
    assert parts == whole.feed(text) + whole.finish()
    assert bpe.decode_ids(parts, MERGES, step=3) == text
    ids = array("I")
    ids.frombytes(parts)
    assert all(i < 50257 for i in ids)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=3)), st.integers(0, 10**6), max_size=12))
def test_targets_share_all_they_may(sizes):
    got = mixing.targets(list(sizes.items()))
    total = sum(sizes.values())
    assert all(0 <= got[s] <= 2 * n for s, n in sizes.items())
    assert sum(got.values()) == min(total * 3 / 2, 2 * total) if total else not any(got.values())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    units = {got[s] / weight[s] for s in sizes if got[s] < 2 * sizes[s]}
    assert len(units) <= 1  # all below their cap have the same share of a weight


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=40), st.integers(1, 6))
def test_shingle_sets_count_distinct_runs(words, size):
    text = " ".join(words)
    want = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    found = neardup.shingle_set(text, size, {})
    assert len(found) == len(want) and list(found) == sorted(found)
    if len(found):
        assert neardup.signature(found, step=3) == neardup.signature(found)
        assert len(set(neardup.chunk_keys(np.frombuffer(neardup.signature(found), "<u2")[None])[0])) == neardup.VALUES
