import random
from array import array

import public_tokenizers
import pytest
from loomtext.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeTable(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def cases():
    rng = random.Random(1)
    fixed = ["", " ", "a" * 5000, " " * 70000 + "x", "the" * 20000, "\n \t x'y're 'll", "<|endoftext|>x<|endo", "日本語" * 9000, "'" * 70000 + "s", "x" * 65533 + "'re y", "=" * 150000]
    for _ in range(60):
        letters = rng.choice(["ab", "the ", "Thentiongre ,.'s\n", "=-_ ", "日本 語a", "'srtvemld "])
        fixed.append("".join(rng.choice(letters) for _ in range(rng.choice([5, 50, 900]))))
    return fixed


@pytest.mark.parametrize("window", [3, 700, 1 << 16])
def test_ids_equal_the_library_at_any_chunk_size(merges, theirs, monkeypatch, window):
    monkeypatch.setattr(bpe, "TEXT_WINDOW", window)
    for text in cases():
        if window < 100 and len(text) > 1000:
            continue
        got = array("I")
        got.frombytes(bpe.encode_text(text, merges))
        want = theirs.encode(text, add_special_tokens=False).ids
        assert list(got) == want, repr(text[:60])
        assert bpe.decode_ids(got.tobytes(), merges) == theirs.decode(want, skip_special_tokens=False)


def test_lookahead_bounds_what_a_continuation_changes(merges):
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("theinga rsto") for _ in range(600)).encode()
        ids, covered = merges.stable(text)
        longer = merges.merge(text + bytes(rng.choice(b"theinga rsto") for _ in range(40)))
        assert longer[: len(ids)] == ids and covered >= len(text) - merges.lookahead - 200


def test_the_state_stays_small_on_an_endless_run(merges):
    encoder, most = bpe.Encoder(merges), 0
    for _ in range(40):
        encoder.feed("a" * 10_000)
        most = max(most, len(encoder.carry))
    assert most <= 3 * merges.window


def test_decoder_holds_back_incomplete_characters(merges):
    decoder = bpe.Decoder(merges)
    ids = array("I")
    ids.frombytes(bpe.encode_text("é🎉日", merges))
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "é🎉日"
    assert bpe.decode_ids(array("I", [merges.base[0xE6]]).tobytes(), merges) == "�"


def test_rows_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "hello world", 9), (3, "hello world", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in out) == [(1, 0, ""), (2, 0, ""), (3, 2, "hello world"), (3, 2, "hello world")]
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0


def test_merges_out_of_order_are_refused():
    import json

    spec = json.loads(open(PATH, "rb").read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        bpe.MergeTable(json.dumps(spec))
