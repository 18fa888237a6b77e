import random

from loomtext.llm import bpe, fingerprint
from loomtext.llm.queries import vocabulary_path


def test_fingerprints_of_very_long_texts(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefgh") * rng.randint(1, 6) + str(rng.randint(0, 400)) for _ in range(20_000)]
    texts = [" ".join(words), " ".join(words), "z" * 1_000_000, " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    assert out[0].fingerprint == out[1].fingerprint != out[3].fingerprint
    assert [out[i].n_chars for i in range(4)] == [len(t) for t in texts]
    assert out[1].near_next == 1.0 and out[3].near_next < 0.2


def test_encoding_null_identifiers_and_very_long_texts(spark):
    rows = [(None, "a b"), (1, None), (2, "x" * 1_000_000), (3, "word " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in bpe.encode(docs, vocabulary_path(), decoded="decoded").collect()}
    assert {i: r.decoded for i, r in out.items()} == {i: t or "" for i, t in rows}
    assert out[None].n_tokens == 2 and out[1].n_tokens == 0
