import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from loomtext.llm import alignment as A
from pyspark.sql import functions as F

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    return A.Pair(open(FIRST, "rb").read(), open(SECOND, "rb").read())


def plain(pair, text):
    """Whole texts through both libraries; every pair of tokens compared. None: no tokens."""
    if not text:
        return None
    ids = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    if not pair.same((" " + text).encode(), *ids):
        return None
    spans = []
    for found, sizes in zip(ids, (pair.a_bytes, pair.b_bytes)):
        at = np.cumsum([0] + [len(sizes[i]) for i in found]).tolist()
        spans.append(list(zip(found, at, at[1:])))
    links = [(a, b) for a, x, y in spans[0] for b, u, v in spans[1] if max(x, u) < min(y, v)]
    groups, low = [], 0
    for end in sorted({y for *_, y in spans[0]} & {y for *_, y in spans[1]}):
        groups.append("|".join(",".join(str(i) for i, _, y in s if low < y <= end) for s in spans))
        low = end
    return len(ids[0]), len(ids[1]), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), Counter(links)


def made(n, seed=1):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "a", "the", "Éa", "ß", "12", "<|endoftext|>", "▁", " ", "　", "日本", "😀", "\x00", "é", "'s", ".", "...", "</s>", "<s>", "\x1c", "\x85"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(n)]


def test_units_give_what_whole_texts_give(pair):
    texts = [*made(1500), "", "x" * 3000, " ", "   ", "\n", "word " * 400]
    units = [pair.units(t) if t else [] for t in texts]
    met = A.Kept(pair).of(units)
    empty = 0
    for text, cut in zip(texts, units):
        got, want = A.document(cut, met), plain(pair, text)
        if want is None:
            empty += 1
            assert got == (0, 0, 0, 0, "", b"", b""), text
            continue
        assert got[:5] == want[:5], repr(text)
        keys, times = np.frombuffer(got[5], np.int64).tolist(), np.frombuffer(got[6], "<u4").tolist()
        assert dict(zip(keys, times)) == {b << 32 | a: n for (a, b), n in want[5].items()}
    assert 100 < empty < 1000


def test_the_operator_equals_brute_force_over_all_rows(spark, pair, monkeypatch):
    monkeypatch.setattr(A, "HELD_KEYS", 300)
    texts = [*made(300, 2), "the cat sat", "the cat sat", None, "", "the " * 700, "z" * 4000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_a int").repartition(5)
    found = [plain(pair, t) for t in texts]
    count = sum((f[5] for f in found if f), Counter())
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = {}
    for i, f in enumerate(found):
        links = f[5] if f else {}
        sums = sum(n for (a, b), n in links.items() if count[a, b] == best[b]), sum(n * count[k] for k, n in links.items())
        want[i] = (*(f[:5] if f else (0, 0, 0, 0, "")), *sums)
    out = A.compare(docs, FIRST, SECOND)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == want


def test_an_empty_table_and_rows_without_identifier(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert A.compare(empty, FIRST, SECOND).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    out = A.compare(rows, FIRST, SECOND).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in out) == [(0, 2, 4), (0, 2, 4), (1, 0, 0)]


def test_shards_are_sorted_summed_and_found_by_search(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("key"), F.lit(1).cast("long").alias("n")).repartition(6)
    manifest = A.write_shards(rows, f"file://{tmp_path}/shards").collect()
    known = A.Shards([(r["keys"], r["counts"], r["low"], r["high"]) for r in manifest])
    assert known.counts(np.arange(1000)).tolist() == [5] * 1000 and sum(r["n_keys"] for r in manifest) == 1000
    with pytest.raises(ValueError, match="in no shard"):
        known.counts(np.array([1 << 40]))
