import sys
from array import array
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from loomtext.llm import mixing, quality
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
from test_dedup import exact_brute, near_brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and returns, written and read again as the stages of a run are."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        found = spark.read.parquet(f"{folder}/{name}")
        out[name], docs = (docs, found), found
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay_until_the_last_stage(stages):
    assert all(after.columns == before.columns for name, (before, after) in stages.items() if name != "bpe")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_quality_keeps_what_the_model_keeps(spark, stages):
    before, after = stages["quality"]
    model = quality.fit(quality.training_rows(before, spark.read.parquet(f"{DATA}/labels.parquet")), grades=3)
    kept = {r.doc_id for r in before.collect() if model.tails(model.score(quality.features(r.text, {})))[1] >= quality.ACCEPT}
    assert {i for i, _ in rows(after)} == kept and 0 < len(kept) < before.count()


def test_exact_and_near_keep_one_of_each_group(stages):
    before, after = stages["exact_dedup"]
    assert sorted(i for i, _ in rows(after)) == [i for i, _, _, kept, _ in exact_brute(rows(before)) if kept]
    before, after = stages["near_dedup"]
    assert sorted(i for i, _ in rows(after)) == [i for i, _, root in near_brute(rows(before), 5) if i == root]


def test_mix_takes_documents_as_often_as_their_words(stages):
    before, after = stages["mixing"]
    got = Counter(i for i, _ in rows(after))
    want = Counter()
    for r in mixing.mix(before).collect():
        want[r.doc_id] = 1 if not r["size"] else max(int(r.taken > 0), int(r.taken / r["size"] + 0.5))
    assert got == +want
    words = Counter()
    for r in after.collect():
        words[r.source] += len(r.text.split())
    sizes, most = Counter(), Counter()
    for r in before.collect():
        n = len(r.text.split())
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    for s, target in mixing.targets(list(sizes.items())).items():
        assert abs(words[s] - float(target)) <= 2 * most[s]


def test_mixed_documents_come_in_the_order_of_their_slots(spark, stages):
    before = stages["mixing"][0]
    want = []
    for r in mixing.mix(before).collect():
        times = 1 if not r["size"] else max(int(r.taken > 0), int(r.taken / r["size"] + 0.5))
        for k in range(times):
            slot = r.slots[min(k, len(r.slots) - 1)] if r.slots else None
            want.append((slot is None, slot or 0, r.doc_id))
    got = [r.doc_id for r in corpus_pipeline.mixing_stage(spark, before, DATA).collect()]
    assert got == [i for *_, i in sorted(want)] and got != sorted(got)


def test_tokens_are_the_library_s(stages):
    before, after = stages["bpe"]
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = dict(rows(before))
    for r in after.collect():
        ids = array("I")
        ids.frombytes(bytes(r.token_ids))
        assert list(ids) == theirs.encode(text[r.doc_id], add_special_tokens=False).ids and len(ids) == r.n_tokens


def test_run_applies_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, stages["bpe"][1].collect()))


def test_stages_survive_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "a plain text of words", "en", "s", 9), (3, "same words here now", "en", "s", 9), (3, "same words here now", "en", "s", 9)], schema)
    for docs, least in ((odd, 1), (odd.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            assert docs.count() >= least
