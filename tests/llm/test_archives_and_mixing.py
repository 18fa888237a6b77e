import base64
import hashlib
import io
import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from loomtext.llm import fingerprint, mixing, warc
from pyspark.sql import functions as F


def test_archives_round_trip(spark):
    rng = random.Random(9)
    html = [None, "", "<p>x</p>", "é" * 90_000, "\r\n\r\nWARC/1.1\r\n"] + ["".join(rng.choice("ab<>\r\n é") for _ in range(200)) for _ in range(20)]
    rows = [(i, rng.choice(["http://a/", None, "http://é x/\r\nX: y"]), rng.choice(html)) for i in range(400)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    for least in (0, 10):
        want = {}
        for h, ids in groups.items():
            raw = h.encode()
            for i in ids:
                again = len(raw) >= least and i != max(ids)
                want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", max(ids) if again else None)
        got = warc.round_trip(pages, least_bytes=least, with_payload=True).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
        assert all(bytes(r.payload) == (rows[r.page_id][2] or "").encode() for r in got if r.record_type == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_null_and_repeated_ids(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (1, "u", "a"), (7, "u", "a"), (7, "u", "a"), (None, "u", "b")], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == Counter({(None, "revisit", 7): 1, (1, "revisit", 7): 1, (7, "response", None): 2, (None, "response", None): 1})


def test_every_revisit_names_a_record_of_the_archives(spark):
    rows = [(f"p {k}\r\né", "http://a/", f"<p>{k % 4}</p>") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    manifest, found = warc.write(pages), []
    for r in manifest.collect():
        with open(r.archive.removeprefix("file:"), "rb") as f:
            found += [warc.parse(m).fields for m in warc.members(f)]
    known = {x["warc-record-id"]: x for x in found}
    again = [x for x in found if x["warc-type"] == "revisit"]
    assert len(known) == 60 and len(again) == 56
    assert all(known[x["warc-refers-to"]]["warc-type"] == "response" for x in again)
    assert all(known[x["warc-refers-to"]]["warc-payload-digest"] == x["warc-payload-digest"] for x in again)
    got = {r.page_id: r.refers_to for r in warc.read(spark, manifest, id_type="string").collect()}
    best = {h: max(i for i, _, g in rows if g == h) for _, _, h in rows}
    assert got == {i: None if best[h] == i else best[h] for i, _, h in rows}


def test_a_revisit_without_its_response_fails(spark, tmp_path):
    date = "2000-01-01T00:00:00Z"
    for k, (payload, fails) in enumerate(((b"same", False), (b"other", True))):
        path = tmp_path / f"{k}.warc.gz"
        path.write_bytes(warc.record(2, "u", payload, None, False, date) + warc.record(1, "u", b"same", 2, True, date))
        manifest = spark.createDataFrame([(f"file://{path}", 2)], "archive string, n_records long")
        if fails:
            with pytest.raises(Exception, match="no response"):
                warc.read(spark, manifest).collect()
        else:
            assert {(r.page_id, r.refers_to) for r in warc.read(spark, manifest).collect()} == {(2, None), (1, 2)}


def test_reader_finds_damage():
    good = warc.record(1, "u", b"hello", None, False, "2000-01-01T00:00:00Z")
    both = list(warc.members(io.BytesIO(good)))
    assert warc.verified(warc.parse(next(warc.members(io.BytesIO(good + good)))))[0] == 5 and len(both) == 1
    import zlib

    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"hello", b"jello"), plain.replace(b"\r\nContent-Length: 5\r\n", b"\r\nContent-Length: 6\r\n"), plain[:-2], b"nonsense\r\n\r\n"):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises((warc.Broken, KeyError)):
            warc.verified(warc.parse(next(warc.members(io.BytesIO(packer.compress(bad) + packer.flush())))))
    with pytest.raises(warc.Broken):
        for member in warc.members(io.BytesIO(good[:-9])):
            warc.parse(member)


def test_targets_fill_up_to_the_cap():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)])
    assert got["a"] == 20 and got["c"] == 0 and got["b"] == 200 and sum(got.values()) == 1665
    assert got[None] == 1445


def test_mix_reaches_targets(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", "d", None]), " ".join(["w"] * rng.choice([0, 1, 5, 300, 4000]))) for i in range(900)] + [(3, "hot", "w w"), (3, "hot", "w w"), (None, "b", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, taken int")
    out = mixing.mix(docs, block_words=64).collect()
    assert len(out) == len(rows)
    size, took, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r["size"]
        size[r.source] += r["size"]
        took[r.source] += r.taken
        target[r.source] = r.target
    want = mixing.targets(list(size.items()))
    for s in size:
        assert target[s] == float(want[s]) and 0 <= target[s] - took[s] < 1
    again = mixing.mix(docs.repartition(7), block_words=64).collect()
    order = lambda rs: sorted(map(str, rs))
    assert order(out) == order(again)
    assert mixing.mix(docs.limit(0)).count() == 0


def mixed_brute(rows, hashes, block, cap=2):
    """Words taken and first slots of every row, document by document."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    goals = mixing.targets(list(sizes.items()))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    take = [int(goals[s]) for s in order]
    blocks = [-(-t // block) for t in take]
    edges = [sum(blocks[: i + 1]) * 2**32 // max(sum(blocks), 1) for i in range(len(blocks))]
    rank, slots, total = Counter(), {}, sum(blocks)
    for slot in range(total):
        point = slot % 2**31 * mixing.GOLDEN % 2**32
        source = min(next((i for i, e in enumerate(edges) if point < e), len(blocks) - 1), max(i for i, n in enumerate(blocks) if n))
        slots[source, rank[source]] = slot
        rank[source] += 1
    out = {}
    for no, source in enumerate(order):
        at = 0
        own = sorted((hashes[i], i, n) for i, s, n in rows if s == source)
        for _, i, n in own:
            taken, first = 0, []
            for p in range(cap):
                a = at + p * sizes[source]
                b = min(a + n, take[no])
                if n and a < take[no]:
                    taken += b - a
                    first.append(slots.get((no, a // block), total + no))
            out[i] = (n, taken, first)
            at += n
    return out


def test_mix_equals_a_plain_version_and_follows_the_schedule(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice([0, 1, 7, 90, 800])) for i in range(300)]
    docs = spark.createDataFrame([(i, s, "w " * n if n else rng.choice(["", None])) for i, s, n in rows], "doc_id long, source string, text string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.expr("pmod(xxhash64(17, doc_id), 2147483648)").alias("h")).collect()}
    got = {r.doc_id: (r["size"], r.taken, r.slots) for r in mixing.mix(docs, block_words=64).collect()}
    assert got == mixed_brute(rows, hashes, 64)
    monkeypatch.setattr(mixing, "GOLDEN", 1)  # another schedule
    other = {r.doc_id: (r["size"], r.taken, r.slots) for r in mixing.mix(docs, block_words=64).collect()}
    assert other != got and {i: x[:2] for i, x in other.items()} == {i: x[:2] for i, x in got.items()}


def test_any_stretch_of_the_schedule_is_near_the_weights(spark):
    blocks = [500, 300, 150, 49, 1]
    slots = [r.source_no for r in mixing.schedule(spark, blocks).orderBy("slot").collect()]
    assert Counter(slots) == Counter({i: n for i, n in enumerate(blocks)})
    for a in range(0, 900, 50):
        part = Counter(slots[a : a + 100])
        assert all(abs(part[i] - n / 10) <= 5 for i, n in enumerate(blocks))


def test_fingerprints(spark):
    rng = random.Random(11)
    texts = [None, "", "one", "a b c", "é🎉 x"] + [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 300, 2000]))) for _ in range(60)]
    docs = spark.createDataFrame([(i * 5, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    rows = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    ids = sorted(rows, reverse=True)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    errors = []
    for k, i in enumerate(ids):
        text, after = texts[i // 5] or "", texts[ids[(k + 1) % len(ids)] // 5] or ""
        third = len(text) // 3
        edit = text[: len(text) - third] + after[:third]
        r = rows[i]
        assert (r.n_chars, r.edited) == (len(text), edit)
        errors += [r.near_edited - alike(shingles(text.split()), shingles(edit.split())), r.near_next - alike(shingles(text.split()), shingles(after.split()))]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors)) / len(errors) < 0.01
    twin = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, "x y"), (2, "q")], "doc_id long, text string")
    out = fingerprint.compare(twin).collect()
    assert len(out) == 4 and len({r.fingerprint for r in out if r.n_chars == 11}) == 1
    alone = next(r for r in out if r.doc_id is None)
    assert alone.near_next == 1.0 and alone.edited == "x x"[:2] + "x"
    assert fingerprint.compare(twin.limit(0)).count() == 0


def test_densified_bins_keep_likeness(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(" ".join(words), " ".join(words[:-k])) for k in range(1, 20)]
    prints = [fingerprint.packed(F.col(c)) for c in "ab"]
    out = spark.createDataFrame(rows, "a string, b string").select(fingerprint.likeness(*prints).alias("x")).collect()
    assert all(abs(r.x - (36 - k) / 36) < 0.3 for k, r in enumerate(out, 1))


def hashed(*longs, seed=42):
    """Spark's xxhash64 of long columns: each is hashed with the hash before it as the seed."""
    for x in longs:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", x % 2**64), seed)
    return seed


def plain_print(text):
    """One-permutation MinHash with densification, bin by bin."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t-\r]+", text or "") if w]
    if not words:
        return []
    shingles = [words[i : i + 5] for i in range(len(words) - 4)]
    if shingles:
        hashes = {hashed(*x) for x in shingles}
    else:  # an array is hashed element by element
        hashes = {hashed(*words)}
    bins = {}
    for h in hashes:
        at = h >> 56 ^ 128  # bins lie in the order of signed hashes
        bins[at] = min(bins.get(at, h), h)
    draws, out = fingerprint._draws(), []
    for k in range(256):
        tries = [k, *draws[k * 16 : k * 16 + 16]]
        held = next((bins[b] for b in tries if b in bins), None)
        if held is None:
            order = {b: hashed(b ^ 128, seed=xxhash.xxh64_intdigest(struct.pack("<i", k), 42)) for b in bins}
            held = bins[min(bins, key=lambda b: order[b] - (order[b] >> 63 << 64))]
        out.append(held & 255)
    return out


def test_fingerprint_bits_equal_a_plain_one_permutation_minhash(spark):
    rng = random.Random(21)
    sizes = [0, 1, 3, 4, 5, 6, 9, 40, 300, 2000, 60_000]
    texts = [None, "", " \t", *(" ".join(f"w{rng.randrange(900)}é" for _ in range(n)) for n in sizes)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r.doc_id: r for r in docs.select("doc_id", fingerprint.fingerprint(F.col("text")).alias("x")).collect()}
    plain = [plain_print(t) for t in texts]
    assert [bytes.fromhex(rows[i].x) for i in range(len(texts))] == [bytes(p) for p in plain]
    likely = {r.doc_id: r for r in fingerprint.compare(docs).collect()}
    for i in range(1, len(texts)):
        a, b = plain[i], plain[i - 1]
        same = sum(x == y for x, y in zip(a, b)) / 256
        want = 1.0 if a == b else 0.0 if not a or not b else min(1.0, max(0.0, (same - 1 / 256) / (1 - 1 / 256)))
        assert abs(likely[i].near_next - want) < 1e-12
