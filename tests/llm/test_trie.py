import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from loomtext.llm import trie
from loomtext.llm.queries import ORACLES, QUERIES


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + turns[h:]
    return out


def brute(paths):
    nodes = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0 for k in nodes}
    kids = defaultdict(int)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for k, v in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(v) - 1) * words[k]
            leaves[k[:d]] += not kids[k]
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[k] if len(paths[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else -1, len(v), kids[k], leaves[k], saved[k], ends(k)) for k, v in nodes.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(seed, convs=60, turns=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 200), convs):
        for t in range(rng.randint(1, turns)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "a b", "", None, "c  d\te"])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 2), (3, 5), (4, 13), (5, 40)])
def test_nodes_equal_brute_force_however_the_points_are_dealt(spark, seed, ranges):
    rows = made(seed)
    found = trie.shared_openings(trie.threads(spark.createDataFrame(rows, SCHEMA)))
    assert got(trie.build(found, ranges)) == brute(rebuilt(rows))


def test_copies_long_threads_and_turns_that_share_a_place(spark):
    long = [(900, t, "user", f"w{t % 3} x") for t in range(120)] + [(901, t, "user", f"w{t % 3} x") for t in range(115)]
    copies = [(c, t, "user", f"same {t}") for c in range(1000, 1400) for t in range(3)]
    ties = [(5, None, "user", "b"), (5, None, "user", "a"), (5, 1, None, None), (5, 1, None, None), (None, 0, "user", "lost")]
    rows = long + copies + ties
    out = got(trie.build(trie.threads(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", name string")), 7))
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, trie_digest(role, text), role or "", text or ""))
    assert out == brute({c: [x[3:] for x in sorted(v)] for c, v in own.items()})


def trie_digest(role, text):
    return hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def test_an_empty_table_and_a_thread_without_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.build(trie.shared_openings(trie.threads(empty))).count() == 0
    single = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1)
    out = got(trie.build(trie.shared_openings(trie.threads(spark.createDataFrame([(single, 0, "user", "x")], SCHEMA)))))
    assert out == [(single, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(single).encode()).hexdigest())]


def test_identifiers_of_a_path_are_hashed_in_order_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_BITS", 3)
    rows = spark.createDataFrame([("p", i) for i in range(-50, 200, 3)] + [("q", 7)], "name string, conv_id long")
    want = {"p": range(-50, 200, 3), "q": [7]}
    assert {r.name: r.ends for r in trie._ends(rows).collect()} == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}


@pytest.mark.parametrize("name", ["op4_warc", "op7_near_dedup", "op9_exact_dedup", "op11_trie", "op12_main_text"])
def test_queries_equal_their_sql(spark, name):
    data, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(found.fetchall(), key=repr)
