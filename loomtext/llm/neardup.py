"""Near-duplicate groups: MinHash signatures, a multi-index Hamming join, and exact confirmation.

A document's set holds its distinct word shingles. Its signature is ``CHUNKS * CHUNK`` b-bit MinHash values.
By pigeonhole, two signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` values have a chunk with at
most ``ERRORS`` differing values; here one error is allowed, so enumerating each chunk with each of its values
left out gives keys of which every such pair shares one. That guarantee is for the signature distance; a pair
of Jaccard similarity 0.8 misses all twelve chunks with a probability of 3 in a million.

No group's pairs are ever listed. Equal sets are one vertex. Each key's smallest vertex leads it, and each
other vertex of the key is compared, on full sets, with the leader only; links found so are contracted to
components. Where a leader's vertices are not all of one component then, one vertex of each component stands
for it: these are compared within blocks of bounded rows and bytes, in rounds, as long as the components
halve. What is left is compared across all of its components: large components have blocks of their own, small
ones share blocks, and blocks of one and the same component never meet. Tasks compare two blocks exactly, from
each vertex's difference to the leader, and return a spanning forest of components, not their links.

"Exactly" is on 64-bit hashes of shingles: of two sets of n and m shingles, two unequal shingles are taken for
equal with a probability of n * m / 2**64, one in a million million for texts of a thousand words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import Hot, Workspace, merge_levels, salt_of, salts_for, tidy

CHUNKS, CHUNK, ERRORS = 12, 6, 1
VALUES = CHUNKS * CHUNK
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
CACHE_WORDS = 100_000
BATCH_ROWS = 500

_RNG = np.random.default_rng(20_240_229)
_MUL = _RNG.integers(1, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_KEY_MUL = _RNG.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64) | np.uint64(1)
_KEY_ADD = _RNG.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles.

    A-Z are lower-cased; words are runs of other than space and \\t to \\r. A text with fewer words than a
    shingle has one for its whole sequence; one without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes both touch ASCII only
    if not found:
        return np.empty(0, np.uint64)
    hashes = []
    for w in found:
        h = cache.get(w)
        if h is None:
            if len(cache) >= CACHE_WORDS:
                cache.clear()
            h = cache[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, dtype=np.uint64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = out * _ROLL + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(out))


def signature(found: np.ndarray, step: int = 2048) -> bytes:
    """Low 16 bits of each MinHash value of a non-empty set."""
    low = (found >> np.uint64(16)).astype(np.uint32)
    best = np.full(VALUES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(low), step):
        np.minimum(best, (low[i : i + step, None] * _MUL + _ADD).min(axis=0), out=best)
    return (best & np.uint32(0xFFFF)).astype("<u2").tobytes()


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, VALUES) 16-bit values to (n, VALUES) keys: each chunk with each one of its values left out."""
    parts = signatures.reshape(-1, CHUNKS, CHUNK).astype(np.uint64) * _KEY_MUL
    return mixed(parts.sum(axis=2, keepdims=True) - parts + _KEY_ADD).reshape(-1, VALUES).view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "n", "name", "sig"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part, n, name, sig = batch.slice(i, BATCH_ROWS), [], [], []
                for text in part.column(1):
                    found = shingle_set(text.as_py(), words, cache)
                    n.append(len(found))
                    name.append(_name(found) if len(found) else None)
                    sig.append(signature(found) if len(found) else None)
                out = [part.column(0), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, f"_id {kind}, n long, name string, sig binary")


def _name(found: np.ndarray) -> str:
    return hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest()


def _keys(vertices: DataFrame, kind: str) -> DataFrame:
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").reshape(-1, VALUES)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), VALUES)))
                yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).ravel()), ids], names=["key", "id"])

    return vertices.select("id", "sig").mapInArrow(run, f"key long, id {kind}")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, kind: str) -> DataFrame:
    """(id, name, members): an identifier has as many rows as its texts have sets."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    rows = rows.join(wanted.hint("merge"), "id")  # one plan at every size

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [shingle_set(t.as_py(), words, cache) for t in part.column(1)]
                names = [_name(x) for x in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), _lists(found)], names=["id", "name", "members"])

    schema = f"id {kind}, name string, members array<long>"
    return rows.select("id", "_text").mapInArrow(run, schema).dropDuplicates(["id", "name"])


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    values = np.concatenate(found) if found else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))


def _compared(star: DataFrame, counts: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """(a, k, b, n, lost, added): the size of the k-th set of a, and what b's lacks and has beyond it.

    Members and their leader's sets are sorted into one stream, a hot leader's into several; a task holds the
    sets of one leader and passes over its members.
    """
    hot = Hot(counts, ["a"])
    members = hot.deal(star, ["b"]).join(sets.withColumnRenamed("id", "b"), "b")
    leaders = hot.send(counts.select("a").join(sets.withColumnRenamed("id", "a"), "a"))
    order = ["a", "_part", "_member", "name"]
    stream = members.select("a", "_part", F.lit(True).alias("_member"), "name", "b", "members").unionByName(
        leaders.select("a", "_part", F.lit(False).alias("_member"), "name", F.col("a").alias("b"), "members")
    )
    dealt = stream.repartition("a", "_part").sortWithinPartitions(*order)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            a, parts, member = (batch.column(i).to_pylist() for i in range(3))
            ends, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            for start in range(0, batch.num_rows, 64):
                rows, k, n, lost, added = [], [], [], [], []
                for r in range(start, min(start + 64, batch.num_rows)):
                    own = values[ends[r] : ends[r + 1]]
                    if (a[r], parts[r]) != at:
                        at, held = (a[r], parts[r]), []
                    if not member[r]:
                        held.append(own.copy())
                        continue
                    for j, leader in enumerate(held):
                        rows.append(r)
                        k.append(j)
                        n.append(len(leader))
                        lost.append(np.setdiff1d(leader, own, assume_unique=True))
                        added.append(np.setdiff1d(own, leader, assume_unique=True))
                took = pa.array(rows, pa.int64())
                out = [batch.column(0).take(took), pa.array(k, pa.int32()), batch.column(4).take(took)]
                out += [pa.array(n, pa.int32()), _lists(lost), _lists(added)]
                yield pa.RecordBatch.from_arrays(out, names=["a", "k", "b", "n", "lost", "added"])

    return dealt.mapInArrow(run, f"a {kind}, k int, b {kind}, n int, lost array<long>, added array<long>")


def _stars(edges: DataFrame) -> bool:
    """Whether every u of (u, v) has one v only, and none is a v."""
    ends = edges.groupBy("u").agg(F.count("*").alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n")).distinct())
    return ends.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("sides")).filter("n > 1 OR sides > 1").isEmpty()


def components(links: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(id, component): the smallest identifier reachable over links (a, b); only linked vertices are listed.

    Alternating large-star and small-star contraction until the edges are stars, each vertex pointing at one
    centre; every round is written to the shared folder. The edges of a hot vertex are dealt in parts, and its
    minimum is sent to each.
    """
    work = work or Workspace(links.sparkSession, "components")
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = work.write(links.filter("a <> b").select(u, v).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = Hot(least, ["u"]).join(both, least.select("u", F.least("u", "m").alias("m")), ["v"])
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        done, large = edges, work.write(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = Hot(least, ["u"]).join(large, least.select("u", "m"), ["v"])
        both_ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = met.select(F.explode(both_ends).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = work.write(small, "edges")
        work.drop(done, large)
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres)


def _relabelled(labels: DataFrame, joined: DataFrame, work: Workspace) -> DataFrame:
    """``labels`` after components were linked: ``joined`` has (a, b), both components or lone vertices."""
    moved = components(joined, work).withColumnRenamed("component", "_to")
    counts = labels.groupBy("component").agg(F.count("*").alias("n"))
    moved_c = moved.withColumnRenamed("id", "component")
    out = Hot(counts, ["component"]).join(labels, moved_c, ["id"], "left")
    out = out.select("id", F.coalesce("_to", "component").alias("component"))
    alone = moved.join(labels, "id", "left_anti").select("id", F.col("_to").alias("component"))
    return work.write(out.unionByName(alone), "labels")


def _forest(group: list[tuple], percent: int) -> tuple[list, list]:
    """Components linked by members of one block or two, exactly, from the differences to their leader.

    With L the leader's set, |x and y| = |L| - |lost_x or lost_y| + |added_x and added_y|. Elements that only
    one of them has add nothing to an intersection and take no column. Of all links, those of a spanning
    forest are returned: each component with the smallest that it reaches.
    """
    comps, n, lost, added = zip(*group)
    names, comp = np.unique(np.array(comps, dtype=object), return_inverse=True)

    def shared(parts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in parts])
        rows, total = np.repeat(np.arange(len(parts)), sizes), np.zeros((len(parts), len(parts)), np.int64)
        _, cols, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        often = counts[cols] > 1
        rows, cols = rows[often], np.unique(cols[often], return_inverse=True)[1]
        for at in range(0, int(cols.max(initial=-1)) + 1, 4096):
            dense = np.zeros((len(parts), 4096), np.float32)
            here = (cols >= at) & (cols < at + 4096)
            dense[rows[here], cols[here] - at] = 1
            total += (dense @ dense.T).astype(np.int64)  # at most 4096 each: whole numbers in float32
        np.fill_diagonal(total, sizes)
        return sizes, total

    (n_lost, both_lost), (n_added, both_added) = shared(lost), shared(added)
    size = np.array(n) - n_lost + n_added
    common = np.array(n)[:, None] - (n_lost[:, None] + n_lost[None, :] - both_lost) + both_added
    link = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(len(names))
    while True:
        near = np.where(link, label[comp][None, :], len(names)).min(axis=1)
        least = label.copy()
        np.minimum.at(least, comp, near)
        if (least == label).all():
            break
        label = least
    moved = np.nonzero(label != np.arange(len(names)))[0]
    return [names[i] for i in moved], [names[label[i]] for i in moved]


def _met(dealt: DataFrame, percent: int, kind: str) -> DataFrame:
    """Links (a, b) of components that meet in the same ``_x``, ``_y`` of ``dealt``."""
    columns = ["_x", "_y", "component", "n", "lost", "added"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, kinds = [], None, None

        def out() -> pa.RecordBatch:
            a, b = _forest(group, percent)
            return pa.RecordBatch.from_arrays([pa.array(a, kinds), pa.array(b, kinds)], names=["a", "b"])

        for batch in batches:
            kinds = batch.schema.field("component").type
            x, y, comps, n = (batch.column(i).to_pylist() for i in range(4))
            ends = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(4), batch.column(5))]
            for r in range(batch.num_rows):
                if (x[r], y[r]) != at:
                    if len(group) > 1:
                        yield out()
                    group, at = [], (x[r], y[r])
                group.append((comps[r], n[r], *(v[o[r] : o[r + 1]].copy() for o, v in ends)))
        if len(group) > 1:
            yield out()

    sorted_rows = dealt.select(*columns).repartition("_x", "_y").sortWithinPartitions("_x", "_y")
    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _blocks(count: str, size: str) -> str:
    return f"cast(greatest(ceil({count} / {BLOCK_ROWS}), ceil({size} / {BLOCK_BYTES})) as int)"


def _across(compared: DataFrame, labels: DataFrame, percent: int, kind: str, work: Workspace) -> DataFrame:
    """``labels`` after members of one leader, of different components, were compared with each other.

    Any two vertices that share a key are both compared with that key's leader, so the members of each leader
    hold every candidate pair.
    """
    star = ["a", "k"]
    slim = compared.select(*star, "b", (F.size("lost") + F.size("added") + 8).alias("_w"))
    before = None
    while True:
        rows = slim.join(labels.withColumnRenamed("id", "b"), "b", "left")
        rows = rows.select(*star, "b", F.coalesce("component", "b").alias("component"), (8 * F.col("_w")).alias("_bytes"))
        best = F.min(F.struct("b", "_bytes")).alias("_rep")
        groups = rows.groupBy(*star, "component").agg(F.count("*").alias("n"), F.sum("_bytes").alias("_bytes"), best)
        groups = work.write(groups, "groups")
        torn = groups.groupBy(*star).agg(
            F.count("*").alias("_comps"), F.sum("_rep._bytes").alias("_rep_bytes"),
            F.sum(F.when(F.col("n") <= BLOCK_ROWS // 2, F.col("n"))).alias("_pool_n"),
            F.sum(F.when(F.col("n") <= BLOCK_ROWS // 2, F.col("_bytes"))).alias("_pool_bytes"),
        ).filter("_comps > 1")
        reps = F.expr(_blocks("_comps", "_rep_bytes")).alias("_reps")
        pool = F.expr(_blocks("_pool_n", "_pool_bytes")).alias("_pool")
        torn = torn.select(*star, "_comps", reps, pool)
        total, most = torn.agg(F.coalesce(F.sum("_comps"), F.lit(0)), F.coalesce(F.max("_reps"), F.lit(0))).first()
        if not total:
            return labels
        shared = groups.join(torn, star)
        if most > 1 and (before is None or 2 * total <= before):
            # one vertex for each component, dealt in blocks within which they are compared
            block = F.pmod(F.xxhash64("component", F.lit(total)), "_reps")
            dealt = shared.select(*star, F.col("_rep.b").alias("b"), "component", F.xxhash64(*star).alias("_x"), block.alias("_y"))
            found = work.write(_met(dealt.join(compared, [*star, "b"]), percent, kind), "joined", BATCH_ROWS)
            work.drop(groups)
            if found.isEmpty():
                before = 0
            else:
                labels, before = _relabelled(labels, found, work), total
            continue
        found = work.write(_met(_paired(rows, shared, torn, compared, star, work), percent, kind), "joined", BATCH_ROWS)
        return labels if found.isEmpty() else _relabelled(labels, found, work)


def _paired(rows: DataFrame, groups: DataFrame, torn: DataFrame, compared: DataFrame, star: list[str], work: Workspace) -> DataFrame:
    """The members of torn leaders, once per pair of blocks (_x, _y) that may hold links across components."""
    large = F.col("n") > BLOCK_ROWS // 2
    own = F.when(large, F.expr(_blocks("n", "_bytes"))).alias("_own")
    plan = groups.select(*star, "component", "n", own, "_pool")
    dealt = Hot(plan, [*star, "component"]).join(rows.select(*star, "component", "b"), plan.drop("n"), ["b"])
    sub = F.coalesce(F.pmod(F.xxhash64("b"), "_own"), F.pmod(F.xxhash64("component"), "_pool")).cast("int").alias("_sub")
    whole = F.when(F.col("_own").isNotNull(), F.col("component")).alias("_whole")
    numbers = plan.filter("_own IS NOT NULL").select(*star, whole, F.explode(F.expr("sequence(0, _own - 1)")).alias("_sub"))
    pooled = torn.filter("_pool > 0").select(*star, F.explode(F.expr("sequence(0, _pool - 1)")).alias("_sub"))
    nothing = F.lit(None).cast(numbers.schema["_whole"].dataType).alias("_whole")
    every = numbers.unionByName(pooled.select(*star, nothing, "_sub"))
    blocks = work.write(every.withColumn("_no", F.monotonically_increasing_id()), "blocks")
    per = Hot(blocks.groupBy(*star).agg(F.count("*").alias("n")), star)
    x = blocks.select(*star, F.col("_whole").alias("_wx"), F.col("_no").alias("_x"))
    y = blocks.select(*star, F.col("_whole").alias("_wy"), F.col("_no").alias("_y"))
    pairs = per.join(x, y, ["_x"]).filter("_x <= _y AND coalesce(_wx <> _wy, true)")
    pairs = pairs.select("_x", "_y")
    sides = pairs.select("_x", "_y", F.explode(F.array_distinct(F.array("_x", "_y"))).alias("_no"))
    placed = dealt.select(*star, "component", "b", whole, sub)
    same = [placed[c] == blocks[c] for c in star] + [placed["_sub"] == blocks["_sub"], placed["_whole"].eqNullSafe(blocks["_whole"])]
    placed = placed.join(blocks, same).select(*[placed[c] for c in star], placed["component"], placed["b"], "_no")
    return placed.join(sides, "_no").join(compared, [*star, "b"])


def _twins(some: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of identifiers that have rows of different sets."""
    mark = F.xxhash64("name")
    twice = some.groupBy("_id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo <> hi").select("_id")
    if twice.isEmpty():
        return None
    each = some.join(twice, "_id").select("_id", "name").distinct().join(classes.select("name", "id"), "name")
    return each.join(each.groupBy("_id").agg(F.min("id").alias("a")), "_id").select("a", F.col("id").alias("b"))


def group(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept, and members (rows of equal sets) of its vertex.

    Rows are linked if 100 * |A and B| >= percent * |A or B|. component_id is the smallest identifier
    reachable over links, kept marks the row that bears it. Null, empty and blank texts have no shingles and
    are linked with nothing. A null identifier is linked with nothing, has a null component and is kept. Rows
    that repeat an identifier are one vertex, linked by each of their texts, and are all marked alike. Very
    long texts are sets like others; a set larger than a block is a block. An empty table gives an empty one.
    Other columns are not read, so none can clash.
    """
    work = Workspace(docs.sparkSession, "near")
    base = work.write(_signed(docs, id_col, text_col, words), "signatures", BATCH_ROWS)
    kind = base.schema["_id"].dataType.simpleString()
    rows = base.count()
    salts, work = salts_for(rows), work.sized(rows)
    base = base.withColumn("_salt", salt_of("_id", salts))
    some = base.filter("name IS NOT NULL AND _id IS NOT NULL")
    runs = some.select("name", "_salt", F.col("_id").alias("id"), F.lit(1).cast("long").alias("members"))
    aggs = lambda: [F.min("id").alias("id"), F.sum("members").alias("members")]
    first, last = merge_levels(runs, "name", aggs, salts)
    classes = work.write(last, "classes")
    # the signature of a class is that of any of its rows; its representative's row has one
    first_row = (F.col("_id") == F.col("id")) & (some["name"] == classes["name"])
    vertices = some.select("_id", "name", "sig").join(classes, first_row).select("id", some["name"], "sig")
    vertices = vertices.dropDuplicates(["id", "name"])
    keys = Workspace(docs.sparkSession, "near-keys").sized(VALUES * rows)
    held, keys = keys, keys.write(_keys(vertices, kind), "keys", BATCH_ROWS)
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    leaders = work.write(leaders, "leaders")
    star = Hot(leaders, ["key"]).join(keys, leaders.select("key", "leader"), ["id"]).filter("id <> leader")
    star = work.write(star.select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    held.drop(keys)
    work.drop(leaders)
    counts = star.groupBy("a").agg(F.count("*").alias("n"))
    wanted = counts.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    sets = work.write(_sets(docs, wanted, id_col, text_col, words, kind), "sets", 64)
    compared = work.write(_compared(star, counts, sets, kind), "compared", 64)
    work.drop(star, sets)
    links = compared.filter(f"100 * (n - size(lost)) >= {percent} * (n + size(added))").select("a", "b")
    twins = _twins(some, classes)
    labels = components(links if twins is None else links.unionByName(twins), work)
    labels = _across(compared, labels, percent, kind, work)
    marked = classes.join(labels, "id", "left").select("name", "members", F.coalesce("component", "id").alias("component_id"))
    rows = some.join(first.select("name", "_salt").join(marked, "name"), ["name", "_salt"])
    linked = rows.select("_id", F.col("n").alias("n_shingles"), "component_id", "members")
    alone = base.filter("name IS NULL OR _id IS NULL").select(
        "_id", F.col("n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(1).cast("long").alias("members")
    )
    kept = F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    return linked.unionByName(alone).select(F.col("_id").alias(id_col), "n_shingles", "component_id", kept, "members")
