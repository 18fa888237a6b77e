"""Alignment of two tokenizers over the same bytes, and corpus-wide counts of the token pairs that it links.

Two tokens are linked if their byte ranges overlap. The ends of both tokenizers' tokens cut a text in segments;
every segment lies in one token of each, and no two segments in the same two, so the links are the segments.

A text is cut in units at every single space between two other characters, where both tokenizers begin a new
token. A unit's alignment is found once and kept, so most of a text is looked up. Links become packed keys
(second id times 2^32 plus first id). Every partition counts its keys with ``numpy.unique``; the partial counts
are range-partitioned and sorted, and one pass over a range adds runs of equal keys and writes a shard of sorted
keys and counts to the shared folder. A second pass over the documents maps the shards into memory, read-only,
and looks every key up by binary search.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.bpe import byte_symbols
from loomtext.llm.common import Workspace, materialize, scratch, tidy

UNIT_SPLIT = re.compile(r"(?<=\S) (?=\S)").split
KEPT_CHARS = 48
KEPT_UNITS = 120_000  # of each generation
CHUNK_CHARS = 1 << 16
BATCH_ROWS = 256
HELD_KEYS = 1 << 21
LOW = (1 << 32) - 1


class Pair:
    """Both tokenizers: their ids of a text, and the bytes of every id."""

    def __init__(self, first: bytes, second: bytes):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(first)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("the first tokenizer must be a plain byte-level one")
        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        symbols, added = byte_symbols(), {x["content"] for x in spec["added_tokens"]}
        by_id = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b""] * (max(by_id) + 1)
        for i, s in by_id.items():
            self.a_bytes[i] = s.encode() if s in added else bytes(symbols[c] for c in s)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes.fromhex(m[1]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        names = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_names = names(len(self.a_bytes), ","), names(len(self.a_bytes), "|")
        self.b_names = names(len(self.b_bytes), ","), names(len(self.b_bytes), ";")

    def units(self, text: str) -> list[str]:
        return UNIT_SPLIT(text) if self.splits else [text]

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + text by the first, and of text by the second, which adds the space itself."""
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text) if text else [self.space]
        return np.array(a, np.int64), np.array(b, np.int64)

    def same(self, text: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == text == b"".join(map(self.b_bytes.__getitem__, b))


#: Of a unit: counts of both tokens (the first in the low 32 bits), groups as text, link keys. None: bytes differ.
Found = tuple[int, str, bytes] | None


def align(pair: Pair, units: list[str]) -> list[Found]:
    """The alignment of each unit, all in a few calls."""
    out: dict[int, Found] = {}
    chunk: list[int] = []
    size = 0
    for k, unit in enumerate(units):
        if unit and not unit[0].isspace() and not unit[-1].isspace() and pair.splits:
            chunk.append(k)
            size += len(unit)
        else:
            out[k] = _aligned(pair, [unit])[0]
        if size >= CHUNK_CHARS:
            out.update(zip(chunk, _aligned(pair, [units[i] for i in chunk])))
            chunk, size = [], 0
    out.update(zip(chunk, _aligned(pair, [units[i] for i in chunk])))
    return [out[k] for k in range(len(units))]


def _aligned(pair: Pair, units: list[str]) -> list[Found]:
    if not units:
        return []
    text = " ".join(units)
    (a, b), whole = pair.ids(text), (" " + text).encode()
    if not pair.same(whole, a, b):
        half = len(units) // 2
        return _aligned(pair, units[:half]) + _aligned(pair, units[half:]) if half else [None]
    a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    ends = np.union1d(a_ends, b_ends)
    keys = b[np.searchsorted(b_ends, ends)] << 32 | a[np.searchsorted(a_ends, ends)]
    shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
    # a group's text: its first ids, then its second ids
    a_upto, b_upto = (np.searchsorted(x, shared, "right") for x in (a_ends, b_ends))
    a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
    parts = np.empty(len(a) + len(b), object)
    before = np.concatenate([[0], b_upto])
    parts[np.arange(len(a)) + before[a_group]] = np.where(np.isin(a_ends, shared, assume_unique=True), pair.a_names[1][a], pair.a_names[0][a])
    parts[np.arange(len(b)) + a_upto[b_group]] = np.where(np.isin(b_ends, shared, assume_unique=True), pair.b_names[1][b], pair.b_names[0][b])
    borders = np.cumsum([len(u.encode()) + 1 for u in units])
    a_at, b_at, at = (np.concatenate([[0], np.searchsorted(x, borders, "right")]) for x in (a_ends, b_ends, ends))
    counts = (np.diff(a_at) | np.diff(b_at) << 32).tolist()
    names, packed, at, part_at = parts.tolist(), keys.tobytes(), (8 * at).tolist(), (a_at + b_at).tolist()
    return [(n, "".join(names[part_at[i] : part_at[i + 1]]), packed[at[i] : at[i + 1]]) for i, n in enumerate(counts)]


class Kept:
    """Alignments of units met before, in two generations."""

    def __init__(self, pair: Pair):
        self.pair, self.new, self.old = pair, {}, {}

    def of(self, texts: list[list[str]]) -> dict[str, Found]:
        """Of every unit of the texts."""
        met, missing = {}, []
        for unit in set().union(*texts):
            if unit in self.new:
                met[unit] = self.new[unit]
            elif unit in self.old:
                met[unit] = self.new[unit] = self.old[unit]
            else:
                missing.append(unit)
        for unit, found in zip(missing, align(self.pair, missing)):
            met[unit] = found
            if len(unit) <= KEPT_CHARS:
                self.new[unit] = found
        if len(self.new) >= KEPT_UNITS:
            self.old, self.new = self.new, {}
        return met


def document(units: list[str], met: dict[str, Found]) -> tuple[int, int, int, int, str, bytes, bytes]:
    """n_a, n_b, n_groups, n_links, groups_sha256, and the distinct keys with their counts, packed."""
    found = [met[u] for u in units]
    if not found or None in found:
        return 0, 0, 0, 0, "", b"", b""
    total, groups = sum(x[0] for x in found), "".join([x[1] for x in found])
    keys = np.frombuffer(b"".join([x[2] for x in found]), np.int64)
    distinct, times = np.unique(keys, return_counts=True)
    digest = hashlib.sha256(groups[:-1].encode()).hexdigest()
    return total & LOW, total >> 32, groups.count(";"), len(keys), digest, distinct.tobytes(), times.astype("<u4").tobytes()


def _aligned_rows(docs: DataFrame, first: str, second: str, keep: tuple[str, ...], text_col: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    raw = sc.broadcast((open(first, "rb").read(), open(second, "rb").read()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*raw.value)
        kept = Kept(pair)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                texts = [pair.units(t) if (t := x.as_py()) else [] for x in part.column(len(keep))]
                met = kept.of(texts)
                columns = zip(*(document(t, met) for t in texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, columns, kinds)], names=names)

    fields = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    fields += [T.StructField("groups_sha256", T.StringType()), T.StructField("_pairs", T.BinaryType()), T.StructField("_times", T.BinaryType())]
    schema = T.StructType([*docs.select(*keep).schema.fields, *fields])
    names = schema.fieldNames()
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(run, schema)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, where = np.unique(keys, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, where, times)
    return distinct, out


def partial_counts(rows: DataFrame) -> DataFrame:
    """key, n: each partition's counts; those of more than two million keys come in several parts."""

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def shrunk() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(x) for x in zip(*held)))

        for batch in batches:
            for keys, times in zip(batch.column(0), batch.column(1)):
                if keys.as_py():
                    held.append((np.frombuffer(keys.as_py(), np.int64), np.frombuffer(times.as_py(), "<u4").astype(np.int64)))
                    size += len(held[-1][0])
                if size >= HELD_KEYS:
                    held = [shrunk()]
                    if (size := len(held[0][0])) >= HELD_KEYS // 2:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["key", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, shrunk())], names=["key", "n"])

    return rows.select("_pairs", "_times").mapInArrow(run, "key long, n long")


def write_shards(partial: DataFrame, folder: str) -> DataFrame:
    """A shard per range of keys, keys and counts as two files of 64-bit numbers; returns the manifest.

    ``best`` has, per second id of the shard, the highest count. Names hold the task attempt, and only the
    manifest, which Spark commits, says which files count.
    """

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        sinks = [store.open_output_stream(f"{root}/{kind}-{name}", compression=None) for kind in ("keys", "counts")]
        low, high, rows, best = None, None, 0, {}
        last: tuple[np.ndarray, np.ndarray] | None = None  # the run that may go on in the next batch

        def put(keys: np.ndarray, counts: np.ndarray) -> None:
            nonlocal low, high, rows
            if not len(keys):
                return
            low, high, rows = int(keys[0]) if low is None else low, int(keys[-1]), rows + len(keys)
            sinks[0].write(keys.astype("<i8").tobytes())
            sinks[1].write(counts.astype("<i8").tobytes())
            ids = keys >> 32
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            for i, n in zip(ids[starts].tolist(), np.maximum.reduceat(counts, starts).tolist()):
                best[i] = max(best.get(i, 0), n)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, counts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                keys, counts = np.concatenate([last[0], keys]), np.concatenate([last[1], counts])
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
            put(keys[:-1], counts[:-1])
            last = keys[-1:], counts[-1:]
        if last is not None:
            put(*last)
        for sink in sinks:
            sink.close()
        if rows:
            ids, most = np.array([*best], "<i8"), np.array([*best.values()], "<i8")
            row = [[f"{folder}/keys-{name}"], [f"{folder}/counts-{name}"], [low], [high], [rows], [ids.tobytes()], [most.tobytes()]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, row)], names=["keys", "counts", "low", "high", "n_keys", "best_ids", "best"])

    schema = "keys string, counts string, low long, high long, n_keys long, best_ids binary, best binary"
    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return materialize(ranged.mapInArrow(run, schema), "manifest")


class Shards:
    """Sorted count shards, mapped into memory as they are needed."""

    def __init__(self, listed: list[tuple[str, str, int, int]]):
        self.listed = sorted(listed, key=lambda x: x[2])
        self.lows = np.array([x[2] for x in self.listed], np.int64)
        self.open: dict[str, np.ndarray] = {}

    def _map(self, uri: str) -> np.ndarray:
        if uri not in self.open:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            if isinstance(store, fs.LocalFileSystem):  # a folder that all machines mount
                self.open[uri] = np.memmap(path, "<i8", "r")
            else:
                with tempfile.TemporaryFile() as copy, store.open_input_stream(path, compression=None) as source:
                    while piece := source.read(1 << 20):
                        copy.write(piece)
                    copy.flush()
                    self.open[uri] = np.memmap(copy, "<i8", "r")
        return self.open[uri]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of every key, by binary search in its shard."""
        out, shard = np.empty(len(keys), np.int64), np.searchsorted(self.lows, keys, "right") - 1
        for s in np.unique(shard).tolist():
            here = np.flatnonzero(shard == s)
            known, wanted = self._map(self.listed[s][0]), keys[here]
            at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            if not np.array_equal(known[at], wanted):
                raise ValueError("a key is in no shard")
            out[here] = self._map(self.listed[s][1])[at]
        return out


def _looked_up(rows: DataFrame, manifest: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    listed = manifest.collect()  # a row per shard; the ids are the second vocabulary's, each in a shard or two
    shards = [(r["keys"], r["counts"], r["low"], r["high"]) for r in listed]
    best = np.zeros(1 + max((int(np.frombuffer(r["best_ids"], "<i8").max()) for r in listed), default=0), np.int64)
    for r in listed:
        ids = np.frombuffer(r["best_ids"], "<i8")
        best[ids] = np.maximum(best[ids], np.frombuffer(r["best"], "<i8"))
    columns = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shards(shards)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(i, BATCH_ROWS)
                packed, times = part.column(len(columns)), part.column(len(columns) + 1)
                keys = np.frombuffer(b"".join(packed.to_pylist()), np.int64)
                weight = np.frombuffer(b"".join(times.to_pylist()), "<u4").astype(np.int64)
                count = known.counts(keys) if len(keys) else np.zeros(0, np.int64)
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (weight * (count == best[keys >> 32]), weight * count)]
                at = np.concatenate([[0], np.cumsum([len(x.as_py()) // 8 for x in packed])])
                out = [pa.array(s[at[1:]] - s[at[:-1]], pa.int64()) for s in sums]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *out], names=names)

    fields = [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    schema = T.StructType([*rows.select(*columns).schema.fields, *fields])
    names = schema.fieldNames()
    return rows.select(*columns, "_pairs", "_times").mapInArrow(run, schema)


def compare(docs: DataFrame, first: str, second: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row: ``keep``, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    ``first`` is the path of a byte-level BPE (JSON), ``second`` of a sentencepiece model; both are read on the
    driver (a few MB) and travel with the tasks. A text is read by both with a space before it and without
    special tokens. Null and empty texts, and those that one of them does not give back byte for byte, have no
    tokens: zeros and an empty digest. Ties for a second id's highest count all count as highest. Repeated rows
    each count. Very long texts are read whole; a unit without spaces is one call. An empty table gives an empty
    one; only the named columns are read, so others cannot clash unless ``keep`` names them.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "alignment")
    rows = work.write(_aligned_rows(docs, first, second, keep, text_col), "aligned", 2 * BATCH_ROWS)
    partial = work.write(partial_counts(rows), "partial")
    manifest = write_shards(partial, scratch(spark, "shards"))
    out = _looked_up(rows, manifest, keep)
    work.drop(partial)
    return out
