"""Byte-pair encoding as a bounded-lookahead transducer, and its incremental inverse.

How far the end of a text can change tokens to its left depends on the merge list alone. Apply the merges
in rank order to a text and to the same text with more appended: the two token sequences agree left of a
frontier, which starts at the shorter text's end. Merge (a, b) moves the frontier only if an ``a`` ends at
it, to the start of that ``a``; afterwards the token that starts there has ``a`` on its left spine. So every
sequence of moves is a chain of merges of increasing rank, where each next merge's right part has the
previous merge's left part on its left spine, and the longest chain, weighed by the left parts' lengths,
bounds the movement. ``MergeTable.lookahead`` is that bound, found in one pass over the merges.

A token is stable, and is emitted, once it ends at least ``lookahead`` bytes before the end of what was
read. What follows a stable token is tokenised as if it stood alone (no merge ever crossed the boundary),
so the state kept is one window, whatever the text's length.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomtext.llm.common import tidy

# Fixed value: the public pattern by which byte-level BPE splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

TEXT_WINDOW = 1 << 16
CACHE_PIECES = 150_000  # of each generation
CACHED_BYTES = 64
NO_MERGE, ID_BITS = 1 << 60, (1 << 20) - 1


def byte_symbols() -> dict[str, int]:
    """Symbol to byte: printable Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Ranks, ids and bytes of a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, raw: str | bytes):
        spec = json.loads(raw)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip, normalise or match words only are not supported")
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        self.added = added
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items()} | {i: s.encode() for s, i in added.items()}
        self.base = [0] * 256
        for s, b in symbols.items():
            self.base[b] = vocab[s]
        self.merged: dict[int, int] = {}  # pair of ids to rank and new id, 20 bits each
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.merged[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        self.lookahead = self._lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.window = 4 * self.lookahead + 256
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(SPLIT_PATTERN)

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        made, known = set(), set(self.base)
        spine_parent: dict[int, int] = {}
        chain: dict[int, int] = {}
        longest = 0
        for a, b, c in merges:
            if c in made or not known.issuperset((a, b)):
                raise ValueError("merges must make each token once, after its parts")
            reach, t = 0, b
            while t is not None:
                reach, t = max(reach, chain.get(t, 0)), spine_parent.get(t)
            moved = len(self.bytes_of[a]) + reach
            chain[a] = max(chain.get(a, 0), moved)
            longest = max(longest, moved)
            made.add(c)
            known.add(c)
            spine_parent[c] = a
        return longest

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of a piece that fits a window, lowest rank first, leftmost first."""
        base, get = self.base, self.merged.get
        ids = [base[b] for b in piece]
        if len(ids) > 40:
            return self._merge_heap(ids)
        found = [get(a << 20 | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NO_MERGE:
            i = found.index(best)
            ids[i : i + 2] = [new := best & ID_BITS]
            del found[i]
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], NO_MERGE)
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, NO_MERGE)
        return ids

    def _merge_heap(self, ids: list[int]) -> list[int]:
        n, merged = len(ids), self.merged
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs = ((i, merged.get(ids[i] << 20 | ids[i + 1])) for i in range(n - 1))
        heap = [(m >> 20, i, ids[i], ids[i + 1], m & ID_BITS) for i, m in pairs if m is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := merged.get(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(heap, (m >> 20, p, ids[p], ids[q], m & ID_BITS))
        return [x for x in ids if x >= 0]

    def stable(self, buffer: bytes) -> tuple[list[int], int]:
        """Ids that no continuation of the buffer changes, and how many bytes they cover.

        The cover ends between characters, so that what is left is text again.
        """
        ids = self.merge(buffer)
        limit, at, keep, covered = len(buffer) - self.lookahead - 8, 0, 0, 0
        for k, i in enumerate(ids, 1):
            at += len(self.bytes_of[i])
            if at > limit:
                break
            if buffer[at] & 0xC0 != 0x80:
                keep, covered = k, at
        return ids[:keep], covered


class PieceCache:
    """Ids of pieces met before, in two generations: when the new one is full the old one goes."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, piece: str, packed: bytes) -> None:
        if len(self.new) >= CACHE_PIECES:
            self.old, self.new = self.new, {}
        self.new[piece] = packed


class Encoder:
    """Text in pieces of any length in, packed little-endian 32-bit ids out, as soon as they are stable."""

    def __init__(self, merges: MergeTable, cache: PieceCache | None = None):
        self.merges, self.cache, self.carry = merges, cache or PieceCache(), ""

    def _piece(self, piece: str) -> bytes:
        if (packed := self.cache.old.get(piece)) is not None:
            self.cache.put(piece, packed)
            return packed
        raw = piece.encode("utf-8", "surrogatepass")
        out = array("I")
        while len(raw) > self.merges.window:
            size = self.merges.window
            ids, covered = self.merges.stable(raw[:size])
            while not covered and size < len(raw):
                size *= 2
                ids, covered = self.merges.stable(raw[:size])
            if not covered:
                break
            out.extend(ids)
            raw = raw[covered:]
        out.extend(self.merges.merge(raw))
        packed = out.tobytes()
        if len(piece) <= CACHED_BYTES:
            self.cache.put(piece, packed)
        return packed

    def _pieces(self, pieces: list[str]) -> bytes:
        cache, known = self.cache, []
        for p in pieces:
            packed = cache.new.get(p)
            known.append(self._piece(p) if packed is None else packed)
        return b"".join(known)

    def feed(self, text: str) -> bytes:
        """The last four pieces wait: nothing in the pattern looks further than three characters ahead."""
        buffer = self.carry + text
        pieces = self.merges.split.findall(buffer)
        done, held = pieces[:-4], pieces[-4:]
        out = self._pieces(done)
        self.carry = "".join(held)
        if len(self.carry) > 2 * self.merges.window:
            out += self._long_run(held)
        return out

    def _long_run(self, held: list[str]) -> bytes:
        """A run longer than the window is emitted while it still grows."""
        k = max(range(len(held)), key=lambda i: len(held[i]))
        if k < len(held) - 1:  # it has ended; only what follows it waits
            self.carry = "".join(held[k + 1 :])
            if len(self.carry) >= 4:
                return self._pieces(held[: k + 1])
            self.carry = "".join(held)
            return b""
        out, raw = array("I"), held[k].encode("utf-8", "surrogatepass")
        while len(raw) > self.merges.window:
            ids, covered = self.merges.stable(raw[: self.merges.window])
            if not covered:
                break
            out.extend(ids)
            raw = raw[covered:]
        self.carry = raw.decode("utf-8", "surrogatepass")
        return self._pieces(held[:k]) + out.tobytes()

    def finish(self) -> bytes:
        out, self.carry = self._pieces(self.merges.split.findall(self.carry)), ""
        return out


def encode_text(text: str | None, merges: MergeTable, cache: PieceCache | None = None) -> bytes:
    """Packed ids of a whole text; a null text counts as empty. Strings of added tokens become those tokens."""
    cache = cache or PieceCache()
    parts = merges.added_pattern.split(text or "") if merges.added_pattern else [text or ""]
    out: list[bytes] = []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(array("I", [merges.added[part]]).tobytes())
            continue
        encoder = Encoder(merges, cache)
        out.extend(encoder.feed(part[i : i + TEXT_WINDOW]) for i in range(0, len(part), TEXT_WINDOW))
        out.append(encoder.finish())
    return b"".join(out)


class Decoder:
    """Ids in, text out: token bytes run through an incremental UTF-8 automaton that holds at most 3 bytes."""

    def __init__(self, merges: MergeTable):
        self.bytes_of, self.automaton = merges.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.automaton.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.automaton.decode(b"", True)


def decode_ids(packed: bytes | None, merges: MergeTable, step: int = 1 << 14) -> str:
    """Text of packed ids, special tokens included; null counts as no ids."""
    ids, decoder = array("I"), Decoder(merges)
    ids.frombytes(packed or b"")
    return "".join([decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)] + [decoder.finish()])


def _rows(batch: pa.RecordBatch, step: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def encode(
    docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: str | None = None
) -> DataFrame:
    """Columns ``keep``, n_tokens and token_ids (little-endian unsigned 32-bit integers) of every row.

    Null and empty texts give no tokens. Repeated rows stay repeated, ties do not occur, very long texts pass
    through a window, an empty table gives an empty one, and only the named columns are read, so others cannot
    clash. ``vocabulary`` is a path on the driver; its bytes (a few MB) travel with the tasks. ``decoded`` names
    a further column with the text that the ids decode to, made in the same pass.
    """
    raw = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    kept = docs.select(*keep)

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, cache = MergeTable(raw.value), PieceCache()
        for batch in batches:
            for part in _rows(batch):
                packed = [encode_text(t.as_py(), merges, cache) for t in part.column(len(keep))]
                out = [*part.columns[: len(keep)], pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    out.append(pa.array([decode_ids(p, merges) for p in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    fields = [*kept.schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
    schema = T.StructType(fields + ([T.StructField(decoded, T.StringType())] if decoded else []))
    names = schema.fieldNames()
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``, the text of the ids, special tokens included; null ids give an empty text."""
    raw = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])
    at, names = encoded.columns.index(ids_col), schema.fieldNames()

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = MergeTable(raw.value)
        for batch in batches:
            for part in _rows(batch):
                texts = [decode_ids(p, merges) for p in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(run, schema)
