"""Most frequent items and literal counts of single texts, counted where the text is.

A document's items never leave its row: only what is asked for comes out of a task, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import lexicons as L

HAN_LOW, HAN_HIGH, HAN_BITS = 0x4E00, 0x9FFF, 15  # the range 一-鿿 as numbers that 15 bits hold, so four of them fit one integer


_STOP = frozenset(L.STOPWORDS)
_LETTERS, _INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"'-"
_LOWER = bytes(c if c in _LETTERS.lower() + _INNER else c + 32 if c in _LETTERS else 32 for c in range(256))
_KIND = bytes(1 if c in _LETTERS else 2 if c in _INNER else 0 for c in range(256))


def words(text: str | None) -> list[str]:
    """Lower-case word tokens in order: runs of what words are made of, from their first letter on."""
    if not text:
        return []
    runs = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("ascii")
    found = runs.split()
    if runs[0] in "'-" or " '" in runs or " -" in runs:
        return [w for run in found if (w := run.lstrip("'-"))]
    return found


def content(text: str | None) -> list[str]:
    """Lower-case word tokens that are longer than two letters and no stop words."""
    return [w for w in words(text) if len(w) > 2 and w not in _STOP]


def bigrams(text: str | None) -> list[str]:
    words = content(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def top(items: Iterable[str], k: int) -> list[tuple[str, int]]:
    """The k most frequent with their counts; a Counter keeps first occurrences in order, and so do ties."""
    return heapq.nlargest(k, Counter(items).items(), key=lambda x: x[1])


def han(text: str | None) -> np.ndarray:
    """The Han characters of a text, as code points."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    return codes[(codes >= HAN_LOW) & (codes <= HAN_HIGH)]


def han_ngrams(codes: np.ndarray, n: int, k: int) -> list[tuple[str, int]]:
    """The k most frequent n-grams of Han characters without a stop character, ties by first occurrence."""
    if len(codes) < n:
        return []
    size = len(codes) - n + 1
    stop = np.isin(codes, _STOP_ZH)
    keys, good = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(n):
        keys = (keys << HAN_BITS) | (codes[j : j + size].astype(np.int64) - HAN_LOW)
        good &= ~stop[j : j + size]
    at = np.flatnonzero(good)
    if not len(at):
        return []
    _, first, hits = np.unique(keys[at], return_index=True, return_counts=True)
    best = np.lexsort((first, -hits))[:k]
    return [(codes[i : i + n].tobytes().decode("utf-32-le"), int(h)) for i, h in zip(at[first[best]], hits[best])]


def grams_zh(n: int) -> Callable[[str | None], list[str]]:
    """For :func:`partial_counts`: the n-grams of a text's Han characters in order, those with a stop character as ''."""
    stop = frozenset(L.STOP_CHARS_ZH)

    def of(text: str | None) -> list[str]:
        chars = han(text).tobytes().decode("utf-32-le")
        bad, until = [], 0  # a gram is bad while a stop character lies in it
        for i, c in enumerate(chars):
            if c in stop:
                bad.extend(range(max(until, i - n + 1), i + 1))
                until = i + 1
        grams = [chars[i : i + n] for i in range(len(chars) - n + 1)]
        for i in bad:
            if i < len(grams):
                grams[i] = ""
        return grams

    return of


def edges_zh(text: Column, n: int) -> Column:
    """Struct of n (Han characters of a text) and its first and last ``n - 1`` of them."""

    @F.arrow_udf("struct<n:bigint,head:string,tail:string>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            codes = han(text)
            ends = [x.tobytes().decode("utf-32-le") for x in (codes[: n - 1], codes[max(0, len(codes) - (n - 1)) :])]
            out.append({"n": len(codes), "head": ends[0], "tail": ends[1]})
        return pa.array(out, pa.struct([("n", pa.int64()), ("head", pa.string()), ("tail", pa.string())]))

    return of.asNondeterministic()(text)


_STOP_ZH = np.unique(np.frombuffer(L.STOP_CHARS_ZH.encode("utf-32-le"), "<u4"))


def ranked(rows: DataFrame, id_col: str, text_col: str, key: str, of: Callable[[str | None], Sequence[tuple]], more: str = "") -> DataFrame:
    """id, key, hits, place (from 1), [more]: of each text what ``of`` gives, tuples of key, hits and values of ``more``.

    A place begins anew where the values of ``more`` change. Nothing but ids and texts goes to the workers.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    extra = [x.strip().split(" ") for x in more.split(",") if x.strip()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, hits, places, rest = [], [], [], [], [[] for _ in extra]
            for i, text in enumerate(batch.column(1)):
                place, last = 0, None
                for found, n, *values in of(text.as_py()):
                    place, last = (place + 1 if values == last else 1), values
                    ids.append(i)
                    keys.append(found)
                    hits.append(n)
                    places.append(place)
                    for column, value in zip(rest, values):
                        column.append(value)
            own = batch.column(0).take(pa.array(ids, pa.int32()))
            arrays = [own, pa.array(keys, pa.string()), pa.array(hits, pa.int64()), pa.array(places, pa.int32()), *[pa.array(x, pa.int32()) for x in rest]]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, key, "hits", "place", *[x for x, _ in extra]])

    schema = ", ".join([f"`{id_col}` {kind}", f"{key} string", "hits long", "place int", *[f"{a} {b}" for a, b in extra]])
    return rows.select(id_col, text_col).mapInArrow(run, schema)


class Literals:
    """Non-overlapping occurrences of fixed literals in a text, and how many of its characters are Han.

    Of literals of several code units only those are looked for whose first two
    units stand side by side somewhere in the text, which one pass over the units tells for all of them.
    """

    def __init__(self, parts: Sequence[str]):
        if not all(parts):
            raise ValueError("an empty literal occurs everywhere")
        units = [np.frombuffer(p.encode("utf-16-le", "surrogatepass"), "<u2") for p in parts]
        self.parts, self.size = tuple(parts), len(parts)
        self.single = [(i, p) for i, (p, u) in enumerate(zip(parts, units)) if len(u) == 1]
        self.longer = [(i, p, int(u[0]) << 16 | int(u[1])) for i, (p, u) in enumerate(zip(parts, units)) if len(u) > 1]
        self.first, self.second = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        for _, _, pair in self.longer:
            self.first[pair >> 16] = self.second[pair & 0xFFFF] = True

    def of(self, text: str) -> list[int]:
        """The number of Han characters, then the count of each literal."""
        counts = [0] * self.size
        if text.isascii():
            return [0, *map(text.count, self.parts)]
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        for i, part in self.single:
            counts[i] = text.count(part)
        if self.longer:
            at = np.flatnonzero(self.first[units[:-1]] & self.second[units[1:]])
            pairs = set(np.unique(units[at].astype(np.uint32) << 16 | units[at + 1]).tolist())
            for i, part, pair in self.longer:
                if pair in pairs:
                    counts[i] = text.count(part)
        return [int(np.count_nonzero((units >= HAN_LOW) & (units <= HAN_HIGH))), *counts]


def literal_counts(text: Column, parts: Sequence[str]) -> Column:
    """array<long>: how many characters of a text are Han, then non-overlapping occurrences of each literal."""
    wanted = Literals(parts)

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        counts = [None if t is None else wanted.of(t) for t in texts.to_pylist()]
        return pa.array(counts, pa.list_(pa.int64()))

    return of.asNondeterministic()(text)  # or a filter on the counts would be moved below them, and count again


def translated(text: Column, old: str, new: str) -> Column:
    """``text`` with each character of ``old`` replaced by that at its place in ``new``, as translate() does one by one."""
    if len(old) != len(new) or len(set(old)) != len(old):
        raise ValueError("every character needs one other")
    pairs = dict(zip(map(ord, old), new))

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        full = np.arange(0x110000, dtype="<u4")
        full[list(pairs)] = [ord(c) for c in pairs.values()]
        return pa.array([None if t is None else full[np.frombuffer(t.encode("utf-32-le"), "<u4")].tobytes().decode("utf-32-le") for t in texts.to_pylist()], pa.string())

    return of.asNondeterministic()(text)


def totals(counts: Column, groups: dict[str, Sequence[str]]) -> dict[str, Column]:
    """The summed counts of each group of literals; ``counts`` is of the groups' literals in order."""
    out, at = {}, 1
    for name, parts in groups.items():
        out[name] = sum((F.get(counts, F.lit(at + k)) for k in range(len(parts))), F.lit(0).cast("long"))
        at += len(parts)
    return out


def literals_of(groups: dict[str, Sequence[str]]) -> tuple[str, ...]:
    return tuple(p for parts in groups.values() for p in parts)


def word_counts(text: Column, groups: dict[str, Sequence[str]]) -> Column:
    """array<long>: how many words a text has, then how many of them are in each group."""
    wanted = [frozenset(g) for g in groups.values()]

    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = words(text)
            held = Counter(found) if wanted else {}
            out.append([len(found), *[sum(held[w] for w in g if w in held) for g in wanted]])
        return pa.array(out, pa.list_(pa.int64()))

    return of.asNondeterministic()(text)


_WORD = re.compile(L.WORD)


def _ends(text: str | None) -> dict:
    """The first and the last content word, looked for from both ends of a text."""
    first = next((w for m in _WORD.finditer(text or "") if len(w := m[0].lower()) > 2 and w not in _STOP), None)
    last, reach = None, 64
    while first and last is None:
        tail = text[-reach:]
        found = words(tail)[reach < len(text) :]  # the first may have begun before
        last = next((w for w in reversed(found) if len(w) > 2 and w not in _STOP), None)
        reach *= 8
    return {"first": first, "last": last}


def content_ends(text: Column) -> Column:
    """Struct of the first and the last content word of a text."""

    @F.arrow_udf("struct<first:string,last:string>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(list(map(_ends, texts.to_pylist())), pa.struct([("first", pa.string()), ("last", pa.string())]))

    return of.asNondeterministic()(text)


def cut_pieces(pieces: Column) -> Column:
    """Struct of inside (histogram of the sentences that neighbours cannot change) and ends (at most three fragments).

    ``pieces`` is array<struct<n, joins>>: words, and whether a piece belongs to the one before it. The first piece
    may continue the document before; pieces that join it are in the same sentence whatever it turns out to be. The
    last piece may go on, and whether it joins what stands before it is known only where it ends.
    """
    kind = "struct<inside:array<struct<length:bigint,n:bigint>>,ends:array<struct<n:bigint,joins:boolean,extra:bigint>>>"
    arrow = pa.struct([("inside", pa.list_(pa.struct([("length", pa.int64()), ("n", pa.int64())]))), ("ends", pa.list_(pa.struct([("n", pa.int64()), ("joins", pa.bool_()), ("extra", pa.int64())])))])

    @F.arrow_udf(kind)
    def of(rows: pa.Array) -> pa.Array:
        flat, offsets = rows.flatten(), rows.offsets.to_pylist()
        n, joins = flat.field(0).to_pylist(), flat.field(1).to_pylist()
        base = offsets[0]
        out = []
        for a, b in zip(offsets, offsets[1:]):
            out.append(_cut(n[a - base : b - base], joins[a - base : b - base]))
        return pa.array(out, arrow)

    return of.asNondeterministic()(pieces)


_BLANK = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"  # \\s of Java's (?U)
_SPACE = b"(?:[\\t-\\r ]" + b"".join(b"|" + c.encode() for c in _BLANK if c > "~") + b")+"
_BREAK = re.compile(rb"[.!?](" + _SPACE + rb""")(?=["'(A-Z0-9])""")
_PARAGRAPH = re.compile(L.PARAGRAPH_BREAK.encode())
_SPACES = re.compile(f"[{_BLANK}]+")
_MARKED = re.compile(rb"['-]+[A-Za-z]")
_OPENS = frozenset("\"'(ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_REACH = 4 * max(map(len, L.ABBREVIATIONS)) + 4  # bytes within which the last word of a piece that can be one stands


def _starts(raw: bytes) -> np.ndarray:
    """Where the runs that hold a word begin, in bytes."""
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    first = kind.copy()
    first[1:][kind[:-1] > 0] = 0
    starts = np.flatnonzero(first == 1)
    odd = np.flatnonzero(first == 2)  # begun by a mark: a word if a letter follows
    if len(odd):
        held = [i for i in odd.tolist() if _MARKED.match(raw, i)]
        starts = np.union1d(starts, np.array(held, np.int64))
    return starts


def _abbreviated(raw: bytes, start: int, end: int) -> bool:
    """Whether the last word of a piece is an abbreviation."""
    if raw[end - 1] in b"!?":
        return False
    piece = raw[start:end].rstrip(b".")[-_REACH:]
    return _SPACES.split(piece.decode("utf-8", "ignore"))[-1].lower() in L.ABBREVIATIONS


def _prose(text: str, merged: bool) -> tuple[list[int], list[bool], bool, bool, list[int]]:
    """Words of each sentence piece, whether it joins the one before, whether the text opens and closes a sentence,
    and the words of each paragraph that has any."""
    text = text.strip(_BLANK)
    if not text:
        return [], [], False, False, []
    raw = text.encode("utf-8", "surrogatepass")
    starts, breaks = _starts(raw), [m.span(1) for m in _BREAK.finditer(raw)]
    count = lambda cuts: np.diff(np.searchsorted(starts, [0, *cuts, len(raw)])).tolist()
    begin, end = [0, *[b for _, b in breaks]], [*[a for a, _ in breaks], len(raw)]
    joins = [_abbreviated(raw, a, b) for a, b in zip(begin, end)] if merged else [False] * len(begin)
    paragraphs = [n for n in count([m.start() for m in _PARAGRAPH.finditer(raw)]) if n]
    return count(begin[1:]), joins, text[0] in _OPENS, text[-1] in ".!?", paragraphs


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of structs from lists of tuples, by columns."""
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = list(zip(*[x for row in rows for x in row])) or [()] * len(kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(flat, kind)], fields=list(kind)))


_INSIDE = pa.struct([("length", pa.int64()), ("n", pa.int64())])
_FRAGMENT = pa.struct([("n", pa.int64()), ("joins", pa.bool_()), ("extra", pa.int64())])


def prose(text: Column, merged: bool) -> Column:
    """Struct of inside and ends of a text's sentences as :func:`cut_pieces` gives them, opens and closes (whether it
    begins like a sentence and ends like one), and paragraphs (a histogram of their words); null has none of them.

    With ``merged``, a piece whose own last word is an abbreviation belongs to the one before it.
    """
    held = "array<struct<length:bigint,n:bigint>>"
    kind = f"struct<inside:{held},ends:array<struct<n:bigint,joins:boolean,extra:bigint>>,opens:boolean,closes:boolean,paragraphs:{held}>"

    @F.arrow_udf(kind)
    def of(texts: pa.Array) -> pa.Array:
        inside, ends, opens, closes, paragraphs = [], [], [], [], []
        for text in texts.to_pylist():
            n, joins, first, last, own = _prose(text or "", merged)
            cut = _cut(n, joins)
            inside.append([tuple(x.values()) for x in cut["inside"]])
            ends.append([tuple(x.values()) for x in cut["ends"]])
            opens.append(first)
            closes.append(last)
            paragraphs.append(list(Counter(own).items()))
        arrays = [_lists(inside, _INSIDE), _lists(ends, _FRAGMENT), pa.array(opens, pa.bool_()), pa.array(closes, pa.bool_()), _lists(paragraphs, _INSIDE)]
        return pa.StructArray.from_arrays(arrays, names=["inside", "ends", "opens", "closes", "paragraphs"])

    return of.asNondeterministic()(text)


def chunk_parts(text: Column, before: Column, size: int) -> Column:
    """Struct of distinct and chunks (distinct words of the chunks of ``size`` words that lie in a text, and how many
    they are), words, and parts: what the text gives to chunks that it shares, as chunk, its distinct words w and m,
    the words they stand for. ``before`` is how many words of the work stand before the text."""
    kind = pa.struct([("chunk", pa.int64()), ("w", pa.string()), ("m", pa.int64())])

    @F.arrow_udf("struct<distinct:bigint,chunks:bigint,words:bigint,parts:array<struct<chunk:bigint,w:string,m:bigint>>>")
    def of(texts: pa.Array, befores: pa.Array) -> pa.Array:
        distinct, chunks, sizes, parts = [], [], [], []
        for text, past in zip(texts.to_pylist(), befores.to_pylist()):
            w = words(text)
            into = min(len(w), -past % size)  # words that fill a chunk begun earlier
            whole = (len(w) - into) // size
            rest = into + whole * size
            distinct.append(sum(len(set(w[a : a + size])) for a in range(into, rest, size)))
            chunks.append(whole)
            sizes.append(len(w))
            own = ((past // size, w[:into]), ((past + rest) // size, w[rest:]))
            parts.append([(chunk, " ".join(dict.fromkeys(x)), len(x)) for chunk, x in own if x])
        arrays = [pa.array(x, pa.int64()) for x in (distinct, chunks, sizes)]
        return pa.StructArray.from_arrays([*arrays, _lists(parts, kind)], names=["distinct", "chunks", "words", "parts"])

    return of.asNondeterministic()(text, before)


def _cut(n: list[int], joins: list[bool]) -> dict:
    last = len(n) - 1
    if last < 0:
        return {"inside": [], "ends": []}
    starts = [i for i in range(1, last) if not joins[i]]
    ends = [{"n": n[0], "joins": joins[0], "extra": sum(n[1 : starts[0] if starts else last])}]
    if starts:
        ends.append({"n": sum(n[starts[-1] : last]), "joins": False, "extra": 0})
    if last:
        ends.append({"n": n[last], "joins": joins[last], "extra": 0})
    inside = Counter(sum(n[a:b]) for a, b in zip(starts, starts[1:]))
    return {"inside": [{"length": k, "n": v} for k, v in inside.items()], "ends": ends}


MOST_ITEMS = 500_000  # of a dictionary before it is given out; what is counted is summed again


def partial_counts(docs: DataFrame, work: str, order: Sequence[str], text_col: str, key: str, of: Callable[..., list[str]], more: Sequence[str] = ()) -> DataFrame:
    """work, key, hits, order, at: counts of ``of(text, *more)`` over some documents of a work, and where each was first.

    Counts of a work are sums, first places the least of (order, at); texts stay in their task. Empty items only
    take a place.
    """
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (work, *order)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            works, texts = batch.column(0).to_pylist(), batch.column(len(kinds))
            places = list(zip(*[batch.column(i + 1).to_pylist() for i in range(len(order))]))
            hits: dict[tuple, list] = {}

            def given() -> pa.RecordBatch:
                rows = pa.array([v[1] for v in hits.values()], pa.int32())
                columns = [batch.column(i).take(rows) for i in range(len(kinds))]
                columns += [pa.array([k[1] for k in hits], pa.string()), pa.array([v[0] for v in hits.values()], pa.int64()), pa.array([v[2] for v in hits.values()], pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=[*kinds, key, "hits", "at"])

            for i in sorted(range(len(works)), key=lambda i: [(x is not None, x) for x in places[i]]):
                own = works[i]
                for at, item in enumerate(of(texts[i].as_py(), *[batch.column(len(kinds) + 1 + k)[i].as_py() for k in range(len(more))])):
                    if not item:
                        continue
                    held = hits.get((own, item))
                    if held is None:
                        hits[own, item] = [1, i, at]
                    else:
                        held[0] += 1
                if len(hits) > MOST_ITEMS:
                    yield given()
                    hits.clear()
            yield given()

    schema = ", ".join([*[f"`{c}` {k}" for c, k in kinds.items()], f"{key} string", "hits long", "at long"])
    return docs.select(*kinds, text_col, *more).mapInArrow(run, schema)


BUCKETS = 1 << 14  # that the bigrams of a work are dealt to: bounds of their counts
MOST_WORKS = 256  # whose buckets a task holds before it gives them out


class _Codes(dict):
    """64-bit codes of words, the same in every process; forgotten when they are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > MOST_ITEMS:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return code

    def pairs(self, words: list[str]) -> np.ndarray:
        """The code of each word with the next one; the upper bits tell the bucket."""
        codes = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        mixed = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
        mixed ^= mixed >> np.uint64(29)
        return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _buckets(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def bigram_bounds(docs: DataFrame, work: str, text_col: str, k: int) -> DataFrame:
    """work, bucket, key, hits, to be summed: bigrams in each bucket (key is null), and occurrences of some frequent
    bigrams (bucket is null). The sum of a bucket is no less than the count of a bigram in it, that of a key no more
    than its count; what is frequent everywhere is counted everywhere."""
    kind = docs.schema[work].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums, names = _Codes(), {}, ["work", "bucket", "key", "hits"]

        def summed() -> Iterator[pa.RecordBatch]:
            for own, held in sums.items():
                at = np.flatnonzero(held)
                works = pa.array([own] * len(at), works_type)
                yield pa.RecordBatch.from_arrays([works, pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.array(held[at], pa.int64())], names=names)
            sums.clear()

        works_type = None
        for batch in batches:
            works_type, by_work = batch.schema.field(0).type, {}
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_work.setdefault(own, []).append(content(text.as_py()))
            for own, texts in by_work.items():
                pairs, flat, first, past = [], [], [], 0
                for w in texts:
                    if len(w) > 1:
                        pairs.append(codes.pairs(w))
                        first.append(np.arange(past, past + len(w) - 1))
                        flat += w
                        past += len(w)
                if not pairs:
                    continue
                pairs, first = np.concatenate(pairs), np.concatenate(first)
                if own not in sums:
                    if len(sums) >= MOST_WORKS:
                        yield from summed()
                    sums[own] = np.zeros(BUCKETS, np.int64)
                sums[own] += np.bincount(_buckets(pairs), minlength=BUCKETS)
                seen, n = np.unique(pairs, return_counts=True)
                often = seen[np.argsort(-n, kind="stable")[: 4 * k]]
                at = first[np.isin(pairs, often)].tolist()
                best = Counter(f"{flat[i]} {flat[i + 1]}" for i in at).most_common(4 * k)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(best), works_type), pa.nulls(len(best), pa.int32()), pa.array([b for b, _ in best], pa.string()), pa.array([h for _, h in best], pa.int64())], names=names)
        yield from summed()

    return docs.select(F.col(work).alias("work"), text_col).mapInArrow(run, f"work {kind}, bucket int, key string, hits long").withColumnRenamed("work", work)


def bitmap(buckets: Column) -> Column:
    """An array of buckets as one bit for each there is."""

    @F.arrow_udf("binary")
    def of(rows: pa.Array) -> pa.Array:
        out = []
        for held in rows.to_pylist():
            bits = np.zeros(BUCKETS, bool)
            bits[held] = True
            out.append(np.packbits(bits).tobytes())
        return pa.array(out, pa.binary())

    return of(buckets)


def bigrams_in() -> Callable[[str | None, bytes], list[str]]:
    """For :func:`partial_counts`: the bigrams of a text in order, those in no bucket of a :func:`bitmap` as ''."""
    codes = _Codes()

    def of(text: str | None, bits: bytes) -> list[str]:
        found = content(text)
        if len(found) < 2:
            return []
        kept = np.unpackbits(np.frombuffer(bits, np.uint8))[_buckets(codes.pairs(found))]
        out = [""] * len(kept)
        for i in np.flatnonzero(kept).tolist():
            out[i] = f"{found[i]} {found[i + 1]}"
        return out

    return of
