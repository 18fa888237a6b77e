"""Secret scans with DataFrame functions only.

Three base kinds are patterns. The method adds spans: in candidate strings of a character class, a window
slides over the characters; per step one character's count goes up and one's goes down, and the Shannon
entropy follows from the running sum of c * log2(c). Windows at or above the class's limit, merged, make a
span, unless an allow-list pattern suppresses the candidate. It is given whether or not a base span covers it:
within one it tells a random value from a long word or a run of one letter. Placeholder words are
allowed wherever they stand: they cut a candidate, so only windows that overlap one are suppressed, not the key
around it.

Positions come from lengths: what splitting by a pattern leaves, and what it matched, alternate. Their prefix
sums are taken over two levels, so a text with n matches costs n ** 1.5 small steps, not n ** 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in order, with the pattern, the group that is measured and its least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
WINDOW = 20
# Character classes with their alphabets and the entropy, in bits, from which a window counts.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", r"[0-9a-fA-F]", 3.0),
    ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]", 3.9),
)
# Candidates that are not secrets: plain words, numbers, rules and paths.
ALLOW = (
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9]+$",
    r"^(.)\1*$",
    r"^[A-Za-z]+([-_/+=]+[A-Za-z]+)*$",
    r"^[a-z0-9_-]*(/[a-z0-9_-]+)+/?$",
)
# Words, in either case, that no window of a secret overlaps.
PLACEHOLDERS = ("example", "sample", "dummy", "placeholder", "changeme", "xxxxxx", "0123456789", "abcdefgh")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _least(pattern: str, least: int) -> str:
    """A trailing + as a repetition of at least so many in all: greedy runs that are shorter fail either way."""
    plain = pattern.startswith("[")
    return pattern[:-1] + "{%d,}" % (least if plain else least - 4)


def _masked(text: Column, words: tuple[str, ...]) -> Column:
    """The text with each placeholder, in turn, as so many blanks: every position stays."""
    if not words:
        return text
    out = text
    for w in words:
        out = F.regexp_replace(out, rf"(?i)\Q{w}\E", " " * len(w))
    return F.when(text.rlike("(?i)" + "|".join(rf"\Q{w}\E" for w in words)), out).otherwise(text)


def _positions(rows: DataFrame, name: str, pattern: str, text: str = "_text") -> DataFrame:
    """Adds ``name``: array of (start, end, text) of every match, leftmost and non-overlapping, in code points."""
    m, gaps, size, blocks, offs = (f"_{name}_{x}" for x in ("m", "gaps", "size", "blocks", "offs"))
    rows = rows.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    rows = rows.withColumn(gaps, F.when(F.size(m) > 0, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.expr("cast(array() as array<int>)")))
    rows = rows.withColumn(size, F.ceil(F.sqrt(F.size(m))).cast("int"))
    rows = rows.withColumn(blocks, F.expr(f"""
        if({size} = 0, cast(array() as array<array<int>>), transform(sequence(0, {size} - 1),
            b -> transform(slice({m}, b * {size} + 1, {size}), (x, i) -> length(x) + {gaps}[b * {size} + i])))"""))
    rows = rows.withColumn(offs, F.expr(f"transform({blocks}, x -> aggregate(x, 0, (a, v) -> a + v))"))
    rows = rows.withColumn(offs, F.expr(f"transform({offs}, (x, b) -> aggregate(slice({offs}, 1, b), 0, (a, v) -> a + v))"))
    starts = f"flatten(transform({blocks}, (x, b) -> transform(x, (v, i) -> {offs}[b] + aggregate(slice(x, 1, i), 0, (a, w) -> a + w) + {gaps}[b * {size} + i])))"
    rows = rows.withColumn(offs, F.expr(starts))
    found = f"transform({m}, (x, i) -> named_struct('start', {offs}[i], 'end', {offs}[i] + length(x), 'text', x))"
    return rows.withColumn(name, F.expr(found)).drop(m, gaps, size, blocks, offs)


def _windows(kind: int, found: str, alphabet: str, limit: float) -> Column:
    """Merged spans of the windows of at least ``limit`` bits.

    counts: of each letter of the alphabet in the window; s: the sum of c * log2(c) over them. A character that
    enters changes s by f(c + 1) - f(c), one that leaves by f(c - 1) - f(c). Entropy = log2(W) - s / W.
    """
    f = lambda c: f"if({c} > 1, {c} * log2({c}), 0.0D)"
    add = f"""named_struct('counts', transform(acc.counts, (c, k) -> if(k = x, c + 1, c)),
        's', acc.s + {f('(acc.counts[x] + 1)')} - {f('acc.counts[x]')}, 'at', acc.at, 'spans', acc.spans)"""
    remove = f"""named_struct('counts', transform(acc.counts, (c, k) -> if(k = y, c - 1, c)),
        's', acc.s + {f('(acc.counts[y] - 1)')} - {f('acc.counts[y]')}, 'at', acc.at, 'spans', acc.spans)"""
    # acc.at counts characters; a step adds the next code, then takes out the one that left the window
    letters = f"transform(split(c.text, ''), x -> instr('{alphabet}', x) - 1)"
    step = f"transform(array({add}), acc -> if(acc.at < {WINDOW}, acc, transform(array(p.codes[acc.at - {WINDOW}]), y -> {remove})[0]))[0]"
    high = f"(acc.at + 1 >= {WINDOW} and log2({WINDOW}.0D) - acc.s / {WINDOW} >= {limit}D)"
    merged = f"""if(not {high}, acc.spans,
        if(size(acc.spans) > 0 and element_at(acc.spans, -1).end >= acc.at - {WINDOW - 1},
           concat(slice(acc.spans, 1, size(acc.spans) - 1), array(named_struct('start', element_at(acc.spans, -1).start, 'end', acc.at + 1))),
           concat(acc.spans, array(named_struct('start', acc.at - {WINDOW - 1}, 'end', acc.at + 1)))))"""
    state = f"""named_struct('counts', array_repeat(0, {len(alphabet)}), 's', 0.0D, 'at', 0, 'spans', cast(array() as array<struct<start:int,end:int>>))"""
    scan = f"""aggregate(p.codes, {state}, (acc, x) -> transform(array({step}),
        acc -> named_struct('counts', acc.counts, 's', acc.s, 'at', acc.at + 1, 'spans', {merged}))[0]).spans"""
    return F.expr(f"""
        flatten(transform({found}, c -> transform(array(named_struct('start', c.start, 'codes', {letters})),
            p -> transform({scan}, w -> named_struct('start', p.start + w.start, 'kind', {kind}, 'end', p.start + w.end)))[0]))""")


def _joined(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k, *_ in (*BASE, *CLASSES))
    return F.expr(f"array_join(transform(array_sort({spans}), x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW,
    placeholders: tuple[str, ...] = PLACEHOLDERS,
) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, n_entropy, base_spans, spans (arrays of start, kind, end), base, all.

    Offsets are code points, ends are exclusive. ``base`` and ``all`` are the spans as kind:start:end, by start
    and then kind; spans of equal start are in the order in which the kinds are listed, so there are no ties.
    Null texts count as empty and have no spans; very long texts and candidates are read whole. Repeated rows
    and null identifiers are scanned like others, an empty table gives an empty one; only identifier and text
    are read, so other columns cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    for kind, (name, pattern, part, least) in enumerate(BASE):
        rows = _positions(rows, f"_{name}", pattern if part else _least(pattern, least))
        held = F.col(f"_{name}")
        if part:
            held = F.filter(held, lambda x: F.length(F.regexp_extract(x["text"], pattern, part)) >= least)
        rows = rows.withColumn(f"_{name}", F.transform(held, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"))))
    rows = rows.withColumn("base_spans", F.concat(*[F.col(f"_{name}") for name, *_ in BASE]))
    rows = rows.withColumn("_plain", _masked(F.col("_text"), placeholders))
    for kind, (name, alphabet, letter, limit) in enumerate(CLASSES, len(BASE)):
        rows = _positions(rows, f"_{name}", letter + "{%d,}" % WINDOW, "_plain")
        rows = rows.withColumn(f"_{name}", F.filter(f"_{name}", lambda x: ~F.greatest(F.lit(False), *[x["text"].rlike(p) for p in allow])))
        rows = rows.withColumn(f"_{name}", F.when(F.size(f"_{name}") > 0, _windows(kind, f"_{name}", alphabet, limit)).otherwise(F.expr(f"cast(array() as {SPAN})")))
    added = F.concat(*[F.col(f"_{name}") for name, *_ in CLASSES])
    rows = rows.withColumn("spans", F.concat("base_spans", added))
    counts = [F.size(f"_{name}").cast("long").alias(f"n_{name}") for name, *_ in BASE]
    return rows.select(F.col("_id").alias(id_col), *counts, F.size(added).cast("long").alias("n_entropy"), "base_spans", "spans", _joined("base_spans").alias("base"), _joined("spans").alias("all"))
