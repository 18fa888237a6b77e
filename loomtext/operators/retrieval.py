"""Keyword in context, and whether names are literally attested in a corpus."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions import text as T

# Window sizes, hits shown per text, and thresholds of the audit.
BEFORE, AFTER, SHOWN = 250, 900, 2
LEAST_HITS, LEAST_FILES, HEADING_CHARS = 2, 2, 30
TERMINAL = "[。！？!?…]\\s*$"
HARVEST = (r"\*\*([^*\n]+?)\*\*", r"「([^」\n]+)」", r"《([^》\n]+)》", r'(?<!\\)"([^"\n]+)"', r"(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$")
WRAPPERS = "“”\"'「」《》"


def bad_alternation(pattern: str) -> bool:
    """A backslash before a pipe makes it literal, which is rarely meant."""
    return r"\|" in pattern


def bad_patterns(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose pattern has such a pipe."""
    return rows.filter(F.contains(F.col(column), F.lit("\\|")))


def kwic(docs: DataFrame, pattern: str, before: int = BEFORE, after: int = AFTER, shown: int = SHOWN, case_sensitive: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, offset, match, window of the first hits of a text, white space collapsed; the pattern is Python's.

    Matching runs on Arrow batches: the pattern language is part of the contract, and Java's differs.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    flags = 0 if case_sensitive else re.I

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, blank = re.compile(pattern, flags), re.compile(r"\s+")
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = blank.sub(" ", text or "")
                for k, m in enumerate(found.finditer(text)):
                    if k >= shown:
                        break
                    for column, value in zip(rows, (i, m.start(), m[0], text[max(0, m.start() - before) : m.end() + after])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], names=[id_col, "offset", "match", "window"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, offset long, match string, window string")


def hit_counts(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, hits of texts with any; for patterns that Java and Python read alike."""
    hits = F.regexp_count(F.regexp_replace(text_col, T.unicode(r"\s+"), " "), F.lit("(?iu)" + pattern)).cast("long")
    return docs.select(id_col, hits.alias("hits")).filter("hits > 0")


def corroboration(counts: DataFrame) -> DataFrame:
    """One row: hits, texts with hits, whether fewer than two texts have any."""
    return counts.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.count("*").alias("files"), (F.count("*") < 2).alias("single"))


def _clean(value: Column) -> Column:
    bare = F.regexp_replace(value, "[*`_]+", "")
    return F.regexp_replace(F.regexp_replace(bare, T.unicode(r"^\s+|\s+$"), ""), f"^[{WRAPPERS}]+|[{WRAPPERS}]+$", "")


def harvest_names(package: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct names in emphasis, quotes, title marks and headings: 2 to 20 characters, one a letter."""
    every = F.concat(*[F.regexp_extract_all(text_col, F.lit(T.unicode(p) if not p.startswith("(?m)") else "(?mU)" + p[4:]), F.lit(1)) for p in HARVEST])
    names = package.select(F.explode(every).alias("raw")).select(_clean(F.col("raw")).alias("name"))
    return names.filter(F.length("name").between(2, 20) & F.col("name").rlike(r"\p{L}")).distinct()


def occurrences(docs: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, offset, heading: every literal, per name non-overlapping hit.

    ``names`` is a checked list on the driver: it is the question, not the corpus. One automaton finds all of
    them in one pass over a text. A hit is in a heading if its line is short, does not end a sentence and
    stands between blank lines.
    """
    if len(names) > 1_000_000:
        raise ValueError("more than a million names; audit them in parts")
    kind, wanted = docs.schema[id_col].dataType.simpleString(), sorted(set(names))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, terminal = _finder(wanted), re.compile(TERMINAL)
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                for name, offset in search(text):
                    first = text.rfind("\n", 0, offset) + 1
                    last = text.find("\n", offset)
                    line = text[first : last if last >= 0 else len(text)]
                    above = text[text.rfind("\n", 0, first - 1) + 1 : first - 1] if first else None
                    below = text[last + 1 : (text.find("\n", last + 1) + 1 or len(text) + 1) - 1] if 0 <= last < len(text) - 1 else None
                    heading = len(line.strip()) < HEADING_CHARS and not terminal.search(line) and above is not None and not above.strip() and below is not None and not below.strip()
                    for column, value in zip(rows, (i, name, offset, heading)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.bool_())], names=[id_col, "name", "offset", "heading"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, name string, offset long, heading boolean")


def _finder(names: list[str]):
    try:
        import ahocorasick
    except ImportError:
        def plain(text: str) -> Iterator[tuple[str, int]]:
            for name in names:
                at = text.find(name)
                while at >= 0:
                    yield name, at
                    at = text.find(name, at + len(name))

        return plain
    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    if names:
        automaton.make_automaton()

    def found(text: str) -> Iterator[tuple[str, int]]:
        free: dict[str, int] = {}
        for end, name in automaton.iter(text) if names else ():
            start = end - len(name) + 1
            if start >= free.get(name, 0):
                free[name] = end + 1
                yield name, start

    return found


def headings(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Lines that look like headings: id, line_no, line (lines with line_no from 0)."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    blank = lambda c: F.regexp_replace(c, T.unicode(r"\s+"), "") == ""
    rows = lines.withColumn("_above", F.lag("line").over(order)).withColumn("_below", F.lead("line").over(order))
    stripped = F.regexp_replace("line", T.unicode(r"^\s+|\s+$"), "")
    return rows.filter((F.length(stripped) < HEADING_CHARS) & (stripped != "") & ~F.col("line").rlike(T.unicode(TERMINAL)) & blank(F.col("_above")) & blank(F.col("_below"))).select(id_col, "line_no", "line")


def attestation(names: DataFrame, hits: DataFrame, least_hits: int = LEAST_HITS, id_col: str = "doc_id") -> DataFrame:
    """name, hits, heading_hits, files, prose_files, verdict."""
    prose = ~F.col("heading")
    by = hits.groupBy("name").agg(F.count("*").alias("hits"), F.count_if(F.col("heading")).alias("heading_hits"), F.countDistinct(id_col).alias("files"), F.countDistinct(F.when(prose, F.col(id_col))).alias("prose_files"))
    rows = names.select("name").distinct().join(by, "name", "left").fillna(0)
    n = F.col("hits") - F.col("heading_hits")
    verdict = F.when(F.col("hits") == 0, "UNATTESTED").when(n == 0, "EDITORIAL").when((n >= least_hits) & (F.col("prose_files") >= LEAST_FILES), "ATTESTED").otherwise("THIN")
    return rows.withColumn("verdict", verdict)


def audit_verdict(attested: DataFrame) -> DataFrame:
    return attested.agg(F.when(F.count_if(F.col("verdict").isin("UNATTESTED", "EDITORIAL")) > 0, "FAIL").otherwise("PASS").alias("verdict"))


def first_contexts(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """name, id, position, context: around the first hit in document order, white space collapsed."""
    first = hits.groupBy("name").agg(F.min(F.struct(id_col, "offset")).alias("f")).select("name", f"f.{id_col}", "f.offset")
    rows = docs.select(id_col, text_col).join(first, id_col)  # one row for each name asked for
    flat = lambda c: F.regexp_replace(c, T.unicode(r"\s+"), " ")
    at = F.length(flat(F.substr(F.col(text_col), F.lit(1), F.col("offset").cast("int"))))
    left = F.greatest(F.lit(0), at - BEFORE)
    context = F.substr(flat(F.col(text_col)), left + 1, at + F.length("name") + AFTER - left)
    return rows.select("name", id_col, at.cast("long").alias("position"), context.alias("context"))
