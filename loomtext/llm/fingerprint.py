"""Document fingerprints with DataFrame functions only: one-permutation MinHash, packed.

Each word is hashed once, and each shingle's word hashes once to 64 bits: the high 8 bits choose one of 256
bins, the rest is the value, and a bin keeps its least value. In sorted order the first entry of each bin is
that value; a sentinel per bin, larger than any value, stands for an empty bin. Optimal densification fills an
empty bin from a bin that is drawn by a hash of (bin, attempt) until one is not empty, the same draws for every
document; after 16 vain draws the non-empty bin of least hash with the empty one is taken. The low 8 bits of
each bin are kept, eight bins to a long; hex digits are made last. Bins of unlike documents agree by chance
once in 256, which the estimate corrects: likeness = (share of equal bins - 2**-8) / (1 - 2**-8), held to 0 to 1.

Intermediate arrays are bound to lambda variables, so that each is computed once a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import Workspace

SHINGLE = 5
BINS = 256
ATTEMPTS = 16
LOW = (1 << 56) - 1
SPACE = r"[\x20\x09-\x0D]+"
RANGE_ROWS = 50_000
MOST_RANGES = 10_000


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _longs(values) -> Column:
    """A constant array that folds to one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _draws() -> list[int]:
    """Bin to look at for (bin, attempt), bin-major: a 64-bit mix of both."""
    out = []
    for k in range(BINS):
        for t in range(ATTEMPTS):
            x = (k * 0x9E3779B97F4A7C15 + (t + 1) * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1)
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
            out.append((x ^ (x >> 31)) % BINS)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def packed(text: Column) -> Column:
    """The low 8 bits of all bins in longs, eight bins each; an empty array for a text without words.

    A text of fewer than five words is one shingle. Null gives what an empty text gives.
    """
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    sentinels = _longs(_signed(b << 56 | LOW) for b in range(BINS))
    draws = _longs(_draws())

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)]))
        none = F.expr("cast(array() as array<bigint>)")
        return F.when(F.size(w) == 0, none).when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(many)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 56)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(s[i - 1])))

    def full(x: Column) -> Column:
        return x.bitwiseAND(F.lit(LOW)) != F.lit(LOW)

    def filled(d: Column) -> Column:
        def donor(k: Column) -> Column:
            drawn = [d[draws[k * ATTEMPTS + t].cast("int")] for t in range(ATTEMPTS)]
            others = F.transform(F.filter(d, full), lambda x: F.struct(F.xxhash64(k, bin_of(x)).alias("order"), x.alias("value")))
            return F.coalesce(*[F.when(full(x), x) for x in drawn], F.array_min(others)["value"])

        return F.transform(d, lambda x, k: F.when(full(x), x).otherwise(donor(k)))

    def eights(d: Column) -> Column:
        def eight(j: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(8):
                out = F.shiftleft(out, 8).bitwiseOR(d[j * 8 + k].bitwiseAND(F.lit(255)))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), eight)

    def bins(h: Column) -> Column:
        values = _let(F.sort_array(F.concat(h, sentinels)), lambda s: _let(firsts(s), lambda d: _let(filled(d), eights)))
        return F.when(F.size(h) == 0, h).otherwise(values)

    return _let(hashed, lambda w: _let(shingles(w), bins))


def digits(prints: Column) -> Column:
    """Hex digits of packed bins."""
    return F.lower(F.array_join(F.transform(prints, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprint(text: Column) -> Column:
    """Hex digits of the packed bins; an empty string for a text without words."""
    return digits(packed(text))


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two packed fingerprints: 1 if both are empty, 0 if one is."""

    def unlike(x: Column) -> Column:
        """How many bytes of x are not zero: the bits of each are gathered in its lowest."""
        for k in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + unlike(x))
    chance = 2.0**-8
    estimate = ((BINS - differ) / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance)
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(a == b, F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), estimate)))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(_id, _for, _need): the document that ``_id`` follows in descending order, and the code points it needs."""
    work = Workspace(rows.sparkSession, "neighbours")
    ids = work.write(rows.filter("_id IS NOT NULL").groupBy("_id").agg(F.max(F.length("_text")).alias("n")), "ids")
    parts = min(MOST_RANGES, max(1, -(-ids.count() // RANGE_ROWS)))
    # the range of each identifier is written, so that every later read sees the same one
    ranged = work.write(ids.repartitionByRange(parts, "_id").withColumn("part", F.spark_partition_id()), "ranges")
    work.drop(ids)
    within = Window.partitionBy("part").orderBy("_id")
    near = ranged.withColumn("_for", F.lead("_id").over(within)).withColumn("_n", F.lead("n").over(within))
    firsts = ranged.groupBy("part").agg(F.min(F.struct("_id", "n")).alias("first"))  # as many rows as ranges
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    near = near.join(F.broadcast(after), "part")
    return near.select("_id", F.coalesce("_for", "after._id").alias("_for"), F.expr("coalesce(_n, after.n) div 3").cast("int").alias("_need"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    ``edited`` has the last third of the text, rounded down, replaced by the first code points of the next
    document, as many or all it has; next is by descending identifier, and the first follows the last. Null
    texts count as empty. A null identifier has no place in that order: such a row is its own next document.
    Of rows that repeat an identifier each is compared; of them others meet the one whose cut head is greatest,
    and of equal heads the greatest fingerprint. Bins hold their smallest hash, so ties there are equal values.
    Very long texts and words are read whole, their shingles in arrays of one row. An empty table gives an empty one. Only identifier and text are read, so other columns cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    every = rows.withColumn("_print", packed(F.col("_text")))
    marked = every.filter("_id IS NOT NULL")  # one shuffle of texts with their prints serves both joins below
    near = _neighbours(rows).hint("merge")
    heads = marked.join(near, "_id").select(F.col("_for").alias("_id"), F.expr("left(_text, _need)").alias("_head"), F.col("_print").alias("_next_print"))
    heads = heads.groupBy("_id").agg(F.max(F.struct("_head", "_next_print")).alias("_next"))
    both = marked.join(heads.hint("merge"), "_id", "left")
    both = both.unionByName(every.filter("_id IS NULL").withColumn("_next", F.lit(None).cast(both.schema["_next"].dataType)))
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    head = F.coalesce("_next._head", F.left("_text", third))
    edited = F.concat(F.left("_text", n - third), F.left(head, third)).alias("edited")
    other = F.coalesce("_next._next_print", "_print").alias("_next_print")
    out = both.select("_id", n.cast("long").alias("n_chars"), edited, "_print", other)
    out = out.withColumn("_edited_print", packed(F.col("edited")))
    prints = [digits(F.col("_print")).alias("fingerprint"), digits(F.col("_edited_print")).alias("edited_fingerprint")]
    near = [likeness(F.col("_print"), F.col(c)).alias(name) for c, name in (("_edited_print", "near_edited"), ("_next_print", "near_next"))]
    return out.select(F.col("_id").alias(id_col), "n_chars", "edited", *prints, *near)
