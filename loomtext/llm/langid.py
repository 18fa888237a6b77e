"""Language identification by compression.

Each language is a zstandard dictionary of raw content: training text, lower-cased, with every run of other
than letters as one space. A text is put in that form and cut into blocks, each block is compressed with every
language's dictionary, and the language whose compressed blocks are smallest in total wins: what the
dictionary has seen costs least to encode. Where the best and the second differ too little, relative to the
best, the margin is narrow and the decision is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import tidy


LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"[^\p{L}]+")
UNKNOWN = "und"
HELD_OUT = 2  # crc32(id as text) mod 4
BUCKETS = 256  # training documents per language, at most; each is learned whole
BLOCK_BYTES = 4096
LEAST_BYTES = 1 << 16
LEVEL = 6
REJECT_MARGIN = 0.01
SCALE = 0.05  # relative margin at which the score is 1
MOST_LANGUAGES = 200


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> dict[str, bytes]:
    """Raw dictionary content of each language.

    Of the rows that are not held out and have text and language, each language gives at most one per bucket
    of hashed identifiers: that with the smallest hash. Only (language, bucket, hash) is shuffled, combined
    before; the whole texts of the at most ``buckets`` winners a language then come from a second scan. Each
    language takes as many of them, whole, as bring it to the size of the smallest (but ``LEAST_BYTES``), so that
    a larger dictionary is no advantage.
    """
    rows = docs.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("_lang"), F.xxhash64(F.col(id_col)).alias("_hash"), F.col(text_col).alias("_text"))
    rows = rows.filter(F.length("_text") > 0)
    rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    best = rows.groupBy("_lang", "_bucket").agg(F.min("_hash").alias("_hash"))
    if best.select("_lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # at most MOST_LANGUAGES * buckets rows of 24 bytes and a name
    chosen = rows.join(F.broadcast(best), ["_lang", "_bucket", "_hash"])
    picked = chosen.groupBy("_lang", "_bucket").agg(F.min("_text").alias("_text")).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: (r["_lang"], r["_bucket"])):
        texts.setdefault(r["_lang"], []).append(letters(r["_text"]))
    # a rare language does not shrink the others' below LEAST_BYTES
    size, out = max(LEAST_BYTES, min((sum(map(len, v)) for v in texts.values()), default=0)), {}
    for lang, held in texts.items():
        before = [sum(map(len, held[:k])) for k in range(len(held))]
        out[lang] = b"\n".join(x for x, n in zip(held, before) if n < size)
    return out


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).encode()


class Models:
    """Compressors of each language; ``predict`` gives language, score and whether the margin was too narrow."""

    def __init__(self, content: dict[str, bytes], reject_margin: float = REJECT_MARGIN):
        self.names, self.reject_margin, self.packers = sorted(content), reject_margin, []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, **plain))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.names or not text or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        raw = letters(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum(len(p.compress(b)) for b in blocks) for p in self.packers]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.names[i]))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / sizes[best]
        return self.names[best], min(1.0, margin / SCALE), margin < self.reject_margin


def identify(docs: DataFrame, content: dict[str, bytes] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reject_margin: float = REJECT_MARGIN) -> DataFrame:
    """Per row: id, held_out, lang_pred, score (0 to 1), rejected.

    Whole texts count. Null texts and texts without a letter are ``und`` with score 0 and rejected, as are all
    texts if nothing could be learned. Equal sizes go to the first language by name, with score 0 and rejected.
    Rows with a null language are predicted but never learned from; a null identifier is not held out. Repeated
    rows are predicted alike; an empty table gives an empty one. Other columns are not read, so none can clash.
    """
    content = training_sample(docs, id_col, text_col, lang_col) if content is None else content
    sent = docs.sparkSession.sparkContext.broadcast(content)  # at most MOST_LANGUAGES languages of BUCKETS documents each
    rows = docs.select(F.col(id_col).alias("_id"), held_out(id_col).alias("_held"), F.col(text_col).alias("_text"))
    schema = f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = Models(sent.value, reject_margin)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [models.predict(t) for t in part.column(2).to_pylist()]
                out = [part.column(0), part.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)
