"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its line into
grades: P(grade <= k | text) = logistic(theta_k - w . x). The expected grade is the sum of the tail
probabilities, and P(grade >= accept_grade) selects. Features are the set of a text's tokens (letter runs,
lower-cased, and punctuation runs) and a few bands of its shape, hashed into 2**40 cells, so that no weight
meets another token by chance; only cells that the fit gave a weight are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import materialize, tidy

TOKEN = regex.compile(r"\p{L}+|[^\p{L}\p{N}\s]+")
CELLS = (1 << 40) - 1
SAMPLE_ROWS = 10_000  # labelled rows that a fit sees, at most
SAMPLE_CELLS = 16_000_000  # cells of these rows together, at most: 128 MB on the driver
LEAST_DOCS = 4
CACHE_TOKENS = 200_000
BATCH_ROWS = 500
ACCEPT = 0.5


def default_grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Toxic 0, poor 1, good 2; null where the labels do not say."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


def cell(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) & CELLS


def band(name: str, share: float) -> str:
    """A share in bands that double: 0, up to 1/64, 1/32, ... 1."""
    k = 0 if share <= 0 else max(1, 7 - int(-np.log2(min(share, 1.0)) + 1e-9))
    return f"\x00{name}{k}"


def features(text: str | None, cache: dict[str, int]) -> set[int]:
    """Cells of a whole text."""
    text = text or ""
    words = text.split()
    low = text.lower()
    tokens = set(TOKEN.findall(low))
    n, chars = max(len(words), 1), max(len(text), 1)
    tokens.add(band("upper", sum(w.isupper() and len(w) > 1 for w in words) / n))
    tokens.add(band("again", sum(a == b for a, b in zip(words, words[1:])) / n))
    tokens.add(band("mark", len(regex.findall(r"[^\p{L}\p{N}\s.,]", text)) / chars))
    tokens.add(f"\x00words{min(int(np.log2(n)), 8)}")
    out = set()
    for t in tokens:
        c = cache.get(t)
        if c is None:
            if len(cache) >= CACHE_TOKENS:
                cache.clear()
            c = cache[t] = cell(t)
        out.add(c)
    return out


@dataclass
class Model:
    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        return [float(1 / (1 + np.exp(np.clip(t - score, -40, 40)))) for t in self.thresholds]

    def score(self, cells: Iterable[int]) -> float:
        get = self.weights.get
        return float(sum(sorted(w for w in map(get, cells) if w is not None)))


def fit(rows: list[tuple[int, np.ndarray]], rounds: int = 400, l1: float = 1e-4, rate: float = 0.5, grades: int | None = None) -> Model:
    """Proximal gradient with L1, cells seen in at least ``LEAST_DOCS`` rows only; thresholds stay ordered.

    Without rows, or with one grade only, the model has no weights and accepts everything.
    """
    top = grades - 1 if grades else max((g for g, _ in rows), default=1)
    if len({g for g, _ in rows}) < 2:
        return Model({}, [-40.0] * max(top, 1))
    cells, counts = np.unique(np.concatenate([np.asarray(x, dtype=np.int64) for _, x in rows]), return_counts=True)
    cells = cells[counts >= LEAST_DOCS]
    index, starts, at = [], [], 0
    for _, x in rows:
        found = np.searchsorted(cells, x := np.sort(np.asarray(x, dtype=np.int64)))
        ok = (found < len(cells)) & (cells[np.minimum(found, len(cells) - 1)] == x) if len(cells) else np.zeros(len(x), bool)
        starts.append(at)
        index.append(found[ok])
        at += int(ok.sum())
    index.append(np.array([len(cells)]))  # keeps the last start inside
    flat, starts, y = np.concatenate(index), np.array(starts), np.array([g for g, _ in rows])
    row_of = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, at)))
    body, m = flat[:-1], len(rows)
    share = np.bincount(y, minlength=top + 1) / m
    theta = np.log(np.clip(np.cumsum(share)[:-1], 1e-4, 1 - 1e-4) / np.clip(1 - np.cumsum(share)[:-1], 1e-4, 1))
    w, seen = np.zeros(len(cells)), np.full(len(cells), 1e-8)
    seen_t = np.full(top, 1e-8)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(rounds):
        f = np.bincount(row_of, weights=w[body], minlength=m)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sigma(edges[y + 1] - f), sigma(edges[y] - f)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        df = (dhi - dlo) / p / m  # of the negative log-likelihood by the score
        g = np.bincount(body, weights=df[row_of], minlength=len(cells))
        gt = np.array([-(dhi[y == k] / p[y == k]).sum() + (dlo[y == k + 1] / p[y == k + 1]).sum() for k in range(top)]) / m
        seen += g * g
        seen_t += gt * gt
        step = rate / np.sqrt(seen)
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        theta = np.maximum.accumulate(theta - rate / np.sqrt(seen_t) * gt)
    return Model({int(c): float(x) for c, x in zip(cells, w) if x}, [float(t) for t in theta])


def training_rows(docs: DataFrame, labels: DataFrame, grade: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, np.ndarray]]:
    """Grade and cells of at most ``sample_rows`` labelled documents: those of smallest hashed identifier.

    Rows are whole: where the cells of so many rows exceed ``SAMPLE_CELLS``, fewer rows are taken, in the same
    order. A document labelled more than once has its lowest grade; rows that repeat it are one. Only cells in
    at least ``LEAST_DOCS`` rows are sent to the driver, since the fit uses no others.
    """
    spark = docs.sparkSession
    graded = labels.select(F.col(id_col).alias("_id"), (default_grade() if grade is None else grade).alias("_grade")).filter("_id IS NOT NULL AND _grade IS NOT NULL")
    known = graded.groupBy("_id").agg(F.min("_grade").cast("int").alias("_grade")).withColumn("_hash", F.xxhash64("_id"))
    # of many labels, all but a few times the sample are passed over by hash, so that no task sends the driver a whole sample
    share = min(1.0, 3 * sample_rows / max(known.count(), 1))
    near = known.filter(F.pmod("_hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = near.orderBy(F.pmod("_hash", F.lit(1 << 30)), "_id").limit(sample_rows).collect()
    if not chosen:
        return []
    kind = graded.schema["_id"].dataType.simpleString()
    wanted = spark.createDataFrame([(r["_id"], r["_grade"]) for r in chosen], f"_id {kind}, _grade int")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted), "_id")

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            cells = [sorted(features(t, cache)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cells, pa.list_(pa.int64()))], names=["_id", "_grade", "_cells"])

    schema = f"_id {kind}, _grade int, _cells array<long>"
    sample = materialize(texts.select("_id", "_text", "_grade").mapInArrow(run, schema), "sample", BATCH_ROWS)
    sizes = {r["_id"]: r["n"] for r in sample.groupBy("_id").agg(F.max(F.size("_cells")).alias("n")).collect()}
    total, fits = 0, []  # at most sample_rows of them
    for r in chosen:
        total += sizes.get(r["_id"], 0)
        if total <= SAMPLE_CELLS:
            fits.append((r["_id"],))
    if total > SAMPLE_CELLS:
        sample = sample.join(F.broadcast(spark.createDataFrame(fits, f"_id {kind}")), "_id").select(*sample.columns)
    often = sample.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    sent = spark.sparkContext.broadcast(np.sort(often.select("_cell").toArrow()["_cell"].to_numpy()))

    @tidy
    def common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [np.intersect1d(x.values.to_numpy(), sent.value, assume_unique=True) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int64()))], names=["_id", "_grade", "_cells"])

    table = sample.mapInArrow(common, schema).toArrow().combine_chunks()
    cells = table["_cells"].combine_chunks()
    values, ends = cells.values.to_numpy(), cells.offsets.to_numpy()  # not as Python integers: a sample has millions
    rows: dict = {}
    for k, (i, g) in enumerate(zip(table["_id"].to_pylist(), table["_grade"].to_pylist())):
        own = values[ends[k] : ends[k + 1]]
        if i not in rows or own.tobytes() < rows[i][1].tobytes():
            rows[i] = (g, own)
    return [rows[i] for i in sorted(rows)]


def grade(docs: DataFrame, model: Model, accept_grade: int = 2, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, expected_grade, tail_prob (of ``accept_grade`` or better), grade_pred, kept.

    Whole texts are read; null and empty ones have shape features only and are graded like any other. Rows
    that repeat are graded alike, ties in grade_pred go to the lower grade, an empty table gives an empty one.
    Only identifier and text are read, so other columns cannot clash.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # as many as the sample has cells
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    names = [id_col, "expected_grade", "tail_prob", "grade_pred", "kept"]
    schema = f"`{id_col}` {rows.schema['_id'].dataType.simpleString()}, expected_grade double, tail_prob double, grade_pred int, kept boolean"

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = Model(*sent.value), {}
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                tails = [own.tails(own.score(features(t, cache))) for t in part.column(1).to_pylist()]
                probs = [[a - b for a, b in zip([1.0, *t], [*t, 0.0])] for t in tails]
                tail = [t[accept_grade - 1] if accept_grade <= len(t) else 0.0 for t in tails]
                out = [part.column(0), pa.array([sum(t) for t in tails], pa.float64()), pa.array(tail, pa.float64()), pa.array([p.index(max(p)) for p in probs], pa.int32()), pa.array([x >= accept for x in tail], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(run, schema)


def accept_rows(docs: DataFrame, model: Model, accept_grade: int = 2, accept: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`grade` accepts, all columns kept, without a shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        own, cache = Model(*sent.value), {}
        tails = [own.tails(own.score(features(t.as_py(), cache))) for t in texts]
        return pa.array([(t[accept_grade - 1] if accept_grade <= len(t) else 0.0) >= accept for t in tails], pa.bool_())

    return docs.filter(accepted(F.col(text_col)))
