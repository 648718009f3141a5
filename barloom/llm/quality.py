"""Quality scores by a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in cycles: each step fits a tree of
depth two to the residuals over one feature's bins and adds it to that feature's table; pairs that explain most
of what is left get two-way tables the same way. A score is then a sum of table look-ups, done for whole
batches at once.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.memory import claim

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "distinct_trigrams", "top_word", "upper", "digits", "marks", "symbols", "bars", "spaces",
    "sentences", "line_length", "distinct_lines", "beyond_ascii", "marked_words", "bare_bars", "byte_entropy",
)
#: labelled rows that a fit reads at most: the rows with the smallest hashes of their id. The fit's cost and
#: what reaches the driver (this many rows of 19 numbers, 3 MB) are bounded by it.
SAMPLE = 20_000
THRESHOLD = 0.3

_CLASS = np.zeros((256, 7))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = ("A" <= _c <= "Z", "0" <= _c <= "9", _c in ".,;:!?'\"()-", _c in "#$%&*@^~_+=<>\\/{}[]", _c == "|", _c in " \t\n\r", _b >= 128)


def text_features(text: str | None) -> list[float]:
    """Numbers of a whole text; an empty or null text gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(data)
    upper, digits, marks, symbols, bars, spaces, beyond = (counts @ _CLASS) / n
    p = counts[counts > 0] / n
    words = text.split()
    w = max(1, len(words))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    lines = text.split("\n")
    ends = sum(k for x, k in seen.items() if not x[-1].isalnum() and x[-1] not in ".,;:!?\"')")
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / w, len(seen) / w, trigrams / max(1, len(words) - 2), max(seen.values(), default=0) / w,
        upper, digits, marks, symbols, bars, spaces, (counts[46] + counts[33] + counts[63]) / w, np.log1p(n / len(lines)), len(set(lines)) / len(lines), beyond,
        ends / w, seen.get("|", 0) / w, float(-(p * np.log2(p)).sum()),
    ]


@dataclasses.dataclass
class Model:
    """Cuts and tables; ``score`` is the only thing executors need."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (cut, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += values[np.searchsorted(cut, x[:, k], side="right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for k in {k for i, j, _ in self.pairs for k in (i, j)}}
        for i, j, values in self.pairs:
            total += values[bins[i], bins[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]


def _tree(grad: np.ndarray, weight: np.ndarray, depth: int = 2, least: float = 2.0, ridge: float = 1.0) -> np.ndarray:
    """Values by bin of a tree over ordered bins that lowers the loss most; Newton steps in its leaves."""
    out = np.empty(len(grad))

    def leaf(a: int, b: int) -> float:
        return grad[a:b].sum() / (weight[a:b].sum() + ridge)

    def grow(a: int, b: int, left: int) -> None:
        if left and b - a > 1:
            g, h = np.cumsum(grad[a:b]), np.cumsum(weight[a:b])
            gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
            gain = np.where((h[:-1] >= least) & (h[-1] - h[:-1] >= least), gain, -1.0)
            k = int(gain.argmax())
            if gain[k] > g[-1] ** 2 / (h[-1] + ridge) + 1e-9:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = leaf(a, b)

    grow(0, len(grad), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 8, rate: float = 0.15, bins: int = 48, coarse_bins: int = 8) -> Model:
    """Cyclic boosting on the logistic loss. Without rows, or with rows of one label, the score is the label mean, smoothed."""
    base = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(base / (1 - base)))
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        none = [np.empty(0)] * width
        return Model(base, none, [np.zeros(1)] * width, none, [])
    cuts = _cuts(x, bins)
    binned = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    margin = np.full(len(y), base)

    def residual():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k in range(width):
            r, w = residual()
            size = len(tables[k])
            step = rate * _tree(np.bincount(binned[k], r, size), np.bincount(binned[k], w, size))
            tables[k] += step
            margin += step[binned[k]]
    coarse = _cuts(x, coarse_bins)
    grid = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(coarse)]
    sizes = [len(c) + 1 for c in coarse]
    r, w = residual()
    gains = []
    for i in range(width):
        for j in range(i):
            cell = grid[i] * sizes[j] + grid[j]
            g, h = np.bincount(cell, r, sizes[i] * sizes[j]), np.bincount(cell, w, sizes[i] * sizes[j])
            gains.append(((g * g / (h + 5.0)).sum(), i, j))
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(gains, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, values in pairs:
            r, w = residual()
            cell = grid[i] * sizes[j] + grid[j]
            g = np.bincount(cell, r, values.size).reshape(values.shape)
            h = np.bincount(cell, w, values.size).reshape(values.shape)
            # a tree over rows, then one over columns within each of its leaves
            rows = _tree(g.sum(axis=1), h.sum(axis=1), depth=1)
            step = np.empty_like(values)
            for value in np.unique(rows):
                at = rows == value
                step[at] = _tree(g[at].sum(axis=0), h[at].sum(axis=0), depth=1)
            values += rate * step
            margin += rate * step[grid[i], grid[j]]
    return Model(base, cuts, tables, coarse, pairs)


def held_out(doc_id) -> object:
    """Rows that no fit sees: crc32 of the id as text, modulo 5, is 0. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


VECTOR = "array<double>"


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("quality")
    for batch in batches:
        rows = [text_features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; rows without a label, id or text match are left out."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("_id").isNotNull() & ~held_out(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # a bound on the fit, not on what is scored
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "_id")
    got = rows.select("y", "text").mapInArrow(_vectors, f"y double, x {VECTOR}").toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    y = (got.column("y").to_numpy() > 0).astype(float)
    order = np.lexsort((y, *x.T))  # the same fit in whatever order the rows come
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; a null text scores as an empty one, repeated rows stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(2)]).reshape(-1, len(FEATURES))
            s = np.round(model.score(x), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int"
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` at least."""
    names = docs.columns
    schema = docs.schema

    def run(batches):
        claim("quality")
        at = names.index("text")
        for batch in batches:
            x = np.array([text_features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(np.round(model.score(x), 6) >= threshold))

    return docs.mapInArrow(run, schema)
