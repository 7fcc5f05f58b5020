"""Quality of texts: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every whole text becomes a short vector of statistics, and only these are moved. Cosines of random projections of the
standardised statistics approximate a Gaussian kernel. Each task sums up its part of the normal equations, one sum a fold,
and the sums are added in a shuffle by matrix row; so the driver gets a matrix of fixed size, whatever the number of labels.
Sums of all folds but one give weights that haven't seen the fold, and its squared error follows from the sums alone: this
chooses the ridge. Scores of rows by weights that haven't seen them are counted in bins, and an isotonic regression of the
labels on the bins calibrates the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Random features, seed of their projections, folds for choosing and calibrating, and ridges to choose from (in rows).
FEATURES, SEED, FOLDS, RIDGES = 256, 7, 4, (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
#: Width of the kernel in units of the root of the number of statistics, and standard deviations that statistics are clipped to.
WIDTH, CLIP = 1.0, 4.0
#: Bins of a unit of the score for the calibration.
BINS = 1024

LETTER, UPPER, DIGIT, BLANK, COMMON, SYMBOL = range(6)
#: Marks that plain prose uses.
PROSE_MARKS = ".,;:'\"?!-()¿¡«»’“”–"
STATISTICS = (
    "log_chars", "log_words", "word_length", "word_spread", "letters", "uppercase", "digits", "blanks", "marks", "symbols", "shouts", "distinct_words", "log_distinct",
    "same_as_last", "same_pairs", "top_word", "repeated_lines", "line_length", "longest_line", "sentences", "symbol_words", "number_words", "short_words", "capital_words", "foreign", "entropy", "distinct_chars",
)


@cache
def kinds() -> np.ndarray:
    """Kind of each character of the basic plane."""
    out = np.full(1 << 16, SYMBOL, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        out[k] = BLANK if c.isspace() else UPPER if c.isupper() else LETTER if c.isalpha() else DIGIT if c.isdigit() else COMMON if c in PROSE_MARKS else SYMBOL
    return out


def share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def describe(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of STATISTICS; those of a null or empty text are zero."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[np.minimum(codes, (1 << 16) - 1)]
    n = np.bincount(kind, minlength=6)
    chars, dense = len(codes), int(n.sum() - n[BLANK])
    counts = np.bincount(np.minimum(codes, 1023))
    p = counts[counts > 0] / chars
    words, lines = text.split(), [x for x in text.splitlines() if x.strip()]
    sizes = np.array([len(w) for w in words] or [0])
    seen, of_line = Counter(words), Counter(lines)
    pairs = Counter(zip(words, words[1:], strict=False))
    last = [w[-1] for w in words]
    ends = Counter(last)
    letters = int(n[LETTER] + n[UPPER])
    w = len(words)
    return [
        np.log1p(chars), np.log1p(w), sizes.mean(), sizes.std(), share(letters, dense), share(n[UPPER], letters), share(n[DIGIT], dense), share(n[BLANK], chars), share(n[COMMON], dense),
        share(n[SYMBOL], dense), share(text.count("!"), dense), share(len(seen), w), np.log1p(len(seen)) / np.log1p(w) if w else 0.0,
        share(sum(a == b for a, b in zip(words, words[1:], strict=False)), w), share(sum(pairs.values()) - len(pairs), w), share(max(seen.values(), default=0), w),
        share(len(lines) - len(of_line), len(lines)), np.log1p(share(chars, len(lines))), share(max(map(len, lines), default=0), chars), share(ends.get(".", 0), w),
        share(sum(c for x, c in ends.items() if not x.isalnum() and x not in PROSE_MARKS), w), share(sum(any(map(str.isdigit, x)) * c for x, c in seen.items()), w),
        share(int((sizes <= 3).sum()), w), share(sum(c for x, c in seen.items() if x[0].isupper()), w), share(int((codes > 127).sum()), chars), -(p * np.log(p)).sum(), np.log1p(len(p)),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row: the statistics of its whole text, with the id as it is."""
    bounded_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([[float(v) for v in describe(t)] for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    """Standardisation, random features, weights, and the steps of the calibration."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]
    constant: float | None = None
    left_out: list[np.ndarray] = field(default_factory=list)

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.spread)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chance of label 1 of each row of statistics."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.features(x) @ self.weights, *self.steps), 0.0, 1.0)


def fourier(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of rows of statistics, and a constant."""
    r = np.random.default_rng(SEED)
    d = len(mean)
    at = r.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES))
    turn = r.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / spread, -CLIP, CLIP)
    return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ at + turn), np.ones((len(x), 1))], axis=1)


def solved(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a ridge regression; the constant is free."""
    return np.linalg.solve(a + ridge * np.diag([*[1.0] * (len(b) - 1), 1e-9]), b)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the steps of the rising function closest to y at the ascending x (adjacent violators pooled)."""
    steps: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        steps.append([a * w, b * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last, strict=True)]
    return np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps])


def matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def fit(described: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Learns from all labelled rows of the learning folds; `learnable` reads the labels' own columns.

    described: (id, x) of statistics(), best as a written table, since it is read several times. Labels other than 0 and 1
    are left out; a row of a repeated id counts as often as it is labelled. Without labelled rows of both kinds the score
    is a constant, the smoothed share of label 1.
    """
    chosen = labels.filter(F.col(label_col).isin(0, 1) & learnable).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = described.join(chosen, "id").select("x", "y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"))
    d = len(STATISTICS)
    sums = rows.agg(F.count("*"), F.sum("y"), *(f(F.col("x")[k]) for k in range(d) for f in (F.avg, F.stddev_pop))).first()
    count, ones = int(sums[0]), float(sums[1] or 0)
    mean, spread = np.array([v or 0.0 for v in sums[2::2]]), np.array([v or 0.0 for v in sums[3::2]])
    spread = np.where(spread > 1e-9, spread, 1.0)
    if not 0 < ones < count:
        return Model(mean, spread, np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)), (ones + 1) / (count + 2))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's part of the sums of each fold: rows of z'z, with z'y behind; the last row is of y'z and y'y."""
        total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
        for batch in batches:
            z, y, fold = fourier(matrix(batch), mean, spread), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            z = np.concatenate([z, y[:, None]], axis=1)
            for k in range(FOLDS):
                total[k] += z[fold == k].T @ z[fold == k]
        at = [(k, i) for k in range(FOLDS) for i in range(FEATURES + 2)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), pa.array([total[k, i].tolist() for k, i in at], pa.list_(pa.float64()))], ["fold", "i", "part"])

    def added(key, parts):
        import pandas as pd

        return pd.DataFrame({"fold": [key[0]], "i": [key[1]], "part": [np.sum(np.stack(parts["part"].to_list()), axis=0).tolist()]})

    schema = "fold int, i int, part array<double>"
    parts = rows.mapInArrow(equations, schema).groupBy("fold", "i").applyInPandas(added, schema).collect()
    total = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2))
    for r in parts:
        total[r["fold"], r["i"]] = r["part"]
    whole = total.sum(0)

    def weights(sums: np.ndarray, ridge: float) -> np.ndarray:
        return solved(sums[:-1, :-1], sums[:-1, -1], ridge)

    def error(ridge: float) -> float:
        """Squared error of all rows by weights that haven't seen their fold."""
        w = [np.append(weights(whole - part, ridge), -1.0) for part in total]
        return sum(v @ part @ v for v, part in zip(w, total, strict=True))

    ridge = min(RIDGES, key=error)
    left_out = [weights(whole - part, ridge) for part in total]

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, fold = fourier(matrix(batch), mean, spread), batch.column("fold").to_numpy()
            raw = np.einsum("ij,ij->i", z, np.stack(left_out)[fold]) if len(fold) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(raw), batch.column("y")], ["raw", "y"])

    scored = rows.mapInArrow(unseen, "raw double, y double")
    bins = scored.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * BINS).alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    steps = isotonic(*(np.array([r[c] for r in bins], float) for c in ("raw", "y", "n")))
    return Model(mean, spread, weights(whole, ridge), steps, None, left_out)


def score(described: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row of statistics().

    A null or empty text has statistics of zero and the score of such. Repeated rows and rows of a null id are scored like
    any other. An empty table gives an empty result. Texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = described.schema["id"].dataType.simpleString()
    return described.select("id", "x").mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
