"""Language of a text by a small convolutional network over bytes, trained here with numpy.

A text's bytes are cut into windows of a fixed length, all of them are classified, and a text's scores are the mean of
its windows' by length. The network: filters over 2, 3 and 4 neighbouring bytes, the maximum of each filter over the
window, and a softmax. As its input is a byte's one-hot code, a filter is a sum of rows of tables, and the tables of
neighbouring bytes are added up to tables of byte pairs before use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept_rows, sampled

#: Bytes in a window, labelled documents learned from at most, and windows taken of each.
WINDOW, SAMPLE, PER_DOCUMENT = 256, 4000, 2
WIDTHS, FILTERS, EPOCHS, BATCH = (2, 3, 4), 12, 12, 64
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width (width, 256, filters)
    bias: np.ndarray
    out: np.ndarray  # (all filters, languages)
    out_bias: np.ndarray
    wide: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"wide": None}

    def pairs(self) -> list[list[np.ndarray]]:
        """Each width's tables of byte pairs (65536, filters), and one of single bytes where a byte is left."""
        if self.wide is None:
            self.wide = []
            for t in self.tables:
                two = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for k in range(0, len(t) - 1, 2)]
                self.wide.append(two + ([t[-1].astype(np.float32)] if len(t) % 2 else []))
        return self.wide

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """(windows, all filters): each filter's maximum. windows: bytes (n, length), zeros after a text's end."""
        pair = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        out = []
        for width, tables in zip(WIDTHS, self.pairs(), strict=True):
            n = windows.shape[1] - width + 1
            total = tables[0][pair[:, :n]]
            for k, t in enumerate(tables[1:], 1):
                total += t[pair[:, 2 * k : 2 * k + n]] if len(t) > 256 else t[windows[:, 2 * k : 2 * k + n]]
            out.append(total.max(1))
        return np.maximum(np.concatenate(out, 1) + self.bias.astype(np.float32), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows).astype(np.float64) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 0, epochs: int = EPOCHS, rate: float = 0.02) -> Network:
    """Gradient descent with Adam on cross entropy. windows: (n, WINDOW) bytes; labels: indices of languages."""
    r = np.random.default_rng(seed)
    filters = FILTERS * len(WIDTHS)
    values = {f"t{k}": r.normal(0, 0.1, (w, 256, FILTERS)) for k, w in enumerate(WIDTHS)} | {"b": np.zeros(filters), "o": r.normal(0, 0.1, (filters, len(languages))), "ob": np.zeros(len(languages))}
    mean, square = ({k: np.zeros_like(v) for k, v in values.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(windows))
        for start in range(0, len(order), BATCH):
            x, y = windows[order[start : start + BATCH]], labels[order[start : start + BATCH]]
            pooled, where = [], []
            for k, w in enumerate(WIDTHS):
                n = x.shape[1] - w + 1
                total = sum(values[f"t{k}"][j][x[:, j : j + n]] for j in range(w))
                at = total.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0])
            before = np.concatenate(pooled, 1) + values["b"]
            h = np.maximum(before, 0)
            z = h @ values["o"] + values["ob"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            slopes = {"o": h.T @ p, "ob": p.sum(0)}
            back = (p @ values["o"].T) * (before > 0)
            slopes["b"] = back.sum(0)
            for k, w in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                slope = np.zeros_like(values[f"t{k}"])
                for j in range(w):
                    byte = np.take_along_axis(x, where[k] + j, 1)
                    np.add.at(slope[j], (byte, np.arange(FILTERS)[None, :]), part)
                slopes[f"t{k}"] = slope
            step += 1
            for k, g in slopes.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                values[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Network(languages, [values[f"t{k}"] for k in range(len(WIDTHS))], values["b"], values["o"], values["ob"])


def cut(texts: Sequence[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (n, window), the text of each, and its own length; a last window is filled with zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(-(-sizes // window), 1)
    out = np.frombuffer(b"".join(t + bytes(int(n) * window - len(t)) for t, n in zip(texts, count, strict=True)), np.uint8).reshape(-1, window)
    owner = np.repeat(np.arange(len(texts)), count)
    first = np.cumsum(count) - count
    length = np.minimum(window, sizes[owner] - (np.arange(len(owner)) - first[owner]) * window)
    return out, owner, np.maximum(length, 1)


def fit(docs: DataFrame, learnable: Column, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", seed: int = 0) -> Network | None:
    """Trains on windows of at most `sample` labelled documents, taken by a hash of their ids; None without any.

    From each document PER_DOCUMENT windows are taken, from anywhere in the text by the hash.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learnable)
    length = F.greatest(F.length(text_col) - WINDOW, F.lit(1))
    parts = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), length) + 1).cast("int"), F.lit(WINDOW)).alias(f"part{k}") for k in range(PER_DOCUMENT)]
    taken = sampled(rows, sample, id_col).select(F.col(lang_col).alias("lang"), *parts).toPandas()
    if not len(taken):
        return None
    languages = sorted(taken["lang"].unique())
    number = {x: k for k, x in enumerate(languages)}
    texts = [t.encode()[:WINDOW] for k in range(PER_DOCUMENT) for t in taken[f"part{k}"]]
    labels = np.array([number[x] for _ in range(PER_DOCUMENT) for x in taken["lang"]])
    return train(cut(texts)[0], labels, languages, seed)


def classified(texts: Sequence[str | None], network: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each whole text; windows are classified in groups, so memory doesn't grow with a text's length."""
    known = [t is not None and network is not None and bool(LETTER.search(t)) for t in texts]
    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    rows = [k for k, yes in enumerate(known) if yes]
    start = 0
    while start < len(rows):
        stop, size = start, 0
        while stop < len(rows) and (stop == start or size + len(texts[rows[stop]]) < 1 << 18):
            size += len(texts[rows[stop]])
            stop += 1
        windows, owner, length = cut([texts[k].encode() for k in rows[start:stop]])
        p = np.concatenate([network.probabilities(windows[k : k + 256]) for k in range(0, len(windows), 256)])
        total = np.zeros((stop - start, p.shape[1]))
        np.add.at(total, owner, p * length[:, None])
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        own = rows[start:stop]
        lang[own] = np.array(network.languages, object)[best]
        score[own] = total[np.arange(len(best)), best]
        start = stop
    return lang, score


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    A null text and one without letters is `und` with score 0; so is every text without a trained network. Any text is
    read to its end. Repeated rows and rows of a null id are judged like any other. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = classified(batch["text"].tolist(), network)
            yield pd.DataFrame({"id": batch["id"], "lang_pred": lang, "score": score})

    bounded_batches(docs)
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, lang_pred string, score double").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def recognised(docs: DataFrame, network: Network | None, sure: float, text_col: str = "text") -> DataFrame:
    """The rows whose language is known with a score of `sure` at least, with all their columns."""

    def decide(texts: list[str | None]) -> Sequence[bool]:
        lang, score = classified(texts, network)
        return (lang != UNKNOWN) & (score >= sure)

    return kept_rows(docs, text_col, decide)
