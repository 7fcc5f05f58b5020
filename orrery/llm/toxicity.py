"""Toxicity by a weighted lexicon, found with an Aho-Corasick automaton in folded text.

The lexicon is learned from a bounded sample of labelled documents: words, and beginnings of words, that come in toxic
documents far more often than in others. Exception phrases, a term with the word before or behind it, are learned where
clean documents have them far more often than toxic ones; more can be given. A document's hits, without those inside
exceptions, are summed by weight and normalised by its length; two logistic weights turn sum and density into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept_rows, sampled

# Characters of other scripts and signs that look like Latin letters, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "@": "a", "$": "s", "€": "e",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
INVISIBLE = "​‌‍⁠﻿­"

#: Labelled documents learned from, at most; beginnings of words are this long.
SAMPLE, SHORTEST, LONGEST = 6000, 4, 12
#: Toxic documents that a term must be in: at least this share of the toxic ones learned from, between these bounds; and the
#: smoothed share of toxic documents among those it is in.
LEAST_SHARE, LEAST, SHARE = 0.02, (2, 5), 0.85

#: Clean documents that an exception must be in, and the smoothed share of clean documents among those it is in.
SPARED, CLEAN_SHARE = 3, 0.8
#: Letters with single signs between them, as in a.b.c, and signs that a letter is decomposed to.
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·|/][^\W\d_]){2,}(?![^\W_])")
BETWEEN = re.compile(r"[.\-_*·|/]")


def folding() -> dict[int, str | None]:
    """For str.translate after lower-casing: full-width forms and homoglyphs to Latin, invisible characters away."""
    wide = {0xFF01 + k: chr(0x21 + k) for k in range(94)}
    return {k: v.lower() for k, v in wide.items()} | {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE}


FOLD = folding()
DIGIT_FOLD = {ord(k): v for k, v in DIGITS.items()}


def fold(text: str) -> str:
    """Lower case, without disguise: compatible forms, accents, look-alikes, invisible characters, letters spelled out.

    Digits become letters only in words that have letters too.
    """
    text = text.lower()
    if not text.isascii():
        text = "".join([c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)]).lower().translate(FOLD)
    elif "@" in text or "$" in text:
        text = text.translate(FOLD)
    text = SPELLED.sub(lambda m: BETWEEN.sub("", m[0]), text)
    if not any(d in text for d in DIGITS):
        return text
    return " ".join([w.translate(DIGIT_FOLD) if not w.isalpha() and any(c.isalpha() for c in w) and any(c.isdigit() for c in w) else w for w in text.split(" ")])


@dataclass
class Lexicon:
    """Terms with weights; a term that ends in `*` fits the beginnings of words, any other only whole words."""

    weights: dict[str, float]
    exceptions: Sequence[str] = ()
    logistic: tuple[float, float, float] = (-3.0, 1.0, 0.3)
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                key = term.rstrip("*")
                old = found.get(key, (0, 0.0, 0.0, False))
                whole, begin = (old[1], max(old[2], weight)) if term.endswith("*") else (max(old[1], weight), old[2])
                found.add_word(key, (len(key), whole, begin, False))
            for phrase in map(fold, self.exceptions):
                old = found.get(phrase, (0, 0.0, 0.0, False))
                found.add_word(phrase, (len(phrase), old[1], old[2], True))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def words_hit(self, folded: str) -> dict[int, float]:
        """Where words begin that a term fits, each with its heaviest term's weight; those in exceptions are left out."""
        words: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        n = len(folded)
        if not len(self.automaton()):
            return words
        for end, (size, whole, begin, spares) in self.automaton().iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum():
                continue
            ends = end + 1 == n or not folded[end + 1].isalnum()
            if spares and ends:
                spared.append((start, end))
            weight = whole if whole > begin and ends else begin
            if weight > words.get(start, 0.0):
                words[start] = weight
        for a, b in spared:
            for start in [s for s in words if a <= s <= b]:
                del words[start]
        return words

    def hits(self, folded: str) -> tuple[int, float]:
        """Number and weight of the words that a term fits."""
        words = self.words_hit(folded)
        return len(words), sum(words.values())

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        _, weight = self.hits(folded)
        return math.log1p(weight), math.log1p(100 * weight / (1 + folded.count(" ")))

    def score(self, text: str) -> float:
        total, dense = self.features(text)
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-(a + b * total + c * dense)))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE, exceptions: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Learns a lexicon from at most `sample` labelled rows, taken by a hash of their ids.

    Only words and their document counts reach the driver, and only those frequent and pure enough. Rows with a label
    other than 0 and 1, or a null text, are left out. Without labelled rows the lexicon is empty and every score is low.
    """
    bounded_batches(docs)
    chosen = sampled(labels.filter(F.col(label_col).isin(0, 1) & learnable).select(id_col, F.col(label_col).cast("int").alias("y")), sample, id_col)
    rows = docs.select(id_col, F.col(text_col).alias("text")).filter("text is not null").join(F.broadcast(chosen), id_col).select("text", "y")
    rows = rows.persist()
    try:
        totals = rows.agg(F.sum("y"), F.count("*")).first()
        toxic, clean = int(totals[0] or 0), int((totals[1] or 0) - (totals[0] or 0))
        if not toxic or not clean:
            return Lexicon({}, exceptions)  # nothing is learned from labels of one kind

        def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import regex

            pattern = regex.compile(r"\p{L}[\p{L}\p{N}]*")
            for batch in batches:
                counts: dict[str, list[int]] = {}
                for text, y in zip(batch["text"], batch["y"], strict=True):
                    own = set()
                    for word in set(pattern.findall(fold(text))):
                        own.add(word)
                        own.update(word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
                    for term in own:
                        counts.setdefault(term, [0, 0])[y] += 1
                if counts:
                    yield pd.DataFrame({"term": list(counts), "clean": [c for c, _ in counts.values()], "toxic": [t for _, t in counts.values()]})

        # toxic documents weigh as much as the others
        balanced = F.col("toxic") / toxic / (F.col("toxic") / toxic + (F.col("clean") + 0.5) / clean)
        found = rows.mapInPandas(words, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        least = min(max(round(LEAST_SHARE * toxic), LEAST[0]), LEAST[1])
        found = found.filter((F.col("toxic") >= least) & (balanced >= SHARE) & (F.col("clean") * 4 <= F.col("toxic")))
        terms = {r["term"]: (r["clean"], r["toxic"]) for r in found.collect()}
        weights = {t: math.log((n + 0.5) / toxic) - math.log((c + 0.5) / clean) for t, (c, n) in terms.items()}
        # a longer beginning says nothing that a shorter one of the same weight doesn't
        kept = {}
        for term in sorted(weights, key=len):
            shorter = [kept.get(term.rstrip("*")[:n] + "*", 0.0) for n in range(SHORTEST, len(term.rstrip("*")) + (not term.endswith("*")))]
            if weights[term] > max(shorter, default=0.0) + 0.7 or not shorter or max(shorter) == 0:
                kept[term] = weights[term]
        lexicon = Lexicon(kept, exceptions)

        def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                counts: dict[str, list[int]] = {}
                for text, y in zip(batch["text"], batch["y"], strict=True):
                    folded = fold(text)
                    for phrase in {p for start in lexicon.words_hit(folded) for p in around(folded, start)}:
                        counts.setdefault(phrase, [0, 0])[y] += 1
                if counts:
                    yield pd.DataFrame({"phrase": list(counts), "clean": [c for c, _ in counts.values()], "toxic": [t for _, t in counts.values()]})

        spares = F.col("clean") / clean / (F.col("clean") / clean + (F.col("toxic") + 0.5) / toxic)
        phrases = rows.mapInPandas(contexts, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        learned = [r["phrase"] for r in phrases.filter((F.col("clean") >= SPARED) & (spares >= CLEAN_SHARE)).orderBy("phrase").collect()]
        lexicon = Lexicon(kept, [*exceptions, *learned])

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = [lexicon.features(t) for t in batch["text"]]
                yield pd.DataFrame({"y": batch["y"], "total": [a for a, _ in x], "dense": [b for _, b in x]})

        x = rows.mapInPandas(features, "y int, total double, dense double").toPandas()
    finally:
        rows.unpersist()
    lexicon.logistic = logistic(x["total"].to_numpy(), x["dense"].to_numpy(), x["y"].to_numpy(float))
    return lexicon


def around(folded: str, start: int) -> list[str]:
    """A word with the word before it, and with the word behind it, where one blank is between them."""
    end = start
    while end < len(folded) and folded[end].isalnum():
        end += 1
    out = []
    if start > 1 and folded[start - 1] == " " and folded[start - 2].isalnum():
        before = start - 1
        while before and folded[before - 1].isalnum():
            before -= 1
        out.append(folded[before:end])
    if end + 1 < len(folded) and folded[end] == " " and folded[end + 1].isalnum():
        behind = end + 1
        while behind < len(folded) and folded[behind].isalnum():
            behind += 1
        out.append(folded[start:behind])
    return out


def logistic(total: np.ndarray, dense: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1.0) -> tuple[float, float, float]:
    """Weights of a logistic regression by Newton steps; both slopes stay positive, so more hits never lower a score."""
    x = np.stack([np.ones_like(total), total, dense], 1)
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return float(w[0]), max(float(w[1]), 0.01), max(float(w[2]), 0.01)


def scored(texts: Sequence[str | None], lexicon: Lexicon) -> tuple[list[float], list[int]]:
    """Score and number of hits of each whole text."""
    a, b, c = lexicon.logistic
    score, count = [], []
    for text in texts:
        folded = fold(text or "")
        n, weight = lexicon.hits(folded)
        z = a + b * math.log1p(weight) + c * math.log1p(100 * weight / (1 + folded.count(" ")))
        count.append(n)
        score.append(1 / (1 + math.exp(-z)))
    return score, count


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_hits) of every whole text; a null or empty text has no hits and the lowest score.

    Repeated rows and rows of a null id are scored like any other. An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score, count = scored(batch["text"].tolist(), lexicon)
            yield pd.DataFrame({"id": batch["id"], "score": score, "predicted": [int(s >= threshold) for s in score], "n_hits": count})

    bounded_batches(docs)
    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, score double, predicted int, n_hits int").withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)


def clean_rows(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    return kept_rows(docs, text_col, lambda texts: [s < threshold for s in scored(texts, lexicon)[0]])
