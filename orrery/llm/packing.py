"""Packing of token sequences by minimum bin slack.

Every document is tokenized whole and ends with a separator. Pieces of exactly the window's length are cut off first;
what remains of each document is shorter than a window. Each partition then fills windows from the multiset of its
remaining lengths: a subset-sum bitset, with one state for each distinct length, finds the reachable total closest to
the window's capacity; counts are backtracked through the states, and the same filling is repeated as long as its
lengths last. Only lengths and digests are held for a partition, never its texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary, share_vocabulary
from .common import chunks, offsets

#: A sequence's identifier is its partition's number times this, plus its number in the partition.
SEQUENCES_IN_PARTITION = 1 << 32

SCHEMA = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def library_words(vocabulary: Vocabulary):
    """A compiled encoder of single words, where the vocabulary's ids follow its merges' order; else None."""
    import tiktoken

    first = np.sort(vocabulary.merged)
    if not np.array_equal(first, vocabulary.merged) or vocabulary.byte_ids.max() >= first[0]:
        return None
    raw, at = vocabulary.token_bytes.tobytes(), vocabulary.token_at.tolist()
    ids = [*vocabulary.byte_ids.tolist(), *vocabulary.merged.tolist()]
    core = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks={raw[at[i] : at[i + 1]]: i for i in ids}, special_tokens={})
    return lambda words: [core.encode_ordinary(w.decode()) for w in words]  # its pattern takes a whole word


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to put in one window so that its slack is least; longer lengths are preferred."""
    states, reach, full = [], 1, (1 << capacity + 1) - 1
    lengths = sorted((n for n, c in counts.items() if c and n <= capacity), reverse=True)
    for n in lengths:
        states.append(reach)
        left, part = min(counts[n], capacity // n), 1
        while left:  # binary parts of the count
            part = min(part, left)
            reach |= reach << n * part & full
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, before in zip(reversed(lengths[: len(states)]), reversed(states), strict=True):
        k = 0
        while not before >> total & 1:
            total -= n
            k += 1
        if k:
            chosen[n] = k
    return chosen


def plan(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, until nothing remains. Each length is at most the capacity."""
    counts = {n: c for n, c in counts.items() if c}
    while counts:
        # the longest piece must go somewhere: the window is built around it
        longest = max(counts)
        counts[longest] -= 1
        chosen = fill(counts, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        yield chosen, times


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document and their places in sequences of at most `window` tokens.

    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is the separator alone.
    Repeated rows and rows of a null id are packed as often as they come. An empty table gives no pieces. Columns other than the two named
    are not read. A sequence lies within one partition of the input, so no tokens are shuffled.
    """
    shared = share_vocabulary(docs, tokenizer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.of(*shared, words=library_words)
        sequence = TaskContext.get().partitionId() * SEQUENCES_IN_PARTITION
        rest: list[pd.DataFrame] = []
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in chunks(texts):
                ids, counts = enc.encode(texts[a:b])
                at = offsets(counts)
                flat = np.insert(ids.astype("<u4"), at[1:], end_id)
                counts = counts + 1
                at = offsets(counts)
                pieces = (counts + window - 1) // window
                doc = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(doc)) - offsets(pieces)[doc]) * window
                length = np.minimum(window, counts[doc] - start)
                raw, begin = flat.tobytes(), 4 * (at[doc] + start)
                crc = [zlib.crc32(raw[p : p + 4 * n]) for p, n in zip(begin.tolist(), length.tolist(), strict=True)]
                out = pd.DataFrame({"id": batch["id"].to_numpy()[a:b][doc], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": counts[doc]})
                full = out[out["length"] == window]
                rest.append(out[out["length"] < window])
                if len(full):
                    yield full.assign(sequence_id=sequence + np.arange(len(full)), offset=0)
                    sequence += len(full)
        if not rest or not sum(map(len, rest)):
            return
        left = pd.concat(rest).sort_values(["length", "id", "start"], ascending=False, kind="stable").reset_index(drop=True)
        length = left["length"].to_numpy()
        sizes, first, count = np.unique(length, return_index=True, return_counts=True)
        used = dict(zip(sizes.tolist(), first.tolist(), strict=True))
        where, place = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for chosen, times in plan(dict(zip(sizes.tolist(), count.tolist(), strict=True)), window):
            at = 0
            for n in sorted(chosen, reverse=True):
                for _ in range(chosen[n]):
                    rows = slice(used[n], used[n] + times)
                    where[rows], place[rows] = sequence + np.arange(times), at
                    used[n] += times
                    at += n
            sequence += times
        yield left.assign(sequence_id=where, offset=place)

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, SCHEMA).withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
