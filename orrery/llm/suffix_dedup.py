"""Removal of every byte that a repeated string of a given length covers, by suffix arrays.

Where strings of W bytes may start is cut into runs by content: a position belongs to the least hash among the short
strings inside its window, and neighbours of the same hash are one run. Equal windows have equal hashes, wherever they
stand, so a run can only share a window with runs of its own hash. Hashes that come once are done; the text of the
other runs goes to shards by hash, where a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai) find
equal windows. A hash whose runs have many bytes is dealt over several shards; each lists its windows once, sorted by
128-bit digests, and these lists are merged by binary search. Removed bytes then go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import bounded_batches, chunks, offsets, ranges, stored
from .minhash import mixed

WINDOW, SHORT = 200, 40
#: Bytes of one hash's runs in a shard, about; bytes whose suffixes are sorted together at least; windows of a run.
SHARD, SORTED, LONGEST = 1 << 19, 1 << 19, 1 << 15

KEY = ["k1", "k2"]

#: A window in the list of a shard: its digest, whether the shard itself has it twice, and one place where it starts.
LISTED = np.dtype([("digest", "S16"), ("settled", "i1"), ("k1", "i8"), ("k2", "i8"), ("at", "i8")])

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_powers = _inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    global _powers, _inverse
    if len(_powers) <= n:
        _powers, _inverse = np.full(n + 1, MULTIPLIER, np.uint64), np.full(n + 1, pow(int(MULTIPLIER), -1, 1 << 64), np.uint64)
        _powers[0] = _inverse[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverse, out=_inverse)
    return _powers, _inverse


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position. It only says where equal strings may be, never that they are equal."""
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * inverse[: len(data) - size + 1])


def sliding(least_or_most: np.ufunc, values: np.ndarray, size: int) -> np.ndarray:
    """Least or greatest of `size` neighbours from each position, by doubling."""
    width = 1
    while 2 * width <= size:
        values = least_or_most(values[:-width], values[width:])
        width *= 2
    left = size - width
    return least_or_most(values[: len(values) - left], values[left:]) if left else values


def runs(data: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts: their hash, first start and number, and at how many places the hash stands in them.

    A run whose hash stands at one place holds no window twice; so a hash that stands at one place anywhere is done.
    A long run, as of one letter repeated, is cut into pieces of its hash.
    """
    if len(data) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    width = window - short + 1
    hashes = rolling(data, short)
    least = sliding(np.minimum, hashes, width)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    number = np.diff(np.concatenate([first, [len(least)]]))
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero(hashes == sliding(np.maximum, np.concatenate([edge, least, edge]), width))
    a, b = np.searchsorted(chosen, first), np.searchsorted(chosen, first + number + width - 1)
    run = np.repeat(np.arange(len(first)), b - a)
    places = np.bincount(run, weights=hashes[chosen[ranges(a, b - a)]] == least[first][run], minlength=len(first)).astype(np.int64)
    pieces = -(-number // LONGEST)
    if len(pieces) and pieces.max() > 1:
        of = np.repeat(np.arange(len(first)), pieces)
        skip = (np.arange(len(of)) - offsets(pieces)[of]) * LONGEST
        return least[first][of], first[of] + skip, np.minimum(number[of] - skip, LONGEST), places[of]
    return least[first], first, number, places


def suffix_order(data: np.ndarray) -> np.ndarray:
    """All suffixes in their order; one that ends comes before those that go on.

    Ranks by 8 bytes are refined by the rank as many bytes further as are already sorted, which doubles that number;
    suffixes alone in their group are left out of later rounds.
    """
    n = len(data)
    big = np.ndarray((n,), ">u8", data.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    order = np.argsort(big, kind="stable")
    sorted_ = big[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.zeros(n + 1, np.int64)
    place = np.arange(n)
    group = np.maximum.accumulate(np.where(fresh, place, 0))
    rank[order] = group
    done = 8
    alone = fresh & np.concatenate([fresh[1:], [True]])
    open_ = np.flatnonzero(~alone)  # places in the order
    while len(open_):
        at = order[open_]
        over = at + done - n  # where the suffix has ended, the shorter one comes first
        own, next_ = rank[at], np.where(over < 0, rank[np.minimum(at + done, n)] + n, n - 1 - at)
        by = np.argsort(own * (2 * n + 2) + next_, kind="stable")
        at, own, next_ = at[by], own[by], next_[by]
        order[open_] = at
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (next_[1:] != next_[:-1])])
        group = np.maximum.accumulate(np.where(new, open_, 0))
        rank[at] = group
        alone = new & np.concatenate([new[1:], [True]])
        open_ = open_[~alone]
        done *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """min(most, common prefix of each suffix and the one before it in the order), by Kasai's inequality.

    In text order a prefix is at most one byte shorter than its left neighbour's. Every `stride`-th one is measured
    first; where the bounds from both sides meet, the ones between are known, and the others are measured from the
    lower bound on, all in step.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eights = np.ndarray((n,), "<u8", data.tobytes() + bytes(8), strides=(1,))
    out = np.zeros(n, np.int64)

    def measure(at: np.ndarray) -> None:
        at = at[before[at] >= 0]
        while len(at):
            a, b = at + out[at], before[at] + out[at]
            room = n - np.maximum(a, b)
            inside = room > 0
            at, a, b, room = at[inside], a[inside], b[inside], room[inside]
            differ = eights[a] ^ eights[b]
            # number of equal low bytes: the lowest set bit's place
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
            same = np.minimum(same, room)
            out[at] = np.minimum(out[at] + same, most)
            at = at[(same == 8) & (out[at] < most)]

    sample = np.arange(0, n, stride)
    measure(sample)
    place = np.arange(n)
    low = np.maximum(out[sample][place // stride] - place % stride, 0)
    following = np.minimum(place // stride + 1, len(sample) - 1)
    high = np.where(sample[following] > place, out[sample][following] + sample[following] - place, most)
    high = np.minimum(high, most)
    rest = np.ones(n, bool)
    rest[sample] = False
    out = np.where(rest, np.minimum(low, most), out)
    # a suffix without a predecessor has no common prefix
    measure(np.flatnonzero(rest & (low < high)))
    out[before < 0] = 0
    return out[order]


def repeated(texts: Sequence[bytes], window: int) -> list[np.ndarray]:
    """For each text the starts of windows that also start elsewhere in these texts; a window lies within one text."""
    bounds = offsets([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order = suffix_order(data)
    lcp = common_prefixes(data, order, window)
    group = np.cumsum(lcp < window) - 1 if lcp[0] < window else np.cumsum(lcp < window)
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(data))
    whole = (room >= window)[order]
    many = np.bincount(group, weights=whole)[group] > 1
    starts = np.sort(order[many & whole])
    edges = np.searchsorted(starts, bounds)
    return [starts[a:b] - o for a, b, o in zip(edges[:-1].tolist(), edges[1:].tolist(), bounds.tolist(), strict=False)]


def spans(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged [low, high) of windows at sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
    return starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1] + window


def window_digests(text: bytes, window: int) -> np.ndarray:
    return np.array([xxhash.xxh3_128_digest(text[k : k + window]) for k in range(len(text) - window + 1)], "S16")


def shard(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Equal windows among runs that come sorted by (hash, part); groups are never torn apart.

    Gives covered bytes (k1, k2, low, high) and, for hashes dealt over several parts, lists of windows to merge.
    """
    held: list[tuple] = []
    size = 0

    def work() -> Iterator[pd.DataFrame]:
        texts: dict[bytes, list[int]] = {}
        for j, row in enumerate(held):
            texts.setdefault((row[0], row[1], row[6]) if row[2] > 1 else row[6], []).append(j)
        keys = list(texts)
        own = [k[2] if isinstance(k, tuple) else k for k in keys]
        found = repeated(own, window)
        out: list[tuple] = []
        lists: dict[tuple, list] = {}
        for key, text, starts in zip(keys, own, found, strict=True):
            rows = texts[key]
            total = len(text) - window + 1
            if len(rows) > 1:
                starts = np.arange(total)
            for low, high in zip(*(x.tolist() for x in spans(starts, window)), strict=True):
                out += [(held[j][3], held[j][4], held[j][5] + low, held[j][5] + high) for j in rows]
            v, part, parts, k1, k2, s1, _ = held[rows[0]]
            if parts > 1:
                own = np.zeros(total, LISTED)
                own["digest"], own["k1"], own["k2"], own["at"] = window_digests(text, window), k1, k2, s1 + np.arange(total)
                own["settled"][starts] = 1
                lists.setdefault((v, part, parts), []).append(own)
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "low", "high"]).assign(v=0, bucket=-1, list=None)
        for (v, part, parts), items in lists.items():
            every = np.concatenate(items)
            _, one = np.unique(every["digest"], return_index=True)  # settled windows are listed once
            every = every[one]
            bucket = np.ndarray((len(every),), "<u4", every["digest"].tobytes(), strides=(16,)) % np.uint32(parts)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in range(parts):
                if edges[b] < edges[b + 1]:
                    yield pd.DataFrame({"k1": [0], "k2": [0], "low": [part], "high": [0], "v": [v], "bucket": [b], "list": [every[order[edges[b] : edges[b + 1]]].tobytes()]})

    last = None
    for batch in batches:
        for row in batch.itertuples(index=False):
            group = (row.v, row.part)
            if size >= SORTED and group != last:
                yield from work()
                held, size = [], 0
            last = group
            held.append((row.v, row.part, row.parts, row.k1, row.k2, row.s1, row.text))
            size += len(row.text)
    if held:
        yield from work()


def merge_lists(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """Windows of one hash and bucket that come in more than one part, found by binary search in the parts' sorted lists.

    A part lists each of its windows once and a bucket has about one of as many buckets as there are parts, so a group
    is about as large as one part's list.
    """
    lists = [np.frombuffer(x, LISTED) for x in group["list"]]
    # the lists are merged two by two; what comes of it is one sorted list of distinct digests of each half
    none = np.zeros(0, "S16")
    halves = [(x["digest"], none) for x in lists]
    while len(halves) > 1:
        merged = []
        for k in range(0, len(halves) - 1, 2):
            (a, twice_a), (b, twice_b) = halves[k], halves[k + 1]
            at = np.searchsorted(a, b)
            shared = a[np.minimum(at, len(a) - 1)] == b
            merged.append((np.insert(a, at[~shared], b[~shared]), np.union1d(np.union1d(twice_a, twice_b), b[shared])))
        halves = merged + halves[len(halves) - len(halves) % 2 :]
    twice = halves[0][1]
    out = []
    for x in lists:
        at = np.searchsorted(twice, x["digest"])
        hit = (twice[np.minimum(at, len(twice) - 1)] == x["digest"]) if len(twice) else np.zeros(len(x), bool)
        out.append(x[hit & (x["settled"] == 0)])
    found = np.concatenate(out)
    return pd.DataFrame({"k1": found["k1"], "k2": found["k2"], "low": found["at"], "high": found["at"] + window})


def covered_bytes(n: int, cover) -> np.ndarray:
    """Which of n bytes lie in some [low, high)."""
    marks = np.zeros(n + 1, np.int32)
    for piece in cover:
        marks[piece["low"]] += 1
        marks[piece["high"]] -= 1
    return np.cumsum(marks[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT, id_col: str = "doc_id", text_col: str = "text", keep: str | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    keep="bytes" adds what is left (kept, binary), keep="text" as a string (kept), without the bytes of characters that
    a cut tears apart. carry names columns of any type that are passed on, as fields of one struct (carried), so their
    names can't clash. A text is its UTF-8 bytes, a null one is empty. Each byte covered by a string of `window` bytes
    that starts anywhere else too, in the same or another row, is removed; so repeated rows remove each other. Strings
    are judged on the input. Rows of a null id are treated like any other. An empty table gives an empty result.
    """
    bounded_batches(docs)
    passed = [StructField("id", docs.schema[id_col].dataType)] + [StructField("carried", StructType([docs.schema[c] for c in carry]))] * bool(carry)
    columns = [F.col(id_col).alias("id")] + [F.struct(*(F.col(c) for c in carry)).alias("carried")] * bool(carry)
    keyed = docs.select(*columns, F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k1", F.xxhash64("id")).withColumn("k2", F.xxhash64("text"))

    def find_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                raw = [t.encode() for t in texts[a:b]]
                found = [runs(np.frombuffer(r, np.uint8), window, short) for r in raw]
                count = [len(f[0]) for f in found]
                if sum(count):
                    v, s1, m, c = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"k1": np.repeat(batch["k1"].to_numpy()[a:b], count), "k2": np.repeat(batch["k2"].to_numpy()[a:b], count), "v": v.view(np.int64), "s1": s1, "m": m, "c": c})

    every = stored(keyed.select(*KEY, "text").mapInPandas(find_runs, "k1 long, k2 long, v long, s1 int, m int, c int"))
    size = F.sum(F.col("m").cast("long") + (window - 1))
    often = every.groupBy("v").agg(size.alias("bytes"), F.sum("c").alias("c")).filter("c > 1").select("v", F.ceil(F.col("bytes") / SHARD).cast("int").alias("parts"))
    lists = every.join(often, "v").groupBy(*KEY).agg(F.collect_set(F.struct("v", "parts", "s1", "m")).alias("runs"), F.count("*").alias("k"))
    # each of the rows that repeat id and text gives the same runs
    lists = lists.select(*KEY, "runs", (F.col("k") > F.size("runs")).alias("copied"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without shared runs are finished, and so are copies of a row, which are removed whole; the others keep their text."""
        for batch in batches:
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            found = batch.column("runs")
            done = found.is_null().to_pylist()
            made = {f.name: batch.column(f.name) for f in passed} | {k: batch.column(k) for k in KEY}
            made["n_bytes"] = pa.array([len(r) for r in raw], pa.int64())
            made["whole"] = pa.array([hashlib.sha256(r).hexdigest() if d else None for r, d in zip(raw, done, strict=True)], pa.string())
            made["raw"] = pa.array([None if d and not keep else r for r, d in zip(raw, done, strict=True)], pa.binary())
            made["copied"] = pa.array([bool(c) for c in batch.column("copied").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_pydict(made | {"runs": found})

    joined = keyed.join(lists, KEY, "left")
    shape = StructType([*passed, *(StructField(k, LongType()) for k in KEY), StructField("n_bytes", LongType()), StructField("whole", StringType()), StructField("raw", BinaryType()), StructField("copied", BooleanType()), StructField("runs", joined.schema["runs"].dataType)])
    rows = stored(joined.mapInArrow(split, shape))
    # of copies one row goes to the shards, for what other texts share with it
    one = rows.filter("whole is null and copied").groupBy(*KEY).agg(F.first("raw").alias("raw"), F.first("runs").alias("runs"))
    parts = rows.filter("whole is null and not copied").select(*KEY, "raw", "runs").unionByName(one).select(*KEY, "raw", F.explode("runs").alias("r"))
    parts = parts.select(F.col("r.v").alias("v"), F.pmod(F.xxhash64(*KEY, "r.s1"), F.col("r.parts")).cast("int").alias("part"), F.col("r.parts").alias("parts"), *KEY, F.col("r.s1").alias("s1"), F.substring("raw", F.col("r.s1") + 1, F.col("r.m") + window - 1).alias("text"))
    parts = parts.repartition("v", "part").sortWithinPartitions("v", "part")
    found = stored(parts.mapInPandas(lambda batches: shard(batches, window), "k1 long, k2 long, low long, high long, v long, bucket int, list binary"))
    merged = found.filter("bucket >= 0").groupBy("v", "bucket").applyInPandas(lambda group: merge_lists(group, window), "k1 long, k2 long, low long, high long")
    covered = found.filter("bucket < 0").select(*KEY, "low", "high").unionByName(merged).groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("covered"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, whole, raw, copied, cover in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "whole", "raw", "copied", "covered")), strict=True):
                if copied:
                    out.append((n, 1, hashlib.sha256(b"").hexdigest(), b""))
                    continue
                if cover is None or whole is not None:
                    out.append((0, 0, whole or hashlib.sha256(raw).hexdigest(), raw))
                    continue
                gone = covered_bytes(n, cover)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest(), kept))
            removed, spans_, digests, kept = ([x[k] for x in out] for k in range(4))
            made = {f.name: batch.column(f.name) for f in passed} | {"n_bytes": batch.column("n_bytes"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            if keep:
                made["kept"] = pa.array(kept, pa.binary()) if keep == "bytes" else pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
            yield pa.RecordBatch.from_pydict(made)

    figures = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType())] + [StructField("kept", BinaryType() if keep == "bytes" else StringType())] * bool(keep)
    first = [f.name for f in passed]
    done = rows.filter("whole is not null or copied").select(*first, "n_bytes", "whole", "raw", "copied").withColumn("covered", F.lit(None).cast("array<struct<low: long, high: long>>"))
    cut = rows.filter("whole is null and not copied").join(covered, KEY, "left").select(*first, "n_bytes", "whole", "raw", "copied", "covered")
    out = done.unionByName(cut).mapInArrow(finish, StructType([*passed, *figures]))
    return out.withColumnRenamed("id", id_col) if not carry else out.select(F.col("id").alias(id_col), *out.columns[1:])
