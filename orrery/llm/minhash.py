"""Near-duplicate documents by circulant MinHash, with every link confirmed on whole shingle sets.

Documents of equal shingle sets are one node. A first permutation scatters a set's shingles over a ring; a second one,
shifted around the ring by 0, 1, 2, ... places, gives all signature coordinates. Bands of coordinates put nodes into
buckets. Links are then confirmed in rounds: each node is held against one head that it shares a bucket with, nodes
found alike are joined to components, and only buckets that still hold several components go on. Then the signatures of
all nodes of such a bucket are compared, in blocks: first each node is held against its likeliest partner of another
component, at last all pairs of different components that may be alike are held against each other. So a group of copies is confirmed by about as many comparisons as it has members, and no link
between nodes that share a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, offsets, stored

#: Two sets of similarity 0.8 miss all of 40 bands of 5 with a probability of 1.2e-7.
BANDS, ROWS = 40, 5
#: Places of the ring for sets of up to LONG shingles; larger sets, which would fill it, are scattered over all 64-bit numbers.
RING, LONG = 1 << 16, 1 << 14
#: Nodes of a bucket are compared by the lowest bits of so many coordinates, in blocks of so many nodes; a pair goes on if
#: its estimate is at most so many standard errors below the similarity asked for.
BITS, BLOCK, ERRORS = 2048, 1024, 5.3
#: Rounds of one head for each node, and of its likeliest partner, before all remaining pairs are compared; nodes that one
#: task compares with a head.
ROUNDS, BEST, TOGETHER = 2, 2, 200
#: Seeds of the words' hashes, and masks for the first n of eight bytes.
SEED, SEEDS = 0x5851F42D, np.array([0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9], np.uint64)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Seeded 64-bit hashes of words: of up to 16 bytes mixed from these as two numbers, of longer ones by xxh3."""
    eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(16), strides=(1,))
    low = eights[start] & KEEP[np.minimum(size, 8)]
    high = eights[np.minimum(start + 8, len(raw))] & KEEP[np.clip(size - 8, 0, 8)]
    out = mixed((mixed(low ^ SEEDS[0]) + SEEDS[1]) * MULTIPLIER ^ mixed(high + size.astype(np.uint64) * SEEDS[2]))
    for k in np.flatnonzero(size > 16).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + size[k]], SEED)
    return out


def shingle_sets(texts: Sequence[str], size: int) -> list[np.ndarray]:
    """Each text's set of word shingles as sorted 64-bit hashes.

    A-Z are lower-cased; words are split at ASCII white space. A text of fewer words is one shingle of all its words;
    a text without words has an empty set. A shingle's hash is a sum of its words' seeded hashes, each times a power of
    an odd number, so different sequences of words share one with a probability of 2**-64, whatever their letters.
    """
    parts = [t.encode().lower() for t in texts]
    if not parts:
        return []
    ends = offsets([len(r) + 1 for r in parts])
    raw = b" ".join(parts) + b" "
    data = np.frombuffer(raw, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start = edge[::2]
    word = word_hashes(raw, start, edge[1::2] - start)
    at = np.searchsorted(start, ends).tolist()
    total = np.zeros(max(len(word) - size + 1, 0), np.uint64)
    for k in range(size):
        total = total * MULTIPLIER + word[k : k + len(total)]
    total = mixed(total)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = one * MULTIPLIER + word[k : k + 1]
            out.append(mixed(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Signer:
    """The two permutations, made from a seed, and all bands of a set.

    Sets of up to LONG shingles use a ring of RING places, with both permutations as tables. Larger ones use the ring of
    all 64-bit numbers, with bijections of them as permutations, so that it never fills. Sets near the limit, which may
    be similar to sets of both sizes, get the buckets of both rings.
    """

    def __init__(self, bands: int = BANDS, rows: int = ROWS, similarity: int = 80, seed: int = 1):
        r = np.random.default_rng(seed)
        self.bands, self.rows, self.similarity = bands, rows, similarity
        self.scatter = r.permutation(RING)
        ring = r.permutation(RING).astype(np.uint16)
        ring = np.concatenate([ring, ring])
        self.shifted, self.wide = (np.lib.stride_tricks.sliding_window_view(ring, n) for n in (bands * rows, BITS))
        self.factors = r.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = r.integers(0, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        return self._least(self.shifted, shingles, 1024)

    def own_buckets(self, shingles: np.ndarray) -> np.ndarray:
        """(2 bands): the set's buckets of the small and of the large ring, 0 where it has none."""
        out = np.zeros(2 * self.bands, np.int64)
        if len(shingles) <= LONG:
            out[: self.bands] = self.buckets(self.signature(shingles)[None])[0]
        if 100 * len(shingles) > self.similarity * LONG:
            out[self.bands :] = self.buckets(self._far(shingles, self.bands * self.rows)[None])[0]
        return out

    def marks(self, shingles: np.ndarray) -> bytes:
        """Short numbers of a set's buckets, and the lowest bits of more coordinates."""
        own = self.own_buckets(shingles)
        missing = mixed(shingles[:1] + np.arange(1, len(own) + 1, dtype=np.uint64)).view(np.int64)  # equal to nothing
        least = self._least(self.wide, shingles, 128) if len(shingles) <= LONG else self._far(shingles, BITS)
        return np.where(own == 0, missing, own).astype(np.uint32).tobytes() + np.packbits((least & least.dtype.type(1)).astype(bool)).tobytes()

    def _least(self, windows: np.ndarray, shingles: np.ndarray, together: int) -> np.ndarray:
        """A coordinate for each shift of the second permutation: neighbours on the ring, so a set's windows are just cut out."""
        at = np.unique(self.scatter[(shingles & np.uint64(RING - 1)).astype(np.int64)])
        return reduce(np.minimum, [windows[at[k : k + together]].min(0) for k in range(0, len(at), together)])

    def _far(self, shingles: np.ndarray, shifts: int) -> np.ndarray:
        """The same on the ring of all 64-bit numbers."""
        at = mixed(shingles * MULTIPLIER)
        return np.array([mixed(at + np.uint64(k)).min() for k in range(shifts)], np.uint64)

    def buckets(self, signatures: np.ndarray) -> np.ndarray:
        """(sets, bands) bucket numbers."""
        parts = signatures.reshape(len(signatures), self.bands, self.rows).astype(np.uint64)
        return mixed((parts * self.factors).sum(2, dtype=np.uint64) + self.salts).view(np.int64)


def signed_documents(docs: DataFrame, size: int, bands: int, rows: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, key, buckets): the text's hash, set size, the set's digest, and its buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(bands, rows, similarity)
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            for a, b in chunks(texts):
                sets = shingle_sets(texts[a:b], size)
                buckets = []
                for s in sets:
                    own = signer.own_buckets(s) if len(s) else np.zeros(0, np.int64)
                    buckets.append(own[own != 0])
                yield pd.DataFrame({
                    "id": batch["id"].to_numpy()[a:b], "h": batch["h"].to_numpy()[a:b], "n": [len(s) for s in sets],
                    "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "buckets": buckets,
                })

    narrow = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return narrow.mapInPandas(run, "id string, h long, n long, key binary, buckets array<long>").withColumn("id", F.col("id").cast("long"))


def alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Those (head, key) pairs whose sets have 100 * intersection >= similarity * union.

    A head's members come behind it in sorted order. A head with many members is dealt to as many
    tasks as needed, with its text beside each part.
    """
    counts = pairs.groupBy("head").agg(F.count("*").alias("members")).select("head", F.ceil(F.col("members") / TOGETHER).cast("int").alias("parts"))
    members = pairs.join(counts, "head").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).select("head", "key", "part")
    heads = counts.select("head", F.col("head").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = members.withColumn("member", F.lit(True)).unionByName(heads.withColumn("member", F.lit(False))).join(texts, "key")
    rows = rows.repartition("head", "part").sortWithinPartitions("head", "part", "member")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                part = batch.iloc[a:b]
                found = []
                for h, k, member, s in zip(part["head"], part["key"], part["member"], shingle_sets(texts[a:b], size), strict=True):
                    if not member:
                        head, own = h, s
                    elif h == head:
                        few, many = (s, own) if len(s) < len(own) else (own, s)
                        place = np.searchsorted(many, few)
                        common = int((many[np.minimum(place, len(many) - 1)] == few).sum()) if len(many) else 0
                        if common and 100 * common >= similarity * (len(s) + len(own) - common):
                            found.append((h, k))
                if found:
                    yield pd.DataFrame(found, columns=["head", "key"])

    return rows.select("head", "key", "member", "text").mapInPandas(run, "head long, key long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each linked node can reach. links: (a, b).

    Each step takes the least label among a node's neighbours, then the label's own label; no node's neighbours are
    gathered in one place.
    """
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component"))
    while True:
        labels = stored(labels)
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        short = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = stored(step.join(short, "component", "left").select("node", "before", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = step.select("node", "component")
        if step.filter("before <> component").limit(1).count() == 0:
            return labels


def likely_pairs(placed: DataFrame, marks: DataFrame, similarity: int, bands: int, best: bool) -> DataFrame:
    """(head, key) pairs of different components in one bucket whose signatures and sizes leave similarity possible; with
    `best` only each node's likeliest of a pair of blocks.

    placed: (bucket, size, key, n, component). A bucket's nodes are dealt to blocks of about BLOCK. The rows of each pair
    of blocks come one after another to one task, and different pairs to different tasks, so neither a bucket nor its
    pairs are ever together in one place. A pair is taken in the first band alone that both share. Sets of different
    rings can't be compared by signatures, so such a pair always goes on.
    """
    rows = placed.join(marks, "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "key", "n", "component", "marks")
    rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    share = (1 + similarity / 100) / 2  # of equal bits
    least = share - ERRORS * (share * (1 - share) / BITS) ** 0.5

    def met(bucket: int, same: bool, part: pd.DataFrame) -> np.ndarray:
        """Pairs of one pair of blocks, (pairs, 2)."""
        sides = [part, part] if same else [part[~part["second"]], part[part["second"]]]
        if not len(sides[0]) or not len(sides[1]):
            return np.zeros((0, 2), np.int64)
        raw = [np.frombuffer(b"".join(x["marks"]), np.uint8).reshape(len(x), -1) for x in sides]
        own = [np.ascontiguousarray(x[:, : 8 * bands]).view(np.uint32) for x in raw]
        a, b = (np.ascontiguousarray(x[:, 8 * bands :]).view(np.uint64) for x in raw)
        n, m = (x["n"].to_numpy(np.int64) for x in sides)
        c, d = (x["component"].to_numpy(np.int64) for x in sides)
        band = int(np.flatnonzero((own[0] == np.uint32(bucket & 0xFFFFFFFF)).all(0))[0])
        equal = np.zeros((len(a), len(b)), np.float32)
        for k in range(len(a)):
            able = (d != c[k]) & (100 * np.minimum(m, n[k]) >= similarity * np.maximum(m, n[k]))
            if same:
                able[: k + 1] = False
            at = np.flatnonzero(able)
            if len(at):
                at = at[~(own[1][at, :band] == own[0][k, :band]).any(1)]
                near = 1 - np.bitwise_count(a[k] ^ b[at]).sum(1) / BITS
                equal[k, at] = np.where((m[at] > LONG) == (n[k] > LONG), near, 1.0)
        keep = equal >= least
        if best:
            keep &= (equal >= equal.max(1, keepdims=True)) | (equal >= equal.max(0, keepdims=True))
        i, j = np.nonzero(keep)
        return np.stack([sides[0]["key"].to_numpy(np.int64)[i], sides[1]["key"].to_numpy(np.int64)[j]], 1)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def pairs() -> Iterator[pd.DataFrame]:
            found = met(last[0], last[1] == last[2], pd.concat(held))
            if len(found):
                yield pd.DataFrame({"head": found.min(1), "key": found.max(1)})

        for batch in batches:
            for group, part in batch.groupby(["bucket", "low", "high"], sort=False):
                if held and group != last:
                    yield from pairs()
                    held = []
                last = group
                held.append(part)
        if held:
            yield from pairs()

    return rows.mapInPandas(compare, "head long, key long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, similarity: int = 80, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS, best: int = BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, chosen) of every row.

    component_id is the smallest id that a document can reach by links of 100 * intersection >= similarity * union, and
    kept tells whether it is the document's own. A null text and one without words has an empty set and is linked with
    nothing. Rows of a null id are linked like others; their component is null if it has no other rows, and they are
    never kept. Repeated rows share one id, so both are kept or neither is; rows of one id and different texts are nodes
    of their own. chosen marks the rows of one (id, text hash) of each component, null ids last, and all rows of empty
    sets: what stays if one of each group is to stay. An empty table gives an empty result. Columns other than the two
    named are not read.
    """
    bounded_batches(docs)
    signed = stored(signed_documents(docs, size, bands, rows, similarity, id_col, text_col))
    # a node is a distinct set; a number of 8 bytes, fixed by writing it, keeps the buckets' shuffle small
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h"))
    nodes = signed.filter("n > 0").groupBy("key").agg(first.alias("pick"), F.min("n").cast("int").alias("n"), F.min("buckets").alias("buckets"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()).withColumnRenamed("key", "digest"))
    filed = nodes.select(F.col("node").alias("key"), "n", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("b")).filter(F.col("a") != F.col("b")).select("bucket")
    filed = stored(filed.join(shared, "bucket", "left_semi"))  # buckets of one node say nothing
    wanted = nodes.select("node", "digest", F.col("pick.id").alias("wanted_id"), F.col("pick.h").alias("wanted_h")).join(filed.select(F.col("key").alias("node")).distinct(), "node", "left_semi")

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows whose text gives the set wanted, with the set's marks."""
        signer = Signer(bands, rows, similarity)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in chunks(texts):
                part = batch.iloc[a:b]
                sets = shingle_sets(texts[a:b], size)
                same = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, part["digest"], strict=True)]
                part = part[same]
                yield pd.DataFrame({"key": part["node"], "text": part["text"], "marks": [signer.marks(s) for s, yes in zip(sets, same, strict=True) if yes]})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").withColumn("h", F.xxhash64("text"))
    source = source.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("h") == F.col("wanted_h")))
    texts = stored(source.select("node", "digest", "text").mapInPandas(checked, "key long, text string, marks binary").dropDuplicates(["key"]))
    labels = nodes.sparkSession.createDataFrame([], "node long, component long")
    tested = nodes.sparkSession.createDataFrame([], "lesser long, greater long")
    fits = lambda m, n: 100 * F.least(m, n) >= similarity * F.greatest(m, n)
    for turn in range(rounds + best + 1):
        # buckets that hold several components, with their nodes
        placed = filed.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        priority = F.xxhash64("key", F.lit(turn))
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("size"), F.min_by(F.struct("key", "component", "n"), priority).alias("head")).filter(F.col("c1") != F.col("c2"))
        if turn < rounds:
            met = placed.join(open_.select("bucket", "head"), "bucket")
            offered = met.filter((F.col("component") != F.col("head.component")) & fits(F.col("n"), F.col("head.n"))).select(F.col("head.key").alias("head"), "key")
            if turn:
                offered = offered.distinct().join(tested, [F.least("head", "key") == F.col("lesser"), F.greatest("head", "key") == F.col("greater")], "left_anti")
            pairs = offered.groupBy("key").agg(F.min("head").alias("head")).select("head", "key")
        else:
            pairs = likely_pairs(placed.join(open_.select("bucket", "size"), "bucket"), texts.select("key", "marks"), similarity, bands, turn < rounds + best)
            pairs = pairs.join(tested.select(F.col("lesser").alias("head"), F.col("greater").alias("key")), ["head", "key"], "left_anti")
        pairs = stored(pairs)
        if not pairs.limit(1).count():
            continue
        found = stored(alike(pairs, texts.select("key", "text"), size, similarity))
        if found.limit(1).count():
            # links between components are joined first, then nodes follow their component
            name = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
            edges = found.join(name("head"), "head", "left").join(name("key"), "key", "left").select(F.coalesce("head_component", "head").alias("a"), F.coalesce("key_component", "key").alias("b"))
            joined = components(edges)
            known = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
            labels = stored(known.unionByName(joined).groupBy("node").agg(F.min("component").alias("component")))
        tested = stored(tested.unionByName(pairs.select(F.least("head", "key").alias("lesser"), F.greatest("head", "key").alias("greater"))))
    # a component is called by the least id of its nodes
    picks = nodes.select("node", "digest", "pick")
    named = labels.join(picks.select("node", "pick"), "node").groupBy("component").agg(F.min("pick").alias("first"))
    linked = labels.join(named, "component").select("node", "first")
    found = picks.join(linked, "node", "left").select("digest", F.coalesce("first", "pick").alias("first"))
    out = signed.withColumn("digest", F.when(F.col("n") > 0, F.col("key"))).join(found, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id"))
    chosen = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.col("h").alias("text_hash"), F.coalesce(chosen, F.lit(False)).alias("chosen"),
    )
