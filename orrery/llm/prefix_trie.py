"""A trie of conversations: what prefixes of turns they share, and what a cache of prefixes would save.

Turns are called by a digest of role and text. Conversations, as strings of digests, are sorted into ranges over the tasks;
a bounded run of them (one batch of rows) is a shard. A shard numbers its turns in order (its dictionary), and builds a
ternary search tree for the distinct sequences of numbers, the median of every range first, so that the tree is balanced.
A node of the trie is a node of that tree. One pass from the last made node to the first adds up members, leaves and
savings, without recursion.

Shards next to each other share the prefixes at their ends. Nodes on the paths of a shard's first and last sequence, the
boundary nodes, are merged by their prefixes' digests; sums over the subtrees of these few nodes are made by doubling the
distance to an ancestor, so that their number of steps is the logarithm of the depth.

Conversations are cut into segments of SEGMENT turns, so that no row or task holds a whole one. Segments that follow the
same turns form a trie of their own, which hangs below the node where those turns end; paths to such nodes are merged like
boundaries. Turns are numbered by sorted ranges and their counts, not by conversation, so that a conversation with a third
of all turns is many tasks' work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Turns in a segment, and bytes of a turn's digest.
SEGMENT, WIDTH = 256, 16
ROOT = b""


class TernaryTree:
    """Distinct sequences of numbers, each node with a lower, an equal (next turn) and a higher child.

    parent is the node of the prefix without the last number, -1 at the top; a parent is always made before its children.
    """

    def __init__(self) -> None:
        self.symbol: list[int] = []
        self.lower: list[int] = []
        self.equal: list[int] = []
        self.higher: list[int] = []
        self.parent: list[int] = []
        self.top = -1

    def _new(self, symbol: int, parent: int) -> int:
        for links in (self.lower, self.equal, self.higher):
            links.append(-1)
        self.symbol.append(symbol)
        self.parent.append(parent)
        return len(self.symbol) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """Nodes of all prefixes of a sequence, made where there are none."""
        path, parent = [], -1
        for number in sequence:
            node = self.top if parent < 0 else self.equal[parent]
            links, last = (self.equal, parent) if parent >= 0 else (None, -1)
            while node >= 0 and self.symbol[node] != number:
                links, last = (self.lower, node) if number < self.symbol[node] else (self.higher, node)
                node = links[node]
            if node < 0:
                node = self._new(number, parent)
                if links is None:
                    self.top = node
                else:
                    links[last] = node
            path.append(node)
            parent = node
        return path

    @classmethod
    def balanced(cls, sequences: list[list[int]]) -> tuple[TernaryTree, list[list[int]]]:
        """The tree of sorted sequences, medians of ranges first, and each sequence's path."""
        tree, paths = cls(), [[]] * len(sequences)
        ranges = [(0, len(sequences))]
        while ranges:
            begin, end = ranges.pop()
            if begin < end:
                middle = (begin + end) // 2
                paths[middle] = tree.insert(sequences[middle])
                ranges += [(begin, middle), (middle + 1, end)]
        return tree, paths


FIELDS = {
    "id": "binary", "parent": "binary", "shard": "long", "special": "boolean", "depth": "long", "conv": "long", "parent_conv": "long", "n_convs": "long", "n_children": "long",
    "n_leaves": "long", "saved": "long", "chars": "long", "ends": "string", "ends_sha256": "string",
}
ARROW = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def grouped(keys: list) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal neighbours."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def shard_nodes(rows: dict[str, list], shard: int) -> dict[str, list]:
    """Nodes of a shard: rows sorted by (gate, turns, conv), columns of FIELDS.

    gate: id of the node that a segment hangs below; first: its depth; turns: digests of the segment joined; sizes: code
    points of each turn; next_gate: id of the last node of a whole segment, else null; more: whether the conversation goes
    on behind it.
    """
    out: dict[str, list] = {c: [] for c in FIELDS}
    n_rows = len(rows["conv"])
    for begin, end in grouped(rows["gate"]):
        gate, first = rows["gate"][begin], rows["first"][begin]
        runs = [(begin + a, begin + b) for a, b in grouped(rows["turns"][begin:end])]
        words = [[t[k : k + WIDTH] for k in range(0, len(t), WIDTH)] for t in (rows["turns"][a] for a, _ in runs)]
        numbers = {w: k for k, w in enumerate(sorted({w for t in words for w in t}))}
        tree, paths = TernaryTree.balanced([[numbers[w] for w in t] for t in words])
        spelled = list(numbers)
        n = len(tree.parent)
        # place n is the gate itself
        members, least, ends = [0] * (n + 1), [None] * (n + 1), [""] * (n + 1)
        depth, size, special, goes_on = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [None] * (n + 1)
        special[n] = True
        for (a, b), path in zip(runs, paths, strict=True):
            last = path[-1] if path else n
            convs = rows["conv"][a:b]
            members[last] += b - a
            least[last] = min(convs)
            for k, node in enumerate(path):
                depth[node], size[node] = k + 1, rows["sizes"][a][k]
            goes_on[last] = rows["next_gate"][a]
            ends[last] = ",".join(str(c) for c, more in zip(convs, rows["more"][a:b], strict=True) if not more)
            if a == 0 or b == n_rows or goes_on[last] is not None:
                for node in path:
                    special[node] = True
        parent = [p if p >= 0 else n for p in tree.parent]
        ids: list[bytes] = [b""] * (n + 1)
        ids[n] = gate
        for k in range(n):  # parents come first
            ids[k] = goes_on[k] or hashlib.md5(b"node" + ids[parent[k]] + spelled[tree.symbol[k]]).digest()
        children, leaves, saved = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for k in range(n - 1, -1, -1):  # children come before parents
            up = parent[k]
            members[up] += members[k]
            least[up] = least[k] if least[up] is None else min(least[up], least[k])
            if special[k]:
                continue  # counted after merging, with all that lies below
            leaves[k] += not children[k]
            saved[k] += (members[k] - 1) * size[k]
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
        below = first > 0  # members of a gate are counted where its turns end
        for k in range(n + 1):
            top = k == n
            out["id"].append(ids[k])
            out["parent"].append(None if top else ids[parent[k]])
            out["shard"].append(shard)
            out["special"].append(special[k])
            out["depth"].append(first + depth[k])
            out["conv"].append(None if top and below else least[k])
            out["parent_conv"].append(None if top or special[parent[k]] else least[parent[k]])
            out["n_convs"].append(0 if top and below else members[k])
            out["n_children"].append(children[k])
            out["n_leaves"].append(leaves[k])
            out["saved"].append(saved[k])
            out["chars"].append(size[k])
            out["ends"].append(ends[k] if special[k] and ends[k] else None)
            out["ends_sha256"].append(None if special[k] else hashlib.sha256(ends[k].encode()).hexdigest())
    return out


def numbered(turns: DataFrame) -> DataFrame:
    """Turns with their place i in the conversation (from 0), the conversation's length n and the task's part p of it.

    Turns are sorted by range over the tasks and written, so that a row's number in the file gives the order; the place is
    the number less the first of the conversation in this part, with the counts of the parts before.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.asc_nulls_first("turn"), "word"]
    rows = turns.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    p = F.shiftright("at", 33).alias("p")
    counts = rows.groupBy("conv", p).agg(F.min("at").alias("begin"), F.count("*").alias("k"))
    each = Window.partitionBy("conv").orderBy("p")
    counts = counts.select("conv", "p", "begin", (F.sum("k").over(each) - F.col("k")).alias("before"), F.sum("k").over(Window.partitionBy("conv")).alias("n"))
    counts = stored(counts)
    return rows.withColumn("p", p).join(counts, ["conv", "p"]).select("conv", "p", (F.col("at") - F.col("begin") + F.col("before")).alias("i"), "n", "word", "chars")


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, word, chars): a turn's digest (of role and text, null ones empty) and its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    word = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), word.alias("word"), F.length(text).cast("long").alias("chars"))
    return rows.filter(F.col("conv").isNotNull())


def rebuilt(rows: DataFrame, source: Column, head: Column, longest_head: int) -> tuple[DataFrame, DataFrame]:
    """(conv, i, word, chars) of conversations rebuilt from another's first turns and their own others, and (conv, n).

    rows: of numbered(). source and head, of the column conv: the conversation whose first turns are taken and how many,
    at most longest_head.
    """
    convs = stored(rows.groupBy("conv").agg(F.max("n").alias("n")))
    sources = convs.select(F.col("conv").alias("source"), F.col("n").alias("given"))
    told = convs.select("conv", "n", source.alias("source"), head.cast("long").alias("head")).join(sources, "source", "left")
    told = stored(told.withColumn("taken", F.least("head", F.coalesce("given", F.lit(0)))))
    heads = rows.filter(F.col("i") < longest_head).select(F.col("conv").alias("source"), "i", "word", "chars")
    first = told.filter("taken > 0").join(heads, "source").filter(F.col("i") < F.col("taken")).select("conv", "i", "word", "chars")
    # a turn finds its conversation by (conv, part), so that a long conversation is not one key
    parts = rows.select("conv", "p").distinct().join(told.select("conv", "head", "taken"), "conv")
    own = rows.join(parts, ["conv", "p"]).filter(F.col("i") >= F.col("head")).select("conv", (F.col("i") - F.col("head") + F.col("taken")).alias("i"), "word", "chars")
    length = F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    return first.unionByName(own), told.select("conv", length.alias("n"))


def segments(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, first, turns, sizes, gate, next_gate, more) of each segment; a conversation without turns has an empty one."""
    s = F.floor(F.col("i") / SEGMENT).alias("s")
    packed = turns.groupBy("conv", s).agg(F.array_sort(F.collect_list(F.struct("i", "word", "chars"))).alias("t"))
    empty = lengths.filter("n = 0").select("conv", F.lit(0).cast("long").alias("s"), F.lit(b"").alias("turns"), F.array().cast("array<bigint>").alias("sizes"))
    joined = F.unhex(F.array_join(F.transform("t.word", F.hex), ""))
    rows = packed.select("conv", "s", joined.alias("turns"), F.col("t.chars").alias("sizes")).unionByName(empty)
    rows = stored(rows)
    long = rows.filter(F.size("sizes") == SEGMENT).select("conv").distinct()
    last = rows.agg(F.max("s")).first()[0] or 0
    # digest of all turns up to a segment's end, by doubling: after k steps, of the last 2^k segments
    reach = rows.join(long, "conv", "left_semi").select("conv", "s", F.unhex(F.md5("turns")).alias("d"))
    k = 1
    while k <= last:
        before = reach.select("conv", (F.col("s") + k).alias("s"), F.col("d").alias("e"))
        reach = stored(reach.join(before, ["conv", "s"], "left").select("conv", "s", F.coalesce(F.unhex(F.md5(F.concat("e", "d"))), F.col("d")).alias("d")))
        k *= 2
    here = reach.select("conv", "s", F.col("d").alias("end"))
    there = reach.select("conv", (F.col("s") + 1).alias("s"), F.col("d").alias("gate"))
    goes_on = reach.select("conv", (F.col("s") - 1).alias("s"), F.lit(True).alias("more"))
    rows = rows.join(here, ["conv", "s"], "left").join(there, ["conv", "s"], "left").join(goes_on, ["conv", "s"], "left")
    end = F.when(F.size("sizes") == SEGMENT, F.col("end")).alias("next_gate")
    return rows.select("conv", (F.col("s") * SEGMENT).alias("first"), "turns", "sizes", F.coalesce("gate", F.lit(ROOT)).alias("gate"), end, F.coalesce("more", F.lit(False)).alias("more"))


def shards(rows: DataFrame) -> DataFrame:
    """FIELDS of the nodes of all shards; each batch of sorted rows is a shard, numbered in the order of the ranges."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["gate", "turns", "conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        for number, batch in enumerate(batches):
            if batch.num_rows:
                nodes = shard_nodes(batch.to_pydict(), part + number)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[c], ARROW[t]) for c, t in FIELDS.items()], list(FIELDS))

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in FIELDS.items()))


def subtree_sums(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The nodes (id, parent, depth, ...) with each named number summed over the node and all below it.

    After k steps a number is the sum over the descendants nearer than 2^k, and `up` the ancestor at that distance.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select("id", F.col("parent").alias("up"), *names)
    k = 1
    while k <= deepest:
        below = state.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(*(F.sum(c).alias(f"_{c}") for c in names))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("next"))
        state = state.join(above, "up", "left").join(below, "id", "left")
        state = stored(state.select("id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names)))
        k *= 2
    return nodes.drop(*names).join(state.drop("up"), "id")


def end_digests(special: DataFrame) -> DataFrame:
    """(id, ends_sha256): the digest of the ids of all shards, which are read one after another."""
    pieces = special.filter(F.col("ends").isNotNull()).select("id", "shard", "ends")
    parts = int(special.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for at, ends in zip(batch.column("id").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if at != node:
                    done += [(node, state.hexdigest())] if state else []
                    node, state = at, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_pydict({"id": pa.array([a for a, _ in done], pa.binary()), "ends_sha256": pa.array([s for _, s in done], pa.string())})
        if state:
            yield pa.RecordBatch.from_pydict({"id": pa.array([node], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    return pieces.repartition(parts, "id").sortWithinPartitions("id", "shard").mapInArrow(run, "id binary, ends_sha256 string")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations: turns (conv, i, word, chars) and lengths (conv, n), conv being unique in lengths."""
    nodes = stored(shards(segments(turns, lengths)))
    special = nodes.filter("special")
    merged = special.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"), F.max("chars").alias("chars"),
    )
    own = merged.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("more"))
    merged = merged.join(own, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    merged = merged.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
    merged = stored(subtree_sums(stored(merged), ["n_leaves", "saved"]))
    called = merged.select(F.col("id").alias("parent"), F.col("conv").alias("_conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = merged.join(called, "parent", "left").join(end_digests(special), "id", "left").withColumn("parent_conv", F.col("_conv")).withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
    # a shard's own nodes find their merged parents by (id, shard), so that the root is not one key
    by_shard = special.select("id", "shard").distinct().join(merged.select("id", F.col("conv").alias("_conv")), "id").select(F.col("id").alias("parent"), "shard", "_conv")
    inner = nodes.filter("not special").join(by_shard, ["parent", "shard"], "left").withColumn("parent_conv", F.coalesce("parent_conv", "_conv"))
    columns = [F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return inner.select(*columns).unionByName(whole.select(*columns))


def conversation_trie(
    conversations: DataFrame, source: Callable[[Column], Column] | None = None, head: Callable[[Column], Column] | None = None, longest_head: int = 0,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    With source and head, conversations are rebuilt first: each takes the first head(conv) turns, at most longest_head, of
    source(conv), none if there is no such conversation, and its own turns behind its first head(conv).

    A conversation's turns are ordered by turn, null first; turns of one number by the digest of role and text. Null roles
    and texts are empty ones. Rows of a null conversation id belong to no conversation and are left out. Repeated rows are
    turns of their own. A conversation without turns after rebuilding is a member of the root. An empty table has no nodes.
    Other columns, of any name, don't matter. Turns are compared by 128-bit digests; texts of any length are read whole.
    """
    turns = numbered(turn_rows(conversations, conv_col, turn_col, role_col, text_col))
    if source is None or head is None:
        return trie(turns.select("conv", "i", "word", "chars"), turns.groupBy("conv").agg(F.max("n").alias("n")))
    return trie(*rebuilt(turns, source(F.col("conv")), head(F.col("conv")), longest_head))


def sql(head_of: int = 6, base: int = 100) -> str:
    """The same in SQL, with every prefix as a key and every pair of a prefix and one below it."""
    byte = "list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv as varchar), ''), lambda c: cast(ascii(c) as bigint))),"
        " lambda a, b: xor(a >> 8, table_of.t[cast(xor(a, b) & 255 as bigint) + 1])), 4294967295)"
    )
    return f"""
    with table_of as materialized (select list_transform(range(0, 256), lambda k: {byte}) as t),
    turns as (select conv_id as conv, length(coalesce(text, '')) as chars, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as word,
            row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 as i
        from conversations where conv_id is not null),
    convs as materialized (select conv, {crc} % {head_of} as head from (select distinct conv from turns), table_of),
    rebuilt as (select c.conv, 0 as part, t.i, t.word, t.chars from convs c join turns t on t.conv = c.conv - c.conv % {base} and t.i < c.head
        union all select c.conv, 1, t.i, t.word, t.chars from convs c join turns t on t.conv = c.conv and t.i >= c.head),
    placed as (select conv, chars, string_agg(word, '') over w as key, row_number() over w as depth from rebuilt window w as (partition by conv order by part, i rows unbounded preceding)),
    paths as materialized (select conv, depth, md5(key) as key, chars, lag(md5(key), 1, '') over (partition by conv order by depth) as parent from placed
        union all select conv, 0, '', 0, null from convs),
    nodes as materialized (select key, any_value(parent) as parent, any_value(depth) as depth, any_value(chars) as chars, min(conv) as conv, count(*) as n from paths group by key),
    kids as (select parent as key, count(*) as n_children from nodes where parent is not null group by parent),
    pairs as (select distinct a.key, b.key as below from paths a join paths b on a.conv = b.conv and a.depth <= b.depth),
    sums as (select p.key, count(*) filter (k.key is null) as n_leaves, sum((n.n - 1) * n.chars) as saved from pairs p join nodes n on n.key = p.below left join kids k on k.key = p.below group by p.key),
    last as (select conv, arg_max(key, depth) as key from paths group by conv),
    ends as (select key, string_agg(cast(conv as varchar), ',' order by conv) as told from last group by key)
    select n.conv as conv_id, cast(n.depth as bigint) as depth, p.conv as parent_conv_id, n.n as n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens,
        sha256(coalesce(e.told, '')) as ends_sha256
    from nodes n left join nodes p on p.key = n.parent left join kids k on k.key = n.key join sums s on s.key = n.key left join ends e on e.key = n.key
"""
