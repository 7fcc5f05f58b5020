"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from orrery.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, id string, word int"


def head(conv):
    return F.crc32(conv.cast("string").cast("binary")) % 6


def mod(a, b):
    return a - b * int(a / b)


def plain(rows, rebuild=True):
    """Every prefix as a key."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            word = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(conv, []).append((turn is not None, turn or 0, word, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole[c] = tuple((turns.get(c - mod(c, 100), [])[:h] if rebuild else []) + own[h:])
    nodes = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids, out = {}, []
    for key in nodes:
        if key:
            kids[key[:-1]] = kids.get(key[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for key in sorted(nodes, key=len, reverse=True):
        leaves[key] += key not in kids
        saved[key] += (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        if key:
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    for key, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids.get(key, 0), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def grown(spark, rows, rebuild=True, parts=3):
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(parts)
    found = prefix_trie.conversation_trie(table, lambda c: c - c % 100, head, 5) if rebuild else prefix_trie.conversation_trie(table)
    return sorted(map(tuple, found.collect()), key=str)


def made(seed, convs=60, words=2, longest=9):
    r = random.Random(seed)
    rows = [(c, t, r.choice("ab"), "w" * r.randrange(words)) for c in range(-30, convs - 30) for t in range(r.randrange(1, longest))]
    rows += [(c, None, None, "first") for c in range(5)] + [(7, 1, "a", None), (7, 1, None, "é😀"), (7, 1, "a", None), (None, 0, "a", "b"), (None, None, None, None)]
    rows += [(c, t, "a", "copy") for c in range(200, 260) for t in range(3)]
    return rows


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 4)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("segment", [256, 1, 3])
def test_trie_equals_all_prefixes(spark, small_batches, monkeypatch, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    for rebuild in (True, False):
        assert grown(spark, made(segment), rebuild) == plain(made(segment), rebuild)


def test_long_conversations(spark, monkeypatch):
    """Copies of a long conversation, one that ends where a segment ends, and one that parts from them late."""
    monkeypatch.setattr(prefix_trie, "SEGMENT", 16)
    rows = [(c, t, "a", f"t{t}" if t < 150 or c < 3 else f"{c}") for c in range(5) for t in range(200)] + [(9, t, "a", f"t{t}") for t in range(160)] + [(8, t, "a", f"t{t}") for t in range(161)]
    assert grown(spark, rows, rebuild=False) == plain(rows, rebuild=False)


def test_empty_table_and_turnless_conversations(spark):
    assert grown(spark, []) == []
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert grown(spark, [(alone, 0, "a", "b")]) == plain([(alone, 0, "a", "b")]) and len(plain([(alone, 0, "a", "b")])) == 1


def test_tree_is_balanced():
    sequences = [[k, 1] for k in range(1023)]
    tree, paths = prefix_trie.TernaryTree.balanced(sequences)

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.lower[node]), height(tree.higher[node]))

    assert height(tree.top) == 10 and len({tuple(p) for p in paths}) == 1023
    assert all(tree.insert(s) == p for s, p in zip(sequences, paths, strict=True)) and len(tree.symbol) == 2046


def test_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    found = con.execute(prefix_trie.sql())
    got = queries.op11_prefix_trie(spark, sf_dir).select(*(d[0] for d in found.description))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(found.fetchall(), key=str)
