"""Deduplication, search, URL rules and the pipeline, against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import minhash, queries, suffix_dedup, topk, url_filters
from orrery.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_components(rows, size):
    """component of each row by all pairs of sets."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)]


def near_copies():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def test_near_duplicates_equal_brute_force(spark, odd_docs):
    texts = near_copies()
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (made, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = sorted(((i, n, c, i is not None and i == c) for i, n, c in brute_components(rows, 4)), key=str)
        found = minhash.near_duplicates(docs, size=4)
        got = sorted(map(tuple, found.select(found.columns[:4]).collect()), key=str)
        assert got == want


def test_near_duplicates_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size=4).collect()}
    assert got == {i: c for i, _, c in brute_components(rows, 4)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_estimates_follow_similarity():
    r = np.random.default_rng(0)
    signer = minhash.Signer()
    common = r.integers(0, 1 << 63, 800, dtype=np.uint64)
    a, b = (np.unique(np.concatenate([common, r.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(2))
    assert abs((signer.signature(a) == signer.signature(b)).mean() - 0.8) < 0.08


def test_hot_heads_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TOGETHER", 3)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs, size=4).collect()} == {0}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_polynomials_confuse(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size=4).collect()}
    assert all(r["n_shingles"] == 1 and r["component_id"] == i and r["kept"] for i, r in got.items())


def test_long_sets_do_not_fill_the_ring():
    r = np.random.default_rng(3)
    signer = minhash.Signer()
    a, b = (np.unique(r.integers(0, 1 << 63, 500_000, dtype=np.uint64)) for _ in range(2))
    assert not (signer.own_buckets(a)[40:] == signer.own_buckets(b)[40:]).any()
    # at the limit of both rings, similar sets share buckets of one of them
    whole = np.unique(r.integers(0, 1 << 63, minhash.LONG + 1000, dtype=np.uint64))
    part = whole[r.permutation(len(whole))[: int(0.9 * len(whole))]]
    assert len(part) <= minhash.LONG < len(whole)
    x, y = signer.own_buckets(whole), signer.own_buckets(np.sort(part))
    assert ((x == y) & (x != 0)).any()


def test_copies_across_the_limit_of_rings(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LONG", 100)
    r = random.Random(9)
    rows = []
    for n in (80, 95, 105, 110, 130):
        base = [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows += [base, base[: int(0.95 * n)], base[int(0.06 * n) :], base[: int(0.7 * n)]]
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, size=4).collect()}
    assert found == {i: c for i, _, c in brute_components([(k, " ".join(x)) for k, x in enumerate(rows)], 4)}


def test_rows_of_one_id_or_none(spark):
    texts = near_copies()[:3]
    rows = [(1, texts[0]), (1, texts[0] + " x y z"), (1, "something else altogether it is"), (None, "something else altogether it is"), (None, "a b c d e f"), (None, "a b c d e f"), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, size=4).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted((str(i), n, str(c)) for i, n, c in brute_components(rows, 4))
    kept = sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert [k[1] for k in kept if k[0] == "None"] == ["a b c d e f"] and kept.count(("2", "")) == 2
    assert ("1", "something else altogether it is") in kept and len(kept) == 5


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def brute_repeats(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + window] for t in raw for k in range(len(t) - window + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_order_and_windows():
    r = random.Random(3)
    for _ in range(150):
        window = r.choice([8, 12, 20])
        base = bytes(r.choice(b"ab") for _ in range(60))
        texts = [b"".join(r.choice([base[i : i + r.randint(1, 40)], bytes(r.choice(b"abcd") for _ in range(r.randint(0, 30))), b"a" * r.randint(0, 40)]) for i in (r.randint(0, 50), 3, 9)) for _ in range(r.randint(1, 8))]
        whole = b"".join(texts) or b"x"
        data = np.frombuffer(whole, np.uint8)
        order = suffix_dedup.suffix_order(data)
        assert order.tolist() == sorted(range(len(whole)), key=lambda k: whole[k:])
        lcp = suffix_dedup.common_prefixes(data, order, 15)
        for j in range(1, len(whole)):
            a, b = whole[order[j - 1] :], whole[order[j] :]
            assert lcp[j] == next((k for k in range(15) if k >= min(len(a), len(b)) or a[k] != b[k]), 15)
        if b"".join(texts):
            seen = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
            assert [x.tolist() for x in suffix_dedup.repeated(texts, window)] == [[k for k in range(len(t) - window + 1) if seen[t[k : k + window]] > 1] for t in texts]
    for data in (b"a\0\0\0", b"\0" * 20, b"x"):
        assert suffix_dedup.suffix_order(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda k: data[k:])


@pytest.mark.parametrize(("shard", "longest"), [(1000, 50), (1 << 19, 1 << 15)])
def test_repeats_equal_brute_force(spark, odd_docs, shard, longest, monkeypatch):
    """The small sizes deal hashes over several shards, whose lists are merged, and cut long runs."""
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "LONGEST", longest)
    r = random.Random(6)
    passage = "".join(r.choice("abcdef gh") for _ in range(260))
    texts = ["".join(r.choice("abcdef gh") for _ in range(r.randint(0, 300))) + passage[r.randint(0, 30) :] + "".join(r.choice("xyz é") for _ in range(r.randint(0, 99))) for _ in range(40)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (made, odd_docs):
        rows = docs.collect()
        want = sorted(((x["doc_id"], *y) for x, y in zip(rows, brute_repeats([x["text"] for x in rows], 200), strict=True)), key=str)
        assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str) == want


def test_copies_of_rows_are_removed_whole(spark):
    """Rows that repeat id and text go whole; one of them stands for all, also for texts that share a part with them."""
    text = "".join(random.Random(5).choice("abcdefgh ") for _ in range(600))
    rows = [(None, text)] * 400 + [(7, text)] * 3 + [(8, "x" * 50 + text[100:350] + "y" * 50), (9, text[:150]), (10, "z" * 300), (None, "short")] * 1 + [(11, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()), key=str)
    want = sorted([(None, 600, 600, 1)] * 400 + [(7, 600, 600, 1)] * 3 + [(8, 350, 250, 1), (9, 150, 0, 0), (10, 300, 300, 1), (None, 5, 0, 0), (11, 0, 0, 0)], key=str)
    assert got == want


def test_repeats_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.collect()
    want = sorted((x["doc_id"], *y) for x, y in zip(rows, brute_repeats([x["text"] for x in rows], 200), strict=True))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect())) == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def sql(text, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(text).fetchall(), [d[0] for d in con.description]


def test_search_equals_sql(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    got = queries.op9_topk(spark, sf_dir)
    rows, names = sql(topk.ORACLE, embeddings=vectors.toPandas())
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rows)


def test_search_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, 2.0, 3.0]), (7, [-1.0, 0.0]), (50, [1.0, 1.0]), (100, [1.0, 1.0]), (50, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 50 == 0, 3).collect()))
    assert got == sorted(brute_search(rows, lambda i: i % 50 == 0, 3))
    assert topk.search(vectors.limit(0), F.lit(True)).count() == 0


def brute_search(rows, asked, k):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(whole):
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for m, (j, v) in enumerate(whole) if m != n and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out


def test_search_of_large_and_many_vectors(spark, monkeypatch):
    """Scores beyond 32 and 53 bits; negative ones; dimensions that don't divide; ties."""
    r = random.Random(2)
    large = [(k, [r.choice([1.0, 4.0e6, -3.0e6, 0.5]) for _ in range(3)]) for k in range(30)] + [(100, [1.0, 1.0, 1.0])]
    many = [(k, [r.gauss(-0.2, 1) for _ in range(7)]) for k in range(400)] + [(k, [0.25] * 7) for k in range(400, 420)]
    wide = [(0, [2.0**20] * 2), (1, [2.0**21, -(2.0**20)]), (2, [2.0**20, 2.0**20 + 1])]
    monkeypatch.setattr(topk, "BLOCK", 64)
    for rows in (large, many, wide):
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted(map(tuple, topk.search(vectors, F.col("vec_id") % 5 == 0, 4).collect()))
        assert got == sorted(brute_search(rows, lambda i: i % 5 == 0, 4))


def test_products_are_exact():
    q, v = np.array([[2**40, -(2**20)]]), np.array([[2**19, 3], [-(2**21), 2**30]])
    assert topk.products(q, v).tolist() == [[2**59 - 3 * 2**20, -(2**61) - 2**50]]
    assert topk.products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).shape == (2, 3)
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40]]), np.array([[2**40]]))


def test_urls_equal_sql(spark, sf_dir):
    for pages in (table(spark, sf_dir, "pages"), table(spark, "/root/testdata/sf0.01", "pages")):
        got = url_filters.judge_urls(pages, queries.URL_RULES)
        rows, names = sql(url_filters.oracle(queries.URL_RULES), pages=pages.toPandas())
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, rows))


def brute_tails(paths, level=1):
    """The template of each path: paths maps tuples of segments to counts, all below one node."""
    children = Counter()
    for path, n in paths.items():
        children[path[level - 1] if level <= len(path) else ""] += n
    total, groups, out = sum(children.values()), {}, {}
    for path, n in paths.items():
        segment = path[level - 1] if level <= len(path) else ""
        token = "*" if len(children) > url_filters.MAX_CHILDREN and children[segment] < url_filters.KEPT_SHARE * total else segment
        if level > 3 and len(path) < level:
            out[path] = (token,)
        else:
            groups.setdefault(token, {})[path] = n
    for token, some in groups.items():
        if level < 3 or max(map(len, some)) > level:
            below = brute_tails({p: n for p, n in some.items() if level < 3 or len(p) >= level}, level + 1)
        else:
            below = {}
        out |= {p: (token, *below.get(p, ())) for p in some}
    return out


def test_deep_paths_are_generalised(spark):
    r = random.Random(8)
    urls = [f"http://a.com/a/b/{k}/{'xy'[k % 2]}" for k in range(60)]
    deep = ["/".join(r.choice("pq") if r.random() < 0.7 else str(r.randrange(60)) for _ in range(r.randrange(1, 9))) for _ in range(1500)]
    urls += [f"http://b.com/{p}" for p in deep]
    # the blocked section is one of many and rare; what it says holds for pages of its structure alone
    urls += [f"http://c.com/{k}/list/{k}-{j}/{'xy'[j % 2]}" for k in range(40) for j in range(6)] + [f"http://c.com/bad/list/{j}/x" for j in range(6)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(pages, [("c.com", "/bad/", "block")]).collect()}
    assert len(got) == len(urls)
    assert {got[k]["template"] for k in range(60)} == {"/a/b/*/x", "/a/b/*/y"}
    want = brute_tails(Counter(tuple(p.split("/")) for p in deep))
    assert {len(t) for t in want.values()} > {3, 6}
    for k, p in enumerate(deep, 60):
        first, *tail = want[tuple(p.split("/"))]
        template = "/".join(x for n, x in enumerate(tail) if x or n < 2)
        assert got[k]["template"].split("/", 2)[2] == template, p
    learned = {u.rsplit("/", 1)[1]: set() for u in urls if "c.com" in u}
    for k, u in enumerate(urls):
        if "c.com" in u and "/bad/" not in u:
            learned[u.rsplit("/", 1)[1]].add(got[k]["verdict"])
    assert learned == {"x": {"block"}, "y": {"allow"}}


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://NET", "http://Net/", "https://a.Example.NET/en/1?x#y", "http://xnet/", "http://example.com#/de/", "http://example.com/de/x", "http://fr.org/fr/", "http://É.net/", "a://b.net/://c"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filters.judge_urls(pages, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None) and got[4] == ("net", "", None) and got[5] == ("net", "/", "net/")
    assert got[6] == ("a.example.net", "/en/1", "example.net/en/") and got[7] == ("xnet", "/", None) and got[8] == ("example.com", "", None)
    assert got[9][2] == "example.com/de/" and got[10][2] == "org/fr/" and got[11] == ("É.net", "/", "net/") and got[12] == ("b.net", "/://c", "net/")
    assert url_filters.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_variable_segments_become_wildcards(spark):
    pages = spark.createDataFrame([(k, f"http://a.com/{'de' if k % 2 else 'en'}/{k}") for k in range(60)], "page_id long, url string")
    rows = url_filters.judge_urls(pages, [("a.com", "/de/", "block")]).collect()
    assert {r["template"] for r in rows} == {"/de/*/", "/en/*/"} and {r["verdict"] for r in rows if r["page_id"] % 2 == 0} == {"allow"}


@pytest.fixture
def strange(spark):
    """Null and repeated ids, null and empty texts, repeated rows, and columns of clashing names and nested types."""
    long = " ".join(f"the house of number {k} is old" for k in range(40))
    rows = [(k, f"{long} and {'it' * k} stands", "en") for k in range(4)] + [(7, None, "en"), (7, "", None), (None, f"another {long[50:]}", "en"), (None, None, None), (9, "x", "en"), (9, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs.withColumn("kept", F.lit(True)).withColumn("n_bytes", F.lit(1.5)).withColumn("tags", F.array(F.lit("a"), F.lit(None))).withColumn("score", F.lit("s")).withColumn("raw", F.unhex(F.lit("ff00"))).withColumn("carried", F.struct(F.lit(1).alias("id"))).withColumn("n_chars", F.length("text"))


def test_stages_on_strange_tables(spark, sf_dir, strange):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (strange, strange.limit(0)):
            got = stage(spark, docs, sf_dir)
            assert got.dtypes == docs.dtypes, name
            rows = got.collect()
            assert all(r["tags"] == ["a", None] and r["raw"] == b"\xff\0" and r["score"] == "s" and r["carried"]["id"] == 1 for r in rows)
            if name == "suffix_dedup":
                assert len(rows) == docs.count()
    assert corpus_pipeline.packed(spark, strange, sf_dir).count() >= 10
    assert corpus_pipeline.packed(spark, strange.limit(0), sf_dir).count() == 0


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions, on its own input."""
    docs = table(spark, sf_dir, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, sf_dir).persist()
        after = docs.toPandas()
        kept[name] = after
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "minhash":
            want = {c for _, _, c in brute_components(list(zip(before["doc_id"], before["text"], strict=True)), 5)}
            assert set(after["doc_id"]) == want
        elif name == "suffix_dedup":
            assert set(after["doc_id"]) == set(before["doc_id"])
            sizes = {i: n - m for i, (n, m, *_) in zip(before["doc_id"], brute_repeats(before["text"], 200), strict=True)}
            assert all(0 <= sizes[i] - len(t.encode()) <= 12 for i, t in zip(after["doc_id"], after["text"], strict=True))
            assert (after["n_chars"] == after["text"].str.len()).all()
        elif name == "packing":
            assert set(after["doc_id"]) == set(before["doc_id"])
        else:
            assert len(after) > 0.8 * len(before)
    assert isinstance(kept["packing"], pd.DataFrame)
