"""URL filter by rules and by a tree of path templates, with DataFrame functions alone.

Rules label the URLs they fit. For the others a tree is built for each host over path segments: under a node with many
children the rare ones become one wildcard, level by level down to the deepest; branches of the first segment of the same shape whose labelled shares don't differ
significantly are merged; a template is blocked if its smoothed share of blocked among labelled URLs is high enough.
Everything is counted over distinct paths with partial aggregation, so a host with most of the rows costs no more than
its distinct paths.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A node keeps all children up to this many; beyond it only those with at least this share of its URLs.
MAX_CHILDREN, KEPT_SHARE = 12, 0.05
#: Branches are similar within this many standard errors; templates are blocked from this purity, with one pseudo-count each.
ERRORS, PURITY = 2.0, 0.8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null URL and for one without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null. rules: (host, path, verdict)."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    by_host: dict[str, list[Column]] = {}
    for rule_host, rule_path, verdict in rules:
        text = rule_host + rule_path
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(text)).alias("n"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path")))
    table = F.create_map(*chain.from_iterable((F.lit(h), F.array(*r)) for h, r in by_host.items()))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", max_children: int = MAX_CHILDREN, kept_share: float = KEPT_SHARE, errors: float = ERRORS, purity: float = PURITY) -> DataFrame:
    """(id, host, path, rule, verdict, template) for every row.

    Rows of a null id are judged by their URL like any other. A null or malformed URL has an empty host and path, no rule, and is judged like any template. Repeated rows are
    judged alike. An empty table gives an empty result. Only the two named columns are read.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    part = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = parsed.select(
        "id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("given"),
        F.array_join(part, "/").alias("s"),
    )
    # the tree's tables are far smaller than the input; each is written once, as several steps read it
    tree = rows.groupBy("host", "s").agg(F.count("*").alias("n"), F.count_if(F.col("given") == "block").alias("b"), F.count_if(F.col("given") == "allow").alias("a"))
    tree = stored(tree.withColumns({"size": F.size(F.split("s", "/")), "t1": F.lit(None).cast("string"), "tail": F.lit("")}))
    for level in (1, 2, 3):
        tree = tree.withColumn("tail", F.col("tail") if level < 3 else F.concat("tail", F.lit("/")))
        tree = stored(_descended(tree, level, max_children, kept_share))
    tree = _deepened(tree, max_children, kept_share)
    leaves = tree.groupBy("host", "t1", "tail").agg(*(F.sum(c).alias(c) for c in ("n", "b", "a")))
    leaves = stored(leaves)
    # a branch's shape is its set of tails, told by their number and hashes, as there may be many
    tail = F.xxhash64("tail")
    branches = leaves.groupBy("host", "t1").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), F.concat_ws(" ", F.count("*"), F.sum(tail.cast("decimal(38,0)")), F.bit_xor(tail)).alias("shape"))
    branches = branches.withColumn("labelled", F.col("a") + F.col("b") > 0)
    pools = branches.groupBy("host", "shape", "labelled").agg(F.sum("b").alias("pb"), F.sum("a").alias("pa"))
    rate = F.try_divide(F.col("pb"), F.col("pa") + F.col("pb"))
    own = F.try_divide(F.col("b"), F.col("a") + F.col("b"))
    near = ~F.col("labelled") | (F.abs(own - rate) <= errors * F.sqrt(rate * (1 - rate) / F.greatest(F.col("a") + F.col("b"), F.lit(1))))
    judged = branches.join(pools, ["host", "shape", "labelled"]).select("host", "t1", "shape", "labelled", near.alias("near"))
    groups = judged.filter("near").groupBy("host", "shape", "labelled").agg(F.count("*").alias("alike"))
    merged = judged.join(groups, ["host", "shape", "labelled"], "left").select("host", "t1", F.when(F.col("near") & (F.col("alike") > 1), F.concat(F.lit("*"), F.when(F.col("labelled"), "").otherwise("?"))).otherwise(F.col("t1")).alias("m1"))
    merged = stored(merged)
    leaves = leaves.join(merged, ["host", "t1"])
    templates = leaves.groupBy("host", "m1", "tail").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    templates = templates.select("host", "m1", "tail", ((F.col("b") + 1) / (F.col("a") + F.col("b") + 2)).alias("blocked"))
    verdicts = (
        tree.select("host", "s", "t1", "tail").join(merged, ["host", "t1"]).join(templates, ["host", "m1", "tail"])
        .select("host", "s", F.concat_ws("/", F.lit(""), "m1", "tail").alias("template"), F.when(F.col("blocked") >= purity, "block").otherwise("allow").alias("learned"))
    )
    return rows.join(verdicts, ["host", "s"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("given", "learned").alias("verdict"), "template")


def _descended(tree: DataFrame, level: int, max_children: int, kept_share: float) -> DataFrame:
    """The paths with the token of their segment at this level: t1 at the first, at others added to the tail.

    tree: (host, s, n, b, a, size, t1, tail). A path that has ended counts as a child without name.
    """
    node = ["host", "t1", "tail"][: 1 if level == 1 else 3]
    tree = tree.withColumn("segment", F.coalesce(F.get(F.split("s", "/"), F.lit(level - 1)), F.lit("")))
    children = tree.groupBy(*node, "segment").agg(F.sum("n").alias("cn"))
    nodes = children.groupBy(*node).agg(F.count("*").alias("nk"), F.sum("cn").alias("nt"))
    token = F.when((F.col("nk") > max_children) & (F.col("cn") < kept_share * F.col("nt")), "*").otherwise(F.col("segment"))
    found = tree.join(children.join(nodes, node).select(*node, "segment", token.alias("token")), [*node, "segment"])
    if level == 1:
        t1, tail = F.col("token"), F.col("tail")
    else:
        t1, tail = F.col("t1"), F.concat("tail", F.when(F.col("token") == "", "").otherwise(F.concat(F.lit("/" if level > 3 else ""), "token")))
    return found.select("host", "s", "n", "b", "a", "size", t1.alias("t1"), tail.alias("tail"))


def _deepened(tree: DataFrame, max_children: int, kept_share: float) -> DataFrame:
    """The same step from the fourth level to the deepest.

    Below a node of at most max_children distinct paths no node can have more children, so there the rest stays as it is.
    """
    whole = ["host", "s", "n", "b", "a", "size", "t1", "tail"]
    done, going, level = [tree.filter("size < 3")], tree.filter("size >= 3"), 4
    if tree.filter("size > 3").isEmpty():
        return tree
    while not going.isEmpty():
        nodes = going.groupBy("host", "t1", "tail").agg(F.count("*").alias("paths"), F.max("size").alias("deep"))
        wide = (F.col("paths") > max_children) & (F.col("deep") >= level)
        going = going.join(nodes, ["host", "t1", "tail"]).withColumn("wide", wide)
        rest = F.slice(F.split("s", "/"), level, F.greatest(F.col("size"), F.lit(1)))
        literal = F.when(F.col("size") >= level, F.concat(F.col("tail"), F.lit("/"), F.array_join(rest, "/"))).otherwise(F.col("tail"))
        done.append(going.filter("not wide").withColumn("tail", literal).select(*whole))
        going = stored(_descended(going.filter("wide").select(*whole), level, max_children, kept_share))
        done.append(going.filter(F.col("size") < level))
        going = going.filter(F.col("size") >= level)
        level += 1
    return stored(reduce(DataFrame.unionByName, done))


def oracle(rules: Sequence[tuple[str, str, str]], max_children: int = MAX_CHILDREN, kept_share: float = KEPT_SHARE, errors: float = ERRORS, purity: float = PURITY) -> str:
    """DuckDB SQL for judge_urls over the table pages, for paths of up to three segments: it takes the rest as the third."""
    quoted = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    levels = "tree0 as (select * from paths)"
    for k in (1, 2, 3):
        node = ", ".join(["host", *(f"t{j}" for j in range(1, k))])
        levels += f""",
        child{k} as (select {node}, s{k}, sum(n) as cn from tree{k - 1} group by all),
        node{k} as (select {node}, count(*) as nk, sum(cn) as nt from child{k} group by all),
        token{k} as (select {node}, s{k}, case when nk > {max_children} and cn < {kept_share}e0 * nt then '*' else s{k} end as t{k} from child{k} join node{k} using ({node})),
        tree{k} as (select * from tree{k - 1} join token{k} using ({node}, s{k}))"""
    return f"""
    with rules(rule_host, rule_path, given) as (values {quoted}),
    url as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
    parsed as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from url),
    hosts as (select distinct host, path from parsed),
    best as (select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(given, length(rule_host || rule_path)) as given
        from hosts join rules on (host = rule_host or host like '%.' || rule_host) and starts_with(path, rule_path) group by all),
    parts as (select page_id, host, path, rule, given, list_filter(string_split(path, '/'), lambda x: x <> '') as part from parsed left join best using (host, path)),
    rows_ as (select page_id, host, path, rule, given, coalesce(part[1], '') as s1, coalesce(part[2], '') as s2, coalesce(array_to_string(part[3:], '/'), '') as s3 from parts),
    paths as (select host, s1, s2, s3, count(*) as n, count(*) filter (given = 'block') as b, count(*) filter (given = 'allow') as a from rows_ group by all),
    {levels},
    leaves as (select host, t1, t2, t3, sum(b) as b, sum(a) as a from tree3 group by all),
    branches as (select host, t1, sum(b) as b, sum(a) as a, sum(a) + sum(b) > 0 as labelled, array_to_string(list_sort(list(distinct t2 || '/' || t3)), '|') as shape from leaves group by host, t1),
    pools as (select host, shape, labelled, sum(b) as pb, sum(a) as pa from branches group by all),
    judged as (select host, t1, shape, labelled, not labelled or abs(b / (a + b) - pb / (pa + pb)) <= {errors}e0 * sqrt(pb / (pa + pb) * (1 - pb / (pa + pb)) / greatest(a + b, 1)) as near
        from branches join pools using (host, shape, labelled)),
    alike as (select host, shape, labelled, count(*) as alike from judged where near group by all),
    merged as (select host, t1, case when near and alike > 1 then case when labelled then '*' else '*?' end else t1 end as m1 from judged left join alike using (host, shape, labelled)),
    templates as (select host, m1, t2, t3, (sum(b) + 1) / (sum(a) + sum(b) + 2) as blocked from leaves join merged using (host, t1) group by all),
    verdicts as (select host, s1, s2, s3, '/' || m1 || '/' || t2 || '/' || t3 as template, case when blocked >= {purity}e0 then 'block' else 'allow' end as learned
        from tree3 join merged using (host, t1) join templates using (host, m1, t2, t3))
    select page_id, host, path, rule, coalesce(given, learned) as verdict, template from rows_ left join verdicts using (host, s1, s2, s3)
    """
