"""Queries over manifests, result matrices and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .views import FILES, RESULTS, duck, read, view

STATES = ("MET", "NOT_MET", "UNCERTAIN")
KEYWORDS = [("tone", "the"), ("tone", "nicht"), ("figures", "token"), ("figures", "Der "), ("law", "copyright")]
LIMIT, BIG = 60_000, 8_000


def results(spark, sf):
    return view(spark, sf, RESULTS)


def files(spark, sf):
    return view(spark, sf, FILES)


def status_pivot(spark, sf):
    rows = results(spark, sf).withColumnRenamed("requirement", "root")
    return tables.status_counts(rows, STATES, ("NOT_MET", "UNCERTAIN"))


def warnings_missing(spark, sf):
    return tables.status_lists(results(spark, sf))


def long_results(spark, sf):
    """The matrix made wide and long again."""
    wide = results(spark, sf).groupBy("student").pivot("requirement", ["quality", "toxic"]).agg(F.first("status"))
    return tables.long_results(wide)


def manifest_merge(spark, sf):
    """A listing of all accounts with the status that the suppliers' older manifest gave their names."""
    t = read(spark, sf, "customer", "supplier")
    listing = t["customer"].select(F.concat(F.lit("acct"), F.col("c_custkey").cast("string")).alias("name"), F.lit("file").alias("kind"))
    old = t["supplier"].select(F.concat(F.lit("acct"), (F.col("s_suppkey") * 3).cast("string")).alias("name"), F.when(F.col("s_suppkey") % 4 == 0, "FAILED").otherwise("UPLOADED").alias("status"))
    return tables.carry_over(listing, old).select("name", "kind", "status")


def upsert_results(spark, sf):
    """Quality results replaced by regraded ones of every seventh document, absent ones added."""
    rows = results(spark, sf)
    again = rows.filter((F.col("student").cast("long") % 7 == 0) & (F.col("requirement") == "quality")).select("student", "requirement", F.lit("MET").alias("status"))
    return tables.upsert(rows.filter("status <> 'UNCERTAIN'"), again, ["student", "requirement"])


def result_merge(spark, sf):
    """Both requirements' tables merged by student, with a default for what is missing."""
    rows = results(spark, sf).filter("status <> 'UNCERTAIN'")
    side = lambda name: rows.filter(F.col("requirement") == name).select("student", F.col("status").alias(name))
    return tables.merged(side("quality").filter("quality = 'MET'"), side("toxic"), ["student"], {"quality": "NONE", "toxic": "NONE"})


def dir_rollup(spark, sf):
    return tables.directory_sizes(files(spark, sf))


def archive_plan(spark, sf):
    return tables.archive_plan(files(spark, sf), LIMIT, BIG)


def evidence_snippets(spark, sf):
    words = spark.createDataFrame(KEYWORDS, "requirement string, word string")
    return tables.evidence(read(spark, sf, "documents")["documents"], words)


def figure_files(spark, sf):
    """Figures among each host's files, whose endings go by their number."""
    ending = F.element_at(F.array(*(F.lit(x) for x in (".png", ".html", ".PDF", "", ".jpeg", ".txt"))), (F.col("page_id") % 6 + 1).cast("int"))
    own = read(spark, sf, "pages")["pages"].select((F.col("page_id") % 10).alias("student"), F.concat(F.lit("out/fig.v2/"), F.col("page_id").cast("string"), ending).alias("path"))
    return tables.figures(own, "student").groupBy("student", "requirement").agg(F.count("*").alias("n"), F.max("word").alias("last"))


def json_extract(spark, sf):
    """A field of the events' JSON by kind, read tolerantly from a fenced text."""
    e = read(spark, sf, "events")["events"]
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    keys = F.json_object_keys(tables.tolerant_json(fenced))
    return e.select(F.explode(keys).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def submission_audit(spark, sf):
    t = read(spark, sf, "documents", "labels")
    docs = t["documents"].select(F.col("doc_id").alias("student"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"))
    return tables.audit(docs, t["labels"].select(F.col("doc_id").alias("student")), docs.filter("text is not null")).groupBy("in_results", "file_missing").agg(F.count("*").alias("n"), F.sum("characters").alias("characters"))


def log_severity(spark, sf):
    """Severities of the conversations' turns, taken as logs."""
    rows = read(spark, sf, "conversations")["conversations"]
    level = tables.severity(F.when(F.col("turn") % 5 == 4, 1).otherwise(0), F.when(F.col("turn") % 3 == 0, F.lit("Warning: slow")).otherwise(F.col("role")))
    return rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


def size_strings(spark, sf):
    rows = read(spark, sf, "part")["part"].select(F.concat((F.col("p_partkey") % 50).cast("string"), F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("text"))
    return rows.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", tables.size_in_bytes(F.col("text")).alias("bytes"))


def upload_tiers(spark, sf):
    rows = read(spark, sf, "part")["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return tables.upload_order(rows, ["^a", "^b"], ["e$"]).groupBy("tier").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    status_pivot, warnings_missing, long_results, manifest_merge, upsert_results, result_merge, dir_rollup, archive_plan, evidence_snippets, figure_files, json_extract, submission_audit, log_severity, size_strings, upload_tiers,
)}

RES = f"res as ({duck(RESULTS)})"
FIL = f"fil as ({duck(FILES)})"
PRE = f"""{FIL}, parts as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as p from fil), pre as (select path, size_bytes, len(p) - 1 as deep, unnest(range(1, len(p))) as depth, p from parts),
  dirs as (select array_to_string(p[1:depth], '/') as prefix, cast(depth as int) as depth, count(*) as files, cast(sum(size_bytes) as bigint) as bytes, count(*) filter (depth = deep) as direct from pre group by 1, 2)"""

ORACLE_SQL = {
    "status_pivot": f"with {RES} select requirement as root, {', '.join(f'count(*) filter (status = {s!r}) as {s.lower()}' for s in STATES)}, count(*) filter (status in ('NOT_MET', 'UNCERTAIN')) as failed, count(*) as total from res group by 1",
    "warnings_missing": f"""with {RES} select student, coalesce(string_agg(requirement, ',' order by requirement) filter (status in ('UNCERTAIN', 'NEEDS_REVIEW')), '') as warnings,
        coalesce(string_agg(requirement, ',' order by requirement) filter (status = 'NOT_MET'), '') as missing from res group by student""",
    "long_results": f"with {RES} select student, requirement, status from res",
    "manifest_merge": """with old as (select 'acct' || (s_suppkey*3)::varchar as name, case when s_suppkey % 4 = 0 then 'FAILED' else 'UPLOADED' end as status from supplier)
        select 'acct' || c_custkey::varchar as name, 'file' as kind, coalesce(old.status, 'PENDING') as status from customer left join old on old.name = 'acct' || c_custkey::varchar""",
    "upsert_results": f"""with {RES} select student, requirement, case when student::bigint % 7 = 0 and requirement = 'quality' then 'MET' else status end as status from res
        where status <> 'UNCERTAIN' or (student::bigint % 7 = 0 and requirement = 'quality')""",
    "result_merge": f"""with {RES}, a as (select student, status from res where requirement = 'quality' and status = 'MET'), b as (select student, status from res where requirement = 'toxic' and status <> 'UNCERTAIN')
        select student, coalesce(a.status, 'NONE') as quality, coalesce(b.status, 'NONE') as toxic from a full outer join b using (student)""",
    "dir_rollup": f"with {PRE} select * from dirs",
    "archive_plan": f"""with {PRE}, w as (select p.path, p.size_bytes, min(d.depth) as top, any_value(p.deep) as deep, any_value(p.p) as p from pre p left join dirs d on d.prefix = array_to_string(p.p[1:p.depth], '/') and d.bytes <= {LIMIT} group by p.path, p.size_bytes)
        select case when top is not null then array_to_string(p[1:top], '/') when size_bytes >= {BIG} then path else array_to_string(p[1:deep], '/') end as archive, case when top is not null then 'directory' when size_bytes >= {BIG} then 'file' else 'bundle' end as kind,
        count(*) as files, cast(sum(size_bytes) as bigint) as bytes from w group by 1, 2""",
    "evidence_snippets": f"""with kw(requirement, word) as (values {", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS)}), m as (select doc_id, requirement, word, text, cast(position(lower(word) in lower(text))  as int) as place from documents cross join kw)
        select doc_id, requirement, word, place, substr(text, greatest(place - 40, 1), place - greatest(place - 40, 1) + length(word) + 40) as snippet from m where place > 0""",
    "figure_files": """select page_id % 10 as student, 'figures' as requirement, count(*) as n, max('out/fig.v2/' || page_id::varchar || ['.png', '', '.PDF', '', '.jpeg', ''][page_id % 6 + 1]) as last from pages where page_id % 2 = 0 group by 1""",
    "json_extract": "select field, count(*) as n from (select unnest(json_keys(props)) as field from events) group by field",
    "submission_audit": """select doc_id in (select doc_id from labels) as in_results, doc_id % 11 = 0 as file_missing, count(*) as n, cast(sum(case when doc_id % 11 <> 0 then length(text) else 0 end) as bigint) as characters from documents group by 1, 2""",
    "log_severity": "select case when turn % 5 = 4 then 'ERROR' when turn % 3 = 0 or lower(role) like '%warning%' then 'WARNING' else 'OK' end as level, count(*) as n from conversations group by 1",
    "size_strings": """with t as (select (p_partkey % 50)::varchar || ['K', 'M', 'G', ''][p_partkey % 4 + 1] as text, p_partkey % 50 as v, p_partkey % 4 as u from part)
        select text, count(*) as n, cast(any_value(v*(case u when 0 then 1024 when 1 then 1048576 when 2 then 1073741824 else 1 end)) as bigint) as bytes from t group by text""",
    "upload_tiers": "select cast(case when p_name like 'a%' then 0 when p_name like 'b%' then 1 when p_name like '%e' then 1000 else 500 end as int) as tier, count(*) as n from part group by 1",
}
