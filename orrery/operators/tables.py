"""Manifests, archive plans, result matrices and text evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING = "PENDING"


def carry_over(listing: DataFrame, old: DataFrame, key: str | Sequence[str] = "name") -> DataFrame:
    """A new listing with the old manifest's status by key, PENDING where there is none."""
    keys = [key] if isinstance(key, str) else list(key)
    return listing.join(old.select(*keys, "status").dropDuplicates(keys), keys, "left").withColumn("status", F.coalesce("status", F.lit(PENDING)))


def insert_absent(manifest: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The manifest with rows whose exact key it lacks."""
    return manifest.unionByName(rows.join(manifest, list(keys), "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with rows of the same key replaced."""
    return table.join(rows, list(keys), "left_anti").unionByName(rows)


def latest(feedback: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each key's last record."""
    rest = [c for c in feedback.columns if c not in keys]
    return feedback.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def merged(a: DataFrame, b: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Full outer merge of two result tables; missing values take their column's default."""
    out = a.join(b, list(keys), "full_outer")
    return out.select(*keys, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def status_counts(manifest: DataFrame, states: Sequence[str], failures: Sequence[str] = (), key: str = "root") -> DataFrame:
    """(key, <state> ..., failed, total) counts."""
    return manifest.groupBy(key).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in states), F.count_if(F.col("status").isin(*failures) if failures else F.lit(False)).alias("failed"), F.count("*").alias("total"))


def all_uploaded(manifest: DataFrame, key: str = "root") -> DataFrame:
    """(key, done): whether every entry of a root has arrived."""
    return manifest.groupBy(key).agg(F.bool_and(F.coalesce(F.col("status") == "UPLOADED", F.lit(False))).alias("done"))


def upload_order(manifest: DataFrame, first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """Entries in three tiers: names that fit a first pattern in the patterns' order, others, and those of the last."""
    tier = F.coalesce(*(F.when(F.col("name").rlike(p), F.lit(k)) for k, p in enumerate(first)), *(F.when(F.col("name").rlike(p), F.lit(1000 + k)) for k, p in enumerate(last)), F.lit(500))
    return manifest.withColumn("tier", tier).orderBy("tier", "name")


def prefixes(path: Column) -> Column:
    """Every directory above a path, itself left out: a/b/c gives a and a/b."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """(prefix, depth, files, bytes, direct) of every directory: all that lies below it, and what lies in it directly."""
    rows = files.filter(F.size(F.filter(F.split("path", "/"), lambda x: x != "")) > 1).select("size_bytes", F.posexplode(prefixes(F.col("path"))).alias("at", "prefix"), (F.size(F.filter(F.split("path", "/"), lambda x: x != "")) - 1).alias("deep"))
    return rows.groupBy("prefix", (F.col("at") + 1).alias("depth")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("at") + 1 == F.col("deep")).alias("direct"))


#: Parts that the directories below one prefix are dealt over.
SALTS = 16


def archive_plan(files: DataFrame, limit: int, big: int) -> DataFrame:
    """(archive, kind, files, bytes): a directory within the limit is one archive, the topmost such; what is left goes
    singly if it is big, else in a bundle for its directory.

    Files are counted by directory first, big ones singly, and only directories are held against those above them, which
    lie in SALTS copies each, so that a root isn't one key of all files.
    """
    sizes = directory_sizes(files)
    own = F.element_at(prefixes(F.col("path")), -1).alias("own")
    units = files.select(own, "size_bytes", F.when(F.col("size_bytes") >= big, F.col("path")).alias("unit")).groupBy("own", "unit").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    fits = sizes.filter(F.col("bytes") <= limit).select("prefix", "depth", salts)
    parts = F.filter(F.split("own", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    chains = units.select("own").distinct().select("own", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(above).alias("prefix"))
    whole = chains.join(fits, ["prefix", "salt"]).groupBy("own").agg(F.min_by("prefix", "depth").alias("whole"))
    met = units.join(whole, "own", "left")
    kind = F.when(F.col("whole").isNotNull(), "directory").when(F.col("unit").isNotNull(), "file").otherwise("bundle")
    return met.groupBy(F.coalesce("whole", "unit", "own").alias("archive"), kind.alias("kind")).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def size_in_bytes(text: Column) -> Column:
    """10M, 1.5G, 7K or 12 as bytes; null for anything else."""
    number = F.try_to_number(F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("999999999999999.999")).cast("double")
    unit = F.upper(F.regexp_extract(text, r"([KMGTkmgt]?)[Bb]?\s*$", 1))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(text.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*[KMGTkmgt]?[Bb]?\s*$"), (number * F.pow(F.lit(1024.0), power)).cast("long"))


def status_lists(results: DataFrame) -> DataFrame:
    """(student, warnings, missing): requirements that are unclear and that aren't met, in order."""
    pick = lambda *states: F.array_join(F.array_sort(F.collect_list(F.when(F.col("status").isin(*states), F.col("requirement")))), ",")
    return results.groupBy("student").agg(pick("UNCERTAIN", "NEEDS_REVIEW").alias("warnings"), pick("NOT_MET").alias("missing"))


def long_results(wide: DataFrame, key: str = "student") -> DataFrame:
    """(student, requirement, status) from one column for each requirement; boolean columns are skipped."""
    columns = [c for c, t in wide.dtypes if c != key and t == "string"]
    return wide.select(key, *columns).unpivot(key, columns, "requirement", "status")


def audit(submissions: DataFrame, results: DataFrame, texts: DataFrame, key: str = "student") -> DataFrame:
    """(key, in_results, file_missing, characters) of each submission."""
    return submissions.select(key).join(results.select(key).distinct().withColumn("r", F.lit(True)), key, "left").join(texts.select(key, "text"), key, "left").select(key, F.col("r").isNotNull().alias("in_results"), F.col("text").isNull().alias("file_missing"), F.coalesce(F.length("text"), F.lit(0)).alias("characters"))


#: Keywords that stand beside a text at once.
TOGETHER = 1000
#: Endings of files that are figures.
FIGURES = (".png", ".jpg", ".jpeg", ".pdf")


def figures(files: DataFrame, key: str, path_col: str = "path") -> DataFrame:
    """(key, requirement, word): files that are figures, by their ending without regard to case."""
    ending = F.lower(F.regexp_extract(path_col, r"[^/](\.[^./]*)$", 1))
    return files.filter(ending.isin(*FIGURES)).select(key, F.lit("figures").alias("requirement"), F.col(path_col).alias("word"))


def evidence(docs: DataFrame, keywords: DataFrame, around: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, requirement, word, place, snippet): the first place of each keyword in each text, without regard to case.

    keywords: (requirement, word). They stand beside each text in arrays of TOGETHER at most, whatever their number, so
    that a text is read where it lies and only what is found becomes a row.
    """
    blocks = -(-keywords.count() // TOGETHER)
    listed = keywords.withColumn("_block", F.pmod(F.xxhash64("requirement", "word"), F.lit(max(2 * blocks, 1))) if blocks > 1 else F.lit(0))
    every = listed.groupBy("_block").agg(F.collect_list(F.struct("requirement", "word", F.lower("word").alias("low"))).alias("_words")).select("_words")
    met = docs.select(id_col, text_col).crossJoin(every).withColumn("_low", F.lower(text_col))
    hits = F.transform("_words", lambda k: F.struct(k["requirement"].alias("requirement"), k["word"].alias("word"), F.call_function("locate", k["low"], F.col("_low")).alias("place")))
    met = met.select(id_col, text_col, F.explode(F.filter(hits, lambda h: h["place"] > 0)).alias("_hit")).select(id_col, text_col, "_hit.*")
    start = F.greatest(F.col("place") - around, F.lit(1))
    return met.select(id_col, "requirement", "word", "place", F.substring(F.col(text_col), start, F.col("place") - start + F.length("word") + around).alias("snippet"))


def tolerant_json(text: Column) -> Column:
    """The outermost object of a text that may be fenced or have control characters, as JSON text."""
    plain = F.regexp_replace(F.regexp_replace(text, r"```[a-zA-Z]*", ""), r"[\x00-\x1f]", " ")
    return F.regexp_extract(plain, r"(?s)\{.*\}", 0)


def requirements(text: Column) -> Column:
    """Requirement list of either shape, bare or under a key, as an array of (id, type, description)."""
    row = "array<struct<id: string, type: string, description: string>>"
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, row)).otherwise(F.from_json(text, f"requirements {row}")["requirements"])


def severity(exit_code: Column, message: Column) -> Column:
    """OK, WARNING or ERROR of a task's log."""
    return F.when(exit_code != 0, "ERROR").when(F.lower(message).contains("warning"), "WARNING").otherwise("OK")


def composition_sums(parts: DataFrame, density: float | None = None, key: str = "system") -> DataFrame:
    """(key, atoms, mass, edge): sums of (quantity, mass, atoms per unit), and the cubic edge for a density."""
    out = parts.groupBy(key).agg(F.sum(F.col("quantity") * F.col("atoms")).alias("atoms"), F.sum(F.col("quantity") * F.col("mass")).alias("mass"))
    return out.withColumn("edge", F.pow(F.col("mass") * 1.6605 / F.lit(density), 1 / 3)) if density else out
