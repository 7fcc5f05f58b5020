"""Structure files, logs and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import filled, headed
from .dumps import KINDS, embedded_number, tokens
from .lines import blocked, carried, lines, unnumbered
from .shared import stored

SECTIONS = "Masses|Atoms|Velocities|Bonds|Angles|Dihedrals|Impropers|Pair Coeffs|Bond Coeffs"
#: Keys over which the atoms of a step are dealt where they meet their cell.
STEP_PARTS = 32
#: Columns of atom lines by style; image flags may follow.
STYLES = {
    "atomic": ("atom_id", "type", "x", "y", "z"), "charge": ("atom_id", "type", "charge", "x", "y", "z"),
    "molecular": ("atom_id", "molecule", "type", "x", "y", "z"), "full": ("atom_id", "molecule", "type", "charge", "x", "y", "z"),
}


def structure(spark: SparkSession, path: str | Sequence[str], style: str | None = None) -> dict[str, DataFrame]:
    """Parts of structure files, where a word that is no number gives null: box (path, xlo ... zhi, tilts), masses (path, type, mass, element), atoms, velocities.

    A line belongs to the last section named above it. The style is the one given, else the one that the section's
    comment names, else atomic. A general cell is told by avec, bvec, cvec and an origin. The files are read when this is
    called, and their lines written once with their sections, so that many files aren't opened again for every part.
    """
    rows = unnumbered(spark, path)
    name = F.regexp_extract("value", rf"^\s*({SECTIONS})\b", 1)
    rows = rows.withColumn("head", F.when(name != "", name))
    rows = stored(carried(rows, F.col("head"), "section", order="at").select("path", "value", "head", "section")).withColumn("w", tokens(F.regexp_replace("value", "#.*", "")))
    body = rows.filter(F.col("head").isNull() & (F.trim("value") != ""))
    numbers = lambda key, k: F.max(F.when(F.col("value").rlike(rf"\b{key}\b"), F.element_at("w", k).try_cast("double")))
    top = rows.filter("section is null and head is null")
    general = {f"{v}vec": [numbers(f"{v}vec", k) for k in (1, 2, 3)] for v in "abc"}
    origin = [F.coalesce(numbers("origin", k), F.lit(0.0)) for k in (1, 2, 3)]
    ends = []
    for k, a in enumerate("xyz"):
        ends += [F.coalesce(numbers(f"{a}lo {a}hi", 1), origin[k]).alias(f"{a}lo"), F.coalesce(numbers(f"{a}lo {a}hi", 2), origin[k] + general["abc"[k] + "vec"][k]).alias(f"{a}hi")]
    tilts = [F.coalesce(numbers("xy xz yz", k + 1), general[v][c], F.lit(0.0)).alias(n) for k, (n, v, c) in enumerate((("xy", "bvec", 0), ("xz", "cvec", 0), ("yz", "cvec", 1)))]
    box = top.groupBy("path").agg(*ends, *tilts)
    masses = body.filter("section = 'Masses'").select("path", F.element_at("w", 1).try_cast("int").alias("type"), F.element_at("w", 2).try_cast("double").alias("mass"), F.regexp_extract("value", r"#\s*(\S+)", 1).alias("element"))
    named = rows.filter("head = 'Atoms'").groupBy("path").agg(F.max(F.regexp_extract("value", r"#\s*(\w+)", 1)).alias("style"))
    said = F.lit(style) if style else F.when(F.col("style").isin(*STYLES), F.col("style")).otherwise("atomic")
    told = body.filter("section = 'Atoms'").join(named, "path", "left").withColumn("style", said)
    columns = dict.fromkeys([*STYLES["full"], "ix", "iy", "iz"])

    def value(c: str) -> Column:
        cases = [F.when(F.col("style") == s, F.try_element_at("w", F.lit((list(cs) + ["ix", "iy", "iz"]).index(c) + 1))) for s, cs in STYLES.items() if c in cs or c in ("ix", "iy", "iz")]
        return F.coalesce(*cases).try_cast(KINDS.get(c, "bigint" if c == "molecule" else "double")).alias(c)

    atoms = told.select("path", *(value(c) for c in columns))
    velocities = body.filter("section = 'Velocities'").select("path", F.element_at("w", 1).try_cast("bigint").alias("atom_id"), *(F.element_at("w", k + 2).try_cast("double").alias(f"v{a}") for k, a in enumerate("xyz")))
    return {"box": box, "masses": masses, "atoms": atoms, "velocities": velocities}


def structure_text(atoms: DataFrame, box: DataFrame, masses: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """(keys, value): structure files with header, masses and atoms in the atomic style."""
    body = atoms.groupBy(*keys).agg(F.count("*").alias("_n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("atom_id", F.concat_ws(" ", *(F.col(c).cast("string") for c in STYLES["atomic"])).alias("l")))), lambda x: x["l"])).alias("_b"))
    kinds = masses.groupBy(*keys).agg(F.count("*").alias("_k"), F.concat_ws("\n", F.array_sort(F.collect_list(F.concat_ws(" ", F.col("type").cast("string"), F.col("mass").cast("string"), F.concat(F.lit("# "), F.col("element")))))).alias("_m"))
    ends = [F.concat_ws(" ", F.col(f"{a}lo").cast("string"), F.col(f"{a}hi").cast("string"), F.lit(f"{a}lo {a}hi")) for a in "xyz"]
    met = box.join(body, list(keys)).join(kinds, list(keys))
    return met.select(*keys, F.concat_ws("\n", F.lit("structure\n"), F.concat(F.col("_n").cast("string"), F.lit(" atoms")), F.concat(F.col("_k").cast("string"), F.lit(" atom types\n")), *ends, F.lit("\nMasses\n"), F.col("_m"), F.lit("\nAtoms # atomic\n"), F.col("_b"), F.lit("")).alias("value"))


def log_sections(rows: DataFrame) -> DataFrame:
    """(path, section, n, names, w): tables of a log, from a line that begins with Step to the one of the loop time.

    rows: (path, n, value). Each file's sections are numbered from 1; rows repeated at the border of runs are kept.
    """
    head, tail = F.col("value").rlike(r"^\s*Step\b"), F.col("value").rlike(r"^\s*Loop time")
    edges = F.when(head, F.struct(F.col("n").alias("at"), tokens(F.col("value")).alias("names"))).when(tail, F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("array<string>").alias("names")))
    marked = carried(blocked(rows).withColumn("n", F.col("n").cast("bigint")), edges, "_last").filter(F.col("_last.at").isNotNull() & ~head)
    heads = rows.filter(head).select("path", F.col("n").cast("bigint").alias("_at"), F.row_number().over(Window.partitionBy("path").orderBy("n")).cast("bigint").alias("section"))  # one row for each section
    body = marked.withColumn("_at", F.col("_last.at")).join(heads, ["path", "_at"]).withColumn("names", F.col("_last.names")).withColumn("w", tokens(F.col("value")))
    return body.filter((F.size("w") == F.size("names")) & F.forall("w", lambda x: x.try_cast("double").isNotNull())).select("path", "section", "n", "names", F.transform("w", lambda x: x.try_cast("double")).alias("w"))


def thermo(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(path, section, <columns>) of all run sections of logs; a column that a section lacks is null."""
    rows = log_sections(lines(spark, path))
    values = F.map_from_arrays("names", "w")
    return rows.select("path", "section", "n", *(F.try_element_at(values, F.lit(c)).alias(c) for c in columns))


def thermo_tables(spark: SparkSession, path: str | Sequence[str], number: Column | None = None) -> DataFrame:
    """Numbered CSV files together, with the number of each in column file: that of its name, or one told of its
    `_metadata`. Empty files give nothing."""
    return spark.read.option("header", True).csv(path).withColumn("file", embedded_number(F.col("_metadata.file_path")) if number is None else number)


OSZICAR = {"temperature": "T", "energy": "E", "free": "F", "e0": "E0", "kinetic": "EK", "sp": "SP", "sk": "SK"}


def oszicar(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, step, temperature, energy, ...) of the lines that tell a step's energies; others are left out."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.col("value").rlike(r"^\s*\d+\s+T=.*E=.*F="))
    take = lambda key: F.regexp_extract("value", rf"\b{key}=\s*(\S+)", 1).try_cast("double")
    return rows.select("path", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("bigint").alias("step"), *(take(k).alias(n) for n, k in OSZICAR.items()))


def dipole_series(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, step, mx, my, mz) of lines with four numbers."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), tokens(F.col("value")).alias("w")).filter((F.size("w") == 4) & F.forall("w", lambda x: x.try_cast("double").isNotNull()))
    return rows.select("path", F.element_at("w", 1).cast("double").cast("bigint").alias("step"), *(F.element_at("w", k + 2).cast("double").alias(f"m{a}") for k, a in enumerate("xyz")))


def bond_lists(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, i, x, y, z, type, j, r) of lines `id x y z type n (j r)*`."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), tokens(F.col("value")).alias("w")).filter(F.size("w") >= 6)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.try_element_at("w", F.lit(6)).cast("int")), lambda k: k < F.element_at("w", 6).cast("int")), lambda k: F.struct(F.element_at("w", 7 + 2 * k).cast("bigint").alias("j"), F.element_at("w", 8 + 2 * k).cast("double").alias("r")))
    out = rows.select("path", F.element_at("w", 1).cast("bigint").alias("i"), *(F.element_at("w", k + 2).cast("double").alias(a) for k, a in enumerate("xyz")), F.element_at("w", 5).cast("int").alias("type"), F.explode(pairs).alias("p"))
    return out.select("path", "i", "x", "y", "z", "type", "p.j", "p.r")


def counted_blocks(rows: DataFrame, header: int = 3, count: int = 3) -> DataFrame:
    """(path, step, head, row, w): rows of blocks whose header of `header` whole numbers begins with the step.

    rows: (path, n, value). The header's number `count` (from 1) tells how many rows follow, and headers are found by these
    counts alone, from the first line on, so rows may be whole numbers too. Blank lines aren't counted, lines that are no
    header where one is due are passed over, and a last block with too few rows is left out. head: the header's words.
    """
    w = tokens(F.col("value"))
    whole = F.col("value").rlike(r"^\s*" + r"\s+".join([r"\d+"] * header) + r"\s*$")
    found = headed(filled(rows), F.when(whole, w[count - 1].try_cast("bigint") + 1))
    opens = F.when(F.col("head"), F.struct(F.col("n").alias("at"), F.when(whole, w).alias("words")))
    marked = carried(found, opens, "_last").filter(~F.col("head") & F.col("_last.words").isNotNull())
    number = F.col("_last.words")[count - 1].try_cast("bigint")
    told = marked.select("path", F.col("_last.at").alias("_at"), F.col("_last.words").alias("head"), number.alias("_number"), (F.col("n") - F.col("_last.at")).alias("row"), w.alias("w"))
    whole_blocks = told.groupBy("path", "_at").agg(F.count("*").alias("_found"))
    return told.join(whole_blocks, ["path", "_at"]).filter("_found >= _number").select("path", F.col("head")[0].try_cast("bigint").alias("step"), "head", "row", "w")


def eigenvalues(rows: DataFrame) -> DataFrame:
    """(path, step, band, energy, occupation) of blocks headed by step, number and number of bands."""
    return counted_blocks(rows).select("path", "step", F.element_at("w", 1).try_cast("int").alias("band"), *(F.try_element_at("w", F.lit(k)).try_cast("double").alias(n) for k, n in ((2, "energy"), (3, "occupation"))))


def fermi_levels(rows: DataFrame) -> DataFrame:
    """(path, step, fermi) of lines with a step and a level."""
    w = tokens(F.col("value"))
    return rows.filter(F.size(w) == 2).select("path", w[0].try_cast("bigint").alias("step"), w[1].try_cast("double").alias("fermi")).filter("step is not null and fermi is not null")


def band_weights(rows: DataFrame) -> DataFrame:
    """(path, step, band, atom, orbital, weight) of blocks headed by step, band and number of rows."""
    found = counted_blocks(rows)
    return found.select("path", "step", F.col("head")[1].try_cast("int").alias("band"), F.element_at("w", 1).try_cast("int").alias("atom"), F.try_element_at("w", F.lit(2)).try_cast("int").alias("orbital"), F.try_element_at("w", F.lit(3)).try_cast("double").alias("weight"))


def by_third_column(rows: DataFrame) -> DataFrame:
    """(value) lines of three columns or more, those with the greatest third number first."""
    w = tokens(F.col("value"))
    return rows.withColumn("third", F.try_element_at(w, F.lit(3)).try_cast("double")).filter("third is not null").orderBy(F.desc("third"), "n").select("path", "n", "third", "value")


def cartesian(atoms: DataFrame, frames: DataFrame, keys: Sequence[str] = ("step",)) -> DataFrame:
    """Scaled coordinates times the cell (columns h11 ... h33, rows are vectors) of each step."""
    # a step's atoms are dealt over several keys, each with the step's cell, so that few steps are no few tasks' work
    spread = F.explode(F.array(*(F.lit(k) for k in range(STEP_PARTS)))).alias("_part")
    part = F.pmod(F.xxhash64("x", "y", "z"), F.lit(STEP_PARTS)).cast("int")
    met = atoms.withColumn("_part", part).join(frames.select("*", spread), [*keys, "_part"]).drop("_part")
    return met.withColumns({a: F.col("x") * F.col(f"h1{k}") + F.col("y") * F.col(f"h2{k}") + F.col("z") * F.col(f"h3{k}") for k, a in enumerate("xyz", 1)})


def curve_table(curves: DataFrame, labels: Sequence[str], x: str = "x", label: str = "label", y: str = "y") -> DataFrame:
    """Curves side by side, one column for each label, with six decimals; for writing, as it is small."""
    wide = curves.groupBy(x).pivot(label, list(labels)).agg(F.first(y)).orderBy(x)
    return wide.select(F.format_string("%.6f", F.col(x)).alias(x), *(F.format_string("%.6f", F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in labels))


def dated(name: str) -> str:
    """A file name that begins with today's date."""
    from datetime import date

    return f"{date.today():%Y%m%d}_{name}"


def id_lists(rows: DataFrame, key: str = "frame", id_col: str = "atom_id", name: str = "ids") -> DataFrame:
    """(key, ids): each frame's ids in order, for JSON lines."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(id_col)).alias(name))


def selection_text(lists: DataFrame, name: str = "ids") -> DataFrame:
    """Adds expression, which selects these ids, and nothing where there are none."""
    each = F.concat_ws(" || ", F.transform(name, lambda x: F.concat(F.lit("ParticleIdentifier == "), x.cast("string"))))
    return lists.withColumn("expression", F.when(F.size(name) > 0, each).otherwise("ParticleIdentifier == 0 && ParticleIdentifier == 1"))
