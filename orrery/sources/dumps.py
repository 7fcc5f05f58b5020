"""Multi-frame dumps and lattice or plain XYZ files as frames and atoms.

A dump is read by byte ranges: one pass finds the headers and counts lines, a second parses the bytes of the frames that are
asked for. XYZ files are numbered lines, so files stay splittable too. Columns are found by the header's names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import headed
from .lines import carried, lines
from .ranges import RANGE, files, filled_lines, line_start, opener, qualified, ranged, read_at, readable, rows_of, sized
from .shared import stored

KINDS = {"atom_id": "bigint", "type": "int", "element": "string", "charge": "double"} | {f"i{a}": "int" for a in "xyz"}
NAMES = {"id": "atom_id", "name": "element", "q": "charge"}
SEPARATOR = "ITEM: TIMESTEP\n"


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def number(words: Column, k: int | Column) -> Column:
    return F.try_element_at(words, F.lit(k) if isinstance(k, int) else k).cast("double")


#: Fields of a frame's header as a dump has them.
HEAD = {"at": "long", "timestep": "long", "n_atoms": "long", "bounds": "string", "b0": "string", "b1": "string", "b2": "string", "columns": "string"}
PIECE = {"path": "string", "range": "long", "piece": "long", "until": "long", "lines": "long", "head": "boolean"} | HEAD
#: What begins a line of a header, and how far behind it a header's end is looked for at once.
ITEM, HEADER_BYTES = b"ITEM: ", 1 << 12


def header_at(file, at: int) -> tuple[dict, int] | None:
    """The header that begins at a place, and where its atoms begin; None where it is cut off or no header."""
    data = read_at(file, at, HEADER_BYTES)
    if not data.startswith(b"ITEM: TIMESTEP"):
        return None
    while (atoms := data.find(b"\nITEM: ATOMS")) < 0 or (end := data.find(b"\n", atoms + 1)) < 0:
        more = read_at(file, at + len(data), HEADER_BYTES)
        if not more and atoms >= 0:  # the file ends with the header
            end = len(data)
            break
        if not more or len(data) > HEADER_BYTES << 4:
            return None
        data += more
    told = data[:end].decode("utf-8", "replace").replace("\r", "").split("\n")
    found: dict = {}
    for k, line in enumerate(told):
        below = told[k + 1 : k + 4]
        if line.startswith("ITEM: TIMESTEP") and below[0].strip().lstrip("-").isdigit():
            found["timestep"] = int(below[0])
        elif line.startswith("ITEM: NUMBER OF ATOMS") and below[0].strip().isdigit():
            found["n_atoms"] = int(below[0])
        elif line.startswith("ITEM: BOX BOUNDS") and len(below) == 3:
            found |= {"bounds": line.strip()} | {f"b{i}": x.strip() for i, x in enumerate(below)}
        elif line.startswith("ITEM: ATOMS"):
            found["columns"] = line.strip()
    return (found | {"at": at}, min(at + end + 1, at + len(data))) if len(found) == len(HEAD) - 1 else None


def item_end(file, at: int, length: int) -> tuple[int, dict | None]:
    """Where a header, or another item of two lines, ends that begins at a place, and the header."""
    head = header_at(file, at)
    if head:
        return head[1], head[0]
    return line_start(file, line_start(file, at + 1, length) + 1, length), None


def begun_before(file, at: int, length: int) -> int:
    """Where a header or other item ends that begins above a line and goes on below it; else the line's own place."""
    low = max(0, at - (HEADER_BYTES << 2))
    above = read_at(file, low, at - low)
    places = [m.start() for m in re.finditer(rb"^ITEM: ", above, re.M) if low == 0 or m.start() > 0]
    steps = [x for x in places if above.startswith(b"ITEM: TIMESTEP", x)]
    ends = [item_end(file, low + x, length)[0] for x in (*steps[-1:], *places[-1:])]
    if steps and places[-1] > steps[-1] and ends[0] > low + places[-1]:  # the last item is part of that header
        ends = ends[:1]
    return max([at, *ends])


def pieces_of(batches: Iterator[pa.RecordBatch], step: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of the ranges (path, length, begin, end): lines between headers, and the header where one begins.

    A line belongs to the range in which it begins. A line of a header's kind that isn't part of a frame's header ends
    the atoms before it.
    """
    opened = opener()
    for row in rows_of(batches, ("path", "length", "begin", "end")):
        file, length = opened(row["path"]), row["length"]
        first, last = (line_start(file, row[c], length) for c in ("begin", "end"))
        found: list[dict] = []
        header_end = begun_before(file, first, length) if 0 < first < last else first
        now: dict = {"piece": header_end, "lines": 0, "head": False}
        at = first
        while at < last:
            data = read_at(file, at, min(step, last - at))
            whole = data.rfind(b"\n") + 1 or len(data)  # lines are looked at whole
            if at + whole < last and not data.endswith(b"\n") and data.find(b"\n") < 0:
                data = read_at(file, at, line_start(file, at + len(data), length) - at)
                whole = len(data)
            data = data[:whole] if at + len(data) < last else data
            place, seen = 0, 0
            while place >= 0:
                place = 0 if seen == 0 and data.startswith(ITEM) else data.find(b"\n" + ITEM, max(seen - 1, 0))
                if place < 0:
                    break
                place += data[place : place + 1] == b"\n"
                if at + place < header_end:  # inside a header
                    seen = place + 1
                    continue
                now["lines"] += filled_lines(data[max(seen, header_end - at, 0) : place]) if place > max(seen, header_end - at, 0) else 0
                found.append(now | {"until": at + place})
                header_end, head = item_end(file, at + place, length)
                now = {"piece": header_end, "lines": 0, "head": True, "at": at + place} | (head or {})
                seen = place + 1
            rest = max(seen - 1 if seen else 0, header_end - at, 0)
            now["lines"] += filled_lines(data[rest:]) if rest < len(data) else 0
            at += len(data)
        found.append(now | {"until": max(last, now["piece"])})
        keep = [{"path": row["path"], "range": row["begin"]} | x for x in found if x["head"] or x["lines"]]
        kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        for k in range(0, len(keep), 1 << 13):
            yield pa.RecordBatch.from_pydict({c: pa.array([x.get(c) for x in keep[k : k + (1 << 13)]], kinds[t]) for c, t in PIECE.items()})


def dump_pieces(spark: SparkSession, path: str | Sequence[str] | DataFrame, size: int = RANGE) -> DataFrame:
    """(path, piece, until, lines, before, found, <header>) of the atoms' byte ranges of every whole frame.

    Only headers are handed over the borders of ranges: a header counts for all pieces down to the next one. before is the
    number of the frame's lines above the piece, found that of all its lines. A last frame with too few lines is left
    out. path may also be a table (path, length) of files.
    """
    listed = path if isinstance(path, DataFrame) else files(spark, path)
    rows = ranged(listed, size).mapInArrow(pieces_of, ", ".join(f"{c} {t}" for c, t in PIECE.items()))
    # within a range first, then over the ranges, so that a file of many small frames is no single task's window
    head = F.when(F.col("head"), F.struct(*HEAD))
    rows = stored(rows)
    down = Window.partitionBy("path", "range").orderBy("piece", "until")
    over = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    ends = rows.groupBy("path", "range").agg(F.max_by(head, F.when(F.col("head"), F.struct("piece", "until"))).alias("_end"), F.sum(F.col("head").cast("int")).alias("_heads"))
    ends = ends.select("path", "range", F.last("_end", True).over(over).alias("_above"), F.coalesce(F.sum("_heads").over(over), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_here", F.last(head, True).over(down)).withColumn("_number", F.sum(F.col("head").cast("int")).over(down)).hint("merge").join(ends.hint("merge"), ["path", "range"])
    rows = rows.withColumn("frame_at", F.coalesce("_here", "_above")).withColumn("number", F.col("_number") + F.col("_before"))
    frame = Window.partitionBy("path", "number")
    rows = rows.filter("frame_at.timestep is not null").select(
        "path", "piece", "until", "lines", (F.sum("lines").over(frame.orderBy("piece", "until")) - F.col("lines")).alias("before"), F.sum("lines").over(frame).alias("found"), *(F.col(f"frame_at.{c}").alias(c) for c in HEAD),
    )
    return rows.filter("found >= n_atoms")


def boxed(heads: DataFrame, *more: str) -> DataFrame:
    """(path, timestep, n_atoms, xlo ... zhi, xy, xz, yz, pbc, header, ...) of header fields.

    Bounds of two numbers a line are orthogonal, of three have a tilt; of four they are cell vectors with the origin.
    """
    f = heads.withColumns({f"b{k}": tokens(F.col(f"b{k}")) for k in range(3)})
    abc = F.col("bounds").contains("abc origin")
    low = [F.when(abc, number(F.col(f"b{k}"), 4)).otherwise(number(F.col(f"b{k}"), 1)) for k in range(3)]
    high = [F.when(abc, number(F.col(f"b{k}"), 4) + number(F.col(f"b{k}"), k + 1)).otherwise(number(F.col(f"b{k}"), 2)) for k in range(3)]
    tilt = [F.when(abc, number(F.col(f"b{v}"), c)).otherwise(F.coalesce(number(F.col(f"b{k}"), 3), F.lit(0.0))) for k, (v, c) in enumerate(((1, 1), (2, 1), (2, 2)))]
    # a tilted box's bounds enclose it; its own edges are further in
    skew = ~abc & F.col("bounds").contains("xy")
    xs = F.array(F.lit(0.0), tilt[0], tilt[1], tilt[0] + tilt[1])
    low[0], high[0] = low[0] - F.when(skew, F.array_min(xs)).otherwise(0.0), high[0] - F.when(skew, F.array_max(xs)).otherwise(0.0)
    low[1], high[1] = low[1] - F.when(skew, F.least(F.lit(0.0), tilt[2])).otherwise(0.0), high[1] - F.when(skew, F.greatest(F.lit(0.0), tilt[2])).otherwise(0.0)
    flags = F.regexp_extract_all("bounds", F.lit(r"\b([pfsm]{2})\b"), F.lit(1))
    box = [c.alias(n) for a, lo, hi in zip("xyz", low, high, strict=True) for n, c in ((f"{a}lo", lo), (f"{a}hi", hi))]
    header = F.transform(F.filter(F.slice(F.split("columns", r"\s+"), 3, 1000), lambda x: x != ""), lambda x: F.lower(x))
    return f.select("path", "timestep", "n_atoms", *box, *(t.alias(n) for n, t in zip(("xy", "xz", "yz"), tilt, strict=True)), F.transform(flags, lambda x: x == "pp").alias("pbc"), header.alias("header"), *more)


def table_of(data: bytes, names: Sequence[str], columns: dict[str, pa.DataType]) -> pa.Table:
    """The asked columns of lines whose words stand for the names; others aren't made."""
    if any(x in data for x in (b"\t", b"\r", b"  ", b" \n", b"\n ")) or data[:1] in (b" ", b"\n"):
        data = re.sub(rb" *\n[ \n]*", b"\n", re.sub(rb"[ \t\r]+", b" ", data)).strip()
    wide = data.split(b"\n", 1)[0].count(b" ") + 1
    named = [*names, *(f"_more{k}" for k in range(len(names), wide))][: max(wide, len(names))]
    return csv.read_csv(
        pa.BufferReader(data), csv.ReadOptions(column_names=named, use_threads=False, block_size=max(len(data) + 1, 1 << 16)), csv.ParseOptions(delimiter=" ", quote_char=False, ignore_empty_lines=True),
        csv.ConvertOptions(column_types=columns, include_columns=list(columns), strings_can_be_null=False),
    )


def piece_atoms(pieces: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("path", "timestep"), at_once: int = 8 << 20) -> DataFrame:
    """One row for each atom of pieces (path, piece, until, lines, before, n_atoms, header), with the asked columns.

    Columns are found by the names of each frame's header; a missing one is an error. Lines behind the header's number of
    atoms are left out.
    """
    kinds = {c: KINDS.get(c, "double") for c in columns}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = dict(pieces.dtypes)
    back = {v: k for k, v in NAMES.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = opener()
        for batch in batches:
            for k, row in enumerate(batch.to_pylist()):
                names = [NAMES.get(c, c) for c in row["header"]]
                for c in columns:
                    if c not in names:
                        raise ValueError(f"the dump has no column {back.get(c, c)}")
                left = min(row["lines"], row["n_atoms"] - row["before"])
                file, at = opened(row["path"]), row["piece"]
                while left > 0 and at < row["until"]:
                    end = min(line_start(file, at + at_once, row["until"]), row["until"])
                    part = table_of(read_at(file, at, end - at), names, {c: arrow[t] for c, t in kinds.items()}).slice(0, left)
                    left, at = left - len(part), end
                    told = {c: batch.column(c).take(pa.array([k] * len(part))) for c in keep}
                    for piece in part.select(list(columns)).combine_chunks().to_batches():
                        yield pa.RecordBatch.from_arrays([*told.values(), *piece.columns], [*told, *columns])

    chosen = pieces.select(*dict.fromkeys([*keep, "path", "piece", "until", "lines", "before", "n_atoms", "header"]))
    spread = chosen.repartition("path", F.floor(F.col("piece") / RANGE)) if "path" in types else chosen
    return spread.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {t}" for c, t in kinds.items())]))


def text_frames(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Header fields and lines of every whole frame, one row a frame: for files that can't be opened by range."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("_metadata.file_path").alias("path"), "value").filter(F.trim("value") != "")
    f = raw.withColumn("l", F.split(F.regexp_replace("value", r"\r", ""), "\n"))
    head = {"timestep": F.trim(F.col("l")[0]).try_cast("bigint"), "n_atoms": F.trim(F.get("l", F.lit(2))).try_cast("bigint"), "bounds": F.trim(F.get("l", F.lit(3)))}
    head |= {f"b{k}": F.get("l", F.lit(4 + k)) for k in range(3)} | {"columns": F.trim(F.get("l", F.lit(7)))}
    f = f.select("path", *(c.alias(n) for n, c in head.items()), F.filter(F.slice("l", 9, 1 << 30), lambda x: F.trim(x) != "").alias("lines"))
    return boxed(f.filter(F.size("lines") >= F.col("n_atoms")).withColumn("lines", F.slice("lines", 1, F.greatest(F.col("n_atoms"), F.lit(0)).cast("int"))), "lines")


def atoms_of(frames: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("path", "timestep")) -> DataFrame:
    """One row for each atom of frames with their lines; a column that a header lacks is an error."""
    back = {v: k for k, v in NAMES.items()}
    named = F.transform("header", lambda x: F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in NAMES.items()), x))
    place = {c: F.array_position(named, c).cast("int") for c in columns}
    told = frames
    for c in columns:
        told = told.withColumn(f"_{c}", F.when(place[c] > 0, place[c]).otherwise(F.raise_error(F.lit(f"the dump has no column {back.get(c, c)}")).cast("int")))
    rows = told.select(*keep, *(f"_{c}" for c in columns), F.explode("lines").alias("line")).withColumn("w", tokens(F.col("line")))
    return rows.select(*keep, *(F.element_at("w", F.col(f"_{c}")).cast(KINDS.get(c, "double")).alias(c) for c in columns))


def read_dump(spark: SparkSession, path: str | Sequence[str] | DataFrame, columns: Sequence[str] = ("atom_id", "type", "x", "y", "z"), where: Column | None = None, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of dumps, of files by byte ranges, so that a frame of any size is read by many tasks.

    `where` chooses frames by their header, and the bytes of others are only searched for headers, never parsed; only
    asked columns are made. The search runs when this is called. A frame whose lines are fewer than its header says is
    left out; so is what comes before a first header. Compressed files, and stores that Arrow doesn't open, are read with
    one row a frame.
    """
    if not isinstance(path, DataFrame) and not readable([path] if isinstance(path, str) else path):
        frames = text_frames(spark, path)
        frames = frames if where is None else frames.filter(where)
        return frames.drop("header", "lines"), atoms_of(frames, columns)
    pieces = boxed_pieces(spark, path, size)
    pieces = pieces if where is None else pieces.filter(where)
    return piece_frames(pieces, ["path", "at"]), piece_atoms(pieces, columns)


def boxed_pieces(spark: SparkSession, path: str | Sequence[str] | DataFrame, size: int = RANGE) -> DataFrame:
    """One row for each frame and range; written once, so that files aren't searched again for every table made of them."""
    return stored(boxed(dump_pieces(spark, path, size), "at", "piece", "until", "lines", "before"))


def piece_frames(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pieces.filter("before = 0").dropDuplicates(list(keys)).drop("header", "at", "piece", "until", "lines", "before")


def read_frame_files(spark: SparkSession, path: str, columns: Sequence[str] = ("atom_id", "type", "x", "y", "z", "vx", "vy", "vz", "fx", "fy", "fz")) -> DataFrame:
    """(path, <columns>) of dumps of one frame each, by lines: for frames too large to be one row. Columns are fixed."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), tokens(F.col("value")).alias("w"), "value")
    rows = lines.filter((F.size("w") == len(columns)) & ~F.col("value").startswith("ITEM:"))
    return rows.select("path", *(F.element_at("w", k + 1).cast(KINDS.get(c, "double")).alias(c) for k, c in enumerate(columns)))


def read_xyz(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ("element", "x", "y", "z"), box: Sequence[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of XYZ files: a count, a comment, and as many atoms, again and again.

    Frames are found by their counts, from the first line on, so comments may be numbers. A comment of six numbers is a lattice (a, b, c and angles); one with `Timestep: N` names the frame; else frames are
    counted in their file, and the box is the one given. A last frame with too few atoms is left out.
    """
    whole = F.when(F.col("value").rlike(r"^\s*[0-9]+\s*$"), F.trim("value").try_cast("bigint"))
    rows = headed(lines(spark, path), whole + 2)
    heads = carried(rows, F.when(F.col("head") & whole.isNotNull(), F.struct("n", whole.cast("int").alias("n_atoms"))), "_head")
    heads = heads.filter("_head is not null").select("path", F.col("_head.n").alias("_start"), F.col("_head.n_atoms").alias("n_atoms"), (F.col("n") - F.col("_head.n")).alias("_at"), "value")
    heads = heads.filter(F.col("_at") <= F.col("n_atoms") + 1)
    f = heads.groupBy("path", "_start").agg(F.first("n_atoms").alias("n_atoms"), F.trim(F.max(F.when(F.col("_at") == 1, F.col("value")))).alias("comment"), F.count_if((F.col("_at") > 1) & (F.trim("value") != "")).alias("_found"))
    f = f.filter(F.col("_found") >= F.col("n_atoms")).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("_start")))  # one row for each frame
    body = heads.filter("_at > 1").select("path", "_start", "value")
    words = tokens(F.col("comment"))
    lattice = F.when(F.size(words) >= 6, F.transform(F.slice(words, 1, 6), lambda x: x.try_cast("double")))
    fixed = F.array(*(F.lit(float(x)) for x in (*box, 90, 90, 90))) if box else F.lit(None).cast("array<double>")
    step = F.regexp_extract("comment", r"Timestep:\s*([0-9]+)", 1)
    f = f.select("path", "_start", F.when(step != "", step.try_cast("bigint")).otherwise(F.col("k") - 1).alias("timestep"), "n_atoms", F.coalesce(F.when(F.forall(lattice, lambda x: x.isNotNull()), lattice), fixed).alias("lattice"))
    told = body.join(f.select("path", "_start", "timestep"), ["path", "_start"]).withColumn("w", tokens(F.col("value")))
    atoms = told.select("path", "timestep", *(F.try_element_at("w", F.lit(k + 1)).cast(KINDS.get(c, "double")).alias(c) for k, c in enumerate(columns)))
    return f.drop("_start"), atoms


def with_elements(atoms: DataFrame, mapping: str | dict[int, str], unknown: str | None = None) -> DataFrame:
    """Adds element by type. mapping: a dict or "1=Si,2=O"; a type without one keeps its number, after `unknown` if given."""
    if isinstance(mapping, str):
        mapping = {int(k): v for k, v in (x.split("=") for x in mapping.split(",") if x)}
    named = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return atoms.withColumn("element", F.coalesce(F.try_element_at(named, F.col("type")), F.concat(F.lit(unknown or ""), F.col("type").cast("string"))))


def resolved(atoms: DataFrame, species: DataFrame) -> DataFrame:
    """Atoms with their species row by name, without regard to case, else by type; an unknown element is an error."""
    by_name = species.select(F.lower("element").alias("_e"), F.col("mass").alias("_by_name"))
    by_type = species.select(F.col("type").alias("_t"), F.col("mass").alias("_by_type"))
    met = atoms.join(by_name, F.lower("element") == F.col("_e"), "left").join(by_type, F.col("element").try_cast("int") == F.col("_t"), "left")
    known = F.col("_e").isNotNull() | F.col("_t").isNotNull()
    mass = F.when(known, F.coalesce("_by_name", "_by_type")).otherwise(F.raise_error(F.concat(F.lit("no species for "), F.coalesce("element", F.lit("null")))).cast("double"))
    return met.withColumn("mass", mass).drop("_e", "_t", "_by_name", "_by_type")


def numbered(frames: DataFrame, by: Sequence[str] = ("traj_id",), order: str = "timestep") -> DataFrame:
    """Adds frame, 0, 1, ... in each trajectory, whatever its length."""
    from ..operators.ranks import dense

    return dense(frames, by, order, "frame")


def window(df: DataFrame, start: int | None = None, end: int | None = None, stride: int = 1, most: int | None = None, column: str = "frame") -> DataFrame:
    """Frames in [start, end), every stride-th of all, at most so many: the stride comes before the cap."""
    if start is not None:
        df = df.filter(F.col(column) >= start)
    if end is not None:
        df = df.filter(F.col(column) < end)
    if stride > 1:
        df = df.filter(F.col(column) % stride == 0)
    return df.filter(F.floor(F.col(column) / stride) < most) if most is not None else df


def embedded_number(path: Column) -> Column:
    """The last whole number in a file's name, by which files sort naturally."""
    return F.try_element_at(F.regexp_extract_all(F.regexp_extract(path, r"([^/]*)$", 1), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("bigint")


def wildcard(paths: DataFrame) -> tuple[str, int]:
    """The pattern that a list of names (column path) shares, with one varying number, and that number's place."""
    split = paths.select(F.split("path", r"\d+").alias("text"), F.regexp_extract_all("path", F.lit(r"(\d+)"), F.lit(1)).alias("numbers"))
    texts = split.agg(F.count_distinct("text").alias("n"), F.first("text").alias("text")).first()
    if texts["n"] != 1:
        raise ValueError("the names differ in more than a number")
    places = split.select(F.posexplode("numbers").alias("k", "v")).groupBy("k").agg(F.count_distinct("v").alias("n"), F.first("v").alias("v")).orderBy("k").collect()  # one row for each number in a name
    varying = [r["k"] for r in places if r["n"] > 1]
    if len(varying) != 1:
        raise ValueError("exactly one number must vary")
    text = texts["text"]
    return "".join(t + ("*" if k == varying[0] else places[k]["v"] if k < len(places) else "") for k, t in enumerate(text)), varying[0]


def validated(frames: DataFrame, atoms: DataFrame, keys: Sequence[str] = ("path", "timestep")) -> DataFrame:
    """(keys, n_atoms, found) of the frames whose rows don't number what their header says."""
    counts = atoms.groupBy(*keys).agg(F.count("*").alias("found"))
    return frames.select(*keys, "n_atoms").join(counts, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("n_atoms <> found")


def frame_head(columns: Sequence[str], style: str) -> Column:
    """What stands above a frame's atoms in a dump or in an XYZ file with its lattice; _n is their number."""
    if style == "xyz":
        return F.concat_ws("\n", F.col("_n").cast("string"), F.concat_ws(" ", *(F.col(c).cast("string") for c in ("a", "b", "c", "alpha", "beta", "gamma"))))
    back = {v: k for k, v in NAMES.items()}
    bounds = [F.concat_ws(" ", F.col(f"{a}lo").cast("string"), F.col(f"{a}hi").cast("string")) for a in "xyz"]
    named = " ".join(back.get(c, c) for c in columns)
    return F.concat_ws("\n", F.lit("ITEM: TIMESTEP"), F.col("timestep").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("_n").cast("string"), F.lit("ITEM: BOX BOUNDS pp pp pp"), *bounds, F.lit(f"ITEM: ATOMS {named}"))


def frame_text(atoms: DataFrame, frames: DataFrame, columns: Sequence[str], style: str = "dump", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(keys, value): each frame as the text of a dump or of an XYZ file with its lattice; atoms in the order of their ids."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    body = atoms.select(*keys, F.col("atom_id").alias("_id"), line.alias("line")).groupBy(*keys).agg(F.count("*").alias("_n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_id", "line"))), lambda x: x["line"])).alias("_body"))
    return frames.join(body, list(keys)).select(*keys, F.concat_ws("\n", frame_head(columns, style), "_body").alias("value"))


def frame_lines(atoms: DataFrame, frames: DataFrame, columns: Sequence[str], style: str = "dump", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(value): frame_text() of all frames in their order, a row for each head and atom, so that no frame is one row."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    counts = atoms.groupBy(*keys).agg(F.count("*").alias("_n"))
    heads = frames.join(counts, list(keys)).select(*keys, F.lit(0).alias("_below"), F.lit(None).cast(dict(atoms.dtypes)["atom_id"]).alias("_id"), frame_head(columns, style).alias("value"))
    body = atoms.join(frames.select(*keys), list(keys), "left_semi").select(*keys, F.lit(1).alias("_below"), F.col("atom_id").alias("_id"), line.alias("value"))
    return heads.unionByName(body).orderBy(*keys, "_below", "_id").select("value")


def dump_parts(atoms: DataFrame, frames: DataFrame, columns: Sequence[str], rows: int = 100_000, key: str = "frame") -> DataFrame:
    """(key, value): frames as texts of dumps of at most so many atoms each, in the order of their ids.

    A frame of any size is written by many tasks: each part has the frame's header, with its own number of atoms, as
    programs do that write one file a process; joined_parts() puts them together again. frames: (key, timestep, xlo ... zhi), and
    xy, xz, yz for tilted boxes, whose bounds enclose them. Columns may be any, velocities and charges too.
    """
    parts_ = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = {v: k for k, v in NAMES.items()}
    tilted = {"xy", "xz", "yz"} <= set(frames.columns)
    low, high = {a: F.lit(0.0) for a in "xyz"}, {a: F.lit(0.0) for a in "xyz"}
    if tilted:
        xs, ys = F.array(F.lit(0.0), F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")), F.array(F.lit(0.0), F.col("yz"))
        low |= {"x": F.array_min(xs), "y": F.array_min(ys)}
        high |= {"x": F.array_max(xs), "y": F.array_max(ys)}
    bounds = [F.concat_ws(" ", *((F.col(f"{a}{e}") + out[a]).cast("string") for e, out in (("lo", low), ("hi", high))), *([F.col(t).cast("string")] if tilted else [])) for a, t in zip("xyz", ("xy", "xz", "yz"), strict=True)]
    box = F.concat_ws("\n", F.lit(f"ITEM: BOX BOUNDS {'xy xz yz ' if tilted else ''}pp pp pp"), *bounds, F.lit("ITEM: ATOMS " + " ".join(back.get(c, c) for c in columns)))
    heads = frames.select(key, F.col("timestep").cast("string").alias("_step"), box.alias("_box"))
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in columns))
    told = atoms.select(key, F.col("atom_id").alias("_id"), line.alias("_line")).join(heads, key)
    kind = dict(told.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = [], None

        def text() -> pa.RecordBatch:
            value = "\n".join(["ITEM: TIMESTEP", head[1], "ITEM: NUMBER OF ATOMS", str(len(held)), head[2], *held])
            return pa.RecordBatch.from_arrays([pa.array([head[0]], types), pa.array([value])], [key, "value"])

        for batch in batches:
            types = batch.schema.field(key).type
            for frame, step, top, line in zip(*(batch.column(c).to_pylist() for c in (key, "_step", "_box", "_line")), strict=True):
                if held and (head[0] != frame or len(held) >= rows):
                    yield text()
                    held = []
                head = (frame, step, top)
                held.append(line)
        if held:
            yield text()

    return told.repartitionByRange(parts_, key, "_id").sortWithinPartitions(key, "_id").mapInArrow(run, f"{key} {kind}, value string")


def joined_parts(frames: DataFrame) -> DataFrame:
    """Frames of read_dump() whose parts lie in several headers or files: one row a time step, with all its atoms counted."""
    rest = [c for c in frames.columns if c not in ("path", "timestep", "n_atoms")]
    return frames.groupBy("timestep").agg(F.sum("n_atoms").alias("n_atoms"), F.count("*").alias("parts"), *(F.first(c).alias(c) for c in rest))


def read_any(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) by the format that the file's first line tells."""
    from .formats import detected

    return detected(spark, path).read(spark, path, **options)


def write_frames(text: DataFrame, path: str, keys: Sequence[str] = ("frame",)) -> None:
    """One folder for each value of the keys, such as frame or temperature, with the text (keys, value) of its frames.

    Spark renames what is complete, so a reader never sees half a file.
    """
    text.select(*keys, "value").write.partitionBy(*keys).text(path)


def read_listed(spark: SparkSession, listing: str, columns: Sequence[str] = ("atom_id", "type", "x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """(frames, atoms) of the dumps that a list file names, one path a line; frame is the place in the list."""
    from ..operators.ranks import ranked

    listed = lines(spark, listing).filter(F.trim("value") != "").select(qualified(spark, F.trim("value")).alias("path"), "n")
    place = ranked(listed, ["n", "path"]).select("path", (F.col("place") - 1).cast("int").alias("frame"))
    each = place.select("path").distinct()
    odd = [r["path"] for r in each.filter(F.udf(lambda p: not readable([p]), "boolean")("path")).collect()]
    if not odd:  # the names stay with the tasks, however many they are
        # places meet the pieces, not the atoms, which the planner takes for as few bytes as the pieces they come from
        pieces = boxed_pieces(spark, sized(each)).hint("merge").join(place.hint("merge"), "path")
        return piece_frames(pieces, ["frame", "at"]), piece_atoms(pieces, columns, ("path", "timestep", "frame"))
    # compressed files and other stores are listed by Spark, which wants their names
    frames, atoms = read_dump(spark, [r["path"] for r in each.collect()], columns)
    bare = lambda c: F.regexp_replace(c, r"^[a-zA-Z]+:/*", "/")
    place = place.select(bare("path").alias("_path"), "frame")
    return tuple(t.withColumn("_path", bare("path")).join(place, "_path").drop("_path") for t in (frames, atoms))


def framewise(atoms: DataFrame, kernel: Callable, schema: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """A kernel over each frame as a pandas frame, for what no operator tells; a frame must fit into a task."""
    return atoms.groupBy(*keys).applyInPandas(kernel, schema)


def modified(atoms: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Atoms after a chain of modifiers, each a function from atoms to atoms."""
    for step in steps:
        atoms = atoms.transform(step)
    return atoms
