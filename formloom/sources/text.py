"""Outlines, landmarks and curves from text files; score tables; file names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Sequence
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import let, pt
from ..operators.ranks import row_index

STEM = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def trim_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")


def stem(path: Column) -> Column:
    return trim_extension(basename(path))


def _numbers(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


COORDINATES = r"^\s*[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s*$"


def _points(lines: Column, place: Column, also: str = r"^\s*$", least: Column | None = None) -> Column:
    """Coordinate lines to points.

    A line that is neither coordinates nor matches ``also``, or another number of points than
    ``least``, raises with ``place``: no point is lost in silence.
    """
    def points(found):
        return F.transform(found, lambda l: let(_numbers(l), lambda v: pt(
            v.getItem(0).try_cast("double"), v.getItem(1).try_cast("double"))))

    def checked(found):
        odd = F.filter(lines, lambda l: ~l.rlike(COORDINATES) & ~l.rlike(also))
        other = F.lit(False) if least is None else F.size(found) != least
        return F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("no coordinates in "), place, F.lit(": "), F.get(odd, F.lit(0))))).when(
            other, F.raise_error(F.concat(F.when(F.size(found) < least, F.lit("fewer")).otherwise(F.lit("more")) if least is not None else F.lit(""),
                                          F.lit(" points than the header says in "), place))).otherwise(points(found))
    return checked(F.filter(lines, lambda l: l.rlike(COORDINATES)))


# ---- bundles: many records in a file ------------------------------------------------


def write_bundles(records: DataFrame, path: str, id_col: str = "id", text: str = "value") -> None:
    """Records of text under a line ``ID=<id>``, as many in a file as its partition holds.

    The line starts a record wherever it stands, so an id of several lines or a text line that begins like it raises.
    """
    name = F.col(id_col).cast("string")
    bad = F.coalesce(name.rlike(r"[\r\n]") | F.col(text).rlike("(?m)^ID="), F.lit(True))
    value = F.when(bad, F.raise_error(F.concat(F.lit("a bundle cannot hold the record "), F.coalesce(name, F.lit("NULL"))))).otherwise(
        F.concat(F.lit("ID="), name, F.lit("\n"), F.col(text)))
    records.select(value.alias("value")).write.text(path)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """``id, value`` of the records of bundles; the id line is the reader's separator, so a large file is split between records."""
    raw = spark.read.option("lineSep", "\nID=").option("recursiveFileLookup", True).text(path)
    body = F.regexp_replace("value", r"^ID=", "")  # the first record of a file keeps its own
    return raw.select(body.alias("value")).filter(F.trim("value") != "").select(F.regexp_extract("value", r"^([^\r\n]*)", 1).alias("id"), F.regexp_replace("value", r"^[^\r\n]*(\r?\n)?", "").alias("value"))


def _lines_of(points: Column, line) -> Column:
    return F.array_join(F.transform(points, line), "\n")


def outline_records(outlines: DataFrame) -> DataFrame:
    """``id, value``: the lines ``x y`` of every outline."""
    return outlines.select("id", _lines_of(F.col("coo"), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))).alias("value"))


def curve_records(curves: DataFrame) -> DataFrame:
    """``id, value``: the lines ``locusNNNN x y`` of the curves (``specimen, locus, coo``) of every specimen."""
    def lines(c):
        return F.transform(c["coo"], lambda p, i: F.concat_ws(" ", F.concat(c["locus"], F.lpad((i + 1).cast("string"), 4, "0")), p["x"].cast("string"), p["y"].cast("string")))
    all_of = F.array_sort(F.collect_list(F.struct("locus", "coo")))
    return curves.groupBy(F.col("specimen").alias("id")).agg(all_of.alias("_c")).select("id", F.array_join(F.flatten(F.transform("_c", lines)), "\n").alias("value"))


def landmark_records(marks: DataFrame) -> DataFrame:
    """``id, value``: the lines ``name x y`` of every specimen, by name."""
    line = F.struct("name", F.concat_ws(" ", "name", F.coalesce(F.col("x").cast("string"), F.lit("NA")), F.coalesce(F.col("y").cast("string"), F.lit("NA"))).alias("l"))
    return marks.groupBy(F.col("specimen").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("_l")).select(
        "id", F.array_join(F.transform("_l", lambda e: e["l"]), "\n").alias("value"))


def _records(spark: SparkSession, path: str, id_pattern: str, bundled: bool) -> DataFrame:
    """``id, place, value``, one row per record of a bundle or per file; the place is for messages."""
    if bundled:
        return read_bundles(spark, path).select("id", F.concat(F.lit("the record "), "id").alias("place"), "value")
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), id_pattern, 1).alias("id"), F.input_file_name().alias("place"), "value")


def _lines(spark: SparkSession, path: str, id_pattern: str, bundled: bool) -> DataFrame:
    """``specimen, value``, one row per line that is not blank."""
    if bundled:
        rows = read_bundles(spark, path).select(F.col("id").alias("specimen"), F.explode(F.split("value", r"\r?\n")).alias("value"))
    else:
        rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_extract(F.input_file_name(), id_pattern, 1).alias("specimen"), "value")
    return rows.filter(F.trim("value") != "")


def read_outlines(spark: SparkSession, path: str, id_pattern: str = STEM, bundled: bool = False) -> DataFrame:
    """``id, coo``: one whitespace table per file, or per record of a bundle; row order is outline order.

    ``id_pattern`` picks the id out of the file path (default: the stem).  A
    line that does not parse raises with its file or record.
    """
    return _records(spark, path, id_pattern, bundled).select("id", _points(F.split("value", r"\r?\n"), F.col("place")).alias("coo"))


def read_tps(spark: SparkSession, path: str, curves: bool = True) -> DataFrame:
    """``specimen, scale, part, part_no, seq, x, y`` from TPS files.

    The record header at a line's start is the reader's separator, so one large
    file is split over tasks.  ``LM=`` gives the number of landmarks; a record
    without curves but with ``POINTS=`` (outline files, ``LM=0``) takes that
    count instead.  Another number of points than that, or a line that is neither points nor
    a key, raise.  Records without ``IMAGE=`` and ``ID=`` are numbered within
    their file.
    """
    raw = spark.read.option("lineSep", "\nLM=").text(path).withColumn("_f", F.input_file_name())
    body = F.regexp_replace("value", r"^\s*LM=", "")  # the first record of a file keeps its header
    rec = raw.withColumn("value", body).filter(F.col("value").rlike(r"\S")).withColumn("value", F.when(
        F.col("value").rlike(r"^\s*[0-9]"), F.col("value")).otherwise(F.raise_error(
            F.concat(F.lit("text before the first LM= in "), F.col("_f"))))).withColumn("_m", F.monotonically_increasing_id())
    key = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}=([^\r\n]*)", 1), F.lit(""))
    rec = rec.withColumn("_name", F.coalesce(trim_extension(key("IMAGE")), key("ID")))
    named = rec.filter(F.col("_name").isNotNull())
    loose = rec.filter(F.col("_name").isNull())
    numbered = row_index(loose, "_m", "_no", within=["_f"])
    both = named.unionByName(numbered.withColumn("_name", F.concat(F.lit("id"), F.col("_no").cast("string"))).drop("_no"))
    has_curves = F.col("value").rlike(r"(?m)^CURVES=")
    # block 0: landmarks and header; every later block: a point count and its lines
    blocks = F.split("value", r"(?m)^POINTS=")

    def lines_of(b):
        return F.split(b, r"\r?\n")

    def counted(b):
        return F.coalesce(F.regexp_extract(b, r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))

    def part(name, no, b):
        return F.struct(F.lit(name).alias("part"), F.lit(no).cast("int").alias("part_no")
                        if isinstance(no, int) else no.cast("int").alias("part_no"),
                        _points(F.slice(lines_of(b), F.lit(2), F.size(lines_of(b))), F.col("specimen"),
                                r"^\s*(?:[A-Za-z_]+=.*)?$", counted(b)).alias("coo"))
    marks = both.select(
        F.col("_name").alias("specimen"), key("SCALE").try_cast("double").alias("scale"),
        has_curves.alias("_c"), blocks.alias("_b"))  # a block's first line ends the header before it
    head = F.element_at("_b", 1)
    first = F.when(~F.col("_c") & (F.size("_b") > 1), part("landmark", 0, F.element_at("_b", 2))).otherwise(
        part("landmark", 0, head))
    rest = F.when(F.col("_c") & F.lit(curves), F.transform(
        F.slice("_b", F.lit(2), F.size("_b")), lambda b, i: part("curve", i + 1, b))).otherwise(
        F.expr("cast(array() as array<struct<part:string,part_no:int,coo:array<struct<x:double,y:double>>>>)"))
    out = marks.select("specimen", "scale", F.explode(F.concat(F.array(first), rest)).alias("p"))
    return out.select("specimen", "scale", "p.part", "p.part_no", F.posexplode("p.coo").alias("_s", "q")).select(
        "specimen", "scale", "part", "part_no", (F.col("_s") + 1).cast("int").alias("seq"), "q.x", "q.y")


CURVE_LINE = r"^\s*\S*[0-9]{4}\s+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s*$"


def read_curve_points(spark: SparkSession, path: str, id_pattern: str = STEM, bundled: bool = False) -> DataFrame:
    """``locus, specimen, coo`` from lines ``locusNNNN x y``, one file (or record of a bundle) per specimen.

    A line that does not parse raises with its specimen.
    """
    lines = _lines(spark, path, id_pattern, bundled)
    good = F.when(F.col("value").rlike(CURVE_LINE), F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("no curve point in "), F.col("specimen"), F.lit(": "), F.col("value"))))
    rows = lines.select("specimen", _numbers(good).alias("v")).select(
        "specimen", F.expr("substr(v[0], 1, length(v[0]) - 4)").alias("locus"),
        F.expr("cast(right(v[0], 4) as int)").alias("seq"),
        F.expr("cast(v[1] as double)").alias("x"), F.expr("cast(v[2] as double)").alias("y"))
    return by_locus(rows)


def by_locus(points: DataFrame) -> DataFrame:
    """``locus, specimen, coo``: the specimen x locus nesting turned around.

    A row is one curve of one specimen, so a locus shared by every specimen
    stays spread over tasks instead of becoming one list.
    """
    return points.groupBy("locus", "specimen").agg(
        F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("_p")).select(
        "locus", "specimen", F.transform("_p", lambda p: pt(p["x"], p["y"])).alias("coo"))


def read_landmark_points(spark: SparkSession, path: str, id_pattern: str = STEM, bundled: bool = False) -> DataFrame:
    """``specimen, name, x, y`` from lines ``name x y``; a value that is no number (``NA``) is NULL."""
    v = F.col("v")
    return _lines(spark, path, id_pattern, bundled).select("specimen", _numbers(F.col("value")).alias("v")).select(
        "specimen", v[0].alias("name"), F.get(v, F.lit(1)).try_cast("double").alias("x"), F.get(v, F.lit(2)).try_cast("double").alias("y"))


def pc_columns(columns: Sequence[str], max_pcs: int | None = None) -> list[str]:
    """Columns named ``PC<n>`` in numeric order, at most index ``max_pcs``."""
    found = sorted((int(c[2:]), c) for c in columns if re.fullmatch(r"PC[0-9]+", c))
    return [c for i, c in found if max_pcs is None or i <= max_pcs]


def read_scores(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Score columns of a table as doubles; at least two are needed.

    Only the wanted columns are read; nothing is inferred from the data.  A
    value that is no number (``NA``) is NULL.
    """
    df = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    pcs = pc_columns(df.columns)
    if len(pcs) < 2:
        raise ValueError("at least two PC columns are needed")
    keep = ["ID"] if "ID" in df.columns else []
    return df.select(*keep, *[F.col(c).try_cast("double").alias(c) for c in pcs])


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """``ID`` first, then the PCs."""
    w = scores.select("ID", *pc_columns(scores.columns)).write.mode("errorifexists")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


ODD_IN_FOLDERS = re.compile("[\x01-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]")


def id_folder(name: str | None) -> str:
    """The folder that Spark's own writer gives an id."""
    return "id=" + (ODD_IN_FOLDERS.sub(lambda m: f"%{ord(m[0]):02X}", name) if name else "__HIVE_DEFAULT_PARTITION__")


def _put_files(rows: Iterable, folder: str) -> None:
    """One file for each id of the rows (id, value), which are sorted by id; another attempt of a task replaces its files."""
    task = TaskContext.get()
    file = f"part-{task.partitionId():05d}.txt"
    for name, own in groupby(rows, lambda r: id_folder(r["id"])):
        home = os.path.join(folder, name)
        os.makedirs(home, exist_ok=True)
        draft = os.path.join(home, f".{file}-{task.taskAttemptId()}")
        with open(draft, "wb") as out:
            out.writelines((r["value"] or "").encode() + b"\n" for r in own)
        os.replace(draft, os.path.join(home, file))


def write_outlines(outlines: DataFrame, path: str) -> None:
    """One text file per outline under ``id=<id>/``: lines ``x y`` in order.  Many outlines go into bundles instead.

    In a folder of the file system that all machines mount the tasks write the files themselves: Hadoop's local files cost a ``chmod``
    process each. Any other store takes Spark's writer.
    """
    records = outline_records(outlines)
    context = outlines.sparkSession.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(context._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        records.write.partitionBy("id").text(path)
        return
    folder = target.toUri().getPath()
    os.makedirs(folder)
    named = records.withColumn("id", F.col("id").cast("string"))
    named.sortWithinPartitions("id").foreachPartition(lambda rows: _put_files(rows, folder))
    open(os.path.join(folder, "_SUCCESS"), "wb").close()


def write_tps(outlines: DataFrame, path: str) -> None:
    """Landmarks from ``ldk`` and the outline as one curve."""
    def line(p):
        return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    marks = F.transform("ldk", lambda i: line(F.element_at("coo", i)))
    text = F.concat_ws("\n", F.concat(F.lit("LM="), F.size("ldk").cast("string")), F.array_join(marks, "\n"),
                       F.lit("CURVES=1"), F.concat(F.lit("POINTS="), F.size("coo").cast("string")),
                       F.array_join(F.transform("coo", line), "\n"),
                       F.concat(F.lit("IMAGE=s"), F.col("id").cast("string"), F.lit(".jpg")), F.lit("SCALE=0.5"))
    outlines.select(text.alias("value")).write.text(path)


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = ("jpg", "jpeg"),
               recursive: bool = True, case_sensitive: bool = False) -> DataFrame:
    """``path`` of matching files; contents are not read (column pruning)."""
    # a listing task for every folder (up to 10,000 by default) takes longer to start than to run
    most = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(most)
    spark.conf.set(most, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select("path")
    finally:
        spark.conf.set(most, before)
    pat = r"\.(" + "|".join(re.escape(e) for e in extensions) + ")$"
    return df.filter(F.col("path").rlike(pat if case_sensitive else "(?i)" + pat))


def name_structure(df: DataFrame, name: str, names: Sequence[str], split: str = "_") -> DataFrame:
    """Split a name into factor columns.

    Raises when a row has another number of parts.  ``odd_names`` finds them.
    """
    parts = F.split(F.col(name), re.escape(split))
    ok = F.size("_p") == len(names)
    return df.withColumn("_p", parts).select("*", *[
        F.when(ok, F.element_at("_p", i + 1)).otherwise(F.raise_error(F.concat(
            F.lit("not the same name structure: "), F.col(name)))).alias(n)
        for i, n in enumerate(names)]).drop("_p")


def odd_names(df: DataFrame, name: str, split: str = "_") -> DataFrame:
    """Names whose number of parts is not the most common one."""
    sized = df.withColumn("n_parts", F.size(F.split(F.col(name), re.escape(split))))
    modal = sized.groupBy("n_parts").count().agg(
        F.max_by("n_parts", F.struct("count", -F.col("n_parts"))).alias("m")).scalar()
    return sized.filter(F.col("n_parts") != modal)
