"""Raw snapshot files: <root>/<split>/Bearing<c>_<u>/acc_<n>.csv and temp_<n>.csv without header, comma or semicolon.

Whole small files are read, so the order of samples is known, and lines are split inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog


def canonical_split(name: Column) -> Column:
    out = name
    for old, new in catalog.SPLITS.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def file_number(path: Column) -> Column:
    """The number before .csv; a name without one fails the job."""
    found = F.regexp_extract(path, r"_(\d+)\.csv$", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no file index in "), path))).cast("int")


def located(path: Column) -> dict[str, Column]:
    """split, bearing, condition and kind of a path; another directory name than Bearing<c>_<u> fails the job."""
    part = lambda p, g=1: F.regexp_extract(path, p, g)
    bearing, condition = part(r"/([^/]+)/[^/]+$"), part(r"/Bearing(\d+)_\d+/[^/]+$")
    return {
        "split": canonical_split(part(r"/([^/]+)/[^/]+/[^/]+$")), "bearing": bearing,
        "condition": F.when(condition != "", condition).otherwise(F.raise_error(F.concat(F.lit("not a bearing directory: "), bearing))).cast("int"),
        "kind": F.when(path.rlike(r"/acc_\d+\.csv$"), "acc").when(path.rlike(r"/temp_\d+\.csv$"), "temp").otherwise("other"),
    }


def listing(spark: SparkSession, root: str) -> DataFrame:
    """split, bearing, condition, kind, file_index and path of all files two directories below root, without reading them."""
    paths = spark.read.format("binaryFile").load(f"{root}/*/*/*").select("path", "length")
    rows = paths.withColumns(located(F.col("path")))
    return rows.withColumn("file_index", F.when(F.col("kind") != "other", file_number(F.col("path"))))


def files_of(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Files of one kind in index order."""
    if kind not in ("acc", "temp"):
        raise ValueError(f"unknown kind: {kind}")
    return listing(spark, root).where(F.col("kind") == kind).orderBy("split", "bearing", "file_index")


def bearings(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """Distinct (split, bearing, condition); an empty or missing split is an error."""
    rows = listing(spark, root).select("split", "bearing", "condition").distinct()
    rows = rows.where(F.col("split") == split) if split else rows
    if rows.isEmpty():
        raise ValueError(f"no bearings under {root}")
    return rows


def lines_of(spark: SparkSession, root: str, kind: str, split: str = "*", bearing: str = "*") -> DataFrame:
    """split, bearing, condition, kind, file_index, position and line of every non-blank line; the path pattern prunes."""
    raw = spark.read.text(f"{root}/{split}/{bearing}/{kind}_*.csv", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = raw.withColumns(located(F.col("path"))).withColumn("file_index", file_number(F.col("path")))
    rows = rows.select("split", "bearing", "condition", "kind", "file_index", F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
    return rows.where(F.trim("line") != "")


def parsed(lines: DataFrame, schema, lenient: bool = False) -> DataFrame:
    """Typed columns of lines; values that can't be parsed fail the job, or are null if lenient."""
    parts = lines.withColumn("_p", F.split(F.translate("line", ";", ","), ","))
    value = lambda i: F.trim(F.get("_p", F.lit(i)))
    typed = lambda i, t: value(i).try_cast(t) if lenient else (value(i).cast("double").cast(t) if t.simpleString() == "int" else value(i).cast(t))
    return parts.select("split", "bearing", "condition", "file_index", "position", *(typed(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def vibration(spark: SparkSession, root: str, split: str = "*", bearing: str = "*", lenient: bool = False) -> DataFrame:
    """All vibration samples with their file and position."""
    return parsed(lines_of(spark, root, "acc", split, bearing), catalog.ACC_SCHEMA, lenient)


def temperature(spark: SparkSession, root: str, split: str = "*", bearing: str = "*", lenient: bool = False) -> DataFrame:
    """All temperature samples; without any such file an empty table of the same columns."""
    try:
        return parsed(lines_of(spark, root, "temp", split, bearing), catalog.TEMP_SCHEMA, lenient)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        own = "split string, bearing string, condition int, file_index int, position int"
        return spark.createDataFrame([], own + ", " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in catalog.TEMP_SCHEMA.fields))


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", F.sha2("content", 256).alias("sha256"))


def inventory(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Per split and bearing: files by kind, missing numbers, hours, and rows of the first vibration file."""
    count = lambda k: F.sum((F.col("kind") == k).cast("long"))
    last = F.max(F.when(F.col("kind") == "acc", F.col("file_index")))
    own = files.groupBy("split", "bearing").agg(count("acc").alias("n_acc"), count("temp").alias("n_temp"), last.alias("last_file"), (last * catalog.INTERVAL_SECONDS / 3600).alias("hours"))
    first = lines.where("kind = 'acc' AND file_index = 1").groupBy("split", "bearing").agg(F.count(F.lit(1)).alias("first_rows"), F.max(F.when(F.col("line").contains(";"), ";").otherwise(",")).alias("delimiter"))
    return own.withColumn("n_missing", F.col("last_file") - F.col("n_acc")).join(first, ["split", "bearing"], "left")
