"""Versions of a table behind one pointer, checked in the pass that writes them.

<root>/rows/<id> holds the rows of one version, <root>/manifest one row per published version.  A version exists for readers once
its manifest row does: that is a single new file with one row, so a writer that stops anywhere before it changes nothing and one
that stops after it has published.  Nothing is renamed or overwritten.  One writer at a time is assumed.

Rows are dealt by entity and block of BLOCK index numbers and sorted by key: files of a version keep an entity's rows together,
an entity of any length is spread over tasks, and rows of equal key meet, so that repeated ones are counted without another
shuffle.  All checks are metrics observed on the rows as they are written, in the write's last stage, where every partition counts
once however often its task ran.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import finite
from ..operators.contracts import ContractError, column_faults

BLOCK = 4_096
MANIFEST = "number long, id string, n_rows long, columns string, metrics string, published_at timestamp"


def laid_out(df: DataFrame, key: list[str]) -> DataFrame:
    """df by blocks of its last key column, sorted by key, with _copies, the number of rows of the same key."""
    *entity, index = key
    rows = df.withColumn("_block", F.floor(F.col(index) / BLOCK)).repartition(*entity, "_block")
    return rows.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy(*entity, "_block", index))).drop("_block")


def metrics(key: list[str], finite_columns: list[str], rules: dict[str, Column]) -> dict[str, Column]:
    """Counts of rows that break a contract, by name; n_rows counts all."""
    bad = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(True)).cast("long")), F.lit(0))
    out = {"n_rows": F.count(F.lit(1)), "repeated key": bad(F.col("_copies") > 1)}
    out |= {f"null {c}": bad(F.col(c).isNull()) for c in key} | {f"not finite {c}": bad(~finite(c)) for c in finite_columns}
    return out | {f"breaks {name}": bad(~rule) for name, rule in rules.items()}


def write_checked(df: DataFrame, write, key: list[str] = catalog.KEY, finite_columns: list[str] = (), rules: dict[str, Column] | None = None) -> dict[str, int]:
    """Lays df out, hands it to write(rows) and returns the metrics of what was written; df is worked out once."""
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    counts = metrics(key, list(finite_columns), rules or {})
    write(laid_out(df, key).observe(seen, *(c.alias(name) for name, c in counts.items())).drop("_copies"))
    return seen.get


def faults_of(counts: dict[str, int]) -> list[str]:
    found = [f"{name}: {n} rows" for name, n in sorted(counts.items()) if name != "n_rows" and n]
    return found if counts["n_rows"] else ["no rows", *found]


def place_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def history(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of all versions; none before the first is published."""
    files, place = place_of(spark, f"{root}/manifest")
    return spark.read.schema(MANIFEST).json(f"{root}/manifest") if files.exists(place) else spark.createDataFrame([], MANIFEST)


def published(spark: SparkSession, root: str, number: int | None = None):
    """The manifest row of a version, of the newest one by default; None where there is none."""
    rows = history(spark, root)
    rows = rows if number is None else rows.where(F.col("number") == number)
    return rows.orderBy(F.desc("number"), F.desc("id")).limit(1).first()


def publish(df: DataFrame, root: str, key: list[str] = catalog.KEY, finite_columns: list[str] = (), rules: dict[str, Column] | None = None, required: list[str] = (), forbidden: list[str] = ()) -> int:
    """Writes df as the next version and returns its number.

    Refused, with nothing changed for readers, are missing or forbidden columns, no rows, null or repeated keys, values of
    finite_columns that aren't finite, and rows for which one of rules isn't true.  Rows of a refused version stay unlisted
    until expire() removes them."""
    spark = df.sparkSession
    if faults := column_faults(df.columns, [*key, *required], forbidden):
        raise ContractError("; ".join(faults))
    own = uuid.uuid4().hex
    counts = write_checked(df, lambda rows: rows.write.parquet(f"{root}/rows/{own}"), key, finite_columns, rules)
    if faults := faults_of(counts):
        raise ContractError("; ".join(faults))
    before = published(spark, root)
    number = before["number"] + 1 if before else 1
    row = spark.createDataFrame([(number, own, counts["n_rows"], df.schema.json(), json.dumps(counts))], "number long, id string, n_rows long, columns string, metrics string")
    row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return number


def current(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """Rows of a version, of the newest one by default.  A reader that began keeps its version whatever is published meanwhile."""
    from pyspark.sql.types import StructType

    row = published(spark, root, number)
    if row is None:
        raise ContractError(f"no version {'' if number is None else number} of {root}")
    return spark.read.schema(StructType.fromJson(json.loads(row["columns"]))).parquet(f"{root}/rows/{row['id']}")


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes rows of all but the newest versions and of refused ones; returns how many folders went.  Manifest rows stay as history."""
    if keep < 1:
        raise ValueError("at least one version has to stay")
    stay = {r["id"] for r in history(spark, root).orderBy(F.desc("number"), F.desc("id")).limit(keep).collect()}
    files, place = place_of(spark, f"{root}/rows")
    old = [x.getPath() for x in files.listStatus(place) if x.getPath().getName() not in stay]
    for path in old:
        files.delete(path, True)
    return len(old)
