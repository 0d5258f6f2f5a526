"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at once inside a task, in bytes; bounds a worker's memory however long the texts are.
SLICE_BYTES = 8 << 20
#: Rows of a key from which a join deals it over pieces, and the most such keys and pieces of a key.
HOT_ROWS, HOT_KEYS, HOT_PIECES = 4096, 1024, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a folder of this machine is set if the master is local; a cluster has to set its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it back, so a lost executor costs a re-read only."""
    return stored(df, purpose, **options)[0]


def stored(df: DataFrame, purpose: str, **options: str) -> tuple[DataFrame, str]:
    """written(), and the folder, for discarded()."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() made, once nothing that is still to be computed reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns called c0, c1, ..., so that helper columns of other names can't meet them, and the new name of each."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), {c: f"c{i}" for i, c in enumerate(df.columns)}


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, rows: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """left.join(right, keys, how) for a right side with one row per key and weight, about the number of rows of left with that key.

    Keys that more than about so many rows share are dealt over pieces: at most HOT_KEYS of them, those of most weight,
    are broadcast with their number of pieces, rows of left go to a piece by their hash, and the row of right to all
    pieces of its key.  The plan is the same at every size."""
    often = right.where(F.col(weight) > rows).orderBy(F.desc(weight)).limit(HOT_KEYS)
    often = F.broadcast(often.select(*keys, F.least(F.lit(HOT_PIECES), F.ceil(F.col(weight) / rows)).cast("int").alias("_pieces")))
    one = left.join(often, keys, "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_pieces").cast("long")), F.lit(0)).cast("int")).drop("_pieces")
    two = right.join(often, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))).drop("_pieces")
    return one.join(two.hint("merge"), [*keys, "_piece"], how).drop("_piece")


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text column of each piece holds about limit bytes; a longer single text stays whole."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        mean = max(1, column.nbytes // max(1, len(column)))
        step = max(1, limit // mean)
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def emit(batch: pa.RecordBatch, keep: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    """The kept columns of batch and the new ones."""
    columns = {k: batch.column(batch.schema.get_field_index(k)) for k in keep} | more
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def schema_of(df: DataFrame, keep: list[str], more: str) -> str:
    """DDL of the kept columns followed by more."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), more])
