"""Labels and the datasets built from snapshots: training rows, label-free test rows, and ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..sources.scratch import kept
from . import blocks, signal
from .contracts import assert_empty, assert_unique
from .trajectory import last_rows, with_identity, with_rul, with_temporal


def union(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns in any order; an empty list is an error."""
    if not frames:
        raise ValueError("nothing to combine")
    return reduce(lambda a, b: a.unionByName(b), frames)


def last_files(frame: DataFrame) -> DataFrame:
    return frame.groupBy("bearing").agg(F.max("file_index").alias("last_file"))


def with_truncated_rul(test: DataFrame, validation: DataFrame) -> DataFrame:
    """Labels truncated runs by the last file of the complete run of the same name; one without it fails the job."""
    rows = test.join(last_files(validation), "bearing", "left")
    rul = F.when(F.col("last_file").isNull(), F.raise_error(F.concat(F.lit("no complete run for "), "bearing")).cast("double")).otherwise(((F.col("last_file") - F.col("file_index")) * catalog.INTERVAL_SECONDS).cast("double"))
    return rows.withColumn("rul_seconds", rul).drop("last_file")


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; a repeated key on either side is an error."""
    assert_unique(left, keys, "left")
    assert_unique(right, keys, "right")
    return left.join(right, keys)


def training_dataset(features: DataFrame, digits: int | None = None) -> DataFrame:
    """Snapshot features with identity, rolling columns and the target of complete runs."""
    return with_rul(with_temporal(with_identity(features), last=True, digits=digits)).select(*catalog.METADATA, *catalog.signal_columns(), *catalog.temporal_columns(), catalog.TARGET)


def test_feature_dataset(features: DataFrame, digits: int | None = None) -> DataFrame:
    """The same without a target; it asks for no complete runs."""
    return with_temporal(with_identity(features), digits=digits).select(*catalog.METADATA, *catalog.signal_columns(), *catalog.temporal_columns())


def ground_truth(test: DataFrame, validation: DataFrame) -> DataFrame:
    """condition, bearing, file_index and rul_seconds of truncated runs."""
    return with_truncated_rul(test.select(*catalog.TRUTH_KEY), validation).select(*catalog.TRUTH_KEY, "rul_seconds")


def endpoint_truth(truth: DataFrame) -> DataFrame:
    """The last labelled file of each entity."""
    return last_rows(truth).select("condition", "bearing", F.col("file_index").alias("cut_file_index"), "rul_seconds")


def align(features: DataFrame, truth: DataFrame) -> DataFrame:
    """Endpoint features with their truth; every row of either side must meet exactly one of the other.

    Both sides, a row per entity, are written first: four checks and the join look at them."""
    keys = ["condition", "bearing", "cut_file_index"]
    features, truth = kept(features, "features"), kept(truth.select(*keys, "rul_seconds"), "truth")
    out = joined_one_to_one(features, truth, keys)
    assert_empty(features.join(truth, keys, "left_anti"), "features without truth")
    assert_empty(truth.join(features, keys, "left_anti"), "truth without features")
    return out


def labelled_split(features: DataFrame, complete: DataFrame | None = None) -> DataFrame:
    """Opt-in labelled form of any split: truncated runs take the target from their complete runs."""
    rows = with_temporal(with_identity(features), last=complete is None)
    return with_rul(rows) if complete is None else with_truncated_rul(rows, complete)


def full_labelled(training: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """All splits labelled in one table.  Not for model selection: test rows carry their targets."""
    return union([labelled_split(training), labelled_split(validation), labelled_split(test, validation)])


def run_table(samples: DataFrame, channels: dict[str, str], step: int = 1, rate_hz: float = catalog.SAMPLING_HZ, edges: list[float] | None = None, position: str = "position") -> DataFrame:
    """Every step-th snapshot of each entity with elapsed and remaining time by the number of snapshots, and the extended time and
    spectrum columns of each channel (its name to the column of samples).  Missing samples are left out.

    A snapshot is a bounded recording; snapshots are counted before any is left out, and only kept ones are transformed."""
    keys = ["bearing", "file_index"]
    edges = edges or catalog.EXTENDED_EDGES
    known = samples.select(*keys).distinct()
    rows = blocks.positioned(known)
    kept = rows.where((F.col("position") - 1) % step == 0).select(*keys, F.col("_n").alias("n_snapshots"))
    mine = samples.join(kept, keys)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), *(F.col(c).cast("double").alias(s) for s, c in channels.items()))))
    found = mine.groupBy(*keys).agg(F.max("n_snapshots").alias("n_snapshots"), *signal.extended_stats(channels), ordered.alias("_rows"))
    stats = signal.spectrum(rate_hz, edges)
    found = found.withColumns({f"_{s}": stats(F.filter(F.transform("_rows", lambda r: r[s]), lambda v: v.isNotNull() & ~F.isnan(v))) for s in channels})  # noqa: B023
    made = {f"{s}_{name}": F.col(f"_{s}.{name}") for s in channels for name in ("dominant_frequency", "spectral_centroid", "total_energy")}
    made |= {f"{s}_{kind}_{i}": F.get(f"_{s}.{whole}", F.lit(i)) for s in channels for kind, whole in (("energy", "bands"), ("ratio", "ratios")) for i in range(len(edges) - 1)}
    time = {"elapsed_seconds": (F.col("file_index") - 1) * catalog.INTERVAL_SECONDS, "rul_seconds": (F.col("n_snapshots") - F.col("file_index")) * catalog.INTERVAL_SECONDS}
    time |= {name.replace("seconds", "hours"): c / 3600 for name, c in time.items()}
    return found.withColumns(time | made).drop("_rows", "n_snapshots", *(f"_{s}" for s in channels))
