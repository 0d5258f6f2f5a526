"""Contract jobs: each returns violations, and assert_* stop on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import catalog
from ..functions.expressions import finite


class ContractError(ValueError):
    pass


def assert_empty(violations: DataFrame, what: str) -> None:
    if rows := violations.limit(5).collect():
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def repeated_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(frame: DataFrame, keys: list[str], name: str) -> None:
    assert_empty(repeated_keys(frame, keys), f"{name} has repeated keys")


def not_finite(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column and n_bad, the values that are null, NaN or infinite; one pass."""
    sums = frame.agg(*(F.sum((~finite(c)).cast("long")).alias(c) for c in columns))
    return sums.unpivot([], columns, "column", "n_bad").select("column", F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def assert_finite(frame: DataFrame, columns: list[str], name: str) -> None:
    assert_empty(not_finite(frame, columns).where("n_bad > 0"), f"{name} has values that aren't finite")


def column_faults(columns: list[str], required: list[str], forbidden: list[str] = (), predictors: list[str] = ()) -> list[str]:
    """Faults of a schema: missing, forbidden and leaking columns."""
    has = set(columns)
    return [*(f"missing {c}" for c in required if c not in has), *(f"forbidden {c}" for c in forbidden if c in has), *(f"leaks {c}" for c in predictors if c in catalog.NEVER_PREDICTORS)]


def split_purity(frame: DataFrame, expected: str) -> DataFrame:
    return frame.where(~F.col("split").eqNullSafe(F.lit(expected))).groupBy("split").count()


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side only, with side."""
    one = left.select(*keys).join(right, keys, "left_anti").withColumn("side", F.lit("left"))
    return one.unionByName(right.select(*keys).join(left, keys, "left_anti").withColumn("side", F.lit("right"))).distinct()


def shared_entities(left: DataFrame, right: DataFrame, entity: str = "bearing") -> DataFrame:
    """Entities that occur on both sides; empty for disjoint splits."""
    return left.select(entity).intersect(right.select(entity))


def unfinished_runs(frame: DataFrame) -> DataFrame:
    """Training entities whose target doesn't end at 0."""
    return frame.groupBy("bearing").agg(F.min("rul_seconds").alias("least_rul")).where(~F.col("least_rul").eqNullSafe(F.lit(0.0)))


def not_positive_truth(frame: DataFrame) -> DataFrame:
    return frame.where(~F.coalesce(F.col("rul_seconds") > 0, F.lit(False)))


def cut_grid_faults(samples: DataFrame, fractions) -> DataFrame:
    """Entities whose rounded cut fractions aren't the grid, with their number of rows."""
    grid = F.array_sort(F.array(*(F.lit(round(float(f), 8)) for f in fractions)))
    rows = samples.groupBy("bearing").agg(F.array_sort(F.collect_set(F.round("cut_fraction", 8))).alias("cuts"), F.count(F.lit(1)).alias("n_rows"))
    return rows.where((F.col("cuts") != grid) | (F.col("n_rows") != len(set(fractions))))


def assert_grid(samples: DataFrame, fractions, entities: int | None = None, rows: int | None = None) -> None:
    """Samples of an experiment: key columns, cut grid, number of entities and of rows."""
    if faults := column_faults(samples.columns, ["condition", "bearing", "cut_fraction", "cut_file_index", "observed_age_seconds", "rul_seconds"]):
        raise ContractError("; ".join(faults))
    assert_unique(samples, ["bearing", "cut_file_index"], "samples")
    assert_empty(cut_grid_faults(samples, fractions), "cut grid")
    found = samples.agg(F.countDistinct("bearing").alias("entities"), F.count(F.lit(1)).alias("rows")).first()
    for name, want in (("entities", entities), ("rows", rows)):
        if want is not None and found[name] != want:
            raise ContractError(f"expected {want} {name}, found {found[name]}")


def verify_samples(samples: DataFrame, predictors: list[str], fractions) -> None:
    """Prefix and health samples: columns, leakage, keys, grid and finite values."""
    if faults := column_faults(samples.columns, [*predictors, "bearing", "cut_fraction", "cut_file_index", "rul_seconds"], (), predictors):
        raise ContractError("; ".join(faults))
    assert_unique(samples, ["bearing", "cut_file_index"], "samples")
    assert_empty(cut_grid_faults(samples, fractions), "cut grid")
    assert_finite(samples, [*predictors, "rul_seconds"], "samples")


def schema_roles(schema: dict, group: str = "bearing") -> list[tuple[str, str]]:
    """(column, role) pairs of a schema dictionary; a column may have several roles."""
    named = {"predictor": schema.get("default_model_feature_columns") or [], "target": [schema.get("target_column", catalog.TARGET)], "group": [group], "blocked": schema.get("blocked_predictor_columns") or []}
    return [(column, role) for role, columns in named.items() for column in columns]


def training_faults(frame: DataFrame, schema: dict, group: str = "bearing") -> DataFrame:
    """check, column and n_bad of a training table against its schema; values are looked at in one pass over the rows.

    A predictor that is blocked or the target leaks; values have to be finite, groups not null and at least two."""
    roles = schema_roles(schema, group)
    of = lambda *names: {c for c, role in roles if role in names}
    known, use = {*frame.columns}, of("predictor", "target", "group")
    named = [("no predictors", group, 1)] * (not of("predictor")) + [("leak", c, 1) for c in of("predictor") & of("blocked", "target")] + [("missing", c, 1) for c in use - known]
    bad = {("value", c): F.sum((~finite(c)).cast("long")) for c in of("predictor", "target") & known}
    if group in known:
        bad |= {("null group", group): F.sum(F.col(group).isNull().cast("long")), ("one group", group): (F.min(group).eqNullSafe(F.max(group))).cast("long")}
    found = frame.agg(F.array(*(F.struct(F.lit(check).alias("check"), F.lit(c).alias("column"), F.coalesce(n, F.lit(0)).alias("n_bad")) for (check, c), n in sorted(bad.items(), key=lambda x: x[0]))).alias("faults"))
    fixed = frame.sparkSession.createDataFrame(sorted(named), "check string, column string, n_bad bigint")
    return fixed.unionByName(found.select(F.inline("faults"))).where("n_bad > 0") if bad else fixed


def training_contract(frame: DataFrame, schema: dict, group: str = "bearing") -> dict[str, list[str]]:
    """Columns by role of a training table without faults."""
    assert_empty(training_faults(frame, schema, group), "training table")
    roles = schema_roles(schema, group)
    return {role: [c for c, r in roles if r == role] for role in ("predictor", "target", "group")}


def metric_input_faults(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """n_rows and n_bad of metric inputs."""
    return predictions.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((~finite(actual) | ~finite(predicted)).cast("long")), F.lit(0)).alias("n_bad"))


def request_faults(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds fault: null for a row that may be logged.  Status must be ok or error, and ok rows need every feature."""
    missing = reduce(lambda a, b: a | b, (~finite(c) for c in columns or catalog.prefix_columns()))
    known = F.coalesce(F.col("status").isin("ok", "error"), F.lit(False))
    return log.withColumn("fault", F.when(~known, "unknown status").when((F.col("status") == "ok") & missing, "missing features"))


def numeric_predictors(frame: DataFrame, blocked: list[str] = catalog.BLOCKED) -> list[str]:
    """Sorted numeric columns that aren't blocked."""
    return sorted(f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in blocked)


def complete_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and NaN values become null, rows with a null among columns go."""
    return frame.withColumns({c: F.when(finite(c), F.col(c)) for c in columns}).dropna(subset=columns)


def select_split(frame: DataFrame, value: str, split: str = "split") -> DataFrame:
    rows = frame.where(F.col(split) == value)
    if rows.isEmpty():
        raise ContractError(f"split {value} is empty")
    return rows


# Raw files.

def file_shapes(lines: DataFrame) -> DataFrame:
    """Per file: rows, least and most fields of its non-blank lines, delimiter of the first; lines come from the scan of raw text."""
    filled = lines.where(F.trim("line") != "")
    width = F.size(F.split(F.translate("line", ";", ","), ","))
    return filled.groupBy("split", "bearing", "kind", "file_index").agg(F.count(F.lit(1)).alias("n_rows"), F.min(width).alias("least_fields"), F.max(width).alias("most_fields"), F.when(F.min_by("line", "position").contains(";"), ";").otherwise(",").alias("delimiter"))


def shape_faults(shapes: DataFrame) -> DataFrame:
    """Files with another shape than the recordings should have, and severity: short temperature files only warn."""
    rows, fields = F.when(F.col("kind") == "acc", catalog.SAMPLES_PER_FILE).otherwise(catalog.TEMPERATURE_ROWS), F.when(F.col("kind") == "acc", 6).otherwise(5)
    bad = shapes.where((F.col("n_rows") != rows) | (F.col("least_fields") != fields) | (F.col("most_fields") != fields))
    return bad.withColumn("severity", F.when(F.col("kind") == "acc", "CRITICAL").otherwise("WARNING"))


def gaps(files: DataFrame, keys: list[str], number: str = "file_index") -> DataFrame:
    """Numbers missing from 1 to the largest, per key; sequences of neighbours, no list of all numbers."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag(number).over(Window.partitionBy(*keys).orderBy(number)), F.lit(0))
    rows = files.select(*keys, F.col(number).cast("long").alias(number)).distinct().withColumn("_before", before).where(F.col(number) - F.col("_before") > 1)
    return rows.select(*keys, F.explode(F.sequence(F.col("_before") + 1, F.col(number) - 1)).alias("missing"))


def directory_faults(files: DataFrame, strict_temperature: bool = False) -> DataFrame:
    """split, bearing, problem and severity: unknown conditions, no vibration files, gaps, stray files."""
    keys = ["split", "bearing"]
    known = files.where(F.col("kind").isin("acc", "temp"))
    of = lambda rows, problem, severity: rows.select(*keys, F.lit(problem).alias("problem"), severity.alias("severity")).distinct()
    critical, warn = F.lit("CRITICAL"), F.lit("CRITICAL" if strict_temperature else "WARNING")
    none = files.groupBy(*keys).agg(F.sum((F.col("kind") == "acc").cast("long")).alias("n")).where("n = 0")
    condition = F.regexp_extract("bearing", r"Bearing(\d+)_", 1).try_cast("int")
    holes = gaps(known, [*keys, "kind"])
    return reduce(lambda a, b: a.unionByName(b), [
        of(files.where(~F.coalesce(condition.isin(*catalog.CONDITIONS), F.lit(False))), "unknown condition", critical), of(none, "no vibration files", critical),
        of(holes.where("kind = 'acc'"), "gap in vibration files", critical), of(holes.where("kind = 'temp'"), "gap in temperature files", warn),
        of(files.where(~F.coalesce(F.col("kind").isin("acc", "temp"), F.lit(False))), "stray file", F.lit("WARNING")),
    ])


def delimiter_summary(shapes: DataFrame) -> DataFrame:
    return shapes.groupBy("split", "bearing", "kind", "delimiter").agg(F.count(F.lit(1)).alias("n_files"))


def prefix_differences(test: DataFrame, validation: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6, entity: str = "bearing") -> DataFrame:
    """Per entity of the truncated side: compared rows, rows without partner, and rows that differ by more than the tolerance."""
    other = validation.select(*keys, *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    apart = reduce(F.greatest, [F.abs(F.col(v) - F.col(f"_{v}")) for v in values]) if len(values) > 1 else F.abs(F.col(values[0]) - F.col(f"_{values[0]}"))
    rows = test.select(*keys, *values).join(other, keys, "left").withColumn("_apart", apart)
    return rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("_there").isNull().cast("long")).alias("n_missing"), F.sum(F.coalesce(F.col("_apart") > tolerance, F.lit(False)).cast("long")).alias("n_different"), F.max("_apart").alias("largest"))
