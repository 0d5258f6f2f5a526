"""Registered queries over the test tables, each with its SQL where SQL can express it.  Doubles are rounded to 6 places."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import stable
from ..operators import contracts, datasets, digests, eda, evaluate, experiments, forests, models, monitor, prefix, signal, trajectory, windows
from ..sources import versions
from ..sources.scratch import folder as shared
from ..sources.scratch import kept
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TRAJ = a.sql_trajectories()
FRACTIONS = (0.4, 0.55, 0.7, 0.85)
HEALTHY = RECENT = 20
DIGITS = 6
FEATURES = ["observed_age_seconds", "rms_horiz_current_over_early", "kurtosis_vert_recent_mean_over_early", "crest_factor_horiz_recent_slope_per_hour"]


def rounded(df: DataFrame, done: bool = False) -> DataFrame:
    return df.select(*(stable(f"`{n}`").alias(n) if t in ("double", "float") and not done else F.col(f"`{n}`").cast("long").alias(n) if t == "int" else F.col(f"`{n}`") for n, t in df.dtypes))


def query(sql: str | None = None, done: bool = False):
    """Registers a function under its name; the result is rounded unless the function has done it, counts are long."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), done)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(x: str, name: str = "") -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


# Trajectories and samples.

def sql_prefix(endpoint: bool, r=r) -> str:
    parts = []
    for s in catalog.SOURCES:
        early = f"greatest(abs(quantile_cont({s}, 0.5) FILTER (file_index <= 60)), 1e-8)"
        near = "FILTER (file_index > cut - 60)"
        parts += [r(f"max({s}) FILTER (file_index = cut) / {early}", f"{s}_current_over_early"), r(f"avg({s}) {near} / {early}", f"{s}_recent_mean_over_early"), r(f"CASE WHEN least(cut, 60) < 2 THEN 0 ELSE regr_slope({s}, file_index * 10 / 3600.0E0) {near} END", f"{s}_recent_slope_per_hour")]
    cuts = "SELECT bearing, n AS cut, CAST(NULL AS DOUBLE) AS cut_fraction FROM traj GROUP BY ALL" if endpoint else f"SELECT bearing, cut, min(cut_fraction) AS cut_fraction FROM (SELECT DISTINCT bearing, greatest(1, least(n - 2, CAST(round_even((n - 1) * f, 0) AS BIGINT))) + 1 AS cut, f AS cut_fraction FROM traj, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in FRACTIONS)}]) AS f)) GROUP BY ALL"
    more = "" if endpoint else f", cut_fraction, {r('max(rul_seconds) FILTER (file_index = cut)', 'rul_seconds')}, {r('cut * 10 + max(rul_seconds) FILTER (file_index = cut)', 'total_life_seconds')}"
    return f"""WITH {TRAJ}, cuts AS ({cuts})
    SELECT {big('condition', 'condition')}, bearing, {big('cut', 'cut_file_index')}, cut * 10.0E0 AS observed_age_seconds, {a.SQL_CONTEXT}, {', '.join(parts)}{more}
    FROM traj JOIN cuts USING (bearing) WHERE file_index <= cut GROUP BY condition, bearing, cut, cut_fraction"""


def plain(x: str, name: str = "") -> str:
    """r() without rounding."""
    return f"CAST({x} AS DOUBLE)" + (f" AS {name}" if name else "")


@query(sql_prefix(True))
def prefix_endpoints(spark, sf_dir):
    return prefix.prefix_endpoints(a.trajectories(spark, sf_dir))


@query(sql_prefix(False))
def prefix_samples(spark, sf_dir):
    return prefix.prefix_samples(a.labelled(spark, sf_dir), FRACTIONS)


def sql_health() -> str:
    sig = catalog.HEALTH_SIGNALS
    totals = ", ".join(f"{' + '.join(catalog.band_columns(c))} AS fft_total_{c}" for c in catalog.CHANNELS)
    base = ", ".join(f"quantile_cont({s}, 0.5) FILTER (file_index <= {HEALTHY}) AS m_{s}, stddev_pop({s}) FILTER (file_index <= {HEALTHY}) AS d_{s}" for s in sig)
    mad = ", ".join(f"quantile_cont(abs({s} - m_{s}), 0.5) FILTER (file_index <= {HEALTHY}) AS a_{s}" for s in sig)
    z = ", ".join(f"least(abs({s} - m_{s}) / greatest(1.4826 * a_{s}, 0.10 * d_{s}, 0.01 * abs(m_{s}), 1e-8), 50.0) AS z_{s}" for s in sig)
    logs = ", ".join(f"ln(1 + z_{s})" for s in sig)
    near, past = f"(PARTITION BY bearing ORDER BY file_index ROWS BETWEEN {RECENT - 1} PRECEDING AND CURRENT ROW)", "(PARTITION BY bearing ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    h = "file_index * 10 / 3600.0E0"
    win = f"avg(hi) OVER {near} AS hi_recent_mean, stddev_pop(hi) OVER {near} AS hi_recent_std, max(hi) OVER {near} AS hi_recent_max, regr_slope(hi, {h}) OVER {near} AS hi_recent_slope_per_hour, avg(hi) OVER {past} AS hi_full_mean, max(hi) OVER {past} AS hi_full_max, regr_slope(hi, {h}) OVER {past} AS hi_full_slope_per_hour"
    zs = ", ".join(f"avg(z_{s}) OVER {near} AS y_{s}" for s in sig)
    fr = ", ".join(f"{x}::DOUBLE" for x in FRACTIONS)
    out = ", ".join(r(c, c) for c in catalog.health_columns() if c.startswith("hi_") and c != "hi_current")
    return f"""WITH {TRAJ}, t AS (SELECT *, {totals} FROM traj), b AS (SELECT bearing, {base} FROM t GROUP BY bearing), tb AS (SELECT * FROM t JOIN b USING (bearing)),
    c AS (SELECT bearing, {mad} FROM tb GROUP BY bearing), zz AS (SELECT *, {z} FROM tb JOIN c USING (bearing)), hh AS (SELECT *, list_median([{logs}]) AS hi FROM zz), w AS (SELECT *, {win}, {zs} FROM hh),
    cuts AS (SELECT bearing, cut, min(f) AS cut_fraction FROM (SELECT DISTINCT bearing, f, greatest({HEALTHY}, least(n - 2, CAST(round_even((n - 1) * f, 0) AS BIGINT))) + 1 AS cut FROM traj, (SELECT unnest([{fr}]) AS f)) GROUP BY ALL)
    SELECT {big('condition', 'condition')}, bearing, cut_fraction, {big('cut', 'cut_file_index')}, cut * 10.0E0 AS observed_age_seconds, {a.SQL_CONTEXT}, {r('hi', 'hi_current')}, {out}, {', '.join(r(f'z_{s}', f'{s}_robust_z_current') + ', ' + r(f'y_{s}', f'{s}_robust_z_recent_mean') for s in sig)}, rul_seconds
    FROM w JOIN cuts USING (bearing) WHERE file_index = cut"""


@query(sql_health())
def health_samples(spark, sf_dir):
    return prefix.health_samples(a.labelled(spark, sf_dir), FRACTIONS, HEALTHY, RECENT)


def sql_temporal(columns: str, source: str) -> str:
    parts = []
    for s in catalog.SOURCES:
        for n in catalog.ROLLING_WINDOWS:
            w = f"(PARTITION BY bearing ORDER BY file_index ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
            parts += [r(f"avg({s}) OVER {w}", f"{s}_roll_mean_{n}"), r(f"stddev_pop({s}) OVER {w}", f"{s}_roll_std_{n}"), r(f"CASE WHEN file_index = 1 THEN 0 ELSE regr_slope({s}, file_index * 10.0E0) OVER {w} END", f"{s}_roll_slope_{n}")]
    return f"WITH {TRAJ} SELECT {columns}, {', '.join(r(c, c) for c in catalog.signal_columns())}, {', '.join(parts)} FROM {source}"


@query(sql_temporal(f"split, {big('condition', 'condition')}, bearing, elapsed_time_seconds, {big('file_index', 'file_index')}, rul_seconds", "traj"), done=True)
def training_dataset(spark, sf_dir):
    return datasets.training_dataset(a.trajectories(spark, sf_dir), DIGITS)


@query(sql_temporal(f"'Test_set' AS split, {big('condition', 'condition')}, bearing, elapsed_time_seconds, {big('file_index', 'file_index')}", "(SELECT * FROM traj WHERE file_index <= floor(0.6 * n))"), done=True)
def test_feature_dataset(spark, sf_dir):
    return datasets.test_feature_dataset(a.truncated(spark, sf_dir)[0], DIGITS)


TRUTH = f"SELECT {big('condition', 'condition')}, bearing, {big('file_index', 'file_index')}, rul_seconds FROM traj WHERE file_index <= floor(0.6 * n)"


@query(f"WITH {TRAJ} {TRUTH}")
def ground_truth(spark, sf_dir):
    return datasets.ground_truth(*a.truncated(spark, sf_dir))


@query(f"WITH {TRAJ} SELECT condition::BIGINT AS condition, bearing, CAST(floor(0.6 * n) AS BIGINT) AS cut_file_index, rul_seconds FROM traj WHERE file_index = floor(0.6 * n)")
def endpoint_truth(spark, sf_dir):
    return datasets.endpoint_truth(datasets.ground_truth(*a.truncated(spark, sf_dir)))


@query(f"WITH {TRAJ} SELECT condition::BIGINT AS condition, bearing, CAST(floor(0.6 * n) AS BIGINT) AS cut_file_index, floor(0.6 * n) * 10 AS observed_age_seconds, rul_seconds FROM traj WHERE file_index = floor(0.6 * n)")
def holdout_alignment(spark, sf_dir):
    test, whole = a.truncated(spark, sf_dir)
    ends = prefix.prefix_endpoints(test).select("condition", "bearing", "cut_file_index", "observed_age_seconds")
    return datasets.align(ends, datasets.endpoint_truth(datasets.ground_truth(test, whole))).select(*ends.columns, "rul_seconds")


@query(f"WITH {TRAJ} SELECT bearing, {big('file_index', 'file_index')}, rul_seconds, elapsed_time_seconds FROM traj")
def run_labels(spark, sf_dir):
    return trajectory.with_rul(trajectory.with_identity(a.trajectories(spark, sf_dir))).select("bearing", "file_index", "rul_seconds", F.col("elapsed_time_seconds").cast("long").alias("elapsed_time_seconds"))


@query(f"WITH {TRAJ} SELECT condition::BIGINT AS condition, max_by(bearing, (m, bearing)) AS bearing, max(m) AS n_rows FROM (SELECT condition, bearing, count(*) AS m FROM traj GROUP BY ALL) GROUP BY condition")
def longest_runs(spark, sf_dir):
    return trajectory.longest_per_group(a.trajectories(spark, sf_dir))


@query(f"WITH {TRAJ} SELECT bearing, {big('file_index', 'file_index')}, {r('rms_horiz', 'rms_horiz')} FROM traj WHERE (file_index - 1) % 7 = 0")
def thinned_runs(spark, sf_dir):
    return trajectory.thinned(a.trajectories(spark, sf_dir), 7).select("bearing", "file_index", "rms_horiz")


@query(f"WITH {TRAJ} SELECT bearing, {big('file_index', 'file_index')}, place FROM traj, (SELECT unnest(['start', 'middle', 'end']) AS place) WHERE file_index = CASE place WHEN 'start' THEN 1 WHEN 'middle' THEN n // 2 + 1 ELSE n END")
def picked_snapshots(spark, sf_dir):
    return trajectory.picked(a.trajectories(spark, sf_dir)).select("bearing", "file_index", "place")


@query(f"WITH {TRAJ} SELECT x.bearing, {big('x.file_index', 'file_index')}, {r('quantile_cont(y.rms_horiz, 0.5)', 'smooth')} FROM traj x JOIN traj y ON x.bearing = y.bearing AND y.file_index BETWEEN x.file_index - 2 AND x.file_index + 2 GROUP BY ALL")
def centred_medians(spark, sf_dir):
    return trajectory.centred_median(a.trajectories(spark, sf_dir), "rms_horiz").select("bearing", "file_index", "smooth")


# Snapshots.

def sql_moments(c: str, out: str) -> str:
    m = f"avg({c})"
    c2, c3, c4 = f"(avg({c}^2) - {m}^2)", f"(avg({c}^3) - 3 * {m} * avg({c}^2) + 2 * {m}^3)", f"(avg({c}^4) - 4 * {m} * avg({c}^3) + 6 * {m}^2 * avg({c}^2) - 3 * {m}^4)"
    return f"{r(f'sqrt(avg({c}^2))', f'rms_{out}')}, round({c4} / nullif({c2}, 0)^2 - 3, 5) AS kurtosis_{out}, round({c3} / nullif({c2}, 0)^1.5, 5) + 0.0 AS skewness_{out}, {r(f'CASE WHEN avg({c}^2) = 0 THEN 0 ELSE max(abs({c})) / sqrt(avg({c}^2)) END', f'crest_factor_{out}')}"


@query(f"SELECT l_suppkey, {sql_moments('l_quantity', 'horiz')}, {sql_moments('l_discount', 'vert')} FROM lineitem GROUP BY l_suppkey")
def time_domain(spark, sf_dir):
    rows = signal.time_domain(a.samples(spark, sf_dir), ["l_suppkey"], {"horiz": "l_quantity", "vert": "l_discount"})
    return rows.withColumns({c: F.round(c, 5) + 0.0 for c in rows.columns if c.startswith(("kurtosis", "skewness"))})


@query(f"""SELECT l_suppkey, {r('avg(x)', 'q_mean')}, {r('stddev_samp(x)', 'q_std')}, {r('sqrt(avg(x*x))', 'q_rms')}, min(x) AS q_min, max(x) AS q_max, max(x) - min(x) AS q_peak_to_peak, max(abs(x)) AS q_absolute_peak,
    round(skewness(x), 5) + 0.0 AS q_skewness, round(kurtosis(x) + 3, 5) + 0.0 AS q_kurtosis, {r('max(abs(x)) / sqrt(avg(x*x))', 'q_crest_factor')} FROM (SELECT l_suppkey, l_quantity AS x FROM lineitem) GROUP BY l_suppkey""")
def extended_time(spark, sf_dir):
    rows = signal.extended_time(a.samples(spark, sf_dir), ["l_suppkey"], {"q": "l_quantity"})
    return rows.withColumns({c: F.round(c, 5) + 0.0 for c in ("q_skewness", "q_kurtosis")})


DFT = """w AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS c, x, i FROM w),
    s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im, sum(c * cos(2 * pi() * k * i / 64)) AS cre, sum(c * sin(2 * pi() * k * i / 64)) AS cim FROM m, range(33) t(k) GROUP BY ALL)"""
BANDS = f"WITH {DFT} SELECT vec_id, {', '.join(r(f'sum((re*re + im*im) / 64) FILTER (least(k // 4, 7) = {i})', f'fft_band_{i}_wave') for i in range(8))} FROM s GROUP BY vec_id"


@query(BANDS)
def fft_bands(spark, sf_dir):
    return signal.with_bands(a.waves(spark, sf_dir), ["wave"]).select("vec_id", *(f"fft_band_{i}_wave" for i in range(8)))


@query(BANDS)
def fft_bands_native(spark, sf_dir):
    rows = a.waves(spark, sf_dir).withColumn("e", signal.band_energy_exact("wave"))
    return rows.select("vec_id", *(F.get("e", F.lit(i)).alias(f"fft_band_{i}_wave") for i in range(8)))


@query(f"""WITH {DFT}, p AS (SELECT vec_id, k, k * 400.0E0 AS f, CASE WHEN k = 0 THEN 0 ELSE cre*cre + cim*cim END AS p FROM s)
    SELECT vec_id, max_by(f, p) AS dominant_frequency, round(sum(f * p) / sum(p), 4) AS spectral_centroid, round(sum(p), 4) AS total_energy, round(sum(p) FILTER (f < 2000), 4) AS low, round(sum(p) FILTER (f >= 2000 AND f < 12800), 4) AS high, {r('sum(p) FILTER (f < 2000) / sum(p)', 'low_ratio')} FROM p GROUP BY vec_id""")
def spectra(spark, sf_dir):
    rows = a.waves(spark, sf_dir).select("vec_id", signal.spectrum(25_600.0, [0.0, 2000.0, 12_800.0])(F.col("wave")).alias("s")).select("vec_id", "s.*")
    return rows.select("vec_id", "dominant_frequency", F.round("spectral_centroid", 4).alias("spectral_centroid"), F.round("total_energy", 4).alias("total_energy"), F.round(F.get("bands", F.lit(0)), 4).alias("low"), F.round(F.get("bands", F.lit(1)), 4).alias("high"), F.get("ratios", F.lit(0)).alias("low_ratio"))


RUN = f"""WITH s AS (SELECT 'S' || (vec_id % 7) AS bearing, CAST(vec_id // 7 AS BIGINT) AS k, vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), n AS (SELECT bearing, k, count(DISTINCT k) OVER (PARTITION BY bearing) AS n, row_number() OVER (PARTITION BY bearing ORDER BY k) AS file_index FROM (SELECT DISTINCT bearing, k FROM s)),
    m AS (SELECT s.bearing, file_index, n, i, x, x - avg(x) OVER (PARTITION BY s.bearing, file_index) AS c FROM s JOIN n USING (bearing, k) WHERE (file_index - 1) % 3 = 0),
    f AS (SELECT bearing, file_index, k, k * 400.0E0 AS f, CASE WHEN k = 0 THEN 0 ELSE sum(c * cos(2 * pi() * k * i / 64))^2 + sum(c * sin(2 * pi() * k * i / 64))^2 END AS p FROM m, range(33) t(k) GROUP BY bearing, file_index, k),
    g AS (SELECT bearing, file_index, max_by(f, p) AS top, sum(f * p) / sum(p) AS centroid, sum(p) FILTER (f >= 1000 AND f < 3000) / sum(p) AS second FROM f GROUP BY ALL),
    h AS (SELECT bearing, file_index, max(n) AS n, avg(x) AS mean, max(x) - min(x) AS span, kurtosis(x) + 3 AS kurt FROM m GROUP BY ALL)
    SELECT bearing, {big('file_index', 'file_index')}, {r('(file_index - 1) * 10 / 3600', 'elapsed_hours')}, {r('(n - file_index) * 10 / 3600', 'rul_hours')}, round(mean, 5) + 0.0 AS wave_mean, round(span, 5) + 0.0 AS wave_peak_to_peak, round(kurt, 4) + 0.0 AS wave_kurtosis, top AS wave_dominant_frequency, round(centroid, 3) AS wave_spectral_centroid, round(second, 5) + 0.0 AS wave_ratio_1 FROM g JOIN h USING (bearing, file_index)"""


@query(RUN)
def run_table(spark, sf_dir):
    waves = a.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("S"), (F.col("vec_id") % 7).cast("string")).alias("bearing"), F.floor(F.col("vec_id") / 7).alias("k"), F.posexplode(F.col("embedding").cast("array<double>")).alias("position", "x"))
    known = waves.select("bearing", "k").distinct()
    numbers = known.withColumn("file_index", F.row_number().over(Window.partitionBy("bearing").orderBy("k")))
    rows = datasets.run_table(waves.join(numbers, ["bearing", "k"]), {"wave": "x"}, 3)
    digits = {"wave_mean": 5, "wave_peak_to_peak": 5, "wave_kurtosis": 4, "wave_spectral_centroid": 3, "wave_ratio_1": 5}
    return rows.select("bearing", "file_index", "elapsed_hours", "rul_hours", "wave_dominant_frequency", *((F.round(c, d) + 0.0).alias(c) for c, d in digits.items()))


# Models and evaluation.

MEDIANS = f"md AS (SELECT f.bearing, quantile_cont(t.rul_seconds, 0.5) AS med FROM (SELECT DISTINCT bearing FROM traj) f JOIN traj t ON t.bearing <> f.bearing GROUP BY f.bearing), pm AS (SELECT traj.bearing, file_index, rul_seconds, med AS predicted FROM traj JOIN md USING (bearing))"


def median_predictions(spark, sf_dir) -> DataFrame:
    return models.leave_one_out("median", a.labelled(spark, sf_dir).select("condition", "bearing", "file_index", "rul_seconds"), [])


@query(f"WITH {TRAJ}, {MEDIANS} SELECT bearing, {big('file_index', 'file_index')}, rul_seconds, {r('predicted', 'predicted')} FROM pm")
def median_lobo(spark, sf_dir):
    return median_predictions(spark, sf_dir).select("bearing", "file_index", "rul_seconds", "predicted")


LIFE_PRIORS = f"""WITH {TRAJ}, l AS (SELECT *, file_index * 10 + rul_seconds AS life, file_index * 10.0E0 AS age FROM traj), f AS (SELECT DISTINCT bearing FROM l),
    c AS (SELECT f.bearing, l.condition, quantile_cont(life, 0.5) AS own FROM f JOIN l ON l.bearing <> f.bearing GROUP BY ALL), g AS (SELECT f.bearing, quantile_cont(life, 0.5) AS every FROM f JOIN l ON l.bearing <> f.bearing GROUP BY ALL)
    SELECT l.bearing, {big('file_index', 'file_index')}, {r('greatest(coalesce(own, every) - age, 0)', 'predicted')} FROM l LEFT JOIN c ON l.bearing = c.bearing AND l.condition = c.condition JOIN g ON l.bearing = g.bearing"""


@query(LIFE_PRIORS)
def life_prior_lobo(spark, sf_dir):
    return life_priors(a.labelled(spark, sf_dir))


@query(LIFE_PRIORS)
def life_prior_lobo_whole(spark, sf_dir):
    return life_priors(a.labelled(spark, sf_dir))


def life_priors(labelled: DataFrame) -> DataFrame:
    rows = labelled.withColumn("observed_age_seconds", F.col("file_index") * 10.0)
    return models.leave_one_out("condition_life_prior", rows.select("condition", "bearing", "file_index", "rul_seconds", "observed_age_seconds"), []).select("bearing", "file_index", "predicted")


METRICS = f"{r('sqrt(avg((y-p)^2))', 'rmse')}, {r('avg(abs(y-p))', 'mae')}, {r('1 - avg((y-p)^2) / nullif(var_pop(y), 0)', 'r2')}, {r('avg(CASE WHEN 100*(y-p)/y <= 0 THEN exp(-ln(0.5)*100*(y-p)/y/5) ELSE exp(ln(0.5)*100*(y-p)/y/20) END) FILTER (y > 0)', 'phm12')}"
FOLDS = f"fm AS (SELECT bearing, sqrt(avg((y-p)^2)) AS rmse, avg(abs(y-p)) AS mae, 1 - avg((y-p)^2) / nullif(var_pop(y), 0) AS r2, avg(CASE WHEN 100*(y-p)/y <= 0 THEN exp(-ln(0.5)*100*(y-p)/y/5) ELSE exp(ln(0.5)*100*(y-p)/y/20) END) FILTER (y > 0) AS phm12 FROM (SELECT bearing, rul_seconds AS y, predicted AS p FROM pm) GROUP BY bearing)"


@query(f"WITH {TRAJ}, {MEDIANS} SELECT bearing, count(*) AS n_rows, {METRICS} FROM (SELECT bearing, rul_seconds AS y, predicted AS p FROM pm) GROUP BY bearing")
def fold_metrics(spark, sf_dir):
    return evaluate.metrics(median_predictions(spark, sf_dir), ["bearing"], "rul_seconds")


@query(f"WITH {TRAJ}, {MEDIANS}, {FOLDS} SELECT 'median' AS model, count(*) AS n_folds, {', '.join(r(f'avg({m})', f'mean_{m}') + ', ' + r(f'stddev_samp({m})', f'std_{m}') for m in ('rmse', 'mae', 'r2', 'phm12'))}, {r('quantile_cont(rmse, 0.5)', 'median_rmse')}, {r('max(rmse)', 'worst_rmse')} FROM fm")
def prefix_cv_summary(spark, sf_dir):
    return evaluate.prefix_summary(evaluate.metrics(median_predictions(spark, sf_dir), ["model", "held_out_bearing"], "rul_seconds"))


def predicted_runs(spark, sf_dir) -> DataFrame:
    """Two simple predictions per snapshot, for evaluation queries."""
    rows = a.labelled(spark, sf_dir).select("bearing", "rul_seconds", F.col("rms_horiz").alias("_x"), (F.col("file_index") * 10.0).alias("observed_age_seconds"))
    both = F.explode(F.array(F.struct(F.lit("age").alias("model"), F.greatest(F.lit(0.0), 700.0 - F.col("observed_age_seconds")).alias("prediction_rul_seconds")), F.struct(F.lit("rms").alias("model"), (F.col("_x") * 300).alias("prediction_rul_seconds"))))
    return rows.withColumn("p", both).select(F.col("bearing").alias("held_out_bearing"), "rul_seconds", "observed_age_seconds", "p.*")


PREDICTED = "pr AS (SELECT bearing AS held_out_bearing, rul_seconds, file_index * 10.0E0 AS age, 'age' AS model, greatest(0.0, 700.0 - file_index * 10.0E0) AS p FROM traj UNION ALL SELECT bearing, rul_seconds, file_index * 10.0E0, 'rms', rms_horiz * 300 FROM traj)"
MONO = "mo AS (SELECT model, held_out_bearing, count(*) FILTER (p - before > 1e-9) AS up, count(before) AS n FROM (SELECT *, lag(p) OVER (PARTITION BY model, held_out_bearing ORDER BY age) AS before FROM pr) GROUP BY ALL)"


@query(f"WITH {TRAJ}, {PREDICTED}, {MONO} SELECT model, held_out_bearing, up AS monotonic_violations, n AS monotonic_comparisons, {r('CASE WHEN n = 0 THEN 0 ELSE up / n END', 'monotonic_violation_rate')} FROM mo")
def monotonicity(spark, sf_dir):
    return trajectory.monotonicity(predicted_runs(spark, sf_dir))


@query(f"WITH {TRAJ}, {PREDICTED}, {MONO}, q AS (SELECT model, sqrt(avg((rul_seconds - p)^2)) AS rmse FROM pr GROUP BY model), v AS (SELECT model, avg(up / n) AS rate FROM mo GROUP BY model) SELECT model, {r('rmse', 'rmse')}, {r('rate', 'mean_violation_rate')}, row_number() OVER (ORDER BY rmse, model) AS rank FROM q LEFT JOIN v USING (model)")
def model_ranking(spark, sf_dir):
    rows = predicted_runs(spark, sf_dir)
    scores = evaluate.metrics(rows, ["model"], "rul_seconds", "prediction_rul_seconds").select("model", "rmse")
    return evaluate.ranked(evaluate.with_monotonicity(scores, evaluate.monotonic_rate(trajectory.monotonicity(rows))))


@query(f"WITH {TRAJ}, {PREDICTED} SELECT held_out_bearing, {r('sqrt(avg((rul_seconds - p)^2) FILTER (model = $$age$$))', 'age')}, {r('sqrt(avg((rul_seconds - p)^2) FILTER (model = $$rms$$))', 'rms')} FROM pr GROUP BY held_out_bearing")
def rmse_pivot(spark, sf_dir):
    folds = evaluate.metrics(predicted_runs(spark, sf_dir), ["model", "held_out_bearing"], "rul_seconds", "prediction_rul_seconds")
    return evaluate.rmse_by_entity(folds, ["age", "rms"])


KNN_X = ["rms_horiz", "kurtosis_vert", "fft_band_3_horiz"]


NEAREST = f"""WITH {TRAJ}, x AS (SELECT bearing, file_index, rul_seconds, CAST(substr(bearing, 2) AS BIGINT) % 2 AS side, {', '.join(KNN_X)} FROM traj), s AS (SELECT {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(KNN_X))} FROM x WHERE side = 1),
    d AS (SELECT q.bearing, q.file_index, t.rul_seconds AS y, {' + '.join(f'((q.{c} - m{i}) / s{i} - (t.{c} - m{i}) / s{i})^2' for i, c in enumerate(KNN_X))} AS d FROM x q, x t, s WHERE q.side = 0 AND t.side = 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY bearing, file_index ORDER BY round(d, 12), y) AS rn FROM d)
    SELECT bearing, {big('file_index', 'file_index')}, {r('CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / sqrt(nullif(d, 0))) / sum(1 / sqrt(nullif(d, 0))) END + 1e-9', 'predicted')} FROM k WHERE rn <= 3 GROUP BY ALL"""


@query(NEAREST)
def knn_regression(spark, sf_dir):
    return nearest(a.labelled(spark, sf_dir))


@query(NEAREST)
def knn_regression_whole(spark, sf_dir):
    return nearest(a.labelled(spark, sf_dir))


def nearest(labelled: DataFrame) -> DataFrame:
    rows = labelled.select("bearing", "file_index", "rul_seconds", *KNN_X).withColumn("side", F.substring("bearing", 2, 20).cast("long") % 2)
    made = models.knn_predict(rows.where("side = 1"), rows.where("side = 0"), KNN_X, "rul_seconds", ["bearing", "file_index"])
    # here and in the SQL, values halfway between two roundings go up, whatever the order of earlier sums was
    return made.select("bearing", "file_index", (F.col("predicted") + 1e-9).alias("predicted"))


def fitted_samples(spark, sf_dir) -> DataFrame:
    return prefix.prefix_samples(a.labelled(spark, sf_dir), FRACTIONS)


SCORES = """fx AS (SELECT model, bearing, sqrt(avg((y-p)^2)) AS rmse, avg(abs(y-p)) AS mae FROM px GROUP BY 1, 2), mx AS (SELECT model, avg(up / greatest(n, 1)) AS rate FROM (SELECT model, bearing, count(*) FILTER (p - before > 1e-9) AS up, count(before) AS n FROM (SELECT *, lag(p) OVER (PARTITION BY model, bearing ORDER BY age) AS before FROM px) GROUP BY 1, 2) GROUP BY 1),
    sx AS (SELECT model, count(*) AS n_folds, avg(rmse) AS mean_rmse, stddev_samp(rmse) AS std_rmse, avg(mae) AS mean_mae, median(rmse) AS median_rmse, max(rmse) AS worst_rmse, rate AS mean_violation_rate FROM fx JOIN mx USING (model) GROUP BY model, rate)"""


def sql_ridge(label: str, features: list[str], alpha: float, life: bool = False) -> tuple[str, str]:
    """CTEs, and the rows (model, bearing, age, y, p) of ridges that leave each machine out: normal equations from the sums of
    products of all rows less the machine's own, solved by elimination, one column after the other."""
    p, n = len(features), label.replace(" ", "_").replace(":", "_")
    goal = "y + age" if life else "y"
    cols = {f"c{j + 1}": f for j, f in enumerate(features)}
    names = ", ".join(f"c{j}" for j in range(p + 2))
    scaled = ", ".join(f"({f} - avg({f}) OVER ()) / coalesce(nullif(stddev_pop({f}) OVER (), 0), 1) AS {c}" for c, f in cols.items())
    size = f"JOIN {n}_t k ON k.bearing = {{}}.bearing AND k.i = 0 AND k.j = 0"
    ctes = [
        f"{n}_x AS MATERIALIZED (SELECT bearing, cut, 1.0::DOUBLE AS c0, {scaled}, {goal} - avg({goal}) OVER () AS c{p + 1}, avg({goal}) OVER () AS shift, y, age FROM fs)",
        f"{n}_l AS MATERIALIZED (SELECT bearing, cut, CAST(substr(name, 2) AS BIGINT) AS j, v FROM (UNPIVOT (SELECT bearing, cut, {names} FROM {n}_x) ON {names} INTO NAME name VALUE v))",
        f"{n}_o AS MATERIALIZED (SELECT a.bearing, a.j AS i, b.j, sum(a.v * b.v) AS v FROM {n}_l a JOIN {n}_l b USING (bearing, cut) GROUP BY ALL)",
        f"{n}_t AS MATERIALIZED (SELECT bearing, i, j, sum(v) OVER (PARTITION BY i, j) - v AS v FROM {n}_o)",
        f"{n}_c AS MATERIALIZED (SELECT t.bearing, t.i, t.j, t.v - a.v * b.v / k.v AS v, k.v AS n FROM {n}_t t JOIN {n}_t a ON a.bearing = t.bearing AND a.i = 0 AND a.j = t.i JOIN {n}_t b ON b.bearing = t.bearing AND b.i = 0 AND b.j = t.j {size.format('t')} WHERE t.i > 0 AND t.j > 0)",
        f"{n}_d AS MATERIALIZED (SELECT bearing, i, CASE WHEN i = {p + 1} THEN 1.0 ELSE sqrt(v / n) END AS d FROM {n}_c WHERE i = j)",
        f"{n}_m0 AS MATERIALIZED (SELECT c.bearing, c.i, list(c.v / (a.d * b.d) + CASE WHEN c.i = c.j THEN {alpha!r}::DOUBLE ELSE 0 END ORDER BY c.j) AS w FROM {n}_c c JOIN {n}_d a ON a.bearing = c.bearing AND a.i = c.i JOIN {n}_d b ON b.bearing = c.bearing AND b.i = c.j WHERE c.i <= {p} GROUP BY ALL)",
    ]
    for k in range(1, p + 1):
        row = f"CASE WHEN a.i = {k} THEN list_transform(a.w, lambda x: x / b.w[{k}]) ELSE list_transform(list_zip(a.w, b.w), lambda z: z[1] - z[2] * (a.w[{k}] / b.w[{k}])) END"
        ctes.append(f"{n}_m{k} AS MATERIALIZED (SELECT a.bearing, a.i, {row} AS w FROM {n}_m{k - 1} a JOIN {n}_m{k - 1} b ON a.bearing = b.bearing AND b.i = {k})")
    ctes.append(f"{n}_w AS MATERIALIZED (SELECT m.bearing, m.i, m.w[{p + 1}] / d.d AS w, t.v / k.v AS mean FROM {n}_m{p} m JOIN {n}_d d USING (bearing, i) JOIN {n}_t t ON t.bearing = m.bearing AND t.i = 0 AND t.j = m.i {size.format('m')})")
    ctes.append(f"{n}_y AS (SELECT a.bearing, a.v / k.v AS mean FROM {n}_t a {size.format('a')} WHERE a.i = 0 AND a.j = {p + 1})")
    raw = "any_value(x.shift) + any_value(y.mean) + sum(w.w * (l.v - w.mean))"
    took = f"greatest(0, greatest(0, {raw}) - any_value(x.age))" if life else f"greatest(0, {raw})"
    rows = f"SELECT '{label}' AS model, x.bearing, any_value(x.age) AS age, any_value(x.y) AS y, {took} AS p FROM {n}_x x JOIN {n}_l l USING (bearing, cut) JOIN {n}_w w ON w.bearing = x.bearing AND w.i = l.j JOIN {n}_y y ON y.bearing = x.bearing GROUP BY x.bearing, x.cut"
    return ", ".join(ctes), rows


FITTED = f"fs AS MATERIALIZED (SELECT *, cut_file_index AS cut, observed_age_seconds AS age, rul_seconds AS y FROM ({sql_prefix(False, plain)}))"


def sql_ridges(*models: tuple) -> str:
    """WITH ... px, the rows of all models; each is (label, features, alpha, life)."""
    made = [sql_ridge(*m) for m in models]
    return f"WITH {FITTED}, {', '.join(c for c, _ in made)}, px AS MATERIALIZED ({' UNION ALL '.join(x for _, x in made)})"


def sql_ridge_metrics(life: bool) -> str:
    return f"{sql_ridges(('ridge', catalog.prefix_columns(), 10.0, life))} SELECT model, count(*) AS n_rows, {METRICS} FROM (SELECT model, y, p FROM px) GROUP BY model"


@query(sql_ridge_metrics(False))
def ridge_cv(spark, sf_dir):
    """Each machine left out once, all fits from one pass over the samples."""
    return evaluate.metrics(models.leave_one_out("ridge", kept(fitted_samples(spark, sf_dir), "samples"), catalog.prefix_columns()), ["model"], "rul_seconds")


@query(sql_ridge_metrics(True))
def total_life_ridge_cv(spark, sf_dir):
    return evaluate.metrics(models.leave_one_out("ridge", kept(fitted_samples(spark, sf_dir), "samples"), catalog.prefix_columns(), total_life=True), ["model"], "rul_seconds")


def trees(name: str, **params):
    def run(spark, sf_dir):
        rows = models.leave_one_out(name, fitted_samples(spark, sf_dir), catalog.prefix_columns(), folds=3, **params)
        return evaluate.metrics(rows, ["model"], "rul_seconds")

    run.__name__ = f"{name}_cv"
    return query()(run)


random_forest_cv = trees("random_forest")
boosted_cv = trees("gradient_boosting")


@query()
def feature_importance(spark, sf_dir):
    return forests.importances(fitted_samples(spark, sf_dir), catalog.prefix_columns(), "rul_seconds", **models.effective_params("random_forest"))


# Experiments.

SAMPLES = f"""cuts AS (SELECT DISTINCT condition, bearing, n, greatest(1, least(n - 2, CAST(round_even((n - 1) * f, 0) AS BIGINT))) + 1 AS cut FROM traj, (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in FRACTIONS)}]) AS f)),
    sm AS (SELECT t.condition, t.bearing, cut, cut * 10.0E0 AS age, t.rul_seconds AS y FROM cuts JOIN traj t ON t.bearing = cuts.bearing AND t.file_index = cut)"""
LEFT_OUT = """fb AS (SELECT DISTINCT bearing FROM sm), om AS (SELECT f.bearing, median(y) AS m FROM fb f JOIN sm s ON s.bearing <> f.bearing GROUP BY 1), ol AS (SELECT f.bearing, median(y + age) AS m FROM fb f JOIN sm s ON s.bearing <> f.bearing GROUP BY 1),
    oc AS (SELECT f.bearing, s.condition, median(y + age) AS m FROM fb f JOIN sm s ON s.bearing <> f.bearing GROUP BY 1, 2),
    px AS (SELECT 'median' AS model, bearing, age, y, om.m AS p FROM sm JOIN om USING (bearing) UNION ALL SELECT 'condition_life_prior', s.bearing, age, y, greatest(0, coalesce(oc.m, ol.m) - age) FROM sm s JOIN ol ON s.bearing = ol.bearing LEFT JOIN oc ON oc.bearing = s.bearing AND oc.condition = s.condition
           UNION ALL SELECT 'median:total_life', s.bearing, age, y, greatest(0, ol.m - age) FROM sm s JOIN ol USING (bearing))"""
SUMMARY = ["model", "n_folds", "mean_rmse", "std_rmse", "mean_mae", "median_rmse", "worst_rmse", "mean_violation_rate"]


def sql_summary(where: str) -> str:
    return f"WITH {TRAJ}, {SAMPLES}, {LEFT_OUT}, {SCORES} SELECT model, n_folds, {', '.join(r(c, c) for c in SUMMARY[2:])} FROM sx WHERE {where}"


def plain_samples(spark, sf_dir) -> DataFrame:
    return kept(fitted_samples(spark, sf_dir).select("condition", "bearing", "observed_age_seconds", "rul_seconds"), "samples")


@query(sql_summary("model = 'condition_life_prior'"))
def experiment(spark, sf_dir):
    return experiments.run_experiment("condition_life_prior", plain_samples(spark, sf_dir), []).summary.select(*SUMMARY)


@query(sql_summary("model IN ('median', 'condition_life_prior')"))
def experiment_baselines(spark, sf_dir):
    return experiments.baselines(plain_samples(spark, sf_dir)).select(*SUMMARY)


@query()
def baseline_models(spark, sf_dir):
    """Medians, life priors, ridge and forest on folds of machines; boosted_cv has the boosted trees, which take minutes."""
    presets = [p for p in experiments.BASELINES if p["model"] in ("ridge", "random_forest")]
    return experiments.baselines(kept(fitted_samples(spark, sf_dir), "samples"), features=catalog.prefix_columns(), folds=2, presets=presets).select("model", "n_folds", "mean_rmse", "worst_rmse")


@query(f"WITH {TRAJ}, {SAMPLES}, {LEFT_OUT}, {SCORES} SELECT 'median' AS model, {r('a.mean_rmse', 'direct')}, {r('b.mean_rmse', 'total_life')}, {r('a.mean_rmse - b.mean_rmse', 'gain')} FROM sx a, sx b WHERE a.model = 'median' AND b.model = 'median:total_life'")
def target_ablation(spark, sf_dir):
    return experiments.target_ablation(["median"], plain_samples(spark, sf_dir), [])


#: Experiments that the contract has to refuse: a column that is never a predictor, alone or with the age.
LEAKS = {f"leak {c}": [c] for c in catalog.NEVER_PREDICTORS} | {"leak of the difference": ["total_life_seconds", "observed_age_seconds"]}
MEDIANS_OF_FOLDS = "SELECT avg(rmse) FROM (SELECT sqrt(avg((y - m)^2)) AS rmse FROM (SELECT a.bearing, a.y, b.m FROM fs a JOIN (SELECT f.bearing, median(s.y) AS m FROM (SELECT DISTINCT bearing FROM fs) f JOIN fs s ON s.bearing <> f.bearing GROUP BY 1) b USING (bearing)) GROUP BY bearing)"
REFUSED = " ".join(f"UNION ALL SELECT '{label}', 'error', 'ContractError: never predictors: {columns[0]}', NULL" for label, columns in LEAKS.items())


@query(f"{sql_ridges(('ridge', catalog.prefix_columns(), 10.0))}, {SCORES} SELECT model, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason, {r('mean_rmse', 'mean_rmse')} FROM sx UNION ALL SELECT 'no such model', 'error', 'KeyError: ''unsupported model: no such model''', NULL UNION ALL SELECT 'median', 'ok', NULL, {r(f'({MEDIANS_OF_FOLDS})')} {REFUSED}")
def experiment_suite(spark, sf_dir):
    """Predictors that leak and a model that isn't there have status error."""
    specs = [{"model": "median"}, {"model": "ridge"}, {"model": "no such model"}, *({"model": "ridge", "label": label, "features": columns} for label, columns in LEAKS.items())]
    return experiments.suite(kept(fitted_samples(spark, sf_dir), "samples"), catalog.prefix_columns(), specs).select("model", "status", "reason", "mean_rmse")


COLUMN_SETS = {"all": catalog.prefix_columns(), "age": ["observed_age_seconds"], "rms": [c for c in catalog.prefix_columns() if c.startswith("rms")], "no slopes": [c for c in catalog.prefix_columns() if "slope" not in c]}


@query(f"{sql_ridges(*((label, columns, 10.0) for label, columns in COLUMN_SETS.items()))}, {SCORES} SELECT model, 'ok' AS status, {r('mean_rmse', 'mean_rmse')}, {r('worst_rmse', 'worst_rmse')} FROM sx")
def feature_ablation(spark, sf_dir):
    return experiments.feature_ablation("ridge", kept(fitted_samples(spark, sf_dir), "samples"), COLUMN_SETS).select("model", "status", "mean_rmse", "worst_rmse")


CANDIDATES = experiments.candidates("ridge", 6)
PARAMS = " ".join(f"WHEN 'k{k}' THEN '{json.dumps(c)}'" for k, c in enumerate(CANDIDATES))


@query(f"{sql_ridges(*((f'k{k}', catalog.prefix_columns(), c['alpha']) for k, c in enumerate(CANDIDATES)))}, {SCORES} SELECT CAST(substr(model, 2) AS BIGINT) AS candidate, CASE model {PARAMS} END AS params, {r('mean_rmse', 'mean_rmse')}, {r('worst_rmse', 'worst_rmse')} FROM sx")
def parameter_sweep(spark, sf_dir):
    return experiments.sweep("ridge", kept(fitted_samples(spark, sf_dir), "samples"), catalog.prefix_columns(), len(CANDIDATES))


HALVES = "CAST(substr(bearing, 2) AS BIGINT) % 2"


@query(f"""WITH {TRAJ}, x AS (SELECT bearing, CASE WHEN file_index % 9 = 0 THEN NULL ELSE rul_seconds END AS y FROM traj), m AS (SELECT median(y) AS p FROM x WHERE {HALVES} = 1), q AS (SELECT y, p FROM x, m WHERE {HALVES} = 0 AND y IS NOT NULL)
    SELECT count(*) AS n_rows, {METRICS}, (SELECT count(*) FROM x WHERE {HALVES} = 1 AND y IS NULL) AS n_dropped_learn, (SELECT count(*) FROM x WHERE {HALVES} = 0 AND y IS NULL) AS n_dropped_judge FROM q""")
def split_fit(spark, sf_dir):
    rows = a.labelled(spark, sf_dir).withColumn("split", F.when(F.substring("bearing", 2, 20).cast("long") % 2 == 1, "learn").otherwise("judge"))
    return experiments.split_fit("median", rows.withColumn("rul_seconds", F.when(F.col("file_index") % 9 != 0, F.col("rul_seconds"))), [], "learn", "judge")[1]


HOLDOUT = f"""ts AS (SELECT *, max(file_index) FILTER (file_index <= floor(0.6 * n)) OVER (PARTITION BY bearing) AS last FROM traj), en AS (SELECT condition, bearing, last * 10.0E0 AS age, (n - last) * 10.0E0 AS y FROM ts WHERE file_index = last),
    mm AS (SELECT median(y) AS m, median(y + age) AS l FROM sm), mc AS (SELECT condition, median(y + age) AS l FROM sm GROUP BY 1),
    ho AS (SELECT 'median' AS model, y, m AS p FROM en, mm UNION ALL SELECT 'condition_life_prior', y, greatest(0, coalesce(mc.l, mm.l) - age) FROM en CROSS JOIN mm LEFT JOIN mc USING (condition))"""


@query(f"WITH {TRAJ}, {SAMPLES}, {HOLDOUT}, s AS (SELECT model, count(*) AS n_rows, {METRICS} FROM ho GROUP BY model) SELECT *, row_number() OVER (ORDER BY rmse, model) AS rank, row_number() OVER (ORDER BY rmse, model) = 1 AS winner FROM s")
def official_holdout(spark, sf_dir):
    test, whole = a.truncated(spark, sf_dir)
    truth = datasets.endpoint_truth(datasets.ground_truth(test, whole))
    return experiments.official_holdout(plain_samples(spark, sf_dir), prefix.prefix_endpoints(test), truth, ["median", "condition_life_prior"], [])[1]


@query(f"WITH {TRAJ}, {SAMPLES}, {HOLDOUT} SELECT bearing, {r('greatest(0, coalesce(mc.l, mm.l) - age)', 'predicted_rul_seconds')}, 'ok' AS status, CAST(NULL AS VARCHAR) AS error_message FROM en CROSS JOIN mm LEFT JOIN mc USING (condition) WHERE {HALVES} = 0 UNION ALL SELECT bearing, NULL, 'error', 'rejected' FROM en WHERE {HALVES} = 1")
def saved_model_scoring(spark, sf_dir):
    """A model is fitted on all samples, saved, loaded, and scores the requests that were accepted."""
    path = shared(spark, "model")
    experiments.fit("condition_life_prior", plain_samples(spark, sf_dir), []).save(path)
    odd = F.substring("bearing", 2, 20).cast("long") % 2 == 1
    requests = prefix.prefix_endpoints(a.truncated(spark, sf_dir)[0]).select("bearing", "condition", "observed_age_seconds", F.when(odd, "rejected").otherwise("ok").alias("outcome"), F.when(odd, "rejected").alias("reason"))
    return experiments.score_requests(experiments.load(spark, path), requests).select("bearing", "predicted_rul_seconds", "status", "error_message")


# Monitoring.

COLS = ["rms_horiz", "kurtosis_vert", "crest_factor_horiz", "fft_band_2_vert"]
LIST = ", ".join(f"'{c}'" for c in COLS)
SIDES = f"ref AS (SELECT * FROM traj WHERE CAST(substr(bearing, 2) AS BIGINT) % 2 = 1), cur AS (SELECT * FROM traj WHERE CAST(substr(bearing, 2) AS BIGINT) % 2 = 0), ur AS (UNPIVOT (SELECT {', '.join(COLS)} FROM ref) ON {', '.join(COLS)} INTO NAME feature VALUE v), uc AS (UNPIVOT (SELECT {', '.join(COLS)} FROM cur) ON {', '.join(COLS)} INTO NAME feature VALUE v)"
RANGES = "rg AS (SELECT feature, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.99) AS p99 FROM ur GROUP BY feature)"


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = a.labelled(spark, sf_dir).withColumn("_side", F.substring("bearing", 2, 20).cast("long") % 2)
    return rows.where("_side = 1"), rows.where("_side = 0")


@query(f"WITH {TRAJ}, {SIDES}, {RANGES} SELECT feature, {r('p01', 'p01')}, {r('p99', 'p99')} FROM rg")
def reference_ranges(spark, sf_dir):
    return monitor.reference_ranges(sides(spark, sf_dir)[0], COLS)


@query(f"WITH {TRAJ}, {SIDES}, {RANGES} SELECT feature, {r('avg(CASE WHEN v < p01 OR v > p99 THEN 1 ELSE 0 END)', 'share_outside')} FROM uc JOIN rg USING (feature) GROUP BY feature")
def out_of_range(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    return monitor.out_of_range(cur, monitor.reference_ranges(ref, COLS), COLS)


@query(f"WITH {TRAJ}, {SIDES} SELECT side, count(v) AS count, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, min(v) AS min, quantile_cont(v, 0.5) AS median, max(v) AS max FROM (SELECT 'reference' AS side, rul_seconds AS v FROM ref UNION ALL SELECT 'current', rul_seconds FROM cur) GROUP BY side")
def prediction_sanity(spark, sf_dir):
    ref, cur = sides(spark, sf_dir)
    return monitor.sanity(ref, "rul_seconds", cur, "rul_seconds")


@query(f"WITH {TRAJ}, {SIDES} SELECT feature, count(*) AS n_rows, 0::BIGINT AS n_missing, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'std')}, {r('min(v)', 'min')}, {r('quantile_cont(v, 0.25)', 'p25')}, {r('quantile_cont(v, 0.5)', 'p50')}, {r('quantile_cont(v, 0.75)', 'p75')}, {r('max(v)', 'max')} FROM uc GROUP BY feature")
def data_summary(spark, sf_dir):
    return monitor.data_summary(sides(spark, sf_dir)[1], COLS)


KS = f"""k AS (SELECT feature, v, sum(sa) OVER (PARTITION BY feature ORDER BY v) AS fa, sum(sb) OVER (PARTITION BY feature ORDER BY v) AS fb, sum(sa) OVER (PARTITION BY feature) AS na, sum(sb) OVER (PARTITION BY feature) AS nb
    FROM (SELECT feature, v, sum(a) AS sa, sum(b) AS sb FROM (SELECT feature, v, 1 AS a, 0 AS b FROM ur UNION ALL SELECT feature, v, 0, 1 FROM uc) GROUP BY ALL)), ks AS (SELECT feature, max(na) AS na, max(nb) AS nb, max(abs(fa / na - fb / nb)) AS d FROM k GROUP BY feature),
    kx AS (SELECT *, (sqrt(na * nb / (na + nb)) + 0.12 + 0.11 / sqrt(na * nb / (na + nb))) * d AS x FROM ks), kp AS (SELECT feature, na, nb, d, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum([CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x) FOR j IN range(1, 101)]))) END AS p FROM kx)"""


@query(f"WITH {TRAJ}, {SIDES}, {KS} SELECT feature, {big('na', 'n_reference')}, {big('nb', 'n_current')}, {r('d', 'statistic')}, {r('p', 'p_value')}, p < 0.05 AS drifted FROM kp")
def drift_report(spark, sf_dir):
    return monitor.drift(*sides(spark, sf_dir), COLS)


@query(f"WITH {TRAJ}, {SIDES}, {KS} SELECT {r('avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END)', 'share')}, avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) > 0.5 AS failed FROM kp")
def drift_gate(spark, sf_dir):
    return monitor.drift_gate(monitor.drift(*sides(spark, sf_dir), COLS))


def sql_scenarios() -> str:
    """The drifted share of endpoints as they are and under each perturbation."""
    columns = catalog.prefix_columns()
    high = lambda c: f"(SELECT quantile_cont({c}, 0.99) FROM ref)"
    other = lambda c: c.replace("_horiz", "_vert") if "_horiz" in c else c.replace("_vert", "_horiz")
    made = {"none": {}, "amplitude": {c: f"4.0 * {high(c)}" for c in columns if c.endswith(monitor.RATIO_ENDINGS)}, "channel": {c: other(c) for c in columns if other(c) in columns}, "quality": dict.fromkeys(columns[:3], "-999.0::DOUBLE")}
    sides = " UNION ALL ".join(f"SELECT '{name}' AS scenario, {', '.join(f'CAST({new.get(c, c)} AS DOUBLE) AS {c}' for c in columns)} FROM cur" for name, new in made.items())
    return f"""WITH ep AS MATERIALIZED ({sql_prefix(True, plain)}), ref AS (SELECT * FROM ep WHERE CAST(substr(bearing, 2) AS BIGINT) % 2 = 1), cur AS (SELECT * FROM ep WHERE CAST(substr(bearing, 2) AS BIGINT) % 2 = 0), sc AS ({sides}),
    rl AS (UNPIVOT (SELECT {', '.join(columns)} FROM ref) ON {', '.join(columns)} INTO NAME name VALUE v), ur AS (SELECT s.scenario || ':' || name AS feature, v FROM rl, (SELECT unnest(['none', 'amplitude', 'channel', 'quality']) AS scenario) s),
    uc AS (SELECT scenario || ':' || name AS feature, v FROM (UNPIVOT (SELECT scenario, {', '.join(columns)} FROM sc) ON {', '.join(columns)} INTO NAME name VALUE v)), {KS}
    SELECT split_part(feature, ':', 1) AS scenario, {r('avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END)', 'share')} FROM kp GROUP BY 1"""


@query(sql_scenarios())
def drift_scenarios(spark, sf_dir):
    test = a.trajectories(spark, sf_dir)
    rows = prefix.prefix_endpoints(test).withColumn("_side", F.substring("bearing", 2, 20).cast("long") % 2)
    rows = kept(rows, "scenarios")
    ref, cur = rows.where("_side = 1"), rows.where("_side = 0")
    return monitor.scenario_report(ref, cur, catalog.prefix_columns(), monitor.ranges_of(monitor.reference_ranges(ref, catalog.prefix_columns())))


@query(f"WITH {a.SQL_LOG} SELECT strftime(date_trunc('day', requested_at), '%Y-%m-%d') AS bucket, count(*) AS requests, {r('quantile_cont(latency_ms, 0.5)', 'p50')}, {r('quantile_cont(latency_ms, 0.95)', 'p95')}, {r('100 * avg(CASE WHEN status = $$error$$ THEN 1 ELSE 0 END)', 'error_rate')} FROM log GROUP BY 1")
def log_dashboard(spark, sf_dir):
    return monitor.dashboard(a.prediction_log(spark, sf_dir), "1 day").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(f"WITH {a.SQL_LOG} SELECT {r('count(*) / greatest((epoch_us(max(requested_at)) - epoch_us(min(requested_at))) / 60000000.0E0, 1)', 'per_minute')} FROM log")
def log_throughput(spark, sf_dir):
    return monitor.throughput(a.prediction_log(spark, sf_dir))


@query(f"WITH {a.SQL_LOG} SELECT 'rul / ' || model_version || ' / champion' AS active_model FROM log ORDER BY requested_at DESC, request_id DESC LIMIT 1")
def active_model(spark, sf_dir):
    return monitor.active_model(a.prediction_log(spark, sf_dir))


@query(f"WITH {a.SQL_LOG} SELECT request_id, latency_ms FROM log WHERE status = 'ok' AND requested_at >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 36 HOURS")
def trailing_window(spark, sf_dir):
    from ..sources.tables import trailing

    return trailing(a.prediction_log(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "'36' HOUR", ["request_id", "latency_ms"])


@query("""WITH q AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_keys(props) AS names FROM events)
    SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN names = ['k'] AND k IS NOT NULL THEN 'ok' ELSE 'rejected' END AS outcome, k FROM q""")
def request_validation(spark, sf_dir):
    return monitor.parsed_requests(a.prediction_log(spark, sf_dir).select("request_id", "props"), "props", ["k"]).select("request_id", "outcome", "k")


@query("""WITH q AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT CAST(event_id AS VARCHAR) AS request_id, CASE WHEN k IS NULL THEN 'error' ELSE 'ok' END AS status, greatest(0.0, 60.0 - k) AS predicted_rul_seconds FROM q""")
def batch_scoring(spark, sf_dir):
    rows = monitor.parsed_requests(a.prediction_log(spark, sf_dir).select("request_id", "props"), "props", ["k"])
    return monitor.scored(rows, age="k", life=60.0).select("request_id", "status", "predicted_rul_seconds")


# Exploration.

@query(f"WITH {TRAJ} SELECT {big('condition', 'condition')}, bearing, count(*) AS snapshots, {big('min(file_index)', 'first_file')}, {big('max(file_index)', 'last_file')}, {r('(max(elapsed_time_seconds) - min(elapsed_time_seconds)) / 3600', 'run_hours')}, {r('min(rul_seconds) / 3600', 'min_rul_hours')}, {r('max(rul_seconds) / 3600', 'max_rul_hours')} FROM traj GROUP BY condition, bearing")
def run_summary(spark, sf_dir):
    return eda.run_summary(a.labelled(spark, sf_dir), ["condition", "bearing"])


@query(f"WITH {TRAJ} SELECT {big('condition', 'condition')}, count(DISTINCT bearing) AS n_entities, count(*) AS n_rows FROM traj GROUP BY condition")
def two_level_counts(spark, sf_dir):
    return eda.two_level_counts(a.trajectories(spark, sf_dir), ["condition"])


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN 'All' ELSE event_type END AS event_type, CASE WHEN grouping(u) = 1 THEN 'All' ELSE CAST(u AS VARCHAR) END AS u, count(*) AS n FROM (SELECT event_type, user_id % 3 AS u FROM events) GROUP BY CUBE (event_type, u)")
def crosstab(spark, sf_dir):
    return eda.crosstab(a.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("u")), "event_type", "u")


LI = ["l_quantity", "l_extendedprice", "l_discount"]
ULI = f"u AS (UNPIVOT (SELECT {', '.join(LI)} FROM lineitem) ON {', '.join(LI)} INTO NAME feature VALUE v)"


@query(f"WITH {ULI} SELECT feature, count(*) AS count, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, {', '.join(r(f'quantile_cont(v, {q})', f'p{round(100 * q):02d}') for q in eda.QUANTILES)}, max(v) AS max, round(skewness(v), 4) + 0.0 AS skew FROM u GROUP BY feature")
def described(spark, sf_dir):
    rows = eda.described(a.table(spark, sf_dir, "lineitem"), LI)
    return rows.withColumns({c: F.round(c, 4) + 0.0 for c in ("mean", "std", "skew")})


@query("SELECT (SELECT count(*) FROM lineitem) AS n_rows, 0::BIGINT AS missing_cells, 0::BIGINT AS rows_with_missing, 0::BIGINT AS infinite_cells, 0::BIGINT AS negative_targets, (SELECT CAST(count(*) AS BIGINT) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS repeated_rows, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS repeated_keys")
def quality_counts(spark, sf_dir):
    return eda.quality_counts(a.table(spark, sf_dir, "lineitem"), LI, ["l_orderkey", "l_linenumber"], "l_tax")


LC = [*LI, "l_tax"]
CORR = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM lineitem" for i, x in enumerate(LC) for y in LC[i + 1 :])


@query(f"SELECT a, b, {r('r', 'r')} FROM ({CORR})")
def correlations(spark, sf_dir):
    return eda.correlations(a.table(spark, sf_dir, "lineitem"), LC)


@query(f"SELECT a, b, {r('r', 'r')} FROM ({CORR}) ORDER BY abs(r) DESC, a, b LIMIT 3")
def strongest_pairs(spark, sf_dir):
    return eda.strongest_pairs(a.table(spark, sf_dir, "lineitem"), LC, 3)


@query(f"SELECT feature, {r('r', 'r')} FROM (SELECT a AS feature, b, r FROM ({CORR})) WHERE b = 'l_tax'")
def target_correlations(spark, sf_dir):
    return eda.correlation_with(a.table(spark, sf_dir, "lineitem"), LI, "l_tax")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf_dir):
    return eda.value_counts(a.table(spark, sf_dir, "events"), "event_type")


@query(f"WITH u AS (UNPIVOT (SELECT l_returnflag, {', '.join(LI)} FROM lineitem) ON {', '.join(LI)} INTO NAME feature VALUE v) SELECT l_returnflag, feature, min(v) AS low, {r('quantile_cont(v, 0.25)', 'q1')}, {r('quantile_cont(v, 0.5)', 'median')}, {r('quantile_cont(v, 0.75)', 'q3')}, max(v) AS high FROM u GROUP BY ALL")
def box_stats(spark, sf_dir):
    return eda.box_stats(a.table(spark, sf_dir, "lineitem"), LI, "l_returnflag")


@query("WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(49, floor((value - lo) / ((hi - lo) / 50))) AS BIGINT) AS bin, count(*) AS n FROM events, e GROUP BY 1")
def histogram(spark, sf_dir):
    return eda.histogram(a.table(spark, sf_dir, "events"), "value")


@query("SELECT 'event_type' AS feature, count(event_type) AS non_null, count(DISTINCT event_type) AS n_distinct, 'string' AS kind FROM events UNION ALL SELECT 'user_id', count(user_id), count(DISTINCT user_id), 'bigint' FROM events")
def profile(spark, sf_dir):
    return eda.profile(a.table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("SELECT event_id, value FROM events WHERE value <= (SELECT quantile_cont(value, 0.995) FROM events)")
def trimmed(spark, sf_dir):
    return eda.trimmed(a.table(spark, sf_dir, "events"), "value").select("event_id", "value")


@query()
def sampled(spark, sf_dir):
    return eda.sampled(a.table(spark, sf_dir, "events").select("event_id", "value"), 500, ["event_id"])


# Contracts.

@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return contracts.repeated_keys(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {TRAJ} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) FILTER (file_index % {5 + i} = 0) AS n_bad FROM traj" for i, c in enumerate(COLS)))
def finite_check(spark, sf_dir):
    rows = a.trajectories(spark, sf_dir)
    spoilt = {c: F.when(F.col("file_index") % (5 + i) == 0, F.lit(bad).cast("double")).otherwise(F.col(c)) for i, (c, bad) in enumerate(zip(COLS, (None, "nan", "inf", "-inf"), strict=True))}
    return contracts.not_finite(rows.withColumns(spoilt), COLS)


@query("WITH x AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup'), y AS (SELECT DISTINCT user_id FROM events WHERE value > 300) SELECT user_id, 'left' AS side FROM x WHERE user_id NOT IN (SELECT user_id FROM y) UNION ALL SELECT user_id, 'right' FROM y WHERE user_id NOT IN (SELECT user_id FROM x)")
def key_differences(spark, sf_dir):
    rows = a.table(spark, sf_dir, "events")
    return contracts.key_differences(rows.where("event_type = 'signup'"), rows.where("value > 300"), ["user_id"])


@query("WITH x AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS l_quantity, l_partkey FROM lineitem), m AS (SELECT l_quantity, max(l_partkey) AS m FROM x GROUP BY 1), g AS (SELECT l_quantity, unnest(range(1, m)) AS k FROM m) SELECT l_quantity, k AS missing FROM g ANTI JOIN x ON x.l_quantity = g.l_quantity AND x.l_partkey = g.k")
def number_gaps(spark, sf_dir):
    return contracts.gaps(a.table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long")), ["l_quantity"], "l_partkey")


@query(f"WITH {TRAJ} SELECT bearing, count(*) AS n_rows, count(*) FILTER (file_index % 11 = 0) AS n_missing, count(*) FILTER (file_index % 7 = 0 AND file_index % 11 <> 0) AS n_different, max(CASE WHEN file_index % 11 = 0 THEN NULL WHEN file_index % 7 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS largest FROM traj WHERE file_index <= floor(0.6 * n) GROUP BY bearing")
def prefix_of_complete_run(spark, sf_dir):
    test, whole = a.truncated(spark, sf_dir)
    # the complete runs lack some files and differ in others
    whole = whole.where(F.col("file_index") % 11 != 0).withColumn(COLS[0], F.col(COLS[0]) + F.when(F.col("file_index") % 7 == 0, 1.0).otherwise(0.0))
    return contracts.prefix_differences(test, whole, ["bearing", "file_index"], COLS)


def stored_trees(spark, sf_dir) -> tuple[str, str, DataFrame, DataFrame]:
    """Truncated and complete runs, of which every seventh machine lacks a file or differs in some, with their written digest trees."""
    test, whole = a.truncated(spark, sf_dir)
    odd = F.substring("bearing", 2, 20).cast("long") % 7 == 0
    whole = whole.where(~(odd & (F.col("file_index") % 11 == 0))).withColumn(COLS[0], F.col(COLS[0]) + F.when(odd & (F.col("file_index") % 5 == 0), 1.0).otherwise(0.0))
    root = shared(spark, "trees")
    for name, rows in (("test", test), ("whole", whole)):
        digests.write_tree(rows, f"{root}/{name}", ["bearing"], "file_index", COLS)
    return f"{root}/test", f"{root}/whole", test, whole


ODD = f"WITH {TRAJ}, o AS (SELECT *, CAST(substr(bearing, 2) AS BIGINT) % 7 = 0 AND file_index % 11 = 0 AS gone, CAST(substr(bearing, 2) AS BIGINT) % 7 = 0 AND file_index % 11 <> 0 AND file_index % 5 = 0 AS other FROM traj WHERE file_index <= floor(0.6 * n))"


@query(f"{ODD} SELECT bearing, count(*) AS n_files, count(*) FILTER (other) AS n_different, count(*) FILTER (gone) AS n_missing, min(file_index) FILTER (other OR gone)::BIGINT AS first_apart FROM o GROUP BY bearing")
def digest_prefix_check(spark, sf_dir):
    """Truncated against complete runs by their digest trees alone."""
    left, right, _, _ = stored_trees(spark, sf_dir)
    return digests.summary(spark, left, digests.differing(spark, left, right, ["bearing"], both=False), ["bearing"])


@query(f"{ODD} SELECT bearing, count(*) AS n_rows, count(*) FILTER (gone) AS n_missing, count(*) FILTER (other) AS n_different, max(CASE WHEN other THEN 1.0 END)::DOUBLE AS largest FROM o WHERE other OR gone GROUP BY bearing")
def digest_differences(spark, sf_dir):
    """The samples below a difference, compared by value; no others are read."""
    left, right, test, whole = stored_trees(spark, sf_dir)
    found = kept(digests.differing(spark, left, right, ["bearing"], both=False), "found")
    one, two = (digests.samples_of(rows, found, ["bearing"], "file_index") for rows in (test, whole))
    return contracts.prefix_differences(one, two, ["bearing", "file_index"], COLS)


@query(f"WITH {TRAJ}, v AS (SELECT 1 AS number, * FROM traj WHERE file_index <= floor(0.6 * n) UNION ALL SELECT 2, * FROM traj) SELECT number::BIGINT AS number, number = 2 AS newest, bearing, count(*) AS n_rows, max(file_index)::BIGINT AS last_file, {r('sum(rms_horiz)', 'rms_horiz')} FROM v GROUP BY ALL")
def table_versions(spark, sf_dir):
    """Two versions of the feature table and two refused ones between them; each published one is read by its number."""
    test, whole = a.truncated(spark, sf_dir)
    root, rules = shared(spark, "versions"), {"index from 1": F.col("file_index") >= 1}
    publish = lambda rows: versions.publish(rows, root, finite_columns=catalog.signal_columns(), rules=rules)
    publish(test)
    for bad in (test.unionByName(test), test.withColumn("rms_vert", F.when(F.col("file_index") > 1, F.col("rms_vert")))):
        try:
            publish(bad)
        except contracts.ContractError:
            continue
        raise AssertionError("a faulty version was published")
    last = publish(whole)
    rows = [versions.current(spark, root, n).withColumn("number", F.lit(n).cast("long")).withColumn("newest", F.lit(n == last)) for n in (1, last)]
    return rows[0].unionByName(rows[1]).groupBy("number", "newest", "bearing").agg(F.count(F.lit(1)).alias("n_rows"), F.max("file_index").alias("last_file"), F.sum("rms_horiz").alias("rms_horiz"))


@query("SELECT DISTINCT o_custkey AS bearing FROM orders WHERE o_totalprice > 300000 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 100000)")
def shared_entities(spark, sf_dir):
    rows = a.table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "bearing")
    return contracts.shared_entities(rows.where("o_totalprice > 300000"), rows.where("o_totalprice < 100000"))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, 'missing features' AS fault FROM events WHERE event_type <> 'error' AND value > 200")
def request_contract(spark, sf_dir):
    rows = a.prediction_log(spark, sf_dir).withColumn("feature", F.when(F.col("latency_ms") <= 200, F.col("latency_ms")))
    return contracts.request_faults(rows, ["feature"]).where("fault IS NOT NULL").select("request_id", "fault")


@query(f"WITH {TRAJ} SELECT bearing, {big('rn - 1', 'row')}, {r('rul_seconds', 'rul_seconds')} FROM (SELECT *, row_number() OVER (PARTITION BY bearing ORDER BY file_index) AS rn FROM traj) WHERE rn <= 3")
def first_rows(spark, sf_dir):
    w = Window.partitionBy("bearing").orderBy("file_index")
    return a.labelled(spark, sf_dir).withColumn("row", F.row_number().over(w) - 1).where("row < 3").select("bearing", "row", "rul_seconds")


# Streams: the events table read as a stream of files.

def event_log_stream(spark, sf_dir) -> DataFrame:
    schema = a.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return rows.select(F.col("event_id").cast("string").alias("request_id"), F.col("ts").cast("timestamp").alias("requested_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), F.col("value").cast("double").alias("latency_ms"), "props", "value")


@query()
def stream_dashboard(spark, sf_dir):
    from ..streaming import log

    out = shared(spark, "stream")
    log.run_to_end(log.dashboard(event_log_stream(spark, sf_dir), "1 day"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(ORACLES["batch_scoring"])
def stream_scoring(spark, sf_dir):
    from ..streaming import log

    out = shared(spark, "stream")
    log.run_to_end(log.scoring(event_log_stream(spark, sf_dir).drop("status"), "props", ["k"], age="k", life=60.0), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("request_id", "status", "predicted_rul_seconds")


@query()
def stream_trailing(spark, sf_dir):
    from ..streaming import log

    out = shared(spark, "stream")
    log.run_to_end(log.trailing(event_log_stream(spark, sf_dir), "6 hours", "3 hours"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query()
def stream_drift(spark, sf_dir):
    from ..streaming import log

    out = shared(spark, "stream")
    reference = a.table(spark, sf_dir, "events").where("user_id % 2 = 1").select("value")
    log.drift_per_batch(event_log_stream(spark, sf_dir).select("value"), reference, ["value"], f"{out}/rows", f"{out}/state").start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("batch").cast("long").alias("batch"), "share")


# The same in SQL: of windows that the watermark has closed.

def closed(late: str) -> str:
    return f"(SELECT max(requested_at) FROM log) - INTERVAL {late}"


ORACLES["stream_dashboard"] = f"WITH {a.SQL_LOG} SELECT strftime(d, '%Y-%m-%d') AS bucket, count(*) AS requests, {r('quantile_cont(latency_ms, 0.5)', 'p50')}, {r('quantile_cont(latency_ms, 0.95)', 'p95')}, {r('100 * avg(CASE WHEN status = $$error$$ THEN 1 ELSE 0 END)', 'error_rate')} FROM (SELECT *, date_trunc('day', requested_at) AS d FROM log) WHERE d + INTERVAL 1 DAY <= {closed('10 MINUTE')} GROUP BY d"
ORACLES["stream_trailing"] = f"""WITH {a.SQL_LOG}, w AS (SELECT time_bucket(INTERVAL 3 HOUR, requested_at) - k * INTERVAL 3 HOUR AS s, latency_ms FROM log, range(2) t(k) WHERE status = 'ok')
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS requests, {r('avg(latency_ms)', 'mean_latency')} FROM w WHERE s + INTERVAL 6 HOUR <= {closed('10 MINUTE')} GROUP BY s"""
EVENT_KS = f"ur AS (SELECT 'value' AS feature, CAST(value AS DOUBLE) AS v FROM events WHERE user_id % 2 = 1 AND value IS NOT NULL), uc AS (SELECT 'value' AS feature, CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL), {KS}"
ORACLES["stream_drift"] = f"WITH {EVENT_KS} SELECT 0::BIGINT AS batch, {r('avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END)', 'share')} FROM kp"

WINDOW_DRIFT = f"""WITH {a.SQL_LOG}, rv AS (SELECT CAST(value AS DOUBLE) AS v, count(*) AS n FROM events WHERE user_id % 2 = 1 AND value IS NOT NULL GROUP BY 1), rb AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS below, sum(n) OVER () AS total FROM rv),
    cu AS (SELECT v, (below + n) / total AS share, row_number() OVER (ORDER BY v) - 1 AS i FROM rb WHERE (below + n) * {windows.BINS} // total > below * {windows.BINS} // total), nr AS (SELECT max(total) AS nr FROM rb),
    x AS (SELECT date_trunc('day', requested_at) AS s, latency_ms AS v FROM log WHERE latency_ms IS NOT NULL), z AS (SELECT s, count(*) AS n FROM x GROUP BY s),
    g AS (SELECT z.s, any_value(z.n) AS n, any_value(cu.share) AS share, count(x.v) AS c FROM z CROSS JOIN cu LEFT JOIN x ON x.s = z.s AND x.v <= cu.v GROUP BY z.s, cu.i),
    d AS (SELECT s, max(n) AS n, max(abs(share - c / n)) AS d FROM g GROUP BY s), e AS (SELECT s, n, d, nr, (sqrt(nr * n / (nr + n)) + 0.12 + 0.11 / sqrt(nr * n / (nr + n))) * d AS x FROM d, nr),
    p AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, list_sum([CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * x * x) FOR j IN range(1, 101)]))) END AS p FROM e)
    SELECT strftime(s, '%Y-%m-%d') AS start, {big('nr', 'n_reference')}, {big('n', 'n_current')}, {r('d', 'statistic')}, {r('p', 'p_value')}, p < 0.05 AS drifted FROM p"""


def value_bins(spark, sf_dir) -> DataFrame:
    reference = a.table(spark, sf_dir, "events").where("user_id % 2 = 1").select(F.col("value").cast("double").alias("latency_ms"))
    return kept(windows.reference_bins(reference, ["latency_ms"]), "bins")


@query(WINDOW_DRIFT)
def drift_by_day(spark, sf_dir):
    log = a.prediction_log(spark, sf_dir).withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    return windows.drift_by_window(log, value_bins(spark, sf_dir), ["latency_ms"]).withColumn("start", F.date_format("start", "yyyy-MM-dd")).drop("feature")


@query(f"{WINDOW_DRIFT} WHERE s + INTERVAL 1 DAY <= {closed('10 MINUTE')}")
def stream_drift_by_day(spark, sf_dir):
    """The same for closed windows, from counts per bin that the stream keeps as its state."""
    from ..streaming import log

    out = shared(spark, "stream")
    log.drift_by_window(event_log_stream(spark, sf_dir), value_bins(spark, sf_dir), ["latency_ms"], f"{out}/rows", f"{out}/state").start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("start", F.date_format("start", "yyyy-MM-dd")).drop("feature", "batch")


@query(ORACLES["log_dashboard"])
def exact_log_dashboard(spark, sf_dir):
    """Quantiles over counts of values."""
    return windows.exact_dashboard(a.prediction_log(spark, sf_dir), "1 day").withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query(f"WITH {a.SQL_LOG} SELECT strftime(date_trunc('day', requested_at), '%Y-%m-%d') AS bucket, count(*) AS requests, {r('100 * avg(CASE WHEN status = $$error$$ THEN 1 ELSE 0 END)', 'error_rate')}, true AS p50_holds, true AS p95_holds FROM log GROUP BY 1")
def latency_rollup(spark, sf_dir):
    """Sketches of minutes merged to hours and those to days; whether the ranks of the quantiles are within the stated error."""
    log = a.prediction_log(spark, sf_dir)
    days = windows.dashboard_of(windows.rolled_up(windows.rolled_up(kept(windows.sketched(log), "sketches"), "1 hour"), "1 day"))
    days = kept(days, "days")
    off = windows.quantile_error(log, days, "1 day")
    rows = days.join(off, "bucket")
    return rows.select(F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "requests", "error_rate", (F.col("off_p50") <= windows.RANK_ERROR).alias("p50_holds"), (F.col("off_p95") <= windows.RANK_ERROR).alias("p95_holds"))


@query(f"""WITH {TRAJ}, {SAMPLES}, m AS (SELECT avg(y) AS my, avg(age) AS ma, stddev_pop(age) AS sa, covar_pop(age, y) AS cay, count(*) AS n FROM sm), q AS (SELECT CAST(event_id AS VARCHAR) AS request_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
    SELECT request_id, CASE WHEN k IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN k IS NOT NULL THEN round(greatest(0.0, my + n * cay / sa / (n + 10) * (k - ma) / sa), 4) + 0.0 END AS predicted_rul_seconds FROM q, m""")
def stream_model_scoring(spark, sf_dir):
    """A ridge is fitted as a pipeline of the library, saved, loaded by the stream, and scores the log's requests into two tables."""
    from ..streaming import log

    out = shared(spark, "stream")
    experiments.fit("ridge", plain_samples(spark, sf_dir), ["observed_age_seconds"]).save(f"{out}/model")
    log.model_scoring(event_log_stream(spark, sf_dir).drop("status"), f"{out}/model", "props", {"k": "observed_age_seconds"}, f"{out}/rows", f"{out}/bad", f"{out}/state").start().awaitTermination()
    both = spark.read.parquet(f"{out}/rows").unionByName(spark.read.parquet(f"{out}/bad"))
    return both.select("request_id", "status", F.round("predicted_rul_seconds", 4).alias("predicted_rul_seconds"))
