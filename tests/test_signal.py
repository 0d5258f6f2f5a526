import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.operators import signal


def samples(spark, values):
    return spark.createDataFrame([(1, i, float(v), float(v)) for i, v in enumerate(values)], "id int, position int, horiz_accel_g double, vert_accel_g double")


def features(spark, values):
    return signal.time_domain(samples(spark, values), ["id"], {"horiz": "horiz_accel_g"}).first()


def test_constant_has_its_rms_and_null_moments(spark):
    row = features(spark, [3.0] * 100)
    assert row.rms_horiz == pytest.approx(3.0)
    assert row.kurtosis_horiz is None


def test_sine_rms(spark):
    row = features(spark, 2 * np.sin(2 * np.pi * 50 * np.arange(1000) / 1000))
    assert row.rms_horiz == pytest.approx(2 / np.sqrt(2), abs=1e-3)


def test_gaussian_moments_are_near_zero(spark):
    row = features(spark, np.random.default_rng(0).normal(size=20_000))
    assert abs(row.kurtosis_horiz) < 0.1 and abs(row.skewness_horiz) < 0.05


def test_crest_factor(spark):
    assert features(spark, [0.0] * 999 + [10.0]).crest_factor_horiz == pytest.approx(10 / np.sqrt(0.1))
    assert features(spark, [0.0] * 100).crest_factor_horiz == 0.0


def waves(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "id int, wave array<double>")


def test_pure_tone_lies_in_its_band(spark):
    tone = np.sin(2 * np.pi * 2000 * np.arange(2560) / 25_600)
    row = signal.with_bands(waves(spark, [tone]), ["wave"]).first()
    bands = [row[f"fft_band_{i}_wave"] for i in range(8)]
    assert bands[1] / sum(bands) > 0.9


def test_band_energy_has_the_one_sided_power_and_equals_the_native_form(spark):
    rng = np.random.default_rng(1)
    rows = [rng.normal(size=n) for n in (16, 17, 64)]
    df = signal.with_bands(waves(spark, rows), ["wave"]).withColumn("e", signal.band_energy_exact("wave")).orderBy("id")
    for r, wave in zip(df.collect(), rows, strict=True):
        bands = [r[f"fft_band_{i}_wave"] for i in range(8)]
        assert sum(bands) == pytest.approx((np.abs(np.fft.rfft(wave)) ** 2 / len(wave)).sum())
        assert bands == pytest.approx(list(r.e), abs=1e-9)


def test_empty_and_null_waves_have_no_bands(spark):
    df = spark.createDataFrame([(0, None), (1, [])], "id int, wave array<double>")
    assert all(r["fft_band_0_wave"] is None for r in signal.with_bands(df, ["wave"]).collect())


def test_snapshot_features_have_24_columns(spark):
    t = np.arange(64)
    rows = [(1, int(i), float(np.sin(2 * np.pi * i / 16)), float(np.cos(2 * np.pi * i / 13))) for i in t]
    df = signal.snapshot_features(spark.createDataFrame(rows, "id int, position int, horiz_accel_g double, vert_accel_g double"), ["id"])
    row = df.first()
    assert len(df.columns) == 25 and all(v is not None for v in row)
    wave = np.sin(2 * np.pi * t / 16)
    assert sum(row[f"fft_band_{i}_horiz"] for i in range(8)) == pytest.approx((np.abs(np.fft.rfft(wave)) ** 2 / 64).sum())


def test_spectrum(spark):
    wave = 5 + np.sin(2 * np.pi * 2000 * np.arange(256) / 25_600)
    row = waves(spark, [wave]).select(signal.spectrum(25_600.0, [0.0, 1000.0, 12_800.0])("wave").alias("s")).select("s.*").first()
    assert row.dominant_frequency == 2000.0 and row.ratios[1] > 0.9


def test_extended_statistics_are_bias_corrected(spark):
    x = np.random.default_rng(2).gamma(2, size=50)
    row = signal.extended_time(samples(spark, x), ["id"], {"h": "horiz_accel_g"}).first()
    n, d = len(x), x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    assert row.h_skewness == pytest.approx(np.sqrt(n * (n - 1)) / (n - 2) * g1)
    assert row.h_std == pytest.approx(x.std(ddof=1)) and row.h_peak_to_peak == pytest.approx(np.ptp(x))
    assert F.lit(1) is not None
