"""Snapshot features: moments, crest factor and spectral bands of waveforms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.expressions import ratio, total, unbiased_kurtosis, unbiased_skewness


def rms(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def crest_factor(x: Column) -> Column:
    """Largest magnitude over rms; 0 for a silent signal."""
    return F.when(rms(x) == 0, F.lit(0.0)).otherwise(ratio(F.max(F.abs(x)), rms(x)))


def time_features(x: Column, suffix: str) -> list[Column]:
    """The four aggregates of a channel; population moments, excess kurtosis."""
    return [rms(x).alias(f"rms_{suffix}"), F.kurtosis(x).alias(f"kurtosis_{suffix}"), F.skewness(x).alias(f"skewness_{suffix}"), crest_factor(x).alias(f"crest_factor_{suffix}")]


def time_domain(samples: DataFrame, keys: list[str], channels: dict[str, str]) -> DataFrame:
    """One row per snapshot from one row per sample; channels: suffix to column.  Partial sums leave each task."""
    return samples.groupBy(*keys).agg(*(c for suffix, name in channels.items() for c in time_features(F.col(name), suffix)))


def extended_stats(channels: dict[str, str]) -> list[Column]:
    """Mean, sample deviation, extremes, spans and bias-corrected moments (kurtosis not in excess) of each channel."""
    out = []
    for s, name in channels.items():
        x = F.col(name)
        n = F.count(x)
        out += [
            F.avg(x).alias(f"{s}_mean"), F.stddev_samp(x).alias(f"{s}_std"), rms(x).alias(f"{s}_rms"), F.min(x).alias(f"{s}_min"), F.max(x).alias(f"{s}_max"),
            (F.max(x) - F.min(x)).alias(f"{s}_peak_to_peak"), F.max(F.abs(x)).alias(f"{s}_absolute_peak"),
            unbiased_skewness(F.skewness(x), n).alias(f"{s}_skewness"), unbiased_kurtosis(F.kurtosis(x), n).alias(f"{s}_kurtosis"),
            ratio(F.max(F.abs(x)), rms(x)).alias(f"{s}_crest_factor"),
        ]
    return out


def extended_time(samples: DataFrame, keys: list[str], channels: dict[str, str]) -> DataFrame:
    """extended_stats() per snapshot."""
    return samples.groupBy(*keys).agg(*extended_stats(channels))


def waveforms(samples: DataFrame, keys: list[str], position: str, channels: dict[str, str]) -> DataFrame:
    """Ordered arrays, one row per snapshot; a snapshot is a bounded recording."""
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), *(F.col(c).cast("double").alias(s) for s, c in channels.items())))).alias("_rows"))
    return rows.select(*keys, *(F.transform("_rows", lambda r: r[s]).alias(s) for s in channels))  # noqa: B023


def band_energy(bands: int = catalog.N_BANDS):
    """Arrow function of waveform arrays: energy |rfft|^2 / n in equal bands up to half the rate, the last one closed."""

    @F.pandas_udf("array<double>")
    def energy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for wave in batch:
                if wave is None or not len(wave):
                    out.append(None)
                    continue
                power = np.abs(np.fft.rfft(wave)) ** 2 / len(wave)
                place = np.minimum(2 * bands * np.arange(len(power)) // len(wave), bands - 1)  # whole numbers: no rounding at edges
                out.append(np.bincount(place, power, bands))
            yield pd.Series(out)

    return energy


def with_bands(waves: DataFrame, channels: list[str], bands: int = catalog.N_BANDS) -> DataFrame:
    """Adds fft_band_<i>_<channel> for each array column."""
    energy = band_energy(bands)
    rows = waves.withColumns({f"_e_{c}": energy(F.col(c)) for c in channels})
    return rows.select(*waves.columns, *(F.get(f"_e_{c}", F.lit(i)).alias(f"fft_band_{i}_{c}") for c in channels for i in range(bands)))


def band_energy_exact(wave: str, bands: int = catalog.N_BANDS) -> Column:
    """The same by array functions alone: a plain Fourier sum, quadratic in the length; for short waves and cross-checks."""
    n = F.size(wave)
    angle = lambda k, i: 2 * F.lit(float(np.pi)) * k * i / n
    part = lambda k, f: F.aggregate(F.transform(wave, lambda v, i: v.cast("double") * f(angle(k, i))), F.lit(0.0), lambda a, x: a + x)
    power = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), lambda k: F.struct(F.least(F.lit(bands - 1), F.floor(2 * bands * k / n).cast("int")).alias("b"), ((F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2)) / n).alias("p")))
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.aggregate(F.filter(power, lambda x: x["b"] == b), F.lit(0.0), lambda a, x: a + x["p"]))


def with_totals(frame: DataFrame) -> DataFrame:
    """Adds the total band energy of each channel."""
    return frame.withColumns({f"fft_total_{c}": total(catalog.band_columns(c)) for c in catalog.CHANNELS})


SPECTRUM = "dominant_frequency double, spectral_centroid double, total_energy double, bands array<double>, ratios array<double>"


def spectrum(rate_hz: float, edges: list[float]):
    """Arrow function: peak, centroid and half-open custom bands of the mean-free signal's |rfft|^2 without its constant part."""

    @F.pandas_udf(SPECTRUM)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["dominant_frequency", "spectral_centroid", "total_energy", "bands", "ratios"]
        for batch in batches:
            out = []
            for wave in batch:
                if wave is None or not len(wave):
                    out.append([None] * len(names))
                    continue
                x = np.asarray(wave, float)
                power = np.abs(np.fft.rfft(x - x.mean())) ** 2
                power[0] = 0
                f = np.fft.rfftfreq(len(x), 1 / rate_hz)
                all_ = power.sum()
                parts = [float(power[(f >= a) & (f < b)].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                out.append([float(f[np.argmax(power)]), float((f * power).sum() / all_) if all_ else 0.0, float(all_), parts, [p / all_ if all_ else 0.0 for p in parts]])
            yield pd.DataFrame(out, columns=names)

    return stats


def snapshot_features(samples: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """The 24 columns of each snapshot: moments by partial aggregation and bands from ordered arrays, in one grouping."""
    names = {"horiz": "horiz_accel_g", "vert": "vert_accel_g"}
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), *(F.col(c).alias(s) for s, c in names.items()))))
    rows = samples.groupBy(*keys).agg(*(c for s, name in names.items() for c in time_features(F.col(name), s)), ordered.alias("_rows"))
    rows = rows.withColumns({f"_{s}": F.transform("_rows", lambda r: r[s]) for s in names})  # noqa: B023
    energy = band_energy()
    rows = rows.withColumns({f"_e_{s}": energy(F.col(f"_{s}")) for s in names})
    rows = rows.withColumns({f"fft_band_{i}_{s}": F.get(f"_e_{s}", F.lit(i)) for s in names for i in range(catalog.N_BANDS)})
    return rows.select(*keys, *catalog.signal_columns())
