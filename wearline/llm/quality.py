"""Quality rules: base rules on counted statistics, and robust multivariate outliers per language and source.

Everything is DataFrame expressions.  statistics() counts on every whole text; verdicts() turns the counts into a
vector of shares, estimates centre and scatter per group by the minimum covariance determinant, and rejects documents
whose squared Mahalanobis distance is over CUTOFF.  Several starts (medians and deviations, lower quartiles and
deviations, means and covariances) each take STEPS concentration steps on the nearer HALF_SHARE of the group; the one
whose scatter has the smallest determinant stays.  Scatters have a floor, so that the determinant of a constant
statistic isn't 0.  Quantiles come from counts over fixed bins, so they don't depend on the order of rows and a group of any size
needs one bounded row per bin.

Rows meet their group's numbers by broadcast where there are at most FEW_GROUPS groups; beyond that the row of all
documents alone is broadcast, and frequent groups are dealt over pieces, so no join has all rows under one key.

The same is estimated for each language and for all documents, and a group's estimate is drawn towards its language's,
which is drawn towards all, by the weight of SHRINK documents: small groups need no rule of their own.

A null or empty text has zero counts and fails the base rules; null languages or sources form groups of their own;
repeated rows are judged each, and equal texts of a group alike; an empty table gives an empty table; texts of any
length are counted whole.  statistics() and kept_documents() pass other columns, whatever their names; columns named like
a new one are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, spread_join, written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Base rules: least words, and the largest percentage of words in repeated windows of SPAN words.
LEAST_WORDS, MOST_REPEATED, SPAN = 20, 30, 8
SHRINK, HALF_SHARE, STEPS = 50, 0.5, 3
#: Makes the scatter of the nearer half of a normal sample in 4 dimensions that of the whole sample.
CONSISTENCY = 2.11
#: Squared distance over which a document is an outlier; a chi-squared variable with 4 degrees exceeds it three times in 1e7.
CUTOFF = 36.0
#: Least deviation of each transformed statistic, so that a constant one doesn't make every other value an outlier.
FLOOR = {"x0": 0.05, "x1": 0.045, "x2": 0.15, "x3": 0.15}
DIMS = list(FLOOR)
BINS = 4096
#: Most groups whose estimates are broadcast: some 7 MB.
FEW_GROUPS = 1 << 14
#: The group of all documents.
ALL = "all"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words."""
    new = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    docs, place = numbered(docs.drop(*(c for c in new if c != text)))
    keep = [c for name, c in place.items() if name != text]
    body = F.coalesce(F.col(place[text]), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # each step names what later steps use more than once, so that it is worked out once
    rows = docs.select(*keep, F.filter(F.split(body, SPACES), lambda w: w != "").alias("_words"), F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("_lines"))
    rows = rows.select(
        *keep, "n_symbols", F.size("_words").cast("long").alias("n_words"), F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("_hashes") - SPAN), lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(SPAN))))
    rows = rows.withColumn("_windows", F.when(F.size("_hashes") > SPAN, windows)).drop("_hashes")
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    at = lambda k: F.get("_sorted", k)
    twice = F.filter("_sorted", lambda x, k: x["h"].eqNullSafe(at(k - 1)["h"]) | x["h"].eqNullSafe(at(k + 1)["h"]))
    rows = rows.withColumn("_places", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    step = F.aggregate(F.slice("_places", 2, F.size("_places")), F.struct(F.lit(SPAN).alias("sum"), F.get("_places", F.lit(0)).alias("last")), lambda a, p: F.struct((a["sum"] + F.least(F.lit(SPAN), p - a["last"])).alias("sum"), p.alias("last")))
    return rows.select(*(F.col(c).alias(name) for name, c in place.items() if name != text), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(step["sum"], F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The transformed statistics: each lies in [0, 4)."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "x0": F.least(F.lit(3.99), F.log1p(share("word_chars", "n_words"))), "x1": F.sqrt(F.least(F.lit(1.0), share("n_symbols", "word_chars"))),
        "x2": F.sqrt(share("n_dup_lines", "n_lines")), "x3": F.sqrt(share("n_repeat_words", "n_words")),
    }


def quantiles(rows: DataFrame, keys: list[str], values: dict[str, Column], shares: dict[str, float]) -> DataFrame:
    """Per group, <share name>_<value name>: below what a share of each column lies, from counts over bins of 4 / BINS (values in [0, 4))."""
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.floor(v * (BINS / 4)).cast("int").alias("bin")) for k, v in values.items())))
    counts = rows.select(*keys, bins.alias("b")).groupBy(*keys, "b.dim", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    at = counts.groupBy(*keys, "dim").agg(F.percentile("bin", F.array(*map(F.lit, shares.values())), F.col("n")).alias("at"))  # at most BINS counts
    return at.groupBy(*keys).agg(*((F.max(F.when(F.col("dim") == k, F.get("at", F.lit(i)))) * (4 / BINS) + 2 / BINS).alias(f"{name}_{k}") for k in values for i, name in enumerate(shares)))


def squeezed(distance: Column) -> Column:
    """A squared distance on a scale of [0, 4), finer near 0."""
    return F.least(F.lit(3.999), F.log1p(distance) / 5)


PLACES = range(len(DIMS))
PAIRS = [(i, j) for i in PLACES for j in range(i + 1)]
#: Names of an estimate's numbers: centre and scatter.
ESTIMATE = [*(f"m{i}" for i in PLACES), *(f"s{i}{j}" for i, j in PAIRS)]


def factored(estimates: DataFrame) -> DataFrame:
    """Estimates with the numbers l<i><j> of the factor, made one after the other."""
    for i, j in PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"s{i}{j}"))  # noqa: B023
        estimates = estimates.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    return estimates


def distance() -> Column:
    """Squared Mahalanobis distance of x0, x1, ... from the centre m<i> with the factor l<i><j>."""
    y: list[Column] = []
    for i, k in enumerate(DIMS):
        y.append(reduce(lambda a, j: a - F.col(f"l{i}{j}") * y[j], range(i), F.col(k) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))  # noqa: B023
    return reduce(lambda a, b: a + b, (v * v for v in y))


def moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Per group: n, centre and scatter (times scale, with the floors added)."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(k).alias(f"m{i}") for i, k in enumerate(DIMS)), *(F.avg(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"s{i}{j}") for i, j in PAIRS))
    floor = lambda i, j: FLOOR[DIMS[i]] ** 2 if i == j else 0.0
    return sums.withColumns({f"s{i}{j}": scale * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + floor(i, j) for i, j in PAIRS})


def met(rows: DataFrame, numbers: DataFrame, sizes: tuple[DataFrame, int], keys: list[str], how: str = "inner") -> DataFrame:
    """rows.join(numbers, keys, how) for one row of numbers per key; sizes are the rows of each group and the number of groups."""
    size, groups = sizes
    if groups <= FEW_GROUPS:
        return rows.join(F.broadcast(numbers), keys, how)
    every = F.col("group") == ALL
    dealt = numbers.where(~every).join(size.select("group", F.col("n").alias("_rows")), "group")
    others = spread_join(rows.where(~every), dealt, keys, "_rows", how=how).drop("_rows")
    return others.unionByName(rows.where(every).join(F.broadcast(numbers.where(every)), keys, how))


def starts(fit: DataFrame, sizes: tuple[DataFrame, int]) -> DataFrame:
    """Three estimates of each group to begin with, by start."""
    middle = written(quantiles(fit, ["group"], {k: F.col(k) for k in DIMS}, {"low": 0.25, "mid": 0.5}), "quality-fit")
    apart = quantiles(met(fit, middle, sizes, ["group"]), ["group"], {k: F.abs(F.col(k) - F.col(f"mid_{k}")) for k in DIMS}, {"off": 0.5})
    middle = middle.join(apart, "group")
    even = lambda name: [*(F.col(f"{name}_{k}").alias(f"m{i}") for i, k in enumerate(DIMS)), *((F.greatest(1.4826 * F.col(f"off_{DIMS[i]}"), F.lit(FLOOR[DIMS[i]])) ** 2 if i == j else F.lit(0.0)).alias(f"s{i}{j}") for i, j in PAIRS)]
    plain = moments(fit, ["group"], 1.0).select("group", F.lit("mean").alias("start"), *ESTIMATE)
    return reduce(lambda a, b: a.unionByName(b), (middle.select("group", F.lit(name).alias("start"), *even(name)) for name in ("mid", "low")), plain)


def estimates(fit: DataFrame, sizes: tuple[DataFrame, int]) -> DataFrame:
    """group, n, centre and scatter by the minimum covariance determinant."""
    held = written(starts(fit, sizes), "quality-fit")
    for _ in range(STEPS):
        numbers = factored(held).select("group", F.struct("start", *(f"m{i}" for i in PLACES), *(f"l{i}{j}" for i, j in PAIRS)).alias("e"))
        begun = numbers.groupBy("group").agg(F.collect_list("e").alias("e"))  # three starts
        near = met(fit, begun, sizes, ["group"]).select("group", *DIMS, F.explode("e").alias("e")).select("group", *DIMS, "e.*").select("group", "start", *DIMS, squeezed(distance()).alias("d"))
        limit = quantiles(near, ["group", "start"], {"d": F.col("d")}, {"limit": HALF_SHARE})
        held = written(moments(met(near, limit, sizes, ["group", "start"]).where(F.col("d") <= F.col("limit_d") + 4 / BINS), ["group", "start"], CONSISTENCY), "quality-fit")
    determinant = reduce(lambda a, i: a * F.col(f"l{i}{i}"), PLACES, F.lit(1.0))
    least = factored(held).groupBy("group").agg(F.min_by(F.struct(*ESTIMATE), F.struct(determinant, "start")).alias("e"))
    return least.join(sizes[0], "group").select("group", "n", "e.*")


def drawn_towards(own: DataFrame, other: DataFrame, at: str) -> DataFrame:
    """Estimates of own, and the group it belongs to in column at, drawn towards the estimate of that group by SHRINK documents."""
    other = other.select(F.col("group").alias(at), *(F.col(c).alias(f"o{c}") for c in ESTIMATE))
    rows = own.join(other, at)
    return rows.select(*(c for c in own.columns if c not in ESTIMATE), *(((F.col("n") * F.col(c) + SHRINK * F.col(f"o{c}")) / (F.col("n") + SHRINK)).alias(c) for c in ESTIMATE))


def verdicts(stats: DataFrame) -> DataFrame:
    """stats with distance2 (null if no document of its group passes the base rules), base_failed and kept; asks for lang, source and the counts."""
    rows, at = numbered(stats.drop("distance2", "base_failed", "kept"))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    rows = rows.withColumns({c: F.col(at[c]) for c in counts}).withColumns(vector())
    levels = F.array(F.to_json(F.struct(F.col(at["lang"]).alias("lang"), F.col(at["source"]).alias("source"))), F.to_json(F.struct(F.col(at["lang"]).alias("lang"))), F.lit(ALL))
    rows = written(rows.withColumn("levels", levels).withColumn("group", F.get("levels", F.lit(0))), "quality-statistics")
    good = rows.where(~base_failed())
    fit = good.select(F.explode("levels").alias("group"), *DIMS)
    size = written(fit.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "quality-fit")
    sizes = (size, size.count())
    found = written(estimates(fit, sizes), "quality-fit")
    names = good.select(F.col("group"), F.get("levels", F.lit(1)).alias("upper")).distinct()
    every = F.broadcast(found.where(F.col("group") == ALL))
    upper = drawn_towards(found.join(names.select(F.col("upper").alias("group")).distinct(), "group").withColumn("top", F.lit(ALL)), every, "top")
    held = factored(drawn_towards(found.join(names, "group"), upper, "upper")).select("group", *(f"m{i}" for i in PLACES), *(f"l{i}{j}" for i, j in PAIRS))
    judged = met(rows, written(held, "quality-fit"), sizes, ["group"], "left").withColumn("distance2", distance()).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance2") > CUTOFF, F.lit(False))
    return judged.select(*(F.col(c).alias(name) for name, c in at.items()), "distance2", "base_failed", kept.alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns as they were; rows with a repeated doc_id are judged each by its text."""
    rows, at = numbered(docs)
    key = F.xxhash64(at["doc_id"], at["text"])
    stats = statistics(rows.select(key.alias("key"), F.col(at["lang"]).alias("lang"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text")))
    good = verdicts(stats).where("kept").select("key").distinct()
    return rows.withColumn("key", key).join(good, "key", "left_semi").select(*(F.col(c).alias(name) for name, c in at.items()))
