"""Mixing sources to target weights with soft domain membership.

A classifier learned from the labels table gives every document a posterior over three domains: clean (quality 1, not
toxic), toxic, and junk (the rest).  One half of the labelled rows gives every hashed word its evidence for toxic and
for junk text, a logarithm of odds where the difference is clear; the other half gives the naive Bayes tables of the
summed evidence and of binned shares of symbols, of distinct words and the mean length of words.

Projected-gradient least squares then fits a rate for every document, at least 0, so that the expected tokens of the
domains, sums of rate * tokens * posterior, are in the proportion of the targets; a small ridge holds rates near 1.  At
last all rates are multiplied so that a document that is of the leading domain by LEADING or more has a rate of 1 or
more: the total is what the shares ask for, and domains that are scarcer than their share get rates above 1.  A domain of which no document is
likeliest is exempt, since it has no tokens of its own; shares() reports asked, natural and reached shares and what is
exempt.  Documents with the same binned features have the same posterior and the same gradient per token, so the
iterations sum over a table of such cells, whose number depends on the bins and not on the corpus.

Everything is DataFrame expressions.  Labels with a null or repeated doc_id are ignored or counted once (their least
values); without any labels all posteriors are even.  A null or empty text has 0 tokens and rate 1 before the fit like
others; rows with repeated ids are rated each, equal texts alike; texts of any length are read whole; mix() carries the asked columns
alone and resampled() all, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

DOMAINS = ("clean", "toxic", "junk")
#: Shares of tokens that are asked for.
TARGETS = {"clean": 0.90, "toxic": 0.05, "junk": 0.05}
#: Slots of hashed words; about so many labelled rows, chosen by a hash of the id, give the words' evidence.
SLOTS, LABELLED = 1 << 14, 20_000
#: Rows with a word, standard errors between domains and ratio of shares from which the word is evidence; evidence of a bin.
#: Weaker words would add up to evidence in any long text.
LEAST_ROWS, CLEAR, RATIO, NATS = 3, 4.0, 3.0, 1.5
BINS = {"f_toxic": 12, "f_junk": 12, "f_symbols": 10, "f_distinct": 10, "f_length": 10}
STEPS, RIDGE = 40, 1e-3
#: Share of the leading domain from which a document's rate is at least 1, and the reciprocal of the largest lift.
LEADING, MOST_LIFT = 0.9, 0.25
SPACES = r"[\x20\x09-\x0D]+"


def domains_of(labels: DataFrame) -> DataFrame:
    """doc_id and domain number; one row for each labelled id."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2).alias("domain"))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def slots_of(text: Column) -> Column:
    """Hashed distinct words in lower case, without marks."""
    plain = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Punct}", " ")), SPACES)
    return F.transform(F.array_distinct(F.filter(plain, lambda w: w != "")), lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def first_half() -> Column:
    """Labelled rows that give evidence; the others give the tables of evidence."""
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0


def evidence(docs: DataFrame, domain: DataFrame) -> dict[str, list[float]]:
    """By slot, how far a word speaks for toxic and for junk text: log of odds where it is clear, else 0."""
    labelled = domain.count()
    chosen = domain.where(first_half()).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, 2 * LABELLED / max(1, labelled)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about LABELLED rows of two numbers
    of = lambda k: F.sum((F.col("domain") == k).cast("int")).alias(f"d{k}")
    found = rows.select("domain", F.explode(F.array_append(F.array_distinct(slots_of(F.col("text"))), F.lit(-1))).alias("slot")).groupBy("slot").agg(*map(of, range(len(DOMAINS)))).collect()  # at most SLOTS + 1 rows
    counts = {r["slot"]: [r[f"d{k}"] for k in range(len(DOMAINS))] for r in found}
    sizes = counts.pop(-1, [0] * len(DOMAINS))
    out = {}
    for k, name in enumerate(DOMAINS):
        yes, no, weights = sizes[k], sum(sizes) - sizes[k], [0.0] * SLOTS
        for slot, c in counts.items() if yes and no else ():
            p, q = (c[k] + 0.5) / (yes + 1), (sum(c) - c[k] + 0.5) / (no + 1)
            if c[k] >= LEAST_ROWS and p > RATIO * q and p - q > CLEAR * math.sqrt(p * (1 - p) / yes + q * (1 - q) / no):
                weights[slot] = round(math.log(p / q), 4)
        out[name] = weights
    return out


def features(docs: DataFrame, weights: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """The kept columns, n_tokens and the binned features of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, words_of(F.col("text")).alias("_words"), slots_of(F.col("text")).alias("_slots"), F.regexp_count(text, F.lit(r"[#*$%&|<>!]")).alias("_symbols"), F.char_length(text).alias("_chars"))
    rows = rows.withColumn("_distinct", F.size(F.array_distinct("_words")))
    capped = lambda x, name: F.least(F.lit(BINS[name] - 1), F.floor(x).cast("int")).alias(name)
    binned = lambda share, name: capped(F.coalesce(share, F.lit(0.0)) * BINS[name], name)
    # one constant array each, which the optimizer folds
    table = {k: F.from_json(F.lit(json.dumps(w)), "array<double>") for k, w in weights.items()}
    spoken = lambda k: F.aggregate("_slots", F.lit(0.0), lambda a, s: a + F.get(table[k], s))
    n = F.size("_words")
    return rows.select(
        *keep, n.cast("long").alias("n_tokens"), capped(spoken("toxic") / NATS, "f_toxic"), capped(spoken("junk") / NATS, "f_junk"),
        binned(F.sqrt(F.try_divide(F.col("_symbols").cast("double"), F.col("_chars"))), "f_symbols"),
        binned(F.try_divide(F.col("_distinct").cast("double"), n), "f_distinct"), binned(F.try_divide(F.col("_chars").cast("double"), n) / 16, "f_length"),
    )


def posteriors(rows: DataFrame, domain: DataFrame) -> DataFrame:
    """rows with p_<domain>, from counts of feature bins by domain (at most bins * domains numbers come to the driver)."""
    known = rows.select("doc_id", *BINS).join(domain.where(~first_half()), "doc_id")
    pairs = known.select("domain", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("bin")) for k in BINS))).alias("f"))
    counts = {(r["domain"], r["name"], r["bin"]): r["n"] for r in pairs.groupBy("domain", "f.name", "f.bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [sum(v for (d, name, _), v in counts.items() if d == k and name == "f_toxic") for k in range(len(DOMAINS))]
    logs = []
    for k in range(len(DOMAINS)):
        tables = [[math.log((counts.get((k, name, b), 0) + 0.5) / (sizes[k] + 0.5 * bins)) for b in range(bins)] for name, bins in BINS.items()]
        prior = math.log((sizes[k] + 1) / (sum(sizes) + len(DOMAINS)))
        logs.append(reduce(lambda a, b: a + b, (F.get(F.array(*map(F.lit, t)), F.col(name)) for t, name in zip(tables, BINS, strict=True)), F.lit(prior)))
    rows = rows.withColumn("_logs", F.array(*logs)).withColumn("_most", F.array_max("_logs"))
    rows = rows.withColumn("_parts", F.transform("_logs", lambda x: F.exp(x - F.col("_most")))).withColumn("_sum", F.aggregate("_parts", F.lit(0.0), lambda a, x: a + x))
    return rows.withColumns({f"p_{d}": F.get("_parts", F.lit(k)) / F.col("_sum") for k, d in enumerate(DOMAINS)}).drop("_logs", "_most", "_parts", "_sum")


def own_tokens() -> list[Column]:
    """By domain, whether there are tokens of a document that is likeliest of it."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    return [F.max((F.col("tokens") > 0) & (x >= F.greatest(*p))).alias(f"has{k}") for k, x in enumerate(p)]


def fit_rates(cells: DataFrame, targets: dict[str, float] = TARGETS) -> list[list[float]]:
    """The residuals of all steps, from which rate() makes a document's rate; cells has tokens and p_<domain>."""
    p = [F.col(f"p_{d}") for d in DOMAINS]
    first = cells.agg(F.sum("tokens").alias("all"), *(F.sum(F.col("tokens") * x).alias(f"s{k}") for k, x in enumerate(p)), *own_tokens()).first()
    if not first["all"]:
        return []
    total = float(first["all"])
    natural = [max(1e-9, first[f"s{k}"] / total) for k in range(len(DOMAINS))]
    weight = [targets[d] / sum(targets.values()) for d in DOMAINS]
    has = [first[f"has{k}"] for k in range(len(DOMAINS))]
    lead = max(range(len(DOMAINS)), key=lambda k: (has[k] and weight[k] > 0, weight[k]))
    size = natural[lead] / weight[lead]
    goals = [size * w if own else q for q, w, own in zip(natural, weight, has, strict=True)]
    residuals: list[list[float]] = []
    now = [first[f"s{k}"] / total for k in range(len(DOMAINS))]
    for _ in range(STEPS):
        # residuals over natural shares: rare domains close in as fast as the common one
        residuals.append([(s - g) / q for s, g, q in zip(now, goals, natural, strict=True)])
        r = rate(residuals, p)
        row = cells.agg(*(F.sum(F.col("tokens") * x * r).alias(f"s{k}") for k, x in enumerate(p))).first()
        now = [row[f"s{k}"] / total for k in range(len(DOMAINS))]
    return residuals


def lift(residuals: list[list[float]], targets: dict[str, float] = TARGETS) -> float:
    """What all rates are multiplied by, so that a document of the leading domain by LEADING or more has a rate of 1 or more."""
    lead, least = max(range(len(DOMAINS)), key=lambda k: targets[DOMAINS[k]]), 1.0
    for other in range(len(DOMAINS)):
        r, rest = 1.0, 0.0 if other == lead else 1 - LEADING
        for g in residuals:
            r = max(0.0, r - ((1 - rest) * g[lead] + rest * g[other] + RIDGE * (r - 1)) / (1 + RIDGE))
        least = min(least, r)
    return 1 / max(least, MOST_LIFT)


def rate(residuals: list[list[float]], p: list[Column]) -> Column:
    """A document's rate after the steps: projected at 0 after each of them."""
    if not residuals:
        return F.lit(1.0)
    step = 1 / (1 + RIDGE)
    held = F.array(*(F.array(*map(F.lit, g)) for g in residuals))
    move = lambda r, g: reduce(lambda a, k: a + F.get(g, F.lit(k)) * p[k], range(len(p)), RIDGE * (r - 1))
    return F.aggregate(held, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - step * move(r, g)))


def mix(docs: DataFrame, labels: DataFrame, keep: list[str], targets: dict[str, float] = TARGETS) -> DataFrame:
    """The kept columns (doc_id among them), n_tokens, p_<domain> and rate of every document."""
    domain = written(domains_of(labels), "mixing-domains")
    rows = written(features(docs, evidence(docs, domain), keep), "mixing-features")
    rows = posteriors(rows, domain)
    names = [f"p_{d}" for d in DOMAINS]
    cells = written(rows.groupBy(*BINS).agg(F.sum("n_tokens").alias("tokens"), *(F.first(c).alias(c) for c in names)), "mixing-cells")
    residuals = fit_rates(cells, targets)
    fitted = rate(residuals, [F.col(c) for c in names]) * lift(residuals, targets)
    return rows.select(*keep, "n_tokens", *(F.round(c, 9).alias(c) for c in names), F.round(fitted, 6).alias("rate"))


def shares(rows: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, the shares of tokens that are asked for, come by nature and are reached, and whether the domain is exempt, of rows as mix() returns them."""
    rows = rows.withColumn("tokens", F.col("n_tokens"))
    sums = rows.agg(*(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * r).alias(f"{name}_{d}") for d in DOMAINS for name, r in (("natural", F.lit(1.0)), ("reached", F.col("rate")))), *own_tokens())
    share = lambda name, d: F.try_divide(F.col(f"{name}_{d}"), reduce(lambda a, b: a + b, (F.col(f"{name}_{x}") for x in DOMAINS))).alias(name)
    parts = (F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / sum(targets.values())).alias("asked"), share("natural", d), share("reached", d), (~F.coalesce(F.col(f"has{k}"), F.lit(False))).alias("exempt")) for k, d in enumerate(DOMAINS))
    return sums.select(F.inline(F.array(*parts)))


def resampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more if a hash of the row falls under the rest."""
    rows, at = numbered(docs)
    rows = rows.withColumn("key", F.xxhash64(at["doc_id"], at["text"]))
    texts = rows.select(F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text"), "key")
    rates = mix(texts, labels, ["doc_id", "key"]).groupBy("key").agg(F.min("rate").alias("rate"))
    even = F.pmod(F.xxhash64(F.col("key"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.join(rates, "key").withColumn("copies", F.floor(F.col("rate") + even).cast("int")).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(c).alias(name) for name, c in at.items()))
