"""Statistics: corrections of p-values, enrichment, heavy tails, comparisons of algorithms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laminet.functions.special import chi2_sf, fisher_column, gamma_q, nelder_mead, t_cdf, zeta
from laminet.session import cut

# Corrections: p-values by group


def holm(df: DataFrame, group: list[str], p: str = "p", alpha: float = 0.05, order: list[str] | None = None) -> DataFrame:
    """Adds significant: Holm's steps down, stopping at the first p > alpha / (m + 1 - k)."""
    w = Window.partitionBy(*group).orderBy(p, *(order or []))
    m = F.count("*").over(Window.partitionBy(*group))
    df = df.withColumn("_fail", (F.col(p) > alpha / (m + 1 - F.row_number().over(w))).cast("int"))
    return df.withColumn("significant", F.max("_fail").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_fail")


def fdr_stepwise(df: DataFrame, group: list[str], p: str = "p", q: float = 0.05, order: list[str] | None = None) -> DataFrame:
    """Adds significant: ascending p-values up to the first p > k q / m."""
    w = Window.partitionBy(*group).orderBy(p, *(order or []))
    m = F.count("*").over(Window.partitionBy(*group))
    df = df.withColumn("_fail", (F.col(p) > F.row_number().over(w) * q / m).cast("int"))
    return df.withColumn("significant", F.max("_fail").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 0).drop("_fail")


def benjamini_hochberg(df: DataFrame, group: list[str], p: str = "p", alpha: float = 0.05, order: list[str] | None = None) -> DataFrame:
    """Adds adjusted, the least of p m / k at its rank or above, and significant (adjusted <= alpha)."""
    w = Window.partitionBy(*group).orderBy(p, *(order or []))
    m = F.count("*").over(Window.partitionBy(*group))
    df = df.withColumn("_x", F.col(p) * m / F.row_number().over(w))
    back = Window.partitionBy(*group).orderBy(F.desc(p), *[F.desc(c) for c in order or []]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("adjusted", F.least(F.lit(1.0), F.min("_x").over(back))).withColumn("significant", F.col("adjusted") <= alpha).drop("_x")


def holm_sidak(df: DataFrame, group: list[str], p: str = "p", alpha: float = 0.05, order: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(p, *(order or []))
    m = F.count("*").over(Window.partitionBy(*group))
    df = df.withColumn("_x", 1 - F.pow(1 - F.col(p), m - F.row_number().over(w) + 1))
    return df.withColumn("adjusted", F.max("_x").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("significant", F.col("adjusted") <= alpha).drop("_x")


CORRECTIONS = {"fdr_bh": benjamini_hochberg, "holm": holm, "holm-sidak": holm_sidak, "fdr_stepwise": fdr_stepwise}

# Enrichment


def enrichment_counts(members: DataFrame, annotations: DataFrame) -> DataFrame:
    """members: (entity, partition); annotations: (entity, term), or (entity, terms), arrays of terms that go to their members whole.
    (partition, term, inside, outside, size, total) of the terms that a partition has: annotated members and others, the partition's members,
    all members."""
    if "terms" in annotations.columns:
        own = annotations.select("entity", "terms").repartition("entity").groupBy("entity").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        a = members.join(own, "entity").select("partition", F.explode("terms").alias("term"))
    else:
        a = members.join(annotations.select("entity", "term").distinct(), "entity")
    inside = cut(a.groupBy("partition", "term").agg(F.count("*").alias("inside")), "inside")
    every = inside.groupBy("term").agg(F.sum("inside").alias("annotated"))
    total = members.agg(F.count("*").alias("total")).withColumn("_j", F.lit(0))
    # Written, so that it is known to be small where it is: a join by partition would bring a partition's terms into one task.
    size = cut(members.groupBy("partition").agg(F.count("*").alias("size")).withColumn("_j", F.lit(0)).join(F.broadcast(total), "_j").drop("_j"), "sizes")
    out = inside.join(every, "term").join(size, "partition")
    return out.select("partition", "term", "inside", (F.col("annotated") - F.col("inside")).alias("outside"), "size", "total")


def ease_table(counts: DataFrame) -> DataFrame:
    """Cells a, b, c, d of the test: members with and without the term, one taken off those with it if there are more than one, others likewise."""
    a = F.when(F.col("inside") > 1, F.col("inside") - 1).otherwise(F.col("inside"))
    return counts.withColumns({"a": a, "b": F.col("size") - F.col("inside"), "c": F.col("outside"), "d": F.col("total") - F.col("size") - F.col("outside")})


def enrichment(members: DataFrame, annotations: DataFrame, alpha: float = 0.05, correction: str = "fdr_bh", only_significant: bool = True) -> DataFrame:
    """ease_table() with p (one for each partition and term), adjusted and significant within each partition."""
    if correction not in CORRECTIONS:
        raise ValueError(f"no correction {correction!r}")
    t = ease_table(enrichment_counts(members, annotations))
    t = t.withColumn("p", fisher_column()("a", "b", "c", "d"))
    out = CORRECTIONS[correction](t, ["partition"], "p", alpha, ["term"])
    return out.where("significant") if only_significant else out


# Distributions


def ccdf(df: DataFrame, value: str) -> DataFrame:
    """(x, n, cdf, ccdf): cdf is the share of values below x."""
    h = df.groupBy(F.col(value).alias("x")).agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return h.select("x", "n", (below / total).alias("cdf"), (1 - below / total).alias("ccdf"))


def log_bins(df: DataFrame, value: str, per_decade: int = 10) -> DataFrame:
    """(bin, n, density): logarithmic bins, bin = floor(per_decade * log10 x)."""
    b = F.floor(F.log10(F.col(value)) * per_decade + 1e-9).cast("long")
    h = df.where(F.col(value) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    width = F.pow(F.lit(10.0), (F.col("bin") + 1) / per_decade) - F.pow(F.lit(10.0), F.col("bin") / per_decade)
    return h.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy()) * width))


def linear_bins(df: DataFrame, value: str, width: float) -> DataFrame:
    return df.groupBy(F.floor(F.col(value) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def powerlaw_alpha(df: DataFrame, value: str, discrete: bool = True) -> DataFrame:
    """(xmin, n, alpha, sigma) for each distinct value as xmin: 1 + n / sum ln(x / (xmin - 1/2)), or over xmin if continuous.

    The sums over larger values come from running sums of the histogram, not from a join.
    """
    h = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("xmin")).agg(F.count("*").alias("k"))
    up = Window.orderBy(F.desc("xmin")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("xmin", F.sum("k").over(up).alias("n"), F.sum(F.col("k") * F.ln("xmin")).over(up).alias("logs"))
    low = F.ln(F.col("xmin") - 0.5) if discrete else F.ln("xmin")
    s = F.col("logs") - F.col("n") * low
    return h.where(s > 0).select("xmin", "n", (1 + F.col("n") / s).alias("alpha"), (F.sqrt("n") / s).alias("sigma"))


def powerlaw_fit(df: DataFrame, value: str, discrete: bool = True, least_tail: int = 10) -> dict:
    """xmin of the least Kolmogorov-Smirnov distance, with alpha, sigma and the distance. Works on the histogram, a row for each distinct value."""
    hist = df.where(F.col(value) > 0).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k"))
    fits = powerlaw_alpha(df, value, discrete).where(F.col("n") >= least_tail)
    pairs = fits.join(F.broadcast(hist.agg(F.sort_array(F.collect_list(F.struct("x", "k"))).alias("h")).withColumn("_j", F.lit(0))), F.lit(0) == F.col("_j"))

    @F.pandas_udf("double")
    def ks(xmin: pd.Series, alpha: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for m, a, rows in zip(xmin, alpha, h):
            x = np.array([(r["x"], r["k"]) for r in rows], float)
            x = x[x[:, 0] >= m]
            below = np.concatenate([[0], np.cumsum(x[:, 1])[:-1]]) / x[:, 1].sum()
            theory = np.array([1 - zeta(a, v) / zeta(a, m) for v in x[:, 0]]) if discrete else 1 - (x[:, 0] / m) ** (1 - a)
            out.append(float(np.abs(below - theory).max()))
        return pd.Series(out)

    best = pairs.select("xmin", "n", "alpha", "sigma", ks("xmin", "alpha", "h").alias("d")).orderBy("d", "xmin").first()
    return best.asDict() if best else {}


def ks_statistics(data: np.ndarray, cdf) -> dict:
    """D, its two one-sided parts, Kuiper's V, Kappa and the weighted A^2 of sorted data against a cdf."""
    x = np.sort(np.asarray(data, float))
    n = len(x)
    theory = np.array([cdf(v) for v in x])
    lower, upper = np.arange(n) / n, np.arange(1, n + 1) / n
    plus, minus = float((upper - theory).max()), float((theory - lower).max())
    inside = np.clip(theory, 1e-12, 1 - 1e-12)
    a2 = float(((lower - theory) ** 2 / (inside * (1 - inside))).mean())
    return {"D": max(plus, minus), "D_plus": plus, "D_minus": minus, "V": plus + minus, "Kappa": 1 + float((theory - lower).mean()), "Asquare": a2}


def _stretched(x, p, m):
    lam, beta = abs(p[0]) + 1e-12, abs(p[1]) + 1e-12
    return math.log(beta * lam) + (beta - 1) * np.log(x * lam) - (lam * x) ** beta + (lam * m) ** beta


def _lognormal(x, p, m):
    mu, s = p[0], abs(p[1]) + 1e-9
    tail = 0.5 * math.erfc((math.log(m) - mu) / (s * math.sqrt(2)))
    return -np.log(x * s * math.sqrt(2 * math.pi)) - (np.log(x) - mu) ** 2 / (2 * s * s) - math.log(max(tail, 1e-300))


def _truncated(x, p, m):
    a, lam = p[0], abs(p[1]) + 1e-9
    grid = m * np.exp(np.linspace(0, math.log(1 + 60 / (lam * m)), 2000))
    mass = np.trapezoid(grid**-a * np.exp(-lam * grid), grid)
    return -a * np.log(x) - lam * x - math.log(max(mass, 1e-300))


def _gamma(x, p, m):
    k, theta = abs(p[0]) + 1e-9, abs(p[1]) + 1e-9
    return (k - 1) * np.log(x) - x / theta - math.lgamma(k) - k * math.log(theta) - math.log(max(gamma_q(k, m / theta), 1e-300))


def _negative_binomial(x, p, m):
    r, q = abs(p[0]) + 1e-9, 1 / (1 + math.exp(-p[1]))
    pmf = lambda k: math.lgamma(k + r) - math.lgamma(k + 1) - math.lgamma(r) + r * math.log(q) + k * math.log(max(1 - q, 1e-300))
    tail = 1 - sum(math.exp(pmf(k)) for k in range(int(m)))
    return np.array([pmf(v) for v in x]) - math.log(max(tail, 1e-300))


#: Log densities of x >= xmin with starting parameters by family.
FAMILIES = {
    "power_law": (lambda x, p, m: math.log(max(p[0] - 1, 1e-12)) - math.log(m) - p[0] * np.log(x / m), lambda x, m: [1 + len(x) / max(1e-9, float(np.log(x / m).sum()))]),
    "exponential": (lambda x, p, m: math.log(abs(p[0]) + 1e-300) - abs(p[0]) * (x - m), lambda x, m: [1 / max(1e-9, float(x.mean() - m))]),
    "stretched_exponential": (_stretched, lambda x, m: [1 / float(x.mean()), 0.8]),
    "lognormal": (_lognormal, lambda x, m: [float(np.log(x).mean()), float(np.log(x).std()) + 0.1]),
    "lognormal_positive": (lambda x, p, m: _lognormal(x, [abs(p[0]), p[1]], m), lambda x, m: [abs(float(np.log(x).mean())), float(np.log(x).std()) + 0.1]),
    "truncated_power_law": (_truncated, lambda x, m: [1.5, 1 / float(x.mean())]),
    "gamma": (_gamma, lambda x, m: [1.0, float(x.mean())]),
    "negative_binomial": (_negative_binomial, lambda x, m: [1.0, -1.0]),
}


def fit_family(x: np.ndarray, family: str, xmin: float) -> tuple[list[float], np.ndarray]:
    """Parameters of greatest likelihood and the log density of each x >= xmin."""
    if family not in FAMILIES:
        raise ValueError(f"no family {family!r}")
    f, start = FAMILIES[family]
    x = np.asarray(x, float)
    x = x[x >= xmin]
    p = nelder_mead(lambda q: -float(f(x, q, xmin).sum()), start(x, xmin))
    return p, f(x, p, xmin)


def likelihood_ratio(a: np.ndarray, b: np.ndarray, nested: bool = False) -> tuple[float, float]:
    """R = sum(a - b) of log densities, and p: that R is 0 by a normal test, or by chi-squared where one family holds the other."""
    d = np.asarray(a) - np.asarray(b)
    r = float(d.sum())
    if nested:
        return r, chi2_sf(2 * abs(r), 1)
    sigma = float(d.std())
    return r, math.erfc(abs(r) / math.sqrt(2 * len(d)) / sigma) if sigma > 0 else 1.0


def loglik_ratio(df: DataFrame, value: str, xmin: float) -> DataFrame:
    """One row (n, r, s2): continuous power law against exponential, both of greatest likelihood over x >= xmin: R and the variance of its terms."""
    x = df.where(F.col(value) >= xmin).select(F.col(value).cast("double").alias("x"))
    m = x.agg(F.count("*").alias("n"), (1 + F.count("*") / F.sum(F.ln(F.col("x") / xmin))).alias("a"), (1 / (F.avg("x") - xmin)).alias("lam")).withColumn("_j", F.lit(0))
    d = F.ln((F.col("a") - 1) / xmin) - F.col("a") * F.ln(F.col("x") / xmin) - F.ln("lam") + F.col("lam") * (F.col("x") - xmin)
    return x.withColumn("_j", F.lit(0)).join(F.broadcast(m), "_j").select("n", d.alias("d")).groupBy("n").agg(F.sum("d").alias("r"), F.var_pop("d").alias("s2"))


def sample_powerlaw(spark, n: int, alpha: float, xmin: float = 1.0, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", (xmin * F.pow(1 - F.rand(seed), F.lit(-1 / (alpha - 1)))).alias("x"))


# Comparing algorithms


def mean_ranks(scores: DataFrame, dataset: str = "dataset", algorithm: str = "algorithm", score: str = "score") -> DataFrame:
    """(algorithm, mean_rank, datasets): the best score of a data set has rank 1; ties by name."""
    r = F.row_number().over(Window.partitionBy(dataset).orderBy(F.desc(score), algorithm))
    return scores.withColumn("_r", r).groupBy(algorithm).agg(F.avg("_r").alias("mean_rank"), F.count("*").alias("datasets"))


def critical_groups(ranks: DataFrame, distance: float) -> DataFrame:
    """(low, high): greatest intervals of mean ranks less than distance wide that hold two algorithms or more."""
    r = ranks.select(F.col("mean_rank").alias("r"))
    spans = r.toDF("low").join(r.toDF("high"), (F.col("high") > F.col("low")) & (F.col("high") - F.col("low") < distance)).groupBy("low").agg(F.max("high").alias("high"))
    inside = spans.toDF("a", "b").join(spans, (F.col("low") <= F.col("a")) & (F.col("b") <= F.col("high")) & ((F.col("low") < F.col("a")) | (F.col("b") < F.col("high"))), "left_anti")
    return inside.toDF("low", "high")


def sign_counts(pairs: DataFrame, a: str, b: str, rope: float) -> DataFrame:
    d = F.col(a) - F.col(b)
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.agg(one(d < -rope).alias("n_left"), one((d >= -rope) & (d <= rope)).alias("n_rope"), one(d > rope).alias("n_right"))


def correlated_ttest(x: np.ndarray, rope: float, runs: int = 1) -> tuple[float, float, float]:
    """Posterior shares below, within and above the rope of the mean difference of correlated folds."""
    x = np.asarray(x, float)
    n, folds = len(x), len(x) / runs
    scale = float(x.var(ddof=1)) * (1 / n + 1 / (folds - 1))
    if scale == 0:
        m = float(x.mean())
        return float(m < -rope), float(-rope <= m <= rope), float(m > rope)
    at = lambda v: t_cdf((v - float(x.mean())) / math.sqrt(scale), n - 1)
    return at(-rope), at(rope) - at(-rope), 1 - at(rope)


def sign_test(left: int, rope: int, right: int, prior: float = 1.0, draws: int = 50_000, seed: int = 1) -> tuple[float, float, float]:
    """How often each of the three is most probable under a Dirichlet posterior (the prior weight goes to the rope)."""
    p = np.random.default_rng(seed).dirichlet([left + 1e-6, rope + prior, right + 1e-6], draws)
    won = np.bincount(p.argmax(1), minlength=3) / draws
    return tuple(float(v) for v in won)


def signed_rank(x: np.ndarray, rope: float, prior: float = 0.6, draws: int = 20_000, seed: int = 1) -> tuple[float, float, float]:
    """As sign_test, over all pairwise means of differences weighted by a Dirichlet over observations (the prior observation is 0)."""
    z = np.concatenate([[0.0], np.asarray(x, float)])
    means = (z[:, None] + z[None]) / 2
    side = np.stack([means < -rope, np.abs(means) <= rope, means > rope]).astype(float)
    rng, out = np.random.default_rng(seed), np.zeros(3)
    weights = rng.dirichlet([prior] + [1.0] * (len(z) - 1), draws)
    for w in weights:
        out[np.argmax([w @ s @ w for s in side])] += 1
    return tuple(out / draws)


def zscore(df: DataFrame, value: str, group: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(group or []))
    return (F.col(value) - F.avg(value).over(w)) / F.stddev_pop(value).over(w)


def benchmark_pivot(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    return df.groupBy(row).pivot(col).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
