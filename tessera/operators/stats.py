"""Drift divergences, two-sample tests, Pareto frontiers and a small Gaussian process."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranking import numbered

from tessera.operators.evaluation import normal_cdf

BINS, PAD, SMOOTH = 50, 0.01, 1e-6


def histograms(reference: DataFrame, current: DataFrame, bins: int = BINS) -> DataFrame:
    """``(value)`` columns -> ``(bin, p, q)``: smoothed shares over the reference's range, padded by 1 % each side."""
    span = reference.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * PAD).otherwise(0.5)
    span = F.broadcast(span.select((F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")))  # one row
    at = F.least(F.greatest(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    sides = [df.filter("value is not null").crossJoin(span).groupBy(at).count().withColumnRenamed("count", n) for df, n in ((reference, "a"), (current, "b"))]
    every = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    both = every.join(sides[0], "bin", "left").join(sides[1], "bin", "left").na.fill(0)  # at most ``bins`` rows
    whole = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda c, t: (F.col(c) / F.col(t) + SMOOTH) / (1 + bins * SMOOTH)
    return both.crossJoin(F.broadcast(whole)).select("bin", share("a", "ta").alias("p"), share("b", "tb").alias("q"))


def psi(reference: DataFrame, current: DataFrame, bins: int = BINS) -> DataFrame:
    return histograms(reference, current, bins).agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def jensen_shannon(reference: DataFrame, current: DataFrame, bins: int = BINS) -> DataFrame:
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.sum(F.col(x) * F.log2(F.col(x) / m)) / 2
    return histograms(reference, current, bins).agg((half("p") + half("q")).alias("js"))


def wasserstein(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Mean gap of the sorted samples, interpolated onto the larger size's grid, over the padded reference range."""
    sides = []
    for df in (reference, current):
        sides.append(numbered(df.filter("value is not null").select("value"), ["value"], "i"))
    n = F.broadcast(sides[0].agg(F.count(F.lit(1)).alias("na")).crossJoin(sides[1].agg(F.count(F.lit(1)).alias("nb"))))
    larger = max(side.count() for side in sides)
    grid = reference.sparkSession.range(larger).select(F.col("id").alias("g")).crossJoin(n)  # one row of sizes
    size = F.greatest("na", "nb")
    out = grid
    for ranked, count, name in ((sides[0], "na", "a"), (sides[1], "nb", "b")):
        at = F.when(size > 1, F.col("g") * (F.col(count) - 1) / (size - 1)).otherwise(0.0)
        out = out.withColumn("at", at).withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at"))
        low, high = ranked.select(F.col("i").alias("lo"), F.col("value").alias("vl")), ranked.select(F.col("i").alias("hi"), F.col("value").alias("vh"))
        out = out.join(low, "lo").join(high, "hi").withColumn(name, F.col("vl") + (F.col("at") - F.col("lo")) * (F.col("vh") - F.col("vl"))).drop("at", "lo", "hi", "vl", "vh")
    span = reference.agg(F.min("value").alias("l"), F.max("value").alias("h")).select((F.when(F.col("h") > F.col("l"), (F.col("h") - F.col("l")) * (1 + 2 * PAD)).otherwise(1.0)).alias("span"))
    return out.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("gap")).crossJoin(span).select((F.col("gap") / F.col("span")).alias("wasserstein"))


def mann_whitney(rows: DataFrame) -> DataFrame:
    """``rows(side, value)`` with sides 0 and 1 -> ``(u, z, p)``: average ranks, tie correction, normal approximation.

    Ranks come from counts per distinct value, so a hot value is one row.
    """
    counted = rows.filter("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("side") == 0).cast("long")).alias("a"))
    before = F.coalesce(F.sum("t").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn("r", before + (F.col("t") + 1) / 2)
    got = ranked.agg(F.sum(F.col("a") * F.col("r")).alias("ra"), F.sum("a").cast("double").alias("na"), F.sum("t").cast("double").alias("n"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"))
    nb = F.col("n") - F.col("na")
    ua = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    u = F.least(ua, F.col("na") * nb - ua)
    var = F.col("na") * nb / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    z = F.when(var > 0, (u - F.col("na") * nb / 2) / F.sqrt(var)).otherwise(0.0)
    return got.select(u.alias("u"), z.alias("z"), F.least(F.lit(1.0), 2 * normal_cdf(z)).alias("p"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def welch_t(rows: DataFrame) -> dict[str, float]:
    """``rows(side, value)`` -> t, Satterthwaite's degrees of freedom and the two-sided p."""
    got = {r["side"]: r for r in rows.groupBy("side").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n")).collect()}
    a, b = got[0], got[1]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    if va + vb == 0:
        return {"t": 0.0, "df": a["n"] + b["n"] - 2.0, "p": 1.0}
    t = (a["m"] - b["m"]) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return {"t": t, "df": df, "p": _incomplete_beta(df / 2, 0.5, df / (df + t * t))}


def bootstrap_interval(values: list[float], iterations: int = 10_000, alpha: float = 0.05, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of the mean; the input's order does not matter."""
    x = np.sort(np.asarray(values, float))
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(iterations)])
    return float(np.quantile(means, alpha / 2)), float(np.quantile(means, 1 - alpha / 2))


def pareto_frontier(rows: DataFrame, objectives: list[str]) -> DataFrame:
    """Rows that no other row dominates (all objectives minimised; equal rows don't dominate each other).

    Candidates are first reduced inside each partition's worth of a hash bucket, then
    against the survivors of all, so the pairwise step sees frontier candidates only.
    """
    def undominated(df: DataFrame, extra: list[str]) -> DataFrame:
        other = df.select(*(F.col(o).alias(f"__o{i}") for i, o in enumerate(objectives)), *(F.col(e).alias(f"__{e}") for e in extra)).distinct()
        no_worse, better = F.lit(True), F.lit(False)
        for i, o in enumerate(objectives):
            no_worse, better = no_worse & (F.col(f"__o{i}") <= F.col(o)), better | (F.col(f"__o{i}") < F.col(o))
        for e in extra:
            no_worse = no_worse & (F.col(f"__{e}") == F.col(e))
        return df.join(other, no_worse & better, "left_anti")

    bucketed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*objectives), F.lit(64)))
    return undominated(undominated(bucketed, ["__bucket"]).drop("__bucket"), [])


def cosine_shift(reference: list[float], current: list[float]) -> float:
    """One less the cosine of two mean vectors; 0 if either is empty."""
    if not len(reference) or not len(current):
        return 0.0
    a, b = np.asarray(reference, float), np.asarray(current, float)
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return float(1 - a @ b / scale) if scale else 1.0


def projection_axis(dimensions: int, seed: int = 7) -> list[float]:
    """A random axis of unit length, the same for one seed; components are uniform before scaling."""
    raw = np.random.default_rng(seed).uniform(-1, 1, dimensions)
    return (raw / (np.linalg.norm(raw) or 1.0)).tolist()


def projected(vectors: DataFrame, axis: list[float]) -> DataFrame:
    """``vectors`` with a ``value``, the inner product with ``axis``, in double precision: the population that
    drift is told from.  A null vector or component gives null; components beyond the shorter of the two don't count."""
    fits = F.least(F.size("vector"), F.lit(len(axis)))
    pairs = F.zip_with(F.slice("vector", F.lit(1), fits), F.slice(F.array(*map(F.lit, axis)), F.lit(1), fits), lambda x, a: x.cast("double") * a)
    return vectors.withColumn("value", F.when(F.col("vector").isNotNull(), F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)))


def mean_pairwise_cosine(vectors: DataFrame) -> float:
    """The mean cosine over distinct pairs, from one sum: |sum of units|^2 less the count, halved.  Under two vectors: 1."""
    from tessera.functions.vectors import l2_normalise, norm

    units = vectors.filter(norm(F.col("vector")) > 0).select(F.posexplode(l2_normalise(F.col("vector"))).alias("lane", "x"))
    n = vectors.filter(F.col("vector").isNotNull()).count()
    if n < 2:
        return 1.0
    lanes = units.groupBy("lane").agg(F.sum("x").alias("s"))
    total = lanes.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0
    nonzero = vectors.filter(norm(F.col("vector")) > 0).count()
    return float((total - nonzero) / (n * (n - 1)))


class GaussianProcess:
    """RBF regression on a driver-side sample: posterior, expected improvement and a likelihood grid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, length: float = 1.0, scale: float = 1.0, noise: float = 1e-6):
        self.x, self.length, self.scale, self.noise = np.atleast_2d(np.asarray(x, float)), length, scale, noise
        self.y = np.asarray(y, float)
        gram = self.kernel(self.x, self.x) + noise * np.eye(len(self.x))
        for jitter in (0.0, 1e-10, 1e-9, 1e-8, 1e-7, 1e-6):
            try:
                self.chol = np.linalg.cholesky(gram + jitter * max(float(np.mean(np.diag(gram))), 1.0) * np.eye(len(gram)))
                break
            except np.linalg.LinAlgError:
                continue
        else:
            raise ValueError("the gram matrix is not positive definite")
        self.weights = np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, self.y))

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
        return self.scale**2 * np.exp(-gap / (2 * self.length**2))

    def posterior(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cross = self.kernel(np.atleast_2d(points), self.x)
        half = np.linalg.solve(self.chol, cross.T)
        return cross @ self.weights, np.maximum(self.scale**2 - (half**2).sum(0), 0.0)

    def expected_improvement(self, points: np.ndarray, best: float) -> np.ndarray:
        mean, var = self.posterior(points)
        sd = np.sqrt(var)
        z = np.divide(mean - best, sd, out=np.zeros_like(mean), where=sd >= 1e-12)
        cdf = np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z])
        pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return np.where(sd < 1e-12, 0.0, (mean - best) * cdf + sd * pdf)

    def log_likelihood(self) -> float:
        return float(-0.5 * self.y @ self.weights - np.log(np.diag(self.chol)).sum() - len(self.y) / 2 * math.log(2 * math.pi))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, lengths=(0.1, 0.3, 1.0, 3.0, 10.0), scales=(0.1, 0.3, 1.0, 3.0, 10.0), noises=(1e-6, 1e-4, 1e-2, 1e-1)) -> GaussianProcess:
        return max((cls(x, y, a, b, c) for a in lengths for b in scales for c in noises), key=cls.log_likelihood)
