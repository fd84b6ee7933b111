"""Thresholds from the data: cuts between good and bad matches for each metric of a table of matches.

Values are first counted, so every figure comes from (value, count). Quantiles, fences, the histogram split and the knee are
exact; density and mixture come from counts, means and spreads in BINS equal bins, which is all that reaches the driver,
whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.quantiles import quantiles
from roadweave.plans.scratch import Scratch

#: Metrics with their better direction and the limit that a recommendation is for; names of methods.
DEFAULT_METRICS = {"dtw_distance": "lower", "bearing_diff": "lower", "overlap_pct": "higher"}
LIMIT_NAMES = {"dtw_distance": "max_match_dist", "bearing_diff": "max_bearing_diff", "overlap_pct": "min_overlap_pct"}
METHODS = ("iqr_fence", "mad_fence", "percentile", "otsu", "kde_valley", "gmm_crossover", "kneedle", "iforest")
BINS, OTSU, GRID, VALLEY, CAP = 1 << 16, 256, 512, 1.3, 99.5


def counted(df: DataFrame, metric: str, mirrored: bool = False) -> DataFrame:
    """(v, n) of the finite values of matched rows; mirrored: 100 less the value."""
    rows = df.where(F.col("match_type") != "NO_MATCH") if "match_type" in df.columns else df
    v = F.col(metric).cast("double")
    rows = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select((100.0 - v if mirrored else v).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def spread(values: DataFrame, *more: float) -> dict[str, float]:
    """Exact quantiles and moments of (v, n); more: further percentages."""
    q = [25, 50, 75, 90, 95, 97.5, 99, CAP, *more]
    r = values.agg(F.sum("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")).first()
    if not r.n:
        return {"n": 0}
    out = {f"p{p:g}": v for p, v in zip(q, quantiles(values, [p / 100 for p in q]), strict=True)} | {"n": r.n, "min": r.min, "max": r.max, "mean": r.mean}
    off = F.col("v") - out["mean"]
    square = values.agg(F.sum(off * off * F.col("n"))).first()[0]
    mad = quantiles(values.select(F.abs(F.col("v") - out["p50"]).alias("v"), "n"), [0.5])[0]
    return out | {"mad": mad, "std": math.sqrt(square / out["n"])}


def mad_fence(s: dict[str, float], k: float = 3.0) -> float:
    return s["p50"] + k * (1.4826 * s["mad"] if s["mad"] > 0 else s["std"])


def iqr_fence(s: dict[str, float], k: float = 1.5) -> float:
    width = s["p75"] - s["p25"]
    if width > 0:
        return s["p75"] + k * width
    fence = mad_fence(s)
    return fence if fence > s["p75"] else s["p97.5"]


class Binned:
    """Capped values in BINS equal bins: counts, means and squared deviations of each, and the moments of the whole."""

    def __init__(self, values: DataFrame, s: dict[str, float]):
        self.lo, self.hi = s["min"], s[f"p{CAP:g}"] if s[f"p{CAP:g}"] > s["min"] else s["max"]
        v = F.least("v", F.lit(self.hi))
        self.flat = not self.hi > self.lo
        bin_ = F.lit(0) if self.flat else F.least(F.floor((F.col("v") - self.lo) / (self.hi - self.lo) * BINS), F.lit(BINS - 1)).cast("int")
        self.rows = values.select(v.alias("v"), "n").withColumn("bin", bin_)
        mean = self.rows.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("square"))
        got = sorted((r.bin, r.n, r.mean, r.square) for r in mean.collect())  # at most BINS rows
        self.bin = np.array([r[0] for r in got], np.int64)
        self.n, self.mean = (np.array([r[k] for r in got], float) for k in (1, 2))
        self.inner = np.maximum(np.array([r[3] for r in got], float) - self.n * self.mean**2, 0.0)
        self.total = self.n.sum()
        centre = (self.n * self.mean).sum() / self.total
        self.var = float((self.n * (self.mean - centre) ** 2 + self.inner).sum() / self.total)
        self.q1, self.median, self.q3 = quantiles(self.rows, [0.25, 0.5, 0.75])


def otsu(b: Binned) -> float | None:
    """The middle of the bin, of OTSU, whose end splits the values with the largest variance between both sides."""
    if b.flat or b.total < 2:
        return None
    share = np.bincount(b.bin * OTSU // BINS, weights=b.n, minlength=OTSU) / b.total
    middle = b.lo + (np.arange(OTSU) + 0.5) * (b.hi - b.lo) / OTSU
    below = np.cumsum(share)
    moment = np.cumsum(share * middle)
    apart = below * (1 - below)
    gain = np.where(apart > 1e-12, (moment[-1] * below - moment) ** 2 / np.where(apart > 1e-12, apart, 1.0), -1.0)
    return float(middle[gain.argmax()])


def density(b: Binned) -> tuple[np.ndarray, np.ndarray]:
    """(grid, density): a normal kernel of the usual width for the smaller of spread and quartile distance."""
    none = np.empty(0), np.empty(0)
    if b.flat or b.total < 2:
        return none
    spread_, quartiles = math.sqrt(b.var * b.total / (b.total - 1)), (b.q3 - b.q1) / 1.349
    width = 0.9 * (min(spread_, quartiles) if quartiles > 0 else spread_) * b.total**-0.2
    if width <= 0:
        return none
    grid = np.linspace(b.lo, b.hi, GRID)
    out = np.zeros(GRID)
    for k in range(0, len(b.n), 4096):
        out += np.exp(-0.5 * ((grid[:, None] - b.mean[None, k : k + 4096]) / width) ** 2) @ b.n[k : k + 4096]
    return grid, out / (b.total * width * math.sqrt(2 * math.pi))


def valley(grid: np.ndarray, y: np.ndarray, ratio: float = VALLEY) -> float | None:
    """The first dip right of the mode that a later peak exceeds by `ratio`."""
    if len(y) < 3:
        return None
    mode = int(y.argmax())
    later = np.maximum.accumulate(y[::-1])[::-1]  # the highest from here on
    k = np.arange(mode + 1, len(y) - 1)
    dips = k[(y[k] < y[k - 1]) & (y[k] <= y[k + 1]) & (later[k + 1] >= ratio * y[k])]
    return float(grid[dips[0]]) if len(dips) and mode < len(y) - 2 else None


def two_normals(b: Binned, rounds: int = 200, least_gain: float = 1e-6, floor: float = 1e-3) -> dict:
    """A mixture of two normals by expectation and maximisation, begun with the values up to and above the median."""
    names = ("mu_good", "mu_bad", "var_good", "var_bad", "pi_bad", "sep")
    none = dict.fromkeys(names, float("nan")) | {"converged": False}
    if b.flat or b.total < 10:
        return none
    least = max(floor * b.var, 1e-12)
    off = F.col("v") - b.median
    sums = [x.alias(f"{k}{i}") for i, side in enumerate((off <= 0, off > 0)) for k, x in (("n", F.sum(F.when(side, F.col("n")))), ("s", F.sum(F.when(side, off * F.col("n")))), ("q", F.sum(F.when(side, off * off * F.col("n")))))]
    r = b.rows.agg(*sums).first()
    if min(r.n0 or 0, r.n1 or 0) < 2:
        return none
    first = np.array([[r.n0, r.s0, r.q0], [r.n1, r.s1, r.q1]], float)
    shift = first[:, 1] / first[:, 0]
    mu, var, pi = b.median + shift, np.maximum(first[:, 2] / first[:, 0] - shift**2, least), np.array([0.5, 0.5])
    last, converged = -np.inf, False
    own = b.inner / b.n
    for _ in range(rounds):
        # squared deviations of a bin's values sum to those of its mean and its own
        part = np.log(pi + 1e-300)[:, None] - 0.5 * np.log(2 * np.pi * var)[:, None] - 0.5 * ((b.mean - mu[:, None]) ** 2 + own) / var[:, None]
        both = np.logaddexp(*part)
        like = float((b.n * both).sum())
        r_ = np.exp(part - both) * b.n
        size = r_.sum(1)
        if (size < 1e-6).any():
            break
        pi, mu = size / b.total, (r_ * b.mean).sum(1) / size
        var = np.maximum((r_ * ((b.mean - mu[:, None]) ** 2 + own)).sum(1) / size, least)
        if abs(like - last) < least_gain:
            converged = True
            break
        last = like
    good, bad = np.argsort(mu, kind="stable")
    pooled = math.sqrt((var[good] + var[bad]) / 2)
    figures = (mu[good], mu[bad], var[good], var[bad], pi[bad], abs(mu[bad] - mu[good]) / pooled if pooled > 0 else float("nan"))
    return dict(zip(names, map(float, figures), strict=True)) | {"converged": converged}


def crossover(g: dict, grid: np.ndarray) -> float | None:
    """The first place of the grid above the lower mean where the upper normal is as likely; else the least density between the means."""
    if not len(grid) or not math.isfinite(g["mu_good"]):
        return None
    normal = lambda x, k, w: w / math.sqrt(2 * math.pi * g[f"var_{k}"]) * np.exp(-0.5 * (x - g[f"mu_{k}"]) ** 2 / g[f"var_{k}"])
    good, bad = normal(grid, "good", 1 - g["pi_bad"]), normal(grid, "bad", g["pi_bad"])
    at = np.flatnonzero((grid > g["mu_good"]) & (bad / (good + bad + 1e-300) >= 0.5))
    if len(at):
        return float(grid[at[0]])
    between = np.flatnonzero((grid >= g["mu_good"]) & (grid <= g["mu_bad"]))
    return float(grid[between[(good + bad)[between].argmin()]]) if len(between) >= 3 else None


def kneedle(b: Binned) -> float | None:
    """The capped value farthest below the chord of the sorted values, the first of equals."""
    if b.flat or b.total < 3:
        return None
    before = [(int(k), int(c)) for k, c in zip(b.bin, np.cumsum(b.n) - b.n, strict=True)]
    rows = b.rows.groupBy("bin", "v").agg(F.sum("n").alias("n"))
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(before, "bin int, before long")), "bin")  # at most BINS rows
    rank = F.col("before") + F.sum("n").over(Window.partitionBy("bin").orderBy("v"))
    below = (rank - 1) / (b.total - 1) - (F.col("v") - b.lo) / (b.hi - b.lo)
    return rows.select("v", below.alias("d")).agg(F.max_by("v", F.struct("d", -F.col("v")))).first()[0]


def _shown(v: float | None) -> float | None:
    return None if v is None or not math.isfinite(v) else round(float(v), 3)


def suggest_one(values: DataFrame, k_iqr: float = 1.5, k_mad: float = 3.0, percentile: float = 97.5, sep_min: float = 2.0, pi_bounds: tuple[float, float] = (0.01, 0.45), min_n: int = 20) -> dict:
    """Methods' cuts and a recommended upper limit for (v, n) where less is better."""
    s = spread(values, percentile)
    if not s["n"]:
        return {"n": 0, "methods": {}, "gmm": {}, "recommended": None, "rationale": "no data", "summary": {}}
    b = Binned(values, s)
    grid, curve = density(b)
    g = two_normals(b)
    iqr, mad, dip, split = iqr_fence(s, k_iqr), mad_fence(s, k_mad), valley(grid, curve), crossover(g, grid)
    cuts = dict(zip(METHODS, map(_shown, (iqr, mad, s[f"p{percentile:g}"], otsu(b), dip, split, kneedle(b), None)), strict=True))
    shown = f"{g['sep']:.1f}" if math.isfinite(g["sep"]) else "n/a"
    apart = g["converged"] and math.isfinite(g["sep"]) and g["sep"] >= sep_min and pi_bounds[0] <= g["pi_bad"] <= pi_bounds[1]
    if s["n"] < min_n:
        cut, why = s["p95"], f"n<{min_n}: insufficient data, using p95"
    elif apart or dip is not None:
        found = sorted(x for x in (split, dip) if x is not None)
        cut = (found[0] + found[-1]) / 2 if found else max(mad, iqr)
        share = f"{g['pi_bad']:.0%}" if math.isfinite(g["pi_bad"]) else "n/a"
        fired = f"GMM sep={shown} + KDE valley" if apart and dip is not None else f"GMM sep={shown}, P(bad)={share}" if apart else f"KDE valley (GMM sep={shown}<{sep_min})"
        why = f"bimodal ({fired}): good/bad crossover"
    else:
        cut, why = min(max(mad, iqr), s["p99"]), f"unimodal (sep={shown}<{sep_min}, no KDE valley): robust MAD/IQR fence"
    summary = {k: s[k] for k in ("min", "p50", "p90", "p95", "p99", "max", "mean", "std")}
    mixture = {k: round(v, 3) if isinstance(v, float) and math.isfinite(v) else v for k, v in g.items()}
    return {"n": s["n"], "methods": cuts, "gmm": mixture, "recommended": round(float(min(max(cut, s["p50"]), s["max"])), 3), "rationale": why, "summary": summary, "curve": (grid, curve)}


def suggest_thresholds(summary: DataFrame, *, metrics: dict[str, str] | tuple[str, ...] | None = None, k_iqr: float = 1.5, k_mad: float = 3.0, percentile: float = 97.5, sep_min: float = 2.0, pi_bounds: tuple[float, float] = (0.01, 0.45), min_n: int = 20) -> dict:
    """{"metrics", "recommended" (by the limit that each metric has), "params", "n_total", "n_nomatch", "plot_path"}.

    Rows without a match are left out; where more is better, cuts are found on 100 less the value and given back mirrored.
    """
    metrics = dict(metrics) if isinstance(metrics, dict) else {m: DEFAULT_METRICS.get(m, "lower") for m in metrics or DEFAULT_METRICS}
    params = {"k_iqr": k_iqr, "k_mad": k_mad, "percentile": percentile, "sep_min": sep_min, "pi_bounds": list(pi_bounds), "min_n": min_n}
    scratch, out = Scratch(summary.sparkSession, "values"), {}
    for m, better in metrics.items():
        if m not in summary.columns:
            continue
        values = scratch.table(counted(summary, m, better == "higher"), m)
        got = suggest_one(values, k_iqr, k_mad, percentile, sep_min, pi_bounds, min_n)
        if better == "higher":
            back = lambda v: None if v is None else round(min(max(100.0 - v, 0.0), 100.0), 3)
            got |= {"methods": {k: back(v) for k, v in got["methods"].items()}, "recommended": back(got["recommended"])}
            if got["n"]:
                s = spread(values.select((100.0 - F.col("v")).alias("v"), "n"))
                got["summary"] = {k: s[k] for k in got["summary"]}
                got["curve"] = (100.0 - got["curve"][0], got["curve"][1])
        out[m] = got | {"direction": better}
        scratch.drop(m)
    n = summary.agg(F.count("*").alias("n"), F.count_if(F.col("match_type") == "NO_MATCH").alias("m") if "match_type" in summary.columns else F.lit(0).alias("m")).first()
    return {"metrics": out, "recommended": {LIMIT_NAMES.get(m, m): v["recommended"] for m, v in out.items()}, "params": params, "n_total": n.n, "n_nomatch": n.m, "plot_path": None}


def threshold_density(summary: DataFrame, found: dict) -> DataFrame:
    """(metric, x, density): the curve that the valleys were looked for in, GRID rows for each metric."""
    rows = [(m, float(x), float(y)) for m, v in found["metrics"].items() for x, y in zip(*v.get("curve", ((), ())), strict=True)]
    return summary.sparkSession.createDataFrame(rows, "metric string, x double, density double")


def threshold_report(found: dict) -> str:
    rows = [f"rows total: {found['n_total']} (without a match: {found['n_nomatch']})"]
    for m, v in found["metrics"].items():
        rows.append(f"{m} ({v['direction']} is better, n={v['n']})")
        if v["n"]:
            rows.append("  " + "  ".join(f"{k}={v['summary'][k]:.2f}" for k in ("p50", "p90", "p95", "p99", "max")))
            rows.append("  " + "  ".join(f"{k}={'n/a' if c is None else format(c, '.2f')}" for k, c in v["methods"].items()))
            rows.append(f"  {LIMIT_NAMES.get(m, m)} = {v['recommended']} [{v['rationale']}]")
    return "\n".join(rows)
