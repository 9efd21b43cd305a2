"""Re-estimation of score weights from decisions, and how sensitive ranks are to weights.

Decisions of one programme are hundreds of rows: fits run on the driver with numpy, over a frame collected after the
join and the per-candidate choice of the last decision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrigraph.estate.governance import latest
from metrigraph.operators.scoring import rank_by

DIMENSIONS = ("demand", "consolidation", "feasibility", "risk")
#: Rows and rows of each class that a fit needs, penalties tried, resamples, least share of a dimension, bounds of risk.
LEAST_ROWS, LEAST_CLASS, PENALTIES, RESAMPLES, SEED, FLOOR, BUDGET, RISK = 50, 10, (0.01, 0.1, 1.0, 10.0), 200, 17, 0.05, 0.90, (0.02, 0.25)
LEAVE_ONE_OUT, FOLDS = 200, 20
STEP, SAMPLES, TOP, TIE_WIDTH = 0.2, 32, 10, 1.0


def training_rows(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """(candidate_id, accepted, four dimensions in 0-1) of the last Accept or Reject of each candidate."""
    last = latest(decisions.where(F.col("decision").isin("Accept", "AcceptWithException", "Reject")))
    return last.join(scores, "candidate_id").select("candidate_id", F.col("decision").startswith("Accept").cast("int").alias("accepted"), *[(F.col(d) / 100.0).alias(d) for d in DIMENSIONS])


def standardise(x: np.ndarray) -> np.ndarray:
    spread = x.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
    return (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1.0)


def fit(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Logistic regression (bias first, not penalised) by Newton steps that are halved while the loss doesn't fall."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    ridge = penalty * np.concatenate(([0.0], np.ones(x.shape[1])))

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * v * v).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def log_loss(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(w[0] + x @ w[1:], -35, 35)
    return float((np.logaddexp(0, z) - y * z).mean()) if len(x) else 0.0


def cross_validate(x: np.ndarray, y: np.ndarray, penalty: float) -> float:
    """Mean held-out loss: each row by itself up to LEAVE_ONE_OUT rows, else FOLDS folds by row number."""
    folds = len(x) if len(x) <= LEAVE_ONE_OUT else FOLDS
    of, whole = np.arange(len(x)) % folds, fit(x, y, penalty)
    return float(np.mean([log_loss(fit(x[of != k], y[of != k], penalty, whole), x[of == k], y[of == k]) for k in range(folds)]))


def bootstrap(x: np.ndarray, y: np.ndarray, penalty: float, seed: int = SEED) -> np.ndarray:
    """95 % interval (low, high) of each coefficient but the bias, over seeded resamples that hold both classes."""
    rng, found, whole = np.random.default_rng(seed), [], fit(x, y, penalty)
    for _ in range(RESAMPLES):
        at = rng.integers(0, len(x), len(x))
        if 0 < y[at].sum() < len(at):
            found.append(fit(x[at], y[at], penalty, whole)[1:])
    return np.percentile(np.array(found), [2.5, 97.5], axis=0)


def to_weights(coefficients: np.ndarray) -> dict[str, float]:
    """Positive dimensions share BUDGET by their coefficients, none below FLOOR; risk is negative within its bounds."""
    up = np.maximum(coefficients[:3], 0.0)
    share = up / up.sum() if up.sum() > 0 else np.full(3, 1 / 3)
    share = FLOOR + (BUDGET - 3 * FLOOR) * share
    return dict(zip(DIMENSIONS, [*map(float, share), -float(np.clip(abs(min(coefficients[3], 0.0)) / (np.abs(coefficients).sum() or 1.0), *RISK))], strict=True))


@dataclass(frozen=True)
class Proposal:
    status: str
    rows: int
    penalty: float = 0.0
    coefficients: tuple[float, ...] = ()
    intervals: tuple[tuple[float, float], ...] = ()
    contradictions: tuple[str, ...] = ()
    weights: dict | None = None
    loss: float = 0.0
    baseline: float = 0.0


def reestimate(rows: DataFrame, current: dict[str, float]) -> Proposal:
    """A proposal of weights: refused with too few rows or classes, or where a coefficient contradicts its dimension."""
    t = rows.select("accepted", *DIMENSIONS).toPandas()
    y = t["accepted"].to_numpy(float)
    if len(t) < LEAST_ROWS or min(y.sum(), len(y) - y.sum()) < LEAST_CLASS:
        return Proposal("insufficient", len(t))
    x = standardise(t[list(DIMENSIONS)].to_numpy(float))
    losses = {p: cross_validate(x, y, p) for p in PENALTIES}
    best = min(PENALTIES, key=lambda p: (losses[p], -p))
    w, ends = fit(x, y, best)[1:], bootstrap(x, y, best)
    wrong = tuple(d for d, sign, low, high in zip(DIMENSIONS, (1, 1, 1, -1), *ends, strict=True) if (high < 0 if sign > 0 else low > 0))
    base = x @ np.array([current[d] for d in DIMENSIONS])
    baseline = log_loss(fit(base[:, None], y, best), base[:, None], y)
    status = "contradicted" if wrong else "proposed" if losses[best] < baseline else "no better"
    return Proposal(status, len(t), best, tuple(map(float, w)), tuple((float(a), float(b)) for a, b in ends.T), wrong, to_weights(w), losses[best], baseline)


def assert_independent(approver: str, decisions: DataFrame) -> None:
    """The approver of weights isn't one whose decisions they were learnt from."""
    if decisions.where(F.col("reviewer") == approver).head(1):
        raise ValueError(f"{approver} decided on training rows")


def weight_vectors(base: dict[str, float], samples: int = SAMPLES, seed: int = SEED, step: float = STEP) -> list[tuple[str, dict[str, float]]]:
    """Each weight up and down by `step` alone, then seeded gamma draws around all of them."""
    out = [(f"{d}{sign}", base | {d: w * (1 + (step if sign == "+" else -step))}) for d, w in base.items() for sign in "+-"]
    rng, sizes = np.random.default_rng(seed), np.array([abs(w) for w in base.values()])
    concentration = sizes / sizes.sum() / step**2
    for k in range(samples):
        g = rng.gamma(np.maximum(concentration, 1e-3))
        drawn = g / g.sum() * sizes.sum()
        out.append((f"sample{k:02}", {d: float(v) * (1 if w >= 0 else -1) for (d, w), v in zip(base.items(), drawn, strict=True)}))
    return out


def rank_sensitivity(scores: DataFrame, base: dict[str, float], top: int = TOP, **how) -> DataFrame:
    """(candidate_id, rank, low, high, robust): ranks under all weight vectors; robust: in the first `top` under each."""
    spark = scores.sparkSession
    vectors = spark.createDataFrame([(n, *[v[d] for d in DIMENSIONS]) for n, v in [("base", base), *weight_vectors(base, **how)]], "vector string, " + ", ".join(f"w_{d} double" for d in DIMENSIONS))
    x = scores.select("candidate_id", *DIMENSIONS).crossJoin(F.broadcast(vectors))  # some forty vectors
    total = sum((F.col(f"w_{d}") * F.col(d) for d in DIMENSIONS), F.lit(0.0))
    ranked = rank_by(x, F.round(total, 9), "candidate_id", ["vector"])
    return ranked.groupBy("candidate_id").agg(F.max(F.when(F.col("vector") == "base", F.col("rank"))).alias("rank"), F.min("rank").alias("low"), F.max("rank").alias("high"), (F.max("rank") <= top).alias("robust"))


def tie_groups(composites: list[float], width: float = TIE_WIDTH) -> list[int]:
    """Group of each of the composites in falling order: a group ends where its leader is more than `width` above."""
    out, leader, group = [], None, -1
    for c in composites:
        if leader is None or leader - c > width:
            leader, group = c, group + 1
        out.append(group)
    return out
