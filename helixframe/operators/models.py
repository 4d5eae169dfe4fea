"""Regression models fitted by repeated aggregation: only sums over all rows come to the driver, as many as the square of the terms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from .rounds import settled

THETA = (math.exp(-6.0), math.exp(10.0))


@F.pandas_udf(T.DoubleType())
def _log_gamma(x: pd.Series) -> pd.Series:
    return pd.Series([math.lgamma(v) for v in x])


@F.pandas_udf(T.DoubleType())
def _digamma(x: pd.Series) -> pd.Series:
    return pd.Series(numeric.polygamma(x.to_numpy(float), 0))


@F.pandas_udf(T.DoubleType())
def _trigamma(x: pd.Series) -> pd.Series:
    return pd.Series(numeric.polygamma(x.to_numpy(float), 1))


class CountModel:
    """A log-linear model of counts with offset log(exposure), on the distinct rows of (terms, count, exposure) and how often they occur.

    Rows with a null in one of the columns, or without a positive exposure, are left out. `poisson()` is fitted by reweighted least squares, one aggregation an iteration;
    `negative_binomial()` moves the coefficients and theta together, each by its own Newton step (they are orthogonal). Sums over
    counts alone (gamma functions) run on the table of distinct counts.
    """

    def __init__(self, df: DataFrame, count: str, exposure: str, terms: list[str]):
        columns = [*(F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(terms)), F.col(count).cast("double").alias("y"), F.col(exposure).cast("double").alias("t")]
        rows = df.select(*columns).dropna().filter("t > 0")
        self.size = len(terms) + 1
        self.cells = settled(rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("c")))
        self.counts = settled(self.cells.groupBy("y").agg(F.sum("c").alias("c")))
        self.n, y, t = self.cells.agg(F.sum("c"), F.sum(F.col("c") * F.col("y")), F.sum(F.col("c") * F.col("t"))).first()
        if not self.n or not y:
            raise ValueError("no counts to fit")
        self.start = np.zeros(self.size)
        self.start[0] = math.log(y / t)
        self.log_factorials = self._over_counts(_log_gamma(F.col("y") + 1))

    def _over_counts(self, value: Column) -> float:
        return self.counts.withColumn("v", value).agg(F.sum(F.col("c") * F.col("v"))).first()[0]

    def _sums(self, beta: np.ndarray, theta: float, **more: Column) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
        """Information and score of the coefficients and further sums, where mu and w are columns."""
        x = [F.lit(1.0), *(F.col(f"x{i}") for i in range(1, self.size))]
        eta = sum((float(b) * v for b, v in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        mu = F.exp(F.greatest(F.least(eta, F.lit(50.0)), F.lit(-50.0))) * F.col("t")
        rows = self.cells.withColumn("mu", mu).withColumn("w", F.col("c") * F.col("mu") / (1 + F.col("mu") / theta) if math.isfinite(theta) else F.col("c") * F.col("mu"))
        pairs = [(i, j) for i in range(self.size) for j in range(i, self.size)]
        sums = [F.sum(F.col("w") * x[i] * x[j]) for i, j in pairs] + [F.sum(F.col("w") * x[i] * (F.col("y") - F.col("mu")) / F.col("mu")) for i in range(self.size)]
        got = rows.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums)), *(F.sum(F.col("c") * v).alias(name) for name, v in more.items())).first()
        information = np.zeros((self.size, self.size))
        for k, (i, j) in enumerate(pairs):
            information[i, j] = information[j, i] = got[f"s{k}"]
        return information, np.array([got[f"s{len(pairs) + i}"] for i in range(self.size)]), {name: got[name] for name in more}

    def _result(self, beta: np.ndarray, theta: float) -> dict:
        y, mu = F.col("y"), F.col("mu")
        likelihood = y * F.ln(mu) - mu if math.isinf(theta) else theta * F.ln(theta / (theta + mu)) + y * F.ln(mu / (theta + mu))
        information, _, more = self._sums(beta, theta, loglik=likelihood, pearson=(y - mu) * (y - mu) / mu)
        loglik = more["loglik"] - self.log_factorials
        if math.isfinite(theta):
            loglik += self._over_counts(_log_gamma(F.col("y") + theta)) - self.n * math.lgamma(theta)
        se = np.sqrt(np.diag(np.linalg.inv(information)))
        left = self.n - self.size
        return {"beta": beta, "se": se, "loglik": loglik, "theta": theta, "dispersion": more["pearson"] / left if left else math.nan, "aic": 2 * (self.size + math.isfinite(theta)) - 2 * loglik}

    def poisson(self, rounds: int = 100) -> dict:
        beta = self.start
        for _ in range(rounds):
            information, score, _ = self._sums(beta, math.inf)
            step = np.linalg.solve(information, score)
            beta = beta + step
            if np.abs(step).max() < 1e-11:
                return self._result(beta, math.inf) | {"family": "Poisson"}
        raise ArithmeticError(f"the model has not settled in {rounds} rounds")

    def negative_binomial(self, beta: np.ndarray, rounds: int = 200) -> dict:
        """From the coefficients of the Poisson model; theta stays within THETA."""
        y, mu = F.col("y"), F.col("mu")
        spread = self._sums(beta, math.inf, v=(y / mu - 1) * (y / mu - 1))[2]["v"]
        theta = min(max(self.n / max(spread, 1e-9), THETA[0]), THETA[1])
        for _ in range(rounds):
            information, score, more = self._sums(beta, theta, a=F.ln(theta + mu), b=(y + theta) / (theta + mu), c=1 / (theta + mu), d=(y + theta) / ((theta + mu) * (theta + mu)))
            first = self._over_counts(_digamma(F.col("y") + theta)) + self.n * (math.log(theta) + 1 - float(numeric.polygamma(np.array([theta]), 0)[0])) - more["a"] - more["b"]
            second = self._over_counts(_trigamma(F.col("y") + theta)) + self.n * (1 / theta - float(numeric.polygamma(np.array([theta]), 1)[0])) - 2 * more["c"] + more["d"]
            slope, curve = theta * first, theta * first + theta * theta * second  # by the logarithm of theta
            move = -slope / curve if curve < 0 else math.copysign(1.0, slope)
            now = min(max(theta * math.exp(min(max(move, -2.0), 2.0)), THETA[0]), THETA[1])
            step = np.linalg.solve(information, score)
            beta, change, theta = beta + step, abs(math.log(now / theta)), now
            if max(np.abs(step).max(), change) < 1e-10:
                return self._result(beta, theta) | {"family": "Negative_binomial"}
        raise ArithmeticError(f"the model has not settled in {rounds} rounds")

    def chosen(self, limit: float = 1.5) -> dict:
        """Poisson, or negative binomial if the dispersion exceeds the limit."""
        first = self.poisson()
        return first if first["dispersion"] <= limit else self.negative_binomial(first["beta"])
