"""Expectation-maximisation over votes of overlapping rules.

Rules vote 1 (good), -1 (bad) or 0 (abstain). The votes of a document are one
pattern in base 3, so a table reduces to at most 3**rules pattern counts; the
iterations run over those counts and thus over all documents, whatever their
number. Only the pattern counts reach the driver.

The model has two classes. The share of good documents and each rule's accuracy
on good and on bad ones are estimated; an abstention says nothing. Weak Beta
priors steady small inputs, and the only constraint is that a rule is no worse
than chance: a vote for good never counts against a document and a vote for bad
never for it. Iterations start at the priors' means, where about four votes for
good outweigh one for bad.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Means of the priors: the share of good documents, a rule's accuracy on good and on bad ones.
PRIOR = (0.7, 0.95, 0.5)
# Keeps logarithms finite; the priors keep estimates further from 0 and 1.
EDGE = 1e-6


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and for each rule the accuracy on good and on bad ones."""

    good: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log-odds that a vote for good and a vote for bad add, by rule."""
        return [
            (float(np.log(g / (1 - b))), float(np.log((1 - g) / b))) for g, b in zip(self.right_good, self.right_bad, strict=True)
        ]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability that a document is good, as an expression on its votes."""
        total = F.lit(float(np.log(self.good / (1 - self.good))))
        for vote, (up, down) in zip(votes, self.weights(), strict=True):
            total = total + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def pattern(votes: list[Column]) -> Column:
    """The votes as one integer in base 3."""
    code = F.lit(0)
    for vote in votes:
        code = code * 3 + (vote + 1)
    return code


def _at_least_chance(good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Accuracies moved equally where both together are under one."""
    lack = np.maximum(0.0, 1.0 - (good + bad)) / 2
    return np.clip(good + lack, EDGE, 1 - EDGE), np.clip(bad + lack, EDGE, 1 - EDGE)


def fit_votes(counted: DataFrame, rules: int, rounds: int = 1000, prior: float = 5.0) -> VoteModel:
    """Fit on rows (code, n): pattern codes with their counts.

    ``prior`` is the weight of the priors in documents. An empty table gives
    the priors' means.
    """
    rows = sorted((r[0], r[1]) for r in counted.select("code", "n").collect())
    codes = np.array([r[0] for r in rows], dtype=np.int64)
    n = np.array([r[1] for r in rows], dtype=float)
    votes = np.stack([codes // 3 ** (rules - 1 - k) % 3 - 1 for k in range(rules)], axis=1)
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    good, right_good, right_bad = PRIOR[0], np.full(rules, PRIOR[1]), np.full(rules, PRIOR[2])
    for _ in range(rounds):
        odds = np.log(good / (1 - good)) + up @ np.log(right_good / (1 - right_bad)) + down @ np.log((1 - right_good) / right_bad)
        q = 1 / (1 + np.exp(-odds))
        wg, wb = n * q, n * (1 - q)
        before = np.concatenate([[good], right_good, right_bad])
        good = float(np.clip((wg.sum() + prior * PRIOR[0]) / (n.sum() + prior), EDGE, 1 - EDGE))
        right_good, right_bad = _at_least_chance(
            (wg @ up + prior * PRIOR[1]) / (wg @ (up + down) + prior), (wb @ down + prior * PRIOR[2]) / (wb @ (up + down) + prior)
        )
        if np.abs(np.concatenate([[good], right_good, right_bad]) - before).max() < 1e-9:
            break
    return VoteModel(good, tuple(map(float, right_good)), tuple(map(float, right_bad)))
