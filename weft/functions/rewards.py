"""Rewards and their parts, piecewise in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def thought_length_score(n: Column) -> Column:
    """0 up to 50 tokens, rising to 1 at 256, 1 up to 400, -1 beyond."""
    return F.when(n.isNull() | (n <= 50), 0.0).when(n > 400, -1.0).when(n >= 256, 1.0).otherwise((n - 50) / 206.0)


def number_reward(loop: Column, correct: Column, boxed: Column, tags: Column, n: Column) -> Column:
    """-0.5 for a loop; a right boxed answer 1 with format and length shares; a right one without box 0.3; else 0."""
    full = 1.0 + 0.3 * F.when(tags, 1.0).otherwise(0.0) + 0.2 * thought_length_score(n)
    return F.when(loop, -0.5).when(correct & boxed, full).when(correct, 0.3).otherwise(0.0)


def thought_bonus(n: Column, good: int = 60, best: int = 250, bad: int = 380) -> Column:
    """From -0.5 up to 0 at `good` tokens, up to 0.5 at `best`, down to -0.5 at `bad`."""
    return (
        F.when(n.isNull() | (n <= 0), -0.5)
        .when(n <= good, -0.5 + 0.5 * (n / float(good)))
        .when(n <= best, 0.5 * ((n - good) / float(best - good)))
        .when(n <= bad, 0.5 - 1.0 * ((n - best) / float(bad - best)))
        .otherwise(-0.5)
    )


def letter_reward(total: Column, correct: Column, boxed: Column, tags: Column, n: Column, ceiling: int = 350) -> Column:
    """-1 near the length ceiling or for a wrong answer; right and boxed 1 with a clipped bonus; right without box 0.2."""
    extra = F.when(tags, F.greatest(F.lit(-0.5), F.least(F.lit(1.0), thought_bonus(n) * 1.2))).otherwise(0.0)
    return F.when(total >= ceiling - 10, -1.0).when(correct & boxed, 1.0 + extra).when(correct, 0.2).otherwise(-1.0)


def accepted(passed: Column, text: Column, tokens: Column, cap: int, loop: Column) -> Column:
    """A verified attempt counts if it is not empty, does not loop and stays below the token cap."""
    return F.coalesce(passed & (F.coalesce(text, F.lit("")) != "") & (tokens < cap) & ~loop, F.lit(False))


def total_length_score(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n <= 40, -0.2).when(n <= 120, 0.5).when(n <= 200, -0.3).otherwise(-1.0)


def advantage(reward: Column, group: str, eps: float = 1e-6) -> Column:
    """Reward less its group's mean, by the sample deviation where there is one."""
    w = Window.partitionBy(group)
    mean, sd = F.avg(reward).over(w), F.stddev_samp(reward).over(w)
    return F.when(sd.isNull() | F.isnan(sd) | (sd < eps), reward - mean).otherwise((reward - mean) / (sd + eps))


def clipped_advantage(reward: Column, group: str, eps: float = 1e-6, clip: float = 5.0) -> Column:
    w = Window.partitionBy(group)
    z = (reward - F.avg(reward).over(w)) / F.greatest(F.stddev_pop(reward).over(w), F.lit(eps))
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def difficulty_weight(rate: Column, sharp: float = 6.0) -> Column:
    """Logistic weight, higher where fewer attempts pass."""
    return 1 / (1 + F.exp(sharp * (rate - 0.5)))


def temperature_weight(correct: Column, temperature: Column, group: str) -> Column:
    """Right answers at high temperature weigh less where the group has a right one at low temperature."""
    cold = F.bool_or(correct & (temperature <= 0.60)).over(Window.partitionBy(group))
    return F.when(cold & correct & (temperature >= 0.80), 0.3).when(cold & correct & (temperature >= 0.65), 0.6).otherwise(1.0)


def kl_estimate(log_ratio: Column, most: float = 10.0) -> Column:
    """exp(x) - 1 - x with x kept within bounds."""
    x = F.greatest(F.lit(-most), F.least(F.lit(most), log_ratio))
    return F.expm1(x) - x


def objective_scale(share: Column, count: Column, ema: Column, low: float = 0.1, high: float = 10.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), share / F.greatest(count * ema, F.lit(1e-8))))
