"""Reward terms of a recorded step log, one column per term."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RewardConfig:
    """Defaults of the reward terms (fixed values)."""

    win_multiplier: float = 4.0
    loss_multiplier: float = 1.8
    open_coeff: float = 0.3
    dd_coeff: float = 50.0
    dd_threshold: float = 0.03
    streak_coeff: float = 0.05
    streak_offset: int = 2
    funding_coeff: float = 0.01
    entry_cost: float = 0.02
    churn_cost: float = 0.005
    give_back_coeff: float = 0.5
    give_back_threshold: float = 0.005
    floor: float = -5.0


TERMS = ("realised", "open_value", "drawdown", "streak", "funding", "entry", "churn", "give_back")


def _excess(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def reward_terms(
    pnl: Column, unrealised: Column, has_position: Column, drawdown: Column, streak: Column, opened: Column,
    funding: Column, cancels: Column, peak: Column, cfg: RewardConfig = RewardConfig(),
) -> dict[str, Column]:
    def only(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(0.0)

    return {
        "realised": F.when(pnl >= 0, pnl * cfg.win_multiplier).otherwise(pnl * cfg.loss_multiplier),
        "open_value": only(has_position, unrealised * cfg.open_coeff),
        "drawdown": -cfg.dd_coeff * F.pow(_excess(drawdown - cfg.dd_threshold), F.lit(2.0)),
        "streak": only(opened, -cfg.streak_coeff * _excess((streak - cfg.streak_offset).cast("double"))),
        "funding": only(has_position, -cfg.funding_coeff * F.abs(funding)),
        "entry": only(opened, F.lit(-cfg.entry_cost)),
        "churn": -cfg.churn_cost * _excess(cancels.cast("double")),
        "give_back": only(has_position, -cfg.give_back_coeff * _excess(peak - unrealised - cfg.give_back_threshold)),
    }


def floored_total(terms, floor: float) -> Column:
    """Sum of the terms; the floor comes last."""
    return F.greatest(reduce(lambda a, b: a + b, [F.col(t) for t in terms]), F.lit(floor))


def with_rewards(df: DataFrame, cfg: RewardConfig = RewardConfig(), **columns: Column) -> DataFrame:
    out = df.withColumns(reward_terms(cfg=cfg, **columns))
    return out.withColumn("reward", floored_total(TERMS, cfg.floor))


def attribution(df: DataFrame, keys, terms=TERMS) -> DataFrame:
    """Sum of each term per key, long form."""
    sums = df.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in terms])
    return sums.unpivot(list(keys), list(terms), "term", "total")
