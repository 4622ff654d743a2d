"""Confidence, freshness and lifecycle expressions (FN16-FN18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import dims
from graphloom.functions.columns import days_between

# Confidence and lifecycle policy.
HALF_LIFE_DAYS = 60.0
ACCESS_BOOST = 0.05
STALE_AFTER_DAYS = 30
EVICT_AFTER_DAYS = 90


def _valid(confidence: Column) -> Column:
    return confidence.isNotNull() & ~F.isnan(confidence) & confidence.between(0, 1)


def decay(confidence: Column, idle_days: Column, floor: float = 0.0) -> Column:
    faded = F.greatest(F.lit(floor), confidence * F.pow(F.lit(0.5), idle_days / HALF_LIFE_DAYS))
    return F.when(~_valid(confidence), 0.0).when(idle_days <= 0, confidence).otherwise(faded)


def boost(confidence: Column, accesses: Column, ceiling: float = 1.0) -> Column:
    raised = F.least(F.lit(ceiling), confidence + F.lit(ACCESS_BOOST) * F.log1p(accesses))
    return F.when(~_valid(confidence), 0.0).otherwise(raised)


def projected(confidence: Column, idle_days: Column, accesses: Column) -> Column:
    return boost(decay(confidence, idle_days), accesses)


def effective_score(confidence: Column, lifecycle: Column, last_accessed: Column, now: Column) -> Column:
    age = F.greatest(F.lit(0.0), days_between(now, last_accessed))
    return F.when(lifecycle.isin("evicted", "archived"), 0.0).otherwise(confidence / (1 + age / 30))


def suggested_lifecycle(lifecycle: Column, last_accessed: Column, now: Column) -> Column:
    idle = days_between(now, last_accessed)
    return (
        F.when((lifecycle == "stale") & (idle >= EVICT_AFTER_DAYS), "evicted")
        .when((lifecycle == "active") & (idle >= STALE_AFTER_DAYS), "stale")
        .otherwise(lifecycle)
    )


def legal_transition(old: Column, new: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in dims.TRANSITIONS.items() for b in bs]
    return F.concat_ws(">", old, new).isin(pairs)
