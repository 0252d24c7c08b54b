"""Progress timing: rates, time to go, confidence and what to show, as Catalyst expressions.

Rates are percent per millisecond, times are milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the progress display.
LEAST_STEP, LEAST_GAP_MS = 0.5, 250
EMA_ALPHA, RECENT_WEIGHT = 0.35, 0.72
FRESH_MS, OLD_MS, STALL_MS = 4_000, 14_000, 12_000
ETA_ELAPSED_MS, ETA_PERCENT, ETA_SAMPLES = 3_000, 8, 2
FAST_MS, ROLLING_MS, ROLLING_SAMPLES = 1_000, 20_000, 8
PENDING = ("queued", "running", "cancelling")
TERMINAL = ("completed", "failed", "cancelled")


def is_pending(state: Column) -> Column:
    return state.isin(*PENDING)


def is_terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def clamp_percent(percent: Column) -> Column:
    bad = percent.isNull() | F.isnan(percent.cast("double"))
    return F.when(bad, 0).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), percent)))


def measured_rate(percent: Column, previous: Column, gap_ms: Column) -> Column:
    """Rate between two samples; null unless the earlier one has begun and both steps are large enough."""
    step = percent - previous
    return F.when((previous > 0) & (gap_ms >= LEAST_GAP_MS) & (step >= LEAST_STEP), step / gap_ms)


def overall_rate(percent: Column, first_percent: Column, since_first_ms: Column) -> Column:
    known = (percent > first_percent + LEAST_STEP) & (since_first_ms >= LEAST_GAP_MS)
    return F.when(known, (percent - first_percent) / since_first_ms)


def recent_weight(stale_ms: Column, recent: Column) -> Column:
    fresh = F.lit(1.0) - (stale_ms - FRESH_MS) / F.lit(float(OLD_MS - FRESH_MS))
    return (
        F.when(F.coalesce(recent, F.lit(0.0)) == 0.0, 0.0)
        .when(stale_ms <= FRESH_MS, RECENT_WEIGHT)
        .when(stale_ms >= OLD_MS, 0.0)
        .otherwise(F.lit(RECENT_WEIGHT) * fresh)
    )


def blended_rate(overall: Column, recent: Column, weight: Column) -> Column:
    """Either rate alone, or both by the weight of the recent one."""
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight))
    return F.when(overall.isNull(), recent).when(recent.isNull(), overall).otherwise(overall * (F.lit(1.0) - w) + recent * w)


def remaining_ms(percent: Column, rate: Column) -> Column:
    return F.when((percent > 0) & (percent < 100) & (rate > 0), (F.lit(100.0) - percent) / rate)


def agreement(overall: Column, recent: Column) -> Column:
    high = F.greatest(overall, recent)
    return F.when(overall.isNull() | recent.isNull() | (high <= 0), 0.0).otherwise(F.least(overall, recent) / F.nullif(high, F.lit(0.0)))


def confidence(samples: Column, measured_ms: Column, percent: Column, stale_ms: Column, overall: Column, recent: Column, remaining: Column) -> Column:
    """none, low, medium or high."""
    point = lambda condition, n=1.0: F.when(condition, n).otherwise(0.0)
    agreed = agreement(overall, recent)
    score = (
        F.lit(2.0) + point(samples >= 3) + point(measured_ms >= 10_000) + point(percent >= 25) + point(stale_ms <= FRESH_MS)
        + F.when(agreed >= 0.7, 1.0).when(agreed >= 0.45, 0.5).otherwise(0.0) + point(remaining <= 10_000, 0.5)
    )
    gates = (samples >= ETA_SAMPLES) & (measured_ms >= ETA_ELAPSED_MS) & (percent >= ETA_PERCENT) & (stale_ms < STALL_MS)
    return F.when(remaining.isNull() | ~F.coalesce(gates, F.lit(False)), "none").when(score >= 6, "high").when(score >= 4.5, "medium").otherwise("low")


def eta_bucket(ms: Column) -> Column:
    """Rounded up to a step that grows with the time to go; one step at least."""
    step = F.when(ms < 10_000, 1_000).when(ms < 60_000, 5_000).when(ms < 300_000, 15_000).when(ms < 1_800_000, 30_000).otherwise(60_000)
    return F.greatest(step.cast("long"), F.ceil(F.greatest(ms, F.lit(0.0)) / step) * step)


def duration_text(ms: Column) -> Column:
    """``5s``, ``2m 5s``, ``3h 2m``; zero parts at the end are left out."""
    s = F.greatest(F.lit(1).cast("long"), F.ceil(ms / F.lit(1000.0)))
    m, h = F.floor(s / 60), F.floor(s / 3600)
    two = lambda big, unit, small, low: F.concat(
        big.cast("string"), F.lit(unit), F.when(small > 0, F.concat(F.lit(" "), small.cast("string"), F.lit(low))).otherwise("")
    )
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, two(m, "m", s % 60, "s")).otherwise(two(h, "h", m % 60, "m"))


def eta_text(remaining: Column, sure: Column, stalled: Column) -> Column:
    """What stands beside a running job's bar."""
    to_go = F.when(remaining < 5_000, "<5s remaining").otherwise(
        F.concat(F.when(sure == "high", "").otherwise("~"), duration_text(eta_bucket(remaining)), F.lit(" remaining"))
    )
    return (
        F.when(stalled, "waiting for next update")
        .when(remaining.isNull() | (sure == "none"), "estimating time...")
        .when((sure == "low") & (remaining >= 5_000), F.concat(F.lit("estimating... "), to_go))
        .otherwise(to_go)
    )


def display_mode(state: Column, from_cache: Column, timed: Column, percent: Column, elapsed_ms: Column, show_eta: Column) -> Column:
    return (
        F.when(from_cache | is_terminal(state), "simple")
        .when(~is_pending(state) | ~timed, "indeterminate")
        .when(show_eta, "detailed")
        .when(percent <= 0, "indeterminate")
        .when(elapsed_ms < FAST_MS, "hidden")
        .otherwise("simple")
    )
