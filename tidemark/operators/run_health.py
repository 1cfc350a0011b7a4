"""Run health: a day's verdict depends on the verdicts before it, so a feed's days are folded in order.

A feed has one row a day, which bounds what one task holds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# The gate's thresholds.
SCORE_CHANGE_SHARE = 0.10
REACHABILITY_POINTS = 15
OBSERVED_DRIFT = 0.20
TOTAL_SHRINK = 0.10
MEAN_DRIFT = 5
AGREE_OBSERVED, AGREE_MEAN = 0.02, 1.5

COLUMNS = ("feed", "day", "total_domains", "observed", "mean_score", "attempted", "succeeded", "score_changes")
SCHEMA = "feed string, day date, observed bigint, mean_score double, suspect boolean, baseline_moved boolean, reasons string"


def _n(v) -> float:
    return 0.0 if v is None or pd.isna(v) else float(v)


def assess(trusted: dict | None, last: dict | None, day: dict) -> tuple[bool, bool, list[str]]:
    """(suspect, baseline moved, reasons) of ``day`` against the last trusted day and the run before, whatever its verdict."""
    observed, mean = _n(day["observed"]), day["mean_score"]
    broken = ["nothing observed"] * (observed == 0) + ["score changes"] * (observed > 0 and _n(day["score_changes"]) / observed > SCORE_CHANGE_SHARE)
    if trusted is None:
        return bool(broken), False, broken
    drift = []
    before, total = _n(trusted["observed"]), _n(trusted["total_domains"])
    if _n(trusted["attempted"]) and total > 0 and before > 0:
        rate = _n(day["succeeded"]) / _n(day["attempted"]) if _n(day["attempted"]) > 0 else 0.0
        if (_n(trusted["succeeded"]) / _n(trusted["attempted"]) - rate) * 100 > REACHABILITY_POINTS:
            drift.append("reachability")
    if abs(observed - before) / max(1, before) > OBSERVED_DRIFT:
        drift.append("population")
    if total > 0 and (total - _n(day["total_domains"])) / total > TOTAL_SHRINK:
        drift.append("shrunk")
    if not (pd.isna(mean) or pd.isna(trusted["mean_score"])) and abs(mean - trusted["mean_score"]) > MEAN_DRIFT:
        drift.append("mean")
    if broken or not drift:
        return bool(broken), False, broken + drift
    if last is not None and last["suspect"]:
        near = abs(_n(last["observed"]) - observed) / max(1, _n(last["observed"])) <= AGREE_OBSERVED
        a, b = last["mean_score"], mean
        alike = (pd.isna(a) and pd.isna(b)) if pd.isna(a) or pd.isna(b) else abs(a - b) <= AGREE_MEAN
        if near and alike:
            return False, True, drift
    return True, False, drift


def reassess(days: DataFrame) -> DataFrame:
    """Verdicts of every feed's days in order; ``days`` has COLUMNS, one row a feed and day."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        trusted, last, out = None, None, []
        for day in p.sort_values("day").to_dict("records"):
            suspect, moved, reasons = assess(trusted, last, day)
            last = day | {"suspect": suspect}
            trusted = trusted if suspect else day
            out.append((day["feed"], day["day"], day["observed"], day["mean_score"], suspect, moved, ",".join(reasons)))
        return pd.DataFrame(out, columns=["feed", "day", "observed", "mean_score", "suspect", "baseline_moved", "reasons"]).astype({"observed": "Int64"})

    return days.select(*COLUMNS).groupBy("feed").applyInPandas(fold, SCHEMA)
