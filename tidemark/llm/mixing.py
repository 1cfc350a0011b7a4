"""Mixing sources to target weights under a token budget, with capped repetition.

Token counts of all documents give each source's size. A mix whose targets can be met keeps them.
Where a source would be repeated beyond its cap, the shares are tempered: share_i is proportional
to target_i * (natural_i / target_i) ** t, and the exponent t (0: the targets, 1: the sources'
natural shares) is bisected to the least at which every source keeps its repetition limit. If none
does, sources at their limit are pinned there and the rest is tempered again among the others. The planned tokens of a source are realised as whole passes over it and one budgeted pass over blocks in
permuted order: whole blocks while they fit, then a cut inside a single block. Only sums of blocks
(at most BLOCKS a source) and one block's documents ever come together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 4096
STEPS = 60


def tempered(base: np.ndarray, to: np.ndarray, t: float) -> np.ndarray:
    """Shares proportional to base * (to / base) ** t; at 0 they are ``base``, beyond it a share of 0 in either stays 0."""
    if t == 0:
        return base / base.sum() if base.sum() else np.zeros(len(base))
    ok = (base > 0) & (to > 0)
    logs = np.where(ok, (1 - t) * np.log(np.where(ok, base, 1)) + t * np.log(np.where(ok, to, 1)), -np.inf)
    if not ok.any():
        return np.zeros(len(base))
    w = np.exp(logs - logs[ok].max())
    return w / w.sum()


def entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def exponent_for_entropy(sizes: Sequence[float], target: float) -> float:
    """The exponent a in [0, 1] at which shares proportional to size ** a have the entropy ``target``.

    Entropy falls from log(number of sources) at 0; a target beyond either end gives that end.
    """
    s = np.asarray(sizes, float)
    s = s[s > 0]
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        mid = (lo + hi) / 2
        w = np.exp(mid * np.log(s) - (mid * np.log(s)).max()) if len(s) else s
        if entropy(w / w.sum() if len(s) else w) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beyond_limit(target: np.ndarray, natural: np.ndarray, limit: np.ndarray, budget, t: float, slack: float = 0.0) -> np.ndarray:
    """The repetition limit that the exponent is searched for: which sources the shares at exponent ``t`` would repeat beyond their cap."""
    return tempered(target, natural, t) * budget > limit * (1 + slack)


def _least_exponent(target: np.ndarray, natural: np.ndarray, limit: np.ndarray, budget: float) -> float | None:
    """The least exponent in [0, 1] at which no source's share of the budget exceeds its limit, or None.

    The exponents at which one source exceeds its limit are a single interval (the logarithm of a
    tempered share is concave in t), so the end of each one in the way is passed once.
    """
    over = lambda t: beyond_limit(target, natural, limit, budget, t, 1e-12)
    t = 0.0
    for _ in range(len(target) + 1):
        bad = over(t)
        if not bad.any():
            return t
        if (bad & over(1.0)).any():
            return None
        i = int(np.argmax(bad))
        lo, hi = t, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if over(mid)[i] else (lo, mid)
        t = hi
    return None


def plan_shares(weights: Sequence[float], available: Sequence[float], caps: Sequence[float], budget: float) -> tuple[float, np.ndarray]:
    """Exponent and planned tokens of one mix's sources; sums to less than the budget only if the caps leave no more.

    At exponent 0 the shares are the targets; if no source is ``beyond_limit`` there, they are the plan.
    Where no exponent fits, the sources whose target exceeds their limit get the limit, and the others share the rest
    of the budget in the same way: by their targets, tempered where these don't fit. The exponent is that
    of the sources below their limit, 1 if there are none.
    """
    w, a, c = (np.nan_to_num(np.asarray(x, float)) for x in (weights, available, caps))
    w = np.maximum(w, 0)
    limit = np.maximum(c, 0) * a
    planned = np.zeros(len(w))
    if not w.sum() or not budget > 0:
        return 0.0, planned
    target = w / w.sum()
    if not beyond_limit(target, a, limit, budget, 0.0).any():
        return 0.0, target * budget
    room = (target > 0) & (limit > 0)
    if limit[room].sum() <= budget:
        return 1.0, np.where(room, limit, 0)
    rest = budget
    while room.any():
        share, natural = (np.where(room, x, 0) / x[room].sum() for x in (target, a))
        t = _least_exponent(share, natural, limit, rest)
        if t is not None:
            return t, np.where(room, np.minimum(tempered(share, natural, t) * rest, limit), planned)
        full = room & (share * rest > limit)
        planned[full] = limit[full]
        rest -= limit[full].sum()
        room &= ~full
    return 1.0, planned


def plan_mix(sizes: DataFrame, targets: DataFrame, by_entropy: bool = False) -> DataFrame:
    """The plan of every mix: a row for each target.

    ``by_entropy``: the targets are the sources' sizes to a power that is bisected until their entropy is that of the weights of the
    mix (sources of weight 0 stay out); where the power of 1 still has more, the natural shares stand.

    ``sizes``: ``source``, ``available`` (tokens), one row a source. ``targets``: ``mix_id``, ``source``, ``weight``,
    ``max_repeats``, ``budget_tokens``; repeated rows count once, null or negative weights, caps and
    budgets are 0, a source without a size has 0 tokens. Result: the target row with ``label`` (the source as sizes spells it),
    ``available``, ``wanted`` (target share of the budget), ``over_cap`` (the shares at exponent 0 are beyond the source's repetition
    limit, max_repeats * available), ``exponent``, ``planned`` (tokens after tempering).
    """
    t = targets.select("mix_id", "source", "weight", "max_repeats", "budget_tokens").distinct().withColumn("label", F.lower(F.trim("source")))
    s = sizes.select(F.col("source").alias("__s"), "available")
    rows = t.join(s, t["label"] == s["__s"], "left").select(*t.columns, F.coalesce("available", F.lit(0)).cast("bigint").alias("available"))

    def plan(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["source", "max_repeats", "weight"], na_position="last").reset_index(drop=True)
        w = p["weight"].fillna(0).clip(lower=0).to_numpy(float)
        cap = p["max_repeats"].fillna(0).clip(lower=0).to_numpy(float)
        budgets = p["budget_tokens"].fillna(0).clip(lower=0).to_numpy(float)
        size = p["available"].to_numpy(float)
        if by_entropy and w.sum():
            some = (w > 0) & (size > 0)
            power = exponent_for_entropy(size[some], entropy(w[some] / w[some].sum()) if some.any() else 0)
            w = np.where(some, np.where(some, size, 1) ** power, 0)
        total = w.sum()
        target = w / total if total else w
        natural = size / size.sum() if size.sum() else size
        t, planned = plan_shares(w, size, cap, budgets.max() if len(p) else 0)
        over = beyond_limit(target, natural, cap * size, budgets, 0.0)
        return p.assign(wanted=target * budgets, over_cap=over, exponent=t, planned=np.floor(planned).astype("int64"))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, wanted double, over_cap boolean, exponent double, planned bigint"
    return rows.groupBy("mix_id").applyInPandas(plan, schema)


def realise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixes themselves: ``mix_id``, ``source`` (label), ``doc_id``, ``tokens``, ``repeats`` (times the document is taken).

    ``docs``: ``doc_id``, ``source``, ``tokens``. The last pass takes documents in a hash order of mix,
    source and document while they fit the budget, so it falls short by less than one document.
    Documents without tokens add nothing to a mix and are in none. Documents meet the plan in a plain join on the source: AQE
    broadcasts the plan if its bytes are few and splits hot sources if not.
    """
    p = plan.where("planned > 0 and available > 0").groupBy("mix_id", "label").agg(F.sum("planned").alias("planned"), F.max("available").alias("available"))
    rows = docs.where("tokens > 0").join(p, F.col("source") == F.col("label")).select("mix_id", "source", "doc_id", "tokens", "planned", "available")
    rows = rows.withColumn("passes", F.floor(F.col("planned") / F.col("available"))).withColumn("rest", F.col("planned") - F.col("passes") * F.col("available"))
    rows = rows.withColumn("at", F.xxhash64("mix_id", "source", "doc_id")).withColumn("block", F.pmod("at", F.lit(BLOCKS)))
    sums = rows.groupBy("mix_id", "source", "block").agg(F.sum("tokens").alias("in_block"))
    order = Window.partitionBy("mix_id", "source").orderBy("block")
    sums = sums.withColumn("before", F.sum("in_block").over(order) - F.col("in_block"))
    placed = rows.join(sums, ["mix_id", "source", "block"])
    inside = Window.partitionBy("mix_id", "source", "block").orderBy("at", "doc_id")
    cut = placed.where("before < rest and before + in_block > rest").withColumn("reach", F.col("before") + F.sum("tokens").over(inside)).withColumn("more", (F.col("reach") <= F.col("rest")).cast("int")).drop("reach")
    whole = placed.where("not (before < rest and before + in_block > rest)").withColumn("more", (F.col("before") + F.col("in_block") <= F.col("rest")).cast("int"))
    taken = cut.unionByName(whole).withColumn("repeats", F.col("passes") + F.col("more"))
    return taken.where("repeats > 0").select("mix_id", "source", "doc_id", "tokens", F.col("repeats").cast("int").alias("repeats"))
