"""Column-level data quality profile of consecutive loads.

Exact base aggregates (counts, null shares, ranges, medians, distinct values, rule violations) are taken for every
load. A classifier two-sample test decides which columns of a load differ from the load before: a logistic regression learns
to tell a load from the one before it. Rows enter it as the cell of coded columns they fall into;
the cells' counts per load and fold are sufficient statistics of the regression, so one aggregation
with map-side combining, spread over the cluster, reduces any number of rows to a bounded table per pair of loads (the numbers
of codes bound it), and each of thousands of models is fitted to that. Fits are cross-fitted (trained on one
fold, judged on the other); discrimination is the AUC, and each column's part in it is the loss when
the column is ablated, what it tells by itself when all others are ablated, and what its missing values tell when its values
are ablated too. A column whose part is below LEAST_PART is not compared: its loads are alike. For the
others the exact aggregates say what differs. Where a fold holds fewer than LEAST_FOLD rows of a load no
classifier can be judged, and the exact comparison is made in any case.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quantiles import exact_medians
from tidemark.tables import by_key, checkpoint

#: Codes of a count: null, and its place against the former load's middle values lo <= hi.
COUNT_CODES = 8
FLAG_CODES = 3
LIST_CODES = 4
RIDGE = 1.0
STEPS = 200
SETTLED = 1e-6
LONG_STEP = 1.5
#: The part in discrimination (AUC above 0.5 by itself, lost by its ablation, or off 0.5 by its missing values) at which a column counts as changed.
#: Null shares more than 0.10 apart move the AUC of missing values by 0.05 where both folds hold half the rows.
LEAST_PART = 0.03
LEAST_FOLD = 20


@dataclass(frozen=True)
class Rules:
    """What is profiled: count columns, one flag, one list of texts, and the rules within a load."""

    counts: Sequence[str]
    flag: str
    texts: str
    pattern: str
    ranges: Mapping[str, Column] = field(default_factory=dict)
    consistency: Column | None = None

    @property
    def columns(self) -> list[str]:
        return [*self.counts, self.flag, self.texts]


def _bad_texts(c: Column, pattern: str) -> Column:
    return F.exists(c, lambda x: x.isNotNull() & ~x.rlike(f"^(?:{pattern})\\z"))


def base_aggregates(rows: DataFrame, group: Sequence[str], load: str, r: Rules) -> DataFrame:
    """One row a load with exact counts; medians come from ``exact_medians``."""
    n_if = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*group, load).agg(
        F.count(F.lit(1)).alias("n"),
        *[n_if(F.col(c).isNull()).alias(f"null_{c}") for c in r.columns],
        *[F.min(c).alias(f"min_{c}") for c in r.counts],
        *[F.max(c).alias(f"max_{c}") for c in r.counts],
        n_if(F.col(r.flag)).alias("n_true"),
        *[n_if(cond).alias(f"range_{c}") for c, cond in r.ranges.items()],
        n_if(_bad_texts(F.col(r.texts), r.pattern)).alias("n_pattern"),
        n_if(r.consistency if r.consistency is not None else F.lit(False)).alias("n_inconsistent"),
    )


def _auc(score: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> float:
    """AUC of grouped scores, ties counting half; 0.5 without both classes."""
    if not n1.sum() or not n0.sum():
        return 0.5
    _, inv = np.unique(np.round(score, 12), return_inverse=True)
    a, b = np.bincount(inv, n1), np.bincount(inv, n0)
    return float((a * (np.cumsum(b) - b / 2)).sum() / (n1.sum() * n0.sum()))


def _fit(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """Ridge logistic regression on grouped rows, by Newton's method with halved steps.

    The penalised likelihood is strictly concave, so the steps settle; ArithmeticError if they don't within STEPS.
    """
    beta, n = np.zeros(x.shape[1]), n1 + n0
    pen = np.full(x.shape[1], RIDGE)
    pen[0] = 1e-6

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((n * np.logaddexp(0, z) - n1 * z).sum() + (pen * b * b).sum() / 2)

    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        grad = x.T @ (n1 - n * p) - pen * beta
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pen), grad)
        longest = np.abs(step).max()
        if longest < SETTLED:
            return beta
        if longest > LONG_STEP:  # only long steps can lead away from the maximum
            at, size = loss(beta), 1.0
            while not loss(beta + size * step) <= at and size > 1e-9:
                size /= 2
            step = size * step
        beta = beta + step
    raise ArithmeticError(f"the regression has not settled after {STEPS} steps")


def _discriminate(names: Sequence[str], sizes: Sequence[int], keys: Sequence[str]):
    codes = [f"code{i}" for i in range(len(names))]

    def judge(key: tuple, p: dict[str, np.ndarray]) -> list[tuple]:
        held = [p[c] for c in codes]
        n1, n0, fold = p["n1"].astype(float), p["n0"].astype(float), p["fold"]
        fair = all(n[fold == k].sum() >= LEAST_FOLD for n in (n1, n0) for k in (0, 1))

        def crossed(blocks: Sequence[tuple[np.ndarray, int]]) -> float | None:
            """Cross-fitted AUC of a model on the coded columns ``blocks``; None where a fold has too few rows of a load."""
            if not fair:
                return None
            at = np.zeros(len(fold), np.int64)
            for code, size in blocks:
                at = at * size + code
            # rows of one cell are one row of the model
            first, cell = np.unique(at, return_index=True, return_inverse=True)[1:]
            x = np.hstack([np.ones((len(first), 1)), *[np.eye(size)[code[first]][:, 1:] for code, size in blocks]])
            a, b = ([np.bincount(cell, n * (fold == k), len(first)) for k in (0, 1)] for n in (n1, n0))
            return float(np.mean([_auc(x @ _fit(x, a[1 - k], b[1 - k]), a[k], b[k]) for k in (0, 1)]))

        def crossed_alone(code: np.ndarray, size: int) -> float:
            """The same for one coded column: its model is saturated, so the fit is in closed form (log odds of the codes, 1/2 added to each count)."""
            a, b = ([np.bincount(code, n * (fold == k), size) for k in (0, 1)] for n in (n1, n0))
            return float(np.mean([_auc(np.log((a[1 - k] + 0.5) / (b[1 - k] + 0.5)), a[k], b[k]) for k in (0, 1)]))

        every = list(zip(held, sizes))
        auc = crossed(every)
        rows = []
        for i, name in enumerate(names):
            parts = (None,) * 3 if auc is None else (auc - crossed(every[:i] + every[i + 1 :]), crossed_alone(*every[i]), crossed_alone((held[i] == 0).astype(int), 2))
            rows.append((*key, name, auc, *parts))
        return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come sorted by ``keys``; a pair of loads may go on in the next frame, so the last one of each is held back."""
        columns = [*keys, "column_name", "auc", "ablation", "alone", "missing"]
        rest = None
        for frame in chain(frames, (None,)):
            p = rest if frame is None else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if p is None or not len(p):
                continue
            first = np.flatnonzero(np.append(True, np.logical_or.reduce([p[k].to_numpy()[1:] != p[k].to_numpy()[:-1] for k in keys])))
            ends = np.append(first[1:], len(p))
            if frame is not None:
                rest, first, ends = p.iloc[first[-1] :].reset_index(drop=True), first[:-1], ends[:-1]
            values = {c: p[c].to_numpy() for c in [*codes, "n1", "n0", "fold"]}
            named = [p[k].to_numpy() for k in keys]
            rows = [r for a, b in zip(first, ends) for r in judge(tuple(k[a] for k in named), {c: v[a:b] for c, v in values.items()})]
            if rows:
                yield pd.DataFrame(rows, columns=columns).astype({c: float for c in columns[len(keys) + 1 :]})

    return run


def _count_code(c: Column, lo: Column, hi: Column) -> Column:
    """0 null; else the place of c against lo and hi, and far below or above them; without a former median all values are 1."""
    return (
        F.when(c.isNull(), 0)
        .when(lo.isNull(), 1)
        .when(c < lo, F.when((lo - c) * 5 > F.abs(lo), 6).otherwise(1))
        .when(c == lo, 2)
        .when(c < hi, 3)
        .when(c == hi, 4)
        .otherwise(F.when((c - hi) * 5 > F.abs(hi), 7).otherwise(5))
    )


def discrimination(rows: DataFrame, medians: DataFrame, group: Sequence[str], load: str, r: Rules, base: DataFrame) -> DataFrame:
    """``group``, ``load``, ``column_name``, ``auc``, ``ablation``, ``alone``, ``missing`` for every load whose former load exists."""
    g = list(group)
    loads = base.select(*g, F.explode(F.array(F.col(load), F.col(load) + 1)).alias("__t")).groupBy(*g, "__t").count().where("count = 2").select(*g, "__t")
    former = medians.groupBy(*g, (F.col(load) + 1).alias("__t")).agg(
        *[F.max(F.when(F.col("column_name") == c, F.col(x))).alias(f"{x}_{c}") for c in r.counts for x in ("lo", "hi")]
    )
    frame = loads.join(former, [*g, "__t"], "left")
    keyed = rows.withColumn("fold", F.pmod(F.xxhash64(*rows.columns), F.lit(2)).cast("int")).withColumn("__t", F.explode(F.array(F.col(load), F.col(load) + 1))).withColumn("now", (F.col("__t") == F.col(load)).cast("int"))
    f, x = F.col(r.flag), F.col(r.texts)
    codes = [
        *[_count_code(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in r.counts],
        F.when(f.isNull(), 0).when(f, 2).otherwise(1),
        F.when(x.isNull(), 0).when(F.size(x) == 0, 1).when(_bad_texts(x, r.pattern), 3).otherwise(2),
    ]
    named = [c.alias(f"code{i}") for i, c in enumerate(codes)]
    cells = keyed.join(frame, [*g, "__t"]).select(*g, "__t", "fold", "now", *named).groupBy(*g, "__t", "fold", *[f"code{i}" for i in range(len(codes))]).agg(F.sum("now").alias("n1"), F.sum(1 - F.col("now")).alias("n0"))
    sizes = [*[COUNT_CODES] * len(r.counts), FLAG_CODES, LIST_CODES]
    schema = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in [*g, "__t"]) + ", column_name string, auc double, ablation double, alone double, missing double"
    placed = by_key(cells, *g, "__t").sortWithinPartitions(*g, "__t")
    return placed.mapInPandas(_discriminate(r.columns, sizes, [*g, "__t"]), schema).withColumnRenamed("__t", load)


def _kept(df: DataFrame, group: Sequence[str], load: str) -> DataFrame:
    rows = df.distinct().where(F.col(load).isNotNull())
    for k in group:
        rows = rows.where(F.col(k).isNotNull())
    return rows


def _measures(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(text that tells values apart, number for range and median) of a column by its type: a number is itself, a flag 0 or 1, a text its length, a list its size, a time its seconds; others have none."""
    c, t = F.col(name), df.schema[name].dataType
    if isinstance(t, T.NumericType):
        return c.cast("string"), c
    if isinstance(t, T.BooleanType):
        return c.cast("string"), c.cast("bigint")
    if isinstance(t, T.StringType):
        return c, F.length(c).cast("bigint")
    if isinstance(t, (T.DateType, T.TimestampType)):
        return c.cast("string"), F.unix_timestamp(c.cast("timestamp"))
    if isinstance(t, T.TimestampNTZType):
        return c.cast("string"), F.unix_timestamp(c.cast("timestamp"))
    if isinstance(t, T.ArrayType):
        return F.to_json(c), F.when(c.isNotNull(), F.size(c)).cast("bigint")
    if isinstance(t, (T.StructType, T.MapType)):
        return F.to_json(c), F.lit(None).cast("bigint")
    return c.cast("string"), F.lit(None).cast("bigint")


def describe(df: DataFrame, group: Sequence[str], load: str, r: Rules, columns: Sequence[str] | None = None) -> DataFrame:
    """The profile itself, a row for each load and column, all exact: ``group``, ``load``, ``column_name``, ``n``, ``nulls``,
    ``null_share``, ``distinct`` (non-null values), ``least``, ``greatest``, ``median``, ``violations`` (rows that break the column's rule).

    ``columns``: those to describe, of any type; the ruled ones if None. Range and median are of the number that ``_measures`` gives;
    without values they are null. ``least`` and ``greatest`` are double if any of the columns is fractional.
    Distinct lists are distinct as lists. Values are counted first, so no group comes together. Rows are kept as in ``profile``.
    """
    key = [*group, load, "column_name"]
    broken = {**r.ranges, r.texts: _bad_texts(F.col(r.texts), r.pattern)}
    if r.consistency is not None:
        broken[r.flag] = r.consistency
    parts = [(c, *_measures(df, c)) for c in (r.columns if columns is None else columns)]
    whole = all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or not isinstance(df.schema[c].dataType, T.NumericType) for c, *_ in parts)
    of = "bigint" if whole else "double"
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), text.alias("__text"), v.cast(of).alias("__v"), F.coalesce(broken.get(c, F.lit(False)), F.lit(False)).cast("bigint").alias("__bad")) for c, text, v in parts])
    long = _kept(df, group, load).select(*group, load, F.explode(cells).alias("__c")).select(*group, load, "__c.*")
    values = long.groupBy(*key, "__text").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__v"), F.sum("__bad").alias("__bad"))
    out = values.groupBy(*key).agg(
        F.sum("__n").alias("n"), F.sum(F.when(F.col("__text").isNull(), F.col("__n")).otherwise(0)).alias("nulls"), F.count("__text").alias("distinct"),
        F.min("__v").alias("least"), F.max("__v").alias("greatest"), F.sum("__bad").alias("violations"),
    )
    mid = exact_medians(long, key, "__v").select(*key, ((F.col("lo").cast("double") + F.col("hi").cast("double")) / 2).alias("median"))
    return out.join(mid, key, "left").select(*key, "n", "nulls", (F.col("nulls") / F.col("n")).alias("null_share"), "distinct", "least", "greatest", "median", "violations")


def profile(df: DataFrame, group: Sequence[str], load: str, r: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base aggregates, medians, discrimination); the first two are small and checkpointed. Rows equal in all columns count once; rows with a null load or group are left out."""
    rows = checkpoint(_kept(df, group, load))  # told apart once, read for the aggregates, the medians and the cells
    base = checkpoint(base_aggregates(rows, group, load, r))
    long = rows.select(*group, load, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in r.counts])).alias("x")).select(*group, load, "x.*")
    medians = checkpoint(exact_medians(long, [*group, load, "column_name"], "v"))
    return base, medians, discrimination(rows, medians, group, load, r, base)


def changed_columns(disc: DataFrame, group: Sequence[str], load: str) -> DataFrame:
    """``group``, ``load``, ``column_name`` of what the classifier calls changed, and of what it could not judge."""
    part = F.greatest(F.col("alone") - 0.5, F.col("ablation"), F.abs(F.col("missing") - 0.5))
    return disc.where(F.col("auc").isNull() | (part > LEAST_PART)).select(*group, load, "column_name")


def findings(df: DataFrame, group: Sequence[str], load: str, r: Rules, every: bool = False) -> DataFrame:
    """``group``, ``load``, ``column_name``, ``check_name``.

    Within a load, from the exact aggregates: ``value_range``, ``pattern``, ``consistency``. Against the load numbered
    one less, for the columns that the classifier calls changed (``changed_columns``): ``null_rate`` (null shares more than
    0.10 apart), ``constant`` (one distinct value now, several before), ``shift`` (median of a count, or
    share of true, moved by more than 0.2). Shares and medians are compared in whole numbers. An empty table has no findings.
    ``every``: compares all columns exactly, whatever the classifier says.
    """
    g = list(group)
    base, medians, disc = profile(df, group, load, r)
    inside = F.array_compact(
        F.array(
            *[F.when(F.col(f"range_{c}") > 0, F.struct(F.lit(c).alias("column_name"), F.lit("value_range").alias("check_name"))) for c in r.ranges],
            F.when(F.col("n_pattern") > 0, F.struct(F.lit(r.texts).alias("column_name"), F.lit("pattern").alias("check_name"))),
            F.when(F.col("n_inconsistent") > 0, F.struct(F.lit(r.flag).alias("column_name"), F.lit("consistency").alias("check_name"))),
        )
    )
    within = base.select(*g, load, F.explode(inside).alias("c")).select(*g, load, "c.*")
    mids = medians.groupBy(*g, load).agg(*[F.max(F.when(F.col("column_name") == c, F.col("lo") + F.col("hi"))).alias(f"mid_{c}") for c in r.counts])
    now = base.join(mids, [*g, load], "left")
    was = now.select(*[F.col(k).alias(f"__{k}") for k in g], (F.col(load) + 1).alias("__load"), *[F.col(c).alias(f"was_{c}") for c in now.columns if c not in g and c != load])
    on = F.col(load) == F.col("__load")
    for k in g:
        on = on & (F.col(k) == F.col(f"__{k}"))
    pair = now.join(was, on)

    def check(column: str, name: str, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(column).alias("column_name"), F.lit(name).alias("check_name")))

    apart = lambda a, n, b, m, tenths: F.abs(F.col(a) * F.col(m) - F.col(b) * F.col(n)) * 10 > F.col(n) * F.col(m) * tenths
    known = pair.withColumn("kn", F.col("n") - F.col(f"null_{r.flag}")).withColumn("was_kn", F.col("was_n") - F.col(f"was_null_{r.flag}"))
    drift = F.array_compact(
        F.array(
            *[check(c, "null_rate", apart(f"null_{c}", "n", f"was_null_{c}", "was_n", 1)) for c in r.columns],
            *[check(c, "constant", (F.col(f"min_{c}") == F.col(f"max_{c}")) & (F.col(f"was_min_{c}") < F.col(f"was_max_{c}"))) for c in r.counts],
            *[check(c, "shift", F.abs(F.col(f"mid_{c}") - F.col(f"was_mid_{c}")) * 5 > F.abs(F.col(f"was_mid_{c}"))) for c in r.counts],
            check(r.flag, "shift", (F.col("kn") > 0) & (F.col("was_kn") > 0) & apart("n_true", "kn", "was_n_true", "was_kn", 2)),
        )
    )
    moved = known.select(*g, load, F.explode(drift).alias("c")).select(*g, load, "c.*")
    if every:
        return within.unionByName(moved)
    return within.unionByName(moved.join(changed_columns(disc, g, load), [*g, load, "column_name"], "left_semi"))
