"""Type-two history of changing attributes.

Updates come in loads (by default a day each). ``load_versions`` compacts every load on its own to its versions of a key;
``merge_versions`` is the type-two merge: the attribute hash of a load's first version is compared with the version that is
current when the load comes; if equal the current version goes on, else it is closed with its end date and a new
open version is inserted. The merge is associative, so all loads of all keys are merged at once, each against one
row that sums up the load before. ``version_history`` merges loads into an empty history; ``merge_history`` merges a further
batch into a stored one.

Scale. The only shuffle of all rows is on (key, load), so one key that holds a third of the rows is spread over its
loads. Within a load a sort finds the changes; the merge reads one summary row a load, which is all that a single
key ever brings into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOAD_SECONDS = 86_400


def load_versions(updates: DataFrame, keys: Sequence[str], ts: str, attr_hash: Column, latest_by: Sequence[str] = (), carry: Sequence[str] = (), load_seconds: int = LOAD_SECONDS) -> DataFrame:
    """Rows of every load with the place of each in it: ``__k`` (struct of the keys), ``__b`` (load), ``__ts``, ``__h``, ``__ph`` (hash before it in the load), ``__n`` (place, from 1) and carried columns.

    Of several rows of a key at one instant the one greatest in ``latest_by`` stands.
    """
    # one struct of the keys: nulls in it are equal, so the join of the merge is on plain equality and keeps the partitioning
    by = [f"__t{i}" for i in range(len(latest_by))]
    cs = [f"__c{i}" for i in range(len(carry))]
    base = updates.where(F.col(ts).isNotNull()).select(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("__k"),
        F.col(ts).alias("__ts"),
        attr_hash.alias("__h"),
        *[F.col(t).alias(a) for t, a in zip(latest_by, by)],
        *[F.col(c).alias(a) for c, a in zip(carry, cs)],
    )
    # said here, the filter that the merge infers for __b is in both of its branches, so they share one exchange
    base = base.withColumn("__b", F.floor(F.unix_timestamp("__ts") / load_seconds)).where(F.col("__b").isNotNull())
    at = Window.partitionBy("__k", "__b").orderBy("__ts", *[F.desc(t) for t in by])
    kept = base.withColumn("__p", F.lag("__ts").over(at)).where(F.col("__p").isNull() | (F.col("__p") != F.col("__ts")))
    seq = Window.partitionBy("__k", "__b").orderBy("__ts")
    return kept.select("__k", "__b", "__ts", "__h", *cs, F.lag("__h").over(seq).alias("__ph"), F.row_number().over(seq).alias("__n"))


def merge_versions(local: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """The type-two merge of all loads of ``load_versions``: ``__k``, ``__ts`` (start), ``__h``, ``__end`` (null: open), ``__seen`` and carried columns."""
    cs = list(carried)
    summary = local.groupBy("__k", "__b").agg(
        F.min("__ts").alias("__first"),
        F.max("__ts").alias("__seen"),
        F.min_by("__h", "__ts").alias("__fh"),
        F.max_by("__h", "__ts").alias("__lh"),
        F.min(F.when((F.col("__n") > 1) & ~F.col("__h").eqNullSafe(F.col("__ph")), F.col("__ts"))).alias("__inner"),
    )
    fwd, back = Window.partitionBy("__k").orderBy("__b"), Window.partitionBy("__k").orderBy(F.desc("__b"))
    current = F.lag("__lh").over(fwd)  # the hash that is current when the load comes
    merged = (
        summary.withColumn("__inserts", F.lag("__b").over(fwd).isNull() | ~current.eqNullSafe(F.col("__fh")))
        .withColumn("__change", F.when(F.col("__inserts"), F.col("__first")).otherwise(F.col("__inner")))
        .withColumn("__closes", F.last("__change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("__seen", F.first("__seen").over(back.rowsBetween(Window.unboundedPreceding, 0)))
        .select("__k", "__b", "__inserts", "__closes", "__seen")
    )
    points = local.where((F.col("__n") == 1) | ~F.col("__h").eqNullSafe(F.col("__ph"))).select("__k", "__b", "__ts", "__h", "__n", *cs)
    j = [points["__k"] == merged["__k"], points["__b"] == merged["__b"]]
    joined = points.join(merged, j).where((points["__n"] > 1) | merged["__inserts"])
    end = F.coalesce(F.lead(points["__ts"]).over(Window.partitionBy(points["__k"], points["__b"]).orderBy(points["__ts"])), merged["__closes"])
    return joined.select(points["__k"], points["__ts"], points["__h"], *[points[c] for c in cs], end.alias("__end"), merged["__seen"])


def version_history(
    updates: DataFrame,
    keys: Sequence[str],
    ts: str,
    attr_hash: Column,
    *,
    latest_by: Sequence[str] = (),
    carry: Sequence[str] = (),
    load_seconds: int = LOAD_SECONDS,
) -> DataFrame:
    """The loads of ``updates`` merged into an empty history: ``keys``, ``valid_from``, ``valid_to`` (null: open), ``version_hash``, ``last_seen``, ``carry``.

    A version begins where ``attr_hash`` differs from the version current then, or at the first row;
    it ends where the next begins. Of several rows of a key at one instant the one greatest in
    ``latest_by`` (in that order, nulls least) stands. Rows with a null ``ts`` say nothing. Null
    keys form a key of their own. An empty input gives an empty history; repeated rows change
    nothing. ``last_seen`` is the last instant seen of the key (only on open versions).
    Input columns are renamed inside, so extra columns with any names do no harm.
    """
    cs = [f"__c{i}" for i in range(len(carry))]
    out = merge_versions(load_versions(updates, keys, ts, attr_hash, latest_by, carry, load_seconds), cs)
    return out.select(
        *[F.col(f"__k.k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("__ts").alias("valid_from"),
        F.col("__end").alias("valid_to"),
        F.col("__h").alias("version_hash"),
        F.when(F.col("__end").isNull(), F.col("__seen")).alias("last_seen"),
        *[F.col(a).alias(c) for c, a in zip(carry, cs)],
    )


def _null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def merge_history(
    history: DataFrame | None,
    updates: DataFrame,
    log: DataFrame | None,
    keys: Sequence[str],
    ts: str,
    attr_hash: Column,
    *,
    latest_by: Sequence[str] = (),
    load_seconds: int = LOAD_SECONDS,
) -> DataFrame:
    """``history`` (of ``version_history``, without carried columns; None: empty) with a batch of ``updates`` merged in.

    Keys whose updates are all later than what was seen of them are merged against their open
    version: it stays open if the hash is equal, else it is closed and new versions follow. A key
    with a late update (at or before ``last_seen``) cannot be mended from versions alone, since a
    history doesn't keep the rows between: its versions up to the one that was open before the earliest late
    instant stay, and only the rows of ``log`` from there on (all rows so far, the batch included) are merged again.
    ``history`` is read several times, so it should be a stored table.
    """
    how = {"latest_by": latest_by, "load_seconds": load_seconds}
    cols = ["valid_from", "valid_to", "version_hash", "last_seen"]
    names = [*keys, *cols]
    if history is None:
        return version_history(updates, keys, ts, attr_hash, **how).select(*names)
    ups = updates.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("valid_from"), attr_hash.alias("version_hash"), *[F.col(c).alias(f"__t{i}") for i, c in enumerate(latest_by)])
    opened = history.where(F.col("valid_to").isNull()).select(*names)
    first = ups.groupBy(*keys).agg(F.min("valid_from").alias("__first"))
    touched = first.join(opened, _null_safe(first, opened, keys), "left").select(
        *[first[k] for k in keys], "__first", (opened["last_seen"].isNotNull() & (first["__first"] <= opened["last_seen"])).alias("__late")
    )
    late = touched.where("__late").select(*keys, "__first")
    fresh = touched.where("not __late").select(*keys)
    # where to begin again: the last version that began before the earliest late instant (an equal instant may change its hash)
    past = history.join(late, _null_safe(history, late, keys)).where(F.col("valid_from") < F.col("__first")).groupBy(*[history[k] for k in keys]).agg(F.max("valid_from").alias("__from"))
    again = late.join(past, _null_safe(late, past, keys), "left").select(*[late[k] for k in keys], "__from")
    rows = log.join(again.withColumnsRenamed({k: f"__q{i}" for i, k in enumerate(keys)}), _renamed(log, keys)).where(F.col("__from").isNull() | (F.col(ts) >= F.col("__from")))
    replayed = version_history(rows, keys, ts, attr_hash, **how)
    before = history.join(again, _null_safe(history, again, keys)).where(F.col("valid_from") < F.col("__from")).select(*[history[c] for c in names])
    seed = opened.join(fresh, _null_safe(opened, fresh, keys), "left_semi").select(*keys, "valid_from", "version_hash")
    new = ups.join(fresh, _null_safe(ups, fresh, keys), "left_semi")
    merged = version_history(new.unionByName(seed, allowMissingColumns=True), keys, "valid_from", F.col("version_hash"), latest_by=[f"__t{i}" for i in range(len(latest_by))], load_seconds=load_seconds)
    closed = history.where(F.col("valid_to").isNotNull())
    untouched = closed.join(late, _null_safe(closed, late, keys), "left_anti").unionByName(opened.join(touched, _null_safe(opened, touched, keys), "left_anti"))
    return untouched.select(*names).unionByName(before).unionByName(merged.select(*names)).unionByName(replayed.select(*names))


def _renamed(log: DataFrame, keys: Sequence[str]):
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & log[k].eqNullSafe(F.col(f"__q{i}"))
    return cond
