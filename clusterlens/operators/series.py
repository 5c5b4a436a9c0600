"""Operators over the snapshots of an entity: counter rates and linear forecasts.

Both can go on from a stored state, one row per series, so that a run reads its own readings and that
row whatever came before. A state knows the last reading, the rate that led to it, and the moments of a
straight line, which merge exactly. Runs come in the order of time: a reading that is not after the last one of
its series has been seen and counts no second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moments of a straight line: readings, means, and sums of squares and products around the means.
MOMENTS = ["n", "mean_x", "mean_y", "sxx", "sxy"]
#: Columns of a state beside its keys.
STATE = ["last_ts", "last_value", "last_rate", *MOMENTS]


def _state_of(rows: DataFrame, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beside the state of their series; the state's keys are some of the rows' columns."""
    on = [c for c in state.columns if c not in STATE]
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in on]
    kept = [F.col(f"s.{c}").alias(f"_{c}") for c in columns]
    return rows.alias("r").join(state.alias("s"), same, "left").select("r.*", *kept)


def counter_rates(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    bucket: Column | None = None,
    seconds_per_unit: float = 1.0,
    state: DataFrame | None = None,
) -> DataFrame:
    """Increase per unit of time since the previous reading of the same entity.

    Readings are numbered within a day of an entity, so an entity with very many readings is
    spread over its days; the first reading of a day takes the last one of the day before from a
    table with one row per entity and day. A counter that falls was reset: its rate is null.

    ``state`` (some of the keys, last_ts, last_value, last_rate) goes on from earlier readings: the first later one
    is compared with the last, and a reading at ``last_ts`` has ``last_rate`` again; older ones have none.
    """
    readings = df.groupBy(*keys, time).agg(F.max(value).alias(value))
    if state is None:
        return _rates(readings, keys, time, value, bucket, seconds_per_unit)
    rows = _state_of(readings, state, ["last_ts", "last_value", "last_rate"])
    seen = F.coalesce(F.col(time) <= F.col("_last_ts"), F.lit(False))
    again = F.when(F.col(time) == F.col("_last_ts"), F.col("_last_rate"))
    known = rows.filter(seen).select(*keys, time, value, again.alias("rate"))
    return _rates(rows.filter(~seen), keys, time, value, bucket, seconds_per_unit).unionByName(known)


def _rates(
    readings: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    bucket: Column | None,
    seconds_per_unit: float,
) -> DataFrame:
    """Rates of distinct readings; ``_last_ts`` and ``_last_value`` come before the first, if there."""
    readings = readings.withColumn("_bucket", F.to_date(time) if bucket is None else bucket)
    reading = F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v"))

    within = Window.partitionBy(*keys, "_bucket").orderBy(time)
    rows = readings.withColumn("_prev", F.lag(reading).over(within))

    days = readings.groupBy(*keys, "_bucket").agg(F.max(reading).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    days = days.select(*keys, "_bucket", F.lag("_last").over(across).alias("_carried"))

    joined = rows.join(days, on=[*keys, "_bucket"], how="left")
    prev = F.coalesce("_prev", "_carried")
    if "_last_ts" in readings.columns:
        last = F.struct(F.col("_last_ts").alias("t"), F.col("_last_value").alias("v"))
        prev = F.coalesce(prev, F.when(F.col("_last_ts").isNotNull(), last))
    elapsed = (_seconds(F.col(time)) - _seconds(prev.getField("t"))) / F.lit(
        float(seconds_per_unit)
    )
    grown = F.col(value).cast("double") - prev.getField("v")
    return joined.select(
        *keys,
        time,
        value,
        F.when(grown >= 0, F.try_divide(grown, elapsed)).alias("rate"),
    )


def _seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")).cast("double") / F.lit(1e6)


def line_moments(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Moments of a straight line through the readings of each key, as one algebraic aggregate."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = df.filter(a.isNotNull() & b.isNotNull())
    n = F.count(F.lit(1))
    return both.groupBy(*keys).agg(
        n.alias("n"),
        F.avg(a).alias("mean_x"),
        F.avg(b).alias("mean_y"),
        (F.var_pop(a) * n).alias("sxx"),
        (F.covar_pop(a, b) * n).alias("sxy"),
    )


def merged_moments(a: str, b: str) -> dict[str, Column]:
    """Moments of two disjoint sets of readings together, from columns with these prefixes."""

    def of(prefix: str, name: str) -> Column:
        return F.coalesce(F.col(prefix + name), F.lit(0))

    na, nb = of(a, "n"), of(b, "n")
    n = na + nb
    dx, dy = of(b, "mean_x") - of(a, "mean_x"), of(b, "mean_y") - of(a, "mean_y")
    share = F.coalesce(F.try_divide(nb.cast("double"), n.cast("double")), F.lit(0.0))
    both = na * share  # na * nb / n
    return {
        "n": n,
        "mean_x": of(a, "mean_x") + F.when(na > 0, dx * share).otherwise(of(b, "mean_x")),
        "mean_y": of(a, "mean_y") + F.when(na > 0, dy * share).otherwise(of(b, "mean_y")),
        "sxx": of(a, "sxx") + of(b, "sxx") + dx * dx * both,
        "sxy": of(a, "sxy") + of(b, "sxy") + dx * dy * both,
    }


def days_to_limit(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    value: str,
    limit: float,
    min_points: int = 3,
) -> DataFrame:
    """Days until a straight line through the readings reaches ``limit``.

    Null when the line does not rise or there are fewer than ``min_points`` readings. The fit is
    an algebraic aggregate: no task sees the whole series.
    """
    x, y = F.col(day).cast("double"), F.col(value).cast("double")
    fit = df.groupBy(*keys).agg(
        F.countDistinct(day).alias("n_points"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.max(x).alias("last_day"),
    )
    return _days_left(fit, keys, limit, min_points)


def _days_left(fit: DataFrame, keys: Sequence[str], limit: float, min_points: int) -> DataFrame:
    now = F.col("slope") * F.col("last_day") + F.col("intercept")
    left = F.when(
        (F.col("n_points") >= min_points) & (F.col("slope") > 0),
        (F.lit(float(limit)) - now) / F.col("slope"),
    )
    return fit.select(*keys, "n_points", "slope", now.alias("now"), left.alias("days_left"))


def days_to_limit_after(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    day: str,
    value: str,
    limit: float,
    state: DataFrame,
    min_points: int = 3,
) -> DataFrame:
    """``days_to_limit`` through the readings of this run and those that the state has merged.

    ``state``: some of the keys, last_ts and the moments. Each reading counts once, so those up to ``last_ts``
    are left to the state.
    """
    readings = df.groupBy(*keys, time, day).agg(F.max(value).alias(value))
    rows = _state_of(readings, state, ["last_ts", *MOMENTS])
    seen = F.coalesce(F.col(time) <= F.col("_last_ts"), F.lit(False))
    new = line_moments(rows.filter(~seen), keys, day, value)
    held = rows.groupBy(*keys).agg(
        F.max(F.col(day).cast("double")).alias("last_day"), *[F.max(f"_{m}").alias(f"_{m}") for m in MOMENTS]
    )
    new = new.select(*keys, *[F.col(m).alias(f"new_{m}") for m in MOMENTS])
    merged = merged_moments("_", "new_")
    fit = held.join(new, on=list(keys), how="left").select(
        *keys, "last_day", *[c.alias(m) for m, c in merged.items()]
    )
    slope = F.when(F.col("n") > 1, F.try_divide("sxy", "sxx"))
    fit = fit.select(
        *keys,
        F.col("n").alias("n_points"),
        slope.alias("slope"),
        (F.col("mean_y") - slope * F.col("mean_x")).alias("intercept"),
        "last_day",
    )
    return _days_left(fit, keys, limit, min_points)


def advance_series(
    df: DataFrame, keys: Sequence[str], time: str, day: str, value: str, state: DataFrame | None = None
) -> DataFrame:
    """The state after these readings: keys, last_ts, last_value, last_rate and the moments.

    Series without a new reading stay as they are. Only series are joined, never readings with readings.
    """
    readings = df.filter(F.col(value).isNotNull()).groupBy(*keys, time, day).agg(F.max(value).alias(value))
    rates = counter_rates(readings, keys, time, value, state=state)
    if state is not None:
        rows = _state_of(readings, state, ["last_ts"])
        readings = rows.filter(F.col("_last_ts").isNull() | (F.col(time) > F.col("_last_ts")))
    reading = F.struct(
        F.col(time).alias("t"), F.col(value).cast("double").alias("v"), F.col("rate").alias("rate")
    )
    last = rates.groupBy(*keys).agg(F.max(reading).alias("last"))
    new = line_moments(readings, keys, day, value).join(last, on=list(keys))
    new = new.select(
        *keys,
        F.col("last.t").alias("last_ts"),
        F.col("last.v").alias("last_value"),
        F.col("last.rate").alias("last_rate"),
        *MOMENTS,
    )
    if state is None:
        return new
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    both = state.alias("o").join(new.alias("w"), same, "full_outer").select(
        *[F.coalesce(f"o.{k}", f"w.{k}").alias(k) for k in keys],
        *[F.col(f"o.{c}").alias(f"old_{c}") for c in STATE],
        *[F.col(f"w.{c}").alias(f"new_{c}") for c in STATE],
    )
    moved = F.col("new_last_ts").isNotNull()
    latest = [
        F.when(moved, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)
        for c in ("last_ts", "last_value", "last_rate")
    ]
    return both.select(*keys, *latest, *[c.alias(m) for m, c in merged_moments("old_", "new_").items()])
