"""The full feature table: all features of one key are computed in one pass over that key."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W, functions as F

from txrisk.functions import rows as R
from txrisk.functions.scale import MAX_BROADCAST_KEYS, attach, checkpoint
from txrisk.operators import aggregates as A, series as S, windows as Wn
from txrisk.schema import DAY_US, DEFAULT, HOUR_US, MINUTE_US, Columns, micros


@dataclass
class FeatureOptions:
    use_client: bool = True
    count_windows_us: tuple[int, ...] = (6 * HOUR_US, DAY_US, 3 * DAY_US, 7 * DAY_US)
    mean_days: tuple[int, ...] = (1, 7, 30)
    drift_days: tuple[int, ...] = (7, 30)
    moving_rows: int = 5
    session_gap_minutes: float | None = None   # sessions are optional
    cycles: bool = True
    splines: bool = True
    crosses: bool = True
    seasonal: bool = True
    fft: bool = True
    cumulative: bool = False
    lomb_scargle: bool = False
    n_clusters: int = 0
    rate_columns: tuple[str, ...] = ("ProductCategory", "ProductId", "ProviderId", "ChannelId")
    spline_columns: tuple[str, ...] = ("Hour", "DayOfWeek", "DayOfMonth")
    drop: tuple[str, ...] = ()


@dataclass
class FeatureState:
    """What fitting learns: the table of fraud rates (column, category, rate), joined and never collected, and spline ranges."""

    rates: DataFrame | None = None
    ranges: dict[str, list[float]] = field(default_factory=dict)

    def to_json(self) -> str:
        """Without the rates, which are stored as a table."""
        return json.dumps({"ranges": self.ranges})

    @staticmethod
    def from_json(text: str, rates: DataFrame | None = None) -> "FeatureState":
        return FeatureState(rates, json.loads(text)["ranges"])


def fit_features(df: DataFrame, o: FeatureOptions = FeatureOptions(), cols: Columns = DEFAULT) -> FeatureState:
    """One aggregate for the rates of all category columns and one for the spline ranges."""
    from txrisk.operators.encoders import category_table
    t = category_table(df, list(o.rate_columns), cols.label)
    rates = checkpoint(t.select("column", "category", (F.col("pos") / F.col("n")).alias("rate"))) if o.rate_columns else None
    ranges = {}
    if o.splines:
        ranges = {c: list(v) for c, v in R.spline_ranges(R.calendar_features(df, cols), list(o.spline_columns)).items()}
    return FeatureState(rates, ranges)


def key_features(key: str, o: FeatureOptions, cols: Columns) -> list:
    """Everything that needs the rows of ``key`` in order or as a group."""
    out = [Wn.Prev(f"__prev_{key}", "__now")]
    out += [Wn.Rolling(f"{key}_Count_{Wn.label_us(w)}", "count", w) for w in o.count_windows_us]
    out += [Wn.Rolling(f"{key}_Mean_{d}d", "avg", d * DAY_US, cols.amount) for d in o.mean_days]
    for v in (cols.value, cols.amount):
        out += A.amount_stats_features(key, v) + Wn.drift_features(key, v, o.drift_days)
    out += [Wn.LastRows(f"{key}_MovingAvg_{o.moving_rows}", "avg", o.moving_rows, cols.amount)]
    if o.cumulative:
        out += [Wn.Running(f"{key}_CumAmount", cols.amount), Wn.Running(f"{key}_CumValue", cols.value),
                Wn.KeyStat("__first", "min", "__now"), Wn.Prev("__pa", cols.amount), Wn.Prev("__pv", cols.value)]
    return out


def _finish_block(raw: DataFrame, names: list[str], key: str, o: FeatureOptions, cols: Columns) -> DataFrame:
    """The columns ``names`` and the block's final columns from evaluated ``key_features``."""
    keep = [F.col(f.name) for f in key_features(key, o, cols) if not f.name.startswith("__") and not f.name.endswith("_Std")]
    mean, moving = F.col(f"{key}_{cols.amount}_Mean"), F.col(f"{key}_MovingAvg_{o.moving_rows}")
    new = [F.coalesce((F.col("__now") - F.col(f"__prev_{key}")) / MINUTE_US, F.lit(0.0)).alias(f"{key}_TimeSinceLast"),
           Wn.ratio(moving - mean, Wn.settled(mean, F.col(f"__size_{key}_{cols.amount}"))).alias(f"{key}_PctChangeFromAvg")]
    for v in (cols.value, cols.amount):
        new += A.amount_stats_columns(key, v) + Wn.drift_columns(key, v, o.drift_days)
    if o.cumulative:
        new += [((F.col("__now") - F.col("__first")) / HOUR_US).alias(f"{key}_CumHours"),
                F.coalesce(F.col(cols.amount) - F.col("__pa"), F.lit(0.0)).alias(f"{key}_AmountDelta"),
                F.coalesce(F.col(cols.value) - F.col("__pv"), F.lit(0.0)).alias(f"{key}_ValueDelta")]
    return raw.select(*names, *keep, *new)


def add_key_block(df: DataFrame, key: str, o: FeatureOptions, cols: Columns, hot_rows: int | None = None,
                  source: DataFrame | None = None) -> DataFrame:
    """All windows of one key: one shuffle for ordinary keys."""
    raw = Wn.over_key(df.withColumn("__now", micros(cols.ts)), key, key_features(key, o, cols), cols, hot_rows=hot_rows,
                      source=df if source is None else source)
    return _finish_block(raw, df.columns, key, o, cols)


def _add_counted_block(df: DataFrame, key: str, o: FeatureOptions, cols: Columns, hot_rows: int | None, source: DataFrame) -> DataFrame:
    return A.daily_count(add_key_block(df, key, o, cols, hot_rows, source), key, cols=cols, source=source)


def _nested_block(key: str, outer: str, o: FeatureOptions, cols: Columns, hot_rows: int | None) -> tuple:
    """A block of ``over_nested_keys``: windows and daily count of a key inside ``outer``."""
    day = W.partitionBy(*dict.fromkeys((outer, key)), F.to_date(cols.ts))
    finish = lambda raw, names: _finish_block(raw, names, key, o, cols).select("*", F.count(F.lit(1)).over(day).alias(f"Daily_{key}_TxnCount"))
    return key, key_features(key, o, cols), finish, lambda rows, source: _add_counted_block(rows, key, o, cols, hot_rows, source)


def build_features(df: DataFrame, state: FeatureState, o: FeatureOptions = FeatureOptions(), cols: Columns = DEFAULT,
                   hot_rows: int | None = None) -> DataFrame:
    """The feature table of ``df``; the label, if present, is carried along and never used."""
    keys = [cols.account, cols.customer, *([cols.client] if o.use_client else [])]
    group_key = cols.client if o.use_client else cols.account
    # tables of statistics are computed from the narrow source, never from the growing feature table
    source = R.add_client_key(df, cols) if o.use_client else df
    # statistics are joined and windows run on rows that are as narrow as they can be; what a row tells by itself is added last and never moved
    out = A.batch_features(source, cols, source)
    batch = out.columns[len(source.columns):]
    sizes = {r["column"]: r["count"] for r in state.rates.groupBy("column").count().collect()} if o.rate_columns else {}
    for c in o.rate_columns:
        table = state.rates.where(F.col("column") == c).select(F.col("category").alias(c), F.col("rate").alias(f"{c}_FraudRate"))
        out = A.lookup_with_fallback(out, F.broadcast(table) if sizes.get(c, 0) <= MAX_BROADCAST_KEYS else table, c, source)
    if o.seasonal:
        out = S.seasonal_features(out, group_key, cols=cols, source=source)
    if o.fft:
        out = S.fft_features(out, group_key, cols=cols, source=source)
    if o.lomb_scargle:
        out = S.lomb_scargle_features(out, group_key, cols=cols, source=source)
    if o.session_gap_minutes is not None:
        out = Wn.sessionize(out, group_key, o.session_gap_minutes, cols, hot_rows, source)
        sessions = A.session_stats(Wn.sessionize(source, group_key, o.session_gap_minutes, cols, hot_rows), group_key, cols=cols)
        out = attach(out, sessions, [group_key, "SessionId"])
    joined = out.columns[len(source.columns) + len(batch):]
    # the block that is moved again first, then those that one shuffle serves
    before = out.columns
    out = add_key_block(out, cols.customer, o, cols, hot_rows, source)
    blocks = {cols.customer: out.columns[len(before):]}
    groups = [k for k in keys if k != cols.customer]
    before = out.columns
    if all(Wn.one_outer(source, k, groups[0]) for k in groups[1:]):
        out = Wn.over_nested_keys(out, [_nested_block(k, groups[0], o, cols, hot_rows) for k in groups], cols, hot_rows=hot_rows, source=source)
    else:
        for key in groups:
            out = _add_counted_block(out, key, o, cols, hot_rows, source)
    added = out.columns[len(before):]
    ends = [added.index(f"Daily_{k}_TxnCount") + 1 for k in groups]
    blocks |= {k: added[a:b] for k, a, b in zip(groups, [0, *ends], ends)}
    out = R.calendar_features(out, cols)
    calendar = [c for c in out.columns if c not in {*source.columns, *batch, *joined, *(c for k in keys for c in blocks[k])}]
    out = out.select(*source.columns, *calendar, *[c for k in keys for c in blocks[k]], *batch, *joined)
    if o.crosses:
        out = R.temporal_identity_crosses(R.cross_features(out, cols=cols), cols)
    if o.cycles:
        out = R.cyclical_sincos(out)
    if o.splines:
        out = R.periodic_spline(out, list(o.spline_columns), {c: tuple(v) for c, v in state.ranges.items()})
    if o.cumulative:
        out = R.night_weekend_crosses(R.debit_and_ratio(out, cols), cols)
    if o.n_clusters > 0:
        out = checkpoint(out)   # read twice below
        from txrisk.operators.models import client_clusters
        means = [cols.amount, cols.value, f"{group_key}_TimeSinceLast", "IsWeekend", "IsNight", "IsMonthEnd", "IsMonthStart",
                 *[f"{group_key}_Count_{Wn.label_us(w)}" for w in o.count_windows_us], f"{group_key}_MovingAvg_{o.moving_rows}",
                 *[f"{group_key}_{v}_{k}_{d}d" for v in (cols.amount, cols.value) for k in ("RatioToMean", "Z") for d in o.drift_days]]
        profile = A.client_profile(out, group_key, means, cols=cols)
        numeric = [f"cluster_{c}" for c in [*means, "Hour", "DayOfWeek", "DayOfMonth"]]
        labels = client_clusters(profile, group_key, numeric, [f"cluster_{c}" for c in cols.categoricals], o.n_clusters)
        out = attach(out, attach(profile, labels, group_key), group_key)
    return R.finalise_features(out, list(o.drop))
