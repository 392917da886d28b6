"""What adjusting for splits changes: distributions before and after, rows that stay suspicious, rows that a split touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as W
from . import asof as A
from . import evaluation as E

#: Returns beyond which a row is suspicious, by field.
SUSPICIOUS = {"feature_return_1d_lagged": 1.0, "feature_return_5d_lagged": 3.0, "feature_return_20d_lagged": 5.0}
FIELDS = (*SUSPICIOUS, "return_5d", "feature_volatility_20d", "feature_price_vs_sma_20", "feature_macd_hist")
SHARES = {"median": 0.5, "p99": 0.99, "p99_5": 0.995, "p99_9": 0.999}


def windows(bars: DataFrame, splits: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """symbol, bar_date, the ends of its feature and label windows, and FIELDS as structs before and after adjustment.

    Feature windows reach back 20 bars (or to the first one), label windows five bars ahead; a close is adjusted by the
    factor of all splits up to its day. A symbol has few splits, so bars meet their list. Columns of ``also`` stay.
    """
    w = W.by_symbol()
    own = ["symbol", "bar_date", *also]
    of = A.cumulative_factor(splits).groupBy(F.col("ticker").alias("_ticker")).agg(F.sort_array(F.collect_list(F.struct("execution_date", "factor"))).alias("_factors"))
    b = bars.join(of, F.col("symbol") == F.col("_ticker"), "left")
    factor = F.coalesce(F.try_element_at(F.filter("_factors", lambda f: f["execution_date"] <= F.col("bar_date")), F.lit(-1))["factor"], F.lit(1.0))
    b = b.select(*own, F.col("close_px").alias("before"), (F.col("close_px") / factor).alias("after"))
    ends = {"feature_from": F.first("bar_date").over(w.rowsBetween(-20, 0)), "label_to": F.lead("bar_date", 5).over(w)}
    steps = {f"_{side}_step": W.lagged_return(side, 1, w) for side in ("before", "after")}
    b = b.withColumns(ends | steps)
    fields = {}
    for side in ("before", "after"):
        fields |= {f"_{side}_{n}": W.lagged_return(side, n, w) for n in (5, 20)}
        fields |= {f"_{side}_next": W.forward_return(side, 5, w), f"_{side}_spread": W.full(f"_{side}_step", F.stddev_pop(f"_{side}_step").over(W.trailing(w, 20)), w, 20), f"_{side}_sma": W.safe_ratio(F.col(side), W.moving_average(side, 20, w)) - 1}
    b = b.withColumns(fields)
    sides = ("before", "after")
    lines = {f"_{side}_{name}": (side, span) for side in sides for name, span in (("fast", 12), ("slow", 26))}
    b = W.with_ema_in_place(b, lines | {f"_{side}_signal": ((f"_{side}_fast", f"_{side}_slow"), 9) for side in sides})
    b = b.withColumns({f"_{side}_macd": F.col(f"_{side}_fast") - F.col(f"_{side}_slow") - F.col(f"_{side}_signal") for side in sides})
    held = lambda side: F.struct(*(F.col(f"_{side}_{c}").alias(f) for c, f in zip(("step", "5", "20", "next", "spread", "sma", "macd"), FIELDS))).alias(side)
    return b.select(*own, "feature_from", "label_to", held("before"), held("after"))


def training_rows(decisions: DataFrame, windows_: DataFrame) -> DataFrame:
    """Decisions (seq, symbol, event_date) with the windows of the last bar up to their day; without a bar they go."""
    met = A.backward_asof(decisions.select("seq", "symbol", "event_date"), windows_, "symbol", "event_date", "bar_date", ["feature_from", "label_to", "before", "after"])
    return met.where("met IS NOT NULL").select("seq", "symbol", "event_date", F.col("met._at").alias("bar_date"), "met.feature_from", "met.label_to", "met.before", "met.after")


def decided_rows(decisions: DataFrame, bars: DataFrame, splits: DataFrame) -> DataFrame:
    """``training_rows`` of all ``windows``, with decisions laid beside the last bar up to their day before windows are made.

    So only narrow rows move: windows with their fields are never shuffled.
    """
    days = bars.select("symbol", "bar_date", "close_px")
    met = A.backward_asof(decisions.select("seq", "symbol", "event_date"), days.select("symbol", "bar_date"), "symbol", "event_date", "bar_date", []).where("met IS NOT NULL")
    asked = met.groupBy("symbol", F.col("met._at").alias("bar_date")).agg(F.collect_list(F.struct("seq", "event_date")).alias("_asked"))
    held = days.join(asked, ["symbol", "bar_date"], "left")
    rows = windows(held, splits, ("_asked",)).where("_asked IS NOT NULL").withColumn("_one", F.explode("_asked"))
    return rows.select("_one.seq", "symbol", "_one.event_date", "bar_date", "feature_from", "label_to", "before", "after")


def long(rows: DataFrame) -> DataFrame:
    """A row for each version and field that has a value."""
    cells = F.array(*(F.struct(F.lit(side).alias("version"), F.lit(f).alias("field"), F.col(f"{side}.{f}").alias("value")) for side in ("before", "after") for f in FIELDS))
    return rows.select("seq", "symbol", "event_date", "bar_date", "feature_from", F.inline(cells)).where("value IS NOT NULL AND NOT isnan(value)")


def _beyond() -> F.Column:
    limit = F.lit(None).cast("double")
    for field, most in SUSPICIOUS.items():
        limit = F.when(F.col("field") == field, most).otherwise(limit)
    return F.coalesce(F.abs("value") > limit, F.lit(False))


def distributions(rows: DataFrame) -> DataFrame:
    """version, field, n, least, most, mean, percentiles by the lower nearest rank, and how many values are suspicious."""
    cells = long(rows)
    by = ["version", "field"]
    plain = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.count(F.when(_beyond(), 1)).alias("suspicious"))
    return plain.join(E.nearest_rank(cells, by, "value", SHARES), by)


def crossing(rows: DataFrame, splits: DataFrame, starts: str, ends: str) -> DataFrame:
    """id, n: training rows whose window (starts, ends] holds the split. Rows with one window are counted before they meet."""
    same = rows.where(F.col(ends).isNotNull()).groupBy("symbol", starts, ends).agg(F.count(F.lit(1)).alias("n"))
    inside = (F.col("symbol") == F.col("ticker")) & (F.col("execution_date") > F.col(starts)) & (F.col("execution_date") <= F.col(ends))
    return same.join(splits.select("id", "ticker", "execution_date"), inside).groupBy("id").agg(F.sum("n").alias("n"))


def audit(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Each split with the training rows whose features and whose labels it touches."""
    of = lambda starts, ends, name: crossing(rows, splits, starts, ends).withColumnRenamed("n", name)
    out = splits.select("id", "ticker", "execution_date", "adjustment_type").join(of("feature_from", "bar_date", "affected_feature_rows"), "id", "left").join(of("bar_date", "label_to", "affected_label_rows"), "id", "left")
    return out.na.fill(0, ["affected_feature_rows", "affected_label_rows"])


def suspicious(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Suspicious values of both versions with the splits of their feature window: a window has few."""
    odd = long(rows).where(_beyond())
    inside = (F.col("symbol") == F.col("ticker")) & (F.col("execution_date") > F.col("feature_from")) & (F.col("execution_date") <= F.col("bar_date"))
    met = odd.join(splits.select("id", "ticker", "execution_date"), inside, "left")
    ids = met.groupBy("seq", "symbol", "event_date", "version", "field", "value").agg(F.concat_ws(",", F.sort_array(F.collect_list("id"))).alias("split_ids"))
    return ids.withColumn("known_split", F.col("split_ids") != "")


def write_reports(rows: DataFrame, splits: DataFrame, path: str) -> None:
    """Both reports as folders of JSON lines under ``path``: split_audit and before_after."""
    audit(rows, splits).write.mode("overwrite").json(f"{path}/split_audit")
    distributions(rows).write.mode("overwrite").json(f"{path}/before_after")
