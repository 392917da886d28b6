"""Backtests of many models at once: models are rows of a table of coefficients, not jobs.

Decisions are dealt out by (day, symbol) once. Every decision meets every model there (the table of models is small and
broadcast), and what belongs to one symbol and day is collapsed where it lies; days, rankings and models follow from
partial aggregates of that. So a suite costs one scan and one shuffle of the decisions, however many models it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from . import modeling as L

#: Returns from which a gain or a loss is a big one, and bins of the calibration.
BIG_GAIN, BIG_LOSS, BINS = 0.03, -0.03, 5
#: Positive rates and shares of big losses that a scope allows.
SCOPE_LIMITS = {
    "main_decision_candidate": (0.02, 0.60, 0.02),
    "high_conviction_overlay_candidate": (0.005, 0.25, 0.01),
    "ranking_only_candidate": (0.0, 1.0, 0.05),
    "research_only": (0.0, 1.0, 1.0),
    "not_usable": (0.0, 1.0, 1.0),
}
_SCOPES = {
    "research_only": ("decision_stump", "shallow_decision_tree", "hard_example_linear"),
    "high_conviction_overlay_candidate": ("two_stage_risk_filter", "abstention_linear"),
    "main_decision_candidate": ("logistic_regression", "calibrated_linear"),
}


def lane(candidate_lane: Column, family: Column) -> Column:
    ranks = (candidate_lane == "ranking") | (family == "ranking_top5_model")
    return F.when(ranks, "ranking").otherwise("decision")


def usage_scope(model_type: Column, its_lane: Column) -> Column:
    scope = F.when((its_lane == "ranking") | (model_type == "ranking_lane_linear"), "ranking_only_candidate")
    for name, types in _SCOPES.items():
        scope = scope.when(model_type.isin(*types), name)
    return scope.otherwise("not_usable")


def scope_limits(scope: Column) -> Column:
    """Struct (min_positive_rate, max_positive_rate, max_big_loss_rate)."""
    names = ("min_positive_rate", "max_positive_rate", "max_big_loss_rate")
    limits = {k: F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values))) for k, values in SCOPE_LIMITS.items()}
    chain = F.lit(None)
    for name, value in limits.items():
        chain = F.when(scope == name, value).otherwise(chain)
    return chain


def scored_by_all(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """Every row under every model: ``models`` has model, threshold, slope, intercept and a weight ``w_<feature>`` each."""
    dealt = rows.repartition("event_date", "symbol")
    both = dealt.crossJoin(F.broadcast(models))  # a suite's models
    z = F.col("intercept")
    for f in features:
        z = z + F.col(f"w_{f}") * F.col(f)
    both = both.withColumn("score", F.round(D.clipped_sigmoid(z), 9))
    return both.withColumn("selected", (F.col("score") >= F.col("threshold")).cast("int"))


def collapsed(scored: DataFrame, y: str, ret: str) -> DataFrame:
    """One row for each (model, event_date, symbol): means of what is distinct, and sums over all rows for their measures.

    Equal rows say nothing more about returns, so they count once there; a symbol is selected on a day by most of them.
    """
    once = scored.groupBy("model", "event_date", "symbol", "score", "selected", F.col(y).alias("y"), F.col(ret).alias("ret")).agg(F.count(F.lit(1)).alias("k"))
    k, hit, loss, gain = F.col("k"), F.col("selected") == 1, F.col("ret") < BIG_LOSS, F.col("ret") >= BIG_GAIN
    total = lambda x: F.sum(k * x)
    share = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1))
    of_bin = [f(F.when(share == b, x)).alias(f"{n}_{b}") for b in range(BINS) for n, f, x in (("bn", F.sum, k), ("bp", F.sum, k * F.col("score")), ("by", F.sum, k * F.col("y")))]
    return once.groupBy("model", "event_date", "symbol").agg(
        F.avg("score").alias("score"), F.avg("selected").alias("rate"), F.avg("y").alias("y"), F.avg("ret").alias("ret"),
        F.sum("k").alias("rows"), total((F.col("selected") == F.col("y")).cast("int")).alias("right"), total(F.col("selected")).alias("picks"), total((F.col("score") - F.col("y")) ** 2).alias("error"),
        total((hit & (F.col("ret") < 0)).cast("int")).alias("falls"), F.sum(F.when(hit & (F.col("ret") < 0), k * F.col("ret"))).alias("fallen"),
        total(loss.cast("int")).alias("losses"), total((hit & loss).cast("int")).alias("loss_picks"), total(gain.cast("int")).alias("gains"), total((hit & gain).cast("int")).alias("gain_picks"), *of_bin,
    )


def daily(canonical: DataFrame, cost: float) -> DataFrame:
    """One row for each (model, event_date): the cohort's return, the selected ones' after costs, and sums of the rest."""
    own = F.col("rate") >= 0.5
    sums = [c for c in canonical.columns if c not in ("model", "event_date", "symbol", "score", "rate", "y", "ret")]
    day = canonical.groupBy("model", "event_date").agg(
        F.avg("ret").alias("universe"), F.avg(F.when(own, F.col("ret"))).alias("gross"), F.count(F.when(own, 1)).alias("entries"), F.sum(F.when(own, F.col("ret"))).alias("entry_returns"), F.max("picks").alias("most_picks"), *(F.sum(c).alias(c) for c in sums))
    net = F.when(F.col("entries") > 0, F.col("gross") - cost).otherwise(0.0)
    return day.withColumn("net", net).withColumn("excess", F.col("net") - F.col("universe"))


def date_local_ranking(canonical: DataFrame, k: int = 5) -> DataFrame:
    """model, top_return, top_precision, top_symbols: the k best scores of every day; tasks send k rows of a day at most."""
    order = Window.partitionBy("model", "event_date").orderBy(F.desc(F.round("score", 9)), "symbol")
    top = canonical.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("model").agg(F.avg("ret").alias("top_return"), F.avg((F.col("y") >= 0.5).cast("double")).alias("top_precision"), F.countDistinct("symbol").alias("top_symbols"))


def bootstrap(days: DataFrame, width: int = 5, resamples: int = 500) -> DataFrame:
    """model, lower, upper, positive: means of resampled blocks of ``width`` days; ``days`` has a row for each model and day."""
    n = F.row_number().over(Window.partitionBy("model").orderBy("event_date")) - 1
    blocks = days.withColumn("block", F.floor(n / width)).groupBy("model", "block").agg(F.avg("excess").alias("mean"))
    draws = blocks.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("model"))).select("model", F.col("block").alias("draw"), "n", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("resample"))
    picked = draws.select("model", "resample", F.pmod(F.lit(7919) * F.col("resample") + F.lit(104729) * F.col("draw") + F.pmod(F.col("resample") * F.col("draw"), F.lit(31)), F.col("n")).alias("block"))
    means = picked.join(blocks, ["model", "block"]).groupBy("model", "resample").agg(F.avg("mean").alias("mean"))
    q = lambda p: F.percentile("mean", F.lit(p))
    return means.groupBy("model").agg(q(0.025).alias("lower"), q(0.975).alias("upper"), F.avg((F.col("mean") > 0).cast("double")).alias("positive"))


def first_half(rows: DataFrame, order: list[str]) -> Column:
    """Condition for the first half of rows in order of (event_date, *order): day counts say in which day the middle lies."""
    days = rows.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    upto = days.withColumns({"upto": F.sum("n").over(Window.orderBy("event_date")), "half": F.floor(F.sum("n").over(whole) / 2)})  # one row a day
    middle = upto.where("upto > half").orderBy("event_date").first()
    if middle is None:
        return F.lit(True)
    within = rows.where(F.col("event_date") == F.lit(middle["event_date"])).select(F.struct(*order).alias("k"))
    left = middle["half"] - (middle["upto"] - middle["n"])
    cut = within.orderBy("k").offset(left).limit(1).first()["k"]
    return (F.col("event_date") < F.lit(middle["event_date"])) | ((F.col("event_date") == F.lit(middle["event_date"])) & (F.struct(*order) < F.struct(*(F.lit(cut[c]).alias(c) for c in order))))


def drift(rows: DataFrame, features: list[str], order: list[str]) -> DataFrame:
    """One row: the largest shift of a feature's mean from the first half to the second, in deviations of the first."""
    half = rows.withColumn("_first", first_half(rows, order))
    shifts = []
    for f in features:
        of = lambda g, side: g(F.when(F.col("_first") == side, F.col(f)))  # noqa: B023, E731
        deviation = of(F.stddev_pop, True)
        shifts.append(F.abs(of(F.avg, False) - of(F.avg, True)) / F.when(deviation > 1e-12, deviation).otherwise(1.0))
    return half.agg(F.greatest(*shifts, F.lit(0.0)).alias("shift"))


def report(rows: DataFrame, models: DataFrame, features: list[str], y: str, ret: str, cost_bps: float = 10.0, min_rows: int = 20, max_ece: float = 0.2, min_excess: float = 0.0, max_shift: float = 3.0, order: tuple[str, ...] = ("ts", "seq"), stored: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> DataFrame:
    """One row for each model of ``models`` (model, model_type, candidate_lane, family, slope, threshold, intercept, weights):
    its measures, the gates it fails, its scope, its rank, and whether no other model of its lane dominates it.

    ``stored`` writes a table and reads it back: the decisions are then computed once, and the table of (model, day) too.
    """
    rows = stored(rows, "suite-rows")
    canonical = collapsed(scored_by_all(rows, models, features), y, ret)
    days = stored(daily(canonical, 2 * cost_bps / 10_000), "suite-days")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    ece = F.try_divide(sum((F.coalesce(F.abs(F.sum(f"bp_{b}") - F.sum(f"by_{b}")), F.lit(0.0)) for b in range(BINS)), F.lit(0.0)), F.sum("rows"))
    m = days.groupBy("model").agg(
        F.sum("rows").alias("rows"), F.sum("entries").alias("entries"), F.round(ratio("right", "rows"), 6).alias("accuracy"), F.round(ratio("picks", "rows"), 6).alias("positive_rate"), F.round(ratio("error", "rows"), 6).alias("brier"), F.round(ece, 6).alias("ece"),
        F.round(F.avg("net"), 6).alias("net_return"), F.round(F.avg("excess"), 6).alias("excess_return"), F.round(ratio("entry_returns", "entries"), 6).alias("entry_return"), F.round(-ratio("fallen", "falls"), 6).alias("downside"),
        F.round(ratio("loss_picks", "losses"), 6).alias("big_loss_rate"), F.round(ratio("gain_picks", "gains"), 6).alias("big_gain_capture"), F.sum("picks").alias("picks"), F.round(F.coalesce(F.try_divide(F.max("most_picks"), F.sum("picks")), F.lit(0.0)), 6).alias("concentration"),
    )
    top = date_local_ranking(canonical).select("model", F.round("top_return", 6).alias("top_return"), F.round("top_precision", 6).alias("top_precision"), "top_symbols")
    sure = bootstrap(days).select("model", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.round("positive", 6).alias("positive"))
    about = models.select("model", "model_type", "slope", lane(F.col("candidate_lane"), F.col("family")).alias("lane"))
    m = m.join(F.broadcast(about), "model").join(top, "model").join(sure, "model").crossJoin(F.broadcast(drift(rows, features, list(order))))  # one row
    m = stored(m, "suite-measures")  # a row for each model: the frontier meets it several times
    m = m.withColumn("scope", usage_scope(F.col("model_type"), F.col("lane")))
    limits = scope_limits(F.col("scope"))
    main = F.col("scope") == "main_decision_candidate"
    issues = {
        "insufficient_rows": F.col("rows") < min_rows,
        "underperforms_aligned_universe_after_costs": F.col("excess_return") < min_excess,
        # Returns at a horizon's end say nothing of the way there, so this gate stays shut.
        "drawdown_evidence_unavailable": F.lit(True),
        "calibration_gate_failed": F.col("ece") > max_ece,
        "drift_gate_failed": F.col("shift") > max_shift,
        "bootstrap_profit_confidence_failed": F.col("lower") < 0,
        "positive_rate_below_scope_minimum": F.col("positive_rate") < limits["min_positive_rate"],
        "positive_rate_above_scope_maximum": F.col("positive_rate") > limits["max_positive_rate"],
        "big_loss_prediction_rate_above_scope_limit": F.col("big_loss_rate") > limits["max_big_loss_rate"],
        "selected_trade_count_too_small": (F.col("picks") < 10) & main,
        "calibration_invalid_negative_slope": F.col("slope") < 0,
        "not_main_decision_candidate": ~main,
    }
    m = m.withColumn("issues", F.concat_ws(",", F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in issues.items()))))))
    m = m.withColumn("ready", (F.col("issues") == "") & main).withColumn("shadow", ~F.col("ready") & F.col("scope").isin("research_only", "ranking_only_candidate", "high_conviction_overlay_candidate"))
    # A suite's models are few.
    ranked = Window.orderBy(F.desc("ready"), F.desc("top_return"), F.desc("excess_return"), F.desc("net_return"), "ece", "model")
    m = m.withColumn("rank", F.row_number().over(ranked))
    m = m.withColumns({"_fit": F.when(F.col("lane") == "ranking", F.col("top_return")).otherwise(F.col("net_return")), "_error": F.when(F.col("lane") == "ranking", F.lit(0.0)).otherwise(-F.col("brier")), "_loss": -F.col("big_loss_rate")})
    able = m.where("model_type <> 'baseline_classifier'")
    front = [L.undominated(able.where(F.col("lane") == name), "model", ["lower", "_fit", "_error", "_loss"]).select("model") for name in ("decision", "ranking")]
    kept = front[0].unionByName(front[1]).withColumn("retained", F.lit(True))
    out = m.join(F.broadcast(kept), "model", "left").withColumn("retained", F.coalesce("retained", F.lit(False)))
    return out.withColumn("shadow", F.col("shadow") & F.col("retained")).drop("_fit", "_error", "_loss", "slope", "model_type", "shift")


def promising(suite: DataFrame, routed: list[str], limit: int = 3) -> DataFrame:
    """Retained candidates for shadow logging that no user is routed to, best rank first."""
    open_ = suite.where(F.col("shadow") & ~F.col("model").isin(*routed)) if routed else suite.where("shadow")
    return open_.orderBy("rank").limit(limit)
