"""Validation of decisions against what came of them: metrics in one pass, gates, and a recommendation; hygiene of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions.windows import STRETCH, stretch

#: Limits of the gates.
LIMITS = {
    "minimum_evaluated_rows": 30.0, "calibration_brier": 0.26, "brier_regression": 0.01, "average_net_return": 0.0, "recommendation_churn": 0.35, "stale_data_rate": 0.05, "fallback_rate": 0.20,
    "adverse_excursion_regression": 0.02,
}
WAITS = ("SELL", "HOLD OFF FOR NOW")
PERIODS = ("fit", "calibration", "threshold_selection", "final_test")


def share(x: Column) -> Column:
    """A probability from a share or a percentage, kept within 0 and 1."""
    p = F.when(x > 1, x / 100).otherwise(x)
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def churn(rows: DataFrame, by: list[str], key: str, at: str, tie: str, value: str, days: float = STRETCH) -> DataFrame:
    """``by``, transitions and changes of ``value`` from row to row of a key, by (at, tie).

    Rows meet their neighbour within a stretch of time; the ends of stretches, one row each, meet afterwards.
    """
    part = rows.withColumn("_part", stretch(rows, at, days))
    group = [*by, key]
    step = F.lag(value).over(Window.partitionBy(*group, "_part").orderBy(at, tie))
    place = F.struct(at, tie)
    inner = part.withColumn("_step", step).groupBy(*group, "_part").agg(F.count("_step").alias("t"), F.count(F.when(F.col("_step") != F.col(value), 1)).alias("c"), F.min_by(value, place).alias("_first"), F.max_by(value, place).alias("_last"))
    end = F.lag("_last").over(Window.partitionBy(*group).orderBy("_part"))
    both = inner.withColumn("_end", end)
    return both.groupBy(*by).agg((F.sum("t") + F.count("_end")).alias("transitions"), (F.sum("c") + F.count(F.when(F.col("_end") != F.col("_first"), 1))).alias("changes"))


def evaluated(rows: DataFrame) -> DataFrame:
    """Rows with a return that is a number and an action that says buy or wait, and what these make of them.

    ``rows``: symbol, ts, seq, action, ret, probability, cost_bps, adverse (worst return on the way), source_mode, profile,
    is_stale, is_degraded, base_action. Actions are trimmed and in capitals; a missing source mode or profile is unknown.
    """
    action = F.upper(F.trim(F.coalesce("action", F.lit(""))))
    ret = F.col("ret")
    e = rows.withColumn("action", action).where(F.col("action").isin(*D.BUY, *WAITS) & ret.isNotNull() & ~F.isnan(ret))
    waits = F.col("action").isin(*WAITS)
    base = F.upper(F.coalesce("base_action", F.lit("")))
    mode = F.coalesce(F.nullif("source_mode", F.lit("")), F.lit("unknown"))
    e = e.withColumns({
        "waits": waits, "hit": F.when(waits, ret <= 0).otherwise(ret > 0), "directional": F.when(waits, -ret).otherwise(ret), "p": share(F.col("probability")), "source_mode": mode, "profile": F.coalesce(F.nullif("profile", F.lit("")), F.lit("unknown")),
        "stale": F.coalesce("is_stale", F.lit(False)), "fallback": F.contains(F.lower(mode), F.lit("fallback")) | F.coalesce("is_degraded", F.lit(False)), "overridden": (base != "") & (base != F.col("action")),
    })
    return e.withColumns({"net": F.col("directional") - F.coalesce("cost_bps", F.lit(0.0)) / 10000, "bin": F.least(F.lit(9), F.floor(F.col("p") * 10))})


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row of metrics for each group ``by``, rounded to six digits.

    Rows are added up by (group, bin of probability), ten cells and one for a group; cells make the metrics.
    """
    e = evaluated(rows)
    n = lambda c: F.count(F.when(c, 1))
    up, waits, hit = F.col("ret") > 0, F.col("waits"), F.col("hit")
    cells = e.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), n(~waits).alias("buys"), n(~waits & hit).alias("buys_right"), n(waits).alias("waits"), n(waits & hit).alias("waits_right"), n(up).alias("ups"), F.sum("ret").alias("ret"),
        F.sum("directional").alias("directional"), F.sum("net").alias("net"), F.min("directional").alias("worst"), F.sum("adverse").alias("adverse"), F.count("adverse").alias("adverse_n"), F.min("adverse").alias("worst_adverse"),
        F.sum(F.pow(F.col("p") - up.cast("int"), 2)).alias("squares"), F.sum("p").alias("p"), n(F.col("p").isNotNull() & up).alias("p_ups"), F.count("p").alias("p_n"), n(F.col("stale")).alias("stale"), n(F.col("fallback")).alias("fallback"),
        n(F.col("overridden")).alias("overridden"),
    )
    s = lambda c: F.sum(c)
    ratio = lambda a, b: F.round(F.try_divide(s(a), s(b)), 6)
    off = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("p") - F.col("p_ups"))))
    m = cells.groupBy(*by).agg(
        s("n").alias("evaluated_rows"), ratio("squares", "p_n").alias("brier_score"), F.round(F.try_divide(off, s("p_n")), 6).alias("calibration_error"), s("p_n").alias("calibration_rows"),
        ratio("buys_right", "buys").alias("buy_precision"), ratio("buys_right", "ups").alias("buy_recall"), ratio("waits_right", "waits").alias("sell_precision"), F.round(F.try_divide(s("waits_right"), s("n") - s("ups")), 6).alias("sell_recall"),
        ratio("directional", "n").alias("avg_return"), ratio("ret", "n").alias("avg_underlying_return"), ratio("net", "n").alias("avg_net_return"), F.round(F.min("worst"), 6).alias("worst_return"),
        ratio("adverse", "adverse_n").alias("avg_max_adverse_excursion"), F.round(F.min("worst_adverse"), 6).alias("worst_max_adverse_excursion"), ratio("overridden", "n").alias("profile_override_rate"), ratio("stale", "n").alias("stale_data_rate"),
        ratio("fallback", "n").alias("fallback_rate"),
    )
    changed = churn(e, by, "symbol", "ts", "seq", "action")
    return m.join(changed, by).withColumn("recommendation_churn_rate", F.coalesce(F.round(F.try_divide("changes", "transitions"), 6), F.lit(0.0))).drop("changes", "transitions")


def gated(metrics: DataFrame, baseline: DataFrame, reviews: dict[str, bool], limits: dict[str, float] = LIMITS) -> DataFrame:
    """name, value, lim, passed, severity of each gate; ``metrics`` and ``baseline`` have one row each at most.

    Without a baseline its gates pass, the one of adverse excursions as a warning.
    """
    one = metrics.select(F.struct("*").alias("m")).join(F.broadcast(baseline.select(F.struct("*").alias("b"))), F.lit(True), "left")
    m, b = (lambda c: F.col(f"m.{c}")), (lambda c: F.col(f"b.{c}"))
    no = lambda c: F.coalesce(c, F.lit(False))
    brier, worst = m("brier_score"), m("worst_max_adverse_excursion")
    calm = F.coalesce(brier <= b("brier_score") + limits["brier_regression"], F.lit(True))
    known = worst.isNotNull() & b("worst_max_adverse_excursion").isNotNull()
    kept = F.coalesce(worst >= b("worst_max_adverse_excursion") - limits["adverse_excursion_regression"], F.lit(True))
    gate = lambda name, value, lim, passed, severity=F.lit("blocker"): F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), lim.cast("double").alias("lim"), passed.alias("passed"), severity.alias("severity"))
    most = lambda name, c: gate(name, m(c), F.lit(limits[name]), no(m(c) <= limits[name]))
    least = lambda name, c: gate(name, m(c), F.lit(limits[name]), no(m(c) >= limits[name]))
    given = lambda name, ok: gate(name, F.lit(float(ok)), F.lit(1.0), F.lit(bool(ok)))
    gates = [
        least("minimum_evaluated_rows", "evaluated_rows"), gate("calibration_brier", brier, F.lit(limits["calibration_brier"]), no(brier <= limits["calibration_brier"]) & calm), least("average_net_return", "avg_net_return"),
        most("recommendation_churn", "recommendation_churn_rate"), most("stale_data_rate", "stale_data_rate"), most("fallback_rate", "fallback_rate"),
        gate("adverse_excursion_regression", worst, b("worst_max_adverse_excursion"), kept, F.when(known, "blocker").otherwise("warning")), *(given(name, ok) for name, ok in reviews.items()),
    ]
    return one.select(F.inline(F.array(*gates)))


def report(rows: DataFrame, by: str, candidate: str, baseline: str, reviews: dict[str, bool], stored) -> DataFrame:
    """section, name, value, lim, passed, severity: metrics, counts by source mode and profile, gates, recommendation.

    Both groups are measured in the same scan; counts are the candidate's.
    """
    both = rows.where(F.col(by).isin(candidate, baseline))
    m = stored(summary(both, [by]), "validation-metrics")
    of = lambda name: m.where(F.col(by) == name).drop(by)
    shape = lambda df, section, severity=F.lit(None).cast("string"): df.select(F.lit(section).alias("section"), "name", "value", *((c if c in df.columns else F.lit(None).cast(t).alias(c)) for c, t in (("lim", "double"), ("passed", "boolean"))), (F.col("severity") if "severity" in df.columns else severity).alias("severity"))
    names = [c for c in m.columns if c != by]
    metrics = of(candidate).select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names))))
    e = evaluated(both.where(F.col(by) == candidate))
    counted = e.groupBy("source_mode", "profile").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.select("n", F.inline(F.array(F.struct(F.lit("by_source_mode").alias("section"), F.col("source_mode").alias("name")), F.struct(F.lit("by_profile").alias("section"), F.col("profile").alias("name")))))
    counts = pairs.groupBy("section", "name").agg(F.sum("n").cast("double").alias("value")).select("section", "name", "value", F.lit(None).cast("double").alias("lim"), F.lit(None).cast("boolean").alias("passed"), F.lit(None).cast("string").alias("severity"))
    gates = gated(of(candidate), of(baseline), reviews)
    failed = F.count(F.when(~F.col("passed") & (F.col("severity") == "blocker"), 1))
    verdict = gates.agg(failed.alias("n"), F.count(F.lit(1)).alias("gates")).select(F.when((F.col("n") == 0) & (F.col("gates") > 0), "promote").otherwise("hold_shadow").alias("name"), F.col("n").cast("double").alias("value"))
    return shape(metrics, "metric").unionByName(counts).unionByName(shape(gates, "gate")).unionByName(shape(verdict, "recommendation"))


def hygiene(rows: DataFrame, parameters: DataFrame, horizon: int = 5, tolerance: float = 1e-9) -> DataFrame:
    """Whether the periods of each split are clean: ``rows`` has split, period (0 to 3, as PERIODS), event_date, symbol.

    One row for each split: rows_<period>, boundaries that share days or (day, symbol) pairs or lie within the horizon,
    split_ok, purge_ok, reproduced and issues. ``parameters`` (split, name, stated, rerun) are those of its recipe; without
    any, or with one that is missing or farther off than ``tolerance``, the recipe isn't reproduced. Rows are folded by (day,
    symbol), then by day, with a bit for each period, so no set of days is held in one row.
    """
    bit = F.expr("shiftleft(1, CAST(period AS INT))")
    pairs = rows.groupBy("split", "event_date", "symbol").agg(F.bit_or(bit).alias("bits"), *(F.count(F.when(F.col("period") == i, 1)).alias(f"n{i}") for i in range(4)))
    crossed = lambda i: F.col("bits").bitwiseAND(3 << i) == (3 << i)
    days = pairs.groupBy("split", "event_date").agg(F.bit_or("bits").alias("bits"), *(F.sum(f"n{i}").alias(f"n{i}") for i in range(4)), *(F.count(F.when(crossed(i), 1)).alias(f"pairs{i}") for i in range(3)))
    held = lambda i: F.when(F.col("bits").bitwiseAND(1 << i) != 0, F.col("event_date"))
    split = days.groupBy("split").agg(
        *(F.sum(f"n{i}").alias(f"rows_{p}") for i, p in enumerate(PERIODS)), *(F.min(held(i)).alias(f"start{i}") for i in range(4)), *(F.max(held(i)).alias(f"end{i}") for i in range(4)),
        *(F.count(F.when(crossed(i), 1)).alias(f"days{i}") for i in range(3)), *(F.sum(f"pairs{i}").alias(f"pairs{i}") for i in range(3)),
    )
    every = lambda conditions: F.forall(F.array(*conditions), lambda c: F.coalesce(c, F.lit(False)))
    gap = [F.datediff(f"start{i + 1}", f"end{i}") > horizon for i in range(3)]
    same = F.coalesce(F.abs(F.col("stated") - F.col("rerun")) <= tolerance, F.lit(False))
    recipe = parameters.groupBy(F.col("split").alias("_of")).agg(F.min(same).alias("reproduced"))
    some = lambda cs: sum((F.when(c, 1).otherwise(0) for c in cs), F.lit(0))
    out = split.join(recipe, F.col("split") == F.col("_of"), "left").withColumns({
        "split_ok": every([*(F.col(f"rows_{p}") > 0 for p in PERIODS), *(F.col(f"end{i}") < F.col(f"start{i + 1}") for i in range(3))]), "purge_ok": every([*(F.col(f"{c}{i}") == 0 for c in ("days", "pairs") for i in range(3)), *gap]),
        "reproduced": F.coalesce("reproduced", F.lit(False)), "shared_days": some(F.col(f"days{i}") > 0 for i in range(3)), "shared_pairs": some(F.col(f"pairs{i}") > 0 for i in range(3)), "short_gaps": some(~F.coalesce(g, F.lit(False)) for g in gap),
    })
    issue = lambda ok, text: F.when(~F.col(ok), text)
    issues = F.concat_ws(";", issue("split_ok", "periods missing or out of order"), issue("purge_ok", "boundaries not purged"), issue("reproduced", "recipe not reproduced"))
    return out.select("split", *(f"rows_{p}" for p in PERIODS), "shared_days", "shared_pairs", "short_gaps", "split_ok", "purge_ok", "reproduced", issues.alias("issues"))


def coverage(rows: DataFrame, by: str, features: list[str]) -> DataFrame:
    """``by``, feature, n, filled, fill_rate, availability_rate: how often a model would fill a feature in.

    A column that isn't there is always filled; text that reads as a number is one.
    """
    there = set(rows.columns)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    held = lambda c: F.count(F.when(number(c).isNotNull() & ~F.isnan(number(c)), 1)) if c in there else F.lit(0).cast("long")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(held(c).alias(f"f{i}") for i, c in enumerate(features)))
    each = counts.select(by, "n", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("held")) for i, c in enumerate(features)))))
    return each.select(by, "feature", "n", (F.col("n") - F.col("held")).alias("filled"), F.round(1 - F.col("held") / F.col("n"), 6).alias("fill_rate"), F.round(F.col("held") / F.col("n"), 6).alias("availability_rate"))


def comparison_scope(rows: DataFrame, by: str, candidate: list[str], production: list[str], matches: dict[str, bool], least: int = 1000, available: float = 0.8) -> DataFrame:
    """One row for each comparison ``by``: its size, whether both models really had their features, and what it may be used for.

    ``rows`` has event_date, symbol and endpoint; a missing symbol or endpoint is unknown. ``matches`` says which policies both
    models share (target, horizon, weights, lineage). Rows are folded by (comparison, symbol, endpoint) before symbols are counted.
    """
    shares = coverage(rows, by, list(dict.fromkeys([*candidate, *production])))
    whole = lambda features: F.coalesce(F.min(F.when(F.col("feature").isin(*features), F.col("availability_rate") >= available)), F.lit(False)) if features else F.lit(False)
    covered = shares.groupBy(F.col(by).alias("_of")).agg(whole(candidate).alias("candidate_covered"), whole(production).alias("production_covered"))
    folded = rows.groupBy(by, F.upper(F.coalesce("symbol", F.lit("unknown"))).alias("_symbol"), F.coalesce("endpoint", F.lit("unknown")).alias("_endpoint")).agg(F.count(F.lit(1)).alias("n"), F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    size = folded.groupBy(by).agg(F.sum("n").alias("n"), F.min("first").alias("first_day"), F.max("last").alias("last_day"), F.count_distinct("_symbol").alias("symbols"), F.count_distinct("_endpoint").alias("endpoints"))
    narrow = F.col("n") < least
    reasons = [F.when(narrow, "too few rows"), F.when(~F.col("production_covered"), "production features filled"), F.when(~F.col("candidate_covered"), "candidate features incomplete"), *(F.lit(f"{name} differs") for name, same in matches.items() if not same)]
    alike = F.col("production_covered") & F.col("candidate_covered") & F.lit(all(matches.values()))
    out = size.join(covered, F.col(by).eqNullSafe(F.col("_of")), "left").na.fill(False, ["candidate_covered", "production_covered"])
    return out.select(
        by, "n", "first_day", "last_day", "symbols", "endpoints", F.when(narrow, "narrow_diagnostic").otherwise("holdout-only").alias("scope"), "candidate_covered", "production_covered", alike.alias("like_with_like"),
        (alike & ~narrow).alias("evidence"), F.concat_ws("; ", *reasons).alias("reasons"),
    )
