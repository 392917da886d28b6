"""Choice of a decision threshold from one histogram.

A decision is counted in the cell of its window, symbol and score, where scores are told apart only by the thresholds
between them. Running sums of the cells from the highest score down are the measures of every threshold in every window, so
one scan serves them all, and what follows is a table of (window, threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .suite import BIG_GAIN, BIG_LOSS

#: The thresholds that are tried, and what a choice has to show.
THRESHOLDS = (0.55, 0.575, 0.60, 0.625, 0.65, 0.675, 0.70)
LEAST_CAPTURE, LEAST_PICKS, SHARE_OF_CURRENT, MOST_OF_ONE_SYMBOL = 0.10, 10, 0.25, 0.50
LEAST_GAINS, LEAST_DATES, LEAST_SYMBOLS, MOST_SPREAD, AGREES = 10, 5, 5, 0.05, 0.025


def row_windows(rows: DataFrame, at: str, order: list[str], n: int) -> DataFrame:
    """Rows with ``window`` 1 to n, of equal numbers of rows in order of (at, *order), the first ones a row longer.

    Days find their ranks first, and a row its rank within its day, so no task orders all rows.
    """
    days = rows.groupBy(at).agg(F.count(F.lit(1)).alias("_rows"))
    upto = days.withColumns({"_before": F.sum("_rows").over(Window.orderBy(at)) - F.col("_rows"), "_total": F.sum("_rows").over(Window.partitionBy())})  # one row a day
    ranked = rows.join(F.broadcast(upto.drop("_rows")), at).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(at).orderBy(*order)))
    size, more = F.floor(F.col("_total") / n), F.col("_total") % n
    long = more * (size + 1)
    window = F.when(F.col("_rank") <= long, F.ceil(F.col("_rank") / (size + 1))).otherwise(more + F.ceil((F.col("_rank") - long) / size))
    return ranked.withColumn("window", window.cast("int")).drop("_before", "_total", "_rank")


def cells(rows: DataFrame, score: str, ret: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Sums for each (window, symbol, step): ``step`` thresholds lie at or below the score."""
    step = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    r = F.col(ret)
    return rows.groupBy("window", "symbol", step.alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(r).alias("ret"), F.sum(F.greatest(-r, F.lit(0.0))).alias("down"), F.count(F.when(r < BIG_LOSS, 1)).alias("losses"), F.count(F.when(r >= BIG_GAIN, 1)).alias("gains"))


def grid(cell: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """window (0: all), step (from 1), threshold and its picks, utility, losses, loss_rate, capture and concentration."""
    cell = cell.unionByName(cell.withColumn("window", F.lit(0)))
    sums = ("n", "ret", "down", "losses", "gains")
    by_step = cell.groupBy("window", "step").agg(*(F.sum(c).alias(c) for c in sums))
    steps = cell.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(thresholds)], "at int, threshold double")
    # A threshold takes all cells from its step up: a few steps for each window.
    above = by_step.join(F.broadcast(steps), F.col("step") >= F.col("at")).groupBy("window", "at").agg(*(F.sum(c).alias(c) for c in sums))
    whole = by_step.groupBy("window").agg(F.sum("losses").alias("all_losses"), F.sum("gains").alias("all_gains"))
    own = cell.join(F.broadcast(steps), F.col("step") >= F.col("at")).groupBy("window", "at", "symbol").agg(F.sum("n").alias("n")).groupBy("window", "at").agg(F.max("n").alias("most"))
    frame = whole.crossJoin(F.broadcast(steps)).join(above, ["window", "at"], "left").join(own, ["window", "at"], "left")
    ratio = lambda a, b: F.try_divide(F.col(a), F.col(b))
    capture = F.coalesce(ratio("gains", "all_gains"), F.lit(0.0))
    utility = ratio("ret", "n") - ratio("down", "n") - ratio("losses", "n") + 0.1 * capture
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return frame.select("window", F.col("at").alias("step"), "threshold", zero("n").alias("picks"), utility.alias("utility"), zero("losses").alias("losses"), F.coalesce(ratio("losses", "all_losses"), F.lit(0.0)).alias("loss_rate"), capture.alias("capture"), F.coalesce(ratio("most", "n"), F.lit(0.0)).alias("concentration"))


def guarded(table: DataFrame, current: int) -> DataFrame:
    """The grid beside its window's current threshold, with the guardrails that each threshold breaks."""
    now = table.where(F.col("step") == current).select("window", *(F.col(c).alias(f"now_{c}") for c in ("picks", "utility", "losses", "loss_rate")))
    both = table.join(F.broadcast(now), "window")
    broken = {
        "big_losses": (F.col("losses") > 0) & (F.col("losses") > F.col("now_losses")),
        "big_loss_rate": F.col("loss_rate") > F.col("now_loss_rate"),
        "big_gain_capture": F.col("capture") < LEAST_CAPTURE,
        "picks": F.col("picks") < F.greatest(F.lit(float(LEAST_PICKS)), SHARE_OF_CURRENT * F.col("now_picks")),
        "concentration": F.col("concentration") > MOST_OF_ONE_SYMBOL,
    }
    return both.withColumn("broken", F.concat_ws(",", *(F.when(c, name) for name, c in broken.items())))


def chosen(table: DataFrame, current: int, tolerance: float) -> DataFrame:
    """window, step, threshold: the middle of each window's widest plateau of guarded thresholds near the best utility.

    The current threshold stays if it lies on that plateau, if nothing passes, or if nothing does better.
    """
    one = Window.partitionBy("window")
    able = guarded(table, current).where("broken = '' AND utility IS NOT NULL")
    near = able.withColumn("best", F.max("utility").over(one)).where(F.col("utility") >= F.col("best") - tolerance)
    near = near.withColumn("run", F.col("step") - F.row_number().over(one.orderBy("step")))
    runs = near.groupBy("window", "run").agg(F.count(F.lit(1)).alias("width"), F.max("utility").alias("top"), F.sort_array(F.collect_list("step")).alias("steps"), F.first("now_utility").alias("now"))
    best = runs.withColumn("r", F.row_number().over(one.orderBy(F.desc("width"), F.desc("top"), "run"))).where("r = 1")
    middle = F.element_at("steps", (F.floor((F.col("width") - 1) / 2) + 1).cast("int"))
    picked = best.select("window", "steps", "now", middle.alias("to"))
    top = picked.join(table.select("window", F.col("step").alias("to"), F.col("utility").alias("to_utility")), ["window", "to"])
    stays = F.array_contains("steps", current) | (F.coalesce("now", F.lit(float("-inf"))) >= F.col("to_utility"))
    step = top.select("window", F.when(stays, current).otherwise(F.col("to")).alias("step"))
    every = table.select("window").distinct().join(step, "window", "left").select("window", F.coalesce("step", F.lit(current)).alias("step"))
    return every.join(table.select("window", "step", "threshold"), ["window", "step"])


def recommendation(rows: DataFrame, cell: DataFrame, current: int, tolerance: float = 0.002, thresholds: tuple[float, ...] = THRESHOLDS, min_rows: int = 30) -> DataFrame:
    """One row: the best guarded threshold, whether windows agree, whether support suffices, and what is recommended.

    ``rows`` has event_date, symbol and window, and ``cell`` is its histogram.
    """
    table = grid(cell, thresholds)
    now = thresholds[current - 1]
    support = rows.agg(F.count_distinct("event_date").alias("dates"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("window").alias("windows"))
    gains = cell.agg(F.sum("gains").alias("gains"))
    at = table.where((F.col("window") == 0) & (F.col("step") == current)).select(F.col("picks"), F.col("utility"), F.col("capture"), F.col("concentration"))
    held = support.crossJoin(gains).crossJoin(at)  # one row each
    enough = (F.col("picks") >= LEAST_PICKS) & (F.col("gains") >= LEAST_GAINS) & (F.col("dates") >= LEAST_DATES) & (F.col("symbols") >= LEAST_SYMBOLS) & (F.col("capture") > 0) & (F.coalesce("utility", F.lit(-1.0)) >= 0) & (F.col("concentration") <= MOST_OF_ONE_SYMBOL)
    choice = chosen(table, current, tolerance)
    best = choice.where("window = 0").select(F.col("step").alias("best_step"), F.col("threshold").alias("best"))
    held = held.withColumn("supported", enough).crossJoin(best).withColumn("best_step", F.when(F.col("supported"), F.col("best_step")).otherwise(current)).withColumn("best", F.when(F.col("supported"), F.col("best")).otherwise(now))
    sized = cell.groupBy("window").agg(F.sum("n").alias("rows"))
    full = sized.crossJoin(F.broadcast(support.select("windows"))).where(F.col("rows") >= F.greatest(F.lit(1), F.floor(F.lit(min_rows) / F.col("windows"))))
    proposed = guarded(table, current).crossJoin(F.broadcast(held.select("best_step"))).where((F.col("window") > 0) & (F.col("step") == F.col("best_step"))).join(full, "window")
    wins = (F.col("broken") == "") & F.coalesce(F.col("utility") > F.col("now_utility"), F.lit(False))
    forward = proposed.agg(F.count(F.lit(1)).alias("evaluated"), F.coalesce(F.min(wins), F.lit(False)).alias("all_win"))
    apart = choice.where("window > 0").join(full, "window").crossJoin(F.broadcast(held.select("best")))
    steady = apart.agg(F.max("threshold").alias("high"), F.min("threshold").alias("low"), F.count(F.lit(1)).alias("k"), F.count(F.when(F.abs(F.col("threshold") - F.col("best")) <= AGREES + 1e-9, 1)).alias("agree"))
    out = held.crossJoin(forward).crossJoin(steady)
    moved = F.col("best_step") != current
    consistent = moved & (F.col("evaluated") >= 2) & F.col("all_win")
    stable = moved & (F.col("k") >= 2) & (F.col("high") - F.col("low") <= MOST_SPREAD + 1e-9) & (F.col("agree") >= F.greatest(F.lit(2), F.ceil(F.col("k") * 2 / 3)))
    change = consistent & stable
    return out.select(F.lit(now).alias("current"), "best", "supported", consistent.alias("consistent"), stable.alias("stable"), "evaluated", F.when(change, F.col("best")).otherwise(now).alias("recommended"))
