"""Which features may be served: by their own declaration, and by what they are built on.

A feature is as bad as the worst feature that it reaches through its inputs, however long the chain. Every round passes
each feature's verdict on to what is built on it, as a join and a minimum; verdicts only get worse, so rounds end after
the longest chain that still changes one, cycles included. Pairs of a feature and all that it reaches are never made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decisions as D

#: Verdicts from the worst on; the last two may be served.
VERDICTS = ("NON_SERVABLE_FUTURE", "NON_SERVABLE_POST_EVENT", "NON_SERVABLE_CIRCULAR", "NON_SERVABLE_UNKNOWN", "SERVABLE", "OPTIONAL_SERVABLE")
SERVED = 4
#: Words of time semantics, and what a declaration has to say.
FUTURE, FUTURE_PARTS = ("future", "forward", "post_prediction"), ("t+1", "t+5", "future", "forward")
POST_EVENT = ("post_event", "realized_outcome", "same_event_output")
DOCUMENTED = ("source", "training_builder", "serving_builder", "transformation", "fill_policy")


def own_verdict(candidate_version: str) -> Column:
    """Place in VERDICTS of a declaration (feature, source, builders, transformation, fill_policy, time_semantics,
    upstream_model_version, available, depends_on_output, required) taken by itself.
    """
    semantics = F.lower(F.trim(F.coalesce("time_semantics", F.lit(""))))
    future = semantics.isin(*FUTURE)
    for part in FUTURE_PARTS:
        future = future | semantics.contains(part)
    after = semantics.isin(*POST_EVENT) | semantics.contains("post-event")
    upstream = F.lower(F.trim(F.coalesce("upstream_model_version", F.lit(""))))
    circular = F.coalesce("depends_on_output", F.lit(False)) | ((F.col("feature") == "feature_probability_up") & upstream.isin("", candidate_version.lower()))
    said = F.lit(True)
    for column in DOCUMENTED:
        said = said & (F.trim(F.coalesce(column, F.lit(""))) != "")
    unknown = ~F.coalesce("available", F.lit(False)) | ~said
    return F.when(future, 0).when(after, 1).when(circular, 2).when(unknown, 3).when(F.coalesce("required", F.lit(True)), 4).otherwise(5)


def audit(declarations: DataFrame, candidate_version: str, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """feature, own, classification, servable, inherited; ``inputs`` names the features that one is built on.

    An input that nobody declared is unknown.
    """
    verdicts = F.array(*map(F.lit, VERDICTS))
    own = declarations.select("feature", own_verdict(candidate_version).alias("own"), F.coalesce("inputs", F.array().cast("array<string>")).alias("inputs"))
    own = stored(own, "features-own")
    links = stored(own.select("feature", F.explode("inputs").alias("input")).distinct(), "features-links")
    now = own.select("feature", F.col("own").alias("verdict"))
    while True:
        known = now.select(F.col("feature").alias("input"), F.col("verdict").alias("of"))
        below = links.join(known, "input", "left").select("feature", F.coalesce("of", F.lit(3)).alias("of")).where(F.col("of") < SERVED)
        worst = below.groupBy("feature").agg(F.min("of").alias("of"))
        step = now.join(worst, "feature", "left").select("feature", F.least("verdict", "of").alias("verdict"), F.coalesce(F.col("of") < F.col("verdict"), F.lit(False)).alias("moved"))
        step = stored(step, "features-verdicts")
        now = step.select("feature", "verdict")
        if step.where("moved").isEmpty():
            break
    of = lambda c: F.element_at(verdicts, F.col(c) + 1)
    both = own.join(now, "feature")
    return both.select("feature", of("own").alias("own"), of("verdict").alias("classification"), (F.col("verdict") >= SERVED).alias("servable"), (F.col("verdict") < F.col("own")).alias("inherited"))


def labelled(rows: DataFrame, symbol: str, mature: Column) -> DataFrame:
    """Decisions that can be learned from, with labels: ``rows`` has event_date, recommendation, ret_1 and ret_5.

    A symbol is trimmed, in capitals, and begins with a letter; a decision is mature up to the day ``mature``; it needs a
    recommendation and one of the returns. Labels of a missing return are null.
    """
    name = F.upper(F.trim(symbol))
    able = name.rlike("^[A-Z][A-Z0-9.-]{0,14}$") & (F.col("event_date") <= mature) & (F.trim("recommendation") != "") & (F.col("ret_1").isNotNull() | F.col("ret_5").isNotNull())
    r = F.col("ret_5")
    of = lambda c: F.when(r.isNotNull(), c.cast("int"))
    return rows.where(F.coalesce(able, F.lit(False))).withColumns({"symbol": name, "label_up_5d": of(r > 0), "label_drawdown_5d": of(r <= -0.02), "return_bin_5d": F.when(r.isNotNull(), D.return_bucket(r))})
