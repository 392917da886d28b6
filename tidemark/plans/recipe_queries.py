"""Queries of recipe grids: selection over folds, calibrated and two-stage recipes, hard examples, the suite they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..operators import modeling as L
from ..operators import recipes as R
from ..operators import suite as S
from ..operators import trees as T
from ..sources.files import stored
from .evaluation_queries import _SCORED, scored
from .model_queries import labelled
from .registry import query
from .suite_queries import _ROWS, FEATURES, suite_rows

#: First day of each validation year; a fold fits on what ends a week before.
FOLDS = {"f1": "1998-01-01", "f2": "1999-01-01", "f3": "2000-01-01"}
MOMENTUM = tuple(f for f in L.FEATURES if any(t in f for t in ("ret", "rsi", "macd", "volume")))
ABLATIONS = {"no-market": tuple(f for f in L.FEATURES if f not in ("bench_ret_5", "relative_5", "risk_on")), "momentum": MOMENTUM, "no-volume": tuple(f for f in L.FEATURES if f != "volume_ratio")}
TAIL_SAFE = {"big_loss": 8.0, "loss": 2.0, "big_gain": 3.0}


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labelled bars with the fold they validate, whether each fold fits on them, and the weights of each policy."""
    rows = labelled(spark, d).withColumn("bucket", D.return_bucket(F.col("ret_next")))
    day = F.col("bar_date")
    ends = [*list(FOLDS.values())[1:], "2002-01-01"]
    fold = F.lit(None).cast("string")
    for (name, start), end in zip(FOLDS.items(), ends):
        rows = rows.withColumn(f"fit_{name}", day < F.date_sub(F.lit(start).cast("date"), 7))
        fold = F.when((day >= start) & (day < end), name).otherwise(fold)
    tail = F.lit(1.0)
    for bucket, weight in TAIL_SAFE.items():
        tail = F.when(F.col("bucket") == bucket, weight).otherwise(tail)
    fit = rows.withColumns({"fold": fold, "recent": F.col("fit_f2") & (day >= "1996-06-01"), "tail": day.between("1999-01-08", "1999-12-24"), "w_tail": tail})
    fit = fit.withColumns({"big_loss": (F.col("bucket") == "big_loss").cast("double"), "w_risk": F.when(F.col("bucket") == "big_loss", 10.0).otherwise(1.0)})
    fit = stored(fit, "recipe-rows")
    share = fit.agg(*(F.avg(F.when(F.col(c), F.col("up"))).alias(c) for c in ("fit_f2", "recent"))).first()
    half = lambda p: F.when(F.col("up") == 1, 0.5 / max(p or 0.0, 1e-9)).otherwise(0.5 / max(1 - (p or 0.0), 1e-9))
    return fit.withColumns({"w_fit_f2": half(share["fit_f2"]), "w_recent": half(share["recent"])})


def fold_scores(spark: SparkSession, rows: DataFrame, fits: list[R.Fit], threshold: float = 0.5) -> DataFrame:
    """recipe and its mean measures over folds: every fold's fit scores the rows that its fold validates, in one scan."""
    models = R.models(spark, fits, L.FEATURES, threshold).withColumns({"recipe": F.substring_index("model", "@", 1), "fold": F.substring_index("model", "@", -1)})
    z = F.col("intercept")
    for f in L.FEATURES:
        z = z + F.col(f"w_{f}") * F.col(f)
    x = rows.where("fold IS NOT NULL").join(F.broadcast(models), "fold").withColumn("p", D.clipped_sigmoid(z))
    hit, ret = F.col("p") >= F.col("threshold"), F.col("ret_next")
    share = lambda c: F.try_divide(F.count(F.when(hit & c, 1)), F.count(F.when(c, 1)))
    each = x.groupBy("recipe", "fold").agg(F.avg((F.col("p") - F.col("up")) ** 2).alias("brier"), F.avg(F.when(hit, ret)).alias("ret"), share(ret < S.BIG_LOSS).alias("loss"), share(ret >= S.BIG_GAIN).alias("gain"))
    return each.groupBy("recipe").agg(F.avg("brier").alias("brier"), F.coalesce(F.avg("ret"), F.lit(-1.0)).alias("avg_return"), F.avg(F.coalesce("loss", F.lit(1.0))).alias("big_loss"), F.avg(F.coalesce("gain", F.lit(0.0))).alias("big_gain"))


#: Of recipes the one of least error, then highest return, fewest big losses, most big gains.
ORDER = (F.asc, "brier"), (F.desc, "avg_return"), (F.asc, "big_loss"), (F.desc, "big_gain"), (F.asc, "recipe")


def select_recipe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All recipes with their measures; ablations are of the best full one. Two shared fits, however many recipes."""
    on_folds = lambda name, features, l2, scaler: [R.Recipe(f"{name}@{fold}", tuple(features), "up", l2, f"fit_{fold}", None, scaler) for fold in FOLDS]
    grid = {f"{scaler}-l2-{l2:g}-all": (scaler, l2) for scaler in ("standard", "robust", "none") for l2 in (0.001, 0.01, 0.1)}
    full = fold_scores(spark, rows, R.fit_many(rows, [r for name, (scaler, l2) in grid.items() for r in on_folds(name, L.FEATURES, l2, scaler)]))
    full = stored(full, "recipe-scores")
    best = full.orderBy(*(o(c) for o, c in ORDER)).first()["recipe"]
    scaler, l2 = grid[best]
    less = R.fit_many(rows, [r for name, features in ABLATIONS.items() for r in on_folds(f"{best}-{name}", features, l2, scaler)])
    return full.unionByName(fold_scores(spark, rows, less))


@query("ml14_selection")
def selection(spark: SparkSession, d: str) -> DataFrame:
    """The grid of scalers and penalties with its ablations, best recipe first."""
    found = select_recipe(spark, training_rows(spark, d)).orderBy(*(o(c) for o, c in ORDER))
    return found.select("recipe", *(F.round(c, 6).alias(c) for c in ("brier", "avg_return", "big_loss", "big_gain")))


def linear_recipes() -> list[R.Recipe]:
    """Subset of features, window and weighting of each calibrated linear recipe."""
    subsets = {"all": tuple(L.FEATURES), "momentum": MOMENTUM}
    weights = {"balanced": lambda window: f"w_{window}", "tail_safe": lambda window: "w_tail"}
    return [R.Recipe(f"{s}-{window}-{w}", features, "up", 0.01, window, of(window)) for s, features in subsets.items() for window in ("fit_f2", "recent") for w, of in weights.items()]


def calibrated(spark: SparkSession, rows: DataFrame, fits: list[R.Fit]) -> dict[str, tuple[float, float]]:
    """(slope, intercept) of each fit's logit on the tail that no fit has seen: once more a shared fit."""
    logits = []
    for k, f in enumerate(fits):
        weights, intercept = f.raw()
        logits.append(sum((F.col(c) * w for c, w in weights.items()), F.lit(intercept)).alias(f"z{k}"))
    tail = rows.where("tail").select("up", *logits)
    found = R.fit_many(tail, [R.Recipe(f.recipe.name, (f"z{k}",), "up", 1e-6, None, None, "none") for k, f in enumerate(fits)])
    return {f.recipe.name: (float(f.weights[0]), f.intercept) for f in found}


def suite_models(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The table of models that the recipes give: calibrated linear ones, the two-stage risk model and the hard-example one."""
    fits = R.fit_many(rows, [*linear_recipes(), R.Recipe("seed", tuple(L.FEATURES), "up", 0.01, "fit_f2"), R.Recipe("risk", tuple(L.FEATURES), "big_loss", 0.01, "fit_f2", "w_risk")])
    weights, intercept = fits[-2].raw()
    seeded = rows.where("fit_f2").withColumn("p", L.linear_score(weights, intercept)).withColumn("key", F.concat_ws("|", "symbol", "bar_date"))
    hard = R.fit_many(stored(R.hard_examples(seeded, "p", 0.5, "bucket", "key"), "recipe-hard"), [R.Recipe("hard", tuple(L.FEATURES), "up", 0.01, None, "weight")])
    fits = [*fits, *hard]
    slopes = calibrated(spark, rows, fits)
    kinds = {"seed": "logistic_regression", "risk": "not_usable", "hard": "hard_example_linear"}
    out = []
    for f in fits:
        weights, intercept = f.raw()
        slope, shift = slopes[f.recipe.name]
        out.append((f.recipe.name, kinds.get(f.recipe.name, "calibrated_linear"), "decision", "", slope, 0.5, slope * intercept + shift, *(slope * weights.get(c, 0.0) for c in L.FEATURES)))
    return spark.createDataFrame(out, "model string, model_type string, candidate_lane string, family string, slope double, threshold double, intercept double, " + ", ".join(f"w_{c} double" for c in L.FEATURES))


@query("ml20_suite")
def trained_suite(spark: SparkSession, d: str) -> DataFrame:
    """Recipes trained before 1999, calibrated on that year, and backtested on what follows; ``alike`` models pick the same rows."""
    rows = training_rows(spark, d)
    models = suite_models(spark, rows)
    holdout = rows.where("bar_date >= '2000-01-01'").withColumnRenamed("bar_date", "event_date").select("symbol", "event_date", "ret_next", "up", *L.FEATURES)
    report = S.report(holdout, models, L.FEATURES, "up", "ret_next", order=("symbol",), stored=stored)
    picks = S.scored_by_all(holdout, models, L.FEATURES).groupBy("model").agg(F.bit_xor(F.when(F.col("selected") == 1, F.xxhash64("symbol", "event_date")).otherwise(F.lit(0).cast("long"))).alias("print"))
    alike = picks.groupBy("print").agg(F.count(F.lit(1)).alias("alike"))
    return report.join(F.broadcast(picks.join(alike, "print").select("model", "alike")), "model")


@query("ml09_recipes")
def recipes(spark: SparkSession, d: str) -> DataFrame:
    """recipe, its slope and intercept of calibration, and its Brier score on the holdout before and after."""
    rows = training_rows(spark, d)
    fits = R.fit_many(rows, linear_recipes())
    slopes = calibrated(spark, rows, fits)
    parts = []
    for f in fits:
        weights, intercept = f.raw()
        z = sum((F.col(c) * w for c, w in weights.items()), F.lit(intercept))
        a, b = slopes[f.recipe.name]
        error = lambda x: F.round(F.avg((D.clipped_sigmoid(x) - F.col("up")) ** 2), 6)
        parts.append(F.struct(F.lit(f.recipe.name).alias("recipe"), F.lit(len(weights)).alias("features"), F.lit(round(a, 6)).alias("slope"), F.lit(round(b, 6)).alias("intercept"), error(z).alias("raw_brier"), error(a * z + b).alias("brier")))
    return rows.where("bar_date >= '2000-01-01'").agg(F.array(*parts).alias("r")).select(F.inline("r"))


def acceptance(rows: DataFrame, p: str, risk: str, ret: str, threshold: float, limits: list[float]) -> DataFrame:
    """For each limit of risk: what is accepted (p at the threshold or above, risk at the limit or below) and what that spares."""
    wanted, r = F.col(p) >= threshold, F.col(ret)
    parts = []
    for limit in limits:
        taken = wanted & (F.col(risk) <= limit)
        left = wanted & (F.col(risk) > limit)
        n = lambda c: F.count(F.when(c, 1))
        parts.append(F.struct(F.lit(limit).alias("risk_limit"), n(taken).alias("accepted"), n(left).alias("rejected"), F.avg(F.when(taken, r)).alias("accepted_return"), F.avg(F.when(left, r)).alias("rejected_return"), n(left & (r < S.BIG_LOSS)).alias("losses_prevented"), n(left & (r >= S.BIG_GAIN)).alias("gains_missed")))
    return rows.agg(F.array(*parts).alias("g")).select(F.inline("g"))


RISK_LIMITS = [0.10, 0.15, 0.20, 0.25, 0.30, 0.40]
_RISK = _SCORED.rstrip() + ", k AS (SELECT *, ((ts + seq * 13) % 1000) / 1000e0 AS risk FROM s), l AS (SELECT unnest([" + ", ".join(f"{x}e0" for x in RISK_LIMITS) + "]) AS risk_limit)"


@query("ml10_acceptance", _RISK + """ SELECT risk_limit, count(*) FILTER (risk <= risk_limit) AS accepted, count(*) FILTER (risk > risk_limit) AS rejected, round(avg(r5) FILTER (risk <= risk_limit), 6) AS accepted_return, round(avg(r5) FILTER (risk > risk_limit), 6) AS rejected_return,
  count(*) FILTER (risk > risk_limit AND r5 < -0.03e0) AS losses_prevented, count(*) FILTER (risk > risk_limit AND r5 >= 0.03e0) AS gains_missed FROM k, l WHERE probability_up >= 0.55e0 GROUP BY risk_limit""")
def risk_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """The two stages' rule on given scores, all limits of risk in one scan."""
    s = scored(spark, d).withColumn("risk", ((F.col("ts") + F.col("seq") * 13) % 1000) / 1000)
    a = acceptance(s, "probability_up", "risk", "ret_5", 0.55, RISK_LIMITS)
    return a.withColumns({c: F.round(c, 6) for c in ("accepted_return", "rejected_return")})


@query("ml10_two_stage")
def two_stage(spark: SparkSession, d: str) -> DataFrame:
    """A return model and a big-loss model from one shared fit, and what their rule accepts on the holdout."""
    rows = training_rows(spark, d)
    fits = R.fit_many(rows, [R.Recipe("decision", tuple(L.FEATURES), "up", 0.01, "fit_f2", "w_tail"), R.Recipe("risk", tuple(L.FEATURES), "big_loss", 0.01, "fit_f2", "w_risk")])
    held = rows.where("bar_date >= '2000-01-01'").withColumns({f.recipe.name: L.linear_score(*f.raw()) for f in fits})
    a = acceptance(held, "decision", "risk", "ret_next", 0.3, [0.5, 0.6, 0.7, 0.8])
    return a.withColumns({c: F.round(c, 6) for c in ("accepted_return", "rejected_return")})


@query("ml11_abstention", _SCORED + "SELECT seq, CASE WHEN probability_up >= 0.6e0 THEN 1 ELSE 0 END AS prediction, probability_up >= 0.5e0 AND probability_up < 0.6e0 AS abstained FROM s")
def abstention(spark: SparkSession, d: str) -> DataFrame:
    """Within 0.05 of the threshold no call is made."""
    p, threshold, margin = F.col("probability_up"), 0.55, 0.05
    low, high = round(max(0.0, threshold - margin), 9), round(min(1.0, threshold + margin), 9)
    return scored(spark, d).select("seq", (p >= high).cast("int").alias("prediction"), ((p >= low) & (p < high)).alias("abstained"))


_HARD = _SCORED.rstrip() + """, j AS (SELECT *, CASE WHEN probability_up >= 0.6e0 AND r5 < -0.03e0 THEN floor(probability_up * 10000) WHEN probability_up < 0.6e0 AND r5 > 0.03e0 THEN floor((1 - probability_up) * 10000) END AS degree FROM s),
h AS (SELECT seq, row_number() OVER (ORDER BY degree DESC, seq) AS place, (SELECT greatest(1, floor(count(*) * 0.15e0)) FROM s) AS most FROM j WHERE degree IS NOT NULL)"""


@query("ml11_hard_examples", _HARD + " SELECT s.seq, CASE WHEN h.place <= h.most THEN 5e0 ELSE 1e0 END AS weight FROM s LEFT JOIN h USING (seq)")
def hard_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of a second fit: the worst mistakes of a first one, of at most 15 % of all rows."""
    s = scored(spark, d).withColumn("bucket", D.return_bucket(F.col("ret_5")))
    return R.hard_examples(s, "probability_up", 0.6, "bucket", "seq").select("seq", "weight")


_LONG = _ROWS + ", f AS (SELECT up, unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, unnest([" + ", ".join(FEATURES) + "]) AS v FROM x)"
_SIDE = "coalesce(2 * sum(up) FILTER ({0}) * (1 - sum(up) FILTER ({0}) / nullif(count(*) FILTER ({0}), 0)), 0)"


@query("ml12_first_splits", _LONG + f""", q AS (SELECT feature, unnest([quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75)]) AS cut FROM f GROUP BY feature), c AS (SELECT DISTINCT * FROM q)
SELECT feature, round(cut, 6) AS cut, count(*) FILTER (v < cut) AS below, round({_SIDE.format('v < cut')} + {_SIDE.format('v >= cut')}, 4) AS impurity FROM c JOIN f USING (feature) GROUP BY feature, cut""")
def first_splits(spark: SparkSession, d: str) -> DataFrame:
    """The quartile cuts of the root and their impurities."""
    c = T.candidates(stored(suite_rows(spark, d).select(*FEATURES, "up"), "tree-rows").withColumn("node", F.lit(1)), FEATURES, "up")
    return c.select("feature", F.round("cut", 6).alias("cut"), F.col("left").alias("below"), F.round(T.impurity(F.col("rows"), F.col("positives"), F.col("left"), F.col("left_positives")), 4).alias("impurity"))


@query("ml12_stumps", _LONG + """, m AS (SELECT feature, quantile_cont(v, 0.5) AS threshold FROM f GROUP BY feature), st AS (SELECT feature, threshold, direction, avg(CASE WHEN (v >= threshold) = (up = CASE WHEN direction = 'gte_positive' THEN 1 ELSE 0 END) THEN 1e0 ELSE 0e0 END) AS accuracy
  FROM f JOIN m USING (feature), (SELECT unnest(['gte_positive', 'lt_positive']) AS direction) GROUP BY ALL) SELECT feature, round(threshold, 6) AS threshold, direction, round(accuracy, 6) AS accuracy FROM st ORDER BY st.accuracy DESC, feature, direction LIMIT 8""")
def stump_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = T.stumps(stored(suite_rows(spark, d).select(*FEATURES, "up"), "stump-rows"), FEATURES, "up")
    return s.select("feature", F.round("threshold", 6).alias("threshold"), "direction", F.round("accuracy", 6).alias("accuracy"))


@query("ml12_tree")
def tree(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of a tree of depth three over all decisions, with their rows and returns."""
    rows = stored(suite_rows(spark, d), "tree-rows")
    found = T.fit_tree(rows, FEATURES, "up", max_depth=3, min_leaf=50)
    return rows.withColumn("score", F.round(T.tree_score(found), 6)).groupBy("score").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("up"), 6).alias("share_up"), F.round(F.avg("ret_5"), 6).alias("mean_return"))
