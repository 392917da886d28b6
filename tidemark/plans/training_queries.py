"""Queries of training snapshots, of feature columns by name, and of the reports on splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import windows as W
from ..operators import snapshots as S
from ..operators import split_reports as R
from ..sources import market as M
from ..sources.files import stored
from .join_queries import _FACTORS
from .registry import query
from .report_queries import _PWEIGHT
from .window_queries import _INDEXED, _W, _ema_sql, _f

_GOOD, _BAD = ("thatin", "hehely", "ering"), ("ononst", "orantion", "oning")
_hits = lambda words: " + ".join(f"CAST(contains(lower(title), '{w}') AS INT)" for w in words)


def _macd_sql(source: str, value: str, name: str) -> str:
    """<name>l (symbol, i, macd) and <name>g (symbol, i, v): MACD and its signal from the first bar on."""
    return ",\n".join([_ema_sql(source, value, 12, f"{name}f"), _ema_sql(source, value, 26, f"{name}w"), f"{name}l AS (SELECT a.symbol, a.i, a.v - b.v AS macd FROM {name}f a JOIN {name}w b ON a.symbol = b.symbol AND a.i = b.i)", _ema_sql(f"{name}l", "macd", 9, f"{name}g")])


_SNAPSHOT = _INDEXED.replace("WITH RECURSIVE ", "WITH RECURSIVE " + M.SQL["news"] + ",\n", 1) + ",\n" + _macd_sql("b", "close_px", "m") + f""",
n AS (SELECT symbol, published_ts, {_PWEIGHT} AS w, CASE WHEN p + q > 0 THEN (p - q) / CAST(p + q AS DOUBLE) ELSE 0e0 END AS tone FROM (SELECT *, {_hits(_GOOD)} AS p, {_hits(_BAD)} AS q FROM news)),
t AS (SELECT symbol, bar_date, CAST(epoch(CAST(bar_date AS TIMESTAMP)) AS BIGINT) AS ts FROM bars),
k AS (SELECT t.symbol, t.bar_date, round(coalesce(sum(tone * w) / sum(w), 0), 4) AS news_sentiment_score, CAST(count(tone) FILTER (ts - published_ts <= 86400) AS DOUBLE) AS news_headline_count_24h, round(coalesce(avg(w), 0), 4) AS news_source_score_72h,
  round(coalesce(avg(tone) FILTER (ts - published_ts <= 86400), 0), 4) AS news_momentum_24h, round(coalesce(avg(tone), 0), 4) AS news_momentum_72h FROM t LEFT JOIN n ON n.symbol = t.symbol AND published_ts <= ts AND ts - published_ts <= 259200 GROUP BY 1, 2),
c AS (SELECT *, close_px - lag(close_px) OVER w AS delta FROM b {_W}),
f AS (SELECT symbol, bar_date, i, close_px, volume, close_px / lag(close_px) OVER w - 1 AS return_1d, close_px / lag(close_px, 5) OVER w - 1 AS return_5d,
  CASE WHEN count(delta) {_f(14)} = 14 THEN 100 - 100 / (1 + avg(greatest(delta, 0e0)) {_f(14)} / nullif(avg(greatest(-delta, 0e0)) {_f(14)}, 0)) END AS rsi_14,
  volume / nullif(CASE WHEN count(volume) {_f(20)} = 20 THEN avg(volume) {_f(20)} END, 0) AS vol_ratio_20d, lead(close_px, 5) OVER w / close_px - 1 AS forward_return_5d FROM c {_W})
"""


@query("src10_training_snapshot", _SNAPSHOT + """SELECT f.symbol, f.bar_date, close_px, volume, news_sentiment_score, news_headline_count_24h, news_source_score_72h, news_momentum_24h, news_momentum_72h, round(return_1d, 6) AS return_1d, round(return_5d, 6) AS return_5d, round(rsi_14, 5) AS rsi_14,
  round(l.macd - g.v, 6) AS macd_hist, round(vol_ratio_20d, 6) AS vol_ratio_20d, round(forward_return_5d, 6) AS forward_return_5d, CASE WHEN forward_return_5d > 0 THEN 1e0 ELSE 0e0 END AS label_up_5d
FROM f JOIN k USING (symbol, bar_date) JOIN ml l ON l.symbol = f.symbol AND l.i = f.i JOIN mg g ON g.symbol = f.symbol AND g.i = f.i""")
def training_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Bars of all symbols with their news, indicators and labels, by symbol and day."""
    news = M.news(spark, d).select("symbol", "published_ts", F.expr(_PWEIGHT).alias("weight"), D.keyword_sentiment(F.col("title"), list(_GOOD), list(_BAD)).alias("tone"))
    rounded = {"return_1d": 6, "return_5d": 6, "rsi_14": 5, "macd_hist": 6, "vol_ratio_20d": 6, "forward_return_5d": 6}
    s = S.training_snapshot(M.bars(spark, d), news)
    return s.select("symbol", "bar_date", "close_px", "volume", *(c for c in s.columns if c.startswith("news_")), *(F.round(c, n).alias(c) for c, n in rounded.items()), "label_up_5d")


_NUMBERS = {
    "feature_return_1d_lagged": "count(r)", "feature_rsi_written": "count(*) FILTER (volume > 40)", "feature_price_to_low": "count(*)", "feature_Volume_ratio": "count(*)",
}


@query("flt06_market_features", M.with_views("bars", more=f"x AS (SELECT *, close_px / lag(close_px) OVER w - 1 AS r FROM bars {_W})") + " UNION ALL ".join(f"SELECT '{c}' AS feature, {n} AS n FROM x" for c, n in _NUMBERS.items()))
def market_features(spark: SparkSession, d: str) -> DataFrame:
    """Of a wide frame of bars the columns that a market-only model may use: some echo models, tell outcomes or hold no number."""
    close, volume = F.col("close_px"), F.col("volume")
    ret = W.lagged_return("close_px", 1, W.by_symbol())
    written = F.when(volume > 40, F.format_string(" %.2f", close)).otherwise("n/a")
    frame = M.bars(spark, d).select(
        "symbol", "bar_date", ret.alias("feature_return_1d_lagged"), written.alias("feature_rsi_written"), (close / F.col("low_px")).alias("feature_price_to_low"), (volume / 10).alias("feature_Volume_ratio"),
        F.lit("rising").alias("feature_trend_word"), F.lit(float("nan")).alias("feature_beta_60"), close.alias("feature_color"), close.alias("return_ratio"), close.alias("feature_probability_up"), close.alias("feature_days_since_last_signal"),
        close.alias("feature_return_5d"), close.alias("feature_future_return"), close.alias("feature_Label_volume"), close.alias("feature_rec_trend"), close.alias("feature_source_volume"), close.alias("feature_endpoint_spy"),
    )
    return S.market_features(frame)


_DECLARED = (*S.CONTRACT, "feature_vwap_20", "Feature_rsi_14", "feature_rec_buy", "feature_future_return_5d", "x_Outcome_5d")


@query("flt07_contract_breaches", f"""WITH c AS (SELECT DISTINCT 'm' || (p_partkey % 97) AS model, list_extract([{", ".join(f"'{c}'" for c in _DECLARED)}], CAST((p_partkey * 7 + p_size) % {len(_DECLARED)} + 1 AS INTEGER)) AS feature FROM part)
SELECT model, feature, CASE WHEN regexp_matches(lower(feature), 'rec_|future_|outcome_') THEN 'forbidden' ELSE 'unlisted' END AS reason FROM c WHERE feature NOT IN ({", ".join(f"'{c}'" for c in S.CONTRACT)})""")
def contract_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Columns that models declare outside the contract of eleven, by model."""
    pick = (F.pmod(F.col("p_partkey") * 7 + F.col("p_size"), F.lit(len(_DECLARED))) + 1).cast("int")
    name = F.element_at(F.array(*map(F.lit, _DECLARED)), pick)
    declared = M.table(spark, d, "part").select(F.concat(F.lit("m"), F.pmod("p_partkey", F.lit(97)).cast("string")).alias("model"), name.alias("feature")).distinct()
    return declared.withColumn("reason", S.contract_breach(F.col("feature"))).where("reason IS NOT NULL")


_SIDES = {"before": "close_px", "after": "adj"}
_COLUMNS = {
    "feature_return_1d_lagged": "{s}_r", "feature_return_5d_lagged": "{c} / lag({c}, 5) OVER w - 1", "feature_return_20d_lagged": "{c} / lag({c}, 20) OVER w - 1", "return_5d": "lead({c}, 5) OVER w / {c} - 1",
    "feature_volatility_20d": f"CASE WHEN count({{s}}_r) {_f(20)} = 20 THEN stddev_pop({{s}}_r) {_f(20)} END", "feature_price_vs_sma_20": f"{{c}} / CASE WHEN count({{c}}) {_f(20)} = 20 THEN avg({{c}}) {_f(20)} END - 1", "feature_macd_hist": "{s}_macd",
}
_TRAINED = (
    M.with_views("bars", "decisions", "splits", more=_FACTORS + """, b AS (SELECT b.symbol, b.bar_date, close_px, close_px / coalesce(factor, 1e0) AS adj, row_number() OVER (PARTITION BY b.symbol ORDER BY b.bar_date) AS i FROM bars b ASOF LEFT JOIN f ON f.ticker = b.symbol AND b.bar_date >= f.execution_date)""").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + ",\n" + _macd_sql("b", "close_px", "p") + ",\n" + _macd_sql("b", "adj", "q") + f""",
g AS (SELECT b.*, pl.macd - pg.v AS before_macd, ql.macd - qg.v AS after_macd FROM b JOIN pl USING (symbol, i) JOIN pg USING (symbol, i) JOIN ql USING (symbol, i) JOIN qg USING (symbol, i)),
h AS (SELECT *, first_value(bar_date) OVER (PARTITION BY symbol ORDER BY bar_date ROWS 20 PRECEDING) AS feature_from, lead(bar_date, 5) OVER w AS label_to, close_px / lag(close_px) OVER w - 1 AS before_r, adj / lag(adj) OVER w - 1 AS after_r FROM g {_W}),
e AS (SELECT symbol, bar_date, feature_from, label_to, """ + ", ".join(f"{x.format(s=s, c=c)} AS {s}_{f}" for s, c in _SIDES.items() for f, x in _COLUMNS.items()) + f""" FROM h {_W}),
y AS (SELECT d.seq, d.event_date, e.* FROM decisions d ASOF JOIN e ON d.symbol = e.symbol AND d.event_date >= e.bar_date),
z AS (""" + " UNION ALL ".join(f"SELECT seq, symbol, event_date, bar_date, feature_from, '{s}' AS version, '{f}' AS field, {s}_{f} AS value, {R.SUSPICIOUS.get(f, 'NULL')} AS lim FROM y WHERE {s}_{f} IS NOT NULL" for s in _SIDES for f in _COLUMNS) + ")"
)
_INSIDE = "s.ticker = {0}.symbol AND s.execution_date > {0}.{1} AND s.execution_date <= {0}.{2}"


def split_rows(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with features and labels before and after adjustment, written once: reports read them several times."""
    return stored(R.decided_rows(M.decisions(spark, d), M.bars(spark, d), M.splits(spark, d)), "split-rows")


@query("snk11_before_after", _TRAINED + ", k AS (SELECT *, row_number() OVER (PARTITION BY version, field ORDER BY value) AS k, count(*) OVER (PARTITION BY version, field) AS n FROM z) SELECT version, field, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, count(*) FILTER (abs(value) > lim) AS suspicious, "
    + ", ".join(f"round(min(value) FILTER (k >= floor((n - 1) * {q}e0) + 1), 6) AS {name}" for name, q in R.SHARES.items()) + " FROM k GROUP BY 1, 2")
def before_after(spark: SparkSession, d: str) -> DataFrame:
    rounded = ("least", "most", "mean", *R.SHARES)
    return R.distributions(split_rows(spark, d)).select("version", "field", "n", "suspicious", *(F.round(c, 6).alias(c) for c in rounded))


@query("snk11_split_audit", _TRAINED + f", u AS (SELECT s.id, count(*) AS n FROM y JOIN splits s ON {_INSIDE.format('y', 'feature_from', 'bar_date')} GROUP BY 1), v AS (SELECT s.id, count(*) AS n FROM y JOIN splits s ON {_INSIDE.format('y', 'bar_date', 'label_to')} GROUP BY 1) SELECT id, ticker, execution_date, adjustment_type, coalesce(u.n, 0) AS affected_feature_rows, coalesce(v.n, 0) AS affected_label_rows FROM splits LEFT JOIN u USING (id) LEFT JOIN v USING (id)")
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    return R.audit(split_rows(spark, d), M.splits(spark, d))


@query("snk11_suspicious_rows", _TRAINED + f", o AS (SELECT z.seq, z.symbol, z.event_date, version, field, round(value, 6) AS value, coalesce(string_agg(s.id, ',' ORDER BY s.id), '') AS split_ids FROM z LEFT JOIN splits s ON {_INSIDE.format('z', 'feature_from', 'bar_date')} WHERE abs(value) > lim GROUP BY ALL) SELECT *, split_ids <> '' AS known_split FROM o")
def suspicious_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.suspicious(split_rows(spark, d), M.splits(spark, d)).withColumn("value", F.round("value", 6))
