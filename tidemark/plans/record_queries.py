"""Queries of lenient record rules over decisions, news, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..sources import market as M
from .registry import query

#: Fields of raw decision records, derived from decisions alike in both engines.
FIELDS = {
    "p_rec": "CASE seq % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE ' ' || lower(action) || ' ' END",
    "p_adv": "CASE seq % 7 WHEN 0 THEN NULL WHEN 3 THEN '' ELSE 'hold' END",
    "e_rec": "CASE seq % 3 WHEN 0 THEN NULL ELSE action END",
    "e_adv": "CASE seq % 2 WHEN 0 THEN 'sell' END",
    "s_rec": "CASE seq % 9 WHEN 0 THEN 'buy' END",
    "p_prob": "CASE WHEN seq % 4 = 0 THEN probability_up END",
    "s_prob": "CASE WHEN seq % 3 = 0 THEN probability_up * 100 END",
    "e_prob": "probability_up",
    "p_provider": "CASE seq % 6 WHEN 0 THEN 'portfolio_quote_only' WHEN 1 THEN '' END",
    "e_provider": "CASE seq % 8 WHEN 1 THEN 'feed' END",
    "q_provider": "CASE seq % 5 WHEN 2 THEN 'quotes' END",
    "m_source": "CASE seq % 10 WHEN 7 THEN ' cache ' END",
    "f_ret1": "CASE WHEN seq % 2 = 0 THEN '0.01' ELSE 'NaN' END",
    "f_ret5": "CASE WHEN seq % 3 = 0 THEN ' 0.05 ' ELSE '' END",
    "f_rsi": "CASE seq % 5 WHEN 0 THEN '55' WHEN 1 THEN 'true' WHEN 2 THEN 'inf' END",
    "f_macd": "CASE seq % 7 WHEN 0 THEN '-1.5e1' ELSE 'x1' END",
    "f_volume": "CASE WHEN seq % 4 = 0 THEN '1.2' END",
    "ts_text": "CASE seq % 6 WHEN 0 THEN CAST(ts AS STRING) WHEN 1 THEN ' ' || CAST(ts AS STRING) || ' ' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '-5' END",
    "raw_symbol": "CASE seq % 13 WHEN 0 THEN ' nvdia' WHEN 1 THEN 'OLFS' WHEN 2 THEN 'FDRXX' WHEN 3 THEN 'BRK.B' WHEN 4 THEN 'BTC-USD' WHEN 5 THEN '^GSPC' WHEN 6 THEN 'APPL.' WHEN 7 THEN '' WHEN 8 THEN 'LONGER' WHEN 9 THEN NULL WHEN 10 THEN 'aapl' WHEN 11 THEN 'tsl' ELSE symbol END",
    "url_text": "CASE seq % 6 WHEN 0 THEN 'https://h.x/quote?a=1&symbol=brk.b&x=2' WHEN 1 THEN 'aapl/details' WHEN 2 THEN 'Symbol=^gspc&y=1' WHEN 3 THEN ' btc-usd ' WHEN 4 THEN 'averyveryverylongsymbolname' ELSE symbol END",
    "horizon_text": "CASE seq % 7 WHEN 0 THEN '5d' WHEN 1 THEN '10 D' WHEN 2 THEN '5day' WHEN 3 THEN 'soon' WHEN 4 THEN '0d' WHEN 5 THEN '' END",
    "lineage_text": "CASE seq % 3 WHEN 0 THEN '20d' END",
    "legacy": "CASE seq % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'old' END",
}
RAW = M.with_views("decisions", more="raw AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in FIELDS.items()) + " FROM decisions)")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return M.decisions(spark, d).select("*", *[F.expr(e).alias(n) for n, e in FIELDS.items()])


_NUM = "CASE WHEN isfinite(TRY_CAST(trim({0}) AS DOUBLE)) THEN TRY_CAST(trim({0}) AS DOUBLE) END"


@query("scl03_numbers", RAW + "SELECT seq, " + ", ".join(f"{_NUM.format(c)} AS {c}" for c in ("f_ret1", "f_ret5", "f_rsi", "f_macd", "f_volume")) + " FROM raw")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", *[R.finite(F.col(c)).alias(c) for c in ("f_ret1", "f_ret5", "f_rsi", "f_macd", "f_volume")])


@query("scl04_seconds", RAW + "SELECT seq, CASE WHEN regexp_full_match(trim(ts_text), '[0-9]+') AND CAST(trim(ts_text) AS BIGINT) > 0 THEN CAST(trim(ts_text) AS BIGINT) END AS seconds FROM raw")
def seconds(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", R.positive_seconds(F.col("ts_text")).alias("seconds"))


_ACTION = "nullif(upper(trim(coalesce(nullif(p_rec, ''), nullif(p_adv, ''), nullif(e_rec, ''), nullif(e_adv, '')))), '')"


@query("scl05_action", RAW + f"SELECT seq, {_ACTION} AS action FROM raw")
def actions(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", R.action(*map(F.col, ("p_rec", "p_adv", "e_rec", "e_adv"))).alias("action"))


@query("scl06_probability", RAW + """SELECT seq, coalesce(s_prob, p_prob, e_prob) AS training, coalesce(s_prob, p_prob) AS dataset, coalesce(p_prob, s_prob) AS calibration,
  round(greatest(0e0, least(1e0, CASE WHEN coalesce(s_prob, p_prob) > 1 THEN coalesce(s_prob, p_prob) / 100 ELSE coalesce(s_prob, p_prob) END)), 9) AS validation FROM raw WHERE coalesce(s_prob, p_prob) IS NOT NULL
UNION ALL SELECT seq, e_prob, NULL, NULL, NULL FROM raw WHERE coalesce(s_prob, p_prob) IS NULL""")  # fmt: skip
def probability(spark: SparkSession, d: str) -> DataFrame:
    p, s, e = map(F.col, ("p_prob", "s_prob", "e_prob"))
    return raw(spark, d).select("seq", F.coalesce(s, p, e).alias("training"), F.coalesce(s, p).alias("dataset"), F.coalesce(p, s).alias("calibration"), F.round(R.share(F.coalesce(s, p)), 9).alias("validation"))


_PROVIDER = "coalesce(nullif(trim(coalesce(nullif(p_provider, ''), nullif(e_provider, ''), nullif(q_provider, ''), nullif(m_source, ''))), ''), 'unknown')"


def provider() -> F.Column:
    return F.coalesce(R.blank_to_null(R.first_text(*map(F.col, ("p_provider", "e_provider", "q_provider", "m_source")))), F.lit("unknown"))


@query("scl07_provider", RAW + f"SELECT seq, {_PROVIDER} AS provider FROM raw")
def providers(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", provider().alias("provider"))


_GROUPS = " + ".join(f"CASE WHEN {_NUM.format(c)} IS NOT NULL THEN 1 ELSE 0 END" for c in ("f_ret1", "f_ret5", "f_rsi", "f_macd", "f_volume"))
_COMPLETE = f"CASE WHEN {_PROVIDER} = 'portfolio_quote_only' THEN 'quote_only' WHEN {_GROUPS} >= 3 THEN 'full_signal' WHEN {_GROUPS} > 0 THEN 'partial_signal' ELSE 'quote_only' END"


def complete() -> F.Column:
    return R.completeness(provider(), [R.finite(F.col(c)) for c in ("f_ret1", "f_ret5", "f_rsi", "f_macd", "f_volume")])


@query("scl08_completeness", RAW + f"SELECT seq, {_COMPLETE} AS completeness FROM raw")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", complete().alias("completeness"))


_SPELL = "CASE " + " ".join(f"WHEN u = '{a}' THEN '{b}'" for a, b in R.SPELLINGS.items()) + " ELSE u END"
_SYMBOLS = f"""u AS (SELECT *, upper(trim(coalesce(raw_symbol, ''))) AS u FROM raw), m AS (SELECT *, {_SPELL} AS m FROM u),
g AS (SELECT *, CASE WHEN u = '' THEN 'empty_symbol' WHEN m IN {R.BAD} THEN 'known_bad_symbol' WHEN m IN {R.FUNDS} THEN 'fund_or_cash_equivalent_symbol' WHEN seq % 40 >= 38 THEN 'cached_failure'
  WHEN contains(m, '.') THEN 'unsupported_suffix' WHEN regexp_matches(m, '[-=/]|^\\^') THEN 'unsupported_non_equity_symbol' WHEN NOT regexp_full_match(m, '[A-Z]+') THEN 'non_alpha_symbol' WHEN length(m) > 5 THEN 'implausible_length' END AS reason FROM m)"""


@query("scl09_symbol_rules", RAW.rstrip() + ",\n" + _SYMBOLS + "\nSELECT seq, CASE WHEN reason IS NULL THEN m END AS symbol, reason, m <> u AS changed FROM g")
def symbol_rules(spark: SparkSession, d: str) -> DataFrame:
    symbol, reason, changed = R.training_symbol(F.col("raw_symbol"), F.when(F.expr("seq % 40 >= 38"), 2).otherwise(0))
    return raw(spark, d).select("seq", symbol.alias("symbol"), reason.alias("reason"), changed.alias("changed"))


@query("scl10_symbol_text", RAW + """SELECT seq, substring(regexp_replace(upper(CASE WHEN regexp_matches(lower(url_text), 'symbol=') THEN regexp_extract(url_text, '.*[sS][yY][mM][bB][oO][lL]=([^&]*)', 1)
  WHEN NOT contains(url_text, '?') THEN regexp_extract(url_text, '^[^/]*', 0) ELSE url_text END), '[^A-Z0-9^.=\\-]', '', 'g'), 1, 15) AS symbol FROM raw""")  # fmt: skip
def symbol_text(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", R.symbol_of_text(F.col("url_text")).alias("symbol"))


_HOTS = [("endpoint", e) for e in ("quick_ask", "hot_momentum_buys", "user_watchlist")] + [("action", a) for a in ("BUY", "HOLD", "HOLD OFF FOR NOW", "SELL", "STRONG BUY")] + [("decision_source", s) for s in ("rules", "model", "hybrid")]
_hot = lambda c, v: f"{c}_{v.lower().replace(' ', '_')}"


@query("scl12_one_hot", M.with_views("decisions") + "SELECT seq, coalesce(probability_up, 0.5e0) AS probability, " + ", ".join(f"CAST({c} = '{v}' AS DOUBLE) AS {_hot(c, v)}" for c, v in _HOTS)
    + ", CAST(action IN ('BUY', 'STRONG BUY') AS DOUBLE) AS positive, CAST(action IN ('SELL', 'HOLD OFF FOR NOW') AS DOUBLE) AS negative FROM decisions")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    hots = [(F.col(c) == v).cast("double").alias(_hot(c, v)) for c, v in _HOTS]
    sides = [F.col("action").isin(*v).cast("double").alias(n) for n, v in (("positive", ("BUY", "STRONG BUY")), ("negative", ("SELL", "HOLD OFF FOR NOW")))]
    return M.decisions(spark, d).select("seq", F.coalesce("probability_up", F.lit(0.5)).alias("probability"), *hots, *sides)


_H = "nullif(coalesce(CASE WHEN TRY_CAST(regexp_extract(replace(lower(trim({0})), ' ', ''), '^([0-9]+)d(ay)?$', 1) AS INTEGER) > 0 THEN CAST(TRY_CAST(regexp_extract(replace(lower(trim({0})), ' ', ''), '^([0-9]+)d(ay)?$', 1) AS INTEGER) AS VARCHAR) || 'd' END, ''), '')"


@query("scl13_horizon_precedence", RAW + f"SELECT seq, coalesce({_H.format('horizon_text')}, {_H.format('lineage_text')}, CASE WHEN legacy = 'v1' THEN '5d' END, 'unknown') AS horizon FROM raw")
def horizons(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("seq", R.first_horizon(F.col("horizon_text"), F.col("lineage_text"), legacy=F.when(F.col("legacy") == "v1", "5d")).alias("horizon"))


#: Publishers' names for the sources of documents, and the words that stand for market words in invented prose.
_NAMES = "CASE CAST(substring(publisher, 4) AS INT) % 6 WHEN 0 THEN 'Reuters UK' WHEN 1 THEN 'The Wall Street Journal' WHEN 2 THEN 'Yahoo Finance' WHEN 3 THEN 'CNBC' WHEN 4 THEN 'Bloomberg' ELSE 'Some Blog' END"
_WORDS = ("thatin", "hehely")
_WEIGHT = "CASE " + " ".join(f"WHEN contains(lower(name), '{k}') THEN {v}e0" for k, v in R.PUBLISHERS.items()) + " ELSE 0.75e0 END"
_NEWS = M.with_views("news", more=f"""n AS (SELECT *, {_NAMES} AS name FROM news), t AS (SELECT *, max(published_ts) OVER () AS now_ts, {_WEIGHT} AS credibility,
  least(1e0, 0.45e0 + CASE WHEN contains(lower(title), 'er') THEN 0.3e0 ELSE 0e0 END + CASE WHEN contains(lower(title), 'ering') OR contains(lower(title), 'onor') THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN contains(lower(title), 'thatin') OR contains(lower(title), 'hehely') THEN 0.1e0 ELSE 0e0 END) AS relevance FROM n),
w AS (SELECT *, CASE WHEN (now_ts - published_ts) / 3600e0 <= 6 THEN 1e0 WHEN (now_ts - published_ts) / 3600e0 <= 24 THEN 0.85e0 WHEN (now_ts - published_ts) / 3600e0 <= 72 THEN 0.65e0 ELSE 0.4e0 END AS recency FROM t),
r AS (SELECT *, round(credibility * 0.4e0 + relevance * 0.35e0 + recency * 0.25e0, 4) AS news_score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY news_score DESC, doc_id) AS k FROM r WHERE trim(title) <> '')""")  # fmt: skip


def ranked_news(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    n = M.news(spark, d).withColumn("name", F.expr(_NAMES))
    now = n.agg(F.max("published_ts").alias("now_ts"))
    n = n.crossJoin(F.broadcast(now))  # one row
    n = n.withColumns({"credibility": R.publisher_weight(F.col("name")), "relevance": R.relevance(F.col("title"), F.lit("ER"), F.lit("ering, onor to"), _WORDS), "recency": R.recency((F.col("now_ts") - F.col("published_ts")) / 3600.0)})
    n = n.withColumn("news_score", F.round(F.col("credibility") * 0.4 + F.col("relevance") * 0.35 + F.col("recency") * 0.25, 4)).where(F.trim("title") != "")
    return n.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("news_score"), "doc_id")))


@query("scl19_publisher_weight", _NEWS + "SELECT doc_id, credibility FROM w")
def publisher_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.news(spark, d).withColumn("name", F.expr(_NAMES)).select("doc_id", R.publisher_weight(F.col("name")).alias("credibility"))


@query("scl20_relevance", _NEWS + "SELECT doc_id, round(relevance, 4) AS relevance, recency FROM k")
def relevances(spark: SparkSession, d: str) -> DataFrame:
    return ranked_news(spark, d).select("doc_id", F.round("relevance", 4).alias("relevance"), "recency")


@query("top05_ranked_news", _NEWS + "SELECT symbol, CAST(k AS INTEGER) AS rank, doc_id, news_score FROM k WHERE k <= 5")
def top_news(spark: SparkSession, d: str) -> DataFrame:
    return ranked_news(spark, d).where("k <= 5").select("symbol", F.col("k").alias("rank"), "doc_id", "news_score")


_SENT = "(CASE WHEN contains(lower(title), 'thatin') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'ering') THEN 1 ELSE 0 END)"
_NSENT = "(CASE WHEN contains(lower(title), 'ononst') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'oning') THEN 1 ELSE 0 END)"


@query("dec09_news_sentiment", _NEWS.rstrip() + f""", v AS (SELECT symbol, news_score, CASE WHEN {_SENT} + {_NSENT} > 0 THEN ({_SENT} - {_NSENT}) / ({_SENT} + {_NSENT})::DOUBLE ELSE 0e0 END AS v FROM k WHERE k <= 5),
s AS (SELECT symbol, round(sum(v * news_score) / sum(news_score), 4) AS score FROM v GROUP BY symbol) SELECT symbol, score, CASE WHEN score >= 0.2e0 THEN 'positive' WHEN score <= -0.2e0 THEN 'negative' ELSE 'neutral' END AS label FROM s""")  # fmt: skip
def news_sentiment(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.decisions import keyword_sentiment

    value = keyword_sentiment(F.col("title"), ["thatin", "ering"], ["ononst", "oning"])
    s = ranked_news(spark, d).where("k <= 5").groupBy("symbol").agg(F.round(F.sum(value * F.col("news_score")) / F.sum("news_score"), 4).alias("score"))
    return s.select("symbol", "score", F.when(F.col("score") >= 0.2, "positive").when(F.col("score") <= -0.2, "negative").otherwise("neutral").alias("label"))


@query("scl21_percent_near", """SELECT page_id, coalesce(TRY_CAST(regexp_extract(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)thatin[^0-9+-]*([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS DOUBLE),
  TRY_CAST(regexp_extract(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?i)the[^0-9+-]*([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*%', 1) AS DOUBLE)) / 100 AS share FROM pages""")  # fmt: skip
def percent_near(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "pages").select("page_id", R.percent_near(F.col("html"), ["thatin", "the"]).alias("share"))


@query("scl22_iso_time", "SELECT event_id, CAST(ts AS TIMESTAMP) AS at, CAST(epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS BIGINT) AS seconds FROM events")
def iso_time(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    e = M.table(spark, d, "events").select("event_id", text.alias("iso"))
    parsed = F.try_to_timestamp(F.replace("iso", F.lit("Z"), F.lit("+00:00")))
    return e.select("event_id", parsed.alias("at"), F.unix_seconds(parsed).alias("seconds"))


_HOLIDAYS = """y AS (SELECT unnest(range(1995, 2027)) AS y), f AS (SELECT make_date(y, m, d) AS day, y, m FROM y, (VALUES (1, 1), (7, 4), (12, 25), (6, 19)) v(m, d) WHERE m <> 6 OR y >= 2022),
g AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), e1 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM g),
e2 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e1), e3 AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM e2),
q AS (SELECT CAST(unnest(range(DATE '1995-01-01', DATE '2027-01-01', INTERVAL 1 DAY)) AS DATE) AS day),
w AS (SELECT day, isodow(day) - 1 AS wd, month(day) AS m, CAST(ceil(day(day) / 7e0) AS INTEGER) AS nth, day(day) AS dom FROM q),
holidays AS (SELECT CASE isodow(day) WHEN 6 THEN CAST(day - INTERVAL 1 DAY AS DATE) WHEN 7 THEN CAST(day + INTERVAL 1 DAY AS DATE) ELSE day END AS day, y FROM f
  UNION SELECT CAST(make_date(y, n // 31, n % 31 + 1) - INTERVAL 2 DAY AS DATE), y FROM e3
  UNION SELECT day, year(day) FROM w WHERE (wd = 0 AND ((m IN (1, 2) AND nth = 3) OR (m = 9 AND nth = 1) OR (m = 5 AND dom > 24))) OR (wd = 3 AND m = 11 AND nth = 4)),
holiday AS (SELECT DISTINCT day FROM holidays WHERE year(day) = y)"""


@query("scl25_session", "WITH " + _HOLIDAYS + """, l AS (SELECT event_id, (CAST(ts AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)
SELECT event_id, CASE WHEN isodow(t) > 5 OR CAST(t AS DATE) IN (SELECT day FROM holiday) THEN 'closed' WHEN hour(t) * 60 + minute(t) < 240 THEN 'closed' WHEN hour(t) * 60 + minute(t) < 570 THEN 'pre'
  WHEN hour(t) * 60 + minute(t) < 960 THEN 'regular' WHEN hour(t) * 60 + minute(t) < 1200 THEN 'after' ELSE 'closed' END AS session FROM l""")  # fmt: skip
def sessions(spark: SparkSession, d: str) -> DataFrame:
    return M.table(spark, d, "events").select("event_id", R.session(F.col("ts").cast("timestamp")).alias("session"))


@query("scl25_trading_days", M.with_views("bars", more=_HOLIDAYS) + "SELECT DISTINCT bar_date, isodow(bar_date) < 6 AND bar_date NOT IN (SELECT day FROM holiday) AS trading FROM bars")
def trading_days(spark: SparkSession, d: str) -> DataFrame:
    days = M.bars(spark, d).select("bar_date").distinct()
    return days.select("bar_date", ((F.weekday("bar_date") < 5) & ~R.is_holiday(F.col("bar_date"))).alias("trading"))


@query("scl28_event_date", RAW + "SELECT seq, coalesce(CASE WHEN seq % 3 = 0 THEN event_date END, CAST(make_timestamp(CAST(trim(ts_text) AS BIGINT) * 1000000) AS DATE)) AS day FROM raw WHERE seq % 6 IN (0, 1) UNION ALL SELECT seq, CASE WHEN seq % 3 = 0 THEN event_date END FROM raw WHERE seq % 6 NOT IN (0, 1)")
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.expr("seq % 3 = 0"), F.col("event_date"))
    return raw(spark, d).select("seq", F.coalesce(given, F.to_date(F.timestamp_seconds(R.positive_seconds(F.col("ts_text"))))).alias("day"))


_STALE = "WITH l AS (SELECT event_id, event_type, user_id, CAST(epoch(max(ts) OVER (PARTITION BY user_id)) - epoch(ts) AS BIGINT) AS age FROM events), s AS (SELECT *, CASE event_type WHEN 'click' THEN 'regular' WHEN 'view' THEN 'pre' WHEN 'signup' THEN 'after' ELSE 'closed' END AS session FROM l) "


@query("scl29_staleness", _STALE + "SELECT event_id, age, age > CASE session WHEN 'regular' THEN 15 WHEN 'pre' THEN 60 WHEN 'after' THEN 60 ELSE 86400 END AS stale FROM s")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kinds = {"click": "regular", "view": "pre", "signup": "after"}
    session = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit("closed"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    age = F.rint(F.max(seconds).over(Window.partitionBy("user_id")) - seconds).cast("bigint")  # halves to even, as SQL's cast
    return M.table(spark, d, "events").select("event_id", age.alias("age"), session.alias("session")).select("event_id", "age", (F.col("age") > R.stale_after(F.col("session"))).alias("stale"))


@query("scl32_recommendation", RAW + f"SELECT seq, coalesce(nullif(upper(trim(s_rec)), ''), {_ACTION}) AS recommendation, coalesce(nullif(trim(model_version), ''), 'unknown') AS model_version FROM raw")
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    action = R.action(*map(F.col, ("p_rec", "p_adv", "e_rec", "e_adv")))
    return raw(spark, d).select("seq", F.coalesce(R.action(F.col("s_rec")), action).alias("recommendation"), F.coalesce(R.blank_to_null(F.col("model_version")), F.lit("unknown")).alias("model_version"))


@query("scl33_recipe_hash", M.with_views("decisions") + """SELECT DISTINCT endpoint, model_version, sha256('{"endpoint":"' || endpoint || '","model_version":"' || model_version || '"}') AS recipe_hash,
  substring(sha256('{"endpoint":"' || endpoint || '","model_version":"' || model_version || '"}'), 1, 16) AS recipe_id FROM decisions""")  # fmt: skip
def recipe_hashes(spark: SparkSession, d: str) -> DataFrame:
    recipes = M.decisions(spark, d).select("endpoint", "model_version").distinct()
    return recipes.withColumn("recipe_hash", R.recipe_hash([F.col("endpoint"), F.col("model_version")])).withColumn("recipe_id", F.substring("recipe_hash", 1, 16))


_ELIGIBLE = RAW.rstrip() + f""", x AS (SELECT *, {_ACTION} AS act, {_COMPLETE} AS completeness, coalesce(p_prob, s_prob) AS p, max(ts) OVER () AS now_ts FROM raw),
c AS (SELECT *, CASE WHEN {_H.format('model_version')} IS NULL AND NOT regexp_matches(model_version, '5d') THEN 'horizon' WHEN p IS NULL THEN 'probability' WHEN completeness = 'quote_only' THEN 'quote_only' WHEN ts > now_ts - 30 * 86400 THEN 'immature' END AS reason FROM x)"""


def eligible(spark: SparkSession, d: str) -> DataFrame:
    """Raw records with the first reason that excludes them, or null."""
    r = raw(spark, d)
    now = r.agg(F.max("ts").alias("now_ts"))
    x = r.crossJoin(F.broadcast(now)).withColumns({"completeness": complete(), "p": F.coalesce("p_prob", "s_prob")})  # one row
    reason = F.when(~F.contains("model_version", F.lit("5d")), "horizon").when(F.col("p").isNull(), "probability").when(F.col("completeness") == "quote_only", "quote_only").when(F.col("ts") > F.col("now_ts") - 30 * 86400, "immature")
    return x.withColumn("reason", reason)


@query("flt02_eligible_events", _ELIGIBLE + " SELECT seq, p FROM c WHERE reason IS NULL")
def eligible_events(spark: SparkSession, d: str) -> DataFrame:
    return eligible(spark, d).where("reason is null").select("seq", "p")


@query("agg11_input_profile", _ELIGIBLE + " SELECT count(*) AS n, count(*) FILTER (p IS NULL) AS no_probability, count(*) FILTER (completeness = 'quote_only') AS quote_only, count(*) FILTER (completeness = 'full_signal') AS full_signal, count(*) FILTER (reason IS NULL) AS eligible FROM c")
def input_profile(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return eligible(spark, d).agg(F.count(F.lit(1)).alias("n"), n("p is null").alias("no_probability"), n("completeness = 'quote_only'").alias("quote_only"), n("completeness = 'full_signal'").alias("full_signal"), n("reason is null").alias("eligible"))


@query("agg12_mixed_segments", _ELIGIBLE + """, u AS (SELECT 'endpoint' AS segment, endpoint AS value FROM c WHERE reason IS NULL UNION ALL SELECT 'completeness', completeness FROM c WHERE reason IS NULL UNION ALL SELECT 'version', model_version FROM c WHERE reason IS NULL),
k AS (SELECT segment, value, count(*) AS n FROM u GROUP BY 1, 2) SELECT segment, count(*) AS n_values, min(n) AS least_rows, count(*) > 1 AS mixed, min(n) < 200 AS few FROM k GROUP BY segment""")  # fmt: skip
def mixed_segments(spark: SparkSession, d: str) -> DataFrame:
    u = eligible(spark, d).where("reason is null").select(F.explode(F.create_map(F.lit("endpoint"), "endpoint", F.lit("completeness"), "completeness", F.lit("version"), "model_version")).alias("segment", "value"))
    k = u.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
    return k.groupBy("segment").agg(F.count(F.lit(1)).alias("n_values"), F.min("n").alias("least_rows"), (F.count(F.lit(1)) > 1).alias("mixed"), (F.min("n") < 200).alias("few"))


@query("agg10_segments_all", _ELIGIBLE + """, u AS (SELECT 'endpoint' AS segment, endpoint AS value, reason FROM c UNION ALL SELECT 'completeness', completeness, reason FROM c UNION ALL SELECT 'version', model_version, reason FROM c UNION ALL SELECT 'source', decision_source, reason FROM c)
SELECT segment, value, count(*) AS scanned, count(*) FILTER (reason IS NULL) AS eligible, count(reason) AS excluded FROM u GROUP BY 1, 2""")  # fmt: skip
def segments_all(spark: SparkSession, d: str) -> DataFrame:
    parts = {"endpoint": "endpoint", "completeness": "completeness", "version": "model_version", "source": "decision_source"}
    u = eligible(spark, d).select("reason", F.explode(F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), F.col(v))])).alias("segment", "value"))
    return u.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("scanned"), F.count(F.when(F.col("reason").isNull(), 1)).alias("eligible"), F.count("reason").alias("excluded"))
