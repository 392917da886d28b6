"""Ordered ticks, alerts, latest values and windows over streams.

One memory per (symbol, type): time, sequence, id and price of the last tick that counted. A tick with that id, or
with that sequence, is a duplicate; a smaller sequence is late; a sequence above the next is a gap (kept and flagged).
Where either sequence is missing, times decide: an earlier tick is late, one of the same time and price a duplicate.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.windows import STRETCH, stretch
from ..sources.files import stored
from .folding import Machine, Row, folded, run_folded, said
from .keyed_table import KeyedTable

TICK = ("event_ts", "event_id", "sequence", "price")


def _status(last: Row | None, tick: Row) -> str:
    if last is None:
        return "first"
    if tick["event_id"] is not None and tick["event_id"] == last["event_id"]:
        return "duplicate"
    if tick["sequence"] is not None and last["sequence"] is not None:
        ahead = tick["sequence"] - last["sequence"]
        return "late" if ahead < 0 else {0: "duplicate", 1: "ok"}.get(ahead, "gap")
    if tick["event_ts"] < last["event_ts"]:
        return "late"
    return "duplicate" if (tick["event_ts"], tick["price"]) == (last["event_ts"], last["price"]) else "ok"


COUNTED = ("first", "ok", "gap")


def _order_step(last: Row | None, tick: Row) -> tuple[Row | None, Row]:
    status = _status(last, tick)
    memory = {k: tick[k] for k in TICK} if status in COUNTED else last
    return memory, {"event_id": tick["event_id"], "sequence": tick["sequence"], "status": status}


#: Ticks of a trigger are taken by time and id, and by sequence where these are equal.
ORDER = Machine(("symbol", "type"), ("event_ts", "event_id", "sequence"), _order_step, "event_id long, sequence long, status string", "event_ts timestamp, event_id long, sequence long, price double")


def _ticks(ticks: DataFrame) -> DataFrame:
    price = F.col("price").cast("double") if "price" in ticks.columns else F.lit(None).cast("double")
    return ticks.select("symbol", "type", F.col("event_ts").cast("timestamp").alias("event_ts"), "event_id", F.col("sequence").cast("long").alias("sequence"), price.alias("price"))


def classify_batch(ticks: DataFrame) -> DataFrame:
    """symbol, type, event_id, sequence and status of each tick of a table, in the order of time."""
    return said(folded(ORDER, _ticks(ticks)))


#: Before any stretch of time: ticks without a time, and before these the tick that a memory holds.
UNTIMED, REMEMBERED = -(2**40), -(2**41)


def _annotated(ticks: DataFrame, days: float = STRETCH, memories: DataFrame | None = None) -> DataFrame:
    """Ticks with ``held``: of the ticks before them the one of the largest sequence, and the first of these.

    A key's time is cut into stretches: what a stretch holds is carried into later ones, so a key with many ticks is spread over
    as many tasks as its time has stretches. Bitwise complements turn the order of times and ids round.
    """
    top = lambda at, of="": F.struct(F.col(f"{of}sequence").cast("long").alias("sequence"), at.alias("rank"), F.bitwise_not(F.col(f"{of}event_id").cast("long")).alias("id"))
    own = top(F.bitwise_not(F.unix_micros(F.col("event_ts").cast("timestamp"))))
    rows = ticks.withColumns({"_key": F.struct("symbol", "type"), "_part": F.coalesce(stretch(ticks, "event_ts", days), F.lit(UNTIMED)), "_own": own})
    within = Window.partitionBy("_key", "_part").orderBy("event_ts", "event_id", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_of").orderBy("_at_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("_key").alias("_of"), F.col("_part").alias("_at_part")).agg(F.max("_own").alias("_top"))
    if memories is not None:
        parts = parts.unionByName(memories.select(F.struct("symbol", "type").alias("_of"), F.lit(REMEMBERED).alias("_at_part"), top(F.lit(2**62), "memory.").alias("_top")))
    parts = parts.withColumn("_carried", F.max("_top").over(before)).drop("_top")
    met = rows.withColumn("_within", F.max("_own").over(within)).join(parts, (F.col("_key") == F.col("_of")) & (F.col("_part") == F.col("_at_part")))
    return met.withColumn("held", F.greatest("_within", "_carried")).select(*ticks.columns, "held")


def _sequenced_status() -> Column:
    ahead = F.col("sequence") - F.col("held.sequence")
    return F.when(ahead.isNull(), "first").when(ahead == 0, "duplicate").when(ahead < 0, "late").when(ahead > 1, "gap").otherwise("ok")


def classify_sequenced(ticks: DataFrame, days: float = STRETCH) -> DataFrame:
    """The same by windows, for ticks that all have a sequence and an id of their own: the largest sequence so far decides."""
    return _annotated(ticks, days).select("symbol", "type", "event_id", "sequence", _sequenced_status().alias("status"))


def _written(df: DataFrame, path: str) -> DataFrame:
    """A trigger that is run again overwrites what it wrote before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_windows(rows: DataFrame, memories: DataFrame | None, folder: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """A shortcut of ``run_folded``. Where all ticks of a key have time, sequence and id, and none has the id of the tick that counted
    last, the largest sequence so far decides, and windows over stretches of time find it. Other keys are left to the machine.
    """
    keys = ["symbol", "type"]
    met = _annotated(rows, memories=memories)
    again = F.coalesce(F.bitwise_not(F.col("event_id")) == F.col("held.id"), F.lit(False))
    met = _written(met.withColumn("_odd", F.col("event_ts").isNull() | F.col("sequence").isNull() | F.col("event_id").isNull() | again), f"{folder}/met")
    strange = met.where("_odd").select(*keys)
    if memories is not None:
        strange = strange.unionByName(memories.where("memory.sequence IS NULL OR memory.event_id IS NULL").select(*keys))
    strange = _written(strange.distinct(), f"{folder}/odd").withColumnsRenamed({k: f"_{k}" for k in keys})
    of = lambda df, how: df.join(strange, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    said_, memory = (StructType.fromDDL(x) for x in (ORDER.said, ORDER.memory))
    mixed = not strange.isEmpty()
    plain = of(met, "left_anti") if mixed else met
    status = F.struct("event_id", "sequence", _sequenced_status().alias("status"))
    out = plain.select(*keys, status.cast(said_).alias("said"), F.lit(None).cast(memory).alias("memory"))
    best = plain.where("held IS NULL OR sequence > held.sequence").select(*keys, F.struct(*TICK).cast(memory).alias("memory"))
    if memories is not None:
        kept = memories.select(*keys, "memory")
        best = best.unionByName(of(kept, "left_anti") if mixed else kept)
    best = best.groupBy(*keys).agg(F.max_by("memory", "memory.sequence").alias("memory"))
    out = out.unionByName(best.select(*keys, F.lit(None).cast(said_).alias("said"), "memory"))
    rest = lambda df: of(df, "left_semi") if mixed else df.where("false")
    return rest(met.select(*rows.columns)), None if memories is None else rest(memories), out


def classify_stream(ticks: DataFrame, folder: str) -> DataFrame:
    """The same over all that a stream of ticks holds now; the memory lasts from trigger to trigger."""
    return run_folded(ORDER, _ticks(ticks), folder, shortcut=_by_windows)


def on_time(statuses: DataFrame) -> DataFrame:
    """Ticks that count: late and repeated ones are dropped at once, whatever a watermark would still let in."""
    return statuses.where(F.col("status").isin(*COUNTED))


def queued_gaps(gaps: DataFrame, cooldown: str = "30 seconds") -> DataFrame:
    """Symbols to be read again: at most one request for each symbol and ``cooldown``, at the first gap of a window.

    Windows are of the cooldown's length and fixed in time, so a symbol waits less than two of them.
    """
    return gaps.groupBy("symbol", F.window("event_ts", cooldown).alias("w")).agg(F.min("event_ts").alias("first_gap"), F.count(F.lit(1)).alias("gaps")).select("symbol", "first_gap", "gaps")


def recovery_requests(cooldown: float = 30.0) -> Machine:
    """Requests to read a symbol again at its gaps: none while the last request is younger than ``cooldown`` seconds."""

    def step(last: Row | None, gap: Row) -> tuple[Row | None, Row]:
        waits = last is not None and (gap["event_ts"] - last["queued"]).total_seconds() < cooldown
        return (last if waits else {"queued": gap["event_ts"]}), {"event_ts": gap["event_ts"], "event_id": gap["event_id"], "queued": not waits}

    return Machine(("symbol",), ("event_ts", "event_id"), step, "event_ts timestamp, event_id long, queued boolean", "queued timestamp")


#: Sessions outside regular hours, and the change of spread (basis points) that counts.
OFF_HOURS = ("pre", "after", "closed")
SPREAD_MOVE = 25.0
ALERT_MEMORY = "price double, spread double, pending string, since double, fired string, fired_state string, fired_at double"


def _crossed(memory: Row, tick: Row, hysteresis: float) -> bool:
    """Up through the threshold's band, or still above it while that waits to be fired."""
    if tick["price"] is None or tick["threshold"] is None:
        return False
    band = abs(tick["threshold"]) * hysteresis / 100
    from_below = memory["price"] is not None and memory["price"] < tick["threshold"] - band
    return tick["price"] >= tick["threshold"] + band and (from_below or memory["pending"] == "price_threshold_crossed")


def _spread_moved(memory: Row, tick: Row, hysteresis: float) -> bool:
    return None not in (tick["spread_bps"], memory["spread"]) and abs(tick["spread_bps"] - memory["spread"]) >= SPREAD_MOVE


#: What may fire, the first that holds.
GUARDS = {
    "snapshot_invalidated": lambda memory, tick, hysteresis: bool(tick["invalidation_reason"]),
    "minute_bar_closed": lambda memory, tick, hysteresis: tick["type"] == "AM",
    "suitability_boundary_crossed": lambda memory, tick, hysteresis: bool(tick["concentration_crossed"]),
    "price_threshold_crossed": _crossed,
    "liquidity_changed": _spread_moved,
}


def alert_machine(enabled: bool = True, hysteresis: float = 0.5, debounce: float = 15.0, cooldown: float = 300.0) -> Machine:
    """Alerts per user and symbol: a rule has to hold on for ``debounce`` seconds, then fires unless one fired in the last
    ``cooldown`` seconds, or the same one last, in the same state of advice. Switched off, or out of hours for a user who
    does not want that, nothing is noted.
    """
    fresh = dict.fromkeys(c.split()[0] for c in ALERT_MEMORY.split(", "))

    def silence(memory: Row, rule: str, tick: Row) -> str | None:
        """Why a rule that held long enough does not fire."""
        if memory["fired_at"] is not None and tick["at"] - memory["fired_at"] < cooldown:
            return "cooldown"
        same = (memory["fired"], memory["fired_state"]) == (rule, tick["recommendation_state"])
        return "duplicate" if same else None

    def step(memory: Row | None, tick: Row) -> tuple[Row | None, Row]:
        says = lambda reason, fired=False: {"event_id": tick["event_id"], "fired": fired, "reason": reason}
        memory = memory or fresh
        if not enabled:
            return memory, says("emergency_disabled")
        if tick["session"] in OFF_HOURS and not tick["after_hours_allowed"]:
            return memory, says("after_hours_disabled")
        rule = next((name for name, holds in GUARDS.items() if holds(memory, tick, hysteresis)), None)
        seen = memory | {k: tick[c] for k, c in (("price", "price"), ("spread", "spread_bps")) if tick[c] is not None}
        if rule is None:
            return seen | {"pending": None, "since": None}, says("no_controlled_boundary")
        if rule != memory["pending"]:
            return seen | {"pending": rule, "since": tick["at"]}, says("debouncing")
        if tick["at"] - memory["since"] < debounce:
            return seen, says("debouncing")
        if (why := silence(memory, rule, tick)) is not None:
            return seen, says(why)
        return seen | {"pending": None, "since": None, "fired": rule, "fired_state": tick["recommendation_state"], "fired_at": tick["at"]}, says(rule, True)

    return Machine(("user_id", "symbol"), ("at", "event_id"), step, "event_id long, fired boolean, reason string", ALERT_MEMORY)


def alert_stream(ticks: DataFrame, folder: str, **policy: float) -> DataFrame:
    """Alerts over a stream of (user_id, symbol, event_id, at: seconds, type, price, threshold, spread_bps, session,
    after_hours_allowed, recommendation_state, concentration_crossed, invalidation_reason).
    """
    return run_folded(alert_machine(**policy), ticks, folder)


FRAME = "ev string, sym string, e long, t long, q long, i string, o double, h double, l double, c double, v double, p double, s double, bp double, ap double, status string, message string"


def parsed_frames(raw: DataFrame, payload: str = "value") -> DataFrame:
    """Typed events of raw frames, each a JSON object or an array of them: kind event, status or bad.

    Times are milliseconds for bars (A, AM) and nanoseconds for quotes and trades; flags name what is missing. Works on
    streams as on tables.
    """
    text = F.trim(F.col(payload))
    array = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    items = raw.withColumn("_items", F.from_json(array, f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in FRAME.split(', ')))}>>"))
    x = items.select(*[c for c in raw.columns if c != payload], F.explode_outer("_items").alias("x"))
    kind, at = F.upper("x.ev"), F.when(F.upper("x.ev").isin("A", "AM"), F.col("x.e") * 1000).otherwise(F.floor(F.col("x.t") / 1000))
    symbol = F.upper(F.trim("x.sym"))
    good = kind.isin("A", "AM", "Q", "T") & (symbol != "") & (symbol != "*") & (at > 0)
    flags = F.array_compact(F.array(
        F.when(kind.isin("A", "AM") & F.expr("x.o is null or x.h is null or x.l is null or x.c is null or x.v is null"), "partial_aggregate"),
        F.when((kind == "Q") & (F.col("x.ap") < F.col("x.bp")), "crossed_market"), F.when((kind == "Q") & F.expr("x.bp is null or x.ap is null"), "incomplete_nbbo"), F.when((kind == "T") & F.col("x.p").isNull(), "missing_trade_price"),
    ))
    price = F.when(kind == "T", F.col("x.p")).when(kind == "Q", F.when(F.col("x.ap") >= F.col("x.bp"), (F.col("x.bp") + F.col("x.ap")) / 2)).otherwise(F.col("x.c"))
    return x.select(
        *[c for c in raw.columns if c != payload], F.when(kind == "STATUS", "status").when(F.coalesce(good, F.lit(False)), "event").otherwise("bad").alias("kind"), kind.alias("event_type"), symbol.alias("symbol"),
        F.timestamp_micros(at).alias("event_ts"), F.col("x.q").alias("sequence"), price.alias("price"), F.concat_ws(",", flags).alias("flags"),
    )


#: Bids are p and asks P, which are one name to Spark, so a quote is read as a map.
SNAPSHOT = "ticker struct<lastQuote: map<string, double>, lastTrade: struct<p: double, t: bigint, i: string>, min: struct<c: double, t: bigint>, day: struct<c: double>, prevDay: struct<c: double>, todaysChangePerc: double>"


def flat_quotes(raw: DataFrame, payload: str = "value", received: str = "received", limit: float = 15) -> DataFrame:
    """One flat quote for each nested snapshot: the first fresh of trade, midpoint and minute, else a stale one, flagged."""
    x = raw.withColumn("x", F.from_json(payload, SNAPSHOT, {"mode": "PERMISSIVE"}).getField("ticker"))
    quote = lambda k: F.try_element_at("x.lastQuote", F.lit(k))
    bid, ask, quoted = quote("p"), quote("P"), quote("t") / 1e9
    midpoint = F.when((bid > 0) & (ask >= bid), (bid + ask) / 2)
    seconds = lambda c: F.col(c) / 1e9
    offers = [("last_trade", F.col("x.lastTrade.p"), seconds("x.lastTrade.t")), ("nbbo_midpoint", midpoint, quoted), ("minute_close", F.col("x.min.c"), F.col("x.min.t") / 1e3), ("day_close", F.col("x.day.c"), F.lit(None).cast("double"))]
    offer = lambda name, price, ok: F.when((price > 0) & ok, F.struct(F.lit(name).alias("source"), price.alias("price")))
    fresh = F.coalesce(*[offer(n, p, t.isNull() | (F.col(received) - t <= limit)) for n, p, t in offers[:3]])
    stale = F.coalesce(*[offer(n, p, F.lit(True)) for n, p, _ in offers])
    newest = F.greatest(seconds("x.lastTrade.t"), quoted, F.col("x.min.t") / 1e3)
    picked = F.coalesce(fresh, stale)
    flags = F.array_compact(F.array(F.when(newest.isNull(), "missing_event_timestamp"), F.when(ask < bid, "crossed_market"), F.when(bid.isNull() | ask.isNull(), "incomplete_nbbo"), F.when(fresh.isNull() & stale.isNotNull(), "stale_price_fallback")))
    previous = F.col("x.prevDay.c")
    change = F.when(previous > 0, (picked["price"] - previous) / previous * 100).otherwise(F.col("x.todaysChangePerc"))
    return x.select(*[c for c in raw.columns if c not in (payload, received)], bid.alias("bid"), ask.alias("ask"), midpoint.alias("midpoint"), picked["source"].alias("price_source"), picked["price"].alias("price"), (F.col(received) - newest).alias("age"), change.alias("change_percent"), F.concat_ws(",", flags).alias("flags"))


def latest_values(ticks: DataFrame) -> DataFrame:
    """The newest tick of each (symbol, type)."""
    newest = F.max_by(F.struct("event_ts", "price", "sequence"), F.struct("event_ts", "event_id"))
    return ticks.groupBy("symbol", "type").agg(newest.alias("v")).select("symbol", "type", "v.event_ts", "v.price", "v.sequence")


def windowed_prices(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tick counts and mean price per type and time window; on a stream, rows later than the watermark are dropped."""
    return ticks.withWatermark("event_ts", late).groupBy(F.window("event_ts", width).alias("w"), "type").agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")).select(F.col("w.start").alias("start"), "type", "n", "mean_price")


def latest_table(folder: str) -> KeyedTable:
    """Newest tick of each (symbol, type), until that expires."""
    return KeyedTable(f"{folder.rstrip('/')}/latest-{uuid.uuid4().hex}", ("symbol", "type"), ("at", "event_id"), "expires")


def demand_table(folder: str) -> KeyedTable:
    """Symbols that each source asked for last, until that expires."""
    return KeyedTable(f"{folder.rstrip('/')}/demand-{uuid.uuid4().hex}", ("source",), ("at", "event_id"), "expires")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Run a streaming DataFrame over all that its source holds now, into Parquet, and read that."""
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def replay(spark: SparkSession, ticks: DataFrame, folder: str, triggers: int = 1, by: str = "event_ts") -> DataFrame:
    """A table of ticks as a stream; with several triggers, each brings a range of ``by``, in order."""
    at = f"{folder.rstrip('/')}/ticks-{uuid.uuid4().hex}"
    if triggers == 1:
        ticks.write.parquet(at)
        return spark.readStream.schema(ticks.schema).parquet(at)
    ticks = stored(ticks, "replayed")
    files = max(1, spark.sparkContext.defaultParallelism)
    none = ticks.where("false").coalesce(1)
    ends = ticks.select(F.percentile_approx(by, [k / triggers for k in range(1, triggers)]).alias("p")).first()["p"]
    for low, high in zip([None, *ends], [*ends, None]):
        part = ticks if low is None else ticks.where(F.col(by) >= low)
        before = len(spark.read.schema(ticks.schema).parquet(at).inputFiles()) if low is not None else 0
        (part if high is None else part.where(F.col(by) < high)).repartition(files).write.mode("append").parquet(at)
        # Every range has as many files as a trigger reads; few rows leave some out, and empty ones stand in.
        for _ in range(before + files - len(spark.read.schema(ticks.schema).parquet(at).inputFiles())):
            none.write.mode("append").parquet(at)
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", files).parquet(at)
