"""Window expressions over daily bars of a symbol; all are Columns, so Catalyst fuses them into one pass.

``w`` is a window partitioned by symbol and ordered by bar date. A frame that isn't full gives null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StructField, StructType, TimestampNTZType


def by_symbol(symbol: str = "symbol", at: str = "bar_date") -> WindowSpec:
    return Window.partitionBy(symbol).orderBy(at)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(x: Column | str, value: Column, w: WindowSpec, n: int) -> Column:
    """``value`` where the frame of ``n`` rows is full and holds no null."""
    return F.when(F.count(_c(x)).over(trailing(w, n)) == n, value)


def rounded(x: Column | str, digits: int) -> Column:
    """Half away from zero by doubles, as SQL's round does it; Spark's own goes by way of decimal text."""
    scaled = F.floor(F.abs(_c(x)) * 10.0**digits + 0.5) / 10.0**digits
    return F.when(_c(x) < 0, 0.0 - scaled).otherwise(scaled) + 0.0


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def lagged_return(close: Column | str, n: int, w: WindowSpec) -> Column:
    return safe_ratio(_c(close), F.lag(_c(close), n).over(w)) - 1


def moving_average(x: Column | str, n: int, w: WindowSpec) -> Column:
    return full(x, F.avg(_c(x)).over(trailing(w, n)), w, n)


def rolling_max(x: Column | str, n: int, w: WindowSpec) -> Column:
    return full(x, F.max(_c(x)).over(trailing(w, n)), w, n)


def rolling_min(x: Column | str, n: int, w: WindowSpec) -> Column:
    return full(x, F.min(_c(x)).over(trailing(w, n)), w, n)


def z_score(x: Column | str, n: int, w: WindowSpec) -> Column:
    f = trailing(w, n)
    spread = F.stddev_pop(_c(x)).over(f)
    return full(x, F.when(F.max(_c(x)).over(f) == F.min(_c(x)).over(f), 0.0).otherwise((_c(x) - F.avg(_c(x)).over(f)) / spread), w, n)


def rolling_volatility(ret: Column | str, n: int, w: WindowSpec) -> Column:
    return full(ret, F.stddev_pop(_c(ret)).over(trailing(w, n)), w, n)


def rsi(delta: Column | str, n: int, w: WindowSpec, zero_loss: str = "hundred") -> Column:
    """Simple-average RSI of bar-to-bar differences. zero_loss: hundred, null, or fifty where gains are zero as well."""
    f = trailing(w, n)
    gain, loss = F.avg(F.greatest(_c(delta), F.lit(0.0))).over(f), F.avg(F.greatest(-_c(delta), F.lit(0.0))).over(f)
    value = 100 - 100 / (1 + gain / loss)
    at_zero = {"hundred": F.lit(100.0), "null": F.lit(None).cast("double"), "fifty": F.when(gain == 0, 50.0).otherwise(100.0)}[zero_loss]
    return full(delta, F.when(loss == 0, at_zero).otherwise(value), w, n)


#: Days of a stretch of time; times that are plain numbers count as seconds. Rows of a block within a stretch.
STRETCH, BLOCK = 128, 64


def stretch(rows: DataFrame, at: str, days: float = STRETCH) -> Column:
    """Number of the stretch of time that a row lies in."""
    kind = rows.schema[at].dataType
    if isinstance(kind, DateType):
        return F.floor(F.unix_date(at) / days)
    moment = F.col(at).cast("timestamp") if isinstance(kind, TimestampNTZType) else F.col(at)
    return F.floor(moment.cast("double") / (days * 86400))


def with_ema(bars: DataFrame, averages: dict[str, tuple[str, int]], key: str = "symbol", at: str = "bar_date", days: float = STRETCH) -> DataFrame:
    """``bars`` with recursive averages name -> (column, span), seeded by each symbol's first value.

    The recurrence e = (1 - a) e + a x is linear, so a series is cut into stretches of time and these into blocks of BLOCK
    rows. Within a block an average is a weighted running sum; a block passes on its sum and its decay, and only these
    are followed along the series. Nulls before the first value stay null, later ones keep the value before them.
    Averages are made in the order given, so one may build on another.
    """
    waiting: dict[str, tuple[str, int]] = {}
    for name, (column, span) in averages.items():
        if waiting and (column in waiting or column != next(iter(waiting.values()))[0]):
            bars, waiting = _with_averages(bars, waiting, key, at, days), {}
        waiting[name] = (column, span)
    return _with_averages(bars, waiting, key, at, days)


def _with_averages(bars: DataFrame, averages: dict[str, tuple[str, int]], key: str, at: str, days: float) -> DataFrame:
    """Averages of one column."""
    x = F.col(next(iter(averages.values()))[0]).cast("double")
    decay = {name: 1 - 2 / (span + 1) for name, (_, span) in averages.items()}
    so_far = Window.partitionBy(key, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("_part", stretch(bars, at, days)).withColumn("_k", F.count(x).over(so_far))
    place = F.greatest(F.col("_k") - 1, F.lit(0))
    rows = rows.withColumns({"_block": F.floor(place / BLOCK).cast("int"), "_i": (place % BLOCK).cast("int")})
    # A span of 1 has no memory: its decay is 0, and the last value counts alone.
    weighed = {n: (1 - d) * x * F.pow(F.lit(d), -F.col("_i")) if d else x for n, d in decay.items()}
    within = Window.partitionBy(key, "_part", "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    summed = {f"_s_{n}": F.sum(w).over(within) if decay[n] else F.last(w, ignorenulls=True).over(within) for n, w in weighed.items()}
    ends = [(F.pow(F.lit(d), F.max("_i")) * F.sum(weighed[n]) if d else F.max_by(weighed[n], F.when(x.isNotNull(), F.col("_i")))).alias(n) for n, d in decay.items()]
    blocks = rows.groupBy(key, "_part", "_block").agg(F.count(x).alias("m"), *ends, F.min_by(x, F.when(x.isNotNull(), F.col("_i"))).alias("x"))
    entry = F.struct("_block", "m", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in decay))
    parts = blocks.groupBy(key, "_part").agg(F.sort_array(F.collect_list(entry)).alias("_blocks"), F.min_by("x", F.when(F.col("x").isNotNull(), F.col("_block"))).alias("_x"))
    order = Window.partitionBy(key).orderBy("_part")  # a row for each stretch
    seed = F.first("_x", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.flatten(F.collect_list("_blocks").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    follow = lambda blocks_, start, n: F.aggregate(blocks_, start, lambda e, b: e * F.pow(F.lit(decay[n]), b["m"]) + b[n])
    parts = parts.withColumns({"_seed": seed, "_before": before}).select(
        F.col(key).alias("_of"), F.col("_part").alias("_stretch"), "_blocks", F.aggregate("_before", F.lit(0).cast("long"), lambda n, b: n + b["m"]).alias("_seen"), *(follow("_before", F.col("_seed"), n).alias(f"_c_{n}") for n in decay))
    met = rows.withColumns(summed).join(parts, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_stretch")))
    out = {}
    for n, d in decay.items():
        carried = follow(F.slice("_blocks", 1, F.col("_block")), F.col(f"_c_{n}"), n)
        own = F.col(f"_s_{n}") * F.pow(F.lit(d), F.col("_i")) + carried * F.pow(F.lit(d), F.col("_i") + 1) if d else F.col(f"_s_{n}")
        out[n] = F.when(F.col("_k") + F.col("_seen") > 0, F.when(F.col(f"_s_{n}").isNotNull(), own).otherwise(carried))
    return met.withColumns(out).select(*bars.columns, *averages)


def with_ema_in_place(bars: DataFrame, averages: dict[str, tuple[str | tuple[str, str], int]], key: str = "symbol", at: str = "bar_date", skip: dict[str, int] | None = None, rolling: dict[str, tuple[str, int, str]] | None = None) -> DataFrame:
    """What ``with_ema`` gives, for rows that windows of their key hold in one task anyway: no further shuffle, sort or join.

    A column may be a pair of earlier averages: their difference. ``skip``: how many of a key's rows lie before an average's first.
    ``rolling``: name -> (column, n, mean or deviation) of the last n rows, null where there are fewer or one is null.
    Rows come in order, an Arrow batch at a time, and a batch hands on what its last key has reached. NaN counts as null.
    """
    order = Window.partitionBy(key).orderBy(at)
    rows = bars.withColumn("_row", F.row_number().over(order)).sortWithinPartitions(key, at)  # as the window leaves them
    names, skip, rolling = [f.name for f in bars.schema.fields], skip or {}, rolling or {}
    sources = sorted({c for c, _ in averages.values() if isinstance(c, str) and c not in averages} | {c for c, _, _ in rolling.values()})
    made = [*averages, *rolling]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = dict.fromkeys(averages, np.nan)
        before = {name: np.full(n - 1, np.nan) for name, (_, n, _) in rolling.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("_row").to_numpy(zero_copy_only=False)
            held = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in sources}
            for name, (column, span) in averages.items():
                x = held[column] if isinstance(column, str) else held[column[0]] - held[column[1]]
                held[name] = _recursive(np.where(place > skip.get(name, 0), x, np.nan), place == 1, 1 - 2 / (span + 1), reached[name])
                reached[name] = held[name][-1]
            for name, (column, n, kind) in rolling.items():
                x = np.concatenate([before[name], held[column]])
                before[name] = x[len(x) - n + 1 :]
                held[name] = np.where(place >= n, _rolling(x, n, kind), np.nan)
            out = [pa.array(held[name], mask=np.isnan(held[name])) for name in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *out], [*names, *made])

    return rows.mapInArrow(run, StructType([*bars.schema.fields, *(StructField(name, DoubleType()) for name in made)]))


def _rolling(x: np.ndarray, n: int, kind: str) -> np.ndarray:
    """Mean or deviation of every ``n`` neighbours, added up from the first one on as a window does."""
    parts = [x[k : len(x) - n + 1 + k] for k in range(n)]
    mean = sum(parts) / n
    return mean if kind == "mean" else np.sqrt(sum((p - mean) ** 2 for p in parts) / n)


def _recursive(x: np.ndarray, first: np.ndarray, decay: float, reached: float) -> np.ndarray:
    """Recursive averages of a batch: one for each key (it begins where ``first``), the first key's going on from ``reached``.

    The recurrence is linear, so sums over the last 1, 2, 4, .. values follow from one another; a sum is long enough where
    what lies before it weighs less than the rounding of doubles.
    """
    rows = np.arange(len(x))
    begin = np.maximum.accumulate(np.where(first, rows, 0))
    known = np.flatnonzero(~np.isnan(x))
    goes_on = not first[0] and not np.isnan(reached)
    if len(known):
        y, of = x[known], begin[known]
        new = np.append(True, of[1:] != of[:-1])
        since = np.arange(len(y)) - np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))
        if goes_on and of[0] == 0:
            new[0] = False
        y = np.where(new, y, (1 - decay) * y)
        if not new[0]:
            y[0] += decay * reached
        step = 1
        while step <= since.max() and decay**step > 1e-17:
            y[step:] += np.where(since[step:] >= step, decay**step * y[:-step], 0.0)
            step *= 2
    out = np.full(len(x), np.nan)
    if len(known):
        out[known] = y
    last = np.maximum.accumulate(np.where(np.isnan(out), -1, rows))
    filled = np.where(last >= begin, out[np.maximum(last, 0)], np.nan)
    return np.where((last < 0) & (begin == 0), reached, filled) if goes_on else filled


def true_range(high: Column | str, low: Column | str, close: Column | str, w: WindowSpec) -> Column:
    before = F.lag(_c(close)).over(w)
    return F.when(before.isNotNull(), F.greatest(_c(high) - _c(low), F.abs(_c(high) - before), F.abs(_c(low) - before)))


def average_true_range(tr: Column | str, n: int, w: WindowSpec) -> Column:
    return full(tr, F.avg(_c(tr)).over(trailing(w, n)), w, n)


def vwap(close: Column | str, volume: Column | str, n: int, w: WindowSpec) -> Column:
    f = trailing(w, n)
    return full(close, safe_ratio(F.sum(_c(close) * _c(volume)).over(f), F.sum(_c(volume)).over(f)), w, n)


def relative_slope(y: Column | str, index: Column | str, n: int, w: WindowSpec) -> Column:
    """Least-squares slope over the frame, as a share of its first value."""
    f = trailing(w, n)
    return full(y, safe_ratio(F.covar_pop(_c(index).cast("double"), _c(y)).over(f) / F.var_pop(_c(index).cast("double")).over(f), F.first(_c(y)).over(f)), w, n)


def rolling_beta(own: Column | str, benchmark: Column | str, n: int, w: WindowSpec) -> Column:
    f = trailing(w, n)
    var = F.var_pop(_c(benchmark)).over(f)
    return full(own, F.when(var > 0, F.covar_pop(_c(own), _c(benchmark)).over(f) / var), w, n)


def forward_return(close: Column | str, n: int, w: WindowSpec) -> Column:
    return safe_ratio(F.lead(_c(close), n).over(w), _c(close)) - 1


def drawdown(equity: Column | str, w: WindowSpec) -> Column:
    """Loss from the running peak."""
    return _c(equity) / F.max(_c(equity)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
