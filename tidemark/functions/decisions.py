"""Scalar rules of decisions and outcomes, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Edges of return buckets, and the actions that count as buying and selling.
BUCKETS = [(-0.03, "big_loss"), (-0.005, "loss")]
BUY, SELL = ("STRONG BUY", "BUY"), ("SELL",)


def return_bucket(ret: Column) -> Column:
    """big_loss below -3 %, loss below -0.5 %, flat up to 0.5 %, gain up to 3 %, else big_gain; null stays null."""
    return F.when(ret < -0.03, "big_loss").when(ret < -0.005, "loss").when(ret <= 0.005, "flat").when(ret <= 0.03, "gain").when(ret.isNotNull(), "big_gain")


def outcome(action: Column, ret: Column) -> Column:
    """correct, incorrect, neutral (HOLD) or skipped (no return or no such action)."""
    buy = F.when(ret > 0, "correct").otherwise("incorrect")
    sell = F.when(ret <= 0, "correct").otherwise("incorrect")
    return F.when(ret.isNull(), "skipped").when(action.isin(*BUY), buy).when(action.isin("SELL", "HOLD OFF FOR NOW"), sell).when(action == "HOLD", "neutral").otherwise("skipped")


def exposure(action: Column) -> Column:
    return F.when(action.isin(*BUY), 1).when(action.isin(*SELL), -1).otherwise(0)


def epoch_seconds(x: Column) -> Column:
    """Seconds from an epoch number of unknown unit, told by its size; null where it isn't positive."""
    return F.when(x >= 10**17, x / 10**9).when(x >= 10**14, x / 10**6).when(x >= 10**11, x / 10**3).when(x > 0, x.cast("double"))


def clipped_sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))


def clipped_logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def hash_share(seed: str, key: Column) -> Column:
    """A stable number from 0 to 1: the first 32 bits of sha256(seed:key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def horizon_days(text: Column) -> Column:
    """'<N>d' from a text such as v1-5d, else unknown."""
    n = F.regexp_extract(text, r"([0-9]+)\s*d", 1)
    return F.when(n != "", F.concat(n, F.lit("d"))).otherwise("unknown")


def keyword_sentiment(title: Column, positive: list[str], negative: list[str]) -> Column:
    """(positive - negative) / (positive + negative) over substring matches; 0 without any."""
    t = F.lower(title)
    count = lambda words: sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0))
    p, n = count(positive), count(negative)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def partition_key(x: Column, fallback: str = "UNKNOWN") -> Column:
    """Upper-cased, other characters than A-Z, 0-9, _ and - replaced by _, 32 characters at most."""
    clean = F.substring(F.regexp_replace(F.upper(F.trim(F.coalesce(x, F.lit("")))), "[^A-Z0-9_-]", "_"), 1, 32)
    return F.when(clean == "", fallback).otherwise(clean)
