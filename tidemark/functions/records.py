"""Lenient reading of decision records, as Columns: numbers, times, actions, precedences, symbols, sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that stand for another symbol, and symbols that are never taken.
SPELLINGS = {"NVDIA": "NVDA", "NVSIA": "NVDA", "APPL": "AAPL", "APPL.": "AAPL", "TSL": "TSLA", "TESLA": "TSLA"}
BAD, FUNDS = ("OLFS", "REVN", "SDNQ", "ADLX"), ("FDRXX", "SPAXX")
#: Weight of a publisher by what its name holds, first match first.
PUBLISHERS = {"reuters": 1.0, "bloomberg": 0.97, "wall street journal": 0.95, "financial times": 0.95, "cnbc": 0.93, "yahoo": 0.88}
MARKET_WORDS = ("earnings", "guidance", "downgrade", "upgrade", "launch", "satellite", "war", "tariff", "lawsuit")


def first_text(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def blank_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", F.trim(x))


def finite(text: Column) -> Column:
    """A number from text; blanks, words, NaN and infinities are null."""
    x = F.trim(text).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive_seconds(text: Column) -> Column:
    """Seconds from a text of digits alone; null where it isn't positive."""
    x = F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("bigint"))
    return F.when(x > 0, x)


def action(*values: Column) -> Column:
    return blank_to_null(F.upper(first_text(*values)))


def share(p: Column) -> Column:
    """A probability given as a share or in percent, within 0 and 1."""
    p = F.when(p > 1, p / 100).otherwise(p)
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def completeness(provider: Column, groups: list[Column]) -> Column:
    n = sum((g.isNotNull().cast("int") for g in groups), F.lit(0))
    return F.when(provider == "portfolio_quote_only", "quote_only").when(n >= 3, "full_signal").when(n > 0, "partial_signal").otherwise("quote_only")


def training_symbol(raw: Column, failures: Column) -> tuple[Column, Column, Column]:
    """(symbol or null, reason of rejection or null, whether a spelling was mended)."""
    upper = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    mended = reduce(lambda acc, kv: acc.when(upper == kv[0], kv[1]), SPELLINGS.items(), F.when(F.lit(False), "")).otherwise(upper)
    reason = (
        F.when(upper == "", "empty_symbol").when(mended.isin(*BAD), "known_bad_symbol").when(mended.isin(*FUNDS), "fund_or_cash_equivalent_symbol")
        .when(failures >= 2, "cached_failure").when(F.contains(mended, F.lit(".")), "unsupported_suffix").when(mended.rlike("[-=/]|^\\^"), "unsupported_non_equity_symbol")
        .when(~mended.rlike("^[A-Z]+$"), "non_alpha_symbol").when(F.length(mended) > 5, "implausible_length")
    )
    return F.when(reason.isNull(), mended), reason, mended != upper


def symbol_of_text(raw: Column) -> Column:
    """A symbol from plain text, a query string or an address; at most 15 of A-Z, 0-9 and ^ - . =."""
    asked = F.regexp_extract(raw, r"(?i).*symbol=([^&]*)", 1)
    text = F.when(raw.rlike("(?i)symbol="), asked).when(~F.contains(raw, F.lit("?")), F.regexp_extract(raw, "^[^/]*", 0)).otherwise(raw)
    return F.substring(F.regexp_replace(F.upper(text), r"[^A-Z0-9^\-.=]", ""), 1, 15)


def horizon(text: Column) -> Column:
    """'<N>d' from 5d, '5 D' or 5day; anything else is unknown."""
    t = F.regexp_replace(F.lower(F.trim(text)), " ", "")
    n = F.regexp_extract(t, "^([0-9]+)d(ay)?$", 1).try_cast("int")
    return F.when(n > 0, F.concat(n.cast("string"), F.lit("d"))).otherwise("unknown")


def first_horizon(*texts: Column, legacy: Column) -> Column:
    """The first horizon that is known, else that of a legacy version."""
    return F.coalesce(*[F.nullif(horizon(F.coalesce(t, F.lit(""))), F.lit("unknown")) for t in texts], legacy, F.lit("unknown"))


def publisher_weight(publisher: Column) -> Column:
    p = F.lower(F.coalesce(publisher, F.lit("")))
    return reduce(lambda acc, kv: acc.when(F.contains(p, F.lit(kv[0])), kv[1]), PUBLISHERS.items(), F.when(F.lit(False), 0.0)).otherwise(0.75)


def relevance(title: Column, symbol: Column, company: Column, words: tuple[str, ...] = MARKET_WORDS) -> Column:
    """0.45, and 0.3 for the symbol, 0.2 for a word of the company's name, 0.1 for a market word; 1 at most."""
    t = F.lower(F.coalesce(title, F.lit("")))
    names = F.filter(F.split(F.lower(F.replace(company, F.lit(","), F.lit(" "))), " +"), lambda w: F.length(w) > 2)
    market = reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    score = F.lit(0.45) + F.when(F.contains(t, F.lower(symbol)), 0.3).otherwise(0.0) + F.when(F.exists(names, lambda w: F.contains(t, w)), 0.2).otherwise(0.0) + F.when(market, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def recency(age_hours: Column) -> Column:
    return F.when(age_hours.isNull(), 0.45).when(age_hours <= 6, 1.0).when(age_hours <= 24, 0.85).when(age_hours <= 72, 0.65).otherwise(0.4)


def percent_near(page: Column, labels: list[str]) -> Column:
    """The first percentage behind the first of some labels in a page's text, as a share."""
    text = F.regexp_replace(page, "<[^>]*>", " ")
    found = [F.regexp_extract(text, rf"(?i){label}[^0-9+-]*([+-]?[0-9]+(?:\.[0-9]+)?)\s*%", 1).try_cast("double") for label in labels]
    return F.coalesce(*found) / 100


def easter(year: Column) -> Column:
    """Easter Sunday of a year."""
    a, century, of = year % 19, F.floor(year / 100), year % 100
    sunday = F.floor((century - F.floor((century + 8) / 25) + 1) / 3)
    h = (19 * a + century - F.floor(century / 4) - sunday + 15) % 30
    lead = (32 + 2 * (century % 4) + 2 * F.floor(of / 4) - h - of % 4) % 7
    day = h + lead - 7 * F.floor((a + 11 * h + 22 * lead) / 451) + 114
    return F.make_date(year, F.floor(day / 31).cast("int"), (day % 31 + 1).cast("int"))


def is_holiday(day: Column) -> Column:
    """Exchange holidays: fixed days moved off weekends, weekdays of a month, Good Friday; Juneteenth from 2022."""
    month, dom, weekday = F.month(day), F.dayofmonth(day), F.weekday(day)
    nth = lambda m, w, n: (month == m) & (weekday == w) & (F.ceil(dom / 7) == n)
    # On the day itself, on Friday where it is a Saturday, on Monday where it is a Sunday.
    fixed = lambda m, d: F.array_contains(F.array(F.when(weekday < 5, day), F.when(weekday == 4, F.date_add(day, 1)), F.when(weekday == 0, F.date_sub(day, 1))), F.make_date(F.year(day), F.lit(m), F.lit(d)))
    return F.coalesce(
        fixed(1, 1) | fixed(7, 4) | fixed(12, 25) | (fixed(6, 19) & (F.year(day) >= 2022)), F.lit(False)
    ) | nth(1, 0, 3) | nth(2, 0, 3) | nth(9, 0, 1) | nth(11, 3, 4) | ((month == 5) & (weekday == 0) & (dom > 24)) | (day == F.date_sub(easter(F.year(day)), 2))


def session(at: Column) -> Column:
    """pre, regular, after or closed of a UTC time, by the exchange's local clock and calendar."""
    local = F.from_utc_timestamp(at, "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    day = F.to_date(local)
    closed = (F.weekday(day) >= 5) | is_holiday(day)
    return F.when(closed, "closed").when((minute >= 240) & (minute < 570), "pre").when((minute >= 570) & (minute < 960), "regular").when((minute >= 960) & (minute < 1200), "after").otherwise("closed")


def stale_after(session: Column) -> Column:
    return F.when(session == "regular", 15).when(session.isin("pre", "after"), 60).otherwise(86400)


def recipe_hash(fields: list[Column]) -> Column:
    """sha256 of a record's JSON with its fields in order of name."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)
