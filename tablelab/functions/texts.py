"""Text parsing expressions: units, ranges, prices, number words, mail and web addresses, sentiment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelab.functions import fixed_values as fixed
from tablelab.functions.columns import map_literal, strip, to_number


def _plain(c: Column) -> Column:
    return to_number(F.replace(c, F.lit(","), F.lit("")))


def units(c: Column) -> Column:
    """``3.5 kg`` -> 3.5, ``$2M`` -> 2000000; units themselves are not converted."""
    text = strip(c)
    out = None
    for pattern, factor in fixed.UNIT_PATTERNS:
        value = _plain(F.regexp_extract(text, pattern, 1)) * F.lit(factor)
        out = F.when(text.rlike(pattern), value) if out is None else out.when(text.rlike(pattern), value)
    return out


def capped(c: Column) -> Column:
    """Midpoint of ``10-20``, bound of ``<5`` or ``100+``, value of ``1,234``."""
    text = strip(c)
    low = _plain(F.regexp_extract(text, fixed.RANGE_PATTERN, 1))
    high = _plain(F.regexp_extract(text, fixed.RANGE_PATTERN, 2))
    middle = F.when(text.rlike(fixed.RANGE_PATTERN), (low + high) / 2.0)
    bound = F.when(text.rlike(fixed.CAPPED_PATTERN), _plain(F.regexp_extract(text, fixed.CAPPED_PATTERN, 1)))
    return F.coalesce(middle, bound, _plain(text))


def numerator(c: Column) -> Column:
    """``8/10`` -> 8."""
    text = strip(c)
    return F.when(text.rlike(fixed.RATIO_PATTERN), to_number(F.regexp_extract(text, fixed.RATIO_PATTERN, 1)))


def mail_host(c: Column) -> Column:
    """First label of the part after the at sign, ``unknown`` where there is none."""
    after = F.get(F.split(F.lower(strip(c)), "@"), F.lit(1))
    host = F.get(F.split(after, r"\."), F.lit(0))
    return F.when(c.isNotNull(), F.coalesce(host, F.lit("unknown")))


def mail_is_free(c: Column) -> Column:
    return F.coalesce(mail_host(c).isin(list(fixed.FREE_MAIL_HOSTS)), F.lit(False)).cast("int")


def web_domain(c: Column) -> Column:
    """Second-level label of a web address."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^https?://|^ftp://|^www\.", "")
    labels = F.split(F.get(F.split(bare, "/"), F.lit(0)), r"\.")
    return F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(F.get(labels, F.lit(0)))


def word_count(c: Column) -> Column:
    """Words between white space, 0 for NULL."""
    text = strip(c)
    return F.when(text != "", F.size(F.split(text, r"\s+"))).otherwise(F.lit(0)).cast("int")


def char_length(c: Column) -> Column:
    return F.length(F.coalesce(strip(c), F.lit(""))).cast("int")


def sentiment(c: Column) -> Column:
    """(positive words - negative words) / words, rounded to four digits."""
    low = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    pattern = r"(?<!\S)(?:" + "|".join([*fixed.POSITIVE_WORDS, *fixed.NEGATIVE_WORDS]) + r")(?!\S)"
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    good = list(fixed.POSITIVE_WORDS)
    balance = F.aggregate(found, F.lit(0), lambda n, w: n + F.when(w.isin(good), 1).otherwise(-1))
    return F.round(F.coalesce(F.try_divide(balance.cast("double"), word_count(c).cast("double")), F.lit(0.0)), 4)


def word_number(c: Column) -> Column:
    """``two hundred five`` -> 205; NULL when a word is no number word."""
    text = F.lower(strip(c))
    clean = strip(F.regexp_replace(text, r"[^a-z0-9\s\-]", " "))
    tokens = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    small = map_literal({k: float(v) for k, v in fixed.NUMBER_WORDS.items()})
    large = map_literal({k: float(v) for k, v in fixed.MAGNITUDE_WORDS.items()})

    def step(acc: Column, token: Column) -> Column:
        add = F.coalesce(F.when(token.rlike(r"^\d+$"), token.try_cast("double")), F.try_element_at(small, token))
        times = F.try_element_at(large, token)
        current = F.when(acc["current"] == 0.0, F.lit(1.0)).otherwise(acc["current"])
        return F.struct(
            F.when(add.isNotNull(), acc["current"] + add)
            .when(times >= 1000.0, F.lit(0.0))
            .when(times.isNotNull(), current * times)
            .otherwise(acc["current"])
            .alias("current"),
            F.when(times >= 1000.0, acc["total"] + current * times).otherwise(acc["total"]).alias("total"),
            (acc["bad"] | (add.isNull() & times.isNull())).alias("bad"),
        )

    start = F.struct(F.lit(0.0).alias("current"), F.lit(0.0).alias("total"), F.lit(False).alias("bad"))
    folded = F.aggregate(tokens, start, step)
    spelled = F.when(~folded["bad"] & (F.size(tokens) > 0), folded["current"] + folded["total"])
    missing = text.isin(list(fixed.MISSING_NUMBER_TOKENS))
    return F.coalesce(to_number(c), F.when(~missing, F.coalesce(to_number(clean), spelled)))


def price(c: Column) -> Column:
    """Price text to number, with European decimals (``1.234,56`` -> 1234.56)."""
    digits = strip(F.regexp_replace(strip(c), r"[^\d\s,\.'\-]", ""))
    european = digits.rlike(r",\d{2}$")
    with_point = F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_point = F.replace(digits, F.lit(","), F.lit("."))
    other = F.regexp_replace(digits, "[,' ]", "")
    text = F.when(european & digits.contains("."), with_point).when(european, no_point).otherwise(other)
    return to_number(text)
