"""Column functions for messy product data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label of a missing facet, texts that mean none, and amount units as factors of 万.
UNKNOWN = "未知"
NULL_TEXTS = ("", "nan", "none", "null", "nat", "-", "--", "n/a", "na")
UNITS = (("亿元", 10000.0), ("亿", 10000.0), ("万元", 1.0), ("万", 1.0), ("元", 0.0001))
#: Status words of products that are no longer active.
INACTIVE = "终止|退市|清盘|暂停|到期"


def strip_suffix(code: Column) -> Column:
    """``510050.SH`` as ``510050``."""
    return F.substring_index(F.trim(code), ".", 1)


def facet(value: Column) -> Column:
    """Null, empty and ``nan`` as the label of a missing facet."""
    return F.coalesce(F.nullif(F.nullif(value, F.lit("")), F.lit("nan")), F.lit(UNKNOWN))


def normal_date(text: Column) -> Column:
    """A date from eight digits or any text that casts to one, else null."""
    short = F.when(F.trim(text).rlike("^[0-9]{8}$"), F.try_to_date(F.trim(text), "yyyyMMdd"))
    return F.coalesce(short, F.trim(text).try_cast("date"))


def number(text: Column, percent: bool = False, amount: bool = False, suffixes: tuple[str, ...] = ()) -> Column:
    """The number in a messy text: percent sign, unit suffixes, thousands separators; ``amount`` scales to 万."""
    plain = F.trim(text)
    value = F.when(~F.lower(plain).isin(*NULL_TEXTS), plain)
    if percent:
        value = F.regexp_replace(value, "%$", "")
    if suffixes:
        value = F.regexp_replace(value, f"(?:{'|'.join(suffixes)})$", "")
    factor = F.lit(1.0)
    if amount:
        chain = None
        for unit, f in UNITS:
            hit = F.endswith(value, F.lit(unit))
            chain = F.when(hit, f) if chain is None else chain.when(hit, f)
        factor = chain.otherwise(1.0)
        value = F.regexp_replace(value, f"(?:{'|'.join(u for u, _ in UNITS)})$", "")
    digits = F.regexp_extract(F.regexp_replace(value, "[,， ]", ""), r"[-+]?\d*\.?\d+", 0)
    return F.nullif(digits, F.lit("")).try_cast("double") * factor


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def to_utc(value: Column, zone: str) -> Column:
    """A naive timestamp of a zone as naive UTC."""
    return F.to_utc_timestamp(value, zone)


def round_up_half(value: Column) -> Column:
    """Two decimals, with the nudge that turns binary near-halves upward."""
    return F.round(value + 1e-8, 2)


def round_even(value: Column, places: int = 4) -> Column:
    return F.bround(value, places)


def issue_text(amount: Column) -> Column:
    """An amount in 万, from 10 000 on in 亿, with two decimals; missing is ``--``."""
    large = F.concat(F.format_number(amount / 10000, 2), F.lit("亿"))
    return F.when(amount.isNull(), "--").when(amount >= 10000, large).otherwise(F.concat(F.format_number(amount, 2), F.lit("万")))


def amount_text(amount: Column) -> Column:
    """An amount in 万, from 10 000 on either side in 亿, with two decimals at most; missing is ``--``."""
    large = F.concat(_plain(amount / 10000), F.lit(" 亿"))
    return F.when(_unknown(amount), "--").when(F.abs(amount) >= 10000, large).otherwise(F.concat(_plain(amount), F.lit(" 万")))


def _unknown(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def _plain(value: Column) -> Column:
    """Grouped digits and no trailing zeros, two decimals at most."""
    return F.regexp_replace(F.regexp_replace(F.format_number(F.round(value, 2), 2), "0+$", ""), r"\.$", "")


def decimal_text(value: Column, digits: int = 2, signed: bool = False) -> Column:
    """Grouped digits with so many decimals, with its sign always if ``signed``; missing or not finite is ``--``."""
    text = F.format_number(F.round(value, digits), digits)
    if signed:
        text = F.when(value >= 0, F.concat(F.lit("+"), text)).otherwise(text)
    return F.when(_unknown(value), "--").otherwise(text)


def percent_text(value: Column, digits: int = 2, signed: bool = True) -> Column:
    """A figure that is in percent already, with its sign and ``%``."""
    return F.when(_unknown(value), "--").otherwise(F.concat(decimal_text(value, digits, signed), F.lit("%")))


def ratio_text(value: Column) -> Column:
    """A share as percent with one decimal."""
    return percent_text(value * 100, 1, False)


def known_text(value: Column) -> Column:
    """Trimmed text; missing or empty is 未知."""
    text = F.trim(value)
    return F.when(F.coalesce(text, F.lit("")) == "", "未知").otherwise(text)


def share(value: Column, low: Column, high: Column, smaller_is_better: bool = False) -> Column:
    """Min-max position in [0, 1]; an empty range is 1."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value - low, high - low)))
    return F.when(low == high, F.lit(1.0)).otherwise(1 - at if smaller_is_better else at)


def spec_key(spec: dict) -> str:
    """SHA-1 of a request's canonical JSON: keys sorted, nulls dropped."""
    import hashlib
    import json

    def pruned(x):
        if isinstance(x, dict):
            return {k: pruned(v) for k, v in x.items() if v is not None}
        return [pruned(v) for v in x] if isinstance(x, list | tuple) else x

    return hashlib.sha1(json.dumps(pruned(spec), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
