"""Subtitle time codes to seconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyframe.functions.text import BLANKS

_DIGITS = r"\d+(?:_\d+)*"
_SPACE = r"[\s\x1C-\x1F]*"
_WHOLE = rf"{_SPACE}[+-]?{_DIGITS}{_SPACE}:"
_REAL = rf"{_SPACE}[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?\d+)?{_SPACE}"
_TIME = rf"^(?:{_WHOLE}){{0,2}}{_REAL}$"


def ass_seconds(text: Column) -> Column:
    """`H:MM:SS.ss`, `MM:SS.ss` or `SS.ss` as seconds.

    A null and any text of more than three parts are 0.0; a part that is no number gives null.
    """
    colons = F.length(text) - F.length(F.replace(text, F.lit(":")))
    # Once the text is known to be a time, blanks and digit separators carry nothing.
    plain = F.translate(text, "_" + BLANKS, "")
    first = F.substring_index(plain, ":", 1).try_cast("bigint")
    middle = F.substring_index(F.substring_index(plain, ":", 2), ":", -1).try_cast("bigint")
    whole = F.when(colons == 2, first * 3600 + middle * 60).when(colons == 1, first * 60).otherwise(F.lit(0))
    seconds = F.substring_index(plain, ":", -1).try_cast("double")
    return (
        F.when(text.isNull() | (colons > 2), F.lit(0.0))
        .when(text.rlike(_TIME), whole.cast("double") + seconds)
    )


def label_seconds(seconds: Column) -> Column:
    """A labelled time; a missing one is 0.0."""
    return F.coalesce(seconds.cast("double"), F.lit(0.0))


def final_time(seconds: Column) -> Column:
    """Seconds as `HH:MM:SS.mmm`.

    The milliseconds are rounded half-even on the exact binary value and never carry into the seconds, so
    59.9996 is `00:00:60.000`. Null is `00:00:00.000`; hours grow without bound.
    """
    x = seconds.cast("double")
    rest = F.pmod(x, F.lit(60.0))
    minutes = F.floor((x - rest) / 60 + 0.5)
    text = F.format_string(
        "%02d:%02d:%06.3f", F.floor(minutes / 60), F.pmod(minutes, F.lit(60)), _millis(rest) / 1000)
    return F.when(x.isNull(), F.lit("00:00:00.000")).otherwise(text)


def iso_utc(ts: Column) -> Column:
    """ISO time in UTC with `+00:00`; microseconds only when there are any."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def _millis(x: Column) -> Column:
    """`x` thousandfold, rounded half-even without the rounding error of the product.

    `high` holds the leading bits of x, so both products with 2000 below are exact and the sign of `over`
    tells on which side of the midpoint between two milliseconds x lies.
    """
    base = F.floor(x * 1000)
    high = F.floor(x * 67108864.0) / 67108864.0
    over = (high * 2000 - (base * 2 + 1)) + (x - high) * 2000
    up = (over > 0) | ((over == 0) & (base % 2 == 1))
    return base + F.when(up, 1).otherwise(0)
