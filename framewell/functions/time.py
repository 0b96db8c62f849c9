"""Timestamps as text and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewell.functions.binding import let

#: H:MM:SS or MM:SS, with a fraction after a comma or a dot.
TIMESTAMP = r"^\s*(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?\s*$"
#: The same at the start of a line, maybe in brackets.
LINE_TIMESTAMP = r"^\[?((?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)\]?"


def parse_timestamp(text: Column) -> Column:
    """Seconds of a timestamp; null if the text is none. A fraction is padded on the right: ``.5`` is 500 ms.

    With hours, minutes must have two digits.
    """
    number = lambda part: F.coalesce(F.nullif(part, F.lit("")), F.lit("0")).cast("int")

    def seconds(parts: Column) -> Column:
        hours, minutes, rest, fraction = (F.get(parts, F.lit(i)) for i in range(4))
        millis = F.rpad(fraction, 3, "0").cast("int") / F.lit(1000.0)
        whole = (number(hours) * 3600 + number(minutes) * 60 + number(rest)).cast("double")
        return F.when((hours == "") | (F.length(minutes) == 2), whole + F.when(fraction == "", F.lit(0.0)).otherwise(millis))

    read = lambda t: F.when(t.rlike(TIMESTAMP), let(F.split(F.regexp_replace(t, TIMESTAMP, "$1:$2:$3:$4"), ":"), seconds))
    return let(text, read)


def _clock(whole: Column) -> Column:
    """``HH:MM:SS`` of whole seconds; hours have as many digits as they need."""
    hours, two = F.floor(whole / 3600), lambda v: F.lpad(v.cast("string"), 2, "0")
    return F.concat(F.when(hours < 10, F.lit("0")).otherwise(F.lit("")), hours.cast("string"), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60))


def format_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole seconds, the rest dropped; null for negative ones."""
    clock = lambda whole: F.when(whole >= 0, _clock(whole))
    return let(F.floor(seconds).cast("long"), clock)


def format_srt_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, rounded to milliseconds with halves to even."""
    clock = lambda ms: F.concat(_clock(F.floor(ms / 1000)), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return let(seconds, lambda t: F.when(t >= 0, let(F.bround(t * 1000, 0).cast("long"), clock)))
