"""Column expressions that read dates written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish month names.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
}


def _checked_date(text: Column, pattern: str, fmt: str) -> Column:
    """A format applied only to text of its shape, so no format guesses at another's input."""
    return F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(fmt)).cast("date"))


def parse_date2(value: Column) -> Column:
    """``YYYY-MM-DD`` first, then ``DD/MM/YYYY``, each by its own format; otherwise null."""
    text = F.trim(value.cast("string"))
    return F.coalesce(
        _checked_date(text, r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        _checked_date(text, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    )


def parse_date_text(value: Column) -> Column:
    """``viernes, 12 de septiembre de 2025 9:05``, an ISO instant, or ``DD/MM/YYYY [HH:MM[:SS]]``."""
    text = F.lower(F.trim(value.cast("string")))
    pattern = r"(\d{1,2}) de ([a-záéíóú]+) de (\d{4})\s+(\d{1,2}):(\d{2})"
    part = lambda i: F.regexp_extract(text, pattern, i)
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    spelled = F.when(
        text.rlike(pattern),
        F.try_to_timestamp(
            F.format_string("%s-%02d-%s %s:%s:00", part(3), F.element_at(months, part(2)), part(1), part(4), part(5)),
            F.lit("yyyy-MM-d H:mm:ss"),
        ),
    )
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    day_first = F.when(
        text.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}"),
        F.coalesce(
            F.try_to_timestamp(F.replace(text, F.lit("-"), F.lit("/")), F.lit("d/M/yyyy H:mm:ss")),
            F.try_to_timestamp(F.replace(text, F.lit("-"), F.lit("/")), F.lit("d/M/yyyy H:mm")),
            F.try_to_timestamp(F.replace(text, F.lit("-"), F.lit("/")), F.lit("d/M/yyyy")),
        ),
    )
    return F.coalesce(spelled, iso, day_first)


def instant(date: Column, time: Column) -> Column:
    """Date plus ``HH:MM:SS`` text; a missing or unreadable time counts as midnight."""
    parts = F.split(F.when(time.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$"), time), ":")
    seconds = (
        F.get(parts, F.lit(0)).cast("int") * 3600
        + F.get(parts, F.lit(1)).cast("int") * 60
        + F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
    )
    return F.timestamp_seconds(F.unix_seconds(date.cast("timestamp")) + F.coalesce(seconds, F.lit(0)))


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
