"""Number, size and duration texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _scaled(value: Column, step: float, units: tuple[str, ...]) -> Column:
    out = None
    for i, unit in reversed(list(enumerate(units))):
        text = F.concat(F.format_string("%.1f", F.bround(value / F.lit(step**i), 1)), F.lit(f" {unit}"))
        out = text if out is None else F.when(value < F.lit(step ** (i + 1)), text).otherwise(out)
    return out


def binary_size(c: str) -> Column:
    """1536 -> 1.5 KiB."""
    v = F.coalesce(F.col(c), F.lit(0)).cast("double")
    return F.when(v < 1024, F.concat(v.cast("long").cast("string"), F.lit(" B"))).otherwise(_scaled(v / 1024, 1024.0, ("KiB", "MiB", "GiB", "TiB", "PiB")))


def percent(part: str, whole: str) -> Column:
    w = F.coalesce(F.col(whole), F.lit(0)).cast("double")
    return F.when(w == 0, F.lit("0%")).otherwise(F.concat(F.format_string("%.1f", F.bround(F.lit(100.0) * F.coalesce(F.col(part), F.lit(0)) / F.nullif(w, F.lit(0.0)), 1)), F.lit("%")))


def duration(c: str) -> Column:
    """m:ss below an hour, else h:mm:ss."""
    s = F.greatest(F.lit(0), F.bround(F.col(c)).cast("long"))
    h, m, x = F.expr(f"greatest(0, cast(bround({c}) as bigint)) div 3600"), F.expr(f"greatest(0, cast(bround({c}) as bigint)) % 3600 div 60"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, x)).otherwise(F.format_string("%02d:%02d", m, x))
