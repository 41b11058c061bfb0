"""Path expressions; paths are relative and separated by '/'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parent(path: str) -> Column:
    """Everything before the last '/', or the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def top_level(path: str) -> Column:
    return F.substring_index(path, "/", 1)


def segments(path: str) -> Column:
    """Directory names on the path, without the file's own name."""
    return F.expr(f"slice(split({path}, '/'), 1, size(split({path}, '/')) - 1)")


def ancestors(path: str) -> Column:
    """Every directory above the path, outermost first. Exploding them turns prefix joins into equal-key ones."""
    return F.expr(f"transform(array(split({path}, '/')), s -> if(size(s) < 2, cast(array() as array<string>), transform(sequence(1, size(s) - 1), n -> array_join(slice(s, 1, n), '/'))))[0]")


def under(path: str, prefix: str) -> Column:
    """Descendants of a directory; pushed down to the scan as a prefix filter."""
    return F.col(path).startswith(prefix.rstrip("/") + "/")


def shown(absolute: str, relative: str, redact: bool) -> Column:
    """Path for reports: absolute, or, when redacted, relative to a placeholder."""
    if not redact:
        return F.coalesce(F.nullif(F.col(absolute), F.lit("")), F.col(relative), F.lit(""))
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return F.when(has(relative), F.concat(F.lit("<source>/"), F.col(relative))).when(has(absolute), F.lit("<source>")).otherwise(F.lit(""))
