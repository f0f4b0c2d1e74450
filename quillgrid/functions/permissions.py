"""Permission levels 1 (widest) to 3 (F06-F09); null is a legacy row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = (1, 2, 3)


def level(x: Column) -> Column:
    """A level from text or number; null for anything but 1, 2 and 3."""
    text = F.trim(x.cast("string"))
    return F.when(text.isin(*(str(n) for n in LEVELS)), text.cast("int"))


def allowed_levels(user_level: int | None) -> tuple[int, ...]:
    """Levels that a user sees: own and above; none for an unknown level."""
    return tuple(range(user_level, LEVELS[-1] + 1)) if user_level in LEVELS else ()


def visible(levels: Column, allowed: tuple[int, ...], legacy: bool = True) -> Column:
    """Whether a row may be seen: legacy rows if allowed, else its level is allowed; no levels see nothing."""
    if not allowed:
        return F.lit(False)
    known = F.coalesce(levels.isin(*allowed), F.lit(False))
    return (levels.isNull() | known) if legacy else known


def visible_raw(raw: Column, allowed: tuple[int, ...]) -> Column:
    """visible() on unparsed levels: an invalid level is not legacy and stays hidden."""
    if not allowed:
        return F.lit(False)
    return raw.isNull() | F.coalesce(level(raw).isin(*allowed), F.lit(False))
