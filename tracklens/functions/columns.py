"""Column-level functions: accuracy, lamps, regions, hash draws, index decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, cast({ts} as timestamp_ntz))")


def epoch_seconds(ts: str) -> Column:
    return F.expr(f"timestampdiff(SECOND, {_EPOCH}, cast({ts} as timestamp_ntz))")


def r(x, digits: int = 6) -> Column:
    """Rounded double; ``+ 0.0`` folds negative zero."""
    return F.round(_c(x).cast("double"), digits) + F.lit(0.0)


def acc_first(ex, notes) -> Column:
    """ex * 50 / notes, NULL without notes."""
    return F.when(_c(notes) > 0, _c(ex) * 50.0 / _c(notes))


# judgement weights: perfect-great counts 2, great counts 1, everything else 0
def acc_judge(weights: dict[str, int], others: list[str]) -> Column:
    """Weighted accuracy over the sum of all judgement counters; NULL for an empty sum."""
    total = sum((_c(c) for c in [*weights, *others]), F.lit(0))
    top = max(weights.values())
    gained = sum((_c(c) * w for c, w in weights.items()), F.lit(0))
    return F.when(total > 0, gained * 100.0 / (total * top))


def acc_two_counter(perfect, great, notes) -> Column:
    return F.when(_c(notes) > 0, (_c(perfect) * 2 + _c(great)) * 100.0 / (_c(notes) * 2))


# fixed values: lamp code of the second client -> lamp code of the first
LAMP_SHIFT = {0: 0, 1: 1, 2: 4, 3: 5, 4: 6, 5: 7, 6: 8, 7: 9, 8: 10, 9: 2, 10: 3}


def map_lamp(code, unknown: str = "error") -> Column:
    """Cross-client lamp code; an unknown code raises (or gives NULL with ``unknown='null'``)."""
    mapping = F.create_map(*[F.lit(v) for kv in LAMP_SHIFT.items() for v in kv])
    hit = F.try_element_at(mapping, _c(code).cast("int"))
    if unknown == "null":
        return hit
    return F.coalesce(hit, F.raise_error(F.concat(F.lit("unknown lamp "), _c(code).cast("string"))).cast("int"))


def parse_level(level) -> Column:
    """'12+' / '11-' -> 12.0 / 11.0; anything else unparsable -> NULL."""
    return F.expr("try_cast(regexp_replace(trim({0}), '[+-]+$', '') as double)".format(level))


def region(table, level) -> Column:
    """Coarse reporting region of (table, level)."""
    t, lv = _c(table), _c(level)
    return (
        F.when(t == "satellite", "SL")
        .when((t == "stella") & (lv <= 3), "ST0-3")
        .when((t == "stella") & (lv <= 7), "ST4-7")
        .when(t == "stella", "ST8+")
        .otherwise("insane")
    )


def coordinate(table, level) -> Column:
    """Fine reporting bands used by the coverage audit."""
    t, lv = _c(table), _c(level)
    sat, st = t == "satellite", t == "stella"
    return (
        F.when(sat & (lv <= 2), "SL0-2").when(sat & (lv <= 5), "SL3-5").when(sat & (lv <= 8), "SL6-8")
        .when(sat, "SL9-12").when(st & (lv <= 3), "ST0-3").when(st & (lv <= 7), "ST4-7")
        .when(st & (lv <= 12), "ST8-12").when(st, "ST13+").when(t == "insane", "insane").otherwise("none")
    )


def draw_hex(*parts) -> Column:
    """First 8 hex digits of an md5 draw; string order equals numeric order."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 8)


def draw_long(*parts) -> Column:
    return F.conv(draw_hex(*parts), 16, 10).cast("long")


def draw(*parts) -> Column:
    """Uniform draw in [0, 1), identical in every engine that has md5."""
    return draw_long(*parts) / F.lit(4294967296.0)


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def decode_index(pair, base) -> Column:
    """Two-character object index in base 36 (case-insensitive) or 62; invalid -> 0."""
    def digit(ch, b):
        c = F.when(b == 62, ch).otherwise(F.upper(ch))
        return F.instr(F.lit(DIGITS), c) - 1

    p, b = _c(pair), _c(base)
    hi, lo = digit(F.substring(p, 1, 1), b), digit(F.substring(p, 2, 1), b)
    ok = (F.length(p) == 2) & (hi >= 0) & (lo >= 0) & (hi < b) & (lo < b)
    return F.when(ok, hi * b + lo).otherwise(F.lit(0))
