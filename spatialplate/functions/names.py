"""Names of wells and classes, and packed colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PALETTE


def well_name(row: Column, col: Column) -> Column:
    """A1 from row 1 and column 1."""
    return F.concat(F.char(row + 64), col.cast("string"))


def well_row(well: Column) -> Column:
    return F.substring(well, 1, 1)


def well_col(well: Column) -> Column:
    return F.substring(well, 2, 9).try_cast("int")


def numbered_class(name: Column, n: Column) -> Column:
    """class_001; from 1000 on the number has its own width."""
    return F.format_string("%s_%03d", name, n)


def combined_class(a: Column, b: Column, i: Column) -> Column:
    return F.concat_ws("_", a, b, i.cast("string"))


def file_stem(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def packed_colour(r: Column, g: Column, b: Column) -> Column:
    """A colour with full alpha as a signed 32-bit number."""
    return (r * 65536 + g * 256 + b - 16777216).cast("int")


def unpacked_colour(packed: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(packed, s).bitwiseAND(255) for s in (16, 8, 0)])


def palette_colour(pos: Column) -> Column:
    """The palette's colour at a position from 0, in rotation."""
    packed = F.array(*[F.lit(r * 65536 + g * 256 + b - 16777216) for r, g, b in PALETTE])
    return F.element_at(packed, (pos % len(PALETTE) + 1).cast("int"))


def percent(fraction: Column) -> Column:
    return F.format_string("%.2f%%", fraction * 100)
