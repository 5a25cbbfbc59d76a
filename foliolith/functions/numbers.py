"""Numbers in recognised text, spreadsheet cells and ranges, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliolith.runtime import let

_SIGNED = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"


def finite(value: Column) -> Column:
    """The value, null if it is not a finite number."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def numeric_value(label: Column) -> Column:
    """Number of a normalised label: plain, with an exponent, in groups of thousands, or [c ×] 10^n; a trailing percent
    sign keeps displayed units. Anything else, and what is not finite, is null.
    """
    power = rf"^(?:({_SIGNED})[×x*])?10\^([+-]?[0-9]+)$"

    def of_bare(bare: Column) -> Column:
        coefficient = F.coalesce(F.regexp_extract(bare, power, 1).try_cast("double"), F.lit(1.0))
        raised = coefficient * F.pow(F.lit(10.0), F.regexp_extract(bare, power, 2).try_cast("double"))
        return F.when(bare.rlike(rf"^{_SIGNED}(?:[eE][+-]?[0-9]+)?$"), bare.try_cast("double")).when(bare.rlike(power), raised)

    def grouped(bare: Column) -> Column:
        return F.when(bare.rlike(r"^[+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"), F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)

    bare = let(F.regexp_replace(F.replace(label, F.lit(" "), F.lit("")), "%$", ""), grouped)
    return let(let(bare, of_bare), finite)


def sheet_value(text: Column) -> Column:
    """struct<type, long, double, string>: how a cell text is typed in a spreadsheet. No leading zeros, a float needs a
    dot, other texts stay texts; integers beyond 64 bits stay texts too.
    """
    whole = text.rlike(r"^[+-]?(?:0|[1-9][0-9]*)$")
    real = text.rlike(r"^[+-]?(?:0|[1-9][0-9]*)\.[0-9]+(?:[eE][+-]?[0-9]+)?$")
    read = F.struct(text.alias("t"), F.when(whole, text.try_cast("bigint")).alias("n"), F.when(real, text.try_cast("double")).alias("d"))
    return let(
        read,
        lambda r: F.struct(
            F.when(r["n"].isNotNull(), "int").when(finite(r["d"]).isNotNull(), "float").otherwise("text").alias("type"),
            r["n"].alias("long"),
            finite(r["d"]).alias("double"),
            F.when(r["n"].isNull() & finite(r["d"]).isNull(), r["t"]).alias("string"),
        ),
    )


def cell_id(row: Column, column: Column) -> Column:
    """Cell id R001C001."""
    return F.format_string("R%03dC%03d", row, column)


def cell_position(cell: Column) -> Column:
    """struct<row, column> of a cell id; null if it is none or a part is zero."""
    row, column = (F.regexp_extract(cell, r"^R([0-9]{3,9})C([0-9]{3,9})$", i).try_cast("int") for i in (1, 2))
    return F.when((row > 0) & (column > 0), F.struct(row.alias("row"), column.alias("column")))


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a column number (bijective base 26; up to 18,278 = ZZZ)."""
    letter = lambda x: F.chr((x + 65).cast("bigint"))
    return let(
        number.cast("bigint") - 1,
        lambda n: let(
            F.floor(n / 26),
            lambda two: F.concat(
                F.when(two > 26, letter(F.floor((two - 1) / 26) - 1)).otherwise(""),
                F.when(two > 0, letter(F.pmod(two - 1, F.lit(26)))).otherwise(""),
                letter(F.pmod(n, F.lit(26))),
            ),
        ),
    )


def column_number(letters: Column) -> Column:
    """Column number of spreadsheet letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def sheet_range(row: Column, column: Column, rowspan: Column, colspan: Column) -> Column:
    """Range A1:B2 of a spanning cell."""
    return F.concat(column_letters(column), row.cast("string"), F.lit(":"), column_letters(column + colspan - 1), (row + rowspan - 1).cast("string"))


def parsed_range(text: Column) -> Column:
    """struct<row, column, rowspan, colspan> of a range; null if it is none or runs backwards."""
    pattern = r"^([A-Z]{1,3})([1-9][0-9]{0,8}):([A-Z]{1,3})([1-9][0-9]{0,8})$"

    def of_text(t: Column) -> Column:
        c1, c2 = (column_number(F.regexp_extract(t, pattern, i)) for i in (1, 3))
        r1, r2 = (F.regexp_extract(t, pattern, i).try_cast("bigint") for i in (2, 4))
        return F.when(t.rlike(pattern), let(F.struct(r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), c2.alias("c2")), of_corners))

    def of_corners(k: Column) -> Column:
        box = F.struct(k["r1"].alias("row"), k["c1"].alias("column"), (k["r2"] - k["r1"] + 1).alias("rowspan"), (k["c2"] - k["c1"] + 1).alias("colspan"))
        return F.when((k["c2"] >= k["c1"]) & (k["r2"] >= k["r1"]), box)

    return let(text, of_text)


def axis_coordinate(value: Column, scale: Column) -> Column:
    """Linear or base-10 logarithmic coordinate of a value; null where the logarithm has none."""
    return F.when(scale == "log", F.when(value > 0, F.log10(value))).otherwise(value)


def interval_distance(value: Column, low: Column, high: Column) -> Column:
    """Distance of a value to a closed interval."""
    return F.greatest(low - value, F.lit(0.0), value - high)


def to_pixels(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Pixels of a point given in thousandths of the image; null outside 0..1000."""
    inside = x.between(0, 1000) & y.between(0, 1000)
    return F.when(inside, F.struct((x * width / 1000).alias("x"), (y * height / 1000).alias("y")))


def sheet_scale(width: Column, height: Column, most: int = 4096) -> Column:
    """Factor that brings the longer side of a sheet to at most `most` pixels."""
    return F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
