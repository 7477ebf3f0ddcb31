"""List and page numbers: formats, labels and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Cyrillic letters that number lists, the numerals by digit, the usual formats and bullets.
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"
ROMAN = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm"))
FORMATS = ("decimal", "lowerLetter", "lowerRoman")
BULLETS = ("•", "◦", "▪")
LEVELS = 9
INDENT_TWIPS = 357


def roman(value: Column) -> Column:
    """Lower-case numerals of 1 to 3999, digit by digit."""
    out = F.lit("")
    for k in (3, 2, 1, 0):
        digit = (F.floor(value / 10**k) % 10).cast("int")
        out = F.concat(out, F.element_at(F.array(*(F.lit(x) for x in ROMAN[k])), digit + 1))
    return out


def lettered(value: Column, alphabet: str) -> Column:
    """a..z, then aa, bb and so on."""
    n = len(alphabet)
    one = F.substring(F.lit(alphabet), ((value - 1) % n + 1).cast("int"), F.lit(1))
    return F.repeat(one, (F.floor((value - 1) / n) + 1).cast("int"))


def format_number(value: Column, fmt: Column) -> Column:
    latin, cyrillic = lettered(value, "abcdefghijklmnopqrstuvwxyz"), lettered(value, CYRILLIC)
    plain = value.cast("string")
    is_roman = (value > 0) & (value < 4000)
    return (
        F.when((fmt == "lowerLetter") & (value > 0), latin).when((fmt == "upperLetter") & (value > 0), F.upper(latin))
        .when((fmt == "russianLower") & (value > 0), cyrillic).when((fmt == "russianUpper") & (value > 0), F.upper(cyrillic))
        .when((fmt == "lowerRoman") & is_roman, roman(F.when(is_roman, value).otherwise(1)))
        .when((fmt == "upperRoman") & is_roman, F.upper(roman(F.when(is_roman, value).otherwise(1))))
        .when((fmt == "decimalZero") & value.between(0, 9), F.concat(F.lit("0"), plain)).otherwise(plain)
    )


def level_label(text: Column, values: Column, formats: Column, legal: Column) -> Column:
    """A label's pattern with %n as the number of level n: in its format, in plain figures if legal, nothing beyond the values."""
    out = text
    for k in range(LEVELS):
        shown = F.when(F.size(values) > k, format_number(F.get(values, F.lit(k)), F.when(legal, "decimal").otherwise(F.get(formats, F.lit(k))))).otherwise("")
        out = F.replace(out, F.lit(f"%{k + 1}"), shown)
    return out


def default_levels(kind: Column, first_format: Column) -> Column:
    """The nine levels of a list that defines none: array of (level, format, text, start, left, hanging)."""
    rows = []
    for k in range(LEVELS):
        number = F.lit(FORMATS[k % 3]) if k else F.coalesce(first_format, F.lit(FORMATS[0]))
        rows.append(F.struct(
            F.lit(k).alias("level"),
            F.when(kind == "bullet", "bullet").when(kind == "none", "none").otherwise(number).alias("format"),
            F.when(kind == "bullet", BULLETS[k % 3]).when(kind == "none", "").otherwise(f"%{k + 1}.").alias("text"),
            F.lit(1).alias("start"), F.lit(INDENT_TWIPS * (k + 1)).alias("left"),
            F.when(kind == "none", 0).otherwise(INDENT_TWIPS).alias("hanging"),
        ))
    return F.array(*rows)
