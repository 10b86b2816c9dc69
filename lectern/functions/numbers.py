"""Spoken forms of numbers, versions and letters, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, places in a group of four, and groups.
DIGITS = "零一二三四五六七八九"
PLACES = ("", "十", "百", "千")
GROUPS = ("", "万", "亿", "兆")
LONGEST = 16


def digit_by_digit(number: Column) -> Column:
    return F.translate(number, "0123456789", DIGITS)


def _group(four: Column) -> Column:
    """A group of four digits; zeros between digits said once, none at the end."""
    said = F.concat(*[
        F.when(F.substring(four, i + 1, 1) == "0", "零").otherwise(
            F.concat(digit_by_digit(F.substring(four, i + 1, 1)), F.lit(PLACES[3 - i])))
        for i in range(4)
    ])
    return F.regexp_replace(F.regexp_replace(said, "零+", "零"), "零$", "")


def chinese_integer(number: Column) -> Column:
    """A run of ASCII digits as it is read; null if it is too long or no such run."""
    padded = F.lpad(number, LONGEST, "0")
    parts = []
    for k in range(4):
        four = F.substring(padded, 4 * k + 1, 4)
        parts.append(F.when(four == "0000", "零").otherwise(F.concat(_group(four), F.lit(GROUPS[3 - k]))))
    said = F.regexp_replace(F.regexp_replace(F.concat(*parts), "零+", "零"), "^零|零$", "")
    read = F.regexp_replace(said, "^一十", "十")
    spelled = (F.length(number) > 1) & number.startswith("0")
    return (
        F.when(~number.rlike(r"\A[0-9]+\z") | (F.length(number) > LONGEST), None)
        .when((number == "0") | spelled, digit_by_digit(number))
        .otherwise(read)
    )


def version_reading(version: Column) -> Column:
    """Components joined by 点; null if one can't be read."""
    parts = F.transform(F.split(version, r"\."), chinese_integer)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, "点"))


def spell(letters: Column) -> Column:
    return F.array_join(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), " ")
