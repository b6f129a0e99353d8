"""Scalar derivations of order rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def design_of(item: Column) -> Column:
    """"DESIGN x" gives x, "47-0-0000" gives 47, anything else stays."""
    named = F.regexp_extract(item, r"(?i)^\s*DESIGN\s+(\S+)", 1)
    coded = F.regexp_extract(item, r"^\s*(\d+)-\d+-\d+\s*$", 1)
    return F.when(named != "", named).when(coded != "", coded).otherwise(F.trim(item))


def design_number(design: Column) -> Column:
    return F.regexp_extract(design, r"^\s*(\d+)", 1).try_cast("int")


def flags(named: dict[str, Column]) -> Column:
    return F.concat_ws(", ", *(F.when(c, F.lit(n)) for n, c in named.items()))


def co_label(number: Column) -> Column:
    return F.when(number > 0, F.concat(F.lit("CO#"), number.cast("string"))).otherwise("")


def split_arrangement(text: Column) -> Column:
    """struct(code, note): "A/4V C-Face" and "Arr. 9 x" give A/4V and A/9 with the rest as note."""
    slash, arr = r"(?i)^\s*(A/[0-9A-Z]+)\s*(.*)$", r"(?i)^\s*ARR(?:ANGEMENT|\.)?\s*([0-9][0-9A-Z]*)\s*(.*)$"
    by_slash = F.regexp_extract(text, slash, 1) != ""
    by_arr = F.regexp_extract(text, arr, 1) != ""
    code = F.when(by_slash, F.upper(F.regexp_extract(text, slash, 1))).when(by_arr, F.concat(F.lit("A/"), F.upper(F.regexp_extract(text, arr, 1)))).otherwise("")
    note = F.when(by_slash, F.trim(F.regexp_extract(text, slash, 2))).when(by_arr, F.trim(F.regexp_extract(text, arr, 2))).otherwise(F.trim(text))
    return F.struct(code.alias("code"), note.alias("note"))


def split_size(text: Column) -> Column:
    """struct(size, rest): a leading number, with a fraction, and what follows."""
    pattern = r"^\s*(\d+(?:\.\d+)?(?:\s*-?\s*\d+/\d+)?)\s*(.*)$"
    size = F.regexp_extract(text, pattern, 1)
    return F.struct(size.alias("size"), F.trim(F.when(size != "", F.regexp_extract(text, pattern, 2)).otherwise(text)).alias("rest"))


def folder_of(path: Column) -> Column:
    """Up to the last backslash, or where there is none, the last slash."""
    return F.when(F.instr(path, "\\") > 0, F.regexp_extract(path, r"^(.*)\\[^\\]*$", 1)).otherwise(F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def run_label(n: Column) -> Column:
    return F.when(n > 1, F.format_string("YES (%d)", n)).when(n == 1, "YES").otherwise("")


def special_temperature(design: Column, most: Column) -> Column:
    top = F.greatest(F.coalesce(design, F.lit(0)), F.coalesce(most, F.lit(0)))
    return F.when(top > 150, top.cast("string")).otherwise("0")


def previous_business_day(day: Column) -> Column:
    """Monday: Friday; Sunday: Friday; else the day before."""
    weekday = F.dayofweek(day)
    return F.when(weekday == 2, F.date_sub(day, 3)).when(weekday == 1, F.date_sub(day, 2)).otherwise(F.date_sub(day, 1))


def urgency(due: Column, today: Column) -> Column:
    return F.when(due.isNull(), "none").when(due < today, "overdue").when(due == today, "due today").when(due <= F.date_add(today, 3), "soon").otherwise("none")


def serial_day(day: Column) -> Column:
    """Days since 1899-12-30, as spreadsheets count."""
    return F.datediff(day, F.lit("1899-12-30").cast("date"))


def file_name(parts: list[Column]) -> Column:
    """Parts joined by underscores; signs that file systems refuse become underscores."""
    return F.regexp_replace(F.concat_ws("_", *parts), r'[<>:"/\\|?*]', "_")


def sold_to(text: Column) -> Column:
    """Cut before the second occurrence of the first word."""
    words = F.split(F.trim(text), r"\s+")
    again = F.array_position(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), words[0])
    return F.when(again > 0, F.array_join(F.slice(words, F.lit(1), again.cast("int")), " ")).otherwise(F.array_join(words, " "))


def route_owner(rules: list[tuple[Column, str]], otherwise: str = "") -> Column:
    """The owner of the first rule that holds."""
    out = F.lit(otherwise)
    for rule, owner in reversed(rules):
        out = F.when(rule, F.lit(owner)).otherwise(out)
    return out


def trusted_ok(status: Column, report: Column, source: Column) -> Column:
    return (status == "ok") & ~F.coalesce(report, F.lit(False)) & (F.coalesce(source, F.lit("")) != "")


def money(text: Column) -> Column:
    """"$1,234.50" as a number; what is none is null."""
    return F.regexp_replace(text, r"[$,\s]", "").try_cast("double")
