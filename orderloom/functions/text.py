"""Text functions as column expressions: normal forms, tags, line kinds, labelled values, names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderloom.functions.rules import ABBREVIATIONS, SECTION_END, SECTION_START, SKIP, TAGS

_FOLDED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}
# fixed values: trailing columns of an item line
PRICE = r"(?:^|\s)(\$\s*\d[\d,]*(?:\.\d{2})?|\d{1,3}(?:,\d{3})+(?:\.\d{2})?|\d+\.\d{2}|N/?C\b|NO\s+CHARGE|INCLUDED)\s*$"
EACH = r"(?:^|\s)(?:EA(?:CH)?|/EA|PER\s+UNIT)\s*$"
TYPE_AND_MARK = r"\s+([LCN])\s+(STD|INC|INCL|INCLUDED|N/?C|N/?A)\.?\s*$"
TYPE = r"\s+([LCN])\s*$"
LEAD = r"^\s*(?:ITEM\s*)?\(?(\d{1,3})\)?\s*(?:[.):]|-(?=\s))?\s+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(text: Column) -> Column:
    """Accented Latin letters without their accents; combining marks go."""
    return F.regexp_replace(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())), r"\p{M}", "")


def split_lead(text: Column) -> Column:
    """struct(text, qty): a leading item number is taken off."""
    return F.struct(F.trim(F.regexp_replace(text, f"(?i){LEAD}", "")).alias("text"), F.regexp_extract(text, f"(?i){LEAD}", 1).alias("qty"))


def split_price(text: Column, most: int = 8) -> Column:
    """struct(text, price): up to `most` trailing money columns and EACH marks are taken off; the leftmost price counts. Most texts
    have none or one, and are searched once more than they have columns."""
    column = f"(?i)(?:{EACH})|(?:{PRICE})"

    def step(acc: Column, _: Column) -> Column:
        each, price = acc["text"].rlike(f"(?i){EACH}"), F.regexp_extract(acc["text"], f"(?i){PRICE}", 1)
        money = ~each & acc["text"].rlike(f"(?i){PRICE}")
        rest = F.when(each, F.regexp_replace(acc["text"], f"(?i){EACH}", "")).when(money, F.regexp_replace(acc["text"], f"(?i){PRICE}", "")).otherwise(acc["text"])
        return F.struct(F.rtrim(rest).alias("text"), F.when(money, F.trim(price)).otherwise(acc["price"]).alias("price"))

    def first(start: Column) -> Column:
        return F.when(start["text"].rlike(column), let(step(start, start), rest)).otherwise(start)

    def rest(one: Column) -> Column:
        return F.when(one["text"].rlike(column), F.aggregate(F.sequence(F.lit(2), F.lit(most)), one, step)).otherwise(one)

    return let(F.struct(F.rtrim(text).alias("text"), F.lit("").alias("price")), first)


def split_type(text: Column) -> Column:
    """struct(text, type, mark): a trailing price type, with or without a mark in place of the price."""
    both, alone = text.rlike(f"(?i){TYPE_AND_MARK}"), text.rlike(TYPE)
    strip = lambda c: F.regexp_replace(c, "[ ,;:-]+$", "")
    rest = F.when(both, strip(F.regexp_replace(text, f"(?i){TYPE_AND_MARK}", ""))).when(alone, strip(F.regexp_replace(text, TYPE, ""))).otherwise(F.trim(text))
    kind = F.when(both, F.upper(F.regexp_extract(text, f"(?i){TYPE_AND_MARK}", 1))).otherwise(F.regexp_extract(text, TYPE, 1))
    return F.struct(rest.alias("text"), kind.alias("type"), F.upper(F.regexp_extract(text, f"(?i){TYPE_AND_MARK}", 2)).alias("mark"))


def normalize(raw: Column, strip_columns: bool = True, abbreviations: dict[str, str] | None = None) -> Column:
    """The form in which lines are compared: folded, upper case, columns taken off, abbreviations written out, signs as blanks;
    points stay within numbers."""
    text = F.upper(fold(F.trim(F.coalesce(raw, F.lit("")))))
    if strip_columns:
        text = let(text, lambda t: let(split_lead(t)["text"], lambda u: let(split_price(u)["text"], lambda v: split_type(v)["text"])))
    known = F.create_map(*(F.lit(x) for pair in (ABBREVIATIONS if abbreviations is None else abbreviations).items() for x in pair))

    def token(tok: Column) -> Column:
        return let(F.regexp_replace(tok, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", ""), lambda bare: written_out(tok, bare))

    def written_out(tok: Column, bare: Column) -> Column:
        # fixed values: forms of stainless steel
        steel = F.coalesce(F.nullif(F.regexp_extract(bare, r"^T?(\d{3}L?)(?:SST?|SS)$", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"^(?:SST?|STAINLESS)(304L?|316L?)$", 1), F.lit("")))
        return (
            F.when(bare == "NAN", F.lit(""))
            .when(F.map_contains_key(known, bare), F.try_element_at(known, bare))
            .when(bare.rlike("^T?\\d{3}L?SS|^SS|^STAINLESS") & steel.isNotNull(), F.concat(steel, F.lit(" STAINLESS STEEL")))
            .when(bare.startswith("W/") & (F.length(bare) > 2), F.concat(F.lit("WITH "), F.substr(bare, F.lit(3))))
            .otherwise(tok)
        )

    # most texts have no token to write out: one search tells, and the tokens are then not taken apart
    forms = "|".join([*map(re.escape, sorted(ABBREVIATIONS if abbreviations is None else abbreviations)), "NAN", r"T?\d{3}L?(?:SST?|SS)", "(?:SST?|STAINLESS)(?:304L?|316L?)", r"W/\S+"])
    within = rf"(?:^|\s)[.,;:()\[\]]*(?:{forms})[.,;:()\[\]]*(?:\s|$)"
    joined = let(text, lambda t: F.when(t.rlike(within), F.array_join(F.transform(F.split(t, r"\s+"), token), " ")).otherwise(F.regexp_replace(t, r"\s+", " ")))
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"(?<!\d)\.|\.(?!\d)", " "), "[^A-Z0-9.%#]+", " "))


def tags(text: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Sorted names of the tags that have a pattern in the text."""
    named = sorted((TAGS if rules is None else rules).items())
    return F.array_compact(F.array(*(F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in named)))


def compare_form(value: Column) -> Column:
    """Upper case, letters, digits and .%+/- kept, others as one blank; values that say nothing are empty."""
    text = F.trim(F.regexp_replace(F.upper(F.trim(F.coalesce(value, F.lit("")))), "[^A-Z0-9.%+/-]+", " "))
    return F.when(text.isin("N/A", "NA", "NONE", "UNKNOWN"), "").otherwise(text)


def respaced(value: Column, text: Column) -> Column:
    """value with the blanks that its words have in text, for words that were joined: each word is looked for in text whatever blanks
    stand between its letters, and its first place is taken with these, as one blank each. Words that are not found stay; so does
    every letter. Null texts have no words."""
    blank = r"[\s\p{Z}]"

    def place(word: Column) -> Column:
        letters = F.transform(F.regexp_extract_all(word, F.lit("(?s)."), 0), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E")))
        found = F.regexp_substr(F.coalesce(text, F.lit("")), F.array_join(letters, f"{blank}*"))
        return F.coalesce(F.regexp_replace(found, f"{blank}+", " "), word)

    words = F.filter(F.split(value, f"{blank}+"), lambda w: w != "")
    return F.array_join(F.transform(words, place), " ")


def order_number(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")


def validation(expected: Column, found: Column, readable: Column) -> Column:
    """MATCH, MISMATCH, UNVERIFIABLE (nothing found) or UNREADABLE."""
    return F.when(~readable, "UNREADABLE").when(F.coalesce(found, F.lit("")) == "", "UNVERIFIABLE").when(order_number(found) == order_number(expected), "MATCH").otherwise("MISMATCH")


def label_value(lines: Column, label: str) -> Column:
    """The value of the first line `label: value`."""
    hit = F.filter(lines, lambda x: x.rlike(rf"(?i)^\s*{label}\s*:\s*\S"))
    return F.regexp_extract(F.try_element_at(hit, F.lit(1)), rf"(?i)^\s*{label}\s*:\s*(.*\S)", 1)


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+"), F.lit(0)))


def names_in(text: Column, roster: dict[str, list[str]]) -> Column:
    """Sorted names of those one of whose aliases stands in the text between signs that are no letters or digits."""
    hit = lambda aliases: text.rlike("(?i)(?<![A-Za-z0-9])(?:" + "|".join(aliases) + ")(?![A-Za-z0-9])")
    return F.array_compact(F.array(*(F.when(hit(a), F.lit(n)) for n, a in sorted(roster.items()))))


def any_of(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def opens_section(line: Column) -> Column:
    """A line of at most 48 characters that names a section."""
    return (F.length(F.trim(line)) <= 48) & any_of(F.trim(line), SECTION_START)


def closes_section(line: Column) -> Column:
    return any_of(F.trim(line), SECTION_END)


def line_kind(line: Column, open_section: Column) -> Column:
    """blank, section_start, section_end, skip, item_priced, item_section or text; open_section: the name of an open one or null.

    An item ends in a price or a price type, with letters before it (three of them where a type stands alone). Base fans and what
    stands in a section are items without either."""

    def unskipped(body: Column, price: Column, kind: Column, mark: Column) -> Column:
        words = body.rlike("[A-Za-z]") & ~((kind != "") & (price == "") & (mark == "") & ~body.rlike("[A-Za-z]{3}"))
        plain = F.when(body.rlike(r"(?i)^Base\s+Fan\b"), "item_section").when(open_section.isNotNull(), "item_section").otherwise("text")
        return F.when((price != "") | (kind != ""), F.when(words, "item_priced").otherwise("text")).otherwise(plain)

    priced = let(split_price(F.trim(line)), lambda p: let(split_type(p["text"]), lambda t: unskipped(t["text"], p["price"], t["type"], t["mark"])))
    return (
        F.when(F.trim(line) == "", "blank")
        .when(opens_section(line), "section_start")
        .when(open_section.isNotNull() & closes_section(line), "section_end")
        .when(any_of(F.trim(line), SKIP), "skip")
        .otherwise(priced)
    )


def coverage(text: Column, fields: Column, probes: dict[str, str]) -> Column:
    """Names whose keyword stands in the text while no field of that name was captured."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}") & F.coalesce(F.try_element_at(fields, F.lit(n)) == "", F.lit(True)), F.lit(n)) for n, p in probes.items())))


def missed_numbers(line: Column, captured: Column) -> Column:
    """Numbers of the line that no captured value holds."""
    number = F.lit(r"\d+(?:\.\d+)?")
    return F.array_except(F.regexp_extract_all(line, number, F.lit(0)), F.flatten(F.transform(captured, lambda v: F.regexp_extract_all(v, number, F.lit(0)))))


def without_gloss(text: Column, operation: Column) -> Column:
    """Parentheses that say the operation again go."""
    return F.trim(F.regexp_replace(text, F.concat(F.lit(r"(?i)\s*\(\s*\Q"), operation, F.lit(r"\E[^)]*\)")), F.lit("")))
