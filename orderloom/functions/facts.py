"""Facts of items and context of orders as texts KEY=VALUE, without what says nothing about the construction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that make a fact noise, and an order's columns that are its context
NOISE = ["admin", "additional", "co number", "customer", "document", "inquiry", "job number", "mark", "note", "rep reference", "review", "ship", "shipping", "ship to", "source", "warranty"]
CONTEXT = ["arrangement", "so_design_desc", "so_size", "so_arrangement", "so_motor_pos", "so_class", "so_rotation"]


def fact_text(value: Column) -> Column:
    """Upper case, blanks as one; null is empty."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(value.cast("string"), F.lit(""))), r"\s+", " "))


def noise(key: Column, value: Column) -> Column:
    """Whether a fact's key and value have one of the words of NOISE in them."""
    both = F.lower(F.concat(key, F.lit("="), fact_text(value)))
    return both.rlike("|".join(NOISE))


def item_facts(section: Column, document_fact: Column, attributes: Column) -> Column:
    """An item's section and attributes (a map) as KEY=VALUE; none for an item whose section or document fact is noise."""
    pairs = F.filter(F.transform(F.map_entries(attributes), lambda e: F.struct(fact_text(e["key"]).alias("k"), fact_text(e["value"]).alias("v"))), lambda e: (e["k"] != "") & (e["v"] != "") & ~noise(e["k"], e["v"]))
    own = F.coalesce(F.transform(pairs, lambda e: F.concat(e["k"], F.lit("="), e["v"])), F.array().cast("array<string>"))
    head = F.when(fact_text(section) != "", F.array(F.concat(F.lit("section="), fact_text(section)))).otherwise(F.array().cast("array<string>"))
    drop = noise(F.lit("section"), section) | ((fact_text(document_fact) != "") & noise(F.lit("document_fact"), document_fact))
    return F.when(drop, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(head, own)))


def order_context(columns: Mapping[str, Column], parts_only: Column | None = None) -> Column:
    """An order's known columns of CONTEXT as key=VALUE, and that it is for parts only."""
    known = [F.when((fact_text(c) != "") & (F.lower(c.cast("string")) != "false") & ~noise(F.lit(k), c), F.concat(F.lit(f"{k}="), fact_text(c))) for k, c in columns.items() if k in CONTEXT]
    only = [F.when(parts_only, F.lit("parts_only=TRUE"))] if parts_only is not None else []
    return F.array_compact(F.array(*known, *only)) if known or only else F.array().cast("array<string>")
