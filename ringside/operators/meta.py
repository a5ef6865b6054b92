"""Published usage tables, the audit log and the knowledge text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.functions import fixed_values as fixed
from ringside.operators.record import top_n
from ringside.plans.scan import last_of, scan

# Labels of the published tables.
TOTAL_BATTLES = "Total battles:"
RAW_COUNT = "Raw count:"
SECTIONS = ["Abilities", "Items", "Spreads", "Moves", "Teammates"]


def text_lines(texts: DataFrame, keys) -> DataFrame:
    """(keys, line_no, line) of a text column."""
    return texts.select(*keys, F.posexplode(F.split("text", "\\r\\n|\\n|\\r")).alias("line_no", "line"))


def _cells():
    return F.transform(F.split("line", "[|]"), lambda x: F.trim(x))


def _number_after(label):
    """The whole number behind a label in the line."""
    rest = F.ltrim(F.substring_index("line", label, -1))
    digits = F.split(rest, "[^0-9]", 2)[0]
    return F.when(F.col("line").contains(label), digits.try_cast("bigint"))


def _share(cell):
    """12.5 of "12.5%"; NULL of anything else."""
    return F.when(cell.endswith("%"), F.rtrim(cell, F.lit("%")).try_cast("double"))


def usage_stats(texts: DataFrame, keys) -> DataFrame:
    """Species, percentage and total battles; a text that is not a table gives no rows."""
    lines = text_lines(texts, keys).withColumns({"battles": _number_after(TOTAL_BATTLES), "cells": _cells()})
    battles = lines.where("battles is not null").groupBy(*keys).agg(F.min_by("battles", "line_no").alias("total_battles"))
    cell = lambda i: F.get("cells", F.lit(i))
    # | rank | species | share% | ...
    table = F.col("line").startswith("|") & (F.size("cells") >= 5) & cell(1).try_cast("bigint").isNotNull() & (cell(2) != "") & _share(cell(3)).isNotNull()
    rows = lines.where(table).groupBy(*keys, cell(2).alias("species")).agg(F.max_by(_share(cell(3)), "line_no").alias("pct"))
    return rows.join(battles, keys, "left")


def moveset_stats(texts: DataFrame, keys) -> DataFrame:
    """Long rows (species, raw_count, section, label, pct) of the block text.

    A block starts two lines above its raw count; a section runs from its
    first heading in the block to the next border.
    """
    lines = text_lines(texts, keys)
    cell = F.trim(F.trim(F.trim("line"), F.lit("|")))
    framed = F.rtrim("line")
    border = framed.startswith("+-") & framed.endswith("-+") & (F.replace(framed, F.lit("-"), F.lit("")) == "++")
    # The last word is the share, the words before it the label.
    last = F.substring_index(cell, " ", -1)
    lines = lines.withColumns({
        "cell": cell, "raw": _number_after(RAW_COUNT), "section": F.when(cell.isin(SECTIONS), cell), "border": border,
        "label": F.rtrim(F.substring(cell, F.lit(1), F.length(cell) - F.length(last))), "pct": F.when(F.col("line").startswith("|"), _share(last))})
    heads = lines.where("raw is not null").select(*keys, (F.col("line_no") - 2).alias("line_no"), F.col("raw").alias("_count"))
    lines = lines.join(heads, [*keys, "line_no"], "left")
    name = F.when(F.col("_count").isNotNull(), F.struct(F.col("line_no").alias("at"), F.col("cell").alias("species"), F.col("_count").alias("n")))
    opened = scan(lines, keys, "line_no", {
        "block": last_of(name),
        "head": last_of(F.when(F.col("section").isNotNull(), F.struct("line_no", "section"))),
        "fence": last_of(F.when(F.col("border"), F.col("line_no")))})
    # Only the first heading of a name in a block opens its section.
    first = opened.where("section is not null and block is not null").groupBy(*keys, F.col("block.at").alias("_at"), "section").agg(
        F.min("line_no").alias("_first"))
    rows = opened.where(
        (F.col("block.species") != "") & F.col("head").isNotNull() & (F.col("head.line_no") >= F.col("block.at"))
        & F.col("section").isNull() & ~F.coalesce(F.col("fence") > F.col("head.line_no"), F.lit(False)))
    rows = rows.where("pct is not null and label <> ''").select(
        *keys, F.col("block.at").alias("_at"), F.col("block.species").alias("species"), F.col("block.n").alias("raw_count"),
        F.col("head.section").alias("section"), F.col("head.line_no").alias("_first"),
        "label", "pct")
    return rows.join(first, [*keys, "_at", "section", "_first"], "left_semi").drop("_at", "_first")


def first_available(candidates: DataFrame, by) -> DataFrame:
    """Per group the newest of three months, best rating cutoff first, that has rows.

    `candidates` has months_back (0, 1, 2), cutoff and rows_found.
    """
    place = F
    for i, cutoff in enumerate(fixed.RATING_CUTOFFS):
        place = place.when(F.col("cutoff") == cutoff, i)
    usable = candidates.where((F.col("rows_found") > 0) & F.col("months_back").between(0, 2) & F.col("cutoff").isin(fixed.RATING_CUTOFFS))
    return top_n(usable, by, [F.col("months_back"), place], 1).drop("rank")


def missing_reference(names: DataFrame, dex: DataFrame) -> DataFrame:
    """Names that the reference lacks, or has without base stats."""
    known = dex.where(F.col("base_stats").isNotNull()).select("name")
    return names.select("name").distinct().join(known, "name", "left_anti")


def audit_counts(audit: DataFrame, time="created_at") -> DataFrame:
    """Events of the audit log by kind and day."""
    return audit.groupBy("event_type", F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def merge_meta(new: DataFrame, old: DataFrame, part="part") -> DataFrame:
    """New parts over old ones; a part the refresh left empty keeps its old rows."""
    return new.unionByName(old.join(new.select(part).distinct(), part, "left_anti"))


def meta_context(rules: DataFrame, worst: DataFrame, usage: DataFrame, by) -> DataFrame:
    """Lines of the knowledge text: rules and forbidden mechanics, worst matchups per player, the field's top ten.

    `rules` holds one row (format_name, active_per_side, bring_count, team_size, legal_mechanics);
    `worst` has rank, name, win_pct; `usage` has species and pct of the chosen table. Lines that
    hold for everyone have NULL in the player columns.
    """
    banned = F.transform(F.filter("legal_mechanics", lambda m: m.endswith("_no")),
                         lambda m: F.trim(F.replace(F.replace(m, F.lit("_no"), F.lit("")), F.lit("_"), F.lit(" "))))
    first = F.concat(F.lit("FORMAT: "), "format_name", F.lit(" - "), "active_per_side", F.lit(" active/side, bring "),
                     "bring_count", F.lit(" of "), "team_size", F.lit("."))
    nobody = [F.lit(None).cast(worst.schema[x].dataType).alias(x) for x in by]
    head = rules.select(*nobody, F.lit(1).alias("part"), F.concat_ws("\n", first, F.when(F.size(banned) > 0, F.concat(
        F.lit("ILLEGAL in this format (NEVER recommend): "), F.array_join(banned, ", "), F.lit(".")))).alias("line"))

    def told(order, text):
        items = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
        return F.array_join(F.transform(items, lambda x: x["t"]), ", ")

    # Six matchups per player and ten species of the field reach these lists.
    pairs = worst.groupBy(*by).agg(told(F.col("rank"), F.concat("name", F.lit(" "), "win_pct", F.lit("%"))).alias("_t"))
    pairs = pairs.select(*by, F.lit(2).alias("part"), F.concat(F.lit("Your worst matchups (your win% vs opponent Pokemon): "), "_t").alias("line"))
    best = usage.orderBy(F.col("pct").desc(), "species").limit(10)
    best = best.agg(told(-F.col("pct"), F.concat("species", F.lit(" "), "pct", F.lit("%"))).alias("_t"))
    field = best.select(*nobody, F.lit(3).alias("part"), F.concat(F.lit("FIELD-WIDE META: "), "_t").alias("line"))
    return head.unionByName(pairs).unionByName(field)
