"""Mix sources to target weights by capped water-filling.

Sources share the whole amount by weight. A source is clamped at ``max_epochs`` times its own size; what it cannot take is
redistributed to the others in proportion to their weights until no source is above its limit. A source whose target is
``r`` times its size gives every document ``floor(r)`` times, and the fractional rest as whole documents in seeded order.

The seeded order is cut at the target with prefix sums: hash buckets (about the square root of a source's rows), one
sum for each, and a window inside a bucket only, so a source with a third of all rows is spread like any other. Documents that
are large against the fractional part are drawn first and the rest fill up to the target, so the taken amount ends
within half of one ordinary document of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import null_safe_join

LARGE = 50  # a document above 1/50 of the fractional part of its source is drawn first


def water_fill(sizes: DataFrame, cycle: list[int], max_epochs: int) -> DataFrame:
    """(source, source_size, source_rows) plus ``target``. One row per source; windows run over this table of sources only."""
    ranked = sizes.withColumn("w", F.element_at(
        F.array(*[F.lit(float(x)) for x in cycle]),
        (F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(cycle))) + 1).cast("int")))
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(cap / F.col("w"), F.col("source").isNull(), "source")
    levels = (ranked.withColumn("cap", cap)
              .withColumn("left", F.sum("source_size").over(Window.partitionBy())
                          - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("fits", F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")))
    # The first source in this order that stays below its limit fixes the level for itself and all after it.
    level = F.first(F.when(F.col("fits"), F.struct("left", "w_left")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    return levels.withColumn("level", level).select(
        "source", "source_size", "source_rows",
        F.when(F.col("level").isNull(), F.col("cap").cast("double"))
        .otherwise(F.col("level.left") * F.col("w") / F.col("level.w_left")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size",
        cycle: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``times`` (how often the document is taken) and ``taken`` (words).

    ``size`` must not be null. A null source is a source of its own and comes last. Equal rows are separate documents; ties of
    the seeded hash are broken by id, size and, for equal rows, arbitrarily (they are interchangeable). An empty document is taken
    0 words; an empty table gives an empty result. Columns of the input named like an output column are replaced.
    """
    made = ("source_size", "target", "times", "taken")
    keep = [c for c in docs.columns if c not in made]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").alias("__source"), F.col(f"`{size}`").alias("__size"),
                       F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{doc_id}`").cast("string"))).alias("__h"))
    totals = rows.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    plan = water_fill(totals, list(cycle), max_epochs)
    plan = plan.withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("__part", F.col("target") - F.col("__whole") * F.col("source_size")).withColumnRenamed("source", "__source")
    rows = null_safe_join(rows, plan, ["__source"], "inner")
    rows = rows.withColumn("__large", F.col("__size") * LARGE > F.col("__part")).withColumn(
        "__b", F.floor(F.conv(F.substring("__h", 1, 8), 16, 10).cast("bigint") * F.ceil(F.sqrt("source_rows")) / float(1 << 32)))
    group, cell = ["__source", "__large"], ["__source", "__large", "__b"]
    cells = rows.groupBy(*cell).agg(F.sum("__size").alias("__s"), F.first("__part").alias("__part"),
                                    F.first("source_size").alias("__all"))
    cells = cells.withColumn("__off", F.coalesce(F.sum("__s").over(
        Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = cells.withColumn("__group", F.sum("__s").over(Window.partitionBy(*group)))
    inside = Window.partitionBy(*cell).orderBy("__h", F.col(f"`{doc_id}`"), "__size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    rows = null_safe_join(rows, cells.select(*cell, "__off", "__group"), cell, "inner").withColumn(
        "__mid", F.col("__before") + F.col("__off") + F.col("__size") / 2.0)
    # Large documents: their proportional share of the fractional part.
    share = F.col("__part") * F.col("__group") / F.col("source_size")
    rows = rows.withColumn("__pick", F.col("__large") & (F.col("__mid") <= share))
    drawn = rows.where("__pick").groupBy("__source").agg(F.sum("__size").alias("__drawn"))
    rows = null_safe_join(rows, drawn, ["__source"], "left")
    rest = ~F.col("__large") & (F.col("__mid") <= F.col("__part") - F.coalesce("__drawn", F.lit(0)))
    more = (F.col("__part") > 0) & (F.col("__pick") | rest)  # at the limit nothing more is taken, empty documents included
    times = (F.col("__whole") + more.cast("bigint")).cast("bigint")
    return rows.select(*[F.col(f"`{c}`") for c in keep], "source_size", "target", times.alias("times"),
                       (times * F.col("__size")).cast("bigint").alias("taken"))
