"""Mixing sources to target weights: capped water-filling. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: A source's rows fall into this many hash ranges, so that no window or join key holds a whole source.
RANGES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_src, source_size) with the column target added: a row a source, so the windows here are small.

    Sources by ascending max_epochs * size / weight are clamped as long as the level that the rest of the budget
    allows, (total - clamped) / (weights left), reaches their cap; the others get weight * level."""
    by_name = Window.orderBy("_src")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("_w", weight.cast("double")).withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
    before = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), "_src").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    rows = rows.withColumn(
        "_level",
        (F.sum("source_size").over(total).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))),
    )
    level = F.max("_level").over(total)  # it rises up to the first source that is not clamped, and falls after it
    return rows.withColumn("target", F.least(F.col("_cap"), level * F.col("_w"))).select("_src", "source_size", "target")


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The carried columns of docs (a struct, _row), size (words), source_size, target (of its source) and taken.

    A source's whole epochs take every document; the fraction left takes documents in the order of a seeded hash of
    doc_id until the target is met, the last of them in part, so that a source's taken words are its target to
    within one word and no document gives more than max_epochs times its size. Null or blank text: size 0, taken 0.
    A null source is a source of its own, last. Null or repeated doc_ids hash alike and are taken one after the
    other. No rows give no rows. Other columns of docs play no part, whatever their names."""
    carry = ["doc_id"] if carry is None else carry
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")).alias("_src"),
        words(F.col("text")).alias("size"),
        key.alias("_key"),
        (F.conv(F.substring(key, 1, 3), 16, 10).cast("int") % RANGES).alias("_range"),
    )
    ranges = common.stash(rows.groupBy("_src", "_range").agg(F.sum("size").alias("_range_size")), "mixing-ranges", small=True)
    plan = targets(ranges.groupBy("_src").agg(F.sum("_range_size").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_range_size").over(earlier), F.lit(0))).join(plan, "_src")
    ranges = common.stash(ranges.select("_src", "_range", "_before", "source_size", "target"), "mixing-plan", small=True)
    within = Window.partitionBy("_src", "_range").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    size, source_size = F.col("size"), F.col("source_size")
    quota = F.round("target").cast("long")
    whole = F.when(source_size > 0, F.floor(quota / source_size)).otherwise(0).cast("long")
    left = quota - whole * source_size - F.col("_before") - F.col("_within")
    return (
        rows.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(ranges, ["_src", "_range"])
        .withColumn("taken", whole * size + F.greatest(F.lit(0), F.least(size, left)))
        .select("_row", "size", "source_size", "target", "taken")
    )


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixture as documents: a row for each whole repetition and one with a part: its text up to the
    last word taken, as it stands."""
    size, taken = F.col("size"), F.col("taken")
    copies = F.when(size > 0, F.ceil(taken / size)).otherwise(0).cast("int")
    rows = mixed.where(taken > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    kept = F.least(size, taken - (F.col("_copy") - 1) * size)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(rf"[\x20\x09-\x0D]*{common.WORD_PATTERN}"), F.lit(0)), 1, F.greatest(kept, F.lit(1)).cast("int")), "")
    text = F.when(kept < size, part).otherwise(F.col("_row.text"))
    return rows.select(*[(text if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in columns])
