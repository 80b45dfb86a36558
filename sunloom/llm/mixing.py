"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

All documents of a source expect the same number of copies, target / size of
the source, so the expected copies before a document are its place in the
source's order times that number.  Places come from a two-level prefix sum:
counts per (source, stratum, bucket), a running sum over those few rows, and a
row number inside each bucket.  Strata are narrow size classes, so systematic sampling
spreads the copies evenly over short and long documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import saved

#: Buckets of each source and size class: md5 prefixes of so many hexadecimal digits.
HEX = 3
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> adds target: weighted shares of share * all sizes, none above most * its own size.

    Resharing the excess by weight until nothing is above its limit ends where every source has
    min(most * size, level * weight); the level follows from one pass over the sources in the order of limit / weight.
    One row per source comes in (a few, whatever the documents), so the unpartitioned windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    limits = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    full = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("w").over(rest)
    solved = limits.withColumn("level", level).withColumn("ratio", F.col("cap") / F.col("w")).withColumn("place", F.row_number().over(by))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("place"), F.col("level")))).over(every)
    return solved.select("source", "source_size", F.least("cap", F.coalesce(first["level"], F.lit(float("inf"))) * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, keep_columns: bool = False) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, copies and taken (= copies * size).

    size counts the runs of characters other than space and \\x09-\\x0D; null text has 0.  A null source is a source of
    its own, last in the order.  A document is emitted `copies` times: the integer boundaries between u + r * place and
    u + r * (place + 1), with r = target / source_size <= most and one u in [0, 1) per source and seed.  Places follow
    size class, md5 bucket of id and text, size, id and text's md5, so reruns agree; rows equal in all of these share
    out their copies in any order.  Sources of size 0 have target 0 and no copies.  keep_columns adds all columns of
    docs (ours come as _size, _source_size, _target, _copies, _taken then).
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    base = docs.select(
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if keep_columns else []), F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("_size"), digest.alias("_md5"),
    )
    bits = F.length(F.bin("_size")).cast("int")
    # A size class is a size's bit length and its nine leading bits, so the documents that a copy more or less goes to
    # in turn are of about one size.
    base = base.withColumn("_class", bits * 512 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 9, 0))").cast("int")).withColumn("_bucket", F.substring("_md5", 1, HEX))
    if not keep_columns:
        base = saved(base)  # slim rows: the texts are gone through once
    counted = base.groupBy("source", "_class", "_bucket").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    counted = saved(counted)
    sizes = counted.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    run = Window.partitionBy("source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("_s"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"), "_before", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_rate"))
    starts = starts.withColumn("_u", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_s", F.lit("\x01null"))).cast("binary")), 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24)))
    inside = Window.partitionBy("source", "_class", "_bucket").orderBy("_size", "_id", "_md5")
    placed = base.withColumn("_k", F.row_number().over(inside).cast("long") - 1)
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
    place = F.col("_before") + F.col("_k")
    copies = (F.floor((place + 1) * F.col("_rate") + F.col("_u")) - F.floor(place * F.col("_rate") + F.col("_u"))).cast("long")
    copies = F.least(copies, F.lit(int(most)))
    if keep_columns:
        return joined.select("_row.*", "_size", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), copies.alias("_copies"), (copies * F.col("_size")).alias("_taken"))
    return joined.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def emit_copies(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """docs with each row as many times as mix_sources gives it copies; the columns of docs, nothing else."""
    mixed = mix_sources(docs, seed=seed, keep_columns=True, **options)
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
