"""Mixing sources to target weights: repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import WORD_RE, durable

WEIGHTS = (5.0, 2.0, 1.0)
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sums: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sums (source, source_size) plus target.

    Sources are ranked by code point, null last, and take the weights in turn; those without words get none.
    A target is its weight times a level, or most times its source's size where that is less. The level starts
    at the total over all weights; each round takes the stopped sources' targets off and shares the rest by
    the others' weights, until no source is above. Ranks are offsets of sorted partitions and a round is one
    aggregate, so that any number of sources will do and only single numbers reach the driver.
    """
    spark = sums.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    s = durable(sums.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("source", "source_size", F.monotonically_increasing_id().alias("_at")), "sources")
    part = F.shiftright("_at", 33)  # the partition's number; below it, the place within
    sizes = s.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))  # a row a partition
    before = sizes.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    s = durable(s.withColumn("_part", part).join(F.broadcast(before), "_part").select("source", "source_size", w.alias("_w")), "weights")
    some = s.where("source_size > 0")
    total, weight = (x or 0 for x in some.agg(F.sum("source_size"), F.sum("_w")).first())
    left, level = share * total, 0.0
    while weight:
        level = left / weight
        over = some.where(F.lit(level) * F.col("_w") > most * F.col("source_size"))
        stopped, gone = (x or 0 for x in over.agg(F.sum("source_size"), F.sum("_w")).first())
        rest, free = share * total - most * stopped, some.agg(F.sum("_w")).first()[0] - gone
        if rest == left and free == weight:
            break
        left, weight = rest, free
    capped = most * F.col("source_size")
    free_target = F.lit(left) * F.col("_w") / F.lit(weight) if weight else capped
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).when(F.lit(level) * F.col("_w") > capped, capped).otherwise(free_target).cast("double").alias("target"))


BROADCAST_SOURCES = 500_000  # sources sent to all tasks at most; beyond, documents and sources meet by shuffle


def with_rates(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (with `size` and `source`) plus source_size, target and rate of each row's source.

    Sizes are summed by partial aggregation. The table of sources goes to every task if it is small, and
    otherwise meets the documents by shuffle, dealt also by a salt, so that a hot source is many tasks' work.
    """
    sums = durable(docs.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")), "sums")
    t = durable(targets(sums, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("rate")), "targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if t.count() <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(t), same, "left").drop("_source")
    salted = t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = docs.withColumn("_s", (F.rand(SEED) * SALTS).cast("int"))
    return d.join(salted, same & (F.col("_s") == F.col("_salt")), "left").drop("_source", "_salt", "_s")


SALTS = 16


def copies(rate: Column, *key: Column) -> Column:
    """floor(rate) copies, and one more with probability of the fraction, decided by a hash of the key alone."""
    u = F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken of every document.

    Null text has size 0; null sources are a source of their own. Rows that repeat an id draw alike only if
    their texts are equal; null ids draw by their text. Texts of any length count whole; other columns are
    ignored. An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_h"))
    d = with_rates(durable(d, "sizes"), **how)
    d = d.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("_h")))
    return d.withColumn("taken", F.col("copies") * F.col("size")).drop("_h", "rate")


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs, whatever their names."""
    d = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    n = copies(F.col("rate"), F.col("row.doc_id"), F.xxhash64("row.text")).cast("int")
    m = with_rates(d, **how).withColumn("n", n).where("n > 0")
    return m.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
