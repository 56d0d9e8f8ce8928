"""Postings of a text field, kept between queries: BM25 reads the rows of a request's terms, no texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.search import K1, B

WIDE = 32  # terms that have a column each; requests of more go by the postings' rows


@dataclass
class Postings:
    """Postings (term, id, tf, size), and the documents (id, size) that have tokens; size is a document's tokens.

    Where texts are not cut yet, `counts` gives (id, size, tf0, tf1, ...) for a request's terms, from one cutting of each
    text: a document's rows add up, and one without tokens may have a row of size 0 or null.
    """

    table: DataFrame
    docs: DataFrame
    counts: Callable[[list[str]], DataFrame] | None = None

    def save(self, path: str) -> Postings:
        """Write both, and give them as read again. Files are sorted by term, so a scan skips other terms' row groups.

        Ranges are of (term, id), so a term that most documents hold is spread over as many tasks as its postings fill."""
        self.table.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/postings")
        self.docs.write.parquet(f"{path}/docs")
        return load(self.table.sparkSession, path)


def load(spark: SparkSession, path: str) -> Postings:
    return Postings(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"))


def build(df: DataFrame, tokens: Column, id_col: str = "_id") -> Postings:
    """Postings of df's rows, whose ids are unique; rows without an id or tokens have none.

    A text is cut into tokens once for each pass over the table or the documents: rows without tokens are left out by
    generators, since a filter on their tokens would be moved below and make them again, and a join by id would be moved
    below and shuffle them. Equal tokens of a document are counted before any shuffle; nothing is ranged until saved.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), tokens.alias("_t"))
    each = rows.select("id", F.size("_t").alias("size"), F.explode_outer("_t").alias("term")).where(F.col("term").isNotNull())
    table = each.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"), F.first("size").alias("size"))
    sized = F.filter(F.array(F.struct("id", F.size("_t").alias("size"))), lambda d: d["size"] > 0)


    def counts(terms: list[str]) -> DataFrame:
        tf = [F.when(F.array_contains("_t", t), F.size("_t") - F.size(F.array_remove("_t", t))).otherwise(0).cast("long") for t in terms]
        return rows.select("id", F.size("_t").cast("long").alias("size"), *[c.alias(f"tf{i}") for i, c in enumerate(tf)])

    return Postings(table, rows.select(F.inline(sized)), counts)


def _counts(p: Postings, terms: list[str]) -> DataFrame:
    """p.counts, of saved postings by the rows of the terms and the documents' sizes."""
    if p.counts:
        return p.counts(terms)
    none = F.lit(0).cast("long")
    sizes = p.docs.select("id", F.col("size").cast("long").alias("size"), *[none.alias(f"tf{i}") for i in range(len(terms))])
    tf = [F.when(F.col("term") == t, F.col("tf")).otherwise(0).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)]
    return sizes.unionByName(p.table.where(F.col("term").isin(*terms)).select("id", none.alias("size"), *tf))


def _replaced(base: DataFrame, new: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Counts of base after a batch, by one shuffle of ids and numbers: no side is made twice, as a join by new's ids would."""
    names = [c for c in base.columns if c != "id"]
    side = lambda d, mark: d.select("id", *[F.col(c).alias(f"{mark}{c}") for c in names])
    rows = side(base, "_b_").unionByName(side(new, "_n_"), allowMissingColumns=True)
    rows = rows.withColumn("_gone", F.lit(None).cast("boolean")) if gone is None else rows.unionByName(gone.select("id", F.lit(True).alias("_gone")), allowMissingColumns=True)
    each = rows.groupBy("id").agg(F.max("_gone").alias("_gone"), *[F.sum(f"{m}{c}").alias(f"{m}{c}") for m in ("_b_", "_n_") for c in names])
    return each.select("id", *[F.when(F.col("_n_size") > 0, F.col(f"_n_{c}")).when(F.col("_gone").isNull(), F.col(f"_b_{c}")).alias(c) for c in names])


def apply(base: Postings, new: Postings, gone: DataFrame | None = None) -> Postings:
    """base after a batch: new documents replace those of equal id, and the ids of gone leave."""
    ids = new.docs.select("id") if gone is None else new.docs.select("id").unionByName(gone.select("id"))
    keep = lambda d: d.join(ids, "id", "left_anti").select(d.columns)
    out = Postings(keep(base.table).unionByName(new.table), keep(base.docs).unionByName(new.docs))
    kinds = {d.schema["id"].dataType for d in (base.docs, new.docs, *([] if gone is None else [gone]))}
    if (base.counts or new.counts) and len(kinds) == 1:  # ids of several types are equal as a join says
        out.counts = lambda terms: _replaced(_counts(base, terms), _counts(new, terms), gone)
    return out


def _counted(p: Postings, weights: dict[str, float], least: int) -> DataFrame:
    """bm25 by p.counts: the corpus's statistics and the hits read the same shuffle of a row of numbers for each document,
    below which no filter is moved, so no text is cut again."""
    terms = sorted(weights)
    tfs = [f"tf{i}" for i in range(len(terms))]
    each = _counts(p, terms).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("size", *tfs)]).where("size > 0")
    stats = each.agg(F.count("*").alias("_docs"), F.sum("size").alias("_total"), *[F.count(F.when(F.col(c) > 0, 1)).alias(f"_d_{c}") for c in tfs])
    held = reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("int") for c in tfs], F.lit(0))
    norm = K1 * (1 - B + B * F.col("size") / (F.col("_total") / F.col("_docs")))
    parts = [F.lit(float(weights[t])) * F.log(1 + (F.col("_docs") - F.col(f"_d_{c}") + 0.5) / (F.col(f"_d_{c}") + 0.5)) * F.col(c) / (F.col(c) + norm) for t, c in zip(terms, tfs, strict=True)]
    return each.where(held >= max(1, least)).crossJoin(F.broadcast(stats)).select("id", reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("_score"))


def bm25(p: Postings, weights: dict[str, float], least: int = 1) -> DataFrame:
    """(id, _score) of the documents that hold at least `least` of the weighted terms.

    Of the corpus only a count and a sum go to the driver, and a row for each term of the request to the tasks; where texts
    are not cut yet, a row of statistics goes to the tasks.
    """
    if p.counts and len(weights) <= WIDE:
        return _counted(p, weights, least)
    s = p.docs.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    n, mean = s["n"], (s["total"] or 0) / max(1, s["n"])
    hits = p.table.where(F.col("term").isin(*sorted(weights)))
    found = hits.groupBy("term").agg(F.count("*").alias("_d"))
    weight = F.element_at(F.create_map(*[F.lit(x) for t, w in sorted(weights.items()) for x in (t, float(w))]), F.col("term"))
    idf = found.select("term", (weight * F.log(1 + (n - F.col("_d") + 0.5) / (F.col("_d") + 0.5))).alias("_w"))
    tf = F.col("tf").cast("double")
    part = F.col("_w") * tf / (tf + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    scored = hits.join(F.broadcast(idf), "term").groupBy("id").agg(F.sum(part).alias("_score"), F.count("*").alias("_n"))
    return scored.where(F.col("_n") >= least).select("id", "_score")


def top(p: Postings, weights: dict[str, float], size: int = 10, start: int = 0, least: int = 1) -> DataFrame:
    """A page of the best documents, ties by id."""
    return bm25(p, weights, least).orderBy(F.desc("_score"), "id").offset(start).limit(size)
