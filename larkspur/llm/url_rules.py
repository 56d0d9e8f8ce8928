"""URL filters: a sort-merge sweep of nested rule intervals over reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import durable

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UP, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = 100_000  # pages of a range, about


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, UP, DOWN)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if null or without ://."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at == 0, F.lit("")).otherwise(F.substr(rest, at))


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at == 0, F.lit("")).otherwise(F.substr(url, at + F.lit(3)))


def key_of(labels: Column, path: Column) -> Column:
    """The canonical key: labels from the last on, each closed by FE, then FF and the path, in bytes.

    Neither byte comes in UTF-8, so keys sort by label and then by path, no text can imitate a boundary, and the
    keys that begin with a rule's are one interval: from the rule's key to it and FF.
    """
    label = F.lit(b"\xfe")
    host = F.aggregate(labels, F.lit(b""), lambda a, x: F.concat(a, x.cast("binary"), label))
    return F.concat(host, F.lit(b"\xff"), path.cast("binary"))


def labels_of(host: Column) -> Column:
    """A host's labels, the last first."""
    return F.reverse(F.split(host, r"\."))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    Rules (host, path, verdict): a rule fits its host and every subdomain if the path starts with the
    rule's; of those that fit, the longest host wins, then the longest path. Rules repeated with different
    verdicts: block wins. Null urls, and rows without a host, have no rule; null ids and repeated rows are
    judged like others, whole urls of any length. Other columns, whatever their names, are ignored. An empty
    table gives no rows.

    1. A rule is an interval of keys and gives two events: it is pushed at its start and popped at its end.
       A url is a probe for every suffix of its host (as many as it has labels), since a rule of that suffix
       is an interval around the suffix's key alone.
    2. Events and probes are sorted together into key ranges of about ROWS, a hot host's by page too. A range
       begins with the stack that holds at its first key: the rules whose keys are prefixes of that key, found
       by an equi-join on its prefixes.
    3. The sweep keeps the stack by its depth: pushes less pops so far. The rule on top is the last one pushed
       to that depth. Of a url's probes, the longest suffix with a rule on its stack decides.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    r = rules.where("host is not null and path is not null").select(F.translate("host", UP, DOWN).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = durable(r.select(key_of(labels_of(F.col("host")), F.col("path")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), "verdict").alias("r")), "rules")

    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    p = durable(p.withColumn("row", F.monotonically_increasing_id()), "hosts")  # written once, so that a row's number stays
    labels = labels_of(F.col("host"))
    probes = p.where("host <> ''").select("row", "path", F.posexplode(F.transform(labels, lambda _, i: F.slice(labels, 1, i + 1))).alias("level", "part"))
    none = F.lit(None).cast(r.schema["r"].dataType).alias("r")
    stream = probes.select(key_of(F.col("part"), F.col("path")).alias("key"), F.lit(2).alias("kind"), "row", "level", none)
    push = r.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("level"), "r")
    pop = r.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("level"), none)
    stream = stream.unionByName(push).unionByName(pop)
    parts = max(1, min(20_000, -(-p.count() // ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the range is fixed by writing it down: a second run of the sampler could cut elsewhere
    stream = durable(stream.repartitionByRange(parts, "key", "kind", "row").withColumn("range", F.spark_partition_id()), "ranges")
    first = stream.groupBy("range").agg(F.min("key").alias("from"))
    longest = r.agg(F.max(F.octet_length("key"))).first()[0] or 0  # no longer prefix is a rule's key
    prefixes = first.select("range", "from", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.least(F.octet_length("from"), F.lit(max(1, longest)))), lambda n: n <= F.octet_length("from")), lambda n: F.substring("from", F.lit(1), n))).alias("key"))
    # rules pushed in this very range are not carried into it: of those with the first key itself, the push may be here
    here = stream.where("kind = 1").select("range", "key")
    carried = prefixes.join(r, "key").join(here, ["range", "key"], "left_anti").select("range", "key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("int").alias("level"), "r")
    stream = stream.unionByName(carried)
    order = [F.col("key"), F.col("kind"), F.col("row")]
    sweep = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = stream.withColumn("depth", F.sum(F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)).over(sweep))
    top = Window.partitionBy("range", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.withColumn("top", F.when(F.col("depth") > 0, F.last("r", ignorenulls=True).over(top))).where("kind = 2 and top is not null")
    best = found.groupBy("row").agg(F.max_by("top", "level").alias("fit"))
    return p.join(best, "row", "left").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
