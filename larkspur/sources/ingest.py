"""Mutations: bulk parsing, compaction, upserts, deletes; a versioned table on Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MUTATION = "seq long, op string, _id string, doc string"


def parse_bulk(lines) -> list[tuple[int, str, str | None, str | None]]:
    """(seq, op, _id, doc) of alternating action and document lines; a delete has no document; broken lines are skipped."""
    out: list = []
    action: tuple[str, str | None] | None = None
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            v = json.loads(line)
        except ValueError:
            continue
        if action:
            op, key = action
            out.append((len(out), "upsert" if key is not None else "insert", key or uuid.uuid4().hex, json.dumps(v)))
            action = None
            continue
        op = next((k for k in ("index", "create", "update", "delete") if isinstance(v, dict) and isinstance(v.get(k), dict)), None)
        if op is None:
            continue
        key = v[op].get("_id")
        key = None if key is None else str(key)
        if op == "delete":
            out.append((len(out), "delete", key, None))
        else:
            action = (op, key)
    return out


def mutations(spark: SparkSession, path: str) -> DataFrame:
    """Bulk files as mutations; a file is parsed by one task, since its lines pair up, and files in parallel."""

    def run(it):
        import pandas as pd

        for pdf in it:
            for p, text in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(p, *r) for r in parse_bulk(bytes(text).decode(errors="replace").split("\n"))]
                yield pd.DataFrame(rows, columns=["path", "seq", "op", "_id", "doc"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, " + MUTATION)


def compact(log: DataFrame, id_col: str = "_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """The effect of a log by id: last data, and an operation from the first and last action.

    insert..delete within a log cancels out; delete..insert and delete..update are updates; otherwise
    the last action counts, an update after an insert staying an insert. One aggregation, no sort.
    """
    data = [c for c in log.columns if c not in (id_col, seq, op)]
    g = log.groupBy(id_col).agg(F.min_by(op, seq).alias("_first"), F.max_by(op, seq).alias("_last"), F.max(seq).alias(seq), F.max_by(F.struct(*[F.col(c) for c in data]), seq).alias("_d") if data else F.lit(None).alias("_d"))
    first, last = F.col("_first"), F.col("_last")
    final = (
        F.when((first == "insert") & (last == "delete"), None).when(last.isin("delete", "delete_vec_only"), last)
        .when(first == "insert", "insert").otherwise("update")
    )
    return g.withColumn(op, final).where(F.col(op).isNotNull()).select(id_col, seq, op, *[F.col(f"_d.{c}").alias(c) for c in data])


def deletes_first(log: DataFrame, request: str | None = None) -> DataFrame:
    """The order of requests without a write-ahead log: all deletes of a request before all its upserts.

    seq stays a key to order by and need not be dense: deletes keep theirs, everything else moves behind the
    greatest. Within a request (its column, by default the whole log) no sort is needed, only that maximum.
    """
    if request:
        top = log.groupBy(request).agg((F.max("seq") + 1).alias("_top"))
        out = log.join(top, request)
    else:
        out = log.crossJoin(F.broadcast(log.agg((F.max("seq") + 1).alias("_top"))))  # one row
    return out.withColumn("seq", F.when(F.col("op") == "delete", F.col("seq")).otherwise(F.col("seq") + F.col("_top"))).drop("_top")


def records(docs: DataFrame, id_col: str = "_id") -> DataFrame:
    """Documents as mutations (op, _id, doc): an upsert where there is an id, else an insert under a new one."""
    key = F.col(id_col).cast("string") if id_col in docs.columns else F.lit(None).cast("string")
    body = [c for c in docs.columns if c != id_col]
    return docs.select(F.when(key.isNotNull(), "upsert").otherwise("insert").alias("op"), F.coalesce(key, F.uuid()).alias("_id"), F.to_json(F.struct(*body)).alias("doc"))


def bulk_v2(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """A request {"index": ..., "records": [...]}: the index it names, and its records as mutations."""
    d = spark.read.option("multiLine", True).json(path)
    return d.first()["index"], records(d.select(F.explode("records").alias("r")).select("r.*"))


def multi(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, as mutations."""
    return records(spark.read.json(path))


def bulk_response(log: DataFrame, index: str, before: DataFrame | None = None, id_col: str = "_id") -> DataFrame:
    """An item for each mutation of a request: seq, action, _index, _id, status, result, _version."""
    done = log.select("seq", "op", F.col("_id"))
    known = before.select(F.col(id_col).cast("string").alias("_id"), F.lit(True).alias("_known")).distinct() if before is not None else None
    done = done.join(known, "_id", "left") if known is not None else done.withColumn("_known", F.lit(None).cast("boolean"))
    gone = F.col("op") == "delete"
    return done.select(
        "seq", F.when(gone, "delete").otherwise("index").alias("action"), F.lit(index).alias("_index"), "_id", F.when(gone, 200).otherwise(201).alias("status"),
        F.when(gone, "deleted").when(F.col("_known"), "updated").otherwise("created").alias("result"), F.lit(1).cast("long").alias("_version"))


class Missing(LookupError):
    """No document has this id."""


def update(base: DataFrame, change: DataFrame, insert: bool = False, id_col: str = "_id") -> DataFrame:
    """base with whole documents replaced; ids that base lacks are an error unless insert is set."""
    if not insert:
        lost = change.select(id_col).join(base.select(id_col), id_col, "left_anti").limit(1).collect()
        if lost:
            raise Missing(lost[0][0])
    return upsert(base, change, id_col)


def delete_one(base: DataFrame, key, id_col: str = "_id") -> DataFrame:
    """base without a document, which must be there."""
    if base.where(F.col(id_col) == F.lit(key)).limit(1).count() == 0:
        raise Missing(key)
    return base.where(~F.coalesce(F.col(id_col) == F.lit(key), F.lit(False)))


# -- placement of documents ----------------------------------------------------------------------------------


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a document's id by the highest random weight: few ids move when a shard comes or goes."""
    weights = [F.struct(F.md5(F.concat(key.cast("string"), F.lit(f"#{i}")).cast("binary")).alias("w"), F.lit(i).alias("i")) for i in range(shards)]
    return F.greatest(*weights)["i"] if shards > 1 else F.lit(0)


def partial_scan(df: DataFrame, shard: int, shards: int, id_col: str = "_id") -> DataFrame:
    """The documents of one shard."""
    return df.where(shard_of(F.col(id_col), shards) == shard)


def upsert(base: DataFrame, changes: DataFrame, id_col: str = "_id") -> DataFrame:
    """base with the rows of changes replacing or joining those of equal id."""
    return base.join(changes.select(id_col), id_col, "left_anti").unionByName(changes.select(*base.columns))


def delete(base: DataFrame, ids: DataFrame, id_col: str = "_id") -> DataFrame:
    return base.join(ids.select(id_col), id_col, "left_anti")


def apply_log(base: DataFrame, log: DataFrame, id_col: str = "_id", op: str = "op") -> DataFrame:
    """base after a compacted log (op, id and base's columns)."""
    gone = log.select(id_col).distinct()
    kept = log.where(F.col(op).isin("insert", "update", "upsert")).select(*base.columns)
    return base.join(gone, id_col, "left_anti").unionByName(kept)


def delete_by_query(base: DataFrame, pred: Column, id_col: str = "_id", size: int | None = 10, order: list | None = None) -> DataFrame:
    """base without the first `size` hits of a query in order; size None deletes all hits."""
    hits = base.where(pred)
    if size is None:
        return base.where(~F.coalesce(pred, F.lit(False)))
    return base.join(hits.orderBy(*(order or [id_col])).limit(size).select(id_col), id_col, "left_anti")


DELTAS = 16  # changes kept beside a table before it is written anew


class Table:
    """A directory of versions. A write makes a new one and then its commit file, which is created or fails as a whole.

    A version is a base and the changes after it, a folder each, which its commit file names in order: applying a log
    writes that log alone, until there are DELTAS of them. The last commit counts, so that a crash at any point leaves
    the table as it was; of two writers that began from one version, the second to commit gets FileExistsError.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._p = jvm.org.apache.hadoop.fs.Path
        self.fs = self._p(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        p = self._p(f"{self.path}/commits")
        names = [f.getPath().getName() for f in self.fs.listStatus(p)] if self.fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=None)

    def _parts(self, n: int | None) -> list[tuple[str, str]]:
        """The folders of a version: its base, then its changes with the name of their id column."""
        lines = sorted(r[0] for r in self.spark.read.text(f"{self.path}/commits/{n}").collect())  # DELTAS + 1 at most
        return [(name, key) for _, name, key in (line.split(" ", 2) for line in lines)]

    def read(self) -> DataFrame:
        (base, _), *changes = self._parts(self.version())
        out = self.spark.read.parquet(f"{self.path}/{base}")
        if not changes:
            return out
        key, log = changes[0][1], None
        for i, (name, _) in enumerate(changes):
            d = self.spark.read.parquet(f"{self.path}/{name}").withColumn("_at", F.lit(i))
            log = d if log is None else log.unionByName(d)
        data = [c for c in log.columns if c not in (key, "_at")]
        last = log.groupBy(key).agg(F.max_by(F.struct(*data), "_at").alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in data])
        return apply_log(out, last, key, "_op")

    def _commit(self, df: DataFrame, before: list[tuple[str, str]], key: str, after: int | None) -> int:
        v, n = f"v-{uuid.uuid4().hex}", 0 if after is None else after + 1
        df.write.parquet(f"{self.path}/{v}")
        try:
            s = self.fs.create(self._p(f"{self.path}/commits/{n}"), False)
        except Exception as e:
            self.fs.delete(self._p(f"{self.path}/{v}"), True)
            raise FileExistsError(f"version {n} exists") from e
        s.write(bytearray("\n".join(f"{i:04d} {name} {k}" for i, (name, k) in enumerate([*before, (v, key)])).encode()))
        s.close()
        return n

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """Write the next version whole, by default after the last; returns its number."""
        return self._commit(df, [], "", self.version() if after is None else after)

    def refresh(self) -> DataFrame:
        """The table as it is now, whatever the session has cached of its files."""
        self.spark.catalog.refreshByPath(self.path)
        return self.read()

    def vacuum(self, keep: int = 2) -> None:
        """Delete the files that only versions before the last `keep` use; their commits stay as numbers taken."""
        last = self.version() or 0
        kept = {name for n in range(max(0, last - keep + 1), last + 1) for name, _ in self._parts(n)}
        for n in range(max(0, last - keep + 1)):
            for name, _ in self._parts(n):
                if name not in kept:
                    self.fs.delete(self._p(f"{self.path}/{name}"), True)

    def apply(self, log: DataFrame, id_col: str = "_id", after: int | None = None) -> int:
        """The table after a compacted log (op, id and the table's columns), as a new version."""
        after = self.version() if after is None else after
        parts = self._parts(after)
        if len(parts) > DELTAS or any(k != id_col for _, k in parts[1:]):
            return self.write(apply_log(self.read(), log, id_col), after)
        columns = self.spark.read.parquet(f"{self.path}/{parts[0][0]}").columns
        return self._commit(log.select(F.col("op").alias("_op"), *columns), parts, id_col, after)
