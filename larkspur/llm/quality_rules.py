"""Quality rules: text statistics, and a hashed n-gram likelihood ratio of trusted target to raw corpus. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD_RE, durable

BUCKETS = 1 << 14
SMOOTH = 1.0  # added to each bucket's count in both models
THRESHOLD = -0.06  # nats per n-gram; documents below it go


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _shift(a: str, n: int, op: str) -> str:
    """op over the pairs (x_i, x_{i+n})."""
    return f"zip_with(slice({a}, 1, greatest(size({a}) - {n}, 0)), slice({a}, {n} + 1, greatest(size({a}) - {n}, 0)), (x, y) -> {op})"


def with_hashes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus _w, the words, _h, their hashes, and _2, the hashes of adjacent pairs: the n-grams are _h and _2.

    Each is a column of its own, so that what is used more than once is computed once.
    """
    d = docs.withColumn("_w", words_of(F.col(text_col).cast("string")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    return d.withColumn("_2", F.expr(_shift("_h", 1, "xxhash64(x, y)")))


def bucket(gram: str) -> str:
    return f"cast(pmod({gram}, {BUCKETS}) as int)"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus _h, _2, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Pair hashes are combined by two more shifted passes into hashes of 8-word windows. Only where some
    window hash repeats are (hash, position) pairs sorted, and the words under repeated windows counted
    as the union of their intervals. No row is exploded or shuffled.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = with_hashes(docs, text_col).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.coalesce(F.char_length(F.array_join("_w", "")), F.lit(0)).cast("long")).drop("_w")
    d = d.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD_RE)))
    d = d.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l", text_col)
    d = d.withColumn("_8", F.expr(_shift("_2", 2, "xxhash64(x, y)"))).withColumn("_8", F.expr(_shift("_8", 4, "xxhash64(x, y)")))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_8")) < F.size("_8"), F.expr("array_sort(transform(_8, (h, i) -> struct(h as h, i as i)))"))).drop("_8")
    near = "(k > 0 and _s[k - 1].h = x.h) or (k + 1 < size(_s) and _s[k + 1].h = x.h)"
    d = d.withColumn("_p", F.expr(f"array_sort(transform(filter(_s, (x, k) -> {near}), x -> x.i))")).drop("_s")
    covered = "aggregate(_p, struct(0L as n, -8 as last), (a, p) -> struct(a.n + least(8, p - a.last) as n, p as last), a -> a.n)"
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0)).cast("long")).drop("_p")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: `ratios`, BUCKETS log likelihood ratios of the trusted target to the raw corpus.

    trusted lists ids (column id_col). Every document counts in the raw multinomial, every trusted one in the
    target; a partial aggregate leaves at most BUCKETS rows a task. Without any trusted text all ratios are 0.
    """
    t = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_t", F.lit(1))
    # only ids are joined; texts never leave their partition when the ids fit a broadcast
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_x")).join(_sized(t), "_id", "left")
    g = with_hashes(d, "_x").select(F.explode(F.concat("_h", "_2")).alias("g"), F.coalesce("_t", F.lit(0)).alias("t"))
    c = g.groupBy(F.expr(bucket("g")).alias("g")).agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("g"))
    c = durable(every.join(c, "g", "left").select("g", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")), "grams")
    n_raw, n_target = c.agg(F.sum("raw")).scalar(), c.agg(F.sum("target")).scalar()
    r = c.select(
        "g", F.when(n_target == 0, 0.0).otherwise(
            F.log((F.col("target") + SMOOTH) / (n_target + SMOOTH * BUCKETS)) - F.log((F.col("raw") + SMOOTH) / (n_raw + SMOOTH * BUCKETS))).alias("r"))
    return r.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "r"))), lambda x: x["r"]).alias("ratios"))


def _sized(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """ids for a broadcast if they are few enough, else for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the statistics, base_failed, llr, kept of every document.

    llr is the mean log ratio over a document's n-grams (0 without any). base_failed: fewer than 20 words,
    or over 30 % of words in repeated windows. kept: not base_failed and llr >= threshold, so a tie stays. Null
    text counts as empty; null ids and repeated rows are judged like others, and count in the corpus as often as
    they come. Texts of any length are counted whole. Other columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    ratios = log_ratios(docs, trusted, id_col, text_col)
    d = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    d = d.withColumn("ratios", ratios.scalar())  # BUCKETS doubles, a scalar subquery
    d = d.withColumn("llr", F.expr(f"case when n_words = 0 then 0D else aggregate(_2, aggregate(_h, 0D, (a, g) -> a + ratios[{bucket('g')}]), (a, g) -> a + ratios[{bucket('g')}]) / (size(_h) + size(_2)) end"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr", (~failed & (F.col("llr") >= threshold)).alias("kept"))
