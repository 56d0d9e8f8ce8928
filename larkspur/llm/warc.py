"""WARC archives of pages: writing, reading back, and assembling transactions."""

from __future__ import annotations

import base64
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.common import discard, durable, shared_dir

END = "\r\n\r\n"
FILE_BYTES = 64 << 20  # of an archive file before compression, on average; its reader holds a whole file
LARGE = 8  # pages of more than so many times the mean are written apart, so that no file has more than LARGE * FILE_BYTES
HEADERS = 2000  # bytes of a page's records beside its payload, about


def _uuid(kind: str, page: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), page.cast("string")).cast("binary"))
    part = [F.substring(h, *x) for x in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _record(lines: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to its closing line ends, which the writer puts between rows."""
    head = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"\r\n{k}: "), v) for k, v in lines if k != "?"]
    return F.concat(*head, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def _base32(it):
    """Adds the digest in base32 as the last column."""
    for b in it:
        b32 = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column("hex").to_pylist()], pa.string())
        yield pa.record_batch([*b.columns, b32], names=[*b.schema.names, "sha1"])


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, gzip: bool = True) -> None:
    """Write request, response or revisit, and metadata records of pages (page_id, url, html) under path.

    Null html is an empty payload, a null url an empty one; line breaks in a url become %0D and %0A. Of
    pages whose payloads of at least min_payload bytes are equal, the smallest page_id is the response and
    the others revisit it. A null id revisits too, but nothing refers to it: without an equal payload under
    an id it is a response, and its metadata name no page. Rows that repeat a page_id are one capture each;
    those whose payloads are equal too are numbered by url in their record ids. Payloads of any length are
    written whole; other columns are ignored. An empty table gives no file that holds a record.

    A file's records are counted so that its bytes are FILE_BYTES on average. Pages far above the mean are
    written by themselves, by their own mean, and so on: each time at most 1 / LARGE of the pages are left.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("url", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    p = p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("hex", F.sha1(F.col("html").cast("binary")))
    # digests first: the texts are shuffled once, with what they need beside them
    keys = durable(p.select("page_id", "bytes", "hex").distinct().mapInArrow(_base32, "page_id long, bytes long, hex string, sha1 string"), "digests")
    first = keys.where(F.col("bytes") >= min_payload).groupBy("hex", "bytes").agg(F.min("page_id").alias("first"))
    low, options = -1, {"lineSep": END, "compression": "gzip" if gzip else "none"}
    while low is not None:
        mean, most = p.where(F.col("bytes") > low).agg(F.avg("bytes"), F.max("bytes")).first()
        high = None if mean is None or most + HEADERS <= LARGE * (mean + HEADERS) else int(LARGE * (mean + HEADERS)) - HEADERS
        part = p.where((F.col("bytes") > low) & (F.col("bytes") <= high)) if high is not None else p.where(F.col("bytes") > low)
        pages_a_file = max(1, min(20_000, int(FILE_BYTES / ((mean or 0) + HEADERS))))
        _records(part, keys, first).write.mode("append").options(**options).option("maxRecordsPerFile", 3 * pages_a_file).text(path)  # three records a page
        low = high
    discard(keys)


def _records(p: DataFrame, keys: DataFrame, first: DataFrame) -> DataFrame:
    """The records of pages (page_id, url, html, bytes, hex): request, response or revisit, metadata of each in turn."""
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    p = p.select("*", key).join(keys.join(first, ["hex", "bytes"], "left").select(key, "hex", "sha1", "first"), ["key", "hex"])
    p = p.withColumn("n", F.row_number().over(Window.partitionBy("key", "hex").orderBy("url")))
    page = F.concat_ws("/", "page_id", "hex", F.when(F.col("n") > 1, F.col("n")).cast("string"))
    id_, ref = _uuid("response", page), _uuid("response", F.concat_ws("/", "first", "hex"))
    revisit = F.col("first").isNotNull() & F.coalesce(F.col("first") < F.col("page_id"), F.lit(True))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    date = F.lit("1970-01-01T00:00:00Z")
    after = F.regexp_extract("url", r"^[^:]*://([^/?#]*)(.*)$", 2)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    ask = F.concat(F.lit("GET "), F.when(F.startswith(after, F.lit("/")), after).otherwise(F.concat(F.lit("/"), after)), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[^:]*://([^/?#]*)(.*)$", 1), F.lit(END))
    base = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    full = F.concat(http, F.col("html"))
    response = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", id_), *base, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))], full)
    again = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", id_), *base, ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", ref), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http;msgtype=response"))], http)
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", page)), ("WARC-Concurrent-To", id_), *base, ("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    meta = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", page)), ("WARC-Concurrent-To", id_), *base, ("Content-Type", F.lit("application/warc-fields"))], F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")))
    return p.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), meta)).alias("value"))


def parse_records(data: bytes):
    """Yield (headers, block) of each record; a block's length is read from its header, never guessed from its text."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower().decode(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines)}
        at = end + 4 + int(head["content-length"])
        yield head, data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {end} is cut short")
        at += 4


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, uri string, payload_digest string, content_length long, http_head string, body binary, digest_ok boolean"


def read_archive(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """One row per record of the archive files under path (gzip or plain). Full payload digests are verified.

    bodies False leaves the body null, for callers who need only the headers.
    """
    import gzip
    import hashlib

    def run(it):
        for b in it:
            for content in b.column(0):
                raw = content.as_py()
                if raw[:2] == b"\x1f\x8b":
                    raw = gzip.decompress(raw)
                out: list[tuple] = []
                for head, block in parse_records(raw):
                    kind = head["warc-type"]
                    http, body, length, ok = None, block, None, None
                    if kind in ("request", "response", "revisit"):
                        cut = block.index(b"\r\n\r\n") + 4
                        http, body = block[:cut].decode(), block[cut:]
                        length = next((int(x.split(":")[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
                    if kind == "response":
                        ok = f"sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}" == head.get("warc-payload-digest")
                    out.append((kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), (head.get("warc-payload-digest") or "sha1:")[5:] or None, length, http, body if bodies or kind == "metadata" else None, ok))
                    if len(out) == 2000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names=names)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, request, response, metadata (each a struct, null where missing).

    Requests and metadata name the response or revisit by its concurrent-to id, so every record has one
    key and a capture is one equi-aggregation, whatever files its records are in.
    """
    r = records.withColumn("capture", F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to")))
    r = r.select("capture", "kind", F.struct(*[c for c in records.columns]).alias("r"))
    main = r.where(F.col("kind").isin("response", "revisit")).select(F.col("capture").alias("record_id"), F.col("r").alias("response")).dropDuplicates(["record_id"])
    out = main
    for kind in ("request", "metadata"):
        side = r.where(F.col("kind") == kind).select(F.col("capture").alias("record_id"), F.col("r").alias(kind)).dropDuplicates(["record_id"])
        out = out.join(side, "record_id", "left")
    return out.select("record_id", "request", "response", "metadata")


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write pages as WARC into the shared folder, read the files back, and describe every capture.

    Rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url, digest_ok. An empty table
    gives no rows.
    """
    path = f"{shared_dir(spark)}/larkspur/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_payload)
    t = transactions(read_archive(spark, path, bodies=False))
    got = durable(t.select(
        "record_id", F.regexp_extract(F.col("metadata.body").cast("string"), r"pageId: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.content_length").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("response.refers_to").alias("ref"), F.col("response.uri").alias("url"), F.col("response.digest_ok").alias("digest_ok")), "captures")
    to = got.where("record_type = 'response'").select(F.col("record_id").alias("ref"), F.col("page_id").alias("refers_to"))
    return got.join(to.join(got.select("ref").where("ref is not null").distinct(), "ref", "left_semi"), "ref", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")
