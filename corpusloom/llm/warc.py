"""WARC archives: writing captures, and assembling them from read records.

A capture is three records: the request, the response (or a revisit of an
earlier response with the same payload) and metadata. Request and metadata
name the response in WARC-Concurrent-To. Reading parses each archive by
Content-Length, joins the three through that identifier and gives one nested
row per capture. Payloads stay out of the shuffles unless they are asked for.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import attach
from ..session import scratch_path

#: Shorter payloads are never revisits.
REVISIT_BYTES = 100
#: Captures of one archive file, so that a reader's task stays small.
PER_FILE = 1000

# Fixed values of the WARC 1.1 format.
EOL = "\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("type string, id string, concurrent string, refers string, uri string, date string, "
          "digest string, fields array<struct<name:string,value:string>>, payload_bytes long, payload_digest string, payload binary")


def _id(kind: str, key: str = "_key") -> Column:
    """Record identifier of a row's record of one kind."""
    h = F.md5(F.concat(F.lit(kind + ":"), F.col(key)))
    cuts = [F.substring(h, lo, n) for lo, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    # a null key gives a null identifier
    return F.when(h.isNotNull(), F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">")))


def _record(kind: Column, ident: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record without its closing empty lines; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident)]
    lines += [F.concat(F.lit(name + ": "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(RECORD_END), body)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all rows below ``path``: request, response or revisit, metadata.

    The payload is the text in UTF-8, null as empty. Of rows with equal
    payloads of at least ``REVISIT_BYTES`` the one with the smallest id (null
    last, then the first in the input) is the response, the others revisit it.
    """
    src = pages.select(
        F.col(id_col).cast("string").alias("_page"), F.col(id_col).cast("bigint").alias("_n"),
        F.coalesce(F.col(url_col), F.lit("")).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
        F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0").alias("_key"))
    src = src.withColumn("_digest", F.sha2("_html", 256))
    same = src.filter(F.octet_length("_html") >= REVISIT_BYTES).groupBy("_digest", "_n").agg(F.count("*").alias("rows"))
    first = (
        same.groupBy("_digest").agg(F.sum("rows").alias("all"), F.min(F.struct(F.col("_n").isNull().alias("none"), F.col("_n").alias("n"), "rows")).alias("f"))
        .filter("all > 1").select("_digest", F.lit(True).alias("_shared"), F.col("f.n").alias("_first"), (F.col("f.rows") > 1).alias("_tie"))
    )
    p = attach(src, first, "_digest")
    ahead = F.coalesce(F.col("_shared") & F.col("_n").eqNullSafe(F.col("_first")), F.lit(False))
    tie = F.coalesce(ahead & F.col("_tie"), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("_digest").orderBy("_key"))
    # of rows that repeat the smallest id one is the response
    p = p.filter(~tie).withColumn("_ahead", ahead).unionByName(p.filter(tie).withColumn("_ahead", turn == 1))
    p = p.withColumn("_key", F.when(F.col("_ahead"), F.col("_digest")).otherwise(F.col("_key")))
    # headers are lines: line ends in a URL would break them
    url = F.regexp_replace("_url", r"[\r\n]", " ")
    again = F.col("_shared").isNotNull() & ~F.col("_ahead")
    response, target = _id("response"), _id("response", "_digest")
    http = F.concat(F.lit("HTTP/1.1 200 OK" + EOL + "Content-Type: text/html; charset=utf-8" + EOL + "Content-Length: "),
                    F.octet_length("_html").cast("string"), F.lit(RECORD_END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    site = F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)
    place = F.regexp_replace(url, r"^[A-Za-z]+://[^/?#]*", "")
    records = [
        _record(F.lit("request"), _id("request"),
                [*common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
                F.concat(F.lit("GET "), F.when(place == "", "/").otherwise(place), F.lit(" HTTP/1.1" + EOL + "Host: "), site, F.lit(RECORD_END))),
        _record(F.when(again, "revisit").otherwise("response"), response,
                [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
                 ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(again, target)),
                 ("Content-Type", F.lit("application/http; msgtype=response"))],
                F.when(again, http).otherwise(F.concat(http, F.col("_html")))),
        _record(F.lit("metadata"), _id("metadata"),
                [*common, ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
                F.concat(F.concat_ws(EOL, F.concat(F.lit("page-id: "), F.col("_page")), F.lit("fetched-by: corpusloom")), F.lit(EOL))),
    ]
    # one line of text per capture: the writer's line end closes its last record
    (p.select(F.concat_ws(RECORD_END, *records).alias("value"))
     .write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path))


def _lines(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _read(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record; stops at a damaged one."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        head = []
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line.rstrip(b"\r\n"))
        headers = _lines(b"\r\n".join(head))
        length = headers.get("content-length", "")
        if not length.isdigit():
            return
        block = stream.read(int(length))
        if len(block) < int(length):
            return
        yield headers, block


def _parse(payloads: bool):
    schema = pa.schema([
        *[(c, pa.string()) for c in ("type", "id", "concurrent", "refers", "uri", "date", "digest")],
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.binary())])

    def pairs(block: bytes) -> list[dict[str, str]]:
        return [{"name": k, "value": v} for k, v in _lines(block).items()]

    def row(headers: dict[str, str], block: bytes) -> dict:
        kind, mime = headers.get("warc-type"), headers.get("content-type", "")
        out = {"type": kind, "id": headers.get("warc-record-id"), "concurrent": headers.get("warc-concurrent-to"),
               "refers": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
               "digest": headers.get("warc-payload-digest"), "fields": None, "payload_bytes": None, "payload_digest": None, "payload": None}
        if mime.startswith("application/http"):
            head, _, body = block.partition(b"\r\n\r\n")
            out["fields"] = pairs(head.partition(b"\r\n")[2])
            if kind == "response":
                out |= {"payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}
                out["payload"] = body if payloads else None
        elif mime.startswith("application/warc-fields"):
            out["fields"] = pairs(block)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = io.BytesIO(batch.column("content")[i].as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows, size = [], 0
                try:
                    for headers, block in _read(gzip.GzipFile(fileobj=raw) if packed else raw):
                        rows.append(row(headers, block))
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) == 2000 or size > 1 << 25:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                except (EOFError, OSError, zlib.error):
                    pass  # a cut or damaged archive: the records before it count
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives below ``path`` (gzip or plain)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(_parse(payloads), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: id, uri, date, request, response, metadata.

    A capture is a response or revisit record; requests and metadata join it
    through WARC-Concurrent-To. Several of them (or none) are a list (or an
    empty one), in the order of their identifiers. Records that name a capture
    that is not there, and captures without identifier, give no row of their
    own. A revisit carries the response it refers to as ``original`` (null if
    it is not there).
    """
    part = F.struct("id", "fields")
    kind = F.col("type")
    main = F.struct(kind.alias("type"), "fields", "digest", "payload_bytes", "payload_digest", "payload", "refers", "uri", "date")
    captured = kind.isin("response", "revisit")
    tied = (
        records.filter((captured & F.col("id").isNotNull()) | (kind.isin("request", "metadata") & F.col("concurrent").isNotNull()))
        .groupBy(F.when(captured, F.col("id")).otherwise(F.col("concurrent")).alias("id"))
        .agg(F.any_value(F.when(captured, main), ignoreNulls=True).alias("response"),
             F.array_sort(F.collect_list(F.when(kind == "request", part))).alias("request"),
             F.array_sort(F.collect_list(F.when(kind == "metadata", part))).alias("metadata"))
        .filter(F.col("response").isNotNull())
    )
    origin = records.filter("type = 'response'").select(
        F.col("id").alias("_id"), F.struct("id", "payload_bytes", "payload_digest").alias("original"))
    return (
        tied.join(origin, F.col("response.refers") == F.col("_id"), "left")
        .select("id", F.col("response.uri").alias("uri"), F.col("response.date").alias("date"), "request", "response", "metadata", "original")
    )


def captures(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write all pages as archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_captures(pages, path, **columns)
    return assemble(read_records(spark, path, payloads=False))


def page_records(captured: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a revisit are those of the response it refers to, and
    the digest must be the one in its own header.
    """
    stated = F.filter(F.get("metadata", F.lit(0))["fields"], lambda f: f["name"] == "page-id")
    flat = captured.select(
        "id", F.get(stated, F.lit(0))["value"].cast("bigint").alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers").alias("refers"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.regexp_replace("response.digest", "^sha256:", "").alias("stated"))
    target = flat.filter("record_type = 'response'").select(F.col("id").alias("refers"), F.col("page_id").alias("refers_to"))
    again = flat.filter("record_type = 'revisit'").join(target, "refers", "left")
    rest = flat.filter("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint"))
    return again.unionByName(rest).select(
        "page_id", "payload_bytes", F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to")
