"""WARC archives: write captures, read them back, and assemble transactions.

A capture is written as a request, a response or revisit, and a metadata record, tied by
``WARC-Concurrent-To``. Spark's own text writer makes the files: a record ends in two line ends,
which is the writer's line separator, so any file system and the commit protocol of Spark's
writers serve. Files hold a bounded number of bytes.

Reading takes each file (plain or gzip, also one gzip member per record) apart by the records'
content lengths. Request, response and metadata records are then joined through their
concurrent-to identifiers, whichever of them names the other, to one nested row per capture. A
revisit takes payload length and page from the response that it refers to.

Defined results: a null payload is empty; a null url leaves its header out; a null page id comes
back as null. Equal payloads have one response, the one with the smallest page id (a null id only
if no other has it); rows equal in id, url and payload are one capture written several times and
come back as often. An empty table gives empty archives and no captures. Other columns are not
read. Payloads may hold any text, line ends and record heads included.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.llm.shared import named, saved
from custvalue.operators.joins import left_join

FILE_BYTES = 16 << 20  # of records, about, in one file
_END = "\r\n"
_HEX5 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary in upper-case base32, 20 bits at a time."""
    digest = F.sha1(data)
    parts = [
        F.lpad(F.upper(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32)), 4, "0")
        for i in range(8)
    ]
    return F.translate(F.concat(*parts), _HEX5, _BASE32)


def _urn(*parts: Column) -> Column:
    """A record id made from what a record is about: a retried task makes the same ids."""
    text = [F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    return F.regexp_replace(
        F.md5(F.concat_ws("|", *text)),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
        "<urn:uuid:$1-$2-$3-$4-$5>",
    )


def _record(kind: str, fields: dict[str, Column], block: Column) -> Column:
    """A record without its final two line ends. Null fields are left out."""
    lines = [F.lit(f"WARC/1.1{_END}WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    length = F.octet_length(block).cast("string")
    lines.append(F.concat(F.lit("Content-Length: "), length))
    return F.concat(F.concat_ws(_END, *lines), F.lit(2 * _END), block)


def captures(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
) -> DataFrame:
    """page_id, url, payload, digest, bytes and first: the page id of the response among the
    captures of this payload. Payloads of fewer than ``least_bytes`` bytes are all responses."""
    payload = F.coalesce(named(payload_column), F.lit(""))
    rows = pages.select(
        named(id_column).alias("page_id"),
        named(url_column).alias("url"),
        payload.alias("payload"),
        base32_sha1(F.encode(payload, "UTF-8")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    firsts = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("__n")
    )
    # Only payloads that occur again matter; the others are their own response.
    firsts = firsts.where("__n > 1").drop("__n").withColumnRenamed("digest", "__digest")
    joined = left_join(rows, firsts, "digest", "__digest", hot_keys=True).drop("__digest")
    return joined.withColumn("first", F.coalesce("first", "page_id"))


def records(rows: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The records (column value) of captures, three in a row for each."""
    page, first = F.col("page_id"), F.col("first")
    response = page.eqNullSafe(first)
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    own = _urn(F.lit("capture"), page, F.col("url"), F.col("digest"))
    # A response is named by page and payload, so that its revisits can refer to it.
    answer = F.when(response, _urn(F.lit("response"), page, F.col("digest"))).otherwise(own)
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": uri}
    digest = F.concat(F.lit("sha1:"), "digest")
    size = F.col("bytes").cast("string")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=UTF-8{_END}Content-Length: "),
        size,
        F.lit(2 * _END),
    )
    http = {"Content-Type": F.lit("application/http; msgtype=response")}
    full = _record(
        "response",
        {"WARC-Record-ID": answer} | common | {"WARC-Payload-Digest": digest} | http,
        F.concat(head, "payload"),
    )
    again = _record(
        "revisit",
        {"WARC-Record-ID": answer}
        | common
        | {
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.lit(
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
            ),
            "WARC-Refers-To": _urn(F.lit("response"), first, F.col("digest")),
        }
        | http,
        head,
    )
    asked = F.regexp_extract(F.coalesce(uri, F.lit("")), "^[^:/?#]*://[^/?#]*([^#]*)", 1)
    request = _record(
        "request",
        {"WARC-Record-ID": _urn(F.lit("request"), page, F.col("url"), F.col("digest"))}
        | common
        | {
            "WARC-Concurrent-To": answer,
            "Content-Type": F.lit("application/http; msgtype=request"),
        },
        F.concat(F.lit("GET "), F.when(asked == "", "/").otherwise(asked), F.lit(f" HTTP/1.1{2 * _END}")),
    )
    about = _record(
        "metadata",
        {"WARC-Record-ID": _urn(F.lit("metadata"), page, F.col("url"), F.col("digest"))}
        | common
        | {"WARC-Concurrent-To": answer, "Content-Type": F.lit("application/warc-fields")},
        F.coalesce(F.concat(F.lit("page-id: "), page.cast("string"), F.lit(_END)), F.lit("")),
    )
    return rows.select(
        F.explode(F.array(request, F.when(response, full).otherwise(again), about)).alias("value")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    compression: str = "gzip",
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
) -> None:
    """Write the captures of ``pages`` as archives into ``folder``."""
    size = pages.agg(
        F.count("*").alias("n"), F.sum(F.octet_length(named(payload_column))).alias("bytes")
    ).first()
    each = (size["bytes"] or 0) / max(size["n"], 1) + 1500
    rows = captures(pages, id_column, url_column, payload_column, least_bytes)
    records(rows).write.option("lineSep", 2 * _END).option("compression", compression).option(
        "maxRecordsPerFile", 3 * max(1, int(FILE_BYTES / each))
    ).text(folder)


def _plain(content: bytes) -> bytes:
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        parts.append(member.flush())
        content = member.unused_data.lstrip(b"\0")
    return b"".join(parts)


def _headers(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.decode("utf-8", "replace").strip().lower()] = value.decode(
                "utf-8", "replace"
            ).strip()
    return found


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record. Raises where a record is cut short or has no length."""
    content, at = _plain(content), 0
    while at < len(content):
        if content[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        headers = _headers(content[at:end])
        start = end + 4
        at = start + int(headers["content-length"])
        if at > len(content):
            raise ValueError(f"a record at byte {start} is cut short")
        yield headers, content[start:at]


_RECORD = (
    "kind string, record_id string, concurrent_to string, refers_to string, uri string, "
    "date string, page_id string, payload_bytes long, payload_digest string, payload binary"
)


def _parsed(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in _RECORD.split(", ")]
        kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse(content.as_py()):
                    rows.append(_row(headers, block))
                    held += len(block)
                    if held > 1 << 22:
                        yield out(names, kinds, rows)
                        rows, held = [], 0
                if rows:
                    yield out(names, kinds, rows)

    def out(names, kinds, rows):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def _row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        size = digest = page = payload = None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size = len(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "revisit":
            digest = headers.get("warc-payload-digest", "").partition(":")[2] or None
        elif kind == "metadata":
            page = _headers(block).get("page-id")
        return (
            kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"),
            headers.get("warc-refers-to"), headers.get("warc-target-uri"),
            headers.get("warc-date"), page, size, digest, payload if with_payload else None,
        )

    return read


def read_records(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder, one row each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder)
    return files.select("content").mapInArrow(_parsed(with_payload), _RECORD)


def assembled(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, uri, request, response, metadata,
    record_type, payload_bytes, payload_digest, refers_to, refers_to_page.

    A record belongs to the response or revisit that it names, that names it, or that a record it
    names belongs to.
    """
    answers = F.col("kind").isin("response", "revisit")
    # Names that stand for an answer: of what it names, and of what names it.
    alias = found.where("concurrent_to IS NOT NULL AND record_id IS NOT NULL").select(
        F.when(answers, F.col("concurrent_to")).otherwise(F.col("record_id")).alias("__alias"),
        F.when(answers, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("__answer"),
    )
    alias = alias.groupBy("__alias").agg(F.min("__answer").alias("__answer"))
    keyed = found.withColumn(
        "__name", F.when(answers, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    )
    small = keyed.where(~answers)
    small = left_join(small, alias, "__name", "__alias", hot_keys=True)
    small = small.withColumn("capture_id", F.coalesce("__answer", "__name"))
    small = small.drop("__alias", "__answer", "__name")
    large = keyed.where(answers).withColumn("capture_id", F.col("record_id")).drop("__name")
    every = large.unionByName(small)
    whole = F.struct("record_id", "uri", "date")
    answer = F.struct(
        "kind", "record_id", "refers_to", "uri", "date", "payload_bytes", "payload_digest", "payload"
    )
    return every.groupBy("capture_id").agg(
        F.max(F.when(F.col("kind") == "request", whole)).alias("request"),
        F.max(F.when(answers, answer)).alias("response"),
        F.max(F.when(F.col("kind") == "metadata", F.struct("record_id", "uri", "date", "page_id")))
        .alias("metadata"),
        F.count_if(answers).alias("n"),
    ).where("n > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n", "nth")


def read_captures(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """``assembled`` records of a folder, with page_id, record_type, payload_bytes,
    payload_digest and refers_to (the page id of the response a revisit refers to)."""
    found = read_records(spark, folder, with_payload)
    if not with_payload:
        found = saved(found.drop("payload")).withColumn("payload", F.lit(None).cast("binary"))
    rows = assembled(found).withColumns(
        {
            "page_id": F.col("metadata.page_id"),
            "record_type": F.col("response.kind"),
            "payload_digest": F.col("response.payload_digest"),
        }
    )
    named_ = rows.where("record_type = 'response'").groupBy("capture_id").agg(
        F.first("page_id").alias("refers_to"),
        F.first("response.payload_bytes").alias("__bytes"),
    )
    target = F.when(F.col("record_type") == "revisit", F.col("response.refers_to"))
    joined = left_join(
        rows.withColumn("__target", target),
        named_.withColumnRenamed("capture_id", "__id"), "__target", "__id", hot_keys=True,
    )
    return joined.withColumn(
        "payload_bytes", F.coalesce("response.payload_bytes", "__bytes")
    ).drop("__target", "__id", "__bytes")
