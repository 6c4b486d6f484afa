"""WARC archives of captures: written as request, response and metadata records, read back and assembled.

A capture whose payload another capture has already is written as a revisit without payload. Archives are gzip
files of records; a task streams one archive and holds one record at a time, whatever the archive's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sqlcurate.sources.storage import stored

VERSION, CRLF = "WARC/1.1", "\r\n"
#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 100
CAPTURES_PER_FILE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_RESPONSE = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
SEEN, BESIDE = ("response", "revisit"), ("request", "metadata")


def headed(fields: dict[str, str | Column], block: Column) -> Column:
    """A record: named fields (null ones are left out), an empty line, the block."""
    lines = [F.concat(F.lit(f"{CRLF}{name}: "), value if isinstance(value, Column) else F.lit(value)) for name, value in fields.items()]
    length = F.concat(F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(VERSION), *[F.coalesce(line, F.lit("")) for line in lines], length, F.lit(CRLF * 2), block)


def deduplicated(pages: DataFrame, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """id, url, payload, payload_bytes, digest, first: of payloads that repeat and are large enough, the smallest id."""
    payload = F.coalesce(F.col(f"`{payload_column}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{url_column}`").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    large = rows.filter(F.col("payload_bytes") >= LEAST_REVISIT)
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(firsts, "digest", "left")


def write_warc(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write every row as three records. Ids are integers, of either sign.

    A null payload is empty, a null address is left out, line ends in an address are escaped. A row without id is
    never the response that others revisit. Rows that repeat with one id are responses all. An empty table gives an
    archive without records. Other columns are not read.
    """
    rows = deduplicated(pages, id_column, url_column, payload_column)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    key = F.expr("concat(coalesce(cast(id AS string), 'none'), '/', substring(digest, 1, 16))")
    name = lambda kind, of=key: F.concat(F.lit(f"<urn:capture:{kind}:"), of, F.lit(">"))
    capture = F.when(revisit, name("revisit")).otherwise(name("response"))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    original = F.when(revisit, name("response", F.expr("concat(cast(first AS string), '/', substring(digest, 1, 16))")))
    common = {"WARC-Target-URI": address, "WARC-Date": date}
    http = F.concat(F.lit(HTTP_RESPONSE + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    asked = F.concat(F.lit("GET "), F.coalesce(address, F.lit("/")), F.lit(" HTTP/1.1" + CRLF * 2))
    facts = F.concat(
        F.coalesce(F.concat(F.lit("pageId: "), F.col("id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.lit("payloadLength: "), F.col("payload_bytes").cast("string"), F.lit(CRLF),
    )
    records = [
        headed({"WARC-Type": "request", "WARC-Record-ID": name("request"), **common, "WARC-Concurrent-To": capture,
                "Content-Type": "application/http; msgtype=request"}, asked),
        headed({"WARC-Type": F.when(revisit, "revisit").otherwise("response"), "WARC-Record-ID": capture, **common,
                "WARC-Payload-Digest": digest, "WARC-Refers-To": original, "WARC-Profile": F.when(revisit, PROFILE),
                "Content-Type": "application/http; msgtype=response"},
               F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))),
        headed({"WARC-Type": "metadata", "WARC-Record-ID": name("metadata"), **common, "WARC-Concurrent-To": capture,
                "Content-Type": "application/warc-fields"}, facts),
    ]
    archive = rows.select(F.concat_ws(CRLF * 2, *records).alias("value"))
    archive.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", CAPTURES_PER_FILE).text(path)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    """Fields and block of a record that has lost its version line; None if it is not whole yet."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split(CRLF):
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = int(fields.get("content-length", 0))
    return (fields, rest[:length]) if len(rest) >= length else None


FIELDS = "record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string"


def read_warc(spark: SparkSession, path: str, kinds: tuple[str, ...] = SEEN, with_payload: tuple[str, ...] = (*SEEN, *BESIDE)) -> DataFrame:
    """Records of the given kinds, one row each: type, fields, block_head, payload, payload_bytes, found_digest.

    For HTTP blocks block_head is what stands before the first empty line and payload what follows; for other
    blocks the payload is the block. found_digest is the SHA-256 of the payload as read. Kinds that are not in
    `with_payload` come without the bytes themselves. A record may hold the version line; its length decides where it ends.
    """
    names = ["type", *[x.split()[0] for x in FIELDS.split(", ")], "block_head", "payload", "payload_bytes", "found_digest"]
    keys = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest"]
    kind = [pa.string()] * 8 + [pa.binary(), pa.int64(), pa.string()]
    version = f"{VERSION}{CRLF}".encode()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, file = None, None  # the beginning of a record that is not whole
        for part in parts:
            out: list[tuple] = []
            for raw, of in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if of != file:
                    held, file = None, of
                raw = raw if held is None else held + version + raw
                if not raw:
                    continue
                if (record := parsed(raw)) is None:
                    held = raw
                    continue
                held, (fields, block) = None, record
                if fields.get("warc-type") not in kinds:
                    continue
                head, payload = b"", block
                if fields.get("content-type", "").startswith("application/http"):
                    head, _, payload = block.partition(b"\r\n\r\n")
                out.append((
                    *[fields.get(k) for k in keys], head.decode("utf-8", "replace"), payload if fields["warc-type"] in with_payload else None, len(payload),
                    hashlib.sha256(payload).hexdigest(),
                ))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kind, strict=True)], names)

    lines = spark.read.option("lineSep", f"{VERSION}{CRLF}").text(path)
    rows = lines.select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    return rows.mapInArrow(batches, f"type string, {FIELDS}, block_head string, payload binary, payload_bytes bigint, found_digest string")


def assemble(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row per capture: request and metadata join the response or revisit that they are concurrent to.

    capture (type, record_id, target_uri, date, payload_digest, refers_to, payload, ...), request, metadata; the
    latter two are null where the archive has none. Rows that repeat share a record id: each capture stays a row, and
    takes one of the equal requests and metadata records.
    """
    if payloads:
        captures, beside = read_warc(spark, path), stored(read_warc(spark, path, BESIDE), "beside")
    else:  # archives are read once
        captures = beside = stored(read_warc(spark, path, (*SEEN, *BESIDE), BESIDE), "records")
    captures = captures.filter(F.col("type").isin(*SEEN))
    requests = beside.filter("type = 'request'").select(F.col("concurrent_to").alias("of_request"), F.struct("record_id", "block_head").alias("request"))
    requests = requests.dropDuplicates(["of_request"])
    text = F.col("payload").cast("string")
    fact = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^{name}: *([^\r\n]*)", 1), F.lit(""))
    metadata = beside.filter("type = 'metadata'").select(
        F.col("concurrent_to").alias("of_metadata"),
        F.struct("record_id", fact("pageId").cast("long").alias("page_id"), fact("payloadLength").cast("long").alias("payload_length")).alias("metadata"),
    ).dropDuplicates(["of_metadata"])
    nested = captures.select(F.col("record_id").alias("id"), F.struct("*").alias("capture"))
    joined = nested.join(requests, F.col("id") == F.col("of_request"), "left").join(metadata, F.col("id") == F.col("of_metadata"), "left")
    return joined.select("capture", "request", "metadata")
