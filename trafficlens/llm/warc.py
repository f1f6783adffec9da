"""WARC archives: writing with revisits, and assembly of transactions on reading.

Every page becomes one capture of three records: the request, the response (or a revisit record that refers
to the response holding the same payload) and metadata; request and metadata name the response or revisit
in WARC-Concurrent-To. Records are written by Spark's text sink, whose line separator is the end mark of a
record, compressed with gzip, so that files go through the committer to any file system.

On reading, files are cut into records by their Content-Length in Python, file by file (files are kept small
on writing), and records of one capture are joined by their identifiers.

Defined cases: a null payload is empty; rows that repeat an id and rows without one are captures of their own:
their identifiers go on with a record number, made of a digest of the row and a count of equal rows, and where
the id is null they hold no id (nor does the metadata record); a null url is written as an empty one; records
whose partners are missing give a capture with nulls; an empty table writes no records.
"""

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.session import written

# Marks of the format.
EOL, RECORD_END = "\r\n", "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SMALLEST_REVISITED = 1000
ROWS_PER_FILE = 2000
# A record without a date of its own gets this one, so that writing again gives the same bytes.
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, concurrent_to string, refers_to string, "
    "declared_digest string, payload_bytes long, payload_digest string, fields string"
)


def _urn(kind: str, page: Column, number: Column) -> Column:
    """Without a `number` the page's id alone tells its records."""
    own = F.coalesce(F.concat(F.lit(":"), number), F.lit(""))
    return F.concat(F.lit(f"<urn:page:{kind}:"), F.coalesce(page.cast("string"), F.lit("")), own, F.lit(">"))


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}WARC-Date: {DATE}{EOL}WARC-Record-ID: "), record_id, F.lit(EOL)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        head += [F.lit(f"{name}: "), value, F.lit(EOL)]
    return F.concat(*head, F.lit(EOL), block)


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` with `number`: null where a row has an id of its own, else what tells rows of one id apart.

    Ids are counted first, so that no payload is moved unless its id is missing or repeats. Equal rows are folded
    and dealt out again with numbers, which keeps any number of them from meeting in one task.
    """
    ids = rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 or page_id is null").select("page_id")
    if not ids.limit(1).count():
        return rows.withColumn("number", F.lit(None).cast("string"))
    ids = written(ids, "warc-repeated-ids")
    alone = rows.where("page_id is not null").join(ids, "page_id", "left_anti").withColumn("number", F.lit(None).cast("string"))
    others = rows.join(ids, "page_id", "left_semi").unionByName(rows.where("page_id is null"))
    folded = others.groupBy("page_id", "url", "n_bytes", "digest").agg(F.first("payload").alias("payload"), F.count("*").alias("_n"))
    row = F.sha1(F.concat("digest", "url").cast("binary"))
    dealt = folded.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    dealt = dealt.withColumn("number", F.concat(row, F.lit("."), F.col("_nth").cast("string"))).drop("_n", "_nth")
    return alone.unionByName(dealt)


def captures(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, smallest: int = SMALLEST_REVISITED) -> DataFrame:
    """Pages with their digest, a record number and, for all but the largest id of equal payloads, id and record
    number of the response they refer to."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    read = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("n_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    rows = _numbered(read)
    # A digest is counted before anything is joined to it; copies of one payload meet in a join, which AQE may split.
    holder = rows.where(F.col("n_bytes") >= smallest).groupBy("digest").agg(
        F.max(F.struct("page_id", "number")).alias("holder"), F.count("*").alias("copies")
    )
    shared = holder.where("copies > 1").drop("copies")
    other = F.col("holder")["page_id"] != F.col("page_id")
    refers = {"refers_to": F.when(other, F.col("holder")["page_id"]), "refers_number": F.when(other, F.col("holder")["number"])}
    return rows.join(shared, "digest", "left").withColumns(refers).drop("holder")


def write_warc(captured: DataFrame, path: str, *, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Three records per capture, in gzip files of at most `rows_per_file` captures."""
    page, number, revisit = F.col("page_id"), F.col("number"), F.col("refers_to").isNotNull()
    uri = ("WARC-Target-URI", F.col("url"))
    answer_id = F.when(revisit, _urn("revisit", page, number)).otherwise(_urn("response", page, number))
    together = ("WARC-Concurrent-To", answer_id)
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", _urn("request", page, number), [uri, together, ("Content-Type", F.lit("application/http; msgtype=request"))], get)
    response = _record("response", answer_id, [uri, digest, http], F.concat(F.lit(HTTP_HEAD), F.col("payload")))
    again = _record(
        "revisit",
        answer_id,
        [uri, digest, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _urn("response", F.col("refers_to"), F.col("refers_number"))), http],
        F.lit(HTTP_HEAD),
    )
    metadata = _record(
        "metadata",
        _urn("metadata", page, number),
        [uri, together, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(EOL)),
    )
    answer = F.when(revisit, again).otherwise(response)
    records = captured.select(F.array_join(F.array(request, answer, metadata), RECORD_END).alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", rows_per_file).text(path)


def _records(stored: bytes) -> Iterator[tuple]:
    """Records of one archive file, plain or in any number of gzip members. It is unpacked as it is read, so that
    only one record is held beside the file as it is stored."""
    data = io.BytesIO(stored)
    if stored[:2] == b"\x1f\x8b":
        data = io.BufferedReader(gzip.GzipFile(fileobj=data), 1 << 20)
    while version := data.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        header = {}
        while (line := data.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            header[name.lower()] = value.strip()
        size = int(header["content-length"])
        block = data.read(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        data.read(len(RECORD_END))
        kind = header["warc-type"]
        payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        yield (
            header["warc-record-id"],
            kind,
            header.get("warc-target-uri"),
            header.get("warc-concurrent-to"),
            header.get("warc-refers-to"),
            header.get("warc-payload-digest", "").rpartition(":")[2] or None,
            None if payload is None else len(payload),
            None if payload is None else hashlib.sha1(payload).hexdigest(),
            block.decode() if kind in ("metadata", "request") else None,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. Lengths and digests of responses are those of the bytes read."""

    def parse(batches):
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in RECORD_SCHEMA.split(", "))])
        for batch in batches:
            for content in batch["content"]:
                rows = list(_records(content.as_py()))
                columns = zip(*rows) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: its answer, request and metadata, each nested, joined by record identifiers.

    The identifiers of a capture are its own, so no key holds more than its records. A revisit gets length and
    digest of the payload from the response it refers to.
    """
    answers = records.where(F.col("record_type").isin("response", "revisit"))
    partner = lambda kind: records.where(F.col("record_type") == kind).select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "target_uri", "fields").alias(kind)
    )
    joined = answers.join(partner("request"), "record_id", "left").join(partner("metadata"), "record_id", "left")
    referred = answers.where(F.col("record_type") == "response").select(
        F.col("record_id").alias("refers_to"), F.struct("payload_bytes", "payload_digest").alias("_held")
    )
    # Many captures may refer to one response: only revisits are joined, and Spark may split such a key.
    whole = joined.where(F.col("record_type") == "response").withColumn("_held", F.struct("payload_bytes", "payload_digest"))
    short = joined.where(F.col("record_type") == "revisit").join(referred, "refers_to", "left")
    return whole.unionByName(short).select(
        F.struct("record_id", "record_type", "target_uri", "refers_to", "declared_digest").alias("answer"),
        "request",
        "metadata",
        F.col("_held")["payload_bytes"].alias("payload_bytes"),
        F.col("_held")["payload_digest"].alias("payload_digest"),
    )


def page_of(urn: Column) -> Column:
    """The id within an identifier made by `write_warc`."""
    return F.regexp_extract(urn, r"^<urn:page:\w+:(-?\d+)(:[^>]*)?>$", 1).try_cast("long")


def without_number(urn: Column) -> Column:
    """An identifier made by `write_warc` without its record number, null where it holds no id."""
    return F.when(page_of(urn).isNotNull(), F.regexp_replace(urn, r"^(<urn:page:\w+:-?\d+):[^>]*>$", "$1>"))
