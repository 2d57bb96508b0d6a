"""WARC archives, index first: records are written with an index, and read back by coalesced byte ranges.

Each record is a gzip member of its own, so a range of a file can be read alone. Writing gives an index row for each
record: the file, its offset and length there, the URL, the payload's digest and size. Reading takes the selected index
rows, sorts those of each file by offset, joins ranges that lie close together, and reads each joined range once.

A task writes one file under a name of its own attempt, and the index, written as Parquet with the task's results, names
only files of attempts that succeeded: a lost executor leaves files that no index names. Files are opened by their URL
through Arrow's file systems, in the folder that all executors share.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is the response, and the others
are revisits that name it. The group is found by digest and size, counted before it is joined back.

Cases: a null payload is an empty one, a null URL is left out of the record; equal ids with equal payloads, as in
repeated rows, are all responses where their id is the largest; a very long payload is one record, written and read alone,
in memory in proportion to it; null ids are written without a record id, never as a
revisit nor as its target; an empty table gives an empty archive and index; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, scratch, shuffle_partitions, text_slices, trimmed

#: Payloads of fewer bytes are never revisits.
LEAST = 0
#: Ranges of a file that lie at most so far apart are read together, up to so many bytes.
GAP, RANGE = 64 << 10, 8 << 20
#: Bytes of payloads that are written at a time, one record at least.
BLOCK_BYTES = 4 << 20
DATE = "2020-01-01T00:00:00Z"
RECORDS = "page_id long, url string, payload binary, digest string, refers_to long"
INDEX = "file string, offset long, length long, page_id long, url string, digest string, payload_bytes long, record_type string"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _digest_column(payload: Column) -> Column:
    """Upper-case base32 SHA-1, from the hexadecimal one: five bits at a time."""
    bits = F.rpad(F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 2), 40, "0") for i in range(1, 41, 10)]), 160, "0")
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(alphabet, F.conv(F.substring(bits, i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(1, 161, 5)])


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Each page's payload, its digest, and the id of the response that it revisits, if it does."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", _digest_column(F.col("payload")))
    keys = materialize(rows.select("page_id", "digest", F.octet_length("payload").alias("n")), "digests")
    # Grouped before it is joined: one row for each payload found twice or more. The join's skewed digests are split.
    twice = keys.where(F.col("page_id").isNotNull() & (F.col("n") >= least)).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    revisits = keys.join(twice, ["digest", "n"]).where("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # Written, so that its size is known: where it is below the session's threshold it goes to the pages, which then stay
    # in place; only beyond it payloads are shuffled.
    revisits = materialize(revisits, "revisits")
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record; a revisit carries the payload's digest and size, but not the payload."""
    revisit = refers_to is not None
    kind = "revisit" if revisit else "response"
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Date: {DATE}".encode()]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>".encode())
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head.append(f"WARC-Payload-Digest: sha1:{digest}".encode())
    if revisit:
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>".encode())
        head.append(f"WARC-Payload-Length: {len(payload)}".encode())
    body = b"" if revisit else payload
    head += [b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's header fields, by lower-case name, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:20]!r}")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.decode().partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length does not fit its block")
    return fields, rest[:length]


def _opened(url: str):
    """Arrow's file system of a URL, and the path there; Hadoop's names of S3 are the one that Arrow knows."""
    from pyarrow import fs

    scheme, mark, rest = url.partition("://")
    return fs.FileSystem.from_uri(f"s3{mark}{rest}" if scheme in ("s3a", "s3n") else url)


def write(records: DataFrame, path: str) -> DataFrame:
    """Writes records (``RECORDS``) to files in the shared folder path; the index, written beside them, is returned."""

    def run(batches):
        import pyarrow as pa

        opened, name, offset = None, None, 0
        try:
            for batch in batches:
                for first, last in text_slices(batch.column(2), BLOCK_BYTES):
                    rows: list[tuple] = []
                    for x in batch.slice(first, last - first).to_pylist():
                        if opened is None:
                            name = f"{path}/{uuid.uuid4().hex}.warc.gz"
                            system, place = _opened(name)
                            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                            opened = system.open_output_stream(place, compression=None)
                        member = gzip.compress(record(x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"]), 6, mtime=0)
                        opened.write(member)
                        kind = "response" if x["refers_to"] is None else "revisit"
                        rows.append((name, offset, len(member), x["page_id"], x["url"], x["digest"], len(x["payload"]), kind))
                        offset += len(member)
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                    names = ["file", "offset", "length", "page_id", "url", "digest", "payload_bytes", "record_type"]
                    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        finally:
            if opened is not None:
                opened.close()

    index = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(trimmed(run), INDEX)
    return materialize(index, "warc-index")


def _ranges(rows: list[tuple[int, int]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) joined to (start, end, members) where gaps are small."""
    out: list[tuple[int, int, list]] = []
    for offset, length in rows:
        if out and offset - out[-1][1] <= GAP and offset + length - out[-1][0] <= RANGE:
            start, end, members = out.pop()
            out.append((start, max(end, offset + length), [*members, (offset, length)]))
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the selected index rows name; digest and size are those of the payload that was read.

    A revisit's are those of its header. Rows of one file are dealt out by ranges of RANGE bytes, so that a large file is
    read by several tasks.
    """

    def numbered(value: str | None):
        return None if value is None else int(value.strip("<>").rpartition(":")[2])

    def told(data: bytes) -> tuple:
        fields, body = parse(gzip.decompress(data))
        revisit = fields["warc-type"] == "revisit"
        digest = fields["warc-payload-digest"].partition(":")[2] if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
        size = int(fields["warc-payload-length"]) if revisit else len(body)
        ids = numbered(fields.get("warc-record-id")), numbered(fields.get("warc-refers-to"))
        return ids[0], fields.get("warc-target-uri"), fields["warc-type"], ids[1], digest, size, body if with_payload and not revisit else None

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
        name, opened = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            a = 0
            while a < len(files):
                b = a
                while b < len(files) and files[b] == files[a]:
                    b += 1
                if files[a] != name:
                    if opened is not None:
                        opened.close()
                    name = files[a]
                    system, place = _opened(name)
                    opened = system.open_input_file(place)
                # A range at a time, so that no more payloads are held than it has.
                for start, end, members in _ranges(list(zip(offsets[a:b], lengths[a:b], strict=True))):
                    data = opened.read_at(end - start, start)
                    columns = list(zip(*[told(data[o - start : o - start + n]) for o, n in members], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                a = b
        if opened is not None:
            opened.close()

    n = shuffle_partitions(index.sparkSession)
    dealt = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / RANGE))
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(trimmed(run), READ)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = write(plan_records(pages), scratch(spark, "warc"))
    return read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH raw AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT page_id, n, h, list_reduce(list_transform(range(1, 41), lambda i: right('000' || bin(strpos('0123456789abcdef', h[i::INT]) - 1), 4)), lambda x, y: x || y) AS b FROM raw),
dig AS (SELECT page_id, n, list_reduce(list_transform(range(0, 32), lambda i: ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[(16 * b[(5 * i + 1)::INT]::INT + 8 * b[(5 * i + 2)::INT]::INT + 4 * b[(5 * i + 3)::INT]::INT + 2 * b[(5 * i + 4)::INT]::INT + b[(5 * i + 5)::INT]::INT + 1)::INT]), lambda x, y: x || y) AS d FROM bits),
top AS (SELECT d, n, max(page_id) AS first FROM dig WHERE page_id IS NOT NULL GROUP BY d, n)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to
FROM dig LEFT JOIN top USING (d, n)
"""
