"""Web archives: pages as WARC 1.1 records, long ones in segments, written and read back.

Archives are gzip files that Spark's text writer commits, a record for each of its lines,
so a lost task leaves no part of one. The reader splits them at the version line, joins
what a payload that holds this line has torn, and gathers the segments of a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import columns_of, keep, new_folder, slices

MARK, BLANK = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Bytes of a record's block, and of a chunk of its transfer framing.
SEGMENT, CHUNK = 8192, 4096
#: Records of an archive.
RECORDS = 50_000
#: Every record has a date; these archives are of no crawl.
DATE = "1970-01-01T00:00:00Z"
PARTS = "record_id string, origin string, number int, total long, page_id long, url string, record_type string, said string, payload_digest string, payload_bytes long, payload binary, fault string, block binary"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing -----------------------------------------------------------------------


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """An HTTP answer whose body goes in chunks."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for at in range(0, len(payload), chunk):
        piece = payload[at : at + chunk]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join(parts) + b"0\r\n\r\n"


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the blank lines that end it. Fields that are None are left out."""
    head = "".join(f"{name}: {value}\r\n" for name, value in fields.items() if value is not None)
    return MARK + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _escaped(url: bytes | None) -> str | None:
    """Control characters and blanks would end a field; they become %XX."""
    return None if url is None else re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url).decode("utf-8", "replace")


def records(page_id: int | None, url: bytes | None, payload: bytes | None, revisit: bool, name: str, said: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit without body, or a response whose block is cut
    in segments, the second and later ones as continuation records."""
    ident = lambda n: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{n}')}>"
    fields = {"WARC-Type": "response", "WARC-Record-ID": ident(1), "WARC-Date": DATE, "WARC-Target-URI": _escaped(url), "WARC-Page-ID": page_id, "WARC-Payload-Digest": f"sha1:{said}", "Content-Type": "application/http; msgtype=response"}
    if revisit:
        yield record(fields | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}, b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = framed(payload or b"")
    cuts = [block[at : at + segment] for at in range(0, len(block), segment)]
    for n, cut in enumerate(cuts, 1):
        last = {"WARC-Segment-Total-Length": len(block)} if n == len(cuts) else {}
        if len(cuts) == 1:
            yield record(fields, cut)
        elif n == 1:
            yield record(fields | {"WARC-Segment-Number": 1}, cut)
        else:
            yield record({"WARC-Type": "continuation", "WARC-Record-ID": ident(n), "WARC-Date": DATE, "WARC-Segment-Origin-ID": ident(1), "WARC-Segment-Number": n} | last, cut)


def _writes(segment: int, run: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "row", "said")), strict=True):
                page_id, url, payload, revisit, nth, said = row
                out += records(page_id, url, payload, revisit, f"{run}/{nth}", said or digest(payload or b""), segment)
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})

    return work


def write(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> str:
    """Writes `pages` (page_id, url, html) as archives; returns their folder.

    Of the rows with equal payloads of `least` bytes or more, those of the smallest
    page_id are responses (a null one is the largest; of one page_id all of them), the
    others revisit them. A null html is empty; rows may repeat; an empty table gives
    no records; further columns are left out.

    Only digests are shuffled to find equal payloads. The page texts meet those that are
    there more than once: by broadcast while the planner finds these few enough, else by
    a join whose large partitions it splits.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("binary").alias("url"), html.alias("payload"), F.sha1(html).alias("sha"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    again = keep(groups.where("n > 1").drop("n").withColumn("many", F.lit(True)), "again")
    of = rows.join(again, "sha", "left").withColumn("revisit", F.coalesce(F.col("many"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")))
    sent = of.select("page_id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "revisit", F.monotonically_increasing_id().alias("row"), F.when(F.col("revisit"), F.col("sha")).alias("sha"))
    sent = sent.withColumn("said", base32("sha")).drop("sha")
    where = new_folder(spark, "archives")
    lines = sent.mapInArrow(_writes(segment, where), "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", BLANK.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(where)
    return where


def base32(sha: str):
    """The column's 40 hex digits as 32 base32 digits: five bits each, eight digits from ten."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for at in range(1, 41, 10):
        bits = F.conv(F.substring(sha, at, 10), 16, 10).cast("long")
        digits += [F.substring(F.lit(letters), F.shiftright(bits, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.when(F.col(sha).isNotNull(), F.concat(*digits))


# -- reading -----------------------------------------------------------------------


def headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space goes on with the last."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    parted = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in parted if colon}


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunks; extensions and trailing fields are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].partition(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of a whole HTTP answer."""
    head, _, body = block.partition(BLANK)
    return unchunked(body) if headers(head).get("transfer-encoding", "").lower().endswith("chunked") else body


def decoded(block: bytes, said: str | None) -> dict[str, object]:
    """Payload, its digest and length; the fault if the framing is broken or the digest differs."""
    try:
        payload = payload_of(block)
    except ValueError:
        return {"fault": "framing"}
    found = digest(payload)
    return {"payload": payload, "payload_digest": found, "payload_bytes": len(payload), "fault": "digest" if said and said != found else None}


def parsed(piece: bytes, wanted: bool) -> dict[str, object] | None:
    """What one record says, decoded unless it is a segment; None if `piece` ends too early."""
    head, blank, rest = piece.partition(BLANK)
    fields = headers(head)
    length = fields.get("content-length", "")
    if not blank or not length.isdigit():
        return {"record_type": fields.get("warc-type", ""), "fault": "header"}
    if len(rest) < int(length):
        return None
    block, page = rest[: int(length)], fields.get("warc-page-id", "")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out = {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type", ""), "url": fields.get("warc-target-uri"), "page_id": int(page) if re.fullmatch(r"-?\d{1,19}", page) and -(1 << 63) <= int(page) < 1 << 63 else None, "said": said}
    if re.fullmatch(r"\d{1,9}", fields.get("warc-segment-number", "")):
        total = fields.get("warc-segment-total-length", "")
        return out | {"origin": fields.get("warc-segment-origin-id", out["record_id"]), "number": int(fields["warc-segment-number"]), "total": int(total) if total.isdigit() else None, "block": block}
    if out["record_type"] == "response":
        out |= decoded(block, said)
        if not wanted:
            out.pop("payload", None)
    return out


def _batch(rows: list[dict[str, object]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows], schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _reads(wanted: bool):
    """Rows are the pieces of archives between version lines, in each archive's order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, torn, last = _arrow(PARTS), None, None
        for batch in slices(batches):
            out = []
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if file != last and torn is not None:
                    out.append({"record_type": "", "fault": "length"})
                    torn = None
                if file == last:
                    torn = piece if torn is None else torn + MARK + piece
                    row = parsed(torn, wanted)
                    if row is not None:
                        out.append(row)
                        torn = None
                last = file  # what comes before the first version line is no record
            yield _batch(out, schema)
        if torn is not None:
            yield _batch([{"record_type": "", "fault": "length"}], schema)

    return work


def _joins(wanted: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(PARTS)
        for batch in slices(batches, 16):
            out = []
            for row in batch.to_pylist():
                parts = row.pop("parts")
                numbers, whole = [p["number"] for p in parts], b"".join(p["block"] for p in parts)
                out.append({n: row.get(n) for n in ("record_id", "page_id", "url", "record_type", "said")})
                if numbers != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(whole):
                    out[-1] |= {"fault": "segments"}
                elif row["record_type"] == "response":
                    out[-1] |= decoded(whole, row["said"])
                    if not wanted:
                        out[-1].pop("payload", None)
            yield _batch(out, schema)

    return work


def read(spark: SparkSession, where: str, payload: bool = True) -> DataFrame:
    """The pages in the archives under `where`: record_id, page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, fault and, if wanted, payload.

    Segments of one origin are gathered, ordered by number, and must be 1, 2, ... up to
    one that states the length of all. A revisit has its digest from its header, and
    bytes and page from the responses of that digest (`refers_to`: the smallest page_id).
    What is broken is returned with its fault: header, length, segments, framing, digest,
    or origin for a revisit of nothing. Records of other types are left out.

    Only segments, and digests with their pages, are shuffled. A group of segments is one
    page, as long as the row that it becomes. A gzip archive is one task's; a plain one
    may be cut anywhere but inside a payload that holds the version line.
    """
    pieces = spark.read.option("lineSep", MARK.decode()).text(where)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    parts = keep(pieces.mapInArrow(_reads(payload), PARTS), "records")
    one = lambda name: F.max(F.when(F.col("number") == 1, F.col(name))).alias(name)
    firsts = [one(n) for n in ("record_id", "page_id", "url", "said")] + [F.coalesce(one("record_type"), F.lit("")).alias("record_type")]
    gathered = parts.where("number IS NOT NULL").groupBy("origin").agg(*firsts, F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))
    whole = gathered.select("record_id", "page_id", "url", "record_type", "said", "parts").mapInArrow(_joins(payload), PARTS)
    kept = ["record_id", "page_id", "url", "record_type", "said", "payload_digest", "payload_bytes", "fault", *["payload"] * payload]
    found = keep(parts.where("number IS NULL").select(kept).unionByName(whole.select(kept)), "pages")
    responses = found.where("record_type = 'response'").drop("said").withColumn("refers_to", F.lit(None).cast("long"))
    origins = found.where("record_type = 'response' AND payload_digest IS NOT NULL").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    again = found.where("record_type = 'revisit'").drop("payload_digest", "payload_bytes").withColumnRenamed("said", "payload_digest").join(origins, "payload_digest", "left")
    again = again.withColumn("fault", F.coalesce("fault", F.when(F.col("payload_bytes").isNull(), F.lit("origin"))))
    broken = found.where("record_type NOT IN ('response', 'revisit') AND fault IS NOT NULL").drop("said").withColumn("refers_to", F.lit(None).cast("long"))
    out = responses.unionByName(again.select(columns_of(responses))).unionByName(broken)
    return out.select("record_id", "page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "fault", *["payload"] * payload)
