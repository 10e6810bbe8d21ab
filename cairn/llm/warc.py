"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the request, the response (or a revisit that refers to
an earlier response with the same payload) and metadata. Request and metadata name
the response's record in WARC-Concurrent-To; ``assemble`` joins them by it and gives
one nested row a capture. Records are gzip members of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_dir, materialise, open_uri
from .workers import releasing

#: Fixed value: the profile of a revisit whose payload is identical.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 256 << 20
SALTS = 32
RECORDS = ("kind string, record_id string, concurrent_to array<string>, refers_to string, uri string, "
           "payload_digest string, payload_bytes long, page_id long, http string")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode('utf-8', 'surrogatepass')).digest(), version=5)}>"


def one_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def capture(row: dict) -> list[bytes]:
    """The records of a page: page_id, url, html, digest (hex SHA-1), nth, first_id, first_url, revisit."""
    page, payload = row["page_id"], (row["html"] or "").encode("utf-8", "surrogatepass")
    uri = quote(row["url"] or f"urn:page:{page}", safe="%:/?#[]@!$&'()*+,;=~")
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    me = record_id("response", page, row["url"], digest, row["nth"])
    at = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    target = urlsplit(uri) if "://" in uri else None
    where = ((target.path or "/") + (f"?{target.query}" if target.query else ""), target.netloc) if target else ("/", "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = [("WARC-Record-ID", me), *at, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if row["revisit"]:
        first = record_id("response", row["first_id"], row["first_url"], digest, 1)
        main = one_record("revisit", [*own, ("WARC-Profile", PROFILE), ("WARC-Refers-To", first)], http)
    else:
        main = one_record("response", own, http + payload)
    beside = [("WARC-Concurrent-To", me), *at]
    fields = "" if page is None else f"page-id: {page}\r\n"
    return [
        one_record("request", [("WARC-Record-ID", record_id("request", me)), *beside, ("Content-Type", "application/http; msgtype=request")],
                   f"GET {where[0]} HTTP/1.1\r\nHost: {where[1]}\r\n\r\n".encode()),
        main,
        one_record("metadata", [("WARC-Record-ID", record_id("metadata", me)), *beside, ("Content-Type", "application/warc-fields")],
                   f"{fields}via: crawl\r\n".encode())]


def write(pages: DataFrame, where: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write a capture for each row of (page_id, url, html); returns the manifest (uri, captures), a committed table.

    Of captures with equal payloads of at least ``min_bytes`` bytes, that of the smallest page_id
    (nulls last) and then smallest url is a response, as are rows that repeat it in full; the others are revisits. A null html is an
    empty payload; an empty table gives no file; other columns play no part. Rows repeated in full get record ids of their own. Payloads meet by digest in a
    join against one row a digest, which the engine splits if one digest has very many rows.
    """
    spark = pages.sparkSession
    where = where or fresh_dir(spark, "warc")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    far = F.lit((1 << 63) - 1)
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(F.struct(
        F.coalesce("page_id", far).alias("k"), F.col("url").alias("u"))).alias("first"))
    same = Window.partitionBy("page_id", "url", "digest").orderBy("bytes")
    nth = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha1(html.cast("binary")).alias("digest"))
    repeats = nth.groupBy("page_id", "url", "digest").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("nth", F.row_number().over(same) if repeats else F.lit(1))
    known = rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", "nth",
        F.when(F.col("first.k") < far, F.col("first.k")).alias("first_id"), F.col("first.u").alias("first_url"),
        (F.col("first").isNotNull() & ((F.coalesce("page_id", far) != F.col("first.k")) | ~F.col("url").eqNullSafe(F.col("first.u")))).alias("revisit"))

    def run(batches):
        import pyarrow as pa

        out = at = None
        n = 0

        def done():
            nonlocal out
            out.close()
            out = None
            return pa.record_batch({"uri": [at], "captures": [n]}, schema=pa.schema([("uri", pa.string()), ("captures", pa.int64())]))

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for row in batch.slice(lo, 512).to_pylist():
                    if out is None:
                        at, n, size = f"{where}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, path = open_uri(at)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                        head = one_record("warcinfo", [("WARC-Record-ID", record_id(at)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")],
                                          b"format: WARC File Format 1.1\r\n")
                        out.write(head)
                    for record in capture(row):
                        size += out.write(record) or len(record)
                    n += 1
                    if size >= ROLL_BYTES:
                        yield done()
        if out is not None:
            yield done()

    return materialise(known.mapInArrow(releasing(run), "uri string, captures long"), "warc-manifest")


def parse(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed stream; lengths alone delimit blocks."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield headers, block


def _row(headers: dict[str, list[str]], block: bytes, payload: bool) -> list | None:
    kind = headers["warc-type"][0]
    if kind not in ("request", "response", "revisit", "metadata"):
        return None
    one = lambda name: headers.get(name, [None])[0]
    digest = n = page = http = body = None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
        digest = (one("warc-payload-digest") or "").rpartition(":")[2] or None
        if kind == "response":
            n, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"{one('warc-record-id')}: payload has digest {found}, its record says {digest}")
            digest = found
        else:
            body = None
            n = next((int(x.split(":")[1]) for x in http.split("\r\n") if x.lower().startswith("content-length:")), None)
    elif kind == "request":
        http = block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
    else:
        page = next((int(x.split(":")[1]) for x in block.decode("utf-8", "replace").split("\r\n") if x.startswith("page-id:")), None)
    out = [kind, one("warc-record-id"), headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), digest, n, page, http]
    return [*out, body] if payload else out


def records(manifest: DataFrame, payload: bool = False) -> DataFrame:
    """The records in the files of a manifest, read as streams; with ``payload`` also the bodies of responses."""
    names = ["kind", "record_id", "concurrent_to", "refers_to", "uri", "payload_digest", "payload_bytes", "page_id", "http", *["payload"] * payload]

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payload]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_uri(uri)
                held: list[list] = []
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        if (row := _row(headers, block, payload)) is not None:
                            held.append(row)
                        if len(held) == (256 if payload else 4096):
                            yield pa.record_batch(list(map(list, zip(*held, strict=True))), schema=schema)
                            held = []
                if held:
                    yield pa.record_batch(list(map(list, zip(*held, strict=True))), schema=schema)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri").repartition(n, "uri").mapInArrow(releasing(run), RECORDS + ", payload binary" * payload)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row for each capture: capture_id, request, response, metadata (structs, null where the archive has none), refers_to_page.

    ``found``: a table of records. Several requests or metadata records of one response: the
    one with the smallest record id counts. Records concurrent to no response are left out;
    a revisit whose response is in no archive has a null refers_to_page.
    """
    main = found.where(F.col("kind").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct(*[c for c in found.columns if c not in ("concurrent_to", "page_id")]).alias("response"))

    def beside(kind: str, *fields: str) -> DataFrame:
        named = found.where(F.col("kind") == kind).select(F.explode("concurrent_to").alias("capture_id"), F.struct("record_id", *fields).alias(kind))
        return named.groupBy("capture_id").agg(F.min(kind).alias(kind))

    whole = main.join(beside("request", "uri", "http"), "capture_id", "left").join(beside("metadata", "page_id"), "capture_id", "left")
    # many captures may refer to one: each page is copied to SALTS places and a capture asks one of them
    asked = found.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("capture_id")).distinct()
    pages = asked.join(beside("metadata", "page_id"), "capture_id").select(
        F.col("capture_id").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("metadata.page_id").alias("refers_to_page"))
    salted = whole.withColumn("own_salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int"))
    return salted.join(pages, (F.col("response.refers_to") == F.col("first")) & (F.col("own_salt") == F.col("salt")), "left").drop("first", "salt", "own_salt")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read the archives back, assemble captures: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An empty table gives an empty result; see write for nulls, ties and repeated rows.
    """
    found = materialise(records(write(pages, min_bytes=min_bytes)), "warc-records")
    return assemble(found).select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"))
