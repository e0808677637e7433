"""Deterministic sharded WARC archives, and their reader.

Every record has a place: a response the digest of its payload, a revisit a digest of its
page. Shards are equal ranges of the places, as many as the payloads' bytes ask for, so they
hold equal parts of the records whatever the pages and the session are. A task sorts its
shard by place, writes records as gzip members with headers and digests made from the
payload, and rolls a file when its compressed size reaches ``roll_bytes``. A file is written
under a temporary name of the attempt and renamed when whole; a lost or repeated task renames
the same bytes to the same name. The manifest, a table with a row for each file, is written
after all files, and readers take only files that it names.

Of records with equal payloads of at least ``min_revisit_bytes``, that of the smallest
page_id (null last, then url) is the response; the others are revisits without payload.
Pages are hashed once into a staged table of (page_id, url, digest, size), which says how
many share a payload and which is first. Of a payload that more pages share than
LEAST_HOT and 1 / MOST_HOT of all, only the first page is compressed; of others, one for each
block that holds the payload. Rows that refer to a payload carry digests only, and meet their
first through ``skew.attach``, so a payload of a third of all pages costs no task more than others.

Archives are written by Arrow's file systems (file, hdfs, s3, gs, abfs and Spark's names for
these). Null html is the empty payload, a null url gives no target URI, a null page_id no
page. Rows that repeat page_id, url and html are records of their own. A payload is whole in
its task, whatever its length; an empty table gives an empty manifest and no rows. Other
columns of pages are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.skew import attach
from weftline.staging import new_path, stage

MIN_REVISIT_BYTES = 0
ROLL_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
#: A shard holds SMALL_SHARD bytes of payloads, and FEW_SHARDS of these and more so much that each SHARD bytes add one.
SMALL_SHARD, FEW_SHARDS, SHARD = 8 << 20, 64, 256 << 20
#: Payloads of which only the first page is compressed: fewer than MOST_HOT.
LEAST_HOT, MOST_HOT = 16, 10_000
#: Bytes read at once from an archive.
_READ = 1 << 20
_MANIFEST = "manifest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return "" if url is None else "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hex=key[:32])}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _head(kind: str, key: str, page: int | None, url: str | None, digest: str, block: bytes, date: str) -> list[tuple[str, str]]:
    named = [("WARC-Target-URI", _uri(url))] if url is not None else []
    page_id = [("WARC-Page-ID", str(page))] if page is not None else []
    return [("WARC-Type", kind), ("WARC-Record-ID", _id(key)), ("WARC-Date", date), *named, *page_id, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http;msgtype=response")]


def response(key: str, page: int | None, url: str | None, payload: bytes, date: str = DATE, level: int = LEVEL) -> bytes:
    """A response record as a gzip member."""
    block = _http(len(payload)) + payload
    return _member(_head("response", key, page, url, base32_sha1(payload), block, date), block, level)


def revisit(key: str, page: int | None, url: str | None, digest: str, size: int, to_key: str, to_page: int | None, to_url: str | None, date: str = DATE, level: int = LEVEL) -> bytes:
    """A revisit record: the response's headers without its payload."""
    block = _http(size)
    to = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(to_key))]
    to += [("WARC-Refers-To-Target-URI", _uri(to_url))] if to_url is not None else []
    to += [("WARC-Refers-To-Date", date)] + ([("WARC-Refers-To-Page-ID", str(to_page))] if to_page is not None else [])
    return _member(_head("revisit", key, page, url, digest, block, date) + to, block, level)


def _key(page: str, url: str, sha: str, copy: Column) -> Column:
    """Hex record id of a row: uniform, and the same in every run."""
    return F.sha1(F.to_json(F.struct(F.col(page).alias("p"), F.col(url).alias("u"), F.col(sha).alias("s"), copy.alias("n"))).cast("binary"))


def _order(page: str, url: str) -> Column:
    return F.struct(F.col(page).isNull().alias("no_page"), F.col(page).alias("page_id"), F.col(url).isNull().alias("no_url"), F.col(url).alias("url"))


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def _responses(batches: Iterator[pa.RecordBatch], level: int, date: str, least: int) -> Iterator[pa.RecordBatch]:
    """Response records; of payloads that repeat in a batch, that of the first page only."""
    for b in batches:
        first: dict[str, tuple] = {}
        rows = list(zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "key")), strict=True))
        for i, (page, url, html, sha, _) in enumerate(rows):
            order = page is None, page or 0, url is None, (url or "").encode()
            group = sha if len((html or "").encode()) >= least else f"{sha}:{i}"
            if group not in first or order < first[group][0]:
                first[group] = order, i
        kept = sorted(i for _, i in first.values())
        members = [response(rows[i][4], rows[i][0], rows[i][1], (rows[i][2] or "").encode(), date, level) for i in kept]
        yield pa.RecordBatch.from_arrays([*(pa.array([rows[i][c] for i in kept], t) for c, t in ((0, pa.int64()), (1, pa.string()), (3, pa.string()), (4, pa.string()))), pa.array(members, pa.binary())], names=["page_id", "url", "sha", "key", "member"])


def _keyed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with html, sha and size; staged keys: page_id, url, sha, size, n rows and place)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.col("html").alias("html"))
    rows = rows.withColumn("sha", F.sha1(_payload("html"))).withColumn("size", F.octet_length(_payload("html")).cast("long"))
    keys = stage(rows.groupBy("page_id", "url", "sha", "size").agg(F.count(F.lit(1)).alias("n")), "keys")
    return rows, keys.withColumn("place", _order("page_id", "url"))


_MEMBER = "page_id long, url string, sha string, key string, member binary"


def records(rows: DataFrame, keys: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Records by their place ``at``: key and member; for revisits also page_id, url, sha, size, to_key, to_page, to_url.

    A response stands at its payload's digest. Blocks that hold the same payload may each send one, and of those with the
    same ``at`` and sha the one of least ``place`` is the record.
    """
    firsts = stage(keys.filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min("place").alias("first"), F.sum("n").alias("pages"), F.count(F.lit(1)).alias("n")), "firsts")
    joined = attach(keys.filter(F.col("size") >= min_revisit_bytes), firsts.select("sha", "first"), "sha", firsts.select("sha", "n"))
    repeats = joined.withColumn("from", F.when(F.col("place") == F.col("first"), 1).otherwise(0)).filter("n > `from`")
    repeats = repeats.select("page_id", "url", "sha", "size", F.col("first.page_id").alias("to_page"), F.col("first.url").alias("to_url"), F.explode(F.sequence(F.col("from"), (F.col("n") - 1).cast("int"))).alias("copy"))
    repeats = repeats.withColumn("key", _key("page_id", "url", "sha", F.col("copy"))).withColumn("to_key", _key("to_page", "to_url", "sha", F.lit(0)))
    total = firsts.agg(F.sum("pages")).first()[0] or 0
    hot = firsts.filter(F.col("pages") > max(LEAST_HOT, total // MOST_HOT)).select("sha", F.col("first.page_id").alias("p"), F.col("first.url").alias("u"))
    hot = F.broadcast(hot.select("sha", _key("p", "u", "sha", F.lit(0)).alias("first_key")))
    made = rows.filter(F.col("size") >= min_revisit_bytes).withColumn("key", _key("page_id", "url", "sha", F.lit(0))).join(hot, "sha", "left")
    made = made.filter(F.col("first_key").isNull() | (F.col("first_key") == F.col("key"))).select("page_id", "url", "html", "sha", "key")
    made = made.mapInArrow(lambda it: _responses(it, level, date, min_revisit_bytes), _MEMBER)
    out = made.select("key", "sha", "member", F.col("sha").alias("at"), _order("page_id", "url").alias("place"))
    out = out.unionByName(repeats.select("key", F.col("key").alias("at"), "page_id", "url", "sha", "size", "to_key", "to_page", "to_url"), allowMissingColumns=True)
    if min_revisit_bytes > 0:
        short = rows.filter(F.col("size") < min_revisit_bytes).groupBy("page_id", "url", "html", "sha").agg(F.count(F.lit(1)).alias("n"))
        short = short.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
        short = short.withColumn("key", _key("page_id", "url", "sha", F.col("copy"))).select("page_id", "url", "html", "sha", "key")
        alone = short.mapInArrow(lambda it: _responses(it, level, date, min_revisit_bytes), _MEMBER)
        out = out.unionByName(alone.select("key", F.col("key").alias("at"), "member"), allowMissingColumns=True)
    return out


def shards_for(size: int) -> int:
    """Shards for so many bytes of payloads."""
    return max(1, min(-(-size // SMALL_SHARD), FEW_SHARDS + size // SHARD))


#: What Spark calls a scheme, and what Arrow does. Fixed values.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasb": "abfs", "wasbs": "abfss"}


def _fs(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    return fs.FileSystem.from_uri(_SCHEMES.get(scheme, scheme) + colon + rest)


def write(pages: DataFrame, path: str | None = None, shards: int | None = None, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, level: int = LEVEL) -> str:
    """Writes archives and their manifest under ``path`` (a folder that all executors reach; a new one in the shared folder, if not given) and returns it."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows, keys = _keyed(pages)
    shards = shards or shards_for(keys.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0)
    made = records(rows, keys, min_revisit_bytes, date, level)
    shard = F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * shards / F.lit(1 << 32)).cast("int")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        fs.create_dir(base, recursive=True)
        done, out = [], None

        def close():
            nonlocal out
            stream, temporary, name, stat = out
            stream.close()
            try:
                fs.move(temporary, f"{base}/{name}")
            except OSError:  # some stores don't replace: another attempt has put the same bytes there
                if fs.get_file_info(f"{base}/{name}").size != stat[1]:
                    raise
                fs.delete_file(temporary)
            done.append((name, *stat[:2], stat[2].hexdigest()))
            out = None

        at, number, last = None, 0, None
        for b in batches:
            for row in b.to_pylist():
                if row["sha"] is not None and row["member"] is not None:
                    if row["sha"] == last:
                        continue
                    last = row["sha"]
                if out and (row["shard"] != at or out[3][1] >= roll_bytes):
                    close()
                if row["shard"] != at:
                    at, number = row["shard"], 0
                if not out:
                    name = f"shard-{at:05d}-of-{shards:05d}-{number:04d}.warc.gz"
                    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out, number = (fs.open_output_stream(temporary, compression=None), temporary, name, [0, 0, hashlib.sha1()]), number + 1
                member = row["member"] if row["member"] is not None else revisit(row["key"], row["page_id"], row["url"], base64.b32encode(bytes.fromhex(row["sha"])).decode(), row["size"], row["to_key"], row["to_page"], row["to_url"], date, level)
                out[0].write(member)
                out[3][0] += 1
                out[3][1] += len(member)
                out[3][2].update(member)
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha1"])

    placed = made.withColumn("shard", shard).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "at", "place").drop("place")
    placed.mapInArrow(save, "file string, records long, bytes long, sha1 string").write.mode("overwrite").parquet(f"{path}/{_MANIFEST}")
    _sweep(path)
    return path


def _sweep(path: str) -> None:
    """Deletes what lost attempts left under temporary names."""
    from pyarrow import fs as files

    fs, base = _fs(path)
    for f in fs.get_file_info(files.FileSelector(base)):
        if f.type == files.FileType.File and f.base_name.startswith(".shard-"):
            fs.delete_file(f.path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a stream of gzip members."""
    left, z, data = b"", None, bytearray()
    while True:
        piece = left or stream.read(_READ)
        if not piece:
            if z is not None:
                raise ValueError("a record ends early")
            return
        z = z or zlib.decompressobj(31)
        data += z.decompress(piece)
        left = z.unused_data
        if z.eof:
            head, _, block = bytes(data).partition(b"\r\n\r\n")
            first, *named = head.decode().split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in named)}
            if not first.startswith("WARC/") or len(block) != int(headers["content-length"]) + 4:
                raise ValueError("not a WARC record")
            yield headers, block[:-4]
            z, data = None, bytearray()


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits) of all records that the manifest names. Digests are verified."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _fs(path)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            for file in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for h, block in parse(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        whole = h["warc-type"] == "response"
                        if h["warc-block-digest"] != "sha1:" + base32_sha1(block) or whole and digest != base32_sha1(payload):
                            raise ValueError(f"{file}: digest of {h['warc-record-id']}")
                        size = int(http.decode().lower().split("content-length:")[1].split()[0])
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        rows.append((number("warc-page-id"), h.get("warc-target-uri"), size, digest, h["warc-type"], number("warc-refers-to-page-id"), payload if whole else None))
                        held += len(block)
                        if held > _READ * 4:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.read.parquet(f"{path}/{_MANIFEST}").select("file")
    return files.repartition(max(1, files.count()), "file").mapInArrow(load, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
