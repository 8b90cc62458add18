"""WARC (3): archives of page captures, and a two-level index over them that is binary-searched before range reads.

The index holds one line for each capture, sorted by reversed-host URL key, page and place, in compressed
blocks. Each range partition of it keeps a sparse directory of its blocks, and a list of the partitions' first
keys stands above these: a search finds the partition, then the block, reads that range, and finds the lines.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, written

#: Payloads from this size on are stored once; smaller ones always.
MIN_BYTES = 0
#: Lines of the index in a block.
BLOCK_LINES = 200
DATE = "2024-01-01T00:00:00Z"
_LINE = "key string, page_id long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The URL's key: host labels reversed and joined by commas, then port, path and query; no scheme or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + tail


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """A WARC record. A revisit (refers_to given) has the HTTP headers but no payload."""
    digest = digest_of(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def parse(data: bytes) -> dict:
    """A record read back. The payload's digest is computed anew where there is a payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = warc["warc-type"]
    stated = warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest_of(payload) != stated:
        raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
    size = len(payload) if kind == "response" else int(_headers(http)["content-length"])
    page, refers = warc.get("page-id"), warc.get("refers-to-page-id")
    return {"page_id": None if page is None else int(page), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": None if refers is None else int(refers), "url": warc.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def typed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: for copies of a payload the smallest page_id that has it.

    Payloads are told apart by SHA-1 over narrow rows; the pages themselves are shuffled once, by page_id.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("hash", F.sha1(F.coalesce("html", F.lit(""))))
    narrow = pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes).select("page_id", "hash")
    first = narrow.groupBy("hash").agg(F.min("page_id").alias("first"))
    copies = narrow.join(first, "hash").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("copy"), F.col("hash").alias("same"), F.col("first").alias("refers_to")).distinct()
    return pages.join(copies, F.col("page_id").eqNullSafe(F.col("copy")) & (F.col("hash") == F.col("same")), "left").select("page_id", "url", "html", "refers_to")


def _writer(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        # a name of this attempt: a task that is run again writes another file, and only its lines count
        name, out, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for pdf in frames:
            rows = []
            for page, url, html, refers in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], strict=True):
                out = out or files.open_output_stream(f"{root}/{name}", compression=None)
                page = None if pd.isna(page) else int(page)
                data = gzip.compress(record(page, url, (html or "").encode(), None if pd.isna(refers) else int(refers)), 6, mtime=0)
                out.write(data)
                rows.append((surt(url), page, name, at, len(data)))
                at += len(data)
            lines = pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"])
            lines["page_id"] = lines["page_id"].astype("Int64")
            yield lines
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes one gzip member a record into archives under the folder; returns the lines of the index, unsorted."""
    spark = pages.sparkSession
    bounded_batches(spark)
    _make(spark, folder)
    return written(typed(pages, min_bytes).mapInPandas(_writer(folder), _LINE), "captures")


def _make(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def _block_writer(folder: str, block_lines: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, at, directory, lines, first, count = None, 0, [], [], None, 0

        def flush():
            nonlocal at, lines
            if lines:
                data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
                out.write(data)
                directory.append([lines[0][0], lines[0][1], at, len(data)])
                at += len(data)
                lines = []

        for pdf in frames:
            for key, page, file, offset, length in zip(pdf["key"], pdf["page_id"], pdf["file"], pdf["offset"], pdf["length"], strict=True):
                out = out or files.open_output_stream(f"{root}/{name}.blocks", compression=None)
                # null pages sort first, as in Spark
                line = [key, -(1 << 63) if pd.isna(page) else int(page), file, int(offset), int(length)]
                first = first or line[:2]
                lines.append(line)
                count += 1
                if len(lines) == block_lines:
                    flush()
        if out:
            flush()
            out.close()
            with files.open_output_stream(f"{root}/{name}.directory", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory, ensure_ascii=False).encode()))
            yield pd.DataFrame({"part": [name], "first_key": [first[0]], "first_page": [first[1]], "captures": [count]})

    return run


def write_index(lines: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the two-level index; returns its top: a row (part, first_key, first_page, captures) for each partition."""
    _make(lines.sparkSession, folder)
    order = ["key", "page_id", "file", "offset"]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.mapInPandas(_block_writer(folder, block_lines), "part string, first_key string, first_page long, captures long"), "index")


def _searcher(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        part, directory, starts, source, held, block = None, [], [], None, None, []
        for pdf in frames:
            rows = []
            for name, key, low, high in zip(pdf["part"], pdf["key"], pdf["low"], pdf["high"], strict=True):
                if name != part:
                    part, held = name, None
                    with files.open_input_stream(f"{root}/{name}.directory", compression=None) as d:
                        directory = json.loads(zlib.decompress(d.read()))
                    starts = [(d[0], d[1]) for d in directory]
                    source = files.open_input_file(f"{root}/{name}.blocks")
                n = max(0, bisect.bisect_left(starts, (key, low)) - 1)
                while n < len(directory) and starts[n] <= (key, high):
                    if held != n:
                        block = json.loads(b"[" + zlib.decompress(source.read_at(directory[n][3], directory[n][2])).replace(b"\n", b",") + b"]")
                        held = n
                    at = bisect.bisect_left(block, [key, low])
                    while at < len(block) and (block[at][0], block[at][1]) <= (key, high):
                        rows.append(block[at])
                        at += 1
                    n += 1
            found = pd.DataFrame(rows, columns=["key", "page_id", "file", "offset", "length"])
            found["page_id"] = found["page_id"].astype("Int64").mask(found["page_id"] == -(1 << 63))
            yield found

    return run


def search(top: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """The lines of the wanted captures: rows (key, low, high), all pages from low to high under a key.

    The top has a row for each partition of the index, as many as its writer had tasks: it is broadcast.
    """
    parts = sorted((r.first_key.encode(), r.first_page, r.part) for r in top.select("part", "first_key", "first_page").toLocalIterator())
    names, firsts = [p[2] for p in parts], [(p[0], p[1]) for p in parts]
    if not names:
        return wanted.sparkSession.createDataFrame([], _LINE)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key, low, high in zip(pdf["key"], pdf["low"], pdf["high"], strict=True):
                a = max(0, bisect.bisect_left(firsts, (key.encode(), low)) - 1)
                b = bisect.bisect_right(firsts, (key.encode(), high))
                rows += [(names[k], key, low, high) for k in range(a, b)]
            yield pd.DataFrame(rows, columns=["part", "key", "low", "high"])

    routed = wanted.mapInPandas(route, "part string, key string, low long, high long")
    routed = routed.repartitionByRange("part", "key", "low").sortWithinPartitions("part", "key", "low")
    return routed.mapInPandas(_searcher(folder), _LINE)


def _reader(folder: str, payloads: bool):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["url", "payload"] * payloads]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = arrow_fs.FileSystem.from_uri(folder)
        name, source = None, None
        for pdf in frames:
            rows = []
            for file, offset, length in zip(pdf["file"], pdf["offset"], pdf["length"], strict=True):
                if file != name:
                    name, source = file, files.open_input_file(f"{root}/{file}")
                found = parse(gzip.decompress(source.read_at(length, offset)))
                rows.append([found[c] for c in columns])
            out = pd.DataFrame(rows, columns=columns)
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([None if x is None or pd.isna(x) else int(x) for x in (r[columns.index(c)] for r in rows)], dtype="Int64")
            yield out

    return run


def read_records(lines: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records at the lines' ranges; each file is read in the order of its offsets."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    ranged = lines.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInPandas(_reader(folder, payloads), schema)


def url_keys(df: DataFrame, url: str = "url") -> DataFrame:
    """df with the column key: the reversed-host key of a URL."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(key=[surt(u) for u in pdf[url]])

    return df.drop("key").mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.drop("key").dtypes) + ", key string")


def archive(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, str, str]:
    """Writes archives and index into the shared folder: the index's top, the folder of the index, that of the archives."""
    spark = pages.sparkSession
    archives, index = new_path(spark, "archives"), new_path(spark, "cdx")
    return write_index(write_archives(pages, archives, min_bytes), index), index, archives


def captures(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes every page as a record, finds every record through the index and reads it back.

    Null html is an empty payload; a null or odd URL is its own key; very long payloads are one record. Rows
    repeated with one page_id and payload are all responses, or all revisits; rows without a page_id revisit
    the payload's smallest page_id, if any row has one. An empty table gives an empty result. Columns other
    than page_id, url and html are not stored.
    """
    top, index, archives = archive(pages, min_bytes)
    asked = url_keys(pages.select(F.col("page_id").cast("long").alias("page_id"), "url").distinct())
    least = F.lit(-(1 << 63)).cast("long")
    wanted = asked.select("key", F.coalesce("page_id", least).alias("low"), F.coalesce("page_id", least).alias("high")).distinct()
    return read_records(search(top, index, wanted), archives)


def query(spark, sf_dir: str) -> DataFrame:
    return captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
