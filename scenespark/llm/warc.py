"""A deterministic sharded WARC writer and its reader.

Records are dealt into ranges of their key (id and payload digest) of about equal bytes,
and each range is written in order by one task at a time, one gzip member a record. A file is closed
when its compressed size passes `roll_bytes`. Headers, ids and digests are regenerated
from the record alone, so a second run writes the same bytes. Each attempt of a task
writes under a name of its own; the manifest, a table that Spark commits, names the
attempts that count, and only those files are renamed to their final names; what lost
attempts left is swept away after that. Payloads that repeat become revisit records without payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_keys, new_path, range_bounds, range_code

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("5f1c1f5e-3a55-5f0e-8a3a-6a1f6c7c2b11")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _uri(url: str | None, page_id: int | None) -> str:
    """A URI without white space or control characters; pages without one get a name."""
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{'' if page_id is None else page_id}"


def _id(kind: str, page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{kind} {page_id} {digest} {copy}')}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, refers_url: str | None, copy: int = 0) -> bytes:
    """One record; payload None: a revisit. copy: number of equal records before it."""
    http = _HTTP.format(size).encode()
    block = http + (payload or b"")
    kind = "revisit" if payload is None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_id(kind, page_id, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {size}",
    ]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id('response', refers_to, digest, 0)}", f"WARC-Refers-To-Target-URI: {_uri(refers_url, refers_to)}"]
        head += [f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a URI (file, hdfs, s3, gs), as each task opens it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(\w+):/*", r"\1:///", uri) if re.match(r"\w+:", uri) else f"file://{uri}")


_MANIFEST = "range int, file string, attempt string, records long, bytes long, sha256 string"


def _writer(folder: str, roll_bytes: int, level: int):
    """Rows in order of range, key and kind to files; the manifest's rows come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        attempt = uuid.uuid4().hex
        state: dict = {"range": None, "out": None, "number": 0}
        done: list[tuple] = []

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                done.append((state["range"], state["name"], state["temporary"], state["records"], state["bytes"], state["hash"].hexdigest()))
                state["out"] = None

        def put(member: bytes, at: int) -> None:
            if state["range"] != at:
                close()
                state.update(range=at, number=0)
            if state["out"] is None:
                name = f"part-{at:06d}-{state['number']:06d}.warc.gz"
                state.update(name=name, temporary=f"_temporary-{attempt}-{name}", number=state["number"] + 1, records=0, bytes=0, hash=hashlib.sha256())
                state["out"] = fs.open_output_stream(f"{base}/{state['temporary']}", compression=None)
            state["out"].write(member)
            state["hash"].update(member)
            state["records"] += 1
            state["bytes"] += len(member)
            if state["bytes"] >= roll_bytes:
                close()

        links: dict = {}  # of the page at hand: digest -> (refers_to, its url)
        page, copies, now = (), {}, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("range", "page_id", "kind", "digest", "refers_to", "refers_url", "url")}
            html = b.column("html")
            for i, at in enumerate(cols["range"]):
                here = (at, cols["page_id"][i])
                if here != now:
                    links, copies, now = {}, {}, here
                digest = cols["digest"][i]
                if cols["kind"][i] == 0:  # what Spark has found out about this page's payload
                    links[digest] = (cols["refers_to"][i], cols["refers_url"][i])
                    continue
                payload = html[i].as_buffer().to_pybytes()
                copy = copies[digest] = copies.get(digest, -1) + 1
                to = links.get(digest)
                first = to is None or (to[0] == cols["page_id"][i] and copy == 0)
                data = record(cols["page_id"][i], cols["url"][i], payload if first else None, digest, len(payload), None if first else to[0], None if first else to[1], copy)
                put(gzip.compress(data, level, mtime=0), at)
            if done:
                yield _manifest(done)
                done.clear()
        close()
        if done:
            yield _manifest(done)

    return run


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["range", "file", "attempt", "records", "bytes", "sha256"])


def _committer(folder: str):
    """Renames the manifest's files to their final names; done twice, it does nothing the second time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for b in batches:
            for file, attempt in zip(b.column("file").to_pylist(), b.column("attempt").to_pylist()):
                if fs.get_file_info(f"{base}/{attempt}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{attempt}", f"{base}/{file}")
                elif fs.get_file_info(f"{base}/{file}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(f"neither {attempt} nor {file} in {folder}")
            yield b

    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = 8 << 20, ranges: int | None = None, least_bytes: int = 100, level: int = 6) -> DataFrame:
    """Write a record for each row to folder/part-RANGE-NUMBER.warc.gz and return the manifest, which is kept in folder/_manifest.

    Of rows with equal payloads of least_bytes or more, that with the least id is a
    response and the others revisit it; all smaller payloads are responses. A null payload
    is empty; a null id comes last and is no least id unless there is no other; of rows
    with equal id and payload one is the response. A null url gets a urn. An empty table
    gives an empty manifest. Payloads are shuffled once: what is known of a repeated one
    travels beside it, under the same key. Rows of one id, or without one, lie in several
    ranges where they are many. A payload is held whole by the task that writes it; other
    columns of pages are not read. A folder whose manifest is there has been written: a
    call that was stopped after that is finished by resume(), or by calling this again.
    """
    if _written(pages.sparkSession, folder):
        return resume(pages.sparkSession, folder)
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    ids = rows.select("page_id", "digest", "url", F.octet_length("html").alias("bytes")).where(F.col("bytes") >= least_bytes)
    # The least id and url of each payload: partial aggregates, so a payload of very many pages is combined first.
    groups = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    members = cut(ids.join(groups, "digest"), "warc_members")
    firsts = members.where(F.col("page_id").eqNullSafe(F.col("refers_to"))).groupBy("digest").agg(F.min(F.coalesce("url", F.lit(""))).alias("refers_url"))
    links = members.select("page_id", "digest", "refers_to").distinct().join(firsts, "digest")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    links = links.select("page_id", F.lit(0).alias("kind"), "digest", "refers_to", "refers_url", none("string", "url"), none("binary", "html"))
    both = links.unionByName(rows.select("page_id", F.lit(1).alias("kind"), "digest", none("long", "refers_to"), none("string", "refers_url"), "url", "html"))
    null, key = id_keys(rows, "page_id")
    keyed = lambda df: df.withColumns({"k0": null, "k1": key})
    keys = ["k0", "k1", "digest"]
    bounds = range_bounds(keyed(rows), keys, F.octet_length("html"), ranges)
    both = keyed(both).withColumn("range", F.shiftright(range_code(bounds, *keys), 1) if bounds else F.lit(0))
    both = both.repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("range", F.col("page_id").asc_nulls_last(), "kind", "digest", F.col("url").asc_nulls_last())
    # Spark's own commit decides which attempts are in this table; their files, and no others, get final names.
    manifest = both.mapInArrow(_writer(folder, roll_bytes, level), _MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return resume(pages.sparkSession, folder)


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether the manifest is complete; one without its mark is from a call that was stopped while it wrote."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_manifest/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def resume(spark: SparkSession, folder: str) -> DataFrame:
    """Give the manifest's files their final names and delete what is left over; returns the manifest. Done again, it changes nothing."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    manifest.mapInArrow(_committer(folder), _MANIFEST).count()
    sweep(spark, folder)
    return manifest


def sweep(spark: SparkSession, folder: str) -> int:
    """Delete what attempts without a place in the manifest have left; how many files those were. Committed files have their final names by then."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_temporary-*")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    left = fs.globStatus(pattern) or []
    return sum(fs.delete(f.getPath(), False) for f in left)


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _records(content: bytes, with_payload: bool) -> Iterator[tuple]:
    """The records of one archive, one at a time."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as f:
        while line := f.readline():
            if line in (b"\r\n", b"\n"):
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                head[name.lower()] = value.strip()
            block = f.read(int(head["content-length"]))
            if "sha256:" + hashlib.sha256(block).hexdigest() != head["warc-block-digest"]:
                raise ValueError(f"block digest of {head['warc-record-id']}")
            digest, kind = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"]
            payload, size = None, int(head["x-payload-length"])
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                size = len(payload)
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest of {head['warc-record-id']}")
            whole = lambda name: int(head[name]) if name in head else None
            yield whole("x-page-id"), head["warc-target-uri"], kind, size, digest, whole("x-refers-to-page"), payload if with_payload else None


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of a folder's committed archives, their digests checked; a revisit has no payload of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for content in b.column("content"):
                for row in _records(content.as_buffer().to_pybytes(), with_payload):
                    out.append(row)
                    size += 256 + len(row[6] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return files.select("content").mapInArrow(run, _RECORD)


def unverified(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the manifest that are missing or whose bytes differ from it."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))
    return manifest.join(found, ["file", "sha256"], "left_anti")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = 8 << 20) -> DataFrame:
    """pages written to archives in the shared folder and read back."""
    folder = new_path(pages.sparkSession, "warc")
    write_warc(pages, folder, id_col, url, html, roll_bytes)
    return read_warc(pages.sparkSession, folder, with_payload=False)
