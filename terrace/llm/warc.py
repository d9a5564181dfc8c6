"""Deterministic sharded WARC writer, and a reader for its archives.

1. One pass digests the payloads (SHA-1, base32) and counts their bytes by range
   of page_id.  Of records with equal payloads the one with the largest page_id is
   the response and the others revisit it; the groups are aggregated partially
   before they are shuffled, and which page revisits which goes to the shards as
   narrow rows of their own, so that payloads are shuffled once.
2. Shards are stretches of the order by page_id and payload digest.  The narrow digest
   rows are range-sorted and their bytes summed along the order, so the first key of
   every shard depends on the records alone, not on sampling or on the number of
   executors.  A shard has ``SHARD`` bytes of payload, or more where there would be over
   ``MOST_SHARDS`` shards, so the table of first keys stays bounded.  Only a key that is
   repeated for more than ``HEAVY`` shards is dealt out, among the shards it fills; its
   records are alike but for the url, and which of them lies where is not fixed.
3. Each shard is sorted and written by one task, which regenerates all headers and
   digests, compresses every record as its own gzip member (no time stamp), and rolls
   to the next file once a file has reached ``ROLL`` compressed bytes.  Files get
   temporary names that no other attempt uses; a task that is run again writes again.
4. The rows of the tasks that succeeded form the manifest (a written table).  A second
   job renames the files it names, which may be repeated safely, and ``_SUCCESS``
   marks the archive as whole.

Defined cases: a null or empty page is an empty payload and takes part like any
other; a null page_id is written as an empty id and never preferred as response;
of repeated rows of the largest page_id the first in sort order is the response; where
no record of equal payloads has a page_id, there is nothing to refer to and all are
responses; an empty table writes no file and an empty manifest; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

#: Payload bytes of a shard, and compressed bytes after which a file is closed.
SHARD = 32 << 20
ROLL = 4 << 20
MOST_SHARDS = 100_000
HEAVY = 32
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "shard long, sequence int, path string, temporary string, bytes long, records long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, digest: str) -> str:
    """A record id that depends on the record alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _member(lines: list[str], body: bytes) -> bytes:
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip without time or name
    return squeeze.compress(head.encode() + body + b"\r\n\r\n") + squeeze.flush()


def _clean(text: str | None) -> str:
    """A header value may not hold line breaks."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of the response of page ``refers_to``."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uri(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        return _member([*lines, "Content-Type: application/http; msgtype=response"], http)
    block = http + payload
    lines.append(f"WARC-Block-Digest: sha1:{payload_digest(block)}")
    return _member([*lines, "Content-Type: application/http; msgtype=response"], block)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [p or b"" for p in batch.column(1).cast(pa.binary()).to_pylist()]
        digests = [hashlib.sha1(p).digest() for p in payloads]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(map(len, payloads), pa.int64())], ["page_id", "digest", "size"])


def _key(page_id: int | None, digest: bytes) -> tuple:
    """The order of the archive, null first."""
    return (page_id is not None, page_id or 0, digest)


def shard_starts(digests: DataFrame, shard: int) -> list[tuple[tuple, int, int]]:
    """(first key, shard, how many shards the key fills) in the archive's order; at most about ``MOST_SHARDS`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            before = []
            for size in batch.column(2).to_pylist():
                before.append(total)
                total += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(before), pa.int32()), pa.array(before, pa.int64())], ["page_id", "digest", "bytes", "part", "before"])

    keys = digests.groupBy("page_id", "digest").agg(F.sum(F.col("size") + 512).alias("bytes"))
    order = [F.asc_nulls_first("page_id"), F.asc("digest")]
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.mapInArrow(run, "page_id long, digest binary, bytes long, part int, before long"), "warc-order")
    sums = {r["part"]: r["bytes"] for r in ranged.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()}  # one row a range
    if not sums:
        return []
    shard, starts = max(shard, -(-sum(sums.values()) // MOST_SHARDS)), [0]
    for part in range(max(sums)):
        starts.append(starts[-1] + sums.get(part, 0))
    before = F.col("before") + F.element_at(F.array(*[F.lit(x) for x in starts]).cast("array<bigint>"), F.col("part") + 1)
    at = ranged.select("page_id", "digest", F.floor(before / shard).cast("long").alias("shard"), F.floor((before + F.col("bytes") - 1) / shard).cast("long").alias("last"))
    first = at.groupBy("shard").agg(F.min(F.struct("page_id", "digest", "last")).alias("k")).select("shard", "k.*")
    heavy = at.where(F.col("last") - F.col("shard") >= HEAVY).select("shard", "page_id", "digest", "last")
    rows = first.unionByName(heavy).distinct().collect()  # at most two rows a shard
    many = lambda r: r["last"] - r["shard"] + 1 if r["last"] - r["shard"] >= HEAVY else 1
    return sorted((_key(r["page_id"], bytes(r["digest"])), r["shard"], many(r)) for r in rows)


def _placed(rows: DataFrame, starts: list[tuple[tuple, int, int]]) -> DataFrame:
    """Adds ``shard``; pages of a key that fills several shards are dealt out, its notes go to each."""
    keys = [k for k, _, _ in starts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = 0
        for batch in batches:
            take, shards = [], []
            for row, (page, digest, is_page) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("page_id", "digest", "is_page")), strict=True)):
                key = _key(page, digest)
                at = bisect.bisect_right(keys, key) - 1
                first, parts = starts[at][1:]
                if parts > 1 and keys[at] != key:  # a later key that starts in the last shard of a heavy one
                    first, parts = first + parts - 1, 1
                if parts > 1 and not is_page:
                    take += [row] * parts
                    shards += range(first, first + parts)
                    continue
                take.append(row)
                shards.append(first + dealt % parts)
                dealt += parts > 1
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(take, pa.int64())).columns, pa.array(shards, pa.int64())], [*batch.schema.names, "shard"])

    return rows.mapInArrow(run, "page_id long, digest binary, is_page boolean, url string, html string, response long, shard long")


def write_archive(pages: DataFrame, path: str, shard: int = SHARD, roll: int = ROLL, least: int = 0) -> DataFrame:
    """Write all pages (page_id, url, html) as archives under ``path``; the committed manifest. Equal payloads of under ``least`` bytes are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digests = materialize(rows.select("page_id", "html").mapInArrow(_digested, "page_id long, digest binary, size long"), "payload-digests")
    groups = digests.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    shared = groups.where("n > 1").select("digest", "response")
    starts = shard_starts(digests, shard)
    # Whose payload is shared is noted in narrow rows that travel to the page's shard and sort before it, so payloads are shuffled once.
    notes = digests.select("page_id", "digest").distinct().join(shared, "digest")
    notes = notes.select("page_id", "digest", F.lit(False).alias("is_page"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "response")
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = rows.select("page_id", F.unhex(F.sha1(payload.cast("binary"))).alias("digest"), F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("response"))
    placed = _placed(keyed.unionByName(notes), starts)
    n_shards = max((at + parts for _, at, parts in starts), default=1)
    # A response that fills several shards is one in its first shard only.
    origin = {key: at for key, at, parts in starts if parts > 1}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        files.create_dir(base, recursive=True)
        out, state, answered, noted = [], None, set(), (None, None, None)

        def close() -> None:
            if state is not None:
                state["stream"].close()
                out.append((state["shard"], state["sequence"], f"{state['shard']:016x}-{state['sequence']:05d}.warc.gz", state["name"], state["bytes"], state["records"], state["sha"].hexdigest()))

        for batch in batches:
            columns = [batch.column(n) for n in ("shard", "page_id", "digest", "is_page", "url", "html", "response")]
            columns[5] = columns[5].cast(pa.binary())
            for shard_no, page, digest, is_page, url, html, response in zip(*(c.to_pylist() for c in columns), strict=True):
                if not is_page:
                    noted = (page, digest, response)
                    continue
                if state is None or state["shard"] != shard_no or state["bytes"] >= roll:
                    sequence = state["sequence"] + 1 if state is not None and state["shard"] == shard_no else 0
                    close()
                    name = f"_temporary-{uuid.uuid4().hex}"
                    state = {"shard": shard_no, "sequence": sequence, "name": name, "stream": files.open_output_stream(f"{base}/{name}"), "bytes": 0, "records": 0, "sha": hashlib.sha256()}
                refers = noted[2] if noted[:2] == (page, digest) else None
                encoded = base64.b32encode(digest).decode()
                if refers == page and (page, digest) not in answered and origin.get(_key(page, digest), shard_no) == shard_no:
                    answered.add((page, digest))  # one entry for each response that is shared: they lie next to each other
                    refers = None
                data = record(page, url, html or b"", encoded, refers)
                state["stream"].write(data)
                state["sha"].update(data)
                state["bytes"] += len(data)
                state["records"] += 1
                if len(answered) > 10_000:
                    answered = {(page, digest)}
        close()
        names = ["shard", "sequence", "path", "temporary", "bytes", "records", "sha256"]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names)

    ordered = placed.select("shard", "page_id", "url", "html", "digest", "is_page", "response").repartitionById(n_shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "is_page", "url")
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "warc-manifest")
    commit(manifest, path)
    return manifest


def commit(manifest: DataFrame, path: str) -> None:
    """Give the files of the manifest their names; may be run again."""

    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = fs.FileSystem.from_uri(path)
        for frame in frames:
            for name, temporary in zip(frame["path"], frame["temporary"], strict=True):
                if files.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    files.move(f"{base}/{temporary}", f"{base}/{name}")
            yield frame[["path"]]

    done = manifest.select("path", "temporary").mapInPandas(rename, "path string").count()
    files, base = fs.FileSystem.from_uri(path)
    files.create_dir(base, recursive=True)
    for left in files.get_file_info(fs.FileSelector(base)):  # of attempts that failed
        if left.base_name.startswith("_temporary-"):
            files.delete_file(left.path)
    with files.open_output_stream(f"{base}/_SUCCESS") as mark:
        mark.write(f"{done} files\n".encode())


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive, one gzip member at a time."""
    unpack, held, data = zlib.decompressobj(31), [], stream.read(1 << 20)
    while data:
        held.append(unpack.decompress(data))
        if unpack.eof:
            data = unpack.unused_data or stream.read(1 << 20)
            whole = b"".join(held)
            head, _, rest = whole.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            if rest[size:] != b"\r\n\r\n":
                raise ValueError(f"record of {len(rest)} bytes says it has {size}")
            yield fields, rest[:size]
            unpack, held = zlib.decompressobj(31), []
        else:
            data = stream.read(1 << 20)
    if held:
        raise ValueError("an archive ends inside a record")


def read_archive(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; digests of responses are computed anew and compared."""

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for fields, block in parse(stream):
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                        if fields["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if payload_digest(payload) != digest or len(payload) != size:
                                raise ValueError(f"{name}: digest of {fields['WARC-Record-ID']} differs")
                        page, refers = fields["X-Page-ID"], fields.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, size, digest, fields["WARC-Type"], int(refers) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    paths = manifest.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, RECORDS)  # a task a file


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back."""
    spark: SparkSession = pages.sparkSession
    path = path or new_path(spark, "warc")
    return read_archive(write_archive(pages, path), path)
