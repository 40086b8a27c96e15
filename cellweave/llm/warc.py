"""WARC archives: deduplicating writer, and a reader that verifies record boundaries by their chain.

Reader: tasks scan byte ranges for the record magic and emit, for every
candidate, the offset of the record that would follow it. A payload can hold
the magic too, so a candidate counts only if the chain from the file's start
reaches it. Within a range the chains are shortened by pointer doubling to the
first offset past the range; between ranges pointers are doubled by joins, so
the rounds grow with the logarithm of the ranges in the largest file.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize

MAGIC = b"WARC/1.0\r\n"
#: Bytes of an archive, of a range that one task scans, and of what is read at once past a range for a header that crosses its end.
FILE_BYTES, RANGE_BYTES, HEAD_BYTES = 64 << 20, 8 << 20, 16 << 10
#: Payloads of fewer bytes are always stored.
LEAST_BYTES = 100
#: Repeated digests that are broadcast; more are shuffled.
BROADCAST_ROWS = 200_000

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"


def _storage(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_bytes(page_id, url, payload: bytes, digest: str, refers) -> bytes:
    """One record; a revisit keeps headers only, and names the record that holds the payload."""
    block = _HTTP + (payload if refers is None else b"")
    fields = [
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-￿]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url or ""),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return MAGIC + "\r\n".join([*fields, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Write every row to archives in ``folder``; returns the manifest (path, size, n).

    Of rows with equal payloads of at least 100 bytes the smallest page_id is
    stored, the others revisit it. Names are unique to a task attempt and only
    finished attempts are in the manifest, so a lost executor leaves at most
    files that nobody lists. A null payload is empty; a null page_id never
    stands for others unless every copy has none; rows that repeat a page_id
    and its payload are all stored.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None).cast("string")).alias("url"), body.alias("html"), F.sha2(body, 256).alias("digest"))
    big = rows.filter(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = materialize(big.filter("n > 1").select("digest", "first"), "warc-copied")
    small = copied.limit(bound + 1).count() <= bound
    told = rows.join(F.broadcast(copied) if small else copied, "digest", "left")
    told = told.withColumn("refers", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def put(batches):
        fs, top = _storage(folder)
        buffer, held, n, done = [], 0, 0, []

        def flush():
            nonlocal buffer, held, n
            path = f"{top}/{uuid.uuid4().hex}.warc"
            with fs.open_output_stream(path) as f:
                for x in buffer:
                    f.write(x)
            done.append((path, held, n))
            buffer, held, n = [], 0, 0

        fs.create_dir(top, recursive=True)
        for b in batches:
            for p, u, h, d, r in zip(b["page_id"].astype(object), b["url"], b["html"], b["digest"], b["refers"].astype(object)):
                x = record_bytes(None if pd.isna(p) else int(p), u, h.encode("utf-8", "surrogatepass"), d, None if pd.isna(r) else int(r))
                buffer.append(x)
                held += len(x)
                n += 1
                if held >= file_bytes:
                    flush()
        if buffer:
            flush()
        yield pd.DataFrame(done, columns=["path", "size", "n"])

    return materialize(told.select("page_id", "url", "html", "digest", "refers").mapInPandas(put, "path string, size long, n long"), "warc-manifest")


def _parse(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _read_on(data: bytes, at: int, start: int, size: int, more) -> tuple[bytes, int]:
    """``data`` and what follows it in the file up to the blank line after ``at``, and where that is; -1 if there is none."""
    head, step = bytearray(data), HEAD_BYTES
    while start + len(head) < size:
        seen = max(at, len(head) - 3)
        got = more(start + len(head), min(step, size - start - len(head)))
        if not got:
            break
        head += got
        stop = head.find(b"\r\n\r\n", seen)
        if stop >= 0:
            return bytes(head), stop
        step *= 2
    return bytes(head), -1


def _scan(data: bytes, start: int, end: int, size: int, more):
    """Candidates of the range [start, end): (offset, next, page, type, refers, bytes, digest); next is -1 if it can't be a record."""
    at, stop, last = data.find(MAGIC), -1, data.rfind(b"\r\n\r\n")
    while at >= 0 and start + at < end:
        head = data
        if stop < at:  # else the blank line ahead is known already
            stop = data.find(b"\r\n\r\n", at) if at < last else -1
        if stop < 0 and data.find(MAGIC, at + 1) < 0:
            head, stop = _read_on(data, at, start, size, more)
        # A header holds the magic at its start only, so each byte is parsed once.
        whole = stop >= 0 and head.find(MAGIC, at + 1, stop) < 0
        fields = _parse(head[at:stop]) if whole else {}
        length = fields.get("content-length", "")
        nxt = start + stop + 4 + int(length) + 4 if re.fullmatch("[0-9]{1,18}", length) else -1
        page = re.fullmatch(r"<urn:page:(-?\d*)>", fields.get("warc-record-id", ""))
        if 0 < nxt <= size and page:
            refers = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
            payload = None
            if fields.get("warc-type") == "response":
                begin = stop + 4
                block = data[begin : begin + int(length)]
                if len(block) < int(length):
                    block = more(start + begin, int(length))
                payload = block[block.find(b"\r\n\r\n") + 4 :]
            yield (
                start + at, nxt, int(page[1]) if page[1] else None, fields.get("warc-type"), int(refers[1]) if refers else None,
                len(payload) if payload is not None else int(fields.get("x-payload-length", 0)),
                hashlib.sha256(payload).hexdigest() if payload is not None else fields.get("warc-payload-digest", "").removeprefix("sha256:"),
            )
        else:
            yield (start + at, -1, None, None, None, 0, "")
        at = data.find(MAGIC, at + 1)


def _exits(off: np.ndarray, nxt: np.ndarray, end: int) -> np.ndarray:
    """For each candidate the first offset at or past ``end`` on its chain, -1 if the chain breaks off before."""
    to = nxt.copy()
    for _ in range(max(1, int(len(off)).bit_length())):
        inside = (to >= 0) & (to < end)
        if not inside.any():
            break
        i = np.searchsorted(off, to[inside])
        i = np.minimum(i, len(off) - 1)
        to[inside] = np.where(off[i] == to[inside], to[i], -1)
    return to


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, offset, page_id, record_type, refers_to, payload_bytes, payload_digest) of the records that the chain from each file's start reaches; an error if a file has other than its manifest row's ``n``."""
    parts = manifest.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    total = manifest.agg(F.sum("size")).first()[0] or 0
    parts = parts.repartition(max(1, min(100_000, -(-total // range_bytes))), "path", "start")

    def scan(batches):
        fs, _ = _storage(folder)
        for b in batches:
            for path, size, start in zip(b["path"], b["size"], b["start"]):
                end = min(size, start + range_bytes)
                with fs.open_input_file(path) as f:

                    def more(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    data = more(start, min(size, end + HEAD_BYTES) - start)
                    found = list(_scan(data, start, end, size, more))
                out = pd.DataFrame(found, columns=["off", "nxt", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])
                out["exit"] = _exits(out["off"].to_numpy(np.int64), out["nxt"].to_numpy(np.int64), end)
                out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
                yield out.assign(path=path, part=start)

    seen = materialize(parts.mapInPandas(scan, "path string, part long, off long, nxt long, exit long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"), "warc-candidates")
    # Entries of ranges: the file's start, and where a chain leaves an earlier range.
    entry = seen.select("path", F.col("exit").alias("off")).filter("off > 0").union(seen.select("path", F.lit(0).cast("long"))).distinct()
    jump = materialize(seen.select("path", "off", "exit").join(entry, ["path", "off"]).select("path", "off", "exit"), "warc-jump")
    reached = materialize(jump.select("path", "off").filter("off = 0"), "warc-reached")
    ranges = int(-(-(manifest.agg(F.max("size")).first()[0] or 1) // range_bytes))
    for _ in range(ranges.bit_length()):
        ahead = jump.join(reached, ["path", "off"]).select("path", F.col("exit").alias("off"))
        reached = materialize(reached.union(ahead.filter("off >= 0")).distinct(), "warc-reached")
        two = jump.select("path", F.col("off").alias("exit"), F.col("exit").alias("far"))
        jump = materialize(jump.join(two, ["path", "exit"], "left").select("path", "off", F.coalesce("far", F.lit(-1).cast("long")).alias("exit")), "warc-jump")

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("off", kind="stable")
        at = dict(zip(g["off"], range(len(g))))
        nxt, kept = g["nxt"].to_numpy(), np.zeros(len(g), bool)
        for i in np.flatnonzero(g["entry"].to_numpy()):
            while i is not None and not kept[i]:
                kept[i] = True
                i = at.get(nxt[i])
        return g[kept].drop(columns=["entry", "nxt"])

    marked = seen.join(reached.withColumn("entry", F.lit(True)), ["path", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    out = marked.select("path", "part", "off", "nxt", "entry", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
    out = out.groupBy("path", "part").applyInPandas(follow, "path string, part long, off long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string")
    out = materialize(out.filter("record_type is not null").withColumnRenamed("off", "offset").drop("part"), "warc-records")
    short = manifest.select("path", "n").join(out.groupBy("path").agg(F.count(F.lit(1)).alias("read")), "path", "left").filter("coalesce(read, 0) <> n").limit(5).collect()
    if short:
        raise ValueError("archives don't hold the records of their manifest: " + ", ".join(f"{r['path']} ({r['read'] or 0} of {r['n']})" for r in short))
    return out


def op10_warc(spark, sf_dir):
    folder = fresh_path(spark, "warc")
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
