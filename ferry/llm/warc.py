"""WARC archives: writing with segmentation and revisits, reading with segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferry.plans.scratch import Scratch

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def _cut(text: str, limit: int) -> Iterator[str]:
    """``text`` in parts of at most ``limit`` UTF-8 bytes, cut between characters."""
    raw = text.encode("utf-8")
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + limit)
        while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        yield raw[lo:hi].decode("utf-8")
        lo = hi


def chunked(payload: str, chunk: int = 4096) -> str:
    """Chunked transfer coding of a text's UTF-8 bytes."""
    return "".join(f"{len(p.encode('utf-8')):x}{CRLF}{p}{CRLF}" for p in _cut(payload, chunk)) + f"0{CRLF}{CRLF}"


def dechunk(body: bytes) -> bytes:
    """Undo chunked transfer coding; chunk extensions and trailers are read over. Broken framing is an error."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line without an end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block, with its transfer coding undone."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("HTTP response without an end of its header")
    fields = dict(line.split(":", 1) for line in head.decode("latin-1").split("\r\n")[1:] if ":" in line)
    coding = {k.strip().lower(): v.strip().lower() for k, v in fields.items()}.get("transfer-encoding", "")
    return dechunk(body) if coding == "chunked" else body


def _record(kind: str, rid: str, block: str, fields: list[tuple[str, object]]) -> str:
    """One record without the blank lines that end it."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", DATE), *fields, ("Content-Length", len(block.encode("utf-8")))]
    return "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in named if v is not None) + CRLF + block


def records(page_id: int | None, url: str | None, html: str, sha1: str, refers_to: int | None, revisit: bool, segment: int) -> Iterator[str]:
    """The records of one page: a revisit, a response, or a response with its continuations."""
    rid = record_id(page_id, sha1)
    target = None if url is None else "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8")) for c in url)
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}"
    fields = [("WARC-Target-URI", target), ("X-Page-Id", page_id), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, sha1))]
        yield _record("revisit", rid, http, fields + more)
        return
    block = http + chunked(html)
    total = len(block.encode("utf-8"))
    if total <= segment:
        yield _record("response", rid, block, fields)
        return
    parts = list(_cut(block, segment))
    for i, part in enumerate(parts, 1):
        if i == 1:
            yield _record("response", rid, part, [*fields, ("WARC-Segment-Number", 1)])
        else:
            last = [("WARC-Segment-Total-Length", total)] if i == len(parts) else []
            yield _record("continuation", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid}#{i}')}>", part, [("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", i), *last])


def write_archives(pages: DataFrame, path: str, scratch: Scratch, min_revisit_bytes: int = 0, segment: int = 16_384, per_file: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one response or revisit per page as gzip-compressed WARC files under ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest id is the response and the
    others revisit it; smaller payloads are all responses. Null html is an empty payload; rows that repeat the largest id
    are all responses; a null id is smaller than any other and stays null. A block above ``segment`` bytes is cut into a
    response and continuation records. The files come from Spark's text sink, whose line separator is the two blank lines
    that end a record: any Hadoop file system will do, and a lost task leaves no half file. ``per_file`` records of a
    segment each bound a file's size.
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    groups = p.where(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    groups = scratch.save(groups, "payloads")
    marked = p.join(groups, "sha", "left").select("id", "url", "html", "sha", "first", (F.col("first").isNotNull() & (F.col("size") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(lo, 64).to_pylist():
                    sha = base64.b32encode(bytes.fromhex(r["sha"])).decode("ascii")
                    out += records(r["id"], r["url"], r["html"], sha, r["first"], r["revisit"], segment)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    marked.mapInArrow(run, "value string").write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of a WARC file, compressed as a whole, by record, or not at all."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at, view = 0, memoryview(raw)
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("record header without an end")
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        if end + 4 + size > len(raw):
            raise ValueError("record shorter than its length")
        yield fields, bytes(view[end + 4 : end + 4 + size])
        at = end + 4 + size


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_archives(spark: SparkSession, path: str, scratch: Scratch, glob: str = "*.gz") -> DataFrame:
    """(page_id, record_type, record_id, refers_to_id, payload_bytes, payload_digest, payload, error) of every record.

    Files are read whole, each in one task, and parsed there; blocks in one piece are decoded at once. Segments are
    grouped by the origin they name, ordered by segment number, checked for gaps and against the total length that the
    last one states, and then decoded. A response that fails a check has null payload and the reason in ``error``.
    Continuations repeated under one number count once; each first segment gives a row. Empty folder: empty result.
    """
    schema = "record_id string, type string, page_id long, refers_to_id string, claimed string, seq int, total long, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse(content.as_py()):
                    kind = f.get("warc-type", "")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    rid = f.get("warc-segment-origin-id") if kind == "continuation" else f.get("warc-record-id")
                    rows.append((rid, kind, _number(f.get("x-page-id")), f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, _number(f.get("warc-segment-number")), _number(f.get("warc-segment-total-length")), block))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("content").mapInArrow(run, schema)
    raw = scratch.save(raw, "records")

    @F.pandas_udf("payload binary, payload_bytes long, payload_digest string, error string")
    def decode(kind: pd.Series, blocks: pd.Series, total: pd.Series, fault: pd.Series) -> pd.DataFrame:
        out = []
        for k, parts, size, why in zip(kind, blocks, total, fault, strict=True):
            if k == "revisit":
                out.append((None, None, None, None))
                continue
            try:
                if why is not None:
                    raise ValueError(why)
                block = b"".join(bytes(p) for p in parts)
                if size >= 0 and len(block) != size:
                    raise ValueError("total length differs")
                p = payload_of(block)
                out.append((p, len(p), digest(p), None))
            except ValueError as e:
                out.append((None, None, None, str(e)))
        return pd.DataFrame(out, columns=["payload", "payload_bytes", "payload_digest", "error"])

    whole = raw.where("seq is null and type <> 'continuation'").select("*", F.array("block").alias("blocks"), F.lit(None).cast("string").alias("fault")).withColumn("total", F.lit(-1).cast("long"))
    seg = raw.where("seq is not null or type = 'continuation'").groupBy("record_id", "seq").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("page_id", "claimed", "total", "block")], F.count_if(F.col("type") == "response").alias("firsts"))
    seg = seg.groupBy("record_id").agg(F.max("page_id").alias("page_id"), F.max("claimed").alias("claimed"), F.max("total").alias("total"), F.max("seq").alias("last"), F.count("*").alias("n"), F.sum("firsts").cast("int").alias("firsts"), F.array_sort(F.collect_list(F.struct("seq", "block"))).alias("parts"))
    fault = F.when(~F.col("n").eqNullSafe(F.col("last").cast("long")), "segments are missing").when(F.col("total").isNull(), "no last segment")
    seg = seg.where("firsts > 0").select("record_id", F.lit("response").alias("type"), "page_id", F.lit(None).cast("string").alias("refers_to_id"), "claimed", F.transform("parts", lambda p: p["block"]).alias("blocks"), F.coalesce("total", F.lit(-1)).alias("total"), fault.alias("fault"), F.explode(F.sequence(F.lit(1), "firsts")).alias("_i"))
    cols = ["record_id", "type", "page_id", "refers_to_id", "claimed", "blocks", "total", "fault"]
    got = whole.select(*cols).unionByName(seg.select(*cols)).withColumn("d", decode("type", "blocks", "total", "fault"))
    return got.select("page_id", F.col("type").alias("record_type"), "record_id", "refers_to_id", "claimed", "d.*")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = ["record_id", "type", "page_id", "refers_to_id", "claimed", "seq", "total", "block"]
    cols = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def resolve_revisits(read: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per record, revisits with the payload facts of the response that they name, and its page id.

    Responses are looked up by record id; equal ids mean equal payloads, so repeats count once.
    """
    facts = scratch.save(read.drop("payload"), "decoded")
    known: Column = F.col("record_type") == "response"
    source = facts.where(known).groupBy(F.col("record_id").alias("_rid")).agg(F.first("page_id").alias("_page"), F.first("payload_bytes").alias("_bytes"), F.first("payload_digest").alias("_digest"))
    named = facts.where(~known).select("refers_to_id").distinct()
    source = scratch.save(source.join(named, F.col("_rid") == F.col("refers_to_id"), "left_semi"), "revisited")
    rev = facts.where(~known).join(source, F.col("refers_to_id") == F.col("_rid"), "left").select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"), F.when(F.col("_rid").isNull(), "nothing to refer to").when(F.col("claimed") != F.col("_digest"), "digest differs").alias("error"))
    wrong = F.coalesce("error", F.when(F.col("claimed") != F.col("payload_digest"), F.lit("digest differs")))
    own = facts.where(known).select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), wrong.alias("error"))
    return own.unionByName(rev)
