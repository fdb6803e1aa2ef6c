"""WARC archives: pages written as records, and archives of any size read back by verified chains of records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if, discard, shared_dir, shuffles_cleared, stored

#: What stands before every record but a file's first; it can't overlap itself, and no header line begins so.
BORDER, MAGIC = "\r\nWARC/1.", "WARC/1."
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
#: Bytes in a bin of a file, to find which record a rejected candidate lies in.
BIN = 1 << 22

#: An HTTP header that is longer is taken for part of the payload.
HTTP_BYTES = 1 << 16

_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*\r\n", re.IGNORECASE)


# --- writing ---------------------------------------------------------------------------------


def _urn(*parts: Column) -> Column:
    """A record id that depends on its parts alone, so that a task that runs again writes the same one."""
    name = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "none", least: int = LEAST_REVISIT) -> None:
    """The pages (page_id, url, html) as WARC/1.1 archives in the new folder ``path``, one for each partition.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least ``least`` bytes
    that with the largest page_id is a response, the others are revisits without payload that refer to it; where rows
    repeat that page_id each is a response. A page without page_id is a response where all its equals have none. A
    null url gives no target; line breaks in one are percent-encoded. Other columns are not written.

    Equal payloads meet by SHA-256 in one aggregation (least rows leave a task: one a payload); only payloads
    that occur twice are joined back, broadcast if their measured size allows. Spark's text sink writes
    and commits the files, so a lost executor's files are written again. ``compression``: none or gzip.
    """
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html).cast("long")
    long = pages.select(F.col("page_id"), F.when(size >= least, F.sha2(html, 256)).alias("name")).where("name is not null")
    groups = long.groupBy("name").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    repeated = stored(groups.where("n > 1 and original is not null").select("name", "original"), "repeated")
    named = pages.select("page_id", "url", html.alias("html"), size.alias("size"), F.when(size >= least, F.sha2(html, 256)).alias("name"))
    met = named.join(broadcast_if(repeated), "name", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    digest = F.sha1("html")
    target = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit(""))

    record = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.when(revisit, _urn(F.lit("revisit"), F.col("page_id"), digest)).otherwise(_urn(F.col("page_id"), digest))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _urn(F.col("original"), digest))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"),
        block,
    )
    with shuffles_cleared(pages.sparkSession):
        met.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
    discard(repeated)


# --- reading ---------------------------------------------------------------------------------


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value): the bytes between candidates, in file order inside each block that one task reads."""
    text = spark.read.option("lineSep", BORDER).text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(path, block, place in the block, bytes, length of the header, length of the content) of each chunk.

    A place counts from the first byte that the block's task reads; a chunk's is where its ``WARC/1.``
    begins. Without a header that ends and says its length, both lengths are None.
    """
    here, at = None, 0
    for batch in batches:
        paths, starts, values = (batch.column(c) for c in range(3))
        for i in range(batch.num_rows):
            block = paths[i].as_py(), starts[i].as_py()
            value = values[i].as_py()
            if block != here:
                here, at = block, 0
                if block[1] == 0:  # nothing stands before a file's first record
                    lead = len(MAGIC) if value.startswith(MAGIC.encode()) else 0
                    at, value = lead, value[lead:]
                    if not lead:
                        yield *block, -1, value, None, None
                        at += len(value) + len(BORDER)
                        continue
            end = value.find(b"\r\n\r\n")
            if end < 0 and value.endswith(b"\r\n"):
                end = len(value) - 2  # a content that begins like a record: the border took the blank line
            length = _LENGTH.search(value[: end + 2]) if end >= 0 else None
            yield *block, at - len(MAGIC), value, *((end + 4, int(length[1])) if length else (None, None))
            at += len(value) + len(BORDER)


def _exits(nodes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate the first place of its chain that is no candidate of the same block; -1 where the chain is broken."""
    out = after.tolist()
    place = np.searchsorted(nodes, after)
    inside = (place < len(nodes)) & (nodes[np.minimum(place, len(nodes) - 1)] == after)
    for i in np.flatnonzero(inside)[::-1].tolist():  # successors lie behind, so theirs are known
        out[i] = out[place[i]]
    return np.array(out, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Narrow rows of ``_placed``: without the bytes, with each candidate's successor and the exit of its chain."""
    names = ["path", "block", "at", "size", "span", "head", "after", "leave"]
    here, rows = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        at, size, span, head, after = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        columns = [pa.array([here[0]] * len(at)), pa.array(np.full(len(at), here[1])), *(pa.array(c) for c in (at, size, span, head, after, _exits(at, after)))]
        yield pa.RecordBatch.from_arrays(columns, names)
        rows.clear()

    for path, block, at, value, head, length in _placed(batches):
        if (path, block) != here:
            yield from flush()
            here = path, block
        span = len(value) + len(BORDER) + (len(MAGIC) if block == 0 and not rows and at == 0 else 0)
        # the terminating two line breaks stand before the successor
        rows.append((at, len(value), span, head or 0, at + len(MAGIC) + head + length + 4 if head is not None else -1))
    yield from flush()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "block", "at", "value", "head", "length"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for row in _placed(batches):
        rows.append(row)
        size += len(row[3])
        if size > 1 << 22 or len(rows) >= 4096:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _followed(links: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, block, at) of each candidate on a chain from an entry (path, at); a group is one block's candidates."""

    def follow(key: tuple, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("at")
        nodes, after = chunks["at"].to_numpy(), chunks["after"].to_numpy()
        place = np.searchsorted(nodes, after)
        found = (place < len(nodes)) & (nodes[np.minimum(place, len(nodes) - 1)] == after) if len(nodes) else np.zeros(0, bool)
        kept = chunks["entry"].to_numpy(bool) & (chunks["head"].to_numpy() > 0)
        reached, place = kept.tolist(), place.tolist()
        for i in np.flatnonzero(found).tolist():  # in order of place: what leads to a candidate stands before it
            if reached[i]:
                reached[place[i]] = chunks["head"].iat[place[i]] > 0
        return pd.DataFrame({"path": key[0], "block": key[1], "at": nodes[np.array(reached, bool)]})

    flagged = links.join(entries.withColumn("entry", F.lit(True)), ["path", "at"], "left").fillna(False, ["entry"])
    return flagged.select("path", "block", "at", "after", "head", "entry").groupBy("path", "block").applyInPandas(follow, "path string, block long, at long")


def _reached(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, at) that chains from ``starts`` meet among the nodes (path, at, leave): by pointers of doubled length."""
    reached, hop = starts, jumps
    temporary: list[DataFrame] = []
    while True:
        nexts = reached.join(hop, ["path", "at"]).select("path", F.col("leave").alias("at"))
        more = stored(reached.union(nexts).distinct(), "reached")
        beyond = hop.select("path", F.col("at").alias("_at"), F.col("leave").alias("at")).join(hop, ["path", "at"])
        longer = stored(beyond.select("path", F.col("_at").alias("at"), "leave"), "hop")
        discard(*temporary)
        temporary = [more, longer]
        reached, hop = more, longer
        if hop.isEmpty():
            discard(longer)
            return reached


def read_warc(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """(path, offset, record_type, record_id, refers_to, target, page_id, digest, headers, payload) of each record.

    ``path``: archives (WARC/1.0 or 1.1) that Spark can read; uncompressed ones are split, those ending in .gz
    are read whole by one task each. Every ``WARC/1.`` at a line's start is a candidate, which claims that its successor stands
    where its length says. From each file's first byte only candidates on the chain are records: what
    looks like a record inside a payload is rejected, as no chain leads there. Chains are
    shortened inside each block that a task reads to their exit from the block; pointers between blocks
    then jump by doubled lengths, so rounds grow with the logarithm of a file's blocks.

    payload: the content, behind the HTTP header where the content is one (application/http); a revisit's is
    empty. offset: of the record in its (unpacked) file. A file that doesn't begin with a record, a broken
    length or a cut end ends its chain: with ``check`` that is an error, else the records before it
    are returned. An empty folder gives no rows. Payloads with rejected candidates are put together by
    record, so a group is one payload; others are never shuffled. Memory: a block's candidates (about 100 bytes each)
    and a record's bytes. The archives must stay until the result is read.
    """
    chunks = _chunks(spark, path)
    local = stored(chunks.mapInArrow(_links, "path string, block long, at long, size long, span long, head long, after long, leave long"), "links")
    sizes = local.groupBy("path", "block").agg(F.sum("span").alias("bytes"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(sizes.withColumn("base", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).cast("long")), "bases")  # one row a block
    links = local.join(broadcast_if(bases), ["path", "block"])
    moved = {c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.col(c)) for c in ("after", "leave")}
    # a block's first candidate may stand before the block's first byte, so places can be negative there
    links = stored(links.withColumns(moved | {"at": F.col("at") + F.col("base")}), "candidates")
    starts = bases.where("block = 0").select("path", F.lit(0).cast("long").alias("at"))
    doors = links.where("leave >= 0").select("path", F.col("leave").alias("at")).union(starts).distinct()
    jumps = stored(doors.join(links.where("head > 0").select("path", "at", "leave"), ["path", "at"]), "jumps")
    reached = _reached(jumps, starts)
    records = stored(_followed(links, reached), "records")
    marked = links.join(records.withColumn("kept", F.lit(True)), ["path", "block", "at"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    # a record whose chunk ends before its content holds candidates that are none
    until = F.col("at") + F.lit(len(MAGIC)) + F.col("size")
    cut = stored(marked.where(F.col("kept") & (F.col("after") - 4 > until)).select("path", "at", "after"), "cut")
    bins = F.explode(F.sequence(F.floor(F.col("at") / BIN), F.floor(F.col("after") / BIN)))
    inside = marked.where("not kept").select("path", "block", "at", F.floor(F.col("at") / BIN).alias("bin")).alias("i")
    spans = cut.select("path", F.col("at").alias("owner"), F.col("after").alias("until"), bins.alias("bin")).alias("s")
    owned = inside.join(spans, ["path", "bin"], "left").groupBy("path", "block", "at").agg(F.max(F.when((F.col("owner") < F.col("at")) & (F.col("at") < F.col("until")), F.col("owner"))).alias("owner"))
    whole = marked.where("kept").join(cut.select("path", "at"), ["path", "at"], "leftsemi").select("path", "block", "at", F.col("at").alias("owner"))
    parts = stored(owned.union(whole).withColumn("part", F.lit(True)), "parts")
    if check:
        _check(marked, bases)
    texts = chunks.mapInArrow(_texts, "path string, block long, at long, value binary, head long, length long")
    placed = texts.join(broadcast_if(bases), ["path", "block"]).withColumn("at", F.col("at") + F.col("base")).drop("bytes", "base")
    met = placed.join(broadcast_if(parts), ["path", "block", "at"], "left")
    lone = met.where("part is null").select("path", "at", "value", "head", "length")
    pieces = met.where("owner is not null").groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("at", "value", "head", "length"))).alias("p"))  # one record's bytes
    joined = F.array_join(F.transform("p", lambda x: x["value"].cast("string")), BORDER).cast("binary")
    together = pieces.select("path", F.col("owner").alias("at"), joined.alias("value"), F.col("p")[0]["head"].alias("head"), F.col("p")[0]["length"].alias("length"))
    discard(local, links, jumps, reached, records, cut)
    complete = together.where(F.octet_length("value") >= F.col("head") + F.col("length"))
    return _parsed(lone.union(complete))


def _check(marked: DataFrame, bases: DataFrame) -> None:
    """An error unless each file's chain goes from its first byte to its last."""
    ends = marked.where("kept").groupBy("path").agg(F.max("after").alias("end"))
    # the last chunk counts a border that isn't there, and its terminator stands before the end
    lengths = bases.groupBy("path").agg((F.sum("bytes") - F.lit(len(BORDER))).alias("length"))
    broken = lengths.join(ends, "path", "left").where("end is null or end <> length").select("path", "end", "length").limit(5).collect()
    if broken:
        raise ValueError("chains of records that don't reach the file's end: " + "; ".join(f"{r['path']} ({r['end']} of {r['length']} bytes)" for r in broken))


def header(name: str) -> Column:
    """The value of a header line, or null."""
    value = F.regexp_extract("headers", rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(value != "", value)


def _parsed(texts: DataFrame) -> DataFrame:
    content = F.expr("substring(value, cast(head + 1 as int), cast(length as int))")
    split = texts.select("path", F.col("at").alias("offset"), F.expr("cast(substring(value, 1, cast(head as int)) as string)").alias("headers"), content.alias("content"))
    http = F.coalesce(header("Content-Type"), F.lit("")).startswith("application/http")
    # the HTTP header ends at its first blank line; a character for each byte
    end = F.locate("\r\n\r\n", F.decode(F.expr(f"substring(content, 1, {HTTP_BYTES})"), "ISO-8859-1"))
    payload = F.when(F.col("end") > 0, F.expr("substring(content, end + 4)")).otherwise(F.col("content"))
    return split.withColumn("end", F.when(http, end)).select(
        "path",
        "offset",
        header("WARC-Type").alias("record_type"),
        header("WARC-Record-ID").alias("record_id"),
        header("WARC-Refers-To").alias("refers_to"),
        header("WARC-Target-URI").alias("target"),
        header("WARC-Page-ID").alias("page_id"),
        header("WARC-Payload-Digest").alias("digest"),
        "headers",
        payload.alias("payload"),
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_warc(pages, path)
    known = read_warc(spark, path).select(
        F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"),
        "record_type",
        "record_id",
        "refers_to",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    known = stored(known, "known")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    revisits = known.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers_to").alias("record_id"))
    referred = known.where("record_type = 'response'").join(revisits.select("record_id").distinct(), "record_id", "leftsemi").dropDuplicates(["record_id"])
    originals = broadcast_if(stored(referred.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"), "originals"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    none = F.lit(None).cast(known.schema["page_id"].dataType)
    responses = known.where("record_type = 'response'").withColumn("refers_to", none)
    return responses.select(columns).union(revisits.join(originals, "record_id").select(columns))


OP13_SQL = f"""SELECT page_id, payload_bytes, payload_digest, CASE WHEN r THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN r THEN original END AS refers_to
    FROM (SELECT *, coalesce(payload_bytes >= {LEAST_REVISIT} AND original IS NOT NULL AND page_id IS DISTINCT FROM original, false) AS r
        FROM (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                max(page_id) OVER (PARTITION BY coalesce(html, '')) AS original FROM pages))"""
