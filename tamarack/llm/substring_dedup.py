"""Removal of repeated word spans over a De Bruijn graph that is never built whole.

Each window of ``width`` words is an edge between its first and last ``width - 1`` words. Windows go to
buckets by their rarest-hashing inner word run (their minimizer), so equal edges meet, and neighbours
in a text mostly stay together. A bucket finds its repeated edges and their first source, and
compacts those that follow each other both in a document and in the source: between these the
graph does not branch. Pieces of different buckets are then joined into whole paths by document and
source coordinates, and each path is verified at both coordinates before its words go.

An edge that fills much of a batch is sent to its bucket once, with its first place there; its
occurrences meet the first source in a separate join. Buckets are counted beforehand: one that a common
minimizer overfills is split by the edges' own hashes, so equal edges still meet. The same pass keeps
counters of the most frequent edges (Misra-Gries), which find every edge that could overfill a bucket
alone, however thinly it is spread over the batches. Such heavy edges never go to a bucket: their first
places are the minima of a grouped aggregate.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, broadcast_if, discard, hash_windows, hash_words, mix, sliced, stored

WIDTH, INNER = 13, 5
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 256
#: Bytes of text that a task gathers before it sends rows; an edge that occurs so often in them is hot.
SEND_BYTES, HOT = 8 << 20, 128
#: A bucket of more windows than MOST is split; where more than WIDE buckets might be, the bound rises to fit.
MOST, WIDE = 1 << 22, 1 << 20
#: Stands for a null doc_id: larger than all others.
_NULL_ID = np.iinfo(np.int64).max
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_PIECE = "doc long, start int, n int, odoc long, ostart int"


def _planes(values: np.ndarray) -> bytes:
    """The bytes of fixed-width values by significance, which the shuffle's codec packs well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values."""
    span, out = 1, v
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    extra = width - span
    return np.minimum(out[: len(out) - extra], out[extra:]) if extra else out


def _edges(texts: list[bytes], ids: np.ndarray, width: int, inner: int):
    """(hash, minimizer, doc_id, place) of each window of a block of texts, in order."""
    words, of, counts, *_ = hash_words(texts)
    if len(words) < width:
        return [np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int32)]
    whole = of[: len(words) - width + 1] == of[width - 1 :]
    low = _least(hash_windows(words, inner), width - inner + 1)
    at = np.flatnonzero(whole)
    first = np.cumsum(counts) - counts
    return hash_windows(words, width)[at], low[at], ids[of[at]], (at - first[of[at]]).astype(np.int32)


def _gathered(batches: Iterator[pa.RecordBatch], width: int, inner: int):
    """Edges of about SEND_BYTES of text at a time."""
    parts, size = [], 0
    for batch in sliced(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
        for first, last in blocks(texts):
            parts.append(_edges(texts[first:last], ids[first:last], width, inner))
            size += sum(map(len, texts[first:last]))
            if size >= SEND_BYTES:
                yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts, size = [], 0
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _hot(edges, often: int) -> np.ndarray:
    """Which of the gathered edges occur ``often`` times or more among them."""
    ordered = np.sort(edges[0])
    found = ordered[often - 1 :][ordered[often - 1 :] == ordered[: max(0, len(ordered) - often + 1)]]
    return np.isin(edges[0], np.unique(found)) if len(found) else np.zeros(len(ordered), bool)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class _Frequent:
    """Counters of the values that come most often among all that are added (Misra-Gries).

    No more than ``size`` are kept; each count is too small by less than a ``size``-th of all values added.
    """

    def __init__(self, size: int):
        self.size, self.added = size, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.added += len(values)
        new, n = self._largest(*np.unique(values, return_counts=True))
        both, at = np.unique(np.concatenate([self.values, new]), return_inverse=True)
        counts = np.zeros(len(both), np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, n]))
        self.values, self.counts = self._largest(both, counts)

    def _largest(self, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At most ``size`` values, their counts less the largest count that goes."""
        if len(counts) <= self.size:
            return values, counts
        cut = np.partition(counts, -self.size - 1)[-self.size - 1]
        kept = counts > cut
        return values[kept], counts[kept] - cut


def _first_places(edges, hot: np.ndarray) -> np.ndarray:
    """Indices of the first place, by (doc_id, place), of each hot edge."""
    at = np.flatnonzero(hot)
    at = at[np.lexsort((edges[3][at], edges[2][at], edges[0][at]))]
    return at[np.diff(edges[0][at], prepend=edges[0][at[0]] + np.uint64(1)) != 0] if len(at) else at


def _sent(edges, often: int, heavy: np.ndarray):
    """The edges that go to buckets, with hot marks: of a hot one its first place alone, of a heavy one nothing."""
    if len(heavy):
        edges = [x[~_among(edges[0], heavy)] for x in edges]
    hot = _hot(edges, often)
    keep = np.sort(np.concatenate([np.flatnonzero(~hot), _first_places(edges, hot)]))
    return [x[keep] for x in (*edges, hot)]


def _bucket_of(h: np.ndarray, low: np.ndarray, buckets: int, split: np.ndarray) -> np.ndarray:
    """The bucket of each edge: by its minimizer, and in split buckets (number, first part, parts) by its hash."""
    bucket = (mix(low) % np.uint64(buckets)).astype(np.int64)
    if len(split):
        near = np.minimum(np.searchsorted(split[:, 0], bucket), len(split) - 1)
        inside = np.flatnonzero(split[near, 0] == bucket)
        _, first, parts = split[near[inside]].T
        bucket[inside] = first + (mix(h[inside]) % parts.astype(np.uint64)).astype(np.int64)
    return bucket


def _to_buckets(edges, buckets: int, split: np.ndarray, often: int, heavy: np.ndarray):
    """Rows (bucket, hashes, run ids, run places, run lengths, hot marks), edges of a run together."""
    h, low, ids, at, hot = _sent(edges, often, heavy)
    if not len(h):
        return
    bucket = _bucket_of(h, low, buckets, split)
    begins = np.ones(len(h), bool)
    begins[1:] = (bucket[1:] != bucket[:-1]) | (ids[1:] != ids[:-1]) | (at[1:] != at[:-1] + 1) | (hot[1:] != hot[:-1])
    begin = np.flatnonzero(begins)
    begin = begin[np.append(True, np.diff(begin) > 0)]
    long = np.diff(begin, append=len(h))
    if long.max() > 255:  # a length is one byte
        begin = np.concatenate([np.arange(b, b + n, 255) for b, n in zip(begin, long, strict=True)])
        long = np.diff(begin, append=len(h))
    bucket = bucket[begin]
    order = np.argsort(bucket, kind="stable")
    begin, long, bucket = begin[order], long[order], bucket[order]
    ends = np.cumsum(long)
    every = np.repeat(begin - (ends - long), long) + np.arange(int(ends[-1]))
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i, j in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
        inside = every[ends[i] - long[i] : ends[j - 1]]
        runs = begin[i:j]
        yield int(bucket[i]), h[inside].tobytes(), _planes(ids[runs]), _planes(at[runs]), long[i:j].astype(np.uint8).tobytes(), hot[runs].tobytes()


def _pieces(doc, at, odoc, oat) -> pd.DataFrame:
    """Occurrences that follow each other in the document and in the source, as one row each."""
    order = np.lexsort((at, doc))
    doc, at, odoc, oat = doc[order], at[order], odoc[order], oat[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (odoc[1:] != odoc[:-1]) | (oat[1:] != oat[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(begin, append=len(doc)).astype(np.int32)
    return pd.DataFrame({"doc": doc[begin], "start": at[begin], "n": n, "odoc": odoc[begin], "ostart": oat[begin]})


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's repeated edges: pieces, and for hot ones a row with the hash in ``hot``."""
    h = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["hashes"]])
    long = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["lengths"]]).astype(np.int64)
    ids = np.concatenate([_values(x, np.int64) for x in rows["ids"]])
    at = np.concatenate([_values(x, np.int32) for x in rows["places"]])
    hot = np.concatenate([np.frombuffer(x, bool) for x in rows["hots"]])
    run = np.repeat(np.arange(len(long), dtype=np.int32), long)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    same = ordered[1:] == ordered[:-1]
    del ordered
    repeated = order[np.append(same, False) | np.append(False, same) | hot[run[order]]]
    del order, same  # what follows holds repeated edges alone
    h, run = h[repeated], run[repeated]
    at = (at[run] + repeated - (np.cumsum(long) - long)[run]).astype(np.int32)
    ids, hot = ids[run], hot[run]
    order = np.lexsort((at, ids, h))
    h, ids, at, hot = h[order], ids[order], at[order], hot[order]
    if not len(h):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "start", "n", "odoc", "ostart", "hot")})
    begin = np.flatnonzero(np.diff(h, prepend=h[0] + np.uint64(1)))
    source = np.repeat(begin, np.diff(begin, append=len(h)))
    late = (ids > ids[source]) & ~hot
    out = _pieces(ids[late], at[late], ids[source[late]], at[source[late]]).assign(hot=None)
    asked = np.unique(source[hot])
    heads = pd.DataFrame({"doc": None, "start": None, "n": None, "odoc": ids[asked], "ostart": at[asked], "hot": h[asked].view(np.int64)})
    return pd.concat([x for x in (out, heads) if len(x)] or [out]).astype({c: "Int64" for c in ("doc", "start", "n", "odoc", "ostart", "hot")})


def _overfull(rows: DataFrame, width: int, inner: int, often: int, buckets: int, most: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, first part, parts) of the buckets that hold over ``most`` windows, and the heavy edges in order.

    ``size`` is the bytes of all texts: there are at most half as many windows. ``most`` rises so that at most
    WIDE buckets are split. Heavy is each edge that sends ``most`` rows, and some that send half as many: counters
    of all tasks together miss less than half of ``most``, and at most 2 * WIDE edges pass.
    """
    most = max(most, -(-size // (2 * WIDE)))
    kept = max(16, -(-2 * size // most))
    none = np.zeros(0, np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_met = _Frequent(kept)

        def batch(bucket, edge, n):
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(edge, pa.int64()), pa.array(n, pa.int64())], ["bucket", "edge", "n"])

        for edges in _gathered(batches, width, inner):
            h, low, *_ = _sent(edges, often, none)
            often_met.add(h)
            found, n = np.unique(mix(low) % np.uint64(buckets), return_counts=True)
            yield batch(found.astype(np.int64), [None] * len(found), n)
        worth = often_met.counts * kept >= often_met.added
        edge = often_met.values[worth].view(np.int64)
        yield batch([None] * len(edge), edge, often_met.counts[worth])

    total = stored(rows.mapInArrow(counted, "bucket long, edge long, n long").groupBy("bucket", "edge").agg(F.sum("n").alias("n")), "sizes")
    large = total.where(F.col("bucket").isNotNull() & (F.col("n") > most)).sort("bucket").collect()  # at most WIDE
    heavy = total.where(F.col("edge").isNotNull() & (2 * F.col("n") >= most)).select("edge").collect()  # at most 2 * WIDE
    discard(total)
    parts = np.array([-(-4 * r["n"] // most) for r in large], np.int64)
    split = np.stack([np.array([r["bucket"] for r in large], np.int64), buckets + np.cumsum(parts) - parts, parts], axis=1)
    return split, np.sort(np.array([r["edge"] for r in heavy], np.int64).view(np.uint64))


def repeated_paths(docs: DataFrame, width: int = WIDTH, inner: int = INNER, often: int = HOT, most: int = MOST) -> DataFrame:
    """(doc, start, n, odoc, ostart): ``n`` windows from word ``start`` that also stand in document
    ``odoc`` < ``doc`` from word ``ostart``, as long as they run on. Null ids are the largest number."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split, heavy = _overfull(rows, width, inner, often, buckets, most, size)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "hashes", "ids", "places", "lengths", "hots"]
        for edges in _gathered(batches, width, inner):
            for row in _to_buckets(edges, buckets, split, often, heavy):
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names)

    def places(edges, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(edges[0][at].view(np.int64)), pa.array(edges[2][at]), pa.array(edges[3][at])], ["hot", "doc", "start"])

    def hot_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges in _gathered(batches, width, inner):
            yield places(edges, np.flatnonzero(_hot(edges, often) | _among(edges[0], heavy)))

    def heavy_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for edges in _gathered(batches, width, inner):
            yield places(edges, _first_places(edges, _among(edges[0], heavy)))

    sent = rows.mapInArrow(spread, "bucket long, hashes binary, ids binary, places binary, lengths binary, hots binary")
    found = stored(sent.groupBy("bucket").applyInPandas(_bucket, _PIECE + ", hot long"), "edges")
    heads = found.where("hot is not null").select("hot", "odoc", "ostart")
    pieces = found.where("hot is null").drop("hot")
    done = [found]
    if len(heavy):
        least = rows.mapInArrow(heavy_firsts, "hot long, doc long, start int").groupBy("hot").agg(F.min(F.struct("doc", "start")).alias("first"))
        done.append(stored(least.select("hot", F.col("first.doc").alias("odoc"), F.col("first.start").alias("ostart")), "heavy"))
        heads = heads.unionByName(done[-1])
    if not heads.isEmpty():
        single = rows.mapInArrow(hot_places, "hot long, doc long, start int").join(broadcast_if(heads), "hot").where("odoc < doc")
        pieces = pieces.unionByName(single.select("doc", "start", F.lit(1).alias("n"), "odoc", "ostart"))
    # pieces of one path share document, source and the distance between their coordinates
    along = Window.partitionBy("doc", "odoc", F.col("ostart") - F.col("start")).orderBy("start")
    marked = pieces.withColumn("new", (F.lag(F.col("start") + F.col("n")).over(along) != F.col("start")).cast("int"))
    marked = marked.withColumn("path", F.sum(F.coalesce("new", F.lit(1))).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    paths = marked.groupBy("doc", "odoc", (F.col("ostart") - F.col("start")).alias("off"), "path").agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"))
    paths = stored(paths.select("doc", "start", "n", "odoc", (F.col("start") + F.col("off")).alias("ostart")), "paths")
    discard(*done)
    return paths


def _digest(words: list[str], start: int, n: int, width: int) -> bytes:
    return hashlib.md5(" ".join(words[start : start + n + width - 1]).encode()).digest()


def remove_repeats(docs: DataFrame, width: int = WIDTH, often: int = HOT, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): what stays of each row of ``docs`` (doc_id, text).

    Words are runs without white space; kept: the words that stay, joined by one space; removed:
    array<struct<start, n>> of word places. A word goes if it lies in a window of ``width`` words that
    also starts in a document with a smaller doc_id. Null text has no words. A null doc_id counts as
    larger than all others; rows with the same doc_id do not take from each other, and each such row
    loses only spans that its own words bear out. Other columns do not matter. Texts of any length are
    read whole; an empty table gives no rows. ``often`` and ``most`` shape the plan, never the result.
    """
    docs = docs.select(F.col("doc_id"), "text")
    paths = repeated_paths(docs, width, min(INNER, width), often, most)

    asked = paths.groupBy("odoc").agg(F.collect_set(F.struct("ostart", "n")).alias("asked"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for odoc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("odoc", "text", "asked")), strict=True):
                words = _WORD.findall(text or "")
                out += [(odoc, s["ostart"], s["n"], _digest(words, s["ostart"], s["n"], width)) for s in spans]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["odoc", "ostart", "n", "digest"])

    wanted = docs.join(asked.hint("merge"), F.col("doc_id") == F.col("odoc"))
    proofs = wanted.select("odoc", "text", "asked").mapInArrow(digests, "odoc long, ostart int, n int, digest binary")
    spans = paths.join(proofs, ["odoc", "ostart", "n"]).groupBy("doc").agg(F.collect_set(F.struct("start", "n", "digest")).alias("spans"))
    spans = stored(spans, "spans")
    discard(paths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, kept, removed = [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = _WORD.findall(text or "")
                gone, gaps = np.zeros(len(words), bool), []
                for s in own or ():
                    if _digest(words, s["start"], s["n"], width) == s["digest"]:
                        gone[s["start"] : s["start"] + s["n"] + width - 1] = True
                if own:
                    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
                    gaps = [{"start": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_words.append(len(gone))
                n_removed.append(len(gone) - len(words))
                kept.append(" ".join(words))
                removed.append(gaps)
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, spans_type)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "removed"])

    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_NULL_ID)))
    joined = docs.join(spans.hint("merge"), own_id == F.col("doc"), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string, removed array<struct<start: int, n: int>>")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS first_id FROM o GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM o JOIN f ON o.g = f.g AND o.doc_id > f.first_id),
k AS (SELECT e.doc_id, count(*) FILTER (r.p IS NOT NULL) AS n_removed, string_agg(x, ' ' ORDER BY e.p) FILTER (r.p IS NULL) AS kept
      FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) e LEFT JOIN r ON e.doc_id = r.doc_id AND e.p = r.p GROUP BY e.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
