"""Near-duplicate components by a prefix-filtered Jaccard join on word shingles.

Shingles carry a frequency class from a fixed-size count sketch over all documents in their top bits,
so the order of their codes is rare-first and global. Two sets of similarity t or more share one of
their rarest ``n - ceil(t n) + 1`` codes; only these prefixes are joined. Equal sets become one class
first. A code's classes are not paired with each other: each is paired with the code's leader, pairs
are verified once, components are formed, and only codes whose classes still lie in several
components are paired further, across components and past length and position bounds. Pairs inside
a component cannot change it, so no link is lost and no group of copies grows by its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, broadcast_if, discard, hash_windows, hash_words, mix, shuffles_cleared, sliced, stored, unused

WIDTH = 5
#: Bounds of the frequency sketch's size in bits; bytes of text for each counter; counters in a row.
SKETCH_BITS, SKETCH_BYTES, SKETCH_ROW = (16, 22), 512, 4096
#: Similarity as a fraction.
TOP, BOTTOM = 80, 100


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct 58-bit shingle hashes of each text (A-Z lower-cased)."""
    for first, last in blocks(texts):
        words, of, counts, *_ = hash_words(texts[first:last], lower=True)
        windows = hash_windows(words, width)
        ends = np.cumsum(counts)
        for begin, end in zip(ends - counts, ends, strict=True):
            n = int(end - begin)
            if n >= width:
                yield np.unique(windows[begin : end - width + 1] >> np.uint64(6))
            elif n:
                yield (hash_windows(words[begin:end], n) + np.uint64(n)) >> np.uint64(6)
            else:
                yield np.zeros(0, np.uint64)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def frequency_sketch(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """For each cell of the sketch the class (bit length) of how many shingles of all documents fall in.

    The number of cells follows the text's size within fixed bounds; tasks merge their own counts first.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // SKETCH_BYTES).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in sliced(batches):
            for some in shingle_sets(_texts(batch), width):
                np.add.at(cells, (some & np.uint64((1 << bits) - 1)).astype(np.int64), 1)
        for row in range(0, 1 << bits, SKETCH_ROW):  # which cells of the row are filled, and these
            part = cells[row : row + SKETCH_ROW]
            if len(filled := part[part > 0]):
                sums = filled.astype(np.min_scalar_type(filled.max())).tobytes()
                yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "at": [np.packbits(part > 0).tobytes()], "sums": [sums]})

    def add(parts):
        total = np.zeros(SKETCH_ROW, np.int64)
        for at, sums in zip(parts["at"], parts["sums"], strict=True):
            at = np.unpackbits(np.frombuffer(at, np.uint8)).view(bool)
            total[at] += np.frombuffer(sums, f"u{len(sums) // np.count_nonzero(at)}").astype(np.int64)
        return pd.DataFrame({"row": parts["row"][:1], "classes": [np.frexp(total.astype(float))[1].astype(np.uint8).tobytes()]})

    cells = docs.select("text").mapInArrow(count, "row long, at binary, sums binary").groupBy("row").applyInPandas(add, "row long, classes binary")
    found = np.zeros(1 << bits, np.uint8)
    with shuffles_cleared(docs.sparkSession):
        rows = cells.collect()  # one byte a cell
    for r in rows:
        found[r["row"] : r["row"] + SKETCH_ROW] = np.frombuffer(bytes(r["classes"]), np.uint8)
    return found


def _codes(some: np.ndarray, classes: np.ndarray) -> np.ndarray:
    at = (some & np.uint64(len(classes) - 1)).astype(np.int64)
    return np.sort((classes[at].astype(np.uint64) << np.uint64(58)) | some)


def _class_of(some: np.ndarray, salt: int) -> int:
    """A 64-bit name of a set; other salts give names that do not depend on each other."""
    salted = mix(some ^ mix(np.array([salt + 1], np.uint64)))
    return int((salted.sum(dtype=np.uint64) + np.uint64(len(some))).astype(np.int64)) if len(some) else 0


def prefix_length(n: int, top: int = TOP, bottom: int = BOTTOM) -> int:
    return n - -(-top * n // bottom) + 1 if n else 0


def shingle_table(docs: DataFrame, classes: np.ndarray, width: int, top: int, bottom: int, salt: int) -> DataFrame:
    """(doc_id, text_key, n, cls, proof, prefix): hash of the text, set size, the set's two names, its rarest codes."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, cls, proof, ends, codes = [], [], [], [0], []
            for some in shingle_sets(_texts(batch), width):
                own = _codes(some, shared.value)[: prefix_length(len(some), top, bottom)]
                n.append(len(some))
                cls.append(_class_of(some, salt))
                proof.append(_class_of(some, salt + 1))
                codes.append(own)
                ends.append(ends[-1] + len(own))
            flat = np.concatenate(codes).view(np.int64) if codes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int32()), pa.array(cls, pa.int64()), pa.array(proof, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n", "cls", "proof", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(read, f"doc_id {kind}, text_key long, n int, cls long, proof long, prefix array<long>")


def shingle_codes(docs: DataFrame, wanted: DataFrame, classes: np.ndarray, width: int, salt: int) -> DataFrame:
    """(cls, codes): the whole sets, as packed sorted codes, of ``wanted`` (cls, text_key), once each.

    Texts that are not wanted never leave the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cls, codes = [], []
            for some in shingle_sets(_texts(batch), width):
                cls.append(_class_of(some, salt))
                codes.append(_codes(some, shared.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(codes, pa.binary())], ["cls", "codes"])

    keys = broadcast_if(wanted.select("text_key"))
    rows = docs.select("text", F.xxhash64("text").alias("text_key")).join(keys, "text_key", "left_semi").select("text").mapInArrow(read, "cls long, codes binary")
    return rows.groupBy("cls").agg(F.first("codes").alias("codes"))


def _similar(batches: Iterator[pa.RecordBatch], top: int, bottom: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            n = len(x) + len(y)
            # suffix filter: codes below and above the middle of x can only meet their like in y
            middle = len(x) // 2
            at = int(np.searchsorted(y, x[middle]))
            most = min(middle, at) + min(len(x) - middle, len(y) - at)
            if bottom * most < top * (n - most):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = bottom * both >= top * (n - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def linked(pairs: DataFrame, own: DataFrame, docs: DataFrame, classes: np.ndarray, width: int, top: int, bottom: int, salt: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of classes that are similar enough, as a stored table.

    Of two prefixes the one that ends first holds all that its set shares with the other one so far:
    what the prefixes share, with all that follows in a set, bounds the overlap. The few pairs that this
    admits meet their whole sets.
    """
    sides = [own.select(F.col("cls").alias(k), F.col("n").alias(f"{k}_n"), F.col("prefix").alias(f"{k}_prefix"), F.col("text_key").alias(f"{k}_key")) for k in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    most = F.size(F.array_intersect("a_prefix", "b_prefix")) + F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    near = stored(met.where(bottom * most >= top * (F.col("a_n") + F.col("b_n") - most)).select("a", "b", "a_key", "b_key"), "near")
    wanted = stored(near.select(F.col("a").alias("cls"), F.col("a_key").alias("text_key")).union(near.select("b", "b_key")).distinct(), "wanted")
    sets = stored(shingle_codes(docs, wanted, classes, width, salt), "sets")
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("codes").alias("x")), "a").join(
        sets.select(F.col("cls").alias("b"), F.col("codes").alias("y")), "b"
    )
    out = stored(both.select("a", "b", "x", "y").mapInArrow(lambda batches: _similar(batches, top, bottom), "a long, b long"), "links")
    discard(near, wanted, sets)
    return out


def _print_of(edges: DataFrame) -> tuple:
    """Count and 128 bits of a set of edges: equal for equal sets."""
    with shuffles_cleared(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u")), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): for each end of a link (a, b) the smallest class it is connected with, as a stored table.

    Alternating large-star and small-star steps, each an aggregation and a join, until nothing changes.
    """
    edges = stored(links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    before, now = None, _print_of(edges)
    while now != before:
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("e"))
        new = stored(small.select(F.col("e.m").alias("v"), F.col("e.u").alias("u")).where("u <> v").distinct(), "edges")
        discard(edges)
        edges, before, now = new, now, _print_of(new)
    out = stored(edges.select(F.col("u").alias("cls"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()), "comps")
    discard(edges)
    return out


def _close(a: str, b: str, top: int, bottom: int) -> str:
    """Length and position filters for rows of one code: SQL condition over n and pos of both sides.

    At their first common code two sets still have at most so many codes in common as follow it.
    """
    most = f"least({a}n - {a}pos, {b}n - {b}pos)"
    return (
        f"{bottom}L * least({a}n, {b}n) >= {top}L * greatest({a}n, {b}n)"
        f" and {bottom}L * {most} >= {top}L * ({a}n + {b}n - {most})"
    )


def similar_classes(docs: DataFrame, own: DataFrame, classes: np.ndarray, width: int, top: int, bottom: int, salt: int) -> DataFrame:
    """(cls, comp) for those of the classes ``own`` (cls, text_key, n, prefix) that are linked with another one."""
    rows = own.select("cls", "n", F.posexplode("prefix").alias("pos", "tok"))
    met = rows.groupBy("tok").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("tok")
    rows = stored(rows.join(met, "tok"), "prefixes")

    # the leader of a code: the set that shares most of its prefix, as an original does with its copies
    rank = rows.groupBy("cls").agg((F.count("*") * 1000 / F.first("n")).cast("int").alias("rank"))
    ranked = rows.join(rank, "cls")
    lead = ranked.groupBy("tok").agg(F.max(F.struct("rank", "cls", "n", "pos")).alias("l")).select("tok", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("cls", "n", "pos")))
    near = rows.join(lead, "tok").where("cls <> l_cls").where(_close("", "l_", top, bottom))
    pairs = stored(near.select(F.least("cls", "l_cls").alias("a"), F.greatest("cls", "l_cls").alias("b")).distinct(), "pairs")
    links = linked(pairs, own, docs, classes, width, top, bottom, salt)

    comps = components(links)
    placed = rows.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("tok")
    apart = stored(placed.join(mixed, "tok"), "apart")
    discard(rows, links)
    # rows of a code meet only where its places and their sizes allow a link at all: a template's code that
    # stands behind words of their own in all prefixes pairs nothing
    groups = apart.groupBy("tok", "n", "pos").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    gx, gy = (groups.select("tok", *(F.col(c).alias(f"{side}_{c}") for c in ("n", "pos", "lo", "hi"))) for side in "xy")
    allowed = gx.join(gy, "tok").where(f"x_lo < y_hi and {_close('x_', 'y_', top, bottom)}").select("tok", "x_n", "x_pos", "y_n", "y_pos")
    allowed = stored(allowed, "allowed")
    x, y = (apart.select("tok", *(F.col(c).alias(f"{side}_{c}") for c in ("cls", "n", "pos", "comp"))) for side in "xy")
    rest = x.join(allowed, ["tok", "x_n", "x_pos"]).join(y, ["tok", "y_n", "y_pos"]).where("x_comp < y_comp")
    rest = rest.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct()
    rest = stored(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    discard(apart, pairs, allowed)
    more = linked(rest, own, docs, classes, width, top, bottom, salt)
    discard(rest)
    if not more.isEmpty():  # the components so far are stars, to be linked further
        comps, stars = components(comps.select(F.col("cls").alias("a"), F.col("comp").alias("b")).union(more)), comps
        discard(stars)
    discard(more)
    return comps


def near_duplicates(docs: DataFrame, width: int = WIDTH, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, comp) for each row of ``docs`` (doc_id, text).

    A row's set: its distinct ``width``-word shingles (white-space words, A-Z lower-cased); of fewer
    words, all of them as one. Rows link when bottom * intersection >= top * union. component_id is
    the least doc_id that links reach (null ids count as none: null if a component has no other);
    comp names the component. Rows without words or text have n_shingles 0, no links, their own
    doc_id as component_id and a null comp. Repeated rows and ids, ties and other columns are fine:
    rows are grouped by what they contain. Texts of any length are read whole, one at a time past
    a block's size; an empty table gives no rows. text_key is xxhash64 of the text.

    Sets are named by 64 bits and proved by 64 more; were two sets to share a name, all are named anew.
    """
    docs = docs.select("doc_id", "text")
    classes = frequency_sketch(docs, width)
    salt, clash = 0, True
    while clash:
        table = stored(shingle_table(docs, classes, width, top, bottom, salt), "shingles")
        own = table.where("n > 0").groupBy("cls").agg(F.min(F.struct("text_key", "n", "prefix")).alias("s"), F.min("doc_id").alias("least"), (F.min("proof") < F.max("proof")).alias("clash"))
        own = stored(own.select("cls", "s.*", "least", "clash"), "classes")
        if clash := not own.where("clash").isEmpty():
            discard(table, own)
            salt += 2
    comps = similar_classes(docs, own.select("cls", "text_key", "n", "prefix"), classes, width, top, bottom, salt)
    named = stored(own.select("cls", "least").join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "named")
    roots = stored(named.groupBy("comp").agg(F.min("least").alias("component_id")), "roots")
    # stored apart, so that the rows of a large component can be split in this join
    names = stored(named.join(broadcast_if(roots), "comp").select("cls", "comp", "component_id"), "names")
    discard(own, comps, named, roots)
    full = table.where("n > 0").select("doc_id", "text_key", "n", "cls")
    empty = table.where("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    found = full.join(names, "cls").select("doc_id", "text_key", "n", "component_id", "comp").unionByName(empty)
    found = stored(found.select("doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"), "component_id", "comp"), "found")
    discard(table, names)
    return found


def deduplicate(docs: DataFrame, width: int = WIDTH, top: int = TOP, bottom: int = BOTTOM) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id (nulls last).

    Rows with the same doc_id and text count as one. Rows without words stay.
    """
    every = near_duplicates(docs, width, top, bottom)
    found = every.where("comp is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = found.groupBy("comp").agg(F.min(order).alias("b"), F.count("*").alias("k")).where("k > 1").select("comp", "b")
    best = stored(best, "best")
    twins = found.join(broadcast_if(best), "comp").withColumn("out", ~order.eqNullSafe(F.col("b")))
    marks = stored(twins.groupBy("doc_id", "text_key").agg(F.max("out").alias("out"), F.count("*").alias("k")).where("out or k > 1"), "marks")
    discard(every, best)
    d, t, out = (unused(name, docs.columns) for name in ("of_doc", "of_text", "out"))
    marks = marks.select(F.col("doc_id").alias(d), F.col("text_key").alias(t), F.col("out").alias(out))
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    if not (twice := marks.where(~F.col(out)).drop(out)).isEmpty():
        return docs.join(broadcast_if(marks), on, "left_anti").unionByName(docs.join(broadcast_if(twice), on, "left_semi").dropDuplicates(["doc_id", "text"]))
    return docs.join(broadcast_if(marks), on, "left_anti")


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM
      (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS root, doc_id AS node FROM n UNION SELECT r.root, l.y FROM r JOIN l ON l.x = r.node),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
