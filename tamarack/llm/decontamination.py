"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams.

Training texts are turned into their windows' hashes in one pass and looked up in the broadcast set;
candidates meet the windows themselves by hash and words before they count, so only these few are
shuffled, never whole texts. Built from SQL functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, broadcast_if, discard, stored, unused

#: Rows of the set of bits, in bits: of 64 bits each, they stay within the bound of a broadcast.
SLOT_BITS = 19
#: What is not a word character once A-Z are in lower case.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Words of digits, a-z and all beyond ASCII, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), _GAP), "")


def benchmark_windows(benchmark: DataFrame, width: int = 10) -> DataFrame:
    """(h, n, gram, item): the distinct windows of each item, with their hash and number of words.

    An item with fewer words than ``width``, but not none, is one window. Null or empty items have none.
    """
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    grams = words.where(F.size("w") > 0).select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("gram"))
    return grams.distinct().select(F.xxhash64("gram").alias("h"), F.size("gram").alias("n"), "gram", "item")


def _hash_set(grams: DataFrame) -> tuple[DataFrame, Column]:
    """What of a window's hash ``h`` is looked up in the broadcast set, and the test of what is found.

    The set is one of hashes while these fit the bound of a broadcast. Beyond it is one of bits, of
    fixed size: rows of 64 bits, found by the lowest bits of a hash, of which the next six choose one.
    """
    hashes = grams.select("h").distinct()
    if hashes.count() * 64 <= BROADCAST_BYTES:
        return hashes.select(F.col("h").alias("slot")), F.lit(True)
    place = F.shiftrightunsigned("h", SLOT_BITS).bitwiseAND(F.lit(63)).cast("int")
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {SLOT_BITS}) & 63 as int))")
    rows = hashes.select(_slot(F.col("h")).alias("slot"), one.alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return rows, F.getbit("bits", place) == 1


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the ``keep`` columns, n_words, spans (array<struct<at, n>>: word
    places, from 1, and lengths of benchmark windows found) and items (array<string>, sorted).

    Null or wordless text has no words and no spans; ids may be null or repeat, as rows are told apart
    by the ``keep`` columns and their text's hash, and equal ones are hit alike; an empty benchmark
    finds nothing, an empty table gives no rows. Whole texts count, whatever their length; other
    columns do not matter. Of a benchmark of any size a set of bounded size is broadcast.
    """
    grams = stored(benchmark_windows(benchmark, width), "windows")
    lengths = sorted({width} | {r["n"] for r in grams.select("n").distinct().collect()})  # at most ``width``
    wanted, holds = _hash_set(grams)
    exact = "bits" not in wanted.columns
    own = F.struct(*(F.col(c) for c in keep), F.xxhash64("text").alias("_text"))

    # Explode, hash and lookup in the broadcast set are one generated loop, in which only the words of
    # candidate windows are copied.
    places = F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1))
    spread = docs.select(own.alias("_key"), normal_words(F.col("text")).alias("_w")).select("*", F.explode(places).alias("_i"))
    number = F.lit(width) if lengths == [width] else F.explode(F.array(*map(F.lit, lengths)))
    spread = spread.select("*", number.alias("_n"))
    words = [F.get("_w", F.col("_i") + j) for j in range(max(lengths))]
    h = F.lit(None).cast("long")
    for n in lengths:
        h = F.when((F.col("_n") == n) & (F.col("_i") + n <= F.size("_w")), F.xxhash64(*words[:n])).otherwise(h)
    spread = spread.withColumn("h", h).withColumn("slot", F.col("h") if exact else _slot(F.col("h")))
    met = spread.join(F.broadcast(wanted), "slot").where(holds)
    met = met.select("_key", (F.col("_i") + 1).alias("at"), F.col("_n").alias("n"), "h", F.slice("_w", F.col("_i") + 1, F.col("_n")).alias("gram"))

    real = stored(grams.select("h", "gram").distinct(), "grams")
    hits = stored(met.join(broadcast_if(real), ["h", "gram"]), "hits")  # verified word by word
    held = hits.select("_key", "h", "gram").distinct().join(broadcast_if(grams.select("h", "gram", "item")), ["h", "gram"])
    items = held.select("_key", "item").distinct().groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    spans = hits.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    marks = stored(spans.join(items, "_key"), "marks")
    discard(grams, real, hits)
    rows = docs.select(own.alias("_key"), F.size(normal_words(F.col("text"))).cast("long").alias("n_words"))
    found = rows.join(broadcast_if(marks.withColumnRenamed("_key", "_of")), F.col("_key").eqNullSafe(F.col("_of")), "left")
    return found.select(*(F.col("_key")[c].alias(c) for c in keep), "n_words", *(_or_empty(c, marks) for c in ("spans", "items")))


def _or_empty(column: str, like: DataFrame) -> Column:
    kind = like.schema[column].dataType.simpleString()
    return F.coalesce(column, F.expr("array()").cast(kind)).alias(column)


def covered_words(spans: Column) -> Column:
    """Words inside at least one of the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            F.greatest(a["end"], (s["at"] + s["n"]).cast("long")).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"].cast("long")))).cast("long").alias("n"),
        ),
    )["n"]


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, spans_only: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window, or without only its words.

    ``spans_only``: documents with hits stay, as their normalised words outside all hits.
    Untouched documents keep their text as it is. Rows with null or empty text stay.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    hit = contaminated_spans(keyed, benchmark, width, ("doc_id", "_key")).where(F.size("spans") > 0)
    d, t, spans = (unused(name, docs.columns) for name in ("of_doc", "of_text", "spans"))
    found = hit.select(F.col("doc_id").alias(d), F.col("_key").alias(t), F.col("spans").alias(spans))
    # equal ids with equal texts are hit alike, so id and text hash are key enough
    found = stored(found.dropDuplicates([d, t]), "hits")
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t))
    if not spans_only:
        return docs.join(broadcast_if(found.drop(spans)), on, "left_anti")
    inside = lambda i: F.exists(spans, lambda s: (s["at"] <= i) & (i < s["at"] + s["n"]))
    words = F.filter(normal_words(F.col("text")), lambda w, i: ~inside(i + 1))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.array_join(words, " "))
    return docs.join(broadcast_if(found), on, "left").withColumn("text", text).drop(d, t, spans)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contaminated_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = covered_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, array_to_string(w[i:i+9], ' ') AS gram, least(len(w), 10) AS n
      FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
h AS (SELECT o.doc_id, o.n, o.i, g.item FROM o JOIN g ON o.gram = g.gram AND o.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
