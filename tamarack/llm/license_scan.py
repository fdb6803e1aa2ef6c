"""License scans: TF-IDF cosine of headers and license files to templates, then inheritance by directory.

A text is compared in units: its lines, its paragraphs, its runs of comment lines and, if it is a license
file or short, all of it. A unit that reaches the cosine with a template must hold one of the
template's weightiest words (the others together stay below it), so one search for those words passes
over almost all texts. The units left become sparse vectors, rows of (unit, word, weight), which meet
the templates' vectors by a join on words. A directory takes the license of its license files; a file
without one of its own takes that of its nearest ancestor directory, found by joining directory
paths. Everything is built from DataFrame and SQL functions.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, stored, unused
from .license_templates import TEMPLATES

COSINE = 0.7
#: The weight of a word that all documents hold.
FLOOR = 0.1
#: A text with at most so many words is compared as a whole, and is a license file if it has a license.
SHORT = 300
#: Between paragraphs; and a run of lines that open with a comment mark.
_BLANK = r"\n[^A-Za-z0-9]*\n"
_COMMENT = r"(?m)(?:^[ \t]*+(?:/?\*|//|#|--|;|%|<!--)[^\n]*+\n?)++"


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), "")


def document_counts(docs: DataFrame) -> DataFrame:
    """(w, n): the documents that hold each word; the empty word counts all documents."""
    held = F.array_distinct(text_words(F.col("text")))
    return docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def inverse_frequency(n: int, held: int) -> float:
    """A word's weight: held by ``held`` of ``n`` documents."""
    return math.log((1 + n) / (1 + held)) + FLOOR


def times(k: int) -> float:
    """What a word counts that a unit holds ``k`` times: little more than once, as else articles would lead."""
    return 1 + math.log(k)


def template_vectors(templates: dict[str, list[str]], counts: DataFrame) -> tuple[dict[tuple[str, int], dict[str, float]], int]:
    """The unit vector of each template, by license and place; and the number of documents."""
    vocabulary = sorted({w for texts in templates.values() for t in texts for w in words(t)})
    held = {r["w"]: r["n"] for r in counts.where(F.col("w").isin(["", *vocabulary])).collect()}  # a row a word
    n, out = held.get("", 0), {}
    for name, texts in templates.items():
        for i, text in enumerate(texts):
            raw = {w: times(k) * inverse_frequency(n, held.get(w, 0)) for w, k in Counter(words(text)).items()}
            norm = math.sqrt(sum(v * v for v in raw.values()))
            out[name, i] = {w: v / norm for w, v in raw.items()}
    return out, n


def _anchors(vectors: list[dict[str, float]], cosine: float) -> list[str]:
    """Words of which a unit that is close enough to a template must hold at least one."""
    found = set()
    for vector in vectors:
        rest = 1.0
        for word, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < cosine * cosine:
                break
            found.add(word)
            rest -= v * v
    return sorted(found)


def _units(text: Column, whole: Column) -> Column:
    """array<struct<i, x>>: a text's units, each with its place among its kind; first ones have 0."""
    at = lambda xs: F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    comments = F.transform(
        F.regexp_extract_all(text, F.lit(_COMMENT), F.lit(0)), lambda x, i: F.struct(F.when(text.startswith(x), 0).otherwise(i + 1).alias("i"), x.alias("x"))
    )
    return F.concat(at(F.split(text, r"\n")), at(F.split(text, _BLANK)), comments, F.when(whole, at(F.array(text))).otherwise(F.array().cast("array<struct<i: int, x: string>>")))


def closest_templates(texts: DataFrame, templates: dict[str, list[str]] | None = None, cosine: float = COSINE) -> DataFrame:
    """(of_text, license, score, first, short) for each distinct text of ``texts`` (text, whole) with a license.

    of_text: xxhash64 of the text. license and score are the closest template's, over all units of the
    text; ``first`` tells that the unit opens the text, ``short`` that the text has at most SHORT words.
    Ties: the first place, then the first name. A unit counts only if it shares two words with the
    template. ``whole``: compare all of the text too, whatever its length. Null text has no units.
    The result is a stored table.
    """
    templates = templates or TEMPLATES
    spark = texts.sparkSession
    counts = stored(document_counts(texts), "word_counts")
    vectors, n = template_vectors(templates, counts)
    search = r"(?i)(?<![a-z0-9])(?:" + "|".join(_anchors(list(vectors.values()), cosine)) + r")(?![a-z0-9])"

    text = F.col("text")
    held = texts.where(text.rlike(search)).select(F.xxhash64(text).alias("of_text"), "text", (F.size(text_words(text)) <= SHORT).alias("short"), F.coalesce("whole", F.lit(False)).alias("whole"))
    hits = F.filter(_units(text, F.col("whole") | F.col("short")), lambda s: s["x"].rlike(search))
    held = held.select("of_text", "short", F.explode(hits).alias("s")).select("of_text", "short", (F.col("s.i") == 0).alias("first"), F.col("s.i").alias("i"), F.xxhash64("s.x").alias("of"), F.col("s.x").alias("x"))
    held = stored(held, "units")

    # units as rows of words; equal units are judged once, whatever texts they stand in
    terms = held.select("of", "x").dropDuplicates(["of"]).select("of", F.explode(text_words(F.col("x"))).alias("w")).groupBy("of", "w").agg(F.count("*").alias("k"))
    counted = stored(terms, "terms")
    weight = (F.log((1 + F.lit(n)) / (1 + F.col("n"))) + FLOOR).alias("idf")
    idf = stored(counts.join(counted.select("w").distinct(), "w", "left_semi").select("w", weight), "idf")
    terms = counted.join(broadcast_if(idf), "w").select("of", "w", ((1 + F.log("k")) * F.col("idf")).alias("v"))
    squares = terms.groupBy("of").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    rows = [{"license": name, "template": i, "w": w, "t": v} for (name, i), vector in vectors.items() for w, v in vector.items()]
    rows = F.from_json(F.lit(json.dumps(rows)), "array<struct<license: string, template: int, w: string, t: double>>")
    known = F.broadcast(spark.range(1).select(F.inline(rows)))  # the templates alone, of fixed size
    dots = terms.join(known, "w").groupBy("of", "license", "template").agg(F.sum(F.col("v") * F.col("t")).alias("dot"), F.count("*").alias("shared")).where("shared > 1")
    scored = dots.join(squares, "of").select("of", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= cosine)
    judged = stored(scored.groupBy("of").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("b")).select("of", "b.*"), "judged_units")

    found = held.select("of_text", "short", "first", "i", "of").join(broadcast_if(judged), "of")
    best = found.groupBy("of_text").agg(F.min(F.struct("minus", "i", "license")).alias("b"), F.bool_or("first").alias("first"), F.first("short").alias("short"))
    best = stored(best.select("of_text", F.col("b.license").alias("license"), (-F.col("b.minus")).alias("score"), "first", "short"), "best_units")
    discard(counts, held, counted, idf, judged)
    return best


def _ancestors(directory: Column) -> Column:
    """A directory and all above it, as array<struct<depth, dir>>; the root is the empty path."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))


def scan_licenses(files: DataFrame, templates: dict[str, list[str]] | None = None, cosine: float = COSINE) -> DataFrame:
    """``files`` (path, text) with own_license, score, license and license_dir.

    own_license: of the text's unit closest to a template (``closest_templates``). license: the own one,
    else that of the nearest directory upwards that has one (license_dir). A directory's license is
    that most of its license files have (ties: the first name); a license file is one with a license
    that opens with it, that has at most SHORT words, or that is named LICENSE, LICENCE or COPYING. A
    null path counts as a file of the root directory; null or empty text has no license of its own; repeated
    rows are judged each; texts of any length are compared whole, in their units; an empty table
    stays empty. The four added columns replace those in ``files``; all others stay, whatever their names.
    """
    path = F.coalesce(F.col("path"), F.lit(""))
    directory = F.regexp_replace(path, r"/?[^/]*$", "")
    named = path.rlike(r"(?i)(^|/)(licen[sc]e|copying)[^/]*$")
    best = closest_templates(files.select("text", named.alias("whole")), templates, cosine)
    own = broadcast_if(best)
    votes = files.select(directory.alias("dir"), named.alias("named"), F.xxhash64("text").alias("of_text")).join(own, "of_text")
    votes = votes.where("named or first or short").groupBy("dir", "license").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("m"))
    chosen = stored(chosen.select("dir", F.col("m.license").alias("of_dir")), "licensed")
    above = files.select(directory.alias("of")).distinct().select("of", F.explode(_ancestors(F.col("of"))).alias("a")).select("of", "a.*")
    near = above.join(broadcast_if(chosen), "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "of_dir")).alias("m"))
    near = stored(near.select("of", "m.dir", "m.of_dir"), "inherited")
    discard(chosen)

    a, b, c, d, e, f = (unused(x, files.columns) for x in ("own_text", "own_name", "own_score", "near_of", "near_dir", "near_name"))
    out = files.join(own.select(F.col("of_text").alias(a), F.col("license").alias(b), F.col("score").alias(c)), F.xxhash64("text") == F.col(a), "left")
    out = out.join(broadcast_if(near).select(F.col("of").alias(d), F.col("dir").alias(e), F.col("of_dir").alias(f)), directory == F.col(d), "left")
    new = {"own_license": F.col(b), "score": F.col(c), "license_dir": F.when(F.col(b).isNull(), F.col(e)), "license": F.coalesce(b, f)}
    return out.withColumns(new).drop(a, b, c, d, e, f)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a tree of directories: source, thousands, fifties
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", "source", step(1000), step(50), F.col("doc_id").cast("string"))
    scanned = scan_licenses(docs.select("doc_id", path.alias("path"), "text"))
    return scanned.select("doc_id", "path", "own_license", F.round("score", 6).alias("score"), "license", "license_dir")
