"""The corpus pipeline: language ID, near duplicates, decontamination, secrets, and the mix.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of ``documents``, with whatever further columns it has, under any names. Every
stage reads whole texts of any length, one row at a time, and gives no rows for an empty table;
ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import stored, table
from tamarack.llm.decontamination import remove_contaminated
from tamarack.llm.language_id import fit_filters, held_out, identify_languages
from tamarack.llm.mixing import mix_sources
from tamarack.llm.ngram_join import deduplicate
from tamarack.llm.secret_scans import redact

#: A document stays if this share of its n-grams belongs to the language that it is given.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too), or that no learned language fits, go.

    Each row is judged by its text alone, so repeated rows stay or go together. With nothing to learn
    from, all go. Ties between languages do not matter: only the score does.
    """
    filters = fit_filters(docs.where(~held_out(F.col("doc_id"))))
    judged = identify_languages(docs, filters)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id, null ids last.

    Of repeated rows (equal id and text) one stays. Null and wordless texts are copies of nothing and stay.
    """
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and wordless texts hold none and stay.

    Repeated rows stay or go together; an empty benchmark removes nothing.
    """
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows; null and empty texts stay as they are.

    Overlapping secrets get one mark; repeated rows are treated alike.
    """
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The readings of the mix, every document at least once: (doc_id, source, n_tokens, weight, epoch, block, place).

    Null and wordless texts have no tokens and are read with each epoch; a null source is the empty one;
    repeated rows are read each; ties in the order go by id and length.
    """
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: A learned filter decides in the first stage: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
