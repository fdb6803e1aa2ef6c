"""Language identification by n-gram filters with a bit for each language.

Training counts character n-grams of labelled texts in Spark and keeps, for each language, those that
are about as frequent there as anywhere. All languages share one bit-sliced Bloom filter: a slot
holds a mask with one bit for each language, and the AND of an n-gram's slots gives every language
that holds it, at once. A text's mask bits are counted for each language, the counts are corrected for
the filter's own rate of false positives, and the highest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, discard, mix, stored, unused

#: Characters of an n-gram; runs of other than letters count as one space.
WIDTH = 4
#: Bound of the sample that the filters are fitted on: texts a language, chosen by a hash of the text.
TRAIN_TEXTS = 4000
#: Bounds of the filter's slots in bits, slots wanted for each n-gram of a language, and hashes of an n-gram.
SLOT_BITS, SLOTS_A_GRAM, HASHES = (16, 22), 8, 3


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; each run of anything else is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter(codes)
    keep = letter | np.concatenate([[True], letter[:-1]])
    return np.where(letter, codes, np.uint32(32))[keep]


_LETTERS = np.zeros(0, bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS[codes]


def ngram_keys(text: str, width: int = WIDTH) -> np.ndarray:
    """A 64-bit key for each n-gram of a text, repeats included; long texts go block by block.

    Letters too few for an n-gram (one between spaces) are padded with spaces to one, if the text has no other.
    """
    parts, short = [], []
    for start in range(0, len(text), BLOCK_BYTES):
        codes = _codes(" " + text[start : start + BLOCK_BYTES + width - 1] + " ").astype(np.uint64)
        if len(codes) >= width:
            parts.append(_keys(codes, width))
        elif (codes != 32).any():
            short.append(_keys(np.pad(codes, (0, width - len(codes)), constant_values=32), width))
    return np.concatenate(parts or short) if parts or short else np.zeros(0, np.uint64)


def _keys(codes: np.ndarray, width: int) -> np.ndarray:
    n = len(codes) - width + 1
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = key * np.uint64(1 << 21) + codes[j : j + n] if j < 3 else mix(key) + codes[j : j + n]
    return key


@dataclass(frozen=True)
class Filters:
    """The bit-sliced filter: a byte row for each slot, a bit for each language in ``langs``."""

    langs: list[str]
    slots: np.ndarray
    rates: np.ndarray

    @staticmethod
    def of_slots(langs: list[str], slots: np.ndarray) -> Filters:
        """Filters over filled ``slots``, with each language's rate of false positives."""
        filled = np.array([((slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(langs))])
        return Filters(langs, slots, filled**HASHES)

    @staticmethod
    def build(kept: dict[str, np.ndarray], slot_bits: int = SLOT_BITS[0]) -> Filters:
        """Filters that hold the n-gram keys of each language."""
        langs = sorted(kept)
        slots = np.zeros((1 << slot_bits, max(1, -(-len(langs) // 8))), np.uint8)
        for i, lang in enumerate(langs):
            for at in _places(kept[lang], slot_bits):
                slots[at, i // 8] |= np.uint8(1 << (i % 8))
        return Filters.of_slots(langs, slots)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The languages that hold each n-gram, as packed bits."""
        bits = int(len(self.slots)).bit_length() - 1
        found = None
        for at in _places(keys, bits):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def shares(self, keys: np.ndarray) -> np.ndarray:
        """For each language the share of n-grams that it holds, corrected for false positives."""
        masks, n = self.masks(keys), len(keys)
        counts = np.zeros(len(self.langs))
        for column in range(masks.shape[1]):
            seen = np.bincount(masks[:, column], minlength=256)
            for i in range(column * 8, min(column * 8 + 8, len(self.langs))):
                counts[i] = seen[(np.arange(256) >> (i % 8)) & 1 == 1].sum()
        return np.clip((counts / n - self.rates) / (1 - self.rates), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        keys = ngram_keys(text) if text else np.zeros(0, np.uint64)
        if not len(keys) or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        shares = self.shares(keys)
        best = int(np.argmax(shares))  # ties: the first language by name
        return self.langs[best], float(shares[best])


def _places(keys: np.ndarray, bits: int):
    h = mix(keys)
    for i in range(HASHES):
        yield ((h >> np.uint64(i * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of n-grams by language, merged within a task before they are shuffled."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in parts:
        for lang, texts in part.groupby("lang")["text"]:
            for some in _grouped(texts):
                old, m = sums.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                new, n = np.unique(np.concatenate([ngram_keys(t) for t in some]), return_counts=True)
                merged, where = np.unique(np.concatenate([old, new]), return_inverse=True)
                sums[lang] = merged, np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                if len(merged) > 500_000:
                    yield _frame(lang, *sums.pop(lang))
    for lang, (keys, n) in sums.items():
        yield _frame(lang, keys, n)


def _grouped(texts):
    """Texts in lists of about BLOCK_BYTES characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _frame(lang: str, keys: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})


def fit_filters(labelled: DataFrame, train_texts: int = TRAIN_TEXTS) -> Filters:
    """Filters learned from ``labelled`` (text, lang).

    Rows without text or lang teach nothing. At most about ``train_texts`` distinct texts a language
    are used, those whose text hashes lowest; with fewer, all. Of the n-grams met more than once, each
    belongs to the languages where it is at least half as frequent as where it is most frequent. All
    of them go into the filter, whose slots follow their number within SLOT_BITS; a filter that fills
    up has a higher rate of false positives, for which the shares are corrected.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    # distinct texts, by the hash that chooses them: copies must not thin out the others
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(train_texts)) / F.countDistinct(F.xxhash64("text"))).alias("share"))
    share = {r["lang"]: r["share"] for r in share.collect()}  # one row a language
    if not share:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    chosen = F.lit(False)
    for lang, part in share.items():
        below = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20)))
        chosen = F.when(F.col("lang") == lang, below).otherwise(chosen)
    # one text may hold much of the rows: once is enough
    counts = rows.where(chosen).dropDuplicates().mapInPandas(_counted, "lang string, key bigint, n bigint")
    counts = stored(counts.groupBy("lang", "key").agg(F.sum("n").alias("n")), "ngrams")
    totals = F.create_map(*(c for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect() for c in (F.lit(r["lang"]), F.lit(r["n"]))))
    rate = F.struct(F.col("lang"), (F.col("n") / totals[F.col("lang")]).alias("rate"))
    grams = counts.where("n > 1").groupBy("key").agg(F.collect_list(rate).alias("at"))  # a row a language at most
    owned = F.filter("at", lambda x: 2 * x["rate"] >= F.array_max("at.rate"))
    grams = stored(grams.select("key", F.transform(owned, lambda x: x["lang"]).alias("langs")), "owned")
    discard(counts)

    langs = sorted(share)
    sizes = [r["n"] for r in grams.select(F.explode("langs").alias("lang")).groupBy("lang").agg(F.count("*").alias("n")).collect()]
    bits = min(max((max(sizes, default=1) * SLOTS_A_GRAM).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    slots = np.zeros((1 << bits, max(1, -(-len(langs) // 8))), np.uint8)
    filled = grams.mapInPandas(lambda parts: _filled(parts, langs, bits), "slot int, part int, mask int").groupBy("slot", "part").agg(F.bit_or("mask").alias("mask"))
    some = filled.toPandas()  # at most a row a byte of the slots
    slots[some["slot"].to_numpy(), some["part"].to_numpy()] = some["mask"].to_numpy()
    discard(grams)
    return Filters.of_slots(langs, slots)


def _filled(parts: Iterator[pd.DataFrame], langs: list[str], bits: int) -> Iterator[pd.DataFrame]:
    """The slots that n-grams fill, as bytes (slot, part, mask) of eight languages each."""
    number = {lang: i for i, lang in enumerate(langs)}
    for part in parts:
        keys = np.repeat(part["key"].to_numpy(np.int64).view(np.uint64), part["langs"].map(len))
        of = np.array([number[lang] for held in part["langs"] for lang in held], np.int64)
        cells = np.concatenate([at * len(langs) + of for at in _places(keys, bits)])
        slot, lang = np.divmod(np.unique(cells), max(1, len(langs)))
        yield pd.DataFrame({"slot": slot, "part": lang // 8, "mask": 1 << (lang % 8)})


def identify_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with lang_pred (a learned language, or `und`) and score (0 to 1) added or replaced.

    `und`, with score 0: null text, text without a letter, or nothing learned. Ties: the first language
    by name. Each row is judged by its whole text alone, block by block if it is very long, so
    repeated rows and ids, and other columns, do not matter; an empty table gives no rows. No
    shuffle; the filters, of bounded size, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    predict.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    judge = F.pandas_udf(predict, "lang_pred string, score double")
    fresh = unused("judged", docs.columns)
    judged = docs.withColumn(fresh, judge(F.col("text")))
    return judged.withColumns({"lang_pred": F.col(fresh)["lang_pred"], "score": F.col(fresh)["score"]}).drop(fresh)


def held_out(doc_id) -> F.Column:
    """The part of the documents that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    filters = fit_filters(docs.where(~held_out(F.col("doc_id"))))
    judged = identify_languages(docs.select("doc_id", "text"), filters)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
