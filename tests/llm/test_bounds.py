"""Long texts, many matches, rows without ids, leftovers in the shared folder, and filters against plain sets."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import language_id, license_scan, media_columns, mixing, ngram_join, queries, secret_scans, substring_dedup, token_counts


def grams(text):
    out, last = [], None
    for c in f" {text} ".lower():
        c = c if c.isalpha() else " "
        if not (c == " " and last == " "):
            out.append(c)
        last = c
    return ["".join(out[i : i + 4]) for i in range(len(out) - 3)]


def test_filters_against_plain_sets(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(80)] for lang, letters in {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}.items()}
    make = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(make(lang, 40), lang) for lang in words for _ in range(60)]
    rows += rows[:20]  # copies teach once
    filters = language_id.fit_filters(spark.createDataFrame(rows, "text string, lang string"))
    counts = {lang: Counter() for lang in words}
    for text, lang in set(rows):
        counts[lang].update(grams(text))
    totals = {lang: sum(c.values()) for lang, c in counts.items()}
    rate = {g: {lang: c[g] / totals[lang] for lang, c in counts.items() if c[g] > 1} for g in set().union(*counts.values())}
    held = {lang: {g for g, r in rate.items() if r and 2 * r.get(lang, 0) >= max(r.values())} for lang in words}
    assert max(filters.rates) < 0.05
    tests = [make(rng.choice(list(words)), rng.randint(1, 30)) for _ in range(120)] + [f"{make('aa', 5)} {make('bb', 5)}", "ab", "zzzz"]
    scored = 0
    for text in tests:
        mine = grams(text)
        plain = np.array([sum(g in held[lang] for g in mine) / len(mine) for lang in filters.langs])
        shares = filters.shares(language_id.ngram_keys(text))
        assert np.all(np.abs(shares - plain) <= 0.05 + 3 / len(mine)), text
        if len(mine) > 30:
            assert np.abs(shares - plain).max() < 0.03
        order = np.sort(plain)
        if order[-1] - order[-2] > 0.2:
            scored += 1
            assert filters.predict(text)[0] == filters.langs[int(plain.argmax())]
    assert scored > 80
    # what is in no set is found as often as the rates say
    other = language_id.ngram_keys(" ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(3000)))
    masks = filters.masks(other)
    for i, expected in enumerate(filters.rates):
        assert abs(((masks[:, i // 8] >> (i % 8)) & 1).mean() - expected) < 0.01 + expected
    assert filters.predict("zzzz qqqq") == ("aa", filters.predict("zzzz qqqq")[1])  # a tie goes to the first name


def test_languages_with_clashing_columns(spark):
    filters = language_id.fit_filters(spark.createDataFrame([("abc abc", "x")] * 3, "text string, lang string"))
    docs = spark.createDataFrame([(1, "abc", "old", 5, True)], "doc_id long, text string, lang_pred string, score int, judged boolean")
    got = language_id.identify_languages(docs, filters)
    assert sorted(got.columns) == sorted(docs.columns) and got.first()["judged"] is True and got.first()["score"] <= 1


def test_one_long_unit_keeps_few_states():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    machine = token_counts.compiled.__wrapped__(path)
    machine.max_states, rng, most = 300, random.Random(7), 0
    move = machine._move

    def watched(state, char):
        nonlocal most
        most = max(most, len(machine.items))
        return move(state, char)

    machine._move = watched
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123+/=") for _ in range(20_000)), "漢字かな" * 500, "a" * 3000):
        assert machine.count(text) == len(model.encode(text))
    assert most <= 302


def test_token_counts_of_long_texts_and_clashing_columns(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "The quick brown fox, étrange. " * 6000 + "x" * 500
    docs = spark.createDataFrame([(1, text, "old", 1), (2, None, "old", 1)], "doc_id long, text string, n_tokens string, over_limit int")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    assert len(text) > 2 * token_counts.CHUNK_CHARS and got[1]["n_tokens"] == len(model.encode(text)) and got[1]["over_limit"] and got[2]["n_tokens"] == 0
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_many_secrets_in_one_text(spark):
    rng = random.Random(1)
    parts = []
    for i in range(64_000):
        parts.append(rng.choice([f"token={i:08d}", f"token={i % 7}", "ab" * 13, "é word"]))
    text = " ".join(parts)
    began = time.time()
    spans = secret_scans.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["secrets"]
    took = time.time() - began
    want = [("assign", *m.span()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted((s["kind"], s["start"], s["end"]) for s in spans if s["kind"] in ("assign", "hex")) == sorted(want)
    assert took < 60


def test_rows_without_ids_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    rows = [(None, "s", "one two")] * 3000 + [(i, "s", "one two three") for i in range(1000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4), 0.5).where("epoch = 0")
    sizes = got.groupBy("block").agg(F.count("*").alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("none")).collect()
    assert got.count() == 4000 and len(sizes) > 20 and max(r["n"] for r in sizes) < 4 * 4000 / len(sizes) and max(r["none"] for r in sizes) < 4 * 3000 / len(sizes)


def test_permutation_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rows = [(i, f"s{i % 2}", "w " * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    seed = 5
    got = mixing.mix_sources(docs, 0.0, seed=seed).collect()
    order = {}
    for s in ("s0", "s1"):
        own = [(i, len(t.split())) for i, x, t in rows if x == s]
        blocks = -(-(sum(n for _, n in own) + 1) // 50)
        assert blocks > 3
        hashed = spark.createDataFrame(own, "doc_id long, n_tokens long").withColumn("lot", F.xxhash64(F.lit(seed), F.lit(0), "doc_id", "n_tokens"))
        hashed = hashed.withColumns({"b": F.pmod("lot", F.lit(blocks)), "at": F.xxhash64("lot")}).withColumn("turn", F.xxhash64(F.lit(seed), "b")).collect()
        turns = sorted({(r["turn"], r["b"]) for r in hashed})
        for r in hashed:
            mine = sorted((q["at"], q["doc_id"]) for q in hashed if q["b"] == r["b"])
            order[r["doc_id"]] = (turns.index((r["turn"], r["b"])) + 1, mine.index((r["at"], r["doc_id"])) + 1)
    assert {r["doc_id"]: (r["block"], r["place"]) for r in got if r["epoch"] == 0} == order


def test_stored_media(spark, tmp_path):
    texts = ["", None, "abc", "é" * 100, "x" * 64, "\x00\x00", "long text " * 9000, "abc"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    media = {r["doc_id"]: bytes(r["media"]) for r in media_columns.flac_columns(docs).select("doc_id", "media").collect()}
    for r in queries.QUERIES["op8_media_columns"](spark, str(tmp_path)).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[r["doc_id"]]), hashlib.sha256(media[r["doc_id"]]).hexdigest())
        assert media[r["doc_id"]][:4] == b"fLaC"


@pytest.mark.parametrize("operator", ["dedup", "licenses"])
def test_little_is_left_in_the_shared_folder(spark, operator):
    text = " ".join(f"word{i}" for i in range(60)) + "\nReleased under the MIT License."
    docs = spark.createDataFrame([(i, text, f"d/{i}") for i in range(5)], "doc_id long, text string, path string")
    where = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(where))
    if operator == "dedup":
        assert substring_dedup.remove_repeats(docs).where("n_removed > 0").count() == 4
    else:
        license_scan.scan_licenses(docs.select("path", "text")).collect()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(where)) - before}
    assert not left & {"edges", "paths", "sizes", "heavy", "terms", "units", "idf"}, left


def test_counters_of_frequent_values():
    rng = np.random.default_rng(4)
    counters, all_values = substring_dedup._Frequent(50), []
    for _ in range(40):
        part = np.concatenate([rng.integers(100, 5000, 900), rng.integers(0, 10, 100)]).astype(np.uint64)
        counters.add(part)
        all_values.append(part)
    true = Counter(np.concatenate(all_values).tolist())
    got = dict(zip(counters.values.tolist(), counters.counts.tolist(), strict=True))
    assert len(got) <= 50 and set(range(10)) <= set(got)
    assert all(n <= true[v] and true[v] - n < 40_000 / 50 for v, n in got.items())
    counters.add(np.zeros(0, np.uint64))
    assert counters.added == 40_000


def test_an_edge_that_is_thin_in_every_batch_fills_no_bucket(spark):
    """A window that comes 100 times in each of 32 tasks is found, sends no row to a bucket, and still goes everywhere but first."""
    phrase = "one two three four five six seven"
    pages = spark.range(0, 3200, 1, 32).select(F.col("id").alias("doc_id"), F.concat(F.lit("a"), "id", F.lit(f" {phrase} b"), "id").alias("text"))
    size = pages.agg(F.sum(F.octet_length("text"))).first()[0]
    _, heavy = substring_dedup._overfull(pages, 7, 5, 128, 256, 1000, size)
    assert len(heavy) == 1
    texts = [t.encode() for (t,) in pages.limit(100).select("text").collect()]
    edges = substring_dedup._edges(texts, np.arange(len(texts)), 7, 5)
    assert (edges[0] == heavy[0]).sum() == 100 and len(edges[0]) == 300
    none = np.zeros(0, np.uint64)
    assert (substring_dedup._sent(edges, 128, none)[0] == heavy[0]).sum() == 100
    sent = substring_dedup._sent(edges, 128, heavy)
    assert len(sent[0]) == 200 and not (sent[0] == heavy[0]).any()
    rows = pages.union(spark.createDataFrame([(0, phrase), (None, phrase), (9999, None)], "doc_id long, text string"))
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(rows, 7, 128, 1000).collect()}
    assert got == {(0, 9, 0), (0, 7, 0), (None, 7, 7), (9999, 0, 0)} | {(i, 9, 7) for i in range(1, 3200)}


def test_templates_pair_nothing(spark):
    """Pages of one template that each end in a word of their own: 5 of 7 shingles in common, so no link, and time in proportion."""
    pages = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this page has one common text and a "), F.concat(F.lit("w"), F.col("id"))).alias("text"))
    copies = pages.where("doc_id < 3").withColumn("doc_id", F.col("doc_id") + 50_000)
    got = ngram_join.near_duplicates(pages.union(copies)).where("component_id <> doc_id").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(50_000, 0), (50_001, 1), (50_002, 2)]
