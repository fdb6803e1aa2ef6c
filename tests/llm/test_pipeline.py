"""Each stage of the corpus pipeline, and all of them, over a small corpus with nulls, copies, long texts and odd columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

BENCH = "what is the capital of the country that lies to the south of the mountains and of the river"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(i, text("abcdeé" if i % 2 else "mnopqß", 40), "aa" if i % 2 else "mm", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[1][1], "aa", "s0"), (101, rows[1][1] + " " + word("abc"), "aa", "s1"), (102, rows[1][1].upper().replace("É", "é"), None, None)]
    rows += [rows[3], (None, rows[5][1], "aa", "s1")]
    rows += [(110, text("abcde", 20) + " " + BENCH.upper() + " " + text("abcde", 20), "aa", "s0")]
    rows += [(120, text("abcde", 20) + ' password = "hunter2222" ' + text("abcde", 10), "aa", "s2")]
    rows += [(130, None, "aa", "s1"), (131, "", None, "s1"), (132, "12 34 !!", "mm", None), (133, text("mnopq", 40_000), "mm", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(c) for c in ("comp", "_key", "judged", "spans", "key", "weight", "_d")})
    where = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def kept(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    every = kept(docs)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "mixing"]

    named = stages["language_id"](spark, docs, corpus)
    assert kept(named) == sorted((i for i in every if i not in (130, 131, 132)), key=str)

    single = stages["near_duplicates"](spark, docs, corpus)
    gone = [100, 101, 102, 3, None]  # copies of 1, the second row 3, a copy of 5
    want = list(every)
    for i in gone:
        want.remove(i)
    assert kept(single) == sorted(want, key=str)

    clean = stages["decontamination"](spark, docs, corpus)
    assert kept(clean) == sorted((i for i in every if i != 110), key=str)

    hidden = stages["secrets"](spark, docs, corpus)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in hidden.collect():
        if r["doc_id"] == 120:
            assert "hunter" not in r["text"] and "[secret]" in r["text"] and r["n_chars"] == len(r["text"])
        elif r["doc_id"] != 102:
            assert r["text"] == texts[r["doc_id"]]
    for stage in (named, single, clean, hidden):
        assert stage.columns == docs.columns and {r["_key"] for r in stage.select("_key").collect()} == {"_key"}

    mix = stages["mixing"](spark, docs, corpus)
    tokens = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    rows = mix.collect()
    assert {r["doc_id"] for r in rows} == set(every) and all(r["n_tokens"] == tokens[r["doc_id"]] for r in rows)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), corpus).count() == 0


def test_run(spark, corpus):
    rows = corpus_pipeline.run(spark, corpus).collect()
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    want = {r["doc_id"] for r in docs.collect()} - {100, 101, 102, None, 110, 130, 131, 132}
    assert {r["doc_id"] for r in rows} == want
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 133][0] == 40_000
