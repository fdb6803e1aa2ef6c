"""Periodic runs against a search of all periods, on short random words, Fibonacci words and a long text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.llm import periodic_runs as module
from tamarack.llm import queries

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(w[x] == w[x + d] for x in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for s, size, q in runs for x in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def samples():
    rng = random.Random(11)
    fib = ["b", "a"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    for n in range(300):
        w = [rng.choice("abcd"[: rng.choice([1, 2, 3, 4])]) for _ in range(rng.randint(0, 40))]
        for _ in range(n % 4):
            root = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(w))
            w[at:at] = root * rng.randint(2, 7) + root[: rng.randint(0, len(root))]
        yield w
    yield list(fib[-1]) * 5
    yield list(fib[-1])


@pytest.mark.parametrize("tree_words", [1, 60, 1 << 17])
def test_all_runs(monkeypatch, tree_words):
    monkeypatch.setattr(module, "TREE_WORDS", tree_words)
    monkeypatch.setattr(module, "QUERIES_AT_ONCE", 64)
    words = list(samples())
    found = module.text_runs([" ".join(w).encode() for w in words])
    for w, rows in zip(words, found, strict=True):
        assert [tuple(r) for r in rows.tolist()] == brute(w)
        names: dict = {}  # the search alone, without ruling out places first
        seq = np.array([names.setdefault(x, len(names)) for x in w] + [9])
        assert sorted(map(tuple, module.runs(seq).tolist()), key=lambda r: (r[0], r[2])) == brute(w)


def test_operator(spark):
    words = list(samples())[:60]
    rows = [(i, " \t".join(w), i, "x") for i, w in enumerate(words)] + [(None, None, 0, "x"), (500, "", 0, None), (501, "\n \x0b", 0, "x"), (3, " \t".join(words[3]), 0, "y"), (502, "é\xa0x " * 9, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string")
    got = module.periodic_runs(docs.repartition(4)).collect()
    want = []
    for i, t, _, _ in rows:
        w = SPACED.findall(t or "")
        want.append((i, len(w), [tuple(r) for r in brute(w)], collapsed(w, brute(w))))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got), key=str) == sorted(want, key=str)
    assert module.periodic_runs(docs.limit(0)).count() == 0


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 1 << 16)
    text = " ".join(f"w{i}" for i in range(40_000)) + " " + "ab cd ef " * 30_000 + "z" * 100_000
    row = module.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(40_000, 90_000, 3)] and row["n_words"] == 130_001
    assert row["collapsed"].endswith(" ab cd ef " + "z" * 100_000)


def test_query(spark, tmp_path):
    words = list(samples())
    rows = [(i, " ".join(w + ["tail", "of", "text"] * (i % 3))) for i, w in enumerate(words)] + [(None, "a a a a a a a"), (10_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = [], 0
    for i, t in rows:
        w = SPACED.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
            planted += 1
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        want.append((i, len(runs), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert planted > 10 and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {k for _, k in got.drop("doc_id").dtypes} == {"bigint", "string"} and got.where(F.col("n_runs") > 0).count() > 50
