"""Helpers that several operators share: shared-folder tables, checked broadcasts, hashing of words."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to take no more than this.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes hashed at a time inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); where none is set, a temporary one if all runs on one machine."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if where is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tamarack-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


@contextmanager
def shuffles_cleared(spark: SparkSession):
    """Queries that run inside remove their shuffle files at their end: what they made is stored or collected."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: lineage ends there.

    ``discard`` deletes the table once all that reads it is stored itself.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_cleared(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` has made."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if(df: DataFrame) -> DataFrame:
    """``df``, a table that is stored or cheap to read, with a broadcast hint if its measured rows fit the bound.

    Beyond the bound Spark's usual join stays. A row counts as twice its JSON text and 64 bytes.
    """
    size = F.lit(64) + 2 * F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)).cast("long")
    with shuffles_cleared(df.sparkSession):
        fits = (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES
    return F.broadcast(df) if fits else df


def unused(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column in ``taken`` has it."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name


def ascii_lower(text):
    """A-Z in lower case and nothing else: ``lower`` where all is ASCII, a translation elsewhere."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


# --- hashing of words inside tasks ---------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _random_words(256, 1)
_PLACE = _random_words(4096, 2)
_STEP = _random_words(64, 3)
_BYTE[_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sliced(batches, rows: int = 1000):
    """Arrow batches cut to at most ``rows`` rows, to bound what a task holds at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def blocks(texts: list[bytes]):
    """(first, last) ranges of ``texts`` that hold about BLOCK_BYTES each."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def hash_words(texts: list[bytes], lower: bool = False):
    """Words between ASCII white space in UTF-8 texts.

    Returns (hashes, document of each word, number of words per document, starts, ends, buffer);
    starts and ends are byte offsets in the buffer of all texts joined by line feeds.
    """
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    change = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = change[::2], change[1::2]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    bounds = np.cumsum(lengths)
    of = np.searchsorted(bounds, starts, side="right")
    counts = np.bincount(of, minlength=len(texts))
    if not len(starts):
        return np.zeros(0, np.uint64), of, counts, starts, ends, buffer
    shown = _LOWER[buffer] if lower else buffer
    first = int(starts[0])
    place = np.arange(first, len(buffer)) - np.repeat(starts, np.diff(starts, append=len(buffer)))
    values = _BYTE[shown[first:]] * _PLACE[place & 4095]
    if int((ends - starts).max()) > 4096:
        values *= (2 * (place >> 12) + 1).astype(np.uint64)
    sums = np.add.reduceat(values, starts - first)
    return mix(sums + (ends - starts).astype(np.uint64)), of, counts, starts, ends, buffer


def hash_windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words (document borders are the caller's)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += words[j : j + n] * _STEP[j]
    return mix(total)
