"""Periodic runs of words: squares from Lempel-Ziv blocks, completed in a suffix tree, merged into runs."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, hash_windows, hash_words, mix, sliced

#: A run holds at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words given to one suffix tree; the stretches of one document are never divided.
TREE_WORDS = 1 << 17
#: Extension queries answered at a time.
QUERIES_AT_ONCE = 1 << 18

_GAP = re.compile(rb"[\x20\x09-\x0D]")


# --- strings of numbers: names of substrings, common extensions ------------------------------


def _names(seq: np.ndarray) -> list[np.ndarray]:
    """Level k names the substrings of 2^k numbers at each place, in their order; the last level ranks all suffixes."""
    n, width = len(seq), 1
    level = np.unique(seq, return_inverse=True)[1]
    levels = [np.append(level, -1).astype(np.int32)]
    while int(level.max()) + 1 < n:
        ahead = np.full(n, -1, np.int64)
        ahead[: max(0, n - width)] = level[width:]
        level = np.unique(level.astype(np.int64) * (n + 1) + ahead + 1, return_inverse=True)[1]
        levels.append(np.append(level, -1).astype(np.int32))
        width *= 2
    return levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes at ``i`` and ``j``, different places up to the end, have in common."""
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        total += (level[i + total] == level[j + total]).astype(np.int64) << k
    return total


def _blocks(levels: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest prefix that begins earlier too, or one number."""
    n = len(order)
    before, after, stack = np.full(n, n), np.full(n, n), []
    before_at, after_at = memoryview(before), memoryview(after)
    for p in memoryview(order):
        while stack and stack[-1] > p:
            after_at[stack.pop()] = p
        if stack:
            before_at[p] = stack[-1]
        stack.append(p)
    places = np.arange(n)
    longest = np.maximum(_common(levels, places, before), _common(levels, places, after))
    starts, at, longest_at = [], 0, memoryview(longest)
    while at < n:
        starts.append(at)
        at += max(1, longest_at[at])
    return np.array(starts)


def _covering_squares(levels: list[np.ndarray], mirrored: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares that cover the leftmost occurrence of every kind of square.

    A square's leftmost occurrence has its middle in a block and ends in that block or the next. For
    each half length that fits, the period is extended from the border before (anchor h + k) and from the border
    behind the block (anchor h1 - k), both ways at once.
    """
    n = len(levels[0]) - 1
    ends = np.append(starts[1:], n)
    beyond = np.append(ends[1:], n)
    size, both = ends - starts, beyond - starts
    border = np.concatenate([np.repeat(ends, size), np.repeat(starts, both)])
    step = np.concatenate([np.arange(1, 1 + size.sum()) - np.repeat(np.cumsum(size) - size, size), np.arange(1, 1 + both.sum()) - np.repeat(np.cumsum(both) - both, both)])
    other = border + np.where(np.arange(len(border)) < size.sum(), -step, step)
    found = []
    for first in range(0, len(border), QUERIES_AT_ONCE):
        b, o, k = (x[first : first + QUERIES_AT_ONCE] for x in (border, other, step))
        ahead = _common(levels, b, o)
        back = _common(mirrored, n - b, n - o)  # from b - 1 and o - 1 backwards
        low = np.minimum(b, o)
        good = (ahead > 0) & (ahead + back >= k)
        found.append(np.stack([np.maximum(low - back, low - k + 1)[good], k[good]]))
    start, half = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
    return start, half


def _primitive(levels: list[np.ndarray], start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the square's root is no power of a shorter one: no prime divides it into equal parts."""
    factor = np.arange(int(half.max(initial=1)) + 1)  # the smallest prime factor of each number
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    whole, rest = np.ones(len(half), bool), half.copy()
    while (live := np.flatnonzero(whole & (rest > 1))).size:
        p = factor[rest[live]]
        part = half[live] // p
        whole[live] = _common(levels, start[live], start[live] + part) < 2 * half[live] - part
        rest[live] //= p
    return whole


# --- the suffix tree -------------------------------------------------------------------------


class _Tree:
    """Leaves are 0 to n - 1 in suffix order, inner nodes follow; ``root`` is n. Each suffix must end in a number of its own."""

    def __init__(self, seq: np.ndarray, levels: list[np.ndarray], order: np.ndarray):
        n = len(seq)
        shared = np.append(0, _common(levels, order[:-1], order[1:]))
        self.root = n
        parent, depth, left, right = [0] * n, [], [], []
        self.upward: list[int] = []  # nodes in the order in which all below them are known
        split = np.full(n, n)
        split_at, upward = memoryview(split), self.upward
        depth.append(0), left.append(0), right.append(n - 1), parent.append(n)
        stack = [n]
        for j, low in enumerate([*shared[1:].tolist(), 0], 1):
            node, first = j - 1, j - 1
            while depth[stack[-1] - n] > low:
                top = stack.pop()
                parent[node] = top
                upward.append(node)
                right[top - n] = j - 1
                node, first = top, left[top - n]
            if depth[stack[-1] - n] < low:
                stack.append(n + len(depth))
                depth.append(low), left.append(first), right.append(j - 1), parent.append(n)
            parent[node] = stack[-1]
            upward.append(node)
            if j < n:
                split_at[j] = stack[-1]
        self.parent = np.array(parent)
        self.depth = np.concatenate([n - order, np.array(depth)])
        self.left = np.concatenate([np.arange(n), np.array(left)])
        self.right = np.concatenate([np.arange(n), np.array(right)])
        self.first = order[self.left]  # a place where the node's string stands
        self.links = self._suffix_links(shared, levels[-1], order, split)
        below = np.array(upward)
        letters = seq[self.first[below] + self.depth[self.parent[below]]]
        self.wide = int(seq.max()) + 1
        keys = self.parent[below] * self.wide + letters
        by_key = np.argsort(keys)
        self.keys, self.children = keys[by_key], below[by_key]

    def _suffix_links(self, shared: np.ndarray, rank: np.ndarray, order: np.ndarray, split: np.ndarray) -> np.ndarray:
        """For each inner node the node of its string without the first number: where the shifted borders' suffixes part."""
        n = len(order)
        links = np.full(len(self.depth), self.root)
        inner = np.flatnonzero(self.depth[n:] > 0) + n
        a, b = rank[order[self.left[inner]] + 1] + 1, rank[order[self.right[inner]] + 1]
        level_of = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        least = np.arange(n)  # the place of the least shared length among 2^k places
        for k in range(int(level_of.max(initial=-1)) + 1):
            mine = level_of == k
            x, y = least[a[mine]], least[b[mine] - (1 << k) + 1]
            links[inner[mine]] = split[np.where(shared[x] <= shared[y], x, y)]
            x, y = least[: max(0, len(least) - (1 << k))], least[1 << k :]
            least = np.where(shared[x] <= shared[y], x, y)
        return links


def _vocabulary(seq: np.ndarray, tree: _Tree, order: np.ndarray, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node below the end, length) of every kind of square: the covering ones, and their rotations by suffix links."""
    n = len(seq)
    by = np.lexsort((-half, start))
    lengths, begins = memoryview(2 * half[by]), np.searchsorted(start[by], np.arange(n + 1))
    at, end = memoryview(begins[:-1].copy()), memoryview(begins[1:].copy())
    parent, depth, first, left, links, text = map(memoryview, (tree.parent, tree.depth, tree.first, tree.left, tree.links, seq))
    keys, children, wide, root = memoryview(tree.keys), memoryview(tree.children), tree.wide, tree.root
    order_at = memoryview(order)
    least = memoryview(np.concatenate([order, np.full(len(tree.depth) - n, n)]))  # the leftmost place below each node
    span = 2 * n + 2
    seen: set[int] = set()
    work: list[tuple[int, int]] = []
    for v in tree.upward:
        j, p = least[v], parent[v]
        while at[j] < end[j] and lengths[at[j]] > depth[p]:
            work.append((v, lengths[at[j]]))
            seen.add(v * span + lengths[at[j]])
            at[j] += 1
        if j < least[p]:
            least[p] = j
    for v, length in work:
        while True:
            i, node = order_at[left[v]], links[parent[v]]
            while (d := depth[node]) < length - 1:  # skip down along the string without its first number
                node = children[bisect_left(keys, node * wide + text[i + 1 + d])]
            if d == length - 1:
                key = node * wide + text[i]
                place = bisect_left(keys, key)
                if place == len(keys) or keys[place] != key:
                    break
                node = children[place]
            elif text[first[node] + length - 1] != text[i]:
                break
            if node * span + length in seen:
                break
            seen.add(node * span + length)
            v = node
    found = np.fromiter(seen, np.int64, len(seen))
    return found // span, found % span


def runs(seq: np.ndarray) -> np.ndarray:
    """Rows (start, length, period): every maximal run of ``seq`` with at least LEAST_WORDS numbers and LEAST_PERIODS periods.

    Each number that ends a part must occur once. Squares with primitive roots occur O(n log n) times in all.
    """
    n = len(seq)
    levels, mirrored = _names(seq), _names(seq[::-1])
    order = np.argsort(levels[-1][:n])
    start, half = _covering_squares(levels, mirrored, _blocks(levels, order))
    del mirrored
    whole = _primitive(levels, start, half)
    start, half = start[whole], half[whole]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    tree = _Tree(seq, levels, order)
    node, length = _vocabulary(seq, tree, order, start, half)
    often = tree.right[node] > tree.left[node]  # each rotation stands at least twice in a run of four periods
    node, length = node[often], length[often]
    count = tree.right[node] - tree.left[node] + 1
    place = order[np.repeat(tree.left[node] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    key = np.sort(np.repeat(length // 2, count) * (n + 1) + place)
    if not len(key):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(key) != 1)
    low, high = key[np.append(0, cut + 1)], key[np.append(cut, len(key) - 1)]
    period = low // (n + 1)
    found = np.stack([low % (n + 1), high - low + 2 * period, period], axis=1)
    return found[found[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)]


# --- texts -----------------------------------------------------------------------------------


def _hashes(text: bytes) -> np.ndarray:
    """A hash of each word, a bounded piece of the text at a time."""
    parts, first = [], 0
    while first < len(text):
        gap = _GAP.search(text, first + BLOCK_BYTES)
        last = gap.start() if gap else len(text)
        parts.append(hash_words([text[first:last]])[0])
        first = last
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _stretches(words: np.ndarray, of: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words that hold every run: three words in a row that begin in a run stand three times in it.

    Words' hashes only rule places out: equal ones of different words leave more places, never fewer.
    """
    width = 3
    if len(words) < width:
        return []
    windows = hash_windows(words, width)
    at = np.flatnonzero(of[:-2] == of[2:])
    group, groups = of[at], -1
    for _ in range(12):
        if not len(at):
            return []
        key = mix(windows[at] ^ mix(group.astype(np.uint64) + np.uint64(1))) % np.uint64(1 << max(10, (8 * len(at)).bit_length()))
        kept = at[np.bincount(key.astype(np.int64))[key.astype(np.int64)] >= LEAST_PERIODS - 1]
        if not len(kept):
            return []
        label = np.cumsum(np.append(True, np.diff(kept) != 1)) - 1  # places side by side are of one document
        long = np.bincount(label)[label] >= LEAST_WORDS - width + 1
        kept, label = kept[long], label[long]
        same, groups_now = len(kept) == len(at), len(np.unique(label))
        at, group = kept, label
        if same and groups_now == groups:
            break
        groups = groups_now
    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
    last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
    return list(zip(at[first].tolist(), (at[last] + width).tolist(), strict=True))


def text_runs(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the runs of its words between ASCII white space, as rows (start, length, period) in that order."""
    out = [np.zeros((0, 3), np.int64) for _ in texts]
    hashed = [_hashes(t) for t in texts]
    sizes = np.array([len(h) for h in hashed])
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    held: dict[int, list[tuple[int, int]]] = {}
    for first, last in _stretches(np.concatenate(hashed), of) if len(of) else []:
        held.setdefault(int(of[first]), []).append((first - int(begins[of[first]]), last - int(begins[of[first]])))
    del hashed
    seq: list[int] = []
    parts: list[tuple[int, int, int]] = []  # (text, first word, place in seq)
    names: dict[bytes, int] = {}

    def solve() -> None:
        found = runs(np.array(seq))
        begin = np.array([p for _, _, p in parts])
        part = np.searchsorted(begin, found[:, 0], side="right") - 1
        for (start, length, period), k in zip(found.tolist(), part.tolist(), strict=True):
            d, word, place = parts[k]
            out[d] = np.append(out[d], [[word + start - place, length, period]], axis=0)
        seq.clear(), parts.clear(), names.clear()

    for d, ranges in held.items():
        words = texts[d].split()
        for first, last in ranges:
            parts.append((d, first, len(seq)))
            seq.extend(names.setdefault(w, len(names)) for w in words[first:last])
            seq.append(names.setdefault(len(seq), len(names)))  # a number of its own: no word is an integer
        if len(seq) >= TREE_WORDS:
            solve()
    if seq:
        solve()
    return [r[np.lexsort((r[:, 2], r[:, 0]))] for r in out]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by spaces, without those that a run holds after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, kept, strict=True) if k)


def periodic_runs(docs: DataFrame, prepare: Callable[[object, bytes], bytes] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): every periodic run of words in each whole text.

    A word is a stretch without ASCII white space. A run is a maximal stretch with smallest period q (words
    q apart are equal) of at least max(6, 4 q) words; runs: array<struct<start, length, period>> by start, then
    period; collapsed: the words that no run holds after its first q, joined by one space. ``prepare`` may
    change a text (doc_id, UTF-8) before.

    Null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows and ids give
    equal rows; other columns are not read; an empty table stays empty. Each text is one row's work: no
    shuffle. Places that no run can hold are ruled out by counts of word triples first. A task holds some 40
    bytes a word of a text, and about 500 bytes for each word in stretches that repeat.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = batch.column("doc_id").to_pylist()
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            texts = [(t or b"") if prepare is None else prepare(i, t or b"") for i, t in zip(ids, raw, strict=True)]
            first = size = 0
            for last in range(1, len(texts) + 1):
                size += len(texts[last - 1])
                if size < BLOCK_BYTES and last < len(texts):
                    continue
                some = texts[first:last]
                found = text_runs(some)
                words = [t.split() for t in some] if last - first == 1 else None
                split = (words[k] if words else t.split() for k, t in enumerate(some))
                counts, short = [], []
                for mine, r in zip(split, found, strict=True):
                    counts.append(len(mine))
                    short.append(b" ".join(mine) if not len(r) else collapsed(mine, r))
                flat = np.concatenate(found)
                offsets = np.cumsum([0, *map(len, found)])
                items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(each.value_type))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(counts, pa.int64()), lists, pa.array(short, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
                first, size = last, 0

    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tail(doc_id: object, text: bytes) -> bytes:
    """The text whose words from a on repeat with period p, where the document's number asks for it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    words = text.split() if h % 10 == 0 else []
    if not words:
        return text
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), repeated_tail)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
