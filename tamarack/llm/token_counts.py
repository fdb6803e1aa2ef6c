"""Token counts by a compiled finite-state transducer.

A sentencepiece BPE vocabulary with byte fallback is turned into a deterministic transducer whose
transitions carry how the token count of the text read so far changes. A state holds, for each
place from which a vocabulary entry may still be spelled on, the node in the vocabulary's trie, the
token that ends at that place and the count there against the count now; two adjacent tokens can
stand side by side exactly when merging their joined text gives these two again, which fixes the one
last token of every prefix. States are made when first met and kept, bounded by ``max_states``.

No entry has a space after another character, so a space after a non-space leads back to the start.
That gives each chunk of a text a short state map: what is counted between its first and last reset,
and the text before and after these. Maps compose associatively, in a tree of logarithmic depth, so
chunks can be counted in any order and long texts stay cheap.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS = 1 << 16
_UNIT = re.compile(" +[^ ]*")
_RESET = re.compile("(?<=[^ ]) ")


class Transducer:
    """The compiled form of one vocabulary: ``scores`` maps each entry, with spaces, to its score."""

    #: What may follow below a node is worked out in full for nodes with so many entries below them.
    few = 32

    def __init__(self, scores: dict[str, float], max_states: int = 150_000, max_units: int = 200_000):
        if any(" " in entry.lstrip(" ") for entry in scores):
            raise ValueError("an entry has a space after another character: chunks would not reset")
        self.scores, self.max_states, self.max_units = scores, max_states, max_units
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        for word in scores:
            node = 0
            for char in word:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                node = self.children[node][char]
            self.entry[node] = word
        self.adjacent: dict[tuple[str | None, str], bool] = {}
        self.below: list[tuple[str, ...] | None] = [None] * len(self.children)
        for node in reversed(range(len(self.children))):  # a child's number is above its parent's
            parts = [self.below[child] for child in self.children[node].values()]
            own = [self.entry[child] for child in self.children[node].values() if self.entry[child]]
            if None not in parts and len(own) + sum(map(len, parts)) <= self.few:
                self.below[node] = (*own, *(x for part in parts for x in part))
        self.context: dict[tuple[int, str | None], tuple | None] = {}
        self.classes: dict[tuple, tuple] = {}
        self.units: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.states = {((0, None, 0),): 0}
        self.items: list[tuple] = [((0, None, 0),)]
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def _entered(self, state: int) -> int:
        """The number of a state in a machine that has forgotten all others."""
        here = self.items[state]
        self._clear()
        if here in self.states:
            return self.states[here]
        self.states[here] = len(self.items)
        self.items.append(here)
        self.moves.append({})
        return self.states[here]

    def merged(self, text: str) -> list[str]:
        """The vocabulary's own merges on a short text, best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, last: str | None, token: str) -> bool:
        known = self.adjacent.get((last, token))
        if known is None:
            if len(self.adjacent) > 300_000:
                self.adjacent.clear()
            known = self.merged((last or "") + token) == ([token] if last is None else [last, token])
            self.adjacent[last, token] = known
        return known

    def _context(self, node: int, last: str | None) -> tuple | None:
        """(node, last) or another pair that allows the same entries; None if it allows none."""
        if self.below[node] is None:
            return node, last
        if (node, last) not in self.context:
            if len(self.context) > 1_000_000:
                self.context.clear()
            fitting = tuple(self._fits(last, entry) for entry in self.below[node])
            same = self.classes.setdefault((node, fitting), (node, last))
            self.context[node, last] = same if any(fitting) else None
        return self.context[node, last]

    def _move(self, state: int, char: str) -> tuple[int, int]:
        """The transition for ``char``: next state and change of the count."""
        if char not in self.children[0]:  # an unknown character never merges; its bytes are tokens
            return 0, len(char.encode())
        alive, token, change = [], None, 0
        for node, last, count in self.items[state]:
            below = self.children[node].get(char)
            if below is None:
                continue
            alive.append((below, last, count))
            entry = self.entry[below] if node or self.entry[below] else char
            if entry is not None and self._fits(last, entry):
                token, change = entry, count + (1 if entry in self.scores else len(char.encode()))
        after = [(found, count - change) for node, last, count in alive if (found := self._context(node, last))]
        key = (*((node, last, count) for (node, last), count in after), (0, token, 0))
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.items)
            self.items.append(key)
            self.moves.append({})
        return found, change

    def count_unit(self, unit: str) -> int:
        """Tokens of a run of spaces and what follows up to the next one, from the start state."""
        known = self.units.get(unit)
        if known is not None:
            return known
        state = total = 0
        for char in unit:
            moves = self.moves[state]
            to = moves.get(char)
            if to is None:
                if len(self.items) > self.max_states:  # forget all but where this unit is
                    state = self._entered(state)
                    moves = self.moves[state]
                to = moves[char] = self._move(state, char)
            state = to[0]
            total += to[1]
        if len(self.units) > self.max_units:
            self.units.clear()
        if len(unit) <= 64:
            self.units[unit] = total
        return total

    def count_units(self, text: str) -> int:
        return sum(self.count_unit(unit) * n for unit, n in Counter(_UNIT.findall(text)).items())

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """(text before the first reset, tokens up to the last one, text after it or None: no reset)."""
        first = _RESET.search(chunk)
        if first is None:
            return chunk, 0, None
        last = chunk.rindex(" ")
        while chunk[last - 1] == " ":
            last -= 1
        return chunk[: first.start()], self.count_units(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two adjacent chunks."""
        if a[2] is None and b[2] is None:
            joined = a[0] + b[0]
            return self.chunk_map(joined) if a[0][-1:] != " " and b[0][:1] == " " else (joined, 0, None)
        if a[2] is None:
            return self._prefixed(a[0], b)
        if b[2] is None:
            return (a[0], *self._suffixed(a[1], a[2] + b[0]))
        return a[0], a[1] + self.count_units(a[2] + b[0]) + b[1], b[2]

    def _prefixed(self, head: str, b: tuple) -> tuple:
        left = self.chunk_map(head + b[0])
        if left[2] is None:
            return left[0], b[1], b[2]
        return left[0], left[1] + self.count_units(left[2]) + b[1], b[2]

    def _suffixed(self, count: int, tail: str) -> tuple[int, str]:
        """A tail starts with a reset; it may hold one more where two chunks met."""
        at = [m.start() for m in _RESET.finditer(tail)]
        return (count + self.count_units(tail[: at[-1]]), tail[at[-1] :]) if at else (count, tail)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """Tokens of a whole text: maps of its chunks, composed in a tree of logarithmic depth."""
        if not text:
            return 0
        text = " " + text.replace("▁", " ")
        if len(text) <= chunk_chars:
            return self.count_units(text)
        maps = [self.chunk_map(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)]
        while len(maps) > 1:
            pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        head, body, tail = maps[0]
        return self.count_units(head) + body + self.count_units(tail or "")


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model file with byte fallback and no normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    if not any(model.is_byte(i) for i in ids):
        raise ValueError("the vocabulary has no byte fallback")
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return Transducer({model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in plain})


def count_tokens(
    docs: DataFrame, model_path: str | None = None, limit: int = 4096, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) in front.

    ``model_path``: a file that every executor can open; None: the installed public vocabulary.
    Null text counts as empty: 0 bytes, 0 tokens; an empty table stays empty. Each row is counted by
    itself, so repeated rows and ids and ties give equal results; columns of these names in ``docs`` are
    replaced. Very long texts are counted whole: above ``chunk_chars`` by maps of chunks that compose in a tree
    inside the row's task; states made on the way are forgotten beyond a bound, also inside one run without spaces. No shuffle.
    """

    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import public_tokenizers

        machine = compiled(model_path or public_tokenizers.path("piece_bpe_32k.model"))
        for texts in parts:
            yield pd.Series([machine.count(t, chunk_chars) for t in texts], dtype="int64")

    # hints by name are not resolved here: the types are given to Spark as such
    count.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {"n_bytes": F.octet_length(text).cast("long"), "n_tokens": F.pandas_udf(count, "long")(text)}
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
