"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold (in lower case). The inverted index lists, for each trigram that some rule asks for, the documents that
hold it: rows (trigram, key), so a frequent trigram is spread over many rows and tasks. Postings are
intersected and united by their document: an aggregation by key gathers a document's trigrams as bits (merged
before the shuffle), and each rule's query is Boolean algebra on the bits. A rule's expression runs only
on documents that its query admits; a rule that has no mandatory trigram runs on all. Everything is
built from SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, stored, unused

#: More alternatives than this are cut off: the part then asks for nothing more.
_MOST = 16


def _letters(word: str) -> str:
    """``word`` with its ASCII letters in either case, spelled out so that all engines agree."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, the group whose length counts, the least length, base or added."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


_KEYS = "|".join(_letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + _letters("api") + "_?" + _letters("key")

RULES = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run that is too short holds no longer run, so the least length may stand in the expression
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)

#: What follows the BEGIN line of a key: all up to its END line; where that is missing, the header and base64
#: lines. Line feeds may be escaped. Possessive, so that the engine keeps no stack on a long body.
_PEM_BODY = (
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z]++-[A-Za-z]++: [^\r\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2}+)*+"
    r"(?:(?:\s|\\[nr])++(?:[A-Za-z0-9+/]++={1,2}+|(?<=[A-Za-z0-9+/]{16}\r?\n)[A-Za-z0-9+/]++(?![^\r\n])))?)"
)

#: The rules that redaction goes by. RULES marks a key by its BEGIN line, which tells where one is; here the key goes too.
REDACTED = tuple(replace(r, pattern=r.pattern + _PEM_BODY) if r.kind == "pem" else r for r in RULES)


# --- Boolean trigram queries --------------------------------------------------------------------
# True: no demand; a string: that trigram; ("and" | "or", parts)


def _joined(op: str, parts: list):
    flat = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat += p[1]
        else:
            flat.append(p)
    flat = tuple(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else (op, flat)


def _of_texts(texts: set[str]):
    """What all of ``texts``, one of which is in a match, ask for."""
    if any(len(t) < 3 for t in texts):
        return True
    return _joined("or", [_joined("and", [t[i : i + 3] for i in range(len(t) - 2)]) for t in sorted(texts)])


def _read(items) -> tuple[set[str] | None, object]:
    """(all texts that the parsed expression matches, or None if too many; its demands)."""
    texts: set[str] | None = {""}  # of the run of parts with few texts that is being read
    whole, demands = True, []
    for op, arg in items:
        if op is sre.LITERAL:
            part, asked = {chr(arg).lower()}, True
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in arg) and len({chr(v).lower() for _, v in arg}) <= 8:
            part, asked = {chr(v).lower() for _, v in arg}, True
        elif op is sre.SUBPATTERN:
            part, asked = _read(arg[3])
        elif op is sre.BRANCH:
            read = [_read(x) for x in arg[1]]
            part = None if any(t is None for t, _ in read) else set().union(*(t for t, _ in read))
            asked = _joined("or", [_of_texts(t) if t is not None else q for t, q in read]) if part is None else True
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            part, asked = _read(inner)
            if (low, high) == (0, 1) and part is not None:
                part = part | {""}
            elif (low, high) != (1, 1):
                asked = (asked if part is None else _of_texts(part)) if low else True
                part = None
        else:
            part, asked = None, True
        if part is not None and len(part) * len(texts) <= _MOST:
            texts = {a + b for a in texts for b in part}
            continue
        whole = False
        demands += [_of_texts(texts), asked if part is None else _of_texts(part)]
        texts = {""}
    if whole:
        return texts, True
    return None, _joined("and", [*demands, _of_texts(texts)])


def trigram_query(pattern: str):
    """The Boolean trigram query of a regular expression; True if it has no mandatory trigram."""
    texts, asked = _read(_parser.parse(pattern))
    return asked if texts is None else _of_texts(texts)


def trigrams_of(query) -> list[str]:
    if query is True:
        return []
    return [query] if isinstance(query, str) else list(dict.fromkeys(t for p in query[1] for t in trigrams_of(p)))


def _admits(query, holds) -> Column:
    if isinstance(query, str):
        return holds(query)
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, [_admits(p, holds) for p in query[1]])


# --- the index ------------------------------------------------------------------------------------


def _key(docs: DataFrame, id: str) -> Column:
    """A row's name in the index. Rows that share one only admit each other's candidates."""
    return F.xxhash64(*([F.col(id)] if id in docs.columns else []), F.col("text"))


def trigram_index(docs: DataFrame, trigrams: list[str], id: str = "doc_id") -> DataFrame:
    """The postings (trigram, key) of ``trigrams`` in the lower-case texts of ``docs``.

    Null text has none. A text is listed once for each trigram that it holds; repeated rows are listed again.
    """
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams)))
    # lower case by itself first: once a row, not once a trigram
    return docs.select(_key(docs, id).alias("key"), F.lower("text").alias("low")).select(F.explode(held).alias("trigram"), "key")


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """(key, one boolean for each of ``queries``): the documents that at least one of the queries admits.

    Queries that demand nothing are left out: all documents are their candidates.
    """
    asked = {kind: q for kind, q in queries.items() if q is not True}
    trigrams = list(dict.fromkeys(t for q in asked.values() for t in trigrams_of(q)))
    words = [trigrams[i : i + 63] for i in range(0, len(trigrams), 63)]  # bits of one long each
    at = {t: (f"bits{w}", 1 << i) for w, some in enumerate(words) for i, t in enumerate(some)}
    bit = {f"bits{w}": F.create_map(*(F.lit(x) for t in some for x in (t, at[t][1]))) for w, some in enumerate(words)}
    held = postings.groupBy("key").agg(*(F.bit_or(F.coalesce(m[F.col("trigram")].cast("long"), F.lit(0).cast("long"))).alias(name) for name, m in bit.items()))
    holds = lambda t: F.col(at[t][0]).bitwiseAND(F.lit(at[t][1])) != 0
    judged = held.select("key", *(_admits(q, holds).alias(kind) for kind, q in asked.items()))
    return judged.where(reduce(lambda a, b: a | b, (F.col(kind) for kind in asked)))


#: Spans gathered before they go to the others: with n matches some n * PART + (n / PART)^2 cells are copied.
PART = 256

# --- spans --------------------------------------------------------------------------------------


def rule_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's leftmost non-overlapping matches that are long enough.

    Positions are code points, ends exclusive: what lies between matches (a split at the same
    expression) and the matches themselves give them by running sums.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    pieces = F.arrays_zip(found.alias("m"), kept.alias("k"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    empty = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def step(acc: Column, p: Column) -> Column:
        # an append copies the array it appends to, so spans are gathered in short parts, and these in one array
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["m"])
        full = F.size(acc["part"]) >= PART
        new = F.when(F.length(p["k"]) >= rule.least, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(
            end.alias("at"),
            F.when(full, new).otherwise(F.concat(acc["part"], new)).alias("part"),
            F.when(full, F.concat(acc["parts"], F.array(acc["part"]))).otherwise(acc["parts"]).alias("parts"),
        )

    begin = F.struct(F.lit(0).alias("at"), empty.alias("part"), F.expr("cast(array() as array<array<struct<start: int, end: int>>>)").alias("parts"))
    return F.aggregate(pieces, begin, step, lambda acc: F.concat(F.flatten(acc["parts"]), acc["part"]))


def _arrow(spans: Column, kind: str, order: int) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, out: str = "secrets", id: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``out``: array<struct<start, order, end, kind>>, by start, then rule.

    Null text has no secrets (an empty array). Each row is judged by itself over its whole text;
    repeated rows repeat, a column ``out`` in ``docs`` is replaced, an empty table stays empty. ``id`` tells
    rows of one text apart in the index; ids may be null, repeated or absent.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    asked = [kind for kind, q in queries.items() if q is not True]
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = docs.columns
    key, name = unused("key", columns), {r.kind: unused(f"found_{r.kind}", columns) for r in rules}
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    indexed, flag = docs, {kind: unused(f"admitted_{kind}", columns) for kind in asked}
    if asked:
        trigrams = list(dict.fromkeys(t for kind in asked for t in trigrams_of(queries[kind])))
        postings = stored(trigram_index(docs, trigrams, id).sortWithinPartitions("trigram"), "postings")
        admitted = stored(candidates(postings, queries), "candidates")
        discard(postings)
        admitted = admitted.select(F.col("key").alias(key), *(F.col(kind).alias(flag[kind]) for kind in asked))
        admitted = broadcast_if(admitted)
        indexed = docs.withColumn(key, _key(docs, id)).join(admitted, key, "left")
    spans = {
        name[r.kind]: F.when(F.col(flag[r.kind]), _spans_if_any(text, r)).otherwise(none) if r.kind in flag else _spans_if_any(text, r)
        for r in rules
    }
    every = F.concat(*(_arrow(F.col(name[r.kind]), r.kind, i) for i, r in enumerate(rules)))
    return indexed.withColumns(spans).withColumn(out, F.array_sort(every)).drop(key, *flag.values(), *name.values())


def _spans_if_any(text: Column, rule: Rule) -> Column:
    """Most admitted documents still have no match: one search tells."""
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    return F.when(text.rlike(rule.pattern), rule_spans(text, rule)).otherwise(none)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACTED, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret in ``text`` replaced by ``mark`` (overlaps: once)."""
    columns, found = docs.columns, find_secrets(docs, rules, out := unused("secrets", docs.columns))
    text = F.col("text")
    state = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        F.col(out),
        state,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < a["at"], a["out"])
                .otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)))
                .alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    new = F.when(F.size(out) > 0, cut).otherwise(text)
    return found.withColumn("text", new).select(*columns)


def _digest(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    base = [r.kind for r in RULES if r.base]
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(_digest(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        _digest(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"""SELECT doc_id, {i} AS ord, '{r.kind}' AS kind, n, {'TRUE' if r.base else 'FALSE'} AS base,
  list_sum(list_transform(gaps[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:n-1], lambda x: length(x))), 0) AS start_at,
  length(found[n]) AS len FROM (
   SELECT doc_id, found, kept, gaps, unnest(range(1, len(found) + 1)) AS n FROM (
    SELECT doc_id, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {r.group}) AS kept,
           regexp_split_to_array(t, {p}) AS gaps FROM d)) WHERE length(kept[n]) >= {r.least}"""
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    span = "kind || ':' || start_at::BIGINT || ':' || (start_at + len)::BIGINT"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY start_at, ord) FILTER (base) AS base,
      string_agg({span}, ',' ORDER BY start_at, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


OP6_SQL = _oracle()
