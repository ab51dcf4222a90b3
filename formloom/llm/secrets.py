"""Secret scans over a trigram index.

``build_index`` writes a table of segments (a few thousand documents each): for every trigram of the ASCII-lowered UTF-8
text the documents that have it, as a list of places or, where that is shorter, a bitmap. ``trigram_query`` derives from
a rule's regular expression a Boolean query of trigrams that every match must hold; ``candidates`` reads only the trigrams
that the rules name and intersects and unites their postings. Only candidates are verified by the expression itself.
A rule without mandatory trigrams (such as hex runs) is verified on every document.

A null text is an empty one: no spans. Ids may be null or repeat: candidates go by id, and verification is by row.
An empty table gives an empty index and no spans. Spans are code points, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import small_side

from .common import arrow_schema, ascii_lower, record, slices, two


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more; ASCII rules of case."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", 0, 0, True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
    Rule("prefixed", r"(?:ghp|gho|ghs|xoxb|xoxp|sk_live|rk_live|AIza)[_-]?[A-Za-z0-9_-]{16,}"),
)

# ---- Boolean trigram queries: True (no demand), bytes (a trigram), ("and" | "or", parts)
MOST = 64


def _join(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else (op, tuple(dict.fromkeys(parts)))
    return True if not parts or True in parts else parts[0] if len(parts) == 1 else (op, tuple(dict.fromkeys(parts)))


def _demand(strings: set[str]):
    """One of these strings is in every match."""
    raw = [ascii_lower(s) for s in sorted(strings)]
    return _join("or", [_join("and", [r[i:i + 3] for i in range(len(r) - 2)]) for r in raw])


def _exact(items) -> set[str] | None:
    """All strings a part can match, lower case, if they are few."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN:
            if any(x[0] is not C.LITERAL for x in arg):
                return None
            own = {chr(x[1]).lower() for x in arg}
        elif op is C.SUBPATTERN:
            own = _exact(arg[3])
        elif op is C.BRANCH:
            sets = [_exact(x) for x in arg[1]]
            own = None if None in sets else set().union(*sets)
        elif op is C.MAX_REPEAT and arg[0] == arg[1] <= 3 or op is C.MAX_REPEAT and arg[:2] == (0, 1):
            one = _exact(arg[2])
            own = None if one is None else {""} | one if arg[0] == 0 else {"".join(t) for t in _power(one, arg[0])}
        elif op is C.AT:
            own = {""}
        else:
            return None
        if own is None or len(out) * len(own) > MOST:
            return None
        out = {a + b for a in out for b in own}
    return out


def _power(strings: set[str], n: int):
    out = [()]
    for _ in range(n):
        out = [(*t, s) for t in out for s in strings][:MOST * MOST]
    return out


def _walk(items):
    parts, run = [], {""}

    def end():
        nonlocal run
        parts.append(_demand(run))
        run = {""}
    for item in items:
        op, arg = item
        own = _exact([item])
        if own is not None:
            if len(run) * len(own) > MOST:
                end()
            run = {a + b for a in run for b in own}
            continue
        end()
        if op is C.SUBPATTERN:
            parts.append(_walk(arg[3]))
        elif op is C.BRANCH:
            parts.append(_join("or", [_walk(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            parts.append(_walk(arg[2]))
    end()
    return _join("and", parts)


def trigram_query(pattern: str):
    """The demand of ``pattern`` on the trigrams of a lowered text; True if it has none."""
    return _walk(_parser.parse(pattern))


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def evaluate(query, has) -> np.ndarray:
    """``has(trigram)`` gives a Boolean array over the documents of a segment."""
    if isinstance(query, bytes):
        return has(query)
    parts = [evaluate(q, has) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


# ---- the index
INDEX = "segment long, trigram int, n int, dense boolean, postings binary"
DOCUMENTS = -1  # the row of a segment that lists its ids


def build_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of ``docs`` at ``path``; a segment holds at most 4,096 documents or about 4 MB of text."""
    out = arrow_schema(docs.sparkSession, INDEX)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for number, b in enumerate(slices(batches, "text")):
            rows = b.to_pydict()
            yield record(out, _segment((part << 32) + number, rows["doc_id"], [ascii_lower(t or "") for t in rows["text"]]))
    two(docs, id_col, text_col).mapInArrow(run, INDEX).write.parquet(path)


def _segment(segment: int, ids: list, texts: list[bytes]) -> dict:
    n = len(texts)
    raw = np.frombuffer(b"".join(texts) + b"\0\0", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, n)
    tri = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    doc = np.repeat(np.arange(n), size)
    ends = np.cumsum(size)
    inside = np.arange(len(doc)) + 2 < ends[doc]
    key = np.unique((tri[:len(doc)] << 12 | doc)[inside])
    tri, doc = key >> 12, key & 4095
    first = np.nonzero(np.append(True, tri[1:] != tri[:-1]))[0] if len(tri) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(tri)))
    width = -(-n // 8)
    dense = 2 * count > width
    bits = np.zeros((int(dense.sum()), n), bool)
    row = np.repeat(np.arange(len(first)), count)
    at = np.cumsum(dense) - 1
    own = dense[row]
    bits[at[row[own]], doc[own]] = True
    packed = np.packbits(bits, axis=1)
    short = doc.astype("<u2")
    postings = [packed[at[i]].tobytes() if dense[i] else short[f:f + c].tobytes()
                for i, (f, c) in enumerate(zip(first.tolist(), count.tolist()))]
    listed = pa.array(ids, pa.int64())
    valid = np.array([x is not None for x in ids], np.uint8).tobytes()
    head = np.array([0 if x is None else x for x in ids], "<i8").tobytes() + valid
    return {"segment": np.full(len(first) + 1, segment), "trigram": np.append(DOCUMENTS, tri[first]), "n": np.append(len(listed), count),
            "dense": np.append(False, dense), "postings": [head, *postings]}


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and the numbers of the rules whose trigram query the document meets, one row for each id."""
    demands = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True}
    needed = sorted({code(t) for q in demands.values() for t in trigrams(q)})

    schema = "doc_id long, rules array<int>"
    out = arrow_schema(index.sparkSession, schema)

    def find(table):
        held = {t: (n, d, p) for t, n, d, p in zip(*(table[c].to_pylist() for c in ("trigram", "n", "dense", "postings")))}
        n, _, head = held[DOCUMENTS]
        ids, valid = np.frombuffer(head, "<i8", n), np.frombuffer(head, np.uint8, n, 8 * n)

        def has(t):
            out = np.zeros(n, bool)
            if (x := held.get(code(t))) is not None:
                if x[1]:
                    out = np.unpackbits(np.frombuffer(x[2], np.uint8), count=n).astype(bool)
                else:
                    out[np.frombuffer(x[2], "<u2")] = True
            return out
        met = {i: evaluate(q, has) for i, q in demands.items()}
        rows = np.nonzero(np.logical_or.reduce(list(met.values())))[0] if met else []
        return pa.Table.from_batches([record(out, {"doc_id": [int(ids[r]) if valid[r] else None for r in rows],
                                                   "rules": [[i for i in met if met[i][r]] for r in rows]})])
    named = index.where(F.col("trigram").isin(DOCUMENTS, *needed))
    found = named.groupBy("segment").applyInArrow(find, schema)  # a group is one segment
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))


def spans_of(text: str, rules) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of every kept match of the compiled rules, in order."""
    out = []
    for i, pattern, group, least in rules:
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def scan(docs: DataFrame, index: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, *, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``, an array of (kind, start, end), for every row."""
    found = small_side(candidates(index, rules).withColumnRenamed("doc_id", "own"))
    rows = two(docs, id_col, text_col)
    rows = rows.join(found, rows.doc_id.eqNullSafe(found.own), "left").select("doc_id", "text", "rules")
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
    out = arrow_schema(docs.sparkSession, schema)
    always = [i for i, r in enumerate(rules) if trigram_query(r.pattern) is True]

    def run(batches):
        made = [(i, r.compiled(), r.group, r.least) for i, r in enumerate(rules)]
        for b in slices(batches, "text"):
            got = b.to_pydict()
            spans = [spans_of(t or "", [made[i] for i in sorted({*always, *(own or ())})])
                     for t, own in zip(got["text"], got["rules"])]
            yield record(out, {"doc_id": got["doc_id"], "spans": [
                [{"kind": rules[i].kind, "start": a, "end": e} for a, i, e in x] for x in spans]})
    return rows.mapInArrow(run, schema)
