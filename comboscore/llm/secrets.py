"""Secrets in texts: all rules as one deterministic automaton, one pass over the bytes.

Every rule is an expression ``head`` + ``body`` and a least length of what ``body`` matches. The
rules are compiled together by subset construction and minimisation (``automaton.py``); the scan
of a text makes one table look-up a byte, whatever the number of rules. The states tell where a
rule ends and where it is under way; only stretches in which a rule is under way and ends are
walked again, by the rule's own automaton, to find its leftmost longest matches. These do not
overlap within a rule; a match whose body is too short is dropped and its place not tried again.

Base rules: assign (a name of a secret, a sign, a value of 12 or more), access (a key id of 18 or
more), hex (16 or more digits). ``hex`` is written with its least length in the expression: its
matches are whole runs, so this leaves out exactly the matches that would be dropped, and saves
walking every letter a to f. Added rules look for formats of tokens in public use.

Places are code points, ends exclusive; rules are ASCII, so lengths in bytes are lengths in code
points. Defined results: a null text is empty and has no spans; rows are independent, so null
and repeated ids need no rule; texts of any length are scanned whole (memory holds a chunk of
documents at a time, a longer document is a chunk); columns other than id and text are ignored,
so their names cannot clash.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import automaton
from comboscore.llm import columnar as C


class Rule(NamedTuple):
    kind: str
    head: str
    body: str
    least: int
    base: bool = False


# The formats of the rules.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18, True),
    Rule("hex", "", r"[0-9a-f]{16,}", 16, True),
    Rule("code_host", "", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", "", r"xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("map_key", "", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("payment", "", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("private_key", "", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----", 0),
)
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


@functools.lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...] = RULES):
    """(automaton of all rules, each rule's own, each head's own)."""
    return (automaton.compile_rules([r.head + r.body for r in rules]), [automaton.anchored(r.head + r.body) for r in rules],
            [automaton.anchored(r.head) if r.head else None for r in rules])


def _matches(own, head, least: int, raw: bytes, low: int, stop: int, last: int):
    """Leftmost longest matches from ``low`` to ``stop``; none ends after ``last``."""
    at = low
    while at < last:
        end = own.longest(raw, at, stop)
        if end < 0:
            at += 1
            continue
        if end - (head.longest(raw, at, end) if head else at) >= least:
            yield at, end
        at = end


def scanner(rules: tuple[Rule, ...] = RULES):
    """Arrow batches of doc_id, text -> doc_id, spans (by start, then the rules' order)."""
    every, own, heads = compiled(rules)
    hit_state = every.matched != 0
    matched, alive = ([(bits >> k & 1).astype(bool) for k in range(len(rules))] for bits in (every.matched, every.alive))

    def spans_of(raw: bytes, data: np.ndarray, states: np.ndarray):
        found = []
        for k, rule in enumerate(rules):
            ends = np.flatnonzero(matched[k][states])
            if not len(ends):
                continue
            for low, stop in automaton.segments(alive[k][states]):
                i, j = np.searchsorted(ends, [low, stop])
                if j > i:
                    found += [(s, k, e) for s, e in _matches(own[k], heads[k], rule.least, raw, low, stop, int(ends[j - 1]) + 1)]
        found.sort()
        if found and (data >= 0x80).any():
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            found = [(int(point[s]), k, int(point[e])) for s, k, e in found]
        return [(rules[k].kind, s, e, rules[k].base) for s, k, e in found]

    def run(batches):
        for batch in batches:
            for sub, offsets, data in C.parts(batch):
                docs = len(offsets) - 1
                # one END after every text
                buffer = np.insert(data, offsets[1:], automaton.END)
                bounds = offsets + np.arange(docs + 1)
                states = automaton.scan(every, buffer)
                of = np.unique(np.searchsorted(bounds, np.flatnonzero(hit_state[states]), "right") - 1)
                spans: list = [[] for _ in range(docs)]
                for d in of.tolist():
                    text = data[offsets[d]:offsets[d + 1]]
                    spans[d] = spans_of(text.tobytes(), text, states[bounds[d]:bounds[d + 1] - 1])
                flat = [x for s in spans for x in s]
                values = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], f.type) for i, f in enumerate(_SPAN)], fields=list(_SPAN))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), pa.int32()), values)
                yield pa.record_batch([sub.column("doc_id"), lists], names=["doc_id", "spans"])
    return run


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base), by start, then the rules' order."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(scanner(tuple(rules)), SPANS)


def listed(spans) -> F.Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base rule, base_spans, spans."""
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, (lambda kind: lambda x: x["kind"] == kind)(r.kind))).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return find_secrets(docs, rules).select("doc_id", *counts, listed(F.filter(spans, lambda x: x["base"])).alias("base_spans"),
                                            listed(spans).alias("spans"))
