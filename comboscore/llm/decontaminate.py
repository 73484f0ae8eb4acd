"""Benchmark decontamination with a distributed positional inverted index.

The index is split by documents: every task builds the postings (term, position) of the
test terms in its own documents, so the corpus is never shuffled. Test phrases are all runs
of ``window`` neighbouring words of an item (a shorter item is one phrase). For each phrase
and shard, candidates come from the term with the shortest postings list there; the lists of
the other terms, rarest next, are intersected at their offsets by binary search. What is left
are exact phrase matches. With ``slack`` the same lists also give proximity matches: documents
that hold all of the phrase's words in any order, a repeated word as often as the phrase does,
inside one span of at most the phrase's length plus ``slack`` words. The rarest term only names
the places to look at; what matches doesn't depend on it, nor on the documents beside.

Items reach the tasks as broadcasts of at most about ``BLOCK`` bytes of text each; a larger
benchmark is cut into blocks by a hash of the item, and the documents pass through one search
step per block, with a stored table after every ``CHAIN`` steps. Memory per task is one block
and one chunk of documents.

Defined results: a null text (document or item) has no words; an empty item has no phrase; a
null item_id is listed as ''; repeated items and documents are handled row by row; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.session import cut_lineage

BLOCK = 4 << 20
CHAIN = 4
SEEDS = 1 << 16                  # places of rarest terms looked at together
SPANS = "array<struct<lo:int,hi:int>>"
FOUND = {"n_words": "long", "n_hit": "long", "spans": SPANS, "items": "array<string>", "near_items": "array<string>"}
_SPAN_TYPE = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


class Phrases:
    """The phrases of a block of items as rows of term numbers (-1 beyond a short phrase)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        offsets, data = C.utf8(pa.array([t for _, t in items], pa.string()))
        w = C.Words(offsets, data, C.ALNUM_WORDS, lower=True)
        self.terms, number = np.unique(w.hashes, return_inverse=True)
        rows, owner = [], []
        for k, (item, _) in enumerate(items):
            own = number[w.bounds[k]:w.bounds[k + 1]]
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                part = own[i:i + window]
                rows.append(np.concatenate([part, np.full(window - len(part), -1)]))
                owner.append(item)
        table = np.array(rows, np.int64).reshape(-1, window)
        self.phrases, which = np.unique(table, axis=0, return_inverse=True)
        self.sizes = (self.phrases >= 0).sum(axis=1)
        # how often a phrase holds each of its words, at the word's first place; 0 at the others
        equal = (self.phrases[:, :, None] == self.phrases[:, None, :]) & (self.phrases >= 0)[:, :, None]
        first = equal.argmax(axis=2) == np.arange(window)
        self.needs = np.where((self.phrases >= 0) & first, equal.sum(axis=2), 0)
        self.items = sorted(set(owner))
        place = {x: i for i, x in enumerate(self.items)}
        pairs = np.unique(np.stack([which.ravel(), np.array([place[x] for x in owner], np.int64)], 1), axis=0) \
            if owner else np.zeros((0, 2), np.int64)
        self.item_of, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))

    def word(self, phrase, place):
        """(term, how often it is needed) at a place of each phrase."""
        return self.phrases[phrase, place], self.needs[phrase, place]

    def owners(self, phrase: np.ndarray):
        """(row of ``phrase``, item number) pairs."""
        many = self.item_at[phrase + 1] - self.item_at[phrase]
        return np.repeat(np.arange(len(phrase)), many), self.item_of[C.ranges(self.item_at[phrase], many)]


class Postings:
    """Positional index of the test terms in one chunk of documents."""

    def __init__(self, words: C.Words, phrases: Phrases):
        self.n = len(words) + 1
        at = np.minimum(np.searchsorted(phrases.terms, words.hashes), max(len(phrases.terms) - 1, 0))
        known = np.flatnonzero(phrases.terms[at] == words.hashes) if len(phrases.terms) else at[:0]
        term = at[known]
        by = np.argsort(term, kind="stable")
        self.position = known[by]
        self.key = term[by] * self.n + self.position
        self.begin = np.searchsorted(term[by], np.arange(len(phrases.terms) + 1))

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.n + position
        p = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (self.key[p] == want) & (position >= 0) & (position < self.n)

    def count(self, term, low, high) -> np.ndarray:
        """Postings of ``term`` from ``low`` up to before ``high``."""
        return np.searchsorted(self.key, term * self.n + high) - np.searchsorted(self.key, term * self.n + low)

    def near(self, phrases: Phrases, rare, phrase, seed, low, high, slack: int) -> np.ndarray:
        """Rows whose phrase has all its words in one span around ``seed``, inside [low, high)."""
        width = phrases.sizes[phrase] + slack
        low, high = np.maximum(low, seed - width + 1), np.minimum(high, seed + width)
        rows = np.arange(len(phrase))
        for k in range(phrases.window):                       # each word often enough around the seed
            term, need = phrases.word(phrase[rows], rare[phrase[rows], k])
            ok = need == 0
            ok[~ok] = self.count(term[~ok], low[rows][~ok], high[rows][~ok]) >= need[~ok]
            rows = rows[ok]
        # a span that holds them all can begin at one of its words: try the words of the phrase before the seed
        span_row, span_at = [], []
        for k in range(phrases.window):
            term, need = phrases.word(phrase[rows], k)
            own = rows[need > 0]
            term = term[need > 0]
            p = np.searchsorted(self.key, term * self.n + low[own])
            many = np.searchsorted(self.key, term * self.n + seed[own], "right") - p
            span_row.append(np.repeat(own, many))
            span_at.append(self.position[C.ranges(p, many)])
        at, own = np.concatenate(span_at), np.concatenate(span_row)
        for k in range(phrases.window):
            term, need = phrases.word(phrase[own], rare[phrase[own], k])
            ok = need == 0
            stop = np.minimum(at + width[own], high[own])
            ok[~ok] = self.count(term[~ok], at[~ok], stop[~ok]) >= need[~ok]
            at, own = at[ok], own[ok]
        return np.unique(own)

    def search(self, phrases: Phrases, document: np.ndarray, bounds: np.ndarray, slack: int | None):
        """(phrase, first word) of exact matches; (phrase, document) of proximity matches."""
        none = np.zeros(0, np.int64)
        if not len(self.key) or not len(phrases.phrases):
            return none, none, none, none
        sizes = np.diff(self.begin)
        real = phrases.phrases >= 0
        lengths = np.where(real, sizes[np.where(real, phrases.phrases, 0)], np.iinfo(np.int64).max)
        rare = np.argsort(lengths, axis=1, kind="stable")      # offsets, rarest term first
        many = lengths[np.arange(len(rare)), rare[:, 0]]
        phrase = np.repeat(np.arange(len(rare)), many)
        first = phrases.phrases[np.arange(len(rare)), rare[:, 0]]
        seed = self.position[C.ranges(self.begin[first], many)]
        start, p = seed - rare[phrase, 0], phrase
        keep = start >= 0
        start, p = start[keep], p[keep]
        for k in range(1, phrases.window):
            if not len(p):
                break
            offset = rare[p, k]
            term = phrases.phrases[p, offset]
            ok = term < 0
            ok[~ok] = self.has(term[~ok], start[~ok] + offset[~ok])
            start, p = start[ok], p[ok]
        if len(p):
            ok = document[start] == document[start + phrases.sizes[p] - 1]
            start, p = start[ok], p[ok]
        near_p, near_d = none, none
        if slack is not None and len(phrase):
            d = document[seed]
            found = [np.zeros(0, np.int64)]
            for i in range(0, len(phrase), SEEDS):            # bounds what is held at once
                j = slice(i, i + SEEDS)
                found.append(i + self.near(phrases, rare, phrase[j], seed[j], bounds[d[j]], bounds[d[j] + 1], slack))
            rows = np.concatenate(found)
            near_p, near_d = phrase[rows], d[rows]
        return p, start, near_p, near_d


def search_step(block, window: int, slack: int | None, text_col: str, prefix: str):
    """Search one block of items; hits of former blocks (columns ``prefix`` + FOUND) are merged."""
    def run(batches):
        phrases = Phrases(block.value, window)
        names = np.array(phrases.items, object)
        for batch in batches:
            for sub, offsets, data in C.parts(batch, text_col):
                w = C.Words(offsets, data, C.ALNUM_WORDS, lower=True)
                document = w.documents()
                found = Postings(w, phrases).search(phrases, document, w.bounds, slack)
                p, start, near_p, near_d = found
                row, item = phrases.owners(p)
                exact = np.unique(np.stack([document[start[row]], item], 1), axis=0)
                row, item = phrases.owners(near_p)
                near = np.unique(np.stack([near_d[row], item], 1), axis=0)
                hit = C.covered(start, start + phrases.sizes[p], len(w))
                old = sub.column(prefix + "spans")
                if (many := np.diff(old.offsets.to_numpy())).any():
                    f = old.flatten()
                    base = np.repeat(w.bounds[:-1], many)
                    hit |= C.covered(base + f.field(0).to_numpy(zero_copy_only=False),
                                     base + f.field(1).to_numpy(zero_copy_only=False), len(w))
                edge = np.flatnonzero(hit & np.concatenate([[True], ~hit[:-1] | (document[1:] != document[:-1])]) if len(w) else hit)
                stop = np.flatnonzero(hit & np.concatenate([~hit[1:] | (document[1:] != document[:-1]), [True]]) if len(w) else hit) + 1
                per = np.bincount(document[edge], minlength=sub.num_rows) if len(edge) else np.zeros(sub.num_rows, np.int64)
                n_hit = np.bincount(document[hit], minlength=sub.num_rows) if len(w) else np.zeros(sub.num_rows, np.int64)
                base = w.bounds[document[edge]] if len(edge) else edge
                spans = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array((edge - base).astype(np.int32)), pa.array((stop - base).astype(np.int32))], ["lo", "hi"]))
                lists = []
                for pairs, col in ((exact, "items"), (near, "near_items")):
                    at = np.searchsorted(pairs[:, 0], np.arange(sub.num_rows + 1))
                    before = sub.column(prefix + col).to_pylist()
                    lists.append([b if i == j else sorted({*b, *names[pairs[i:j, 1]]})
                                  for b, i, j in zip(before, at[:-1], at[1:])])
                new = [pa.array(w.counts, pa.int64()), pa.array(n_hit, pa.int64()), spans.cast(_SPAN_TYPE),
                       *(pa.array(x, pa.list_(pa.string())) for x in lists)]
                for name, column in zip(FOUND, new):
                    sub = sub.set_column(sub.schema.get_field_index(prefix + name), prefix + name, column)
                yield sub
    return run


def with_items(docs: DataFrame, items: DataFrame, prefix: str, window: int = 10, slack: int | None = None,
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """All columns of ``docs`` and, under ``prefix``: n_words, n_hit, spans (of hit words), items, near_items."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                         F.coalesce(F.col(item_text_col), F.lit("")).alias("words"))
    size = items.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block))
    empty = {"long": F.lit(0), SPANS: F.array(), "array<string>": F.array()}
    out = docs.withColumns({prefix + k: empty[t].cast(t) for k, t in FOUND.items()})
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k) if blocks > 1 else items
        value = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows.collect()])
        out = out.mapInArrow(search_step(value, window, slack, text_col, prefix), out.schema)
        if k % CHAIN == CHAIN - 1 and k < blocks - 1:
            out = cut_lineage(out)
    return out


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items, near_items."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_items(docs, items, "", **options).drop("text")
