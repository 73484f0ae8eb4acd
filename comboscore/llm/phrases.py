"""Phrase mining with stripes: each prefix keys an associative counter of the words that follow it.

Words stand in pieces (a piece ends at punctuation or a line break); everything is counted per
language. For lengths 2 to ``longest`` one pass over the texts makes stripes: a task emits, for each
prefix of ``length`` - 1 words, the words that follow it with their counts, and one entry for
all places where no candidate follows. A task packs the stripes that go to the same place into one
row (a block of prefixes, four blocks for each shuffle partition). Stripes of one prefix meet by a
shuffle on the block and are added elementwise there, without another shuffle. A merged stripe gives three things: its
entries are the counts of the longer phrases, its sum is the count of the prefix, and its largest
entry tells whether one extension to the right takes in every occurrence of the prefix.

A phrase is counted only if the phrases without its last and without its first word occur
``least`` times, which a bit table of 2**``bits`` places says (4 MB, whatever the input): a
place without its bit proves that the phrase is too rare. Two phrases may share a place, so counts
alone decide; a table that fills up prunes less and changes no result.

Hot prefixes: of each length at most ``HEAVY`` prefixes can hold a ``HEAVY``-th of all words; their
stripes are dealt to ``DEALT`` places by the next word, at every input size, and their sums and
maxima are added up afterwards. Nothing is gathered but the bit table and that list.

Score: for a phrase with count a, cut into parts with counts l and r, floor(1000 * a * n / (l * r)),
n being the words of the language, in exact decimals; the lowest cut counts, of equal ones the
earliest. A phrase is dropped if a candidate that holds it is as frequent. As counts cannot grow
with length, such a candidate makes the ones between it and the phrase as frequent too, so
extensions by one word decide.

Words and phrases are known by 64-bit hashes. Defined results: a null text has no words, a null
language is ``und``; ids are not read, so repeated and null ids are rows as others; an empty table
gives no rows; other columns are ignored, so their names cannot clash; ties are ranked by count,
then phrase (byte order).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comboscore.llm import columnar as C
from comboscore.session import cut_lineage

BITS = 25
HEAVY, DEALT = 256, 64
HELD = 1 << 20           # occurrences that a task gathers before it emits their stripes
ENTRIES, ROWS = 8192, 32    # entries of an emitted row, rows of an Arrow batch
_END = [*b".,;:!?", *range(0x0A, 0x0E)]
_WORD = C.table([0x20, 0x09, *_END])
_BREAK = np.zeros(256, np.int64)
_BREAK[_END] = 1
_STEP = C.U64(0xBF58476D1CE4E5B9)
WORDS = "lang string, key long, word string, n long"
STRIPES = "block int, prefix array<long>, next array<long>, n array<long>"


def extend(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Keys of phrases longer by one word."""
    with np.errstate(over="ignore"):
        return C.mix(keys * _STEP + words)


@functools.lru_cache(maxsize=4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _read(batch: pa.RecordBatch):
    """(languages of the documents, words, keys of the words, piece of each word) in chunks."""
    for sub, offsets, data in C.parts(batch):
        langs = sub.column("lang").to_pylist()
        w = C.Words(offsets, data, _WORD, lower=True)
        of = w.documents()
        with np.errstate(over="ignore"):
            keys = C.mix(w.hashes + np.array([_salt(x) for x in langs], C.U64)[of])
        # breaks before the word, and one more for every text
        piece = np.cumsum(_BREAK[data])[w.starts] + of if len(w) else of
        yield langs, w, keys, piece


def count_words(batches):
    """Every word of a chunk with its count, and a row without word for each language."""
    for batch in batches:
        for langs, w, keys, _ in _read(batch):
            if not len(w):
                continue
            kinds, first, n = np.unique(keys, return_index=True, return_counts=True)
            raw, of = w.data.tobytes(), w.documents()
            words = [raw[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist())]
            total: dict[str, int] = {}
            for x, c in zip(langs, w.counts.tolist()):
                total[x] = total.get(x, 0) + c
            lang = [langs[d] for d in of[first].tolist()]
            yield pa.record_batch([pa.array(lang + list(total)),
                                   pa.array(np.concatenate([kinds.view(np.int64), np.array([_salt(x) for x in total], C.U64).view(np.int64)])),
                                   pa.concat_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.nulls(len(total), pa.string())]),
                                   pa.array(n.tolist() + list(total.values()), pa.int64())], names=["lang", "key", "word", "n"])


def _stripes(prefix, following, heavy, blocks: int):
    """Record batches of the stripes of occurrences (prefix, next word; 0: none that counts).

    A row holds stripes of one block, side by side: prefixes that go to the same place in the shuffle.
    """
    both = extend(prefix, following)
    _, at, n = np.unique(both, return_index=True, return_counts=True)
    prefix, following = prefix[at], following[at]
    with np.errstate(over="ignore"):
        dealt = np.where(np.isin(prefix, heavy), C.mix(following) % C.U64(DEALT), C.U64(0))
        block = (C.mix(prefix + dealt) % C.U64(blocks)).astype(np.int32)
    order = np.lexsort([prefix, block])
    prefix, following, block, n = prefix[order], following[order], block[order], n[order]
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    begin = np.flatnonzero(new)
    place = np.arange(len(block)) - np.repeat(begin, np.diff(np.append(begin, len(block))))
    begin = np.flatnonzero(place % ENTRIES == 0)
    stop = np.append(begin[1:], len(block))
    for i in range(0, len(begin), ROWS):
        b, e = begin[i:i + ROWS], stop[i:i + ROWS]
        bounds = pa.array(np.append(b, e[-1]) - b[0], pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x[b[0]:e[-1]].view(np.int64))) for x in (prefix, following, n.astype(np.int64))]
        yield pa.record_batch([pa.array(block[b], pa.int32()), *lists], names=["block", "prefix", "next", "n"])


def make_stripes(length: int, table: np.ndarray, heavy: np.ndarray, bits: int, blocks: int):
    """Stripes of the prefixes of ``length`` - 1 words that ``table`` doesn't rule out."""
    def frequent(keys):
        at = (keys & C.U64((1 << bits) - 1)).astype(np.int64)
        return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def run(batches):
        held, waiting = [], 0
        for batch in batches:
            for _, _, words, piece in _read(batch):
                n = len(words) - (length - 2)
                if n <= 0:
                    continue
                keys = words
                for k in range(1, length - 1):
                    keys = extend(keys[:-1], words[k:])
                may = frequent(keys) & (piece[:n] == piece[length - 2:])
                follows = np.zeros(n, bool)
                follows[:-1] = may[:-1] & may[1:] & (piece[:n - 1] == piece[length - 1:])
                at = np.flatnonzero(may)
                following = np.where(follows[at], words[np.minimum(at + length - 1, len(words) - 1)], C.U64(0))
                held.append((keys[at], following))
                waiting += len(at)
                if waiting >= HELD:
                    yield from _stripes(*map(np.concatenate, zip(*held)), heavy, blocks)
                    held, waiting = [], 0
        if waiting:
            yield from _stripes(*map(np.concatenate, zip(*held)), heavy, blocks)
    return run


def merge(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes added elementwise: prefix, block, total, most, kept (entries of ``least`` or more).

    The shuffle on the block serves both groupings below.
    """
    entries = (stripes.repartition("block").select("block", F.explode(F.arrays_zip("prefix", "next", "n")).alias("x"))
               .groupBy("block", F.col("x.prefix").alias("prefix"), F.col("x.next").alias("next")).agg(F.sum("x.n").alias("n")))
    real = F.col("next") != 0
    return entries.groupBy("block", "prefix").agg(
        F.sum("n").alias("total"), F.max(F.when(real, F.col("n"))).alias("most"),
        F.collect_list(F.when(real & (F.col("n") >= least), F.struct("next", "n"))).alias("kept"))


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """2**``bits`` bits, set where a key falls; made in pieces of 4 KB by the tasks."""
    span = 15

    def pack(table: pa.Table) -> pa.Table:
        place = np.zeros(1 << span, bool)
        place[table.column("place").to_numpy()] = True
        return pa.table({"part": table.column("part")[:1], "packed": [np.packbits(place, bitorder="little").tobytes()]})
    place = F.col("key").bitwiseAND((1 << bits) - 1)
    parts = (keys.select(F.shiftright(place, span).cast("int").alias("part"), place.bitwiseAND((1 << span) - 1).cast("int").alias("place"))
             .distinct().groupBy("part").applyInArrow(pack, "part int, packed binary").toArrow())
    out = np.zeros(1 << max(bits - 3, span - 3), np.uint8)
    for part, packed in zip(parts.column("part").to_pylist(), parts.column("packed").to_pylist()):
        out[part << (span - 3):(part + 1) << (span - 3)] = np.frombuffer(packed, np.uint8)
    return out


def _numbers(batch, name) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _keyed(batches):
    """Adds the key of prefix + next."""
    for b in batches:
        key = extend(_numbers(b, "prefix").view(C.U64), _numbers(b, "next").view(C.U64))
        yield pa.record_batch([b.column("prefix"), b.column("next"), b.column("n"), pa.array(key.view(np.int64))], names=["prefix", "next", "n", "key"])


def _cuts(batches):
    """Every way to cut the phrases in two: key, cut, key of the first part, key of the rest."""
    for b in batches:
        words = b.column("words")
        size = np.diff(words.offsets.to_numpy())
        flat = words.flatten().to_numpy(zero_copy_only=False).view(C.U64)
        begin = np.cumsum(size) - size
        out = []
        for k in np.unique(size).tolist():
            rows = np.flatnonzero(size == k)
            w = flat[begin[rows][:, None] + np.arange(k)]

            def span(i, j):
                key = w[:, i]
                for x in range(i + 1, j):
                    key = extend(key, w[:, x])
                return key
            own = _numbers(b, "key")[rows]
            out += [(own, np.full(len(rows), j, np.int32), span(0, j).view(np.int64), span(j, k).view(np.int64)) for j in range(1, k)]
        if out:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "cut", "first", "rest"])


def _union(tables):
    return functools.reduce(DataFrame.unionByName, tables)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, bits: int = BITS, lang_col: str = "lang", text_col: str = "text"):
    """(words per language, phrases by length, prefixes).

    Phrases: key, lang, words (keys), phrase, n. Prefixes: key, total (the count of the prefix
    itself), most (the count of its most frequent extension by one word).
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    counted = cut_lineage(rows.mapInArrow(count_words, WORDS).groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))
                          .where(F.col("word").isNull() | (F.col("n") >= least)))
    size = counted.where("word is null").select("lang", F.col("n").alias("words_total"))
    words = counted.where("word is not null").select("key", "lang", F.array("key").alias("words"), F.col("word").alias("phrase"), "n")
    everything = size.agg(F.sum("words_total")).first()[0] or 0
    phrases, prefixes = [words], []
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for length in range(2, longest + 1):
        shorter = phrases[-1]
        # at most HEAVY rows, as counts of one length add up to at most all words
        heavy = shorter.where(F.col("n") * HEAVY >= everything).select("key").toArrow().column("key").to_numpy().view(C.U64)
        stripes = rows.mapInArrow(make_stripes(length, bit_table(shorter, bits), heavy, bits, blocks), STRIPES)
        merged = cut_lineage(merge(stripes, least))
        prefixes.append(merged.groupBy(F.col("prefix").alias("key")).agg(F.sum("total").alias("total"), F.max("most").alias("most"))
                        .where(F.col("total") >= least))
        longer = merged.select("prefix", F.explode("kept").alias("x")).select("prefix", "x.next", "x.n")
        longer = longer.mapInArrow(_keyed, "prefix long, next long, n long, key long")
        longer = (longer.join(shorter.select(F.col("key").alias("prefix"), "lang", F.col("words").alias("before"), F.col("phrase").alias("begins")), "prefix")
                  .join(words.select(F.col("key").alias("next"), F.col("phrase").alias("ends")), "next"))
        phrases.append(cut_lineage(longer.select("key", "lang", F.concat("before", F.array("next")).alias("words"),
                                                 F.concat_ws(" ", "begins", "ends").alias("phrase"), "n")))
    return size, phrases, _union(prefixes)


def exact_score(a: str, n: str, l: str, r: str) -> F.Column:
    """floor(1000 * a * n / (l * r)) in decimals of 38 digits (an overflow is an error)."""
    def d(x):
        return f"cast({x} as decimal(18,0))"
    return F.expr(f"(cast(1000 as decimal(4,0)) * {d(a)} * {d(n)}) div ({d(l)} * {d(r)})").cast("long")


def mine_phrases(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, bits: int = BITS,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    size, phrases, prefixes = frequent_phrases(docs, least, longest, bits, lang_col, text_col)
    counts = _union([p.select("key", F.col("n").alias("f")) for p in phrases])
    candidates = _union(phrases[1:])
    cuts = cut_lineage(candidates.select("key", "words").mapInArrow(_cuts, "key long, cut int, first long, rest long"))
    # a phrase without its first word: the longest extension to its left
    left = (cuts.where("cut = 1").join(candidates.select("key", "n"), "key").groupBy(F.col("rest").alias("key")).agg(F.max("n").alias("left_most")))
    open_ = (candidates.select("key", "lang", "phrase", F.col("n").alias("a")).join(left, "key", "left")
             .join(prefixes.select("key", "most"), "key", "left").where("coalesce(greatest(left_most, most), 0) < a").drop("left_most", "most"))
    scored = (cuts.join(open_, "key").join(size.withColumnRenamed("words_total", "n"), "lang")
              .join(prefixes.select(F.col("key").alias("first"), F.col("total").alias("l")), "first")
              .join(counts.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
              .withColumn("score", exact_score("a", "n", "l", "r")))
    best = (scored.groupBy("key", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
            .select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
