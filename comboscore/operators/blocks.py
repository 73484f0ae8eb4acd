"""Word-id blocks for language-model training tables (fixed length, masks, labels).

The vocabulary is a table (token, count, token_id) with ids by (count desc, token); ids
come from the distributed ``with_ordinal``, never from a single-partition ranking. Tokens
are mapped to ids in two steps: the frequent head of the vocabulary, as
large as the session's broadcast threshold allows, is broadcast and looked up by whole rows, so hot
tokens are neither rows nor shuffle keys; the rest joins by a shuffle. Only positions that can reach the block are joined (the block is
the feature), while the full token count of every text is kept for the ``truncated`` flag.
``pad_batches`` collates rows of any length into batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comboscore.functions.text import ws_tokens
from comboscore.operators.ordinal import with_ordinal
from comboscore.session import cut_lineage

PAD_ID = 0
IGNORE_INDEX = -100


def vocabulary(df: DataFrame, text: str, tokenizer=ws_tokens, first_id: int = 1) -> DataFrame:
    """(token, count, token_id): ids from ``first_id`` by count desc, then token."""
    counts = (df.select(F.explode(tokenizer(F.col(text))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    o = with_ordinal(counts, [F.col("count").desc(), F.col("token")], "_r")
    return o.select("token", "count", (F.col("_r") + first_id).alias("token_id"))


def _head_and_tail(vocab: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent tokens, as many as fit the session's broadcast threshold, and the others (None
    without any).

    Ids follow the counts, so the head is a range of ids. Its bytes are measured on the stored
    vocabulary.
    """
    spark = vocab.sparkSession
    v = cut_lineage(vocab.select("token", "token_id"))
    size = v.agg(F.sum(F.octet_length("token") + 16).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("token_id").alias("first")).first()
    limit = max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))
    keep = size.n if not size.bytes else min(size.n, size.n * limit // size.bytes)
    in_head = F.col("token_id") < F.lit((size.first or 0) + keep)
    return v.where(in_head), v.where(~in_head) if keep < size.n else None


def _head_ids(head: DataFrame, other: int | None = None):
    """array<string> -> array<long>: ids of the broadcast tokens, ``other`` for others. Works on the flattened
    tokens of an Arrow batch; rows stay rows."""
    table = head.toArrow().combine_chunks()
    shared = head.sparkSession.sparkContext.broadcast(tuple(
        pa.array(table.column(c).to_pylist(), t) for c, t in (("token", pa.string()), ("token_id", pa.int64()))))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def ids(tokens: pa.Array) -> pa.Array:
        known, number = shared.value
        found = number.take(pc.index_in(tokens.flatten().cast(pa.string()), value_set=known))
        if other is not None:
            found = found.fill_null(other)
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(starts, found)
    return ids


def token_ids(df: DataFrame, key: str, text: str, vocab: DataFrame, limit: int | None = None,
              pad_id: int = PAD_ID, tokenizer=ws_tokens) -> DataFrame:
    """(key, ids, n_tokens): ids of the first ``limit`` tokens (all without it) and the full count.

    The frequent tokens are looked up in a broadcast head of the vocabulary, whole rows at a time; only
    the rare others become rows, which join the tail by a shuffle. A token that the vocabulary
    lacks becomes ``pad_id``. Rows that share a key are one, by position.
    """
    toks = df.select(key, tokenizer(F.col(text)).alias("_t"))
    cut = F.col("_t") if limit is None else F.slice("_t", 1, limit)
    head, tail = _head_and_tail(vocab)
    rows = toks.select(key, F.size("_t").alias("n_tokens"), F.coalesce(cut, F.array().cast("array<string>")).alias("_t"))
    rows = rows.withColumn("_ids", _head_ids(head, pad_id if tail is None else None)("_t"))
    repeats = df.groupBy(key).count().where("count > 1").limit(1).count()
    if tail is None and not repeats:
        return rows.select(key, F.col("_ids").alias("ids"), "n_tokens")
    at = F.transform("_ids", lambda x, i: F.struct(i.alias("_pos"), x.alias("id")))
    parts = rows.select(key, "n_tokens", F.filter(at, lambda x: x["id"].isNotNull()).alias("_p"))
    if tail is not None:
        lacked = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size("_t") - 1).alias("_pos"), F.col("_t").alias("token"), "_ids"),
                          lambda x: x["_ids"].isNull())
        rare = rows.where(F.size("_t") > 0).select(key, F.inline(F.transform(lacked, lambda x: F.struct(x["_pos"].alias("_pos"), x["token"].alias("token")))))
        rare = rare.join(tail, "token", "left")
        place = F.struct("_pos", F.coalesce("token_id", F.lit(pad_id)).cast("long").alias("id"))
        parts = parts.unionByName(rare.select(key, F.lit(None).cast("int").alias("n_tokens"), F.array(place).alias("_p")))
    grouped = parts.groupBy(key).agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.flatten(F.collect_list("_p"))).alias("_s"))
    return grouped.select(key, F.transform("_s", lambda x: x["id"]).alias("ids"), "n_tokens")


def _padded(ids: Column, length: Column, side: str, pad_id: int) -> tuple[Column, Column]:
    """(ids, mask) of ``length`` places."""
    if side not in ("right", "left"):
        raise ValueError("side must be 'right' or 'left'")
    k, room = F.size(ids), (length - F.size(ids)).cast("int")
    pad, ones, zeros = F.array_repeat(F.lit(pad_id).cast("long"), room), F.array_repeat(F.lit(1), k), F.array_repeat(F.lit(0), room)
    return (F.concat(ids, pad), F.concat(ones, zeros)) if side == "right" else (F.concat(pad, ids), F.concat(zeros, ones))


def blocks(df: DataFrame, key: str, text: str, vocab: DataFrame, size: int = 128,
           side: str = "right", pad_id: int = PAD_ID, tokenizer=ws_tokens) -> DataFrame:
    """(key, ids, mask, n_tokens, truncated): first ``size`` token ids, padded on ``side``.

    Truncation keeps the first ``size`` tokens (as the reference does with right
    truncation); padding goes to the right or the left.
    """
    out = token_ids(df, key, text, vocab, size, pad_id, tokenizer)
    ids, mask = _padded(F.col("ids"), F.lit(size), side, pad_id)
    return out.select(key, ids.alias("ids"), mask.alias("mask"), "n_tokens", (F.col("n_tokens") > size).alias("truncated"))


def pad_batches(df: DataFrame, ids: str = "ids", batch: str | None = "batch_id", side: str = "right",
                pad_id: int = PAD_ID, limit: int | None = None) -> DataFrame:
    """Collate: ids padded to the longest row of their batch, with ``mask`` and ``pad_len``.

    ``batch=None`` pads to the longest row of the table (one number, measured first). ``limit``
    cuts longer rows before, as a model's window does. A null list is an empty one. All other
    columns stay.
    """
    row = F.coalesce(F.col(ids), F.array().cast("array<long>"))
    df = df.withColumn(ids, row if limit is None else F.slice(row, 1, limit))
    if batch is None:
        length = F.lit(df.agg(F.max(F.size(ids))).first()[0] or 0)
    else:
        # batches are of a fixed small size, so a window over one is bounded
        length = F.max(F.size(ids)).over(Window.partitionBy(batch))
    df = df.withColumn("pad_len", length)
    padded, mask = _padded(F.col(ids), F.col("pad_len"), side, pad_id)
    return df.withColumn("mask", mask).withColumn(ids, padded)


def lm_labels(ids, mask) -> Column:
    """Training labels: the ids, with padded positions set to -100."""
    i = F.col(ids) if isinstance(ids, str) else ids
    m = F.col(mask) if isinstance(mask, str) else mask
    return F.zip_with(i, m, lambda x, y: F.when(y == 1, x).otherwise(F.lit(IGNORE_INDEX).cast("long")))


def strip_echo(output, prompt) -> Column:
    """The part of ``output`` after the echoed ``prompt``; unchanged when it does not start
    with the prompt."""
    o = F.col(output) if isinstance(output, str) else output
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.when(o.startswith(p), o.substr(F.length(p) + 1, F.length(o))).otherwise(o)


def strip_echo_ids(ids, input_len) -> Column:
    """Generated ids after the first ``input_len`` positions."""
    i = F.col(ids) if isinstance(ids, str) else ids
    n = F.col(input_len) if isinstance(input_len, str) else input_len
    return F.when(F.size(i) > n, F.slice(i, n + 1, F.size(i) - n)).otherwise(F.array().cast("array<long>"))
