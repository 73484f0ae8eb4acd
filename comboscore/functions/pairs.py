"""Column functions for unordered pairs and id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split() whitespace set, written as one Java regex class.
WS_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pair_key(a, b) -> tuple[Column, Column]:
    """Unordered pair key (smaller id, larger id)."""
    a, b = _col(a), _col(b)
    return F.least(a, b), F.greatest(a, b)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind (also no-break
    spaces and the separators 0x1C-0x1F, which ``\\s`` leaves)."""
    return F.regexp_replace(_col(c), rf"\A{WS_CLASS}+|{WS_CLASS}+\z", "")


def parse_ids(c, sep: str = ",") -> Column:
    """``"a, b, c"`` -> ``array<int>``: split on ``sep``, strip, cast."""
    return F.transform(F.split(_col(c), sep), lambda x: strip_ws(x).cast("int"))


def join_ids(c, sep: str = ", ") -> Column:
    """``array<int>`` -> ``"a, b, c"``."""
    return F.array_join(_col(c).cast("array<string>"), sep)


def index_pairs(arr) -> Column:
    """All (i, j, a, b) with i < j in list order, as an array of structs.

    Use with ``F.inline`` — one row per pair, computed inside the row (no shuffle).
    Lists shorter than two give null, which ``inline`` turns into no rows.
    """
    arr = _col(arr)
    n = F.size(arr)
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.transform(
            F.sequence(i + 1, n - 1),
            lambda j: F.struct(i.alias("i"), j.alias("j"),
                               F.element_at(arr, i + 1).alias("a"),
                               F.element_at(arr, j + 1).alias("b")))))
    return F.when(n >= 2, pairs)
