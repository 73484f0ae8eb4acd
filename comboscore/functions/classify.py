"""Threshold classifiers and the pair vote (F4-F9) as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: label words, score cut-offs and sentence wording.
SYNERGISTIC = "Synergistic"
ANTAGONISTIC = "Antagonistic"
ADDITIVE = "Additive"
HIGHLY_SYNERGISTIC = "Highly Synergistic"
HIGHLY_ANTAGONISTIC = "Highly Antagonistic"
SCORE_CUT = 0.1          # bliss / loewe / hsa: strictly above or below +-0.1
ZIP_HIGH = 15.0          # zip beyond +-15 is "highly"
ZIP_FLAG = -1.0          # zip below -1 marks the combination antagonistic
SENTENCE_TEMPLATE = "{a} and {b} are {word}. "


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN -> NULL so that every threshold test is false, as with pandas NaN."""
    c = _col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def classify(c, cut: float = SCORE_CUT, invert: bool = False) -> Column:
    """> cut -> Synergistic, < -cut -> Antagonistic, else Additive (NULL -> Additive).

    ``invert=True`` swaps the two outer labels (the Loewe convention).
    """
    c = _col(c)
    above, below = (ANTAGONISTIC, SYNERGISTIC) if invert else (SYNERGISTIC, ANTAGONISTIC)
    return F.when(c > cut, above).when(c < -cut, below).otherwise(ADDITIVE)


def classify_bliss(c) -> Column:
    return classify(c)


def classify_hsa(c) -> Column:
    return classify(c)


def classify_loewe(c) -> Column:
    return classify(c, invert=True)


def classify_zip(c, high: float = ZIP_HIGH) -> Column:
    """Five-way zip label, tested in this order: >high, <-high, >0, <0, else Additive."""
    c = _col(c)
    return (F.when(c > high, HIGHLY_SYNERGISTIC)
            .when(c < -high, HIGHLY_ANTAGONISTIC)
            .when(c > 0, SYNERGISTIC)
            .when(c < 0, ANTAGONISTIC)
            .otherwise(ADDITIVE))


def antagonism_flag(zip_col, flag: float = ZIP_FLAG) -> Column:
    """True when this pair sets the combination's antagonism flag (zip below -1)."""
    return F.coalesce(_col(zip_col) < flag, F.lit(False))


def _count_of(label: str, *labels: Column) -> Column:
    total = F.lit(0)
    for lab in labels:
        total = total + (lab == label).cast("int")
    return total


def pair_vote(bliss, loewe, hsa, zip_col, sticky, high: float = ZIP_HIGH) -> tuple[Column, Column]:
    """Pair label and the word used in its sentence.

    Order: zip > high -> Synergistic ("highly synergistic"); zip < -high -> Antagonistic
    ("highly antagonistic"); two or more Antagonistic among bliss/loewe/hsa, or the sticky
    flag -> Antagonistic; two or more Synergistic -> Synergistic; two or more Additive ->
    Additive; otherwise the Loewe label, whose sentence keeps the capital letter.
    """
    z = _col(zip_col)
    b, lw, h = classify_bliss(bliss), classify_loewe(loewe), classify_hsa(hsa)
    n_ant = _count_of(ANTAGONISTIC, b, lw, h)
    n_syn = _count_of(SYNERGISTIC, b, lw, h)
    n_add = _count_of(ADDITIVE, b, lw, h)
    cases = [
        (z > high, SYNERGISTIC, "highly synergistic"),
        (z < -high, ANTAGONISTIC, "highly antagonistic"),
        ((n_ant > 1) | _col(sticky), ANTAGONISTIC, "antagonistic"),
        (n_syn > 1, SYNERGISTIC, "synergistic"),
        (n_add > 1, ADDITIVE, "additive"),
    ]
    label = word = None
    for cond, lab, wd in cases:
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
        word = F.when(cond, wd) if word is None else word.when(cond, wd)
    return label.otherwise(lw), word.otherwise(lw)


def pair_sentence(name_a, name_b, word) -> Column:
    """``"{A} and {B} are {word}. "`` (trailing blank kept)."""
    return F.concat(_col(name_a), F.lit(" and "), _col(name_b), F.lit(" are "), _col(word), F.lit(". "))
