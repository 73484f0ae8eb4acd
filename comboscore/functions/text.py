"""String column functions: prompt rendering, label words, typo injection, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comboscore.functions.pairs import WS_CLASS, strip_ws

# Fixed values that results depend on (prompt wording, markers, label keywords).
NAMES_MARKER = "The drug combination to analyze is:"
LOEWE_RULE = (". According to the rule, if Loewe > 0.1, the outcome is Antagonistic; "
              "if Loewe < -0.1, it is Synergistic; otherwise, it is Additive. "
              "Decide if the combination is synergistic, antagonistic, or additive.")
CONTEXT_PREFIX = "Context: "
SCORE_SENTENCE_MIDDLE = " have a Loewe score of: "
PROMPT_TAG = "<PROMPT> "
PREDICTION_TAG = " <PREDICTION> "
KEYWORDS = ("antagonistic", "synergistic", "additive")   # first match wins, in this order
NO_PRED = "no_pred"
LABEL_INDEX = {"Additive": 0, "Synergistic": 1, "Antagonistic": 2}
NAMES_PATTERN = r"The drug combination to analyze is: ([^.]+)\."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- prompts

def score_sentence(name_a, name_b, score_text) -> Column:
    """``"{A} and {B} have a Loewe score of: {text}."``"""
    return F.concat(_col(name_a), F.lit(" and "), _col(name_b), F.lit(SCORE_SENTENCE_MIDDLE),
                    _col(score_text), F.lit("."))


def render_prompt(context, names, rule: str = LOEWE_RULE) -> Column:
    """context, two blanks, the names line, a blank, then the rule text."""
    return F.concat(_col(context), F.lit("  "), F.lit(NAMES_MARKER + " "), _col(names), F.lit(" "),
                    F.lit(rule))


def train_text(prompt, prediction) -> Column:
    """``"<PROMPT> " + prompt + " <PREDICTION> " + prediction``; NULL if either is NULL."""
    return F.concat(F.lit(PROMPT_TAG), _col(prompt), F.lit(PREDICTION_TAG), _col(prediction))


def instruct_text(prompt, context, prediction, reasoning) -> Column:
    """Four-section instruction template."""
    return F.format_string("### Prompt: %s\n  ### Context: %s\n  ### Prediction: %s\n  ### Reasoning: %s",
                           _col(prompt), _col(context), _col(prediction), _col(reasoning))


def extract_names(prompt) -> Column:
    """First group of the names pattern, ``''`` when absent."""
    return F.regexp_extract(_col(prompt), NAMES_PATTERN, 1)


def decimal_text(c, places: int = 4) -> Column:
    """Shortest decimal text of a value rounded to ``places`` (``0.1``, ``-0.0422``, ``2.0``).

    Built from integers so every engine prints the same digits (a plain cast can give
    ``1.0E-4``).
    """
    scale = 10 ** places
    v = F.round(_col(c) * scale).cast("long")
    a = F.abs(v)
    frac = F.regexp_replace(F.lpad((a % scale).cast("string"), places, "0"), "0+$", "")
    return F.concat(F.when(v < 0, "-").otherwise(""), (a / scale).cast("long").cast("string"), F.lit("."),
                    F.when(frac == "", "0").otherwise(frac))


# ---------------------------------------------------------------- labels

def keyword_label(text, words=KEYWORDS, default: str = NO_PRED) -> Column:
    """Lower-case the text; the first keyword it contains, else ``default`` (NULL -> default)."""
    t = F.lower(_col(text))
    out = None
    for w in words:
        cond = F.coalesce(t.contains(w), F.lit(False))
        out = F.when(cond, w) if out is None else out.when(cond, w)
    return out.otherwise(default)


def label_index(label, mapping: dict | None = None) -> Column:
    """Label -> integer index, unknown -> NULL."""
    mapping = mapping or LABEL_INDEX
    out = None
    for k, v in mapping.items():
        cond = _col(label) == k
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out


def strip_first_line(text) -> Column:
    """Text after the first newline; unchanged when there is none."""
    t = _col(text)
    pos = F.instr(t, "\n")
    return F.when(pos > 0, t.substr(pos + 1, F.length(t))).otherwise(t)


# ---------------------------------------------------------------- typos

def swap_middle(word) -> Column:
    """Swap the two middle characters: even length -> (mid-1, mid), odd -> (mid, mid+1)."""
    w = _col(word)
    n = F.length(w)
    mid = F.floor(n / 2).cast("int")
    # 1-based position of the first character of the swapped pair
    p = F.when(n % 2 == 0, mid).otherwise(mid + 1)
    swapped = F.concat(w.substr(F.lit(1), p - 1),
                       w.substr(p + 1, F.lit(1)), w.substr(p, F.lit(1)), w.substr(p + 2, n))
    return F.when(n > 1, swapped).otherwise(w)


def drop_last(word) -> Column:
    """Remove the last character; the empty string stays empty."""
    w = _col(word)
    return w.substr(F.lit(1), F.greatest(F.length(w) - 1, F.lit(0)))


def perturb_names(prompt, use_swap, marker: str = NAMES_MARKER) -> Column:
    """Corrupt every name between the marker and the next ``.`` with one typo rule.

    ``use_swap`` (boolean column) picks ``swap_middle`` for the whole row, else ``drop_last``.
    Text before the marker is kept; text after a second marker is dropped; rows
    without the marker are returned unchanged.
    """
    p = _col(prompt)
    parts = F.split(p, _regex_quote(marker), -1)
    before = F.element_at(parts, 1)
    after = F.element_at(parts, 2)
    pieces = F.split(after, r"\.", -1)
    names = F.split(F.element_at(pieces, 1), ",", -1)
    stripped = F.transform(names, lambda x: strip_ws(x))
    fixed = F.when(use_swap, F.transform(stripped, swap_middle)).otherwise(F.transform(stripped, drop_last))
    rest = F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), ".")
    rest = F.when(F.size(pieces) > 1, rest).otherwise(F.lit(""))
    new = F.concat(before, F.lit(marker + " "), F.array_join(fixed, ", "), F.lit("."), rest)
    return F.when(p.contains(marker), new).otherwise(p)


def _regex_quote(s: str) -> str:
    return "\\Q" + s + "\\E"


# ---------------------------------------------------------------- tokens

def ws_tokens(text) -> Column:
    """``str.split()``: split on whitespace runs, no empty tokens. In printable ASCII only the blank is
    whitespace, and a split at one character needs no pattern."""
    t = _col(text)
    plain = ~t.rlike(r"[^\x20-\x7e]")
    return F.array_remove(F.split(F.when(plain, t).otherwise(F.regexp_replace(t, WS_CLASS + "+", " ")), " ", -1), "")


def rouge_tokens(text) -> Column:
    """Lower-case, every run of characters outside ``[a-z0-9]`` is a separator."""
    return F.filter(F.split(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", " "), " ", -1),
                    lambda x: x != "")


def sentence_split(text) -> Column:
    """``str.split('.')``: keeps empty pieces, including the one after a final dot."""
    return F.split(_col(text), r"\.", -1)


def sentences_of(columns) -> Column:
    """Sentences of several text columns: array of (col, pos, sentence), by column, then place.

    ``col`` is the column's number in ``columns``. A NULL text has no sentences.
    """
    def numbered(k, c):
        return F.transform(sentence_split(c), lambda s, i: F.struct(F.lit(k).alias("col"), i.alias("pos"), s.alias("sentence")))
    none = F.array().cast("array<struct<col:int,pos:int,sentence:string>>")
    return F.concat(*(F.coalesce(numbered(k, c), none) for k, c in enumerate(columns)))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of a token array (empty when shorter than n)."""
    def of(t):
        k = F.size(t) - n + 1
        grams = F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(k >= 1, grams).otherwise(F.array().cast("array<string>"))
    # bound first: the tokens may be an expression, which the inner lambda would compute for every gram
    return F.transform(F.array(_col(tokens)), of)[0]
