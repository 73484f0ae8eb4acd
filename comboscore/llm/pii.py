"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. For each kind, all leftmost non-overlapping matches of a pattern are
found in the whole text; their places follow from the lengths of the text between them. The
patterns are written so that no position is tried twice: a match can start only where a run
of its characters starts (or where the last match ended), and repetition never backtracks, so
time is linear even in one very long run.

Base kinds, kept whenever their check holds: email; ip (parts at most 255); card (13 to 19
digits, Luhn); phone (9 to 15 digits). Every span carries a score in hundredths, 100 at most: the
kind's prior, plus ``CHECKED`` if a checksum holds, plus ``NEAR`` if a context word of the kind
stands within ``REACH`` characters before the span, less ``AGAINST`` if a word stands there that
speaks of another kind of number. Base spans stay whatever their score; spans of the added
kinds are kept with a score of ``ACCEPT`` or more:

* iban: as many characters as its country's numbers have (so a word after it is no part of it), and
  mod-97 must hold; then only a word against it, with none for it, drops it;
* national_id (3-2-4 digits) and local_phone (3-3-4 digits): need a context word, and none against.

Places are code points, ends exclusive. Defined results: a null text is empty and has no
spans; rows are independent, so repeated rows and null ids need no rule; other columns are
ignored by ``find_pii`` and passed on by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Characters of an account number by country (ISO 13616)
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """Country, two digits, then groups of four (a blank may stand before each) to the country's
    length; other countries: two groups or more."""
    def rest(n):
        return f"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = [f"(?:{names.replace(' ', '|')})[0-9]{{2}}{rest(n - 4)}" for n, names in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*known, other])})(?![A-Za-z0-9])"


ADDED = {
    "iban": _iban_pattern(),
    "national_id": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "local_phone": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])",
}
KINDS = [*BASE, *ADDED]
# a text without this character cannot hold the kind
NEEDS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-"}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo|courriel)",
    "ip": r"(?i)\b(ip|address|host|server|login|client)",
    "card": r"(?i)\b(card|visa|mastercard|credit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|anruf)",
    "iban": r"(?i)\b(iban|account|konto|compte|cuenta|bank)",
    "national_id": r"(?i)\b(ssn|social|security|insurance|identity|sozial|sécurité|seguro)",
    "local_phone": r"(?i)\b(phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono|anruf)",
}
OTHER_NUMBER = r"(?i)\b(isbn|serial|sku|tracking|checksum|version|model)"
PRIOR = {"email": 70, "ip": 40, "card": 20, "phone": 40, "iban": 20, "national_id": 30, "local_phone": 30}
CHECKED, NEAR, AGAINST, REACH, ACCEPT = 50, 30, 20, 40, 60
CHECKSUMS = ("card", "iban")
SPAN = "array<struct<start:int,end:int,value:string>>"


def _matches(text: Column, kind: str) -> Column:
    found = F.regexp_extract_all(text, F.lit({**BASE, **ADDED}[kind]), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(text.contains(NEEDS[kind]), found).otherwise(none) if kind in NEEDS else found


def _places(text: Column, matches: Column, kind: str) -> Column:
    """Start, end and text of every match."""
    between = F.split(text, {**BASE, **ADDED}[kind], -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches,
                       lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))
    return F.when(F.size(matches) > 0, F.aggregate(steps, empty, step, lambda acc: acc["spans"])).otherwise(F.array().cast(SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    return F.call_function("luhn_check", _digits(value))


def mod97(value: Column) -> Column:
    """ISO 7064 check of an account number: first four characters last, letters as 10..35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def step(acc, ch):
        letter = ch >= "A"
        number = F.when(letter, F.ascii(ch) - 55).otherwise(F.ascii(ch) - 48)
        return (acc * F.when(letter, 100).otherwise(10) + number) % 97
    return F.aggregate(F.split(turned, "(?!^)(?!$)"), F.lit(0), step) == 1


def _base_check(kind: str, x: Column) -> Column:
    value = x["value"]
    if kind == "ip":
        part = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return value.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _score(text: Column, kind: str, x: Column) -> Column:
    """Hundredths; the checksum of a base kind holds by then, that of an account number is tried here."""
    before = F.substring(text, F.greatest(x["start"] - REACH + 1, F.lit(1)), F.least(x["start"], F.lit(REACH)))
    score = (F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]), NEAR).otherwise(0)
             - F.when(before.rlike(OTHER_NUMBER), AGAINST).otherwise(0))
    if kind in CHECKSUMS:
        score = score + (F.when(mod97(x["value"]), CHECKED).otherwise(0) if kind == "iban" else CHECKED)
    return F.least(score, F.lit(100))


def with_spans(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """Add one array column per kind (``prefix`` + kind) of confirmed spans: start, end, value, score."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.withColumns({f"{prefix}{k}": _matches(text, k) for k in KINDS})
    docs = docs.withColumns({f"{prefix}{k}": _places(text, F.col(f"{prefix}{k}"), k) for k in KINDS})

    def scored(kind):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"),
                                  _score(text, kind, x).alias("score"))

    def confirmed(kind):
        spans = F.col(f"{prefix}{kind}")
        if kind in BASE:
            return F.transform(F.filter(spans, lambda x: _base_check(kind, x)), scored(kind))
        return F.filter(F.transform(spans, scored(kind)), lambda x: x["score"] >= ACCEPT)
    return docs.withColumns({f"{prefix}{k}": confirmed(k) for k in KINDS})


def _listed(kinds, prefix: str) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    def named(kind):
        return lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.concat(*(F.transform(F.col(f"{prefix}{k}"), named(k)) for k in kinds)), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a count per base kind, base_spans, spans, scores (those of
    ``spans``, in its order, joined by commas)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = with_spans(rows)
    return rows.select("doc_id", *(F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE),
                       _listed(BASE, "pii_").alias("base_spans"), _listed(KINDS, "pii_").alias("spans"),
                       F.array_join(F.concat(*(F.transform(F.col(f"pii_{k}"), lambda x: x["score"].cast("string"))
                                               for k in KINDS)), ",").alias("scores"))


def redact(docs: DataFrame, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """Replace every span by its kind in brackets; overlapping spans become one (the first one's kind).

    All columns stay; only ``text_col`` changes. ``prefix`` names helper columns and must not
    begin one of the input's own names.
    """
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    columns = docs.columns
    text = F.col(f"`{text_col}`")
    rows = with_spans(docs, text_col, prefix)

    def place(kind):
        return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    every = F.concat(*(F.transform(F.col(f"{prefix}{k}"), place(k)) for k in KINDS))
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))
    rows = rows.withColumn(f"{prefix}all", F.array_sort(every))
    new = F.aggregate(F.col(f"{prefix}all"), empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = rows.withColumn(text_col, F.when(F.size(f"{prefix}all") > 0, new).otherwise(text))
    return rows.select(*(F.col(f"`{c}`") for c in columns))
