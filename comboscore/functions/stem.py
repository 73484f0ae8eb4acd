"""Porter suffix-stripping stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980),
in the variant the common Python toolkits ship as their default mode.

Departures from the 1980 paper in that variant: a small table of irregular forms; words of
one or two letters are returned as they are; "ies"/"ied" on four-letter words keep "ie";
y -> i only after a consonant that is not the first letter; step 2 uses "bli" -> "ble",
handles "alli" first and adds "fulli" -> "ful" and "logi" -> "log"; a two-letter
vowel-consonant stem counts as consonant-vowel-consonant.

Used per token inside the ROUGE UDF (tokens longer than three characters only), behind a
cache, so each distinct token is stemmed once per Python worker.
"""

from __future__ import annotations

from functools import lru_cache

# Irregular forms mapped directly to their stems.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
VOWELS = "aeiou"


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(s: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_vowel = 0, False
    for i in range(len(s)):
        v = not _cons(s, i)
        if prev_vowel and not v:
            m += 1
        prev_vowel = v
    return m


def _has_vowel(s: str) -> bool:
    return any(not _cons(s, i) for i in range(len(s)))


def _double_cons(s: str) -> bool:
    return len(s) >= 2 and s[-1] == s[-2] and _cons(s, len(s) - 1)


def _cvc(s: str) -> bool:
    if len(s) >= 3 and _cons(s, len(s) - 3) and not _cons(s, len(s) - 2) and _cons(s, len(s) - 1):
        return s[-1] not in "wxy"
    return len(s) == 2 and not _cons(s, 0) and _cons(s, 1)


def _rules(w: str, rules) -> str:
    """First rule whose suffix matches decides; its condition (on the stem) may veto."""
    for suf, rep, cond in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond is None or cond(stem) else w
    return w


def _m_gt(k):
    return lambda s: _measure(s) > k


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-3] + "ie"
    return _rules(w, [("sses", "ss", None), ("ies", "i", None), ("ss", "ss", None), ("s", "", None)])


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-3] + ("ie" if len(w) == 4 else "i")
    if w.endswith("eed"):
        stem = w[:-3]
        return stem + "ee" if _measure(stem) > 0 else w
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[: len(w) - len(suf)]):
            s = w[: len(w) - len(suf)]
            break
    else:
        return w
    for suf, rep in (("at", "ate"), ("bl", "ble"), ("iz", "ize")):
        if s.endswith(suf):
            return s[: len(s) - len(suf)] + rep
    if _double_cons(s):
        return s[:-1] if s[-1] not in "lsz" else s
    if _measure(s) == 1 and _cvc(s):
        return s + "e"
    return s


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
          ("fulli", "ful")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""),
          ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
          "ism", "ate", "iti", "ous", "ive", "ize"]


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    rules = [(s, r, _m_gt(0)) for s, r in _STEP2]
    rules.append(("logi", "log", lambda stem: _measure(w[:-3]) > 0))
    return _rules(w, rules)


def _step3(w: str) -> str:
    return _rules(w, [(s, r, _m_gt(0)) for s, r in _STEP3])


def _step4(w: str) -> str:
    rules = []
    for s in _STEP4:
        if s == "ion":
            rules.append((s, "", lambda stem: _measure(stem) > 1 and len(stem) > 0 and stem[-1] in "st"))
        else:
            rules.append((s, "", _m_gt(1)))
    return _rules(w, rules)


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_step1a, _step1b, _step1c, _step2, _step3, _step4, _step5):
        w = step(w)
    return w
