"""Brute-force versions of the operators' contracts, for small inputs."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def word_dedup(rows, n):
    first = {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        for k in range(len(w) - n + 1):
            x = tuple(w[k:k + n])
            if i is not None and i < first.get(x, i + 1):
                first[x] = i
    out = []
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def byte_dedup(rows, n):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k:k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if seen[b[k:k + n]] > 1:
                gone[k:k + n] = b"\1" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def hits(rows, items, n):
    phrases = collections.defaultdict(set)
    for i, t in items:
        w = TERMS.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            phrases[tuple(w[k:k + n])].add("" if i is None else str(i))
    sizes = {len(p) for p in phrases}
    out = []
    for i, t in rows:
        w = TERMS.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if (x := phrases.get(tuple(w[k:k + size]))) is not None:
                    hit[k:k + size] = [True] * size
                    found |= x
        out.append((i, len(w), sum(hit), tuple(sorted(found))))
    return out


def near(rows, items, n, slack):
    """Items with a phrase all of whose words, repeated ones included, are in one span of its length plus slack."""
    phrases = set()
    for i, t in items:
        w = TERMS.findall((t or "").translate(LOWER))
        phrases |= {("" if i is None else str(i), tuple(w[k:k + n])) for k in range(max(1, len(w) - n + 1) if w else 0)}
    out = []
    for i, t in rows:
        w = TERMS.findall((t or "").translate(LOWER))
        found = {x for x, p in phrases if set(p) <= set(w) and any(collections.Counter(p) <= collections.Counter(w[k:k + len(p) + slack]) for k in range(len(w)))}
        out.append((i, tuple(sorted(found))))
    return out


def counts(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    again = [False] * len(w)
    for k in range(len(w) - 2):
        if grams[tuple(w[k:k + 3])] > 1:
            again[k:k + 3] = [True] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(again)


def chi2(x, dof):
    """Distribution function of chi-squared by the sum over a fine grid."""
    t = (np.arange(20_000) + 0.5) * (x / 20_000)
    return float((t ** (dof / 2 - 1) * np.exp(-t / 2)).sum() * (x / 20_000) / (2 ** (dof / 2) * math.gamma(dof / 2)))


@functools.cache
def consistency(share):
    if share >= 1 - 1e-9:
        return 1.0
    low, high = 0.0, 100.0
    while high - low > 1e-7:
        mid = (low + high) / 2
        low, high = (mid, high) if chi2(mid, 5) < share else (low, mid)
    return share / chi2(high, 7)


def far(x, centre, scatter):
    d = x - centre
    return np.maximum(np.einsum("ni,ij,nj->n", d, np.linalg.inv(scatter), d), 1e-9)


def mcd(x, floor, near):
    """Centre and scatter of the rows of ``x``: three starts, half of the rows as the core, one reweighting."""
    n, p = x.shape
    middle = lambda v: np.sort(v, axis=0)[math.ceil(n / 2) - 1]
    med = middle(x)
    scale = np.sqrt((1.4826 * middle(np.abs(x - med))) ** 2 + floor ** 2)
    z = (x - med) / scale
    signs = z / np.sqrt(np.maximum((z * z).sum(1, keepdims=True), 1e-12))
    best = None
    for start in (np.eye(p), p * signs.T @ signs / n, np.tanh(z).T @ np.tanh(z) / n):
        centre, scatter, before = med, np.diag(scale) @ (start + 0.01 * np.eye(p)) @ np.diag(scale), math.inf
        while True:
            b = np.floor(np.log(far(x, centre, scatter)) * 16)
            last = np.sort(b)[math.ceil(n / 2) - 1]
            core = x[b <= last]
            centre = core.mean(0)
            scatter = np.cov(core.T, bias=True) * consistency(len(core) / n) + np.diag(floor ** 2)
            logdet = np.linalg.slogdet(scatter)[1]
            if best is None or logdet < best[0]:
                best = logdet, centre, scatter
            if not logdet < before - 1e-3:
                break
            before = logdet
    core = x[far(x, best[1], best[2]) <= near]
    return core.mean(0), np.cov(core.T, bias=True) * consistency(0.975) + np.diag(floor ** 2)


def distances(groups, x, floor, near, prior):
    """Squared distance of every row of ``x``; ``groups``: its (language, source)."""
    out = np.zeros(len(x))
    for lang, source in sorted(set(groups)):
        centre = scatter = None
        for inside in (lambda a, b: True, lambda a, b: a == lang, lambda a, b: (a, b) == (lang, source)):
            part = x[[inside(a, b) for a, b in groups]]
            c, s = mcd(part, floor, near)
            w = len(part) / (len(part) + prior) if centre is not None else 1
            centre, scatter = (c, s) if centre is None else (w * c + (1 - w) * centre, w * s + (1 - w) * scatter)
        here = np.array([g == (lang, source) for g in groups])
        out[here] = far(x[here], centre, scatter)
    return out


def classes(rows, n=5):
    sets = []
    for _, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def pieces_hold(pieces, documents, size):
    """Every id once, offsets without gaps, checksums right."""
    at = collections.defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == at[p.sequence_id]
        at[p.sequence_id] += p.length
    assert all(v <= size for v in at.values())
    for doc, ids in documents.items():
        place = 0
        for p in sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start):
            assert p.start == place and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[place:place + p.length], "<u4").tobytes())
            place += p.length
        assert place == len(ids)


def trie(rows):
    """Rows conv_id, turn, role, text -> the nodes' columns."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        new[c] = tuple(own.get(leader, [])[:h] + own[c][h:])
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in new.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in children[p])
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
             sha(",".join(map(str, sorted(c for c in m if len(new[c]) == len(p)))))) for p, m in members.items()]


def secrets(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(f"({r.head})(?:{r.body})", text or ""):
            if m.end() - m.end(1) >= r.least:
                out.append((m.start(), k, m.end()))
    return [(rules[k].kind, s, e, rules[k].base) for s, k, e in sorted(out)]


def phrases(rows, least, longest, top):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in count.items():
        found = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        inside = {p[i:j] for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and 100 * a >= 100 * found[p[i:j]]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return out
