"""Token ids of a public byte-level BPE vocabulary, many documents at a time.

The vocabulary's split pattern never joins text across certain places: before a white-space
character that a visible one follows, and between an ASCII letter and ASCII punctuation. Texts
are cut there, each distinct piece is encoded once per worker and kept by its hash, and the
documents' ids are gathered from the kept pieces with numpy. The vocabulary's added tokens (such
as ``<|endoftext|>``) are pieces of their own wherever a text holds them, with their own ids. The
result is what encoding the whole text gives (tests compare it with the ``tokenizers`` form of
the same vocabulary).
"""

from __future__ import annotations

import base64
import json
import os
import re

import numpy as np

from comboscore.llm import columnar as C

KEEP = 1 << 20                       # pieces a worker remembers before it starts anew
_WHITE = ~C.SPACE_WORDS
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[0x21:0x7F] = True
_PUNCT[0x30:0x3A] = _PUNCT[0x41:0x5B] = _PUNCT[0x61:0x7B] = False
# bytes that may begin a white-space character beyond ASCII
_MAYBE_WHITE = _WHITE.copy()
_MAYBE_WHITE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def load(path: str | None = None):
    """The vocabulary at ``path`` (ranks, one token a line); default: the installed 50k one."""
    import public_tokenizers
    import tiktoken
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str | None = None) -> dict[bytes, int]:
    """The added tokens of the JSON form that lies beside the ranks at ``path`` (none without it)."""
    import public_tokenizers
    path = os.path.splitext(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in found if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take in or look at their neighbours: {odd}")
    return {t["content"].encode(): t["id"] for t in found}


class Encoder:
    def __init__(self, path: str | None = None):
        self.bpe = load(path)
        self.added = added_tokens(path)
        longest = sorted(self.added, key=len, reverse=True)
        self.any_added = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.clear()

    def find_added(self, raw: bytes, offsets):
        """(begins, ends) of the added tokens in the documents; none goes from one into the next."""
        begins, ends = [], []
        if self.any_added and self.any_added.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for m in self.any_added.finditer(raw, a, b):
                    begins.append(m.start())
                    ends.append(m.end())
        return np.array(begins, np.int64), np.array(ends, np.int64)

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, keys, pieces):
        """Encode pieces that are not known yet."""
        coded = [[self.added[p]] if p in self.added else self.bpe.encode_ordinary(p.decode("utf-8")) for p in pieces]
        size = np.array([len(c) for c in coded], np.int64)
        flat = np.fromiter((i for c in coded for i in c), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size + len(self.ids)
        self.ids = np.concatenate([self.ids, flat])
        keys = np.concatenate([self.keys, keys])
        by = np.argsort(keys)
        self.keys, self.begin, self.size = (x[by] for x in (keys, np.concatenate([self.begin, begin]),
                                                            np.concatenate([self.size, size])))

    def encode(self, offsets, data, end: int | None = None):
        """(ids of all documents one after the other, ids per document); ``end`` closes each one."""
        docs = len(offsets) - 1
        n = len(data)
        if len(self.keys) > KEEP:
            self.clear()
        raw = data.tobytes()
        begins, stops = self.find_added(raw, offsets)
        cut = np.zeros(n + 1, bool)
        if n > 1:
            cut[:n - 1] = _WHITE[data[:-1]] & ~_MAYBE_WHITE[data[1:]]
            # no visible character follows white space that ends a stretch
            last = np.concatenate([offsets, begins]) - 1
            cut[last[last >= 0]] = False
            cut[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        cut[C.ranges(begins, stops - begins)] = False
        cut[offsets] = cut[begins] = cut[stops] = True
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)
        keys = C.span_hashes(data, starts, ends)
        kinds, first, which = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != kinds[inside]
        if new.any():
            self.learn(kinds[new], [raw[starts[i]:ends[i]] for i in first[new]])
            at = np.searchsorted(self.keys, kinds)
        at = at[which]
        size = self.size[at]
        ids = self.ids[C.ranges(self.begin[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        bounds = upto[np.searchsorted(starts, offsets)]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(docs + 1)
        return ids, np.diff(bounds)
