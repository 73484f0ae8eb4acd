"""Regular expressions as deterministic automata over bytes.

``compile_rules`` turns several expressions into one automaton: each expression becomes a small
nondeterministic one, subset construction follows all of them at once from every place of a
text, and partition refinement merges states that behave alike. A state tells which rules have
just matched and which rules are under way. ``anchored`` builds the automaton of one expression
that starts at a given place. ``scan`` runs an automaton over a buffer of many texts, one table
look-up a byte.

Expressions are ASCII: characters, ``\\xHH`` and other escapes, classes with ranges, groups,
``(?i:...)`` (letters in either case), ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
A match is the longest one from the leftmost start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

STATES = 60_000          # more states than this are an error, not a slow scan
LANE = 512               # bytes of a lane; lanes are scanned side by side
BLOCK = 1 << 20          # bytes whose lanes are held at a time
END = 0xFF               # stands between texts (never a byte of UTF-8) and resets the automaton


class Syntax(ValueError):
    """An expression outside the supported form."""


class _Parser:
    """Expression -> tree of ("set", mask), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or expected and c != expected:
            raise Syntax(f"{self.text!r}: {expected or 'a character'} expected at {self.at}")
        self.at += 1
        return c

    def whole(self):
        tree = self.choice(False)
        if self.at < len(self.text):
            raise Syntax(f"{self.text!r}: unexpected {self.peek()!r} at {self.at}")
        return tree

    def choice(self, fold: bool):
        parts = [self.sequence(fold)]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence(fold))
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self, fold: bool):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom(fold)))
        return ("cat", parts)

    def repeated(self, part):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                close = self.text.find("}", self.at)
                if close < 0:
                    raise Syntax(f"{self.text!r}: a count is never closed")
                first, comma, second = self.text[self.at:close].partition(",")
                low = int(first)
                high = (int(second) if second else None) if comma else low
                self.at = close + 1
            part = ("rep", part, low, high)
        return part

    def atom(self, fold: bool):
        c = self.take()
        if c == "(":
            if self.text.startswith("?i:", self.at):
                self.at += 3
                fold = True
            elif self.peek() == "?":
                raise Syntax(f"{self.text!r}: unknown group at {self.at}")
            tree = self.choice(fold)
            self.take(")")
            return tree
        if c == "[":
            mask = 0
            while self.peek() != "]":
                low = self.code(self.take())
                high = low
                if self.peek() == "-" and self.text[self.at + 1:self.at + 2] not in ("]", ""):
                    self.take()
                    high = self.code(self.take())
                for b in range(low, high + 1):
                    mask |= 1 << b
            self.take("]")
        elif c in "*+?{.^$":
            raise Syntax(f"{self.text!r}: unexpected {c!r}")
        else:
            mask = 1 << self.code(c)
        return ("set", _both_cases(mask) if fold else mask)

    def code(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            if c == "x":
                return int(self.take() + self.take(), 16)
            if c.isalnum():
                raise Syntax(f"{self.text!r}: unknown escape {c!r}")
        if ord(c) > 127:
            raise Syntax(f"{self.text!r}: not ASCII")
        return ord(c)


def _both_cases(mask: int) -> int:
    for b in range(0x41, 0x5B):
        if mask >> b & 1 or mask >> (b + 32) & 1:
            mask |= 1 << b | 1 << (b + 32)
    return mask


class _Threads:
    """Nondeterministic automaton of all rules: free moves, moves by byte sets, owners, last states."""

    def __init__(self, patterns):
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []
        self.owner: list[int] = []
        self.first, self.last = [], []
        for k, pattern in enumerate(patterns):
            self.rule = k
            self.first.append(self.new())
            self.last.append(self.build(_Parser(pattern).whole(), self.first[-1]))

    def new(self) -> int:
        self.free.append([])
        self.moves.append([])
        self.owner.append(self.rule)
        return len(self.free) - 1

    def build(self, tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.new()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.new()
            for part in tree[1]:
                begin = self.new()
                self.free[start].append(begin)
                self.free[self.build(part, begin)].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.build(part, start)
        end = self.new()
        if high is None:
            loop = self.new()
            self.free[start].append(loop)
            self.free[self.build(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(high - low):
            self.free[start].append(end)
            begin = self.new()
            self.free[start].append(begin)
            start = self.build(part, begin)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """``table[state, kind]`` is the next state, ``kinds[byte]`` a byte's kind.

    ``matched`` and ``alive`` hold, for every state, a bit for each rule that ends here and for
    each rule that is under way. State 0 is the start; an anchored automaton's ``dead`` state has
    no way on.
    """

    def __init__(self, table, kinds, matched, alive, dead):
        self.table, self.kinds, self.matched, self.alive, self.dead = table, kinds, matched, alive, dead

    def __len__(self):
        return len(self.table)

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """End of the longest match that starts at ``start`` (-1: none)."""
        rows, kinds, matched = self._lists()
        state, end = 0, -1
        for j in range(start, stop):
            state = rows[state][kinds[data[j]]]
            if state == self.dead:
                break
            if matched[state]:
                end = j + 1
        return end

    def _lists(self):
        if not hasattr(self, "_kept"):
            self._kept = self.table.tolist(), self.kinds.tolist(), self.matched.tolist()
        return self._kept


def _kinds(threads: _Threads) -> tuple[np.ndarray, list[int]]:
    """Bytes that no rule tells apart are of one kind; ``END`` is a kind of its own, the last."""
    masks = sorted({m for moves in threads.moves for m, _ in moves})
    found: dict[tuple, int] = {}
    kinds = np.zeros(256, np.intp)
    example = []
    for b in range(256):
        key = tuple(m >> b & 1 for m in masks)
        if key not in found:
            found[key] = len(found)
            example.append(b)
        kinds[b] = found[key]
    kinds[END] = len(found)
    return kinds, example


def _determinise(threads: _Threads, anywhere: bool) -> Automaton:
    """Subset construction. ``anywhere``: a match may begin at every byte."""
    kinds, example = _kinds(threads)
    entry = threads.closure(threads.first)
    start = frozenset() if anywhere else entry
    number, order, rows = {start: 0}, [start], []
    while len(rows) < len(order):
        states = order[len(rows)] | entry if anywhere else order[len(rows)]
        row = []
        for b in example:
            to = threads.closure({t for s in states for m, t in threads.moves[s] if m >> b & 1})
            if to not in number:
                if len(number) >= STATES:
                    raise Syntax(f"the rules need more than {STATES} states")
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append([*row, 0])
    bits = np.zeros((2, len(order)), np.int64)
    for i, states in enumerate(order):
        for k, last in enumerate(threads.last):
            bits[0, i] |= (last in states) << k
        for s in states:
            bits[1, i] |= 1 << threads.owner[s]
    return Automaton(np.array(rows, np.intp), kinds, bits[0], bits[1], number.get(frozenset(), -1) if not anywhere else -1)


def _minimise(a: Automaton) -> Automaton:
    """Merge states that no input tells apart, by refining the partition of equal marks."""
    _, part = np.unique(np.stack([a.matched, a.alive], 1), axis=0, return_inverse=True)
    part = part.ravel()
    while True:
        _, finer = np.unique(np.column_stack([part, part[a.table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == part.max():
            break
        part = finer
    # the start becomes state 0 again
    _, chosen = np.unique(part, return_index=True)
    rank = np.empty(len(chosen), np.intp)
    rank[np.argsort(chosen)] = np.arange(len(chosen))
    chosen = np.sort(chosen)
    part = rank[part]
    return Automaton(part[a.table[chosen]], a.kinds, a.matched[chosen], a.alive[chosen], int(part[a.dead]) if a.dead >= 0 else -1)


def compile_rules(patterns: list[str]) -> Automaton:
    """One automaton that follows all patterns from every place of a text."""
    return _minimise(_determinise(_Threads(patterns), True))


def anchored(pattern: str) -> Automaton:
    """The automaton of one pattern from a fixed place."""
    return _minimise(_determinise(_Threads([pattern]), False))


def scan(a: Automaton, data: np.ndarray) -> np.ndarray:
    """State after every byte of ``data`` (texts with ``END`` between them), as 16-bit numbers."""
    out = np.empty(len(data), np.uint16)
    state = 0
    for i in range(0, len(data), BLOCK):
        out[i:i + BLOCK] = _scan_block(a, data[i:i + BLOCK], state)
        state = int(out[min(i + BLOCK, len(data)) - 1])
    return out


def _scan_block(a: Automaton, data: np.ndarray, start: int) -> np.ndarray:
    """States of one block that is entered in state ``start``.

    The block is cut into lanes that advance side by side. A lane's first state is not known
    until the lane before it has ended, so lanes begin at the start state; afterwards those whose
    true first state differs are run again, until they meet the states already found. That is
    exact for every input, and short, as states soon forget what lies far back.
    """
    n = len(data)
    lanes = -(-n // LANE)
    kinds = np.full(lanes * LANE, a.kinds[END], np.intp)
    kinds[:n] = a.kinds[data]
    kinds = np.ascontiguousarray(kinds.reshape(lanes, LANE).T)
    wide = a.table.shape[1]
    flat = (a.table * wide).ravel()
    out = np.empty((LANE, lanes), np.intp)
    state = np.zeros(lanes, np.intp)
    for t in range(LANE):
        state = flat[state + kinds[t]]
        out[t] = state
    assumed = np.zeros(lanes, np.intp)
    while True:
        true = np.concatenate([[start * wide], out[-1, :-1]])
        lane = np.flatnonzero(true != assumed)
        if not len(lane):
            break
        state = true[lane]
        assumed[lane] = state
        for t in range(LANE):
            state = flat[state + kinds[t, lane]]
            differs = out[t, lane] != state
            lane, state = lane[differs], state[differs]
            if not len(lane):
                break
            out[t, lane] = state
    return out.T.ravel()[:n] // wide


def segments(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of True as start, end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    yield from zip(edge[::2].tolist(), edge[1::2].tolist())
