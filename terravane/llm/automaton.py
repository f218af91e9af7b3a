"""Rules as regular expressions, compiled together into one minimised byte automaton.

`compile_rules` parses each rule, builds its Thompson automaton and determinises all of
them at once: a combined state holds, for each rule, the threads still alive, oldest start first,
so one table lookup per byte advances every rule with leftmost, longest, non-overlapping
semantics. Moore's refinement then merges equal states.

A rule must not leave its accepting part once it is in it (its expression ends with the class
it repeats, or with its last literal), and a younger thread must not accept while an older one is
still undecided; `compile_rules` raises ValueError for others, for which one pass would not do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """min_total: bytes of a whole match; min_tail: bytes from where the expression first accepts."""

    kind: str
    pattern: str
    ignore_case: bool = False
    min_total: int = 1
    min_tail: int = 1


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.edges: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.edges.append(None)
        return len(self.eps) - 1


class _Parser:
    """Literals, \\xHH and \\ escapes, classes, groups, |, ?, *, + and {m,} or {m}."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.s, self.i, self.ci, self.n = pattern, 0, ignore_case, _Nfa()

    def parse(self):
        a, b = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"cannot parse {self.s!r} at {self.i}")
        return self.n, a, b

    def alternatives(self):
        parts = [self.sequence()]
        while self.i < len(self.s) and self.s[self.i] == "|":
            self.i += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.n.state(), self.n.state()
        for x, y in parts:
            self.n.eps[a].append(x)
            self.n.eps[y].append(b)
        return a, b

    def sequence(self):
        a = b = self.n.state()
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            x, y = self.repeated()
            self.n.eps[b].append(x)
            b = y
        return a, b

    def repeated(self):
        at = self.i
        x, y = self.atom()
        if self.i >= len(self.s):
            return x, y
        c = self.s[self.i]
        if c in "?*+":
            self.i += 1
            return self._loop(x, y, c in "?*", c in "*+")
        if c == "{":
            end = self.s.index("}", self.i)
            low, comma, _ = self.s[self.i + 1 : end].partition(",")
            after = end + 1
            a, b = x, y
            for k in range(1, int(low)):
                self.i = at
                p, q = self.atom()
                if comma and k == int(low) - 1:
                    p, q = self._loop(p, q, False, True)
                self.n.eps[b].append(p)
                b = q
            self.i = after
            return a, b
        return x, y

    def _loop(self, x, y, none, many):
        a, b = self.n.state(), self.n.state()
        self.n.eps[a].append(x)
        self.n.eps[y].append(b)
        if none:
            self.n.eps[a].append(b)
        if many:
            self.n.eps[y].append(x)
        return a, b

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            x, y = self.alternatives()
            self.i += 1
            return x, y
        if c == "[":
            self.i += 1
            found: set[int] = set()
            while self.s[self.i] != "]":
                low = self.char()
                high = low
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    high = self.char()
                found.update(range(low, high + 1))
            self.i += 1
        else:
            found = {self.char()}
        if self.ci:
            found |= {ord(f(chr(x))) for x in found if x < 128 for f in (str.lower, str.upper)}
        a, b = self.n.state(), self.n.state()
        self.n.edges[a] = (frozenset(found), b)
        return a, b


def _closure(nfa: _Nfa, states) -> frozenset:
    todo, seen = list(states), set(states)
    while todo:
        for x in nfa.eps[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return frozenset(x for x in seen if nfa.edges[x] or not nfa.eps[x])


class _Rule:
    """Threads of one rule: a tuple of state sets, oldest start first; decided: the first one accepts."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.nfa, start, self.end = _Parser(rule.pattern, rule.ignore_case).parse()
        self.first = _closure(self.nfa, [start])
        if self.end in self.first:
            raise ValueError(f"{rule.kind} matches the empty text")
        self.classes = {e[0] for e in self.nfa.edges if e}

    def move(self, states: frozenset, byte: int) -> frozenset:
        return _closure(self.nfa, [e[1] for s in states if (e := self.nfa.edges[s]) and byte in e[0]])

    def accepts(self, threads: tuple) -> bool:
        return bool(threads) and self.end in threads[0]

    def step(self, threads: tuple, byte: int) -> tuple:
        if self.accepts(threads):
            on = self.move(threads[0], byte)
            if on:
                if self.end not in on:
                    raise ValueError(f"{self.rule.kind}: leaves its accepting part")
                return (on,)
            threads = ()
        out, known = [], set()
        for t in (*threads, self.first):
            on = self.move(t, byte) - known
            if on:
                out.append(frozenset(on))
                known |= on
                if self.end in on:
                    if len(out) > 1:
                        raise ValueError(f"{self.rule.kind}: a younger thread accepts before an older one")
                    break
        if self.accepts(tuple(out)) and self.accepts(threads):
            raise ValueError(f"{self.rule.kind}: adjacent matches cannot be told apart")
        return tuple(out)


@dataclass
class Automaton:
    """table: next state for state and byte class, flat, states scaled by the number of classes.

    States from `accepting` on accept; masks has a bit for each rule, by state.
    """

    rules: tuple
    classes: np.ndarray
    width: int
    table: np.ndarray
    masks: np.ndarray
    accepting: int
    resets: np.ndarray


def compile_rules(rules: tuple) -> Automaton:
    own = [_Rule(r) for r in rules]
    sets = list({c for r in own for c in r.classes})
    signature: dict[tuple, int] = {}
    classes = np.zeros(256, np.uint8)
    for b in range(256):
        classes[b] = signature.setdefault(tuple(b in c for c in sets), len(signature))
    width = len(signature)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(width)]
    memo: list[dict] = [{} for _ in own]
    start = tuple(() for _ in own)
    index, order, table = {start: 0}, [start], []
    for state in order:
        row = []
        for b in sample:
            new = []
            for r, m, t in zip(own, memo, state, strict=True):
                if (t, b) not in m:
                    m[t, b] = r.step(t, b)
                new.append(m[t, b])
            key = tuple(new)
            if key not in index:
                index[key] = len(order)
                order.append(key)
            row.append(index[key])
        table.append(row)
    t = np.array(table)
    masks = np.array([sum(1 << k for k, (r, x) in enumerate(zip(own, s, strict=True)) if r.accepts(x)) for s in order])
    label = np.unique(masks, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([label, label[t]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == label.max():
            break
        label = new
    n = int(label.max()) + 1
    one = np.zeros(n, np.int64)
    one[label[::-1]] = np.arange(len(order))[::-1]
    small, small_masks = label[t[one]], masks[one]
    rank = np.argsort(np.lexsort((np.arange(n) != label[0], small_masks != 0)))
    back = np.argsort(rank)
    small, small_masks = rank[small[back]], small_masks[back]
    resets = np.array([bool((small[:, k] == 0).all()) for k in range(width)])
    return Automaton(tuple(rules), classes, width, (small * width).astype(np.int32).ravel(), small_masks.astype(np.int64), int((small_masks == 0).sum()), resets)


class Backward:
    """Finds where a match starts, from the byte at which its rule first accepts: the longest backward match."""

    def __init__(self, rule: Rule):
        r = _Rule(rule)
        back: dict[int, list] = {}
        for s, e in enumerate(r.nfa.edges):
            if e:
                back.setdefault(e[1], []).append((e[0], s))
        into: dict[int, list] = {}
        for s, xs in enumerate(r.nfa.eps):
            for x in xs:
                into.setdefault(x, []).append(s)
        self._back, self._into, self._memo = back, into, {}
        self._start, self._end = _Parser(rule.pattern, rule.ignore_case).parse()[1], r.end

    def _close(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for x in self._into.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def start(self, data, first_accept: int, least: int) -> int:
        now, found, i = self._close([self._end]), first_accept, first_accept
        while i >= least and now:
            key = (now, int(data[i]))
            if key not in self._memo:
                self._memo[key] = self._close([s for x in now for c, s in self._back.get(x, ()) if key[1] in c])
            now = self._memo[key]
            if self._start in now:
                found = i
            i -= 1
        return found


def run(a: Automaton, data: np.ndarray, bounds: np.ndarray, lanes: int = 8192):
    """Positions and rule masks of all accepting bytes of texts that lie one after another.

    Many lanes advance together by one byte; a lane starts where a text starts or after a
    byte that takes every state back to the first one, so nothing needs to be scanned twice.
    """
    total = len(data)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = a.classes[data]
    length = min(max(total // lanes, 64), 4096)
    after = np.flatnonzero(a.resets[cls]) + 1
    cuts = np.zeros(0, np.int64)
    if len(after):
        at = np.searchsorted(after, np.arange(length, total, length))
        cuts = after[at[at < len(after)]]
    starts = np.unique(np.concatenate([bounds[:-1], cuts]))
    starts = starts[starts < total]
    lens = np.diff(np.append(starts, total))
    by = np.argsort(-lens, kind="stable")
    pos, lens = starts[by], lens[by]
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(int(lens[0])), "right")
    state, idx = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int32)
    least = a.accepting * a.width
    found_pos, found_state = [], []
    t, last = 0, int(lens[0])
    while t < last and active[t] > 12:
        n = active[t]
        np.add(state[:n], cls[pos[:n]], out=idx[:n], casting="unsafe")
        np.take(a.table, idx[:n], out=state[:n], mode="clip")
        hit = np.flatnonzero(state[:n] >= least)
        if len(hit):
            found_pos.append(pos[hit])
            found_state.append(state[hit])
        pos[:n] += 1
        t += 1
    if t < last:
        table = a.table.tolist()
        for k in range(int(active[t])):
            s, p, own_pos, own_state = int(state[k]), int(pos[k]), [], []
            for c in cls[p : p + int(lens[k]) - t].tolist():
                s = table[s + c]
                if s >= least:
                    own_pos.append(p)
                    own_state.append(s)
                p += 1
            found_pos.append(np.array(own_pos, np.int64))
            found_state.append(np.array(own_state, np.int32))
    if not found_pos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, s = np.concatenate(found_pos), np.concatenate(found_state)
    by = np.argsort(p)
    return p[by], a.masks[s[by] // a.width]
