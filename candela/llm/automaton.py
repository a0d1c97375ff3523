"""One deterministic automaton for many patterns: subset construction, minimisation, lanes."""

from __future__ import annotations

import re
from re import _constants as code
from re import _parser as parser

import numpy as np

#: States beyond which a set of patterns is refused.
MOST_STATES = 60_000


class TooManyStates(ValueError):
    pass


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is code.LITERAL:
        found = {arg}
    elif op is code.NOT_LITERAL:
        found = set(range(256)) - {arg}
    elif op is code.ANY:
        found = set(range(256)) - {10}
    else:
        found, negate = set(), False
        for kind, x in arg:
            if kind is code.NEGATE:
                negate = True
            elif kind is code.RANGE:
                found |= set(range(x[0], x[1] + 1))
            elif kind is code.LITERAL:
                found.add(x)
            else:
                raise ValueError(f"{kind} isn't supported in a class")
        if negate:
            found = set(range(256)) - found
    if fold:
        found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
    return frozenset(found)


class _Nfa:
    """Thompson's construction from the parse tree of a bytes pattern; `back` reads the pattern from its end."""

    def __init__(self, back: bool = False, look: int | None = None):
        self.back, self.look = back, look
        self.empty: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append(None)
        return len(self.step) - 1

    def add(self, tree, at: int, fold: bool) -> int:
        for op, arg in reversed(tree) if self.back else tree:
            if op in (code.LITERAL, code.NOT_LITERAL, code.IN, code.ANY):
                to = self.state()
                self.step[at] = (_bytes_of(op, arg, fold), to)
                at = to
            elif op is code.SUBPATTERN:
                _, on, off, inner = arg
                at = self.add(inner, at, fold or bool(on & re.I.value))
            elif op is code.BRANCH:
                end = self.state()
                for inner in arg[1]:
                    begin = self.state()
                    self.empty[at].append(begin)
                    self.empty[self.add(inner, begin, fold)].append(end)
                at = end
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT):
                least, most, inner = arg
                if self.look is not None and least > self.look:
                    least, most = self.look, code.MAXREPEAT
                for _ in range(least):
                    at = self.fresh(self.add(inner, at, fold))
                if most is code.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[at] += [loop, end]
                    self.empty[self.add(inner, loop, fold)].append(at)
                    at = end
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(end)
                        at = self.fresh(self.add(inner, at, fold))
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"{op} isn't supported")
        return at

    def fresh(self, at: int) -> int:
        to = self.state()
        self.empty[at].append(to)
        return to


class Automaton:
    """next[state, byte] and found[state], the patterns that end there; state 0 is the start.

    The patterns may begin anywhere, so the start is in every state; `anchored` ones begin with the first
    byte, and `dead` is the state from which nothing can be found any more. There may be any number of patterns.
    `back` builds the patterns' mirror images, for texts that are read from their ends. With `look`, a repeat of
    more than `look` times is one of at least `look` times: what a pattern matches is found, and some more. States that find something come last.
    """

    def __init__(self, patterns: list[bytes], anchored: bool = False, back: bool = False, look: int | None = None, most_states: int = MOST_STATES):
        nfa = _Nfa(back, look)
        root, ends = nfa.state(), {}
        for k, p in enumerate(patterns):
            tree = parser.parse(p)
            if tree.getwidth()[0] == 0:
                raise ValueError(f"{p!r} matches nothing at all")
            begin = nfa.state()
            nfa.empty[root].append(begin)
            ends[nfa.add(list(tree), begin, bool(tree.state.flags & re.I.value))] = k

        closed: dict[int, frozenset[int]] = {}

        def closure(s: int) -> frozenset[int]:
            if s not in closed:
                seen, todo = {s}, [s]
                while todo:
                    for t in nfa.empty[todo.pop()]:
                        if t not in seen:
                            seen.add(t)
                            todo.append(t)
                closed[s] = frozenset(x for x in seen if nfa.step[x] or x in ends)
            return closed[s]

        # Bytes that no step tells apart are one class.
        sets = {x[0] for x in nfa.step if x}
        signs: dict[tuple, int] = {}
        klass = np.array([signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256)])
        member = [int(np.flatnonzero(klass == c)[0]) for c in range(len(signs))]
        moves = {i: [closure(x[1]) if b in x[0] else None for b in member] for i, x in enumerate(nfa.step) if x}
        begin = closure(root)
        states, order, table = {begin: 0}, [begin], []
        for now in order:
            row = []
            for c in range(len(member)):
                to = set() if anchored else set(begin)
                for s in now:
                    if s in moves and moves[s][c]:
                        to |= moves[s][c]
                to = frozenset(to)
                if to not in states:
                    if len(states) >= most_states:
                        raise TooManyStates(f"the patterns need over {most_states} states")
                    states[to] = len(states)
                    order.append(to)
                row.append(states[to])
            table.append(row)
        table = np.array(table)
        found = [tuple(sorted(ends[s] for s in x if s in ends)) for x in order]
        self.built = len(order)
        # Minimisation: states are told apart by what they find, then by where each class leads.
        kinds: dict[tuple, int] = {}
        block = np.array([kinds.setdefault(x, len(kinds)) for x in found])
        while True:
            new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        first = np.unique(block, return_index=True)[1]
        # The start is state 0; the states that find something are the last ones.
        places = sorted(range(len(first)), key=lambda b: (b != block[0], bool(found[first[b]]), b))
        where = np.empty(len(first), dtype=np.int64)
        where[places] = np.arange(len(first))
        self.next = where[block[table[first[places]]]][:, klass].astype(np.int32)
        self.found = [found[first[b]] for b in places]
        self.states = len(first)
        self.accepts = next((i for i, x in enumerate(self.found) if x), self.states)
        still = (self.next == np.arange(self.states)[:, None]).all(axis=1)
        self.dead = next((i for i in np.flatnonzero(still).tolist() if not self.found[i]), -1)
        #: Bytes after which nothing before them matters.
        self.resets = np.flatnonzero((self.next == 0).all(axis=0))
        self._flat = (self.next.astype(np.int32) * 256).ravel()
        kinds = {x: i for i, x in enumerate(dict.fromkeys(self.found))}
        self._kind = np.array([kinds[x] for x in self.found])
        self.rows = None

    def row_lists(self) -> list[list[int]]:
        """next as lists, for runs of one text by itself."""
        if self.rows is None:
            self.rows = self.next.tolist()
        return self.rows

    def run(self, text: bytes, begin: int = 0) -> int:
        """Where the longest match that begins at `begin` ends; -1: nowhere. For anchored automata."""
        rows, state, limit, dead, end = self.row_lists(), 0, self.accepts, self.dead, -1
        for i, byte in enumerate(memoryview(text)[begin:], begin + 1):
            state = rows[state][byte]
            if state >= limit:
                end = i
            elif state == dead:
                break
        return end

    def _entries(self, buf: np.ndarray, starts: np.ndarray, lane: int) -> np.ndarray:
        """The state at each of `starts`, lanes of `lane` bytes side by side of which the first begins in state 0.

        All states step through every lane at once; those that meet go on as one, so that soon few are left.
        """
        n, states = len(starts) - 1, self.states
        out, state = np.zeros(len(starts), dtype=np.int64), 0
        for at in range(0, n, each := max(1, (1 << 21) // states)):
            own = starts[at : min(at + each, n)].astype(np.int64)
            m = np.broadcast_to(np.arange(states, dtype=np.int32) * 256, (len(own), states))
            place = np.broadcast_to(np.arange(states), (len(own), states))
            done = 0
            for stop in (4, 16, 64, 256, lane):
                for t in range(done, min(stop, lane)):
                    m = self._flat[m + buf[own + t][:, None]]
                done = max(done, min(stop, lane))
                order = np.argsort(m, axis=1, kind="stable")
                ranked = np.take_along_axis(m, order, axis=1)
                group = np.zeros(m.shape, dtype=np.int64)
                group[:, 1:] = np.cumsum(ranked[:, 1:] != ranked[:, :-1], axis=1)
                swap = np.empty_like(group)
                np.put_along_axis(swap, order, group, axis=1)
                small = np.zeros((len(own), int(group.max()) + 1), dtype=np.int32)
                np.put_along_axis(small, group, ranked, axis=1)
                m, place = small, np.take_along_axis(swap, place, axis=1)
            for i in range(len(own)):
                out[at + i] = state
                state = int(m[i, place[i, state]]) >> 8
        out[n] = state
        return out

    def hits(self, texts: list[bytes], lane: int = 4096) -> list[tuple[int, int, int, int]]:
        """(text, pattern, begin, end), once each: in text[begin:end], which no byte that resets the automaton divides, the pattern is found.

        All texts are read at once, in lanes that begin after a byte that resets the automaton: each step moves every lane
        that isn't over by a byte, whatever the number of patterns. Where no such byte comes for long, lanes begin anywhere,
        with the state that the bytes before them lead to. No lane holds bytes of two texts.
        """
        size = np.array([len(x) for x in texts], dtype=np.int64)
        ends = np.cumsum(size)
        buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(buf):
            return []
        table = np.zeros(256, dtype=bool)
        table[self.resets] = True
        resets = np.flatnonzero(table[buf])
        stops = np.unique(ends[size > 0])
        if len(resets):
            near = resets[np.minimum(np.searchsorted(resets, np.arange(lane, len(buf), lane)), len(resets) - 1)] + 1
            stops = np.union1d(stops, near)
        starts = np.concatenate([[0], stops[:-1]])
        long = np.flatnonzero(stops - starts > 2 * lane)
        entry = np.zeros(len(starts), dtype=np.int64)
        if len(long):
            more, states = [], []
            for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
                own = np.arange(a, b, lane)
                more.append(own)
                states.append(self._entries(buf, own, lane))
            short = np.delete(np.arange(len(starts)), long)
            starts, entry = np.concatenate([starts[short], *more]), np.concatenate([entry[short], *states])
            order = np.argsort(starts, kind="stable")
            starts, entry = starts[order], entry[order]
            stops = np.append(starts[1:], len(buf))
        size_of = stops - starts
        order = np.argsort(-size_of, kind="stable")
        at, size_of = starts[order].astype(np.int64), size_of[order]
        state = (entry[order] * 256).astype(np.int32)
        live = np.searchsorted(-size_of, -np.arange(size_of[0]) - 1, side="right")
        limit, out = self.accepts * 256, set()
        for t, k in enumerate(live.tolist()):
            s = self._flat[state[:k] + buf[at[:k] + t]]
            hit = s >= limit
            if hit.any():
                new = np.flatnonzero(hit)
                new = new[self._kind[s[new] >> 8] != self._kind[state[new] >> 8]]
                for x, found in zip((at[new] + t).tolist(), (s[new] >> 8).tolist(), strict=True):
                    text = int(np.searchsorted(ends, x, side="right"))
                    begin, r = int(ends[text] - size[text]), int(np.searchsorted(resets, x))
                    low = max(begin, int(resets[r - 1]) + 1) if r else begin
                    high = min(int(ends[text]), int(resets[r])) if r < len(resets) else int(ends[text])
                    out.update((text, p, low - begin, high - begin) for p in self.found[found])
            state[:k] = s
        return sorted(out)

    def scan(self, texts: list[bytes], lane: int = 4096) -> list[set[int]]:
        """The patterns found in each text."""
        out: list[set[int]] = [set() for _ in texts]
        for text, pattern, _, _ in self.hits(texts, lane):
            out[text].add(pattern)
        return out


def finder(patterns: list[bytes], most_states: int = 4000) -> Automaton:
    """One automaton that finds every place with a match of any pattern, within so many states if some number of counted repeats allows.

    Counters of many patterns side by side multiply, so repeats are counted as far as the states reach; what is found beyond the patterns is
    for Spans to drop.
    """
    for look in (None, 24, 16, 12, 8, 6, 4, 3):
        try:
            return Automaton(patterns, look=look, most_states=most_states)
        except TooManyStates:
            pass
    return Automaton(patterns, look=2)


class Spans:
    """The matches of one pattern: leftmost, of these longest, not overlapping.

    The mirrored automaton reads a text from its end and marks where matches begin; from each
    such place the anchored one finds the longest. Both read a byte once.
    """

    def __init__(self, pattern: bytes):
        self.begins, self.longest = Automaton([pattern], back=True), Automaton([pattern], anchored=True)

    def find(self, text: bytes) -> list[tuple[int, int]]:
        marks, rows, state, limit = bytearray(len(text)), self.begins.row_lists(), 0, self.begins.accepts
        i = len(text)
        for byte in reversed(text):
            i -= 1
            state = rows[state][byte]
            if state >= limit:
                marks[i] = 1
        out, at = [], marks.find(1)
        while at >= 0:
            end = self.longest.run(text, at)
            out.append((at, end))
            at = marks.find(1, end)
        return out
