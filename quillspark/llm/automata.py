"""Regular expressions over bytes as one deterministic automaton: subset construction, then minimisation.

Expressions have literals, ``\\xHH``, classes, groups, ``(?i:...)``, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``,
``{m,n}``. All must match one byte at least.
"""

from __future__ import annotations

import numpy as np

_EVERY = frozenset(range(256))


class _Parser:
    """Expression to a tree of ('set', bytes), ('cat', parts), ('or', parts) and ('repeat', part, least, most)."""

    def __init__(self, source: str) -> None:
        self.source, self.at, self.fold = source, 0, False

    def peek(self) -> str:
        return self.source[self.at : self.at + 1]

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or expected and c != expected:
            raise ValueError(f"{expected or 'more'} expected at {self.at} of {self.source!r}")
        self.at += 1
        return c

    def choice(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self) -> tuple:
        part = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body = self.source[self.at : self.source.index("}", self.at)]
                self.at += len(body) + 1
                least, comma, most = body.partition(",")
                part = ("repeat", part, int(least), (int(most) if most else None) if comma else int(least))
            else:
                part = ("repeat", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c])
        return part

    def byte(self) -> int:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        return int(self.take() + self.take(), 16) if c == "x" else ord(c)

    def folded(self, found: set[int]) -> tuple:
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isascii() and chr(b).isalpha()}
        return ("set", frozenset(found))

    def atom(self) -> tuple:
        c = self.peek()
        if c == "(":
            self.take()
            before = self.fold
            if self.source.startswith("?i:", self.at):
                self.at += 3
                self.fold = True
            out = self.choice()
            self.take(")")
            self.fold = before
            return out
        if c == "[":
            self.take()
            found: set[int] = set()
            while self.peek() != "]":
                low = high = self.byte()
                if self.peek() == "-" and self.source[self.at + 1 : self.at + 2] != "]":
                    self.take()
                    high = self.byte()
                found |= set(range(low, high + 1))
            self.take()
            return self.folded(found)
        return self.folded({self.byte()})


class _Graph:
    """States with arrows on byte sets and free arrows."""

    def __init__(self) -> None:
        self.arrows: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.arrows.append([])
        self.free.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, begin: int) -> int:
        """The state reached from ``begin`` by what the tree matches."""
        if tree[0] == "set":
            end = self.state()
            self.arrows[begin].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for part in tree[1]:
                begin = self.add(part, begin)
            return begin
        if tree[0] == "or":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, begin)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            begin = self.add(part, begin)
        if most is None:
            loop, end = self.state(), self.state()
            self.free[begin] += [loop]
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[begin].append(end)
            begin = self.add(part, begin)
        self.free[begin].append(end)
        return end

    def closures(self) -> list[int]:
        """For each state the states that free arrows lead to, itself among them, as bits."""
        out = []
        for s in range(len(self.free)):
            found, todo = {s}, [s]
            while todo:
                for x in self.free[todo.pop()]:
                    if x not in found:
                        found.add(x)
                        todo.append(x)
            out.append(sum(1 << x for x in found))
        return out


def _union(masks) -> int:
    out = 0
    for mask in masks:
        out |= mask
    return out


def _bits(mask: int) -> list[int]:
    out = []
    while mask:
        low = mask & -mask
        out.append(low.bit_length() - 1)
        mask ^= low
    return out


def _reversed(tree: tuple) -> tuple:
    """The tree that matches what this one matches, read backwards."""
    if tree[0] == "set":
        return tree
    if tree[0] == "repeat":
        return ("repeat", _reversed(tree[1]), *tree[2:])
    parts = list(map(_reversed, tree[1]))
    return (tree[0], parts[::-1] if tree[0] == "cat" else parts)


class Automaton:
    """A minimal automaton; state 0 is the start. ``anywhere``: matches may begin at any byte.

    ``step[state * classes + class_of[byte]]`` is the next state, ``accepts[state]`` has bit r set if a match of rule r ends
    there, ``dead`` is the state without a way to a match (-1 if there is none), and ``resets`` are the bytes that lead from every state back
    to the start (or to the dead state), so no match contains them.
    """

    def __init__(self, expressions: list[str], anywhere: bool, backwards: bool = False) -> None:
        graph = _Graph()
        start, final = graph.state(), {}
        for k, expression in enumerate(expressions):
            parser = _Parser(expression)
            tree = parser.choice()
            if parser.at != len(expression):
                raise ValueError(f"unbalanced: {expression!r}")
            begin = graph.state()
            graph.free[start].append(begin)
            final[graph.add(_reversed(tree) if backwards else tree, begin)] = k
        # bytes that all arrows treat alike are one class
        sets = {s for arrows in graph.arrows for s, _ in arrows}
        kinds: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        self.class_of = np.array([kinds.setdefault(tuple(b in s for s in ordered), len(kinds)) for b in range(256)], dtype=np.uint8)
        self.classes = len(kinds)
        sample = [int(np.flatnonzero(self.class_of == k)[0]) for k in range(self.classes)]

        reach = graph.closures()
        # by state: the classes that it has arrows on, and where each leads, as bits
        leads = [[(k, _union(reach[end] for on, end in arrows if byte in on)) for k, byte in enumerate(sample) if any(byte in on for on, _ in arrows)] for arrows in graph.arrows]
        home = reach[start] if anywhere else 0
        first = reach[start]
        number, todo, step, accepted = {first: 0}, [first], [], []
        for states in todo:  # grows meanwhile
            row, accept = [home] * self.classes, 0
            for s in _bits(states):
                for k, target in leads[s]:
                    row[k] |= target
                if s in final:
                    accept |= 1 << final[s]
            accepted.append(accept)
            for target in row:
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
            step.append([number[target] for target in row])
        accepts = np.array(accepted, dtype=np.int64)
        self._minimise(np.array(step, dtype=np.int64), accepts)

    def _minimise(self, step: np.ndarray, accepts: np.ndarray) -> None:
        """Splits states by what they accept and then by where they lead, until nothing splits."""
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack((block, block[step])), axis=0, return_inverse=True)
            finer = finer.ravel()
            if finer.max() == block.max():
                break
            block = finer
        rename = np.full(block.max() + 1, -1)
        order = list(dict.fromkeys(block.tolist()))  # the start's block comes first
        rename[order] = np.arange(len(order))
        member = np.array([int(np.flatnonzero(block == b)[0]) for b in order])
        table = rename[block[step[member]]]
        self.step, self.accepts = table.astype(np.int32).ravel(), accepts[member]
        loops = [s for s in range(len(table)) if not self.accepts[s] and (table[s] == s).all()]
        self.dead = loops[0] if loops and loops[0] else -1
        home = np.isin(table, [0, self.dead]).all(axis=0)
        self.resets = home[self.class_of]


class Scanner:
    """All rules in one pass over bytes, then each found rule's leftmost longest spans."""

    #: Fewer runs than this are finished one by one.
    FEW = 48

    def __init__(self, expressions: list[str]) -> None:
        self.all = Automaton(expressions, anywhere=True)
        # each rule forwards, for ends, and backwards, for where matches can begin
        self.tables = [[(a.step.tolist(), a.class_of.tolist(), a.accepts.tolist(), a.classes, a.dead) for a in (Automaton([x], anywhere=False), Automaton([x], anywhere=True, backwards=True))] for x in expressions]
        self.flat = (self.all.step * self.all.classes).astype(np.int32)  # states come multiplied
        self.accepts = np.zeros(len(self.flat) + 1, dtype=np.int64)
        self.accepts[:: self.all.classes][: len(self.all.accepts)] = self.all.accepts

    def rules_in(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each run of bytes, bits of the rules that match in it: all runs take a byte at a time together."""
        classes = self.all.class_of[data].astype(np.int32)
        order = np.argsort(start - end, kind="stable")  # the longest first
        begin, length = start[order], (end - start)[order]
        state, found = np.zeros(len(order), dtype=np.int32), np.zeros(len(order), dtype=np.int64)
        longest = int(length[0]) if len(length) else 0
        alive = np.searchsorted(-length, -np.arange(longest), side="left")  # runs longer than i
        i = 0
        while i < longest and alive[i] >= self.FEW:
            n = alive[i]
            state[:n] = self.flat[state[:n] + classes[begin[:n] + i]]
            found[:n] |= self.accepts[state[:n]]
            i += 1
        if i < longest:
            flat, accepts = self.flat.tolist(), self.accepts.tolist()
            for k in range(alive[i]):
                s, bits = int(state[k]), int(found[k])
                for c in classes[begin[k] + i : begin[k] + length[k]].tolist():
                    s = flat[s + c]
                    bits |= accepts[s]
                found[k] = bits
        out = np.empty_like(found)
        out[order] = found
        return out

    def spans(self, rule: int, text: bytes) -> list[tuple[int, int]]:
        """Leftmost non-overlapping spans of one rule, each as long as it can be.

        One pass backwards marks the places where a match begins; only from those is the text read forwards, and after a match
        from its end on. A byte is read again only if a match could have gone on over it and did not.
        """
        step, class_of, accepts, classes, _ = self.tables[rule][1]
        begins, state = [], 0
        for i in range(len(text) - 1, -1, -1):
            state = step[state * classes + class_of[text[i]]]
            if accepts[state]:
                begins.append(i)
        step, class_of, accepts, classes, dead = self.tables[rule][0]
        out, at = [], 0
        for begin in reversed(begins):
            if begin < at:
                continue
            state = 0
            for i in range(begin, len(text)):
                state = step[state * classes + class_of[text[i]]]
                if state == dead:
                    break
                if accepts[state]:
                    at = i + 1
            out.append((begin, at))
        return out
