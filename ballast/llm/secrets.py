"""Secret scan with one combined deterministic automaton (operator 6).

The rules' regular expressions are parsed, joined into one nondeterministic
automaton, determinised by subset construction and minimised by partition
refinement into one transition array over byte classes. All documents of a batch
go through the array side by side, one byte at a step, all rules in that pass; a
match may start at any byte, and a state's bits say which rules have just
matched.

Where a rule has matched in a document, the same construction without the free
start gives the spans: from every byte at once for the rules' openings, which
finds all starts, then from each start in turn for the whole rules, whose last
accepting position is the end. Where starts read the same bytes again and again
(a long run of openings that never complete a match), one pass from the last byte
to the first gives the ends of all starts instead. A kind's spans are leftmost, longest and don't
overlap, and matches that fail their length rule are dropped after matching.

An opening holds what every match of a rule that isn't dropped must begin with
(for hexadecimal runs and access keys the whole least length), so no match is
missed and the product of the rules' length counters doesn't multiply states.

Defined results: null or empty text has no spans, an empty table gives an empty
result. Very long texts are scanned whole, in time linear in their length.
Repeated rows give equal results. Extra columns pass through; a column named as
the result is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import flat_bytes

#: Fixed values: (kind, opening, head, body, least length of the body).
RULES = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 8),
    ("access", r"AKIA[A-Z0-9]{12}", r"", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]{32}", r"", r"[0-9a-f]+", 32),
    ("forge", r"gh[pousr]_[A-Za-z0-9]", r"", r"gh[pousr]_[A-Za-z0-9]{20,}", 24),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]", r"", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
    ("cloud", r"AIza[A-Za-z0-9_-]", r"", r"AIza[A-Za-z0-9_-]{20,}", 24),
    ("pay", r"[sr]k_live_[A-Za-z0-9]", r"", r"[sr]k_live_[A-Za-z0-9]{16,}", 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]", r"", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\x20\t\n\r\f\v]*-----END [A-Z ]*PRIVATE KEY-----)?", 1),
]
BASE = ("assign", "access", "hex")

#: With fewer documents left in a step than this, the rest is scanned one by one.
LEAST_LANES = 48

#: Once a rule's starts have read a document this often in all, its ends come from one backward pass.
WALKS = 4

_ESCAPES = {"t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
ALL = frozenset(range(256))


class _Nfa:
    """Thompson automaton over bytes of an expression: moves (byte set, target) and free moves of each state.

    Expressions hold ASCII literals, escapes, sets, groups (also ``(?i:``), branches and the repeats ``? * + {m} {m,} {m,n}``.
    """

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, at: int) -> int:
        """Adds an expression after state ``at``; gives its last state."""
        self.text, self.pos = pattern, 0
        end = self._branches(at, False)
        if self.pos < len(pattern):
            raise ValueError(f"unexpected {pattern[self.pos]!r} in {pattern!r}")
        return end

    def _peek(self) -> str:
        return self.text[self.pos : self.pos + 1]

    def _take(self) -> str:
        self.pos += 1
        return self.text[self.pos - 1]

    def _branches(self, at: int, fold: bool) -> int:
        end = self.state()
        while True:
            start = self.state()
            self.free[at].append(start)
            self.free[self._sequence(start, fold)].append(end)
            if self._peek() != "|":
                return end
            self._take()

    def _sequence(self, at: int, fold: bool) -> int:
        while self._peek() not in ("", "|", ")"):
            begin = self.pos
            end = self._atom(at, fold)
            after = self.pos
            low, high = self._repeat()
            if (low, high) == (1, 1):
                at = end
                continue
            follow = self.pos

            def again(start: int) -> int:
                self.pos = begin
                return self._atom(start, fold)

            reached = at
            for _ in range(low):
                reached = again(reached)
            last = self.state()
            self.free[reached].append(last)
            if high is None:
                loop = self.state()
                self.free[reached].append(loop)
                back = again(loop)
                self.free[back] += [loop, last]
            else:
                for _ in range(high - low):
                    reached = again(reached)
                    self.free[reached].append(last)
            assert self.pos in (begin, after)
            self.pos, at = follow, last
        return at

    def _repeat(self) -> tuple[int, int | None]:
        c = self._peek()
        if c and c in "?*+":
            self._take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        inner = self.text[self.pos + 1 : self.text.index("}", self.pos)]
        self.pos += len(inner) + 2
        low, comma, high = inner.partition(",")
        return int(low), int(high) if high else None if comma else int(low)

    def _atom(self, at: int, fold: bool) -> int:
        c = self._take()
        if c == "(":
            if self.text.startswith("?:", self.pos):
                self.pos += 2
            elif self.text.startswith("?i:", self.pos):
                self.pos, fold = self.pos + 3, True
            elif self._peek() == "?":
                raise ValueError(f"this kind of group isn't supported: {self.text!r}")
            end = self._branches(at, fold)
            if self._peek() != ")":
                raise ValueError(f"a group isn't closed: {self.text!r}")
            self._take()
            return end
        if c == "[":
            found = self._set(fold)
        elif c == ".":
            found = ALL - {10}
        elif c in "*+?{^$":
            raise ValueError(f"{c!r} isn't supported here: {self.text!r}")
        else:
            found = self._folded({self._char(c)}, fold)
        end = self.state()
        self.moves[at].append((frozenset(found), end))
        return end

    def _char(self, c: str) -> int:
        if c == "\\":
            c = self._take()
            if c == "x":
                self.pos += 2
                return int(self.text[self.pos - 2 : self.pos], 16)
            if c in _ESCAPES:
                return _ESCAPES[c]
            if c.isalnum():
                raise ValueError(f"the escape of {c!r} isn't supported in a rule")
        if ord(c) > 127:
            raise ValueError("rules hold ASCII characters only")
        return ord(c)

    @staticmethod
    def _folded(found: set, fold: bool) -> set:
        return found | {x ^ 32 for x in found if chr(x).isalpha()} if fold else found

    def _set(self, fold: bool) -> set:
        negate = self._peek() == "^"
        self.pos += negate
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._char(self._take())
            if self._peek() == "-" and self.text[self.pos + 1] != "]":
                self._take()
                high = self._char(self._take())
            found |= set(range(low, high + 1))
        self._take()
        found = self._folded(found, fold)
        return ALL - found if negate else found


class Automaton:
    """``table[state * classes + class]`` gives the next state times ``classes``; states from ``accepting`` on carry rule bits.

    With ``anywhere``, a match may start at any byte; else it starts where the automaton does, and ``dead`` is the state that no match leaves.
    """

    def __init__(self, patterns: list[str], anywhere: bool = True):
        nfa = _Nfa()
        root = nfa.state()
        final: dict[int, int] = {}
        for k, p in enumerate(patterns):
            final[nfa.add(p, root)] = 1 << k
        # Bytes that no rule tells apart form a class.
        sets = sorted({s for m in nfa.moves for s, _ in m}, key=sorted)
        keys: dict[tuple, int] = {}
        self.classes_of = np.array([keys.setdefault(tuple(b in s for s in sets), len(keys)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(self.classes_of == c)[0]) for c in range(len(keys))]
        self.classes = len(keys)

        def closure(states: set) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for x in nfa.free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        # Subset construction; where a match may start anywhere, the root stays in every set.
        stay = {root} if anywhere else set()
        start = closure({root})
        number, order, rows = {start: 0}, [start], []
        for states in order:
            row = []
            for b in sample:
                target = closure({t for s in states for chars, t in nfa.moves[s] if b in chars} | stay)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        table = np.array(rows, np.int64)
        bits = np.array([sum({final[s] for s in states if s in final}) for states in order], np.int64)
        # Minimisation: split blocks of states until all states of a block agree on the blocks they lead to.
        _, block = np.unique(bits, return_inverse=True)
        while True:
            _, new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            new = new.ravel()
            if new.max() == block.max():
                break
            block = new
        n = int(block.max()) + 1
        one = np.zeros(n, np.int64)
        one[block] = np.arange(len(block))
        rank = np.argsort(np.argsort(np.where(bits[one] > 0, 1, 0), kind="stable"), kind="stable")
        small = np.zeros((n, self.classes), np.int64)
        small[rank] = rank[block[table[one]]]
        self.bits = np.zeros(n, np.int64)
        self.bits[rank] = bits[one]
        self.start = int(rank[block[0]]) * self.classes
        self.accepting = int((self.bits == 0).sum()) * self.classes
        self.table = (small * self.classes).astype(np.int32).ravel()
        self.states = n
        self.subsets = len(order)
        stuck = [k for k in range(n) if not self.bits[k] and (small[k] == k).all()]
        self.dead = stuck[0] * self.classes if stuck else -1

    def scan(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each document the bits of the rules that match in it: one pass, a byte of every document at a step."""
        n = len(offsets) - 1
        lengths = np.diff(offsets)
        masks = np.zeros(n, np.int64)
        order = np.argsort(-lengths, kind="stable")
        at, left = offsets[:-1][order], lengths[order]
        state = np.full(n, self.start, np.int32)
        classes = self.classes_of[flat]
        table, accepting = self.table, self.accepting
        step, live = 0, n
        while live:
            live = int(np.searchsorted(-left, -step, side="left"))
            if live < LEAST_LANES:
                break
            state = state[:live]
            state = table[state + classes[at[:live] + step]]
            if state.max() >= accepting:
                hit = np.flatnonzero(state >= accepting)
                masks[order[hit]] |= self.bits[state[hit] // self.classes]
            step += 1
        quick = table.tolist()
        for k in range(live):
            s, seen = int(state[k]), set()
            for c in classes[at[k] + step : at[k] + left[k]].tobytes():
                s = quick[s + c]
                if s >= accepting:
                    seen.add(s)
            for s in seen:
                masks[order[k]] |= self.bits[s // self.classes]
        return masks

    def starts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, bits of the rules that match from it) of all bytes of a document, from all of them side by side."""
        classes = self.classes_of[data].astype(np.int32)
        bits = np.zeros(len(data), np.int64)
        at, state, step = np.arange(len(data)), np.full(len(data), self.start, np.int32), 0
        while len(at):
            state = self.table[state + classes[at + step]]
            hit = state >= self.accepting
            bits[at[hit]] |= self.bits[state[hit] // self.classes]
            step += 1
            live = (state != self.dead) & (at + step < len(data))
            at, state = at[live], state[live]
        found = np.flatnonzero(bits)
        return found, bits[found]

    def longest(self, classes: bytes, at: int, rules: tuple[int, ...]) -> tuple[list[int], int]:
        """(ends of the longest matches of the rules from byte ``at`` (-1: none), bytes read)."""
        s, ends = self.start, [at if self.bits[self.start // self.classes] >> k & 1 else -1 for k in rules]
        if not hasattr(self, "quick"):
            self.quick, self.marks = self.table.tolist(), self.bits.tolist()
        for k in range(at, len(classes)):
            s = self.quick[s + classes[k]]
            if s == self.dead:
                break
            if s >= self.accepting:
                bits = self.marks[s // self.classes]
                ends = [k + 1 if bits >> r & 1 else e for r, e in zip(rules, ends)]
        else:
            k = len(classes)
        return ends, k - at + 1

    def ends(self, classes: np.ndarray) -> np.ndarray:
        """End of the longest match from every byte (-1: none): one pass from the last byte to the first, all states side by side.

        A state's longest end is that of the state which the byte leads to, or
        else the place itself if the state accepts. So the pass is linear however
        the matches from different bytes overlap.
        """
        to = np.ascontiguousarray((self.table.reshape(self.states, self.classes) // self.classes).T)
        start, n, accepts = self.start // self.classes, len(classes), self.bits > 0
        first = int(np.argmax(accepts)) if accepts.any() else self.states  # accepting states come last
        reach, other = np.where(accepts, n, -1), np.empty(self.states, np.int64)
        rows, out = list(to), [0] * n
        for i, c in zip(range(n - 1, -1, -1), classes[::-1].tolist()):
            reach.take(rows[c], out=other, mode="clip")
            np.maximum(other[first:], i, out=other[first:])
            reach, other = other, reach
            out[i] = reach[start]
        return np.array(out, np.int64)


class Scanner:
    """The automata of a set of rules: all openings anywhere, all openings from a byte on, heads and whole rules from a byte on."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.anywhere = Automaton([r[1] for r in rules])
        self.openings = Automaton([r[1] for r in rules], anywhere=False)
        self.whole = Automaton([r[2] for r in rules] + [r[2] + r[3] for r in rules], anywhere=False)
        self.alone: dict[int, list[Automaton]] = {}

    def spans(self, data: np.ndarray, mask: int) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points of the rules in ``mask``, by start and then rule."""
        n = len(self.rules)
        at, bits = self.openings.starts(data)
        classes = self.whole.classes_of[data].tobytes()
        found = []
        for k in range(n):
            if mask >> k & 1:
                done, room, whole = 0, WALKS * len(data), None
                for s in at[bits >> k & 1 > 0].tolist():
                    if s >= done:
                        if room > 0:
                            (head, end), read = self.whole.longest(classes, s, (k, n + k))
                            room -= read
                        else:  # starts overlap in the bytes they read
                            if whole is None:
                                whole = self._all_ends(data, k)
                            head, end = int(whole[0][s]), int(whole[1][s])
                        if end >= 0:
                            done = max(end, s + 1)
                            if end - max(head, s) >= self.rules[k][4]:
                                found.append((s, k, end))
        if not found:
            return []
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return sorted((int(points[s]), k, int(points[e])) for s, k, e in found)


    def _all_ends(self, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends of a rule's head and of the whole rule from every byte."""
        if k not in self.alone:
            self.alone[k] = [Automaton([p], anywhere=False) for p in (self.rules[k][2], self.rules[k][2] + self.rules[k][3])]
        head, whole = self.alone[k]
        return head.ends(head.classes_of[data]) if self.rules[k][2] else np.arange(len(data)), whole.ends(whole.classes_of[data])


def scan(docs: DataFrame, text: str = "text", into: str = "secrets", rules=RULES) -> DataFrame:
    """``docs`` with an array of (kind, start, end) spans, by start and then kind as listed."""
    docs = docs.drop(into)
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, offsets = flat_bytes(b.column(text))
            masks = scanner.anywhere.scan(flat, offsets)
            found = [[{"kind": rules[k][0], "start": s, "end": e} for s, k, e in scanner.spans(flat[offsets[i] : offsets[i + 1]], int(m))] if m else [] for i, m in enumerate(masks)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{into}` array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, spans: list[tuple[int, int]], by: str = "<secret>") -> str:
    """``text`` with the spans replaced; overlapping spans count as one."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def base_digest(spans: list[tuple[int, int, int]], rules=RULES) -> str:
    """The digest column for spans of base rules, for tests and callers outside Spark."""
    return hashlib.sha256(",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in spans if rules[k][0] in BASE).encode()).hexdigest()
