"""Secret scan: rules compiled together into one minimal deterministic automaton over bytes."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from operator import length_hint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quietwatch.llm.common import map_batches, working_as

# The rules, and the characters that a match needs at least.  The first three are the base.  A pattern
# must end in a repeated class or in a fixed text, so that nothing of a match lives on after its end.
BASE_RULES = (
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", 0),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
)
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 24),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    ("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0),
    # the lines of a key up to its end, where there is one
    ("key_block", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x0A\x0D]*-----END ([A-Z]+ )*PRIVATE KEY-----", 0),
)
RULES = BASE_RULES + MORE_RULES

#: The shortest value of an assignment that counts.
ASSIGN_VALUE = 8


class _Parser:
    """Rule syntax: literals, ``\\xHH``, ``[..]``, ``(..)``, ``(?i:..)``, ``|``, ``? * + {m} {m,} {m,n}``."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def parse(self):
        tree = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unbalanced pattern at {self.i}: {self.p}")
        return tree

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated(self.atom()))
        return ("seq", items)

    def atom(self):
        c = self.p[self.i]
        if c == "(":
            fold, self.i = self.fold, self.i + 1
            if self.p.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            tree = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"missing ) in {self.p}")
            self.fold, self.i = fold, self.i + 1
            return tree
        if c == "[":
            return self.char_class()
        return self.set_of([self.char()])

    def char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def char_class(self):
        self.i += 1
        codes: list[int] = []
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                codes.extend(range(low, self.char() + 1))
            else:
                codes.append(low)
        self.i += 1
        return self.set_of(codes)

    def set_of(self, codes):
        found = set(codes)
        if self.fold:
            found |= {ord(chr(c).swapcase()) for c in found if chr(c).isascii()}
        return ("set", frozenset(found))

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.p.index("}", self.i)
                first, comma, second = self.p[self.i : end].partition(",")
                self.i = end + 1
                low, high = int(first), (int(second) if second else None) if comma else int(first)
            tree = ("repeat", tree, low, high)
        return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, reverse: bool = False) -> tuple[int, int]:
        start, end = self.state(), self.state()
        kind = tree[0]
        if kind == "set":
            self.moves[start].append((tree[1], end))
        elif kind == "or":
            for option in tree[1]:
                a, b = self.build(option, reverse)
                self.empty[start].append(a)
                self.empty[b].append(end)
        elif kind == "seq":
            at = start
            for item in reversed(tree[1]) if reverse else tree[1]:
                a, b = self.build(item, reverse)
                self.empty[at].append(a)
                at = b
            self.empty[at].append(end)
        else:
            _, inner, low, high = tree
            at = start
            for _ in range(low):
                a, b = self.build(inner, reverse)
                self.empty[at].append(a)
                at = b
            if high is None:
                a, b = self.build(inner, reverse)
                self.empty[at] += [a, end]
                self.empty[b] += [a, end]
            else:
                for _ in range(high - low):
                    a, b = self.build(inner, reverse)
                    self.empty[at] += [a, end]
                    at = b
                self.empty[at].append(end)
        return start, end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``step[state * 256 + byte]`` is the next state, already times 256; ``ended[state]`` has rules that end there.

    ``inside[state]``: the rules whose match reaches up to this state.
    """

    step: list[int]
    inside: list[tuple[int, ...]]
    start: int


def _byte_classes(sets) -> list[list[int]]:
    groups = defaultdict(list)
    for byte in range(256):
        groups[tuple(byte in s for s in sets)].append(byte)
    return list(groups.values())


def _minimal(step: list[list[int]], label: list) -> tuple[list[list[int]], list, list[int]]:
    """Merge states no input can tell apart, by refining the partition of their labels."""
    ids: dict = {}
    part = [ids.setdefault(x, len(ids)) for x in label]
    while True:
        keys: dict = {}
        finer = [keys.setdefault((part[s], *(part[t] for t in row)), len(keys)) for s, row in enumerate(step)]
        if len(keys) == len(set(part)):
            break
        part = finer
    first = {}
    for s, c in enumerate(finer):
        first.setdefault(c, s)
    states = [first[c] for c in range(len(first))]
    return [[finer[t] for t in step[s]] for s in states], [label[s] for s in states], finer


def _compiled(step, label, classes, start) -> Dfa:
    table = [0] * (len(step) * 256)
    numbers = [s * 256 for s in range(len(step))]  # one object per state keeps the table small in memory
    for s, row in enumerate(step):
        for c, members in enumerate(classes):
            for byte in members:
                table[s * 256 + byte] = numbers[row[c]]
    return Dfa(table, label, start * 256)


def combined_dfa(patterns: list[str]) -> Dfa:
    """One automaton that searches for all patterns at once, each leftmost and longest, restarting after a match.

    Per rule a state keeps the live threads, grouped by their start, the oldest first.  When a group matches, all
    younger ones are cut and none is added.  When it dies, the byte is read again by a fresh start of that rule.
    """
    nfa = _Nfa()
    ends = [nfa.build(_Parser(p).parse()) for p in patterns]
    fresh = [nfa.closure([a]) for a, _ in ends]
    classes = _byte_classes({s for moves in nfa.moves for s, _ in moves})
    sample = [members[0] for members in classes]

    def move(states, byte):
        return nfa.closure({t for s in states for chars, t in nfa.moves[s] if byte in chars})

    def step_rule(rule: int, part: tuple[bool, tuple], byte: int) -> tuple[bool, tuple]:
        matched, groups = part
        moved = list(dict.fromkeys(filter(None, (move(g, byte) for g in groups))))
        if matched and not moved:
            matched, moved = False, list(filter(None, [move(fresh[rule], byte)]))
        for k, group in enumerate(moved):
            if ends[rule][1] in group:
                return True, tuple(moved[: k + 1])
        if matched:
            raise ValueError(f"a match of {patterns[rule]} could go on after its end")
        return False, tuple(dict.fromkeys([*moved, fresh[rule]]))

    begin = tuple((False, (f,)) for f in fresh)
    index, todo, step, label = {begin: 0}, [begin], [], []
    memo: dict = {}
    for state in todo:
        row = []
        for byte in sample:
            nxt = []
            for rule, part in enumerate(state):
                key = (rule, part, byte)
                if key not in memo:
                    memo[key] = step_rule(rule, part, byte)
                nxt.append(memo[key])
            nxt = tuple(nxt)
            if nxt not in index:
                index[nxt] = len(todo)
                todo.append(nxt)
            row.append(index[nxt])
        step.append(row)
        label.append(tuple(r for r, part in enumerate(state) if part[0]))
    # a state whose match goes on must be told from one where a new match of the same rule just began
    step, label, where = _minimal(step, label)
    return _compiled(step, label, classes, where[0])


def reverse_dfa(pattern: str) -> Dfa:
    """Reads a match backwards from its end; state 0 accepts nothing more."""
    nfa = _Nfa()
    start, end = nfa.build(_Parser(pattern).parse(), reverse=True)
    classes = _byte_classes({s for moves in nfa.moves for s, _ in moves})
    begin = nfa.closure([start])
    index, todo, step, label = {frozenset(): 0, begin: 1}, [frozenset(), begin], [], []
    for state in todo:
        row = []
        for members in classes:
            nxt = nfa.closure({t for s in state for chars, t in nfa.moves[s] if members[0] in chars})
            if nxt not in index:
                index[nxt] = len(todo)
                todo.append(nxt)
            row.append(index[nxt])
        step.append(row)
        label.append((0,) if end in state else ())
    return _compiled(step, label, classes, 1)


class Scanner:
    """Finds the spans of all rules in one pass over the bytes of a text."""

    def __init__(self, rules=RULES):
        self.names = [name for name, _, _ in rules]
        self.least = [least for _, _, least in rules]
        self.forward = combined_dfa([p for _, p, _ in rules])
        self.backward = [reverse_dfa(p) for _, p, _ in rules]
        inside = self.forward.inside
        # states in which some rule has a match come last, so one comparison finds them
        order = sorted(range(len(inside)), key=lambda s: bool(inside[s]))
        place = {s: i for i, s in enumerate(order)}
        old = self.forward.step
        numbers = [place[s] << 8 for s in range(len(inside))]
        self.step = [numbers[t >> 8] for s in order for t in old[s << 8 : (s + 1) << 8]]
        self.inside = [inside[s] for s in order]
        self.start = place[self.forward.start >> 8] << 8
        self.first_match = sum(1 for x in inside if not x) << 8

    def _begin(self, rule: int, data: bytes, end: int, floor: int) -> int:
        table, state, best = self.backward[rule], self.backward[rule].start, end
        for i in range(end - 1, floor - 1, -1):
            state = table.step[state + data[i]]
            if not state:
                break
            if table.inside[state >> 8]:
                best = i
        return best

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then by rule; null is the empty text."""
        if not text:
            return []
        data = text.encode("utf-8", "replace")
        step, state, limit = self.step, self.start, self.first_match
        open_at: dict[int, int] = {}
        floor = [0] * len(self.names)
        found: list[tuple[int, int, int]] = []

        def close(rules: list[int]) -> None:
            for rule in rules:
                end = open_at.pop(rule)
                found.append((self._begin(rule, data, end, floor[rule]), rule, end))
                floor[rule] = end

        left = iter(data)
        size = len(data)
        for byte in left:
            state = step[state + byte]
            if state < limit:
                continue
            # rare: some match reaches this byte; follow it until none does
            while state >= limit:
                inside = self.inside[state >> 8]
                close([r for r in open_at if r not in inside])
                at = size - length_hint(left)
                for rule in inside:
                    open_at[rule] = at
                byte = next(left, None)
                if byte is None:
                    break
                state = step[state + byte]
            close(list(open_at))
        kept = [x for x in sorted(found) if self._counts(x, data)]
        if len(data) == len(text):
            return [(self.names[r], a, b) for a, r, b in kept]
        return [(self.names[r], len(data[:a].decode("utf-8")), len(data[:b].decode("utf-8"))) for a, r, b in kept]

    def _counts(self, span: tuple[int, int, int], data: bytes) -> bool:
        begin, rule, end = span
        if self.names[rule] == "assign":
            return assigned_length(data[begin:end]) >= ASSIGN_VALUE
        return end - begin >= self.least[rule]


def assigned_length(match: bytes) -> int:
    """Length of the value of an assignment: what follows the first ``:`` or ``=``, blanks and a quote."""
    separator = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[separator + 1 :].lstrip(b" ")
    return len(rest[1:]) if rest[:1] in (b'"', b"'") else len(rest)


_SCANNER: Scanner | None = None


def scanner() -> Scanner:
    """The compiled rules, once per Python worker."""
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and ``spans``, an array of (kind, start, end) over its whole text.

    Offsets are code points, the end is exclusive; matches of one rule never overlap, those of different rules may.
    A null or empty text has no spans; repeated rows are scanned like any other.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batch):
        scan_text = scanner().spans
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)] for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "spans": spans}

    return map_batches(rows, scan, f"doc_id {id_type}, spans array<struct<kind: string, start: long, end: long>>")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, merged where they overlap, replaced by ``mark``; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for _, start, end in scanner().spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


def redacted(text_col: str) -> Column:
    """``redact`` over a column."""

    @pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        working_as("secrets")
        return texts.map(redact)

    return run(text_col)
