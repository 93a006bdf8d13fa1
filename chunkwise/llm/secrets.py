"""Secret scan with one combined deterministic automaton.

The regexes of all rules are parsed, turned into one nondeterministic
automaton, determinised by subset construction and minimised; its transition
array is indexed by state and byte class.  Each text is read once, byte by
byte, for all rules together.  That pass finds where a rule can first complete
a match (trailing repeats are left out of it, which keeps the automaton
small); the match's place is then settled with two smaller automata of
the rule (reversed: the leftmost start; anchored: the longest end) that are
built the same way.

Matches of a rule are leftmost, longest and do not overlap; a match shorter
than the rule's floors is dropped after it was consumed.  Matches of different
rules are independent.  Every rule here has the property that its first
completed match is its leftmost one, which the pass relies on.

Offsets are code points, end exclusive.  A null text counts as empty; an empty
text or table has no spans.  Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkwise.llm.worker_cache import per_worker


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_length: int = 1  # of the whole match
    min_tail: int = 0  # of what follows the separator (group 2 of an assignment)


BASE_RULES = (
    Rule(
        "assign",
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        min_tail=12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=18),
    Rule("hex", r"[0-9a-f]{16}[0-9a-f]*"),  # runs; shorter ones could never pass
)

EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]+", min_length=26),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", min_length=20),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", min_length=24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_length=40),
    Rule("private_key", r"-----BEGIN ((RSA|DSA|EC|OPENSSH|ENCRYPTED|PGP) )?PRIVATE KEY( BLOCK)?-----"),
    Rule("bearer", r"[bB]earer\x20[A-Za-z0-9._~+/=-]+", min_length=27),
)

RULES = BASE_RULES + EXTRA_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)


# ------------------------------------------------------------ the parser ----
# Syntax: literals, \x.., \., classes, groups, |, and the repeats ? * + {n} {n,} {n,m}.


class _Pattern:
    """Recursive descent over one regex; nodes are tuples ('set', bytes) / ('cat', ..) / ('alt', ..) / ('rep', ..)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.peek()
        self.at += 1
        return c

    def parse(self):
        node = self.alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.peek()!r} in {self.text!r}")
        return node

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeat(self.atom()))
        return ("cat", parts)

    def repeat(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                body, _, rest = self.text[self.at :].partition("}")
                self.at = len(self.text) - len(rest)
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.take()
        if c == "(":
            node = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            return node
        if c == "[":
            return ("set", self.char_class())
        return ("set", frozenset({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            code = int(self.text[self.at : self.at + 2], 16)
            self.at += 2
            return code
        return ord(c)

    def char_class(self) -> frozenset:
        codes: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                c = self.take()
                codes.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                codes.add(low)
        return frozenset(codes)


def _reverse(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if kind == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    if kind == "rep":
        return ("rep", _reverse(node[1]), node[2], node[3])
    return node


def _shortest(node):
    """The tree without its trailing repeats: it completes where a match of ``node`` first can."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if node[0] == "rep" and node[3] is None:
        return ("rep", node[1], node[2], node[2])
    return node


# ---------------------------------------------------------- the automata ----


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Append ``node`` behind ``start``; returns its end state."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                head = self.state()
                self.empty[start].append(head)
                self.empty[self.add(part, head)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            start = self.state()
            self.empty[loop].append(start)
            return start
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(part, start)
        self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + classes[byte]]`` is the next state times ``n_classes``.

    States are ordered so that those without a match come first:
    a value of at least ``first_match`` says that rules match here, and
    ``masks[state]`` which.  Value 0 is the dead state, ``start`` where to begin.
    """

    classes: bytes
    n_classes: int
    step: list[int]
    masks: list[int]
    first_match: int
    start: int


def compile_automaton(nodes: list, unanchored: bool) -> Automaton:
    """One minimal deterministic automaton over the given syntax trees."""
    nfa = _Nfa()
    start = nfa.state()
    accepts: dict[int, int] = {}
    for i, node in enumerate(nodes):
        head = nfa.state()
        nfa.empty[start].append(head)
        accepts[nfa.add(node, head)] = 1 << i
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature: dict[tuple, int] = {}
    classes = bytes(signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256))
    sample = [classes.index(c) for c in range(len(signature))]
    moves = [[[to for chars, to in out if b in chars] for b in sample] for out in nfa.moves]

    first = nfa.closure({start})
    number, order, table = {frozenset(): 0, first: 1}, [frozenset(), first], []
    for states in order:  # grows while it runs: subset construction
        row = []
        for c in range(len(signature)):
            reached = {to for s in states for to in moves[s][c]}
            if unanchored and states:
                reached.add(start)
            target = nfa.closure(reached)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    masks = [functools.reduce(lambda a, s: a | accepts.get(s, 0), states, 0) for states in order]

    block = list(masks)  # minimisation: split blocks until their rows agree
    while True:
        keys = [(block[s], tuple(block[t] for t in table[s])) for s in range(len(order))]
        ids: dict[tuple, int] = {}
        new = [ids.setdefault(k, len(ids)) for k in keys]
        if len(ids) == len(set(block)):
            break
        block = new
    dead = new[0]
    blocks = sorted(set(new), key=lambda b: (b != dead, masks[new.index(b)] != 0, b))
    rank = {b: i for i, b in enumerate(blocks)}
    k = len(signature)
    step, out_masks = [], []
    for b in blocks:
        s = new.index(b)
        step += [rank[new[t]] * k for t in table[s]]
        out_masks.append(masks[s])
    first_match = next((i for i, m in enumerate(out_masks) if m), len(out_masks))
    return Automaton(classes, k, step, out_masks, first_match * k, rank[new[1]] * k)


def compile_rules(rules: tuple[Rule, ...]):
    """(combined automaton, reversed automaton per rule, anchored automaton per rule); once per worker."""
    return per_worker(("rules", *map(repr, rules)), lambda: _compile_rules(rules))


def _compile_rules(rules: tuple[Rule, ...]):
    trees = [_Pattern(r.pattern).parse() for r in rules]
    whole = compile_automaton([_shortest(t) for t in trees], unanchored=True)
    back = [compile_automaton([_reverse(t)], unanchored=False) for t in trees]
    ahead = [compile_automaton([t], unanchored=False) for t in trees]
    return whole, back, ahead


def _longest(auto: Automaton, data: bytes, start: int, stop: int, way: int) -> int:
    """How far from ``start`` towards ``stop`` the longest match of an anchored automaton reaches."""
    state, step, reached = auto.start, auto.step, start
    for i in range(start, stop, way):
        state = step[state + data[i if way > 0 else i - 1]]
        if not state:
            break
        if state >= auto.first_match:
            reached = i + way
    return reached


def _tail_length(match: bytes) -> int:
    """Length of the value of an assignment: key, quote?, blanks, [:=], blanks, quote?, value."""
    at = next(i for i, c in enumerate(match) if c in b":=") + 1
    while match[at : at + 1] == b" ":
        at += 1
    return len(match) - at - (match[at : at + 1] in (b'"', b"'"))


def scan_bytes(data: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in byte offsets, by rule and start."""
    whole, back, ahead = compile_rules(rules)
    coded = data.translate(whole.classes)
    step, first_match, state = whole.step, whole.first_match, whole.start
    first_end: dict[int, list[int]] = {}
    marks = []
    for at, c in enumerate(coded):  # the one pass over the text, for all rules
        state = step[state + c]
        if state >= first_match:
            marks.append((at + 1, state))
    k = whole.n_classes
    for end, s in marks:
        mask = whole.masks[s // k]
        while mask:
            rule = (mask & -mask).bit_length() - 1
            mask &= mask - 1
            first_end.setdefault(rule, []).append(end)
    out = []
    for rule, ends in sorted(first_end.items()):
        floor = 0  # where the previous match ended
        own_back, own_ahead = data.translate(back[rule].classes), data.translate(ahead[rule].classes)
        for end in ends:
            if end <= floor:
                continue
            start = _longest(back[rule], own_back, end, floor, -1)
            if start == end:
                continue  # it began inside the previous match
            stop = _longest(ahead[rule], own_ahead, start, len(data), 1)
            floor = stop
            spec = rules[rule]
            if stop - start >= spec.min_length and (not spec.min_tail or _tail_length(data[start:stop]) >= spec.min_tail):
                out.append((start, stop, rule))
    return out


def scan_text(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in code points, by start, then rule."""
    if not text:
        return []
    data = text.encode("utf-8")
    spans = scan_bytes(data, rules)
    if spans and len(data) != len(text):
        heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        point = lambda b: int(heads[b]) - 1 if b < len(data) else len(text)
        spans = [(point(a), point(b), r) for a, b, r in spans]
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


# ------------------------------------------------------------ the operator ---

SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans): the secret spans of every text; one output row per input row, no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [
                [{"kind": rules[r].kind, "start": a, "end": b} for a, b, r in scan_text(t, rules)] for t in batch["text"]
            ]
            yield pd.DataFrame({"id": batch["id"], "spans": found})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(scan, f"id {kind}, spans {SPAN_TYPE}").withColumnRenamed("id", id_col)


def secret_digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds and the digest columns of a span table."""
    joined = lambda arr: F.concat_ws(
        ",", F.transform(arr, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    )
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        id_col,
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
