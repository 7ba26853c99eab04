"""A generalised LL recogniser with a graph-structured stack.

A grammar is a set of EBNF rules, each compiled to a small automaton whose edges are terminals or
rule calls. The recogniser advances all parses together, one token at a time: a parse is a pair of
an automaton state and a stack node, and stack nodes are shared between parses (one node for each
return state and input position, with as many parents as there are callers), so ambiguity costs
polynomial time and space. What a state does on a token is tabulated on first use, by FIRST and
FOLLOW sets; while there is one parse with one choice the machine runs without any bookkeeping.

The dialects of a language run together in the same stack: what only some of them have stands
behind a gate, and every parse carries the set of dialects that have all it went through, so one
pass over the tokens tells which dialects accept a text. Parses of different sets share no stack
node. Several start rules may run together, too. Rules must not be left recursive.

EBNF: ``name = alternative | alternative ;`` with 'literal', TOKEN, rule, ( ), [ ], and the
suffixes * + ?. ``name !'a' !'b' = ...`` is never entered on the tokens a, b. ``@gate`` before
something that takes a token admits the dialects of that gate.
"""

from __future__ import annotations

import re

_LEX = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+')|([A-Za-z_]\w*)|([=|;()\[\]*+?!])|(@\w+)")


class Grammar:
    def __init__(self, text: str, starts: tuple[str, ...], virtual: tuple[str, ...] = (), dialects: tuple[str, ...] = ("only",), gates: dict[str, tuple[str, ...]] | None = None):
        self.dialects, self.all = dialects, (1 << len(dialects)) - 1
        self.gates = {k: sum(1 << dialects.index(d) for d in v) for k, v in (gates or {}).items()}
        self.gate: list[list[tuple[int, int]]] = []
        self.terms: dict[str, int] = {}
        self.eps: list[list[int]] = []
        self.term: list[list[tuple[int, int]]] = []
        self.call: list[list[tuple[str, int]]] = []
        self.rule_of: list[str] = []
        self.start: dict[str, int] = {}
        self.final: dict[str, int] = {}
        self.never: dict[str, set[int]] = {}
        for v in virtual:
            self.tid(v)
        self._read(text)
        self._sets()
        self.starts = [self.start[s] for s in starts]
        self.moves: list[dict[int, tuple]] = [{} for _ in self.eps]
        self.pops = [self._final_in(s) for s in range(len(self.eps))]
        self.follow_of = [self.follow.get(self.rule_of[s], set()) for s in range(len(self.eps))]

    def tid(self, name: str) -> int:
        return self.terms.setdefault(name, len(self.terms))

    # -- reading the rules ------------------------------------------------------------------
    def _state(self) -> int:
        self.eps.append([])
        self.gate.append([])
        self.term.append([])
        self.call.append([])
        self.rule_of.append(self._now)
        return len(self.eps) - 1

    def _read(self, text: str) -> None:
        toks = [m.group(0) for m in _LEX.finditer(text) if m.lastindex]
        rules, i = [], 0
        while i < len(toks):
            name, i = toks[i], i + 1
            never = []
            while toks[i] == "!":
                never.append(toks[i + 1][1:-1].replace("\\", ""))
                i += 2
            if toks[i] != "=":
                raise ValueError(f"rule {name}: '=' expected, not {toks[i]}")
            end = toks.index(";", i)
            rules.append((name, never, toks[i + 1 : end]))
            i = end + 1
        self.names = {r[0] for r in rules}
        for name, never, body in rules:
            self._now = name
            self.never[name] = {self.tid(n) for n in never}
            self.start[name], self.final[name] = self._state(), self._state()
            self._toks, self._i = body, 0
            a, b = self._alternatives()
            if self._i != len(body):
                raise ValueError(f"rule {name}: stuck at {body[self._i:]}")
            self.eps[self.start[name]].append(a)
            self.eps[b].append(self.final[name])

    def _alternatives(self) -> tuple[int, int]:
        a, b = self._state(), self._state()
        while True:
            x, y = self._sequence()
            self.eps[a].append(x)
            self.eps[y].append(b)
            if self._i < len(self._toks) and self._toks[self._i] == "|":
                self._i += 1
                continue
            return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self._state()
        while self._i < len(self._toks) and self._toks[self._i] not in ("|", ")", "]"):
            x, y = self._item()
            self.eps[b].append(x)
            b = y
        return a, b

    def _item(self) -> tuple[int, int]:
        t = self._toks[self._i]
        self._i += 1
        if t in ("(", "["):
            a, b = self._alternatives()
            self._i += 1
            if t == "[":
                self.eps[a].append(b)
        else:
            a, b = self._state(), self._state()
            if t[0] == "@":
                self.gate[a].append((b, self.gates[t[1:]]))
            elif t[0] == "'":
                self.term[a].append((self.tid(t[1:-1].replace("\\", "")), b))
            elif t in self.names:
                self.call[a].append((t, b))
            else:
                self.term[a].append((self.tid(t), b))
        while self._i < len(self._toks) and self._toks[self._i] in ("*", "+", "?"):
            op, x, y = self._toks[self._i], self._state(), self._state()
            self._i += 1
            self.eps[x].append(a)
            self.eps[b].append(y)
            if op in "*+":
                self.eps[b].append(a)
            if op in "*?":
                self.eps[x].append(y)
            a, b = x, y
        return a, b

    # -- sets -------------------------------------------------------------------------------
    def _closure(self, s: int) -> dict[int, int]:
        """States that ``s`` reaches without a token, each with the dialects that may."""
        seen, todo = {s: self.all}, [s]
        while todo:
            x = todo.pop()
            free = self.eps[x] + [y for n, y in self.call[x] if n in self.nullable]
            for y, g in [(y, self.all) for y in free] + self.gate[x]:
                g &= seen[x]
                if g & ~seen.get(y, 0):
                    seen[y] = seen.get(y, 0) | g
                    todo.append(y)
        return seen

    def _final_in(self, s: int) -> bool:
        return self.final[self.rule_of[s]] in self.close[s]

    def _sets(self) -> None:
        self.nullable: set[str] = set()
        grown = True
        while grown:
            grown = False
            for n in self.names - self.nullable:
                if self.final[n] in self._closure(self.start[n]):
                    self.nullable.add(n)
                    grown = True
        self.close = [self._closure(s) for s in range(len(self.eps))]
        self.first: dict[str, set[int]] = {n: set() for n in self.names}
        grown = True
        while grown:
            grown = False
            for n in self.names:
                got = self._first_of(self.start[n]) - self.never[n]
                if got - self.first[n]:
                    self.first[n] |= got
                    grown = True
        self.follow: dict[str, set[int]] = {n: set() for n in self.names}
        grown = True
        while grown:
            grown = False
            for s in range(len(self.eps)):
                for n, target in self.call[s]:
                    got = self._first_of(target)
                    if self.final[self.rule_of[s]] in self.close[target]:
                        got = got | self.follow[self.rule_of[s]]
                    if got - self.follow[n]:
                        self.follow[n] |= got
                        grown = True

    def _first_of(self, s: int) -> set[int]:
        out = set()
        for c in self.close[s]:
            out |= {t for t, _ in self.term[c]}
            for n, _ in self.call[c]:
                out |= self.first[n]
        return out

    def expand(self, s: int, t: int) -> tuple:
        """All ways to shift ``t`` from state ``s``: (return states pushed, outermost first; new state; dialects)."""
        known = self.moves[s].get(t)
        if known is None:
            self.moves[s][t] = ()  # a left-recursive call would end here
            out: dict[tuple, int] = {}
            for c in sorted(self.close[s]):
                g = self.close[s][c]
                for x, y in self.term[c]:
                    if x == t:
                        out[(), y] = out.get(((), y), 0) | g
                for n, y in self.call[c]:
                    if t in self.first[n]:
                        tail = self._only_final(y)
                        for p, z, h in self.expand(self.start[n], t):
                            way = (p if tail else (y, *p), z)
                            out[way] = out.get(way, 0) | g & h
            known = self.moves[s][t] = tuple((p, z, g) for (p, z), g in out.items() if g)
        return known

    def _only_final(self, s: int) -> bool:
        """After ``s`` its rule only returns, so a call there need not come back (same FOLLOW is kept by the caller)."""
        return self.final[self.rule_of[s]] in self.close[s] and not any(self.term[c] or self.call[c] for c in self.close[s])

    # -- recognising ------------------------------------------------------------------------
    def accepts(self, tokens: list, optional: list[bool] | None = None, inserted: int | None = None) -> tuple[bool, int]:
        """Whether any dialect derives ``tokens``, and how far the longest parse came."""
        got, at = self.accepting(tokens, optional, inserted)
        return got != 0, at

    def accepting(self, tokens: list, optional: list[bool] | None = None, inserted: int | None = None) -> tuple[int, int]:
        """The set of dialects (bits) whose start rules derive ``tokens`` (each a terminal, or a tuple of those
        it may be), and how far the longest parse came. Before a token marked ``optional``, the terminal
        ``inserted`` may be put where no parse could go on otherwise."""
        live = self.all
        state, node, many = (self.starts[0], None, None) if len(self.starts) == 1 else (0, None, {(s, live): [None] for s in self.starts})
        moves, pops, follow, expand = self.moves, self.pops, self.follow_of, self.expand
        for i, t in enumerate(tokens):
            if many is None and t.__class__ is int:
                s, n = state, node
                while True:
                    mv = moves[s].get(t)
                    if mv is None:
                        mv = expand(s, t)
                    back = pops[s] and t in follow[s]
                    if back and not mv and n is not None and len(n) == 2:
                        s, n = n[0], n[1]
                        continue
                    break
                if len(mv) == 1 and not back and mv[0][2] & live:
                    pushed, state, g = mv[0]
                    live &= g
                    for r in pushed:
                        n = [r, n]
                    node = n
                    continue
            now = many if many is not None else {(state, live): [node]}
            new = self._step(now, t)
            if not new and optional is not None and optional[i]:
                mid = self._step(now, inserted)
                new = self._step(mid, t) if mid else mid
            if not new:
                return 0, i
            many = new
            if len(new) == 1:
                ((state, live), nodes), = new.items()
                if len(nodes) == 1:
                    node, many = nodes[0], None
        now = many if many is not None else {(state, live): [node]}
        got = self._ends(now)
        if not got and optional is not None and len(optional) > len(tokens) and optional[len(tokens)]:
            mid = self._step(now, inserted)
            got = self._ends(mid) if mid else 0
        return got, len(tokens)

    def _step(self, now: dict[tuple[int, int], list], t) -> dict[tuple[int, int], list]:
        new: dict[tuple[int, int], list] = {}
        shared: dict[tuple[int, int], list] = {}
        done = set()
        for tid in t if t.__class__ is tuple else (t,):
            todo = [(s, live, n) for (s, live), nodes in now.items() for n in nodes]
            while todo:
                s, live, n = todo.pop()
                if (s, live, id(n), tid) in done:
                    continue
                done.add((s, live, id(n), tid))
                for pushed, z, g in self.expand(s, tid):
                    g &= live
                    if not g:
                        continue
                    m = n
                    for r in pushed:
                        up = shared.get((r, g))
                        if up is None:
                            up = shared[r, g] = [r, m]
                        elif not any(x is m for x in up[1:]):
                            up.append(m)
                        m = up
                    nodes = new.setdefault((z, g), [])
                    if not any(x is m for x in nodes):
                        nodes.append(m)
                if n is not None and self.pops[s] and tid in self.follow_of[s]:
                    todo += [(n[0], live, p) for p in n[1:]]
        return new

    def _ends(self, now: dict[tuple[int, int], list]) -> int:
        todo, done, got = [(s, live, n) for (s, live), nodes in now.items() for n in nodes], set(), 0
        while todo:
            s, live, n = todo.pop()
            if (s, live, id(n)) in done or not self.pops[s]:
                continue
            done.add((s, live, id(n)))
            if n is None:
                got |= live
            else:
                todo += [(n[0], live, p) for p in n[1:]]
        return got
