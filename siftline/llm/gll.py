"""Generalised LL recognition with a graph-structured stack, remembered as it goes.

A grammar is a set of rules in EBNF; each becomes a small automaton whose edges read a token, call a rule, or
enter a pair of brackets.  Recognition keeps every descriptor (place in an automaton, node of the stack) that
is alive after the tokens read so far.  Calls of one rule at one position share a node, whose edges say where
each caller goes on: that is the graph-structured stack, and with it every reading of an ambiguous text, and
every dialect among the start rules, is followed at once.

Two things make it fast.  Stacks are cut at brackets: what lies between brackets is recognised relative to
them, as the sets of inner rules that are alive and, at the closing bracket, of those that are complete.  And
nodes and sets of descriptors are stored once and compared by identity, independent of the place in a text, so
that each set's step by a run of tokens is computed once per process and found in a dictionary thereafter.
Rules may be left recursive: a call at a place where the same rule is being called adds an edge to the node that
is there, and nodes that so call each other in a circle are stored together.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:#[^\n]*)?\s*('[^']*'|[A-Za-z_][A-Za-z_0-9]*|[][{}()|=;])")
BRACKETS = {"(": ")", "[": "]", "{": "}", "\x01": "\x02"}  # the last pair: indent and dedent
CLOSERS = {v: k for k, v in BRACKETS.items()}
#: States, nodes and runs that a process remembers, about 150 MB, and the tokens of the longest run among them.
MOST_KEPT, LONGEST_KEPT = 500_000, 256


class Rule:
    __slots__ = ("body", "name", "start")

    def __init__(self, name: str):
        self.name, self.start, self.body = name, None, None


class Place:
    """A place in a rule's automaton; ``skips`` are silent steps, ``end`` marks the rule's end."""

    __slots__ = ("calls", "end", "opens", "ready", "skips", "terms")

    def __init__(self) -> None:
        self.terms, self.calls, self.opens, self.skips, self.end, self.ready = [], [], [], [], False, False

    def settle(self) -> Place:
        """Takes in what lies behind silent steps."""
        if not self.ready:
            seen, todo = {id(self)}, list(self.skips)
            while todo:
                p = todo.pop()
                if id(p) not in seen:
                    seen.add(id(p))
                    todo += p.skips
                    self.end |= p.end
                    if p.ready:
                        self.terms += [x for x in p.terms if x not in self.terms]
                        self.calls += [x for x in p.calls if x not in self.calls]
                        self.opens += [x for x in p.opens if x not in self.opens]
                    else:
                        self.terms += p.terms
                        self.calls += p.calls
                        self.opens += p.opens
            self.skips, self.ready = [], True
        return self


class Node:
    """A node of the stack: a call of ``rule`` and where its callers go on. Equal nodes are one object."""

    __slots__ = ("edges", "popped", "rule")

    def __init__(self, rule: Rule, edges=()):  # noqa: ANN001
        self.rule, self.edges, self.popped = rule, edges, False


class State:
    """A set of descriptors waiting for tokens, relative to the innermost open bracket."""

    __slots__ = ("after", "done", "inner", "opens", "runs", "terms")

    def __init__(self, terms: dict, opens: dict, done: frozenset):
        self.terms, self.opens, self.done = terms, opens, done
        self.after: dict = {}
        self.inner: dict = {}
        self.runs: dict = {}


class Grammar:
    """``text`` in EBNF: ``name = 'literal' CLASS rule [optional] {repeated} (a | b) ;``.  ``kinds`` maps literals
    and classes to one character each."""

    def __init__(self, text: str, kinds: dict[str, str]):
        self.kinds, self.rules = kinds, {}
        self.nodes: dict = {}
        self.states: dict = {}
        self.starts: dict = {}
        self.circles: dict = {}
        self.size = 0
        self._read(text)
        for r in list(self.rules.values()):
            if r.body is None:
                raise ValueError(f"no rule {r.name}")
            r.start, end = self._build(r.body)
            end.end = True

    # -- reading ------------------------------------------------------------------------------------------
    def _rule(self, name: str) -> Rule:
        return self.rules.setdefault(name, Rule(name))

    def _read(self, text: str) -> None:
        toks, at = [], 0
        while m := _TOKEN.match(text, at):
            toks.append(m[1])
            at = m.end()
        if re.sub(r"#[^\n]*", "", text[at:]).strip():
            raise ValueError(f"unreadable grammar at {text[at : at + 40]!r}")
        self._toks, self._i = toks, 0
        while self._i < len(toks):
            rule = self._rule(toks[self._i])
            assert toks[self._i + 1] == "=", toks[self._i : self._i + 3]
            self._i += 2
            rule.body = self._alternatives(rule.name)
            assert toks[self._i] == ";", (rule.name, toks[self._i])
            self._i += 1

    def _alternatives(self, owner: str) -> tuple:
        out = [self._sequence(owner)]
        while self._toks[self._i] == "|":
            self._i += 1
            out.append(self._sequence(owner))
        return ("alt", out)

    def _sequence(self, owner: str) -> tuple:
        items: list = []
        stack: list = []
        while (t := self._toks[self._i]) not in ("|", ";", ")", "]", "}"):
            self._i += 1
            if t in ("[", "{", "("):
                body = self._alternatives(owner)
                assert self._toks[self._i] == {"[": "]", "{": "}", "(": ")"}[t]
                self._i += 1
                item = ({"[": "opt", "{": "rep", "(": "one"}[t], body)
            elif t[0] == "'" or t.isupper():
                kind = self.kinds[t[1:-1] if t[0] == "'" else t]
                if kind in BRACKETS:
                    stack.append((kind, items))
                    items = []
                    continue
                if kind in CLOSERS:
                    opener, outer = stack.pop()
                    assert BRACKETS[opener] == kind, owner
                    inner = self._rule(f"{owner}{opener}{len(self.rules)}")
                    inner.body = ("alt", [("seq", items)])
                    items = outer
                    item = ("open", opener, inner)
                else:
                    item = ("term", kind)
            else:
                item = ("call", self._rule(t))
            items.append(item)
        assert not stack, f"open bracket in {owner}"
        return ("seq", items)

    def _build(self, x: tuple) -> tuple[Place, Place]:
        a, b = Place(), Place()
        if x[0] == "alt":
            for y in x[1]:
                s, e = self._build(y)
                a.skips.append(s)
                e.skips.append(b)
        elif x[0] == "seq":
            last = a
            for y in x[1]:
                s, e = self._build(y)
                last.skips.append(s)
                last = e
            last.skips.append(b)
        elif x[0] == "term":
            a.terms.append((x[1], b))
        elif x[0] == "call":
            a.calls.append((x[1], b))
        elif x[0] == "open":
            a.opens.append((x[1], x[2], b))
        else:
            s, e = self._build(x[1])
            a.skips.append(s)
            e.skips.append(b)
            if x[0] in ("opt", "rep"):
                a.skips.append(b)
            if x[0] == "rep":
                e.skips.append(s)
        return a, b

    # -- recognising --------------------------------------------------------------------------------------
    def start(self, rules: frozenset) -> State:
        """The state before the first token of any of the rules (names, or Rule objects between brackets)."""
        if (s := self.starts.get(rules)) is None:
            self.size += 1
            rules_ = [self.rules[r] if isinstance(r, str) else r for r in rules]
            s = self.starts[rules] = self._close([(r.start, self._node(r, frozenset())) for r in rules_])
        return s

    def _node(self, rule: Rule, edges: frozenset) -> Node:
        key = (rule, edges)
        if (n := self.nodes.get(key)) is None:
            self.size += 1
            n = self.nodes[key] = Node(rule, edges)
        return n

    def _close(self, descriptors: list[tuple[Place, Node]]) -> State | None:
        """Follows calls and returns until every descriptor waits for a token."""
        seen: set = set()
        new: dict[Rule, Node] = {}
        waiting: list = []
        entering: list = []
        done: set = set()
        todo = list(descriptors)
        while todo:
            d = todo.pop()
            if d in seen:
                continue
            seen.add(d)
            place, node = d
            if not place.ready:
                place.settle()
            for kind, to in place.terms:
                waiting.append((kind, to, node))
            for kind, inner, to in place.opens:
                entering.append((kind, inner, to, node))
            for rule, to in place.calls:
                called = new.get(rule)
                if called is None:
                    called = new[rule] = Node(rule, set())
                    todo.append((rule.start, called))
                edge = (to, node)
                if edge not in called.edges:
                    called.edges.add(edge)
                    if called.popped:  # it has already ended here, having read nothing
                        todo.append(edge)
            if place.end:
                if isinstance(node.edges, set):
                    node.popped = True
                if node.edges:
                    todo.extend(node.edges)
                elif not isinstance(node.edges, set):
                    done.add(node.rule)
        frozen = self._stored([x[-1] for x in (*waiting, *entering)])
        items = frozenset((*x[:-1], frozen.get(x[-1], x[-1])) for x in (*waiting, *entering))
        key = (items, frozenset(done))
        if not items and not done:
            return None
        if (s := self.states.get(key)) is None:
            self.size += 1
            terms: dict = {}
            opens: dict = {}
            for x in items:
                if len(x) == 3:
                    terms.setdefault(x[0], []).append((x[1], x[2]))
                else:
                    opens.setdefault(x[0], []).append((x[1], x[2], x[3]))
            s = self.states[key] = State(terms, opens, frozenset(done))
        return s

    def _stored(self, nodes: list[Node]) -> dict[Node, Node]:
        """The stored equals of new nodes and of those they go on to; circles of calls at once (Tarjan's components)."""
        frozen: dict[Node, Node] = {}
        index: dict[Node, int] = {}
        low: dict[Node, int] = {}
        open_: list[Node] = []

        def visit(n: Node) -> None:
            index[n] = low[n] = len(index)
            open_.append(n)
            for _, p in n.edges:
                if isinstance(p.edges, set):
                    if p not in index:
                        visit(p)
                        low[n] = min(low[n], low[p])
                    elif p not in frozen:
                        low[n] = min(low[n], index[p])
            if low[n] == index[n]:
                at = open_.index(n)
                circle = open_[at:]
                del open_[at:]
                if len(circle) == 1 and all(p is not n for _, p in n.edges):
                    frozen[n] = self._node(n.rule, frozenset((to, frozen.get(p, p)) for to, p in n.edges))
                else:
                    store(circle)

        def store(circle: list[Node]) -> None:
            inside = set(circle)  # at one place a rule has one node, so that rules name the circle's own
            key = frozenset((x.rule, frozenset((to, p.rule if p in inside else frozen.get(p, p)) for to, p in x.edges)) for x in circle)
            if (known := self.circles.get(key)) is None:
                self.size += len(circle)
                known = self.circles[key] = {x.rule: Node(x.rule) for x in circle}
                for x in circle:
                    known[x.rule].edges = frozenset((to, known[p.rule] if p in inside else frozen.get(p, p)) for to, p in x.edges)
            frozen.update((x, known[x.rule]) for x in circle)

        for n in nodes:
            if isinstance(n.edges, set) and n not in index:
                visit(n)
        return frozen

    def token(self, s: State, kind: str) -> State | None:
        found = s.terms.get(kind)
        return self._close(found) if found else None

    def enter(self, s: State, bracket: str) -> State | None:
        if bracket not in s.inner:
            found = s.opens.get(bracket)
            s.inner[bracket] = self.start(frozenset(i for i, _, _ in found)) if found else None
        return s.inner[bracket]

    def leave(self, outer: State, bracket: str, done: frozenset) -> State | None:
        key = (bracket, done)
        if key not in outer.after:
            found = [(to, n) for i, to, n in outer.opens[bracket] if i in done]
            outer.after[key] = self._close(found) if found else None
        return outer.after[key]

    def run(self, s: State, kinds: str) -> tuple[tuple, State] | None | bool:
        """Steps over a run of tokens that may open brackets and close them again: the states it leaves open
        and the last one. None: rejected. False: it closes a bracket that it did not open."""
        if (r := s.runs.get(kinds, 0)) != 0:
            return r
        stack: list = []
        now: State | None = s
        out: tuple[tuple, State] | None | bool = None
        for k in kinds:
            if k in BRACKETS:
                inner = self.enter(now, k)
                stack.append((now, k))
                now = inner
            elif k in CLOSERS:
                if not stack:
                    out = False
                    break
                outer, opener = stack.pop()
                now = self.leave(outer, opener, now.done) if opener == CLOSERS[k] and now.done else None
            else:
                if k not in now.runs:
                    nxt = self.token(now, k)
                    now.runs[k] = ((), nxt) if nxt is not None else None
                r = now.runs[k]
                now = r[1] if r else None
            if now is None:
                break
        else:
            out = (tuple(stack), now)
        if len(kinds) <= LONGEST_KEPT:
            self.size += 1
            s.runs[kinds] = out
        return out

    def accepts(self, starts: frozenset, chunks: list[str]) -> bool:
        """Whether the tokens, given in runs, are a text of one of the start rules."""
        if self.size > MOST_KEPT:  # what is remembered has a bound; it builds up again
            self.nodes, self.states, self.starts, self.circles, self.size = {}, {}, {}, {}, 0
        now = self.start(starts)
        stack: list = []
        for chunk in chunks:
            r = now.runs.get(chunk, 0)
            if r == 0:
                r = self.run(now, chunk)
            if r:
                if r[0]:
                    stack.extend(r[0])
                now = r[1]
                continue
            if r is None:
                return False
            for k in chunk:
                if k in CLOSERS:
                    if not stack:
                        return False
                    outer, opener = stack.pop()
                    if opener != CLOSERS[k] or not now.done:
                        return False
                    now = self.leave(outer, opener, now.done)
                    if now is None:
                        return False
                else:
                    r = self.run(now, k)
                    if not r:
                        return False
                    stack.extend(r[0])
                    now = r[1]
        return not stack and bool(now.done)
