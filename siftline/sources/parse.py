"""Facts of source files: functions, calls, allocations, variables, entry points and the nodes that rules
start from, one row each, in one pass over the texts.

Python files are read with the standard parser, falling back to their lines when they do not parse; the other
languages by tokens and matching brackets, so that broken files still give what can be seen.
"""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Calls that allocate and free, where programs start, and marks of input from outside.
ALLOCATING = {"c": {"malloc", "calloc", "realloc"}, "cpp": {"new"}, "go": {"make", "new"}}
FREEING = {"c": {"free"}, "cpp": {"delete", "delete[]", "free"}}
ENTRIES = {"c": {"main"}, "cpp": {"main"}, "java": {"main"}, "go": {"main", "init"}, "python": {"main"}}
EXTERN = {
    "c": ("scanf", "gets", "fgets", "argv", "stdin", "read(", "recv("),
    "cpp": ("std::cin", "cin", "scanf", "gets", "argv", "read("),
    "java": ("Scanner", "System.in", "HttpRequest", "HttpServletRequest", "args"),
    "go": ("os.Args", "bufio.NewReader", "fmt.Scan", "http.Request", "os.Stdin"),
    "python": ("input(", "sys.stdin", "open(", "request", "argv"),
}

_TOKENS = {
    g: re.compile(
        r'//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<line>(?m:^[ \t]*\#(?:[^\n\\]|\\.)*))|(?P<str>"""(?:[^\\]|\\.)*?"""|(?:R"\((?:.*?)\)"|"(?:[^"\\\n]|\\.)*"?)' + ("|`[^`]*`?" if g == "go" else "") + r"|'(?:[^'\\\n]|\\.)*'?)"
        r"|(?P<word>[^\W\d][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|:=|\+\+|--|[-+*/%&|^=!<>]=|&&|\|\||<<|[^\s\w])|(?P<nl>\n)|\s+",
        re.S,
    )
    for g in ("c", "cpp", "java", "go")
}
_NOT_CALLED = frozenset("if for while switch return sizeof catch else do case new delete throw func go defer range select synchronized try using template static_cast dynamic_cast const_cast reinterpret_cast alignof decltype noexcept operator typeid assert super this void int char long short float double bool import const type var package".split())
_TYPES = frozenset("int char long short float double unsigned signed void const static struct auto bool size_t final var boolean byte volatile register enum union wchar_t".split())
_LOOPS = frozenset(("for", "while", "do"))
_CLOSE = {"(": ")", "[": "]", "{": "}"}

COLUMNS = {
    "kind": pa.string(), "ord": pa.int32(), "name": pa.string(), "fn": pa.string(), "line": pa.int32(), "end_line": pa.int32(), "args": pa.list_(pa.string()), "type": pa.string(),
    "is_entry": pa.bool_(), "extern_input": pa.bool_(), "loop_depth": pa.int32(), "pointer_ops": pa.int32(), "freed": pa.bool_(), "free_line": pa.int32(),
    "is_pointer": pa.bool_(), "is_array": pa.bool_(), "array_size": pa.int32(), "reachable": pa.bool_(), "call_depth": pa.int32(), "calls": pa.list_(pa.string()), "depth": pa.int32(),
}
SCHEMA = (
    "kind string, ord int, name string, fn string, line int, end_line int, args array<string>, type string, is_entry boolean, extern_input boolean, loop_depth int, pointer_ops int, "
    "freed boolean, free_line int, is_pointer boolean, is_array boolean, array_size int, reachable boolean, call_depth int, calls array<string>, depth int"
)


class File:
    """What is gathered of one file."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.functions: dict[str, dict] = {}
        self.calls: list[dict] = []
        self.allocations: list[dict] = []
        self.variables: list[dict] = []
        self.entries: list[str] = []
        self.nodes: list[dict] = []
        self.error: str | None = None

    def function(self, name: str, line: int, **more) -> dict:  # noqa: ANN003
        f = {"name": name, "line": line, "end_line": line, "args": [], "type": None, "is_entry": False, "loop_depth": 0, "pointer_ops": 0, "calls": [], "extern_input": False} | more
        if not (more.get("keep_first") and name in self.functions):
            self.functions[name] = f  # of one name the last counts
        return f

    def call(self, caller: str, callee: str, line: int, args: list[str]) -> None:
        self.calls.append({"name": callee, "fn": caller, "line": line, "args": args})
        if (f := self.functions.get(caller)) is not None and callee not in f["calls"]:
            f["calls"].append(callee)
        if callee in ALLOCATING.get(self.language, ()):
            self.allocations.append({"name": callee, "fn": caller, "line": line, "freed": self.language == "go", "free_line": None})
        if callee in FREEING.get(self.language, ()) and args:
            for a in self.allocations:  # the earliest that is still open, whatever its variable
                if a["fn"] == caller and not a["freed"]:
                    a["freed"], a["free_line"] = True, line
                    break

    def node(self, type_: str, line: int, name: str | None = None, depth: int = 0) -> None:
        self.nodes.append({"type": type_, "line": line, "name": name, "depth": depth})

    # -- of the calls within the file ---------------------------------------------------------------------
    def reached(self) -> set[str]:
        callees: dict[str, list[str]] = {}
        for c in self.calls:
            callees.setdefault(c["fn"], []).append(c["name"])
        seen, todo = set(self.entries), deque(self.entries)
        while todo:
            for c in callees.get(todo.popleft(), ()):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        return seen

    def depth_below(self, name: str) -> int:
        """Depth of calls below a function, each function counted where it is met first: the order of calls
        decides, so it is not the longest path."""
        visited: set[str] = set()
        deepest, todo = 0, [(name, 0)]
        visited.add(name)
        while todo:
            at, d = todo.pop()
            deepest = max(deepest, d)
            for c in reversed(self.functions.get(at, {}).get("calls", ())):
                if c in self.functions and c not in visited:
                    visited.add(c)
                    todo.append((c, d + 1))
        return deepest

    def rows(self) -> Iterator[tuple[str, list[dict]]]:
        """The facts by kind."""
        reached = self.reached()
        functions = [f | {"fn": f["name"], "reachable": f["name"] in reached, "call_depth": self.depth_below(f["name"])} for f in self.functions.values()]
        yield from (("function", functions), ("call", self.calls), ("allocation", self.allocations), ("variable", self.variables), ("node", self.nodes))
        yield "entry", [{"name": e} for e in dict.fromkeys(self.entries)]
        yield "error", [{"name": self.error}] if self.error else []


def _tokens(text: str, language: str) -> list[tuple[str, str, int]]:
    out, line = [], 1
    for m in _TOKENS[language].finditer(text):
        kind = m.lastgroup
        t = m[0]
        if kind == "nl":
            line += 1
        else:
            if kind in ("str", "word", "num", "op"):
                out.append((kind, t, line))
            line += t.count("\n")
    return out


def _arguments(toks: list, i: int, close: int) -> list[str]:
    out, depth, part = [], 0, []
    for _, t, _ in toks[i + 1 : close]:
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
        if t == "," and depth == 0:
            out.append(_text(part))
            part = []
        else:
            part.append(t)
    return [*out, _text(part)] if part or out else []


def _text(parts: list[str]) -> str:
    s = ""
    for p in parts:
        s += (" " if s and (s[-1].isalnum() or s[-1] == "_") and (p[0].isalnum() or p[0] == "_") else "") + p
    return s


def _braced(text: str, language: str) -> File:
    f = File(text, language)
    toks = _tokens(text, language)
    n = len(toks)
    match, stack = [-1] * n, []
    for i, (_, t, _) in enumerate(toks):
        if t in _CLOSE:
            stack.append(i)
        elif t in (")", "]", "}"):
            if stack and _CLOSE[toks[stack[-1]][1]] == t:
                match[stack.pop()] = i
    for i in stack:
        match[i] = n
    last_line = text.count("\n") + 1
    line_of = lambda i: toks[i][2] if i < n else last_line
    source = text.split("\n")
    start, ends, where = 0, [], []  # first token of the statement; open functions; loops within them
    loops: list[int] = []
    i = 0
    while i < n:
        kind, t, line = toks[i]
        while ends and i > ends[-1]:
            ends.pop()
            where.pop()
        while loops and i > loops[-1]:
            loops.pop()
        fn = where[-1] if where else None
        if t in ("{", "}", ";"):
            start = i + 1
        if kind == "word":
            nxt = toks[i + 1][1] if i + 1 < n else ""
            before = toks[i - 1][1] if i else ""
            if t in _LOOPS and fn is not None and not (t == "while" and before == "}"):
                body = match[i + 1] + 1 if nxt in ("(",) and match[i + 1] >= 0 else i + 1
                if language == "go" and (body := _go_body(toks, match, i, n)) == n:
                    body = i + 1
                end = match[body] if body < n and toks[body][1] == "{" else next((k for k in range(body, n) if toks[k][1] == ";"), n)
                loops.append(end)
                f.functions[fn]["loop_depth"] = max(f.functions[fn]["loop_depth"], len(loops))
            if language == "go" and t == "func" and i + 1 < n:
                k = match[i + 1] + 1 if nxt == "(" and match[i + 1] >= 0 else i + 1
                method = k != i + 1
                if k + 1 < n and toks[k][0] == "word" and toks[k + 1][1] == "(" and match[k + 1] >= 0:
                    body = _go_body(toks, match, match[k + 1], n)
                    if body < n:
                        name = toks[k][1]
                        _open(f, name, line, line_of(match[body]), source, method and name in f.functions, _arguments(toks, k + 1, match[k + 1]), None, method)
                        ends.append(match[body])
                        where.append(name)
                        i = body
                        start = i + 1
                        loops = []
                        continue
            if nxt == "(" and match[i + 1] >= 0 and t not in _NOT_CALLED:
                close = match[i + 1]
                body = _body(toks, match, close, n, language) if language != "go" else -1
                defines = body >= 0 and (fn is None or language in ("java", "cpp") and not ends) and before not in (".", "->", "new", "=", "return", ",", "(") and (i > start or language in ("java", "cpp"))
                if defines:
                    first, k = start, i
                    name = t
                    while language == "cpp" and k >= 2 and toks[k - 1][1] == "::" and toks[k - 2][0] == "word":
                        k -= 2
                        name = toks[k][1] + "::" + name
                    while first < i and toks[first][1] in ("public", "private", "protected") and first + 1 < n and toks[first + 1][1] == ":":
                        first += 2
                    type_ = _text([x for _, x, _ in toks[first:k] if x != "*"])
                    _open(f, name, line_of(first), line_of(match[body]), source, False, _arguments(toks, i + 1, close), type_, False)
                    ends.append(match[body])
                    where.append(name)
                    i = body
                    start = i + 1
                    loops = []
                    continue
                k, chain = i, t
                while language != "java" and k >= 2 and toks[k - 1][1] in (".", "->", "::") and toks[k - 2][0] == "word":
                    chain = toks[k - 2][1] + toks[k - 1][1] + chain
                    k -= 2
                declared = language in ("c", "cpp") and before not in (".", "->") and k > start and toks[k - 1][0] == "word" and toks[k - 1][1] not in ("return", "else", "do", "throw", "case", "co_return") or language == "java" and before == "new"
                type_ = "method_invocation" if language == "java" else "call_expression"
                if not declared:
                    f.node(type_, line_of(k), chain, len(ends))
                    if fn is not None:
                        f.call(fn, chain, line_of(k), _arguments(toks, i + 1, close) if language in ("c", "cpp") else [])
            if t == "new" and language in ("cpp", "java"):
                f.node("new_expression" if language == "cpp" else "object_creation_expression", line)
                if fn is not None and language == "cpp":
                    f.allocations.append({"name": "new", "fn": fn, "line": line, "freed": False, "free_line": None})
            if t == "unsafe" and nxt == ".":
                f.node("qualified_type", line)
                if fn is not None and language == "go":
                    f.functions[fn]["pointer_ops"] += 1
            if language == "go" and t == "os" and nxt == ".":
                f.node("selector_expression", line)
            if language == "go" and t == "var":
                f.node("var_declaration", line)
        if i == start and fn is not None and kind == "word" and language in ("c", "cpp", "java"):
            _declares(f, toks, i, n, match, fn, language)
            if language == "cpp":
                f.node("expression_statement", line)
        elif i == start and (kind == "word" or t == "@") and language == "java":
            if _assigned(toks, match, i, n):
                f.node("field_declaration", line)
        if t == ":=" and fn is not None:
            f.node("short_var_declaration", line)
            k = i
            while k > start and toks[k - 1][2] == line and (toks[k - 1][0] == "word" or toks[k - 1][1] == ",") and toks[k - 1][1] not in ("for", "if", "switch", "case"):
                k -= 1
            f.variables.append({"name": _text([x for _, x, _ in toks[k:i]]) or "?", "type": "inferred", "fn": fn, "line": line, "is_pointer": False, "is_array": False, "array_size": None})
        if language in ("c", "cpp") and fn is not None and i:
            before = toks[i - 1]
            unary = t in ("*", "&") and (before[0] == "op" and before[1] not in (")", "]", ".") or before[1] in ("return", "=")) and i + 1 < n and toks[i + 1][0] in ("word", "op")
            subscript = t == "[" and before[0] == "word" and not (i - 1 > start and toks[i - 2][0] == "word")
            if unary or subscript:
                f.functions[fn]["pointer_ops"] += 1
                if unary:
                    f.node("pointer_expression", line)
            if t == "->":
                f.node("field_expression", line)
        i += 1
    return f


def _open(f: File, name: str, line: int, end: int, source: list[str], keep: bool, args: list[str], type_: str | None, method: bool) -> None:
    text = "\n".join(source[line - 1 : end])
    entry = name.split("::")[-1] in ENTRIES[f.language] and not method
    f.function(name, line, end_line=end, args=args, type=type_, is_entry=entry, extern_input=any(k in text for k in EXTERN[f.language]), keep_first=keep)
    if entry:
        f.entries.append(name)


def _body(toks: list, match: list[int], close: int, n: int, language: str) -> int:
    """The opening brace of a definition whose parameters end at ``close``, or -1."""
    k = close + 1
    if language == "java":
        while k < n and toks[k][1] == "[" and 0 <= match[k] < n:
            k = match[k] + 1
        if k < n and toks[k][1] == "throws":
            while k < n and (toks[k][0] == "word" or toks[k][1] in (".", ",", "<", ">", "@")):
                k += 1
    elif language == "cpp":
        if k < n and toks[k][1] not in ("{", "const", "volatile", "noexcept", "override", "final", ":", "->", "&", "&&", "try", "throw", "requires"):
            return -1
        while k < n and (t := toks[k][1]) != "{":
            if t == ":":
                return _initialised(toks, match, k + 1, n)
            if t in (";", "}", ")", "]", ",", "="):
                return -1
            k = match[k] + 1 if t in ("(", "[") and match[k] >= 0 else k + 1
    return k if k < n and toks[k][1] == "{" else -1


def _initialised(toks: list, match: list[int], k: int, n: int) -> int:
    """The opening brace after the initialisers of a constructor that start at ``k``, or -1."""
    while k < n and (toks[k][0] == "word" or toks[k][1] == "::"):
        while k < n and (toks[k][0] == "word" or toks[k][1] in ("::", "<")):
            k = _angles(toks, k, n) if toks[k][1] == "<" else k + 1
        if k >= n or toks[k][1] not in ("(", "{") or not 0 <= match[k] < n:
            return -1
        k = match[k] + 1
        while k < n and toks[k][1] == ".":
            k += 1
        if k < n and toks[k][1] == "{":
            return k
        if k >= n or toks[k][1] != ",":
            return -1
        k += 1
    return -1


def _angles(toks: list, k: int, n: int) -> int:
    """The place after the angle brackets that open at ``k``; n if the statement ends before they close."""
    depth = 0
    while k < n and (t := toks[k][1]) not in (";", "{", "}"):
        depth += (t == "<") - (t == ">")
        k += 1
        if depth == 0:
            return k
    return n


def _go_body(toks: list, match: list[int], k: int, n: int) -> int:
    """The opening brace of the Go function or loop whose header goes on at ``k``, or n.  Brackets are jumped
    over; as in the language, a line end after an operand ends the header."""
    while k < n:
        t, end = toks[k][1], k
        if t == "}" or t == "{" and match[k] < 0:
            return n
        if t == "{":
            end = match[k]
            if toks[k - 1][1] not in ("interface", "struct") and not (end + 1 < n and toks[end + 1][1] == "{" and toks[end + 1][2] == toks[end][2]):
                return k  # neither a type nor a literal before the body
        elif t in ("(", "[") and match[k] >= 0:
            end = match[k]
        if end + 1 < n and toks[end + 1][2] > toks[end][2] and (toks[end][0] != "op" or toks[end][1] in (")", "]", "}")):
            return n
        k = end + 1
    return n


def _assigned(toks: list, match: list[int], k: int, n: int) -> bool:
    """Whether the Java declaration that starts at ``k`` is a field with a value."""
    while k < n and (t := toks[k][1]) not in (";", "{", "}"):
        if t == "=":
            return True
        if t == "(":
            at = k - 1
            while at >= 2 and toks[at - 1][1] == ".":
                at -= 2
            if match[k] < 0 or toks[at - 1][1] != "@":
                return False
            k = match[k]
        k += 1
    return False


def _declares(f: File, toks: list, i: int, n: int, match: list[int], fn: str, language: str) -> None:
    """A declaration of variables at a statement's start."""
    k = i
    while k < n and (toks[k][0] == "word" and (toks[k][1] in _TYPES or k + 1 < n and (toks[k + 1][0] == "word" or toks[k + 1][1] in ("*", "&", "<", "::", "[")))):
        if toks[k][1] in ("return", "if", "else", "delete", "throw", "case", "goto", "new", "using", "break", "continue", "do", "while", "for", "switch"):
            return
        k += 1
        while k + 1 < n and (toks[k][1] in ("::", "<") or toks[k][1] == "[" and toks[k + 1][1] == "]"):
            k = _angles(toks, k, n) if toks[k][1] == "<" else k + 2
        if k >= n:
            return
        stars = k
        while k < n and toks[k][1] in ("*", "&"):
            k += 1
        after = toks[k + 1][1] if k + 1 < n else ""
        if k < n and toks[k][0] == "word" and toks[k][1] not in _TYPES and after in ("=", ";", "[", ",", "(") and k > i and not (after == "(" and language != "cpp"):
            type_ = _text([x for _, x, _ in toks[i:stars]])
            size = int(toks[k + 2][1]) if after == "[" and k + 2 < n and toks[k + 2][1].isdigit() else None
            array = after == "[" and language != "java" or language == "java" and "[]" in type_
            f.variables.append({"name": toks[k][1], "type": type_, "fn": fn, "line": toks[i][2], "is_pointer": k > stars, "is_array": array, "array_size": size})
            f.node("local_variable_declaration" if language == "java" else "declaration", toks[i][2])
            return
        if k == stars and not (k < n and toks[k][0] == "word"):
            return


def _python(text: str) -> File:
    f = File(text, "python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        f.error = type(e).__name__
        return _python_lines(f)
    lines = text.split("\n")

    def visit(node: ast.AST, fn: str | None, depth: int) -> None:
        todo: list = [(node, fn, depth)]
        while todo:
            node, fn, depth = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                a = node.args
                args = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                f.function(node.name, node.lineno, end_line=node.end_lineno, args=args, loop_depth=_loop_depth(node), extern_input=any(k in body for k in EXTERN["python"]), is_entry=True)
                f.entries.append(node.name)
                fn = node.name
            elif isinstance(node, ast.Call):
                callee = _dotted(node.func) or (ast.unparse(node.func) if isinstance(node.func, ast.Attribute) else ast.get_source_segment(text, node.func))
                f.node("call", node.lineno, callee, depth)
                if fn:
                    f.call(fn, callee or "", node.lineno, [])
            elif isinstance(node, ast.Assign):
                f.node("assignment", node.lineno, None, depth)
                if fn:
                    f.variables.append({"name": _dotted(node.targets[0]) or ast.unparse(node.targets[0]), "type": "dynamic", "fn": fn, "line": node.lineno, "is_pointer": False, "is_array": False, "array_size": None})
            todo += [(c, fn, depth + 1) for c in reversed(_children(node))]

    visit(tree, None, 0)
    if "__name__" in text and "__main__" in text:
        f.entries.append("__main__")
    return f


def _children(node: ast.AST) -> list[ast.AST]:
    """The nodes below a node, but those that hold nothing."""
    out: list[ast.AST] = []
    for v in node.__dict__.values():
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST) and v._fields:
            out.append(v)
    return out


def _dotted(node: ast.AST) -> str | None:
    """A name, or attributes of a name, as written; None for anything else."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(names)]) if isinstance(node, ast.Name) else None


def _loop_depth(node: ast.AST) -> int:
    deepest, todo = 0, [(node, 0)]
    while todo:
        x, d = todo.pop()
        d += isinstance(x, (ast.For, ast.AsyncFor, ast.While))
        deepest = max(deepest, d)
        todo += [(c, d) for c in _children(x) if not isinstance(c, ast.expr)]
    return deepest


_PY_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+(\w+)\s*\(([^)]*)")
_PY_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")


def _python_lines(f: File) -> File:
    open_: list[tuple[int, str]] = []
    for i, s in enumerate(f.text.split("\n"), 1):
        if not s.strip() or s.lstrip().startswith("#"):
            continue
        indent = len(s) - len(s.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        if m := _PY_DEF.match(s):
            f.function(m[2], i, args=[a.split("=")[0].split(":")[0].strip() for a in m[3].split(",") if a.strip()], is_entry=True)
            f.entries.append(m[2])
            open_.append((indent, m[2]))
            continue
        for _, name in open_:
            f.functions[name]["end_line"] = i
        if open_ and any(k in s for k in EXTERN["python"]):
            f.functions[open_[-1][1]]["extern_input"] = True
        for m in _PY_CALL.finditer(s):
            if m[1] not in ("if", "while", "for", "return", "and", "or", "not", "in", "print"):
                f.node("call", i, m[1])
                if open_:
                    f.call(open_[-1][1], m[1], i, [])
        if re.match(r"\s*[\w.\[\], ]+=[^=]", s):
            f.node("assignment", i)
    return f


def parsed(text: str, language: str) -> File:
    return _python(text) if language == "python" else _braced(text, language)


def facts(files: DataFrame, *, text: str, lang: str, keep: tuple[str, ...]) -> DataFrame:
    """One row a fact, with the columns kept, ``lang`` and those of ``SCHEMA``; see ``of_kind``.

    Null texts, null languages and languages other than the five give nothing; the language is lower-cased
    and trimmed.  A file that cannot be parsed gives what its lines or tokens show, and an ``error`` row.
    """
    rows = files.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.lower(F.trim(F.col(lang))).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isin(*ENTRIES) & F.col("text").isNotNull())
    kept = [f"k{i}" for i in range(len(keep))]
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = {k: ([], []) for k in KINDS}, 0
            for i, (t, g) in enumerate(zip(b["text"], b["lang"].to_pylist(), strict=True)):
                for kind, found in parsed(t.as_py(), g).rows():
                    at, facts_ = held[kind]
                    at += [(i, o) for o in range(len(found))]
                    facts_ += found
                    size += len(found)
                if size > 50_000:
                    yield from batch(b, held)
                    held, size = {k: ([], []) for k in KINDS}, 0
            yield from batch(b, held)

    def batch(b: pa.RecordBatch, held: dict[str, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
        for kind, (at, found) in held.items():
            if found:
                n, take = len(found), pa.array([i for i, _ in at], pa.int64())
                cols = {c: pa.array([f.get(c) for f in found], COLUMNS[c]) for c in (*KINDS[kind], "fn") if c != "ord"} | {"kind": pa.repeat(kind, n), "ord": pa.array([o for _, o in at], pa.int32())}
                yield pa.RecordBatch.from_arrays([*[b[k].take(take) for k in kept], b["lang"].take(take), *[cols[c] if c in cols else pa.nulls(n, t) for c, t in COLUMNS.items()]], [*kept, "lang", *COLUMNS])

    out = spread(rows).mapInArrow(run, ", ".join([*[f"{k} {types[k]}" for k in kept], "lang string", SCHEMA]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], "lang", *COLUMNS)


# Which columns each kind of fact has.
KINDS = {
    "function": ["ord", "name", "line", "end_line", "args", "type", "is_entry", "calls", "pointer_ops", "loop_depth", "extern_input", "reachable", "call_depth"],
    "call": ["ord", "fn", "name", "line", "args"],
    "allocation": ["ord", "fn", "name", "line", "freed", "free_line"],
    "variable": ["ord", "fn", "name", "type", "line", "is_pointer", "is_array", "array_size"],
    "entry": ["ord", "name"],
    "node": ["ord", "type", "line", "name", "depth"],
    "error": ["name"],
}


def of_kind(facts_: DataFrame, kind: str, *keys: str) -> DataFrame:
    return facts_.where(F.col("kind") == kind).select(*keys, "lang", *KINDS[kind])
