"""From a source file to runs of one-character token kinds.

Every lexer reads a file with one compiled pattern; the kind of each distinct spelling is worked out once.
"""

from __future__ import annotations

import re
from functools import lru_cache

from . import grammars as G

_CLASSES = {"NAME": "a", "NUM": "0", "STR": "s", "CHAR": "c", "BYTES": "b", "NEWLINE": "\n", "INDENT": "\x01", "DEDENT": "\x02"}
#: Of what no grammar accepts.
WRONG = "?"
#: Of conditions: one that may hold or not, one that never does, one that always does; what goes on, and the end.
_IF, _NEVER, _ALWAYS, _ELSE, _ENDIF = "\ue001", "\ue004", "\ue005", "\ue002", "\ue003"
#: Spellings remembered per language, before they are forgotten and learnt anew.
_MOST = 200_000


def kinds(words: str, signs: str) -> dict[str, str]:
    out = dict(_CLASSES)
    for s in "()[]{}":
        out[s] = s
    for i, s in enumerate([*words.split(), *signs.split()]):
        out[s] = ";" if s == ";" else chr(0x100 + i)
    return out


def _either(signs: str) -> str:
    return "|".join(re.escape(s) for s in sorted(signs.split(), key=len, reverse=True))


class Lexer(dict):
    """Spelling to kind; ``read`` gives the runs of a text, or None when no token sequence can be right."""

    words, signs, skipped, tokens = "", "", "", ""
    _chunk = re.compile("[^{};]+[{;]?|[{};]")

    def __init__(self) -> None:
        super().__init__()
        self.kinds = kinds(self.words, self.signs)
        self._first = {"": ""} | {w: self.kinds[w] for w in [*self.words.split(), *self.signs.split(), *"()[]{}"]}
        self.update(self._first)
        self.pattern = re.compile(f"(?:{self.skipped})|({self.tokens}|{_either(self.signs)}|.)", re.S)

    def __missing__(self, token: str) -> str:
        if len(self) > _MOST:
            self.clear()
            self.update(self._first)
        k = self[token] = self.kind(token)
        return k

    def kind(self, token: str) -> str:
        raise NotImplementedError

    def string(self, text: str) -> str:
        return "".join(map(self.__getitem__, self.pattern.findall(text)))

    def read(self, text: str) -> list[list[str]] | None:
        """The ways in which the file may be read; it is right if all of them are."""
        s = self.string(text)
        return None if WRONG in s else [self._chunk.findall(s)]


_NAME = r"[^\W\d]\w*"
_C_SPACE = r"\s*\n(?=[ \t]*\#)|(?:\s|\\\r?\n)+|//(?:\\(?:\r\n|.)|[^\n\\])*|/\*.*?\*/"
_C_LINE = r"(?:(?<=\n)|\A)[ \t]*\#(?:\\(?:\r\n|.)|/\*.*?\*/|//[^\n]*|[^\n\\])*"
_C_TEXT = r'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*"'
_C_CHAR = r"(?:u8|[uUL])?'(?:[^'\\\n]|\\(?:\r\n|.))+'"
_C_NUMBER = r"\.?\d(?:[eEpP][+-]|\w|\.)*"
_INT = r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9]\d*)(?:[uU](?:ll|LL|[lLzZ])?|(?:ll|LL|[lLzZ])[uU]?)?"
_FLOAT = r"(?:(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+)[fFlL]?"
_DIRECTIVE = re.compile(r"\s*#\s*(\w*)\s*(.*)", re.S)


class C(Lexer):
    words, signs = G.C_WORDS, G.C_SIGNS
    skipped = _C_SPACE
    tokens = rf"{_C_LINE}|{_C_TEXT}|{_C_CHAR}|{_NAME}|{_C_NUMBER}|/\*"
    number = re.compile(f"(?:{_INT}|{_FLOAT})")
    #: Whether ``__cplusplus`` is defined.
    plus = False

    def kind(self, token: str) -> str:
        if (m := _DIRECTIVE.match(token)) is not None:
            return self.directive(m[1], m[2])
        if token[-1] == '"' and len(token) > 1:
            return "s"
        if token[-1] == "'" and len(token) > 1:
            return "c"
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            return "0" if self.number.fullmatch(token) else WRONG
        return "a" if token[0].isalpha() or token[0] == "_" else WRONG

    def directive(self, name: str, rest: str) -> str:
        if name in ("if", "ifdef", "ifndef"):
            rest = re.sub(r"/\*.*?\*/|//.*", " ", rest, flags=re.S).strip()
            if rest == "__cplusplus" and name != "if":
                return _ALWAYS if self.plus == (name == "ifdef") else _NEVER
            return WRONG if not rest else _NEVER if name == "if" and rest == "0" else _ALWAYS if name == "if" and rest == "1" else _IF
        if name in ("else", "elif"):
            return _ELSE
        if name == "endif":
            return _ENDIF
        if name == "include":
            return "" if re.match(r'<[^>\n]+>|"[^"\n]+"|[A-Za-z_]', rest) else WRONG
        if name in ("define", "undef"):
            return "" if re.match(r"[A-Za-z_]", rest) else WRONG
        if name == "" and rest.strip() == "" or name in ("pragma", "line", "error", "warning"):
            return ""
        return WRONG

    def read(self, text: str) -> list[list[str]] | None:
        s = self.string(text)
        if WRONG in s:
            return None
        if not _CONDITION.search(s):
            return [self._chunk.findall(s)]
        ways = self.ways(s)
        return None if ways is None else [self._chunk.findall(w) for w in ways]

    @staticmethod
    def ways(s: str) -> list[str] | None:
        """Texts that hold every branch of every condition at least once; None if conditions don't match up.

        The first takes the first branches everywhere, the second the second (or last) ones and so on, as the
        conditions of a file mostly go together; a branch that is in none of these gets a text of its own, so that
        there are at most as many texts as branches.  Branches that no compiler reads are left out."""
        root = now = _Branch(None, 0)
        every: list[_Branch] = []
        for piece in _CONDITION.split(s):
            if piece in (_IF, _NEVER, _ALWAYS):
                group = _Group(now, piece)
                now.parts.append(group)
                every.append(now := group.open())
            elif piece in (_ELSE, _ENDIF):
                if now.group is None:
                    return None
                if piece == _ENDIF:
                    now = now.group.outer
                else:
                    every.append(now := now.group.open())
            else:
                now.parts.append(piece)
        if now is not root:
            return None
        covered: set[_Branch] = set()

        def text(i: int, forced: dict[_Group, _Branch]) -> str:
            out, todo = [], [iter(root.parts)]
            while todo:
                for x in todo[-1]:
                    if isinstance(x, str):
                        out.append(x)
                    elif live := x.live():
                        branch = forced.get(x) or live[min(i, len(live) - 1)]
                        covered.add(branch)
                        todo.append(iter(branch.parts))
                        break
                else:
                    todo.pop()
            return "".join(out)

        found = [text(i, {}) for i in range(max(len(b.group.live()) for b in every) or 1)]
        for b in every:
            if b not in covered:
                forced, at = {}, b
                while at.group is not None and at in at.group.live():
                    forced[at.group], at = at, at.group.outer
                if at is root:
                    found.append(text(b.number, forced))
        return found


_CONDITION = re.compile(f"([{_IF}{_NEVER}{_ALWAYS}{_ELSE}{_ENDIF}])")


class _Branch:
    """Texts and conditions between two directives."""

    def __init__(self, group: _Group | None, number: int):
        self.group, self.number, self.parts = group, number, []


class _Group:
    """A condition with its branches."""

    def __init__(self, outer: _Branch, kind: str):
        self.outer, self.kind, self.branches = outer, kind, []

    def open(self) -> _Branch:
        self.branches.append(_Branch(self, len(self.branches)))
        return self.branches[-1]

    def live(self) -> list[_Branch]:
        """The branches that some compiler reads."""
        return self.branches[:1] if self.kind == _ALWAYS else self.branches[1:] if self.kind == _NEVER else self.branches


class Cpp(C):
    words, signs = G.CPP_WORDS, G.CPP_SIGNS
    plus = True
    _suffix = rf"(?:{_NAME})?"
    raw = r'(?:u8|[uUL])?R"(?P<d>[^()\\\s"]{0,16})\(.*?\)(?P=d)"'
    tokens = rf"{_C_LINE}|{_C_TEXT}{_suffix}|{_C_CHAR}{_suffix}|{_NAME}|\.?\d(?:[eEpP][+-]|'?\w|\.)*|/\*"
    literal = re.compile(rf"{raw}|{_C_TEXT}|{_C_CHAR}|//(?:\\(?:\r\n|.)|[^\n\\])*|/\*.*?\*/|\b\d(?:'?\w)*", re.S)
    number = re.compile(rf"(?:{_INT}|{_FLOAT})(?:_\w+)?")

    def kind(self, token: str) -> str:
        t = token.replace("'", "") if token[0].isdigit() else token
        if '"' in t[:3] and t[-1] != '"':
            return "s"
        if t[0] == "'" and len(t) > 2 and t[-1] != "'":
            return "c"
        return super().kind(t)

    def string(self, text: str) -> str:
        if 'R"' in text:
            text = self.literal.sub(lambda m: '""' if m["d"] is not None else m[0], text)
        return super().string(text)


class Java(Lexer):
    words, signs = G.JAVA_WORDS, G.JAVA_SIGNS
    skipped = r"\s+|//[^\n]*|/\*.*?\*/"
    tokens = r'"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""|"(?:[^"\\\n\r]|\\[^\n])*"|' + r"'(?:[^'\\\n\r]|\\[^\n][0-9a-fA-Fu]*)'" + r"|(?:[^\W\d]|\$)[\w$]*|\.?\d(?:[eEpP][+-]|\w|\.(?=[\deEfFdDpP_]|[^\w.]))*|/\*"
    number = re.compile(
        r"(?:0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*|0[bB][01](?:_*[01])*|0(?:_*[0-7])*|[1-9](?:_*\d)*)[lL]?"
        r"|(?:\d(?:_*\d)*\.(?:\d(?:_*\d)*)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?[fFdD]?|\d(?:_*\d)*(?:[eE][+-]?\d(?:_*\d)*[fFdD]?|[fFdD])"
        r"|0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?\d+[fFdD]?"
    )
    escapes = re.compile(r"(?:[^\\]|\\(?:[btnfrs\"'\\0-7]|u+[0-9a-fA-F]{4}|\r?\n))*", re.S)

    def kind(self, token: str) -> str:
        if token[0] in "\"'" and len(token) > 2 or token == '""':
            if "\\" in token and not self.escapes.fullmatch(token):
                return WRONG
            return "s" if token[0] == '"' else "c"
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            return "0" if self.number.fullmatch(token) else WRONG
        return "a" if token[0].isalpha() or token[0] in "_$" else WRONG


class Go(Lexer):
    words, signs = G.GO_WORDS, G.GO_SIGNS
    skipped = r"[ \t\r]+|//[^\n]*"
    tokens = rf'\n|/\*.*?\*/|`[^`]*`|"(?:[^"\\\n]|\\[^\n])*"|' + r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'" + rf"|{_NAME}|\.?\d(?:[eEpP][+-]|\w|\.)*|/\*"
    number = re.compile(
        r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])*|[1-9](?:_?\d)*"
        r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*"
        r"|0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?\d+)i?|\d+i"
    )
    escapes = re.compile(r"(?:[^\\]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*", re.S)

    def __init__(self) -> None:
        super().__init__()
        k = self.kinds
        ends = "".join(map(re.escape, ["a", "0", "s", "c", ")", "]", "}", *(k[w] for w in ("break", "continue", "fallthrough", "return", "++", "--"))]))
        self._end = re.compile(rf"(?<=[{ends}])\n")

    def kind(self, token: str) -> str:
        if token == "\n":
            return "\n"
        if token.startswith("/*"):
            return WRONG if len(token) < 4 else "\n" if "\n" in token else ""
        if token[0] == "`":
            return "s" if len(token) > 1 else WRONG
        if token[0] in "\"'" and len(token) > 2 or token == '""':
            if "\\" in token and not self.escapes.fullmatch(token):
                return WRONG
            return "s" if token[0] == '"' else "c"
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            return "0" if self.number.fullmatch(token) else WRONG
        return "a" if token[0].isalpha() or token[0] == "_" else WRONG

    def read(self, text: str) -> list[list[str]] | None:
        s = self.string(text)
        if WRONG in s:
            return None
        s = self._end.sub(";", s + "\n").replace("\n", "")
        return [self._chunk.findall(s)]


#: A line end and the indent after it, whatever its width.
_LINE = "\uf000"


@lru_cache(65_536)
def _width(start: str) -> tuple[int, int]:
    """Columns and characters of the indent after a line end."""
    indent = start.split("\n", 1)[1].rpartition("\f")[2]
    wide = 0
    for ch in indent:
        wide = wide + 1 if ch == " " else (wide // 8 + 1) * 8
    return wide, len(indent)


_PY_PREFIX = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
#: In place of an f-string; CPython's bounds of f-strings in f-strings and of specifications in specifications.
_FORMATTED, _LEVELS, _SPECS = "\ue010", 149, 2
CLOSING = {"(": ")", "[": "]", "{": "}"}


class Python(Lexer):
    words, signs = G.PYTHON_WORDS, G.PYTHON_SIGNS
    skipped = r"[ \t\f]+|\\\r?\n(?=.)|\#[^\n]*"
    _long = r'(?:"""(?:[^\\]|\\.)*?"""|' + r"'''(?:[^\\]|\\.)*?''')"
    _short = r'(?:"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|' + r"'(?:[^'\\\r\n]|\\(?:\r\n|.))*')"
    tokens = rf'\r?\n[ \t\f]*|\x00|{_PY_PREFIX}(?:{_long}|"""|' + rf"'''|{_short})|{_NAME}|\.?\d(?:[eE][+-](?=\d)|\w|\.)*"
    number = re.compile(
        r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|0(?:_?0)*|[1-9](?:_?\d)*"
        r"|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ])"
    )
    escapes = re.compile(r"(?:[^\\]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U00(?:0\d|10)[0-9a-fA-F]{4}|N\{[^}]+\}|[^xuUN]))*", re.S)
    byte_escapes = re.compile(r"(?:[^\\]|\\(?:x[0-9a-fA-F]{2}|[^x]))*", re.S)
    _formatted = re.compile(rf"[fF][rR]?[\"']|[rR][fF][\"']|{_FORMATTED}")
    _opened = r"(?<!\w)(?P<f>[fF][rR]?|[rR][fF])(?P<q>\"\"\"|'''|[\"'])"
    _outside = re.compile(rf"\#[^\n]*|{_opened}|{_long}|(?!\"\"\"|'''){_short}|(?P<bad>[\"'{_FORMATTED}])", re.S)
    _inside = re.compile(rf"(?P<gap>\#[^\n]*|\\\r?\n|\r?\n)|{_opened}|{_long}|(?!\"\"\"|'''){_short}|(?P<bad>[\"'{_FORMATTED}])|!=|[][(){{}}:!]", re.S)
    _middle = re.compile(r"\\(?:\r\n|.)|[{}\"'\n]", re.S)
    _closed = re.compile(r"(?:\s|\#[^\n]*\n)*(?=\})")
    _conversion = re.compile(r"[rsa](?:\s|\#[^\n]*\n)*([:}])")

    def __init__(self) -> None:
        self.fields: list[str] = []
        self.depths: dict[str, int] = {}
        super().__init__()

    def kind(self, token: str) -> str:
        if token[0] in "\r\n" and token.lstrip("\r \t\f")[:1] == "\n":
            return _LINE
        if token == _FORMATTED:
            return "s"
        if token[-1] in "\"'" and len(token) > 1:
            prefix = re.match("[A-Za-z]*", token)[0].lower()
            body = token[len(prefix) :]
            if body in ('"""', "'''"):
                return WRONG
            if "b" in prefix:
                if not token.isascii() or "r" not in prefix and "\\" in token and not self.byte_escapes.fullmatch(token):
                    return WRONG
                return "b"
            if "r" not in prefix and "\\" in token and not self.escapes.fullmatch(token):
                return WRONG
            return "s"
        if token[0].isdigit() or token[0] == "." and len(token) > 1:
            return "0" if self.number.fullmatch(token) else WRONG
        return "a" if token[0].isalpha() or token[0] == "_" else WRONG

    def split(self, text: str) -> tuple[str, list[str]] | None:
        """The text with a mark in place of each f-string, and the expressions in their fields at any depth; None
        when an f-string or another string is malformed."""
        if not self._formatted.search(text):
            return text, []
        out: list[str] = []
        found: list[str] = []
        at = i = 0
        while m := self._outside.search(text, i):
            i = m.end()
            if m["bad"]:
                return None
            if m["f"]:
                i = self.formatted(text, i, m["q"], "r" in m["f"].lower(), found, 1)
                if i < 0:
                    return None
                out += [text[at : m.start()], _FORMATTED]
                at = i
        return "".join(out) + text[at:], found

    def formatted(self, text: str, i: int, quote: str, raw: bool, found: list[str], level: int, spec: int = 0) -> int:
        """Where the f-string, or with ``spec`` the format specification of that depth, that starts at ``i`` ends;
        its fields go to ``found``. -1: malformed."""
        if level > _LEVELS:
            return -1
        start = i

        def plain(end: int) -> bool:
            part = text[start:end]
            return raw and not spec or "\\" not in part or self.escapes.fullmatch(part) is not None

        while m := self._middle.search(text, i):
            i, c = m.start(), m[0]
            if c[0] == "\\":
                if c[1:] in ("{", "}"):
                    if not plain(i):
                        return -1
                    start = i = i + 1
                elif c == "\\N" and not raw and text[i + 2 : i + 3] == "{":
                    i = text.find("}", i) + 1
                    if i == 0:
                        return -1
                else:
                    i = m.end()
            elif text.startswith(quote, i):
                return i + len(quote) if plain(i) and not spec else -1
            elif c in "\"'":
                i += 1
            elif c == "\n":
                if len(quote) == 3:
                    i += 1
                    continue
                # a line end closes the specification, and nothing but the field's end may follow
                m = self._closed.match(text, i)
                return m.end() if spec and m and plain(i) else -1
            elif c == "}" and spec:
                return i if plain(i) else -1
            elif not spec and text.startswith(c * 2, i):
                i += 2
            elif c == "}":
                return -1
            else:
                if not plain(i):
                    return -1
                start = i = self.field(text, i + 1, quote, raw, found, level, spec)
                if i < 0:
                    return -1
        return -1

    def field(self, text: str, i: int, quote: str, raw: bool, found: list[str], level: int, spec: int) -> int:
        """Where the replacement field ends whose expression starts at ``i``; -1: malformed."""
        if spec > _SPECS:
            return -1
        out: list[str] = []
        at, closers = i, ""
        while m := self._inside.search(text, i):
            i, c = m.end(), m[0]
            if m["bad"]:
                return -1
            if m["f"]:
                out.append(text[at : m.start()])
                i = self.formatted(text, i, m["q"], "r" in m["f"].lower(), found, level + 1)
                if i < 0:
                    return -1
                out.append(_FORMATTED)
                at = i
            elif m["gap"]:
                out += [text[at : m.start()], " "]
                at = i
            elif c in "([{":
                closers += CLOSING[c]
            elif c in ")]}" and closers:
                if closers[-1] != c:
                    return -1
                closers = closers[:-1]
            elif c in ")]":
                return -1
            elif c in "}:!" and not closers:
                break
        else:
            return -1
        expression = "".join([*out, text[at : m.start()]]).strip()
        if expression.endswith("=") and not expression.endswith(("==", "!=", "<=", ">=")):
            expression = expression[:-1].rstrip()
        if not expression:
            return -1
        found.append(expression)
        if c == "!":
            if not (m := self._conversion.match(text, i)):
                return -1
            i, c = m.end(), m[1]
        if c == ":":
            i = self.formatted(text, i, quote, raw, found, level, spec + 1)
            if i >= 0 and text[i] == "}":
                i += 1
        return i

    def read(self, text: str) -> list[list[str]] | None:
        if "\x00" in text or "\r" in text and re.search("\r(?!\n)", text):
            text = re.sub("\r(?!\n)", "\n", text)
        whole = self.split(text)
        if whole is None:
            return None
        text, self.fields = whole
        found = self.pattern.findall(text.removeprefix("\ufeff"))
        s = "".join(map(self.__getitem__, found))
        if WRONG in s:
            return None
        starts = [x for x in found if x and x[0] in "\r\n"]
        lead = re.match("[ \t]*", text)[0]
        pieces = s.split(_LINE)
        out: list[str] = []
        stack = [(0, 0)]
        depth, line = 0, ""
        indent: tuple[int, int] = (0, 0)
        if lead:
            indent = _width("\n" + lead)
        for i, piece in enumerate(pieces):
            if not piece:
                continue
            if i and depth == 0:
                indent = _width(starts[i - 1])
            if depth == 0 and not line:
                if indent != stack[-1]:
                    if indent[0] > stack[-1][0]:
                        if indent[1] <= stack[-1][1]:
                            return None
                        stack.append(indent)
                        out.append("\x01")
                    else:
                        while indent[0] < stack[-1][0]:
                            stack.pop()
                            out.append("\x02")
                        if indent != stack[-1]:
                            return None
            if (d := self.depths.get(piece)) is None:
                d = sum(piece.count(k) for k in "([{") - sum(piece.count(k) for k in ")]}")
                if len(self.depths) < _MOST:
                    self.depths[piece] = d
            depth += d
            line += piece
            if depth < 0:
                return None
            if depth == 0:
                out.append(line + "\n")
                line = ""
        if depth or line:
            return None
        out += ["\x02"] * (len(stack) - 1)
        return [out]
