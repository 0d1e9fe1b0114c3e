"""Detection rules as columns, and the scan that applies all of them in one pass over the lines.

A rule starts from nodes of given types (``sources.parse``), looks at the node's line and, where it says so, at
the enclosing function or the whole file.  All rules are kept in one registry; another is a ``Rule`` more.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, spread
from ..sources import files as S
from ..sources import parse as P


def has(pattern: str) -> Column:
    return F.col("src").rlike(pattern)


def holds(text: str) -> Column:
    return F.col("src").contains(text)


@dataclass(frozen=True)
class Rule:
    """``when`` is a predicate over ``src`` (the line), ``callee`` (of a call), ``extern_input``, ``before3``
    (a check in the three lines before), and the marks named in ``function`` and ``file``."""

    name: str
    language: str
    nodes: tuple[str, ...]
    cwe: str
    title: str
    severity: str | Column
    confidence: float | Column
    when: Column
    #: Marks: name to a predicate over a line; true where any line of the enclosing function has it.
    function: dict[str, Column] = field(default_factory=dict)
    #: The rule looks at every line of a file that has a trigger node, not at the node's own line.
    whole_file: bool = False
    #: What a line must have, by itself, for the rule to hold. It is tried in the scan; without it, a rule that
    #: looks at its line alone is tried there, and one that looks at more is tried on every line.
    screen: Column | None = None

    def screen_column(self) -> Column:
        if self.screen is not None:
            return self.screen
        more = ("callee", "extern_input", "before3", *self.function)
        return F.lit(True) if any(m in str(self.when) for m in more) else self.when

    def severity_column(self) -> Column:
        return self.severity if isinstance(self.severity, Column) else F.lit(self.severity)

    def confidence_column(self) -> Column:
        return (self.confidence if isinstance(self.confidence, Column) else F.lit(self.confidence)).cast("double")


_CALL = ("call_expression",)
_FORMAT = ["printf", "fprintf", "sprintf", "snprintf", "vprintf"]
#: Functions that give further rules: plug-ins append to this list.
MORE: list[Callable[[], Rule]] = []


def _mark(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _worse(condition: Column) -> Column:
    return F.when(condition, "CRITICAL").otherwise("HIGH")


def registry() -> list[Rule]:
    """All rules that look at a line; columns need a running session, so they are made anew."""
    callee, extern = F.col("callee"), F.col("extern_input")
    # Names, weaknesses, severities, confidences and patterns of the rules.
    built_in = [
        Rule("strcpy_overflow", "c", _CALL, "CWE-120", "Buffer overflow by an unbounded copy", "HIGH", 0.90, callee.isin("strcpy", "strcat", "wcscpy", "wcscat"), screen=has("strcpy|strcat|wcscpy|wcscat")),
        Rule("gets_unbounded_read", "c", _CALL, "CWE-121", "Unbounded read", "CRITICAL", 0.98, callee == "gets", screen=holds("gets")),
        Rule("sprintf_overflow", "c", _CALL, "CWE-120", "Buffer overflow by formatting", "HIGH", 0.85, callee == "sprintf", screen=holds("sprintf")),
        Rule("scanf_unbounded_string", "c", _CALL, "CWE-120", "Unbounded string read", "HIGH", 0.80, callee.isin("scanf", "fscanf", "sscanf") & has(r"%\d*s") & ~has(r"%\d+s"), screen=holds("scanf") & holds("%s")),
        Rule(
            "format_string_injection", "c", _CALL, "CWE-134", "Format string from a variable", "HIGH", 0.80,
            callee.isin(*_FORMAT, "syslog") & ~F.coalesce(F.expr(r"""regexp_like(src, concat(callee, '\\s*\\(\\s*"'))"""), F.lit(False)), screen=has("printf|syslog"),
        ),
        Rule("command_injection", "c", _CALL, "CWE-78", "Command from a variable", _worse(extern), 0.88, callee.isin("system", "popen", "execl", "execlp", "execvp"), screen=has("system|popen|execl|execvp")),
        Rule("memcpy_no_bounds", "c", _CALL, "CWE-125", "Copy without a size check", "MEDIUM", 0.65, callee.isin("memcpy", "memmove", "bcopy") & ~holds("sizeof"), screen=has("memcpy|memmove|bcopy") & ~holds("sizeof")),
        Rule(
            "memory_leak_raw_new", "cpp", ("new_expression",), "CWE-401", "Raw new without delete", "MEDIUM", 0.70,
            ~has(r"(?:unique_ptr|shared_ptr|make_unique|make_shared)") & ~_mark("f_delete"), {"f_delete": holds("delete")}, screen=holds("new"),
        ),
        Rule(
            "nullptr_dereference_uncaught", "cpp", ("pointer_expression",), "CWE-476", "Dereference without a null check", "MEDIUM", 0.65,
            ~_mark("before3") & ~has(r"(?:unique_ptr|shared_ptr|weak_ptr).*\*") & has(r"(?:\*\s*\w+|\w+\s*->)") & ~_mark("f_try"), {"f_try": holds("try") | holds("catch")}, screen=holds("*") | holds("->"),
        ),
        Rule("char_array_buffer_issue", "cpp", ("declaration",), "CWE-190", "Fixed character array", "LOW", 0.60, has(r"\bchar\s+\w+\s*\[\s*\d+\s*\]") & ~(holds("const") & holds("=") & holds('"'))),
        Rule(
            "cpp_format_string_injection", "cpp", _CALL, "CWE-134", "Format string from a variable", "HIGH", 0.80,
            (F.regexp_extract("src", r"^\s*(?:\w+\s*=\s*)?(\w+)\s*\(", 1).isin(*_FORMAT) | callee.isin(*_FORMAT))
            & ~F.coalesce(F.expr(r"""regexp_like(src, concat(if(regexp_extract(src, '^\\s*(?:\\w+\\s*=\\s*)?(\\w+)\\s*\\(', 1) IN ('printf', 'fprintf', 'sprintf', 'snprintf', 'vprintf'), regexp_extract(src, '^\\s*(?:\\w+\\s*=\\s*)?(\\w+)\\s*\\(', 1), callee), '\\s*\\(\\s*(?:stdout\\s*,\\s*)?["\']'))"""), F.lit(False)), screen=holds("printf"),
        ),
        Rule(
            "cpp_system_command_injection", "cpp", _CALL, "CWE-78", "Command from a variable", "CRITICAL", 0.85,
            has(r"\bsystem\s*\(") & (~has(r"""system\s*\(\s*["']""") | has(r"""system\s*\(\s*(?:[^"'(]+\+|cmd|command|buf|input)""")),
        ),
        Rule("integer_overflow_array_size", "cpp", ("new_expression",), "CWE-190", "Array size from arithmetic", "HIGH", 0.72, has(r"new\s+\w[\w:<>*\s]*\[\s*\w+\s*[*+]\s*\w+") & ~has(r"(?:size_t|static_cast|checked_|overflow)")),
        Rule("ofstream_incorrect_permissions", "cpp", ("declaration", "expression_statement"), "CWE-732", "File made with default permissions", "MEDIUM", 0.68, has(r"""\bofstream\b|\bofs\.open\s*\(|\bfopen\s*\(.*["']w""") & ~has(r"(?:chmod|umask|ios::out\s*\|)")),
        Rule(
            "sql_injection_string_concat", "java", ("method_invocation",), "CWE-89", "Query joined from strings", "CRITICAL", 0.90,
            has(r"(?i)(?:executeQuery|executeUpdate|prepareStatement|createStatement)\s*\([^)]*\+") & ~has(r'prepareStatement\s*\(\s*"[^"]*\?'),
        ),
        Rule(
            "xxe_document_builder_factory", "java", ("method_invocation",), "CWE-611", "XML parser with external entities", "HIGH", 0.82, holds("DocumentBuilderFactory") & ~_mark("f_safe_xml"),
            {"f_safe_xml": has("setFeature|external-general-entities|external-parameter-entities|disallow-doctype-decl|setExpandEntityReferences")}, screen=holds("DocumentBuilderFactory"),
        ),
        Rule("unsafe_deserialization_object_input_stream", "java", ("method_invocation",), "CWE-502", "Objects read from a stream", "CRITICAL", 0.88, has(r"\.readObject\s*\(\s*\)") & (_mark("f_stream") | holds("ObjectInputStream")), {"f_stream": holds("ObjectInputStream")}, screen=holds("readObject")),
        Rule(
            "path_traversal_new_file", "java", ("object_creation_expression",), "CWE-22", "Path from a variable", "HIGH", 0.78,
            has(r"\bnew\s+File\s*\(") & ~has(r'new\s+File\s*\(\s*"[^"]*"\s*\)') & has(r"new\s+File\s*\([^)]*(?:\+|\w)") & ~_mark("f_checked_path"),
            {"f_checked_path": holds("getCanonicalPath") | holds("normalize") | holds("startsWith")}, screen=has(r"\bnew\s+File\s*\("),
        ),
        Rule("runtime_exec_command_injection", "java", ("method_invocation",), "CWE-78", "Command from a variable", _worse(holds("+")), 0.87, has(r"Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\(")),
        Rule(
            "hardcoded_password_credential", "java", ("variable_declarator", "local_variable_declaration", "field_declaration"), "CWE-798", "Credential in the source", "HIGH", 0.85,
            has(r"""(?i)(?:password|passwd|pwd|secret|credential|apikey|api_key|authtoken|auth_token)\s*=\s*["'][^"']{4,}["']""") & ~has(r"(?i)(?:your_|example|placeholder|changeme|xxx|todo|<|>|\{|\})"),
        ),
        Rule(
            "null_return_not_checked", "java", ("method_invocation",), "CWE-476", "Result used without a null check", "MEDIUM", 0.70,
            has(r"(?i)\b(?:get|find|lookup|fetch|load|read|next|peek|poll|remove|getProperty|getenv|getParameter|getAttribute|getHeader)\s*\(") & has(r"\)\s*\.")
            & ~has(r"(?:Optional|Objects\.requireNonNull|!= null|== null|isPresent|orElse)"),
        ),
        Rule(
            "hardcoded_crypto_key", "java", ("local_variable_declaration", "field_declaration", "variable_declarator", "string_literal"), "CWE-321", "Key in the source", "HIGH", 0.83,
            (has(r"(?i)(?:key|secretkey|aeskey|deskey|privatekey|ivspec|initvector|iv|hmackey)\s*=\s*") & has(r"""(?:["'][^"']{4,}["']|new\s+(?:byte|char)\s*\[\s*\]\s*\{[^}]+\})"""))
            | (has(r"(?:SecretKeySpec|IvParameterSpec|SecretKeyFactory)\s*\(") & (has(r"""(?:SecretKeySpec|IvParameterSpec)\s*\([^)]*["']""") | has(r"(?:SecretKeySpec|IvParameterSpec)\s*\([^)]*getBytes"))),
        ),
        Rule("eval_exec_injection", "python", ("call",), "CWE-95", "Code from a variable", "CRITICAL", 0.88, callee.isin("eval", "exec", "compile") & ~F.coalesce(F.expr(r"""regexp_like(src, concat(callee, '\\s*\\(\\s*["\']'))"""), F.lit(False)), screen=has("eval|exec|compile")),
        Rule("unsafe_deserialization", "python", ("call",), "CWE-502", "Objects read from a pickle", "CRITICAL", 0.92, has(r"pickle\.(loads?|Unpickler)")),
        Rule("subprocess_shell_injection", "python", ("call",), "CWE-78", "Command run by a shell", "HIGH", 0.90, holds("subprocess") & (holds("shell=True") | holds("shell = True"))),
        Rule("os_system_injection", "python", ("call",), "CWE-78", "Command run by a shell", "HIGH", 0.85, has(r"os\.(system|popen)\s*\(")),
        Rule("path_traversal", "python", ("call",), "CWE-22", "Path from a variable", "MEDIUM", F.when(extern, 0.80).otherwise(0.55), has(r"\bopen\s*\(") & ~has(r"""open\s*\(\s*["']""")),
        Rule(
            "hardcoded_secret", "python", ("assignment",), "CWE-798", "Credential in the source", "HIGH", 0.82,
            has(r"""(?i)(password|passwd|secret|api_key|apikey|token|auth_token|private_key|access_key|secret_key|credentials)\s*=\s*["'][^"']{4,}["']""") & ~has(r"(?i)(?:your_|example|placeholder|changeme|xxx|todo)"), whole_file=True,
        ),
        Rule("go_exec_command_injection", "go", _CALL, "CWE-78", "Command from a variable", _worse(extern), 0.85, has(r"exec\.Command\s*\(") & ~has(r'exec\.Command\s*\(\s*"[^"]+"\s*\)'), whole_file=True),
        Rule("go_unsafe_pointer", "go", ("qualified_type",), "CWE-242", "Unsafe pointer", "MEDIUM", 0.85, (holds("unsafe.Pointer") | holds("unsafe.Sizeof")) & ~holds("import"), whole_file=True),
        Rule("go_ignored_error", "go", ("short_var_declaration",), "CWE-390", "Error ignored", "MEDIUM", 0.75, has(r"^\s*\w+\s*,\s*_\s*:?=|^\s*_\s*,\s*\w+\s*:?=|^\s*_\s*=") & ~holds("range ") & ~holds("for "), whole_file=True),
        Rule("go_fmt_sprintf_injection", "go", _CALL, "CWE-134", "Format string from a variable", "MEDIUM", 0.72, has(r"fmt\.(Sprintf|Fprintf|Printf|Errorf)\s*\(") & ~has(r'fmt\.\w+\s*\(\s*"') & ~has(r'fmt\.Fprintf\s*\(\s*\w+\s*,\s*"'), whole_file=True),
        Rule("go_hardcoded_secret", "go", ("var_declaration",), "CWE-798", "Credential in the source", "HIGH", 0.82, has(r'(?i)(password|passwd|secret|apiKey|api_key|token|authToken|privateKey|accessKey|secretKey|credentials)\s*[=:]\s*"[^"]{4,}"') & ~has(r"(?i)(?:example|placeholder|your_|changeme)"), whole_file=True),
    ]
    return built_in + [make() for make in MORE]


#: Rules with an operator of their own, below: name, language, weakness, title, severity, confidence.
OTHERS = [
    ("use_after_free", "c", "CWE-416", "Use after free", "HIGH", 0.70),
    ("double_free", "c", "CWE-415", "Freed twice", "HIGH", 0.75),
    ("use_after_delete", "cpp", "CWE-416", "Use after delete", "HIGH", 0.78),
    ("go_osargs_no_validation", "go", "CWE-20", "Argument read without a length check", "LOW", 0.80),
]
#: Hints that an argument is a pointer.
POINTER_HINTS = ["ptr", "p", "buf", "data", "mem"]


def line_hits(lines: DataFrame, language: str, *keys: str, src: str = "src") -> DataFrame:
    """``keys, rule_name`` of each line that a rule of the language matches by its line alone, trigger nodes,
    functions and files left aside: one pass, one array of rule names a line."""
    rules = [r for r in registry() if r.language == language and not r.function and not _uses_callee(r)]
    marked = lines.withColumn("src", F.col(src)).withColumn("extern_input", F.lit(False))
    found = F.array_compact(F.array(*[F.when(r.when, r.name) for r in rules]))
    return marked.select(*keys, F.explode(found).alias("rule_name"))


def _uses_callee(r: Rule) -> bool:
    return "callee" in str(r.when) or "before3" in str(r.when)


def by_file(functions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _fs``: the functions of each file as one array, in order; ``functions`` has ``ord, name, line, end_line``
    and more."""
    more = [c for c in functions.columns if c not in keys and c not in ("lang", "ord")]
    return functions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", *more))).alias("_fs"))


def covering(line: str) -> Column:
    """Those of ``_fs`` whose lines hold the line."""
    return F.filter("_fs", lambda f: (f["line"] <= F.col(line)) & (F.col(line) <= f["end_line"]))


def enclosing(points: DataFrame, functions: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Each point with its enclosing function's columns: the first in order whose lines cover it, else nulls.
    The functions of one file make one array, so that the range join is an equality join on the file and no pair
    of point and function is ever a row."""
    near = points.join(by_file(functions, keys), keys, "left").withColumn("_f", F.get(covering(line), F.lit(0)))
    more = [c for c in functions.columns if c not in keys and c != "lang"]
    return near.select(*points.columns, *[F.col(f"_f.{c}").alias(_RENAMED.get(c, c)) for c in more])


_RENAMED = {"ord": "f_ord", "name": "function_name", "line": "f_line", "end_line": "f_end"}


def before3(lines: DataFrame, keys: list[str], check: Column) -> DataFrame:
    """``lines`` with ``before3``: a line among the three before passes the check."""
    w = Window.partitionBy(*keys).orderBy("line").rowsBetween(-3, -1)
    return lines.withColumn("before3", F.coalesce(F.max(check).over(w), F.lit(False)))


def snippet(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``code_snippet``: the line between its neighbours, numbered, the line marked."""
    w = Window.partitionBy(*keys).orderBy("line")
    row = lambda mark, number, text: F.format_string(mark + "%4d | %s", number, F.rtrim(text))
    parts = [F.when(F.lag("src").over(w).isNotNull(), row("    ", F.col("line") - 1, F.lag("src").over(w))), row(">>> ", F.col("line"), F.col("src")), F.when(F.lead("src").over(w).isNotNull(), row("    ", F.col("line") + 1, F.lead("src").over(w)))]
    return lines.withColumn("code_snippet", F.array_join(F.array(*parts), "\n"))


FINDING = ["lang", "rule_name", "cwe", "title", "severity", "confidence", "function_name", "line", "extern_input", "reachable", "call_depth", "in_loop", "node_ord"]


_CHECKED = r"nullptr|NULL|if\s*\("
_DELETED = r"\bdelete(?:\[\])?\s+(\w+)\s*;"
_NULLED, _USED = r"\b(\w+)\s*=\s*nullptr", r"\b(\w+)\s*(?:->|\[|\*)"
_ABOUT = ["extern_input", "reachable", "call_depth", "loop_depth"]


def marked_lines(files: DataFrame, functions: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The lines that any rule or mark can be about, few of all, in one pass over the texts.

    ``key, lang, line, src, before3`` (one of the three lines before has a check; C++ only), ``hit`` (a rule of the
    language may hold), a column for each mark, ``ptr`` (deleted here), ``fs`` (``ord`` of all functions around it)
    and ``f``, the first of these as a struct."""
    by_language = lambda make: reduce(lambda c, g: c.when(F.col("lang") == g, make(g)), P.ENTRIES, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    either = lambda columns: reduce(operator.or_, columns, F.lit(False))
    each = spread(files.select(key, F.lower(F.trim("lang")).alias("lang"), text).where(F.col("lang").isin(*P.ENTRIES) & F.col(text).isNotNull()))
    each = each.select(key, "lang", F.transform(S.split_lines(F.col(text)), F.trim).alias("_ls"))
    is_cpp = F.col("lang") == "cpp"
    each = each.withColumn("_checks", F.when(is_cpp, F.transform("_ls", lambda x: x.rlike(_CHECKED)))).withColumn("_deletes", F.when(is_cpp, F.exists("_ls", lambda x: x.rlike(_DELETED))).otherwise(F.lit(False)))
    each = each.select(key, "lang", "_checks", "_deletes", F.posexplode("_ls").alias("_pos", "src"))
    before = either([F.coalesce(F.get("_checks", F.col("_pos") - i), F.lit(False)) for i in (1, 2, 3)])
    lines = each.select(key, "lang", (F.col("_pos") + 1).alias("line"), "src", before.alias("before3"), "_deletes")
    marks = {m: (F.col("lang") == r.language) & c for r in rules for m, c in r.function.items()}
    lines = lines.withColumn("hit", by_language(lambda g: either([r.screen_column() for r in rules if r.language == g]))).withColumns(marks)
    about = (F.col("_deletes") & (has(_DELETED) | has(_NULLED) | has(_USED))) | ((F.col("lang") == "go") & holds("os.Args"))
    kept = lines.where(F.col("hit") | either([F.col(m) for m in marks]) | about).withColumn("ptr", F.when(F.col("_deletes"), F.nullif(F.regexp_extract("src", _DELETED, 1), F.lit(""))))
    near = kept.join(by_file(functions, [key]), key, "left").withColumn("_in", covering("line"))
    return near.select(*[c for c in kept.columns if c != "_deletes"], F.transform("_in", lambda f: f["ord"]).alias("fs"), F.get("_in", F.lit(0)).alias("f"))


def scan(files: DataFrame, facts: DataFrame, key: str, text: str) -> DataFrame:
    """All findings of all rules: ``key`` and ``FINDING``, each rule, function and line once a file.

    ``facts`` are those of ``parse.facts`` with ``key`` kept.  MEDIUM becomes HIGH in functions that are
    reachable and read input from outside.  The texts are read once; what follows works on the lines kept there.
    """
    rules = registry()
    functions = P.of_kind(facts, "function", key).select(key, "ord", "name", "line", "end_line", *_ABOUT)
    lines = cut(marked_lines(files, functions, key, text, rules))
    marks = [m for r in rules for m in r.function]
    # marks of a function are taken over its lines; lines outside any function have none
    of_function = lines.where(" OR ".join(marks)).select(key, F.explode("fs").alias("f_ord"), *marks).groupBy(key, "f_ord").agg(*[F.max(m).alias(m) for m in marks])
    where = lines.where("hit").select(key, "lang", "line", "src", "before3", F.col("f.ord").alias("f_ord"), F.col("f.name").alias("function_name"), *[F.col(f"f.{c}").alias(c) for c in _ABOUT])
    where = where.join(of_function, [key, "f_ord"], "left").withColumn("extern_input", F.coalesce("extern_input", F.lit(False)))
    types = sorted({n for r in rules for n in r.nodes} | {"selector_expression"})
    nodes = P.of_kind(facts, "node", key).where(F.col("type").isin(*types))
    at_node = nodes.select(key, "line", F.col("type").alias("node"), F.col("name").alias("callee"), F.col("ord").alias("node_ord"))
    triggered = where.join(at_node, [key, "line"])
    triggers = nodes.groupBy(key).agg(F.collect_set("type").alias("types"))
    in_file = where.join(triggers, key).withColumn("callee", F.lit(None).cast("string")).withColumn("node_ord", F.col("line"))

    def hits(rows: DataFrame, rules: list[Rule], gate) -> DataFrame:  # noqa: ANN001
        cells = [F.when((F.col("lang") == r.language) & gate(r) & r.when, F.struct(F.lit(r.name).alias("rule_name"), F.lit(r.cwe).alias("cwe"), F.lit(r.title).alias("title"), r.severity_column().alias("severity"), r.confidence_column().alias("confidence"))) for r in rules]
        found = rows.select(key, "lang", "line", "function_name", *_ABOUT, "node_ord", F.explode(F.array_compact(F.array(*cells))).alias("r"))
        return found.select(key, "lang", "line", "function_name", *_ABOUT, "node_ord", "r.*")

    by_node = hits(triggered, [r for r in rules if not r.whole_file], lambda r: F.col("node").isin(*r.nodes))
    by_whole = hits(in_file, [r for r in rules if r.whole_file], lambda r: F.arrays_overlap(F.col("types"), F.array(*[F.lit(n) for n in r.nodes])))
    found = by_node.unionByName(by_whole).unionByName(_special(lines, facts, functions, triggers, key))
    found = found.withColumn("function_name", F.coalesce("function_name", F.lit("unknown")))
    boosted = (F.col("severity") == "MEDIUM") & F.coalesce("reachable", F.lit(False)) & F.coalesce("extern_input", F.lit(False))
    found = found.withColumn("severity", F.when(boosted, "HIGH").otherwise(F.col("severity"))).withColumn("in_loop", F.coalesce(F.col("loop_depth") > 0, F.lit(False)))
    return dedup_first(found, [key, "rule_name", "function_name", "line"], ["node_ord"]).select(key, *FINDING)


def used_after(deletes: DataFrame, lines: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """``keys, take, at_line, ptr, use_line``: each delete of a pointer (``keys, take, line, ptr``) with the first
    later line of the file that uses it, unless it is set to null before or there.  ``lines`` has ``keys, line, src``.

    Uses and nulls are events of their pointer, so that a delete meets the events of its own pointer alone."""
    event = lambda k, p: F.struct(p.alias("ptr"), F.lit(k).alias("kind"))
    events = F.concat(F.transform(F.regexp_extract_all("src", F.lit(_NULLED), 1), lambda p: event(0, p)), F.array(event(1, F.regexp_extract("src", _USED, 1))))
    later = lines.select(*keys, "line", F.explode(events).alias("e")).select(*keys, "line", "e.ptr", "e.kind").where("ptr <> ''")
    right = later.groupBy(*keys, "ptr", "line").agg(F.min("kind").alias("kind")).withColumn("_at", F.struct("line", "kind"))
    left = deletes.select(*keys, *take, F.col("line").alias("at_line"), "ptr")
    found = first_after(left, right.select(*keys, "ptr", "line", "kind", "_at"), [*keys, "ptr"], take, "at_line", "line", "_at", lambda t: F.floor(t / 4096))
    return found.where("kind = 1").select(*keys, *take, "at_line", "ptr", F.col("line").alias("use_line"))


def _special(lines: DataFrame, facts: DataFrame, functions: DataFrame, triggers: DataFrame, key: str) -> DataFrame:
    """Rules 7 and 8 of C, 2 of C++ and 5 of Go, which look for pairs of places."""
    calls, allocs = P.of_kind(facts, "call", key), P.of_kind(facts, "allocation", key)
    hint = F.exists("args", lambda a: F.exists(F.array(*[F.lit(h) for h in POINTER_HINTS]), lambda h: a.contains(h)))
    after = first_after(
        allocs.where("lang = 'c' AND freed").select(key, "fn", F.col("free_line").alias("at"), F.col("ord").alias("a")),
        calls.where(F.col("lang") == "c").where(hint).select(key, "fn", "line", F.col("ord").alias("o")), [key, "fn"], ["a"], "at", "line", "o", lambda t: F.floor(t / 4096),
    )
    frees = calls.where("lang = 'c' AND name = 'free' AND size(args) > 0").select(key, "fn", F.expr("trim(BOTH '&* ' FROM args[0])").alias("arg"), "line")
    twice = repeated(frees, [key, "fn", "arg"], "line").where("n >= 2").select(key, "fn", F.col("last").alias("line"))
    deletes = lines.where("lang = 'cpp' AND ptr IS NOT NULL AND f IS NOT NULL").select(key, "line", "ptr", F.col("f.name").alias("fn"), F.col("f.end_line").alias("end"))
    used = used_after(deletes, lines.where("lang = 'cpp'").select(key, "line", "src"), [key], ["fn", "end"]).where("use_line <= end").select(key, "fn", F.col("use_line").alias("line"))
    args = lines.where("lang = 'go'").groupBy(key).agg(F.max_by(F.struct("line", F.col("f.name").alias("fn")), F.when(has(r"os\.Args\["), F.col("line"))).alias("x"), F.max(has(r"len\s*\(\s*os\.Args\s*\)")).alias("checked"))
    args = args.where("x IS NOT NULL AND NOT checked").join(triggers.where(F.array_contains("types", "selector_expression")), key, "left_semi").select(key, "x.fn", "x.line")
    info = functions.select(key, F.col("name").alias("function_name"), *_ABOUT)
    out = None
    for (name, language, cwe, title, severity, confidence), rows in zip(OTHERS, (after.select(key, "fn", "line"), twice, used, args), strict=True):
        rows = rows.select(key, F.col("fn").alias("function_name"), F.col("line").cast("int").alias("line")).join(info, [key, "function_name"], "left")
        rows = rows.select(key, F.lit(language).alias("lang"), "line", "function_name", *_ABOUT, F.col("line").alias("node_ord"), F.lit(name).alias("rule_name"), F.lit(cwe).alias("cwe"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(confidence).cast("double").alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_after(left: DataFrame, right: DataFrame, keys: list[str], id_: list[str], at: str, line: str, order: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """Of each left row the first right row of equal keys, in ``order``, whose ``line`` is after ``at``; left
    rows without one drop out.

    No pairs are made: a running minimum from the last line back gives each place the first of those after it.
    ``bucket`` cuts lines into ranges, each of which is a group of its own; the minima of later ranges are carried
    over, so that a key of many rows is not one task's work."""
    take = [c for c in right.columns if c not in keys]
    best = F.struct(F.col(order).alias("_o"), *take)
    a = left.select(*keys, *id_, F.col(at).alias("_t"), F.lit(0).alias("_r"), F.lit(None).cast(right.select(best.alias("x")).schema["x"].dataType).alias("_b"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in left.select(*id_).dtypes]
    rows = a.unionByName(right.select(*keys, *nothing, F.col(line).alias("_t"), F.lit(1).alias("_r"), best.alias("_b"))).withColumn("_k", bucket(F.col("_t")))
    w = Window.partitionBy(*keys, "_k").orderBy(F.desc("_t"), "_r").rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy(*keys, "_k").agg(F.min("_b").alias("_b"))
    later = per.select(*keys, "_k", F.min("_b").over(Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    found = rows.withColumn("_in", F.min("_b").over(w)).where("_r = 0").join(later, [*keys, "_k"], "left").withColumn("_b", F.least("_in", "_later")).where("_b IS NOT NULL")
    return found.select(*keys, *id_, F.col("_t").alias(at), *[F.col(f"_b.{c}").alias(c) for c in take])


def following(rows: DataFrame, keys: list[str], order: list[str], take: str, name: str, bucket: Column) -> DataFrame:
    """``rows`` with ``name``: ``take`` of the next row of equal keys in order, null for the last.

    ``bucket``, which must not fall as the order rises, cuts a key's rows into ranges, each of them a group of its
    own; the last row of a range gets the first of the next range."""
    ranged = rows.withColumn("_k", F.coalesce(bucket, F.lit(-(1 << 62))))
    inside = F.lead(F.struct(F.col(take).alias("v"))).over(Window.partitionBy(*keys, "_k").orderBy(*order))
    first = ranged.groupBy(*keys, "_k").agg(F.min_by(F.struct(F.col(take).alias("v")), F.struct(*order)).alias("_f"))
    after = first.select(*keys, "_k", F.lead("_f").over(Window.partitionBy(*keys).orderBy("_k")).alias("_n"))
    met = ranged.withColumn("_in", inside).join(after, [*keys, "_k"], "left")
    return met.select(*rows.columns, F.coalesce("_in", "_n")["v"].alias(name))


def repeated(rows: DataFrame, keys: list[str], line: str) -> DataFrame:
    """``keys, n, first, last`` of each group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(line).alias("first"), F.max(line).alias("last"))


def dedup_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group in the order given, ties broken by all columns; partial aggregation keeps
    one row a group and task before anything is moved."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*order, *[c for c in others if c not in order])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others]).select(*rows.columns)


def numbered(findings: DataFrame, order: list[Column | str], lang: str = "lang", id_: str = "vuln_id") -> DataFrame:
    """``vuln_id`` like ``SIFT-PY-001``: dense numbers of each language in the order given.

    Counts per range of the order are summed first, so that no task numbers a whole language."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for k, v in (("c", "C"), ("cpp", "CPP"), ("java", "JAVA"), ("python", "PY"), ("go", "GO")) for x in (k, v)]), F.col(lang))
    ranged = findings.repartitionByRange(lang, *order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged)
    sizes = ranged.groupBy(lang, "_p").agg(F.count("*").alias("_n"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(lang).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(lang, "_p").orderBy(*order))
    out = ranged.withColumn("_i", within).join(F.broadcast(offset), [lang, "_p"])
    return out.withColumn(id_, F.format_string("SIFT-%s-%03d", prefix, F.col("_i") + F.col("_o"))).drop("_p", "_i", "_o")
