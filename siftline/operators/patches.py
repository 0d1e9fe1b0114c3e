"""Patches as data: templates are patterns and replacements, applied to lines inside the JVM.

A finding's template is looked up in tiers, its place is the finding's line or the nearest within three that the
template's pattern matches, the line is rewritten by a regular expression, and the file is put together again
from its lines.  Only the unified diff is made in Python, file by file.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..session import cut
from ..sources import files as S
from . import joins

# Weaknesses and strategies by preference.
STRATEGIES = {
    "CWE-120": ["replace_strcpy_with_strncpy", "replace_gets_with_fgets", "replace_sprintf_with_snprintf", "add_bounds_check"],
    "CWE-121": ["add_stack_bounds_check", "replace_with_safe_alternative"], "CWE-122": ["add_heap_bounds_check", "validate_size_before_alloc"],
    "CWE-125": ["add_sizeof_bounds_check", "validate_copy_length"], "CWE-134": ["add_literal_format_string", "sanitize_format_argument"],
    "CWE-78": ["use_arg_list_no_shell", "sanitize_input"], "CWE-416": ["set_pointer_null_after_free", "use_ownership_pattern"],
    "CWE-415": ["add_null_check_before_free", "set_pointer_null_after_free"], "CWE-476": ["add_null_pointer_check"], "CWE-95": ["replace_eval_with_literal_eval", "use_ast_parse"],
    "CWE-502": ["replace_pickle_with_json", "validate_before_deserialize"], "CWE-22": ["validate_path_with_abspath", "use_safe_path_join"],
    "CWE-798": ["move_to_env_variable", "use_secrets_manager"], "CWE-242": ["remove_unsafe_pointer", "use_safe_alternative"],
    "CWE-390": ["add_error_handling", "propagate_error_return"], "CWE-20": ["add_input_validation", "add_bounds_check"], "CWE-362": ["add_mutex_lock", "use_atomic_operation"],
}
DEFAULT_STRATEGY = "manual_review"

# What each rewriting finds in the line, and the lines it puts there ($1.. are the groups).
REWRITES = {
    "strcpy": (r"strcpy\s*\(\s*(\w+)\s*,\s*(.+?)\s*\)\s*;", ["strncpy($1, $2, sizeof($1) - 1);", "$1[sizeof($1) - 1] = '\\\\0';  /* bounds-safe copy */"]),
    "strcat": (r"strcat\s*\(\s*(\w+)\s*,\s*(.+?)\s*\)\s*;", ["strncat($1, $2, sizeof($1) - strlen($1) - 1);  /* bounds-safe concat */"]),
    "gets": (r"gets\s*\(\s*(\w+)\s*\)\s*;", ["fgets($1, sizeof($1), stdin);  /* replaces unsafe gets() */", '$1[strcspn($1, "\\\\n")] = 0;  /* strip trailing newline */']),
    "sprintf": (r"sprintf\s*\(\s*(\w+)\s*,\s*(.+)\)\s*;", ["snprintf($1, sizeof($1), $2);  /* bounds-safe sprintf */"]),
    "scanf": (r"^(.*?)%s(.*)$", ["$1%.255s$2  /* bounded scanf */"]),
    "memcpy": (r"memcpy\s*\(\s*(\w+)\s*,\s*(\w+)\s*,\s*(.+?)\s*\)\s*;", ["/* bounds check before memcpy */", "if (($3) <= sizeof($1)) {", "    memcpy($1, $2, $3);", "} else {", "    memcpy($1, $2, sizeof($1));  /* clamped to dest size */", "}"]),
    "format": (r"""printf\s*\(([^"')\s][^)]*)\)\s*;""", ['printf("%s", $1);  /* literal format string */']),
    "system": (r"system\s*\(\s*(.+?)\s*\)\s*;", ["/* PATCHED: replaced system() with execve - no shell injection */", "{", '    char *argv[] = {"sh", "-c", $1, NULL};', "    /* TODO: replace with direct execve call without shell */", '    /* execve("/bin/sh", argv, NULL); */', "    (void)argv;  /* remove this line when implementing execve */", "}"]),
    "free": (r"free\s*\(\s*(\w+)\s*\)\s*;", ["free($1);", "$1 = NULL;  /* prevent use-after-free */"]),
    "free_guarded": (r"free\s*\(\s*(\w+)\s*\)\s*;", ["if ($1 != NULL) {", "    free($1);", "    $1 = NULL;  /* prevent double-free */", "}"]),
    "go_exec": (r'exec\.Command\s*\(\s*"(bash|sh)"\s*,\s*"-c"\s*,\s*(.+?)\s*\)', ["// PATCHED: Avoid shell execution (CWE-78)", 'exec.Command("$1", $2).Run()']),
}
# The templates in order: weakness, strategy, the line they look for, and their rewriting.
TEMPLATES = [
    ("CWE-120", "replace_strcpy_with_strncpy", r"\bstrcpy\s*\(", "strcpy"),
    ("CWE-120", "replace_strcat_with_strncat", r"\bstrcat\s*\(", "strcat"),
    ("CWE-120", "replace_gets_with_fgets", r"\bgets\s*\(", "gets"),
    ("CWE-120", "replace_with_safe_alternative", r"\bgets\s*\(", "gets"),
    ("CWE-120", "replace_sprintf_with_snprintf", r"\bsprintf\s*\(", "sprintf"),
    ("CWE-120", "add_bounds_check", r"\bscanf\s*\(", "scanf"),
    ("CWE-125", "validate_copy_length", r"\bmemcpy\s*\(", "memcpy"),
    ("CWE-134", "add_literal_format_string", r"""\b(printf|fprintf|sprintf|snprintf)\s*\([^"')\s]""", "format"),
    ("CWE-78", "use_execve_arg_array", r"\bsystem\s*\(", "system"),
    ("CWE-78", "use_arg_list_no_shell", r"\bsystem\s*\(", "system"),
    ("CWE-416", "set_pointer_null_after_free", r"\bfree\s*\(", "free"),
    ("CWE-415", "add_null_check_before_free", r"\bfree\s*\(", "free_guarded"),
    ("CWE-78", "use_arg_list_no_shell", r'exec\.Command\s*\(\s*"(bash|sh)"\s*,\s*"-c"', "go_exec"),
    ("CWE-78", "sanitize_input", r'exec\.Command\s*\(\s*"(bash|sh)"\s*,\s*"-c"', "go_exec"),
]


def first_strategy(cwe: Column) -> Column:
    """The preferred strategy of a weakness; manual review where there is none."""
    return C.looked_up({k: v[0] for k, v in STRATEGIES.items()}, cwe, DEFAULT_STRATEGY)


def register(name: str, cwe: str, strategy: str, pattern: str, find: str, puts: list[str]) -> None:
    """A further template: for lines that match ``pattern``, ``puts`` in place of what ``find`` finds.  Templates are
    tried in the order in which they were made known."""
    REWRITES[name] = (find, puts)
    TEMPLATES.append((cwe, strategy, pattern, name))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, s, p) for i, (c, s, p, _) in enumerate(TEMPLATES)], "template_ord int, cwe string, strategy string, pattern string")


def template(cwe: Column, strategy: Column, line: Column | None = None, matches: Callable[[int], Column] | None = None) -> Column:
    """``template_ord, tier`` as a struct, as ``joins.tiered`` finds them, without a join: of the templates of weakness
    and strategy (tier 1), else of the strategy (2), the first that the line matches, else the first; else the first
    of the weakness (3).  ``matches`` says of a template's number whether the line matches, where that is known."""
    cells = []
    for i, (c, s, pattern, _) in enumerate(TEMPLATES):
        here = matches(i) if matches else line.rlike(pattern)
        cell = lambda tier, miss, i=i: F.struct(F.lit(tier).alias("tier"), miss.alias("miss"), F.lit(i).alias("template_ord"))
        miss = F.when(F.coalesce(here, F.lit(False)), 0).otherwise(1)
        cells.append(F.when((cwe == c) & (strategy == s), cell(1, miss)).when(strategy == s, cell(2, miss)).when(cwe == c, cell(3, F.lit(0))))
    best = F.array_min(F.array_compact(F.array(*cells)))
    return F.struct(best["template_ord"].alias("template_ord"), best["tier"].alias("tier"))


def rewritten(template_ord: Column, line: Column) -> Column:
    """The line as its template rewrites it, lines joined by line ends and indented alike; the line itself
    where the rewriting finds nothing."""
    indent = F.regexp_extract(line, r"^(\s*)", 1)
    body = F.trim(line)
    out = line
    for i, (_, _, _, name) in enumerate(TEMPLATES):
        find, puts = REWRITES[name]
        found = F.regexp_extract(body, find, 0)
        new = F.regexp_replace(found, find, "\n".join(puts))
        if name == "scanf":
            new = F.concat(F.replace(body, F.lit("%s"), F.lit("%.255s")), F.lit("  /* bounded scanf */"))
        new = F.concat(indent, F.replace(new, F.lit("\n"), F.concat(F.lit("\n"), indent)))
        out = F.when((template_ord == i) & body.rlike(find), new).otherwise(out)
    return out


def apply(files: DataFrame, findings: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Results and patched files.

    ``findings`` has ``key, finding_id, cwe, strategy, line``.  Results: ``key, finding_id, template_ord,
    line_patched, success, error``; a finding without a template, or without a line within three that its
    template looks for, fails; a line that the rewriting leaves as it is counts as success; of several findings
    that come to one line the first, by template and id, rewrites it and the others succeed with it.  Files:
    ``key, original, patched`` of those with a rewritten line.
    """
    # one pass over the texts: the lines that any template looks for, with its numbers
    patterns = dict.fromkeys(p for _, _, p, _ in TEMPLATES)
    found = F.flatten(F.array(*[F.when(F.col("src").rlike(p), F.array(*[F.lit(i) for i, t in enumerate(TEMPLATES) if t[2] == p])).otherwise(F.array().cast("array<int>")) for p in patterns]))
    lines = cut(S.lines(files.select(key, text), text, key).withColumn("ords", found).where(F.size("ords") > 0))
    targets = findings.join(lines.select(key, "line", "ords"), [key, "line"], "left")
    chosen = cut(targets.select(key, "finding_id", "line", template(F.col("cwe"), F.col("strategy"), matches=lambda i: F.array_contains("ords", i))["template_ord"].alias("template_ord")))
    near = chosen.where("template_ord IS NOT NULL").select(key, "finding_id", "template_ord", F.col("line").alias("at_line"))
    matching = lines.select(key, F.explode("ords").alias("template_ord"), "line")
    placed = joins.nearest_within(near, matching, [key, "template_ord"], ["finding_id"], "at_line", "line")
    none = chosen.where("template_ord IS NULL").select(key, "finding_id", "template_ord", F.lit(None).cast("int").alias("nearest_line"))
    results = cut(placed.select(key, "finding_id", "template_ord", "nearest_line").unionByName(none))
    results = results.select(key, "finding_id", "template_ord", F.col("nearest_line").alias("line_patched"), F.col("nearest_line").isNotNull().alias("success"), F.when(F.col("template_ord").isNull(), "No template found").when(F.col("nearest_line").isNull(), "No matching line").alias("error"))
    edits = results.where("success").groupBy(key, F.col("line_patched").alias("line")).agg(F.min_by("template_ord", F.struct("template_ord", "finding_id")).alias("template_ord"))
    new = edits.join(lines.select(key, "line", "src"), [key, "line"]).select(key, "line", rewritten(F.col("template_ord"), F.col("src")).alias("new"))
    per_file = new.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("line", "new"))).alias("_new"))
    joined = files.select(key, F.col(text).alias("original")).join(per_file, key)
    patched = F.array_join(F.transform(S.split_lines(F.col("original")), lambda x, i: F.coalesce(F.try_element_at("_new", i + 1), x)), "\n")
    return results, joined.select(key, "original", F.concat(patched, F.lit("\n")).alias("patched"))


def diffs(patched: DataFrame, key: str) -> DataFrame:
    """``key, diff``: the unified diff of each patched file."""
    kind = dict(patched.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ["".join(difflib.unified_diff((x or "").splitlines(keepends=True), (y or "").splitlines(keepends=True), "original", "patched")) for x, y in zip(b["original"].to_pylist(), b["patched"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(out, pa.string())], [key, "diff"])

    return patched.select(key, "original", "patched").mapInArrow(run, f"{key} {kind}, diff string")


def verified(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Per file ``n_before, n_after, n_fixed, n_remaining, fix_rate`` of findings by rule and line; patches that
    add lines move the findings below them, which then count as fixed and new, as keys hold the line."""
    keys = [key, "rule_name", "line"]
    fate = joins.compared(before, after, keys)
    per = fate.groupBy(key).agg(F.count_if(F.col("fate") != "new").alias("n_before"), F.count_if(F.col("fate") != "fixed").alias("n_after"), F.count_if(F.col("fate") == "fixed").alias("n_fixed"), F.count_if(F.col("fate") == "remaining").alias("n_remaining"))
    gone = F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0))
    return per.withColumn("fix_rate", F.when(F.col("n_before") == 0, 1.0).otherwise(F.round(gone / F.nullif(F.col("n_before"), F.lit(0)), 6)))
