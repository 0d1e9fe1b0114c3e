"""Columns over code and scores; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh, spread
from ..sources.files import split_lines

# Caps of the structural features, words that branch, and signs of pointers.
MOST = {"tokens": 512, "lines": 200, "depth": 20, "calls": 50, "branches": 30, "line_length": 120}
BRANCHES = "if|else|elif|switch|case|for|while|do|try|catch|except|finally"
POINTERS = r"\*\s*\w|\w\s*->|(?<!\w)(?:malloc|free|new|delete)(?!\w)|&\w"
FEATURES = ["n_tokens", "n_lines", "avg_line_len", "n_function_calls", "n_branches", "max_nesting_depth", "has_pointer_ops", "cyclomatic_proxy"]
SEVERITY_SCORE = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.2, "INFO": 0.05}
SEVERITY_RANK = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
LANGUAGE_RISK = {"c": 1.0, "go": 0.6, "python": 0.5}
BUCKETS = [(0.90, "CRITICAL"), (0.70, "HIGH"), (0.45, "MEDIUM"), (0.20, "LOW")]
CVSS = {
    "CWE-120": 7.5, "CWE-121": 7.8, "CWE-122": 7.8, "CWE-125": 6.5, "CWE-134": 7.5, "CWE-20": 5.3, "CWE-22": 6.5, "CWE-242": 5.5, "CWE-362": 7.0, "CWE-390": 4.3,
    "CWE-401": 5.5, "CWE-415": 8.1, "CWE-416": 8.1, "CWE-476": 6.5, "CWE-502": 9.1, "CWE-617": 4.3, "CWE-78": 9.8, "CWE-798": 7.5, "CWE-95": 9.8,
}
CVSS_DEFAULT = 5.0
SINK_BOOST = {"gets": 0.25, "strcpy": 0.15, "system": 0.20, "sprintf": 0.10, "scanf": 0.10, "eval": 0.25, "pickle": 0.20}
TAINT_BOOST, EXTERN_BOOST, LEAST_PROBABILITY, MOST_PROBABILITY = 0.15, 0.10, 0.05, 0.98
WEIGHTS = {"text": 0.5, "graph": 0.3, "tree": 0.2}


def looked_up(values: dict, key: Column, default: object = None) -> Column:
    """The value of a small fixed table; the default for keys it lacks, and for null."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.coalesce(key, F.lit(""))), F.lit(default))


def count(text: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.regexp_count(text, F.lit(pattern))


def with_structural_features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns kept and the eight structural features of a code, each 0..1; null for a null text.

    Tokens are runs of non-space characters; a call is a word before a bracket; nesting is a quarter of the
    widest indent in spaces, or the widest in a line with tabs.  Words end at anything but ASCII letters, digits
    and underscores.  Lines are split once, in a projection of their own.
    """
    t, lines, full, n_branches = fresh([*keep, *FEATURES], "_text", "_lines", "_full", "_branches")
    rows = spread(df.select(*keep, F.col(text).alias(t))).withColumn(lines, split_lines(F.col(t)))
    rows = rows.withColumn(full, F.filter(lines, lambda s: s.rlike(r"\S"))).withColumn(n_branches, F.least(count(F.col(t), rf"(?<!\w)(?:{BRANCHES})(?!\w)"), F.lit(MOST["branches"])))
    n = F.size(full)
    indent = lambda s: F.length(s) - F.length(F.regexp_replace(s, r"^[ \t\x0b\f]+", ""))
    depth = F.array_max(F.transform(full, lambda s: F.when(s.contains("\t"), indent(s)).otherwise(F.floor(indent(s) / 4).cast("int"))))
    capped = lambda x, k: F.least(x, F.lit(MOST[k])) / F.lit(float(MOST[k]))
    mean = F.when(n > 0, F.aggregate(full, F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)) / n).otherwise(0.0)
    out = {
        "n_tokens": capped(count(F.col(t), r"\S+"), "tokens"),
        "n_lines": capped(F.size(lines), "lines"),
        "avg_line_len": F.least(mean / MOST["line_length"], F.lit(1.0)),
        "n_function_calls": capped(count(F.col(t), r"(?<![A-Za-z0-9_])[A-Za-z0-9_]++\s*\("), "calls"),
        "n_branches": F.col(n_branches) / float(MOST["branches"]),
        "max_nesting_depth": capped(F.coalesce(depth, F.lit(0)), "depth"),
        "has_pointer_ops": F.when(F.col(t).rlike(POINTERS), 1.0).otherwise(0.0),
        "cyclomatic_proxy": (F.col(n_branches) + 1) / float(MOST["branches"] + 1),
    }
    return rows.select(*keep, *[F.when(F.col(t).isNotNull(), F.round(v, 6)).alias(k) for k, v in out.items()])


def bucket(score: Column) -> Column:
    """The severity of a score; null for null."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in BUCKETS:
        out = out.when(score >= least, name)
    return out.otherwise("INFO")


def bucket_of_base_score(score: Column) -> Column:
    """The severity of a base score of 0..10."""
    return F.when(score.isNull(), F.lit(None).cast("string")).when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def heuristic_risk(severity: Column, confidence: Column, risk: Column) -> Column:
    """The model's risk where there is one, else weight of the severity times confidence, rounded to 4."""
    return F.coalesce(risk, F.round(looked_up(SEVERITY_SCORE, F.upper(severity), 0.5) * confidence, 4))


def base_score(cwe: Column) -> Column:
    """The weakness's usual base score, 0..1."""
    return F.round(looked_up(CVSS, cwe, CVSS_DEFAULT) / 10, 4)


def composite_risk(x: dict[str, Column]) -> Column:
    """Risk of features that were divided by their column's maximum: severity, exploitability, context."""
    severity = 0.5 * x["cwe_cvss_score"] + 0.3 * x["severity_score"] + 0.2 * x["confidence"]
    exploit = 0.3 * x["reachable_from_entry"] + 0.3 * x["has_extern_input"] + 0.1 * (x["pointer_ops"] + x["unsafe_api_count"] + x["alloc_without_free"] + x["language_risk"])
    context = 0.4 * x["call_depth"] + 0.3 * x["in_loop"] + 0.3 * x["loop_depth"]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * severity + 0.35 * exploit + 0.15 * context))


def epsilon(id_: Column) -> Column:
    """A small number, 0..0.049, fixed by the id."""
    return F.pmod(F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(50)) / 1000.0


def ensemble(parts: dict[str, Column], function: Column, taint: Column, extern: Column, id_: Column) -> Column:
    """The mean of the models that gave a probability, by weight; raised for sinks, taint and input from
    outside; kept within 0.05..0.98, plus the id's epsilon, at most 1; rounded to 4.  Null without a model."""
    weight = sum((F.when(p.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, p in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(p, F.lit(0.0)) * WEIGHTS[k] for k, p in parts.items()), F.lit(0.0))
    boost = looked_up(SINK_BOOST, F.lower(function), 0.0) + F.when(taint, TAINT_BOOST).otherwise(0.0) + F.when(extern, EXTERN_BOOST).otherwise(0.0)
    raised = F.greatest(F.lit(LEAST_PROBABILITY), F.least(F.lit(MOST_PROBABILITY), total / F.nullif(weight, F.lit(0.0)) + boost))
    return F.when(weight > 0, F.round(F.least(F.lit(1.0), raised + epsilon(id_)), 4))


def decision(raw: Column, known: list[str], default: str) -> dict[str, Column]:
    """Strategy and reason from a model's answer: the JSON object in it, if any; its strategy as it is or as
    one of the known ones that contains it or is contained; else the first known one named in the text; else
    the default.  A null answer gives the default and a null reason."""
    object_ = F.regexp_extract(raw, r"(?s)\{.*?\}", 0)
    said = F.lower(F.trim(F.get_json_object(object_, "$.strategy")))
    names = F.array(*[F.lit(k) for k in known])
    near = F.get(F.filter(names, lambda k: (said != "") & (k.contains(said) | said.contains(k))), F.lit(0))
    named = F.get(F.filter(names, lambda k: F.lower(raw).contains(k)), F.lit(0))
    reason = F.coalesce(F.get_json_object(object_, "$.reasoning"), F.get_json_object(object_, "$.why"), raw)
    return {"strategy": F.coalesce(F.when(said.isin(*known), said), near, named, F.lit(default)), "reason": reason}
