"""Queries over the table of source files, and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import dataset, joins, reports, rules
from ..session import cut, table
from ..sources import files, parse


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "samples").select("sample_id", F.lower(F.trim("language")).alias("lang"), "raw_code", "source", "repo", "file_path", "label")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return files.lines(_samples(spark, folder), "raw_code", "sample_id", "lang").withColumn("src", F.trim("src"))


def structural_features(spark: SparkSession, folder: str) -> DataFrame:
    return C.with_structural_features(table(spark, folder, "samples").where("raw_code IS NOT NULL"), "raw_code", ["sample_id"])


def line_explode_counts(spark: SparkSession, folder: str) -> DataFrame:
    each = files.lines(table(spark, folder, "samples"), "raw_code", "sample_id")
    return each.groupBy("sample_id").agg(F.count("*").alias("n_lines"), F.max("line").alias("last_line"), F.sum(F.length("src")).alias("n_chars"))


def risk_rank_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by a risk made of their structural features over their maxima, with severities and ranks."""
    docs = cut(C.with_structural_features(table(spark, folder, "documents").where("text IS NOT NULL"), "text", ["doc_id", "source"]))
    x = dataset.normalised(docs, C.FEATURES)
    score = 0.5 * (0.5 * F.col("n_function_calls") + 0.3 * F.col("has_pointer_ops") + 0.2 * F.col("n_tokens")) + 0.35 * (0.6 * F.col("n_branches") + 0.4 * F.col("cyclomatic_proxy")) + 0.15 * (0.5 * F.col("max_nesting_depth") + 0.3 * F.col("n_lines") + 0.2 * F.col("avg_line_len"))
    return x.select("doc_id", "source", F.round(score, 5).alias("risk")).withColumn("severity", C.bucket(F.col("risk"))).orderBy(F.desc("risk"), "doc_id")


def _hits(language: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rules.line_hits(_lines(spark, folder).where(F.col("lang") == language), language, "sample_id", "line")

    return query


def md5_dedup_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "samples").where("raw_code IS NOT NULL").select("sample_id", F.md5(F.col("raw_code").cast("binary")).alias("digest"), "source")
    return rows.groupBy("digest").agg(F.min("sample_id").alias("sample_id"), F.min_by("source", "sample_id").alias("source"), F.count("*").alias("n_copies"))


def prior3_window_anti(spark: SparkSession, folder: str) -> DataFrame:
    checked = rules.before3(_lines(spark, folder).where("lang IN ('c', 'cpp')"), ["sample_id"], F.col("src").rlike(r"nullptr|NULL|if\s*\("))
    return checked.where(F.col("src").contains("->") & ~F.col("before3")).select("sample_id", "line")


def nearest_band_match(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).where("lang IN ('c', 'cpp')")
    targets = lines.where(F.col("src").rlike(r"\bgets\s*\(")).select("sample_id", F.col("line").alias("at_line"))
    candidates = lines.where(F.col("src").rlike(r"\b(strcpy|sprintf|memcpy)\s*\(")).select("sample_id", "line")
    return joins.nearest_within(targets, candidates, ["sample_id"], ["at_line"], "at_line", "line")


def use_after_delete_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each delete with the first later use of its pointer in the file before the pointer is set to null."""
    lines = _lines(spark, folder).where("lang = 'cpp'").select("sample_id", "line", "src")
    gone = lines.withColumn("ptr", F.regexp_extract("src", r"\bdelete(?:\[\])?\s+(\w+)\s*;", 1)).where("ptr <> ''")
    return rules.used_after(gone, lines, ["sample_id"], [])


def snippets_of_calls(spark: SparkSession, folder: str) -> DataFrame:
    return rules.snippet(_lines(spark, folder).where("lang = 'c'"), ["sample_id"]).where(F.col("src").rlike(r"\bsystem\s*\(")).select("sample_id", "line", "code_snippet")


def files_per_language(spark: SparkSession, folder: str) -> DataFrame:
    return files.per_language(_samples(spark, folder))


def language_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "samples").select(files.language_of(F.col("file_path")).alias("by_extension"), F.lower(F.trim("language")).alias("lang"))
    return rows.groupBy("by_extension", "lang").agg(F.count("*").alias("n"))


def file_tree(spark: SparkSession, folder: str) -> DataFrame:
    return reports.tree(table(spark, folder, "samples"), "file_path")


def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder)
    return rows.agg(F.count("*").alias("n_files"), F.count("raw_code").alias("n_read"), F.countDistinct("lang").alias("n_languages"), F.coalesce(F.sum(F.size(files.split_lines(F.col("raw_code")))), F.lit(0)).alias("n_lines"))


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The three sources under one schema, named, with their sizes."""
    a = table(spark, folder, "samples").select(F.lit("samples").alias("origin"), F.col("raw_code").alias("text"), F.col("label").alias("label"))
    b = table(spark, folder, "split_samples").select(F.lit("split_samples").alias("origin"), F.col("raw").alias("text"), F.col("label").alias("label"))
    c = table(spark, folder, "documents").select(F.lit("documents").alias("origin"), "text", F.lit(None).cast("int").alias("label"))
    kept = a.unionByName(b).unionByName(c).where(F.length(F.trim("text")) >= 20)
    return kept.groupBy("origin", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def first_n_per_source(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.first_of_each(table(spark, folder, "samples").select("sample_id", "source", "repo"), "source", 25, ["sample_id"])


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return cut(parse.facts(_samples(spark, folder), text="raw_code", lang="lang", keep=("sample_id",)))


def fact_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).groupBy("lang", "kind").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_files"))


def functions_found(spark: SparkSession, folder: str) -> DataFrame:
    return parse.of_kind(_facts(spark, folder), "function", "sample_id")


def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    return rules.scan(_samples(spark, folder), _facts(spark, folder), "sample_id", "raw_code")


def scan_numbered(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_findings(spark, folder)
    return rules.numbered(found, ["sample_id", "line", "rule_name", "function_name"]).select("vuln_id", "sample_id", "lang", "rule_name", "line", "severity")


def unsafe_calls_per_function(spark: SparkSession, folder: str) -> DataFrame:
    calls = parse.of_kind(_facts(spark, folder), "call", "sample_id")
    unsafe = spark.createDataFrame([(g, n) for g, names in dataset.UNSAFE.items() for n in names], "lang string, name string")
    return dataset.unsafe_calls(calls, unsafe, ["sample_id", "fn"])


def unfreed_per_function(spark: SparkSession, folder: str) -> DataFrame:
    """Functions with an allocation that no free follows, by file."""
    rows = parse.of_kind(_facts(spark, folder), "allocation", "sample_id")
    return rows.groupBy("sample_id", "fn").agg(F.max(~F.col("freed")).alias("any_unfreed"), F.count("*").alias("n_allocations"))


_LINES = r"""lines AS (SELECT sample_id, lang, trim(unnest(ls), ' ') AS src, unnest(range(1, len(ls) + 1))::INT AS line FROM (
  SELECT sample_id, lower(trim(language)) AS lang, CASE WHEN raw_code = '' THEN [] ELSE string_split_regex(regexp_replace(raw_code, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END AS ls FROM samples WHERE raw_code IS NOT NULL))"""


def _features_sql(key: str, text: str, table_: str) -> str:
    return rf"""SELECT {key},
  round(least(len(regexp_extract_all({text}, '\S+')), 512) / 512.0::DOUBLE, 6) AS n_tokens,
  round(least(len(ls), 200) / 200.0::DOUBLE, 6) AS n_lines,
  round(least(CASE WHEN len(full_) > 0 THEN list_sum(list_transform(full_, lambda s: length(s)))::DOUBLE / len(full_) ELSE 0 END / 120, 1.0), 6) AS avg_line_len,
  round(least(len(regexp_extract_all({text}, '[A-Za-z0-9_]+\s*\(')), 50) / 50.0::DOUBLE, 6) AS n_function_calls,
  round(b / 30.0::DOUBLE, 6) AS n_branches,
  round(least(coalesce(list_max(list_transform(full_, lambda s: CASE WHEN contains(s, chr(9)) THEN length(s) - length(regexp_replace(s, '^[ \t\x0b\f]+', '')) ELSE (length(s) - length(regexp_replace(s, '^[ \t\x0b\f]+', ''))) // 4 END)), 0), 20) / 20.0::DOUBLE, 6) AS max_nesting_depth,
  CASE WHEN regexp_matches({text}, '\*\s*\w|\w\s*->|\bmalloc\b|\bfree\b|\bnew\b|\bdelete\b|&\w') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_pointer_ops,
  round((b + 1) / 31.0::DOUBLE, 6) AS cyclomatic_proxy
FROM (SELECT *, list_filter(ls, lambda s: regexp_matches(s, '\S')) AS full_, least(len(regexp_extract_all({text}, '\b(?:if|else|elif|switch|case|for|while|do|try|catch|except|finally)\b')), 30) AS b
FROM (SELECT *, CASE WHEN {text} = '' THEN [] ELSE string_split_regex(regexp_replace({text}, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') END AS ls FROM {table_} WHERE {text} IS NOT NULL))"""


def _hits_sql(language: str, cases: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in cases.items())
    return f"WITH {_LINES} SELECT sample_id, line, rule_name FROM (SELECT sample_id, line, unnest([{listed}]) AS rule_name FROM lines WHERE lang = '{language}') WHERE rule_name IS NOT NULL"


def _m(pattern: str) -> str:
    return "regexp_matches(src, '" + pattern.replace("'", "''") + "')"


_BUCKET = "CASE WHEN {0} >= 0.9 THEN 'CRITICAL' WHEN {0} >= 0.7 THEN 'HIGH' WHEN {0} >= 0.45 THEN 'MEDIUM' WHEN {0} >= 0.2 THEN 'LOW' ELSE 'INFO' END"

SQL = {
    "structural_features": _features_sql("sample_id", "raw_code", "samples"),
    "line_explode_counts": f"WITH {_LINES.replace('trim(unnest(ls), ' + chr(39) + ' ' + chr(39) + ')', 'unnest(ls)')} SELECT sample_id, count(*) AS n_lines, max(line) AS last_line, sum(length(src))::BIGINT AS n_chars FROM lines GROUP BY 1",
    "risk_rank_documents": f"""WITH f AS ({_features_sql("doc_id, source", "text", "documents")}),
m AS (SELECT {", ".join(f"CASE WHEN max({c}) > 0 THEN max({c}) ELSE 1 END AS m_{c}" for c in C.FEATURES)} FROM f),
x AS (SELECT doc_id, source, {", ".join(f"{c} / m_{c} AS {c}" for c in C.FEATURES)} FROM f, m),
r AS (SELECT doc_id, source, round(0.5 * (0.5 * n_function_calls + 0.3 * has_pointer_ops + 0.2 * n_tokens) + 0.35 * (0.6 * n_branches + 0.4 * cyclomatic_proxy) + 0.15 * (0.5 * max_nesting_depth + 0.3 * n_lines + 0.2 * avg_line_len), 5) AS risk FROM x)
SELECT doc_id, source, risk, {_BUCKET.format("risk")} AS severity FROM r""",
    "rule_hits_python": _hits_sql("python", {
        "unsafe_deserialization": _m(r"pickle\.(loads?|Unpickler)"),
        "subprocess_shell_injection": "contains(src, 'subprocess') AND (contains(src, 'shell=True') OR contains(src, 'shell = True'))",
        "os_system_injection": _m(r"os\.(system|popen)\s*\("),
        "path_traversal": _m(r"\bopen\s*\(") + " AND NOT " + _m(r"""open\s*\(\s*["']"""),
        "hardcoded_secret": _m(r"""(?i)(password|passwd|secret|api_key|apikey|token|auth_token|private_key|access_key|secret_key|credentials)\s*=\s*["'][^"']{4,}["']""") + " AND NOT " + _m("(?i)(your_|example|placeholder|changeme|xxx|todo)"),
    }),
    "rule_hits_java": _hits_sql("java", {
        "sql_injection_string_concat": _m(r"(?i)(executeQuery|executeUpdate|prepareStatement|createStatement)\s*\([^)]*\+") + " AND NOT " + _m(r'prepareStatement\s*\(\s*"[^"]*\?'),
        "runtime_exec_command_injection": _m(r"Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec\s*\("),
        "hardcoded_password_credential": _m(r"""(?i)(password|passwd|pwd|secret|credential|apikey|api_key|authtoken|auth_token)\s*=\s*["'][^"']{4,}["']""") + " AND NOT " + _m(r"(?i)(your_|example|placeholder|changeme|xxx|todo|<|>|\{|\})"),
        "null_return_not_checked": _m(r"(?i)\b(get|find|lookup|fetch|load|read|next|peek|poll|remove|getProperty|getenv|getParameter|getAttribute|getHeader)\s*\(") + " AND " + _m(r"\)\s*\.") + " AND NOT " + _m(r"(Optional|Objects\.requireNonNull|!= null|== null|isPresent|orElse)"),
        "hardcoded_crypto_key": "(" + _m(r"(?i)(key|secretkey|aeskey|deskey|privatekey|ivspec|initvector|iv|hmackey)\s*=\s*") + " AND " + _m(r"""(["'][^"']{4,}["']|new\s+(byte|char)\s*\[\s*\]\s*\{[^}]+\})""") + ") OR (" + _m(r"(SecretKeySpec|IvParameterSpec|SecretKeyFactory)\s*\(") + " AND (" + _m(r"""(SecretKeySpec|IvParameterSpec)\s*\([^)]*["']""") + " OR " + _m(r"(SecretKeySpec|IvParameterSpec)\s*\([^)]*getBytes") + "))",
    }),
    "rule_hits_go": _hits_sql("go", {
        "go_exec_command_injection": _m(r"exec\.Command\s*\(") + " AND NOT " + _m(r'exec\.Command\s*\(\s*"[^"]+"\s*\)'),
        "go_unsafe_pointer": "(contains(src, 'unsafe.Pointer') OR contains(src, 'unsafe.Sizeof')) AND NOT contains(src, 'import')",
        "go_ignored_error": _m(r"^\s*\w+\s*,\s*_\s*:?=|^\s*_\s*,\s*\w+\s*:?=|^\s*_\s*=") + " AND NOT contains(src, 'range ') AND NOT contains(src, 'for ')",
        "go_fmt_sprintf_injection": _m(r"fmt\.(Sprintf|Fprintf|Printf|Errorf)\s*\(") + " AND NOT " + _m(r'fmt\.\w+\s*\(\s*"') + " AND NOT " + _m(r'fmt\.Fprintf\s*\(\s*\w+\s*,\s*"'),
        "go_hardcoded_secret": _m(r'(?i)(password|passwd|secret|apiKey|api_key|token|authToken|privateKey|accessKey|secretKey|credentials)\s*[=:]\s*"[^"]{4,}"') + " AND NOT " + _m("(?i)(example|placeholder|your_|changeme)"),
    }),
    "rule_hits_cpp": _hits_sql("cpp", {
        "char_array_buffer_issue": _m(r"\bchar\s+\w+\s*\[\s*\d+\s*\]") + " AND NOT (contains(src, 'const') AND contains(src, '=') AND contains(src, '\"'))",
        "cpp_system_command_injection": _m(r"\bsystem\s*\(") + " AND (NOT " + _m(r"""system\s*\(\s*["']""") + " OR " + _m(r"""system\s*\(\s*([^"'(]+\+|cmd|command|buf|input)""") + ")",
        "integer_overflow_array_size": _m(r"new\s+\w[\w:<>*\s]*\[\s*\w+\s*[*+]\s*\w+") + " AND NOT " + _m("(size_t|static_cast|checked_|overflow)"),
        "ofstream_incorrect_permissions": _m(r"""\bofstream\b|\bofs\.open\s*\(|\bfopen\s*\(.*["']w""") + " AND NOT " + _m(r"(chmod|umask|ios::out\s*\|)"),
    }),
    "md5_dedup_keep_first": "SELECT md5(raw_code) AS digest, min(sample_id) AS sample_id, arg_min_null(source, sample_id) AS source, count(*) AS n_copies FROM samples WHERE raw_code IS NOT NULL GROUP BY 1",
    "prior3_window_anti": rf"WITH {_LINES}, c AS (SELECT *, coalesce(bool_or({_m('nullptr|NULL|if' + chr(92) + 's*' + chr(92) + '(')}) OVER (PARTITION BY sample_id ORDER BY line ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS b FROM lines WHERE lang IN ('c', 'cpp')) SELECT sample_id, line FROM c WHERE contains(src, '->') AND NOT b",
    "nearest_band_match": rf"""WITH {_LINES}, t AS (SELECT sample_id, line AS at_line FROM lines WHERE lang IN ('c', 'cpp') AND {_m(chr(92) + 'bgets' + chr(92) + 's*' + chr(92) + '(')}), k AS (SELECT sample_id, line FROM lines WHERE lang IN ('c', 'cpp') AND {_m(chr(92) + 'b(strcpy|sprintf|memcpy)' + chr(92) + 's*' + chr(92) + '(')}),
j AS (SELECT t.sample_id, at_line, k.line, k.line - at_line AS delta, row_number() OVER (PARTITION BY t.sample_id, at_line ORDER BY abs(k.line - at_line), CASE WHEN k.line < at_line THEN 1 ELSE 0 END) AS r FROM t LEFT JOIN k ON k.sample_id = t.sample_id AND k.line BETWEEN at_line - 3 AND at_line + 3)
SELECT sample_id, at_line, line AS nearest_line, delta FROM j WHERE r = 1""",
    "use_after_delete_lines": rf"""WITH {_LINES}, d AS (SELECT sample_id, line AS at_line, regexp_extract(src, '\bdelete(?:\[\])?\s+(\w+)\s*;', 1) AS ptr FROM lines WHERE lang = 'cpp'),
l AS (SELECT d.sample_id, at_line, ptr, line, regexp_matches(src, '\b' || ptr || '\s*=\s*nullptr') AS stop, regexp_extract(src, '\b(\w+)\s*(?:->|\[|\*)', 1) = ptr AS use FROM d JOIN lines ON lines.sample_id = d.sample_id AND line > at_line AND lang = 'cpp' WHERE ptr <> ''),
b AS (SELECT sample_id, at_line, ptr, min(line) FILTER (WHERE stop) AS s, min(line) FILTER (WHERE use AND NOT stop) AS u FROM l GROUP BY 1, 2, 3)
SELECT sample_id, at_line, ptr, u AS use_line FROM b WHERE u IS NOT NULL AND (s IS NULL OR u < s)""",
    "snippets_of_calls": rf"""WITH {_LINES}, w AS (SELECT sample_id, line, src, lag(src) OVER p AS b, lead(src) OVER p AS a FROM lines WHERE lang = 'c' WINDOW p AS (PARTITION BY sample_id ORDER BY line))
SELECT sample_id, line, concat_ws(chr(10), CASE WHEN b IS NOT NULL THEN format('    {{:4d}} | {{}}', line - 1, rtrim(b, ' ')) END, format('>>> {{:4d}} | {{}}', line, rtrim(src, ' ')), CASE WHEN a IS NOT NULL THEN format('    {{:4d}} | {{}}', line + 1, rtrim(a, ' ')) END) AS code_snippet FROM w WHERE {_m(chr(92) + 'bsystem' + chr(92) + 's*' + chr(92) + '(')}""",
    "files_per_language": "SELECT lower(trim(language)) AS lang, count(*) AS n_files FROM samples GROUP BY 1",
    "language_by_extension": r"SELECT CASE lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' END AS by_extension, lower(trim(language)) AS lang, count(*) AS n FROM samples GROUP BY 1, 2",
    "file_tree": """WITH p AS (SELECT string_split(file_path, '/') AS s FROM (SELECT DISTINCT file_path FROM samples WHERE file_path IS NOT NULL)),
r AS (SELECT array_to_string(s[1:i - 1], '/') AS parent, s[i] AS name, i < len(s) AS is_dir FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p)),
n AS (SELECT parent, name, is_dir, count(*) AS n_files FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, name)::INT AS place FROM n""",
    "corpus_summary": r"SELECT count(*) AS n_files, count(raw_code) AS n_read, count(DISTINCT lower(trim(language))) AS n_languages, sum(CASE WHEN raw_code = '' THEN 0 ELSE len(string_split_regex(regexp_replace(raw_code, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r')) END)::BIGINT AS n_lines FROM samples",
    "union_sources": "SELECT origin, label, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM (SELECT 'samples' AS origin, raw_code AS text, label FROM samples UNION ALL SELECT 'split_samples', raw, label FROM split_samples UNION ALL SELECT 'documents', text, NULL FROM documents) WHERE length(trim(text, ' ')) >= 20 GROUP BY 1, 2",
    "first_n_per_source": "SELECT sample_id, source, repo FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sample_id) AS r FROM samples) WHERE r <= 25",
}


def queries():  # noqa: ANN201
    out = {f.__name__: f for f in (structural_features, line_explode_counts, risk_rank_documents, md5_dedup_keep_first, prior3_window_anti, nearest_band_match, use_after_delete_lines, snippets_of_calls, files_per_language, language_by_extension, file_tree, corpus_summary, union_sources, first_n_per_source, fact_counts, functions_found, scan_findings, scan_numbered, unsafe_calls_per_function, unfreed_per_function)}
    return out | {f"rule_hits_{g}": _hits(g) for g in ("python", "java", "go", "cpp")}
