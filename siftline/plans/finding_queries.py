"""Queries over scored findings, decisions and standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import dataset, joins, metrics, models, patches, references, reports, rules
from ..session import cut, table

#: Findings scanned before this belong to the earlier half.
HALF = "2025-01-01"


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "scored_vulns")


def _once(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``finding_id`` and the columns named of findings without their redeliveries: of each id the first that came
    in.  Redelivered rows hold the same values, so that the time alone decides."""
    best = _findings(spark, folder).groupBy("finding_id").agg(F.min_by(F.struct(*columns), F.coalesce("ingested_at", F.expr("timestamp_ntz'9999-12-31'"))).alias("_b"))
    return best.select("finding_id", *[F.col(f"_b.{c}").alias(c) for c in columns])


def finding_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.counts(_findings(spark, folder), ["severity", "cwe", "language"])


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.summary(_findings(spark, folder), "severity", "risk_score")


def scored_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.scored_summary(_findings(spark, folder), "exploit_prob", "risk_score", "composite_risk")


def recon_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _findings(spark, folder)
    return rows.agg(F.countDistinct("function_name").alias("n_functions"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n_severe"), F.count_if("taint_confirmed").alias("n_tainted"), F.countDistinct("source_file").alias("n_files"))


def finding_dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    rows = _findings(spark, folder).select("finding_id", "rule_name", "function_name", "line_start", "source_file", "severity", "ingested_at")
    return rules.dedup_first(rows, ["rule_name", "function_name", "line_start", "source_file"], ["ingested_at", "finding_id"])


def findings_in_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "language", "composite_risk")
    order = [F.desc_nulls_last("composite_risk"), "finding_id"]
    return rules.numbered(rows.select("finding_id", "language", "composite_risk"), order, lang="language", id_="number").select("number", "finding_id", "composite_risk")


def _top(k: int, *order: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = _once(spark, folder, "cwe", "severity", *order)
        return reports.top(rows, [*[F.desc_nulls_last(c) for c in order], F.asc("finding_id")], k, ["finding_id", "cwe", "severity", *order])

    return query


top20_findings, top15_chart, top5_risk = _top(20, "composite_risk"), _top(15, "composite_risk"), _top(5, "risk_score")


def top7_cwes(spark: SparkSession, folder: str) -> DataFrame:
    return reports.common(_findings(spark, folder), "cwe", 7)


def _number(column: str) -> F.Column:
    return F.get(references.numbers(F.col(column)), F.lit(0)).try_cast("bigint")


def standard_in_force(spark: SparkSession, folder: str) -> DataFrame:
    """Each finding with the first entry of its weakness in force when it was scanned."""
    points = _once(spark, folder, "cwe", "scanned_at").select("finding_id", _number("cwe").alias("cwe_no"), "scanned_at")
    spans = table(spark, folder, "standards_db").select(_number("cwe_id").alias("cwe_no"), "entry_id", "added_at", "retired_at", "cvss_severity")
    return joins.first_covering(points, spans, ["cwe_no"], "scanned_at", "added_at", "retired_at", "entry_id", ["finding_id"], ["entry_id", "cvss_severity"])


def citation_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each finding's citation: that of the weakness's last entry, or that it is missing."""
    db = table(spark, folder, "standards_db").select(F.upper(F.trim("cwe_id")).alias("cwe"), "entry_id", F.concat_ws(" ", "cert_c_rule", "title").alias("citation"))
    last = db.groupBy("cwe").agg(F.max_by("citation", "entry_id").alias("citation"))
    rows = _once(spark, folder, "cwe")
    return joins.looked_up(rows, last, "cwe", {"citation": F.concat(F.lit("Citation missing for "), F.coalesce("cwe", F.lit("no weakness")))})


def base_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "cwe")
    return rows.select("finding_id", C.base_score(F.col("cwe")).alias("base_score"), C.bucket_of_base_score(C.base_score(F.col("cwe")) * 10).alias("base_severity"))


def _decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions without full repetitions, strategies in lower case."""
    return table(spark, folder, "decisions").withColumn("strategy", F.lower("strategy")).distinct()


def decision_join(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions by strategy and language of their findings; those without a finding drop out."""
    rows = _decisions(spark, folder).join(_once(spark, folder, "language", "severity", "ingested_at"), "finding_id")
    return rows.groupBy("strategy", "language").agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("n_severe"), F.count_if(F.col("decided_at") < F.col("ingested_at")).alias("n_early"))


def decisions_by_file(spark: SparkSession, folder: str) -> DataFrame:
    rows = _decisions(spark, folder).join(_once(spark, folder, "source_file", "line_start"), "finding_id")
    return rows.groupBy("source_file").agg(F.count("*").alias("n_decisions"), F.countDistinct("finding_id").alias("n_findings"), F.max("line_start").alias("last_line"))


def strategy_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "cwe")
    return rows.select("finding_id", patches.first_strategy(F.col("cwe")).alias("strategy"))


def tiered_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The template of each finding, by weakness and strategy, by strategy, or by weakness, preferring one that
    matches the code."""
    rows = _once(spark, folder, "cwe", "code_snippet").select("finding_id", "cwe", patches.first_strategy(F.col("cwe")).alias("strategy"), "code_snippet")
    return rows.select("finding_id", patches.template(F.col("cwe"), F.col("strategy"), F.col("code_snippet")).alias("_t")).select("finding_id", "_t.template_ord", "_t.tier")


def theta_first_after(spark: SparkSession, folder: str) -> DataFrame:
    """For each tainted finding the first later untainted one of the same file."""
    rows = _once(spark, folder, "source_file", "taint_confirmed", "scanned_at")
    a = rows.where("taint_confirmed").select("source_file", F.col("finding_id").alias("tainted_id"), F.col("scanned_at").alias("seen"))
    b = rows.where("NOT taint_confirmed").select("source_file", F.col("finding_id").alias("next_id"), "scanned_at", F.struct("scanned_at", "finding_id").alias("o"))
    return rules.first_after(a, b, ["source_file"], ["tainted_id"], "seen", "scanned_at", "o", lambda t: F.date_trunc("month", t)).select("source_file", "tainted_id", "next_id", "scanned_at")


def repeated_key_group(spark: SparkSession, folder: str) -> DataFrame:
    return rules.repeated(_once(spark, folder, "source_file", "rule_name", "line_start"), ["source_file", "rule_name"], "line_start").where("n >= 2")


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _once(spark, folder, "rule_name", "source_file", "scanned_at")
    early = F.col("scanned_at") < F.expr(f"timestamp_ntz'{HALF}'")
    return rows.where(early), rows.where(~early)


def before_after_diff(spark: SparkSession, folder: str) -> DataFrame:
    return joins.compared(*_halves(spark, folder), ["rule_name", "source_file"])


def fixed_findings(spark: SparkSession, folder: str) -> DataFrame:
    return joins.kept(*_halves(spark, folder), ["rule_name", "source_file"], fixed=True).select("finding_id", "rule_name", "source_file")


def remaining_findings(spark: SparkSession, folder: str) -> DataFrame:
    return joins.kept(*_halves(spark, folder), ["rule_name", "source_file"], fixed=False).select("finding_id", "rule_name", "source_file")


def _per_file(spark: SparkSession, folder: str) -> DataFrame:
    early = F.col("scanned_at") < F.expr(f"timestamp_ntz'{HALF}'")
    return _once(spark, folder, "source_file", "scanned_at").groupBy("source_file").agg(F.count_if(early).alias("n_before"), F.count_if(~early).alias("n_after"))


def fix_rate(spark: SparkSession, folder: str) -> DataFrame:
    return reports.fix_rates(_per_file(spark, folder), "n_before", "n_after")


def total_fix_rate(spark: SparkSession, folder: str) -> DataFrame:
    return reports.total_fix_rate(_per_file(spark, folder), "n_before", "n_after")


def path_or_name(spark: SparkSession, folder: str) -> DataFrame:
    """Files of findings that are files of the samples, by path or by name."""
    a = _findings(spark, folder).select("source_file").where("source_file IS NOT NULL").distinct()
    b = table(spark, folder, "samples").select("file_path").where("file_path IS NOT NULL").distinct()
    return joins.by_path_or_name(a, b, "source_file", "file_path").groupBy("source_file").agg(F.count("*").alias("n_files"))


def covering_findings(spark: SparkSession, folder: str) -> DataFrame:
    """How many findings of other rules cover each finding's line in its file."""
    rows = _once(spark, folder, "source_file", "rule_name", "line_start", "line_end")
    band = lambda c: F.floor(c / 32)  # noqa: E731  # equality keys for the range: no file is one group
    b = rows.select("source_file", F.col("rule_name").alias("r"), F.col("line_start").alias("s"), F.col("line_end").alias("e")).where("s <= e")
    b = b.withColumn("band", F.explode(F.sequence(band(F.col("s")), band(F.col("e")))))
    near = rows.withColumn("band", band(F.col("line_start"))).join(b, ["source_file", "band"]).where((F.col("line_start") >= F.col("s")) & (F.col("line_start") <= F.col("e")) & (F.col("rule_name") != F.col("r")))
    return near.groupBy("finding_id").agg(F.count("*").alias("n_covering"))


def first_on_line(spark: SparkSession, folder: str) -> DataFrame:
    """The first finding of each line of each file."""
    rows = _once(spark, folder, "source_file", "line_start", "rule_name")
    return rules.dedup_first(rows, ["source_file", "line_start"], ["finding_id"])


STRATEGIES = ["argument_array", "bounded_copy", "check_length_first", "drop_shell", "literal_format", "manual_review", "move_to_environment", "null_after_free", "parameter_binding", "propagate_error", "safe_join", "validate_input"]


def json_extract_decision(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "decisions").select("decision_id", "reasoning").distinct()
    d = C.decision(F.col("reasoning"), STRATEGIES, "manual_review")
    return rows.select("decision_id", d["strategy"].alias("strategy"), d["reason"].alias("reason"))


def heuristic_risk(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "severity", "confidence", "risk_score").select("finding_id", C.heuristic_risk(F.col("severity"), F.col("confidence"), F.col("risk_score")).alias("composite"))


def severity_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "exploit_prob", "ml_severity").withColumn("bucket", C.bucket(F.col("exploit_prob")))
    return rows.groupBy("bucket", "ml_severity").agg(F.count("*").alias("n"))


def ensemble_score(spark: SparkSession, folder: str) -> DataFrame:
    parts = {"text": F.lit(None).cast("double"), "graph": F.col("confidence"), "tree": F.col("exploit_prob")}
    score = C.ensemble(parts, F.col("function_name"), F.col("taint_confirmed"), F.col("has_extern_input"), F.col("vuln_id"))
    return _once(spark, folder, "confidence", "exploit_prob", "function_name", "taint_confirmed", "has_extern_input", "vuln_id").select("finding_id", score.alias("score"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    columns = {"cwe": c("cwe"), "severity": c("severity"), "confidence": c("confidence"), "reachable": c("reachable_from_entry"), "extern": c("has_extern_input"), "depth": c("call_depth"), "in_loop": c("in_loop"), "pointers": F.length("code_snippet") - F.length(F.replace("code_snippet", F.lit("*"), F.lit(""))), "unsafe": F.size(F.coalesce("agent_notes", F.array())), "unfreed": c("cwe") == "CWE-401", "loops": c("in_loop").cast("int"), "language": c("language")}
    rows = _once(spark, folder, "cwe", "severity", "confidence", "reachable_from_entry", "has_extern_input", "call_depth", "in_loop", "code_snippet", "agent_notes", "language", "risk_score", "exploit_prob", "taint_confirmed")
    return dataset.features(rows, columns, ["finding_id", "severity", "risk_score", "exploit_prob", "taint_confirmed"])


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select("finding_id", *dataset.FEATURES)


def composite_risk(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.risk(cut(feature_vectors(spark, folder))).select("finding_id", "risk")


def column_maxima(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.maxima(feature_vectors(spark, folder), dataset.FEATURES)


def feature_profile(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.profile(table(spark, folder, "samples"), C.FEATURES)


def _weak(strategy: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return dataset.weak_labels(_once(spark, folder, "composite_risk"), "composite_risk", strategy).select("finding_id", "label")

    return query


def weak_labels_flipped(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.weak_labels(_once(spark, folder, "composite_risk"), "composite_risk", "moderate", "finding_id").select("finding_id", "label")


def percentile_split(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.percentile_split(_once(spark, folder, "composite_risk"), "composite_risk").select("finding_id", "label")


def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.balance(table(spark, folder, "samples"), "label")


def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "samples").select("sample_id", "label", F.lower(F.trim("language")).alias("lang"))
    return dataset.split(rows, ["label", "lang"], "sample_id")


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _once(spark, folder, "taint_confirmed", "exploit_prob", "language").select(F.col("taint_confirmed").cast("int").alias("truth"), (F.col("exploit_prob") >= 0.5).cast("int").alias("guess"), "language")
    return metrics.confusion(rows, "truth", "guess", ["language"])


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, folder, "taint_confirmed", "exploit_prob").select(F.col("taint_confirmed").cast("int").alias("truth"), "exploit_prob")


def roc_points(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc(_truth(spark, folder), "truth", "exploit_prob")


def precision_recall_points(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.precision_recall(_truth(spark, folder), "truth", "exploit_prob")


def areas_under_curves(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.areas(_truth(spark, folder), "truth", "exploit_prob")


def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.regression(_once(spark, folder, "risk_score", "exploit_prob", "language"), "risk_score", "exploit_prob", ["language"])


def corr_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.correlations(table(spark, folder, "samples"), C.FEATURES)


def interaction_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.correlations(table(spark, folder, "samples"), C.FEATURES, "label")


def fold_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.folds(_once(spark, folder, "risk_score", "exploit_prob"), "finding_id").select("fold", "risk_score", "exploit_prob")
    return metrics.over_folds(metrics.regression(rows, "risk_score", "exploit_prob", ["fold"]), ["mae", "rmse"])


def smote_like(spark: SparkSession, folder: str) -> DataFrame:
    rows = dataset.weak_labels(cut(dataset.risk(cut(feature_vectors(spark, folder)))), "risk", "lenient")
    return dataset.oversampled(rows, "label", "finding_id", dataset.FEATURES)


def gaussian_augment(spark: SparkSession, folder: str) -> DataFrame:
    return dataset.augmented(feature_vectors(spark, folder), "finding_id", dataset.FEATURES)


def _trained(spark: SparkSession, folder: str):  # noqa: ANN202
    rows = cut(_vectors(spark, folder).withColumn("label", F.col("taint_confirmed").cast("int")))
    return rows, models.train(rows, dataset.FEATURES, "label", "risk_score")


def gbt_rf_score(spark: SparkSession, folder: str) -> DataFrame:
    rows, (a, b) = _trained(spark, folder)
    out = models.scored(rows.drop("exploit_prob", "risk_score"), a, b, dataset.FEATURES, "severity")
    return models.explained(out, models.importances(a, b, dataset.FEATURES)).select("finding_id", "exploit_prob", "risk_score", "ml_severity", "note", "top")


def partial_dependence(spark: SparkSession, folder: str) -> DataFrame:
    rows, (_, b) = _trained(spark, folder)
    return models.partial_dependence(rows, b, dataset.FEATURES, "cwe_cvss_score")


def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(_vectors(spark, folder).withColumn("label", F.col("taint_confirmed").cast("int")).drop("exploit_prob").withColumnRenamed("risk_score", "target"))
    return models.cross_validated(rows, dataset.FEATURES, "label", "target", "finding_id")


_ONCE = "o AS (SELECT * FROM scored_vulns QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY ingested_at) = 1)"
_BUCKET = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} >= 0.9 THEN 'CRITICAL' WHEN {0} >= 0.7 THEN 'HIGH' WHEN {0} >= 0.45 THEN 'MEDIUM' WHEN {0} >= 0.2 THEN 'LOW' ELSE 'INFO' END"
_CVSS = "CASE cwe " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CVSS.items()) + " ELSE 5.0 END"
_TEMPLATES = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}', '{s}', '{p.replace(chr(39), chr(39) * 2)}')" for i, (c, s, p, _) in enumerate(patches.TEMPLATES)) + ") AS v(template_ord, t_cwe, t_strategy, pattern))"
_STRATEGY = "CASE cwe " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in patches.STRATEGIES.items()) + " ELSE 'manual_review' END"
_POINTS = "p AS (SELECT exploit_prob AS score, count_if(taint_confirmed) AS p, count_if(NOT taint_confirmed) AS n FROM o WHERE taint_confirmed IS NOT NULL AND exploit_prob IS NOT NULL GROUP BY 1), c AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS tot_p, sum(n) OVER () AS tot_n FROM p WINDOW w AS (ORDER BY score DESC))"
_VECTORS = f"""f AS (SELECT finding_id, round({_CVSS} / 10, 4)::DOUBLE AS cwe_cvss_score, (CASE upper(severity) WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 WHEN 'INFO' THEN 0.05 ELSE 0.5 END)::DOUBLE AS severity_score, coalesce(confidence, 0)::DOUBLE AS confidence,
CASE WHEN reachable_from_entry THEN 1 ELSE 0 END::DOUBLE AS reachable_from_entry, CASE WHEN has_extern_input THEN 1 ELSE 0 END::DOUBLE AS has_extern_input, least(greatest(coalesce(call_depth, 0), 0), 10) / 10.0::DOUBLE AS call_depth, CASE WHEN in_loop THEN 1 ELSE 0 END::DOUBLE AS in_loop,
least(coalesce(length(code_snippet) - length(replace(code_snippet, '*', '')), 0), 20) / 20.0::DOUBLE AS pointer_ops, least(coalesce(len(agent_notes), 0), 15) / 15.0::DOUBLE AS unsafe_api_count, CASE WHEN cwe = 'CWE-401' THEN 1 ELSE 0 END::DOUBLE AS alloc_without_free,
least(coalesce(in_loop::INT, 0), 5) / 5.0::DOUBLE AS loop_depth, (CASE language WHEN 'c' THEN 1.0 WHEN 'go' THEN 0.6 ELSE 0.5 END)::DOUBLE AS language_risk FROM o)"""
_MAXIMA = ", ".join(f"CASE WHEN max({c}) > 0 THEN max({c}) ELSE 1.0 END AS {{}}{c}" for c in dataset.FEATURES)
_R = lambda x: f"round(coalesce({x}, 0), 6)"


def _top_sql(k: int, order: str) -> str:
    return f"WITH {_ONCE} SELECT row_number() OVER (ORDER BY {order} DESC NULLS LAST, finding_id)::INT AS rank, finding_id, cwe, severity, {order} FROM o ORDER BY rank LIMIT {k}"


def _weak_sql(strategy: str) -> str:
    high, low, _ = dataset.STRATEGIES[strategy]
    return f"WITH {_ONCE} SELECT finding_id, (composite_risk > {high})::INT AS label FROM o WHERE composite_risk > {high} OR composite_risk < {low}"


def _corr_sql(target: bool) -> str:
    pairs = [(a, b) for i, a in enumerate(C.FEATURES) for b in C.FEATURES[i + 1 :]]
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({f'abs(corr({a} * {b}, label))' if target else f'corr({a}, {b})'}, 6) AS r FROM samples" for a, b in pairs)


SQL = {
    "finding_counts": " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM scored_vulns GROUP BY 2" for c in ("severity", "cwe", "language")),
    "report_summary": "SELECT count(*) AS n, " + ", ".join(f"count_if(severity = '{s}') AS n_{s.lower()}" for s in reports.SEVERITIES) + ", round(sum(coalesce(risk_score, 0)) / greatest(count(*), 1), 4) AS avg_risk, count_if(coalesce(risk_score, 0) >= 0.7) AS n_high_risk FROM scored_vulns",
    "scored_summary": "SELECT count(*) AS n, count(exploit_prob) AS n_scored, round(avg(exploit_prob), 4) AS avg_probability, round(avg(risk_score) FILTER (WHERE exploit_prob IS NOT NULL), 4) AS avg_risk, count_if(composite_risk >= 0.7) AS n_high_risk FROM scored_vulns",
    "recon_counts": "SELECT count(DISTINCT function_name) AS n_functions, count_if(severity IN ('CRITICAL', 'HIGH')) AS n_severe, count_if(taint_confirmed) AS n_tainted, count(DISTINCT source_file) AS n_files FROM scored_vulns",
    "finding_dedup_first": "SELECT finding_id, rule_name, function_name, line_start, source_file, severity, ingested_at FROM scored_vulns QUALIFY row_number() OVER (PARTITION BY rule_name, function_name, line_start, source_file ORDER BY ingested_at, finding_id) = 1",
    "findings_in_order": f"WITH {_ONCE} SELECT printf('SIFT-%s-%03d', CASE language WHEN 'c' THEN 'C' WHEN 'cpp' THEN 'CPP' WHEN 'java' THEN 'JAVA' WHEN 'python' THEN 'PY' WHEN 'go' THEN 'GO' END, row_number() OVER (PARTITION BY language ORDER BY composite_risk DESC NULLS LAST, finding_id)) AS number, finding_id, composite_risk FROM o",
    "top20_findings": _top_sql(20, "composite_risk"), "top15_chart": _top_sql(15, "composite_risk"), "top5_risk": _top_sql(5, "risk_score"),
    "top7_cwes": "SELECT cwe, count(*) AS n FROM scored_vulns WHERE cwe IS NOT NULL GROUP BY 1 ORDER BY n DESC, cwe LIMIT 7",
    "standard_in_force": rf"""WITH {_ONCE}, a AS (SELECT finding_id, try_cast(nullif(regexp_extract(cwe, '[0-9]+'), '') AS BIGINT) AS cwe_no, scanned_at FROM o), s AS (SELECT *, try_cast(nullif(regexp_extract(cwe_id, '[0-9]+'), '') AS BIGINT) AS no FROM standards_db)
SELECT a.*, entry_id, cvss_severity FROM a LEFT JOIN s ON no = cwe_no AND added_at <= scanned_at AND (retired_at IS NULL OR scanned_at < retired_at) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY entry_id) = 1""",
    "citation_lookup": f"WITH {_ONCE}, s AS (SELECT upper(trim(cwe_id)) AS k, concat_ws(' ', cert_c_rule, title) AS c FROM standards_db QUALIFY row_number() OVER (PARTITION BY upper(trim(cwe_id)) ORDER BY entry_id DESC) = 1) SELECT finding_id, cwe, coalesce(c, 'Citation missing for ' || coalesce(cwe, 'no weakness')) AS citation FROM o LEFT JOIN s ON k = cwe",
    "base_scores": f"WITH {_ONCE}, b AS (SELECT finding_id, round({_CVSS} / 10, 4)::DOUBLE AS base_score FROM o) SELECT *, CASE WHEN base_score * 10 >= 9 THEN 'CRITICAL' WHEN base_score * 10 >= 7 THEN 'HIGH' WHEN base_score * 10 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS base_severity FROM b",
    "decision_join": f"WITH {_ONCE}, d AS (SELECT DISTINCT decision_id, finding_id, vuln_id, lower(strategy) AS strategy, reasoning, decided_at FROM decisions) SELECT strategy, language, count(*) AS n, count_if(severity IN ('CRITICAL', 'HIGH')) AS n_severe, count_if(decided_at < ingested_at) AS n_early FROM d JOIN o USING (finding_id) GROUP BY 1, 2",
    "decisions_by_file": f"WITH {_ONCE}, d AS (SELECT DISTINCT decision_id, finding_id, vuln_id, lower(strategy) AS strategy, reasoning, decided_at FROM decisions) SELECT source_file, count(*) AS n_decisions, count(DISTINCT d.finding_id) AS n_findings, max(line_start) AS last_line FROM d JOIN o USING (finding_id) GROUP BY 1",
    "strategy_lookup": f"WITH {_ONCE} SELECT finding_id, {_STRATEGY} AS strategy FROM o",
    "tiered_lookup": f"""WITH {_ONCE}, {_TEMPLATES}, r AS (SELECT finding_id, cwe, {_STRATEGY} AS strategy, code_snippet FROM o),
j AS (SELECT finding_id, code_snippet, pattern, template_ord, CASE WHEN t_cwe IS NULL THEN NULL WHEN cwe = t_cwe AND strategy = t_strategy THEN 1 WHEN strategy = t_strategy THEN 2 ELSE 3 END AS tier FROM r LEFT JOIN t ON cwe = t_cwe OR strategy = t_strategy)
SELECT finding_id, template_ord, tier FROM j QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY tier, CASE WHEN tier = 3 THEN 0 WHEN coalesce(regexp_matches(code_snippet, pattern), false) THEN 0 ELSE 1 END, template_ord) = 1""",
    "theta_first_after": f"WITH {_ONCE} SELECT a.source_file, a.finding_id AS tainted_id, b.finding_id AS next_id, b.scanned_at FROM o a JOIN o b ON a.source_file = b.source_file AND b.scanned_at > a.scanned_at WHERE a.taint_confirmed AND NOT b.taint_confirmed QUALIFY row_number() OVER (PARTITION BY a.finding_id ORDER BY b.scanned_at, b.finding_id) = 1",
    "repeated_key_group": f"WITH {_ONCE} SELECT source_file, rule_name, count(*) AS n, min(line_start) AS first, max(line_start) AS last FROM o GROUP BY 1, 2 HAVING count(*) >= 2",
    "before_after_diff": f"WITH {_ONCE}, b AS (SELECT DISTINCT rule_name, source_file FROM o WHERE scanned_at < '{HALF}'), a AS (SELECT DISTINCT rule_name, source_file FROM o WHERE NOT scanned_at < '{HALF}') SELECT rule_name, source_file, CASE WHEN a.x IS NULL THEN 'fixed' WHEN b.x IS NULL THEN 'new' ELSE 'remaining' END AS fate FROM (SELECT *, 1 AS x FROM b) b FULL JOIN (SELECT *, 1 AS x FROM a) a USING (rule_name, source_file)",
    "fixed_findings": f"WITH {_ONCE} SELECT finding_id, rule_name, source_file FROM o WHERE scanned_at < '{HALF}' AND NOT EXISTS (SELECT 1 FROM o a WHERE NOT a.scanned_at < '{HALF}' AND a.rule_name = o.rule_name AND a.source_file = o.source_file)",
    "remaining_findings": f"WITH {_ONCE} SELECT finding_id, rule_name, source_file FROM o WHERE scanned_at < '{HALF}' AND EXISTS (SELECT 1 FROM o a WHERE NOT a.scanned_at < '{HALF}' AND a.rule_name = o.rule_name AND a.source_file = o.source_file)",
    "fix_rate": f"WITH {_ONCE}, f AS (SELECT source_file, count_if(scanned_at < '{HALF}') AS n_before, count_if(NOT scanned_at < '{HALF}') AS n_after FROM o GROUP BY 1) SELECT *, greatest(n_before - n_after, 0) AS fixed, CASE WHEN n_before = 0 THEN 1.0 ELSE round(greatest(n_before - n_after, 0)::DOUBLE / n_before, 6) END::DOUBLE AS fix_rate FROM f",
    "total_fix_rate": f"WITH {_ONCE} SELECT count_if(scanned_at < '{HALF}') AS before, count_if(NOT scanned_at < '{HALF}') AS after, round((count_if(scanned_at < '{HALF}') - count_if(NOT scanned_at < '{HALF}'))::DOUBLE / nullif(count_if(scanned_at < '{HALF}'), 0), 6) AS fix_rate FROM o",
    "path_or_name": r"WITH a AS (SELECT DISTINCT source_file, regexp_extract(source_file, '[^/\\]*$') AS n FROM scored_vulns WHERE source_file IS NOT NULL), b AS (SELECT DISTINCT file_path, regexp_extract(file_path, '[^/\\]*$') AS m FROM samples WHERE file_path IS NOT NULL) SELECT source_file, count(*) AS n_files FROM a JOIN b ON source_file = file_path OR n = m GROUP BY 1",
    "covering_findings": f"WITH {_ONCE} SELECT a.finding_id, count(*) AS n_covering FROM o a JOIN o b ON a.source_file = b.source_file AND a.line_start BETWEEN b.line_start AND b.line_end AND a.rule_name <> b.rule_name GROUP BY 1",
    "first_on_line": f"WITH {_ONCE} SELECT source_file, line_start, finding_id, rule_name FROM o QUALIFY row_number() OVER (PARTITION BY source_file, line_start ORDER BY finding_id) = 1",
    "json_extract_decision": "WITH d AS (SELECT DISTINCT decision_id, reasoning FROM decisions), j AS (SELECT decision_id, reasoning, regexp_extract(reasoning, '(?s)\\{.*?\\}') AS obj FROM d), x AS (SELECT *, lower(trim(CASE WHEN obj <> '' AND json_valid(obj) THEN json_extract_string(obj, '$.strategy') END)) AS said, CASE WHEN obj <> '' AND json_valid(obj) THEN coalesce(json_extract_string(obj, '$.reasoning'), json_extract_string(obj, '$.why')) END AS why FROM j) SELECT decision_id, coalesce("
    + "CASE WHEN said IN (" + ", ".join(f"'{k}'" for k in STRATEGIES) + ") THEN said END, "
    + ", ".join(f"CASE WHEN said <> '' AND (contains('{k}', said) OR contains(said, '{k}')) THEN '{k}' END" for k in STRATEGIES) + ", "
    + ", ".join(f"CASE WHEN contains(lower(reasoning), '{k}') THEN '{k}' END" for k in STRATEGIES) + ", 'manual_review') AS strategy, coalesce(why, reasoning) AS reason FROM x",
    "heuristic_risk": f"WITH {_ONCE} SELECT finding_id, coalesce(risk_score, round((CASE upper(severity) WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.8 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.2 WHEN 'INFO' THEN 0.05 ELSE 0.5 END)::DOUBLE * confidence, 4)) AS composite FROM o",
    "severity_buckets": f"WITH {_ONCE} SELECT {_BUCKET.format('exploit_prob')} AS bucket, ml_severity, count(*) AS n FROM o GROUP BY 1, 2",
    "ensemble_score": f"""WITH {_ONCE}, w AS (SELECT finding_id, (CASE WHEN confidence IS NOT NULL THEN 0.3 ELSE 0.0 END + CASE WHEN exploit_prob IS NOT NULL THEN 0.2 ELSE 0.0 END)::DOUBLE AS weight, coalesce(confidence, 0) * 0.3::DOUBLE + coalesce(exploit_prob, 0) * 0.2::DOUBLE AS total,
({C.TAINT_BOOST}::DOUBLE * coalesce(taint_confirmed, false)::INT + {C.EXTERN_BOOST}::DOUBLE * coalesce(has_extern_input, false)::INT + CASE lower(function_name) {" ".join(f"WHEN '{k}' THEN {v}" for k, v in C.SINK_BOOST.items())} ELSE 0 END::DOUBLE) AS boost, (('0x' || substr(md5(vuln_id), 1, 8))::BIGINT % 50) / 1000.0::DOUBLE AS eps FROM o)
SELECT finding_id, CASE WHEN weight > 0 THEN round(least(1.0::DOUBLE, greatest(0.05::DOUBLE, least(0.98::DOUBLE, total / weight + boost)) + eps), 4) END AS score FROM w""",
    "feature_vectors": f"WITH {_ONCE}, {_VECTORS} SELECT * FROM f",
    "column_maxima": f"WITH {_ONCE}, {_VECTORS} SELECT {_MAXIMA.replace('{}', '')} FROM f",
    "composite_risk": f"""WITH {_ONCE}, {_VECTORS}, m AS (SELECT {_MAXIMA.replace('{}', 'm_')} FROM f), x AS (SELECT finding_id, {", ".join(f"{c} / m_{c} AS {c}" for c in dataset.FEATURES)} FROM f, m)
SELECT finding_id, round(greatest(0.0, least(1.0, 0.5 * (0.5 * cwe_cvss_score + 0.3 * severity_score + 0.2 * confidence) + 0.35 * (0.3 * reachable_from_entry + 0.3 * has_extern_input + 0.1 * (pointer_ops + unsafe_api_count + alloc_without_free + language_risk)) + 0.15 * (0.4 * call_depth + 0.3 * in_loop + 0.3 * loop_depth))), 6) AS risk FROM x""",
    "feature_profile": " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(min({c}), 6) AS least, round(max({c}), 6) AS most, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS deviation FROM samples" for c in C.FEATURES),
    "weak_labels_strict": _weak_sql("strict"), "weak_labels_moderate": _weak_sql("moderate"), "weak_labels_lenient": _weak_sql("lenient"),
    "percentile_split": f"WITH {_ONCE}, q AS (SELECT quantile_cont(composite_risk, 0.3) AS lo, quantile_cont(composite_risk, 0.7) AS hi FROM o) SELECT finding_id, (composite_risk >= hi)::INT AS label FROM o, q WHERE composite_risk >= hi OR composite_risk <= lo",
    "class_balance": "SELECT count(*) AS n, count_if(label = 1) AS n_positive, count_if(label = 0) AS n_negative, round(avg((label = 1)::INT), 6) AS share FROM samples",
    "stratified_split": "WITH s AS (SELECT sample_id, label, lower(trim(language)) AS lang FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY label, lang ORDER BY md5(sample_id::VARCHAR), sample_id) AS r, count(*) OVER (PARTITION BY label, lang) AS n FROM s) SELECT sample_id, label, lang, CASE WHEN r <= CASE WHEN n >= 2 THEN greatest(1, floor(n * 0.2::DOUBLE)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM r",
    "confusion_metrics": f"""WITH {_ONCE}, c AS (SELECT language, count_if(t AND g) AS tp, count_if(NOT t AND g) AS fp, count_if(t AND NOT g) AS fn, count_if(NOT t AND NOT g) AS tn FROM (SELECT language, taint_confirmed AS t, exploit_prob >= 0.5 AS g FROM o) WHERE t IS NOT NULL AND g IS NOT NULL GROUP BY 1)
SELECT *, {_R("(tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0)")} AS accuracy, {_R("tp::DOUBLE / nullif(tp + fp, 0)")} AS "precision", {_R("tp::DOUBLE / nullif(tp + fn, 0)")} AS recall, {_R("2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0)")} AS f1, {_R("tn::DOUBLE / nullif(tn + fp, 0)")} AS specificity FROM c""",
    "roc_points": f"WITH {_ONCE}, {_POINTS} SELECT score, {_R('tp::DOUBLE / nullif(tot_p, 0)')} AS tpr, {_R('fp::DOUBLE / nullif(tot_n, 0)')} AS fpr FROM c",
    "precision_recall_points": f"""WITH {_ONCE}, {_POINTS} SELECT score, {_R('tp::DOUBLE / nullif(tp + fp, 0)')} AS "precision", {_R('tp::DOUBLE / nullif(tot_p, 0)')} AS recall FROM c""",
    "areas_under_curves": f"WITH {_ONCE}, {_POINTS} SELECT {_R('sum(n * (tp - p + p / 2.0::DOUBLE)) / nullif(max(tot_p * tot_n), 0)')} AS auc, {_R('sum(p * tp::DOUBLE / (tp + fp)) / nullif(max(tot_p), 0)')} AS average_precision FROM c",
    "regression_metrics": f"WITH {_ONCE} SELECT language, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / nullif(var_pop(risk_score), 0), 6) AS r2, round(avg(abs(e) / (abs(risk_score) + 1e-10)), 2) AS mape FROM (SELECT *, risk_score - exploit_prob AS e FROM o) WHERE e IS NOT NULL GROUP BY 1",
    "corr_matrix": _corr_sql(False), "interaction_matrix": _corr_sql(True),
    "fold_metrics": f"""WITH {_ONCE}, f AS (SELECT ('0x' || substr(md5(finding_id::VARCHAR), 1, 8))::BIGINT % 5 AS fold, risk_score - exploit_prob AS e FROM o), m AS (SELECT fold, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM f WHERE e IS NOT NULL GROUP BY 1)
SELECT 'mae' AS measure, round(avg(mae), 6) AS mean, round(stddev_pop(mae), 6) AS deviation FROM m UNION ALL SELECT 'rmse', round(avg(rmse), 6), round(stddev_pop(rmse), 6) FROM m""",
}


def queries():  # noqa: ANN201
    listed = (finding_counts, report_summary, scored_summary, recon_counts, finding_dedup_first, findings_in_order, top7_cwes, standard_in_force, citation_lookup, base_scores, decision_join, decisions_by_file, strategy_lookup, tiered_lookup, theta_first_after, repeated_key_group, before_after_diff, fixed_findings, remaining_findings, fix_rate, total_fix_rate, path_or_name, covering_findings, first_on_line, json_extract_decision, heuristic_risk, severity_buckets, ensemble_score, feature_vectors, composite_risk, column_maxima, feature_profile, weak_labels_flipped, percentile_split, class_balance, stratified_split, confusion_metrics, roc_points, precision_recall_points, areas_under_curves, regression_metrics, corr_matrix, interaction_matrix, fold_metrics, smote_like, gaussian_augment, gbt_rf_score, partial_dependence, cross_validation)
    return {f.__name__: f for f in listed} | {"top20_findings": top20_findings, "top15_chart": top15_chart, "top5_risk": top5_risk} | {f"weak_labels_{s}": _weak(s) for s in dataset.STRATEGIES}
