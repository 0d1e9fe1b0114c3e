"""Results as files: JSON by Spark, and small reports made on the driver of aggregates and a bounded top list."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, reports
from .pipeline import Pipeline

#: Findings listed in a report.
LISTED = 20


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_results(p: Pipeline, folder: str) -> None:
    """All tables of a run, each in its own folder: JSON, and Parquet for the features."""
    write_json(p.contexts(), f"{folder}/contexts")
    write_json(p.call_graph, f"{folder}/call_graph")
    write_json(graph.statistics(p.call_graph), f"{folder}/call_graph_statistics")
    write_json(p.findings.orderBy("vuln_id"), f"{folder}/findings")
    p.features.write.mode("overwrite").parquet(f"{folder}/features")
    write_json(p.scored.orderBy(F.desc_nulls_last("composite_risk"), "vuln_id"), f"{folder}/scored")
    write_json(p.decisions, f"{folder}/decisions")
    write_json(p.patches[0], f"{folder}/patch_results")
    p.patches[1].write.mode("overwrite").parquet(f"{folder}/patched_files")
    write_json(p.verification, f"{folder}/verification")


def summary(p: Pipeline) -> dict:
    """Counts, rates and the top findings: the size of the rule set, not of the findings."""
    one = reports.summary(p.scored, "severity", "risk_score").first().asDict()
    per = [r.asDict() for r in reports.counts(p.scored, ["severity", "cwe", "lang"]).orderBy("dimension", F.desc("n"), "value").collect()]
    first = reports.top(p.scored, [F.desc_nulls_last("composite_risk"), F.asc("vuln_id")], LISTED, ["vuln_id", "file", "line", "rule_name", "cwe", "severity", "composite_risk", "standards_citation"])
    rate = reports.total_fix_rate(p.verification, "n_before", "n_after").first().asDict()
    patched = p.patches[0].agg(F.count_if("success").alias("patched"), F.count_if(~F.col("success")).alias("failed")).first().asDict()
    return {"summary": one, "counts": per, "top": [r.asDict() for r in first.orderBy("rank").collect()], "verification": rate, "patches": patched}


def as_json(s: dict) -> str:
    return json.dumps(s, indent=2, default=str)


def as_text(s: dict) -> str:
    rows = [f"findings: {s['summary']['n']}   mean risk: {s['summary']['avg_risk']}   high risk: {s['summary']['n_high_risk']}"]
    rows += [f"  {r['dimension']:9} {r['value']}: {r['n']}" for r in s["counts"]]
    rows += [f"{r['rank']:3} {r['vuln_id']:14} {r['severity']:9} {r['composite_risk']:.4f} {r['cwe']:8} {r['file']}:{r['line']} {r['rule_name']}" for r in s["top"]]
    if (more := s["summary"]["n"] - len(s["top"])) > 0:
        rows.append(f"    and {more} more")
    rows.append(f"patched {s['patches']['patched']}, failed {s['patches']['failed']}; findings before {s['verification']['before']}, after {s['verification']['after']}, fix rate {s['verification']['fix_rate']}")
    return "\n".join(rows) + "\n"


def as_html(s: dict) -> str:
    e = lambda x: html.escape(str(x))
    table = lambda head, rows: "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    top = [[r[k] for k in ("rank", "vuln_id", "severity", "composite_risk", "cwe", "file", "line", "standards_citation")] for r in s["top"]]
    counts = [[r["dimension"], r["value"], r["n"]] for r in s["counts"]]
    return f"<!doctype html><meta charset=utf-8><title>Findings</title><h1>{e(s['summary']['n'])} findings</h1>{table(['by', 'value', 'findings'], counts)}{table(['rank', 'id', 'severity', 'risk', 'weakness', 'file', 'line', 'citation'], top)}"


def as_csv(s: dict) -> str:
    keys = ["n", *[f"n_{x.lower()}" for x in reports.SEVERITIES], "avg_risk", "n_high_risk"]
    return ",".join(keys) + "\n" + ",".join(str(s["summary"][k]) for k in keys) + "\n"


def as_gml(edges: DataFrame, most: int = 100_000) -> str:
    """A call graph as GML; graphs of more than ``most`` edges are for tables, and refused."""
    rows = edges.orderBy("src", "dst").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges: write the table instead")
    ids = {n: i for i, n in enumerate(dict.fromkeys(x for r in rows for x in (r["src"], r["dst"])))}
    quoted = lambda n: n.replace("&", "&amp;").replace('"', "&quot;")
    return "graph [\n  directed 1\n" + "".join(f'  node [ id {i} label "{quoted(n)}" ]\n' for n, i in ids.items()) + "".join(f"  edge [ source {ids[r['src']]} target {ids[r['dst']]} line {r['line'] if r['line'] is not None else -1} ]\n" for r in rows) + "]\n"


def write_reports(p: Pipeline, folder: str) -> None:
    s = summary(p)
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, text in (("report.json", as_json(s)), ("report.txt", as_text(s)), ("report.html", as_html(s)), ("benchmark.csv", as_csv(s))):
        (out / name).write_text(text, encoding="utf-8")
