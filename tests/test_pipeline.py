import json

import pytest
from pyspark.sql import functions as F

from siftline.plans import pipeline_queries, render
from siftline.plans.pipeline import Pipeline
from siftline.sources import files
from siftline.streaming import windows

from .test_rules import CPP, GO, PY, C


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("code")
    for name, text in (("a.c", C), ("b.cpp", CPP), ("sub/c.py", PY), ("sub/d.go", GO), ("node_modules/e.c", C), (".hidden/f.c", C), ("g.txt", C)):
        (d / name).parent.mkdir(exist_ok=True)
        (d / name).write_text(text)
    (d / "latin.c").write_bytes(b"int x; /* \xe9 */\r\nint y;")
    return str(d)


def test_scan_of_folders_and_files(spark, folder, tmp_path):
    got = {r.file.removeprefix(folder + "/"): r for r in files.scan(spark, folder).collect()}
    assert sorted(got) == ["a.c", "b.cpp", "latin.c", "sub/c.py", "sub/d.go"] and sorted(r.file_ord for r in got.values()) == [0, 1, 2, 3, 4]
    assert "�" in got["latin.c"].text
    assert files.scan(spark, folder + "/g.txt", "c").first().lang == "c"
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path))


def test_lines(spark):
    t = spark.createDataFrame([(1, "a\r\nb\n\nc"), (2, ""), (3, None), (4, "x\n"), (5, "\n")], "id int, text string")
    got = {}
    for r in files.lines(t, "text", "id").collect():
        got.setdefault(r.id, []).append((r.line, r.src))
    assert got == {1: [(1, "a"), (2, "b"), (3, ""), (4, "c")], 4: [(1, "x")], 5: [(1, "")]}


def test_dimension_and_data_sets(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"cwe_id": "CWE-1", "title": "old"}, {"cwe_id": "CWE-1", "title": "new"}, {"cwe_id": "CWE-2", "title": None}]))
    assert {r.cwe_id: r.title for r in files.json_dimension(spark, str(tmp_path / "s.json"), "cwe_id").collect()} == {"CWE-1": "new", "CWE-2": None}
    assert files.json_dimension(spark, str(tmp_path / "none.json"), "cwe_id").count() == 0
    (tmp_path / "b.csv").write_text('func_before,vul\n"int f() {\n  return 1 + 2 + 3;\n}",1\nshort,0\n')
    got = files.labelled(files.csv(spark, str(tmp_path / "b.csv")), "csv").collect()
    assert [(r.label, r.lang, r.source) for r in got] == [(1, "c", "csv")] and "\n" in got[0].code
    pairs = files.before_and_after(spark.createDataFrame([("a" * 30, "b" * 30), ("a" * 30, "c")], "x string, y string"), "x", "y", F.lit("c"), "fixes")
    assert sorted((r.code[0], r.label) for r in pairs.collect()) == [("a", 1), ("b", 0)]
    cves = spark.createDataFrame([("CWE-1", 0.0, 7.5, None), ("CWE-1", 9.0, None, None), ("CWE-1", None, None, None), ("CWE-2", None, None, 5.25)], "cwe string, v31 double, v30 double, v2 double")
    assert {r.cwe: r.score for r in files.mean_base_score(cves).collect()} == {"CWE-1": 8.25, "CWE-2": 5.25}


def test_all_phases(spark, folder, tmp_path):
    standards = spark.createDataFrame([("CWE-120", "STR31-C")], "cwe string, citation string")
    p = Pipeline.of_path(spark, folder, standards=standards)
    scored = p.scored.collect()
    assert len(scored) == p.findings.count() > 20
    assert all(0 <= r.risk <= 1 and 0 <= r.risk_score <= 1 and (r.exploit_prob is None or 0.05 <= r.exploit_prob <= 1) for r in scored)
    assert {r.standards_citation for r in scored if r.cwe == "CWE-120"} == {"STR31-C"}
    s = render.summary(p)
    assert s["summary"]["n"] == len(scored) and len(s["top"]) == 20 and s["verification"]["after"] < s["verification"]["before"]
    render.write_results(p, str(tmp_path / "out"))
    render.write_reports(p, str(tmp_path / "reports"))
    assert json.loads((tmp_path / "reports/report.json").read_text())["summary"]["n"] == len(scored)
    assert "more" in (tmp_path / "reports/report.txt").read_text() and "<table>" in (tmp_path / "reports/report.html").read_text()
    assert spark.read.json(str(tmp_path / "out/findings")).count() == len(scored)
    assert render.as_gml(p.call_graph).count("edge [") == p.call_graph.count()


def test_stream_equals_batch(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    counts = windows.windowed_counts(windows.read(spark, str(tmp_path / "in"), events.schema, 100), "ts", ["event_type"], late="3650 days")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    batch = windows.windowed_counts(events, "ts", ["event_type"])
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, batch.collect()))


def test_files_scanned_as_they_come(spark, tmp_path):
    spark.createDataFrame([("a.c", "c", C), ("b.py", "python", PY)], "file string, lang string, text string").write.parquet(str(tmp_path / "in"))
    stream = windows.read(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    windows.scan_new_files(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "file", "text", "lang").awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 10


def test_patches_of_all_languages(spark, tmp_path):
    java = 'class A {\n  void f(String c) throws Exception {\n    Runtime.getRuntime().exec("ls " + c);\n  }\n}\n'
    samples = [(1, "c", "void f(char *a, char *b) {\n  strcpy(a, b);\n}\n"), (2, "Python", "import os\ndef f(x):\n    os.system('ls ' + x);\n"), (3, " java", java)]
    spark.createDataFrame(samples, "sample_id bigint, language string, raw_code string").write.parquet(str(tmp_path / "samples.parquet"))
    got = {(r.sample_id, r.success, r.error) for r in pipeline_queries.patch_results(spark, str(tmp_path)).collect()}
    assert {(1, True, None), (2, True, None), (3, False, "No matching line")} <= got
