import math

from pyspark.sql import functions as F

from siftline.functions import code as C
from siftline.operators import dataset, joins, metrics, models, patches, reports


def rows(spark, n=400):
    cols = {c: F.round(dataset.uniform(F.col("id"), c), 4) for c in dataset.FEATURES}
    return spark.range(n).select("id", *[(F.round(v) if c in dataset.BINARY else v).alias(c) for c, v in cols.items()])


def test_split_is_stratified_and_stable(spark):
    t = spark.range(1000).select("id", (F.col("id") % 3).alias("s")).unionByName(spark.createDataFrame([(5000, None), (5001, 9)], "id bigint, s bigint"))
    a = {r.id: r.split for r in dataset.split(t, ["s"], "id").collect()}
    assert a == {r.id: r.split for r in dataset.split(t.repartition(7), ["s"], "id").collect()} and len(a) == 1002
    assert sum(v == "val" for k, v in a.items() if k % 3 == 0 and k < 1000) == 66
    assert a[5000] == a[5001] == "train"


def test_labels_flip_and_fall_back(spark):
    t = spark.createDataFrame([(i, i / 100) for i in range(101)], "id int, risk double")
    plain = {r.id: r.label for r in dataset.weak_labels(t, "risk", "strict").collect()}
    assert set(plain) == {i for i in range(101) if i > 75 or i < 25}
    flipped = {r.id: r.label for r in dataset.weak_labels(t, "risk", "lenient", "id").collect()}
    assert sum(flipped[k] != (k > 65) for k in flipped) == max(1, int(len(flipped) * 0.03))
    middle = spark.createDataFrame([(i, 0.5 + i / 1000) for i in range(10)], "id int, risk double")
    assert dataset.labelled(middle, "risk", "moderate").where("label = 1").count() == 10
    few = middle.unionByName(spark.createDataFrame([(99, 0.99)], "id int, risk double"))
    assert dataset.labelled(few, "risk", "moderate").count() == 8
    one = dataset.two_of_each(t.withColumn("label", F.lit(0)), "label", "risk", "id")
    assert sorted(r.id for r in one.where("label = 1").collect()) == [99, 100]
    assert dataset.two_of_each(t.where("id < 1").withColumn("label", F.lit(0)), "label", "risk", "id").where("label = 1").count() == 0


def test_oversampling_and_noise_stay_in_range(spark):
    t = rows(spark).withColumn("label", (F.col("id") < 60).cast("int"))
    out = dataset.oversampled(t, "label", "id", dataset.FEATURES)
    assert {r.label: r.n for r in out.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 340, 1: 340}
    assert out.where("synthetic").count() == 280
    noisy = dataset.augmented(t, "id", dataset.FEATURES)
    assert noisy.count() == 2000
    assert noisy.where(" OR ".join(f"{c} < 0 OR {c} > 1" for c in dataset.FEATURES)).count() == 0
    assert noisy.where(" OR ".join(f"{c} NOT IN (0, 1)" for c in dataset.BINARY)).count() == 0
    moved = noisy.where("copy > 0").join(t.select("id", F.col("cwe_cvss_score").alias("o")), "id").agg(F.stddev(F.col("cwe_cvss_score") - F.col("o"))).first()[0]
    assert 0.03 < moved < 0.06


def test_metrics_by_hand(spark):
    t = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.7), (0, 0.1), (None, 0.5), (1, None)], "y int, s double")
    a = metrics.areas(t, "y", "s").first()
    assert math.isclose(a.auc, (3 + 0 + 2 * 1.5 + 0) / 9 + 0.0, abs_tol=1) and a.auc == round((1 * 3 + 2 * (0.5 + 1)) / 9, 6)
    c = metrics.confusion(t.withColumn("g", (F.col("s") >= 0.75).cast("int")), "y", "g").first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 1, 2, 2) and c.precision == 0.5
    assert metrics.confusion(t.limit(0).withColumn("g", F.lit(1)), "y", "g").first().accuracy == 0
    assert metrics.areas(t.where("y = 1"), "y", "s").first().auc == 0


def test_joins(spark):
    p = spark.createDataFrame([(1, "f", 10), (2, "f", 3), (3, "g", 10), (4, "f", 100)], "id int, k string, at_ int")
    c = spark.createDataFrame([("f", 9), ("f", 11), ("f", 12), ("f", 6), ("g", 14)], "k string, line int")
    got = {r.id: (r.nearest_line, r.delta) for r in joins.nearest_within(p, c, ["k"], ["id"], "at_", "line").collect()}
    assert got == {1: (11, 1), 2: (6, 3), 3: (None, None), 4: (None, None)}
    a, b = spark.createDataFrame([("r", 1), ("r", 2)], "rule string, line int"), spark.createDataFrame([("r", 2), ("s", 3)], "rule string, line int")
    assert {(r.rule, r.line, r.fate) for r in joins.compared(a, b, ["rule", "line"]).collect()} == {("r", 1, "fixed"), ("r", 2, "remaining"), ("s", 3, "new")}
    f = joins.by_path_or_name(spark.createDataFrame([("a/x.c",), ("y.c",)], "p string"), spark.createDataFrame([("a/x.c",), ("b/x.c",), ("c\\y.c",)], "q string"), "p", "q")
    assert sorted(map(tuple, f.collect())) == [("a/x.c", "a/x.c"), ("a/x.c", "b/x.c"), ("y.c", "c\\y.c")]


def test_decisions(spark):
    t = spark.createDataFrame([(1, '{"strategy": "Bounded_Copy", "why": "w"}'), (2, '{"strategy": "copy"}'), (3, "use safe_join here"), (4, "no idea"), (5, None), (6, "{broken"), (7, 'x {"strategy": "drop_shell now"} y')], "id int, raw string")
    d = C.decision(F.col("raw"), ["bounded_copy", "drop_shell", "safe_join"], "manual_review")
    got = {r.id: (r.s, r.w) for r in t.select("id", d["strategy"].alias("s"), d["reason"].alias("w")).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["bounded_copy", "bounded_copy", "safe_join", "manual_review", "manual_review", "manual_review", "drop_shell"]
    assert got[1][1] == "w" and got[5][1] is None


def test_structural_features_edges(spark):
    t = spark.createDataFrame([(1, ""), (2, None), (3, "\n\n"), (4, "\tif (x) {\r\n\t\ty = *p;\r\n"), (5, "        a\n"), (6, "x " * 5000)], "id int, t string")
    got = {r.id: r for r in C.with_structural_features(t, "t", ["id"]).collect()}
    assert got[1].n_lines == 0 and got[2].n_lines is None and got[3].n_lines == 0.01
    assert got[4].max_nesting_depth == 0.1 and got[4].has_pointer_ops == 1 and got[5].max_nesting_depth == 0.1 and got[6].n_tokens == 1


def test_patches(spark):
    text = "int f(char *b) {\n    strcpy(b, s);\n\n    free(b);\n    memcpy(d, s, n);\n}\n"
    files = spark.createDataFrame([("a", text), ("b", "x\n")], "file string, text string")
    found = spark.createDataFrame([("a", 1, "CWE-120", "replace_strcpy_with_strncpy", 3), ("a", 2, "CWE-415", "anything", 4), ("a", 3, "CWE-121", "unknown", 5), ("a", 4, "CWE-125", "validate_copy_length", 9), ("b", 5, "CWE-120", "add_bounds_check", 1)], "file string, finding_id int, cwe string, strategy string, line int")
    results, patched = patches.apply(files, found, "file", "text")
    got = {r.finding_id: (r.line_patched, r.success, r.error) for r in results.collect()}
    assert got == {1: (2, True, None), 2: (4, True, None), 3: (None, False, "No template found"), 4: (None, False, "No matching line"), 5: (None, False, "No matching line")}
    new = patched.collect()
    assert [r.file for r in new] == ["a"]
    assert new[0].patched == "int f(char *b) {\n    strncpy(b, s, sizeof(b) - 1);\n    b[sizeof(b) - 1] = '\\0';  /* bounds-safe copy */\n\n    if (b != NULL) {\n        free(b);\n        b = NULL;  /* prevent double-free */\n    }\n    memcpy(d, s, n);\n}\n"
    assert patches.diffs(patched, "file").first().diff.startswith("--- original\n+++ patched\n@@ -1,")


def test_models(spark):
    t = rows(spark).withColumn("target", F.round(0.6 * F.col("cwe_cvss_score") + 0.4 * F.col("confidence"), 4)).withColumn("label", (F.col("target") > 0.5).cast("int")).withColumn("severity", F.lit("LOW"))
    a, b = models.train(t, dataset.FEATURES, "label", "target")
    out = models.explained(models.scored(t, a, b, dataset.FEATURES, "severity"), models.importances(a, b, dataset.FEATURES)).collect()
    assert all(0 <= r.exploit_prob <= 1 and 0 <= r.risk_score <= 1 and len(r.top) == 5 for r in out)
    assert sum((r.exploit_prob > 0.5) == bool(r.label) for r in out) > 360
    pd = [r.mean for r in models.partial_dependence(t, b, dataset.FEATURES, "cwe_cvss_score", 5).orderBy("value").collect()]
    assert len(pd) == 5 and pd[0] < pd[-1]
    cv = {r.measure: r.mean for r in models.cross_validated(t, dataset.FEATURES, "label", "target", "id", 2).collect()}
    assert set(cv) == {"accuracy", "precision", "recall", "f1", "mae", "rmse", "r2"} and cv["accuracy"] > 0.7 and cv["r2"] > 0.3


def test_reports(spark):
    t = spark.createDataFrame([("a", 3, 1), ("b", 0, 2), ("c", 2, 0)], "f string, b int, a int")
    assert {r.f: r.fix_rate for r in reports.fix_rates(t, "b", "a").collect()} == {"a": 0.666667, "b": 1.0, "c": 1.0}
    assert reports.total_fix_rate(t, "b", "a").first().fix_rate == 0.4
    assert reports.counts(spark.createDataFrame([("x", None), ("x", "1")], "p string, q string"), ["p", "q"]).count() == 3
