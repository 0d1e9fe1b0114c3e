"""The whole analysis as one lazy pipeline over a folder or a table of source files.

Each phase is a property made of the ones before; nothing runs until a result is written or counted, and a
phase that several others read is written to the checkpoint folder once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as C
from ..operators import dataset, graph, joins, models, patches, rules
from ..session import cut
from ..sources import files, parse


class Pipeline:
    """``files``: ``file, lang, text``.  ``standards``: ``cwe, citation``; without it every citation is missing."""

    def __init__(self, rows: DataFrame, standards: DataFrame | None = None, strategy: str = "moderate", decisions: DataFrame | None = None):
        self.files, self.standards, self.strategy, self.chosen = rows, standards, strategy, decisions

    @classmethod
    def of_path(cls, spark: SparkSession, path: str, language: str | None = None, **more) -> Pipeline:  # noqa: ANN003
        return cls(files.scan(spark, path, language), **more)

    # -- 1: structure
    @cached_property
    def facts(self) -> DataFrame:
        return cut(parse.facts(self.files, text="text", lang="lang", keep=("file",)))

    @cached_property
    def functions(self) -> DataFrame:
        return parse.of_kind(self.facts, "function", "file")

    @cached_property
    def calls(self) -> DataFrame:
        return parse.of_kind(self.facts, "call", "file")

    @cached_property
    def call_graph(self) -> DataFrame:
        return graph.edges(self.calls, "fn", "name", "line", "line")

    def contexts(self) -> DataFrame:
        """One row a file: counts and lists of its facts."""
        names = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("name")))
        n = lambda k: F.count_if(F.col("kind") == k)
        return self.facts.groupBy("file", "lang").agg(n("function").alias("n_functions"), n("call").alias("n_calls"), n("allocation").alias("n_allocations"), n("variable").alias("n_variables"), names("function").alias("functions"), names("entry").alias("entry_points"), (n("error") == 0).alias("parse_success"))

    # -- 2: findings
    @cached_property
    def findings(self) -> DataFrame:
        found = cut(rules.scan(self.files, self.facts, "file", "text"))
        numbered = rules.numbered(found, ["file", "line", "rule_name", "function_name"])
        missing = F.concat(F.lit("Citation missing for "), F.col("cwe"))
        if self.standards is None:
            return numbered.withColumn("standards_citation", missing)
        last = self.standards.groupBy("cwe").agg(F.max("citation").alias("_c"))
        return numbered.join(joins.small(last), "cwe", "left").withColumn("standards_citation", F.coalesce("_c", missing)).drop("_c")

    @cached_property
    def taint(self) -> DataFrame:
        return graph.tainted(self.call_graph, self.findings, "function_name")

    # -- 3: features
    @cached_property
    def features(self) -> DataFrame:
        spark = self.files.sparkSession
        f = self.functions.select("file", F.col("name").alias("function_name"), "pointer_ops", "loop_depth")
        unfreed = parse.of_kind(self.facts, "allocation", "file").groupBy("file", F.col("fn").alias("function_name")).agg(F.max(~F.col("freed")).alias("unfreed"))
        unsafe = spark.createDataFrame([(g, n) for g, names in dataset.UNSAFE.items() for n in names], "lang string, name string")
        n_unsafe = dataset.unsafe_calls(self.calls, unsafe, ["file", "fn"]).select("file", F.col("fn").alias("function_name"), F.col("n").alias("unsafe"))
        # depth over the whole graph, from every entry point; unreached functions count as depth 0
        depth = graph.reach(self.call_graph, parse.of_kind(self.facts, "entry", "file").select("name")).select(F.col("node").alias("function_name"), F.col("depth").alias("entry_depth"))
        rows = self.findings.join(f, ["file", "function_name"], "left").join(unfreed, ["file", "function_name"], "left").join(n_unsafe, ["file", "function_name"], "left").join(depth, "function_name", "left").join(self.taint.select(F.col("target").alias("function_name"), "taint_path"), "function_name", "left")
        c = F.col
        columns = {"cwe": c("cwe"), "severity": c("severity"), "confidence": c("confidence"), "reachable": c("reachable"), "extern": c("extern_input"), "depth": c("entry_depth"), "in_loop": c("in_loop"), "pointers": c("pointer_ops"), "unsafe": c("unsafe"), "unfreed": c("unfreed"), "loops": c("loop_depth"), "language": c("lang")}
        keep = ["vuln_id", "file", "lang", "function_name", "rule_name", "cwe", "severity", "line", "extern_input", "taint_path", "standards_citation"]
        return cut(dataset.features(rows, columns, keep))

    # -- 4: scores
    @cached_property
    def models(self) -> tuple | None:
        """The two models, trained on weak labels of these findings; None with a single class."""
        rows = dataset.risk(self.features)
        labelled = dataset.two_of_each(dataset.labelled(rows, "risk", self.strategy), "label", "risk", "vuln_id")
        whole = cut(dataset.oversampled(labelled, "label", "vuln_id", dataset.FEATURES))
        if whole.select("label").distinct().count() < 2:
            return None
        return models.train(whole, dataset.FEATURES, "label", "risk")

    @cached_property
    def scored(self) -> DataFrame:
        rows = dataset.risk(self.features)
        if self.models is None:
            rows = rows.withColumn("exploit_prob", F.lit(None).cast("double")).withColumn("risk_score", F.col("risk")).withColumn("ml_severity", C.bucket(F.col("risk"))).withColumn("note", F.lit(None).cast("string"))
        else:
            rows = models.scored(rows, *self.models, dataset.FEATURES, "severity")
        parts = {"text": F.lit(None).cast("double"), "graph": F.lit(None).cast("double"), "tree": F.col("exploit_prob")}
        final = C.ensemble(parts, F.col("function_name"), F.col("taint_path").isNotNull(), F.col("extern_input"), F.col("vuln_id"))
        out = rows.withColumn("exploit_prob", final).withColumn("ml_severity", F.coalesce(C.bucket(F.col("exploit_prob")), F.col("ml_severity")))
        return cut(out.withColumn("composite_risk", C.heuristic_risk(F.col("severity"), F.col("confidence"), F.col("risk_score"))))

    # -- 5: decisions
    @cached_property
    def decisions(self) -> DataFrame:
        """A strategy for every finding: the one given for it, else the weakness's first."""
        rows = self.scored.select("vuln_id", "file", "cwe", "line", patches.first_strategy(F.col("cwe")).alias("usual"))
        if self.chosen is None:
            return rows.withColumnRenamed("usual", "strategy")
        return rows.join(self.chosen.select("vuln_id", F.col("strategy").alias("_s")), "vuln_id", "left").withColumn("strategy", F.coalesce("_s", "usual")).drop("_s", "usual")

    # -- 6: patches and their proof
    @cached_property
    def patches(self) -> tuple[DataFrame, DataFrame]:
        results, patched = patches.apply(self.files.select("file", "text"), self.decisions.withColumnRenamed("vuln_id", "finding_id"), "file", "text")
        return cut(results), cut(patched)

    @cached_property
    def verification(self) -> DataFrame:
        changed = self.patches[1].join(self.files.select("file", "lang"), "file").select("file", "lang", F.col("patched").alias("text"))
        facts = cut(parse.facts(changed, text="text", lang="lang", keep=("file",)))
        after = rules.scan(changed, facts, "file", "text")
        before = self.findings.join(changed.select("file"), "file", "left_semi")
        return patches.verified(before.select("file", "rule_name", "line"), after.select("file", "rule_name", "line"), "file")
