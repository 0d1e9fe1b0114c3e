"""Source files and data sets as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

# The extensions scanned, their languages, and the folders left out.
EXTENSIONS = {"c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "py": "python", "go": "go"}
SKIPPED = ["__pycache__", ".git", ".svn", ".hg", "node_modules", "vendor", "venv", ".venv", "env", "dist", "build", "target", ".idea"]


def language_of(path: Column) -> Column:
    """The language of a path by its extension, lower-cased; null for any other."""
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def scan(spark: SparkSession, path: str, language: str | None = None) -> DataFrame:
    """``file, lang, text, file_ord`` of a file, or of all source files under a folder.

    ``language`` overrides the extension.  Hidden and vendored folders are left out.  Bytes that are not
    UTF-8 become U+FFFD.  Files are numbered by path.  No source file at all is an error.
    """
    glob = "*.{" + ",".join(sorted({*EXTENSIONS, *(e.upper() for e in EXTENSIONS)})) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if language is None:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("file"), "content")
    root = path.rstrip("/")
    below = F.when(F.startswith(F.col("file"), F.lit(root + "/")), F.expr(f"substring(file, {len(root) + 2})")).otherwise(file_name(F.col("file")))
    folders = F.slice(F.split(below, "/"), F.lit(1), F.size(F.split(below, "/")) - 1)
    kept = ~F.exists(folders, lambda d: d.isin(*SKIPPED) | F.startswith(d, F.lit(".")))
    out = found.where(kept).withColumn("lang", F.lit(language) if language else language_of(F.col("file"))).where(F.col("lang").isNotNull())
    if out.isEmpty():
        raise FileNotFoundError(f"no source files in {path}")
    names = out.select("file").distinct().orderBy("file")
    numbered = names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("file string, file_ord bigint")
    return out.join(numbered, "file").select("file", "lang", F.expr("make_valid_utf8(cast(content AS STRING))").alias("text"), "file_ord")


def per_language(files: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, n_files``."""
    return files.groupBy(lang).agg(F.count("*").alias("n_files"))


def split_lines(text: Column) -> Column:
    """Lines without their ends (LF, CRLF or CR); a last line end opens no further line; null stays null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r"))


def lines(files: DataFrame, text: str, *keep: str, line: str = "line", src: str = "src") -> DataFrame:
    """One row a line: the columns kept, the number from 1, and the line itself. Null texts have none."""
    each = spread(files.select(*keep, text)).select(*keep, F.posexplode(split_lines(F.col(text))).alias("_pos", src))
    return each.select(*keep, (F.col("_pos") + 1).alias(line), src)


def json_dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A JSON array of objects, one row a key: of repeated keys the last counts. Unreadable rows are dropped; a
    missing file gives an empty table of the key alone."""
    try:
        rows = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:  # AnalysisException: the path does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{key} string")
    if key not in rows.columns:
        return spark.createDataFrame([], f"{key} string")
    ordered = rows.withColumn("_ord", F.monotonically_increasing_id())
    others = [c for c in rows.columns if c != key]
    best = ordered.groupBy(key).agg(F.max_by(F.struct(*others), "_ord").alias("_v")) if others else ordered.select(key).distinct()
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in others]) if others else best


def mean_base_score(cves: DataFrame) -> DataFrame:
    """``cwe, score``: of each weakness's records the mean of the first non-zero of the scores by version 3.1,
    3.0 and 2, rounded to 2; records without a score do not count."""
    score = F.coalesce(F.nullif("v31", F.lit(0.0)), F.nullif("v30", F.lit(0.0)), F.nullif("v2", F.lit(0.0)))
    return cves.withColumn("_s", score).where(F.col("_s").isNotNull()).groupBy("cwe").agg(F.round(F.avg("_s"), 2).alias("score"))


# The names under which the public data sets hold code, label and language.
ALTERNATIVES = {"code": ["func", "func_before", "code", "vul_func", "method"], "label": ["target", "vul", "label", "is_vulnerable"], "lang": ["lang", "language", "programming_language"]}


def _first(df: DataFrame, names: list[str]) -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def labelled(df: DataFrame, source: str, least: int = 20, languages: tuple[str, ...] | None = None, most: int | None = None, order: str | None = None) -> DataFrame:
    """``code, label, lang, source`` of a public data set, whatever its column names; texts under ``least``
    characters are dropped; ``most`` keeps the first so many in ``order``."""
    out = df.select(_first(df, ALTERNATIVES["code"]).alias("code"), F.coalesce(_first(df, ALTERNATIVES["label"]).try_cast("int"), F.lit(0)).alias("label"), F.lower(F.trim(F.coalesce(_first(df, ALTERNATIVES["lang"]), F.lit("c")))).alias("lang"), F.lit(source).alias("source"), *([F.col(order).alias("_o")] if order else []))
    out = out.where(F.length(F.trim("code")) >= least)
    if languages:
        out = out.where(F.col("lang").isin(*languages))
    if most is not None:
        out = out.orderBy("_o" if order else "code").limit(most)
    return out.select("code", "label", "lang", "source")


def before_and_after(df: DataFrame, before: str, after: str, lang: Column, source: str, least: int = 20) -> DataFrame:
    """The rows before a fix with label 1 and after it with label 0, repeated texts once each."""
    both = df.select(lang.alias("lang"), F.explode(F.array(F.struct(F.col(before).alias("code"), F.lit(1).alias("label")), F.struct(F.col(after).alias("code"), F.lit(0).alias("label")))).alias("x"))
    rows = both.select("x.code", "x.label", "lang", F.lit(source).alias("source")).where(F.length(F.trim("code")) >= least)
    return rows.groupBy(F.md5("code").alias("_h")).agg(F.max_by(F.struct("code", "label", "lang", "source"), F.col("label")).alias("r")).select("r.*")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header whose fields may hold line ends."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def features(spark: SparkSession, path: str) -> DataFrame:
    """A stored feature table, Parquet or JSON."""
    return spark.read.option("multiLine", True).json(path) if path.endswith(".json") else spark.read.parquet(path)
