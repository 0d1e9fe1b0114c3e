"""Source files that do not parse (problem 4).

A file is read under every dialect of its language at once, by generalised LL with a graph-structured stack
(``gll``), and flagged when every dialect rejects it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import grammars as G
from . import lexers as L
from .gll import Grammar

#: Language to its lexer, its grammar and the start rules of its dialects.
LANGUAGES = {
    "c": (L.C, G.C, ("c17",)),
    "cpp": (L.Cpp, G.CPP, ("cpp20", "cpp20module")),
    "java": (L.Java, G.JAVA, ("java21", "java21module")),
    "python": (L.Python, G.PYTHON, ("python313",)),
    "go": (L.Go, G.GO, ("go122",)),
}


@cache
def _parser(language: str) -> tuple[L.Lexer, Grammar, frozenset]:
    lexer, text, starts = LANGUAGES[language]
    lexer = lexer()
    return lexer, Grammar(text, lexer.kinds), frozenset(starts)


_FIELD = frozenset(["fexpression"])


def valid(text: str, language: str) -> bool:
    """Whether some dialect of the language accepts the whole text, each way it can be read."""
    lexer, grammar, starts = _parser(language)
    ways = lexer.read(text)
    if ways is None or not all(grammar.accepts(starts, w) for w in ways):
        return False
    if language == "python":
        for x in lexer.fields:
            s = lexer.string(x)
            if L.WRONG in s or not grammar.accepts(_FIELD, [s]):
                return False
    return True


def checked(df: DataFrame, *, id_: str, text: str, language: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, language, broken`` and the columns ``keep`` of every row that is a case.

    The language is lower-cased and trimmed.  No cases: null and blank texts, null languages, languages
    without a grammar.  A row is broken when its text as a whole is rejected by every dialect of its
    language.  Repeated rows each come out; long texts are read whole.
    """
    rows = df.select(F.col(id_).cast("bigint").alias("id"), F.lower(F.trim(F.col(language))).alias("language"), F.col(text).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    rows = rows.where(F.col("language").isin(*LANGUAGES) & F.col("text").rlike(r"(?U)\S"))
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            languages = b["language"].to_pylist()
            broken = [not valid(t.as_py(), g) for t, g in zip(b["text"], languages, strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["language"], pa.array(broken, pa.bool_()), *[b[k] for k in kept]], ["id", "language", "broken", *kept])

    schema = ["id bigint", "language string", "broken boolean", *[f"{k} {dict(rows.dtypes)[k]}" for k in kept]]
    out = spread(rows.select("id", "language", "text", *kept)).mapInArrow(run, ", ".join(schema))
    return out.select("id", "language", "broken", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def rates(checked_: DataFrame, repo: str) -> DataFrame:
    """``repo, language, n_files, n_broken, rate`` (share of broken files, 0..1)."""
    return checked_.groupBy(F.col(repo).alias("repo"), "language").agg(F.count("*").alias("n_files"), F.count_if("broken").alias("n_broken"), F.round(F.avg(F.col("broken").cast("int")), 6).alias("rate"))
