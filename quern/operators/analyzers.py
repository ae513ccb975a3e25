"""A registry of analyzers by language, and their results as table functions for SQL.

    analyzers.add("ini", [".ini"], ini_file)          # (path, text) -> parse.Parsed
    analyzers.register(spark)
    spark.sql("SELECT f.path, d.id, d.start_line FROM files f, LATERAL definitions(f.path, f.text, f.language) d")

`definitions`, `calls` and `imports` are Python table functions: a file at a time, wherever its row lies, so a lateral
join moves nothing. What is added later is known to functions that are registered after it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from quern.operators import parse
from quern.sources import corpus
from quern.sources.tables import spread

Analyzer = Callable[[str, str], parse.Parsed]


def add(language: str, extensions: list[str], analyzer: Analyzer, builtins: tuple[str, ...] = ()) -> None:
    """Makes a language known to scans, call graphs, outlines and the table functions; replaces one of that name.

    The module of the analyzer travels to the executors by value, as this package does.
    """
    if analyzer.__module__ in sys.modules and analyzer.__module__ != "__main__":
        cloudpickle.register_pickle_by_value(sys.modules[analyzer.__module__])
    parse.ANALYZERS[language] = analyzer
    parse.BUILTINS[language] = frozenset(builtins)
    for e in (x.lstrip(".").lower() for x in extensions):
        corpus.LANGUAGES[e] = language
        if e not in corpus.EXTENSIONS:
            corpus.EXTENSIONS.append(e)


def languages() -> list[str]:
    return sorted(parse.ANALYZERS)


def register(spark: SparkSession) -> None:
    """Registers definitions, calls and imports (path, text, language) in a session."""
    parsed = parse.parsed

    class Definitions:
        def eval(self, path: str, text: str, language: str) -> Iterator[tuple]:
            for n in parsed(path, text or "", language or "").nodes:
                yield n.id, n.name, n.type, n.start, n.end, n.parameters

    class Calls:
        def eval(self, path: str, text: str, language: str) -> Iterator[tuple]:
            yield from parsed(path, text or "", language or "").calls

    class Imports:
        def eval(self, path: str, text: str, language: str) -> Iterator[tuple]:
            yield from parsed(path, text or "", language or "").imports.items()

    kinds = {
        "definitions": (Definitions, "id string, name string, component_type string, start_line int, end_line int, parameters array<string>"),
        "calls": (Calls, "caller string, callee string, line int"),
        "imports": (Imports, "name string, target string"),
    }
    for name, (table, schema) in kinds.items():
        spark.udtf.register(name, udtf(table, returnType=schema))


def table(files: DataFrame, function: str) -> DataFrame:
    """files (path, text, language) with the columns of a registered table function, parsed on all cores."""
    spread(files).createOrReplaceTempView("__files")
    return files.sparkSession.sql(f"SELECT f.path, t.* FROM __files f, LATERAL {function}(f.path, f.text, f.language) t")
