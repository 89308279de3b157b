"""A registry of named operations, by which other packages add their own: name -> (spark, arguments) -> DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from skerry.errors import EngineError
from skerry.sources import markdown

Operation = Callable[..., DataFrame]
_known: dict[str, Operation] = {}


def register(name: str, operation: Operation, namespace: str = "") -> None:
    """Add an operation; names of a namespace begin with it and an underscore, and no name is given twice."""
    full = f"{namespace}_{name}" if namespace else name
    if not re.fullmatch(r"[a-z][a-z0-9_]*", full) or full in _known:
        raise EngineError("registry/invalid-name", full)
    _known[full] = operation


def names(namespace: str = "") -> list[str]:
    return sorted(n for n in _known if not namespace or n.startswith(namespace + "_"))


def call(spark: SparkSession, name: str, /, **arguments) -> DataFrame:
    if name not in _known:
        raise EngineError("registry/unknown", name)
    return _known[name](spark, **arguments)


def as_view(spark: SparkSession, name: str, **arguments) -> None:
    """Let SQL read a registered operation, with fixed arguments, as a view of its name."""
    call(spark, name, **arguments).createOrReplaceTempView(name)


@dataclass(frozen=True)
class TableFunction:
    """An operation that SQL calls with arguments: a query over tables and parameters, or a function of a row's values.

    parameters and returns are lists of columns as in a table's definition. A body is SQL, which Spark puts in the place of each call and
    optimises with the query around it; a handler gives the rows for one call's values and runs as a Python function, for
    what SQL can't express, beside a table by LATERAL."""

    parameters: str
    returns: str
    body: str | None = None
    handler: Callable[..., Iterable[tuple]] | None = None


_functions: dict[str, TableFunction] = {}


def register_function(name: str, function: TableFunction) -> None:
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or name in _functions or (function.body is None) == (function.handler is None):
        raise EngineError("registry/invalid-name", name)
    _functions[name] = function


def install(spark: SparkSession, *names: str) -> None:
    """Make registered table functions, all if none is named, known to a session's SQL."""
    for name in names or sorted(_functions):
        if name not in _functions:
            raise EngineError("registry/unknown", name)
        f = _functions[name]
        if f.body is not None:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.parameters}) RETURNS TABLE ({f.returns}) RETURN {f.body}")
        else:
            spark.udtf.register(name, udtf(_handler(f.handler), returnType=f.returns))


def _handler(rows: Callable[..., Iterable[tuple]]) -> type:
    class Handler:
        def eval(self, *values):
            yield from rows(*values)

    return Handler


def _links(text: str) -> Iterable[tuple]:
    try:
        yield from ((x.target, x.display, x.heading, x.block, x.embed, x.pos) for x in markdown.links(text or ""))
    except EngineError:  # a note with a bad link has none
        return


def _sections(text: str) -> Iterable[tuple]:
    return ((n, trail, body) for n, (trail, body) in enumerate(markdown.sections(text or "")))


register_function("note_links", TableFunction("text STRING", "target string, display string, heading string, block string, embed boolean, pos int", handler=_links))
register_function("note_sections", TableFunction("text STRING", "ordinal int, heading_context array<string>, body string", handler=_sections))
#: Over the tables or views graph_nodes(path, title, phantom) and graph_edges(edge_id, from, to, kind).
register_function("note_backlinks", TableFunction("note STRING", "source STRING, kind STRING, n BIGINT", body="SELECT `from`, kind, count(*) FROM graph_edges WHERE `to` = note GROUP BY `from`, kind"))
register_function("notes_under", TableFunction("prefix STRING", "path STRING, title STRING", body="SELECT path, title FROM graph_nodes WHERE NOT phantom AND (path = prefix OR startswith(path, rtrim('/', prefix) || '/'))"))
