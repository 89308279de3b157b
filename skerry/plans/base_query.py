"""View queries over notes or any table: filter, sort, limit and project, compiled to DataFrame operations.

A definition comes from a Base document (YAML) or inline. Filters are trees of and / or / not whose leaves are short
expressions; they become one Column, so Catalyst plans, prunes and pushes them down. Every leaf is two-valued.
Invalid filters, sort keys and columns are errors at once, before any row is read.
"""

from __future__ import annotations

import ast
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.functions import values as V

# The properties of a note's file, and the names of summaries.
FILE_PROPERTIES = ["name", "basename", "path", "ext", "folder", "size", "ctime", "mtime", "properties", "tags", "links", "embeds", "backlinks"]
SUMMARIES = ["Average", "Min", "Max", "Sum", "Range", "Median", "Stddev", "Earliest", "Latest", "Checked", "Unchecked", "Empty", "Filled", "Unique", "Count"]
VIEW_TYPES = ["table", "cards", "list", "map"]


@dataclass
class Definition:
    filters: list = field(default_factory=list)  # every one must hold
    columns: list[str] = field(default_factory=list)
    sort: list[tuple[str, bool]] = field(default_factory=list)  # (property, descending)
    limit: int | None = None
    formulas: dict[str, str] = field(default_factory=dict)
    group_by: tuple[str, bool] | None = None
    summaries: dict[str, str] = field(default_factory=dict)


def parse_base(text: str) -> dict:
    """A Base document's YAML as a mapping."""
    import yaml

    try:
        got = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise EngineError("format/base-schema", str(e)) from e
    if got is not None and not isinstance(got, dict):
        raise EngineError("format/base-schema", "the document is not a mapping")
    return got or {}


def from_document(document: dict, view: str | None = None) -> Definition:
    """The definition of a named view, or of the first."""
    views = document.get("views") or []
    chosen = next((v for v in views if view is None or v.get("name") == view), None)
    if chosen is None:
        raise EngineError("query/base-view-not-found", f"no view {view!r}")
    d = from_inline(chosen | {"formulas": document.get("formulas") or {}, "properties": document.get("properties") or {}})
    if document.get("filters") is not None:
        d.filters.insert(0, document["filters"])
    return d


def from_inline(given: dict) -> Definition:
    columns = list(given.get("order") or (given.get("properties") or {}).keys())
    if not columns:
        raise EngineError("query/base-query-no-columns", "neither order nor properties name a column")
    limit = given.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise EngineError("query/base-query-malformed", "limit is a positive whole number")
    group = given.get("groupBy")
    return Definition(
        filters=[] if given.get("filters") is None else [given["filters"]],
        columns=columns,
        sort=[_key(x) for x in given.get("sort") or []],
        limit=limit,
        formulas=dict(given.get("formulas") or {}),
        group_by=_key(group) if group else None,
        summaries=dict(given.get("summaries") or {}),
    )


def _key(given: dict) -> tuple[str, bool]:
    direction = given.get("direction", "ASC")
    if "property" not in given or direction not in ("ASC", "DESC"):
        raise EngineError("query/base-query-malformed", f"not a sort key: {given}")
    return given["property"], direction == "DESC"


class Properties:
    """Resolves property names of a table to lanes: file.* to the table's file columns, others to a column or a frontmatter key."""

    def __init__(self, df: DataFrame) -> None:
        self.kinds = {f.name: f.dataType for f in df.schema.fields}

    def raw(self, name: str) -> str:
        """The column of a file property."""
        if name not in FILE_PROPERTIES:
            raise EngineError("query/base-query-unsupported-file-property", f"file.{name}")
        return {"properties": "frontmatter_json"}.get(name, name)

    def lanes(self, name: str) -> Column:
        if name.startswith("formula."):
            raise EngineError("query/base-query-formula-reference", f"{name} can't be used here")
        if name.startswith("file."):
            column = self.raw(name[5:])
            return V.of_column(F.col(f"`{column}`"), self.kinds[column]) if column in self.kinds else V.missing()
        key = name[5:] if name.startswith("note.") else name
        if "frontmatter_json" in self.kinds:
            return V.of_json(F.col("frontmatter_json"), key)
        return V.of_column(F.col(f"`{key}`"), self.kinds[key]) if key in self.kinds else V.missing()


# --- filters ---------------------------------------------------------------------------------------------------------


def compile_filter(node: object, p: Properties) -> Column:
    if node is None:
        return F.lit(True)
    if isinstance(node, str):
        return compile_text(node, p)
    if isinstance(node, dict) and node:
        kind, operands = next(iter(node.items()))
        parts = [compile_filter(x, p) for x in (operands if isinstance(operands, list) else [operands])]
        if kind == "and":
            return _all(parts)
        if kind == "or":
            return _any(parts)
        if kind == "not":
            return ~_all(parts)  # of an empty list: false
    raise EngineError("query/base-query-malformed", f"not a filter: {node!r}")


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for x in parts:
        out = out & x
    return out


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for x in parts:
        out = out | x
    return out


# What a text filter is made of: operators and parentheses, and leaves, in which quotes and the parentheses of calls hide them.
_QUOTED = r"""(?:"[^"]*"|'[^']*')"""
_PIECES = re.compile(rf"""(?P<operator>&&|\|\||!(?!=)|[()])|(?P<leaf>(?:{_QUOTED}|(?<=\w)\((?:{_QUOTED}|[^()])*\)|&(?!&)|\|(?!\|)|!=|[^()&|!])+)""")
_OPERATORS = {"&&": " & ", "||": " | ", "!": " ~ ", "(": "(", ")": ")"}


def compile_text(text: str, p: Properties) -> Column:
    """A filter given as text. `!` binds before `&&`, and that before `||`, as ~, & and | do in Python, whose grammar reads the text."""
    leaves: list[Column] = []
    skeleton = ""
    for piece in _PIECES.finditer(text):
        if piece["operator"]:
            skeleton += _OPERATORS[piece["operator"]]
        elif piece["leaf"].strip():
            skeleton += f"f{len(leaves)}"
            leaves.append(leaf(piece["leaf"].strip(), p))
    try:
        return _folded(ast.parse(skeleton.strip(), mode="eval").body, leaves)
    except SyntaxError:
        raise EngineError("query/base-query-unsupported-filter", text) from None


def _folded(node: ast.expr, leaves: list[Column]) -> Column:
    match node:
        case ast.Name(id=name):
            return leaves[int(name[1:])]
        case ast.UnaryOp(op=ast.Invert(), operand=x):
            return ~_folded(x, leaves)
        case ast.BinOp(left=x, op=ast.BitAnd(), right=y):
            return _folded(x, leaves) & _folded(y, leaves)
        case ast.BinOp(left=x, op=ast.BitOr(), right=y):
            return _folded(x, leaves) | _folded(y, leaves)
    raise SyntaxError(ast.dump(node))


_LEAF = re.compile(
    r"""(?sx)
    file\.(?P<call>hasTag|inFolder)\((?P<argument>.*)\)
    | (?P<inside>[^()"'=!]+)\.contains\((?P<part>.*)\)
    | (?P<name>[^()"'=!]+)(?P<sign>[!=]=)(?P<value>.*)
    """
)


def leaf(text: str, p: Properties) -> Column:
    """A comparison, or one of the calls contains, file.hasTag and file.inFolder."""
    found = _LEAF.fullmatch(text)
    if found is None:
        raise EngineError("query/base-query-unsupported-filter", text)
    if found["sign"]:
        same = V.equals(p.lanes(_name(found["name"])), literal(found["value"].strip()))
        return same if found["sign"] == "==" else ~same
    if found["inside"]:
        return V.contains(p.lanes(_name(found["inside"])), _string(found["part"]))
    argument = _string(found["argument"])
    column = {"hasTag": "tags", "inFolder": "folder"}[found["call"]]
    if column not in p.kinds:
        return F.lit(False)
    folder = argument.rstrip("/")
    held = F.array_contains("tags", argument) if column == "tags" else (F.col("folder") == folder) | F.col("folder").startswith(folder + "/")
    return F.coalesce(held, F.lit(False))


def _name(text: str) -> str:
    if not re.fullmatch(r"[\w.\- ]+", text.strip()):
        raise EngineError("query/base-query-unsupported-filter", f"not a property: {text!r}")
    return text.strip()


def _string(text: str) -> str:
    got = literal(text.strip())
    if not isinstance(got, str):
        raise EngineError("query/base-query-unsupported-filter", f"not a string: {text!r}")
    return got


def literal(text: str) -> object:
    """A quoted string without escapes, true, false, null, a whole number, or another number (null if not finite)."""
    if len(text) >= 2 and text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    if text in ("true", "false"):
        return text == "true"
    if text == "null":
        return None
    try:
        if re.fullmatch(r"[+-]?\d+", text) and -(2**63) <= int(text) < 2**63:
            return int(text)
        number = float(text)
    except ValueError:
        raise EngineError("query/base-query-unsupported-filter", f"not a literal: {text!r}") from None
    return number if math.isfinite(number) else None


# --- columns and execution -------------------------------------------------------------------------------------------


def column_of(name: str, d: Definition, p: Properties) -> Column:
    """A display column: the plain column where the table has it as such, else the property's text; formulas by name."""
    if name.startswith("formula."):
        return formula(name[8:], d, p)
    if name.startswith("file."):
        raw = p.raw(name[5:])
        return F.col(f"`{raw}`") if raw in p.kinds else F.lit(None).cast("string")
    key = name[5:] if name.startswith("note.") else name
    if "frontmatter_json" not in p.kinds and key in p.kinds:
        return F.col(f"`{key}`")
    return V.scalar_text(p.lanes(name))


def formula(name: str, d: Definition, p: Properties) -> Column:
    """A bare property, a link to the note, or a marker that the formula isn't evaluated."""
    text = d.formulas.get(name, "").strip()
    if m := re.fullmatch(r"file\.asLink\(\s*(.*?)\s*\)", text):
        basename = F.col("basename") if "basename" in p.kinds else F.lit("")
        shown = V.scalar_text(p.lanes(m[1])) if m[1] else basename
        return F.struct(F.lit("link").alias("type"), F.col("path").alias("target"), shown.alias("display"))
    if re.fullmatch(r"[A-Za-z0-9_.-]+", text) and not text.startswith("formula."):
        return column_of(text, d, p)
    return F.lit(f"formula.{name} (not evaluated)")


def matching(df: DataFrame, d: Definition) -> DataFrame:
    """Rows of df that every filter keeps."""
    p = Properties(df)
    return df.where(_all([compile_filter(f, p) for f in d.filters]))


def run(df: DataFrame, d: Definition, tie_break: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Filter, sort (ties by tie_break), limit, project. A limit given here overrides the definition's, and may be 0."""
    p = Properties(df)
    rows = matching(df, d)
    keys = [k for name, down in d.sort for k in V.order_keys(p.lanes(name), down)]
    ties = tie_break if tie_break is not None else (["path"] if "path" in p.kinds else [])
    if "path" in ties:
        keys.append(F.lower("path"))
    if keys or ties:
        rows = rows.orderBy(*keys, *ties)
    n = d.limit if limit is None else limit
    rows = rows if n is None else rows.limit(n)
    return rows.select(*(column_of(c, d, p).alias(c) for c in d.columns))


def matched(df: DataFrame, d: Definition) -> DataFrame:
    """One row: how many rows the filters keep, before any limit."""
    return matching(df, d).agg(F.count("*").alias("matched"))


def summarize(df: DataFrame, d: Definition) -> DataFrame:
    """An extension: one row for each group with the summaries of the definition, as <property>_<summary in lower case>."""
    p = Properties(df)
    made = []
    for name, kind in d.summaries.items():
        if kind not in SUMMARIES:
            raise EngineError("base/schema", f"no summary {kind}")
        column = column_of(name, d, p)
        by_kind = {
            "Average": F.avg, "Min": F.min, "Max": F.max, "Sum": F.sum, "Range": lambda c: F.max(c) - F.min(c), "Median": F.median, "Stddev": F.stddev,
            "Earliest": F.min, "Latest": F.max, "Checked": lambda c: F.count_if(c.cast("boolean")), "Unchecked": lambda c: F.count_if(~c.cast("boolean")),
            "Empty": lambda c: F.count_if(c.isNull()), "Filled": lambda c: F.count_if(c.isNotNull()), "Unique": F.count_distinct, "Count": lambda c: F.count(F.lit(1)),
        }
        made.append(by_kind[kind](column).alias(f"{name}_{kind.lower()}"))
    rows = matching(df, d)
    if d.group_by is None:
        return rows.agg(*made)
    return rows.groupBy(column_of(d.group_by[0], d, p).alias(d.group_by[0])).agg(*made)
