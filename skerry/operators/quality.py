"""Diagnostics of notes, Base documents and canvases, each as rows of what is wrong."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.errors import EngineError
from skerry.plans import base_query
from skerry.sources import markdown


def dangling(child: DataFrame, parent: DataFrame, on: str) -> DataFrame:
    """Rows that refer to no row of parent."""
    return child.join(parent, on, "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def bad_frontmatter(notes: DataFrame, limit: int = 10) -> DataFrame:
    """The first notes whose frontmatter doesn't parse; placeholders between {{ }} don't count as errors."""
    plain = F.regexp_replace("raw", r"(?s)\{\{.*?\}\}", "PLACEHOLDER")
    return notes.where(F.col("fm_error").isNotNull()).select("path", "fm_error", (plain != F.col("raw")).alias("has_placeholder")).orderBy("path").limit(limit)


CANVAS = (
    "nodes array<struct<id:string,type:string,x:bigint,y:bigint,width:bigint,height:bigint,color:string,text:string,file:string,subpath:string,url:string,label:string,background:string,backgroundStyle:string>>,"
    "edges array<struct<id:string,fromNode:string,toNode:string,fromSide:string,toSide:string,fromEnd:string,toEnd:string,color:string,label:string>>"
)


def canvas_tables(canvases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of canvases(path, json) with their position, which is the order of drawing."""
    parsed = canvases.select("path", F.from_json("json", CANVAS).alias("c"))
    return tuple(parsed.select("path", F.posexplode(f"c.{part}").alias("pos", "x")).select("path", "pos", "x.*") for part in ("nodes", "edges"))


def canvas_problems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, code, at): ids used twice and edges that end in no node."""
    ids = nodes.select("path", "id").union(edges.select("path", "id"))
    twice = duplicates(ids, ["path", "id"]).select("path", F.lit("canvas/duplicate-id").alias("code"), F.col("id").alias("at"))
    known = nodes.select("path", F.col("id").alias("node")).distinct()
    out = twice
    for end in ("fromNode", "toNode"):
        loose = edges.withColumn("node", F.col(end)).join(known, ["path", "node"], "left_anti")
        out = out.unionByName(loose.select("path", F.lit("canvas/dangling-edge").alias("code"), F.concat(F.lit("edges["), F.col("pos").cast("string"), F.lit(f"].{end}")).alias("at")))
    return out


def remove_canvas_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes gone(path, id), and without the edges at them."""
    left = nodes.join(gone, ["path", "id"], "left_anti")
    for end in ("fromNode", "toNode"):
        edges = edges.join(gone.select("path", F.col("id").alias(end)), ["path", end], "left_anti")
    return left, edges


def update_canvas(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Canvas nodes or edges after patches, which have path, id and any of their other columns; a null leaves a value as it is. Ids can't be changed."""
    names = [c for c in patches.columns if c not in ("path", "id")]
    both = rows.join(patches.select("path", "id", *(F.col(c).alias(f"_{c}") for c in names)), ["path", "id"], "left")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in rows.columns))


def add_canvas_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and new ones(path, pos and other columns): one without x stands 60 to the right of all others, without y at 0, without an id gets one of its own."""
    right = nodes.groupBy("path").agg((F.max(F.col("x") + F.col("width")) + 60).alias("_right"), (F.max("pos") + 1).alias("_next"))
    put = new.join(right, "path", "left")
    values = {c: F.col(c) if c in new.columns else F.lit(None).cast(nodes.schema[c].dataType) for c in nodes.columns}
    values["pos"] = F.coalesce("_next", F.lit(0)) + values["pos"]
    values |= {"x": F.coalesce(values["x"], "_right", F.lit(0)), "y": F.coalesce(values["y"], F.lit(0)), "id": F.coalesce(values["id"], F.concat(F.lit("node-"), values["pos"].cast("string")))}
    return nodes.unionByName(put.select(*(v.alias(c) for c, v in values.items())))


def add_canvas_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True).select(edges.columns)


def remove_canvas_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["path", "id"], "left_anti")


def add_canvas_groups(nodes: DataFrame, members: DataFrame, padding: int = 40) -> DataFrame:
    """nodes and one of type group around the members(path, id) of each canvas, drawn before all others."""
    box = group_bounds(nodes.join(members, ["path", "id"], "left_semi"), padding)
    group = box.withColumns({"id": F.lit("group"), "type": F.lit("group"), "pos": F.lit(-1)})
    return nodes.unionByName(group, allowMissingColumns=True).select(nodes.columns)


def all_problems(*found: DataFrame) -> DataFrame:
    """Diagnostics (path, code, at) of several kinds as one table, each once."""
    out = found[0].select("path", "code", "at")
    for x in found[1:]:
        out = out.unionByName(x.select("path", "code", "at"))
    return out.distinct()


#: Operations on a Base document's sections: (section, whether it must be there, whether it may be there).
SECTIONS = {"add_formula": ("formulas", False, False), "remove_formula": ("formulas", True, None), "set_property": ("properties", False, True), "remove_property": ("properties", True, None), "set_summary": ("summaries", False, True), "remove_summary": ("summaries", True, None)}


def edit_base(document: dict, operations: list[dict]) -> dict:
    """A Base document after operations {"op", "name", "value"}, all or none of them; the result is checked as a whole.

    Besides SECTIONS there are set_filters, add_view, update_view (a merge patch) and remove_view."""
    out = copy.deepcopy(document)
    for i, step in enumerate(operations):
        op, name, value = step.get("op"), step.get("name"), step.get("value")

        def fail(why: str, i=i, name=name) -> EngineError:
            return EngineError("base/operation", f"operation {i}: {name}: {why}")

        if op == "set_filters":
            out["filters"] = value
            continue
        if not isinstance(name, str) or not name.strip():
            raise fail("it has no name")
        if op in SECTIONS:
            section, there, may = SECTIONS[op]
            part = out.setdefault(section, {})
            if there and name not in part:
                raise fail("it doesn't exist")
            if may is False and name in part:
                raise fail("it exists")
            if there:
                del part[name]
            else:
                part[name] = value
            continue
        views = out.setdefault("views", [])
        own = next((v for v in views if v.get("name") == name), None)
        if op == "add_view" and own is None:
            views.append({**(value or {}), "name": name})
        elif op == "update_view" and own is not None:
            views[views.index(own)] = markdown.merge_frontmatter(own, value or {}) | {"name": name}
        elif op == "remove_view" and own is not None:
            views.remove(own)
        else:
            raise fail(f"{op} can't be done")
    if problems := base_problems(out):
        raise EngineError("format/base-schema", "; ".join(f"{at}: {why}" for at, why in problems))
    return out


def group_bounds(nodes: DataFrame, padding: int = 40) -> DataFrame:
    """(path, x, y, width, height) of a group around nodes."""
    box = nodes.groupBy("path").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1"))
    return box.select("path", (F.col("x0") - padding).alias("x"), (F.col("y0") - padding).alias("y"), (F.col("x1") - F.col("x0") + 2 * padding).alias("width"), (F.col("y1") - F.col("y0") + 2 * padding).alias("height"))


def base_problems(document: dict) -> list[tuple[str, str]]:
    """(path in the document, message) of what a Base document's schema forbids."""
    out = []
    for i, view in enumerate(document.get("views") or []):
        at = f"views[{i}]"
        if view.get("type") not in base_query.VIEW_TYPES:
            out.append((f"{at}.type", "not a view type"))
        try:
            base_query.from_inline(view | {"properties": document.get("properties") or {"file.name": {}}})
        except EngineError as e:
            out.append((at, str(e)))
        for name, kind in (view.get("summaries") or {}).items():
            if kind not in base_query.SUMMARIES and kind not in (document.get("summaries") or {}):
                out.append((f"{at}.summaries.{name}", "not a summary"))
        for name in view.get("order") or []:
            if name.startswith("formula.") and name[8:] not in (document.get("formulas") or {}):
                out.append((f"{at}.order", f"no formula {name[8:]}"))
    for where, node in [("filters", document.get("filters")), *((f"views[{i}].filters", v.get("filters")) for i, v in enumerate(document.get("views") or []))]:
        out += _filter_problems(node, where)
    return out


def _filter_problems(node: object, at: str) -> list[tuple[str, str]]:
    if node is None or isinstance(node, str):
        return []
    if not isinstance(node, dict) or len(node) != 1 or next(iter(node)) not in ("and", "or", "not"):
        return [(at, "a filter is a text or has one of the keys and, or, not")]
    key, inner = next(iter(node.items()))
    return [p for i, x in enumerate(inner if isinstance(inner, list) else [inner]) for p in _filter_problems(x, f"{at}.{key}[{i}]")]
