"""The link graph: resolution of links to notes, neighbours, backlinks, shortest paths, orphans and phantoms, and its upkeep.

nodes(path, title, phantom) and edges(edge_id, from, to, kind) are DataFrames; parallel edges are kept. Expansions are
joins with a frontier; each level's is written once into the shared folder, so no level computes those before again and a
plan is as long as one level's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry import store
from skerry.errors import EngineError

DIRECTIONS = ("out", "in", "both")


def resolve(links: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of links(edge_id, from, target, kind) among notes(path, title).

    A target is a note's path, its path without .md, or, without a slash, the stem of the smallest such path; else a phantom."""
    known = notes.select(F.col("path").alias("p"))
    stems = notes.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "").alias("stem")).groupBy("stem").agg(F.min("path").alias("s"))
    found = (
        links.where(F.coalesce(F.col("target"), F.lit("")) != "")
        .join(known, F.col("target") == F.col("p"), "left")
        .join(known.select(F.col("p").alias("p2")), F.concat("target", F.lit(".md")) == F.col("p2"), "left")
        .join(stems, (F.col("target") == F.col("stem")) & (F.instr("target", "/") == 0), "left")
    )
    to = F.coalesce("p", "p2", "s", "target")
    edges = found.select("edge_id", "from", to.alias("to"), "kind", (F.coalesce("p", "p2", "s").isNull()).alias("_phantom"))
    phantoms = edges.where("_phantom").select(F.col("to").alias("path")).distinct()
    nodes = notes.select("path", "title", F.lit(False).alias("phantom")).dropDuplicates(["path"]).unionByName(phantoms.select("path", F.col("path").alias("title"), F.lit(True).alias("phantom")))
    return nodes, edges.drop("_phantom")


def backlinks(edges: DataFrame) -> DataFrame:
    """(path, backlinks): the notes that link to each note, sorted and without repetition."""
    return edges.groupBy(F.col("to").alias("path")).agg(F.array_sort(F.collect_set("from")).alias("backlinks"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes without any link in or out; a link to itself counts."""
    ends = edges.select(F.col("from").alias("path")).union(edges.select(F.col("to").alias("path")))
    return nodes.where("not phantom").join(ends, "path", "left_anti")


def unresolved(nodes: DataFrame, edges: DataFrame, start: str | None = None) -> DataFrame:
    """The phantom targets of one note, or of all, sorted."""
    own = edges if start is None else edges.where(F.col("from") == start)
    return own.join(nodes.where("phantom"), F.col("to") == F.col("path"), "left_semi").select(F.col("to").alias("target")).distinct().orderBy("target")


def _reach(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b): from b one gets to a in one step against, or along, the direction."""
    out = edges.select(F.col("from").alias("a"), F.col("to").alias("b"))
    back = edges.select(F.col("to").alias("a"), F.col("from").alias("b"))
    return out if direction == "out" else back if direction == "in" else out.union(back)


def require(edges: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """An error unless the graph has this node: among nodes, or without these at an edge."""
    known = edges.where((F.col("from") == path) | (F.col("to") == path)) if nodes is None else nodes.where(F.col("path") == path)
    if known.isEmpty():
        raise EngineError("path/not-found", f"{path} is not in the graph")


def distances(edges: DataFrame, start: str, depth: int = 1, direction: str = "both", nodes: DataFrame | None = None) -> DataFrame:
    """(path, distance) of every node within depth steps."""
    if not 1 <= depth <= 4 or direction not in DIRECTIONS:
        raise EngineError("index/invalid-query", f"depth {depth} is not between 1 and 4, or {direction} is no direction")
    require(edges, start, nodes)
    spark, steps = edges.sparkSession, _reach(edges, direction)
    path = store.new_path(spark, "near")
    seen = front = store.added(spark.createDataFrame([(start, 0)], "path string, distance int"), path)
    for d in range(1, depth + 1):
        new = front.join(steps, front["path"] == steps["a"]).select(F.col("b").alias("path")).distinct().join(seen.select("path"), "path", "left_anti")
        seen = store.added(new.select("path", F.lit(d).alias("distance")), path)
        front = seen.where(F.col("distance") == d)
    return seen


def neighbours(edges: DataFrame, start: str, depth: int = 1, direction: str = "both", nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their distance, edges): an edge belongs if it leaves a node nearer than depth in the direction."""
    near = distances(edges, start, depth, direction, nodes)
    inner = near.where(F.col("distance") < depth).select("path")
    by_from = edges.join(inner, F.col("from") == F.col("path"), "left_semi")
    by_to = edges.join(inner, F.col("to") == F.col("path"), "left_semi")
    kept = by_from if direction == "out" else by_to if direction == "in" else by_from.union(by_to).dropDuplicates(["edge_id"])
    return near.orderBy("path"), kept.orderBy("from", "to", "kind")


def shortest_path(edges: DataFrame, start: str, goal: str, direction: str = "out", nodes: DataFrame | None = None) -> DataFrame:
    """(hop, path) from start to goal, of equal ones the one that visits lexicographically smaller notes first; empty if there is none.

    A round for each hop, from the goal back until the start is found, stores how far every note is from the goal. Then the
    way is walked forward: of the notes one step on that are one hop nearer, the smallest is next, one row a hop."""
    require(edges, start, nodes)
    require(edges, goal, nodes)
    spark, steps = edges.sparkSession, _reach(edges, direction)
    path, hop = store.new_path(spark, "hops"), 0
    seen = store.added(spark.createDataFrame([(goal, 0)], "path string, hop int"), path)
    trail = [start]
    while True:
        front = seen.where(F.col("hop") == hop)
        if not front.where(F.col("path") == start).isEmpty():
            break
        new = front.join(steps, front["path"] == steps["b"]).select(F.col("a").alias("path")).distinct().join(seen.select("path"), "path", "left_anti")
        hop += 1
        seen = store.added(new.select("path", F.lit(hop).alias("hop")), path)
        if seen.where(F.col("hop") == hop).isEmpty():
            trail = []
            break
    for left in range(hop - 1, -1, -1) if trail else []:
        nearer = seen.where(F.col("hop") == left)
        trail.append(steps.where(F.col("a") == trail[-1]).join(nearer, F.col("b") == nearer["path"]).agg(F.min("b")).first()[0])
    store.remove(spark, path)
    return spark.createDataFrame(list(enumerate(trail)), "hop int, path string")


def upsert(nodes: DataFrame, edges: DataFrame, notes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after notes(path, title) are new or changed, with all their links(edge_id, from, target, kind).

    Their outgoing edges are replaced, a phantom that is a note now becomes one in place, and phantoms to which no edge
    leads are dropped."""
    real = nodes.where("not phantom").select("path", "title").join(notes, "path", "left_anti").unionByName(notes.select("path", "title"))
    made, new = resolve(links, real)
    edges = edges.join(notes.select(F.col("path").alias("from")), "from", "left_anti").select("edge_id", "from", "to", "kind").unionByName(new)
    phantoms = nodes.where("phantom").unionByName(made.where("phantom")).dropDuplicates(["path"]).join(real, "path", "left_anti")
    return real.select("path", "title", F.lit(False).alias("phantom")).unionByName(_linked(phantoms, edges)), edges


def remove(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after notes gone(path) are deleted: those to which edges of others lead become phantoms, titled by their path."""
    edges = edges.join(gone.select(F.col("path").alias("from")), "from", "left_anti").select("edge_id", "from", "to", "kind")
    dead = gone.select("path").distinct().withColumn("_gone", F.lit(True))
    marked = nodes.join(dead, "path", "left").withColumn("_gone", F.col("_gone").isNotNull())
    marked = marked.select("path", F.when(F.col("_gone"), F.col("path")).otherwise(F.col("title")).alias("title"), (F.col("phantom") | F.col("_gone")).alias("phantom"))
    return marked.where("not phantom").unionByName(_linked(marked.where("phantom"), edges)), edges


def _linked(phantoms: DataFrame, edges: DataFrame) -> DataFrame:
    return phantoms.join(edges.select(F.col("to").alias("path")), "path", "left_semi").select("path", "title", "phantom")


def resolve_reading(links: DataFrame, files: DataFrame) -> DataFrame:
    """links(from, target) with resolved, by the rule for reading a note, which differs from the graph's.

    Case doesn't count; without an extension .md is added; a target without a slash is a file of this name in any folder.
    Absolute targets and those with a backslash, a colon or a step to a parent folder are never resolved."""
    target = F.col("target")
    invalid = target.rlike(r"^/|[\\:]|(^|/)\.\.(/|$)") | (target == "")
    name = F.element_at(F.split(target, "/"), -1)
    full = F.lower(F.when(name.rlike(r"[^.]\.[^.]*$"), target).otherwise(F.concat(target, F.lit(".md"))))
    rows = links.withColumn("_full", full).withColumn("_valid", ~invalid)
    whole = files.select(F.lower("path").alias("_full")).distinct().withColumn("_whole", F.lit(True))
    named = files.select(F.lower(F.element_at(F.split("path", "/"), -1)).alias("_full")).distinct().withColumn("_named", F.lit(True))
    rows = rows.join(whole, "_full", "left").join(named, "_full", "left")
    found = F.col("_valid") & (F.col("_whole").isNotNull() | (F.col("_named").isNotNull() & ~F.col("_full").contains("/")))
    return rows.withColumn("resolved", found).select(*links.columns, "resolved")
