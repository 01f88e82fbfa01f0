"""Paths in the graph of references.

Nodes are symbols; an edge leads from a symbol to each one whose name is among
its references.  A search goes from the goals backward, all goals at once, one
level each round: the frontier joins the edges, what was met before is left out,
and what is new is written and the next frontier.  The rounds are as many as the
longest of the shortest paths; no set of nodes is ever on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symsearch.operators.checkpoints import checkpointed


def edges(symbols: DataFrame, id_col: str = "id") -> DataFrame:
    """(src, dst) of symbols (id, name, relocations): src refers to dst's name exactly."""
    asked = symbols.select(F.col(id_col).alias("src"), F.explode(F.array_distinct("relocations")).alias("name"))
    return asked.join(symbols.select(F.col(id_col).alias("dst"), "name"), "name").select("src", "dst")


def neighbours(symbols: DataFrame, name: str) -> DataFrame:
    """The symbols that refer to exactly this name."""
    return symbols.where(F.array_contains("relocations", name))


@dataclass
class Progress:
    """Called as a search goes on."""

    visited: Callable[[int], object] = lambda n: None
    found: Callable[[], object] = lambda: None
    done: Callable[[int, int], object] = lambda done, total: None


def levels(graph: DataFrame, goals: DataFrame, *, starts: DataFrame | None = None, most: int | None = None, progress: Progress | None = None) -> DataFrame:
    """(goal, node, next, hops): for each goal each node that leads to it, the next node on a shortest way, and the number of edges.

    ``graph``: (src, dst); ``goals``: (goal).  Among equal ways the smallest next
    node counts.  A goal leads to itself only by a cycle, which is not followed.
    ``starts`` (start): a goal is done with the round that reaches any of them.
    """
    ends = None if starts is None else checkpointed(starts.select(F.col("start").alias("node")).distinct())
    graph = checkpointed(graph.distinct())
    frontier = checkpointed(goals.select("goal", F.col("goal").alias("node"), F.lit(None).cast(goals.schema["goal"].dataType).alias("next"), F.lit(0).alias("hops")).distinct())
    met = frontier
    hops = 0
    while most is None or hops < most:
        hops += 1
        step = frontier.select("goal", F.col("node").alias("dst")).join(graph, "dst").groupBy("goal", F.col("src").alias("node")).agg(F.min("dst").alias("next"))
        frontier = checkpointed(step.join(met.select("goal", "node"), ["goal", "node"], "left_anti").select("goal", "node", "next", F.lit(hops).alias("hops")))
        if progress:
            progress.visited(frontier.count())
        if frontier.isEmpty():
            break
        met = met.union(frontier)  # each part of it is written already
        if ends is not None:
            frontier = frontier.join(frontier.join(ends, "node", "left_semi").select("goal").distinct(), "goal", "left_anti")
    return met


def routes(graph: DataFrame, starts: DataFrame, goals: DataFrame, *, num_routes: int | None = 1, zero_hops: bool = False, most: int | None = None, progress: Progress | None = None) -> DataFrame:
    """(goal, start, path): for each goal one shortest path from any of the starts, for ``num_routes`` goals at most (None or 0: all).

    A path has an edge at least, unless ``zero_hops`` takes a goal that is a
    start for a path of itself.
    """
    all_levels = levels(graph, goals, starts=starts, most=most, progress=progress)
    if not zero_hops:
        # a way back to the goal itself: over the goal's successors
        around = graph.where("src = dst").select(F.col("src").alias("goal"), F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(1).alias("hops"))
        back = graph.select(F.col("src").alias("goal"), F.col("dst").alias("node")).join(all_levels, ["goal", "node"]).groupBy("goal").agg(F.min(F.struct(F.col("hops") + 1, F.col("node"))).alias("m"))
        own = back.select("goal", F.col("goal").alias("node"), F.col("m.node").alias("next"), F.col("m.col1").alias("hops")).unionByName(around.join(goals, "goal", "left_semi"))
        candidates = all_levels.where("hops > 0").unionByName(own)
    else:
        candidates = all_levels
    ends = candidates.join(starts.select(F.col("start").alias("node")).distinct(), "node", "left_semi")
    one = ends.groupBy("goal").agg(F.min(F.struct("hops", "node", "next")).alias("m")).select("goal", F.col("m.node").alias("start"), F.col("m.hops").alias("left"), F.col("m.next").alias("at"), F.array("m.node").alias("path"))
    if num_routes:
        one = one.orderBy("goal").limit(num_routes)
    one = checkpointed(one)
    steps = all_levels.select("goal", F.col("node").alias("at"), F.col("next").alias("then"))
    while not (open_ := one.where("left > 0")).isEmpty():
        moved = open_.join(steps, ["goal", "at"], "left").select("goal", "start", (F.col("left") - 1).alias("left"), F.col("then").alias("at"), F.array_append("path", F.col("at")).alias("path"))
        one = checkpointed(one.where("left = 0").unionByName(moved))
    if progress:
        n = one.count()
        for i in range(n):
            progress.found()
            progress.done(i + 1, n)
    return one.select("goal", "start", "path")


def depth_first(graph: DataFrame, start: object, goals: set, *, neighbours_of: Callable[[object], list] | None = None) -> list | None:
    """A path of an edge or more from a start to any of a few goals, deepest first with the smallest neighbour first; None: there is none.

    Depth-first search is one step after another by nature: the driver walks,
    and asks for one node's neighbours at a time.
    """
    ask = neighbours_of or (lambda node: sorted(r.dst for r in graph.where(F.col("src") == F.lit(node)).select("dst").distinct().collect()))
    stack, seen = [[start, iter(ask(start))]], {start}
    while stack:
        node = next(stack[-1][1], None)
        if node is None:
            stack.pop()
        elif node in goals:
            return [frame[0] for frame in stack] + [node]
        elif node not in seen:
            seen.add(node)
            stack.append([node, iter(ask(node))])
    return None


def _quoted(text: str) -> str:
    return '"' + str(text).replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(found: DataFrame, symbols: DataFrame, start_query: str, goal_query: str, id_col: str = "id") -> str:
    """The routes as DOT: starts and goals in clusters (a goal that is a start among the goals), nodes by name."""
    rows = found.select("goal", "start", F.posexplode("path").alias("nth", "node"), F.col("path").alias("path")).join(symbols.withColumnRenamed(id_col, "node"), "node")
    nodes: dict[str, tuple] = {}
    place: dict[object, str] = {}
    steps: dict[tuple[str, str], None] = {}
    names: dict[object, str] = {}
    paths = []
    # a few routes of a few nodes, as they are to be printed
    for r in rows.orderBy("goal", "nth").collect():
        names[r.node] = r["name"]
        nodes[r["name"]] = (r.demangled or r["name"], r["path"] if isinstance(r["path"], str) else "", r.address, r.section, r.size)
        place[r["name"]] = "goal" if r.node == r.goal else place.get(r["name"]) or ("start" if r.node == r.start else "")
        if r.nth == 0:
            paths.append([])
        paths[-1].append(r["name"])
    for p in paths:
        steps.update({(a, b): None for a, b in zip(p, p[1:], strict=False)})
    line = lambda n: f"{_quoted(n)} [label={_quoted(nodes[n][0])}, address={_quoted(nodes[n][2])}, section={_quoted(nodes[n][3])}, size={_quoted(nodes[n][4])}];"
    out = ["strict graph {", "\tgraph [overlap=false, rankdir=LR, splines=true];"]
    for kind, query in (("start", start_query), ("goal", goal_query)):
        out += [f"\tsubgraph cluster_{kind}_query {{", f"\t\tgraph [label={_quoted(f'Matching {kind} query "{query}"')}, style=filled];", *(f"\t\t{line(n)}" for n in nodes if place[n] == kind), "\t}"]
    out += [f"\t{line(n)}" for n in nodes if not place[n]]
    out += [f"\t{_quoted(a) if not a.isidentifier() else a} -- {_quoted(b) if not b.isidentifier() else b} [dir=forward];" for a, b in steps]
    return "\n".join([*out, "}"]) + "\n"
