"""Events as a graph in space and time: edges, communities, their figures and hulls."""

from __future__ import annotations

import collections
import functools
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyflux.functions.columns import ms_to_days
from canopyflux.operators.components import Store, cut, neighbourhoods
from canopyflux.operators.segments import mark_breaks
from canopyflux.operators.spatial import neighbour_pairs

MAX_DISTANCE = 12.0
MAX_DAYS = 30.0
LEAST_EVENTS = 25
#: Edges of a component that a task moves at once: some 250 MB of dictionaries.
BLOCK_EDGES = 1_000_000
#: Of a larger component, a part has at most this share of them, counted at both ends.
PARTS = 4
#: Rows of a table that may be broadcast, as counted.
FEW = 200_000


def event_vertices(segments: DataFrame) -> DataFrame:
    """(id, x_coord, y_coord, tBreak_days, is_break); ids follow from the key and the start, not from the order of files."""
    marked = mark_breaks(segments)
    return marked.select(F.xxhash64("x_coord", "y_coord", "tStart").alias("id"), "x_coord", "y_coord", ms_to_days("tBreak").alias("tBreak_days"), "is_break")


def event_edges(vertices: DataFrame, distance: float = MAX_DISTANCE, days: float = MAX_DAYS) -> DataFrame:
    """(src, dst): events at most ``distance`` apart of which exactly one is terminal, or which are breaks less than ``days`` apart."""
    pairs = neighbour_pairs(vertices, distance, "id", "x_coord", "y_coord", ("tBreak_days", "is_break"))
    one = F.col("is_break_a") != F.col("is_break_b")
    both = (F.col("is_break_a") == 1) & (F.col("is_break_b") == 1) & (F.abs(F.col("tBreak_days_a") - F.col("tBreak_days_b")) < days)
    return pairs.filter(one | both).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def settle(edges: np.ndarray, weights: np.ndarray, degree: np.ndarray, own: np.ndarray, mass: np.ndarray, total: float, rng: np.random.Generator) -> np.ndarray:
    """``own`` after local moves: each vertex goes to the neighbouring community with the most gain, in seeded orders, until none gains.

    edges: pairs of places of vertices, with weights; degree of each vertex in the whole graph; own: its community, a place
    in ``mass``; mass of each community, its vertices elsewhere included; total: degrees of the whole graph together. The
    neighbours of a vertex that went are looked at again at once, all vertices until a look at all of them moves none.
    """
    n = len(degree)
    between = edges[:, 0] != edges[:, 1]
    ends, others = edges[between].T.ravel(), edges[between][:, ::-1].T.ravel()
    order = np.argsort(ends, kind="stable")
    bounds = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    others, links_of = others[order].tolist(), np.tile(weights[between], 2)[order].tolist()
    own, mass, degree = own.tolist(), mass.tolist(), degree.tolist()
    moved = True
    while moved:
        moved = False
        queue = collections.deque(rng.permutation(n).tolist())
        waits = bytearray(b"\1" * n)
        while queue:
            v = queue.popleft()
            waits[v] = 0
            near = others[bounds[v] : bounds[v + 1]]
            links: dict[int, float] = {}
            for u, w in zip(near, links_of[bounds[v] : bounds[v + 1]], strict=True):
                c = own[u]
                links[c] = links.get(c, 0.0) + w
            old, d = own[v], degree[v]
            share = d / total
            mass[old] -= d
            best, most = old, links.pop(old, 0.0) - share * mass[old] + 1e-12 * (1 + d)
            for c, w in links.items():
                gain = w - share * mass[c]
                if gain > most or (gain == most and best != old and c < best):
                    best, most = c, gain
            mass[best] += d
            if best != old:
                own[v], moved = best, True
                for u in near:
                    if not waits[u] and own[u] != best:
                        waits[u] = 1
                        queue.append(u)
    return np.array(own, np.int64)


def louvain(n: int, edges: np.ndarray, weights: np.ndarray, seed: int = 123) -> np.ndarray:
    """Communities of vertices 0 to n - 1 by modularity: local moves in a seeded order, then the same on the merged graph."""
    labels = np.arange(n)
    rng = np.random.default_rng(seed)
    while True:
        degree = np.bincount(edges.ravel(), np.repeat(weights, 2), n)
        if not degree.any():
            return labels
        names, own = np.unique(settle(edges, weights, degree, np.arange(n), degree, degree.sum(), rng), return_inverse=True)
        labels = own[labels]
        if len(names) == n:
            return labels
        n, edges = len(names), np.sort(own[edges], axis=1)
        pairs, places = np.unique(edges[:, 0] * n + edges[:, 1], return_inverse=True)
        edges, weights = np.column_stack([pairs // n, pairs % n]), np.bincount(places, weights)


def _few(df: DataFrame) -> DataFrame:
    """A table for a join, broadcast only if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def settled(edges: DataFrame, seed: int, level: int, block_edges: int) -> DataFrame:
    """(v, c): the vertices of (root, a, b, w) after local moves until no vertex gains by any; c is the smallest vertex of its community."""
    with Store(edges.sparkSession, "settled") as store:
        graph = edges.join(F.broadcast(edges.groupBy("root").agg((2 * F.sum("w")).alias("total"))), "root")
        return cut(_settled(_with_parts(graph, neighbourhoods(edges, _most(block_edges)).drop("root")), seed, level, block_edges, store))


def _most(block_edges: int) -> int:
    """Ends of edges of a part."""
    return max(1, block_edges // PARTS)


def _with_parts(graph: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges with the parts of both ends, p and q."""
    graph = graph.join(parts.withColumnsRenamed({"v": "a", "part": "p"}).hint("merge"), "a")
    return graph.join(parts.select(F.col("v").alias("b"), F.col("part").alias("q")).hint("merge"), "b")


def _settled(graph: DataFrame, seed: int, level: int, block_edges: int, store: Store) -> DataFrame:
    """(v, c): as :func:`settled` says.

    graph: (root, total, a, b, w, p, q), with the parts of both ends. First each part is a task that moves its vertices among
    its own communities. A vertex all of whose neighbours are in its part gains by nothing after that; the others may.

    Then in each round every vertex that would gain names the community that it would best go to, and communities are dealt
    to blocks (see :func:`_dealt`). A block is a task: it moves its vertices among its own communities, whose masses and
    links it knows whole, so that the gains are exact and blocks don't disturb each other. Some community meets one that it
    names, so that each round raises the modularity and the rounds end. The next round looks at the vertices of communities
    that have changed and at those beside them; what the others would gain is as it was.
    """
    name = lambda what, step: f"{what}-{level}-{step}"
    sides = graph.withColumn("part", F.col("p")).unionByName(graph.filter("p <> q").withColumn("part", F.col("q")))
    sides = sides.select("root", "part", "total", "a", "b", "w", (F.col("p") == F.col("part")).alias("own_a"), (F.col("q") == F.col("part")).alias("own_b"))
    nodes = store.kept(sides.groupBy("root", "part").applyInArrow(_parted([seed, level]), "root long, v long, d double, total double, c long, beside boolean"), name("nodes", 0))
    active = nodes.filter("beside").select("v")
    edges = graph.filter("a <> b").select("root", "a", "b", "w")
    for step in itertools.count():
        at = store.kept(nodes.join(nodes.groupBy("c").agg(F.sum("d").alias("m")).hint("merge"), "c").select("v", "total", "d", "c", "m"), name("at", step))
        flagged = _few(store.kept(active.withColumn("on", F.lit(True)), name("active", step)))
        ends = edges
        for v in ("a", "b"):
            ends = ends.join(flagged.select(F.col("v").alias(v), F.col("on").alias(f"{v}_on")), v, "left")
        ends = ends.filter("a_on OR b_on").join(at.select(F.col("v").alias("a"), F.struct("d", "c", "m").alias("x"), "total").hint("merge"), "a")
        ends = ends.join(at.select(F.col("v").alias("b"), F.struct("d", "c", "m").alias("y")).hint("merge"), "b")
        wanted = store.kept(_wanted(ends), name("wanted", step))
        if wanted.isEmpty():
            break
        blocks = store.kept(_dealt(wanted, [seed, level, step], block_edges, store, name("near", step)), name("blocks", step))
        movers = _few(store.kept(at.join(_few(blocks), "c"), name("movers", step)))
        inner = edges
        for v, e in (("a", "x"), ("b", "y")):
            inner = inner.join(movers.select(F.col("v").alias(v), *(F.col(k).alias(f"{e}_{k}") for k in "dcm"), F.col("block").alias(f"{e}_block"), *(["total"] if v == "a" else [])), v)
        inner = store.kept(inner, name("inner", step))
        dealt = inner.filter("x_block = y_block").withColumnRenamed("x_block", "block").drop("y_block")
        moved = store.kept(dealt.groupBy("root", "block").applyInArrow(_mover([seed, level, step]), "v long, was long, to long"), name("moved", step))
        changed = moved.select(F.col("was").alias("c")).unionByName(moved.select(F.col("to").alias("c"))).distinct()
        gone = _few(moved.select("v", "to"))
        now = nodes.join(gone, "v", "left").select("root", "v", "d", "total", F.coalesce("to", "c").alias("c"))
        nodes = store.kept(now, name("nodes", step + 1))
        store.drop(name("nodes", step))
        inside = store.kept(nodes.join(_few(store.kept(changed, name("changed", step))), "c").select("v"), name("inside", step))
        few = _few(inside)
        beside = [edges.join(few.select(F.col("v").alias(v)), v, "left_semi").select(F.col(u).alias("v")) for v, u in (("a", "b"), ("b", "a"))]
        active = store.kept(inside.unionByName(beside[0]).unionByName(beside[1]).distinct(), name("next", step))
        store.drop(*(name(x, step) for x in ("at", "active", "wanted", "near", "blocks", "movers", "inner", "moved", "changed", "inside")))
    names = nodes.groupBy("c").agg(F.min("v").alias("name"))
    return nodes.join(names.hint("merge"), "c").select("v", F.col("name").alias("c"))


def _dealt(wanted: DataFrame, seed: list[int], whole: int, store: Store, name: str) -> DataFrame:
    """(c, block): the communities of ``wanted``, dealt to blocks.

    Where few would meet, one task deals those of a component. Masses of at most ``whole`` in all are one block. Else, in a
    seeded order, a pair's blocks become one if their masses are at most those of a part (or eight times the largest) together, or if neither has met any other; the latter must fit into a task. Where many would, a
    community points to that one of highest rank, by a hash that changes with the round, among itself, those that it names
    and those that name it; four such steps lead to its block.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("c", "ascending"), ("other", "ascending")])
        pairs = np.column_stack([table.column(x).to_numpy() for x in ("c", "other")])
        ids, places = np.unique(pairs, return_inverse=True)
        places, mass = places.reshape(-1, 2), np.zeros(len(ids))
        mass[places] = np.column_stack([table.column(x).to_numpy() for x in ("m", "other_m")])
        if mass.sum() <= whole:
            return pa.table({"c": ids, "block": np.full(len(ids), ids[0])})
        room = max(_most(whole), 8 * mass.max())
        mass, above, alone = mass.tolist(), list(range(len(ids))), [True] * len(ids)

        def top(v: int) -> int:
            while above[v] != v:
                above[v] = v = above[above[v]]
            return v

        for a, b in np.random.default_rng(seed).permutation(places).tolist():
            a, b = sorted((top(a), top(b)))
            if a != b and (mass[a] + mass[b] <= room or alone[a] and alone[b]):
                above[b], alone[a] = a, False
                mass[a] += mass[b]
        return pa.table({"c": ids, "block": ids[[top(v) for v in range(len(ids))]]})

    if wanted.count() <= FEW:
        return wanted.groupBy("root").applyInArrow(run, "c long, block long")
    near = wanted.select("root", "c", "other")
    near = near.unionByName(near.select("root", F.col("other").alias("c"), F.col("c").alias("other")))
    near = near.unionByName(near.select("root", "c", F.col("c").alias("other")))
    rank = F.struct(F.xxhash64("other", *map(F.lit, seed)), "other")
    blocks = near.groupBy("c").agg(F.max_by("other", rank).alias("block"))
    for k in range(2):
        blocks = store.kept(blocks, f"{name}/{k}")
        blocks = blocks.join(blocks.select(F.col("c").alias("block"), F.col("block").alias("to")).hint("merge"), "block").select("c", F.col("to").alias("block"))
    return blocks


def _wanted(ends: DataFrame) -> DataFrame:
    """(root, c, m, other, other_m): communities of which a vertex that is on would gain by going to another one, its best; with their masses."""
    one, other = (ends.filter(f"{v}_on").select("root", "total", "w", F.col(v).alias("v"), F.col(f"{e}.d").alias("d"), F.col(f"{e}.c").alias("own"), F.col(f"{e}.m").alias("own_m"), F.col(f"{u}.c").alias("c"), F.col(f"{u}.m").alias("m")) for v, e, u in (("a", "x", "y"), ("b", "y", "x")))
    vertex = ["root", "v", "total", "d", "own", "own_m"]
    links = one.unionByName(other).groupBy(*vertex, "c", "m").agg(F.sum("w").alias("links"))
    away = F.when(F.col("c") != F.col("own"), F.struct((F.col("links") - F.col("d") * F.col("m") / F.col("total")).alias("gain"), (-F.col("c")).alias("to"), "m"))
    found = links.groupBy(*vertex).agg(F.max(away).alias("away"), F.coalesce(F.max(F.when(F.col("c") == F.col("own"), F.col("links"))), F.lit(0.0)).alias("links"))
    stay = F.col("links") - F.col("d") * (F.col("own_m") - F.col("d")) / F.col("total")
    return found.filter(F.col("away.gain") > stay + 1e-9 * (1 + F.col("d"))).select("root", F.col("own").alias("c"), F.col("own_m").alias("m"), (-F.col("away.to")).alias("other"), F.col("away.m").alias("other_m")).distinct()


def _parted(seed: list[int]) -> Callable[[pa.Table], pa.Table]:
    """A part's own vertices after moves among its own communities; beside: whether a neighbour is in another part."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda *names: np.column_stack([table.column(x).to_numpy() for x in names])
        weights, owned = table.column("w").to_numpy(), column("own_a", "own_b")
        ids, places = np.unique(column("a", "b"), return_inverse=True)
        places = places.reshape(-1, 2)
        degree = np.bincount(places.ravel(), np.repeat(weights, 2), len(ids))
        own, beside = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        own[places[owned]] = True
        beside[places[~owned.all(axis=1)]] = True
        inner = owned.all(axis=1)
        order = np.argsort(table.column("b").to_numpy()[inner], kind="stable")  # the order of rows must not count
        order = order[np.argsort(table.column("a").to_numpy()[inner][order], kind="stable")]
        total = table.column("total")[0].as_py()
        now = settle(places[inner][order], weights[inner][order], degree, np.arange(len(ids)), degree, total, np.random.default_rng(seed))
        n = int(own.sum())
        head = {x: pa.array(np.full(n, table.column(x)[0].as_py())) for x in ("root", "total")}
        return pa.table({"root": head["root"], "v": ids[own], "d": degree[own], "total": head["total"], "c": ids[now][own], "beside": beside[own]})

    return run


def _mover(seed: list[int]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        column = lambda *names: np.column_stack([table.column(x).to_numpy() for x in names])
        ids, places = np.unique(column("a", "b"), return_inverse=True)
        names, group = np.unique(column("x_c", "y_c"), return_inverse=True)
        places, group = places.reshape(-1, 2), group.reshape(-1, 2)
        degree, own, mass = np.zeros(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(names))
        degree[places], own[places], mass[group] = column("x_d", "y_d"), group, column("x_m", "y_m")
        now = settle(places, table.column("w").to_numpy(), degree, own, mass, table.column("total")[0].as_py(), np.random.default_rng(seed))
        return pa.table({"v": ids[now != own], "was": names[own[now != own]], "to": names[now[now != own]]})

    return run


def communities(edges: DataFrame, seed: int = 123, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """(id, community_id): modularity communities; each is named by its smallest vertex.

    Local moves until no vertex gains, then the same on the graph of communities, until nothing moves. A component of at
    most ``block_edges`` edges, as it is or once it is merged so far, is one task; a larger one moves in parts, then in
    blocks (see :func:`settled`). Both stop only where no vertex gains. Results are the same for the same edges, in any order.
    """
    with Store(edges.sparkSession, "communities") as store:
        return cut(_communities(edges, seed, block_edges, store))


def _communities(edges: DataFrame, seed: int, block_edges: int, store: Store) -> DataFrame:
    pairs = store.kept(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1.0).alias("w")), "pairs")
    small, members = [], None
    for level in itertools.count():
        graph = pairs.groupBy("a", "b").agg(F.sum("w").alias("w")) if not level else pairs
        graph = store.kept(_with_parts(graph, neighbourhoods(pairs, _most(block_edges))), f"graph-{level}")
        store.drop(f"pairs-{level}" if level else "pairs")
        large = graph.groupBy("root").agg(F.count("*").alias("edges"), (2 * F.sum("w")).alias("total")).filter(F.col("edges") > block_edges)
        large = store.kept(large.select("root", "total"), f"large-{level}")
        small.append(graph.join(F.broadcast(large), "root", "left_anti").select("root", "a", "b", "w"))
        if large.isEmpty():
            break
        graph = graph.join(F.broadcast(large), "root")
        placed = store.kept(_settled(graph, seed, level, block_edges, store), f"placed-{level}")
        if placed.filter("v <> c").isEmpty():
            members = placed.withColumnRenamed("v", "id") if members is None else members
            break
        members = placed.withColumnRenamed("v", "id") if members is None else store.kept(_followed(members, placed), f"members-{level}")
        pairs = graph.join(placed.select(F.col("v").alias("a"), F.col("c").alias("x")).hint("merge"), "a").join(placed.select(F.col("v").alias("b"), F.col("c").alias("y")).hint("merge"), "b")
        pairs = store.kept(pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w")), f"pairs-{level + 1}")
        spark = edges.sparkSession
        spark.sparkContext._jvm.System.gc()  # else the files of shuffles stay until the driver happens to collect its garbage

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        ends = np.column_stack([table.column("a").to_numpy(), table.column("b").to_numpy()])
        ids, places = np.unique(ends, return_inverse=True)
        labels = louvain(len(ids), places.reshape(ends.shape), table.column("w").to_numpy(), seed)
        first = np.full(labels.max() + 1, len(ids))
        np.minimum.at(first, labels, np.arange(len(ids)))
        return pa.table({"id": ids, "community_id": ids[first[labels]]})

    found = functools.reduce(DataFrame.unionByName, small).groupBy("root").applyInArrow(run, "id long, community_id long")
    if members is None:
        return found
    found = store.kept(found, "found")
    merged = members.join(found.withColumnRenamed("id", "c"), "c", "left").select("id", F.coalesce("community_id", "c").alias("community_id"))
    return found.join(members, "id", "left_anti").unionByName(merged)


def _followed(members: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, c): where the communities c of ``members`` went; those that ``placed`` doesn't hold stay."""
    went = placed.select(F.col("v").alias("c"), F.col("c").alias("to"))
    return members.join(went, "c", "left").select("id", F.coalesce("to", "c").alias("c"))


def _placed(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """The vertices with their communities; neither table is broadcast, however small its files are."""
    return vertices.join(members.hint("merge"), "id")


def community_stats(vertices: DataFrame, members: DataFrame, least: int = LEAST_EVENTS) -> DataFrame:
    """(community_id, events, tBreak_mean, tBreak_min, tBreak_max) over breaks, of communities with enough events."""
    at = F.when(F.col("is_break") == 1, F.col("tBreak_days"))
    found = _placed(vertices, members).groupBy("community_id").agg(F.count("*").alias("events"), F.avg(at).alias("tBreak_mean"), F.min(at).alias("tBreak_min"), F.max(at).alias("tBreak_max"))
    return found.filter(F.col("events") >= least)


def convex_hull(points: np.ndarray) -> list[int]:
    """Places of the hull's corners, counter-clockwise from the lowest x."""
    order = np.lexsort((points[:, 1], points[:, 0])).tolist()

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for i in places:
            while len(out) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[out[-2]], points[out[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    lower, upper = half(order), half(order[::-1])
    return lower[:-1] + upper[:-1]


def concave_hull(points: np.ndarray, concavity: float = 2.0) -> np.ndarray:
    """Corners of a hull that follows the points: edges are dented to the nearest inner point while they are longer than
    ``concavity`` times its distance from both ends, and no edge is crossed."""
    points = np.unique(points, axis=0)
    if len(points) < 4:
        return points
    ring = convex_hull(points)
    free = set(range(len(points))) - set(ring)

    def crosses(p, q, r, s) -> bool:
        side = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0

    queue = list(zip(ring, ring[1:] + ring[:1], strict=True))
    while queue and free:
        a, b = queue.pop()
        inner = np.fromiter(free, np.int64)
        near = np.minimum(np.hypot(*(points[inner] - points[a]).T), np.hypot(*(points[inner] - points[b]).T))
        c = int(inner[near.argmin()])
        far = max(np.hypot(*(points[c] - points[a])), np.hypot(*(points[c] - points[b])))
        length = np.hypot(*(points[a] - points[b]))
        if length <= concavity * near.min() or far >= length:
            continue
        others = [(u, v) for u, v in zip(ring, ring[1:] + ring[:1], strict=True) if not {u, v} & {a, b}]
        if any(crosses(points[a], points[c], points[u], points[v]) or crosses(points[c], points[b], points[u], points[v]) for u, v in others):
            continue
        ring.insert(ring.index(a) + 1, c)
        free.discard(c)
        queue += [(a, c), (c, b)]
    return points[ring]


def hulls(vertices: DataFrame, members: DataFrame, least: int = LEAST_EVENTS, concavity: float = 2.0) -> DataFrame:
    """(community_id, events, ring): the hull of each community with enough events."""
    rows = _placed(vertices, members).select("community_id", F.col("x_coord").cast("double").alias("x"), F.col("y_coord").cast("double").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < least:
            return pa.table({"community_id": pa.array([], pa.int64()), "events": pa.array([], pa.int64()), "ring": pa.array([], ring)})
        corners = concave_hull(np.column_stack([table.column("x").to_numpy(), table.column("y").to_numpy()]), concavity)
        found = [{"x": float(a), "y": float(b)} for a, b in corners]
        return pa.table({"community_id": pa.array([table.column("community_id")[0].as_py()], pa.int64()), "events": pa.array([table.num_rows], pa.int64()), "ring": pa.array([found], ring)})

    ring = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    return rows.groupBy("community_id").applyInArrow(run, "community_id long, events long, ring array<struct<x:double,y:double>>")
