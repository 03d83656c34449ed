"""Connected components of an edge table, by merging neighbours."""

from __future__ import annotations

import collections
import math
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task merges, as counted.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where all run on this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="canopyflux-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Store:
    """Tables that are written to the shared folder and read back, until they are dropped; all go when the store is closed."""

    def __init__(self, spark: SparkSession, kind: str) -> None:
        self.spark, path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.folder = path(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, name), True)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.files.delete(self.folder, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached from each node that has an edge to another one."""
    return _merged(edges, 0).filter("v <> root").select(F.col("v").alias("node"), "root")


def neighbourhoods(edges: DataFrame, most: int) -> DataFrame:
    """(v, root, part): of each node that has an edge to another one, its component and the largest part of it to which the
    node belongs, of those that are made on the way, that has at most ``most`` ends of edges. A node by itself is a part, too,
    whatever it has."""
    return _merged(edges, most)


def _merged(edges: DataFrame, most: int) -> DataFrame:
    """(v, root, part): as :func:`neighbourhoods` says.

    edges: (a, b). In each round every node points to that one of lowest rank among itself and its neighbours, by a hash that
    changes with the round, and goes on to where that one points. Nodes that go to the same one are merged, and the edges
    between merged nodes are all that the next round sees; where they are few, one task does the rest. No node goes to the one of highest rank, so that the rounds end;
    how much a round leaves doesn't depend on how nodes are named. Back from the last round, each takes the root of the one
    it went to. Each round is written to the shared folder, so that neither plans nor recomputation grow. Neither side of a
    join is broadcast: packed files can be a small part of the rows.
    """
    with Store(edges.sparkSession, "components") as store:
        kept = store.kept
        edges, least, levels = kept(edges.select("a", "b").filter("a <> b"), "edges-0"), None, []
        while (left := edges.count()) and (left > FEW or not levels):
            level = len(levels)
            rank = lambda c: F.xxhash64(F.lit(level), c)  # noqa: B023, E731
            sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = sides.groupBy(F.col("a").alias("v")).agg(F.min_by("b", rank("b")).alias("m"), F.count("*").alias("ends"))
            best = best.select("v", F.when(rank("v") < rank("m"), F.col("v")).otherwise(F.col("m")).alias("m"), "ends")
            best = best.join(best.select(F.col("v").alias("m"), F.col("m").alias("to")).hint("merge"), "m").select("v", F.col("to").alias("m"), "ends")
            names = best.withColumn("least", F.col("v")) if least is None else least.join(best.drop("ends").hint("merge"), "v", "left").select("v", "m", "ends", "least")
            levels.append(names := kept(names, f"names-{level}"))
            least = names.filter("m IS NOT NULL").groupBy(F.col("m").alias("v")).agg(F.min("least").alias("least"), F.sum("ends").alias("ends"))
            to = names.filter("m IS NOT NULL").select("v", "m")
            for end in ("a", "b"):
                edges = edges.join(to.select(F.col("v").alias(end), F.col("m").alias(f"{end}_m")).hint("merge"), end)
            merged = edges.filter("a_m <> b_m").select(F.least("a_m", "b_m").alias("a"), F.greatest("a_m", "b_m").alias("b")).distinct()
            edges = kept(merged, f"edges-{level + 1}")
            store.drop(f"edges-{level}")
        if not levels:
            return cut(edges.select(F.col("a").alias("v"), F.col("b").alias("root"), F.lit(0).cast("long").alias("part")))
        part = lambda level: F.when(F.col("ends") <= most, F.xxhash64(F.lit(level), "v"))
        found = least.select("v", "least", "ends", F.lit(None).cast(least.schema["v"].dataType).alias("root"), F.lit(None).cast("long").alias("own"))
        if left:
            for end in ("a", "b"):
                edges = edges.join(least.select(F.col("v").alias(end), F.col("least").alias(f"{end}_least"), F.col("ends").alias(f"{end}_ends")).hint("merge"), end)
            kind = least.schema["v"].dataType.simpleString()
            last = edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_last(most), f"v {kind}, root {kind}, centre {kind}")
            last = last.select("v", "root", F.when(F.col("centre").isNotNull(), F.xxhash64(F.lit(-1), "centre")).alias("own"))
            found = least.join(last.hint("merge"), "v", "left")
        roots = found.select("v", F.coalesce("root", "least").alias("root"), F.coalesce("own", part(len(levels))).alias("part"))
        for level in reversed(range(len(levels))):
            above = roots.select(F.col("v").alias("m"), "root", "part").hint("merge")
            own = part(level) if level else F.xxhash64(F.lit(level), "v")
            roots = levels[level].join(above, "m", "left").select("v", F.coalesce("root", "least").alias("root"), F.coalesce("part", own).alias("part"))
        return cut(roots)


def _last(most: int) -> Callable[[pa.Table], pa.Table]:
    """(v, root, centre): components of few edges in one task; centre: the node from which a part of at most ``most`` ends is grown, by breadth."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("a", "ascending"), ("b", "ascending")])
        near, least, ends = collections.defaultdict(list), {}, {}
        for e, u in (("a", "b"), ("b", "a")):
            own = table.column(e).to_pylist()
            least |= zip(own, table.column(f"{e}_least").to_pylist(), strict=True)
            ends |= zip(own, table.column(f"{e}_ends").to_pylist(), strict=True)
            for v, w in zip(own, table.column(u).to_pylist(), strict=True):
                near[v].append(w)

        def grown(v, into: dict, most: float) -> list:
            into[v], out, room = v, [v], most - ends[v]
            for x in out:
                for u in near[x]:
                    if u not in into and ends[u] <= room:
                        into[u] = v
                        out.append(u)
                        room -= ends[u]
            return out

        root, centre = {}, {}
        for v in near:
            if v not in root:
                whole = grown(v, {}, math.inf)
                root |= dict.fromkeys(whole, min(least[u] for u in whole))
            if v not in centre and ends[v] <= most:
                grown(v, centre, most)
        kind = table.schema.field("a").type
        return pa.table({"v": pa.array(near, kind), "root": pa.array([root[v] for v in near], kind), "centre": pa.array([centre.get(v) for v in near], kind)})

    return run
