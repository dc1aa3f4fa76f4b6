"""Connected components: every task contracts its own edges, then alternating star contractions.

A task turns up to ``LOCAL`` edges into stars around their smallest nodes; where all edges fit one task, that
is the answer. Else every further step is a grouped minimum and an equi-join, so a hub with millions of
neighbours is pre-aggregated before its rows move and no adjacency list is ever
gathered. Lineage is cut with ``checkpoint()`` once a round.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edges that one task contracts.
LOCAL = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; set one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumenfold-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stars(batches, most: int):
    """Edges (u, v) of one task, ``most`` at a time, as stars (node, smallest node it reaches among them)."""
    import pyarrow as pa

    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def done(kind):
        out = [(x, y) for x in root if (y := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i in (0, 1)], ["u", "v"])

    kind, n = None, 0
    for batch in batches:
        if n and n + batch.num_rows > most:
            yield done(kind)
            n = 0
        kind, n = batch.schema.field(0).type, n + batch.num_rows
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    if n:
        yield done(kind)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component = smallest node id reachable.

    Null ends and self-loops are dropped first. Empty input gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    e = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    tasks = max(1, -(-e.count() // LOCAL))
    e = cut(e.coalesce(tasks).mapInArrow(functools.partial(stars, most=LOCAL), e.schema))
    for _ in range(max_rounds):
        if tasks == 1:
            break
        # a star forest has one parent per node and no parent that is itself a child
        kids = e.groupBy("u").agg(F.count("*").alias("n"))
        many = kids.filter("n > 1").limit(1).count()
        if not many and not e.join(kids.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.filter("x.a <> x.b").select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tree_positions(frames: DataFrame, values: list[str], node: str = "frame", parent: str = "matched_to") -> DataFrame:
    """(node, root, sums...): each value summed from the root down to the node (a root's own value counts),
    by pointer doubling, so depth d takes log2(d) joins. Roots have a null parent, or one that is not a node.

    A cycle raises: in a forest every round finishes some nodes, in a cycle none.
    """
    f = frames.select(F.col(node).alias("node"), F.col(parent).alias("up"), *values)
    known = f.select(F.col("node").alias("up"), F.lit(True).alias("is_node"))
    f = cut(f.join(known, "up", "left").select("node", F.when(F.col("is_node"), F.col("up")).alias("up"), F.col("node").alias("root"), *values))
    left = None
    while True:
        now = f.filter("up is not null").count()
        if not now:
            return f.select("node", "root", *values)
        if now == left:
            raise ValueError("the parent links form a cycle")
        left = now
        above = f.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), *[F.col(v).alias(f"_{v}") for v in values])
        f = f.join(above, "up", "left")
        f = cut(f.select("node", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]))


def forest(frames: DataFrame, node: str = "frame", parent: str = "matched_to") -> DataFrame:
    """(node, root, depth) of a parent forest; cycles raise."""
    steps = frames.select(node, parent).withColumn("depth", F.lit(1).cast("long"))
    return tree_positions(steps, ["depth"], node, parent).select("node", "root", (F.col("depth") - 1).alias("depth"))


def dense_ids(observations: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys..., id): distinct keys numbered in the order they are first seen, in two steps: by range, then by offset.

    A running number over all rows without one task seeing them all.
    """
    first = observations.groupBy(*keys).agg(F.min(order).alias("_at"))
    part = cut(first.repartitionByRange("_at", *keys).sortWithinPartitions("_at", *keys).withColumn("_p", F.spark_partition_id()))
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_at", *keys)) - 1
    return part.withColumn("_i", place).join(starts.select("_p", "_before"), "_p").select(*keys, (F.col("_before") + F.col("_i")).alias("id"))


def spawn_components(frames: DataFrame, node: str = "frame", parent: str = "matched_to") -> DataFrame:
    """(node, root, component): components numbered by the order of their roots."""
    f = forest(frames, node, parent)
    roots = f.filter("depth = 0").select(F.col("node").alias("root"))
    n = dense_ids(roots.withColumn("at", F.col("root")), ["root"], "at").withColumnRenamed("id", "component")
    return f.join(n, "root").select("node", "root", F.col("component").cast("int").alias("component"))


def observation_key(frame: str, kp: str) -> Column:
    """A keypoint of a frame as one string, in the order of both numbers."""
    return F.concat(F.lpad(F.col(frame).cast("string"), 19, "0"), F.lit(":"), F.lpad(F.col(kp).cast("string"), 19, "0"))


def tracks(matches: DataFrame) -> DataFrame:
    """(frame, kp, track, conflict) from matches (src, dst, src_kp, dst_kp): the closure over all matches; a
    track is in conflict if any frame appears in it with two keypoints. The flag does not depend on the
    order of merging."""
    e = matches.select(observation_key("src", "src_kp").alias("src"), observation_key("dst", "dst_kp").alias("dst"))
    c = connected_components(e)
    part = lambda i: F.split_part("node", F.lit(":"), F.lit(i)).cast("long")
    c = c.select(part(1).alias("frame"), part(2).alias("kp"), F.col("component").alias("track"))
    twice = c.groupBy("track", "frame").agg(F.count("*").alias("n")).groupBy("track").agg((F.max("n") > 1).alias("conflict"))
    return c.join(twice, "track").select("frame", "kp", "track", "conflict")


def materialise_tracks(observed: DataFrame) -> DataFrame:
    """(track, n_frames) of usable tracks: seen in two frames or more, and in none of them twice."""
    return observed.filter("not conflict").groupBy("track").agg(F.count("*").alias("n_frames")).filter("n_frames > 1")


def absorb(components: DataFrame, links: DataFrame) -> DataFrame:
    """(component, into): joined components go to the largest of their group, ties to the smallest id.

    ``components``: (component, size); ``links``: (a, b) pairs to join.
    """
    c = connected_components(links, "a", "b").withColumnRenamed("component", "grp")
    j = components.join(c, components["component"] == c["node"], "left").withColumn("grp", F.coalesce("grp", components["component"]))
    head = j.groupBy("grp").agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("into"))
    return j.join(head, "grp").select("component", "into")


def greedy_cover(covers: DataFrame, by: str, n: int = 4) -> DataFrame:
    """(by, turn, item, gain): the item that covers most of what is still uncovered, up to ``n`` times; the
    smallest item wins ties and a gain of 0 ends. ``covers``: (by, item, element), bounded per key."""
    import pandas as pd

    kinds = {k: covers.schema[k].dataType.simpleString() for k in (by, "item")}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sets = {i: set(g["element"]) for i, g in part.groupby("item")}
        out, done = [], set()
        for turn in range(1, n + 1):
            best = min(sets, key=lambda i: (-len(sets[i] - done), i), default=None)
            if best is None or not sets[best] - done:
                break
            out.append((part[by].iloc[0], turn, best, len(sets[best] - done)))
            done |= sets.pop(best)
        return pd.DataFrame(out, columns=[by, "turn", "item", "gain"])

    return covers.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, turn int, item {kinds['item']}, gain int")


def bridge_path(edges: DataFrame, members: DataFrame, by: str, start: str, goal: str) -> DataFrame:
    """(by, path, cost): cheapest path between two nodes of each graph, a step to a non-member costing 1 and
    an edge of the second kind its penalty, then fewest steps, then smallest ids. ``edges``: (by, a, b,
    penalty); ``members``: (by, node). One bounded graph per key."""
    import heapq

    import pandas as pd

    def run(key, e: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        inside, near = set(m["node"]), {}
        for r in e.itertuples():
            near.setdefault(r.a, []).append((r.b, r.penalty))
            near.setdefault(r.b, []).append((r.a, r.penalty))
        s, g = e[start].iloc[0] if len(e) else None, e[goal].iloc[0] if len(e) else None
        heap, done = [(0.0, 0, [s], s)], set()
        while heap:
            cost, steps, path, v = heapq.heappop(heap)
            if v == g:
                return pd.DataFrame([(key[0], ",".join(map(str, path)), cost)], columns=[by, "path", "cost"])
            if v in done:
                continue
            done.add(v)
            for w, penalty in near.get(v, ()):
                if w not in done:
                    heapq.heappush(heap, (cost + penalty + (w not in inside), steps + 1, [*path, w], w))
        return pd.DataFrame([], columns=[by, "path", "cost"])

    kind = edges.schema[by].dataType.simpleString()
    members = members.select(F.col(by).alias("_by"), "node")  # its own name: members may be derived from the edges
    return edges.groupBy(by).cogroup(members.groupBy("_by")).applyInPandas(run, f"{by} {kind}, path string, cost double")
