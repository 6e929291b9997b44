"""Density clusters of tables of any size: a graph of nearest neighbours from random-projection trees, its minimum spanning forest, and the most stable clusters of the hierarchy of its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.components import components
from textloom.sources.scratch import discard, materialize

#: Rows that trees are fitted on at most, rows that one task holds at a time, rows that are compared with one another, and rows of edges or hierarchy that one task works on.
SAMPLE, RUN, LEAF, BATCH = 50_000, 40_000, 400, 500_000


# ---- the graph ---------------------------------------------------------------------------------------------------


def fit_tree(x: np.ndarray, rng: np.random.Generator, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, cuts and children of a tree that halves the sample by random directions down to `leaf` rows; a child below 0 is leaf -1 - child. Leaves are numbered from left to right."""
    directions, cuts, children, leaves = [], [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        a, b = x[rng.choice(rows, 2)]
        d = a - b if (a != b).any() else rng.standard_normal(x.shape[1])
        at = x[rows] @ d
        cut = np.median(at)
        left = at <= cut
        if len(rows) <= leaf or left.all() or not left.any():
            leaves += 1
            return -leaves
        me = len(cuts)
        directions.append(d)
        cuts.append(cut)
        children.append([0, 0])
        children[me] = [grow(rows[left]), grow(rows[~left])]
        return me

    grow(np.arange(len(x)))
    return np.array(directions).reshape(-1, x.shape[1]), np.array(cuts), np.array(children, int).reshape(-1, 2)


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    directions, cuts, children = tree
    at = np.zeros(len(x), int) if len(cuts) else np.full(len(x), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        node = at[inner]
        right = (x[inner] * directions[node]).sum(1) > cuts[node]
        at[inner] = children[node, right.astype(int)]
    return -1 - at


def _halves(rows: np.ndarray, x: np.ndarray, rng: np.random.Generator, leaf: int) -> Iterator[np.ndarray]:
    todo = [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        order = np.argsort(x[rows] @ rng.standard_normal(x.shape[1]), kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def nearest_within(x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of `rows` to each of them, itself left out, and their distances."""
    own = x[rows]
    square = (own * own).sum(1)
    rough = square[:, None] + square[None, :] - 2 * own @ own.T
    np.fill_diagonal(rough, np.inf)
    k = min(k, len(rows) - 1)
    near = np.argpartition(rough, k - 1, axis=1)[:, :k] if k < len(rows) - 1 else np.argsort(rough, axis=1)[:, :k]
    # the same number for a pair wherever it is met
    return rows[near], np.sqrt(((own[:, None, :] - own[near]) ** 2).sum(2))


def neighbours(df: DataFrame, key: str, vector: str, k: int = 15, trees: int = 6, seed: int = 0, sample: int = SAMPLE, run: int = RUN, leaf: int = LEAF) -> DataFrame:
    """(key, near): the k nearest rows of each row by Euclidean distance, as far as `trees` random-projection trees find them: an array of (distance, match), nearest first.

    Trees are fitted on `sample` rows at most, those of the least hashes of their keys. All rows are dealt by (tree,
    leaf, a projection) into runs of about `run` rows, however many a leaf has; a task halves what it holds down to
    `leaf` rows, which are compared with one another. A row takes part once for each tree, and its lists are merged by
    one aggregation. Keys are distinct numbers.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"))
    drawn = rows.orderBy(F.xxhash64(F.col("key") + seed)).limit(sample).collect()  # a bounded sample
    n = len(drawn) if len(drawn) < sample else rows.count()
    if n < 2:
        return rows.select(F.col("key").alias(key), F.array().cast("array<struct<distance:double,match:bigint>>").alias("near"))
    points = np.array([r.x for r in drawn], float)
    rng = np.random.default_rng(seed)
    fitted = [(fit_tree(points, rng, max(32, -(-leaf * len(points) // n))), rng.standard_normal(points.shape[1])) for _ in range(trees)]
    shared = spark.sparkContext.broadcast(fitted)  # as many leaves as the sample has room for

    def dealt(frames):
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, points.shape[1]))
            for t, (tree, side) in enumerate(shared.value):
                yield pd.DataFrame({"tree": np.full(len(f), t, np.int32), "leaf": leaf_of(x, tree).astype(np.int64), "side": x @ side, "key": f["key"], "x": f["x"]})

    def lists(keys: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        order = np.random.default_rng(seed)
        found_key, found = [], []
        for part in _halves(np.arange(len(keys)), x, order, leaf):
            if len(part) > 1:
                near, distance = nearest_within(x, part, k)
                found_key.append(keys[part])
                found += [[{"distance": d, "match": m} for d, m in zip(ds, ms, strict=True)] for ds, ms in zip(distance.tolist(), keys[near].tolist(), strict=True)]
        return pd.DataFrame({"key": np.concatenate(found_key) if found_key else np.zeros(0, np.int64), "near": pd.Series(found, dtype=object)})

    def compared(frames):
        held: list[pd.DataFrame] = []
        for f in frames:
            for _, part in f.groupby(["tree", "leaf"], sort=False):
                same = held and held[-1]["tree"].iloc[0] == part["tree"].iloc[0] and held[-1]["leaf"].iloc[0] == part["leaf"].iloc[0]
                if held and (not same or sum(map(len, held)) >= run):
                    whole = pd.concat(held)
                    yield lists(whole["key"].to_numpy(), np.stack(whole["x"].to_numpy()))
                    held = []
                held.append(part)
        if held:
            whole = pd.concat(held)
            yield lists(whole["key"].to_numpy(), np.stack(whole["x"].to_numpy()))

    spread = rows.mapInPandas(dealt, "tree int, leaf long, side double, key long, x array<double>")
    # runs of several leaves at least, so that few of these are cut
    parts = max(-(-n * trees // run), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * trees // (4 * leaf))))
    runs = spread.repartitionByRange(parts, "tree", "leaf", "side", "key").sortWithinPartitions("tree", "leaf", "side", "key")
    found = runs.mapInPandas(compared, "key long, near array<struct<distance:double,match:bigint>>")
    merged = found.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    return rows.select("key").join(merged, "key", "left").select(F.col("key").alias(key), F.coalesce("near", F.array().cast("array<struct<distance:double,match:bigint>>")).alias("near"))


# ---- the forest --------------------------------------------------------------------------------------------------


def _top(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


EDGE = "a long, b long, w double, u long, v long"


def _light(frame: pd.DataFrame) -> pd.DataFrame:
    """The edges of the minimum spanning forest of some edges between a and b; ties go by (w, u, v)."""
    frame = frame.sort_values(["w", "u", "v"])
    names, at = np.unique(frame[["a", "b"]].to_numpy(), return_inverse=True)
    parent, keep = list(range(len(names))), []
    for row, (i, j) in enumerate(at.reshape(-1, 2).tolist()):
        i, j = _top(parent, i), _top(parent, j)
        if i != j:
            parent[i] = j
            keep.append(row)
    return frame.iloc[keep]


def spanning_forest(edges: DataFrame, batch: int = BATCH) -> DataFrame:
    """(u, v, w) of the minimum spanning forest of edges (u, v, w); ties go by (w, u, v). A table in the shared folder.

    An edge that is the heaviest of a cycle is in no such forest, so each task first drops those of its own batches.
    What is left of at most `batch` edges is finished in one task; beyond, each round of Boruvka takes the lightest edge
    of every tree, joins trees along them and keeps the lightest edge between two trees. Rounds grow with the logarithm
    of the nodes.
    """
    spark = edges.sparkSession
    u, v = F.least("u", "v"), F.greatest("u", "v")
    live = edges.where("u != v").select(u.alias("a"), v.alias("b"), F.col("w").cast("double").alias("w"), u.alias("u"), v.alias("v"))

    def thinned(frames):
        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= 2 * batch:
                yield _light(pd.concat(held))
                held, n = [], 0
        if held:
            yield _light(pd.concat(held))

    done: DataFrame | None = None
    live = materialize(spark, live.mapInPandas(thinned, EDGE))
    while True:
        n = live.count()
        if n <= batch:
            last = live.coalesce(1).mapInPandas(lambda frames: (_light(pd.concat(x)) for x in [list(frames)] if x), EDGE).select("u", "v", "w")
            return materialize(spark, last if done is None else done.unionByName(last), live, *([] if done is None else [done]))
        ends = live.select(F.explode(F.array("a", "b")).alias("node"), F.struct("w", "u", "v", "a", "b").alias("e"))
        chosen = materialize(spark, ends.groupBy("node").agg(F.min("e").alias("e")).select("e.*").distinct())
        taken = chosen.select("u", "v", "w")
        done = materialize(spark, taken) if done is None else materialize(spark, done.unionByName(taken), done)
        roots = components(chosen.select(F.col("a").alias("u"), F.col("b").alias("v")))
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = live.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "w", "u", "v").where("a != b")
        lightest = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("e")).select("a", "b", "e.w", "e.u", "e.v")
        live = materialize(spark, lightest, live, chosen)
        discard(spark, roots)


# ---- the hierarchy -----------------------------------------------------------------------------------------------

NODE = "node long, size long, cluster string, total double, under double, points array<bigint>"
STEP = f"kind string, root long, {NODE}, parent string, born double, stability double, chosen boolean, lam double"


def _density(w: float) -> float:
    return 1 / max(w, 1e-12)


class Merge:
    """Trees of one group, joined edge by edge in order of weight. A tree of fewer than `least` points has no cluster; where it meets one, its points fall to that; where two clusters meet, both end."""

    def __init__(self, nodes: pd.DataFrame, least: int) -> None:
        self.least, self.rows = least, []
        self.index = {n: i for i, n in enumerate(nodes["node"].tolist())}
        self.names, self.parent = nodes["node"].tolist(), list(range(len(nodes)))
        self.size, self.total = nodes["size"].tolist(), nodes["total"].tolist()
        self.cluster = [None if pd.isna(c) else c for c in nodes["cluster"]]
        self.under = [None if pd.isna(x) else x for x in nodes["under"]]
        self.points = [[] if p is None else list(p) for p in nodes["points"]]

    def row(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind} | values)

    def close(self, i: int, born: float, parent: str | None) -> float:
        stability = self.total[i] - born * self.size[i]
        under = self.under[i]
        self.row("cluster", cluster=self.cluster[i], parent=parent, born=born, stability=stability, chosen=under is None or under <= stability, size=self.size[i])
        return stability if under is None else max(stability, under)

    def fall(self, i: int, cluster: str, lam: float) -> None:
        if self.points[i]:
            self.row("point", cluster=cluster, lam=lam, points=self.points[i])
        self.points[i] = []

    def join(self, a: int, b: int, w: float, name: str) -> None:
        i, j = _top(self.parent, self.index[a]), _top(self.parent, self.index[b])
        lam = _density(w)
        if self.size[i] < self.size[j]:
            i, j = j, i
        if self.size[j] >= self.least:
            self.under[i] = self.close(i, lam, name) + self.close(j, lam, name)
            self.cluster[i], self.total[i] = name, (self.size[i] + self.size[j]) * lam
        elif self.size[i] >= self.least:
            self.fall(j, self.cluster[i], lam)
            self.total[i] += self.size[j] * lam
        elif self.size[i] + self.size[j] >= self.least:
            self.fall(i, name, lam)
            self.fall(j, name, lam)
            self.cluster[i], self.total[i] = name, (self.size[i] + self.size[j]) * lam
        else:
            self.points[i] += self.points[j]
        self.parent[j] = i
        self.size[i] += self.size[j]

    def result(self) -> pd.DataFrame:
        for i, name in enumerate(self.names):
            top = _top(self.parent, i)
            self.row("moved", node=name, root=self.names[top])
            if top == i:
                self.row("node", node=name, size=self.size[i], cluster=self.cluster[i], total=self.total[i], under=self.under[i], points=self.points[i])
        columns = {c.split()[0]: c.split()[1] for c in STEP.split(", ")}
        kinds = {"long": "Int64", "double": "Float64", "boolean": "boolean"}
        return pd.DataFrame({c: pd.Series([r.get(c) for r in self.rows], dtype=kinds.get(t, object)) for c, t in columns.items()})


def _starts(points: DataFrame, least: int) -> DataFrame:
    """NODE rows of points (key, weight, core): a point of `least` copies is a cluster from the density at which these meet."""
    lam = 1 / F.greatest("core", F.lit(1e-12))
    full = F.col("weight") >= least
    return points.select(
        F.col("key").alias("node"), F.col("weight").cast("long").alias("size"), F.when(full, F.col("key").cast("string")).alias("cluster"), F.when(full, F.col("weight") * lam).otherwise(0.0).alias("total"), F.lit(None).cast("double").alias("under"),
        F.when(full, F.array().cast("array<bigint>")).otherwise(F.array("key")).alias("points"), F.when(full, lam).alias("lam"),
    )


def hierarchy(points: DataFrame, forest: DataFrame, least: int = 10, batch: int = BATCH) -> DataFrame:
    """(key, cluster, density): the cluster of each point by excess of mass, and the density at which it falls out; points in none have no row.

    points: (key, weight, core), distinct keys with the number of their copies and their core distance; forest: (u, v,
    w), the minimum spanning forest of mutual reachability. Edges are worked on in order of weight, as many at a time as
    fall into groups of at most `batch` trees: each group is one task's, which keeps a row for each tree that is left
    and gives out the points and clusters that are done. Of n points in one task's reach, this is one step. Clusters
    are named by the edge that made them.
    """
    spark = points.sparkSession
    starts = materialize(spark, _starts(points, least))
    fallen = [starts.where("lam is not null").select(F.col("node").alias("key"), "cluster", "lam")]
    clusters: list[DataFrame] = []
    nodes = starts.drop("lam")
    rest = materialize(spark, forest.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    left = rest.count()
    while left:
        if left <= batch:
            part, roots = rest, None
        else:
            part, roots = _level(rest, batch)
        grouped = part.withColumn("root", F.lit(0).cast("long")) if roots is None else part.join(roots.withColumnRenamed("node", "a"), "a")
        touched = part.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        touched = materialize(spark, touched.withColumn("root", F.lit(0).cast("long")) if roots is None else touched.join(roots, "node"))

        def run(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
            tree = Merge(own, least)
            for e in edges.sort_values(["w", "u", "v"]).itertuples():
                tree.join(e.a, e.b, e.w, f"{e.u}:{e.v}")
            return tree.result()

        step = nodes.join(touched, "node").groupBy("root").cogroup(grouped.groupBy("root")).applyInPandas(run, STEP)
        step = materialize(spark, step, by=["kind"])
        clusters.append(step.where("kind = 'cluster'").select("cluster", "parent", "born", "stability", "chosen"))
        fallen.append(step.where("kind = 'point'").select(F.explode("points").alias("key"), "cluster", "lam"))
        kept = nodes.join(touched, "node", "left_anti").unionByName(step.where("kind = 'node'").select(*nodes.columns))
        nodes = materialize(spark, kept)
        moved = step.where("kind = 'moved'").select("node", "root")
        of = lambda c: moved.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        later = rest.join(part.select("u", "v"), ["u", "v"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = materialize(spark, later.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), "w", "u", "v"), rest)
        left = rest.count()
    ends = nodes.where("cluster is not null")
    clusters.append(ends.select("cluster", F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("born"), F.col("total").alias("stability"), (F.col("under").isNull() | (F.col("under") <= F.col("total"))).alias("chosen")))
    whole = ends.select("cluster").limit(2).collect() if nodes.count() == 1 else []  # one tree: its cluster may be the root of all
    return _chosen(_union(fallen), _union(clusters), whole[0].cluster if whole else None)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _level(rest: DataFrame, batch: int) -> tuple[DataFrame, DataFrame | None]:
    """The lightest edges that fall into groups of at most `batch` nodes, and (node, root) of these groups; if there is no such weight, the `batch` lightest edges."""
    spark = rest.sparkSession
    for share in (0.9, 0.5, 0.2):
        cut = rest.agg(F.percentile_approx("w", F.lit(share), 10_000).alias("c")).first().c
        part = rest.where(F.col("w") <= cut)
        roots = components(part.select(F.col("a").alias("u"), F.col("b").alias("v")))
        if roots.groupBy("root").count().where(F.col("count") > batch).isEmpty():
            return part, roots
        discard(spark, roots)
    return materialize(spark, rest.orderBy("w", "u", "v").limit(batch)), None


def _chosen(fallen: DataFrame, clusters: DataFrame, root: str | None) -> DataFrame:
    """Points under their topmost chosen cluster, by pointer doubling over (cluster, parent); of the root of all, only points that stay to its end."""
    spark = clusters.sparkSession
    clusters = materialize(spark, clusters)
    up = materialize(spark, clusters.select("cluster", F.col("parent").alias("next"), F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    while not up.where("next is not null").isEmpty():
        above = up.select(F.col("cluster").alias("next"), F.col("next").alias("_next"), F.col("top").alias("_top"))
        up = materialize(spark, up.join(above, "next", "left").select("cluster", F.col("_next").alias("next"), F.coalesce("_top", "top").alias("top")), up)
    out = fallen.join(up.select("cluster", "top"), "cluster").where("top is not null")
    if root is not None:
        lams = fallen.where(F.col("cluster") == root).select("lam").unionByName(clusters.where(F.col("parent") == root).select(F.col("born").alias("lam")))
        last = lams.agg(F.max("lam").alias("m")).first().m
        out = out.where((F.col("top") != root) | (F.col("lam") >= F.lit(last)))
    return out.select("key", F.col("top").alias("cluster"), F.col("lam").alias("density"))


# ---- all of it ---------------------------------------------------------------------------------------------------


def reachability(near: DataFrame, key: str, weight: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """points (key, weight, core) and edges (u, v, w) of mutual reachability from lists of neighbours and weights (key, weight). The core distance is that to the `least`-th other point, copies counted."""
    spark = near.sparkSession
    flat = near.select(F.col(key).alias("u"), F.posexplode("near").alias("p", "e")).select("u", "p", F.col("e.distance").alias("d"), F.col("e.match").alias("v"))
    flat = flat.join(weight.select(F.col("key").alias("v"), F.col("weight").alias("n")), "v")
    upto = F.sum("n").over(Window.partitionBy("u").orderBy("p"))  # k rows at most
    own = weight.select(F.col("key").alias("u"), F.col("weight").alias("own"))
    flat = materialize(spark, flat.join(own, "u").withColumn("upto", upto + F.col("own") - 1))
    far = flat.groupBy("u").agg(F.coalesce(F.min(F.when(F.col("upto") >= least, F.col("d"))), F.max("d")).alias("far"))
    core = F.when(F.col("weight") > least, 0.0).otherwise(F.coalesce("far", F.lit(0.0)))
    points = materialize(spark, weight.join(far.withColumnRenamed("u", "key"), "key", "left").select("key", "weight", core.alias("core")))
    of = lambda c: points.select(F.col("key").alias(c), F.col("core").alias(f"{c}_core"))
    edges = flat.select("u", "v", "d").join(of("u"), "u").join(of("v"), "v").select("u", "v", F.greatest("d", "u_core", "v_core").alias("w"))
    return points, edges


def clusters(df: DataFrame, key: str, vector: str, least: int = 10, k: int = 15, trees: int = 6, seed: int = 0, batch: int = BATCH, **more) -> DataFrame:
    """(key, cluster, confidence): density clusters of all rows; cluster is the least key of its members, -1 for rows in none, and confidence the row's density by the largest of its cluster.

    Equal vectors are one point with a weight, so copies make neither long lists nor distances of nothing. k >= least
    gives each point its core distance. The graph is approximate (neighbours()); the rest is exact for that graph. Null
    vectors and keys have no row; keys are distinct numbers.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.transform(F.col(vector), lambda v: v.cast("double")).alias("x"))
    name = [F.xxhash64("x").alias("one"), F.xxhash64(F.lit(1), "x").alias("two")]
    rows = materialize(spark, rows.select("key", *name, "x"))
    distinct = materialize(spark, rows.groupBy("one", "two").agg(F.min("key").alias("point"), F.count(F.lit(1)).alias("weight")))
    kept = rows.join(distinct, (rows["key"] == distinct["point"]) & (rows["one"] == distinct["one"]) & (rows["two"] == distinct["two"])).select("key", "x", "weight")
    kept = materialize(spark, kept)
    near = materialize(spark, neighbours(kept, "key", "x", max(k, least), trees, seed, **more))
    points, edges = reachability(near, "key", kept.select("key", "weight"), least)
    forest = spanning_forest(edges, batch)
    found = materialize(spark, hierarchy(points, forest, least, batch))
    named = found.groupBy("cluster").agg(F.min("key").alias("label"), F.max("density").alias("most"))
    labels = found.join(named, "cluster").select(F.col("key").alias("point"), "label", (F.col("density") / F.col("most")).alias("confidence"))
    all_rows = rows.join(distinct, ["one", "two"]).join(labels, "point", "left")
    return all_rows.select(F.col("key").alias(key), F.coalesce("label", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
