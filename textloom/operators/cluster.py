"""Clusters: density clusters, k-means topics, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import lexical
from textloom.operators.components import components
from textloom.sources.scratch import materialize


#: Rows of a block; two blocks are compared in one task.
BLOCK = 2048

#: Terms of the lists that one call clusters, list by list.
ROWS = 20_000


def density_clusters(df: DataFrame, key: str, pos: str, vector: str, similarity: float = 0.8, least: int = 2, block: int = BLOCK) -> DataFrame:
    """(key, pos, label): within each key, vectors linked by cosines of at least `similarity`, directly or through others, form a cluster if there are `least` of them; others get -1.

    Labels are numbered by their first member; pos names a row of its key. Each key's rows are dealt into blocks of
    about `block` rows by a hash, all pairs of blocks are compared, and each pair gives a spanning forest of its links.
    """

    def links(pdf):
        import numpy as np
        import pandas as pd

        x = np.array([list(v) for v in pdf[vector]], float)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        rest, edges = np.arange(len(x)), []
        while len(rest):
            frontier, rest = rest[:1], rest[1:]
            while len(frontier) and len(rest):
                found = []
                for some in np.array_split(frontier, -(-len(frontier) // 512)):
                    near = x[some] @ x[rest].T >= similarity
                    hit = near.any(0)
                    edges.append((some[near.argmax(0)[hit]], rest[hit]))
                    found.append(rest[hit])
                    rest = rest[~hit]
                frontier = np.concatenate(found)
        u, v = (np.concatenate(e) for e in zip(*edges, strict=True)) if edges else (np.zeros(0, int),) * 2
        at = pdf[pos].to_numpy()
        return pd.DataFrame({"_key": pdf[key].iloc[0], "_u": at[u], "_v": at[v]})

    rows = df.select(key, pos, vector)
    blocks = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks")).withColumnRenamed(key, "_key")
    dealt = rows.join(blocks, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_b", F.pmod(F.xxhash64(pos), F.col("_blocks")))
    others = F.col("_blocks") - 1
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), others)))
    # a block meets itself in its pairs with others
    dealt = dealt.where((F.col("_b") != F.col("_o")) | (others == 0)).select(key, pos, vector, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))
    found = dealt.groupBy(key, "_i", "_j").applyInPandas(links, "_key long, _u long, _v long")
    node = lambda c: F.struct(F.col("_key").alias("key"), F.col(c).alias("pos"))
    roots = components(found.select(node("_u").alias("u"), node("_v").alias("v")))
    named = rows.select(key, pos, F.struct(F.col(key).cast("long").alias("key"), F.col(pos).cast("long").alias("pos")).alias("node")).join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    clusters = named.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    clusters = clusters.select("root", (F.row_number().over(Window.partitionBy("root.key").orderBy("root.pos")) - 1).alias("_label"))
    return named.join(clusters, "root", "left").select(F.col(key).cast("long").alias(key), F.col(pos).cast("long").alias(pos), F.coalesce("_label", F.lit(-1)).alias("label"))


def hierarchy_labels(distance, least: int = 2):
    """Labels (-1: none) of the clusters that HDBSCAN picks by excess of mass from a matrix of distances, one cluster of all points allowed: mutual reachability, its minimum spanning tree, the condensed tree, the most stable clusters."""
    import numpy as np

    n = len(distance)
    if n < 2:
        return np.full(n, -1)
    near = min(n - 1, least)
    core = np.partition(distance, near, axis=0)[near]
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), distance)
    inside, best, frm, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], frm[closer] = reach[at][closer], at
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], frm[nxt], nxt))
        at = nxt
    # the single-linkage tree: nodes n, n + 1, ... join two others at a distance
    top, joined, size = list(range(n)), {}, [1] * n
    find = lambda x: x if top[x] == x else find(top[x])
    for d, a, b in sorted(edges):
        a, b = find(a), find(b)
        top[a] = top[b] = len(top)
        joined[len(top)] = (a, b, d)
        size.append(size[a] + size[b])
        top.append(len(top))
    # condensed: rows (parent cluster, child point or cluster, lambda, size); clusters are numbered from n in order of birth
    points = lambda x: [x] if x < n else points(joined[x][0]) + points(joined[x][1])
    rows, born, todo, clusters = [], {n: 0.0}, [(len(top) - 1, n)], n + 1
    while todo:
        node, own = todo.pop(0)
        a, b, d = joined[node]
        density = 1 / max(d, 1e-12)
        large = [x for x in (a, b) if size[x] >= least]
        for x in (a, b):
            if len(large) == 2:
                rows.append((own, clusters, density, size[x]))
                born[clusters] = density
                todo.append((x, clusters)) if x >= n else rows.append((clusters, x, density, 1))
                clusters += 1
            elif x in large:
                todo.append((x, own)) if x >= n else rows.append((own, x, density, 1))
            else:
                rows += [(own, p, density, 1) for p in points(x)]
    stable = {c: sum((lam - born[c]) * k for parent, _, lam, k in rows if parent == c) for c in born}
    chosen, below = set(born), {c: [x for parent, x, _, _ in rows if parent == c and x >= n] for c in born}
    for c in sorted(born, reverse=True):
        under = sum(stable[x] for x in below[c])
        if below[c] and under > stable[c]:
            chosen.discard(c)
            stable[c] = under
        else:
            drop = list(below[c])
            while drop:
                x = drop.pop()
                chosen.discard(x)
                drop += below[x]
    parent = {x: (c, lam) for c, x, lam, _ in rows}
    last = max(lam for c, _, lam, _ in rows if c == n)
    labels = np.full(n, -1)
    number = {c: i for i, c in enumerate(sorted(chosen))}
    for p in range(n):
        c = parent[p][0]
        while c not in chosen and c in parent:
            c = parent[c][0]
        if c in chosen and (c != n or parent[p][1] >= last):
            labels[p] = number[c]
    return labels


def term_clusters(terms: DataFrame, key: str, term: str, vector: str, least: int = 2) -> DataFrame:
    """(key, term, label): density clusters (HDBSCAN on 1 - cosine) of each document's terms; -1 for terms in none, and for a single term.

    For short lists of terms, of which extractors give a stated number a document: each list is one group.
    """

    def labels(x):
        import numpy as np

        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        distance = np.clip(1 - x @ x.T, 0, 2)
        np.fill_diagonal(distance, 0)
        return hierarchy_labels(distance, least)

    def run(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, [(key, "ascending"), (term, "ascending")])).combine_chunks()
        names, x = table[key].to_pylist(), np.array(table[vector].to_pylist(), float)
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        found = np.concatenate([labels(x[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)])
        return pa.table({key: table[key].cast(pa.int64()), term: table[term].cast(pa.string()), "label": pa.array(found, pa.int32())})

    # lists are short, so many make one group: a group for each list would cost more than its clusters
    own = materialize(terms.sparkSession, terms.select(key, term, vector))
    groups = max(1, -(-own.count() // ROWS))
    return own.groupBy(F.pmod(F.xxhash64(key), F.lit(groups))).applyInArrow(run, f"{key} long, {term} string, label int")


def kmeans_topics(df: DataFrame, key: str, vector: str, k: int = 5, seed: int = 42):
    """(key, topic, confidence, distance) by k-means, confidence falling with the distance to the centre; and the centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    prepared = df.select(key, F.transform(F.col(vector), lambda x: x.cast("double")).alias("_a")).withColumn("features", array_to_vector("_a"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(prepared)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(prepared).withColumn("_c", F.get(centres, F.col("prediction")))
    distance = F.sqrt(F.aggregate(F.zip_with("_a", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return out.select(key, F.col("prediction").alias("topic"), F.greatest(F.lit(0.0), 1 - distance / 2).alias("confidence"), distance.alias("distance")), model.clusterCenters()


def text_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 256, stopwords: list[str] | None = None) -> DataFrame:
    """(key, vector): hashed words weighted by TF-IDF, at length 1; texts without words have no row."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stop = stopwords or []
    words = docs.select(key, F.filter(T.words(text), lambda w: ~w.isin(stop)).alias("_w")).where(F.size("_w") > 0)
    counted = HashingTF(numFeatures=size, inputCol="_w", outputCol="_x").transform(words).select(key, vector_to_array("_x").cast("array<int>").alias("_n"))
    counted = materialize(docs.sparkSession, counted).select(key, array_to_vector(F.col("_n").cast("array<double>")).alias("_tf"))  # texts are cut into words once, and read twice
    weighted = IDF(inputCol="_tf", outputCol="_x").fit(counted).transform(counted)
    return Normalizer(inputCol="_x", outputCol="_u").transform(weighted).select(key, vector_to_array("_u").alias("vector"))


def topic_model(df: DataFrame, key: str, vector: str, k: int = 5, dims: int = 8, spread: float = 2.0, seed: int = 42) -> DataFrame:
    """(key, topic, confidence): vectors reduced to `dims` principal components, k-means on them, and -1 for outliers, which lie more than `spread` standard deviations farther from their centre than their topic's mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))).alias("_v"))
    reduced = PCA(k=dims, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select(key, vector_to_array("_p").alias("_a"))
    assigned, centres = kmeans_topics(reduced, key, "_a", k, seed)
    x = assigned.withColumn("_d", F.col("distance"))
    stats = x.groupBy("topic").agg(F.avg("_d").alias("_mean"), F.stddev_pop("_d").alias("_std"))  # one row a topic
    far = F.col("_d") > F.col("_mean") + spread * F.col("_std")
    return x.join(F.broadcast(stats), "topic").select(key, F.when(far, -1).otherwise(F.col("topic")).alias("topic"), F.when(far, 0.0).otherwise(F.col("confidence")).alias("confidence"))


def discover(docs: DataFrame, assigned: DataFrame, key: str = "doc_id", stopwords: list[str] | None = None, min_df: int = 2, most: int = 3, k: int = 10) -> DataFrame:
    """(topic, size, representatives, name, terms) of assigned documents: the first members, the k terms of 1 to `most` words that a topic has above others (in `min_df` documents at least), and a name of the first three; -1 is Outlier, without terms."""
    # a document's key takes its topic along: rows of one key and topic are one document
    named = docs.join(assigned.select(key, "topic"), key, "left").select(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col("topic"), F.lit(-1)).cast("string")).alias("_name"), F.coalesce("topic", F.lit(-1)).cast("int").alias("topic"), "text")
    best = lexical.heaviest_terms(named, "_name", "topic", stopwords=stopwords, most=most, min_df=min_df, k=k, texts=docs)
    lists = best.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return topic_summary(assigned, "topic", key, best).join(lists, "topic", "left")


def topic_terms(assigned: DataFrame, occurrences: DataFrame, key: str = "doc_id", topic: str = "topic", k: int = 5) -> DataFrame:
    """(topic, term, weight, rank): class-based TF-IDF, tf in the topic times ln(1 + mean tokens a topic / tf overall)."""
    return heaviest(occurrences.join(assigned.select(key, topic), key).groupBy(topic, "term").agg(F.count(F.lit(1)).alias("tf")), topic, k)


def heaviest(tf: DataFrame, topic: str, k: int) -> DataFrame:
    """topic_terms() of (topic, term, tf)."""
    total = tf.groupBy("term").agg(F.sum("tf").alias("_all"))
    mean = tf.groupBy(topic).agg(F.sum("tf").alias("_t")).agg(F.avg("_t").alias("_mean"))  # one row
    weighted = tf.join(total, "term").join(F.broadcast(mean)).withColumn("weight", F.col("tf") * F.log(1 + F.col("_mean") / F.col("_all")))
    n = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("weight"), "term"))
    return weighted.withColumn("rank", n).where(F.col("rank") <= k).select(topic, "term", "weight", "rank")


def topic_summary(assigned: DataFrame, topic: str, pos: str, words: DataFrame | None = None) -> DataFrame:
    """(topic, size, representatives, name): the first three members, and the first three terms joined by _; -1 is Outlier."""
    # only rows that are among the first three of their task are shuffled and sorted
    first = assigned.withColumn("_n", F.row_number().over(Window.partitionBy(topic).orderBy(pos))).where("_n <= 3").groupBy(topic).agg(F.sort_array(F.collect_list(pos)).alias("representatives"))
    out = assigned.groupBy(topic).agg(F.count(F.lit(1)).alias("size")).join(first.withColumnRenamed(topic, "_topic"), F.col(topic).eqNullSafe(F.col("_topic"))).drop("_topic")
    if words is None:
        return out
    named = words.where("rank <= 3").groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), "_").alias("_name"))
    return out.join(named, topic, "left").withColumn("name", F.when(F.col(topic) == -1, "Outlier").otherwise(F.col("_name"))).drop("_name")
