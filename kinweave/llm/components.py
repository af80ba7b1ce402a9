"""Groups of linked records by degree-one stripping, chain compression and a reduced core (problem 2).

Rounds of joins proportional to a group's diameter are what makes plain label spreading slow on long chains.  Here

1. vertices of degree one are stripped, each remembering its only neighbour,
2. maximal chains of vertices of degree two are removed as a whole: every directed edge (arc) into a chain points to
   the arc that follows it, and pointer doubling (list ranking) finds the end of a chain of length n in log2(n)
   rounds; the chain is replaced by one edge between its two ends,
3. both are repeated until neither removes anything (a tree is used up in a number of rounds that grows with the
   logarithm of its size); what is left, the core, is labelled by spreading minima with pointer shortcuts,
4. labels are restored to the removed vertices in the opposite order.

Every step is a join or aggregation by vertex, cut with a checkpoint; neither edges nor labels reach the driver, only
row counts do.  Sums by vertex are combined before the shuffle, so a vertex with a third of all edges is one group of
partial results; joins against a unique vertex table are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.plans.runtime import cut, discard


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))


def _degrees(edges: DataFrame) -> DataFrame:
    """v, deg, one: a neighbour (the only one where deg = 1), other: the largest neighbour."""
    return _both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("w").alias("one"), F.max("w").alias("other"))


def _strip(edges: DataFrame, deg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without vertices of degree one; (v, parent, low) of the stripped ones.

    An edge between two such vertices is a whole group: the smaller end becomes a root of its own.
    """
    leaf = deg.filter("deg = 1").select("v", F.col("one").alias("parent"))
    leaf_ids = leaf.select("v")
    left = edges.join(leaf_ids, edges.a == leaf_ids.v, "left_anti").join(leaf_ids, F.col("b") == leaf_ids.v, "left_anti")
    twin = leaf.select(F.col("v").alias("tv"), F.col("parent").alias("tp"))
    pairs = leaf.join(twin, (F.col("parent") == F.col("tv")) & (F.col("tp") == F.col("v")), "left")
    gone = pairs.select("v", F.when(F.col("tv").isNotNull() & (F.col("v") < F.col("parent")), F.col("v")).otherwise(F.col("parent")).alias("parent"))
    return left, gone


def _chains(edges: DataFrame, deg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with every chain replaced by one edge; (v, parent) of chain vertices.

    Arc (u, v) with deg(v) = 2 is followed by (v, w), w the other neighbour.  After doubling, an arc knows the end of
    its chain, or it lies on a ring of vertices of degree two only; then the smallest vertex seen is its parent.
    """
    two = deg.filter("deg = 2").select(F.col("v").alias("m"), "one", "other")
    arcs = two.select(F.col("one").alias("u"), F.col("m").alias("v"), F.col("other").alias("w")).unionAll(
        two.select(F.col("other").alias("u"), F.col("m").alias("v"), F.col("one").alias("w"))
    )
    # state of arc (u, v): its chain is known up to arc (p, q); low: smallest chain vertex seen; done: q is no chain vertex
    ids = two.select(F.col("m").alias("id"))
    state = arcs.join(ids, F.col("w") == F.col("id"), "left").select(
        "u", "v", F.col("v").alias("p"), F.col("w").alias("q"), F.col("v").alias("low"), F.col("id").isNull().alias("done")
    )
    state = cut(state)
    open_before = state.filter("not done").count()
    # a ring never ends: an arc has passed 2**r vertices after r rounds, so more rounds than bits cannot be needed
    for _ in range(64):
        if open_before == 0:
            break
        nxt = state.select(F.col("u").alias("p"), F.col("v").alias("q"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        going = state.filter("not done").join(nxt, ["p", "q"], "left")
        going = going.select(
            "u", "v", F.coalesce("p2", "p").alias("p"), F.coalesce("q2", "q").alias("q"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.coalesce("done2", F.lit(True)).alias("done"), (F.col("low2") < F.col("low")).alias("fell")
        )
        old = state
        state = cut(going.unionByName(state.filter("done").withColumn("fell", F.lit(False))))
        discard(old)
        count = state.agg(F.count_if(~F.col("done")).alias("o"), F.count_if("fell").alias("f")).first()
        state = state.drop("fell")
        # rings only: no arc ended and no minimum fell, so every arc has gone round
        if count["o"] == open_before and count["f"] == 0:
            break
        open_before = count["o"]
    # the two arcs into a chain vertex end at the chain's two ends
    ends = state.groupBy("v").agg(
        F.bool_and("done").alias("ended"), F.min("q").alias("e1"), F.max("q").alias("e2"), F.min("low").alias("low")
    )
    ends = cut(ends)
    gone = ends.select("v", F.when(F.col("ended"), F.col("e1")).otherwise(F.col("low")).alias("parent"))
    spans = ends.filter("ended and e1 <> e2").select(F.col("e1").alias("a"), F.col("e2").alias("b"))
    inner = ends.select(F.col("v").alias("iv"))
    kept = edges.join(inner, edges.a == F.col("iv"), "left_anti").join(inner, F.col("b") == F.col("iv"), "left_anti")
    # distinct: chains between the same two ends, and an edge that was there already, are one edge
    return kept.unionByName(spans).distinct(), gone


def _core(edges: DataFrame) -> DataFrame:
    """(v, label): smallest vertex of each group of a graph, by spreading minima with shortcuts."""
    arcs = cut(_both_ways(edges))
    labels = cut(arcs.groupBy("v").agg(F.least(F.min("w"), F.min("v")).alias("label")))
    while True:
        near = arcs.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("seen"))
        low = labels.join(near, "v").select("v", "label", F.least("label", "seen").alias("low"))
        # shortcut: a label is a vertex too; take its label if that is smaller
        up = labels.select(F.col("v").alias("low"), F.col("label").alias("up"))
        stepped = low.join(up, "low", "left").select("v", F.least("low", F.coalesce("up", "low")).alias("label"), F.col("label").alias("before"))
        old, stepped = labels, cut(stepped)
        discard(old)
        changed = stepped.filter("label <> before").limit(1).count()
        labels = stepped.select("v", "label")
        if not changed:
            return labels


def connected_groups(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(vertex, group): for each id of the pairs, the smallest id it reaches directly or indirectly.

    ``left`` and ``right`` are bigint columns.  Pairs with a null on either side link nothing and are left out;
    repeated pairs, both directions and pairs of an id with itself are allowed (the latter gives a group of one).
    Other columns are ignored; no pairs give no rows.
    """
    raw = pairs.select(F.col(left).cast("long").alias("x"), F.col(right).cast("long").alias("y")).filter("x is not null and y is not null")
    edges = cut(raw.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    loops = edges.filter("a = b").select(F.col("a").alias("v"))
    edges = first = edges.filter("a <> b")
    removed: list[DataFrame] = []
    n, before = edges.count(), None
    while n and n != before:
        before = n
        for step in (_strip, _chains):
            deg = cut(_degrees(edges))
            left, gone = step(edges, deg)
            left, gone = cut(left), cut(gone)
            removed.append(gone)
            if edges is not first:
                discard(edges)
            discard(deg)
            edges = left
        n = edges.count()
    labels = _core(edges) if n else edges.select(F.col("a").alias("v"), F.col("b").alias("label"))
    edges_left = labels
    for gone in reversed(removed):
        up = labels.select(F.col("v").alias("parent"), "label")
        # a parent without a label is a vertex that nothing is left of: its own group so far
        back = gone.join(up, "parent", "left").select("v", "parent", F.coalesce("label", "parent").alias("label"))
        alone = back.filter("label = parent").select(F.col("parent").alias("v"), "label")
        old, labels = labels, cut(labels.unionByName(back.select("v", "label")).unionByName(alone).groupBy("v").agg(F.min("label").alias("label")))
        discard(gone)
        if old is not edges_left:
            discard(old)
    # stripped and chain vertices may be smaller than the label their group got
    low = labels.groupBy("label").agg(F.min("v").alias("low"))
    grouped = labels.join(low, "label").select(F.col("v").alias("vertex"), F.col("low").alias("group"))
    return grouped.unionByName(loops.select(F.col("v").alias("vertex"), F.col("v").alias("group"))).groupBy("vertex").agg(F.min("group").alias("group"))
