"""Graph algorithms on edge frames: degree, PageRank, triangles, clustering, components, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.operators.graph import undirected
from pitchlake.session import checkpoint, release


def _links(edges: DataFrame) -> DataFrame:
    """(id, next) of the simple undirected graph, both directions."""
    e = undirected(edges)
    return e.select(F.col("a").alias("id"), F.col("b").alias("next")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("next")))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): different neighbours of each node."""
    return _links(edges).groupBy("id").agg(F.count("*").alias("degree"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(id, score) on the simple undirected graph: ``(1 - d) + d x sum(score / degree)`` over the neighbours, in fixed rounds."""
    links = checkpoint(_links(edges).join(degrees(edges), "id"))
    scores, last = links.select("id").distinct().withColumn("score", F.lit(1.0)), None
    for i in range(1, rounds + 1):
        given = links.join(scores, "id").groupBy(F.col("next").alias("id")).agg(F.sum(F.col("score") / F.col("degree")).alias("got"))
        scores = given.select("id", (F.lit(1 - damping) + damping * F.col("got")).alias("score"))
        if i % every == 0:
            old, scores = last, checkpoint(scores)
            last = scores
            if old is not None:
                release(old)
    return scores


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles) of the nodes in at least one triangle.

    Edges point from the node of lower degree to that of higher, so a node with very many neighbours begins few wedges:
    the wedges number at most the edges to the power 1.5.
    """
    e = undirected(edges)
    d = degrees(edges)
    ranked = e.join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    low_first = F.struct("da", "a") < F.struct("db", "b")
    out = ranked.select(F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("high"))
    out = checkpoint(out)
    wedges = out.withColumnRenamed("high", "x").join(out.withColumnRenamed("high", "y"), "low").filter("x < y")
    closed = wedges.join(e, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b"))).select("low", "x", "y")
    return closed.select(F.explode(F.array("low", "x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, triangles, coefficient): local clustering, ``2 t / (d (d - 1))``, 0 below two neighbours."""
    d = degrees(edges).join(triangles(edges), "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return d.withColumn("coefficient", F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(0.0))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component.

    Every round a node takes the least label among itself and its neighbours and then its label's label, so long chains
    shorten by jumps; rounds end when no label changes.
    """
    links = checkpoint(_links(edges))
    labels, last = links.groupBy("id").agg(F.least(F.first("id"), F.min("next")).alias("component")), None
    while True:
        near = links.join(labels.withColumnRenamed("id", "next"), "next").groupBy("id").agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("low"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("jump"))
        fresh = checkpoint(low.join(jump, "low").select("id", F.least("low", "jump").alias("fresh"), "component"))
        changed = not fresh.filter("fresh <> component").isEmpty()
        labels = fresh.select("id", F.col("fresh").alias("component"))
        if last is not None:
            release(last)
        last = fresh
        if not changed:
            return labels


def louvain(edges: DataFrame, levels: int = 10, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(id, community): communities by greedy modularity (Blondel et al. 2008) on the simple undirected graph.

    A round moves nodes at once to the neighbouring community of the highest gain, ties to the least id; a node may only
    move in the rounds of its hash parity, so two neighbours don't swap for ever. A level ends when the gain falls below
    the tolerance or after ``rounds`` (ten of each parity, as documented); then communities become the nodes of the next, up
    to ``levels``.
    """
    weighted = checkpoint(_links(edges).withColumn("w", F.lit(1.0)))
    assigned = weighted.select("id").distinct().withColumn("community", F.col("id"))
    total = weighted.agg(F.sum("w")).first()[0]
    if not total:
        return assigned
    for _ in range(levels):
        strength = checkpoint(weighted.groupBy("id").agg(F.sum("w").alias("k")))
        own = strength.select("id", F.col("id").alias("c"))
        last = None
        for r in range(rounds):
            sums = own.join(strength, "id").groupBy("c").agg(F.sum("k").alias("tot"))
            to = weighted.filter("id <> next").join(own.select(F.col("id").alias("next"), F.col("c").alias("to")), "next").groupBy("id", "to").agg(F.sum("w").alias("inside"))
            at = own.join(strength, "id")
            options = to.join(at, "id").join(sums.select(F.col("c").alias("to"), "tot"), "to")
            rest = F.col("tot") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
            options = options.withColumn("gain", F.col("inside") - F.col("k") * rest / F.lit(total))
            here = options.filter("to = c").select("id", F.col("gain").alias("now"))
            best = options.groupBy("id").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("b"))
            moved = best.join(here, "id", "left").filter((F.col("b.gain") > F.coalesce("now", F.lit(0.0)) + 1e-9) & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0))
            own = checkpoint(own.join(moved.select("id", (-F.col("b.to")).alias("to")), "id", "left").select("id", F.coalesce("to", "c").alias("c")))
            if r % 2 == 0:  # the gain is looked at after every second round
                continue
            q = modularity(weighted, own, total)
            if last is not None and q - last < tolerance:
                break
            last = q
        assigned = checkpoint(assigned.join(own.select(F.col("id").alias("community"), "c"), "community").select("id", F.col("c").alias("community")))
        joined = weighted.join(own, "id").join(own.select(F.col("id").alias("next"), F.col("c").alias("cn")), "next")
        merged = checkpoint(joined.groupBy(F.col("c").alias("id"), F.col("cn").alias("next")).agg(F.sum("w").alias("w")))
        if merged.select("id").distinct().count() == own.count():
            break
        weighted = merged
    return assigned


def modularity(weighted: DataFrame, own: DataFrame, total: float) -> float:
    """Modularity of communities ``own`` (id, c) on weighted links (id, next, w), both directions."""
    by = weighted.join(own, "id").join(own.select(F.col("id").alias("next"), F.col("c").alias("cn")), "next")
    per = by.groupBy("c").agg(F.sum(F.when(F.col("c") == F.col("cn"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("tot"))
    return per.agg(F.sum(F.col("inside") / total - (F.col("tot") / total) ** 2)).first()[0] or 0.0
