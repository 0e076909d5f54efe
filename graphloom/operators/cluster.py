"""Clustering of modules or functions by attributes, and groups of duplicates."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The options of a run and their defaults.
OPTIONS = {"algorithm": "agglomerative", "entity": "module", "clusters": 4, "linkage": "average", "populations": 4, "generations": 30, "save": False}
MAX_ITEMS = 1_000_000


def distances(features: DataFrame) -> DataFrame:
    """``(a, b, distance)``, a < b: one minus the Jaccard similarity of attribute sets ``(item, attribute)``, for pairs that
    share one; all other pairs are at distance 1."""
    rows = features.select("item", "attribute").distinct()
    size = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    x, y = rows.select(F.col("item").alias("a"), "attribute"), rows.select(F.col("item").alias("b"), "attribute")
    common = x.join(y, "attribute").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    met = common.join(size.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    return met.select("a", "b", (1 - F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("distance"))


def _merged(names: list, pairs: Iterable[tuple], clusters: int, linkage: str) -> dict:
    """Members of each cluster, by its name; ``names`` ascending, ``pairs (a, b, distance)`` with ``a < b``.

    Only pairs that aren't at distance 1 are held, as exact likenesses (one minus the distance, whole numbers over a common
    power of two), and the nearest pair comes off a heap; so time grows with pairs that share something, not with all.
    """
    rows = [(a, b, float(d).as_integer_ratio()) for a, b, d in pairs]
    whole = max((below for _, _, (_, below) in rows), default=1)
    near: dict = {i: {} for i in names}
    groups = {i: [i] for i in names}
    for a, b, (over, below) in rows:
        if over != below:
            near[a][b] = near[b][a] = whole - over * (whole // below)
    mean = linkage not in ("single", "complete")

    def entry(x, y) -> tuple:
        x, y = min(x, y), max(x, y)
        n = len(groups[x]) * len(groups[y]) if mean else 1
        return ((n * whole - near[x][y]) / whole / n, x, y, len(groups[x]), len(groups[y]))  # the exact sum, rounded

    heap = [entry(x, y) for x in names for y in near[x] if x < y]
    heapq.heapify(heap)
    while len(groups) > clusters:
        while heap and not (heap[0][1] in groups and heap[0][2] in groups and heap[0][3:] == (len(groups[heap[0][1]]), len(groups[heap[0][2]])) and heap[0][2] in near[heap[0][1]]):
            heapq.heappop(heap)
        if not heap:  # all are at distance 1, so the first takes the next ones
            first, *others = groups
            for y in others[: len(groups) - clusters]:
                groups[first] += groups.pop(y)
            break
        x, y = heap[0][1:3]
        if heap[0][0] >= 1:  # the first pair in order that shares nothing, if there is one, may come before
            x, y = min([heap[0][:3], *islice(((1.0, p, q) for p in groups for q in islice(groups, 1, None) if p < q and q not in near[p]), 1)])[1:]
        groups[x] += groups.pop(y)
        gone = near.pop(y)
        for z in gone.keys() | near[x].keys():
            one, other = near[x].pop(z, 0), gone.get(z, 0)
            if z in (x, y):
                continue
            near[z].pop(y, None)
            near[z].pop(x, None)
            both = one + other if mean else max(one, other) if linkage == "single" else min(one, other)
            if both:
                near[x][z] = near[z][x] = both
        near[x].pop(x, None)
        for z in near[x]:
            heapq.heappush(heap, entry(x, z))
    return groups


def agglomerate(pairs: DataFrame, items: DataFrame, clusters: int, linkage: str = "average") -> DataFrame:
    """``(item, cluster)``: bottom-up merging of the nearest clusters until ``clusters`` are left; a cluster is named by its
    smallest item, ties go to the smallest names.  Items (at most ``MAX_ITEMS``) are merged in one task."""
    if items.limit(MAX_ITEMS + 1).count() > MAX_ITEMS:
        raise ValueError(f"over {MAX_ITEMS} items; cluster connected components or a coarser entity")
    kind = items.schema["item"].dataType.simpleString()
    rows = pairs.select("a", "b", "distance").union(items.select("item", "item", F.lit(0.0)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.loc[pdf.a == pdf.b, "a"].tolist()))
        some = pdf[pdf.a != pdf.b]
        groups = _merged(names, zip(some.a.tolist(), some.b.tolist(), some.distance.tolist(), strict=True), clusters, linkage)
        return pd.DataFrame([(i, name) for name, members in groups.items() for i in members], columns=["item", "cluster"])

    return rows.groupBy(F.lit(1).alias("all")).applyInPandas(merge, f"item {kind}, cluster {kind}")


def genetic(features: DataFrame, clusters: int, populations: int = 4, size: int = 24, generations: int = 30, seed: int = 0) -> DataFrame:
    """``(item, cluster, fitness)``: the best of several populations evolved apart, one in each task.  Fitness is the share of
    attribute pairs that meet inside a cluster."""
    kind = features.schema["item"].dataType.simpleString()
    rows = features.select("item", "attribute").distinct().crossJoin(F.broadcast(features.sparkSession.range(populations).select(F.col("id").alias("population"))))

    def evolve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rng = np.random.default_rng(seed + int(pdf.population.iloc[0]))
        items = sorted(pdf.item.unique())
        table = pd.crosstab(pdf.item, pdf.attribute).loc[items].to_numpy(float)
        near = table @ table.T
        np.fill_diagonal(near, 0)
        total = max(near.sum(), 1.0)
        fitness = lambda g: near[g[:, None] == g[None, :]].sum() / total - np.bincount(g, minlength=clusters).max() / len(g) * 0.5
        pool = [rng.integers(0, clusters, len(items)) for _ in range(size)]
        for _ in range(generations):
            pool.sort(key=fitness, reverse=True)
            half = pool[: size // 2]
            young = []
            for g in half:
                other = half[rng.integers(len(half))]
                child = np.where(rng.random(len(items)) < 0.5, g, other)
                flip = rng.random(len(items)) < 1.5 / max(len(items), 1)
                young.append(np.where(flip, rng.integers(0, clusters, len(items)), child))
            pool = half + young
        best = max(pool, key=fitness)
        return pd.DataFrame({"item": items, "cluster": best, "fitness": float(fitness(best)), "population": int(pdf.population.iloc[0])})

    found = rows.groupBy("population").applyInPandas(evolve, f"item {kind}, cluster int, fitness double, population int")
    top = found.agg(F.max(F.struct("fitness", (-F.col("population")).alias("p"))).alias("t")).select((-F.col("t.p")).alias("population"))
    return found.join(F.broadcast(top), "population").select("item", "cluster", "fitness")


def duplicates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``(digest, members)`` of groups of rows with equal text, white space aside."""
    plain = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    return texts.where(F.col(text).isNotNull()).groupBy(F.md5(plain).alias("digest")).agg(F.array_sort(F.collect_list(key)).alias("members")).where(F.size("members") > 1)
