"""Graph analytics over an edge table (src, dst): degrees, neighbours, label propagation, modularity, Leiden, layout."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import repulsion


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage is cut once a round, in the folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder.  A temporary one is made only where none is named and all executors are threads of this machine."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mossgraph-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and no later plan knows of those before it."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def co_occurrence(items: DataFrame, group: str, item: str, largest: int = 1_000) -> DataFrame:
    """Undirected weighted edges between items of the same group."""
    return group_pairs(items, group, item, largest).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def group_pairs(items: DataFrame, group: str, item: str, largest: int = 1_000) -> DataFrame:
    """src, dst: each two items of a group, the smaller first, once for each group that has both.

    ``largest`` guards against a group whose pairs would explode: such a group raises, since it is no edge list any more."""
    sets = items.select(group, item).distinct().groupBy(group).agg(F.sort_array(F.collect_list(item)).alias("m"))
    checked = sets.withColumn("m", F.when(F.size("m") > largest, F.raise_error(F.lit("a group is too large for its pairs"))).otherwise(F.col("m")))
    return checked.select(F.explode("m").alias("src"), "m").select("src", F.explode(F.filter("m", lambda x: x > F.col("src"))).alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = undirected(edges).distinct().select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    return edges.select("src", "dst", *extra).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *extra))


def neighbour_lists(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, links_to, linked_from: each node's neighbours in both directions, in order and without repeats; nodes without
    links have empty lists.  A hub's list is one cell of the result."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(None).cast("long").alias("frm")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(None).cast("long").alias("to"), F.col("src").alias("frm")))
    held = ends.groupBy("id").agg(F.sort_array(F.collect_set("to")).alias("links_to"), F.sort_array(F.collect_set("frm")).alias("linked_from"))
    none = F.array().cast("array<long>")
    return nodes.select("id").distinct().join(held, "id", "left").select("id", F.coalesce("links_to", none).alias("links_to"), F.coalesce("linked_from", none).alias("linked_from"))


#: Ends of edges that a block of neighbour lists holds, least blocks of a large graph, and chunks of the nodes that meet a block.
BLOCK_ENDS, BLOCKS, CHUNKS = 32_000_000, 8, 3


def shared_neighbours(edges: DataFrame, query: DataFrame, few: bool = False) -> DataFrame:
    """a, b, shared for query pairs (a, b): b's neighbours, duplicates kept, that are neighbours of a.

    Neighbour lists are dealt into blocks by ranges of ids with as many ends each.  A node's list goes once to each block that
    holds any b asked with it, however many those are, so what is shuffled is at most lists times blocks, and less where
    neighbours have near ids; a task holds the lists of one block and the others pass by.  ``few``: the query names few nodes,
    and only their lists are made."""
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    turned = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ends = known.select(F.inline(turned))
    if few:
        ends = ends.join(F.broadcast(query.select(F.explode(F.array("a", "b")).alias("src")).distinct()), "src", "left_semi")
    n, *bounds = ends.agg(F.count(F.lit(1)), F.min("src"), F.max("src"), F.min("dst"), F.max("dst")).first()
    if not n:
        return query.select("a", "b", F.lit(0).cast("long").alias("shared"))
    least, most = min(bounds), max(bounds)
    blocks = max(1, min(BLOCKS, n // 500_000), -(-n // BLOCK_ENDS))
    chunks = min(CHUNKS, blocks)
    cuts = ends.agg(F.percentile_approx("src", [k / blocks for k in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    block = lambda c: F.aggregate(F.array(*[F.lit(x).cast("long") for x in cuts]), F.lit(0), lambda s, x: s + (x <= c).cast("int")) if cuts else F.lit(0)
    # Lists of four bytes an end where the ids lie close enough.
    short = most - least < 1 << 31
    small = lambda c: (F.col(c) - F.lit(least)).cast("int") if short else F.col(c)
    known = F.coalesce(F.col("a").between(least, most) & F.col("b").between(least, most), F.lit(False))
    lists = ends.select("src", small("dst").alias("dst")).groupBy("src").agg(F.collect_list("dst").alias("near"))
    asked = query.where(known).select("a", block(F.col("b")).alias("block"), small("b").alias("b")).repartition("a").groupBy("a", "block").agg(F.collect_list("b").alias("asked"))
    own = lists.select(F.explode(F.sequence(block(F.col("src")) * chunks, block(F.col("src")) * chunks + F.lit(chunks - 1))).alias("task"), F.lit(0).alias("kind"), small("src").alias("id"), F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"), "near")
    come = asked.join(lists.withColumnRenamed("src", "a"), "a", "left").select((F.col("block") * chunks + F.pmod(F.xxhash64("a"), F.lit(chunks))).cast("int").alias("task"), F.lit(1).alias("kind"), small("a").alias("id"), "asked", "near")
    dealt = own.unionByName(come).repartitionById(blocks * chunks, F.col("task")).sortWithinPartitions("task", "kind")
    base = least if short else 0

    def met(batches):
        held, table = None, None
        mark = np.zeros(1 << 16, dtype=bool)
        for task, kind, rows in _runs(batches):
            ids, (sizes, near) = rows.column("id").to_numpy(), _flat(rows.column("near"))
            if held is None or held[0] != task:
                held, table = (task, [], [], []), None
            if not kind:
                for part, x in zip(held[1:], (ids, sizes, near)):
                    part.append(x)
                continue
            if table is None:
                table = _block_of(*held[1:])
                held = (task, [], [], [])
            made = _met(ids, sizes, near, *_flat(rows.column("asked")), *table, mark)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64) + add) for x, add in zip(made, (base, base, 0))], names=["a", "b", "shared"])

    counted = dealt.mapInArrow(met, "a long, b long, shared long")
    return counted.unionByName(query.where(~known).select("a", "b", F.lit(0).cast("long").alias("shared")))


def _runs(batches):
    """task, kind and the rows of each run of them, in the order that they come in."""
    for batch in batches:
        task, kind = batch.column("task").to_numpy(), batch.column("kind").to_numpy()
        starts = np.flatnonzero(np.r_[True, (task[1:] != task[:-1]) | (kind[1:] != kind[:-1])]) if len(task) else []
        for lo, hi in zip(starts, [*starts[1:], len(task)]):
            yield int(task[lo]), int(kind[lo]), batch.slice(lo, hi - lo)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of lists (of a null one: 0) and their values in a row."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _block_of(ids: list, sizes: list, near: list) -> tuple[np.ndarray, ...]:
    """A block's nodes in order, where the list of each begins, its size, all lists, and the low bits of their ids."""
    if not ids:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint16))
    ids, sizes, near = (np.concatenate(x) for x in (ids, sizes, near))
    order = np.argsort(ids)
    begin = np.cumsum(sizes) - sizes
    return ids[order], begin[order], sizes[order], near, (near & 0xFFFF).astype(np.uint16)


def _met(a, sizes, near, counts, asked, ids, begin, length, lists, low, mark) -> tuple[np.ndarray, ...]:
    """a, b, shared of every b asked with each a.  Ends whose low bits a's neighbours have are looked up; so no other is lost."""
    shared = np.zeros(len(asked), dtype=np.int64)
    if len(ids) and len(asked):
        place = np.searchsorted(ids, asked)
        place[place == len(ids)] = 0
        size, start = np.where(ids[place] == asked, length[place], 0), begin[place]
        n0 = p0 = 0
        for n1, p1 in zip(np.cumsum(sizes), np.cumsum(counts)):
            own, s, b = np.sort(near[n0:n1]), size[p0:p1], start[p0:p1]
            if len(own) and s.any():
                stop = np.cumsum(s)
                at = np.arange(stop[-1]) + np.repeat(b - stop + s, s)
                bits = own & 0xFFFF
                mark[bits] = True
                hit = np.flatnonzero(mark[low[at]])
                mark[bits] = False
                found = lists[at[hit]]
                hit = hit[own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found]
                shared[p0:p1] = np.bincount(np.searchsorted(stop, hit, side="right"), minlength=p1 - p0)
            n0, p0 = n1, p1
    return np.repeat(a, counts), asked, shared


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int, until_stable: bool = False, ends: int | None = None) -> DataFrame:
    """id, label.  Synchronous: every node takes its neighbours' most frequent label, of equals the smallest.

    A neighbour that isn't among the nodes has no label, and doesn't count."""
    from . import pull

    ids = written(nodes.select("id").distinct())
    made = pull.dealt(ids, both_ways(written(undirected(edges))), ends=ends)

    def vote(sizes, place, _, own, held):
        rows, label, n = pull.grouped(sizes, place, None, held["label"])
        has, key, _ = pull.best_of(rows, label, n, len(sizes))
        return [pa.array(held["label"][own]), pa.array(np.where(has, key, held["label"][own]))]

    labels = ids.select("id", F.col("id").alias("label"))
    for _ in range(rounds):
        following = written(pull.pulled(made, labels, vote, "label long, new long"))
        stable = until_stable and following.where("label != new").isEmpty()
        labels = following.select("id", F.col("new").alias("label"))
        if stable:
            break
    return labels


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place (from 0) in an order over all of them, which has no ties: each range partition numbers its own
    rows and starts after those before it."""
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    return own.join(F.broadcast(starts), "part").select(*rows.columns, (F.col("own") + F.col("start")).cast("long").alias(name))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows with place: a seeded order that any engine can repeat."""
    return numbered(rows.withColumn("__turn", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))), ["__turn", key], "place").drop("__turn")


def relabelled(labels: DataFrame) -> DataFrame:
    """Contiguous labels from 0 in the order of each community's first node."""
    first = numbered(labels.groupBy("label").agg(F.min("id").alias("first")), ["first"], "community")
    return labels.join(first.select("label", "community"), "label").select("id", "community")


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: q.  edges: src, dst, weight."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("ls"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    marked = edges.where("src != dst").join(a, "src").join(b, "dst")
    inside = marked.where("ls = ld").groupBy(F.col("ls").alias("label")).agg(F.sum("weight").alias("inside"))
    ends = marked.select(F.explode(F.array("ls", "ld")).alias("label"), "weight").groupBy("label").agg(F.sum("weight").alias("ends"))
    joined = ends.join(inside, "label", "left").fillna(0, ["inside"])
    sums = joined.agg(F.sum("ends").alias("m2"), F.sum("inside").alias("i"), F.sum(F.col("ends").cast("double") * F.col("ends")).alias("sq"))
    return sums.select((F.col("i") / (F.col("m2") / 2) - F.lit(resolution) * F.col("sq") / (F.col("m2").cast("double") * F.col("m2"))).alias("q"))


# -- kernels that run on one graph that fits a worker


def _gains(node: int, own: int, near: dict, part: dict, weight: dict, total: dict, m: float, gamma: float) -> int:
    """The neighbouring community with the largest modularity gain, of equals the smallest; the own one if none is better."""
    links: Counter = Counter()
    for other, w in near[node].items():
        if other != node:
            links[part[other]] += w
    score = lambda c: links[c] - gamma * weight[node] * (total[c] - (weight[node] if c == own else 0)) / (2 * m)
    best, top = own, score(own)
    for c in sorted(links):
        if c != own and score(c) > top + 1e-12:
            best, top = c, score(c)
    return best


def leiden(
    edges: list[tuple[int, int, float]], nodes: list[int], gamma: float = 1.0, levels: int = 4, sweeps: int = 30, weight: dict | None = None, part: dict | None = None, m: float | None = None
) -> list[dict[int, int]]:
    """A partition for each level, finest first; labels are smallest members, so results don't depend on any order.

    ``weight``, ``part`` and ``m`` are those of a contracted graph: the weight of each node with what is inside it, the community
    it begins in, and half of the weight of the whole graph.

    Local moves, refinement inside the communities found, and aggregation of the refined parts, until nothing merges."""
    near: dict = {n: Counter() for n in nodes}
    for a, b, w in edges:
        if a in near and b in near and a != b:
            near[a][b] += w
            near[b][a] += w
    weight = weight or {n: sum(near[n].values()) for n in nodes}
    m = sum(weight.values()) / 2 if m is None else m
    members = {n: [n] for n in nodes}
    part = part or {n: n for n in nodes}
    found = []
    for _ in range(levels):
        if not m:
            found.append({n: n for n in nodes})
            break
        total: Counter = Counter()
        for n, c in part.items():
            total[c] += weight[n]
        for _ in range(sweeps):
            moved = False
            for n in sorted(part):
                best = _gains(n, part[n], near, part, weight, total, m, gamma)
                if best != part[n]:
                    total[part[n]] -= weight[n]
                    total[best] += weight[n]
                    part[n] = best
                    moved = True
            if not moved:
                break
        # Refinement: nodes merge only inside their community and only while they are alone.
        fine = {n: n for n in part}
        sums = Counter({n: weight[n] for n in part})
        for n in sorted(part):
            if sums[fine[n]] != weight[n]:
                continue
            inside = {n: {o: w for o, w in near[n].items() if part[o] == part[n]}}
            best = _gains(n, fine[n], inside, fine, weight, sums, m, gamma)
            if best != fine[n]:
                sums[fine[n]] -= weight[n]
                sums[best] += weight[n]
                fine[n] = best
        groups = defaultdict(list)
        for n, c in part.items():
            groups[c] += members[n]
        found.append({x: min(g) for g in groups.values() for x in g})
        parts = defaultdict(list)
        for n, c in fine.items():
            parts[c].append(n)
        if len(parts) == len(part):
            break
        name = {c: min(ns) for c, ns in parts.items()}
        up = {n: name[c] for n, c in fine.items()}
        smaller: dict = {name[c]: Counter() for c in parts}
        for n in near:
            for o, w in near[n].items():
                if up[n] != up[o] or n == o:
                    smaller[up[n]][up[o]] += w
                elif up[n] == up[o]:
                    smaller[up[n]][up[n]] += w
        outer = {up[n]: part[n] for n in part}
        first: dict = {}
        for n in sorted(outer):
            first.setdefault(outer[n], n)
        weight = {name[c]: sum(weight[n] for n in ns) for c, ns in parts.items()}
        members = {name[c]: [x for n in ns for x in members[n]] for c, ns in parts.items()}
        near, part = smaller, {n: first[c] for n, c in outer.items()}
    return found


#: Rows of a strip of pairs; its numbers should stay in a core's cache.
STRIP = 128


def _pushed(at: np.ndarray, others: np.ndarray, mass: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of mass * (p - q) / |p - q|^2 over others q for each p, a strip at a time; own: which of the others p is (in).

    Distances are one matrix product, and the sum is p times a row sum less another; so no array of pairs is made twice."""
    left = np.concatenate([-2 * at, np.ones((len(at), 1)), (at**2).sum(axis=1, keepdims=True)], axis=1).astype(np.float32)
    right = np.concatenate([others, (others**2).sum(axis=1, keepdims=True), np.ones((len(others), 1))], axis=1).astype(np.float32).T
    weighted = (np.concatenate([others, np.ones((len(others), 1))], axis=1) * mass[:, None]).astype(np.float32)
    move, strip = np.empty_like(at), np.arange(STRIP)
    for a in range(0, len(at), STRIP):
        near = left[a : a + STRIP] @ right
        np.maximum(near, np.float32(2e-4), out=near)
        np.reciprocal(near, out=near)
        near[strip[: len(near)], own[a : a + STRIP]] = 0
        sums = near @ weighted
        move[a : a + STRIP] = at[a : a + STRIP] * sums[:, 2:] - sums[:, :2]
    return move


def layout(n: int, edges: np.ndarray, iterations: int = 250, width: float = 1000.0, height: float = 1000.0, seed: int = 7, exact: int = 4096) -> tuple[np.ndarray, int]:
    """Fruchterman-Reingold positions and the rounds run; repulsion is of all pairs, in strips of rows, up to ``exact`` nodes,
    and by the tree of ``repulsion`` above (within a thousandth of the sum of all pairs)."""
    rng = np.random.default_rng(seed)
    half = np.array([width / 2, height / 2])
    at = rng.uniform(-1, 1, size=(n, 2)) * half
    if n < 2:
        return at, 0
    k2 = width * height / n
    heat = max(width, height) / 10
    edges = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
    a, b = np.ascontiguousarray(edges[np.argsort(edges[:, 0], kind="stable")].T)
    for done in range(1, iterations + 1):
        move = k2 * (repulsion.pushed(at) if n > exact else _pushed(at, at, np.ones(n), np.arange(n)))
        if len(a):
            d = [np.ascontiguousarray(at[:, axis]) for axis in (0, 1)]
            d = [x[a] - x[b] for x in d]
            pull = np.sqrt(d[0] * d[0] + d[1] * d[1]).clip(0.01) / math.sqrt(k2)
            for axis in (0, 1):
                d[axis] *= pull
                move[:, axis] += np.bincount(b, d[axis], n) - np.bincount(a, d[axis], n)
        size = np.sqrt((move**2).sum(axis=1, keepdims=True)).clip(1e-6)
        at = np.clip(at + move / size * np.minimum(size, heat), -half, half)
        heat *= 0.95
        if heat < 0.05:
            break
    return at, done


def layout_frame(spark: SparkSession, nodes: DataFrame, edges: DataFrame, iterations: int = 250, largest: int = 50_000, most: int = 2_000_000) -> DataFrame:
    """id, x, y, degree of a snapshot for drawing: one kernel call on a worker, and the same rounds over tables for a graph of more
    than ``largest`` nodes or ``most`` edges."""
    from . import placing

    ids, pairs = written(nodes.select("id").where("id IS NOT NULL").distinct()), written(undirected(edges))
    n, m = ids.count(), pairs.count()
    if n > largest or m > most:
        return placing.placed(ids, pairs, iterations, 2 * m, n)
    ns, es = ids.withColumn("one", F.lit(1)), pairs.distinct().withColumn("one", F.lit(1))

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(a["id"].to_numpy())
        b = b[b["src"].isin(ids) & b["dst"].isin(ids)]
        pairs = np.stack([np.searchsorted(ids, b["src"]), np.searchsorted(ids, b["dst"])], axis=1) if len(b) else np.zeros((0, 2), dtype=int)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]  # sums in one order, so reruns agree
        at, _ = layout(len(ids), pairs, iterations)
        return pd.DataFrame({"id": ids, "x": at[:, 0], "y": at[:, 1], "degree": np.bincount(pairs.reshape(-1), minlength=len(ids))})

    return ns.groupBy("one").cogroup(es.groupBy("one")).applyInPandas(work, "id long, x double, y double, degree long")


def framed(positions: DataFrame, width: float, height: float, margin: float = 0.9) -> DataFrame:
    """One row: the box around positions (x, y), and the scale at which it fills the share ``margin`` of a canvas."""
    box = positions.agg(F.min("x").alias("left"), F.max("x").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"))
    wide, high = F.greatest(F.col("right") - F.col("left"), F.lit(1.0)), F.greatest(F.col("bottom") - F.col("top"), F.lit(1.0))
    return box.withColumn("scale", F.lit(margin) * F.least(F.lit(width) / wide, F.lit(height) / high))
