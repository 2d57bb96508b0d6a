"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, and queries search it greedily.

Dong, Moses and Li, "Efficient k-nearest neighbor graph construction for generic similarity measures" (2011). Vectors of
one 16-bit code, as copies and positively scaled copies are, form a node, indexed once; of equal vectors only the members
with the smallest ids can be among the nearest, so as many are kept as a query can return.

The graph starts from blocks of ``BLOCK`` nodes, compared within each: ``TREES`` times all nodes are laid out in the order
of their nearest pivots, at several levels. Runs of blocks of the first layout, of up to ``CELL`` components, are also the
cells in which the rounds work.
A round joins neighbours of neighbours: every node gathers its neighbours, forward and reverse, compares those pairs of
them that were not compared before, and offers each its best matches, which are merged into the graph. Edges travel as
ids; a cell gets the code of each node that its edges name once, with the similarity that an offer to it must exceed. So a
round sends no more codes than nodes times cells, nor than ``DEGREE + REVERSE`` for each node, whatever the table's size.
Rounds end when few entries are new.

A query starts at its node's neighbours and, in rounds, expands the best nodes not yet expanded: they are joined with
their neighbours' ids, and those that it has not seen with their codes. The best ``BEAM`` seen stay, and all others whose
score by codes is so near to that of the last place asked for that the error of the codes, which is measured, can hide
their order: these are expanded too, and all members of all nodes within that error are scored on the original vectors,
with cosines in double precision. The search ends when no query has a node left to expand. Cosines are given to
``PLACES`` places, so that the rounding of scaled copies makes no order among them.

Reverse neighbours of a node are drawn, as in the paper, up to a fixed number by a hash; recall is measured against
brute force in the tests and, for the query's own tables, in the README.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another
length than the most common one; ties go to the smaller id; with fewer candidates than asked for, all are returned;
repeated ids are kept as they are, and a row is no candidate for a query of the same id; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize, shuffle_partitions, trimmed
from .near_dedup import _groups

#: Neighbours of a node in the graph, reverse ones drawn for a round, and matches offered to a node by another.
DEGREE, REVERSE, OFFERS = 32, 32, 12
#: Nodes that are compared with each other at the start, layouts, and pivots of a layout at each of its levels.
BLOCK, TREES, PIVOTS, LEVELS = 1024, 4, 256, 3
#: Components of the nodes of a cell, a block at least. A cell gets the codes of up to DEGREE + REVERSE nodes for each.
CELL = 1 << 18
#: The build ends when at most this share of the graph's entries is new; it fails if that takes more rounds than this.
SETTLED, ROUNDS = 0.02, 30
BEAM, EXPAND = 128, 64
#: Nodes expanded in a round at most, where so many are within the error of the codes.
CLOSE = 256
PLACES = 13
SEED = 11


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def _code(vectors: np.ndarray) -> np.ndarray:
    """Vectors in 16 bits a component, each scaled to its largest component."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    return np.round(vectors / top * 32767).astype(np.int16)


def _unit(codes: np.ndarray) -> np.ndarray:
    v = codes.astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(len(column), -1)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its k largest values, on the last axis."""
    k = min(k, sims.shape[-1])
    return np.argpartition(-sims, k - 1, axis=-1)[..., :k]


OFFERED = "node long, near array<long>, sims array<float>"
GRAPH = "node long, near array<long>, sims array<float>, fresh array<boolean>"


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, dtype=np.int64)


def _lists(node: np.ndarray, *values: np.ndarray):
    """Columns of nodes, sorted and repeated, as one row each with lists of the values."""
    import pyarrow as pa

    first = _starts(node)
    bounds = pa.array(np.append(first, len(node)).astype(np.int32))
    names = ["node", "near", "sims", "fresh"][: len(values) + 1]
    return pa.RecordBatch.from_arrays([pa.array(node[first]), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in values)], names)


def _top(node: np.ndarray, near: np.ndarray, sims: np.ndarray, k: int, fresh: np.ndarray | None = None):
    """The k best distinct pairs of each node, by node; an entry that is not fresh in any copy is not fresh."""
    fresh = np.ones(len(node), dtype=bool) if fresh is None else fresh
    order = np.lexsort((fresh, near, node))
    node, near, sims, fresh = node[order], near[order], sims[order], fresh[order]
    once = np.append(True, (node[1:] != node[:-1]) | (near[1:] != near[:-1])) if len(node) else np.empty(0, dtype=bool)
    node, near, sims, fresh = node[once], near[once], sims[once], fresh[once]
    order = np.lexsort((near, -sims, node))
    node, near, sims, fresh = node[order], near[order], sims[order], fresh[order]
    first = _starts(node)
    place = np.arange(len(node)) - np.repeat(first, np.diff(first, append=len(node)))
    keep = place < k
    return node[keep], near[keep], sims[keep], fresh[keep]


def _merge(offers: DataFrame, n: int) -> DataFrame:
    """For each node the best DEGREE of what is offered to it; offers have ``old``: entries that the graph had before."""

    def run(batches):
        for table, _ in _groups(batches):
            lists, values = table.column(1).combine_chunks(), table.column(2).combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            node = np.repeat(table.column(0).to_numpy(), sizes)
            fresh = ~np.repeat(table.column(3).to_numpy(), sizes)
            yield _lists(*_top(node, lists.flatten().to_numpy(), values.flatten().to_numpy(), DEGREE, fresh))

    return offers.select("node", "near", "sims", "old").repartition(n, "node").sortWithinPartitions("node").mapInArrow(trimmed(run), GRAPH)


def _laid_out(points: DataFrame, pivots: list[np.ndarray], ranges: int) -> DataFrame:
    """(node, cell, code, near, sims): points in the order of their nearest pivots, cut into blocks of about BLOCK, the cell
    of each, and the best matches of each within its block."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.zeros(batch.num_rows, dtype=np.int64)
            if batch.num_rows:
                unit = _unit(_codes(batch.column(1)))
                for p in pivots:
                    at = at * PIVOTS + (unit @ p.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], ["node", "code", "at"])

    def whole(table, cell: int):
        import pyarrow as pa

        ids, unit = table.column(0).to_numpy(), _unit(_codes(table.column(1)))
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2)
        at = _best(sims, min(DEGREE, len(ids) - 1)) if len(ids) > 1 else np.empty((len(ids), 0), dtype=np.int64)
        bounds = pa.array((np.arange(len(ids) + 1) * at.shape[1]).astype(np.int32))
        found = np.take_along_axis(sims, at, axis=1).astype(np.float32)
        near = pa.ListArray.from_arrays(bounds, pa.array(ids[at].ravel())), pa.ListArray.from_arrays(bounds, pa.array(found.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), cell)), table.column(1).combine_chunks(), *near], ["node", "cell", "code", "near", "sims"])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held, first, block, together = None, TaskContext.get().partitionId() << 32, 0, 1
        for batch in batches:
            table = pa.Table.from_batches([batch]).select([0, 1])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= 2 * BLOCK:
                together = max(1, CELL // (BLOCK * _codes(held.slice(0, 1).column(1)).shape[1]))
                yield whole(held.slice(0, BLOCK), first + block // together)
                held, block = held.slice(BLOCK), block + 1
        if held is not None and held.num_rows:
            yield whole(held, first + block // together)

    laid = points.mapInArrow(trimmed(place), "node long, code binary, at long")
    dealt = laid.repartitionByRange(ranges, "at", "node") if ranges > 1 else laid.coalesce(1)
    return dealt.sortWithinPartitions("at", "node").select("node", "code").mapInArrow(trimmed(run), "node long, cell long, code binary, near array<long>, sims array<float>")


def _around(graph: DataFrame) -> DataFrame:
    """(centre, member, fresh): each node's neighbours, forward and up to REVERSE drawn ones that it is a neighbour of.

    A member that is both comes twice.
    """
    forward = graph.select(F.col("node").alias("centre"), F.explode(F.arrays_zip("near", "fresh")).alias("e")).select("centre", F.col("e.near").alias("member"), F.col("e.fresh").alias("fresh"))
    drawn = Window.partitionBy("centre").orderBy(F.xxhash64("member", "centre"))
    reverse = forward.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")
    reverse = reverse.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= REVERSE).drop("_r")
    return forward.unionByName(reverse)


def _compared(ids: np.ndarray, unit: np.ndarray, least: np.ndarray, centre: np.ndarray, member: np.ndarray, fresh: np.ndarray):
    """(node, near, sims) that the centres' members offer each other, the best DEGREE to each: pairs with a fresh one whose
    similarity exceeds what the receiver has."""
    order = np.lexsort((~fresh, member, centre))
    centre, member, fresh = centre[order], member[order], fresh[order]
    once = np.append(True, (centre[1:] != centre[:-1]) | (member[1:] != member[:-1]))
    centre, at, fresh = centre[once], np.searchsorted(ids, member[once]), fresh[once]
    first = _starts(centre)
    sizes = np.diff(first, append=len(centre))
    out = []
    for a in range(0, len(first), 512):
        own = slice(first[a], first[a + 512] if a + 512 < len(first) else len(centre))
        n, width = sizes[a : a + 512], int(sizes[a : a + 512].max())
        if width < 2:
            continue
        row = np.repeat(np.arange(len(n)), n)
        column = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        who, new = np.full((len(n), width), -1), np.zeros((len(n), width), dtype=bool)
        who[row, column], new[row, column] = at[own], fresh[own]
        vectors = unit[who]
        sims = vectors @ vectors.transpose(0, 2, 1)
        sims[(who < 0)[:, None, :] | (who < 0)[:, :, None] | ~(new[:, :, None] | new[:, None, :])] = -2
        sims[:, np.arange(width), np.arange(width)] = -2
        sims[sims <= least[who][:, :, None]] = -2
        best = _best(sims, OFFERS)
        value = np.take_along_axis(sims, best, axis=2)
        good = value > -1.5
        receiver, other = np.broadcast_to(who[:, :, None], best.shape)[good], np.take_along_axis(np.broadcast_to(who[:, None, :], sims.shape), best, axis=2)[good]
        out.append(_top(receiver, other, value[good].astype(np.float32), DEGREE)[:3])
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    node, near, sims, _ = _top(*(np.concatenate(x) for x in zip(*out, strict=True)), DEGREE)
    return ids[node], ids[near], sims


def _round(graph: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """The graph after each node has compared its neighbours, forward and reverse, with each other."""
    cells = points.select(F.col("node").alias("centre"), "cell")
    edges = materialize(_around(graph).join(cells, "centre").select("cell", "centre", "member", "fresh"), "edges")
    worst = F.when(F.size("sims") >= DEGREE, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
    asked = edges.select("cell", F.col("member").alias("node")).distinct()
    codes = asked.join(points.select("node", "code"), "node").join(graph.select("node", worst.alias("worst")), "node", "left")
    none = F.lit(None)
    first = codes.select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), none.cast("long").alias("b"), none.cast("boolean").alias("fresh"), "code", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    second = edges.select("cell", F.lit(1).alias("kind"), F.col("centre").alias("a"), F.col("member").alias("b"), "fresh", none.cast("binary").alias("code"), none.cast("float").alias("worst"))

    def run(batches):
        for table, starts in _groups(batches):
            for s, e in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist(), strict=True):
                part = table.slice(s, e - s).combine_chunks()
                m = int(np.searchsorted(part.column(1).to_numpy(), 1))
                if m < 2 or m == e - s:
                    continue
                nodes, rest = part.slice(0, m), part.slice(m)
                unit, least = _unit(_codes(nodes.column(5))), nodes.column(6).to_numpy()
                found = _compared(nodes.column(2).to_numpy(), unit, least, rest.column(2).to_numpy(), rest.column(3).to_numpy(), rest.column(4).to_numpy())
                if len(found[0]):
                    yield _lists(*found)

    offers = first.unionByName(second).repartition(n, "cell").sortWithinPartitions("cell", "kind", "a").mapInArrow(trimmed(run), OFFERED)
    merged = graph.select("node", "near", "sims", F.lit(True).alias("old")).unionByName(offers.withColumn("old", F.lit(False)))
    out = materialize(_merge(merged, n), "graph")
    discard(edges)
    return out


def build(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, points): the neighbour graph (node, near, sims, fresh) over points (node, code), and the points with cells."""
    n, count = shuffle_partitions(points.sparkSession), points.count()
    # As many ranges as there are blocks, at most, so that few points are not each alone in a range.
    ranges, each = max(1, min(n, count // BLOCK)), max(1, min(PIVOTS, count // BLOCK))
    drawn = points.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(TREES * LEVELS * each).select("code").toArrow()
    sample = _unit(_codes(drawn.column("code"))) if drawn.num_rows else np.empty((0, 1), dtype=np.float32)
    offers, held = None, None
    for tree in range(TREES if count > 2 * BLOCK else 1):
        pivots = [sample[(tree * LEVELS + level) * each :][:each] for level in range(LEVELS)]
        laid = _laid_out(points, [p for p in pivots if len(p)], ranges)
        if held is None:
            laid = held = materialize(laid, "cells")
        found = laid.select("node", "near", "sims", F.lit(False).alias("old"))
        offers = found if offers is None else offers.unionByName(found)
    points = held.select("node", "cell", "code")
    graph = materialize(_merge(offers, n), "graph")
    for _ in range(ROUNDS if count > 2 * BLOCK else 0):
        after = _round(graph, points, n)
        discard(graph)
        graph = after
        change = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x))).alias("c"), F.sum(F.size("near")).alias("t")).first()
        if not change["t"] or change["c"] <= SETTLED * change["t"]:
            return graph, points
    if count > 2 * BLOCK:
        raise RuntimeError(f"the graph has not settled in {ROUNDS} rounds")
    return graph, points


STATE = "query long, code binary, near array<long>, sims array<float>, open array<long>, done array<long>"


def search(graph: DataFrame, points: DataFrame, starts: DataFrame, k: int, margin: float) -> DataFrame:
    """(query, near, sims): of the nodes that greedy search from starts (query, code) finds, those less than margin below
    the k-th best."""
    n = shuffle_partitions(points.sparkSession)
    hops = materialize(_around(graph).select(F.col("centre").alias("node"), "member").groupBy("node").agg(F.collect_set("member").alias("members")), "hops")

    def run(batches):
        import pyarrow as pa

        for table, first in _groups(batches):
            rows: list[tuple] = []
            for s, e in zip(first.tolist(), np.append(first[1:], table.num_rows).tolist(), strict=True):
                head, rest = table.slice(s, 1).to_pylist()[0], table.slice(s + 1, e - s - 1)
                near, sims = np.array(head["near"], dtype=np.int64), np.array(head["sims"], dtype=np.float32)
                ids = rest.column(2).to_numpy()
                fresh = np.flatnonzero(~np.isin(ids, near) & (ids != head["query"]))
                if len(fresh):
                    codes = _unit(_codes(rest.column(3).take(pa.array(fresh))))
                    own = _unit(np.frombuffer(head["code"], dtype=np.int16)[None, :])[0]
                    near, sims = np.concatenate([near, ids[fresh]]), np.concatenate([sims, (codes @ own).astype(np.float32)])
                done = set(head["done"]) | set(head["open"])
                order = np.argsort(-sims, kind="stable")
                close = int(np.count_nonzero(sims >= sims[order[min(k, len(order)) - 1]] - margin)) if len(order) else 0
                order = order[: max(BEAM, close)]
                near, sims = near[order], sims[order]
                left = [x for x in near.tolist() if x not in done]
                unsure = sum(x not in done for x in near[:close].tolist())
                rows.append((head["query"], head["code"], near, sims, left[: min(max(EXPAND, unsure), CLOSE)], sorted(done & set(near.tolist()))))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["query", "code", "near", "sims", "open", "done"])

    none, longs = F.lit(None), F.array().cast("array<long>")
    state = starts.select("query", "code", longs.alias("near"), F.array().cast("array<float>").alias("sims"), F.array("query").alias("open"), longs.alias("done"))
    state = materialize(state, "beam")
    while True:
        asked = state.select("query", F.explode("open").alias("node")).join(hops, "node").select("query", F.explode("members").alias("node")).distinct()
        met = asked.join(points.select("node", "code"), "node")
        first = state.select("query", F.lit(0).alias("kind"), none.cast("long").alias("node"), "code", "near", "sims", "open", "done")
        second = met.select("query", F.lit(1).alias("kind"), "node", "code", *[none.cast(t).alias(c) for c, t in (("near", "array<long>"), ("sims", "array<float>"), ("open", "array<long>"), ("done", "array<long>"))])
        grouped = first.unionByName(second).repartition(n, "query").sortWithinPartitions("query", "kind")
        after = materialize(grouped.mapInArrow(trimmed(run), STATE), "beam")
        discard(state)
        state = after
        if state.where(F.size("open") > 0).isEmpty():
            break
    least = F.element_at("sims", F.least(F.lit(k), F.size("sims"))) - F.lit(margin)
    close = F.when(F.size("sims") > 0, F.size(F.filter("sims", lambda x: x >= least))).otherwise(0)
    return state.select("query", F.slice("near", F.lit(1), close).alias("near"), F.slice("sims", F.lit(1), close).alias("sims"))


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, its k nearest others."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("asks"))
    rows = rows.where(usable("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = lengths["d"]

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dims)
                values = values / np.abs(values).max(axis=1, keepdims=True)
                codes = _code(values)
                exact, rough = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (values, codes.astype(np.float64)))
                lost = pa.array(np.linalg.norm(exact - rough, axis=1), pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), lost], ["id", "v", "asks", "code", "lost"])

    # -0.0 is 0.0, so that equal vectors are equal arrays.
    whole = rows.where(F.size("v") == dims).select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "asks")
    coded = materialize(whole.mapInArrow(trimmed(code), "id long, v array<double>, asks boolean, code binary, lost double"), "vectors")
    points = materialize(coded.groupBy("code").agg(F.max("asks").alias("asks"), F.max("lost").alias("lost")).withColumn("node", F.monotonically_increasing_id()), "points")
    # A score by codes errs by the loss of both codes and the rounding of single precision, and so does the one it is held against.
    margin = 4 * (points.agg(F.max("lost")).first()[0] + dims * 2.0**-24)
    graph, celled = build(points.select("node", "code"))
    asked = points.where("asks").select(F.col("node").alias("query"), "code")
    found = search(graph, celled, asked, k + 1, margin).select("query", F.explode("near").alias("node"))
    found = materialize(found.unionByName(asked.select("query", F.col("query").alias("node"))), "found")
    # The members that can be among the nearest: the k + 1 smallest ids of each vector, cut to that within each task first.
    named = coded.join(points.select("code", "node"), "code").select("id", "v", "asks", "node")
    wanted = named.join(found.select("node").distinct(), "node")
    ranked = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1)
    # The exact measure, for each query and each candidate member.
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (a, x) -> a + x)"
    scaled = "transform({0}, x -> x / array_max(transform({0}, y -> abs(y))))"
    near = found.join(ranked.select("node", F.col("id").alias("vec_id"), F.expr(scaled.format("v")).alias("w")), "node").drop("node")
    asking = named.where("asks").select(F.col("id").alias("query_id"), F.col("node").alias("query"), F.expr(scaled.format("v")).alias("v"))
    pairs = asking.join(near, "query").where("query_id <> vec_id")
    score = F.expr(f"{dot.format('v', 'w')} / (sqrt({dot.format('v', 'v')}) * sqrt({dot.format('w', 'w')}))")
    scored = pairs.select("query_id", "vec_id", F.round(score, PLACES).alias("score")).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 50 == 0)
