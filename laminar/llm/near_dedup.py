"""Near-duplicate detection by a chosen-path set similarity join.

Christiani and Pagh, "Set similarity search beyond MinHash" (2017); Christiani, Pagh and Sivertsen, "Scalable and robust
set similarity join" (2018). A document is the set of its k-word shingles, embedded as T minwise values. Each of several
independent trees branches at its root on one of the T positions: a document follows the edge of its value there. Nodes
that are still large branch again, on positions drawn for that node, each taken with probability 1.5 / (threshold * T);
small nodes are compared exhaustively by their minwise values. Trees are repeated until the recall target holds
for a pair just at the threshold.

The steps:

1. each row's shingle set, its digest, its nodes at the first level, and its minwise values cut to four bits (written);
2. rows with equal sets form a class (written, with a number of its own), whatever their ids;
3. nodes of all trees, as (path, class), of which those with two rows or more get the bits; a node of up to ``NODE`` rows
   branches in its task until ``LEAF`` rows are left, larger ones are dealt out by their branches, then by pairs of blocks,
   so no task holds a very large node; each gives a forest of its likely links, at most a row for each member;
4. likely links are joined into families by contracting stars, iteratively, each round written;
5. the full sets of all members are written; each member's likeliest link is confirmed on the two full sets, and
   confirmed links give first components;
6. in families that these leave in several parts, all pairs of members of different parts are compared on the full sets,
   dealt out by pairs of blocks of about ``BLOCK`` members: those outside the family's largest part against all;
7. confirmed links, and links between classes that share a doc_id, give components; each row takes the smallest doc_id of
   its component.

What can be missed: a pair exactly at the threshold meets in some tree with probability RECALL, however deep its nodes
branch, as levels below the root branch at a higher rate and the trees are counted for branching without end; a pair that
meets is likely if its bits agree down to 4.5 standard deviations below the threshold; and step 6 does not count pairs
whose minwise values lie six deviations below. Sets are compared by 64-bit hashes of shingles.

Cases: a null or empty text, or one without words, has an empty set, links with nothing and is its own component, also
where another row of its id has words; one with fewer than k words is one shingle; a very long text is one set, in memory
in proportion to its words; equal rows have equal sets and so one component, and all are ``kept`` if their id is the
component's; rows of one id with different texts all count, and their components are one; a null doc_id takes no part in
links and has a null component and kept true; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U, discard, materialize, mix, shingles_of, shuffle_partitions, small, text_buffers, trimmed, words_of

SHINGLE = 3
PERCENT = 85
RECALL = 0.9999
POSITIONS = 128
SEED = 20260
#: Rows of a node that are compared exhaustively; larger ones branch again, up to so many levels.
LEAF = 1024
LEVELS = 4
#: Rows of a node that one task holds and branches in memory; larger ones are dealt out by their branches first.
NODE = 16384
#: Expected children of a pair at the threshold in a node below the root.
BELOW = 1.5
#: Members of a family, or of a node that no branching divides, that one task compares with as many others.
BLOCK = 512
#: Links, 16 bytes each, that one task unites.
TOGETHER = 1 << 20


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(SEED * 2 + 1)) | U(1)


def minwise(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """For each non-empty set its minimum under each of the hash functions, as 32 bits."""
    lengths = np.array([len(s) for s in sets])
    out = np.empty((len(sets), positions), dtype=np.uint32)
    if not len(sets):
        return out
    values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for i, m in enumerate(_multipliers(positions)):
        out[:, i] = np.minimum.reduceat(((values ^ (m >> U(7))) * m) >> U(32), starts)
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """The low four bits of each value, two to a byte."""
    low = (values & 0xF).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def tree_count(threshold: float, recall: float) -> int:
    """Trees needed for a pair at the threshold to meet in a leaf, if branching goes on for any number of levels.

    The pair passes the root of a tree if it agrees at the root's position; below, its meeting dies out with the smallest
    root of the branching process's equation.
    """
    apart = 0.0
    for _ in range(200):
        apart = math.exp(BELOW * (apart - 1))
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * (1 - apart)))


def chosen(path: int, threshold: float, positions: int) -> list[int]:
    """The positions on which a node below the root branches, each taken with probability BELOW / (threshold * positions)."""
    with np.errstate(over="ignore"):
        draws = mix(U(path & (2**64 - 1)) * U(0x9E3779B97F4A7C15) + np.arange(1, positions + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
    return np.flatnonzero(draws < U(min(2**64 - 1, int(2**64 * BELOW / (threshold * positions))))).tolist()


def roots(trees: int) -> list[int]:
    """The position on which each tree's root branches: each another one, so that trees are independent."""
    return np.random.default_rng(SEED).permutation(POSITIONS)[:trees].tolist()


def child(path, position: int, values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = mix(np.atleast_1d(np.asarray(path)).astype(U) + U(position + 1) * U(0xD6E8FEB86659FD93))
        return mix(seed + (values.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)).view(np.int64)


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


SKETCHED = "doc_id long, n_shingles long, digest binary, roots array<long>, sketch binary"


def sketches(docs: DataFrame, k: int, trees: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's set size, the digest of its set, its nodes at the first level, and its packed minwise values."""
    positions = roots(trees)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                sets = shingles_of(*words_of(data, offsets), k)
                full = [s for s in sets if len(s)]
                values = minwise(full)
                nodes = np.stack([child(tree - trees, position, values[:, position]) for tree, position in enumerate(positions)], axis=1)
                low = packed(values)
                at = iter(range(len(full)))
                place = [next(at) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if i is None else digest_of(s) for i, s in zip(place, sets, strict=True)], pa.binary()),
                        pa.array([None if i is None else nodes[i] for i in place], pa.list_(pa.int64())),
                        pa.array([None if i is None else low[i].tobytes() for i in place], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "roots", "sketch"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), SKETCHED)


def _groups(batches):
    """From Arrow batches sorted by their first column: tables of whole groups, and where each group begins."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        group = table.column(0).to_numpy()
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        if not len(cuts):
            held = table
            continue
        held = table.slice(int(cuts[-1]))
        yield table.slice(0, int(cuts[-1])), np.concatenate([[0], cuts[:-1]])
    if held is not None and held.num_rows:
        yield held, np.array([0])


def _matrix(column) -> np.ndarray:
    """The values of packed sketches, a row each."""
    both = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    out = np.empty((len(both), 2 * both.shape[1]), dtype=np.uint8)
    out[:, 0::2], out[:, 1::2] = both >> 4, both & 0xF
    return out


class Union:
    """Disjoint sets of 0 to n - 1."""

    def __init__(self, label: np.ndarray):
        self.label = label

    def join(self, a: int, b: int) -> bool:
        x, y = self.label[a], self.label[b]
        if x == y:
            return False
        self.label[self.label == max(x, y)] = min(x, y)
        return True


def forest(sketch: np.ndarray, rows: np.ndarray, least: int, union: Union, sides: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(row, row, positions alike): links that join all of rows of which a chain of pairs agrees in ``least`` positions.

    Each row looks for all that it is not yet joined with. sides: with two blocks, only pairs across them count.
    """
    out: list[tuple[int, int, int]] = []
    for at, i in enumerate(rows[:-1].tolist()):
        others = rows[at + 1 :]
        others = others[union.label[others] != union.label[i]]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        if len(others):
            alike = np.count_nonzero(sketch[others] == sketch[i], axis=1)
            near = np.flatnonzero(alike >= least)
            for j, n in zip(others[near].tolist(), alike[near].tolist(), strict=True):
                if union.join(i, j):
                    out.append((i, j, n))
        elif (union.label[rows[at:]] == union.label[i]).all():
            break
    return out


def branched(sketch: np.ndarray, rows: np.ndarray, path: int, threshold: float, least: int, union: Union, level: int = 0) -> list[tuple[int, int, int]]:
    """Likely links in a node, branching while it is large: at each chosen position by the rows' values there."""
    if len(rows) <= LEAF or level >= LEVELS:
        return forest(sketch, rows, least, union)
    out = []
    for position in chosen(path, threshold, POSITIONS):
        values = sketch[rows, position]
        order = np.argsort(values, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(values[order])) + 1):
            if len(own) > 1 and (union.label[rows[own]] != union.label[rows[own[0]]]).any():
                below = int(child(path & (2**64 - 1), position, values[own[:1]])[0])
                out += branched(sketch, rows[own], below, threshold, least, union, level + 1)
    return out


LINKS = "a long, b long"


def likely_links(held: DataFrame, percent: int) -> DataFrame:
    """(a, b, alike): forests of likely links in the nodes of all trees, over the classes ``held``."""
    threshold = percent / 100
    agree = threshold + (1 - threshold) / 16  # four bits agree by chance as well
    least = math.ceil(POSITIONS * (agree - 4.5 * math.sqrt(agree * (1 - agree) / POSITIONS)))
    spark = held.sparkSession
    n = shuffle_partitions(spark)

    def compare(batches):
        import pyarrow as pa

        for table, starts in _groups(batches):
            ends = np.append(starts[1:], table.num_rows)
            paths, sides, ids = (table.column(i).to_numpy() for i in range(3))
            out: list[np.ndarray] = []
            several = np.flatnonzero(ends - starts > 1)
            for g in several.tolist():
                s, e = int(starts[g]), int(ends[g])
                own, rows = _matrix(table.column(3).slice(s, e - s)), np.arange(e - s)
                if sides[s] < 0:
                    found = branched(own, rows, int(paths[s]), threshold, least, Union(rows.copy()))
                else:
                    found = forest(own, rows, least, Union(rows.copy()), sides[s:e] if sides[s:e].min() != sides[s:e].max() else None)
                if found:
                    i, j, alike = np.array(found).T
                    out.append(np.stack([np.minimum(ids[s + i], ids[s + j]), np.maximum(ids[s + i], ids[s + j]), alike]))
            a, b, alike = np.concatenate(out, axis=1) if out else np.empty((3, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(alike.astype(np.int32))], ["a", "b", "alike"])

    def branch(batches):
        import pyarrow as pa

        for batch in batches:
            paths, ids, sketch = batch.column("path").to_numpy(), batch.column("class").to_numpy(), _matrix(batch.column("sketch"))
            out_path, out_row = [], []
            for path in np.unique(paths):
                rows = np.flatnonzero(paths == path)
                for position in chosen(int(path), threshold, POSITIONS):
                    out_path.append(child(int(path) & (2**64 - 1), position, sketch[rows, position]))
                    out_row.append(rows)
            if out_row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_path)), pa.array(ids[np.concatenate(out_row)])], ["path", "class"])

    # Nodes are counted, and parted by size, as pairs of numbers; sketches go only to those of two rows or more.
    sketches_of = held.select("class", "sketch")
    rows, done = held.select(F.explode("roots").alias("path"), "class"), []
    for level in range(LEVELS + 1):
        counts = materialize(rows.groupBy("path").count().where("count > 1"), "counts")
        live = rows.join(counts, "path").join(sketches_of, "class").select("path", "class", "sketch", "count")
        done.append(live.where(F.col("count") <= NODE).select("path", F.lit(-1).alias("side"), "class", "sketch"))
        large = live.where(F.col("count") > NODE)
        if counts.where(F.col("count") > NODE).isEmpty():
            break
        if level == LEVELS:
            done.append(_block_pairs(large).select("path", "side", "class", "sketch"))
        else:
            rows = materialize(large.mapInArrow(trimmed(branch), "path long, class long"), "nodes")
    links = [x.repartition(n, "path").sortWithinPartitions("path").mapInArrow(trimmed(compare), LINKS + ", alike int") for x in done]
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out.groupBy("a", "b").agg(F.max("alike").alias("alike"))


def _block(count: int | str) -> F.Column:
    return F.ceil(F.col(count) / BLOCK).cast("int")


def _block_pairs(rows: DataFrame) -> DataFrame:
    """rows (with ``count``, the node's rows) once for each pair of blocks that theirs is in; side: the block's place."""
    out = rows.withColumn("_blocks", _block("count")).withColumn("_block", F.pmod(F.xxhash64("class"), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    side = F.when(F.col("_block") == F.col("_other"), -1).otherwise(F.col("_block"))
    out = out.withColumn("side", side).withColumn("path", F.xxhash64("path", low, high))
    return out.drop("_blocks", "_block", "_other", "count")


def _fingerprint(links: DataFrame) -> tuple:
    """Tells sets of links apart: their number, and two sums of their checksums."""
    mixed = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.bit_xor(mixed), F.sum(mixed.cast("decimal(38,0)"))).first())


def _united(batches):
    """(id, root) of links that one task holds: labels sink to the smallest that each reaches."""
    import pyarrow as pa

    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, dtype=np.int64) for i in range(2))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "root"])


def components(links: DataFrame) -> DataFrame:
    """(id, root) of all ids that links (a, b) name: the smallest id that each reaches.

    Up to TOGETHER links are united in one task. For more, each round gives every node's larger neighbours, then its
    smaller ones, to its smallest neighbour (Kiveris et al., "Connected components in MapReduce and beyond", 2014) and is
    written; rounds go on until they change nothing, or so few links are left. Both ways give the same.
    """
    now = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    seen = _fingerprint(now)
    while seen[0] > TOGETHER:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
        large = large.distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(down, "b")
        small = moved.select(F.col("m").alias("a"), "b").unionByName(moved.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        after = materialize(small.distinct(), "links")
        found = _fingerprint(after)
        discard(now)
        now = after
        if found == seen:
            roots = now.select("a").distinct()
            return now.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(roots.select(F.col("a").alias("id"), F.col("a").alias("root")))
        seen = found
    return now.coalesce(1).mapInArrow(trimmed(_united), "id long, root long")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if percent * len(b) > 100 * len(a):
        return False
    found = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(found, len(b) - 1)] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(sets: list[np.ndarray], asking: np.ndarray, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of those asking with all that carry another label, as far as they join what is not yet joined."""
    threshold = percent / 100
    least = math.floor(POSITIONS * (threshold - 6 * math.sqrt(threshold * (1 - threshold) / POSITIONS)))
    sketch = (minwise(sets) & 0xFF).astype(np.uint8)
    sizes, union, out = np.array([len(s) for s in sets]), Union(label), []
    for i in asking.tolist():
        fits = (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * percent) & (union.label != union.label[i])
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        alike = np.count_nonzero(sketch[others] == sketch[i], axis=1)
        near = np.flatnonzero(alike >= least)
        for j in others[near[np.argsort(-alike[near], kind="stable")]].tolist():
            if union.label[i] != union.label[j] and linked(sets[i], sets[j], percent):
                union.join(i, j)
                out.append((i, j))
    return out


def member_sets(docs: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(class, values): the full set of each member (class, doc_id, digest, copies), as sorted 64-bit hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(1)):
                sets = shingles_of(*words_of(data, offsets), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([digest_of(x) for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())],
                    ["doc_id", "digest", "values"],
                )

    # Where the members are few enough they go to the texts, which then stay in place.
    asked = docs.join(small(members.select("doc_id"), 16), "doc_id", "left_semi")
    found = asked.mapInArrow(trimmed(run), "doc_id long, digest binary, values binary")
    # Another text of an id is no member's set; a set of several rows can come several times, from rows of one id.
    own = materialize(found.join(small(members, 96), ["doc_id", "digest"]).select("class", "copies", "values"), "sets")
    once = own.where("copies > 1").groupBy("class").agg(F.any_value("values").alias("values"))
    return own.where("copies = 1").select("class", "values").unionByName(once)


def with_digest(docs: DataFrame, k: int, text: str = "text", out: str = "_digest") -> DataFrame:
    """docs with the digest of each row's set, null if that is empty."""
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for first, data, offsets in text_buffers(batch.column(at)):
                sets = shingles_of(*words_of(data, offsets), k)
                digests = pa.array([digest_of(s) if len(s) else None for s in sets], pa.binary())
                part = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns, digests], [*part.schema.names, out])

    return docs.mapInArrow(trimmed(run), docs.schema.add(out, "binary"))


def _sets_of(column) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in column.to_pylist()]


def confirmed_likeliest(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each member's likeliest link, if the full sets confirm it.

    Members that chose the same one meet in cells of about BLOCK of them, each with the set of the chosen one.
    """
    both = likely.select("a", "b", "alike").unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"), "alike"))
    best = materialize(both.groupBy("a").agg(F.max_by("b", F.struct("alike", -F.col("b"))).alias("b")), "likeliest")
    counts = best.groupBy("b").count()
    cells = materialize(best.join(counts, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), _block("count"))).alias("cell")), "dealt")
    asking = cells.select("cell", "b", F.lit(1).alias("side"), F.col("a").alias("class"))
    asked = cells.select("cell", "b", F.lit(0).alias("side"), F.col("b").alias("class")).distinct()
    places = materialize(asking.unionByName(asked), "dealt")

    def run(batches):
        import pyarrow as pa

        for table, starts in _groups(batches):
            out: list[tuple] = []
            for s, e in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist(), strict=True):
                part = table.slice(s, e - s)
                chosen_ones, sides, ids = (part.column(i).to_numpy() for i in (1, 2, 3))
                values = _sets_of(part.column(4))
                hubs = {int(ids[i]): values[i] for i in np.flatnonzero(sides == 0)}
                out += [(int(ids[i]), int(chosen_ones[i])) for i in np.flatnonzero(sides == 1) if linked(values[i], hubs[int(chosen_ones[i])], percent)]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = shuffle_partitions(likely.sparkSession)
    dealt = sets.join(small(places, 64), "class").select("cell", "b", "side", "class", "values")
    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(trimmed(run), LINKS)


def confirmed_apart(families: DataFrame, first: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the parts (class, part) that the first components leave of families (class, family)."""
    members = families.join(first, families["class"] == first["id"], "left").select("class", "family", F.coalesce("root", "class").alias("part"))
    parts = materialize(members.groupBy("family", "part").count(), "parts")
    split = parts.groupBy("family").agg(F.sum("count").alias("n"), F.max(F.struct("count", "part")).alias("top"), F.count("*").alias("parts"))
    split = split.where("parts > 1 AND n > 2").select("family", "n", (F.col("n") - F.col("top.count")).alias("outside"), F.col("top.part").alias("top"))
    own = members.join(split, "family").withColumn("_all", _block("n")).withColumn("_out", _block("outside")).withColumn("_hash", F.xxhash64("class"))
    asking = own.where("part <> top").select("*", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)).alias("_j"))
    asking = asking.select(F.xxhash64("family", F.pmod("_hash", "_out"), F.col("_j").cast("long")).alias("cell"), F.lit(0).alias("side"), "class", "part")
    asked = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_out") - 1)).alias("_i"))
    asked = asked.select(F.xxhash64("family", F.col("_i").cast("long"), F.pmod("_hash", "_all")).alias("cell"), F.lit(1).alias("side"), "class", "part")

    def run(batches):
        import pyarrow as pa

        for table, starts in _groups(batches):
            a, b = [], []
            for s, e in zip(starts.tolist(), np.append(starts[1:], table.num_rows).tolist(), strict=True):
                part = table.slice(s, e - s)
                sides, ids = part.column(1).to_numpy(), part.column(2).to_numpy()
                asking = np.flatnonzero(sides == 0)
                if not len(asking) or len(asking) == len(ids):
                    continue
                _, label = np.unique(part.column(3).to_numpy(), return_inverse=True)
                for i, j in confirm(_sets_of(part.column(4)), asking, label, percent):
                    a.append(ids[i])
                    b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    n = shuffle_partitions(families.sparkSession)
    places = materialize(asking.unionByName(asked), "dealt")
    dealt = sets.join(small(places, 64), "class").select("cell", "side", "class", "part", "values")
    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(trimmed(run), LINKS)


def same_id_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows (doc_id, digest) that share an id."""
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    held = rows.join(several, "doc_id").distinct().join(classes.select("digest", "class"), "digest").select("doc_id", "class")
    return held.join(held.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").where("a <> class").select("a", F.col("class").alias("b"))


def grouped(docs: DataFrame, k: int, percent: int, recall: float = RECALL, key: str = "doc_id", text: str = "text", by_id: bool = True) -> DataFrame:
    """(doc_id, n_shingles, digest, component_id, first) of each row of docs; digest: of its set, null if that is empty.

    first: the row's set is the component's first, of the smallest id and then the smallest digest. by_id: classes that
    share an id are linked.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = materialize(sketches(docs, k, tree_count(percent / 100, recall)), "sketches")
    # One row for each class: equal sets have equal nodes and bits. Copies are joined before they are shuffled.
    fine = held.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    once = fine.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("roots").alias("roots"), F.any_value("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = materialize(once.withColumn("class", F.monotonically_increasing_id()), "classes")
    likely = materialize(likely_links(classes, percent), "likely")
    families = materialize(components(likely).select(F.col("id").alias("class"), F.col("root").alias("family")), "families")
    members = materialize(classes.join(families.select("class"), "class").select("class", "doc_id", "digest", "copies"), "members")
    sets = member_sets(docs, members, k)
    links = materialize(confirmed_likeliest(likely, sets, percent), "confirmed")
    more = materialize(confirmed_apart(families, components(links), sets, percent), "confirmed")
    links = links.unionByName(more)
    if by_id:
        links = links.unionByName(same_id_links(fine.select("doc_id", "digest"), classes))
    joined = classes.select("class", "doc_id", "digest").join(components(links).withColumnRenamed("id", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    tops = joined.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("top"))
    by_digest = joined.join(tops, "root").select("digest", F.col("top.doc_id").alias("component"), (F.col("top.digest") == F.col("digest")).alias("first"))
    out = held.join(by_digest, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "digest", component.alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, recall: float = RECALL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs."""
    found = grouped(docs, k, percent, recall, key, text).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
