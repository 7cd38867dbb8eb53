"""MinHash near-dedup by an LSH forest.

A text's set holds its distinct shingles (``words`` words each, A-Z lower-cased).
Texts with the same set become one class. Each class gets ``TREES * DEPTH``
min-hashes; a tree orders all classes by its own sequence of them. Neighbours
whose longest common prefix reaches the region's depth are candidates; where a
region is dense, its depth grows until it is small, so common passages do not
flood it. In a region that is dense at full depth rows also meet the leaders of
the region (rows that no earlier leader resembles). Rows at the borders of tasks
meet in a second pass, so the order has no gaps. Candidates form clusters; the
sets of a cluster meet, and links are confirmed on the full sets:
100 * intersection >= threshold * union.

A cluster is compared in blocks of at most BLOCK sets and BLOCK_BYTES, all pairs
of a block by one matrix product over its shingles. Large clusters (a group of
near copies may hold a third of all rows) are first split into blocks, then the
members that are not yet in the cluster's largest component are compared with
all others, tile by tile; a tile yields the links of a spanning forest at most.

Shingles are compared by 64-bit hashes. Outside dense regions the forest finds a
pair of similarity s with probability 1 - (1 - s**depth)**TREES, and the least
depth follows from the threshold: 6 at 85 (about 0.9995), 4 at 80 (0.9998). In a
region that is dense at each smaller depth it is DEPTH = 8: 0.993 at 85.

Defined results: a null text or one without words has the empty set and is
linked with nothing; with fewer words than a shingle has, the whole sequence is
the one shingle; equal sets are linked, also those of ties in size; doc_id is an
integer key (another type is an error); rows that repeat one share its component
and are decided alike; rows without doc_id are linked with nothing: their
component is null, and they are kept; an empty table gives no rows; whole texts
are read; further columns are ignored, whatever their names, and kept by
``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import Forest, components
from ._shared import WordHashes, lookup_join, lower_words, materialize, maybe_broadcast, mix, read_table, release_since, spread_join, trimmed, written

WORDS, THRESHOLD = 5, 85
TREES, DEPTH, MIN_DEPTH = 16, 8, 6
HASHES = 96
#: Neighbours looked at on each side, members of a region before its depth grows.
NEIGHBOURS, REGION = 6, 48
#: A candidate's estimate may fall this far below the threshold (4 standard errors).
SLACK = 0.16
#: Sets, and bytes of sets, of a block whose pairs one task compares; shingles of a matrix product.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 48_000_000, 16_384
#: Rows of a sorted order that a task holds at once; it cuts between regions where it can.
HELD = 100_000

_rng = np.random.default_rng(20_240_229)
MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
ADDENDS = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
PLACES = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
#: Least probability that a pair at the threshold becomes a candidate outside dense regions.
RECALL = 0.999


def least_depth(threshold: int) -> int:
    """The largest depth, MIN_DEPTH at most, at which the forest still has RECALL."""
    found = (d for d in range(MIN_DEPTH, 1, -1) if 1 - (1 - (threshold / 100) ** d) ** TREES >= RECALL)
    return next(found, 1)


def orders(depth: int) -> list[list[int]]:
    """Tree t reads the hashes from t * depth on: the first ``depth`` of each tree are its own."""
    return [[(t * depth + i) % HASHES for i in range(DEPTH)] for t in range(TREES)]


def shingles(text: str | None, memo: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = memo.of(lower_words(text))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(words, len(h))))
    for i in range(min(words, len(h))):
        out = mix(out ^ h[i : i + n]) * PLACES[i]
    return np.unique(mix(out))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 32-bit minima per set."""
    out = np.empty((len(sets), HASHES), np.uint32)
    step = 2_000_000
    lo = 0
    while lo < len(sets):
        hi, n = lo, 0
        while hi < len(sets) and (hi == lo or n + len(sets[hi]) <= step):
            n += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k in range(HASHES):
            out[lo:hi, k] = np.minimum.reduceat((flat * MULTIPLIERS[k] + ADDENDS[k]) >> np.uint64(32), starts).astype(np.uint32)
        lo = hi
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, print (of the whole set), sketch (low 16 bits of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            sets = [shingles(t.as_py(), memo, words) for t in batch.column("text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch: list[bytes | None] = [None] * len(sets)
            named = batch.column("doc_id").is_valid().to_pylist()
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) and ok else None for s, ok in zip(sets, named)]
            if full:
                for i, row in zip(full, min_hashes([sets[i] for i in full]).astype(">u2")):
                    sketch[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "print", "sketch"])

    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("near-dedup needs an integer doc_id")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(run), "doc_id long, n_shingles long, print binary, sketch binary")


def forest_edges(classes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Candidate pairs (a, b) of class ids: neighbours in one of the sorted orders."""
    of_tree = orders(least_depth(threshold))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), ">u2").reshape(n, HASHES)
            low = np.ascontiguousarray(sketch.astype(np.uint8))
            flat = pa.array([x.tobytes() for x in low], pa.binary())
            for t, order in enumerate(of_tree):
                keys = np.ascontiguousarray(sketch[:, order])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array([x.tobytes() for x in keys], pa.binary()), batch.column("rep"), flat], ["tree", "key", "rep", "low"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        border: list[tuple] = []  # the first and the last rows of the task

        def rows_of(batch: pa.RecordBatch) -> tuple:
            n = batch.num_rows
            key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(n, DEPTH)
            low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(n, HASHES)
            return batch.column("tree").to_numpy(zero_copy_only=False), key, low, batch.column("rep").to_numpy()

        for batch in batches:
            if not batch.num_rows:
                continue
            new = rows_of(batch)
            if not border:
                border.append(tuple(x[:NEIGHBOURS] for x in new))
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            if len(held[0]) >= HELD:
                starts = np.flatnonzero(prefixes(held[0], held[1]) < least) + 1
                cut = int(starts[-1]) if len(starts) else len(held[0])
                neighbours(*(x[:cut] for x in held), threshold, forest)
                held = tuple(x[cut if len(starts) else cut - NEIGHBOURS :] for x in held)
        if held is not None:
            neighbours(*held, threshold, forest)
            border.append(tuple(x[-NEIGHBOURS:] for x in held))
            tree, key, low, rep = (np.concatenate(x) for x in zip(*border))
            yield edges_and(forest, tree, key, low, rep)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows at the borders of tasks, in order again: few, whatever the input."""
        for out in link(batches):
            yield out.select(["a", "b"]).filter(out.column("a").is_valid())

    least = least_depth(threshold)
    rows = classes.select("rep", "sketch").mapInArrow(trimmed(grow), "tree int, key binary, rep long, low binary")
    linked = rows.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep").mapInArrow(trimmed(link), "a long, b long, tree int, key binary, rep long, low binary")
    linked = materialize(linked, "forest")
    borders = linked.filter("a is null").select("tree", "key", "rep", "low").repartition("tree").sortWithinPartitions("tree", "key", "rep").mapInArrow(meet, "a long, b long")
    return linked.filter("a is not null").select("a", "b").union(borders)


def edges_and(forest: Forest, tree: np.ndarray, key: np.ndarray, low: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Stars of ``forest`` as rows (a, b), then sorted rows of an order (a and b null)."""
    stars = np.array(forest.stars(), np.int64).reshape(-1, 2)
    n, m = len(stars), len(rep)
    pad = lambda values, kind: pa.array([None] * n + values, kind)
    ends = [pa.array(stars[:, i].tolist() + [None] * m, pa.int64()) for i in (0, 1)]
    rest = [pad(tree.tolist(), pa.int32()), pad([x.tobytes() for x in key], pa.binary()), pad(rep.tolist(), pa.int64()), pad([x.tobytes() for x in low], pa.binary())]
    return pa.RecordBatch.from_arrays([*ends, *rest], ["a", "b", "tree", "key", "rep", "low"])


def prefixes(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Longest common prefix of each sorted row with the one before."""
    equal = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.where(equal.all(1), DEPTH, equal.argmin(1))


def estimates(same: np.ndarray) -> np.ndarray:
    return (same - 1 / 256) / (1 - 1 / 256)


def neighbours(tree: np.ndarray, key: np.ndarray, low: np.ndarray, rep: np.ndarray, threshold: int, forest: Forest) -> None:
    """Joins candidates among sorted rows: prefix long enough for the region, estimate near the threshold."""
    n = len(rep)
    if n < 2:
        return
    prefix, least, cut = prefixes(tree, key), least_depth(threshold), threshold / 100 - SLACK
    depth = np.full(n - 1, least)
    for d in range(least, DEPTH):  # a region that is too large at depth d asks for d + 1
        region = np.concatenate([[0], np.cumsum(prefix < d)])
        dense = np.bincount(region)[region] > REGION
        depth = np.where(dense[1:] & dense[:-1] & (prefix >= d), d + 1, depth)
    joined = prefix >= depth
    for k in range(1, NEIGHBOURS + 1):
        if k > 1:
            joined = joined[:-1] & (prefix[k - 1 :] >= depth[k - 1 :])
        at = np.nonzero(joined)[0]
        if not len(at):
            return
        alike = estimates((low[at] == low[at + k]).mean(1)) >= cut
        for i in at[alike]:
            forest.join(int(rep[i]), int(rep[i + k]))
    full = np.concatenate([[0], np.cumsum(prefix < DEPTH)])  # regions of one whole key
    first = np.flatnonzero(np.diff(full, prepend=-1))
    for a, b in zip(first, [*first[1:], n]):
        if b - a > 2 * NEIGHBOURS:
            _meet_leaders(low[a:b], rep[a:b], cut, forest)


def _meet_leaders(low: np.ndarray, rep: np.ndarray, cut: float, forest: Forest) -> None:
    """Each row meets the leaders before it until one resembles it; a row that none does is a leader."""
    left = np.arange(len(rep))
    while len(left) > 1:
        lead, left = left[0], left[1:]
        alike = estimates((low[left] == low[lead]).mean(1)) >= cut
        for i in left[alike].tolist():
            forest.join(int(rep[lead]), int(rep[i]))
        left = left[~alike]


def similar_pairs(sets: list[np.ndarray], probe: np.ndarray, threshold: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sorted distinct arrays with a probe among them and 100 * |a & b| >= threshold * |a | b|.

    The sizes of all intersections are one product of the 0/1 matrix of sets and
    shingles with its transpose, taken some columns at a time.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    found, column = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.bincount(column, minlength=len(found)) > 1  # a shingle of one set alone is in no intersection
    column, owner = (np.cumsum(held) - 1)[column][held[column]], owner[held[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.zeros((n, n), np.float64)
    for lo in range(0, int(held.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        part = np.zeros((n, min(COLUMNS, int(held.sum()) - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        shared += part @ part.T  # exact: counts stay below 2**24
    union = sizes[:, None] + sizes[None, :] - shared
    linked = (100 * shared >= threshold * union) & (probe[:, None] | probe[None, :])
    i, j = np.nonzero(np.triu(linked, 1))
    return zip(i.tolist(), j.tolist())


def confirm(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Confirmed links (a, b) within each ``grp`` that join components; rows have doc_id, component, probe and the set.

    Pairs of two non-probes are left out, and pairs already in one component.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, known, probe = pdf["doc_id"].to_numpy(), pdf["component"].to_numpy(), pdf["probe"].to_numpy(bool)
        forest, out = Forest(), []
        if len(pdf) > 1:
            for i, j in similar_pairs([np.frombuffer(s, np.uint64) for s in pdf["shingles"]], probe, threshold):
                if forest.join(int(known[i]), int(known[j])):
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return sets.groupBy("grp").applyInPandas(run, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """The full sets of cluster members: doc_id, cluster, blocks, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [shingles(t.as_py(), memo, words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cluster"), batch.column("blocks"), pa.array(found, pa.binary())], ["doc_id", "cluster", "blocks", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(maybe_broadcast(members), "doc_id").select("doc_id", "text", "cluster", "blocks")
    return rows.mapInArrow(trimmed(run), "doc_id long, cluster long, blocks long, shingles binary")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links).withColumnRenamed("id", "doc_id")
    return sets.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def link_classes(docs: DataFrame, classes: DataFrame, words: int, threshold: int) -> DataFrame:
    """Links (a, b) between class ids that connect what is similar."""
    members = materialize(components(forest_edges(classes, threshold)).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster")), "clusters")
    members = members.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles"), "doc_id")
    sizes = materialize(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles_all")), "cluster-sizes")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("shingles_all") / BLOCK_BYTES)).cast("long").alias("blocks")
    n_members = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    sized = lookup_join(members, sizes.select("cluster", blocks, "size"), ["cluster"], F.col("doc_id"), "size", n_members).select("doc_id", "cluster", "blocks")
    sets = materialize(_sets(docs, sized, words).dropDuplicates(["doc_id"]), "sets")

    def grouped(frame: DataFrame, *by) -> DataFrame:
        return frame.withColumn("grp", F.concat_ws(":", "cluster", *by))

    first = grouped(sets.withColumns({"component": F.col("doc_id"), "probe": F.lit(True)}), F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    links = materialize(confirm(first, threshold), "links")
    large = sets.filter("blocks > 1")
    n_large = large.count()
    if not n_large:
        return links
    # a few members of each component meet across blocks
    labelled = materialize(_labelled(large.drop("shingles"), links), "labels")
    hubs = labelled.groupBy("cluster", "component", "blocks").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.max_by("doc_id", F.xxhash64("doc_id")).alias("c"), F.count(F.lit(1)).alias("members"))
    hubs = hubs.select("cluster", "component", "blocks", "members", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("doc_id"))
    n_hubs = materialize(hubs.groupBy("cluster").agg(F.count(F.lit(1)).alias("hubs")), "hubs")
    dealt = lookup_join(hubs, n_hubs.select("cluster", F.col("hubs").alias("in_cluster"), "hubs"), ["cluster"], F.col("doc_id"), "hubs", 3 * n_large).select("doc_id", "component", F.ceil(F.col("in_cluster") / BLOCK).cast("long").alias("hub_blocks"), F.col("blocks").alias("_all"))
    hub_blocks = F.least(F.greatest("hub_blocks", F.lit(1)), F.col("_all"))  # as many bytes a block as in ``blocks``
    hub_rows = large.join(dealt, "doc_id").withColumn("probe", F.lit(True))
    more = materialize(confirm(grouped(hub_rows, F.pmod(F.xxhash64("component", F.lit(1)), hub_blocks)), threshold), "links")
    links = links.union(more)
    # who is not in a cluster's largest component meets all its other members, in tiles
    labelled2 = materialize(_labelled(large.drop("shingles"), links), "labels")
    counts = labelled2.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), F.max("n").alias("most"))
    open_ = materialize(largest.filter("total > most").withColumn("rows", F.col("total")), "open-clusters")
    if not open_.limit(1).count():
        return links
    split = lookup_join(labelled2.select("doc_id", "component", "cluster", "blocks"), open_, ["cluster"], F.col("doc_id"), "rows", n_large)
    split = materialize(split.filter("largest is not null").withColumn("probe", F.col("component") != F.col("largest")), "open-members")
    per_block = F.ceil(F.col("total") / F.col("blocks"))
    tiles_q = F.ceil((F.col("total") - F.col("most")) / per_block).cast("long")
    q, m = F.pmod(F.xxhash64("doc_id", F.lit(2)), tiles_q), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks"))
    ids = split.select("doc_id", "component", "probe", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), tiles_q - 1)).alias("q"), m.alias("m")).withColumn("probe", F.lit(False))
    asks = split.filter("probe").select("doc_id", "component", "probe", "cluster", q.alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("m"))
    tiles = asks.union(ids).groupBy("cluster", "q", "m", "doc_id").agg(F.first("component").alias("component"), F.max("probe").alias("probe"))
    rest = large.drop("cluster").join(tiles, "doc_id")
    last = materialize(confirm(grouped(rest, "q", "m"), threshold), "links")
    return links.union(last)


def near_dedup(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    prints = materialize(signatures(docs, words), "prints")
    full = prints.filter("print is not null")
    classes = materialize(full.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n")), "classes")
    before = written(docs.sparkSession)
    links = materialize(components(link_classes(docs, classes, words, threshold)), "components")
    release_since(docs.sparkSession, before, links)
    found = classes.join(links, F.col("rep") == F.col("id"), "left").select("print", F.coalesce("component", "rep").alias("component_id"), "n")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = spread_join(prints.select("doc_id", "n_shingles", "print"), found, ["print"], F.struct("doc_id", "n_shingles"), "n", total)
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents that near-dedup keeps, one of each component, with all their columns."""
    gone = near_dedup(docs, threshold=threshold).filter("not kept").select(F.col("doc_id").alias("_gone"), F.lit(0).cast("long").alias("_deal")).distinct()
    deal = F.when(docs["doc_id"].isNull(), F.xxhash64("text").bitwiseOR(F.lit(1))).otherwise(F.lit(0))  # rows without doc_id match nothing, and are dealt
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(0)) == F.col("_gone")) & (deal == F.col("_deal"))
    return docs.join(gone, match, "left_anti").select(*(docs[c] for c in docs.columns))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "documents"))
