"""Embedding near-dedup by a random-projection tree forest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartlight.llm.components import components
from cartlight.llm.scratch import Scratch

# Trees, distance from the cut up to which a vector goes to both sides, and vectors in a leaf at most. The projections
# of two unit vectors differ by about their distance, which is at most 0.32 for a cosine of 0.95.
TREES, MARGIN, LEAF = 6, 0.15, 400
# A node one side of which would keep more than this share is not split: its vectors lie too close together.
STUCK = 0.8
# Vectors that the upper splits are fitted on at most, and the fewest of them in a node that is split by them.
SAMPLE, LEAST = 16_384, 48


def _direction(tree: int, node: int, dims: int) -> np.ndarray:
    """The random projection of a node: a function of its place in the forest alone."""
    return np.random.default_rng([tree, node]).standard_normal(dims)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors by their length in double precision; scaled first so that no square over- or underflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _fit_forest(sample: np.ndarray, total: int) -> dict[tuple[int, int], float]:
    """(tree, node) -> cut: to the left up to MARGIN above it, to the right from MARGIN below. Children: 2k, 2k + 1."""
    cuts: dict[tuple[int, int], float] = {}
    share = total / max(len(sample), 1)
    for tree in range(TREES):
        todo = [(1, np.arange(len(sample)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) < LEAST or len(rows) * share <= LEAF:
                continue
            value = sample[rows] @ _direction(tree, node, sample.shape[1])
            cut = float(np.median(value))
            left, right = rows[value <= cut + MARGIN], rows[value >= cut - MARGIN]
            if max(len(left), len(right)) > STUCK * len(rows):
                continue
            cuts[tree, node] = cut
            todo += [(2 * node, left), (2 * node + 1, right)]
    return cuts


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def embedding_dedup(embeddings: DataFrame, least: float = 0.95, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: near duplicates by cosine similarity of ``least`` or more.

    Links are between different rows' vectors; n_links counts the linked rows, component_id is the smallest vec_id
    reachable, kept says that it is the row's own. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different dimensions with each other. Equal vectors are one class
    and linked without being compared. A row without vec_id has no component and is not kept, but equal vectors
    count it. Rows repeating a vec_id are compared like others; their links are counted row by row.

    A forest of random-projection trees splits near the median of a random projection; vectors near the cut go to both
    sides. The upper splits are fitted on a bounded sample (the SAMPLE classes of smallest hash), then every vector is
    routed; leaves still too large are split further at the median of all their vectors. Vectors are compared exactly
    within a leaf, so no false link is made, and the pairs of all trees are united. A leaf whose vectors lie so close
    together that a split would part none is compared in blocks of bounded size, each pair of blocks in a group of
    its own. Linked vectors are counted, so every linked pair of different vectors is formed once a tree.
    """
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark, "embedding-dedup")
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = scratch.keep(rows.withColumn("digest", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("v")), 256))), "rows")
    classes = scratch.keep(
        rows.filter("usable").groupBy("digest").agg(
            F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")
        ).withColumn("key", F.xxhash64("digest")), "classes",
    )

    links = None
    dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    for d in sorted(dims):  # one dimension as a rule
        own = classes.filter(F.size("v") == d) if len(dims) > 1 else classes
        found = _linked(scratch, own.select("key", "v"), least, d)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = spark.createDataFrame([], "a bigint, b bigint")

    names = classes.select("key", "digest", "class_id", "n")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(names.select(F.col("key").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    comp = components(scratch, links)
    low = names.join(comp, names.key == comp.node, "left").withColumn("part", F.coalesce("component", "key"))
    least_id = low.groupBy("part").agg(F.min("class_id").alias("component_id"))
    per_class = low.join(least_id, "part").join(degree, low.key == degree.a, "left").select(
        "digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")
    )
    joined = rows.select("vec_id", "digest").join(per_class, "digest", "left")
    own = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )


def _linked(scratch: Scratch, classes: DataFrame, least: float, dims: int) -> DataFrame:
    """(a, b) of the classes (key, v) whose vectors are found to link, a < b."""
    spark = classes.sparkSession
    total = classes.count()
    drawn = classes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toPandas()
    cuts = spark.sparkContext.broadcast(_fit_forest(_unit(np.array(drawn["v"].tolist())), total))

    def route(batches):
        known = cuts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, unit = batch.column(0), _unit(_matrix(batch.column(1)))
            for tree in range(TREES):
                todo = [(1, np.arange(len(unit)))]
                at_rows, at_nodes = [], []
                while todo:
                    node, own = todo.pop()
                    cut = known.get((tree, node))
                    if cut is None:
                        at_rows.append(own)
                        at_nodes.append(np.full(len(own), node))
                    else:
                        value = unit[own] @ _direction(tree, node, dims)
                        todo += [(2 * node, own[value <= cut + MARGIN]), (2 * node + 1, own[value >= cut - MARGIN])]
                take, node = np.concatenate(at_rows), np.concatenate(at_nodes)
                yield _placed(keys.take(pa.array(take)), np.full(len(take), tree), node, unit[take])

    kind = "key bigint, tree int, node bigint, u array<double>"
    placed = scratch.keep(classes.mapInArrow(route, kind), "leaves")
    links = []
    while True:
        sizes = placed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
        large = scratch.keep(sizes.filter(F.col("n") > LEAF), "large")
        small = placed.join(large, ["tree", "node"], "left_anti")
        links.append(_compared(scratch, small.withColumn("block", F.lit(0)), least))
        if large.isEmpty():
            break
        inside = placed.join(large, ["tree", "node"])
        placed, stuck = _split_further(scratch, inside, dims)
        links.append(_compared_in_blocks(scratch, stuck, least))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return scratch.keep(found.distinct(), "links")


def _placed(keys, trees, nodes, unit) -> pa.RecordBatch:
    flat = pa.array(unit.ravel())
    ends = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(trees.astype(np.int32)), pa.array(nodes.astype(np.int64)), pa.ListArray.from_arrays(ends, flat)],
        ["key", "tree", "node", "u"],
    )


def _split_further(scratch: Scratch, inside: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """One more split of every large leaf, at the median projection of all its vectors; and the leaves that are stuck."""

    def project(batches):
        for batch in batches:
            unit = _matrix(batch.column("u"))
            trees, nodes = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            value = np.empty(batch.num_rows)
            for tree, node in set(zip(trees.tolist(), nodes.tolist())):
                own = (trees == tree) & (nodes == node)
                value[own] = unit[own] @ _direction(tree, node, dims)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], [*batch.schema.names, "value"])

    valued = scratch.keep(
        inside.select("key", "tree", "node", "u", "n").mapInArrow(
            project, "key bigint, tree int, node bigint, u array<double>, n bigint, value double"
        ), "projected",
    )
    cut = valued.groupBy("tree", "node").agg(F.percentile_approx("value", 0.5, 1000).alias("cut"))
    left, right = F.col("value") <= F.col("cut") + MARGIN, F.col("value") >= F.col("cut") - MARGIN
    sides = valued.join(cut, ["tree", "node"]).groupBy("tree", "node", "n", "cut").agg(
        F.greatest(F.count_if(left), F.count_if(right)).alias("kept")
    )
    sides = scratch.keep(sides.withColumn("stuck", F.col("kept") > STUCK * F.col("n")).drop("n", "kept"), "cuts")
    judged = valued.join(sides, ["tree", "node"])
    side = F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1)))
    split = judged.filter("not stuck").select("key", "tree", "node", "u", F.explode(side).alias("side"))
    placed = scratch.keep(
        split.filter("side is not null").select("key", "tree", (F.col("node") * 2 + F.col("side")).alias("node"), "u"),
        "split",
    )
    return placed, judged.filter("stuck").select("key", "tree", "node", "u", "n")


def _pairs(key_a, unit_a, key_b, unit_b, least: float):
    """Pairs of two blocks with cosine of at least ``least``, a strip of rows at a time."""
    for at in range(0, len(unit_a), 512):
        i, j = np.nonzero(unit_a[at : at + 512] @ unit_b.T >= least - 1e-9)
        exact = np.einsum("ij,ij->i", unit_a[at + i], unit_b[j]) >= least
        a, b = key_a[at + i[exact]], key_b[j[exact]]
        yield np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]


def _compared(scratch: Scratch, leaves: DataFrame, least: float) -> DataFrame:
    """All pairs within each (tree, node, block); side 1 is compared with side 0 if the block has both."""

    def compare(table: pa.Table) -> pa.Table:
        keys, unit = table.column("key").to_numpy(), _matrix(table.column("u").combine_chunks())
        if "side" in table.schema.names:
            side = table.column("side").to_numpy() == 1
            found = list(_pairs(keys[~side], unit[~side], keys[side], unit[side], least))
        else:
            found = list(_pairs(keys, unit, keys, unit, least))
        a = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
        both = np.unique(np.c_[a, b], axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    made = leaves.groupBy("tree", "node", "block").applyInArrow(compare, "a bigint, b bigint")
    return scratch.keep(made.distinct(), "pairs")


def _compared_in_blocks(scratch: Scratch, stuck: DataFrame, least: float) -> DataFrame:
    """Leaves that will not shrink: every pair of blocks of about LEAF vectors is compared on its own."""
    cut = stuck.withColumn("parts", F.ceil(F.col("n") / LEAF).cast("bigint"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), "parts"))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        (F.least("part", k) * F.col("parts") + F.greatest("part", k)).alias("block"),
        F.when(F.col("part") > k, 1).otherwise(0).alias("side"), (F.col("part") == k).alias("alone"),
    ))
    sent = cut.select("key", "tree", "node", "u", F.explode(every).alias("e")).select("key", "tree", "node", "u", "e.*")
    apart = _compared(scratch, sent.filter("not alone").drop("alone"), least)
    return apart.unionByName(_compared(scratch, sent.filter("alone").drop("alone", "side"), least))
