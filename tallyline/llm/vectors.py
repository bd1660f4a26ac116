"""Near-duplicate embeddings by an epsilon grid order join.

Cosine 0.9 is a distance of sqrt(0.2) between unit vectors.  The leading principal directions are
taken from a bounded sample; they decide how much work can be skipped, never which links are found.
Vectors are sorted by their grid cells (of that width) on these directions and cut into numbered
blocks of about ``BLOCK_BYTES`` with the bounds of their coordinates; what the partitions of the sort
leave over is put together with its neighbours.  Intervals of blocks are then joined recursively: a
pair of intervals whose bounds lie farther apart than the radius is dropped, others go on as pairs
of their parts, each step being an equi-join on the parent.  What remains are pairs of blocks, which
are joined in the same way by tiles of ``TILE`` vectors, with cosines in double precision.

Equal vectors are one class with a weight.  A pair of blocks yields, per class, the summed weight of
its partners, and the links of a spanning forest only, so that a dense group is never expanded into
pairs and no link is lost.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without vec_id, link with nothing; only vectors of equal length are compared.  vec_id is taken to be
unique: links count rows, so that a repeated row links with its copy, and all rows of one vec_id lie
in one component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common
from tallyline.llm.components import components
from tallyline.llm.simhash import spanning

LIMIT = 0.9
#: Bytes of the vectors of a block, which travels as one row, and vectors of a tile, compared at once.
BLOCK_BYTES, TILE = 2 << 20, 512
#: Vectors from which the principal directions are taken, directions in the cell order, and directions
#: in the bounds of a block.
SAMPLE, CELLS, BOUNDS = 10_000, 6, 10
#: Parts of an interval in one step of the recursion, as bits.
STEP = 4
_CHUNK = ["part", "start", "size", "nodes", "weights", "vectors", "low", "high"]
_CHUNKS = (
    "part int, start long, size long, nodes binary, weights binary, vectors binary, low array<double>, high array<double>"
)


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def principal(sample: np.ndarray) -> np.ndarray:
    """Directions of unit vectors, the ones with most variance first."""
    if not len(sample):
        return np.zeros((sample.shape[1], 0))
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1]


def components_of(rows: pa.Array) -> np.ndarray:
    """The vectors of a list column as they are stored."""
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(float)
    # Scaled first, so that squares neither overflow nor vanish.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cell_order(coordinates: np.ndarray, radius: float) -> np.ndarray:
    """Sort key: cells of the radius' width, then cells of an eighth of it."""
    key = np.zeros(len(coordinates), np.int64)
    for width, bits in ((radius, 3), (radius / 8, 6)):
        cells = np.floor((coordinates[:, :CELLS] + 1) / width).astype(np.int64)
        for i in range(cells.shape[1]):
            key = (key << bits) | np.clip(cells[:, i], 0, (1 << bits) - 1)
    return key


def chunks(classes: DataFrame, axes: np.ndarray, radius: float, size: int) -> DataFrame:
    """The classes (node, weight, embedding) in cell order, at most ``size`` of one partition to a row."""
    sent = classes.sparkSession.sparkContext.broadcast(axes[:, :BOUNDS])
    names = ["node", "weight", "embedding"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key = cell_order(unit(components_of(batch.column(2))) @ sent.value, radius)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, waiting = 0, []

        def chunk(rows: pa.Table) -> pa.RecordBatch:
            vectors = components_of(rows.column("embedding").combine_chunks())
            near = unit(vectors) @ sent.value
            values = [
                TaskContext.get().partitionId(),
                start,
                rows.num_rows,
                rows.column("node").to_numpy().tobytes(),
                rows.column("weight").to_numpy().tobytes(),
                vectors.tobytes(),
                near.min(axis=0).tolist(),
                near.max(axis=0).tolist(),
            ]
            types = [pa.int32(), *[pa.int64()] * 2, *[pa.binary()] * 3, *[pa.list_(pa.float64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=_CHUNK)

        for batch in batches:
            waiting.append(batch)
            while sum(b.num_rows for b in waiting) >= size:
                rows = pa.Table.from_batches(waiting)
                yield chunk(rows.slice(0, size))
                waiting, start = rows.slice(size).to_batches(), start + size
        rows = pa.Table.from_batches(waiting) if waiting else None
        if rows is not None and rows.num_rows:
            yield chunk(rows)

    element = dict(classes.dtypes)["embedding"]
    placed = classes.select(*names).mapInArrow(keyed, f"key long, node long, weight long, embedding {element}")
    return placed.repartitionByRange("key", "node").sortWithinPartitions("key", "node").mapInArrow(cut, _CHUNKS)


def blocks(cut: DataFrame, size: int) -> DataFrame:
    """(rank, parts, l0, ..., h0, ...): chunks that begin in the same ``size`` vectors of the whole
    order, less than twice ``size`` vectors together.  The driver sees one count per partition."""
    spark = cut.sparkSession
    counts = sorted(tuple(r) for r in cut.groupBy("part").agg(F.sum("size")).collect())
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    begins = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "part int, before long")
    rank = F.floor((F.col("before") + F.col("start")) / size)
    at = [(f"{edge[0]}{i}", how(F.get(edge, F.lit(i)))) for edge, how in (("low", F.min), ("high", F.max)) for i in range(BOUNDS)]
    return (
        cut.join(begins, "part")
        .groupBy(rank.alias("rank"))
        .agg(
            F.array_sort(F.collect_list(F.struct("part", "start", "nodes", "weights", "vectors"))).alias("parts"),
            *[column.alias(name) for name, column in at],
        )
    )


def near_blocks(whole: DataFrame, radius: float, dims: int) -> DataFrame:
    """Pairs (a, b), a <= b, of ranks of blocks whose bounds do not lie apart."""
    last = whole.agg(F.max("rank")).first()[0]
    edges = [f"{edge}{i}" for edge in "lh" for i in range(dims)]
    levels = max(1, -(-int(last or 0).bit_length() // STEP))
    pairs = whole.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for level in range(levels - 1, -1, -1):
        part = F.shiftright("rank", STEP * level)
        boxes = whole.groupBy(part.alias("part")).agg(
            *[(F.min if e[0] == "l" else F.max)(e).alias(e) for e in edges]
        )

        def side(name: str, boxes: DataFrame = boxes) -> DataFrame:
            return boxes.select(
                F.shiftright("part", STEP).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in boxes.columns]
            )

        apart = F.lit(0.0)
        for i in range(dims):
            gap = F.greatest(F.lit(0.0), F.col(f"a_l{i}") - F.col(f"b_h{i}"), F.col(f"b_l{i}") - F.col(f"a_h{i}"))
            apart = apart + gap * gap
        pairs = (
            pairs.join(side("a"), "a")
            .join(side("b"), "b")
            .filter("a_part <= b_part")
            .filter(apart <= radius * radius + 1e-9)
            .select(F.col("a_part").alias("a"), F.col("b_part").alias("b"))
        )
    return pairs


class Block:
    """The vectors of a block in cell order, with the bounds of its tiles."""

    def __init__(self, parts: list[dict], kind: np.dtype, axes: np.ndarray):
        self.nodes = np.concatenate([np.frombuffer(p["nodes"], np.int64) for p in parts])
        self.weights = np.concatenate([np.frombuffer(p["weights"], np.int64) for p in parts])
        self.vectors = unit(np.concatenate([np.frombuffer(p["vectors"], kind) for p in parts]).reshape(self.nodes.size, -1))
        self.tiles = [slice(i, i + TILE) for i in range(0, self.nodes.size, TILE)]
        near = self.vectors @ axes
        self.low = [near[t].min(axis=0) for t in self.tiles]
        self.high = [near[t].max(axis=0) for t in self.tiles]


def joined_blocks(left: Block, right: Block, limit: float, radius: float) -> pa.RecordBatch:
    """Partner weights (node, n) and forest links (node, other) of one pair of blocks, which may be
    one block twice."""
    same = left is right
    nodes = left.nodes if same else np.concatenate([left.nodes, right.nodes])
    after = 0 if same else left.nodes.size
    counts, label = np.zeros(nodes.size, np.int64), np.arange(nodes.size)
    for i, a in enumerate(left.tiles):
        for j in range(i if same else 0, len(right.tiles)):
            gap = np.maximum(0, np.maximum(left.low[i] - right.high[j], right.low[j] - left.high[i]))
            if gap @ gap > radius * radius + 1e-9:
                continue
            b = right.tiles[j]
            x, y = np.nonzero(left.vectors[a] @ right.vectors[b].T >= limit)
            x, y = x + a.start, y + b.start
            np.add.at(counts, x, right.weights[y])
            if not (same and i == j):
                np.add.at(counts, y + after, left.weights[x])
            spanning(x, y + after, label)
    some, linked = np.flatnonzero(counts), np.flatnonzero(label != np.arange(nodes.size))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([nodes[some], nodes[linked]])),
            pa.concat_arrays([pa.nulls(some.size, pa.int64()), pa.array(nodes[label[linked]], pa.int64())]),
            pa.concat_arrays([pa.array(counts[some]), pa.nulls(linked.size, pa.int64())]),
        ],
        names=["node", "other", "n"],
    )


def found_links(whole: DataFrame, pairs: DataFrame, kind: np.dtype, axes: np.ndarray, limit: float, radius: float) -> DataFrame:
    """(node, other, n): with ``other`` a link, with ``n`` the weight of partners."""
    sent = whole.sparkSession.sparkContext.broadcast(axes[:, :BOUNDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                left = Block(row["a_parts"], kind, sent.value)
                right = left if row["a"] == row["b"] else Block(row["b_parts"], kind, sent.value)
                yield joined_blocks(left, right, limit, radius)

    # Pairs are few and costly: they are dealt out before the blocks join them.
    tasks = int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide = pairs.repartition(tasks, "a", "b")
    for name in ("a", "b"):
        wide = wide.join(whole.select(F.col("rank").alias(name), F.col("parts").alias(f"{name}_parts")), name)
    return wide.mapInArrow(run, "node long, other long, n long")


def near_duplicates(rows: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id) of every row of ``rows`` (vec_id, embedding)."""
    spark = rows.sparkSession
    radius = float(np.sqrt(2 - 2 * limit))
    good = rows.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = common.stored(
        good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")), "vector-classes"
    )
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    links = spark.createDataFrame([], "node long, other long, n long")
    for size in sizes:
        own = classes.filter(F.size("embedding") == size)
        some = common.sampled(own, F.col("node"), SAMPLE, own.count()).select("embedding").toArrow()
        kept = components_of(some.column(0).combine_chunks())
        axes = principal(unit(kept))
        rows_in_block = max(1, BLOCK_BYTES // (size * kept.dtype.itemsize))
        cut = common.stored(chunks(own, axes, radius, rows_in_block), "chunks")
        whole = common.stored(blocks(cut, rows_in_block), "blocks")
        pairs = near_blocks(whole, radius, min(BOUNDS, axes.shape[1]))
        links = links.unionByName(found_links(whole, pairs, kept.dtype, axes, limit, radius))
    links = common.stored(links, "vector-links")
    groups = components(links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.filter("n is not null").groupBy("node").agg((F.sum("n") - 1).alias("n_links"))
    placed = classes.join(counted, "node", "left").join(groups, "node", "left").select(
        F.col("embedding").alias("vector"), "n_links", F.coalesce("component", "node").alias("component")
    )
    usable_vector = F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding"))
    return (
        rows.select("vec_id", usable_vector.alias("vector"))
        .join(placed, "vector", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
    )


def op6_vector_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))

