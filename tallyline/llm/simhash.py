"""SimHash near-duplicates: fingerprints of word shingles, linked at a Hamming distance of at most 3.

Equal fingerprints are one class.  Two fingerprints within distance 3 agree in one of four 16-bit
bands, and, of the other 48 bits, in one of four 12-bit parts; each class is therefore dealt to
sixteen shards by 28 bits.  A shard's fingerprints form a BK-tree, whose children are keyed by their
integer distance to the parent, and a query follows only edges within the radius.  Trees of all
shards of a slice are built and searched together, level by level, in flat arrays.  Trees are not
broadcast as a whole, since their number grows with the documents: queries reach their trees by the
shuffle.  A shard of more than ``TREE_NODES`` classes is split into several trees, each of which sees
every query of the shard; the work is done in blocks and nothing is dropped.

From a shard come the links of a spanning forest only.  They connect the same fingerprints as all
links would, so copies are never expanded into pairs.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any
other; fewer than three words make one shingle.  Repeated rows and ties fall into one class, whose
component is its smallest doc_id.  Rows without a doc_id link like any other; their component is the
smallest doc_id of the group, and null if no row of it has one.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import common, places
from tallyline.llm.components import components

WIDTH = 3
RADIUS = 3
SEED = 42
#: Classes in one tree; larger shards get several trees.
TREE_NODES = 4_096
#: Tree positions looked at together in one search step.
FRONTIER = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    width = min(WIDTH, len(words))
    stops = ends[width - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    # Bits are counted in parts, of which 255 at most fit one byte a column.
    ones = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 8_192):
        bits = np.unpackbits(hashes[at : at + 8_192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > hashes.size, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, file: Column | None = None, row: Column | None = None) -> DataFrame:
    """(doc_id, fp, file, row) of every row, fp as a signed number of the same 64 bits; the place is null
    unless it is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), batch.column(2), batch.column(3)], names=["doc_id", "fp", "file", "row"]
            )

    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        (F.lit(None).cast("string") if file is None else file).alias("file"),
        (F.lit(None).cast("long") if row is None else row).alias("row"),
    )
    return rows.mapInArrow(run, "doc_id long, fp long, file string, row long")


def shard_keys(fp: Column) -> Column:
    """The sixteen (band, part) keys of a fingerprint, with 28 of its bits each."""
    keys = []
    for band in range(4):
        first = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << 16 * band) - 1)
        high = F.shiftrightunsigned(fp, 16 * (band + 1)) if band < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(F.shiftleft(high, 16 * band))
        for part in range(4):
            second = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(0xFFF)
            keys.append(
                F.lit((4 * band + part) << 28).cast("long").bitwiseOR(F.shiftleft(first, 12)).bitwiseOR(second)
            )
    return F.array(*keys)


class Forest:
    """BK-trees of several shards in flat arrays: node ``i`` holds ``values[i]``; its children stand
    next to each other, ordered by edge."""

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        """``shard`` is ascending; values within a shard differ."""
        n = values.size
        self.values = values
        roots = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root_of = dict(zip(shard[roots].tolist(), roots.tolist()))
        parent_of, edge_of = np.full(n, -1), np.zeros(n, np.int64)
        waiting = np.setdiff1d(np.arange(n), roots)
        above = roots[np.searchsorted(roots, waiting, side="right") - 1]
        while waiting.size:
            edge = np.bitwise_count(values[waiting] ^ values[above]).astype(np.int64)
            slot = above * 65 + edge
            _, first, inverse = np.unique(slot, return_index=True, return_inverse=True)
            child = waiting[first]
            parent_of[child], edge_of[child] = above[first], edge[first]
            above = child[inverse]
            stays = waiting != above
            waiting, above = waiting[stays], above[stays]
        nodes = np.flatnonzero(parent_of >= 0)
        order = np.lexsort((edge_of[nodes], parent_of[nodes]))
        self.children = nodes[order]
        self.slots = (parent_of * 65 + edge_of)[self.children]

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the query, node) within the radius, part by part."""
        stack = [(np.arange(queries.size), roots)]
        while stack:
            query, node = stack.pop()
            if query.size > FRONTIER:
                half = query.size // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            distance = np.bitwise_count(queries[query] ^ self.values[node]).astype(np.int64)
            near = distance <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.slots, node * 65 + np.maximum(distance - radius, 0), side="left")
            high = np.searchsorted(self.slots, node * 65 + np.minimum(distance + radius, 64), side="right")
            counts = high - low
            if counts.sum():
                stack.append((np.repeat(query, counts), common.gathered(self.children, low, counts)))


def spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Join the groups of ``label`` (each element's smallest member) along the links."""
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def shard_links(rows: pa.Table) -> pa.RecordBatch:
    """Links between the classes of whole shards; columns key, tree, query, fp, node of ``rows``."""
    key, tree, fp, node = (rows.column(c).to_numpy() for c in ("key", "tree", "fp", "node"))
    is_query = rows.column("query").to_numpy(zero_copy_only=False)
    shard = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (tree[1:] != tree[:-1])]) - 1
    values = fp.view(np.uint64)
    build, ask = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    if not build.size or not ask.size:
        return _links([], [])
    forest = Forest(shard[build], values[build])
    roots = np.array([forest.root_of.get(s, -1) for s in shard[ask].tolist()], np.int64)
    ask, roots = ask[roots >= 0], roots[roots >= 0]
    # A shard's query and tree entry of one fingerprint are one element.
    element = np.unique(np.stack([shard, fp], 1), axis=0, return_inverse=True)[1].ravel()
    label = np.arange(element.max() + 1)
    for query, found in forest.search(values[ask], roots, RADIUS):
        spanning(element[ask[query]], element[build[found]], label)
    holder = np.zeros(label.size, np.int64)
    holder[element] = node
    linked = np.flatnonzero(label != np.arange(label.size))
    return _links(holder[linked], holder[label[linked]])


def _links(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted shards; the last, perhaps incomplete shard of a batch waits for the next."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        key, tree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]) | (tree[1:] != tree[:-1])) + 1
        last = int(ends[-1]) if ends.size else 0
        if waiting and (waiting[-1]["key"][0].as_py(), waiting[-1]["tree"][0].as_py()) != (key[0], tree[0]):
            yield shard_links(pa.Table.from_batches(waiting))
            waiting = []
        if last:
            yield shard_links(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield shard_links(pa.Table.from_batches(waiting))


def class_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect classes (node, fp) of different fingerprints within the radius."""
    keyed = classes.select("node", "fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = keyed.join(sizes, "key").withColumn("trees", F.ceil(F.col("n") / TREE_NODES).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    build = shared.select("key", own.alias("tree"), F.lit(False).alias("query"), "fp", "node")
    ask = shared.select(
        "key",
        F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
        F.lit(True).alias("query"),
        "fp",
        "node",
    )
    dealt = build.unionByName(ask).repartition("key", "tree").sortWithinPartitions("key", "tree", "query", "fp")
    return dealt.mapInArrow(whole_shards, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    marked = common.stored(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    grouped = common.stored(fingerprint_groups(marked), "groups")
    smallest = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    placed = grouped.join(smallest, "component").select("fp", "component_id")
    return marked.join(placed, "fp")


def fingerprint_groups(marked: DataFrame) -> DataFrame:
    """(fp, id, component) of every fingerprint: its smallest doc_id, and the smallest fingerprint it
    reaches by links.  Fingerprints of rows without a doc_id link like any other."""
    classes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    groups = components(class_links(classes.select(F.col("fp").alias("node"), "fp")))
    placed = classes.join(groups, classes["fp"] == groups["node"], "left")
    return placed.select("fp", "id", F.coalesce("component", "fp").alias("component"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with the columns it came with.

    Groups are made of fingerprints, so rows without a doc_id are compared like any other, and rows
    that share a doc_id are in one group only if their texts are.  A row without a doc_id stays if no
    row of its group has one; of equal rows the first one in the table stays.

    Texts are read once for their fingerprints and once more for the rows that stay, and never shuffled:
    what is shuffled are fingerprints and places, and the places of the others are broadcast in rounds.
    """
    docs = places.placed(docs)
    marked = common.stored(fingerprints(docs, *places.place_of(docs)), "fingerprints")
    grouped = marked.join(fingerprint_groups(marked).select("fp", "component"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "file", "row")
    first = grouped.groupBy("component").agg(F.min(order).alias("first")).select("first.file", "first.row")
    dropped = marked.select("file", "row").join(first, ["file", "row"], "left_anti")
    return places.without(docs, common.stored(dropped, "dropped"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
