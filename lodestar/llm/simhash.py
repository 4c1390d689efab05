"""SimHash near-duplicates found by BK-trees over sharded fingerprints.

A fingerprint has a bit set where over half of the hashes of a text's word
shingles have it set. Two 64-bit fingerprints that differ in at most r bits are
equal in one of r + 1 bands, so each band value is a shard; a shard's distinct
fingerprints form a BK-tree (children keyed by Hamming distance to the parent)
in which a search follows only edges within the radius. A shard above MAX_SHARD
is split again by bands of the bits that are not yet fixed, which keeps every
pair and ends at 2 ** 11 values, so a tree's size does not grow with the corpus.
Each shard gives a spanning forest of its links, not its pairs, and the forests
are joined by distributed connected components.

`classes` links by the fingerprint alone. `similar_classes` is for texts that
share most of their shingles: see there.

Defined cases: a null text is empty; a text without words has fingerprint 0 and
links like any other; fewer words than a shingle has: the whole sequence; ties
(exactly half) leave the bit unset; repeated rows share a class; a null id is
kept, and is a class's id only where the class has no other; an empty table
gives an empty table; columns named fingerprint or component_id are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import groups, persist
from lodestar.llm.components import components

MAX_SHARD = 2048
#: Bytes of sketches or shingles that a tree holds, about.
BLOCK_BYTES = 32_000_000
#: Shingles hashed at a time.
STEP = 200_000
#: Bytes of texts whose shingles are sent at a time.
STEP_BYTES = 4_000_000
#: Parts of the hash range in a sketch; bands of it, and values of a band.
BINS, BANDS, ROWS = 256, 16, 4
NOTHING = np.uint32(2**32 - 1)
#: Share of common shingles that links texts, by how much less the sketches' estimate
#: may be (four standard errors), and bits in which the fingerprints may differ.
LEAST_SIMILAR, SLACK, WIDE = 0.8, 0.1, 20


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of all words if there are fewer."""
    n = max(1, len(words) - size + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(words[i : i + size]), 42) for i in range(n)], np.uint64)


def majority(found: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for start in range(0, len(found), STEP):
        votes += np.unpackbits(found[start : start + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(found)).tobytes(), "big")


def fingerprint(words: list[bytes], size: int) -> int:
    return majority(hashes(words, size))


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (columns in keep, or all but fingerprint) with fingerprint, a long
    that holds the 64 bits."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "fingerprint"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.LongType())])
    source = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py().lower().split(), size) for x in batch.column("__raw")]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [values], names=[*keep, "fingerprint"])

    return source.mapInArrow(run, schema)


class BKTree:
    """Values with links to the root of their group among those inserted."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.parent = radius, [], [], []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def near(self, value: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            i = stack.pop()
            d = (self.values[i] ^ value).bit_count()
            if d <= self.radius:
                found.append(i)
            stack += [child for edge, child in self.children[i].items() if d - self.radius <= edge <= d + self.radius]
        return found

    def insert(self, value: int) -> None:
        new, near = len(self.values), self.near(value)
        i = 0
        while new:
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = new
                break
            i = self.children[i][d]
        self.values.append(value)
        self.children.append({})
        self.parent.append(new)
        for other in near:
            self.parent[self.root(new)] = self.root(other)


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    if len(values) == 2:
        return [(values[1], values[0])] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree = BKTree(radius)
    for value in values:
        tree.insert(value)
    return [(value, tree.values[r]) for i, value in enumerate(tree.values) if (r := tree.root(i)) != i]


def _shard_links(cells: DataFrame, radius: int) -> DataFrame:
    """Links u, v within each cell; a cell's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, values = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for key, value in zip(batch.column("cell").to_pylist(), batch.column("fp").to_pylist()):
                if key != cell:
                    if len(values) > 1:
                        out += _forest(values, radius)
                    cell, values = key, []
                values.append(value & 0xFFFFFFFFFFFFFFFF)
            yield _links(out)
        if len(values) > 1:
            yield _links(_forest(values, radius))

    def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        flat = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["u", "v"])

    return cells.repartition("cell").sortWithinPartitions("cell", "fp").select("cell", "fp").mapInArrow(run, "u long, v long")


def _split(free: list[int], parts: int) -> list[list[int]]:
    return [free[i * len(free) // parts : (i + 1) * len(free) // parts] for i in range(parts)]


def _bits(column, bits: list[int]):
    """These bits of the column (neighbours, highest first) as a number."""
    return F.shiftrightunsigned(column, bits[-1]).bitwiseAND(F.lit((1 << len(bits)) - 1))


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """u, v: a spanning forest per shard of all pairs within the radius. distinct: fp."""
    # a cell's path: the bands fixed so far, and their values
    level = distinct.select("fp", F.lit("").alias("cell"), F.lit(0).alias("path"))
    paths: dict[int, list[int]] = {0: list(range(63, -1, -1))}
    found = None
    while True:
        bands, following = [], {}
        for path, free in paths.items():
            for i, band in enumerate(_split(free, radius + 1)):
                code = path * (radius + 2) + i + 1
                following[code] = [b for b in free if b not in band]
                bands.append((path, code, band))
        # bands of one path are not neighbours after the first level, so a value is put together from runs
        choices = F.array(*[
            F.struct(F.lit(path).alias("was"), F.lit(code).alias("path"), _value(F.col("fp"), band).alias("value"))
            for path, code, band in bands
        ])
        cells = level.select("fp", "cell", F.col("path").alias("old"), F.explode(choices).alias("b")).filter("b.was = old").select(
            "fp", F.concat("cell", F.lit("/"), F.col("b.path"), F.lit(":"), F.col("b.value")).alias("cell"), F.col("b.path").alias("path")
        )
        cells = persist(cells, "cells")
        counts = cells.groupBy("cell").count().filter("count > 1")
        last = max(len(free) for free in following.values()) <= 11
        crowded = persist(counts.filter(f"count > {MAX_SHARD}").select("cell"), "crowded") if not last else None
        some = crowded is not None and bool(crowded.take(1))
        small = counts.filter(f"count <= {MAX_SHARD}") if some else counts
        part = _shard_links(cells.join(small.select("cell"), "cell", "left_semi"), radius)
        found = part if found is None else found.union(part)
        if not some:
            return found
        level = cells.join(crowded, "cell", "left_semi")
        used = [r.path for r in level.select("path").distinct().collect()]
        paths = {path: following[path] for path in used}


def _value(column, bits: list[int]):
    runs, start = [], 0
    for i in range(1, len(bits) + 1):
        if i == len(bits) or bits[i] != bits[i - 1] - 1:
            runs.append(bits[start:i])
            start = i
    value = F.lit(0).cast("long")
    for run in runs:
        value = F.shiftleft(value, len(run)).bitwiseOR(_bits(column, run))
    return value


def classes(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """doc_id, fingerprint (long), component_id: one row per document."""
    prints = persist(fingerprints(docs, size, keep=["doc_id"]), "prints")
    distinct = persist(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, F.col("fingerprint") == F.col("fp")).select("doc_id", "fingerprint", "component_id")


def deduplicate(docs: DataFrame, size: int = 5, least: float = LEAST_SIMILAR) -> DataFrame:
    """The documents whose id is their class's id: one of each class of
    documents linked by `least` similarity of their shingles. Where rows share
    that id, the first by text."""
    found = persist(similar_classes(docs.select("doc_id", "text"), size, least), "classes")
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    one = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")))
    if kept.filter("__n > 1").take(1):
        first = Window.partitionBy("doc_id").orderBy("text")
        one = one.withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    return one.drop("__id", "__n")


# Classes by similarity. Texts that share four fifths of their shingles may
# differ in a quarter of the fingerprint's bits, more than any band of them
# survives, so shards come from the shingles' least hashes instead.


def sketch(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least hash in each of BINS parts of the hash range (all ones where
    there is none), and the keys of the bands made of them."""
    part, value = (found >> np.uint64(56)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(BINS, NOTHING, np.uint32)
    np.minimum.at(least, part, value)
    coarse = least.reshape(BANDS * ROWS, -1).min(1)
    filled = np.flatnonzero(coarse != NOTHING)
    if not len(filled):
        return least, np.zeros(0, np.uint64)
    # an empty part takes the value of the next that is not
    after = filled[np.searchsorted(filled, np.arange(len(coarse))) % len(filled)]
    rows = coarse[after].reshape(BANDS, ROWS)
    return least, np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(rows)], np.uint64)


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, least, bands, nodes = [], [], [], []
            for x in batch.column("__raw"):
                found = hashes(x.as_py().lower().split(), size)
                each = np.unique(found)
                one, keys = sketch(each)
                nodes.append(node_of(each))
                prints.append(majority(found))
                least.append(one.tobytes())
                bands.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(least, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(np.array(nodes, np.uint64).view(np.int64)),
            ], names=["doc_id", "fp", "least", "bands", "node"])

    return source.mapInArrow(run, f"doc_id {kind}, fp long, least binary, bands array<long>, node long")


def node_of(each: np.ndarray) -> int:
    """One name for a set of shingles (their sorted hashes)."""
    return xxhash.xxh64_intdigest(each.tobytes(), 7)


def _shingles(docs: DataFrame, size: int) -> DataFrame:
    """node, item: the sorted hashes of each document's shingles."""
    source = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("__raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raws in groups(batch.column("__raw").to_pylist(), STEP_BYTES):
                sets = [np.unique(hashes(raw.lower().split(), size)) for raw in raws]
                nodes = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "item"])

    return source.mapInArrow(run, "node long, item binary")


class SimilarTree(BKTree):
    """A BK-tree whose links also need what comes with the values to be alike."""

    def __init__(self, radius: int, alike: Callable[[np.ndarray, np.ndarray], bool]):
        super().__init__(radius)
        self.alike, self.items = alike, []

    def insert_with(self, value: int, item: np.ndarray, link: bool = True) -> None:
        new = len(self.values)
        self.items.append(item)
        near, self.near = self.near(value) if link else [], lambda _: []
        self.insert(value)
        del self.near
        for other in near:
            a, b = self.root(new), self.root(other)
            if a != b and self.alike(item, self.items[other]):
                self.parent[a] = b


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal values among parts that either fills: an estimate of
    the share of common shingles, with a standard error of at most 1 / 32."""
    either = np.count_nonzero((a != NOTHING) | (b != NOTHING))
    return np.count_nonzero((a == b) & (a != NOTHING)) / either if either else 1.0


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The share of common values of two sorted sets; 0 where it must be under least."""
    few, many = sorted((len(a), len(b)))
    if few < least * many:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / (few + many - common) if many else 1.0


def _block_links(members: DataFrame, radius: int, alike: Callable[[np.ndarray, np.ndarray], bool], kind: type) -> DataFrame:
    """u, v: a spanning forest of each block's alike nodes. members: cell, block,
    fp, node, item. With columns root and probe: the probes' links to the block's
    nodes instead, one to each root other than the probe's."""
    probing = "probe" in members.columns
    columns = ["cell", "block", *(["probe", "root"] if probing else []), "fp", "node", "item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tree, nodes, roots = None, None, [], []

        def links() -> list[tuple[int, int]]:
            return [(nodes[i], nodes[r]) for i in range(len(nodes)) if (r := tree.root(i)) != i]

        def probed(value: int, item: np.ndarray, node: int, root: int) -> Iterator[tuple[int, int]]:
            met = {root}
            for other in tree.near(value):
                if roots[other] not in met and alike(item, tree.items[other]):
                    met.add(roots[other])
                    yield node, nodes[other]

        def table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.int64()), pa.array([v for _, v in pairs], pa.int64())], names=["u", "v"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                value, node, item = row[-3] & 0xFFFFFFFFFFFFFFFF, row[-2], np.frombuffer(row[-1], kind)
                if row[:2] != block:
                    if tree is not None and not probing:
                        out += links()
                    block, tree, nodes, roots = row[:2], SimilarTree(radius, alike), [], []
                if probing and row[2]:
                    out += probed(value, item, node, row[3])
                    continue
                tree.insert_with(value, item, link=not probing)
                nodes.append(node)
                if probing:
                    roots.append(row[3])
            if out:
                yield table(out)
        if tree is not None and not probing and (out := links()):
            yield table(out)

    order = ["cell", "block", *(["probe"] if probing else []), "fp", "node"]
    return members.select(*columns).repartition("cell", "block").sortWithinPartitions(*order).mapInArrow(run, "u long, v long")


def _similar_links(members: DataFrame, nodes: DataFrame, radius: int, alike: Callable[[np.ndarray, np.ndarray], bool], kind: type) -> DataFrame:
    """u, v: links that join all alike nodes of each cell. members: cell, node;
    nodes: node, fp, item (bytes of kind).

    A cell is dealt into blocks of about MAX_SHARD nodes and BLOCK_BYTES, whose
    pairs are compared in the block's tree. Pairs of different blocks are compared
    unless these links join them already: all nodes but those of the cell's
    largest class go to every block."""
    sized = nodes.select("node", F.length("item").alias("size"))
    cells = members.join(sized, "node").groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("size")).filter("n > 1")
    cells = cells.select("cell", F.ceil(F.greatest(F.col("n") / MAX_SHARD, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks"))
    cells = persist(cells, "cells")
    placed = members.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = _block_links(placed.join(nodes, "node"), radius, alike, kind)
    if not cells.filter("blocks > 1").take(1):
        return found
    found = persist(found, "links")
    roots = components(found).withColumnRenamed("node", "__node")
    crowded = placed.filter("blocks > 1").join(roots, F.col("node") == F.col("__node"), "left")
    crowded = persist(crowded.select("cell", "blocks", "block", "node", F.coalesce("root", "node").alias("root")), "crowded")
    largest = crowded.groupBy("cell", "root").count().groupBy("cell").agg(F.max(F.struct("count", "root")).alias("most")).select("cell", F.col("most.root").alias("__root"))
    apart = persist(crowded.join(largest, "cell").filter("root != __root").drop("__root"), "apart")
    probes = apart.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    held = crowded.join(apart.select("cell").distinct(), "cell", "left_semi").withColumn("probe", F.lit(False))
    return found.union(_block_links(held.unionByName(probes).join(nodes, "node"), radius, alike, kind))


def similar_classes(docs: DataFrame, size: int = 5, least: float = LEAST_SIMILAR, radius: int = WIDE) -> DataFrame:
    """doc_id, component_id: classes of documents linked by similarity. Nodes
    (distinct sets of shingles) meet in the shard of any band they share, however
    many nodes it has. In a shard, BK-trees find what is within the (wide) radius,
    and sketches propose groups, with SLACK. In a group, all nodes within the
    radius are compared by their whole sets of shingles, which decide."""
    made = persist(_sketches(docs, size), "sketches")
    nodes = persist(made.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.any_value("least").alias("item"), F.any_value("bands").alias("bands")), "nodes")
    met = nodes.select("node", F.explode(F.array_distinct("bands")).alias("cell"))
    proposed = _similar_links(met, nodes.select("node", "fp", "item"), radius, lambda a, b: similarity(a, b) >= least - SLACK, np.uint32)
    grouped = persist(components(proposed).select("node", F.col("root").alias("cell")), "groups")
    some = nodes.join(grouped.select("node"), "node", "left_semi").select("node", "fp", "first")
    wanted = some.select(F.col("first").alias("__id")).distinct()
    sets = _shingles(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"), size)
    sets = some.join(sets.groupBy("node").agg(F.any_value("item").alias("item")), "node").select("node", "fp", "item")
    linked = _similar_links(grouped, persist(sets, "shingles"), radius, lambda a, b: jaccard(a, b, least) >= least, np.uint64)
    roots = components(linked)
    rooted = nodes.select("node", "first").join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    rooted = rooted.select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id")
    return made.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
