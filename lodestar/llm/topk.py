"""Exact top-k inner products over vectors sorted by length.

Vectors are put in order of descending length and packed into blocks; queries
are packed into blocks of their own. A query's k-th best score among the
longest vectors is a first bound. A pair of blocks is met only if
Cauchy-Schwarz (|q| times the block's greatest length) can reach a bound. Inside
a pair, both sides are rotated by the singular vectors of all vectors, so that
the first coordinates hold most of the product; what the partial sum and the
product of the residual lengths cannot bring to the bound is dropped before the
exact integer product is taken. Bounds get a margin for rounding; the scores
themselves are exact integers.

Defined cases: components are floor(scale * x), x as double; vectors that are
null or hold null or non-finite components take no part; vectors of another
length (number of components) than the query's are no candidates of it; ties go
to the smaller id; rows that repeat an id are candidates each, but not of a
query with that id; a query with fewer than k candidates gets them all; an empty
table gives an empty table; scores beyond a long are an error; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import persist

#: Rows of a block of vectors and of a block of queries.
VECTORS, QUERIES = 8192, 1024
#: Longest vectors that give the first bounds.
HEAD = 2048
#: Vectors looked at before the bounds are raised.
STEP = 1024


def quantized(table: DataFrame, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, ints (array of long), n2 (squared length as double)."""
    ints = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    kept = table.filter(F.col("vec_id").isNotNull() & good).select("vec_id", ints.alias("ints"))
    return kept.withColumn("n2", F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int64).reshape(rows, -1)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to size rows that follow each other: dim, n, ids, ints (both
    as bytes), longest (greatest length in the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors, n2 = zip(*held.pop(dim))
            return pa.RecordBatch.from_pydict({
                "dim": [dim], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()],
                "ints": [np.array(vectors, np.int64).tobytes()], "longest": [float(np.sqrt(max(n2)))],
            })

        for batch in batches:
            for row in zip(batch.column("vec_id").to_pylist(), batch.column("ints").to_pylist(), batch.column("n2").to_pylist()):
                held.setdefault(len(row[1]), []).append(row)
                if len(held[len(row[1])]) == size:
                    yield block(len(row[1]))
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, "dim long, n long, ids binary, ints binary, longest double")


def _rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all vectors of this many components, from
    their Gram matrix: one dim x dim matrix per task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for batch in batches:
            flat = batch.column("ints").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(-1, dim)
            gram += rows.T @ rows
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "row": list(gram)})

    if not dim:
        return np.zeros((0, 0))
    sums = vectors.filter(F.size("ints") == dim).select("ints").mapInArrow(run, "i int, row array<double>")
    summed = sums.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    gram = np.zeros((dim, dim))
    gram[summed["i"], summed["j"]] = summed["x"]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query: higher score, then smaller id."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer products; objects where 64 bits might not do."""
    if a.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2.0**62:
        products = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)]
        if any(abs(x) >= 2**63 for x in products):
            raise OverflowError("an inner product does not fit a long")
        return np.array(products, np.int64)
    return np.einsum("ij,ij->i", a, b)


def search_blocks(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, bound: np.ndarray, rotation: np.ndarray, k: int):
    """query index, score, id: the k best of c for each query among those that
    reach its bound. c is in order of descending length."""
    dim = q.shape[1]
    head = max(1, dim // 4)
    qr, bound = q.astype(np.float64) @ rotation, bound.copy()
    q_long, q_rest = np.sqrt((qr**2).sum(1)), np.sqrt((qr[:, head:] ** 2).sum(1))
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for start in range(0, len(c), STEP):
        part, ids = c[start : start + STEP], cids[start : start + STEP]
        cr = part.astype(np.float64) @ rotation
        c_long, c_rest = np.sqrt((cr**2).sum(1)), np.sqrt((cr[:, head:] ** 2).sum(1))
        margin = 1e-9 * q_long * (c_long.max() + 1) + 1e-6
        live = np.flatnonzero(q_long * c_long.max() + margin >= bound)
        if not len(live):
            continue
        reach = qr[live, :head] @ cr[:, :head].T + np.outer(q_rest[live], c_rest)
        at, of = np.nonzero((reach + margin[live, None] >= bound[live, None]) & (qids[live, None] != ids))
        at = live[at]
        scores = np.concatenate([_exact(q[at[i : i + 500_000]], part[of[i : i + 500_000]]) for i in range(0, max(1, len(at)), 500_000)])
        fits = scores >= bound[at]
        found = _best(*(np.concatenate(x) for x in zip(found, (at[fits], scores[fits], ids[of[fits]]))), k)
        counts = np.bincount(found[0], minlength=len(q))
        full = np.flatnonzero(counts >= k)
        last = np.cumsum(counts) - 1
        bound[full] = np.maximum(bound[full], found[1][last[full]])
    return found


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, the k
    highest inner products with the other rows."""
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors = persist(quantized(table.select("vec_id", vector), scale, vector), "vectors")
    asked = vectors.filter(is_query)
    dims = [r.dim for r in vectors.select(F.size("ints").alias("dim")).distinct().collect()]
    rotations = {dim: _rotation(vectors, dim) for dim in dims}
    longest: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in dims:
        rows = vectors.filter(F.size("ints") == dim).orderBy(F.desc("n2"), "vec_id").limit(HEAD).collect()
        longest[dim] = np.array([r.ints for r in rows], np.int64).reshape(len(rows), dim), np.array([r.vec_id for r in rows], np.int64)
    shared = spark.sparkContext.broadcast((rotations, longest))  # bounded: dim x dim and HEAD x dim

    def first_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations, longest = shared.value
        for batch in batches:
            made = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            made["bounds"], made["least"] = [], []
            for dim, n, ids, ints in zip(made["dim"], made["n"], made["ids"], made["ints"]):
                q, qids = _matrix(ints, n), np.frombuffer(ids, np.int64)
                query, score, _ = search_blocks(q, qids, *longest[dim], np.full(n, -np.inf), rotations[dim], k)
                counts = np.bincount(query, minlength=n)
                bound = np.full(n, -np.inf)
                full = np.flatnonzero(counts >= k)
                bound[full] = score[(np.cumsum(counts) - 1)[full]]
                length = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                made["bounds"].append(bound.tobytes())
                made["least"].append(float(np.min(np.where((length > 0) & (bound > 0), bound / np.maximum(length, 1e-300), -np.inf))))
            yield pa.RecordBatch.from_pydict(made)

    query_blocks = _packed(asked.repartition(max(1, parts // 4), "vec_id"), QUERIES).mapInArrow(
        first_bounds, "dim long, n long, ids binary, ints binary, longest double, bounds binary, least double"
    )
    query_blocks = persist(query_blocks.withColumn("block", F.monotonically_increasing_id()), "queries")
    in_order = vectors.repartitionByRange(parts, F.desc("n2"), F.xxhash64("vec_id")).sortWithinPartitions(F.desc("n2"), "vec_id")
    vector_blocks = persist(_packed(in_order, VECTORS), "blocks")
    # blocks of queries (a stated set) meet blocks of vectors: which ones is decided on numbers alone
    needed = F.broadcast(query_blocks.select("block", "least", F.col("dim").alias("query_dim"))) if query_blocks.limit(100_001).count() <= 100_000 else query_blocks.select("block", "least", F.col("dim").alias("query_dim"))
    pairs = vector_blocks.join(
        needed, (F.col("dim") == F.col("query_dim")) & (F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("least"))
    ).select("block", F.col("n").alias("vn"), F.col("ids").alias("vids"), F.col("ints").alias("vints"))
    met = pairs.join(query_blocks, "block").repartition(max(parts, 1), "block", F.xxhash64("vids"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations = shared.value[0]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("dim", "n", "ids", "ints", "bounds", "vn", "vids", "vints")]
            for dim, n, ids, ints, bounds, vn, vids, vints in zip(*columns):
                qids = np.frombuffer(ids, np.int64)
                query, score, found = search_blocks(
                    _matrix(ints, n), qids, _matrix(vints, vn), np.frombuffer(vids, np.int64), np.frombuffer(bounds), rotations[dim], k
                )
                yield pa.RecordBatch.from_pandas(pd.DataFrame({"query_id": qids[query], "vec_id": found, "score": score}), preserve_index=False)

    scored = met.mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
