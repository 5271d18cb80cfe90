"""Approximate nearest neighbours: a forest of hash-prefix trees over sorted long hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnsearch.llm.common import join_hot, store

TREES = 12
BITS = 64
#: Levels of a tree whose counts the driver holds: so many that a node has about ``BLOCK`` vectors, within these bounds.
LEAST_BITS, MOST_BITS = 12, 18
BLOCK = 4096
CALIBRATION = 64
RECALL = 0.96
SEED = 20240607


def _planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TREES * BITS, size)).astype(np.float64)


def _hashes(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(vectors, trees) hash strings of 64 bits, as unsigned numbers whose order is that of the strings."""
    bits = (vectors @ planes.T >= 0).reshape(len(vectors), TREES, BITS)
    return np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64)


def _prefix(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits) if bits else np.zeros_like(hashes)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise cosine, added up in the same order wherever a pair is met."""
    return np.einsum("ij,ij->i", q, v) / (_norms(q) * _norms(v))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows that take part, as ``(id, vector)``, and their common length."""
    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = plain.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = [r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths")
    return rows, sizes[0] if sizes else 0


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _top_bits(total: int) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, total / BLOCK))))))


def _calibrate(rows: DataFrame, queries: DataFrame, planes: np.ndarray, k: int, top: int) -> tuple[int, np.ndarray]:
    """The number of candidates that reaches ``RECALL`` on a bounded sample of queries, and the trees' upper levels.

    The sampled queries are compared with every vector in one pass: their true neighbours, and how many vectors
    share each prefix length with them in each tree, added up by Spark.
    """
    size = planes.shape[1]
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION).toPandas()
    q = np.stack(sample["vector"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((0, size))
    q_ids, q_hash = sample["id"].to_numpy(dtype=np.int64), _hashes(q, planes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.zeros((TREES, 1 << top), dtype=np.int64)
        same = np.zeros((len(q), 65), dtype=np.int64)
        best: list[list[tuple[float, int, int]]] = [[] for _ in range(len(q))]
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                ids, v = part.column("id").to_numpy(), _matrix(part.column("vector"))
                h = _hashes(v, planes)
                for t in range(TREES):
                    upper[t] += np.bincount(_prefix(h[:, t], top).astype(np.int64), minlength=1 << top)
                score = (q / _norms(q)[:, None]) @ (v / _norms(v)[:, None]).T
                for i in range(len(q)):
                    common = _shared_bits(h ^ q_hash[i])
                    same[i] += np.bincount(common.ravel(), minlength=65)
                    ok = np.flatnonzero(ids != q_ids[i])
                    near = ok[_top(ids[ok], score[i, ok], k)]
                    best[i] = sorted([*best[i], *((-score[i, j], int(ids[j]), int(common[j].max())) for j in near)])[:k]
        kinds, a, b, n, score = [], [], [], [], []
        for t, p in zip(*np.nonzero(upper)):
            kinds.append(0), a.append(t), b.append(p), n.append(upper[t, p]), score.append(0.0)
        for i, c in zip(*np.nonzero(same)):
            kinds.append(1), a.append(i), b.append(c), n.append(same[i, c]), score.append(0.0)
        for i, found in enumerate(best):
            for s, j, c in found:
                kinds.append(2), a.append(i), b.append(j), n.append(c), score.append(-s)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), *[pa.array(np.array(x, dtype=np.int64)) for x in (a, b, n)], pa.array(score, pa.float64())],
            names=["kind", "a", "b", "n", "score"],
        )

    told = store(rows.mapInArrow(look, "kind int, a long, b long, n long, score double"), "ann-calibration")
    upper = np.zeros((TREES, 1 << top), dtype=np.int64)
    same = np.zeros((len(q), 65), dtype=np.int64)
    # a row per tree and node, at most TREES << MOST_BITS numbers, and 65 a sampled query
    counted = told.filter("kind < 2").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).toArrow()
    kind, a, b, n = (counted.column(c).to_numpy() for c in ("kind", "a", "b", "n"))
    upper[a[kind == 0], b[kind == 0]] = n[kind == 0]
    same[a[kind == 1], b[kind == 1]] = n[kind == 1]
    first = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    nearest = told.filter("kind = 2").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k).collect()
    at_least = np.cumsum(same[:, ::-1], axis=1)[:, ::-1]  # vectors, over all trees, that share so many bits at least
    total = int(upper.sum()) // TREES
    steps = [min(total * TREES, int(100 * 1.25**i)) for i in range(200)]
    for wanted in steps:
        depth = [_depth(at_least[i, : top + 1], wanted) for i in range(len(q))]
        found = [r["n"] >= depth[r["a"]] for r in nearest]
        if not found or np.mean(found) >= RECALL or wanted == total * TREES:
            return wanted, upper
    return total * TREES, upper


def _shared_bits(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64-bit numbers."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top = np.where(high > 0, 31 - np.floor(np.log2(np.maximum(high, 1))), 63 - np.floor(np.log2(np.maximum(low, 1))))
    return np.where(x == 0, 64, top).astype(np.int64)


def _depth(at_least: np.ndarray, wanted: int) -> int:
    """The longest shared prefix at which the trees together hold enough candidates; 0 holds everything."""
    enough = np.flatnonzero(at_least >= wanted)
    return int(enough[-1]) if len(enough) else 0


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
) -> DataFrame:
    """``(query_id, rank, id, score)``: for every row of ``queries`` its ``k`` nearest other rows of ``vectors`` by cosine.

    Each tree is the sorted array of its 64-bit hash strings (signs of products with fixed random planes), kept
    in blocks by prefix; a block above ``BLOCK`` vectors is split by id. A query descends all trees to its longest
    prefixes and climbs them in step, one bit at a time, until they hold enough candidates together; the counts of the
    trees' upper levels, more of them the more vectors there are, tell where to stop, so no candidate is cut off. It then
    visits the blocks under the prefixes it reached, where candidates are scored from the vectors stored with the
    hashes; only the best ``k`` of a block leave it. Queries stream past a block's vectors, and equal query vectors are
    searched once. How many candidates are enough is measured on up to ``CALIBRATION`` of the queries against all
    vectors, so that recall there is ``RECALL`` at least.

    Scores are in double precision; ties go to the smaller id. Null, zero and non-finite vectors take no part, nor do null
    ids; a query without enough other vectors returns fewer rows. Rows that repeat an id count once. Vectors of different
    lengths raise an error. Other columns are left out; an empty table gives an empty result.
    """
    rows, size = usable(vectors, id_col, vector_col)
    asked, _ = usable(queries, id_col, vector_col)
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if not size:
        return rows.sparkSession.createDataFrame([], schema)
    planes = _planes(size)
    top = _top_bits(rows.count())
    wanted, upper = _calibrate(rows, asked, planes, k, top)
    total = int(upper.sum()) // TREES
    bits = int(min(top, max(0, np.ceil(np.log2(max(1, total / BLOCK))))))
    counts = upper.reshape(TREES, 1 << bits, -1).sum(axis=2)
    parts = np.maximum(1, -(-counts // BLOCK))  # pieces of a block
    levels = [upper.reshape(TREES, 1 << d, -1).sum(axis=2) for d in range(top + 1)]
    firsts = np.concatenate([[0], np.cumsum(parts.ravel())])[:-1].reshape(parts.shape)  # number of a block's first piece

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids, h = part.column("id").to_numpy(), _hashes(_matrix(part.column("vector")), planes)
                for t in range(TREES):
                    block = _prefix(h[:, t], bits).astype(np.int64)
                    piece = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                    number = firsts[t, block] + piece % parts[t, block]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number), part.column("id"), pa.array(h[:, t].astype(np.int64)), part.column("vector")],
                        names=["block", "id", "hash", "vector"],
                    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                h = _hashes(_matrix(part.column("vector")), planes)
                row, number, depth_of, hash_of = [], [], [], []
                for i in range(len(h)):
                    held = np.array([sum(levels[d][t, int(_prefix(h[i, t], d))] for t in range(TREES)) for d in range(top + 1)])
                    depth = _depth(held, wanted)
                    for t in range(TREES if depth else 1):  # at the root, one tree has every vector
                        prefix = int(_prefix(h[i, t], min(depth, bits)))
                        low, high = prefix << (bits - min(depth, bits)), (prefix + 1) << (bits - min(depth, bits))
                        for block in range(low, high):
                            for piece in range(parts[t, block]):
                                row.append(i)
                                number.append(firsts[t, block] + piece)
                                depth_of.append(depth)
                                hash_of.append(h[i, t])
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(number, dtype=np.int64)),
                        part.column("id").take(take),
                        pa.array(np.array(hash_of, dtype=np.uint64).astype(np.int64)),
                        pa.array(depth_of, pa.int32()),
                        part.column("vector").take(take),
                    ],
                    names=["block", "query_id", "hash", "depth", "vector"],
                )

    # equal vectors ask once, for one neighbour more, which is what each of them leaves out as itself
    keys = [F.xxhash64(F.lit(seed), "vector").alias(f"v{seed}") for seed in (1, 2)]
    members = asked.select(F.col("id").alias("query_id"), *keys)
    groups = asked.select("id", "vector", *keys).groupBy("v1", "v2").agg(
        F.min("id").alias("id"), F.first("vector").alias("vector"), F.count("*").alias("n")
    )
    groups = store(groups, "ann-queries")
    kind = "array<float>" if _is_float(vectors, vector_col) else "array<double>"
    held = rows.mapInArrow(index, "block long, id long, hash long, vector array<double>").select(
        "block",
        F.lit(0).alias("side"),
        "id",
        "hash",
        F.lit(0).alias("depth"),
        F.col("vector").cast(kind).alias("vector"),
        F.lit(None).cast("array<double>").alias("asked"),
    )
    came = groups.select("id", "vector").mapInArrow(route, "block long, query_id long, hash long, depth int, vector array<double>")
    came = came.select(
        "block",
        F.lit(1).alias("side"),
        F.col("query_id").alias("id"),
        "hash",
        "depth",
        F.lit(None).cast(kind).alias("vector"),
        F.col("vector").alias("asked"),
    )
    meeting = held.unionByName(came).repartition("block").sortWithinPartitions("block", "side")
    found = meeting.mapInArrow(_visits(k + 1), "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = near.groupBy(F.col("query_id").alias("speaker")).agg(F.collect_list(F.struct("id", "score")).alias("near"))
    named = groups.select("v1", "v2", "n", F.col("id").alias("speaker")).join(lists, "speaker").drop("speaker")
    each = join_hot(members, named, ["v1", "v2"], "n", members.count()).select("query_id", F.explode("near").alias("hit"))
    each = each.select("query_id", "hit.id", "hit.score").filter(F.col("id") != F.col("query_id"))
    each = each.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _first_ids(ids: np.ndarray, v: np.ndarray, q: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` ids with the best cosines among the rows ``found``, each with its best one."""
    exact = cosines(np.broadcast_to(q, (len(found), len(q))), v[found])
    order = _top(ids[found], exact, len(found))
    _, first = np.unique(ids[found][order], return_index=True)
    chosen = order[np.sort(first)[:k]]
    return ids[found][chosen], exact[chosen]


def _visits(k: int):
    """Rows of a block in order, its vectors first: the best ``k`` of each query that follows them."""

    def best_of(hashes: np.ndarray, ids: np.ndarray, v: np.ndarray, unit: np.ndarray, came: pa.RecordBatch) -> list[tuple]:
        q = _matrix(came.column("asked"))
        scores = (q / _norms(q)[:, None]) @ unit.T
        asked = came.column("hash").to_numpy().astype(np.uint64)
        out = []
        for i, (query, h, depth) in enumerate(zip(came.column("id").to_pylist(), asked, came.column("depth").to_pylist())):
            low, high = 0, len(ids)
            if depth:
                mask = np.uint64((1 << (64 - depth)) - 1)
                low = int(np.searchsorted(hashes, h & ~mask, side="left"))
                high = int(np.searchsorted(hashes, h | mask, side="right"))
            every = np.arange(low, high)
            found = every
            if len(found) > k:
                # whatever ties with the k-th stays until it is scored exactly
                least = np.partition(scores[i, found], len(found) - k)[len(found) - k]
                found = found[scores[i, found] >= least - 1e-9]
            best, exact = _first_ids(ids, v, q[i], found, k)
            if len(best) < k and len(found) < len(every):  # rows that repeat an id took the places of others
                best, exact = _first_ids(ids, v, q[i], every, k)
            out.append((np.full(len(best), query), best, exact))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, held = None, [], None
        for batch in batches:
            blocks, sides = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            turns = np.flatnonzero((blocks[1:] != blocks[:-1]) | (sides[1:] != sides[:-1])) + 1
            edges = [0, *turns.tolist(), len(blocks)] if len(blocks) else []
            for start, stop in zip(edges, edges[1:]):
                if blocks[start] != at:
                    at, pieces, held = blocks[start], [], None
                part = batch.slice(start, stop - start)
                if sides[start] == 0:
                    pieces.append((part.column("hash").to_numpy().astype(np.uint64), part.column("id").to_numpy(), _matrix(part.column("vector"))))
                    continue
                if not pieces:
                    continue
                if held is None:
                    hashes, ids, v = (np.concatenate(x) for x in zip(*pieces))
                    order = np.argsort(hashes, kind="stable")
                    v = v[order]
                    held, pieces = (hashes[order], ids[order], v, v / _norms(v)[:, None]), [None]
                for first in range(0, part.num_rows, 256):
                    out = best_of(*held, part.slice(first, 256))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["query_id", "id", "score"]
                    )

    return run


def _is_float(vectors: DataFrame, vector_col: str) -> bool:
    return dict(vectors.dtypes)[vector_col] == "array<float>"


def search_fiftieths(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
