"""Nearest neighbours by inner product from randomly rotated one-bit codes (operator 9).

A vector is scaled to length 1, rotated by a fixed random rotation and kept as the signs of its D coordinates, packed
into bits, with two correction scalars: its length and c, the inner product of the rotated unit vector with its own
code (signs / sqrt(D)).  For a unit query q, <code, q> / c estimates the inner product without bias, and the error stays
within sqrt((1 - c^2) / c^2) * EPSILON / sqrt(D - 1) but for a probability that falls with exp(-EPSILON^2 / 2)
(the RaBitQ estimator).  A vector is reranked with its exact inner product if its upper bound reaches the k-th largest
lower bound, or the k-th exact score so far.  Nothing is sampled: every row has a code.

A query is rotated once and rounded to ``QUERY_BITS`` bits for each coordinate, as bit planes: the estimate is a sum of
popcounts of (code & plane), so that a candidate costs a few machine words until its bounds let it through to its vector.

Rows are encoded once, in blocks of ``DATA_BLOCK``, and staged; groups of at most ``GROUP_BLOCKS`` blocks are dealt to
tasks, which hold one group at a time and let all query blocks pass.  A task gives the k best of a query within its
group; one window merges the groups.  Of identical vectors only the k + 1 smallest ids can be among the k nearest of
anything; the others go before they are dealt out.

Every query meets every code: vectors without clusters (these are) leave nothing to skip at a recall of 0.9, so that
work grows with queries times rows, at a popcount for most pairs.

Results for odd input: vectors that are null, empty, zero or hold null or non-finite components take no part, neither as
queries nor as candidates; vectors of another dimension are no candidates; ties go to the smaller vec_id; rows with the
same id are all candidates of others but not of each other; rows with a null id take no part; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

EPSILON = 3.0
SEED = 7
DATA_BLOCK = 8192
QUERY_BLOCK = 512
#: Blocks of a group, at 70 MB for 64 dimensions; small tables make more groups, up to FEW.
GROUP_BLOCKS = 16
FEW = 48
QUERY_BITS = 6


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, c) of the rows."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ turn.T
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def _words(packed: np.ndarray) -> np.ndarray:
    """Packed bits as 64-bit words."""
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def planes(queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated queries in QUERY_BITS bits a coordinate: (bit planes by query and bit, least value, step, sum of coordinates)."""
    turned = queries @ turn.T
    least = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - least) / (2**QUERY_BITS - 1), 1e-300)
    whole = np.rint((turned - least[:, None]) / step[:, None]).astype(np.uint8)
    bits = [_words(np.packbits((whole >> j) & 1, axis=1)) for j in range(QUERY_BITS)]
    return np.stack(bits, axis=1), least, step, least * turned.shape[1] + step * whole.sum(axis=1)


def bounds(codes: np.ndarray, length: np.ndarray, c: np.ndarray, queries: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries (rows) and coded vectors (columns), from packed bits."""
    dim = queries.shape[1]
    code = _words(codes)
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.float32)
    scale = (length / c / np.sqrt(dim)).astype(np.float32)
    spread = (np.sqrt(np.maximum(1 - c * c, 0)) / c * (epsilon / np.sqrt(max(dim - 1, 1))) * length + 1e-5 * length).astype(np.float32)
    estimate, slack = np.empty((2, len(queries), len(code)), np.float32)
    norms = np.linalg.norm(queries, axis=1)
    for i, (bits, least, step, total) in enumerate(zip(*planes(queries, turn), strict=True)):
        count = np.zeros(len(code), np.float32)
        for j in range(QUERY_BITS):
            count += np.bitwise_count(code & bits[j]).sum(axis=1, dtype=np.float32) * np.float32(2**j)
        estimate[i] = (2 * (least * ones + step * count) - total) * scale
        # rounding moves a coordinate by step / sqrt(12) on average
        slack[i] = norms[i] * spread + (epsilon * step / np.sqrt(12)) * np.sqrt(dim) * scale
    return estimate - slack, estimate + slack


def search(ids: np.ndarray, vectors: np.ndarray, code: tuple, query_ids: np.ndarray, queries: np.ndarray, best: list, k: int, turn: np.ndarray, epsilon: float = EPSILON) -> None:
    """Puts candidates of one block into ``best``: for each query (scores, ids), best first."""
    low, high = bounds(*code, queries, turn, epsilon)
    for i in range(len(queries)):
        scores, names = best[i]
        mine = np.flatnonzero(ids != query_ids[i])
        up = high[i, mine]
        line = scores[k - 1] if len(scores) >= k else -np.inf
        if len(mine) > k:
            line = max(line, np.partition(low[i, mine], len(mine) - k)[len(mine) - k])
        # the most promising first: their exact scores raise the line for the rest
        few = min(len(mine), 4 * k)
        order = np.argpartition(-up, few - 1) if few else mine[:0]
        for part in (order[:few], order[few:]):
            chosen = mine[part[up[part] >= line]]
            near = chosen[vectors[chosen] @ queries[i] >= line - 1e-9 * max(1.0, abs(line))] if np.isfinite(line) else chosen
            scores = np.concatenate([scores, (vectors[near] * queries[i][None, :]).sum(axis=1)])
            names = np.concatenate([names, ids[near]])
            top = np.lexsort((names, -scores))[:k]
            scores, names = scores[top], names[top]
            if len(scores) >= k:
                line = max(line, scores[k - 1])
        best[i] = scores, names


def _pack(kind: int, size: int):
    """mapInArrow function: rows to blocks of one group and dimension; those of data (kind 0) with their codes."""

    def work(batches):
        held: dict = {}
        turns: dict[int, np.ndarray] = {}

        def block(key: tuple) -> pa.RecordBatch:
            group, dim = key
            names, rows = held.pop(key)
            vectors = np.array(rows, "<f8")
            if dim not in turns:
                turns[dim] = rotation(dim)
            code = [x.tobytes() for x in encode(vectors, turns[dim])] if kind == 0 else [b""] * 3
            values = [names_.tobytes() for names_ in (np.array(names, "<i8"), vectors)] + code
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([group], pa.int32()), pa.array([kind], pa.int32()), pa.array([min(names)]), *(pa.array([x], pa.binary()) for x in values)], names=["dim", "group", "kind", "first", "ids", "vectors", "codes", "length", "c"])

        for batch in batches:
            for name, row, g in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), batch.column("group").to_pylist(), strict=True):
                key = (g, len(row))
                names, rows = held.setdefault(key, ([], []))
                names.append(name)
                rows.append(row)
                if len(names) >= size:
                    yield block(key)
        for key in list(held):
            yield block(key)

    return work


_BLOCK = "dim int, group int, kind int, first long, ids binary, vectors binary, codes binary, length binary, c binary"


def _meet(k: int, epsilon: float):
    """mapInArrow function over blocks sorted by dimension, group and kind: the k best of each query within a group."""

    def work(batches):
        group, data, turn = None, [], np.zeros((0, 0))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                dim = row["dim"]
                if (dim, row["group"]) != group:
                    if turn.shape[0] != dim:
                        turn = rotation(dim)
                    group, data = (dim, row["group"]), []
                ids, vectors = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim)
                if row["kind"] == 0:
                    code = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(row["length"], "<f8"), np.frombuffer(row["c"], "<f8")
                    data.append((ids, vectors, code))
                    continue
                best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
                for own_ids, own, code in data:
                    search(own_ids, own, code, ids, vectors, best, k, turn, epsilon)
                n = [len(s) for s, _ in best]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(ids, n), "vec_id": np.concatenate([x for _, x in best]), "score": np.concatenate([s for s, _ in best])})

    return work


def nearest(table: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    clean = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(sound).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))
    blocks = -(-clean.count() // DATA_BLOCK)
    groups = max(1, min(blocks, FEW), -(-blocks // GROUP_BLOCKS))
    copies = Window.partitionBy("vector").orderBy("vec_id")
    chosen = clean.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    dealt = chosen.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).repartition(groups, "group")
    data = stage(dealt.mapInArrow(_pack(0, DATA_BLOCK), _BLOCK), "ann-blocks")
    asked = clean.where(F.col("vec_id") % every == 0).withColumn("group", F.lit(0)).mapInArrow(_pack(1, QUERY_BLOCK), _BLOCK)
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    found = data.unionByName(asked).repartition(groups, "dim", "group").sortWithinPartitions("dim", "group", "kind", "first").mapInArrow(_meet(k, epsilon), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
