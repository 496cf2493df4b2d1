"""Hard negatives by norm-bucketed inner-product search (operator 11).

Candidates are sorted by length (norm) and dealt to buckets of about ``BUCKET_ROWS`` rows of nearly one length, longest
first; a bucket is a few blocks of ``BLOCK_ROWS`` rows.  By Cauchy-Schwarz, no score in a bucket exceeds the anchor's
length times the bucket's largest.  Two searches use this bound:

* positives: within a bucket an anchor leaves a block, and those after it, as soon as the bound falls below its running
  k-th score;
* negatives: each positive p opens a window of scores, from 30 % to 90 % of p's score.  An anchor isn't even sent to
  buckets whose bound stays below the lowest of its windows' lower limits, and within a bucket it leaves the blocks whose
  bound is below the lower limits, or the running k-th scores, of all its windows.

Rows of a block that are too short for an anchor are left out as well, as a block is sorted.  Scores are exact: vectors
are whole numbers, multiplied in double precision while no sum can pass 2^53, else as 64-bit integers.

Tasks hold one bucket and let blocks of anchors pass; a window function merges the buckets' best.  Vectors of one length
leave nothing to prune, so that work then grows with anchors times rows: the method's worst case.

Results for odd input: rows with a null label, id or vector or a null or non-finite component take no part, nor do those
whose whole-number vector is as long as 2^28, as 90 times their scores may not fit 64 bits; zero and empty vectors do take part;
only vectors of the same dimension meet; rows of the anchor's id are neither its positives nor its negatives; repeated
rows (same id, label and vector) count once, rows that share an id only count each; ties go to the smaller id, then to
the smaller row hash; a positive whose score isn't above 0 has an empty window, but for 0 itself, whose window is 0; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

POSITIVES = 5
NEGATIVES = 10
#: Per cent of a positive's score between which its negatives lie.
LOWEST, HIGHEST = 30, 90
SCALE = 256
#: Vectors must be shorter, so that percentages of scores fit 64 bits.
LONGEST = float(2**28)
BLOCK_ROWS = 4096
#: Rows of a bucket, at 40 MB for 64 dimensions; small tables make more buckets, up to FEW.
BUCKET_ROWS = 65536
FEW = 24
ANCHOR_ROWS = 512

_BLOCK = "dim int, bucket int, kind int, longest double, rows int, keys binary, ids binary, labels binary, vectors binary, norms binary, lows binary, highs binary, windows int, need double"


def whole_rows(table: DataFrame, vec_id: str, vector: str, label: str, relabel: Column | None) -> DataFrame:
    """Rows that take part: whole-number vectors with their length and a hash as key; repeated rows once."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = table.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(sound)
    named = clean.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x).cast("double")).alias("q"))
    if relabel is not None:
        named = named.withColumn("label", relabel.cast("int"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    kept = named.withColumn("norm", norm).where(F.col("norm") < LONGEST)
    longs = kept.withColumn("vector", F.transform("q", lambda x: x.cast("long"))).drop("q")
    keyed = longs.withColumn("key", F.xxhash64("vec_id", "label", "vector"))
    # equal rows share all columns: dealt by hash, so that no copies but those of one row meet, and merged before that
    return keyed.dropDuplicates(["key", "vec_id", "label"]).select(F.size("vector").alias("dim"), "key", "vec_id", "label", "vector", "norm")


def _block(dim: int, bucket: int, kind: int, keys: list, ids: list, labels: list, vectors: list, norms: list, lows: list = [], highs: list = [], needs: list = [None]) -> pa.RecordBatch:  # noqa: B006
    windows = len(lows[0]) if lows else 0
    arrays = [np.array(keys, "<i8"), np.array(ids, "<i8"), np.array(labels, "<i4"), np.array(vectors, "<i8"), np.array(norms, "<f8"), np.array(lows, "<i8"), np.array(highs, "<i8")]
    ends = [pa.array([windows], pa.int32()), pa.array([None if None in needs else min(needs)], pa.float64())]
    head = [pa.array([x], pa.int32()) for x in (dim, bucket, kind)] + [pa.array([float(max(norms))]), pa.array([len(ids)], pa.int32())]
    names = ["dim", "bucket", "kind", "longest", "rows", "keys", "ids", "labels", "vectors", "norms", "lows", "highs", "windows", "need"]
    return pa.RecordBatch.from_arrays(head + [pa.array([x.tobytes()], pa.binary()) for x in arrays] + ends, names=names)


def _pack(kind: int, size: int, more: tuple[str, ...] = ()):
    """mapInArrow function: rows, as they come, to blocks of one dimension; a task is a bucket of candidates (kind 0)."""
    columns = ["key", "vec_id", "label", "vector", "norm", *more]

    def work(batches):
        bucket = TaskContext.get().partitionId() if kind == 0 else 0
        held, dim = [[] for _ in columns], None
        for batch in batches:
            for d, *row in zip(batch.column("dim").to_pylist(), *(batch.column(c).to_pylist() for c in columns), strict=True):
                if held[0] and (d != dim or len(held[0]) == size):
                    yield _block(dim, bucket, kind, *held)
                    held = [[] for _ in columns]
                dim = d
                for own, x in zip(held, row, strict=True):
                    own.append(x)
        if held[0]:
            yield _block(dim, bucket, kind, *held)

    return work


class Block:
    """A block's columns as arrays."""

    def __init__(self, row: dict):
        n, self.dim, self.longest = row["rows"], row["dim"], row["longest"]
        self.keys, self.ids, self.labels = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4")
        self.vectors, self.norms = np.frombuffer(row["vectors"], "<i8").reshape(n, self.dim), np.frombuffer(row["norms"], "<f8")
        self.lows, self.highs = (np.frombuffer(row[c], "<i8").reshape(n, row["windows"]) for c in ("lows", "highs"))
        self.floats = self.vectors.astype(np.float64)

    def scores(self, other: Block, mine: np.ndarray, rows: int) -> np.ndarray:
        """Exact inner products of own rows ``mine`` with the first rows of ``other``."""
        if float(self.norms[mine].max()) * other.longest < 2.0**53:
            return (self.floats[mine] @ other.floats[:rows].T).astype(np.int64)
        return self.vectors[mine] @ other.vectors[:rows].T


def _best(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best, highest score first, then smallest id, then smallest key."""
    if len(scores) > k:  # only scores of at least the k-th can be among them
        at = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, keys = scores[at], ids[at], keys[at]
    top = np.lexsort((keys, ids, -scores))[:k]
    return scores[top], ids[top], keys[top]


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)


def _room(x: np.ndarray | float) -> np.ndarray | float:
    """A bound from rounded lengths, made safe."""
    return x * (1 + 1e-9) + 1e-6


def find(anchors: Block, bucket: list[Block], k: int, same: bool) -> tuple[list, int]:
    """For each anchor and window (one without limits for positives) its best rows of a bucket; and the pairs scored."""
    n, scored = len(anchors.ids), 0
    windows = 1 if same else anchors.lows.shape[1]
    best = [[_NONE] * windows for _ in range(n)]
    # the score that a row must reach to matter to any window of an anchor
    least = np.full((n, windows), -np.inf) if same else anchors.lows.astype(np.float64)
    if not same:
        least[anchors.lows > anchors.highs] = np.inf
    for block in bucket:
        line = least.min(axis=1)
        mine = np.flatnonzero(_room(anchors.norms * block.longest) >= line)
        if not len(mine):
            continue
        # rows are sorted by length: those beyond are too short for every anchor that is left
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(line[mine] > 0, line[mine] / _room(anchors.norms[mine]), 0.0).min()
        rows = int(np.searchsorted(-block.norms, -need * (1 - 1e-9) + 1e-6, "right"))
        table = anchors.scores(block, mine, rows)
        scored += table.size
        ids, labels, keys = block.ids[:rows], block.labels[:rows], block.keys[:rows]
        for i, scores in zip(mine, table, strict=True):
            fits = ((labels == anchors.labels[i]) == same) & (ids != anchors.ids[i]) & (scores >= line[i])
            if not same:
                fits &= scores <= anchors.highs[i].max()
            at = np.flatnonzero(fits)
            for w in range(windows) if len(at) else ():
                own = at if same else at[(scores[at] >= least[i, w]) & (scores[at] <= anchors.highs[i, w])]
                if not len(own):
                    continue
                kept = best[i][w]
                best[i][w] = kept = _best(*(np.concatenate([a, b[own]]) for a, b in zip(kept, (scores, ids, keys), strict=True)), k)
                if len(kept[0]) == k:
                    least[i, w] = max(least[i, w], kept[0][-1])
    return best, scored


def _meet(k: int, same: bool):
    """mapInArrow function over blocks sorted by dimension, bucket, kind and length: each anchor's best of a bucket."""

    def work(batches):
        at, bucket = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                if (row["dim"], row["bucket"]) != at:
                    at, bucket = (row["dim"], row["bucket"]), []
                block = Block(row)
                if row["kind"] == 0:
                    bucket.append(block)
                    continue
                best, _ = find(block, bucket, k, same)
                flat = [(i, w, found) for i, own in enumerate(best) for w, found in enumerate(own) if len(found[0])]
                sizes = [len(found[0]) for _, _, found in flat]
                spread = lambda x: np.repeat(np.array(x, np.int64), sizes)
                joined = [np.concatenate([f[c] for _, _, f in flat] or [np.zeros(0, np.int64)]) for c in range(3)]
                yield pa.RecordBatch.from_pydict({"anchor": spread([block.keys[i] for i, _, _ in flat]), "window": spread([w for _, w, _ in flat]), "score": joined[0], "vec_id": joined[1], "key": joined[2]})

    return work


_FOUND = "anchor long, window long, score long, vec_id long, key long"


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    table: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Column | None = None,
) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``relabel`` is an expression over vec_id and label.
    """
    rows = stage(whole_rows(table, vec_id, vector, label, relabel), "negative-rows")
    n = rows.count()
    buckets = max(1, min(-(-n // BLOCK_ROWS), FEW), -(-n // BUCKET_ROWS))
    order = [F.col("dim"), F.desc("norm"), F.col("key")]
    data = stage(rows.repartitionByRange(buckets, *order).sortWithinPartitions(*order).mapInArrow(_pack(0, BLOCK_ROWS), _BLOCK), "negative-buckets")
    # a row for each bucket and dimension: as many as the table has blocks at most
    bounds = data.groupBy("dim", "bucket").agg(F.max("longest").alias("longest"))

    def best(packed: DataFrame, k: int, same: bool) -> DataFrame:
        reach = F.col("need").isNull() | (F.col("bound") * (1 + 1e-9) + 1e-6 >= F.col("need"))
        sent = packed.join(F.broadcast(bounds.withColumnRenamed("bucket", "to").withColumnRenamed("longest", "bound")), "dim").where(reach)
        sent = sent.withColumn("bucket", F.col("to")).select(*data.columns)
        met = data.unionByName(sent).repartition(buckets, "dim", "bucket").sortWithinPartitions("dim", "bucket", "kind", F.desc("longest"))
        return met.mapInArrow(_meet(k, same), _FOUND)

    anchors = rows.where(F.col("vec_id") % every == 0)
    few = -(-n // every // ANCHOR_ROWS) + 1
    asked = stage(anchors.repartition(few).sortWithinPartitions("dim", F.desc("norm")).mapInArrow(_pack(1, ANCHOR_ROWS), _BLOCK), "negative-anchors")
    near = _ranked(best(asked, positives, True), ["anchor"], positives)
    pairs = stage(near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")

    # limits as whole numbers: lowest * p <= 100 * x <= highest * p; windows without a positive are empty
    floor = lambda x: F.expr(f"(positive_score * {x} - pmod(positive_score * {x}, 100L)) div 100")
    limits = pairs.select("anchor", "window", (-floor(-lowest)).alias("low"), floor(highest).alias("high"))
    limits = limits.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("low", "high")))).alias("by"))  # `positives` entries
    every_window = F.sequence(F.lit(0), F.lit(positives - 1))
    limit = lambda name, other: F.transform(every_window, lambda w: F.coalesce(F.try_element_at("by", w)[name], F.lit(other).cast("long")))
    opened = anchors.join(limits, F.col("key") == F.col("anchor")).select(*anchors.columns, limit("low", 1).alias("low"), limit("high", 0).alias("high"))
    # the length that a candidate needs: the lowest of the windows' lower limits over the anchor's length
    lows = F.transform(F.filter(F.arrays_zip("low", "high"), lambda z: z["low"] <= z["high"]), lambda z: z["low"])
    needing = opened.withColumn("need", F.try_divide(F.array_min(lows).cast("double"), F.col("norm"))).where(F.size(lows) > 0)
    dealt = needing.repartitionByRange(few, "dim", "need", "key").sortWithinPartitions("dim", "need")
    asked = stage(dealt.mapInArrow(_pack(1, ANCHOR_ROWS, ("low", "high", "need")), _BLOCK), "negative-windows")
    found = _ranked(best(asked, negatives, False), ["anchor", "window"], negatives)
    ids = anchors.select(F.col("key").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = found.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return told.join(pairs, ["anchor", "window"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def contract_label() -> Column:
    """Fixed rule of the contract: the labels of rows whose id is divisible by 7 move on by one of ten."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


ORACLE = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOWEST} * positive_score <= 100 * score AND 100 * score <= {HIGHEST} * positive_score QUALIFY rank <= {NEGATIVES}"""
