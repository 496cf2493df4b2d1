"""Toxicity by cumulative-link ordinal regression over sparse words (operator 3).

Severity grades are ordered: 0 is harmless, and labelled toxic texts are graded 1 to 3 by how many distinct features
with a screened link to toxicity they hold (thirds of the toxic training texts), as the labels themselves only tell
toxic from not.  One weight vector w is shared by all thresholds:
P(grade > k) = sigmoid(w . x - t_k) with t_0 <= t_1 <= ...
(Agresti's proportional-odds model), so the expected severity is the sum of these probabilities.  Features are the
distinct words of a text (the pattern of :data:`shared.ALNUM`) and their first bytes, hashed into ``2 ** BITS`` buckets
and screened for an association with the labels; copies among the training texts (by MinHash) count once.

Training takes at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of their id - a documented bound:
their features are gathered on the driver, so its memory does not depend on the table.  The fit is deterministic.
Scoring covers every document with one pass and no shuffle.

Results for odd input: null, empty and wordless texts have no features and get the grade of the thresholds alone; null
labels don't train; different labels for an id all train, with its first text in order; without two different grades the model predicts the only
one there is (0 if none); repeated rows are scored row by row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, map_whole, mix, row_shingles, slice_hashes, text_blocks, word_hashes, word_spans

BITS = 20
#: Words inflect: besides the word itself, its first bytes are features.
PREFIXES = (3, 4, 5, 6, 7, 8)
TRAIN_ROWS = 5_000
#: A feature is used if it is in MIN_ROWS training texts and its share of grades above 0 is SIGMAS deviations off.
MIN_ROWS = 5
SIGMAS = 4.0
SKETCH = 8
EPOCHS = 600
RATE = 0.05
DECAY = 1e-5
GRADES = 4
#: A document counts as toxic from this probability of a grade above 0.
CUTOFF = 0.5


def _buckets(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of every word, then of every word's first bytes, for each of PREFIXES."""
    low, starts, ends, first = word_spans(data, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    yield slice_hashes(low, starts, ends) >> U64(64 - BITS), owner
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        yield slice_hashes(low, starts[longer], starts[longer] + size) >> U64(64 - BITS), owner[longer]


def _distinct(bucket: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text, concatenated, and where each begins (with the total)."""
    both = np.unique((owner.astype(U64) << U64(BITS)) | bucket)
    return (both & U64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(both >> U64(BITS), np.arange(n + 1, dtype=U64))


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of each text, concatenated, and where each begins (with the total)."""
    bucket, owner = (np.concatenate(x) for x in zip(*_buckets(data, offs), strict=True))
    return _distinct(bucket, owner, len(offs) - 1)


def _sketches(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash values of the five-word shingles of each text, two to a column; texts without words get random ones."""
    hashes, owner = row_shingles(*word_hashes(data, offs), 5)
    order = np.argsort(owner, kind="stable")
    hashes, begin = hashes[order], np.searchsorted(owner[order], np.arange(len(offs)))
    full = np.flatnonzero(np.diff(begin) > 0)
    out = np.zeros((len(offs) - 1, SKETCH), U64)
    with np.errstate(over="ignore"):
        for k in range(SKETCH if len(full) else 0):
            one, two = mix(np.arange(2 * k + 1, 2 * k + 3, dtype=U64))
            pair = [np.minimum.reduceat((hashes ^ x) * (mix(np.array([x]))[0] | U64(1)), begin[:-1][full]) for x in (one, two)]
            out[full, k] = mix(mix(pair[0]) + pair[1])
    return out


def _one_of_each_copy(sketch: np.ndarray) -> np.ndarray:
    """Rows to train on: the first of those connected by an equal column, as copies would count as much evidence."""
    root = list(range(len(sketch)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for column in sketch.T.tolist():
        seen: dict[int, int] = {}
        for i, value in enumerate(column):
            j = seen.setdefault(value, i) if value else i
            if i != j:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return np.array([find(i) == i for i in range(len(sketch))], bool)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(index: np.ndarray, begin: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> dict:
    """Weights and thresholds by full-batch Adam on the penalised likelihood of the screened features."""
    # feature numbers are dense enough to count by: no sorting of all occurrences
    count = np.bincount(index, minlength=1 << BITS)
    names, dense = np.arange(1 << BITS), index
    row = np.repeat(np.arange(len(toxic), dtype=np.int32), np.diff(begin))
    base = float(np.mean(toxic)) if len(toxic) else 0.0
    excess = np.bincount(dense, toxic[row], len(names)) - count * base
    used = (count >= MIN_ROWS) & (np.abs(excess) >= SIGMAS * np.sqrt(np.maximum(count * base * (1 - base), 1e-9)))
    held = np.bincount(row, (used & (excess > 0))[dense], len(toxic))
    cuts = np.quantile(held[toxic > 0], np.arange(1, grades - 1) / (grades - 1)) if (toxic > 0).any() else np.zeros(grades - 2)
    grade = np.where(toxic > 0, 1 + (held[:, None] > cuts[None, :]).sum(axis=1), 0)
    number = np.cumsum(used) - 1
    keep = used[dense]
    row, col, names = row[keep], number[dense[keep]], names[used]
    levels = np.array([np.mean(grade > k) for k in range(grades - 1)]) if len(grade) else np.zeros(grades - 1)
    levels = np.clip(levels, 1e-6, 1 - 1e-6)
    if len(grade) == 0 or len(np.unique(grade)) < 2 or not len(names):
        return {"names": names[:0], "weights": np.zeros(0), "thresholds": -np.log(levels / (1 - levels)) if len(grade) else np.full(grades - 1, 14.0)}
    w, t = np.zeros(len(names)), -np.log(levels / (1 - levels))
    t = np.maximum.accumulate(t + 1e-3 * np.arange(grades - 1))
    # gaps between thresholds are kept positive by their logarithms
    free = np.concatenate([w, t[:1], np.log(np.diff(t) + 1e-6)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    n, d = len(grade), len(names)
    for epoch in range(1, EPOCHS + 1):
        w, gaps = free[:d], np.exp(free[d + 1 :])
        t = free[d] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, w[col], n)
        above = _sigmoid(z[:, None] - t[None, :])  # P(grade > k)
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-12)
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        dz = -(up - down) / n
        dt = np.array([np.sum(np.where(grade == k + 1, up, 0.0) - np.where(grade == k, down, 0.0)) for k in range(grades - 1)]) / n
        step = np.concatenate([np.bincount(col, dz[row], d) + DECAY * w, [dt.sum()], [dt[k + 1 :].sum() * gaps[k] for k in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step * step
        free = free - RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    t = free[d] + np.concatenate([[0], np.cumsum(np.exp(free[d + 1 :]))])
    return {"names": names, "weights": free[:d], "thresholds": t}


def train(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> dict:
    """The model of at most ``rows`` labelled documents."""
    graded = labels.where("doc_id is not null and toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    # the bound on rows makes this side small enough to broadcast
    sample = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    labelled = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    # ids may repeat among documents: one text of each keeps the bound
    chosen = labelled.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def extract(batches):
        for batch, data, offs in text_blocks(batches):
            index, begin = features(data, offs)
            lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(index.astype(np.int32)))
            sketch = pa.array([x.tobytes() for x in _sketches(data, offs)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists, sketch], names=["doc_id", "label", "words", "sketch"])

    kind = dict(docs.dtypes)["doc_id"]
    got = chosen.mapInArrow(extract, f"doc_id {kind}, label int, words array<int>, sketch binary").toArrow()
    # in an order that does not depend on tasks
    got = got.append_column("size", pc.list_value_length(got["words"])).sort_by([("doc_id", "ascending"), ("label", "ascending")])
    once = _one_of_each_copy(np.frombuffer(b"".join(got["sketch"].to_pylist()), U64).reshape(-1, SKETCH))
    got = got.filter(pa.array(once))
    words, size = got["words"].combine_chunks(), got["size"].to_numpy()
    return fit(words.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), got["label"].to_numpy().astype(np.int64))


def _scorer(model: dict):
    table = np.zeros(1 << BITS)
    table[model["names"]] = model["weights"]

    def score(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(grade > k) of each text, one column for each k."""
        n = len(offs) - 1
        found = [(bucket[k], owner[k]) for bucket, owner in _buckets(data, offs) for k in [np.flatnonzero(table[bucket])]]
        index, begin = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)), n)
        sums = np.bincount(np.repeat(np.arange(n), np.diff(begin)), table[index], n)
        return _sigmoid(sums[:, None] - model["thresholds"][None, :])

    return score


def scores(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """Per document: expected severity, most likely grade, probability of any toxicity, and the verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def work(batches):
        score = _scorer(shared.value)
        for batch, data, offs in text_blocks(batches):
            above = score(data, offs)
            edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= cutoff)], names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return slim.mapInArrow(work, f"doc_id {kind}, severity double, grade int, p_toxic double, toxic boolean")


def harmless(docs: DataFrame, model: dict, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The documents, columns unchanged, that are not judged toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        score = _scorer(shared.value)
        for batch, data, offs in text_blocks(batches, text):
            yield batch.filter(pa.array(score(data, offs)[:, 0] < cutoff))

    return map_whole(docs, work, docs.schema)


