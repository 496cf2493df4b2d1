"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures (operator 10).

1. A document is the set of its distinct ``width``-word shingles; equal sets form a class, and classes are the nodes
   from here on, so copies cost nothing further.
2. A class gets ``SIZE`` MinHash values of ``16`` bits.  Two signatures within ``reach`` differing values are found with
   certainty: the values are split into ``CHUNKS`` chunks, and with at most 2 * CHUNKS - 1 differences some chunk holds
   one at most (pigeonhole).  Every chunk is indexed once for each of its values left out, which enumerates all chunks
   within one error.  Sets at the threshold exceed ``reach`` with a probability of a few in a million.
3. Classes with a common key are put into one group by linking each to the smallest class of the key (never all pairs)
   and taking connected components: all pairs within reach meet in a group, whatever the size of a key.
4. Groups are checked in cells of bounded size: a large group is dealt into blocks and a cell holds two of them.  In a
   cell, pairs that aren't connected yet are compared by signature distance and confirmed on their full sets with
   100 * intersection >= 100 * threshold * union; only links that connect something new leave the cell.
5. Components of these links give the groups of near-duplicates.

Results for odd input: null, empty and blank texts have no shingles and link with nothing, not even each other; fewer
words than ``width`` make one shingle; rows with a null or repeated id are judged by their text; repeated rows enter a
cell once; ties go to the smallest id; very long texts are handled alone, whole, and make a block of a cell of their
own; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, columns_of, components, drop_staged, mix, ragged, row_shingles, scratch, stage, text_blocks, unused, word_hashes

WIDTH = 4
THRESHOLD = 80
SIZE = 48
CHUNKS = 12
REACH = 2 * CHUNKS - 1
CELL_BYTES = 8 << 20

with np.errstate(over="ignore"):
    _FLIPS = mix(np.arange(1, SIZE + 1, dtype=U64))
    _ODD = mix(_FLIPS) | U64(1)


def distinct_shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, concatenated, and where each row begins (with the total)."""
    hashes, owner = row_shingles(words, rows, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(rows)))


def signatures(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SIZE 16-bit MinHash values of each non-empty row of sorted shingles."""
    out = np.empty((len(begin) - 1, SIZE), np.uint16)
    full = np.flatnonzero(np.diff(begin) > 0)
    if len(full):
        scratch = np.empty(len(hashes), U64)
        for k in range(SIZE):
            np.bitwise_xor(hashes, _FLIPS[k], out=scratch)
            np.multiply(scratch, _ODD[k], out=scratch)
            out[full, k] = mix(np.minimum.reduceat(scratch, begin[:-1][full])) >> U64(48)
    return out


def _marks(rows: DataFrame, width: int) -> DataFrame:
    """Each row's id and pick with the number of its shingles, the key of its set (null if empty) and its signature."""
    kind = dict(rows.dtypes)["doc_id"]

    def scan(batches):
        for batch, data, offs in text_blocks(batches):
            words, first = word_hashes(data, offs, spaced=True)
            hashes, begin = distinct_shingles(words, first, width)
            n = np.diff(begin)
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes), dtype=U64)])
            with np.errstate(over="ignore"):
                key = mix(sums[begin[1:]] - sums[begin[:-1]] + n.astype(U64)).view(np.int64)
            table = signatures(hashes, begin)
            empty = n == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pick"), pa.array(n), pa.array(key, mask=empty), pa.array([x.tobytes() for x in table], pa.binary())], names=["doc_id", "pick", "n", "set", "signature"])

    return rows.select("doc_id", "pick", "text").mapInArrow(scan, f"doc_id {kind}, pick long, n long, set long, signature binary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, set): every chunk with each of its values left out."""
    size = SIZE // CHUNKS
    for batch in batches:
        for i in range(0, batch.num_rows, 8192):
            part = batch.slice(i, 8192)
            sets = part.column("set").to_numpy()
            table = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, SIZE).astype(U64)
            out = []
            with np.errstate(over="ignore"):
                for k in range(SIZE):
                    key = np.full(len(sets), k + 1, U64)
                    for j in range(k - k % size, k - k % size + size):
                        if j != k:
                            key = mix(key) + table[:, j]
                    out.append(mix(key))
            yield pa.RecordBatch.from_pydict({"key": np.concatenate(out).view(np.int64), "set": np.tile(sets, SIZE)})


def _cell_links(size_limit: int, reach: int, threshold: int):
    """mapInArrow function over rows sorted by cell: links (a, b) that connect something new."""

    def solve(rows: list[tuple]) -> tuple[list, list]:
        sets = [r[0] for r in rows]
        block = np.array([r[1] for r in rows])
        crossing = rows[0][2]  # the cell holds two blocks: only pairs between them are new
        table = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(-1, SIZE)
        lists = [np.frombuffer(r[4], U64) for r in rows]
        n = np.array([len(x) for x in lists])
        dense = np.unique(np.concatenate(lists), return_inverse=True)[1]
        begin = np.cumsum(n) - n
        mark = np.zeros(int(dense.max()) + 1, np.int8)
        root = np.arange(len(rows))
        one, two = [], []
        for i in range(len(rows) - 1):
            j = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
            if crossing:
                j = j[block[j] != block[i]]
            j = j[100 * np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i])]
            j = j[np.count_nonzero(table[j] != table[i], axis=1) <= reach]
            if not len(j):
                continue
            own = dense[begin[i] : begin[i] + n[i]]
            mark[own] = 1
            for a in range(0, len(j), 1024):
                k = j[a : a + 1024]
                k = k[root[k] != root[i]]
                if not len(k):
                    continue
                both = np.add.reduceat(mark[dense[ragged(begin[k], n[k])]], np.cumsum(n[k]) - n[k], dtype=np.int64)
                for x in k[100 * both >= threshold * (n[k] + n[i] - both)].tolist():
                    if root[x] != root[i]:
                        one.append(sets[i])
                        two.append(sets[x])
                        root[root == root[x]] = root[i]
            mark[own] = 0
        return one, two

    def work(batches):
        cell, held = None, []
        for batch in batches:
            names = ("group", "low", "high", "set", "block", "signature", "shingles")
            for group, low, high, key, block, sig, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (group, low, high) != cell:
                    if len(held) > 1:
                        one, two = solve(held)
                        yield pa.RecordBatch.from_pydict({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})
                    cell, held = (group, low, high), []
                if not held or held[-1][0] != key:  # rows come in order of block and set
                    held.append((key, block, low != high, sig, raw))
        if len(held) > 1:
            one, two = solve(held)
            yield pa.RecordBatch.from_pydict({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return work


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each set; equal rows share a pick, and so the task that the join by pick sends them to."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for i, key in enumerate(batch.column("set").to_pylist()):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if new:
            yield batch if len(new) == batch.num_rows else batch.take(pa.array(new))


def _classes(rows: DataFrame, width: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(marks of all rows, (set, component) of the sets that link with another).  rows: doc_id, pick, text."""
    with scratch() as held:
        marks = stage(_marks(rows, width), "near-marks")
        classes = marks.where("set is not null").groupBy("set").agg(F.min(F.struct("pick", "n", "signature")).alias("c")).select("set", "c.*")
        classes = stage(classes, "near-classes")
        keys = classes.select("set", "signature").mapInArrow(_keys, "key long, set long")
        least = keys.groupBy("key").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most").select("key", "least")
        star = keys.join(least, "key").where("set <> least").select(F.col("least").alias("a"), F.col("set").alias("b")).distinct()
        groups = components(star, "near-groups").select(F.col("node").alias("set"), F.col("component").alias("group"))
        members = stage(groups.join(classes, "set"), "near-members")
        sizes = members.groupBy("group").agg(F.ceil(F.sum(F.col("n") * 8 + SIZE * 2) / CELL_BYTES).cast("int").alias("blocks"))
        wanted = members.join(sizes, "group").select("set", "group", "blocks", "pick", "signature", F.pmod(F.hash("set"), F.col("blocks")).alias("block"))
        kept = rows.select(F.col("pick").alias("_pick"), "text")

        def full_sets(batches):
            names = ["set", "group", "blocks", "signature", "block"]
            for batch, data, offs in text_blocks(_once(batches)):
                words, first = word_hashes(data, offs, spaced=True)
                hashes, begin = distinct_shingles(words, first, width)
                raw = [hashes[begin[i] : begin[i + 1]].tobytes() for i in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], names=[*names, "shingles"])

        sets = kept.join(wanted.hint("shuffle_hash"), F.col("_pick") == F.col("pick")).drop("pick", "_pick").mapInArrow(full_sets, "set long, group long, blocks int, signature binary, block int, shingles binary")
        cells = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "block", "signature", "shingles")
        links = cells.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "block", "set").mapInArrow(_cell_links(CELL_BYTES, REACH, threshold), "a long, b long")
        linked = stage(components(links, "near-links").select(F.col("node").alias("set"), F.col("component").alias("class")), "near-linked")
    drop_staged(*(t for t in held if t is not marks and t is not linked))
    return marks, linked


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """pick: a row's content, the same whenever it is read again."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.withColumn("pick", F.xxhash64("doc_id", "text"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept."""
    marks, linked = _classes(_rows(docs, doc_id, text), width, threshold)
    named = marks.select("doc_id", "n", "set").join(linked, "set", "left").withColumn("class", F.coalesce("class", "set"))
    least = named.where("set is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "class", "left").withColumn("component_id", F.coalesce(F.when(F.col("set").isNotNull(), F.col("least")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, columns unchanged, without all but one (that of the smallest id) of each near-duplicate group."""
    marks, linked = _classes(_rows(docs, doc_id, text), width, threshold)
    named = marks.where("set is not null").select("doc_id", "pick", "set").join(linked, "set", "left").withColumn("class", F.coalesce("class", "set"))
    best = named.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "pick")).alias("best"), F.count("*").alias("n"))
    gone = named.join(best, "class").where("pick <> best.pick").select("pick").distinct()
    # rows with the same id and text have the same pick: of those, one is kept
    mine, theirs = unused(docs, "pick", "other")
    again = marks.where("set is not null").groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select(F.col("pick").alias(theirs))
    gone, again = stage(gone.withColumnRenamed("pick", theirs), "near-gone"), stage(again, "near-again")
    drop_staged(marks, linked)
    kept = docs.withColumn(mine, F.xxhash64(F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))).join(gone, F.col(mine) == F.col(theirs), "left_anti")
    if again.isEmpty():
        return kept.select(*columns_of(docs))
    once = kept.join(again, F.col(mine) == F.col(theirs), "left_semi").dropDuplicates([mine])
    return kept.join(again, F.col(mine) == F.col(theirs), "left_anti").unionByName(once).select(*columns_of(docs))


def brute_force(docs: list[tuple], width: int = WIDTH, threshold: int = THRESHOLD) -> list[tuple]:
    """Plain Python over all pairs, for tests: sorted (doc_id, n_shingles, component_id, kept)."""
    import re

    pattern = re.compile(r"[^\x20\x09-\x0D]+")
    lower = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, text in docs:
        w = pattern.findall((text or "").translate(lower))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(docs):
        r = find(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    rows = [(doc, len(sets[i]), least.get(find(i)), doc is not None and doc == least.get(find(i))) for i, (doc, _) in enumerate(docs)]
    return sorted(rows, key=str)
