"""Benchmark decontamination: a prefix-filtered join of item windows with documents (operator 6).

Items are cut into windows of ``window`` consecutive words (an item with fewer words, but not none, is one window).
A window is the set of its ``shingle``-word shingles with their places.  Shingles are ordered by their document
frequency in the corpus, rarest first; a window contained in a document must hold all its shingles, so the necessary
prefix is the one rarest shingle.  Documents look their shingles up among the prefixes; a match fixes where the window
would start (positional bound), it must fit between the first and last word of the document (length bound), and only
then are all its words compared.

Benchmark windows are held in memory by every task, so their size is checked: items are dealt into as many groups as
keep each below ``group_bytes`` of text, and the documents are scanned once for each group.

Results for odd input: null or empty text and text without words have no words and no hits; null or empty items, and
items without an id, match nothing; repeated items are all reported, those of one id once; repeated documents are judged
one by one; very long texts are handled alone, whole; of equally rare shingles the smaller hash is the prefix, which no
result depends on; an empty table gives an empty result, an empty benchmark hits nothing; columns besides the id and the
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, map_whole, mix, ragged, run_hashes, text_blocks, word_hashes

WINDOW = 10
SHINGLE = 2
GROUP_BYTES = 8 << 20


def _cut(rows: list[tuple], window: int, shingle: int) -> dict:
    """Windows of the items: word hashes (padded), lengths, item of each window, and their shingles."""
    ids = [str(r[0]) for r in rows]
    raw = [(r[1] or "").encode("utf-8", "replace") for r in rows]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    words, first = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs)
    counts = np.diff(first)
    n = np.where(counts > 0, np.maximum(counts - window + 1, 1), 0)
    start, item = ragged(first[:-1], n), np.repeat(np.arange(len(rows)), n)
    length = np.minimum(counts[item], window)
    inside = np.arange(window)[None, :] < length[:, None]
    grid = np.where(inside, words[np.minimum(start[:, None] + np.arange(window)[None, :], max(len(words) - 1, 0))] if len(words) else U64(0), U64(0))
    # the same window in one item counts once
    key = np.concatenate([item[:, None].astype(U64), grid], axis=1)
    keep = np.unique(key, axis=0, return_index=True)[1] if len(key) else np.zeros(0, np.int64)
    grid, length, item = grid[keep], length[keep], item[keep]
    parts = []  # (window, place, hash)
    flat = grid.ravel()
    for width in range(1, shingle + 1):
        own = np.flatnonzero(length >= shingle) if width == shingle else np.flatnonzero(length == width)
        places = length[own] - width + 1
        at, w = ragged(own * window, places), np.repeat(own, places)
        hashes = run_hashes(flat, width)[at] if len(at) else np.zeros(0, U64)
        parts.append((w, at - w * window, mix(hashes + U64(width)), np.full(len(at), width)))
    if not len(grid):
        return {"ids": ids, "grid": grid, "length": length, "item": item} | {k: np.zeros(0, U64 if k == "hash" else np.int64) for k in ("w", "place", "hash", "width")}
    w, place, hashes, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    return {"ids": ids, "grid": grid, "length": length, "item": item, "w": w, "place": place, "hash": hashes, "width": width}


def _doc_shingles(words: np.ndarray, rows: np.ndarray, widths: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """Hashes of the shingles that start at each word; those that cross rows are found out by the length bound."""
    for width in widths:
        yield mix(run_hashes(words, width) + U64(width)), width


def _lookup(sorted_keys: np.ndarray, seen: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``values`` of known keys, and which keys they are; ``seen`` is a bitmap over the top 20 bits."""
    at = np.flatnonzero(seen[(values >> U64(44)).astype(np.int64)])
    if not len(sorted_keys):
        return at[:0], at[:0]
    k = np.searchsorted(sorted_keys, values[at])
    k[k == len(sorted_keys)] = 0
    good = sorted_keys[k] == values[at]
    return at[good], k[good]


def _bitmap(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 20, bool)
    seen[(keys >> U64(44)).astype(np.int64)] = True
    return seen


def _frequencies(docs: DataFrame, text: str, cut: dict) -> np.ndarray:
    """Document frequency, over all documents, of each distinct shingle of the windows (in sorted order)."""
    keys = np.unique(cut["hash"])
    if not len(keys):
        return np.zeros(0, np.int64)
    widths = [int(x) for x in np.unique(cut["width"])]
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        keys = shared.value
        seen, total = _bitmap(keys), np.zeros(len(keys), np.int64)
        for _, data, offs in text_blocks(batches, text):
            words, rows = word_hashes(data, offs)
            for values, width in _doc_shingles(words, rows, widths):
                at, k = _lookup(keys, seen, values)
                row = np.searchsorted(rows, at, "right") - 1
                inside = at + width <= rows[row + 1]
                pairs = np.unique(row[inside].astype(np.int64) * len(keys) + k[inside])
                total += np.bincount(pairs % len(keys), minlength=len(keys))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": k, "n": total[k]})

    sums = docs.select(text).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(keys), np.int64)
    out[sums["k"].to_numpy()] = sums["n"].to_numpy()
    return out


def _index(cut: dict, frequency: np.ndarray) -> dict:
    """Postings of each window under its rarest shingle (ties: smaller hash, then earlier place)."""
    keys = np.unique(cut["hash"])
    rarity = frequency[np.searchsorted(keys, cut["hash"])]
    order = np.lexsort((cut["place"], cut["hash"], rarity, cut["w"]))
    first = order[np.unique(cut["w"][order], return_index=True)[1]]
    first = first[np.argsort(cut["hash"][first], kind="stable")]
    prefix, start, n = np.unique(cut["hash"][first], return_index=True, return_counts=True)
    return {
        "ids": cut["ids"], "grid": cut["grid"], "length": cut["length"], "item": cut["item"], "prefix": prefix, "start": start, "n": n,
        "window": cut["w"][first], "place": cut["place"][first], "widths": [int(x) for x in np.unique(cut["width"][first])],
    }


def _match(index: dict, words: np.ndarray, rows: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in a row."""
    starts, windows = [], []
    for values, _ in _doc_shingles(words, rows, index["widths"]):
        at, k = _lookup(index["prefix"], seen, values)
        step = max(1, (1 << 20) // max(1, int(index["n"].max(initial=1))))
        for i in range(0, len(at), step):
            n = index["n"][k[i : i + step]]
            posting = ragged(index["start"][k[i : i + step]], n)
            w = index["window"][posting]
            begin = np.repeat(at[i : i + step], n) - index["place"][posting]
            row = np.searchsorted(rows, np.repeat(at[i : i + step], n), "right") - 1
            fits = (begin >= rows[row]) & (begin + index["length"][w] <= rows[row + 1])
            begin, w = begin[fits], w[fits]
            for j in range(index["grid"].shape[1]):
                same = (j >= index["length"][w]) | (words[np.minimum(begin + j, len(words) - 1)] == index["grid"][w, j])
                begin, w = begin[same], w[same]
            starts.append(begin)
            windows.append(w)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _groups(items: DataFrame, item_id: str, text: str, group_bytes: int) -> Iterator[list[tuple]]:
    """The items in groups of bounded size: the driver holds one at a time."""
    clean = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null")
    size = clean.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 + size // group_bytes
    for g in range(n):
        yield [tuple(r) for r in (clean if n == 1 else clean.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g)).collect()]


def _indexes(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, window: int, shingle: int, group_bytes: int) -> Iterator:
    """The broadcast index of each group of items."""
    for rows in _groups(items, item_id, item_text, group_bytes):
        cut = _cut(rows, window, shingle)
        yield docs.sparkSession.sparkContext.broadcast(_index(cut, _frequencies(docs, text, cut)))


def _occurrences(batches, text: str, index: dict) -> Iterator[tuple]:
    """(block, first word of each row, first word and window of every occurrence)."""
    seen = _bitmap(index["prefix"])
    for batch, data, offs in text_blocks(batches, text):
        words, first = word_hashes(data, offs)
        yield batch, first, *_match(index, words, first, seen)


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per document: n_words, the hit runs of words (begin, end), n_hit and the sorted ids of the items that occur."""
    found = []
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("key"))
    kind = dict(slim.dtypes)["doc_id"]
    schema = f"key long, doc_id {kind}, n_words long, begins array<long>, ends array<long>, items array<string>"
    for index in _indexes(slim, "text", items, item_id, item_text, window, shingle, group_bytes):

        def scan(batches, shared=index):
            index = shared.value
            for batch, first, begin, w in _occurrences(batches, "text", index):
                edge = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + index["length"][w], -1)
                hit = np.cumsum(edge)[:-1] > 0
                row = np.searchsorted(first, begin, "right") - 1
                n = batch.num_rows
                begins, ends, names = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
                for r, name in sorted({(int(r), index["ids"][i]) for r, i in zip(row, index["item"][w], strict=True)}):
                    names[r].append(name)
                for r in np.unique(row):
                    own = np.concatenate([[0], hit[first[r] : first[r + 1]].astype(np.int8), [0]])
                    begins[r], ends[r] = np.flatnonzero(np.diff(own) == 1).tolist(), np.flatnonzero(np.diff(own) == -1).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(np.diff(first)), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], names=["key", "doc_id", "n_words", "begins", "ends", "items"])

        found.append(slim.mapInArrow(scan, schema))
    out = _merge(found) if len(found) > 1 else found[0].drop("key")
    n_hit = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_hit", n_hit)


def _merge(found: list[DataFrame]) -> DataFrame:
    """Rows of several groups of items: the runs of a document are united and the item lists joined.

    A row's id and text stand for it, so that the result doesn't depend on how rows are dealt; equal rows come as often
    as they are there.
    """
    every = None
    for f in found:
        every = f if every is None else every.unionByName(f)
    runs = F.array_sort(F.flatten(F.collect_set(F.arrays_zip("begins", "ends"))))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda acc, x: F.struct(last(acc)["begins"].alias("begins"), F.greatest(last(acc)["ends"], x["ends"]).alias("ends"))
    merged = F.aggregate(
        runs,
        F.expr("cast(array() as array<struct<begins:bigint,ends:bigint>>)"),
        lambda acc, x: F.when(last(acc)["ends"] >= x["begins"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined(acc, x)))).otherwise(F.concat(acc, F.array(x))),
    )
    times = (F.count("*") / len(found)).cast("int").alias("times")
    # equal rows of one scan give equal runs and items: their union is that of one of them
    once = every.groupBy("key", "doc_id").agg(F.max("n_words").alias("n_words"), merged.alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), times)
    return once.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc_id", "n_words", F.col("runs.begins").alias("begins"), F.col("runs.ends").alias("ends"), "items")


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of query op6."""
    return decontaminate(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents, columns unchanged, that hold no benchmark window: one narrow filter for each group of items."""
    out = docs
    for index in _indexes(docs, text, items, item_id, item_text, window, shingle, group_bytes):

        def keep(batches, shared=index):
            for batch, first, begin, _ in _occurrences(batches, text, shared.value):
                clean = np.ones(batch.num_rows, bool)
                clean[np.searchsorted(first, begin, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        out = map_whole(out, keep, docs.schema)
    return out


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """Plain Python, for tests: doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(65, 91)}
    cut = lambda t: pattern.findall((t or "").translate(lower))
    out = {}
    for doc, text in docs:
        words = cut(text)
        hit, names = set(), set()
        for name, item in items:
            own = cut(item)
            size = min(window, len(own))
            for i in range(len(own) - size + 1) if own else ():
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own[i : i + size]:
                        hit.update(range(j, j + size))
                        names.add(str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(names), digest, bool(hit))
    return out
