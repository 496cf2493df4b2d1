"""Exact repeated byte strings by a common-prefix-aware distributed merge sort of suffixes (operator 8).

Every byte covered by a ``length``-byte string that also starts anywhere else is found, exactly, without sorting the
suffix of every byte:

* *Which suffixes.*  Each ``length``-byte string owns the leftmost of its smallest ``gram``-byte gram hashes.  Equal
  strings own the same gram at the same offset, so only suffixes that start at owned grams (about 2 in
  ``length - gram``) matter, each with at most ``length`` bytes to its right and ``length - gram`` to its left.
  Suffixes whose gram occurs once in the corpus cannot match and go before anything is exchanged.
* *Runs.*  Each task sorts its suffixes and front-codes them (bytes shared with the predecessor, then the rest), with
  equal contexts stored once.  Suffixes of one gram belong to one part, by the gram's hash, and a run is cut into its
  parts: nothing has to be sampled, and no list of splitters grows with the corpus.
* *Merge.*  Each part is merged by a loser tree that carries, with every head, the prefix it shares with the last
  winner: heads are compared by these numbers first and by bytes only beyond a known prefix.
* *Extension.*  While winners come out in order, suffixes with a common gram are united along the tree of their common
  prefixes, small sets into large, each set ordered by the bytes to the left and kept in chunks.  Neighbours in that
  order give, for every suffix, the longest reach to the left and right over all partners with left + right >=
  ``length``: each suffix is inserted O(log n) times for a gram of n different contexts, at a cost of O(sqrt n) at most.

Several lengths are judged in one pass: strings of the longest hold strings of the shortest, whose anchors serve all.
Texts that occur more than once are represented by one copy, and are covered as a whole when ``length`` bytes long.

Memory: a part holds ``RANGE_BYTES`` of contexts on average; what all texts share with the same surroundings is one
context in a run.  A gram with many different surroundings stays in one part, as its suffixes must meet.

Results for odd input: null counts as empty; texts shorter than ``length`` keep everything; repeated ids and null ids
are judged row by row; very long texts are handled alone, whole; ties can't arise, as all of equal strings count; an
empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, columns_of, drop_staged, map_whole, slice_hashes, stage, text_blocks, unused, word_spans

LENGTH = 400
GRAM = 128
#: A passage of over 50 words takes 254 bytes or more in 99 of 100 cases (measured on the synthetic texts).
PASSAGE_LENGTH = 240
PASSAGE_GRAM = 64
PASSAGE_WORDS = 50
RUN_BYTES = 24 << 20
RANGE_BYTES = 12 << 20


def _keys(doc_id: str, text: str) -> list:
    """rid stands for a text and pick for one of its copies: both follow from a row's content, so that they are the same
    whenever and however often it is read (two texts share a rid with a probability of 2 ** -64)."""
    return [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("rid"), F.xxhash64(F.col(doc_id)).alias("pick")]


# --- which suffixes --------------------------------------------------------------------------------


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U64).max, U64)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the grams owned by the ``length``-byte strings of each text."""
    none = np.zeros(0, np.int64), np.zeros(0, U64)
    if len(data) < length:
        return none
    starts = np.arange(len(data) - gram + 1)
    hashes = slice_hashes(data, starts, starts + gram)
    least = _sliding_min((hashes & U64(0xFFFFFFFF00000000)) | starts.astype(U64), length - gram + 1)
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= length)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - length + 1, -1)
    own = least[np.cumsum(inside)[: len(least)] > 0]
    if not len(own):
        return none
    at = (own & U64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, hashes[at]


def _anchor_table(rows: DataFrame, classes: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, place in the text, gram hash) of one copy of each text."""

    def scan(batches):
        for batch, data, offs in text_blocks(batches):
            at, hashes = anchors(data, offs, length, gram)
            cut = np.searchsorted(at, offs)
            full = np.flatnonzero(np.diff(cut) > 0)
            places, grams = at.astype(np.int64), hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(full)) for c in ("rid", "pick")), pa.array([(places[cut[i] : cut[i + 1]] - offs[i]).tobytes() for i in full], pa.binary()), pa.array([grams[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary())],
                names=["rid", "pick", "places", "grams"],
            )

    def unpack(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                places, grams = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<i8") for c in ("places", "grams"))
                count = pc.binary_length(part.column("places")).to_numpy() // 8
                yield pa.RecordBatch.from_pydict({"rid": np.repeat(part.column("rid").to_numpy(), count), "at": places, "gram": grams})

    packed = rows.select("rid", "pick", "text").mapInArrow(scan, "rid long, pick long, places binary, grams binary")
    return packed.join(classes.select("rid", "pick"), ["rid", "pick"], "left_semi").mapInArrow(unpack, "rid long, at long, gram long")


# --- runs ------------------------------------------------------------------------------------------


def _front_code(entries: list[tuple[bytes, bytes, list]]) -> dict:
    """A sorted run as columns: shared prefix, rest of the right bytes, left bytes, places."""
    rights = [e[0] for e in entries]
    common = np.zeros(len(rights), np.int64)
    for i in range(0, len(rights) - 1, 4096):
        part = rights[i : i + 4097]
        size = np.array([len(x) for x in part])
        width = int(size.max())
        grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        differ = grid[1:] != grid[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[i + 1 : i + len(part)] = np.minimum(first, np.minimum(size[1:], size[:-1]))
    return {
        "common": common.astype("<u2").tobytes(),
        "rest": np.array([len(x) for x in rights] - common, "<u2").tobytes(),
        "right": b"".join(x[c:] for x, c in zip(rights, common.tolist(), strict=True)),
        "lefts": np.array([len(e[1]) for e in entries], "<u2").tobytes(),
        "left": b"".join(e[1] for e in entries),
        "times": np.array([len(e[2]) for e in entries], "<u4").tobytes(),
        "rid": np.array([p[0] for e in entries for p in e[2]], "<i8").tobytes(),
        "at": np.array([p[1] for e in entries for p in e[2]], "<i8").tobytes(),
    }


_RUN = "part int, common binary, rest binary, right binary, lefts binary, left binary, times binary, rid binary, at binary"


def _runs(parts: int, length: int, least: int, gram: int):
    """mapInArrow function: (rid, text, places) to front-coded sorted runs, one row for each part."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        entries = sorted(held.values())
        first = [0, *(i for i in range(1, len(entries)) if entries[i][0] != entries[i - 1][0]), len(entries)]
        for a, b in zip(first, first[1:], strict=False):
            if b > a:
                row = _front_code([e[1:] for e in entries[a:b]])
                yield pa.RecordBatch.from_arrays([pa.array([entries[a][0]], pa.int32()), *(pa.array([v], pa.binary()) for v in row.values())], names=["part", *row])

    def work(batches):
        held: dict = {}
        size = 0
        for batch, data, offs in text_blocks(batches):
            places = batch.column("places")
            flat, count = places.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(places).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), count)
            at = flat.astype(np.int64) + offs[row]
            lo, hi = np.maximum(at - (length - gram), offs[row]), np.minimum(at + length, offs[row + 1])
            part = (slice_hashes(data, at, at + gram) % U64(parts)).astype(np.int64)
            # equal contexts are stored once: by the hashes of both sides
            right, left = slice_hashes(data, at, hi), slice_hashes(data, lo, at)
            rid, raw = batch.column("rid").to_numpy()[row].tolist(), data.tobytes()
            for key, p, a, b, c, r, x in zip(zip(right.tolist(), left.tolist(), strict=True), part.tolist(), at.tolist(), lo.tolist(), hi.tolist(), rid, flat.tolist(), strict=True):
                own = held.get(key)
                if own is None:
                    held[key] = (p, raw[a:c], raw[b:a][::-1], [(r, x)])
                    size += c - b + 200
                else:
                    own[3].append((r, x))
                    size += 80
            if size > RUN_BYTES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    return work


def _read_run(run: dict) -> Iterator[tuple[bytes, int, bytes, tuple]]:
    """(right bytes, prefix shared with the predecessor, left bytes reversed, places) in order."""
    common, rest, lefts, times = (np.frombuffer(run[k], t).tolist() for k, t in (("common", "<u2"), ("rest", "<u2"), ("lefts", "<u2"), ("times", "<u4")))
    rid, at = np.frombuffer(run["rid"], "<i8"), np.frombuffer(run["at"], "<i8")
    right, left, last, i, j, k = run["right"], run["left"], b"", 0, 0, 0
    for c, n, m, t in zip(common, rest, lefts, times, strict=True):
        last = last[:c] + right[i : i + n]
        yield last, c, left[j : j + m], (rid[k : k + t], at[k : k + t])
        i, j, k = i + n, j + m, k + t


# --- merge -----------------------------------------------------------------------------------------


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Bytes that a and b share at the front; the first ``known`` are known to be equal."""
    h, n = known, min(len(a), len(b))
    while h < n:
        x, y = a[h : h + 64], b[h : h + 64]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return h + m - (differ.bit_length() + 7) // 8
        h += len(x)
    return n


def merge_runs(runs: list) -> Iterator[tuple[bytes, int, bytes, tuple]]:
    """Merges iterators of (string, prefix shared with the predecessor, ...) by a loser tree of known prefixes."""
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # prefix that a head shares with the last winner

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        p, q = known[i], known[j]
        if p != q:
            return (i, j) if p > q else (j, i)
        a, b = x[0], y[0]
        h = shared_prefix(a, b, p)
        if a[h : h + 1] <= b[h : h + 1]:
            known[j] = h
            return i, j
        known[i] = h
        return j, i

    loser = [0] * k
    winners = list(range(k))
    size = k
    while size > 1:  # each level of the tree, from the leaves
        size //= 2
        nxt = []
        for n in range(size):
            w, lost = play(winners[2 * n], winners[2 * n + 1])
            loser[size + n] = lost
            nxt.append(w)
        winners = nxt
    w = winners[0]
    while heads[w] is not None:
        head = heads[w]
        yield head[0], known[w], head[2], head[3]
        heads[w] = new = next(runs[w], None)
        known[w] = new[1] if new is not None else 0
        n = (k + w) // 2
        while n:
            w, loser[n] = play(w, loser[n])
            n //= 2


# --- extension -------------------------------------------------------------------------------------


class Shelf:
    """A sorted list in chunks, so that an insertion moves the items of one chunk only."""

    SIZE = 512

    def __init__(self, item: tuple):
        self.chunks, self.n = [[item]], 1

    def __iter__(self) -> Iterator[tuple]:
        for chunk in self.chunks:
            yield from chunk

    def put(self, item: tuple) -> list[tuple]:
        """Inserts ``item`` and returns its neighbours."""
        c = max(bisect_right(self.chunks, item, key=lambda x: x[0]) - 1, 0)
        chunk = self.chunks[c]
        i = bisect_left(chunk, item)
        beside = []
        if i or c:
            beside.append(chunk[i - 1] if i else self.chunks[c - 1][-1])
        if i < len(chunk) or c + 1 < len(self.chunks):
            beside.append(chunk[i] if i < len(chunk) else self.chunks[c + 1][0])
        chunk.insert(i, item)
        self.n += 1
        if len(chunk) > self.SIZE:
            self.chunks[c : c + 1] = [chunk[: self.SIZE // 2], chunk[self.SIZE // 2 :]]
        return beside


def _reach(merged: Iterator[tuple[bytes, int, bytes, tuple]], lengths: tuple[int, ...], gram: int) -> Iterator[tuple[tuple, list[tuple[int, int, int]]]]:
    """(places, [(which length, left, right)]) of suffixes with a repeated string of a length across their gram."""
    least = min(lengths)

    def unite(one: Shelf, two: Shelf, depth: int) -> Shelf:
        """Sets ordered by left bytes, whose suffixes share ``depth`` bytes to the right."""
        if one.n < two.n:
            one, two = two, one
        for item in two:
            for other in one.put(item):
                left = shared_prefix(item[0], other[0])
                if left + depth < least:
                    continue
                for k, length in enumerate(lengths):
                    if left + depth >= length:
                        for e in (best[item[1]][k], best[other[1]][k]):
                            e[0], e[1] = max(e[0], left), max(e[1], depth)
        return one

    best: list[list[list[int]]] = []
    held: list[tuple] = []
    stack: list[tuple[Shelf, int]] = []
    now: Shelf | None = None

    def finish() -> Iterator[tuple]:
        nonlocal now
        while stack:
            under, depth = stack.pop()
            now = unite(under, now, depth)
        for places, own in zip(held, best, strict=True):
            good = [(k, left, right) for k, (left, right) in enumerate(own) if left + right >= lengths[k]]
            if good:
                yield places, good
        best.clear()
        held.clear()
        now = None

    for right, common, left, places in merged:
        if common < gram:
            yield from finish()
        elif now is not None:
            while stack and stack[-1][1] >= common:
                under, depth = stack.pop()
                now = unite(under, now, depth)
            stack.append((now, common))
        several = len(places[0]) > 1
        best.append([[min(len(left), n - gram), min(len(right), n)] if several else [0, 0] for n in lengths])
        held.append(places)
        now = Shelf((left, len(best) - 1))
    yield from finish()


def _merge_ranges(lengths: tuple[int, ...], gram: int):
    """mapInArrow function over runs sorted by part: (rid, which length, lo, hi) of covered stretches."""

    def solve(runs: list[dict]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: np.concatenate(x) for c, x in zip(("rid", "which", "lo", "hi"), zip(*out, strict=True), strict=True)})

        for (own, at), good in _reach(merge_runs([_read_run(r) for r in runs]), lengths, gram):
            out += [[own, np.full(len(own), k, np.int32), at - left, at + right] for k, left, right in good]
            if len(out) >= 8192:
                yield batch()
                out = []
        if out:
            yield batch()

    def work(batches):
        part, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    yield from solve(held)
                    part, held = row["part"], []
                held.append(row)
        yield from solve(held)

    return work


# --- the operator ----------------------------------------------------------------------------------


def _covered(rows: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """(rid, spans) of the texts that hold repeated strings or occur several times.  rows: rid, pick, text."""
    length, least = max(lengths), min(lengths)
    if not 0 < gram < least:
        raise ValueError("gram must be shorter than length")
    classes = rows.groupBy("rid").agg(F.min("pick").alias("pick"), F.count("*").alias("times"), F.first(F.octet_length("text").cast("long")).alias("size"))
    classes = stage(classes.where(F.col("size") >= least), "suffix-classes")
    span = lambda k: F.struct(F.lit(k).alias("which"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"))
    whole = classes.where("times > 1").select("rid", F.array_compact(F.array(*[F.when(F.col("size") >= n, span(k)) for k, n in enumerate(lengths)])).alias("spans"))
    every = stage(_anchor_table(rows, classes, least, gram), "suffix-anchors")
    # only grams that occur again go on; staged, so that the join below sees a plain exchange, whose hot grams Spark can split
    again = stage(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "suffix-grams")
    places = stage(every.join(again, "gram", "left_semi").select("rid", "at"), "suffix-places")
    drop_staged(every, again)
    parts = int(1 + places.count() * (2 * length - gram) // RANGE_BYTES)
    listed = places.groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("places"))
    once = rows.join(listed.join(classes.select("rid", "pick"), "rid").hint("shuffle_hash"), ["rid", "pick"]).select("rid", "text", "places")
    runs = once.mapInArrow(_runs(parts, length, least, gram), _RUN)
    found = runs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge_ranges(lengths, gram), "rid long, which int, lo long, hi long")
    spans = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("which", "lo", "hi"))).alias("spans"))
    out = stage(spans.join(classes.where("times = 1").select("rid"), "rid", "left_semi").unionByName(whole), "suffix-spans")
    drop_staged(places, classes)
    return out


def _covers(spans: list[dict] | None, size: int, which: int) -> np.ndarray:
    """Which of a text's bytes the spans of one length cover."""
    edge = np.zeros(size + 1, np.int32)
    for s in spans or ():
        if s["which"] == which:
            edge[s["lo"]] += 1
            edge[s["hi"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the covered stretches."""
    step = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _wordy(raw: np.ndarray, mask: np.ndarray, words: int) -> np.ndarray:
    """The covered stretches of more than ``words`` words (parts of words count)."""
    if not words or not mask.any():
        return mask
    out = np.zeros(len(mask), bool)
    for a, b in zip(*_stretches(mask), strict=True):
        if len(word_spans(raw[a:b], np.array([0, b - a]))[1]) > words:
            out[a:b] = True
    return out


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM) -> DataFrame:
    """docs' id and text with ``spans``: sorted, possibly overlapping stretches (which length, lo, hi), or null."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_keys(doc_id, text))
    return slim.join(_covered(slim.drop("doc_id"), lengths, gram), "rid", "left").drop("rid", "pick")


def removal_report(docs: DataFrame, length: int = LENGTH, passage_length: int = PASSAGE_LENGTH, gram: int = PASSAGE_GRAM, words: int = PASSAGE_WORDS) -> DataFrame:
    """The digest columns of query op8, and how many stretches of over ``words`` words strings of ``passage_length`` bytes
    that also start elsewhere cover (n_passages), and their bytes (passage_bytes)."""
    table = repeated_spans(docs, lengths=(length, passage_length), gram=gram)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")

    def digest(batches):
        for batch, data, offs in text_blocks(batches):
            out = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                raw = data[offs[i] : offs[i + 1]]
                gone, passages = _covers(spans, len(raw), 0), _wordy(raw, _covers(spans, len(raw), 1), words)
                out.append((len(raw), int(gone.sum()), len(_stretches(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).hexdigest(), len(_stretches(passages)[0]), int(passages.sum())))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=list(names))

    kind = dict(table.dtypes)["doc_id"]
    return table.mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, words: int = 0) -> DataFrame:
    """The documents with repeated strings cut out of their text; those of which nothing is left go.

    Stretches of ``words`` words or fewer stay, if it is over 0.  Where a cut would fall inside a character, the rest of
    that character goes as well.  A column n_chars follows the text; all other columns stay as they are.
    """
    slim = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *_keys(doc_id, text))
    rid, spans = unused(docs, "rid", "spans")
    covered = _covered(slim, (length,), gram).withColumnsRenamed({"rid": rid, "spans": spans})
    joined = docs.withColumn(rid, _keys(doc_id, text)[0]).join(covered, rid, "left").drop(rid)
    names = docs.columns

    def cut(batches):
        for block, data, offs in text_blocks(batches, text):
            values, alive = block.column(text).to_pylist(), np.ones(block.num_rows, bool)
            for i, own in enumerate(block.column(spans).to_pylist()):
                raw = data[offs[i] : offs[i + 1]]
                if own and (gone := _wordy(raw, _covers(own, len(raw), 0), words)).any():
                    values[i] = raw[~gone].tobytes().decode("utf-8", "ignore")
                    alive[i] = bool(values[i])
            columns = [pa.array(values, block.schema.field(text).type) if c == text else block.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(alive))

    out = map_whole(joined, cut, docs.schema)
    if "n_chars" not in names:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(kind)).select(*columns_of(docs))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """Plain Python, for tests: (n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    raw = [(t or "").encode() for t in texts]
    count: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            s = r[i : i + length]
            count[s] = count.get(s, 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), sum(g and not p for p, g in zip([0, *gone], gone, strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


