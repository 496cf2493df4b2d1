"""Token ids in canonical length-limited Huffman files (operator 7).

Format.  A written folder holds two Parquet tables, so any store that Spark can reach will do:

* ``code``: (id, bits) - the code length of every id in the corpus.  Codes are canonical: in order of length, then id,
  each code is the last plus one, so lengths are all a reader needs.
* ``blocks``: one row for each block of documents in ascending order - start (ids before it), docs (their ids), sizes
  (number of token ids of each), checkpoints (bit offset of every ``EVERY``-th id), bits (in total) and payload (the
  codes, first bit first).  A block decodes on its own.

Encoding: documents are dealt out in ranges of their id and sorted; one pass turns texts into ids and stages them, each row with the ids before
it in its range; counts are summed over all documents; the package-merge algorithm (Larmore and Hirschberg) gives the best lengths within ``LIMIT`` bits (the
table is as large as the vocabulary, not the corpus); a second pass over the staged ids writes the blocks.

Decoding: the segments between checkpoints are decoded side by side, one id of every segment at a step: a table of
``2 ** limit`` entries tells id and length from the next bits.

Results for odd input: null and empty texts hold only the end id; null document ids come first, repeated ones in the
order of their texts; an empty table gives empty files; further columns are ignored.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TEXT_BYTES, Memo
from .shared import drop_staged, shared_folder, stage, text_blocks

LIMIT = 18
EVERY = 256
#: Ids in a block, at least one document.
BLOCK_IDS = 1 << 18


# --- codes -----------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol with a count, 0 for others: optimal within ``limit``, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need more than {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # level by level: packages of the level below, merged with the symbols; a list is kept as which entries are symbols
    lists, below = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weight, below])
        rank = np.argsort(merged, kind="stable")
        lists.append(rank < n)
        merged = merged[rank]
        below = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * n - 2
    for symbols in reversed(lists):
        singles = int(symbols[:take].sum())
        lengths[order[:singles]] += 1
        take = 2 * (take - singles)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: in order of length, then symbol, each is the last plus one."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    out = []
    for bits in lengths[order].tolist():
        code <<= bits - last
        out.append(code)
        code, last = code + 1, bits
    codes[order] = out
    return codes


class Code:
    """What encoders and decoders need of a code."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.limit = int(max(lengths.max(initial=1), 1))
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        width = 1 << (self.limit - lengths[order])
        self.table_id, self.table_bits = np.zeros(1 << self.limit, np.uint32), np.zeros(1 << self.limit, np.uint8)
        at = int(width.sum())
        self.table_id[:at], self.table_bits[:at] = np.repeat(order, width), np.repeat(lengths[order], width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """(payload, bit offset of every EVERY-th id, bits)."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        total = int(ends[-1]) if len(ids) else 0
        starts = ends - bits
        words = np.zeros(total // 32 + 3, np.uint64)
        if len(ids):
            word, shift = starts >> 5, (64 - bits - (starts & 31)).astype(np.uint64)
            value = self.codes[ids] << shift
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            both = np.bitwise_or.reduceat(value, new)
            words[word[new]] |= both >> np.uint64(32)
            words[word[new] + 1] |= both & np.uint64(0xFFFFFFFF)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], starts[::EVERY], total

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block."""
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at = checkpoints.astype(np.int64).copy()
        out = np.zeros((EVERY, len(at)), np.uint32)
        live, shift = len(at), np.uint32(32 - self.limit)
        rest = n - (len(at) - 1) * EVERY if len(at) else 0
        for k in range(EVERY):
            if k == rest:
                live -= 1
            if not live:
                break
            p = at[:live]
            code = (window[p >> 3] << (p & 7).astype(np.uint32)) >> shift
            out[k, :live] = self.table_id[code]
            at[:live] += self.table_bits[code]
        return out.T.ravel()[:n]


# --- ids -------------------------------------------------------------------------------------------

_memo: dict[str, Memo] = {}


def _library_memo(source: str) -> Memo:
    """Each distinct word is encoded by the tokenizers library, once in a worker."""
    if source not in _memo:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(source)
        library.no_truncation()
        library.no_padding()

        def encode_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            lists = [library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in words]
            return np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)

        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        _memo.clear()
        _memo[source] = Memo(encode_words, special)
    return _memo[source]


def token_rows(docs: DataFrame, path: str, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, ids): ids of a text as little-endian integers of two bytes, or four if the vocabulary needs them, the end id last."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    shared, dtype = docs.sparkSession.sparkContext.broadcast(source), id_type(source)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def work(batches):
        memo = _library_memo(shared.value)
        for batch, data, offs in text_blocks(batches, limit=TEXT_BYTES):
            ids, first = memo.encode(data, offs)
            sizes = np.diff(first) + 1
            flat = np.full(len(ids) + batch.num_rows, end, dtype)
            keep = np.ones(len(flat), bool)
            keep[np.cumsum(sizes) - 1] = False
            flat[keep] = ids
            offsets = pa.array(np.concatenate([[0], flat.itemsize * np.cumsum(sizes)]), pa.int32())
            column = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets.buffers()[1], pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), column], names=["doc_id", "n", "ids"])

    return slim.mapInArrow(work, f"doc_id {kind}, n long, ids binary")


def id_type(source: str) -> str:
    """Two bytes hold the ids of most vocabularies."""
    spec = json.loads(source)
    most = max([0, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if most < 1 << 16 else "<u4"


def _ids_of(column: pa.Array, dtype: str) -> np.ndarray:
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(dtype) if data is not None else np.zeros(0, dtype)


# --- files -----------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, folder: str | None = None, end: int = 0, limit: int = LIMIT, parts: int | None = None) -> str:
    """Encodes ``docs`` (doc_id, text) with the tokenizer at ``path`` into ``folder``, and returns it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    kind = dict(docs.dtypes)["doc_id"]
    with open(path, encoding="utf-8") as f:
        dtype = id_type(f.read())
    # ranges are dealt out before encoding: finding their bounds reads the rows once more
    ranged = docs.repartitionByRange(parts, "doc_id") if parts else docs.repartitionByRange("doc_id")
    ids = token_rows(ranged.sortWithinPartitions("doc_id", "text"), path, end).withColumn("part", F.spark_partition_id())

    def running(batches):
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = total + np.cumsum(n)
            yield batch.append_column("before", pa.array(ends - n))
            total = int(ends[-1]) if len(n) else total

    # a row's place is stored, so that later passes don't depend on how files are dealt to tasks
    staged = stage(ids.mapInArrow(running, f"doc_id {kind}, n long, ids binary, part int, before long"), "packed-ids")

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_ids_of(batch.column("ids"), dtype))
            if len(own) > len(total):
                own[: len(total)] += total
                total = own
            else:
                total[: len(own)] += own
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": k, "n": total[k]})

    sums = staged.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(sums["id"].to_numpy(), default=0)) + 1, np.int64)
    counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "bits": lengths[used]}).to_pandas(), "id long, bits long").coalesce(1).write.parquet(f"{folder}/code")

    # ids before each range: one number for each range
    sizes = {r["part"]: r["n"] for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    shared = spark.sparkContext.broadcast((lengths, before))

    def blocks(batches):
        lengths, first = shared.value
        code = Code(lengths)
        held: list[tuple] = []
        start = next_start = size = 0

        def flush() -> pa.RecordBatch:
            names, sizes = (pa.concat_arrays([h[k] for h in held]) for k in range(2))
            raw = np.concatenate([h[2] for h in held])
            payload, checkpoints, bits = code.encode(raw)
            row = {"start": pa.array([start]), "docs": pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "sizes": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), sizes), "checkpoints": pa.array([checkpoints.tolist()], pa.list_(pa.int64())), "bits": pa.array([bits]), "payload": pa.array([payload], pa.binary())}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            n = batch.column("n").to_numpy()
            place = batch.column("before").to_numpy() + np.array([first[p] for p in batch.column("part").to_pylist()], np.int64)
            i = 0
            while i < batch.num_rows:
                if held and (size >= BLOCK_IDS or place[i] != next_start):
                    yield flush()
                    held, size = [], 0
                if not held:
                    start = int(place[i])
                # rows that follow each other and fit, one at least
                follow = np.append(place[i + 1 :] != place[i:-1] + n[i:-1], True)
                j = min(i + 1 + int(np.argmax(follow)), i + max(1, int(np.searchsorted(np.cumsum(n[i:]), BLOCK_IDS - size, "right"))))
                own = batch.slice(i, j - i)
                held.append((own.column("doc_id"), own.column("n"), _ids_of(own.column("ids"), dtype)))
                size, next_start, i = size + int(n[i:j].sum()), int(place[j - 1] + n[j - 1]), j
        if held:
            yield flush()

    schema = f"start long, docs array<{kind}>, sizes array<long>, checkpoints array<long>, bits long, payload binary"
    staged.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    drop_staged(staged)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what a written folder holds; ids as little-endian 32-bit integers."""
    table = spark.read.parquet(f"{folder}/code").toArrow()
    lengths = np.zeros(int(max(table["id"].to_numpy(), default=0)) + 1, np.int64)
    lengths[table["id"].to_numpy()] = table["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(lengths)
    rows = spark.read.parquet(f"{folder}/blocks")
    kind = dict(rows.dtypes)["docs"].removeprefix("array<")[:-1]

    def work(batches):
        code = Code(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.slice(k, 1)
                sizes = block.column("sizes").flatten().to_numpy()
                ids = code.decode(block.column("payload")[0].as_py(), block.column("checkpoints").flatten().to_numpy(), int(sizes.sum()))
                ends = np.cumsum(sizes)
                offsets = pa.array(np.concatenate([[0], 4 * ends]), pa.int32())
                column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([block.column("docs").flatten(), pa.array(block.column("start")[0].as_py() + ends - sizes), pa.array(sizes), column], names=["doc_id", "start", "n_tokens", "ids"])

    return rows.select("start", "docs", "sizes", "checkpoints", "payload").mapInArrow(work, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_report(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of query op7, from the files."""
    return read(docs.sparkSession, write(docs.select("doc_id", "text"), path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


