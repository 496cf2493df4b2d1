"""Helpers that the operators of this subpackage share: staging, Arrow text blocks, hashes, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that one numpy pass handles at once; bounds a Python worker's memory.
BLOCK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


# --- staging ---------------------------------------------------------------------------------------

_own_folder: str | None = None
_open: list[list[DataFrame]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset and Spark is local."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="emberflow-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged = path
    for own in _open:
        own.append(table)
    return table


def drop_staged(*tables: DataFrame) -> None:
    """Delete tables written by :func:`stage`.  Only for those whose readers have all been staged themselves: a lost
    shuffle would be computed again from them."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path is not None:
            df._staged = None
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects what is staged inside: drop_staged(*held) frees it when the results have been written."""
    held: list[DataFrame] = []
    _open.append(held)
    try:
        yield held
    finally:
        _open.pop()


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as ``docs`` has columns that Spark takes for the same."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(docs: DataFrame) -> list[Column]:
    """All columns by their names as they are, dots included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def map_whole(df: DataFrame, function: Callable, schema: StructType) -> DataFrame:
    """mapInArrow over all columns, whose names may hold dots."""
    names, made = df.columns, schema.names
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def work(batches):
        for out in function(b.rename_columns(names) for b in batches):
            yield out.rename_columns(plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(work, plain).toDF(*made)


# --- Arrow text ------------------------------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1, from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (one row at least), with their bytes and offsets."""
    limit = limit or BLOCK_BYTES
    for batch in batches:
        data, offs = text_buffers(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


# --- hashes ----------------------------------------------------------------------------------------

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(12, (n - 1).bit_length())
        base, inverse = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        base[0] = inverse[0] = 1
        with np.errstate(over="ignore"):
            _powers, _inverses = np.cumprod(base), np.cumprod(inverse)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, symbols: np.ndarray = _SYMBOL) -> np.ndarray:
    """64-bit hashes of byte slices: prefix sums of symbol * base^i, shifted back by the slice's start."""
    powers, inverses = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum(symbols[data] * powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U64))


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive values (empty if there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = values[:n].copy()
        for k in range(1, width):
            out *= U64(_BASE)
            out += values[k : n + k]
    return mix(out)


# --- words -----------------------------------------------------------------------------------------


def byte_table(separators: str) -> np.ndarray:
    """Per byte: its lower-cased (A-Z only) value, or 0 if it separates words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for c in separators:
        table[ord(c)] = 0
    return table


#: The word patterns of the contracts, as the bytes that separate words.
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased, and [^\x20\x09-\x0D]+.
ALNUM = byte_table("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
SPACED = byte_table(" \t\n\v\f\r")
_SPACED_LOWER = SPACED.copy()
#: NUL is an ordinary character of [^\x20\x09-\x0D]+; it needs a non-zero stand-in that no UTF-8 text holds.
_SPACED_LOWER[0] = 0xFF


def word_spans(data: np.ndarray, offs: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes as words see them, word starts, word ends, first word of each row and the total)."""
    low = (_SPACED_LOWER if spaced else ALNUM)[data]
    word = low != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offs[:-1][(offs[:-1] < len(data)) & (offs[:-1] > 0)]
    first[edges] |= word[edges]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word of each row with the total."""
    low, starts, ends, rows = word_spans(data, offs, spaced)
    return slice_hashes(low, starts, ends), rows


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.repeat(starts - shift, lengths) + np.arange(total)


def row_shingles(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width``-word shingle of a row; all words of a shorter, non-empty row are one shingle."""
    counts = np.diff(rows)
    full = run_hashes(words, width)
    n = np.maximum(counts - width + 1, 0)
    at = ragged(rows[:-1], n)
    hashes, owner = full[at], np.repeat(np.arange(len(counts)), n)
    for short in range(1, width):
        few = np.flatnonzero(counts == short)
        if len(few):
            own = run_hashes(words, short)[rows[:-1][few]]
            hashes, owner = np.concatenate([hashes, own]), np.concatenate([owner, few])
    return hashes, owner


# --- connected components --------------------------------------------------------------------------


def components(edges: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates the large-star and small-star steps, each a grouped minimum and a join back, and stages the
    edges after every round, so that no node's links meet in one task and lineage stays short.
    """

    def signature(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def minima(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = signature(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # staged, so that the join sees a plain exchange on either side, whose hot nodes Spark can split
        least = stage(minima(both), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = minima(down)
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, now = now, stage(small, name)
        drop_staged(last)
        drop_staged(least)
        before, seen = seen, signature(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"{name}: no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


# --- DuckDB ----------------------------------------------------------------------------------------

#: Tables of WITH RECURSIVE: crcs(t) has the list of the 256 steps of the reflected CRC-32 polynomial.
CRC_TABLES = """bits(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, where crcs is joined."""
    return f"""CAST(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda s, x: xor(s // 256, t[CAST(xor(s % 256, x) AS BIGINT) + 1])), 4294967295) AS BIGINT)"""
