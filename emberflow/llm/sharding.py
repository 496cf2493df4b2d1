"""Shards by a Feistel permutation with cycle walking over global row numbers (operator 12), DataFrame functions only.

Rows are numbered 0 .. n - 1 in the order of their id, size, checksum and content.  A permutation of these numbers
shuffles them: a number is split into a pair (l, r) of Z_a x Z_b with a = ceil(sqrt(n)) and b = ceil(n / a), and rounds
add a keyed function of one half to the other.  The grid has fewer than a numbers too many; whoever lands there walks
on through the permutation until it is back below n.  Position p of the shuffle lies in shard ``p % shards`` at slot
``p // shards``: shards differ by one row at most, slots have no gaps, and both can be computed from the row number
alone, as can the row number from them (:func:`permuted` with ``inverse``).  The law of the contract is `rows`.

No bound is set on a walk: the numbers outside, fewer than sqrt(n) + 1, are walked to their ends once, as a small table,
and rows that come to one of them look its end up.

Numbering takes one shuffle of narrow rows (id, size, checksum, hash): a range sort whose last key is the row's place in
the staged input, so that no number of copies meets in one task, and the counts of the parts, which are as many rows as
there are shuffle partitions.

Results for odd input: a null text has no bytes (size 16, checksum 0), as has an empty one; null ids come first; rows
that are alike are numbered one after the other, which of them first can't be told from the result; very long texts
count by their bytes in `size` only, as the law is `rows`; an empty table gives an empty result; further columns are
ignored by :func:`placements`, whatever their names, and kept by :func:`write_shards`.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import CRC_TABLES, columns_of, crc_sql, stage, unused

SHARDS = 40
SEED = 12
ROUNDS = 6
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: The round function works modulo this prime, so that products stay below 2^62.
_PRIME = 2**31 - 1


def radices(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    return [(draw.randrange(1, _PRIME), draw.randrange(_PRIME)) for _ in range(ROUNDS)]


def _mixed(half: Column, key: tuple[int, int], modulus: int) -> Column:
    x = (half * key[0] + key[1]) % _PRIME
    return x * x % _PRIME * x % _PRIME % modulus


def _once(df: DataFrame, column: str, n: int, seed: int, inverse: bool) -> DataFrame:
    """One application of the permutation of the grid to ``column``."""
    a, b = radices(n)
    left, right = unused(df, "_l", "_r")
    out = df.withColumns({left: F.expr(f"`{column}` div {b}"), right: F.col(column) % b})
    for i, key in (reversed if inverse else list)(list(enumerate(round_keys(seed)))):
        own, other, modulus = (left, right, a) if i % 2 == 0 else (right, left, b)
        step = _mixed(F.col(other), key, modulus)
        out = out.withColumn(own, F.pmod(F.col(own) - step if inverse else F.col(own) + step, F.lit(modulus)))
    return out.withColumn(column, F.col(left) * b + F.col(right)).drop(left, right)


def walks(spark: SparkSession, n: int, seed: int = SEED, inverse: bool = False) -> DataFrame | None:
    """(_out, _in): where a walk that has come to the number ``_out``, not below ``n``, gets back below it.

    Fewer than sqrt(n) + 1 rows; None if the grid has no number too many.  Only numbers that a walk can come to at its
    first step are in it.  Every round walks those on that are not back yet.
    """
    a, b = radices(n)
    if a * b == n:
        return None
    start = spark.range(n, a * b).select(F.col("id").alias("_out"), F.col("id").alias("_in"))
    # staged before it is filtered: a filter pushed below the rounds would repeat their expressions
    now = stage(_once(start, "_in", n, seed, not inverse), "shard-walks").where(F.col("_in") < n).select("_out", F.col("_out").alias("_in"))
    back = now.limit(0)
    while not now.isEmpty():
        now = stage(_once(now, "_in", n, seed, inverse), "shard-walks")
        back, now = back.unionByName(now.where(F.col("_in") < n)), now.where(F.col("_in") >= n)
    return back


def permuted(df: DataFrame, column: str, n: int, seed: int = SEED, inverse: bool = False) -> DataFrame:
    """``column``, a number below ``n``, mapped by the permutation, or back by its inverse."""
    out, back = _once(df, column, n, seed, inverse), walks(df.sparkSession, n, seed, inverse)
    if back is None:
        return out
    # a broadcast of less than sqrt(n) + 1 rows
    joined = out.join(F.broadcast(back), F.col(column) == F.col("_out"), "left")
    return joined.withColumn(column, F.coalesce("_in", column)).drop("_out", "_in")


def numbered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", content: list[Column] | None = None) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row_key, row_no) of every row, and the number of rows.

    ``content`` are the columns that tell rows apart, which ``row_key`` is a hash of: id and text, unless given.
    """
    t = F.col(text)
    bytes_ = F.coalesce(F.octet_length(t), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (bytes_ + ROW_BYTES).alias("size"), F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(*(content or [F.col(doc_id), t])).alias("row_key"))
    narrow = stage(rows, "shard-rows").withColumn("_place", F.monotonically_increasing_id())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32", "row_key", "_place"]
    sorted_ = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_place")
    # the upper bits of the running id are the part's number, the lower ones count its rows
    ranked = stage(sorted_.withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("_at", 33)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ends = counts.agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("all"))  # a row for each shuffle partition
    before = F.aggregate(F.filter("all", lambda p: p["_part"] < F.col("_p")), F.lit(0).cast("long"), lambda acc, p: acc + p["_n"])
    offsets = counts.select(F.col("_part").alias("_p"), "_n").crossJoin(F.broadcast(ends)).select(F.col("_p").alias("_part"), before.alias("_before"), "_n")
    offsets = stage(offsets, "shard-offsets")
    n = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    found = ranked.withColumn("_part", part).join(F.broadcast(offsets.drop("_n")), "_part")
    return found.select("doc_id", "size", "text_crc32", "row_key", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("row_no")), n


def placements(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", content: list[Column] | None = None) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard (null), row_no, row_key."""
    rows, n = numbered(docs, doc_id, text, content)
    placed = permuted(rows.withColumn("_p", F.col("row_no")), "_p", n, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no", "row_key")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes whole rows, as the struct ``row``, to ``folder/shard=k`` in the order of their ``slot``.

    Rows that are alike are sent once and copied to their slots by the join, which Spark splits where one is hot.
    """
    whole = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns_of(docs), docs.schema.fields, strict=True)]
    places = placements(docs, shards, seed, doc_id, text, whole).select("row_key", F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    t = F.col(text)
    key = [F.xxhash64(*whole).alias("row_key"), (F.coalesce(F.octet_length(t), F.lit(0)) + ROW_BYTES).cast("long").alias("_size"), F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("_crc")]
    row = docs.select(*key, F.struct(*columns_of(docs)).alias("row")).groupBy("row_key", "_size", "_crc").agg(F.first("row").alias("row"))
    out = row.join(places, ["row_key", "_size", "_crc"]).select("row", "shard", "slot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)


def read_shard(spark: SparkSession, folder: str, shard: int, schema: StructType | None = None) -> DataFrame:
    """The rows of one shard with their slots."""
    table = (spark.read.schema(schema) if schema else spark.read).parquet(folder)
    return table.where(F.col("shard") == shard).select("row.*", "slot")


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same for DuckDB; the checksum is a fold over the bytes with the table of the reflected polynomial."""

    def mixed(half: str, key: tuple[int, int], modulus: str) -> str:
        x = f"(({half} * {key[0]} + {key[1]}) % {_PRIME})"
        return f"({x} * {x} % {_PRIME} * {x} % {_PRIME} % {modulus})"

    rounds = "".join(
        f", f{i + 1} AS (SELECT * REPLACE (({own} + {mixed(other, key, modulus)}) % {modulus} AS {own}) FROM f{i})"
        for i, key in enumerate(round_keys(seed))
        for own, other, modulus in [("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")]
    )
    # the grid is permuted whole, so that a walk is a path through a table
    return f"""
WITH RECURSIVE {CRC_TABLES},
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + {ROW_BYTES} AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crcs),
numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS row_no FROM d),
dims AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
f0 AS (SELECT x, n, a, b, x // b AS l, x % b AS r FROM dims, LATERAL (SELECT unnest(range(a * b)) AS x)){rounds},
step AS (SELECT x, n, l * b + r AS y FROM f{ROUNDS}),
walk(x, n, y) AS (SELECT x, n, y FROM step WHERE x < n UNION ALL SELECT w.x, w.n, s.y FROM walk w JOIN step s ON s.x = w.y WHERE w.y >= w.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INTEGER) AS shard, y // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard, row_no
FROM numbered JOIN (SELECT x, y FROM walk WHERE y < n) ON x = row_no"""
