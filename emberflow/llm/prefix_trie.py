"""The prefix trie of conversations by heavy-path decomposition (operator 13).

A node is a distinct sequence of first turns (role, text); conversations that start with it are its members.  A node's
key is the exclusive or of two 64-bit hashes of (position, turn) over its turns, with its depth: all prefixes of a
conversation come from one running aggregate, and two different prefixes share a key with a probability of 2^-128.

Sums over subtrees come from heavy paths: each node's largest child (most members, then smallest conversation) goes on
its path, every other child starts one of its own, as does the root.  A light child has half of its parent's members at
most, so that at most log2(conversations) light nodes lie above any node, and a conversation's light nodes are a short
array, which tells every node its path and every path the node that it hangs from.  Paths' totals are then attached to
their parents level by level, deepest first, in as many rounds as there are levels, over a table of a row for each path;
at the end one suffix sum runs along each path's nodes in the order of depth.

Long conversations are split: turns are numbered by a range sort whose parts are counted, running hashes restart with
each part (the at most two parts a boundary that share a conversation are broadcast), and paths are summed in chunks of
``CHUNK`` nodes.  Nodes that many conversations share are merged before they are exchanged; hashes over the members that
end at a node are fed from pieces of ``PIECE`` bytes, in order, holding one piece at a time.

With ``period`` p > 0 conversations are rebuilt first: of every conversation c the first h = crc32(decimal c) % ``most``
turns are replaced by those of conversation c - c % p (as many as it has; none, if it is absent).

Results for odd input: null role or text is empty; null turns come first; turns of one number are ordered by role, then by
checksum and hash of the text; repeated rows are turns each; rows with a null conv_id take no part; conversations of which
rebuilding leaves no turn are members of the root; very long texts count whole; an empty table has no root and gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import CRC_TABLES, crc_sql, stage

#: Fixed values of the contract: whose turns replace the first ones, and how many are replaced (below MOST).
PERIOD = 20
MOST = 4
WORD = r"[^\x20\x09-\x0D]+"
#: Nodes of a path, and bytes of joined ids, that are handled at once.
CHUNK = 4096
PIECE = 1 << 16

_KEY = ["depth", "k1", "k2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns with hashes and words in order (conv, part, at, t1, t2, words), and what each part holds of a conversation
    (conv, part, first, start, length, whole): its first turn in the part, the turns before, all turns."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), F.crc32(t).alias("crc"), F.xxhash64(r, t).alias("t1"), F.xxhash64(F.lit(1), t, r).alias("t2"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))
    narrow = stage(rows, "trie-turns").withColumn("place", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), "role", "crc", "t1", "place"]
    sorted_ = narrow.repartitionByRange(_parts(narrow), *order).sortWithinPartitions(*order)
    # the upper bits of the running id are the part's number
    turns = stage(sorted_.select("conv", "t1", "t2", "words").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "trie-order")
    own = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    spans = spans.select("conv", "part", "first", before.alias("start"), F.sum("n").over(own).alias("length"), (F.count("*").over(own) == 1).alias("whole"))
    return turns, stage(spans, "trie-spans")


def _xor(turns, name: str):
    """Exclusive or of the hashes of (position, turn) over an array of turns."""
    return F.aggregate(turns, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.xxhash64(x["pos"], x[name])))


def members(conversations: DataFrame, period: int = 0, most: int = MOST, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation and depth, from 0: conv, depth, key (k1, k2), parent's key (p1, p2), words of the last
    turn, and whether the conversation ends there."""
    turns, spans = _numbered(conversations, conv_id, turn, role, text)
    placed = lambda rows: rows.join(spans, ["conv", "part"]).withColumn("pos", F.col("start") + F.col("at") - F.col("first") + 1)
    convs = spans.groupBy("conv").agg(F.max("length").alias("length"))
    if period:
        convs = convs.withColumn("h", (F.crc32(F.col("conv").cast("string")) % most).cast("int"))
        heads = placed(turns.where(F.col("conv") % period == 0)).where(F.col("pos") < most)
        heads = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("heads"))  # below `most` turns
        convs = convs.withColumn("base", F.col("conv") - F.col("conv") % period).join(heads, "base", "left")
        grafted = F.when(F.col("heads").isNull() | (F.col("h") == 0), F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,words:bigint>>")).otherwise(F.slice("heads", 1, F.greatest("h", F.lit(1))))
    else:
        convs = convs.withColumn("h", F.lit(0))
        grafted = F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,words:bigint>>")
    convs = convs.select("conv", "length", "h", grafted.alias("grafted")).withColumn("k", F.size("grafted"))
    convs = stage(convs.withColumn("end", F.col("k") + F.greatest(F.col("length") - F.col("h"), F.lit(0))), "trie-conversations")

    # the root and the grafted turns, fewer than `most`
    few = convs.select("conv", "end", "grafted", F.explode(F.sequence(F.lit(0), "k")).alias("depth"))
    upto = lambda n: F.filter("grafted", lambda x: x["pos"] <= n)
    depth = F.col("depth")
    words = F.when(depth > 0, F.try_element_at("grafted", depth)["words"]).otherwise(0)
    top = few.select("conv", depth.cast("long").alias("depth"), _xor(upto(depth), "t1").alias("k1"), _xor(upto(depth), "t2").alias("k2"), _xor(upto(depth - 1), "t1").alias("p1"), _xor(upto(depth - 1), "t2").alias("p2"), words.cast("long").alias("words"), (depth == F.col("end")).alias("ends"))

    # own turns behind them
    based = spans.join(convs.select("conv", "h", "k", "end", _xor(F.col("grafted"), "t1").alias("g1"), _xor(F.col("grafted"), "t2").alias("g2")), "conv")
    body = turns.join(based, ["conv", "part"]).withColumn("pos", F.col("start") + F.col("at") - F.col("first") + 1).where("pos > h")
    body = body.withColumn("depth", F.col("pos") - F.col("h") + F.col("k")).withColumns({"z1": F.xxhash64("depth", "t1"), "z2": F.xxhash64("depth", "t2")})
    # conversations over several parts: at most two of a boundary between parts, broadcast
    cut = body.where("not whole").groupBy("conv", "part").agg(F.bit_xor("z1").alias("z1"), F.bit_xor("z2").alias("z2"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("conv", "part", F.bit_xor("z1").over(earlier).alias("e1"), F.bit_xor("z2").over(earlier).alias("e2"))
    running = Window.partitionBy("conv", "part").orderBy("depth")
    run = body.select("conv", "part", "depth", "words", "end", "g1", "g2", "z1", "z2", F.bit_xor("z1").over(running).alias("r1"), F.bit_xor("z2").over(running).alias("r2")).join(F.broadcast(cut), ["conv", "part"], "left")
    key = lambda i: F.col(f"r{i}").bitwiseXOR(F.col(f"g{i}")).bitwiseXOR(F.coalesce(f"e{i}", F.lit(0)))
    low = run.select("conv", "depth", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("z1")).alias("p1"), key(2).bitwiseXOR(F.col("z2")).alias("p2"), "words", (F.col("depth") == F.col("end")).alias("ends"))
    return top.unionByName(low)


def _pieces(most: int = PIECE):
    """mapInArrow function over members sorted by node and id: (node, first id, ids joined by commas), in pieces."""

    def work(batches):
        node, first, ids, size = None, 0, [], 0

        def made():
            return pa.RecordBatch.from_pydict({"depth": [node[0]], "k1": [node[1]], "k2": [node[2]], "first": [first], "ids": [",".join(ids)]})

        for batch in batches:
            for *own, c in zip(*(batch.column(x).to_pylist() for x in (*_KEY, "conv")), strict=True):
                if ids and (own != node or size > most):
                    yield made()
                    ids, size = [], 0
                if not ids:
                    node, first = own, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield made()

    return work


def _digest(batches):
    """Pieces sorted by node and first id: the hash of each node's ids."""
    node, sha = None, None
    for batch in batches:
        out: dict = {"depth": [], "k1": [], "k2": [], "sha": []}
        for *own, ids in zip(*(batch.column(x).to_pylist() for x in (*_KEY, "ids")), strict=True):
            if own != node:
                if node is not None:
                    for c, x in zip(out, (*node, sha.hexdigest()), strict=True):
                        out[c].append(x)
                node, sha = own, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sha", pa.string())]))
    if node is not None:
        yield pa.RecordBatch.from_pydict({"depth": [node[0]], "k1": [node[1]], "k2": [node[2]], "sha": [sha.hexdigest()]})


def _ends(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2, sha) of nodes at which several conversations end."""
    several = rows.where("ends").join(nodes.where("n_ends > 1").select(_KEY), _KEY, "left_semi").select(*_KEY, "conv")
    order = [*_KEY, "conv"]
    pieces = several.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).mapInArrow(_pieces(), "depth long, k1 long, k2 long, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digest, "depth long, k1 long, k2 long, sha string")


def _shape(rows: DataFrame) -> DataFrame:
    """Nodes with their counts, children, and whether they start a path."""
    nodes = stage(rows.groupBy(_KEY).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv"))).alias("end")), "trie-nodes")
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("c"), "k1", "k2"))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), largest.alias("heavy"))
    kids = stage(kids, "trie-children")
    heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("heavy.k1").alias("k1"), F.col("heavy.k2").alias("k2"), F.lit(True).alias("heavy"))
    return stage(nodes.join(kids.drop("heavy"), _KEY, "left").join(heavy, _KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "light": F.col("heavy").isNull()}).drop("heavy"), "trie-shape")


def _on_paths(rows: DataFrame, shape: DataFrame) -> DataFrame:
    """Nodes with their path (the key of its first node), its level, and the path that it hangs from."""
    lights = rows.select("conv", *_KEY).join(shape.where("light").select(_KEY), _KEY)
    lights = lights.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_KEY))).alias("lights"))  # log2(conversations) + 1 at most
    both = shape.join(lights, shape["conv_id"] == lights["conv"])
    above = F.filter("lights", lambda x: x["depth"] <= F.col("depth"))
    return stage(both.withColumn("above", above).select(*shape.columns, F.element_at("above", -1).alias("path"), (F.size("above") - 1).alias("level"), F.try_element_at("above", F.lit(-2)).alias("hangs"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")), "trie-paths")


_SUMS = ["leaves", "saved"]


def _attached(nodes: DataFrame) -> DataFrame:
    """(depth, k1, k2) of nodes with the totals of all paths that hang from them, level by level from the deepest."""
    totals = nodes.groupBy("path").agg(*[F.sum(c).alias(c) for c in _SUMS])
    heads = nodes.where("light").select("path", "level", "hangs", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    paths = stage(heads.join(totals, "path"), "trie-totals")
    done = []
    for level in range(paths.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], 0, -1):
        own = paths.where(F.col("level") == level)
        if done:
            below = done[-1].groupBy(F.col("hangs").alias("path")).agg(*[F.sum(c).alias(f"_{c}") for c in _SUMS])
            own = own.join(below, "path", "left").select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in _SUMS else F.col(c) for c in paths.columns])
        done.append(stage(own, "trie-level"))
    every = paths.limit(0)
    for part in done:
        every = every.unionByName(part)
    return every.groupBy(_KEY).agg(*[F.sum(c).alias(f"_{c}") for c in _SUMS])


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """Nodes with leaves and saved summed over their subtrees: suffix sums along the paths, chunk by chunk."""
    chunk = F.expr(f"(depth - path.depth) div {CHUNK}")
    full = nodes.join(_attached(nodes), _KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in _SUMS}).drop("_leaves", "_saved").withColumn("chunk", chunk)
    full = stage(full, "trie-sums")
    down = Window.partitionBy("path", "chunk").orderBy(F.desc("depth"))
    later = full.where("chunk > 0").groupBy("path", "chunk").agg(*[F.sum(c).alias(c) for c in _SUMS])
    behind = Window.partitionBy("path").orderBy(F.desc("chunk"))
    later = later.select("path", (F.col("chunk") - 1).alias("chunk"), *[F.sum(c).over(behind).alias(f"_{c}") for c in _SUMS])
    summed = full.withColumns({c: F.sum(c).over(down) for c in _SUMS}).join(later, ["path", "chunk"], "left")
    return summed.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in _SUMS}).drop("_leaves", "_saved")


def prefix_trie(conversations: DataFrame, period: int = 0, **columns) -> DataFrame:
    """A row for each node: conv_id (its smallest member) and depth name it; parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, level (light nodes above it) and n_ends."""
    rows = stage(members(conversations, period, **columns), "trie-members")
    shape = _shape(rows)
    summed = _subtree_sums(_on_paths(rows, shape))
    parent = shape.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = summed.join(parent, ["depth", "p1", "p2"], "left").join(_ends(rows, shape), _KEY, "left")
    sha = F.coalesce("sha", F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256))
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"), "level", "n_ends")


#: The same for DuckDB, over whole prefixes.
ORACLE = f"""
WITH RECURSIVE {CRC_TABLES},
turns AS (SELECT conv_id AS c, coalesce(text, '') AS text, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {crc_sql("CAST(c AS VARCHAR)")} % {MOST} AS h FROM (SELECT DISTINCT c FROM turns), crcs),
rebuilt AS (SELECT v.c, 0 AS own, b.pos, b.id, b.text FROM convs v JOIN turns b ON b.c = v.c - v.c % {PERIOD} AND b.pos <= v.h UNION ALL SELECT c, 1, pos, id, text FROM turns JOIN convs USING (c) WHERE pos > h),
ordered AS (SELECT c, text, list(id) OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
members AS (SELECT c, text, path FROM ordered UNION ALL SELECT c, '', CAST([] AS VARCHAR[]) FROM convs),
ended AS (SELECT c, max(len(path)) AS depth FROM members GROUP BY c),
nodes AS (SELECT path, len(path) AS depth, min(m.c) AS conv_id, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words, string_agg(m.c, ',' ORDER BY m.c) FILTER (WHERE e.depth = len(path)) AS ids FROM members m JOIN ended e USING (c) GROUP BY path),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (SELECT u.path[1:d] AS path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM nodes u LEFT JOIN kids k USING (path), LATERAL (SELECT unnest(range(u.depth + 1)) AS d) GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(v.ids, '')) AS ends_sha256
FROM nodes v JOIN sums USING (path) LEFT JOIN kids k USING (path) LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1]"""
