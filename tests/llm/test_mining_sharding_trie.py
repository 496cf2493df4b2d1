"""Hard negatives, sharding and the prefix trie against brute force and DuckDB, on odd rows and on the given tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberflow.llm import negatives, prefix_trie, sharding
from emberflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_sharding", "op13_prefix_trie"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


# --- hard negatives --------------------------------------------------------------------------------


def mined_by_hand(rows, every=100):
    kept = {(i, v if i % 7 else 0, l if i % 7 else (l + 1) % 10, v) for i, v, l in ((i, tuple(v) if v is not None else None, l) for i, v, l in rows) if None not in (i, v, l) and all(x is not None and math.isfinite(x) for x in v)}
    clean = sorted({(i, l, tuple(math.floor(256 * x) for x in v)) for i, _, l, v in kept})
    clean = [r for r in clean if sum(x * x for x in r[2]) < 2**56]
    out = []
    for a, label, q in clean:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i, l) for i, l, p in clean if i != a and len(p) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [(i, -n) for n, i, l in scored if l != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, p, rank, i, -s, n) for rank, (i, n) in enumerate(fits, 1)]
    return sorted(out)


def test_negatives_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.01, 1, 50])], int(rng.integers(4))) for i in range(400)]
    rows += [(None, [1.0] * 4, 1), (700, None, 1), (701, [1.0] * 4, None), (702, [1.0, None, 1.0, 1.0], 1), (703, [1.0, float("nan"), 1.0, 1.0], 1), (704, [float("inf")] * 4, 2)]
    rows += [(800, [0.0] * 4, 0), (900, [], 1), (1000, [1.0, 2.0], 1), (1001, [1.0, 2.5], 1), (1002, [0.5, 1.0], 2), (1100, [2.0**40] * 4, 0), (901, [], 1), (902, [], 2)]
    rows += [rows[100], rows[100], rows[5], (1200, rows[0][1], 0), (1201, rows[0][1], 0), (1202, rows[0][1], 1), (1203, rows[0][1], 1)]
    rows += [(-100, rows[7][1], 2), (1300, [-x for x in rows[0][1]], 1)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, key string, norm double")
    got = negatives.mined(df, relabel=negatives.contract_label())
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows)
    assert negatives.mined(df.limit(0)).count() == 0


def test_lengths_prune(spark):
    """Of vectors with very different lengths most pairs are never multiplied, and nothing is lost."""
    rng = np.random.default_rng(4)
    n = 3000
    vectors = rng.integers(-40, 40, size=(n, 8)) * np.repeat([400, 20, 1], n // 3)[:, None]
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    pack = lambda at, lows=(), highs=(): negatives.Block(negatives._block(8, 0, 0, at.tolist(), at.tolist(), (at % 2).tolist(), vectors[at].tolist(), norms[at].tolist(), lows, highs).to_pylist()[0])
    bucket = [pack(order[i : i + 250]) for i in range(0, n, 250)]
    few = order[:40]
    best, scored = negatives.find(pack(few), bucket, 5, True)
    assert scored < 40 * n / 2
    lows, highs = [[int(norms[i] ** 2 * 0.3)] for i in few], [[int(norms[i] ** 2 * 0.9)] for i in few]
    found, again = negatives.find(pack(few, lows, highs), bucket, 10, False)
    assert again < 40 * n / 2
    table = vectors[few] @ vectors.T
    for i, own in enumerate(few):
        same = [j for j in range(n) if j % 2 == own % 2 and j != own]
        assert best[i][0][1].tolist() == sorted(same, key=lambda j: (-table[i, j], j))[:5]
        fits = [j for j in range(n) if j % 2 != own % 2 and lows[i][0] <= table[i, j] <= highs[i][0]]
        assert found[i][0][1].tolist() == sorted(fits, key=lambda j: (-table[i, j], j))[:10]


# --- sharding --------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 36, 37, 1000, 4099])
def test_permutation_and_inverse(spark, n):
    there = sharding.permuted(spark.range(n).withColumn("p", F.col("id")), "p", n)
    back = sharding.permuted(there.withColumn("q", F.col("p")), "q", n, inverse=True).collect()
    assert sorted(r["p"] for r in back) == list(range(n)) and all(r["q"] == r["id"] for r in back)
    if n > 1000:  # neighbours end up far from each other, as if drawn
        p = np.array([r["p"] for r in sorted(back, key=lambda r: r["id"])], float)
        assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.05 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.05


def test_shards_on_odd_rows(spark, tmp_path):
    rows = [(None, "a"), (None, None), (1, None), (1, ""), (2, "é ß 中文"), (3, "x" * 3_000_000), (-4, "y")] + [(7, "again")] * 700 + [(i, f"t{i % 5}") for i in range(10, 90)]
    df = spark.createDataFrame([(*r, {"a": i % 3}, "s") for i, r in enumerate(rows)], "doc_id long, text string, size map<string,int>, shard string")
    found = sharding.placements(df).drop("row_key")
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").where("length(text) < 1000 or text is null").toPandas())
    again = sharding.placements(df.where("length(text) < 1000 or text is null").repartition(3)).drop("row_key")  # any order, any parts
    assert sorted(map(tuple, again.collect()), key=str) == sorted(con.sql(sharding.oracle()).fetchall(), key=str)
    got = found.collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(by[s]) == list(range(len(by[s]))) for s in by)
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.placements(df.limit(0)).count() == 0
    sharding.write_shards(df, f"file://{tmp_path}/shards", shards=7)
    kept = [sharding.read_shard(spark, f"file://{tmp_path}/shards", s) for s in range(7)]
    assert all(sorted(r["slot"] for r in k.collect()) == list(range(k.count())) for k in kept)
    text = lambda r: (r["doc_id"], r["text"], r["size"]["a"])
    assert collections.Counter(text(r) for k in kept for r in k.collect()) == collections.Counter(text(r) for r in df.collect())


# --- prefix trie -----------------------------------------------------------------------------------


def trie_by_hand(rows, period=20):
    turns = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            turns[c].append((n is not None, n or 0, role or "", zlib.crc32((text or "").encode()), text or ""))
    turns = {c: [(t[2], t[4]) for t in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4 if period else 0
        base = c - int(math.fmod(c, period)) if period else c
        whole[c] = turns.get(base, [])[:h] + own[h:] if period else own
    members = collections.defaultdict(list)
    for c, own in whole.items():
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    sums = collections.defaultdict(lambda: [0, 0])
    for p, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += not kids[p]
            sums[p[:d]][1] += (len(own) - 1) * words
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("chunk", "period"), [(3, 20), (4096, 0)])
def test_trie_on_odd_rows(spark, monkeypatch, chunk, period):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    words = ["a", "b b", "c\tc c", "", "é\n中"]
    rows = [(int(c), int(t), ["user", "system"][int(rng.integers(2))], words[int(rng.integers(3))]) for c in range(-45, 120) if c % 20 or c % 40 for t in range(int(rng.integers(1, 7)))]
    rows += [(200, None, None, "first"), (200, 0, None, None), (200, 0, "user", None), (200, 0, "user", "x"), (200, 0, "user", "x"), (None, 1, "user", "x")]
    rows += [(c, t, "user", f"w {t}") for c in (301, 302, 303, 304) for t in range(4)]  # the same, all ending at one node
    rows += [(c, 0, "user", "alone") for c in range(401, 419)]  # turnless, as their base is absent and h may be over 0
    rows += [(500 + c, t, "user", f"long {t}") for c in (0, 1) for t in range(900)] + [(502, 0, "user", "z " * 600_000)]  # long conversations, over several parts
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 string")
    got = prefix_trie.prefix_trie(df, period)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == trie_by_hand(rows, period)
    assert got.agg(F.max("level")).first()[0] <= math.log2(400)
    assert prefix_trie.prefix_trie(df.limit(0), period).count() == 0


def test_pieces_hash_like_the_whole():
    ids = [3, 10, 11, 12, 500, 501, 502, 9000]
    batch = pa.RecordBatch.from_pydict({"depth": [1] * len(ids) + [2], "k1": [5] * len(ids) + [5], "k2": [6] * len(ids) + [6], "conv": [*ids, 4]})
    pieces = pa.Table.from_batches(list(prefix_trie._pieces(8)([batch])))
    assert pieces.num_rows > 3
    out = pa.Table.from_batches(list(prefix_trie._digest(b for b in pieces.to_batches(max_chunksize=2)))).to_pylist()
    assert [r["sha"] for r in out] == [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in (ids, [4])]
