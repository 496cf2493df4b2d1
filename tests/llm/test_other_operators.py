"""URLs, licences and neighbours against DuckDB or brute force; the pipeline; and the registry."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberflow.llm import ann, decontam, licences, neardup, suffixes, urls
from emberflow.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_urls(spark):
    rows = [(1, None), (2, "nourl"), (3, "http://NET/"), (4, "http://a.net"), (5, "https://x.Example.NET/en/a?b"), (6, "http://example.com/de/#x"), (7, "ftp://ab.org/fr/"), (8, "http://badexample.net/en/"), (9, "http://c.com/Best-CASINO/x"), (10, "http://c.com/casinos"), (11, "a://b://net/"), (12, "http://É.org/fr/é"), (14, "http://écasino.com/"), (15, "http://x.com/é/xxx"), (13, ""), (13, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert sorted(map(tuple, urls.judged(df).collect())) == sorted(con.sql(urls.ORACLE).fetchall())
    assert urls.judged(df.limit(0)).count() == 0
    assert urls.judged(df, rules=[]).where("verdict <> 'allow'").count() == 0


def test_url_rules_index_complete_tokens_only():
    assert urls.host_rule("block", "a.net/en/x").tokens == ("a", "net", "en")
    with pytest.raises(ValueError):
        urls.judged(None, rules=[urls.Rule("r", "block", ".", ())])


def test_url_rules_of_a_table(spark):
    words = [f"bad{i}" for i in range(2000)] + ["Two-Words", "é"]
    hosts = [f"h{i}.Org/p/" for i in range(1000)]
    rows = [("word", "block", w) for w in words] + [("host", "block", h) for h in hosts] + [("host", "allow", "h7.org/p/q"), ("word", "block", None), ("word", "block", "bad1")]
    table = spark.createDataFrame(rows, "kind string, verdict string, text string")
    rules = urls.rules_from(table)
    assert len(rules) == len(words) + len(hosts) + 1
    with pytest.raises(ValueError):
        urls.rules_from(table, most=3000)
    found = [f"http://a{i}.com/x/BAD{i}-y" for i in range(0, 2400, 80)] + [f"http://w.h{i}.org/p/q" for i in (3, 7, 999, 1000)]
    found += ["http://a.com/two-words", "http://two-words2.com/", "http://É.com/é", "http://a.com/" + "x/" * 40000 + "bad5", None]
    judged = urls.judged(spark.createDataFrame(list(enumerate(found)), "page_id long, url string"), rules=rules).collect()
    expressions = [(r, re.compile(r.pattern)) for r in rules]
    for row in judged:
        fits = [r for r, e in expressions if e.search("\n".join(urls.split(found[row["page_id"]])))]
        best = min(fits, key=lambda r: (-r.weight, r.name), default=None)
        assert (row["rule"] or row["pattern"], row["verdict"]) == ((best.name, best.verdict) if best else (None, "allow"))
    # common tokens (org, p) index nothing where a rarer one is at hand
    tokens = [urls.tokens(*urls.split(u)) for u in found]
    index = urls.index_of(rules, {t: sum(t in own for own in tokens) for own in tokens for t in own})
    assert max(sum(len(index.get(t, ())) for t in own) for own in tokens) <= 3


def test_licences(spark):
    rows = [(1, None), (2, ""), (3, "Under the MIT license. UNDER the MIT\nLicense; under the mit licénse"), (4, "cc-by-nc cc by nc"), (4, "under the GNU general public license version 3"), (6, "apache license version 2 apache license version 20 apache License, Version 2.0"), (8, "é ß under the mit license 中文"), (9, "\x00cc\x00by\x00nc"), (10, "x " * 3000 + "cc by nc")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(map(tuple, licences.scanned(df).collect()), key=str) == sorted(con.sql(licences.oracle()).fetchall(), key=str)
    assert licences.scanned(df.limit(0)).count() == 0


def test_licences_stay_out_of_python(spark):
    plan = licences.scanned(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 32))
    x[100:200] = x[100]  # ties
    odd = [(2000, None), (2001, []), (2002, [0.0] * 32), (2020, [float("nan")] * 32), (2040, [None] * 32), (2060, [1.0])]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(*o, 1) for o in odd], "vec_id long, embedding array<double>, score int")
    got = ann.nearest(df).toPandas()
    assert set(got.query_id) == set(range(0, 900, 20))
    hits = 0
    for q, g in got.groupby("query_id"):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(900), -s))[:20]
        g = g.sort_values("rank")
        assert np.allclose(g.score, s[g.vec_id], rtol=0, atol=1e-12)
        hits += len(set(want) & set(g.vec_id))
    assert hits >= 0.99 * 20 * got.query_id.nunique()
    assert ann.nearest(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((20, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    low, high = ann.bounds(*ann.encode(x, turn), q, turn)
    exact = q @ x.T
    assert ((low <= exact) & (exact <= high)).mean() > 0.995


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_against_plain_python(spark, monkeypatch):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from emberflow.llm import bpe, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe"]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scores(docs, model).where("toxic").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    kept = {r[0] for r in neardup.brute_force(rows, width=5) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    cut = dict(zip([i for i, _ in rows], _without_passages([t for _, t in rows]), strict=True))
    left = [(i, cut[i]) for i, t in rows if cut[i] or not t]
    assert len(left) > 100
    assert any(t != cut[i] for i, t in rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {k for k, v in decontam.brute_force(left, items).items() if v[4]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == {i for i, _ in left} - dirty
    assert all(out[i].decoded == (t or "") for i, t in left if i in out)
    for name, f in corpus_pipeline.STAGES[:4]:
        assert f(spark, docs, SF).columns == docs.columns, name
    assert bpe.Vocabulary


def _without_passages(texts, length=240, words=50):
    """Brute force: texts without covered stretches of over ``words`` words."""
    count = {}
    raw = [(t or "").encode() for t in texts]
    for r in raw:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for t, r in zip(texts, raw, strict=True):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept, at = b"", 0
        for run in re.finditer(b"\1+", gone):
            inside = r[run.start() : run.end()].lower()
            if len(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", inside)) > words:
                kept, at = kept + r[at : run.start()], run.end()
        kept += r[at:]
        out.append(t if kept == r else kept.decode("utf-8", "ignore"))
    return out


def test_pipeline_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "no id here"), (10**6 + 2, "twice the same"), (10**6 + 2, "twice the same"), (10**6 + 3, "long words " * 40000)], "doc_id long, text string")
    odd = odd.select("doc_id", "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c not in ("doc_id", "text")])
    for name, table in (("all", docs.unionByName(odd)), ("none", docs.limit(0))):
        folder = tmp_path / name
        table.withColumn("pick", F.lit(1)).withColumn("_spans", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{other}.parquet").write.parquet(f"{folder}/{other}.parquet")
        out = corpus_pipeline.run(spark, str(folder)).collect()
        got = [(r.doc_id, r.decoded) for r in out]
        if name == "none":
            assert not got
        else:
            assert {(10**6, ""), (10**6 + 1, ""), (None, "no id here"), (10**6 + 2, "twice the same")} <= set(got)
            assert got.count((10**6 + 2, "twice the same")) == 1


def test_columns_with_clashing_names(spark):
    names = ["pick", "_pick", "other", "again", "rid", "_rid", "spans", "_spans", "Set", "a.b"]
    rows = [(i, "some words of a text that is repeated here " * 3 + str(i % 3), *range(len(names))) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [tuple(r)[2:] for r in kept.collect()] == [tuple(range(len(names)))]
    cut = suffixes.without_repeats(docs, length=20, gram=6)
    assert cut.columns == docs.columns
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in cut.collect())
    items = spark.createDataFrame([("i", "a text that is repeated here some words of a")], "item_id string, text string")
    assert decontam.decontaminate(docs, items).where("n_hit > 0").count() == 9
    assert decontam.clean_documents(docs, items).columns == docs.columns


def test_groups_of_items_after_a_reshuffle(spark):
    rows = [(i % 7, f"w{i % 3} " + " ".join(f"v{j}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(f"i{k}", " ".join(f"v{j}" for j in range(k, k + 12))) for k in range(15)], "item_id string, text string")
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("doc_id", "n_words", "n_hit", "begins", "ends", "items").collect())
    assert key(decontam.decontaminate(docs, items, group_bytes=200)) == key(decontam.decontaminate(docs, items))
