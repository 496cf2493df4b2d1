"""Operators over texts against brute force, the library, and odd input."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberflow.llm import bpe, decontam, neardup, packed, passages, suffixes, toxicity
from emberflow.llm.shared import components, text_buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
SOURCE = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(SOURCE)
VOCAB = bpe.Vocabulary(SOURCE)
MEMO = bpe.Memo(VOCAB.encode_words, VOCAB.special)
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one two three four five"), (4, " \n\t"), (5, "a" * 3000), (6, "É \x00 é 中文 😀"), (7, "x y " * 800)]


def frame(spark, rows, names="doc_id long, text string, extra int"):
    """Texts with a further column, whose name operators use themselves."""
    return spark.createDataFrame([(*r, 1) for r in rows], names.replace("extra", "rid"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*"abst'rvemldx  \n\t019.,!-", "'s", "'ll", "<|endoftext|>"]), st.characters(codec="utf-8")), max_size=30).map("".join))
def test_bpe_equals_the_library(text):
    data, offs = text_buffers(pa.array([text]))
    ids, _ = MEMO.encode(data, offs)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert VOCAB.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


def test_bpe_speculation_is_mended():
    words = ["".join(random.Random(i).choices("thean iors", k=12)).encode() for i in range(400)]
    ids, first = VOCAB.encode_words(words)
    for k, w in enumerate(words):
        assert ids[first[k] : first[k + 1]].tolist() == VOCAB.merge(w)


def test_bpe_frames(spark):
    df = frame(spark, ODD)
    rows = bpe.tokenized(df, PATH).collect()
    assert sorted(r.decoded for r in rows) == sorted(t or "" for _, t in ODD)
    back = bpe.decoded(bpe.encoded(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t in ODD)
    assert bpe.round_trip_report(df.limit(0), PATH).collect() == []


def test_packed_files(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_IDS", 500)
    df = frame(spark, ODD)
    rows = sorted(((i, t or "") for i, t in ODD), key=lambda x: (x[0] is not None, x[0], x[1]))
    at, want = 0, []
    for i, t in rows:
        ids = LIBRARY.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in packed.read_report(df, PATH).orderBy("start").collect()] == want
    assert packed.read_report(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize(("n", "limit"), [(1, 4), (2, 4), (5, 3), (300, 9), (3000, 13)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = rng.integers(1, 1000, n) ** 2
    lengths = packed.code_lengths(counts, limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0]).sum() <= 1 + 1e-12
    code = packed.Code(lengths)
    for size in (0, 1, packed.EVERY, packed.EVERY + 1, 2000):
        ids = rng.integers(0, n, size)
        payload, checkpoints, _ = code.encode(ids)
        assert (code.decode(payload, checkpoints, size) == ids).all()


def test_suffix_dedup(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffixes, "RUN_BYTES", 3000)
    rng = random.Random(5)
    base = ["".join(rng.choices("ab é", k=rng.randint(0, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(base)[: rng.randint(1, 120)] for _ in range(rng.randint(0, 4)))) for i in range(60)] + ODD
    got = sorted(tuple(r)[1:5] for r in suffixes.removal_report(frame(spark, rows), length=20, gram=6).collect())
    assert got == sorted(suffixes.brute_force([t for _, t in rows], 20))
    assert suffixes.removal_report(frame(spark, rows).limit(0), length=20, gram=6).count() == 0
    cut = suffixes.without_repeats(frame(spark, rows), length=20, gram=6)
    assert cut.columns == ["doc_id", "text", "rid"]
    cut.collect()


def test_suffix_merge_never_compares_known_prefixes():
    rng = random.Random(1)
    runs = [sorted("".join(rng.choices("ab", k=rng.randint(1, 30))).encode() for _ in range(50)) for _ in range(5)]
    coded = [iter([(x, suffixes.shared_prefix(r[i - 1], x) if i else 0, b"", ()) for i, x in enumerate(r)]) for r in runs]
    out = list(suffixes.merge_runs(coded))
    assert [x[0] for x in out] == sorted(x for r in runs for x in r)
    assert all(out[i][1] == suffixes.shared_prefix(out[i - 1][0], out[i][0]) for i in range(1, len(out)))


def test_repeated_rows_enter_a_cell_once(spark, monkeypatch):
    """Equal rows, with one id or with many, cost a cell what one does; all of them get the group's id."""
    one, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58))
    rows = [(7, one)] * 3000 + [(i, one) for i in range(10, 40)] + [(3, other), (4, "something else that is here"), (4, "something else that is here")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.doc_id != 4} == {3} and {r.component_id for r in got if r.doc_id == 4} == {4}
    assert neardup.one_of_each(frame(spark, rows)).count() == 2

    batch = pa.RecordBatch.from_pydict({"set": [5, 5, 9, 5], "text": ["a", "a", "b", "a"]})
    assert [b.column("set").to_pylist() for b in neardup._once(iter([batch, batch.slice(1, 2), batch.slice(2, 1)]))] == [[5, 9]]
    shingles = np.arange(20, dtype=np.uint64).tobytes()
    cell = {"group": [1] * 5, "low": [0] * 5, "high": [0] * 5, "set": [1, 1, 1, 2, 2], "block": [0] * 5, "signature": [bytes(2 * neardup.SIZE)] * 5, "shingles": [shingles] * 5}
    links = neardup._cell_links(1 << 20, neardup.REACH, neardup.THRESHOLD)(iter([pa.RecordBatch.from_pydict(cell)]))
    assert [(x["a"], x["b"]) for b in links for x in b.to_pylist()] == [(1, 2)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_BYTES", 2000)
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))) for _ in range(8)]
    rows = []
    for i in range(100):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((i + 10, "\t".join(words)))
    rows += ODD
    got = sorted((tuple(r) for r in neardup.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == neardup.brute_force(rows)
    kept = neardup.one_of_each(frame(spark, rows))
    wanted = {w[0] for w in neardup.brute_force(rows) if w[3]}
    assert {r.doc_id for r in kept.collect()} - {None} == wanted
    assert neardup.one_of_each(frame(spark, rows).limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    items = [(f"i{i}", " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(12)] + [("n", None), ("e", ""), ("i0", "again W1")]
    docs = [(i, " ".join(rng.choices(words, k=30) + (rng.choice(items[:12])[1].split() if i % 2 else []) + rng.choices(words, k=5))) for i in range(30)] + ODD
    it = spark.createDataFrame([(*x, 3) for x in items], "item_id string, text string, doc_id int")
    want = decontam.brute_force([(k, t) for k, (_, t) in enumerate(docs)], items)
    numbered = frame(spark, [(k, t) for k, (_, t) in enumerate(docs)])
    got = {r[0]: tuple(r)[1:] for r in decontam.contamination_report(numbered, it).collect()}
    assert got == want
    small = decontam.decontaminate(numbered, it, group_bytes=300).select("doc_id", "n_words", "n_hit").collect()
    assert {r[0]: tuple(r)[1:] for r in small} == {k: v[:2] for k, v in want.items()}
    clean = {r.doc_id for r in decontam.clean_documents(numbered, it, group_bytes=300).collect()}
    assert clean == {k for k, v in want.items() if not v[4]}
    assert decontam.contamination_report(numbered, it.limit(0)).where("contaminated").count() == 0


def test_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    text = lambda n: rng.choices(words, k=n)
    passage = text(60)
    rows, planted = [], set()
    for i in range(60):
        own = text(rng.randint(5, 200))
        if i % 6 == 0:
            copy = list(passage)
            for _ in range(i % 4):
                copy[rng.randrange(60)] = "zz"
            own, planted = own[:40] + copy + own[40:], planted | {i}
        rows.append((i, " ".join(own)))
    got = passages.shared_passages(frame(spark, rows + [(100, rows[7][1]), (101, None), (102, "")])).collect()
    pairs = {(r.doc_id, r.partner_id) for r in got}
    assert {x for p in pairs for x in p} == planted | {7, 100}
    assert all(r.similarity >= 0.8 and r.end - r.begin >= 40 for r in got)
    assert passages.shared_passages(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("sizes", "between"), [((60, 60), 31), ((60, 60), 60), ((60, 60), 115), ((100, 40), 50)])
def test_passages_of_a_pair_are_judged_one_by_one(spark, sizes, between):
    rng = random.Random(between)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    one, two = (text(n) for n in sizes)
    rows = [(i, " ".join(text(30) + one + text(between + 3 * i) + two + text(30))) for i in range(2)]
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert sorted(r.n_match for r in got) == sorted(sizes)
    assert all(r.similarity == 1 for r in got)


def test_passages_meet_though_smaller_texts_hold_parts(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(text(20) + passage + text(20))) for i in range(2)]
    # many texts hold a line of it, each less than a passage: most ids come before those of both
    rows += [(10 + i, " ".join(text(20) + passage[i % 4 * 15 : i % 4 * 15 + 20] + text(20))) for i in range(28)]
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((0, 1))}
    assert max(r.n_match for r in got) == 60


def test_passages_at_a_later_place_of_the_partner(spark):
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    lines = [w for i in range(0, 60, 15) for w in text(20) + passage[i : i + 20]]
    rows = [(i, " ".join(lines + text(20) + passage + text(20))) for i in range(2)] + [(2, " ".join(text(20) + passage + text(20)))]
    got = passages.shared_passages(frame(spark, rows)).collect()
    whole = {frozenset((r.doc_id, r.partner_id)) for r in got if r.n_match >= 60}
    assert {frozenset((0, 1)), frozenset((0, 2)), frozenset((1, 2))} <= whole


def test_passages_with_a_fifth_of_the_words_changed(spark):
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(0, 80, 2):
        passage = text(41)
        copy = list(passage)
        # half of them evenly: no run of more than four words is left
        for at in range(4, 41, 5) if i % 4 else rng.sample(range(1, 40), 8):
            copy[at] = "zz"
        rows += [(i, " ".join(text(30) + passage + text(30))), (i + 1, " ".join(text(30) + copy + text(30)))]
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert {min(r.doc_id, r.partner_id) for r in got if abs(r.doc_id - r.partner_id) == 1} == set(range(0, 80, 2))


def test_chains_against_all_orders():
    rng = random.Random(6)
    for _ in range(50):
        parts = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 6)) for _ in range(7)]
        best = max(_score(c) for c in _orders(parts))
        assert abs(_score(passages.chains(parts)[0]) - best) < 1e-9


def _score(chain):
    total = sum(n for _, _, n in chain)
    return total - sum(passages.SKIP * (c[0] - a[0] - a[2] + c[1] - a[1] - a[2]) for a, c in zip(chain, chain[1:], strict=False))


def _orders(parts):
    def grow(chain):
        yield chain
        a = chain[-1]
        for c in parts:
            if c is not a and c[0] >= a[0] + a[2] and c[1] >= a[1] + a[2]:
                yield from grow([*chain, c])

    for p in parts:
        yield from grow([p])


def test_toxicity(spark):
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        words, bad = rng.choices(plain, k=40), i % 5 == 0
        if bad:
            words[3:5] = rng.choices(["awful", "awfully", "nasty", "nastier"], k=2)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = frame(spark, rows + ODD)
    table = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table.where("doc_id % 2 = 0 or doc_id is null"))
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [i for i in range(20, 400) if i % 2]
    assert sum(got[i].toxic == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[25].severity > got[21].severity and list(model["thresholds"]) == sorted(model["thresholds"])
    assert toxicity.harmless(docs, model).columns == docs.columns
    empty = toxicity.train(docs, table.limit(0))
    assert not any(r.toxic for r in toxicity.scores(docs, empty).collect())
    assert toxicity.scores(docs.limit(0), model).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_passages_against_all_pairs(spark, monkeypatch):
    """Links by every diagonal of every pair: texts whose common passages have changed words only and end in equal ones."""
    monkeypatch.setattr(passages, "PART_BYTES", 2000)
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    shared = [text(rng.choice([36, 41, 60, 90])) for _ in range(6)]
    rows = []
    for i in range(40):
        words = text(rng.randint(0, 30))
        for p in rng.sample(shared, rng.randint(0, 2)):
            words += [f"x{rng.randrange(10**6)}" if rng.random() < 0.06 else w for w in p] + text(rng.randint(0, 40))
        rows.append((i, " ".join(words)))
    wanted = set()
    for i, (_, one) in enumerate(rows):
        for j in range(i):
            a, b = one.split(), rows[j][1].split()
            for shift in range(-len(b), len(a)):
                same = np.array([a[x] == b[x - shift] for x in range(max(0, shift), min(len(a), len(b) + shift))], int)
                total = np.concatenate([[0], np.cumsum(same)])
                x, y = np.triu_indices(len(total), 40)
                if len(x) and ((total[y] - total[x] >= 0.8 * (y - x)) & (same[np.minimum(x, len(same) - 1)] == 1) & (same[y - 1] == 1)).any():
                    wanted.add((j, i))
                    break
    got = {tuple(sorted((r.doc_id, r.partner_id))) for r in passages.shared_passages(frame(spark, rows)).collect()}
    assert wanted
    assert got == wanted


def test_passages_of_repeated_rows_come_once(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(["a", *words])), (3, " ".join([*words, "mid", *words]))]
    got = [tuple(r) for r in passages.shared_passages(frame(spark, rows)).collect()]
    assert len(got) == len(set(got))
    assert {frozenset(x[:2]) for x in got} == {frozenset(x) for x in ((1, 2), (1, 3), (2, 3))}


def test_passages_of_texts_that_repeat_a_line(spark):
    line = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join([f"a{i}"] * 30 + line * n + [f"b{i}"] * 30)) for i, n in enumerate((3, 40, 100, 1500))]
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((i, j)) for i in range(4) for j in range(i)}
    longest = {frozenset((r.doc_id, r.partner_id)): 0 for r in got}
    for r in got:
        key = frozenset((r.doc_id, r.partner_id))
        longest[key] = max(longest[key], r.n_match)
    assert longest[frozenset((2, 3))] >= 2000
    assert longest[frozenset((0, 3))] >= 60


@pytest.mark.parametrize("lines", [lambda i: (i % 4 * 15, 20), lambda i: (i * 7 % 41, 20), lambda i: (i * 5 % 29, 30)])
def test_passages_meet_though_more_texts_than_a_group_hold_their_lines(spark, lines):
    """Every seed of the passage is common; longer runs still tell the two texts that hold all of it."""
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(text(20) + passage + text(20))) for i in (500, 501)]
    for i in range(160):
        begin, n = lines(i)
        rows.append((i, " ".join(text(20) + passage[begin : begin + n] + text(20))))
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((500, 501))}
    assert [(r.begin, r.end, r.n_match) for r in got] == [(20, 80, 60)]


def test_passages_of_common_seeds_link_their_texts_with_one_that_holds_them(spark):
    """300 texts hold a passage and as many others its lines, some with smaller hashes: each holder is linked with a holder."""
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(text(15) + passage + text(15))) for i in range(300)]
    rows += [(1000 + i, " ".join(text(20) + passage[i % 4 * 15 : i % 4 * 15 + 15] + text(20))) for i in range(300)]
    got = passages.shared_passages(frame(spark, rows)).collect()
    found = {x for r in got if r.n_match >= 60 for x in (r.doc_id, r.partner_id)}
    assert found == set(range(300))


def test_runs_count_each_seed_within_once():
    at, width = np.array([0, 1, 10, 3, 3]), np.array([8, 8, 4, 4, 16])
    index, place = passages._within(at, width, np.array([True, False, False, True, False]), 4)
    assert place.tolist() == [0, 1, 2, 3, 4, 5, 10, *range(3, 16)]
    assert index.tolist() == [0] * 5 + [1, 2] + [3] + [4] * 12


def test_a_lot_of_many_links_is_chained_in_pieces(monkeypatch):
    """Some pairs at a time, so that a worker's memory doesn't grow with the lot; the chains are the same."""
    links = [(rid, partner, x, x + partner) for rid in range(20, 30) for partner in range(10) for x in range(30)]
    rid, partner, at, other = (np.array(x) for x in zip(*links, strict=True))
    batch = pa.RecordBatch.from_pylist([
        {"lot": 3, "width": 4, "rids": rid[::30].astype("<i8").tobytes(), "partners": partner[::30].astype("<i8").tobytes(), "counts": np.full(100, 30, "<i4").tobytes(), "at": at.astype("<i4").tobytes(), "other": other.astype("<i4").tobytes()}
    ])
    chained = lambda: [b.to_pylist() for b in passages._link_chains(4, 5, 24)([batch])]
    (whole,) = chained()
    monkeypatch.setattr(passages, "LINKS", 600)
    pieces = chained()
    assert len(whole) == 100 and max(map(len, pieces)) < 50
    assert sorted((c for piece in pieces for c in piece), key=str) == sorted(whole, key=str)


@pytest.mark.parametrize("every", [4, 6])
def test_passages_of_common_seeds_only_are_in_one_class(spark, every):
    """Two texts share a passage without long runs, whose seeds over 32 texts each hold and none of them more than a line:
    they are in one class, the others alone."""
    rng = random.Random(every)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    # a changed word after each few, so that the runs of the two are short
    copy = [f"x{i}" if i % (every + 1) == every else w for i, w in enumerate(passage)]
    rows = [(i, " ".join(text(20) + words + text(20))) for i, words in ((1000, passage), (1001, copy))]
    for i in range(400):
        begin = rng.randrange(0, 45)
        rows.append((i, " ".join(text(20) + passage[begin : begin + 15] + text(20))))
    got = passages.shared_passages(frame(spark, rows)).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((1000, 1001))}
    assert {r.class_id for r in got} == {1000}


def _profile(rid, component, seed, at):
    body = pa.compress(passages._planes(seed, 6) + passages._planes(at, 4), "zstd", asbytes=True)
    return {"rid": rid, "component": component, "n": len(seed), "body": body}


class _Marks:
    value = np.full(1 << (passages.MARK_BITS - 6), 2**64 - 1, np.uint64)


def test_a_repeated_line_gives_each_pair_of_seeds_once():
    """Two texts that repeat a line 400 times are one candidate pair, once for each key, not once for each pair of places."""
    line = passages.mix(np.arange(1, 31, dtype=np.uint64)) >> np.uint64(16)
    seed, at = np.tile(line, 400), np.arange(12000)
    profiles = pa.RecordBatch.from_pylist([_profile(7, 1, seed, at), _profile(9, 2, seed, at)])
    packed = [r for b in passages._packed_twos(1, 20, 76, _Marks, _Marks)([profiles]) for r in b.to_pylist()]
    held = [passages._unpacked(r, ids=2) for r in packed]
    keys = {(key, rid) for seed, ids, _ in held for key, rid in zip(seed.tolist(), ids[:, 0].tolist(), strict=True)}
    assert sum(r["n"] for r in packed) == len(keys) == 2 * 30 * 30
    pairs = [r for b in passages._two_pairs(packed) for r in b.to_pylist()]
    assert {(r["rid"], r["partner"]) for r in pairs} == {(9, 7)}
    assert len(pairs) <= 900


def test_a_key_that_a_text_repeats_meets_others_once():
    """Also if a text's places come from several rows: 3000 places in each of two texts are one pair."""
    ids = np.repeat(np.array([[7, 1], [9, 2]]), 3000, axis=0)
    (pairs,) = passages._apart(np.zeros(6000, np.uint64), ids)
    assert pairs.tolist() == [[9], [7]]


def test_pairs_whose_words_rule_out_a_passage_are_left_unchained():
    """Of 40 words in a row 32 have to stand in the other text; what is among other words can't hold a passage."""
    words = np.arange(200, dtype=np.uint32)
    among = lambda n: np.unique(np.concatenate([words[50 : 50 + n], [1000, 1001]])).astype(np.uint32)
    assert passages._may_hold(words, among(32), 40, 0.8)
    assert not passages._may_hold(words, among(31), 40, 0.8)
    assert passages._may_hold(words, np.delete(words, slice(60, 200, 5)), 40, 0.8)
    assert not passages._may_hold(words[:39], words, 40, 0.8)


def test_seeds_of_several_components_are_told_whole():
    """Two seeds of one mark that a component each holds are none of several; one that two components hold is."""
    seed = np.array([5 << 22, (5 << 22) + 1, 9 << 22], np.uint64)
    profiles = pa.RecordBatch.from_pylist([_profile(1, 1, seed[[0, 2]], np.array([0, 30])), _profile(2, 2, seed[[1, 2]], np.array([0, 30])), _profile(3, 2, seed[[1]], np.array([0]))])
    packed = [r for b in passages._packed_held(1)([profiles]) for r in b.to_pylist()]
    (words,) = passages._several_marks(packed)
    assert words.to_pylist() == [{"slot": 0, "bits": 1 << 9}]
