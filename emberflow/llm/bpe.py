"""Byte-level BPE encoding and decoding by speculation and verification (operator 1).

Texts are split into words with array operations on code points (:func:`word_bounds` follows the byte-level
pre-tokenizer's pattern), and each distinct word is encoded once:

* *Speculate.*  Greedy longest match proposes the tokens of all new words at once, by looking hashes of their byte
  slices up in the vocabulary.
* *Verify.*  A token sequence is the result of merging exactly if every adjacent pair is compatible: undoing the merges
  of both tokens from the last one, no pair across the border would have been merged earlier.  All pairs of all
  proposals are tested together, one undone merge per array step; known pairs come from a memo.
* *Mend.*  Only words with an incompatible pair undergo exact merging.

A worker keeps the words it has seen in a table of bounded size.  The vocabulary file's path is a parameter; it is read
by the driver and broadcast, as executors need not hold it.  Vocabularies must be byte-level with ids in merge order.

Results for odd input: null and empty texts have no tokens and decode to the empty text; special tokens in the text are
encoded as themselves, as the library does; repeated rows and ids are encoded row by row; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, ragged, slice_hashes, text_blocks

#: Words that a worker remembers; the table is emptied beyond that.
MEMO_WORDS = 1 << 20
_SLOT_BITS = 22
#: Bytes of text that one pass over code points handles: it takes more room for each byte than other operators do.
TEXT_BYTES = 1 << 19


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if chr(b) not in table]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, and what verification needs, from a tokenizer file's JSON."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        size = max(max(model["vocab"].values(), default=-1), *(t["id"] for t in spec.get("added_tokens", [])), -1) + 1
        self.tokens: list[bytes] = [b""] * size
        for text, i in model["vocab"].items():
            self.tokens[i] = bytes(alphabet[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: by pair (left * size + right): rank * size + the token made
        self.step: dict[int, int] = {}
        self.none = 1 << 62
        self.left, self.right = np.arange(size), np.arange(size)
        #: when a token is made: rank of its merge plus one, 0 for bytes
        self.made = np.zeros(size, np.int64)
        for r, (a, b) in enumerate(pairs):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.step[i * size + j] = r * size + k
            if self.left[k] == k:
                self.left[k], self.right[k], self.made[k] = i, j, r + 1
        keys = np.fromiter(self.step, np.int64, len(self.step))
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], np.fromiter(self.step.values(), np.int64, len(keys))[order] // size + 1
        self.size = size
        # longest match: hashes of the tokens that merging can make, by hash, open for all lengths
        data = b"".join(self.tokens)
        ends = np.cumsum([len(t) for t in self.tokens])
        usable = np.array([i not in self.special.values() and len(t) > 0 for i, t in enumerate(self.tokens)])
        ids = np.flatnonzero(usable)
        starts = ends - np.array([len(t) for t in self.tokens])
        hashes = slice_hashes(np.frombuffer(data, np.uint8), starts[ids], ends[ids])
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], ids[order]
        self.longest = max(len(self.tokens[i]) for i in ids)
        self.byte_ids = {t[0]: i for i, t in enumerate(self.tokens) if len(t) == 1 and usable[i]}
        #: for decoding: all tokens' bytes, and where each begins
        self.bytes = np.frombuffer(data, np.uint8)
        self.begin, self.length = starts, ends - starts

    # --- speculate

    def propose(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of words given as bytes: (ids, first token of each word and the total)."""
        n = len(offs) - 1
        at, word = offs[:-1].copy(), np.arange(n)
        live = np.flatnonzero(at < offs[1:])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            begin, stop = at[live], offs[1:][live]
            token, width = np.full(len(live), -1), np.zeros(len(live), np.int64)
            todo = np.arange(len(live))
            for size in range(int(min(self.longest, (stop - begin).max())), 0, -1):
                fits = todo[begin[todo] + size <= stop[todo]]
                if not len(fits):
                    continue
                h = slice_hashes_at(data, begin[fits], size, self._prefix)
                k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                good = self.hashes[k] == h
                token[fits[good]], width[fits[good]] = self.hash_ids[k[good]], size
                todo = todo[token[todo] < 0]
                if not len(todo):
                    break
            out.append((word[live], token))
            at[live] += width
            live = live[at[live] < offs[1:][live]]
        if not out:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        owner, ids = np.concatenate([o for o, _ in out]), np.concatenate([t for _, t in out])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(n + 1))

    # --- verify

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging would leave each pair of tokens side by side.

        Both tokens are taken apart, the part made last first.  At each step the tokens at the border exist side by
        side; if their merge comes before the step that was just undone, it would have happened instead.
        """
        one, two = one.copy(), two.copy()
        good = np.ones(len(one), bool)
        never = np.int64(1) << 60
        limit = np.full(len(one), never)
        at_left = np.zeros(len(one), bool)  # whether the step undone was in the left token
        live = np.arange(len(one))
        while len(live):
            a, b = one[live], two[live]
            key = a * self.size + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
            made = np.where(self.pair_keys[k] == key, self.pair_made[k], never) if len(self.pair_keys) else np.full(len(key), never)
            # Equal ranks mean the same pair twice, as in "aa" + "a": the leftmost place is merged first, so a
            # merge across the border precedes an equal one to its right, but not one to its left.
            bad = (made < limit[live]) | ((made == limit[live]) & ~at_left[live] & (made < never))
            good[live[bad]] = False
            live, a, b = live[~bad], a[~bad], b[~bad]
            ma, mb = self.made[a], self.made[b]
            more = (ma > 0) | (mb > 0)
            live, a, b, ma, mb = live[more], a[more], b[more], ma[more], mb[more]
            # of equal steps, the right one comes later
            left = ma > mb
            one[live[left]], two[live[~left]] = self.right[a[left]], self.left[b[~left]]
            limit[live] = np.maximum(ma, mb)
            at_left[live] = left
        return good

    # --- mend

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the adjacent pair of lowest rank, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in word]
        get, size, none = self.step.get, self.size, self.none
        steps = [get(a * size + b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while steps:
            best = min(steps)
            if best == none:
                break
            i = steps.index(best)
            ids[i : i + 2] = (new := best % size,)
            del steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] * size + new, none)
            if i < len(steps):
                steps[i] = get(new * size + ids[i + 1], none)
        return ids

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each word and the total)."""
        data = np.frombuffer(b"".join(words), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self._prefix = prefix_sums(data)
        ids, first = self.propose(data, offs)
        border = np.ones(len(ids), bool)
        border[first[1:][first[1:] > 0] - 1] = False
        at = np.flatnonzero(border)
        key, back = np.unique(ids[at] * self.size + ids[np.minimum(at + 1, len(ids) - 1)], return_inverse=True)
        bad = at[~self.compatible(key // self.size, key % self.size)[back]]
        failing = np.unique(np.searchsorted(first, bad, "right") - 1)
        if not len(failing):
            return ids, first
        pieces, last, sizes = [], 0, np.diff(first)
        for w in failing.tolist():
            own = self.merge(words[w])
            pieces += [ids[last : first[w]], np.array(own, ids.dtype)]
            last, sizes[w] = first[w + 1], len(own)
        return np.concatenate([*pieces, ids[last:]]), np.concatenate([[0], np.cumsum(sizes)])

    # --- decode

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.begin[ids], self.length[ids])].tobytes()


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .shared import _SYMBOL, _tables

    powers, inverses = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(_SYMBOL[data] * powers[: len(data)], out=sums[1:])
    return sums, inverses


def slice_hashes_at(data: np.ndarray, begin: np.ndarray, size: int, prefix: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """As slice_hashes, for slices of one size over prepared sums."""
    from .shared import mix

    sums, inverses = prefix
    with np.errstate(over="ignore"):
        return mix((sums[begin + size] - sums[begin]) * inverses[begin] + U64(size))


# --- words -----------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_kinds: np.ndarray | None = None


def _kind_table() -> np.ndarray:
    """Per code point: letter, number, white space or other."""
    global _kinds
    if _kinds is None:
        table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for cp in range(sys.maxunicode + 1):
            major = unicodedata.category(chr(cp))[0]
            if major == "L":
                table[cp] = _LETTER
            elif major == "N":
                table[cp] = _NUMBER
        # Code points with the property White_Space.
        table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds = table
    return _kinds


def word_bounds(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the words of all texts, which the pattern of byte-level pre-tokenizers finds:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    kind = _kind_table()[points]
    n = len(points)
    text_start = np.zeros(n + 1, bool)
    inner = offs[:-1][offs[:-1] < len(data)]
    text_start[np.searchsorted(lead, inner)] = True
    text_start[n] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | text_start[1:n]
    run = np.flatnonzero(change)
    run_kind = kind[run]
    ends = np.append(run[1:], n)
    start = change.copy()
    # the last white space before a word: a blank joins the word, any other stands alone
    space = np.flatnonzero((run_kind == _SPACE) & ~text_start[ends])
    last = ends[space] - 1
    start[last] = True
    blank = points[last] == 0x20
    start[ends[space][blank]] = False
    # contractions: a lone apostrophe that isn't joined to a blank, with the letters that follow
    alone = np.flatnonzero((run_kind == _OTHER) & (ends - run == 1) & (points[run] == 0x27) & ~text_start[ends])
    alone = alone[(np.append(run_kind, 0)[alone + 1] == _LETTER) & start[run[alone]]]
    q = run[alone]
    one = points[q + 1]
    far = np.minimum(q + 2, n - 1)
    two = np.where((q + 2 < n) & ~text_start[np.minimum(q + 2, n)] & (kind[far] == _LETTER), points[far], 0)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = np.zeros(len(q), bool)
    for a, b in ("re", "ve", "ll"):
        double |= (one == ord(a)) & (two == ord(b))
    for hit, size in ((single, 2), (double & ~single, 3)):
        start[q[hit] + 1] = False
        after = q[hit] + size
        after = after[after < n]
        start[after] = True
    return lead[start]


class Memo:
    """Encodes texts by distinct words; remembers the words, up to a bound."""

    def __init__(self, encode_words: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], special: dict[str, int]):
        self.encode_words, self.special = encode_words, special
        self.clear()

    def clear(self) -> None:
        self.slots, self.where = np.zeros(1 << _SLOT_BITS, U64), np.zeros(1 << _SLOT_BITS, np.int32)
        self.begin, self.length, self.ids = (np.zeros(0, np.int32) for _ in range(3))

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (hashes >> U64(64 - _SLOT_BITS)).astype(np.int64)
        return self.where[slot], self.slots[slot] == hashes

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the total)."""
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            return self._with_special(raw, offs)
        starts = word_bounds(data, offs)
        ends = np.append(starts[1:], len(data))
        hashes = slice_hashes(data, starts, ends)
        if len(self.begin) > MEMO_WORDS:
            self.clear()
        where, known = self._known(hashes)
        if not known.all():
            fresh, at = np.unique(hashes[~known], return_index=True)
            at = np.flatnonzero(~known)[at]
            ids, first = self.encode_words([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            base = len(self.begin)
            self.begin = np.concatenate([self.begin, (len(self.ids) + first[:-1]).astype(np.int32)])
            self.length = np.concatenate([self.length, np.diff(first).astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            slot = (fresh >> U64(64 - _SLOT_BITS)).astype(np.int64)
            self.slots[slot], self.where[slot] = fresh, base + np.arange(len(fresh))
            # two new words of one slot: the later has it, the earlier is found by its place
            where[~known] = base + np.searchsorted(fresh, hashes[~known])
        length = self.length[where]
        total = np.concatenate([[0], np.cumsum(length)])
        return self.ids[ragged(self.begin[where], length)], total[np.searchsorted(starts, offs)]

    def _with_special(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import re

        pattern = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.special, key=len, reverse=True)))
        out, first = [], [0]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            last, n, text = 0, 0, raw[a:b]
            for m in [*pattern.finditer(text), None]:
                part = np.frombuffer(text[last : m.start() if m else len(text)], np.uint8)
                if len(part):
                    ids, _ = Memo.encode(self._plain(), part, np.array([0, len(part)]))
                    out.append(ids)
                    n += len(ids)
                if m:
                    out.append(np.array([self.special[m[0].decode()]]))
                    n, last = n + 1, m.end()
            first.append(first[-1] + n)
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.array(first)

    def _plain(self) -> Memo:
        if not hasattr(self, "plain"):
            self.plain = Memo(self.encode_words, {})
        return self.plain


# --- the operator ----------------------------------------------------------------------------------

_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(source: str) -> Vocabulary:
    """Parsed once in each worker."""
    key = hashlib.md5(source.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(source)
    return _vocabularies[key]


_memos: dict[int, Memo] = {}


def memo_of(vocab: Vocabulary) -> Memo:
    if id(vocab) not in _memos:
        _memos[id(vocab)] = Memo(vocab.encode_words, vocab.special)
    return _memos[id(vocab)]


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def work(batches):
        memo = memo_of(vocabulary(shared.value))
        for batch, data, offs in text_blocks(batches, limit=TEXT_BYTES):
            ids, first = memo.encode(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return slim.mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decoded(table: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with ``decoded``: the text of its token ids (null for null ids; unknown ids decode to nothing)."""
    shared = table.sparkSession.sparkContext.broadcast(_read(path))
    schema = table.drop("decoded").withColumn("decoded", F.lit("")).schema

    def work(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            column = batch.column(ids)
            out = []
            for row in column:
                if not row.is_valid:
                    out.append(None)
                    continue
                own = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
                out.append(vocab.decode(own[(own >= 0) & (own < vocab.size)]).decode("utf-8", "replace"))
            names = [n for n in batch.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "decoded"])

    return table.mapInArrow(work, schema)


def tokenized(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): encoding and decoding by the same workers, which hold one vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(slim.dtypes)["doc_id"]

    def work(batches):
        vocab = vocabulary(shared.value)
        memo = memo_of(vocab)
        for batch, data, offs in text_blocks(batches, limit=TEXT_BYTES):
            ids, first = memo.encode(data, offs)
            back = vocab.decode(ids)
            end = np.concatenate([[0], np.cumsum(vocab.length[ids])])[first].tolist()
            texts = pa.array([back[a:b].decode("utf-8", "replace") for a, b in zip(end, end[1:], strict=False)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts], names=["doc_id", "ids", "decoded"])

    return slim.mapInArrow(work, f"doc_id {kind}, ids array<int>, decoded string")


def round_trip_report(docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of query op1: texts are encoded, their ids decoded, and both digested in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        vocab = vocabulary(shared.value)
        memo = memo_of(vocab)
        digits = [f"{i},".encode() for i in range(vocab.size)]
        size = np.array([len(d) for d in digits])
        begin, letters = np.cumsum(size) - size, np.frombuffer(b"".join(digits), np.uint8)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch, data, offs in text_blocks(batches, limit=TEXT_BYTES):
            ids, first = memo.encode(data, offs)
            listed = letters[ragged(begin[ids], size[ids])].tobytes()
            at = np.concatenate([[0], np.cumsum(size[ids])])[first].tolist()
            back = vocab.decode(ids)
            end = np.concatenate([[0], np.cumsum(vocab.length[ids])])[first].tolist()
            n = range(batch.num_rows)
            texts = [back[end[i] : end[i + 1]].decode("utf-8", "replace").encode() for i in n]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), pa.array([sha(listed[at[i] : at[i + 1] - 1] if at[i + 1] > at[i] else b"") for i in n]), pa.array([sha(t) for t in texts])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


