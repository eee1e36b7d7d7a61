from __future__ import annotations

import random
import time
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import common, packing, tokens
from quillon.llm.queries import byte_tokenizer

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["hello", "World", "don't", "we'll", "42", "3.14", "!!!", "naïve", "日本語", "👍🏽", "ß", "É", " ", " ", "\x1c", "\t", "\n", "  ", "<|endoftext|>", "<|startoftext|>", "a_b", "$%&", "ﬁ", "İ", "x" * 70, "aaaaaaaa", "'s", "''", "‍", "\x00"]


def texts(n=300):
    draw = random.Random(8)
    return ["".join(draw.choice(PIECES) + draw.choice(["", " ", " ", "\n"]) for _ in range(draw.randrange(0, 40))) for _ in range(n)]


def test_counts_equal_the_library():
    library = Tokenizer.from_file(PATH)
    count = tokens.PrefixCounter(PATH)
    for t in texts() + [t or "" for _, t in ODD]:
        assert count.total(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t[:80])


def test_every_prefix():
    library = Tokenizer.from_file(PATH)
    count = tokens.PrefixCounter(PATH)
    draw = random.Random(4)
    odd_runs = ["".join(draw.choice([*PIECES, "<|endof", "e\u0301", "\u0301", "\xa0", "'re", "'r", "\u03a3", "한국"]) for _ in range(draw.randrange(1, 6))) for _ in range(300)]
    for t in ["Hello wonderful world", "unbelievable  antidisestablishmentarianism x", "don't 42!! naïve", *odd_runs]:
        want = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert count.every_prefix(t).tolist() == want, repr(t)
        for limit in (0, 1, 3):
            assert count.fit(t.encode(), count.counts(t.encode()), limit) == max(k for k, n in enumerate(want) if n <= limit), repr(t)


@pytest.mark.parametrize("seed", range(4))
def test_every_prefix_of_joined_letters(seed):
    """Letters that the normalizer joins or moves, contractions in the making, control signs and special strings."""
    library = Tokenizer.from_file(PATH)
    count = tokens.PrefixCounter(PATH)
    draw = random.Random(seed)
    signs = [*"eAsrdl4!''が한Σİﬁ\xa0\u3000\x1c\x00\x85\u200d", *"\u0301\u0323\u0327\u0345\u3099\u1112\u1161\u11ab", "\U00011099\U000110ba", "<|endoftext|>", "<|end", "\u212a", "👍🏽"]
    for _ in range(400):
        t = "".join(draw.choice(signs) for _ in range(draw.randrange(1, 14)))
        assert count.every_prefix(t).tolist() == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], ascii(t)


@pytest.mark.parametrize(
    "text",
    [
        unicodedata.normalize("NFD", "がぎぐげござパピプ") * 6000, unicodedata.normalize("NFD", "한국어") * 14_000, "e\u0323\u0301o\u0301" * 20_000,
        "ab\x00\x01" * 25_000, "e" + "\u0301" * 100_000, "x" * 100_000, "\u00e9'" * 50_000,
    ],
    ids=["kana", "jamo", "latin", "control", "marks", "letters", "quotes"],
)
def test_prefixes_of_long_runs(text):
    library = Tokenizer.from_file(PATH)
    count = tokens.PrefixCounter(PATH)
    t = text[:100_000]
    began = time.perf_counter()
    chars = count.fit(t.encode(), count.counts(t.encode()), 2048)
    assert time.perf_counter() - began < 60
    assert len(library.encode(t[:chars], add_special_tokens=False).ids) <= 2048 < len(library.encode(t[: chars + 1], add_special_tokens=False).ids)
    assert len(count.words) <= 3  # no prefix is remembered


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "WORD_BYTES", 20_000)
    count = tokens.PrefixCounter(PATH)
    library = Tokenizer.from_file(PATH)
    for k in range(2000):
        t = f"word{k}"
        assert count.word(t.encode()) == len(library.encode(t, add_special_tokens=False).ids)
        assert sum(len(w) + tokens.ENTRY for w in count.words) <= 21_000
    monkeypatch.setattr(packing, "WORD_BYTES", 20_000)
    ids = packing.Ids(*byte_tokenizer())
    plain = Tokenizer.from_file(byte_tokenizer()[0])
    for k in range(300):
        texts_ = [" ".join(f"w{k * 20 + j}" for j in range(20))]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.batch(texts_)] == [plain.encode(t, add_special_tokens=False).ids for t in texts_]
        assert ids.held == sum(len(a) + len(b) for a, b in ids.known.items()) < 21_000


def test_words_of_every_batch_are_encoded_once(monkeypatch):
    """The table turns over, within its bound, and words that are met again and again stay in it."""
    monkeypatch.setattr(packing, "WORDS", 200)
    ids = packing.Ids(*byte_tokenizer())
    plain = Tokenizer.from_file(byte_tokenizer()[0])
    encoded = []

    class Counted:
        def encode_ordinary(self, text, quick=ids.quick):
            encoded.extend(text.split("\n"))
            return quick.encode_ordinary(text)

    ids.quick = Counted()
    for k in range(100):
        t = " ".join(["the", "and", *(f"w{k * 20 + j}" for j in range(20)), "the"])
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.batch([t])] == [plain.encode(t, add_special_tokens=False).ids]
        assert len(ids.known) + len(ids.older) <= 200
        assert ids.held == sum(len(a) + len(b) for a, b in ids.known.items())
    assert [encoded.count(w) for w in ("the", " and", " the", " w1999")] == [1, 1, 1, 1]


def test_only_distinct_words_are_looked_up():
    """The words of a batch are told apart in Arrow: one that is repeated is no Python object each time."""

    class Counted(dict):
        lookups = 0

        def __getitem__(self, word):
            Counted.lookups += 1
            return super().__getitem__(word)

    ids = packing.Ids(*byte_tokenizer())
    plain = Tokenizer.from_file(byte_tokenizer()[0])
    ids.known = Counted()
    texts_ = [" ".join(["of the people", "by the people", "\n\nfor the people "] * 50)] * 20
    want = plain.encode(texts_[0], add_special_tokens=False).ids
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.batch(texts_)] == [want] * 20
    assert Counted.lookups < 20


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_ids_of_slices_equal_the_library(kind):
    """Texts are cut in the buffers of a batch, wherever in it they begin and whatever lies beside them."""
    ids = packing.Ids(*byte_tokenizer())
    plain = Tokenizer.from_file(byte_tokenizer()[0])
    every = ["", " ", "a", " a", "a ", "", "\n", " \n b\t", "x\xa0 y", "x", "\u3000", "", "<|endoftext|>", "a <|endoftext|>b", "\u2028", "\x1c ", "é ß", "  ", "\x85", *texts(60), ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in every]
    column = pa.array(every, kind)
    for begin in range(len(every) + 1):
        for n in (0, 1, 2, 3, 40):
            got = [np.frombuffer(x, "<u4").tolist() for x in ids.batch(column.slice(begin, n))]
            assert got == want[begin : begin + n], (begin, n)


def _anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) / 1024


def test_tasks_leave_workers_no_free_memory():
    """What a task has freed goes back to the system when it ends, also below blocks that are still in use."""

    class Frame:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    seen, pins = [], []

    def run(batches):
        for batch in batches:
            blocks = [bytes(2000) for _ in range(50_000)]
            pins.append(bytes(2000))
            del blocks
            seen.append(_anonymous_mb())
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array(range(4))], ["k"])
    task = common.map_batches(Frame(), run, "k long")(iter([batch]))
    assert next(task).equals(batch) and list(task) == []
    assert _anonymous_mb() < seen[0] - 60


def test_batches_in_smaller_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 0, 5000, 300, 300, 2, 900)])], ["text"])
    parts = list(common.smaller(batch, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.nbytes <= 1000 or p.num_rows == 1 for p in parts) and len(parts) > 2


def test_token_counts(odd, none):
    library = Tokenizer.from_file(PATH)
    want = sorted((i or 0, len((t or "").encode()), n, n > 100) for i, t in ODD for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    out = tokens.token_counts(odd, PATH, 100).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    for r in out:
        text = dict((i or 0, t or "") for i, t in ODD)[r.doc_id or 0]
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 100
        assert r.fit_chars == len(text) or len(library.encode(text[: r.fit_chars + 1], add_special_tokens=False).ids) > 100
    assert tokens.token_counts(none, PATH).count() == 0


def test_budgets_from_the_table(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(1, "one two three four"), (2, None), (3, "x" * 5000), (4, "日本語" * 50)]
    table = tokens.prefix_table(spark.createDataFrame(rows, "doc_id long, text string"), PATH).cache()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts_ = {i: t or "" for i, t in rows}
    for chars in (0, 2, 9, 200):
        assert {r.doc_id: r.tokens for r in tokens.tokens_of(table, chars).collect()} == {i: count(t[:chars]) for i, t in texts_.items()}
    for budget in (0, 3, 40):
        for r in tokens.longest_within(table, budget).collect():
            t = texts_[r.doc_id]
            assert count(t[: r.fit_chars]) <= budget and all(count(t[:k]) > budget for k in range(r.fit_chars + 1, min(len(t), r.fit_chars + 20) + 1))


def check_packing(rows, out, capacity):
    library = Tokenizer.from_file(byte_tokenizer()[0])
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(pieces) == len(rows)
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        at = 0
        for k, p in enumerate(sorted(pieces[i], key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at) and p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            assert k == 0 or p.length == capacity
            at += p.length
        assert at == len(ids) // 4
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), sum(p.length for r in pieces.values() for p in r)


def test_packing(spark, none):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(PIECES[:12]) for _ in range(draw.choice([0, 3, 20, 50, 90, 200, 700])))) for i in range(500)] + [(i + 1000, t) for i, (_, t) in enumerate(ODD) if t is None or len(t) < 10_000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bins, total = check_packing(rows, packing.pack(docs, byte_tokenizer(), 256).collect(), 256)
    assert bins <= 1.02 * -(-total // 256) + 1
    assert packing.pack(none, byte_tokenizer()).count() == 0


def test_packing_of_odd_documents(odd):
    out = packing.pack(odd, byte_tokenizer()).collect()
    assert len({(r.doc_id, r.ids_crc32, r.piece, r.sequence_id, r.offset) for r in out}) == len(out)
    assert sum(r.piece == 0 for r in out) == len(ODD)


@pytest.mark.parametrize("seed", range(3))
def test_best_fit(seed):
    draw = np.random.RandomState(seed)
    sizes = draw.randint(1, 100, 400)
    bins = packing.best_fit(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 100
    free, want = [], np.empty(400, int)
    for i in np.argsort(-sizes, kind="stable"):  # the plain way: the fullest bin that fits
        fitting = [b for b, room in enumerate(free) if room >= sizes[i]]
        b = min(fitting, key=lambda b: free[b]) if fitting else len(free)
        if not fitting:
            free.append(100)
        free[b] -= sizes[i]
        want[i] = b
    assert len(free) == bins.max() + 1 and sorted(fill) == sorted(100 - np.array(free))
