"""Token counts by prefix dynamic programming over a byte-pair vocabulary.

For every prefix of a word exactly one vocabulary entry can end that prefix's encoding: the entry that is
compatible with the entry ending the shorter prefix before it, where two entries are compatible when merging
their symbols gives back the two. So the encoding of each prefix follows from those of shorter ones, and one
pass stores the token count at every prefix. Prefixes that words share are worked out once. A document is a
run of words (cut at ASCII white space, where no token of this vocabulary reaches across), so its counts are those of its
words added up, and inside a word those of the word's prefixes. prefix_table() stores the count at every code point;
questions of truncation and budget are answered from it without encoding anything again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import map_batches, text_of

#: Bytes of words, and numbers of word prefixes and pairs, that a task remembers; beyond these it starts afresh.
WORD_BYTES, PREFIXES, PAIRS = 128 << 20, 300_000, 400_000
#: What a word that is remembered takes besides its bytes, about.
ENTRY = 120
#: Longer words are worked out by position, without remembering each of their prefixes.
LONG = 48
END = "</w>"
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class PrefixCounter:
    """Exact counts of a tokenizers file of kind BPE with word ends (and white space dropped)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        self.library = Tokenizer.from_file(path)
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) + ")")
        self.words: dict[bytes, int] = {b"": 0}
        self.held = 0  # bytes of words
        self.kinds: dict[str, str] = {}
        self.prefixes: dict[str, tuple[str, int]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Byte-pair merging of a few symbols: the best-ranked pair first, leftmost of equals."""
        while len(symbols) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def compatible(self, before: str, token: str) -> bool:
        """Whether merging the symbols of both gives both; before may be empty."""
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            stem = token.removesuffix(END)
            symbols = [*before, *stem]
            if stem != token:
                symbols[-1] += END
            known = self.merged(symbols) == ([before, token] if before else [token])
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _step(self, word: str, end: int, last: list[str], suffix: str, before: int = 0) -> str:
        """The token that ends word[:end], given those that end shorter prefixes; word lacks its first `before` letters."""
        for k in range(min(end, self.longest), 0, -1):
            token = word[end - k - before : end - before] + suffix
            if token in self.vocab and self.compatible(last[end - k], token):
                return token
        raise ValueError(f"no encoding: {word[:end]!r}")

    def _stems(self, word: str, upto: int) -> tuple[list[str], list[int]]:
        """Last tokens and counts of the first prefixes of a word as parts of a longer one."""
        last, count = [""], [0]
        prefixes = self.prefixes
        if len(prefixes) >= PREFIXES:
            prefixes.clear()
        for end in range(1, upto + 1):
            known = prefixes.get(word[:end]) if end <= LONG else None
            if known is None:
                token = self._step(word, end, last, "")
                known = (token, count[end - len(token)] + 1)
                if end <= LONG:
                    prefixes[word[:end]] = known
            last.append(known[0])
            count.append(known[1])
        return last, count

    def piece(self, word: str) -> int:
        """Tokens of a pre-token, in byte-level letters."""
        if not word:
            return 0
        last, count = self._stems(word, len(word) - 1)
        token = self._step(word, len(word), last, END)
        return count[len(word) - len(token) + len(END)] + 1

    def piece_prefixes(self, word: str, ends: list[int]) -> list[int]:
        """Tokens of the prefixes of a pre-token that end at `ends` (from 1), each taken as a text that ends there."""
        last, count = self._stems(word, len(word) - 1)
        return [count[end - len(t) + len(END)] + 1 for end, t in ((end, self._step(word, end, last, END)) for end in ends)]

    def _pieces(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text without special strings, in byte-level letters."""
        if text.isascii():
            text = text.lower()
            if not _CONTROL.search(text):
                yield from _ASCII_PIECES.findall(text)
                return
        for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
            yield piece

    def _count(self, raw: bytes) -> int:
        return sum(1 if k % 2 else sum(map(self.piece, self._pieces(part))) for k, part in enumerate(self.special.split(raw.decode())))

    def word(self, raw: bytes) -> int:
        """Tokens of a word in UTF-8: a run without ASCII white space."""
        count = self.words.get(raw)
        if count is None:
            count = self._count(raw)
            if self.held > WORD_BYTES:
                self.words.clear()
                self.held = 0
            if len(raw) < WORD_BYTES >> 10:  # a longer one is worked out each time
                self.words[raw] = count
                self.held += len(raw) + ENTRY
        return count

    def counts(self, raw: bytes) -> list[int]:
        """Tokens of each word of a text, in order."""
        words = raw.split()
        out = list(map(self.words.get, words))
        if None in out:
            out = [self.word(w) if n is None else n for w, n in zip(words, out, strict=True)]
        return out

    def kind(self, char: str) -> str:
        """What the pre-tokenizer takes a normal character for: letter (L), number (N), white space (empty), or other (O)."""
        known = self.kinds.get(char)
        if known is None:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            known = "" if not cut(char) else "L" if len(cut("a" + char)) == 1 else "O" if len(cut("!" + char)) == 1 else "N"
            self.kinds[char] = known
        return known

    def total(self, text: str) -> int:
        return sum(self.counts(text.encode()))

    def run_prefixes(self, run: str) -> list[int]:
        """Token counts of run[:1], run[:2], ..., for a run without ASCII white space.

        A prefix has the pre-tokens of the whole run up to the one it ends in, of which it has a prefix, so one pass over
        each pre-token does. A part in which the normalizer joins letters is walked by character (_Walk), which takes back
        what only a prefix has. Prefixes of a contraction or a special string, a few letters each, are counted from the pre-token that they end in.
        """
        out: list[int] = []
        done = tail = 0  # tokens before, and the place where the pre-token before began
        for k, part in enumerate(self.special.split(run)):
            at = len(out)
            if k % 2:
                base = done - self._count(run[tail:at].encode())
                out += [base + self._count(run[tail:e].encode()) for e in range(at + 1, at + len(part))] + [done + 1]
                done, tail = done + 1, at + len(part)
                continue
            letters = [c.lower() if c.isascii() else self.library.normalizer.normalize_str(c) for c in part]
            whole = part.lower() if part.isascii() else self.library.normalizer.normalize_str(part)
            pieces = self.library.pre_tokenizer.pre_tokenize_str(whole)
            ends = np.cumsum([len(x) for x in letters]).tolist()  # where each code point's normal form ends
            place = {0: 0} | {e: i for i, e in enumerate(ends, 1)}
            if "".join(letters) != whole or _CONTROL.search(part) or any(a not in place or b not in place for _, (a, b) in pieces):
                inner, tail = _Walk(self).prefixes(part)
                out += [done + n for n in inner]
                done, tail = out[-1], at + tail
                continue
            for piece, (a, b) in pieces:
                first, last = place[a], place[b]
                out += [done] * (at + first - len(out))  # white space beyond ASCII
                tail = at + first
                if whole[a] == "'" and b - a > 1 and whole[a + 1].isalpha():
                    out += [done + self._count(part[first:e].encode()) for e in range(first + 1, last + 1)]
                else:
                    stops = list(accumulate(len(x.encode()) for x in letters[first:last]))
                    out += [done + n for n in self.piece_prefixes(piece, stops)]
                done += self.piece(piece)
            out += [done] * (at + len(part) - len(out))
        return out

    def every_prefix(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text[:len(text)]."""
        out, before = [0], 0
        for m in _RUNS.finditer(text):
            run = m.group()
            if run[0] in " \t\n\v\f\r":
                out += [before] * len(run)
            else:
                inner = self.run_prefixes(run)
                out += [before + n for n in inner]
                before += inner[-1]
        return np.array(out)

    def fit(self, raw: bytes, tokens: list[int], limit: int) -> int:
        """Code points of the longest prefix of a text that has at most `limit` tokens, given the tokens of its words."""
        upto = np.fromiter(accumulate(tokens), np.int64, len(tokens))
        k = int(np.searchsorted(upto, limit, "right"))  # the first word that is not in whole
        if k == len(tokens):
            return len(raw.decode())
        start, end = next(islice(((m.start(), m.end()) for m in _WORDS.finditer(raw)), k, None))
        left = limit - (int(upto[k - 1]) if k else 0)
        inner = self.run_prefixes(raw[start:end].decode())
        return len(raw[:start].decode()) + max((i for i, n in enumerate(inner, 1) if n <= left), default=0)


class _Walk:
    """Counts of a growing text of normal characters: the tokens of closed pre-tokens, and the open one with its prefixes."""

    def __init__(self, counter: PrefixCounter) -> None:
        self.counter = counter
        self.done, self.kind, self.quote = 0, "", ""  # quote: an apostrophe, and a letter after it, that may become a contraction
        self.letters, self.before = "", 0  # the open pre-token in byte-level letters, without so many at its begin
        self.last, self.count = [""], [0]

    def _push(self, char: str) -> None:
        c = self.counter
        for letter in byte_letters(char):
            self.letters += letter
            if len(self.letters) > 4 * c.longest:  # no token reaches further back
                self.before += len(self.letters) - c.longest
                self.letters = self.letters[-c.longest :]
            token = c._step(self.letters, len(self.last), self.last, "", self.before)
            self.last.append(token)
            self.count.append(self.count[len(self.last) - 1 - len(token)] + 1)

    def _open(self) -> int:
        """Tokens of the open pre-token, as one that ends here."""
        if self.quote:
            return sum(map(self.counter.piece, map(byte_letters, self.quote)))
        if not self.kind:
            return 0
        end = len(self.last) - 1
        token = self.counter._step(self.letters, end, self.last, END, self.before)
        return self.count[end - len(token) + len(END)] + 1

    def _close(self) -> None:
        self.done += self._open()
        self.kind = self.quote = self.letters = ""
        self.before, self.last, self.count = 0, [""], [0]

    def tokens(self) -> int:
        return self.done + self._open()

    def step(self, char: str) -> None:
        """One more normal character."""
        if self.quote:
            both = self.quote + char
            if both in CONTRACTIONS:
                self.done += self.counter.piece(byte_letters(both))
                self.quote = ""
                return
            if any(x.startswith(both) for x in CONTRACTIONS):
                self.quote = both
                return
            pending, self.quote = self.quote, ""
            self.kind = "O"
            self._push(pending[0])
            for c in pending[1:]:
                self._plain(c)
        self._plain(char)

    def _plain(self, char: str) -> None:
        kind = self.counter.kind(char)
        if kind and kind != "N" and kind == self.kind:
            self._push(char)
            return
        self._close()
        if kind == "N":
            self.done += self.counter.piece(byte_letters(char))
        elif char == "'":
            self.quote = char
        elif kind:
            self.kind = kind
            self._push(char)

    def prefixes(self, part: str) -> tuple[list[int], int]:
        """Tokens of part[:1], part[:2], ...; and a place from which on a longer text is cut anew.

        Normal forms change only between a starter and what joins it, so they are made cluster by cluster. Inside a cluster
        the normal form of each prefix is tried, and taken back where a longer one has another. A mark that stays as it is behind
        its like does so for as long as it is repeated; only long rows of different marks on one letter are made anew for each prefix.
        """
        normal = self.counter.library.normalizer.normalize_str
        out: list[int] = []
        tail = start = 0
        while start < len(part):
            end = start + 1
            while end < len(part) and joins(part[end]):
                end += 1
            if not self.kind and not self.quote:
                tail = start
            cluster, formed, settled, kept = part[start:end], "", False, self._state()
            for k, char in enumerate(cluster, 1):
                if settled and char == cluster[k - 2]:
                    self.step(char)
                    formed += char
                else:
                    now = normal(cluster[:k])
                    if not now.startswith(formed):
                        self._restore(kept)
                        formed = ""
                    settled = formed.endswith(char) and now == formed + char
                    for c in now[len(formed) :]:
                        self.step(c)
                    formed = now
                out.append(self.tokens())
            start = end
        return out, tail

    def _state(self) -> tuple:
        return self.done, self.kind, self.quote, self.letters, self.before, len(self.last), self.last, self.count

    def _restore(self, state: tuple) -> None:
        self.done, self.kind, self.quote, self.letters, self.before, size, self.last, self.count = state
        del self.last[size:], self.count[size:]


CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def _byte_table() -> list[str]:
    """Letters of bytes: printable ones stand for themselves, the others for the letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def byte_letters(text: str) -> str:
    table = _byte_table()
    return "".join(table[b] for b in text.encode())


@lru_cache(maxsize=1)
def _second_parts() -> frozenset[str]:
    """Characters that a canonical composition may join to the one before."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in parts if len(p) == 2 and "<" not in p[0]) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


def joins(char: str) -> bool:
    """Whether a normal form may join a character with what is before it, or move it."""
    return not char.isascii() and (unicodedata.combining(char) > 0 or char in _second_parts())


_RUNS = re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("_text"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit, fit_chars for each row.

    n_tokens is what the tokenizers library gives without added special tokens; special strings inside texts are special
    tokens, as by its default. fit_chars is the length of the longest prefix, in code points, that has at most `limit` tokens.
    A null text is empty: all numbers are 0. Ids may repeat or be null; every row gets its own result. An empty table
    gives no rows.
    """
    slim = _texts(docs, id_col, text_col)
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            sizes, totals, fits = [], [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                tokens = count.counts(raw)
                total = sum(tokens)
                sizes.append(len(raw))
                totals.append(total)
                fits.append(len(text) if total <= limit else count.fit(raw, tokens, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_()), pa.array(fits, pa.int64())],
                [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return map_batches(slim, run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts: the tokens of every prefix of a text, by its length in code points, from 0 to the whole.

    The table answers later questions by itself: see tokens_of() and longest_within(). A null text is empty.
    """
    slim = _texts(docs, id_col, text_col)
    fields = slim.select(id_col).schema.simpleString()[len("struct<") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):  # four bytes for each code point: a text at a time
                counts = pa.array(count.every_prefix(text), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), lists], [id_col, "counts"])

    return map_batches(slim, run, f"{fields}, counts array<int>")


def tokens_of(table: DataFrame, chars: int) -> DataFrame:
    """A prefix table with `tokens`: those of the first `chars` code points, or of the whole text where it is shorter."""
    return table.withColumn("tokens", F.get("counts", F.least(F.lit(chars), F.size("counts") - 1)))


def longest_within(table: DataFrame, budget: int) -> DataFrame:
    """A prefix table with `fit_chars`: the code points of the longest prefix that has at most `budget` tokens."""
    return table.withColumn("fit_chars", F.array_max(F.transform("counts", lambda n, i: F.when(n <= budget, i))))
