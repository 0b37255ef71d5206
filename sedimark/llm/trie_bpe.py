"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

A text is cut into pre-token words. The distinct words that a worker has not met
yet are inserted into a trie; a depth-first walk gives every node (a prefix) the
last token of that prefix's encoding and a link to the node where that token
starts. For every prefix exactly one token fits: it must end the prefix and be
*compatible* with the last token of what stands before it, which means that
encoding the two tokens' bytes together gives these two tokens again. So each
shared prefix is encoded once, whatever number of words share it.

The trie is held as its sorted word list plus the walk's current path (one state
per byte of the path), which is the depth-first order of the explicit tree
without its nodes; memory is that of the new words.

Defined cases: a null text is an empty one (no tokens); an empty text gives no
tokens; the text of a special token gives that token's id; words of any length
are walked whole; repeated rows give repeated results; an empty table gives no row;
other columns of the input, whatever their names, aren't carried on.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import table

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode White_Space, what ``\s`` means there.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs between white space. No word crosses their borders, so each is cut into words and encoded once.
RUNS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies: bytes that print stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


NEVER = float("inf")


class PrefixTrie:
    """Distinct words in depth-first order; ``walk`` gives each word with the length of the path that it shares with the one before."""

    def __init__(self) -> None:
        self._words: set[bytes] = set()

    def insert(self, words) -> None:
        self._words.update(words)

    def walk(self) -> Iterator[tuple[bytes, int]]:
        before = b""
        for word in sorted(self._words):
            shared, most = 0, min(len(before), len(word))
            if before[:most] == word[:most]:
                shared = most
            else:
                while before[shared] == word[shared]:
                    shared += 1
            yield word, shared
            before = word


class TrieBpe:
    """Encoder and decoder of one vocabulary file (``tokenizers`` JSON, byte-level BPE).

    ``cache_words`` bounds the memory for words already encoded; when it is full
    the cache starts anew, which changes the speed and never the result.
    """

    def __init__(self, vocabulary: str, cache_words: int = 250_000) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: bytes(symbols[c] for c in t) for t, i in raw.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        as_bytes = {t: self.bytes_of[i] for t, i in raw.items()}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            whole = self.id_of[as_bytes[a] + as_bytes[b]]
            self.rank[self.id_of[as_bytes[a]], self.id_of[as_bytes[b]]] = (r, whole)
        self.longest = max(map(len, self.id_of))
        self.token_of = {b: i for b, i in self.id_of.items() if self._merge(b) == [i]}  # tokens that their own bytes lead to
        self.ends: dict[bytes, set[int]] = {}  # lengths of the tokens that end in these three bytes, or two at a word's start
        for b in self.token_of:
            for n in (2, 3):
                if len(b) >= n:
                    self.ends.setdefault(b[-n:], {1}).add(len(b))
        for b in [b for b in self.ends if len(b) == 3]:
            self.ends[b] |= self.ends.get(b[-2:], {1}) & {1, 2}
        self.ends = {k: sorted(v, reverse=True) for k, v in self.ends.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # the merge that makes each token
        for pair, (_, whole) in self.rank.items():
            self.parts.setdefault(whole, pair)
        self.left_edges: dict[int, list[tuple[int, float]]] = {}
        self.right_edges: dict[int, list[tuple[int, float]]] = {}
        self.fits: dict[int, bool] = {}
        self.pattern = regex.compile(PATTERN.replace("\\s", SPACE).replace(f"|{SPACE}+", f"|[{SPACE}]+").replace("\\S", f"[^{SPACE}]"))
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_words = cache_words
        self.cache: dict[str, tuple[int, ...]] = {}
        self.decimal: dict[str, str] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Plain BPE of a few bytes, to find the tokens that their own bytes lead to."""
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            found = [(self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
            if not found:
                break
            best, _ = min(found)
            out, i = [], 0
            while i < len(ids):
                pair = tuple(ids[i : i + 2])
                if len(pair) == 2 and pair in self.rank and self.rank[pair][0] == best:
                    out.append(self.rank[pair][1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _edge(self, token: int, side: int, known: dict[int, list[tuple[int, float]]]) -> list[tuple[int, float]]:
        """What stands at one edge of a token while it is built, each with the rank of the merge that takes it in."""
        found = known.get(token)
        if found is None:
            parts = self.parts.get(token)
            found = [(token, NEVER)]
            if parts:
                inner = self._edge(parts[side], side, known)
                found = [*inner[:-1], (inner[-1][0], self.rank[parts][0]), (token, NEVER)]
            known[token] = found
        return found

    def _compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: at no time is the merge over their border the next one. The left one of equal merges goes first."""
        known = self.fits.get(key := a << 20 | b)
        if known is None:
            left, right = self._edge(a, 1, self.right_edges), self._edge(b, 0, self.left_edges)
            i = j = 0
            known = True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                over = self.rank.get((x, y))
                if over is not None and over[0] < until_x and over[0] <= until_y:
                    known = False
                    break
                if until_x == until_y == NEVER:
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_words(self, words) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words: one walk through the trie of all of them."""
        trie, out = PrefixTrie(), {}
        trie.insert(words)
        last, start = [-1], [0]  # for each prefix length of the path: its last token, and where that token starts
        ends, token_of, fits = self.ends, self.token_of, self.fits
        for word, shared in trie.walk():
            del last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                lengths = ends.get(word[end - 3 : end]) if end > 2 else None
                if lengths is None:
                    lengths = (2, 1) if end > 1 else (1,)
                for n in lengths:
                    if n > end or (token := token_of.get(word[end - n : end])) is None:
                        continue
                    before = last[end - n]
                    if before < 0 or (known := fits.get(before << 20 | token)) or known is None and self._compatible(before, token):
                        last.append(token)
                        start.append(end - n)
                        break
                else:
                    raise ValueError(f"no token ends the prefix {word[:end]!r}")
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at = start[at]
            out[word] = tuple(reversed(ids))
        return out

    def learn(self, runs) -> None:
        """Encode distinct runs that the cache lacks and put them there."""
        plain, cut = {}, {}
        for r in runs:
            if (r[1:] if r[0] == " " else r).isalpha():
                plain[r] = r.encode()
            else:
                cut[r] = [w.encode() for w in self.pattern.findall(r)]
        found = self.encode_words(chain(plain.values(), chain.from_iterable(cut.values())))
        for r, word in plain.items():
            self.cache[r] = found[word]
        for r, words in cut.items():
            self.cache[r] = tuple(chain.from_iterable(map(found.__getitem__, words)))
        for r in runs:
            self.decimal[r] = ",".join(map(str, self.cache[r]))

    def runs(self, text: str) -> list[str]:
        """Runs and special tokens of a text, in order."""
        if self.cuts is None or not any(s in text for s in self.special):
            return RUNS.findall(text)
        out = []
        for i, part in enumerate(self.cuts.split(text)):
            out += [part] if i % 2 else RUNS.findall(part)
        return out

    def prepare(self, texts: list[str], most_runs: int = 400_000) -> Iterator[tuple[int, list[str]]]:
        """(position, runs) of each text, when the cache holds all its runs. Texts come in groups of about so many runs."""
        group, n = [], 0
        for i, text in enumerate(texts):
            runs = self.runs(text)
            group.append((i, runs))
            n += len(runs)
            if n >= most_runs:
                yield from self._ready(group)
                group, n = [], 0
        yield from self._ready(group)

    def _ready(self, group):
        if len(self.cache) > self.cache_words:
            self.cache.clear()
            self.decimal.clear()
        for s, i in self.special.items():
            self.cache[s], self.decimal[s] = (i,), str(i)
        known = self.cache
        new = Counter(r for _, runs in group for r in runs if r not in known)
        self.learn(new)
        yield from group
        for r, n in new.items():  # what came once in a group is not worth its memory
            if n == 1:
                del known[r], self.decimal[r]

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        for _, runs in self.prepare(texts):
            yield list(chain.from_iterable(map(self.cache.__getitem__, runs)))

    def decode(self, ids) -> str:
        """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, TrieBpe] = {}


def coder(vocabulary: str) -> TrieBpe:
    """This worker's coder; the vocabulary is read once for each Python worker."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = TrieBpe(vocabulary)
    return _CODERS[vocabulary]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's collector of cycles until a task ends: a coder's millions of small objects make none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def encode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, n_tokens, decoded string) of each text, by one scan without a shuffle."""

    def run(batches):
        with uncollected():
            c = coder(vocabulary)
            for batch in batches:
                ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
                rows = list(c.encode_batch(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32())), pa.array(map(len, rows), pa.int64()), pa.array([c.decode(r) for r in rows], pa.string())], ["id", "ids", "n_tokens", "decoded"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, decoded string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of ids and text: nothing long leaves the worker."""

    def run(batches):
        with uncollected():
            c = coder(vocabulary)
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                counts, ids_sha, text_sha = [0] * len(texts), [""] * len(texts), [""] * len(texts)
                for i, runs in c.prepare(texts):
                    ids = list(chain.from_iterable(map(c.cache.__getitem__, runs)))
                    counts[i] = len(ids)
                    ids_sha[i] = hashlib.sha256(",".join(map(c.decimal.__getitem__, runs)).encode()).hexdigest()
                    text_sha[i] = hashlib.sha256(c.decode(ids).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_column)


def op3_trie_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of ids and of the decoded text of every document, with the 50k byte-level vocabulary."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
