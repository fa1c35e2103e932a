"""BPE encoding and decoding of whole texts with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are compiled, with their ids as output, into an automaton whose suffixes are
shared. Executors map its file into memory; a batch of words runs through it in step, one byte at a time.
A word that it doesn't hold is merged exactly, pair by pair, again for a whole batch at once; a long word (base64,
minified code, any text without blanks) by itself with a heap of its pairs, in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from veldoc.llm.common import small_batches

#: Words of the corpus that the lexicon holds at most: this bounds what the driver collects and ships.
LEXICON_WORDS = 30_000
#: Letters of a word of the lexicon at most; longer words are merged where they occur.
LEXICON_LETTERS = 64
#: Words whose ids a Python worker keeps at a time.
CACHE_WORDS = 100_000
#: Bytes from which on a word is merged by itself.
LONG_WORD = 256
END = "</w>"
#: White space as the tokenizer's patterns mean it.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Automaton:
    """A minimal acyclic word automaton over bytes. The number of a word among all words, in sorted order,
    is the sum of what its edges skip; it leads to the word's ids."""

    def __init__(self, edges: np.ndarray, targets: np.ndarray, skips: np.ndarray, final: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        self.edges, self.targets, self.skips, self.final, self.starts, self.ids = edges, targets, skips, final, starts, ids

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> Automaton:
        """Adds sorted words one by one; a state whose word has ended is replaced by an equal one if there is any."""
        final, nexts, register = [False], [{}], {}
        path = [0]
        last = b""

        def settle(depth: int) -> None:
            while len(path) - 1 > depth:
                state = path.pop()
                key = (final[state], *nexts[state].items())
                nexts[path[-1]][last[len(path) - 1]] = register.setdefault(key, state)

        for word in sorted(words):
            shared = len(os.path.commonprefix([word, last]))
            settle(shared)
            for b in word[shared:]:
                final.append(False)
                nexts.append({})
                nexts[path[-1]][b] = len(final) - 1
                path.append(len(final) - 1)
            final[path[-1]], last = True, word
        settle(0)
        counts: dict[int, int] = {}  # words below each state: a state is counted when all that it leads to are
        todo = [0]
        while todo:
            state = todo[-1]
            left = [t for t in nexts[state].values() if t not in counts]
            if left:
                todo += left
                continue
            counts[state] = final[state] + sum(counts[t] for t in nexts[state].values())
            todo.pop()

        number, order = {0: 0}, [0]
        rows = []
        for state in order:
            skipped = int(final[state])
            for b, t in sorted(nexts[state].items()):
                if t not in number:
                    number[t] = len(order)
                    order.append(t)
                rows.append((number[state] << 8 | b, number[t], skipped))
                skipped += counts[t]
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 3)
        outputs = [words[w] for w in sorted(words)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in outputs])]).astype(np.int64)
        return Automaton(table[:, 0], table[:, 1], table[:, 2], np.array([final[s] for s in order]), starts, np.array([i for x in outputs for i in x], np.int64))

    def save(self, path: str) -> None:
        parts = [np.asarray(x, np.int64) for x in (self.edges, self.targets, self.skips, self.final, self.starts, self.ids)]
        with open(path, "wb") as f:
            f.write(np.array([len(x) for x in parts], np.int64).tobytes())
            for x in parts:
                f.write(x.tobytes())

    @staticmethod
    def map(path: str) -> Automaton:
        table = np.memmap(path, np.int64, "r").view(np.ndarray)
        ends = 6 + np.cumsum(table[:6])
        return Automaton(*np.split(table[6:], (ends - 6)[:5]))

    def output(self, number: int) -> list[int]:
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that it doesn't hold."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        out = np.full(len(words), -1, np.int64)
        if not len(self.edges):
            return out
        step = 0
        while len(live):
            key = state[live] << 8 | data[at[live] + step]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            ok = self.edges[edge] == key
            live, edge = live[ok], edge[ok]
            state[live] = self.targets[edge]
            number[live] += self.skips[edge]
            step += 1
            ended = lengths[live] == step
            done = live[ended]
            done = done[self.final[state[done]] > 0]
            out[done] = number[done]
            live = live[~ended]
        return out


class Bpe:
    """Vocabulary and merges of a tokenizer file of the word-end kind, in arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.digits = {i: str(i) for i in self.names}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE))
        self.split_ascii = re.compile(pattern.replace(r"[^\s", r"[^\t-\r\x20").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        self.first = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + END] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pair = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.rank = pair[order], order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        self.ranks: dict[int, int] | None = None  # of pairs, made when the first long word comes
        self.merged_ids: list[int] = []

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: the pair of least rank, the leftmost of equal ones, is merged until none is left."""
        if max(map(len, words), default=0) >= LONG_WORD:
            short = [w for w in words if len(w) < LONG_WORD]
            ids = dict(zip(short, self.merge(short))) if short else {}
            return [ids[w] if w in ids else self.merge_long(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        ids = self.first[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        out: list[list[int]] = [[]] * len(words)
        none = len(self.merged)
        while len(ids):
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.full(len(ids), none, np.int64)
            rank[:-1] = np.where((self.pairs[at] == key) & (word[:-1] == word[1:]), self.rank[at], none)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(ids)))
            for h, n in zip(heads[least == none].tolist(), sizes[least == none].tolist()):
                out[word[h]] = ids[h : h + n].tolist()
            wide = np.repeat(least, sizes)
            hit = np.flatnonzero((rank == wide) & (wide < none))
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])] if len(hit) else hit
            ids[hit] = self.merged[rank[hit]]
            keep = wide < none
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one word by a heap of pairs over linked places: n log n, some 200 bytes of memory a letter. A pair
        whose place has changed since it was put in the heap is passed over."""
        if self.ranks is None:
            self.ranks = dict(zip(self.pairs.tolist(), self.rank.tolist()))
            self.merged_ids = self.merged.tolist()
        ranks, merged = self.ranks, self.merged_ids
        data = np.frombuffer(word, np.uint8)
        ids = self.first[data]
        ids[-1] = self.last[data[-1]]
        key = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        here = np.flatnonzero(self.pairs[at] == key)
        heap = np.sort(self.rank[at[here]] << 32 | here).tolist()  # a sorted list is a heap
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = merged[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                r = ranks.get(ids[i] << 32 | ids[after[j]])
                if r is not None:
                    heapq.heappush(heap, r << 32 | i)
            if before[i] >= 0:
                r = ranks.get(ids[before[i]] << 32 | ids[i])
                if r is not None:
                    heapq.heappush(heap, r << 32 | before[i])
        return [x for x in ids if x >= 0]


@lru_cache(2)
def model(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(2)
def _library_split(path: str):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)["pre_tokenizer"]["pretokenizers"]
    pattern = next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")
    return Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def split_by_library(path: str, text: str) -> list[str]:
    """The words of a text with characters that are newer than Python's Unicode tables: only the library knows which
    of them it takes for letters."""
    normalizer, split = _library_split(path)
    return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]


_LOWERED = str.maketrans({"Σ": "σ", "İ": "i̇"})


def normalised(text: str) -> str:
    """NFC and lower case character by character. White space is no part of any token, so it may stay as it is."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(_LOWERED).lower() if "Σ" in text or "İ" in text else text.lower()


class Encoder:
    """Encodes batches of texts and keeps the ids of the words it has met lately: a generation of CACHE_WORDS
    words and the one before it."""

    def __init__(self, path: str, lexicon: Automaton | None):
        self.bpe, self.lexicon, self.cache, self.before = model(path), lexicon, {}, {}
        self.path, self.seen, self.newer = path, set(), set()

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if unseen := set(text) - self.seen:
                self.seen |= unseen
                self.newer |= {c for c in unseen if unicodedata.category(c) == "Cn"}
            if self.newer and not self.newer.isdisjoint(text):
                return split_by_library(self.path, text)
        plain = normalised(text)
        return self.bpe.split_ascii.findall(plain) if plain.isascii() else self.bpe.split.findall(plain)

    def _learn(self, words: set[str]) -> None:
        if len(self.cache) + len(words) > CACHE_WORDS:
            self.before, self.cache = self.cache, {}
        cache, known = self.cache, self.before
        words = [w for w in words if w not in known or cache.__setitem__(w, known[w])]
        if not words:
            return
        raw = [w.encode("utf-8", "replace") for w in words]
        found = self.lexicon.find(raw) if self.lexicon else np.full(len(raw), -1)
        rest = np.flatnonzero(found < 0).tolist()
        ids = dict(zip(rest, self.bpe.merge([raw[i] for i in rest]))) if rest else {}
        names, digits = self.bpe.names, self.bpe.digits
        for i, (w, k) in enumerate(zip(words, found.tolist())):
            x = ids[i] if k < 0 else self.lexicon.output(k)
            cache[w] = (digits[x[0]], names[x[0]], 1) if len(x) == 1 else (" ".join([digits[j] for j in x]), " ".join([names[j] for j in x]), len(x))

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[str, str, int]]:
        """For each text: ids and decoded tokens, each joined by single spaces, and the number of tokens.
        The words of all the texts that are not known yet are looked up and merged together."""
        split: list[list[tuple[str, list[str]]]] = []
        for text in texts:
            parts, at, text = [], 0, text or ""
            for m in self.bpe.specials.finditer(text) if self.bpe.specials and "<|" in text else ():
                parts += [("", self._words(text[at : m.start()])), (m[0], [])]
                at = m.end()
            split.append([*parts, ("", self._words(text[at:] if at else text))])
        cache = self.cache
        if unmet := {w for parts in split for _, words in parts for w in words if w not in cache}:
            if len(cache) + len(unmet) > CACHE_WORDS:
                unmet = {w for parts in split for _, words in parts for w in words}
            self._learn(unmet)
            cache = self.cache
        for parts in split:
            got = []
            for special, words in parts:
                got += [(str(self.bpe.special[special]), special, 1)] if special else [cache[w] for w in words]
            if got:
                ids, names, counts = zip(*got)
                yield " ".join(ids), " ".join(names), sum(counts)
            else:
                yield "", "", 0


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(path: str, lexicon: str) -> Encoder:
    if (path, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, lexicon] = Encoder(path, Automaton.map(SparkFiles.get(lexicon)))
    return _ENCODERS[path, lexicon]


def build_lexicon(df: DataFrame, tokenizer: str, text_col: str = "text", words: int = LEXICON_WORDS) -> str:
    """Counts the words of all texts, compiles the `words` most frequent ones and hands the file to all executors.
    Returns its name among Spark's files. The counts are summed before they are shuffled. Of LEXICON_LETTERS a word at
    most, what the driver collects is bounded in bytes too."""
    spark = df.sparkSession
    runs = F.explode(F.split(F.lower(F.col(text_col)), r"\P{L}+")).alias("w")
    top = df.select(runs).where((F.col("w") != "") & (F.length("w") <= LEXICON_LETTERS)).groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).select("w")
    found = [r["w"].encode() for r in top.toLocalIterator()]
    ids = dict(zip(found, model(tokenizer).merge(found))) if found else {}
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="veldoc-")
    Automaton.compile(ids).save(f"{folder}/{name}")
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def _in_parts(batches: Iterator[pd.DataFrame], rows: int = 400) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "token_ids", lexicon: str | None = None) -> DataFrame:
    """`df` and an array of the ids of each text; a null or empty text has an empty array. All rows and columns stay;
    a column of the name `ids_col` is replaced."""
    small_batches(df.sparkSession)
    name = lexicon or build_lexicon(df, tokenizer, text_col)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(tokenizer, name)
        for batch in texts:
            out = []
            for at in range(0, len(batch), 400):
                out += [np.array(x.split(" "), np.int32) if x else np.zeros(0, np.int32) for x, _, _ in encoder.encode(batch.iloc[at : at + 400])]
            yield pd.Series(out)

    return df.withColumn(ids_col, ids(F.col(text_col)))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """`df` and the tokens of each array of ids joined by single spaces, special tokens among them; null for null.
    An id that the vocabulary doesn't have is left out."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        names = model(tokenizer).names
        return ids.map(lambda x: None if x is None else " ".join([names[i] for i in x if i in names]))

    return df.withColumn(text_col, text(F.col(ids_col)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, for each row of `documents`, whole texts of any length and
    words of any length. A null or empty text has no tokens and the digests of the empty string; a null id stays null;
    repeated rows stay."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    name = build_lexicon(docs, tokenizer)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer, name)
        for b in _in_parts(batches):
            out = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(tokens.encode()).hexdigest()) for ids, tokens, n in encoder.encode(b["text"])]
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    return docs.mapInPandas(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
