"""Byte-level BPE encoding and decoding of whole texts.

A word (pre-token) is merged with a segment tree over the ranks of its adjacent pairs: the root holds
the lowest rank, the walk to its leftmost leaf gives the merge, and the merge updates the two
neighbouring pairs and clears its own in logarithmic time, until the root is infinite. New words of a
portion of texts are merged in step, each with its own tree, by vector operations. Decoding joins
the bytes of the ids and reads them as UTF-8 with replacement.

The vocabulary file is read once on the driver and shipped to the tasks as a Spark broadcast (its size
is that of the file, checked against MAX_FILE_BYTES, and never grows with the corpus). Words repeat,
so a worker keeps the results of short words in two generations of up to CACHE_WORDS each: a full young
generation becomes the old one, and words still in use move back from there.

Defined cases: null is the empty text (no ids); any length of word is merged whole; added tokens of the
file are split off before the words, as the tokenizer library does; extra columns pass unchanged.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_FILE_BYTES = 64 << 20
CACHE_WORDS = 200_000
CACHE_WORD_CHARS = 64
STEP_SYMBOLS = 64       # words of up to so many adjacent pairs are merged in step with others
STEP_ROWS = 8192        # such words at a time
PORTION_CHARS = 2 << 20  # text whose words are looked up together
INF = 1 << 62

# Fixed value: the word pattern of this family of byte-level tokenizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merge_word(symbols: list[int], rank_of: dict[int, int], merged: list[int]) -> list[int]:
    """The ids of one word: leftmost lowest-rank pair first, by a segment tree over pair ranks. A leaf holds
    (rank, position) as one number, so the root names the merge and ties go to the left."""
    n = len(symbols)
    if n < 2:
        return symbols
    size, bits = 1, 0
    while size < n - 1:
        size, bits = size * 2, bits + 1
    rank = rank_of.get
    tree = [INF] * (2 * size)
    at = size
    a = symbols[0]
    for b in symbols[1:]:
        if (r := rank(a << 32 | b)) is not None:
            tree[at] = r << bits | at - size
        a, at = b, at + 1
    for i in range(size - 1, 0, -1):
        x, y = tree[2 * i], tree[2 * i + 1]
        tree[i] = x if x < y else y

    symbols = symbols.copy()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) < INF:
        i = best & size - 1
        j = after[i]
        new = symbols[i] = merged[best >> bits]
        symbols[j] = -1
        k = after[i] = after[j]
        # the pair that begins at i is gone or new, so is the one before it; the one that began at j is gone
        changed = [(i, INF)]
        if k < n:
            before[k] = i
            changed[0] = i, INF if (r := rank(new << 32 | symbols[k])) is None else r << bits | i
            changed.append((j, INF))
        elif j < size:
            changed.append((j, INF))
        if (h := before[i]) >= 0:
            changed.append((h, INF if (r := rank(symbols[h] << 32 | new)) is None else r << bits | h))
        for at, low in changed:  # point updates: up to the root or to the first node that keeps its minimum
            at += size
            while tree[at] != low:
                tree[at] = low
                at >>= 1
                if not at:
                    break
                x, y = tree[2 * at], tree[2 * at + 1]
                low = x if x < y else y
    return [s for s in symbols if s >= 0]


def merge_rows(symbols: np.ndarray, n: np.ndarray, pairs: np.ndarray, merged: np.ndarray) -> None:
    """``merge_word`` for many words at once, in place: a row of ``symbols`` (size + 1 places, -1 after its ``n``
    symbols) has its own segment tree, and all rows take their next merge in step. ``pairs`` holds the sorted pair
    keys and, beside them, their ranks."""
    rows, size = len(symbols), symbols.shape[1] - 1
    bits = size.bit_length() - 1

    def leaf_of(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        place = np.searchsorted(pairs[0], key)
        place[place == pairs.shape[1]] = 0
        return np.where(pairs[0][place] == key, pairs[1][place] << bits | at, INF)

    tree = np.full((rows, 2 * size), INF, np.int64)
    r, c = np.nonzero(np.arange(size)[None, :] < n[:, None] - 1)
    tree[r, size + c] = leaf_of(symbols[r, c], symbols[r, c + 1], c)
    level = size
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    after = np.tile(np.arange(1, size + 2), (rows, 1))
    before = np.tile(np.arange(-1, size), (rows, 1))

    def update(r: np.ndarray, leaf: np.ndarray, low: np.ndarray) -> None:
        node = leaf + size
        tree[r, node] = low
        for _ in range(bits):
            node >>= 1
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

    r = np.nonzero(tree[:, 1] < INF)[0]
    while len(r):
        best = tree[r, 1]
        i = best & size - 1
        j = after[r, i]
        new = merged[best >> bits]
        symbols[r, i], symbols[r, j] = new, -1
        k = after[r, j]
        after[r, i] = k
        low = np.full(len(r), INF, np.int64)
        m = np.nonzero(k < n[r])[0]
        before[r[m], k[m]] = i[m]
        low[m] = leaf_of(new[m], symbols[r[m], k[m]], i[m])
        update(r, i, low)
        m = np.nonzero(j < size)[0]
        update(r[m], j[m], np.full(len(m), INF, np.int64))
        h = before[r, i]
        m = np.nonzero(h >= 0)[0]
        update(r[m], h[m], leaf_of(symbols[r[m], h[m]], new[m], h[m]))
        r = r[tree[r, 1] < INF]


class Codec:
    """Encoder and decoder built from the text of a vocabulary file."""

    def __init__(self, file_text: str, cache_words: int = CACHE_WORDS):
        spec = json.loads(file_text)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        alphabet = byte_alphabet()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank_of = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        self.sorted_pairs = np.array(sorted(self.rank_of.items()), np.int64).reshape(-1, 2).T.copy()
        self.merged_ids = np.array(self.merged, np.int64)
        self.byte_id = [0] * 256
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        self.byte_ids = np.array(self.byte_id, np.int64)
        self.bytes_of = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.words = regex.compile(WORD_PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.cache: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}
        self.cache_words = cache_words

    def result(self, w: str, ids: list[int]) -> tuple[str, str]:
        """The ids of a word in decimal, and what they decode to: words and ids both end at whole characters."""
        back = self.decode(ids)
        return ",".join(map(str, ids)), w if back == w else back  # equal strings are kept once

    def merge_words(self, words: list[str]) -> Iterator[tuple[str, tuple[str, str]]]:
        """Results of distinct words; words of like length are merged in step, long ones alone."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            size = 1 << max(0, len(raw) - 2).bit_length()
            if size > STEP_SYMBOLS:
                yield w, self.result(w, merge_word([self.byte_id[b] for b in raw], self.rank_of, self.merged))
            else:
                by_size.setdefault(size, []).append((w, raw))
        for size, own in by_size.items():
            for at in range(0, len(own), STEP_ROWS):
                part = own[at:at + STEP_ROWS]
                n = np.array([len(raw) for _, raw in part])
                symbols = np.full((len(part), size + 1), -1, np.int64)
                symbols[np.arange(size + 1)[None, :] < n[:, None]] = self.byte_ids[np.frombuffer(b"".join([raw for _, raw in part]), np.uint8)]
                merge_rows(symbols, n, self.sorted_pairs, self.merged_ids)
                ends = np.cumsum((symbols >= 0).sum(axis=1)).tolist()
                flat = symbols[symbols >= 0].tolist()
                for (w, _), a, b in zip(part, [0, *ends], ends):
                    yield w, self.result(w, flat[a:b])

    def parts(self, texts: list[str]) -> Iterator[list[tuple[str, str]]]:
        """For each text the results of its words and added tokens, in order."""
        if len(self.cache) >= self.cache_words:
            self.old, self.cache = self.cache, {}
        pieces, long = [], {}
        for text in texts:
            own: list[str | int] = []
            for piece in self.split(text) if self.split else [text]:
                if piece in self.added:
                    own.append(self.added[piece])
                elif piece:
                    own += self.words(piece)
            pieces.append(own)
        cache = self.cache
        missing = {w for own in pieces for w in own if w not in cache}
        for i in [i for i in missing if isinstance(i, int)]:
            missing.remove(i)
            long[i] = str(i), self.decode([i])
        back = {w: self.old[w] for w in missing if w in self.old}
        cache |= back
        for w, out in self.merge_words([w for w in missing if w not in back]):
            if len(w) <= CACHE_WORD_CHARS:
                cache[w] = out
            else:
                long[w] = out
        for own in pieces:
            yield [cache.get(w) or long[w] for w in own]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _ in next(self.parts([text or ""])) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


def portions(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in runs of about PORTION_CHARS characters."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= PORTION_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


_CODECS: dict[int, Codec] = {}


def codec_of(shared) -> Codec:
    """One codec for each worker process and vocabulary."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(shared.value)
    return _CODECS[shared.id]


class SharedFile:
    """A broadcast with an id that tells vocabularies apart inside a worker."""

    def __init__(self, spark: SparkSession, path: str):
        text = open(path, encoding="utf-8").read()  # the tokenizer file is a parameter on the driver's disk, not an input table
        if len(text) > MAX_FILE_BYTES:
            raise ValueError(f"{path}: {len(text)} characters; a vocabulary file may have {MAX_FILE_BYTES}")
        self.id = hashlib.sha256(text.encode()).hexdigest()
        self._shared = spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self._shared.value


def encode_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``decoded`` (string) of every whole text."""
    shared = SharedFile(df.sparkSession, path)
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("ids", "decoded")]
                          + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        keep = [f.name for f in schema.fields[:-2]]
        for b in batches:
            ids, decoded = [], []
            for texts in portions(b.column(text_col)):
                for parts in codec.parts(texts):
                    ids.append([int(i) for p in parts for i in p[0].split(",")])
                    decoded.append(codec.decode(ids[-1]))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                names=[*keep, "ids", "decoded"])

    return df.mapInArrow(run, schema)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The other columns of ``df`` with the number of ids and digests of the ids and the decoded text; the ids
    themselves stay in the task."""
    shared = SharedFile(df.sparkSession, path)
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(DIGEST).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        sha = hashlib.sha256
        for b in batches:
            n, ids, decoded = [], [], []
            for texts in portions(b.column(text_col)):
                for parts in codec.parts(texts):
                    listed = ",".join([p[0] for p in parts])
                    n.append(listed.count(",") + 1 if parts else 0)
                    ids.append(sha(listed.encode()).hexdigest())
                    decoded.append(sha("".join([p[1] for p in parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, schema)


def op4(documents: DataFrame, path: str) -> DataFrame:
    """The contract's digest of every document."""
    return digest(documents.select("doc_id", "text"), path).select(
        F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
