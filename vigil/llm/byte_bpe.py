"""Byte-level BPE by backtracking over longest matches.

The bytes of a word are mapped to Latin-1, one character a byte, so that an Aho-Corasick automaton of the
vocabulary (pyahocorasick) finds the longest token at every place. A word is then cut from the left: the longest
token that may stand beside the token before it is taken, shorter ones (its longest prefixes in the vocabulary)
are tried next, and if none fits the token before it is taken back. A place that was given up is never entered
again, so the work is linear in the word. Two tokens may stand side by side if no merge across their border would
have come before the merges that built them; this is found by undoing their merges, the latest first, and kept
in a table of pairs. The ids are those of the merges in order of rank.

The vocabulary file (ranks) is read once on the driver and broadcast; its size is checked and does not grow with
the corpus. Results of words are kept in two generations of up to CACHE_WORDS each, the table of pairs in one of up
to PAIRS.

Defined cases: null is the empty text (no ids); a word of any length is cut whole; characters that the pattern
skips have no ids; a token that its own merges cannot build stands only for a word equal to it; a vocabulary
whose ranks are not in the order of its merges is refused; other columns pass
unchanged, an input column named as one of the results is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigil.llm.bpe import SharedFile, portions

CACHE_WORDS = 150_000     # words in each of two generations
CACHE_WORD_CHARS = 64     # longer words are not kept
PAIRS = 1 << 20           # answers kept about adjacent tokens


class Ranks:
    """A vocabulary of byte strings with ranks: encoder and decoder."""

    def __init__(self, file_text: str, pattern: str, cache_words: int = CACHE_WORDS):
        self.rank_of = {base64.b64decode(a): int(r) for a, r in map(str.split, file_text.splitlines() if file_text else [])}
        if any(bytes([b]) not in self.rank_of for b in range(256)):
            raise ValueError("the vocabulary must hold all 256 bytes")
        self.token = {r: t for t, r in self.rank_of.items()}
        words = regex.compile(pattern)
        self.words = words.findall if not words.groups else lambda text: [m[0] for m in words.finditer(text)]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._learn()
        self.cache: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}
        self.cache_words = cache_words

    def _learn(self) -> None:
        """The two halves whose merge makes each token, and the tokens that merges can make at all."""
        built: dict[bytes, int] = {}
        for rank, token in sorted(self.token.items()):
            if len(token) == 1:
                self.halves[rank] = rank, rank
                built[token] = rank
        for rank, token in sorted(self.token.items()):
            for cut in range(len(token) - 1, 0, -1):
                a, b = built.get(token[:cut]), built.get(token[cut:])
                if a is not None and b is not None and self._apart(a, b):
                    self.halves[rank], self.joined[a, b] = (a, b), rank
                    built[token] = rank
                    break
            else:
                if len(token) > 1 and len(self._merged(token)) == 1:
                    raise ValueError(f"token {rank} is merged from tokens of higher rank: backtracking needs ranks in the order of merges")
        self.pairs.clear()
        self.length = {r: len(t) for t, r in built.items()}
        self.shorter = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in built.items():
            self.shorter[rank] = next((built[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in built), None)
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()

    def _merged(self, word: bytes) -> list[bytes]:
        """A word merged step by step; only for the few tokens that earlier ones do not build."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, i = min((self.rank_of.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 62:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` and ``b`` side by side never join across the border: the merges are undone, the
        latest first (of equal ones the right one, as merges run from the left), and a merge across the border must
        not come before the one undone last."""
        limit = 1 << 62
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, self.halves[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.halves[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.halves[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.halves[a][1]
                    if a == limit:
                        return True

    def _fits(self, a: int, b: int) -> bool:
        fits = self.pairs.get((a, b))
        if fits is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            fits = self.pairs[a, b] = self._apart(a, b)
        return fits

    def cut(self, word: bytes) -> list[int]:
        """The ids of one word."""
        whole = self.rank_of.get(word)
        if whole is not None:
            return [whole]
        n, length, shorter, fits = len(word), self.length, self.shorter, self._fits
        longest = [0] * n
        for end, rank in self.automaton.iter(word.decode("latin-1")):  # ends ascend, so the longest of a start comes last
            longest[end + 1 - length[rank]] = rank
        usable = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if usable[end] and (not out or fits(out[-1], token)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
            elif shorter[token] is not None:
                token = shorter[token]
            else:
                usable[at] = 0
                token = out.pop()
                at -= length[token]

    def result(self, word: str) -> tuple[str, int, bytes]:
        """Ids of a word in decimal, their number, and the bytes they decode to."""
        out = self.old.get(word)
        if out is None:
            ids = self.cut(word.encode())
            out = ",".join(map(str, ids)), len(ids), self.decode(ids)
        if len(word) <= CACHE_WORD_CHARS:
            self.cache[word] = out
        return out

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        """Results of the words of a text, in order."""
        if len(self.cache) >= self.cache_words:
            self.old, self.cache = self.cache, {}
        known, new = self.cache.get, self.result
        return [known(w) or new(w) for w in self.words(text) if w]

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text or "") for i in ids.split(",")]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


_RANKS: dict[tuple[str, str], Ranks] = {}


def ranks_of(shared: SharedFile, pattern: str) -> Ranks:
    """One vocabulary for each worker process."""
    key = shared.id, pattern
    if key not in _RANKS:
        _RANKS.clear()
        _RANKS[key] = Ranks(shared.value, pattern)
    return _RANKS[key]


def _mapped(df: DataFrame, path: str, pattern: str, text_col: str, keep: list[str], added: str, row) -> DataFrame:
    """``keep`` and the columns ``added``, which ``row(ranks, parts)`` makes of each text."""
    shared = SharedFile(df.sparkSession, path)
    new = T._parse_datatype_string(added).fields
    schema = T.StructType([df.schema[c] for c in keep] + new)
    types = [pa.list_(pa.int32()) if isinstance(f.dataType, T.ArrayType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(shared, pattern)
        for b in batches:
            rows = [row(ranks, ranks.parts(t)) for texts in portions(b.column(text_col)) for t in texts]
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(cols, types)],
                                             names=[*keep, *(f.name for f in new)])

    return df.mapInArrow(run, schema)


def encode_decode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (array of int) and ``decoded`` (string) of every whole text."""
    def row(ranks: Ranks, parts: list) -> tuple:
        ids = [int(i) for p in parts for i in p[0].split(",")]
        return ids, ranks.decode(ids).decode("utf-8", "replace")

    return _mapped(df, path, pattern, text_col, [c for c in df.columns if c not in ("ids", "decoded")], "ids array<int>, decoded string", row)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The other columns of ``df`` with the number of ids and the digests of ids and decoded bytes; the ids
    themselves stay in the task."""
    def row(_: Ranks, parts: list) -> tuple:
        return (sum([p[1] for p in parts]), hashlib.sha256(",".join([p[0] for p in parts]).encode()).hexdigest(),
                hashlib.sha256(b"".join([p[2] for p in parts])).hexdigest())

    keep = [c for c in df.columns if c not in (text_col, "n_tokens", "ids_sha256", "decoded_sha256")]
    return _mapped(df, path, pattern, text_col, keep, DIGEST, row)


def op13(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digest of every document."""
    return digest(documents.select("doc_id", "text"), path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
