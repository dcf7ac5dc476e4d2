"""Vector codes, spelling variants and byte-level BPE by backtracking, each against a plain version."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute_codes import spelling as plain_spelling
from brute_codes import vector_codes as plain_codes
from pyspark.sql import types as T

from vigil.llm import byte_bpe, spelling, vector_codes
from vigil.llm.common import prepare

# ---------------------------------------------------------------- op11


def vectors(spark, rows):
    prepare(spark)
    schema = "vec_id long, embedding array<double>, label int, code string, error string, id string"
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(3)


def clustered(seed, n, dim, kinds=40, spread=0.02):
    r = np.random.default_rng(seed)
    centers = r.normal(0, 1, (kinds, dim))
    return (centers[r.integers(0, kinds, n)] + r.normal(0, spread, (n, dim))).tolist()


@pytest.mark.parametrize("dim,entries,block", [(16, 30, 64), (10, 8, 2048), (4, 256, 17)])
def test_codes_match_plain_version(spark, dim, entries, block):
    rows = [(i * 3, v) for i, v in enumerate(clustered(dim, 300, dim))]
    coded, books = vector_codes.compress(vectors(spark, [(i, v, i % 4) for i, v in rows]), entries=entries, block=block)
    want, want_books = plain_codes(rows, entries=entries)
    assert {r.id: (tuple(r.code), r.error) for r in coded.collect()} == want
    assert all((a == b).all() for a, b in zip(books, want_books))


def test_subtrees_are_assigned_whole():
    points = np.floor(np.array(clustered(1, 2000, 8, 10)) * 1024).astype(np.int64)
    tree = vector_codes.CoverTree.build(points)
    book = np.floor(np.array(clustered(1, 10, 8, 10, 0)) * 1024).astype(np.int64)
    code, count, total, exact = tree.assign(np.unique(book, axis=0))
    want = ((points[:, None] - np.unique(book, axis=0)[None]) ** 2).sum(-1).argmin(1)
    assert (code == want).all() and exact < 200 and count.sum() == 2000
    assert all((total[e] == points[want == e].sum(0)).all() for e in range(len(count)))
    for i in range(1, len(tree.center)):  # nodes cover their points; children lie apart at their parent's scale
        own = tree.place[tree.first[i]:tree.last[i]]
        assert np.sqrt(((points[own] - points[tree.center[i]]) ** 2).sum(1).max()) <= tree.radius[i] + 1e-6
    for p in np.unique(tree.parent[1:])[:50]:
        kids = points[tree.center[tree.parent == p]]
        d = np.sqrt(((kids[:, None] - kids[None]) ** 2).sum(-1)) + np.eye(len(kids)) * 1e9
        assert d.min() > tree.radius[p] / 2 - 1e-6


def test_codes_of_awkward_vectors(spark):
    good = [(1, [0.5, -0.5, 0.25, 0.0], 1), (2, [0.5, -0.5, 0.25, 0.0], None), (2, [0.0, 1.0, 2.0, 3.0], None), (None, [1e300, -1e300, 0.1, -0.001], 7)]
    bad = [(3, None, 1), (4, [0.1, None, 0.2, 0.3], 1), (5, [0.1, float("nan"), 0.2, 0.3], 1), (6, [float("inf"), 0.0, 0.2, 0.3], 1), (7, [], 1), (8, [1.0], 1)]
    rows = vector_codes.op11(vectors(spark, good + bad)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    assert {r.error for r in rows} == {0} and {r.label_error for r in rows} == {0} and all(len(r.code) == 8 for r in rows)
    assert len({r.codebooks_sha256 for r in rows}) == 1
    empty = vector_codes.op11(vectors(spark, bad[:1]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_label_errors_of_a_hot_label(spark):
    rows = [(i, v, 1 if i % 3 else None if i % 2 else 2) for i, v in enumerate(clustered(5, 400, 8, 300, 0.3))]
    out = vector_codes.op11(vectors(spark, rows)).collect()
    label = {i: lab for i, _, lab in rows}
    want = {}
    for r in out:
        want[label[r.vec_id]] = want.get(label[r.vec_id], 0) + r.error
    assert len(out) == 400 and all(r.label_error == want[label[r.vec_id]] for r in out) and any(want.values())


def test_distances_are_exact_beyond_floating_point():
    a = np.array([[2**27, -(2**27)], [2**27 - 1, 0]], np.int64)
    assert vector_codes.squared(a, a).tolist() == [[0, 1 + 2**54], [1 + 2**54, 0]]


# ---------------------------------------------------------------- op12

def misspelt(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(6, 8))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa"]
    out = []
    for i in range(n):
        own = []
        for w in r.choices(words, [2 ** (j % 7) for j in range(len(words))], k=40):
            if r.random() < 0.3:
                at = r.randint(0, len(w))
                w = r.choice([w[:at] + r.choice("abcéÿ") + w[at:], w[:at] + w[at + 1:], w[:at] + r.choice("abcd") + w[at + 1:]])
            own.append(r.choice([w, w, w.upper(), w.capitalize()]))
        out.append((i, r.choice([" ", ", ", "1", "\n"]).join(own)))
    return out


def words_frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, word string, n string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_plain_version(spark, seed):
    rows = [*misspelt(seed, 60), (900, None), (901, ""), (902, "short words a b"), (None, "abcabca " * 9), (3, "abcabca"), (3, "abcabca"), (904, "z" * 3000 + " " + ("z" * 3000 + " ") * 5)]
    want, pairs = plain_spelling(rows)
    got = spelling.op12(words_frame(spark, rows)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert len(got) == len(want) and any(v[0] for v in want.values())
    words = spark.createDataFrame([(w, v[2]) for w, v in want.items()], "word string, n long")
    listed = [(r.word, r.near) for r in spelling.neighbours(words).collect()]
    assert len(listed) == len(pairs) and set(listed) == pairs


def test_roots_follow_long_chains(spark):
    chain = ["abcdef" + "x" * i for i in range(9)]
    words = spark.createDataFrame([(w, 5 ** (i + 1)) for i, w in enumerate(chain)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.group_variants(words).collect()}
    assert got == {w: (chain[i + 1] if i < 8 else None, chain[8]) for i, w in enumerate(chain)}


def test_variants_of_an_empty_table(spark):
    assert spelling.op12(words_frame(spark, [(1, None)]).limit(0)).collect() == []


# ---------------------------------------------------------------- op13

PATH = str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(open(PATH, encoding="utf-8").read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank_of, special_tokens={})


def test_backtracking_gives_the_merges(ranks, library):
    r = random.Random(4)
    tokens = sorted(ranks.rank_of)
    texts = ["".join(r.choice("aaabbcdeèé 漢\n'st\x1c\u0085'RE123#") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += [b"".join(r.choices(tokens, k=r.randint(1, 5))).decode("utf-8", "replace").replace(" ", "") for _ in range(4000)]
    texts += ["a" * 20_000, "ab" * 10_000, "-=" * 5000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)), " " * 9000, "🙂\U0010ffff" * 50, ""]
    for t in texts:
        ids = ranks.encode(t)
        assert ids == library.encode_ordinary(t)
        assert ranks.decode(ids).decode() == t


def test_small_vocabularies_with_ties_and_dead_tokens():
    r = random.Random(5)
    held = refused = 0
    for _ in range(60):
        words = {bytes([b]): b for b in range(256)}
        pool = [b"a", b"b", b"c"]
        while len(words) < 280:
            t = r.choice(pool) + r.choice(pool)
            if t not in words:
                words[t] = len(words)
                pool.append(t)
        file = "\n".join(f"{base64.b64encode(t).decode()} {i}" for t, i in words.items())
        try:
            own = byte_bpe.Ranks(file, r"[\s\S]+")
        except ValueError:  # a token built from later ones
            refused += 1
            continue
        held += len(own.length) < len(words)
        library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=words, special_tokens={})
        for _ in range(60):
            t = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
            assert own.encode(t) == library.encode_ordinary(t)
    assert held and refused < 50


def test_digests_of_documents(spark, library):
    prepare(spark)
    texts = ["Grüße an alle", None, "", "x " * 3000, "  \n\t", "漢字かな", "Grüße an alle"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.StringType())])
    docs = spark.createDataFrame([(i // 2, t, "x", "y") for i, t in enumerate(texts)], schema).repartition(3)

    def sha(b):
        return hashlib.sha256(b).hexdigest()

    want = []
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((i // 2, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, byte_bpe.op13(docs, PATH, public_tokenizers.PATTERN).collect())) == sorted(want)
    full = byte_bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert all(r.decoded == (r.text or "") and r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == "y" for r in full)
    assert byte_bpe.op13(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
