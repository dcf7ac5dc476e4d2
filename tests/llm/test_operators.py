"""Each operator against a plain version on random and awkward texts."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from brute import components, contamination, fingerprint, repeats
from pii_brute import base_spans
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import bpe, chat, decontaminate, hamming_search, html_extract, pii, quality, sharding, simhash, substring_dedup
from vigil.llm.common import prepare

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("spans", T.StringType()), T.StructField("n_words", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows, schema=DOCS):
    prepare(spark)
    wide = [tuple(r) + ("x",) * (len(schema) - len(r)) for r in rows]
    return spark.createDataFrame(wide, schema).repartition(3)


def texts(seed, n=60):
    """Random texts with shared passages, copies, short and empty ones."""
    r = random.Random(seed)
    vocabulary = ["a", "bb", "Ccc", "d,", "é", "漢字", "x1", "Y-2", "the", "zz."] + [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    out = []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if r.random() < 0.5:
            at = r.randint(0, len(w))
            a = r.randint(0, 40)
            w[at:at] = passage[a:a + r.randint(10, 60)]
        if r.random() < 0.2:
            w += ["loop", "Loop"][:r.randint(1, 2)] * r.randint(5, 40)
        out.append(r.choice([" ", "\n", "\t ", "  "]).join(w))
        if r.random() < 0.2:
            out.append(r.choice(out))
    return out + ["", " \n\t", "one", "one two", None, "   x y"]


# ---------------------------------------------------------------- op1

@pytest.mark.parametrize("hot", [256, 2])
def test_repeats_match_plain_version(spark, hot):
    rows = list(enumerate(texts(1)))
    got = substring_dedup.remove_repeats(frame(spark, rows), hot=hot).collect()
    want = repeats(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want
    assert all(sum(s.n for s in r.removed) == r.n_removed for r in got)


@pytest.mark.parametrize("load", [0, 8])
def test_repeats_with_few_filter_bits_lose_nothing(spark, load):
    """Crowded bitmaps (load 0), and the joins that take their place beyond their size."""
    rows = list(enumerate(texts(2, 30)))
    got = substring_dedup.remove_repeats(frame(spark, [*rows, (1, rows[1][1])]), bits=7, hot=3, load=load).collect()
    assert {r.doc_id: r.n_removed for r in got} == {d: v[1] for d, v in repeats(rows).items()}


def test_repeats_of_equal_rows_null_ids_and_long_runs(spark):
    w = " ".join(f"k{i}" for i in range(30))
    rows = [(1, w), (1, w), (None, w), (5, "same " * 5000), (7, "p q " * 300), (9, w + " tail")]
    got = {}
    for r in substring_dedup.remove_repeats(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got == {1: [(30, 0), (30, 0)], None: [(30, 30)], 5: [(5000, 4999)], 7: [(600, 598)], 9: [(31, 30)]}


def test_automaton_finds_every_window():
    r = random.Random(3)
    for _ in range(50):
        seen, auto = set(), substring_dedup.SuffixAutomaton()
        for _ in range(4):
            w = [r.choice([b"a", b"b"]) for _ in range(r.randint(6, 40))]
            windows = [tuple(w[i:i + 6]) for i in range(len(w) - 5)]
            assert auto.matches(w, 6) == [x in seen for x in windows]
            auto.add(w)
            seen |= set(windows)


# ---------------------------------------------------------------- op3

@pytest.mark.parametrize("part_words", [1_000_000, 20])
def test_contamination_matches_plain_version(spark, part_words):
    docs = texts(4)
    r = random.Random(5)
    items = [(i, " ".join((r.choice(docs) or "x y").split()[:r.choice([0, 1, 5, 13, 14, 40])])) for i in range(12)] + [(12, None), (13, "loop Loop"), (21, "LOOP loop")]
    rows = list(enumerate(docs))
    found = decontaminate.contamination(frame(spark, rows), frame(spark, items, ITEMS), part_words=part_words, keep_text=False)
    got = {x.doc_id: (x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.contaminated) for x in found.collect()}
    assert got == contamination(rows, items)


def test_contamination_without_items_or_documents(spark):
    empty = frame(spark, [], ITEMS)
    got = decontaminate.op3(frame(spark, [(1, "a b"), (None, None)]), empty).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got) == [(0, 0, 0, 0, False), (1, 2, 0, 0, False)]
    assert decontaminate.op3(frame(spark, []), frame(spark, [(1, "a b")], ITEMS)).count() == 0


def test_items_without_an_id_hit_words_as_in_the_sql(spark):
    import duckdb

    from vigil.llm import oracle
    w = [f"k{i}" for i in range(40)]
    docs = [(1, " ".join(w[:20])), (2, "x " + " ".join(w[20:]) + " y"), (3, "none of it"), (4, None)]
    items = [(None, " ".join(w[:20])), (None, " ".join(w[2:22])), (7, " ".join(w[5:30])), (8, None)]
    got = decontaminate.op3(frame(spark, docs), frame(spark, items, ITEMS)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = con.execute(oracle.OP3).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got}[1] == (20, 2)


# ---------------------------------------------------------------- op4

def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return path, Tokenizer.from_file(path)


def test_codec_equals_library():
    path, lib = library()
    codec = bpe.Codec(open(path).read(), cache_words=500)
    r = random.Random(6)
    alphabet = [chr(c) for c in range(1, 0x250)] + list(" \n\t'aébst123!? 　 漢😀") * 20 + ["<|endoftext|>", "'ll", "​", "﻿"]
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["ab" * 20000, "\n" * 3000, "é" * 200, ""]
    want = lib.encode_batch(made, add_special_tokens=False)
    got = [[int(i) for p in parts for i in p[0].split(",")] for parts in codec.parts(made)]
    assert got == [w.ids for w in want]
    for w in want[:500]:
        assert codec.decode(w.ids) == lib.decode(w.ids, skip_special_tokens=False)
    for _ in range(500):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 12))]
        assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_merge_word_and_rows_agree_with_plain_merging():
    r = random.Random(7)
    for _ in range(300):
        pairs = {}
        merged = []
        for _ in range(r.randint(1, 40)):
            key = r.randrange(12) << 32 | r.randrange(12)
            if key not in pairs:
                pairs[key] = len(merged)
                merged.append(r.randrange(12))
        word = [r.randrange(12) for _ in range(r.randint(1, 17))]
        plain = list(word)
        for _ in range(len(word)):
            ranks = [(pairs[a << 32 | b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 32 | b in pairs]
            if not ranks:
                break
            rank, i = min(ranks)
            plain[i:i + 2] = [merged[rank]]
        assert bpe.merge_word(word, pairs, merged) == plain
        symbols = np.full((1, 17), -1)
        symbols[0, :len(word)] = word
        table = np.array(sorted(pairs.items())).T.copy()
        bpe.merge_rows(symbols, np.array([len(word)]), table, np.array(merged))
        assert [s for s in symbols[0].tolist() if s >= 0] == plain


def test_encode_decode_frames(spark):
    path, lib = library()
    docs = [t or "" for t in texts(8, 20)] + ["<|endoftext|>x<|endoftext|>"]
    rows = [*enumerate(docs), (None, None)]
    got = bpe.encode_decode(frame(spark, rows), path).collect()
    assert all(r.ids == lib.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "") for r in got)
    for r in bpe.op4(frame(spark, rows), path).collect():
        ids = lib.encode(docs[r.doc_id] if r.doc_id is not None else "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert bpe.op4(frame(spark, []), path).count() == 0


# ---------------------------------------------------------------- op5

def test_fingerprints_and_components_match_plain_version(spark):
    r = random.Random(9)
    docs = texts(10, 40)
    long = " ".join(r.choice("abcdefgh") + str(r.randrange(99)) for _ in range(400))
    for i in range(60):  # near copies: a word changed at a time, a chain of small steps
        w = long.split()
        w[r.randrange(len(w))] = "changed"
        docs.append(" ".join(w))
        if i % 3 == 0:
            long = docs[-1]
    rows = list(enumerate(docs))
    fps = {d: fingerprint(t) for d, t in rows}
    want = components(fps)
    got = simhash.near_duplicates(frame(spark, [*rows, (3, docs[3]), (None, "a b c")])).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got if x.doc_id is not None} == {d: (f"{fps[d]:016x}", want[d]) for d, _ in rows}
    assert len(got) == len(rows) + 2
    assert [x.component_id for x in got if x.doc_id is None] == [None]
    kept = simhash.first_of_each(frame(spark, [*rows, (0, docs[0]), (None, "a b c"), (None, "d")]))
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 2


def test_a_repeated_id_does_not_take_its_other_texts_along(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (2, b), (2, a), (3, b), (5, a.upper()), (5, "a text of its own that is like none"), (6, None), (7, "")]
    kept = simhash.first_of_each(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.text or "") for x in kept) == [(1, a), (2, b), (5, rows[5][1]), (6, "")]
    assert all(x.score == "x" for x in kept)
    again = simhash.first_of_each(frame(spark, [(1, a), (1, a), (1, a.upper()), (None, a), (None, a)])).collect()
    assert sorted((x.doc_id or 0) for x in again) == [0, 1]


@pytest.mark.parametrize("bits,tile", [(2, 2048), (2, 8), (1, 16), (3, 2048)])
def test_links_join_all_within_radius(spark, bits, tile):
    r = random.Random(11)
    prepare(spark)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(30):
            for _ in range(r.randint(1, 4)):
                b ^= 1 << r.randrange(64)
            fps.add(b)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(rows, "fp long"), bits, tile)
    root = {x.node: x.root for x in simhash.components(links).collect()}
    want = components({f: f % (1 << 64) for (f,) in rows}, bits)
    parts = {}
    for (f,) in rows:
        parts.setdefault(root.get(f, f), set()).add(f)
    plain = {}
    for f, c in want.items():
        plain.setdefault(c, set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, plain.values()))
    assert all(bin((x.a ^ x.b) % (1 << 64)).count("1") <= bits for x in links.collect())


def test_near_duplicates_of_nothing(spark):
    assert simhash.op5(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- op6

@pytest.mark.parametrize("n,range_rows", [(3000, 4_000_000), (3000, 20), (5, 4_000_000), (0, 10)])
def test_shards_are_balanced_and_gapless(spark, n, range_rows):
    r = random.Random(12)
    hot = "hot " * 40
    rows = [(i, hot if i % 3 == 0 else "x" * r.randint(0, 300)) for i in range(n)] + ([(None, None), (1, hot)] if n else [])
    df = frame(spark, rows).withColumn("shard_", F.lit(1))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    out = sharding.histogram_shards(df, text=F.col("text"), doc_id=F.col("doc_id"), size=size, n_shards=8, range_rows=range_rows).collect()
    assert len(out) == len(rows)
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append((x.slot, len(x.text or "") + 16))
    for slots in by.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
    if n > 100:
        sizes = [sum(b for _, b in v) for v in by.values()]
        assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * 316 + 2 * 0.001 * sum(sizes)


@pytest.mark.parametrize("equal", [0.3, 1.0])
@pytest.mark.parametrize("range_rows", [4_000_000, 50])
def test_equal_rows_are_cut_among_shards(spark, equal, range_rows):
    r = random.Random(21)
    n = 3000
    rows = [(7, "same row " * 5) if i < equal * n else (i, "x" * r.randint(0, 90)) for i in range(n)] + [(None, None)] * 500
    df = frame(spark, rows).repartition(7).withColumn("__note", F.lit("kept"))
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    out = sharding.histogram_shards(df, text=F.col("text"), doc_id=F.col("doc_id"), size=size, n_shards=8, range_rows=range_rows).collect()
    assert sorted(str((x.doc_id, x.text)) for x in out) == sorted(str(x) for x in rows) and {x["__note"] for x in out} == {"kept"}
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append((x.slot, len(x.text or "") + 16))
    for slots in by.values():
        assert sorted(s for s, _ in slots) == list(range(len(slots)))
    sizes = [sum(b for _, b in v) for v in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 2 * 106 + 2 * 0.001 * sum(sizes)


def test_shard_query_columns(spark):
    rows = [(1, "é"), (2, None), (3, "")]
    got = {r.doc_id: r for r in sharding.op6(frame(spark, rows)).collect()}
    assert [got[i].size for i in (1, 2, 3)] == [18, 16, 16]
    assert got[1].text_crc32 == zlib.crc32("é".encode()) and got[2].text_crc32 == 0
    assert {r.law for r in got.values()} == {"bytes"} and {r.grown_shard for r in got.values()} == {None}


# ---------------------------------------------------------------- op7

@pytest.mark.parametrize("bits,n,k", [(64, 400, 10), (12, 300, 10), (64, 4, 10)])
def test_top_k_is_exact_with_ties_and_hot_codes(spark, bits, n, k):
    prepare(spark)
    r = random.Random(13)
    rows = [(i, 5 if i % 3 == 0 else r.getrandbits(bits - 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, (0, rows[0][1]), (None, 1), (7000, None)], "vec_id long, code long")
    asked = df.where(F.col("vec_id") % 20 == 0)
    got = hamming_search.top_k(df, asked, id_col="vec_id", code_col="code", k=k, bits=bits).collect()
    want = []
    for q, c in rows:
        if q % 20 == 0:
            near = sorted((bin(c ^ d).count("1"), i) for i, d in rows)[:k]
            want += [(q, j + 1, i, dist) for j, (dist, i) in enumerate(near)]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_sign_codes(spark):
    rows = spark.createDataFrame([([0.5, -1.0, 0.0, 2.0],), ([1.0],), (None,), ([1.0, None, 1.0, 1.0],)], "v array<float>")
    assert [r[0] for r in rows.select(hamming_search.sign_code("v", 4)).collect()] == [9, None, None, None]


# ---------------------------------------------------------------- op9

def test_classifier_learns_form_and_keeps_folds(spark):
    r = random.Random(14)
    good = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(80)) + "."
    bad = lambda: " ".join(r.choice("ABCDE") * r.randint(2, 6) + "!!" for _ in range(80))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(600)] + [(700, None), (701, "")]
    labels = [(i, 0 if i % 5 == 0 else 1) for i in range(0, 600, 2)] + [(2, 1), (4, None), (None, 1)]
    got = quality.op9(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert np.mean([x.predicted == (x.doc_id % 5 != 0) for x in got if x.doc_id < 600 and x.held_out]) > 0.95


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.op9(frame(spark, [(1, "a"), (None, None)]), none).collect()
    assert [x.score for x in got] == [0.5, 0.5] and quality.op9(frame(spark, []), none).count() == 0
    ones = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(x.predicted == 1 for x in quality.op9(frame(spark, [(1, "a"), (2, "b")]), ones).collect())


def test_non_negative_risk_goes_back_when_negative():
    r = np.random.default_rng(15)
    p = np.column_stack([r.normal(2, 1, 200), np.ones(200)])
    u = np.column_stack([np.concatenate([r.normal(2, 1, 300), r.normal(-2, 1, 300)]), np.ones(600)])
    w = quality.nn_pu(quality.Moments.of(p), quality.Moments.of(u), 0.5)
    assert (p @ w > 0).mean() > 0.9 and (u[300:] @ w < 0).mean() > 0.9 and np.isfinite(w).all()


def test_unlabelled_rows_teach_what_labelled_negatives_do_not_show():
    """Label shift: labelled negatives are of one kind, the corpus holds another. A fit on labels alone keeps that other kind;
    the risk over the unlabelled rows rejects it."""
    r = np.random.default_rng(16)

    def around(x, y, n):
        return np.column_stack([r.normal(x, 0.3, n), r.normal(y, 0.3, n), np.ones(n)])

    good, shown, hidden = around(2, 0, 400), around(-2, 0, 400), around(2, 4, 400)
    known, label = np.vstack([good, shown]), np.repeat([1.0, 0.0], 400)
    plain = np.zeros(3)
    for _ in range(2000):
        plain += 0.05 * known.T @ (label - quality.sigmoid(known @ plain)) / len(known)
    assert (hidden @ plain > 0).mean() > 0.9
    u = np.vstack([around(2, 0, 400), around(-2, 0, 300), around(2, 4, 300)])
    w = quality.nn_pu(quality.Moments.of(good), quality.Moments.of(u), 0.4)
    assert (hidden @ w < 0).mean() > 0.9 and (shown @ w < 0).mean() > 0.9 and (good @ w > 0).mean() > 0.9


def test_moments_cover_every_row_that_is_not_held_out(spark):
    rows = list(enumerate(texts(17)))
    got = quality.unlabelled_moments(frame(spark, rows))
    free = np.array([quality.features(t) for d, t in rows if zlib.crc32(str(d).encode()) % 5])
    assert got.n == len(free) and np.allclose(got.mean, free.mean(axis=0), atol=1e-3) and np.allclose(got.products, free.T @ free / len(free), atol=5e-3)
    words = "20240101-abc 12345678x 99999999 --------é"
    assert quality.features(words)[quality.N_CLASSES + 9] == 0.25  # a word is judged whole


# ---------------------------------------------------------------- op10

def test_base_spans_match_plain_version(spark):
    r = random.Random(16)
    alphabet = "0123456789.+-() @aB_é\n255😀:"
    made = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 100))) for _ in range(1500)]
    made += [None, "", "9" * 20000, "a" * 50000, "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.3", "a@b.c@d.e a@b.c_x@d.e", "+1 (988) 555-2485x", "4111 1111 1111 1111"]
    rows = list(enumerate(made))
    got = pii.op10(frame(spark, rows)).collect()
    for x in got:
        want = base_spans(made[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), made[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone")]


def test_added_kinds_need_checksum_or_context(spark):
    rows = [(0, "pay to IBAN DE89 3704 0044 0532 0130 00 THE END"), (1, "DE89 3704 0044 0532 0130 01 is wrong"),
            (2, "card 378282246310005"), (3, "number 378282246310005"), (4, "call (988) 555-1234"), (5, "see 988-555-1234"),
            (6, "SSN 123-45-6789"), (7, "part 123-45-6789"), (8, "ssn 000-45-6789")]
    got = {x.doc_id: x.spans for x in pii.op10(frame(spark, rows)).collect()}
    assert got == {0: "iban:12:39", 1: "", 2: "card_short:5:20", 3: "", 4: "phone_local:5:19", 5: "", 6: "ssn:4:15", 7: "", 8: ""}


def test_redaction_keeps_other_columns(spark):
    rows = [(0, "é mail a@b.cd, call +1 (988) 555-2485 now"), (1, None), (2, "clean"), (None, "1.2.3.4")]
    df = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    got = {x.doc_id: x for x in pii.redacted_documents(df).collect()}
    assert got[0].text == "é mail <EMAIL>, call <PHONE> now" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "clean" and got[None].text == "<IP>" and got[2].spans == "x"
    assert pii.redacted_documents(df).columns == df.columns


def test_a_text_full_of_spans_takes_linear_time(spark):
    """A hundred thousand addresses in one text: lists and lookups that start anew for each span would take many minutes."""
    n = 100_000
    text = " é ".join(f"10.{i % 200}.0.7" for i in range(n))
    prepare(spark)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    row = pii.op10(df).collect()[0]
    assert row.n_ip == n and row.base_sha256 == hashlib.sha256(",".join(base_spans(text)).encode()).hexdigest()
    assert pii.redacted_documents(df).collect()[0].text == " é ".join(["<IP>"] * n)
    assert time.time() - start < 60


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 700])
def test_redaction_across_blocks(spark, n):
    r = random.Random(n)
    text = "é" * r.randint(0, 9000) + "".join(" a@b.cd" + "x🙂 "[:r.randint(0, 3)] * r.randint(0, 40) for _ in range(n)) + "z" * r.randint(0, 5000)
    got = pii.redacted_documents(frame(spark, [(1, text)])).collect()[0].text
    spans = [tuple(map(int, s.split(":")[1:])) for s in base_spans(text)]
    want, at = [], 0
    for a, z in spans:
        want += [text[at:a], "<EMAIL>"]
        at = z
    assert len(spans) == n and got == "".join(want) + text[at:]


# ---------------------------------------------------------------- op8

def test_quotes_are_linked_and_removed(spark):
    prepare(spark)
    rows = [
        (1, 0, "user", "How do I sort?\nIt must be stable."), (1, 1, "assistant", "Use sorted().\r\nIt is stable."),
        (1, 2, "user", "> Use sorted().\n>> how do I SORT\nThanks"), (1, 3, "user", "> It must be  stable\nAnother thought"),
        (1, 4, "assistant", "> nobody said this\nOk"), (1, 2, "user", "> Use sorted().\n>> how do I SORT\nThanks"),
        (2, 5000, "user", None), (2, 1, "", "It is stable."), (2, 9000, "user", "> it is stable"), (None, 1, "user", "x"), (3, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): (x.position, x.text, x.quoted, x.linked, x.parent_turn) for x in chat.linked_messages(df).collect()}
    assert got == {
        (1, 0): (0, "How do I sort?\nIt must be stable.", 0, 0, None), (1, 1): (1, "Use sorted().\nIt is stable.", 0, 0, 0),
        (1, 2): (2, "Thanks", 2, 2, 1), (1, 3): (3, "Another thought", 1, 1, 0), (1, 4): (4, "Ok", 1, 0, 3),
        (2, 1): (0, "It is stable.", 0, 0, None), (2, 5000): (1, "", 0, 0, 1), (2, 9000): (2, "", 1, 1, 1)}
    chats = {(x.conv_id, x.segment): x for x in chat.chats(df, segment=2).collect()}
    assert chats[1, 1].chat == "<|user|>\nThanks\n<|user|>\nAnother thought" and chats[1, 1].n_linked == 2 and (1, 2) in chats
    assert chat.chats(df.limit(0)).count() == 0


def reply_order(parent, sizes):
    """Depth first, replies by turn: first position of every turn."""
    out, at, todo = {}, 0, [min(parent)]
    while todo:
        t = todo.pop()
        out[t], at = at, at + sizes[t]
        todo += sorted((k for k, p in parent.items() if p == t), reverse=True)
    return out


def test_replies_stand_under_what_they_answer(spark):
    prepare(spark)
    rnd, rows, parent = random.Random(5), [], {}
    for t in range(40):  # conversation 1: quotes of any earlier message
        parent[t * 700] = None if t == 0 else rnd.choice([t - 1, rnd.randrange(t)]) * 700
        quote = "" if t == 0 or parent[t * 700] == (t - 1) * 700 else f"> point {parent[t * 700] // 700} of it\n"
        rows.append((1, t * 700, "user", f"{quote}point {t} of it"))
    rows.append((1, 7 * 700, "zz", "second message of a turn"))
    rows += [(2, t, "user", f"m{t}" if t < 8 else "> m2\nm8" if t == 8 else "> m7\nm9") for t in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn, x.role): (x.position, x.parent_turn) for x in chat.linked_messages(df).collect()}
    want = reply_order(parent, {t: 1 + (t == 7 * 700) for t in parent})
    assert {t: got[1, t, "user"] for t in parent} == {t: (want[t], parent[t]) for t in parent}
    assert got[1, 7 * 700, "zz"][0] == want[7 * 700] + 1
    assert [x.chat for x in chat.op8(df.where("conv_id = 2")).collect()] == ["\n".join(f"<|user|>\nm{t}" for t in (0, 1, 2, 3, 4, 5, 6, 7, 9, 8))]


def test_passages_are_linked_before_lines(spark):
    prepare(spark)
    said = "A long remark that goes\nover two lines.\n\nThen a second part\nof it."
    rows = [(1, 0, "user", said), (1, 1, "user", "Yes\nI agree with this"), (1, 2, "user", "Yes"), (1, 3, "user", "No"),
            (1, 4, "user", "> A long remark\n> that goes over two\n> lines.\nre-wrapped paragraph"),
            (1, 5, "user", "> A long remark that goes over\n> two lines.\n>\n> Then a second part of it.\nre-wrapped message"),
            (1, 6, "user", "> Yes\n> I agree with this\npassage"), (1, 7, "user", "> Yes\nline")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.turn: (x.quoted, x.linked, x.parent_turn) for x in chat.linked_messages(df).collect() if x.turn > 3}
    assert got == {4: (3, 3, 0), 5: (3, 3, 0), 6: (2, 2, 1), 7: (1, 1, 2)}


# ---------------------------------------------------------------- op2

def page(i, article, **kw):
    return (i, kw.get("url", f"https://a.example/{i}"),
            f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p><article>no</article>";</script></head><body>'
            f'<header>Site</header><nav><ul><li><a href="/">x{i}<li>y</ul></nav><div class="cookie-notice">We use cookies</div>'
            f'<div class="ad">buy {i}</div>{article}<aside>side {i}</aside><section id="comments"><p>nice {i}</section><form>f<input></form>'
            f'<footer>&copy; {i}</footer></body></html>')


def test_article_text_without_boilerplate(spark):
    prepare(spark)
    body = "<article><h1>T {0}</h1><p>A&amp;B &lt;{0}&gt;\n  c<b>d</b><br>e<p>Next {0}<div class='share'>tweet</div><ul><li>i{0}<li>j{0}</ul><table><tr><td>k{0}<td>c{0}</table></article>"
    rows = [page(i, body.format(i)) for i in range(12)] + [(90, None, None), (91, "nohost", ""), (92, "https://b.example/", "<p>lone <i>page</i><p>two")]
    got = {r.page_id: r for r in html_extract.op2(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"T {i}\n\nA&B <{i}> cd e\n\nNext {i}\n\ni{i}\n\nj{i}\n\nk{i}\n\nc{i}"
        assert got[i].n_chars == len(got[i].text)
    assert got[90].text == "" and got[91].text == "" and got[92].text == "lone page\n\ntwo"


def test_template_without_article_markup(spark):
    prepare(spark)
    rows = [(i, "https://c.example/x", f"<body><div><p>Welcome to our site</p></div><div><h2>Story {i * 7}</h2><p>{'word%d ' % i * 30}</p></div><div><p>All rights</p></div></body>")
            for i in range(12)]
    got = html_extract.op2(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Story {r.page_id * 7}\n\n{('word%d ' % r.page_id * 30).strip()}" for r in got)


def test_names_of_boilerplate():
    parts = "".join(f"<div {a}>gone</div>" for a in ('class="commentlist"', "id=siteFooter", "class='x top-nav'", 'role="alert"', 'class="advertbox"', 'class="reader-comments"'))
    kept = "".join(f"<div {a}>kept</div>" for a in ('class="commentary"', 'class="shadow"', 'id="lead"', 'hidden'))
    assert html_extract.Reference("").extract(f"<article><p>a{parts}{kept}</article>") == "a\n\nkept\n\nkept\n\nkept\n\nkept"


def test_elements_that_hold_the_page_are_no_boilerplate():
    extract = html_extract.Reference("").extract
    boiler = "<nav>menu</nav><div class='related'><p>other story</div><div id='comments'><p>a comment that is longer than the text</div><footer>f</footer>"
    for a in ("<div class='layout has-sidebar'>{}</div>", "<div id='search-result-page'>{}</div>", "<form id='aspnetForm'>{}</form>"):
        assert extract("<body>" + a.format("<article><p>story</article>" + boiler) + "</body>") == "story"
        assert extract("<body><nav>menu</nav>" + a.format("<h1>title of it</h1><p>a story that is told without article markup") + "</body>") == (
            "title of it\n\na story that is told without article markup")
    cards = "<div class='related'><article>card</article></div><section id='comments'><article>a comment, longer than all else on the page</article></section>"
    assert extract(f"<body><article><p>story</article>{cards}</body>") == "story"
    assert extract(f"<body><div><p>a story without markup</div>{cards}</body>") == "a story without markup"


def test_ends_of_deep_elements_end_themselves():
    extract = html_extract.Reference("").extract
    deep = "<div>" * 70 + "in<nav>menu</nav><div class=ad>buy</div>" + "</div>" * 70
    assert extract(f"<body><div><article><p>one</p>{deep}<p>two</p></article></div></body>") == "one\n\nin\n\ntwo"
    far = "<div>" * 50_000 + "in" + "</div>" * 50_000
    assert html_extract.Reference(far).extract(f"{far}<p>out") == "in\n\nout"


def test_broken_and_deep_markup():
    deep = "<div>" * 5000 + "in" + "</div>" * 4000
    assert html_extract.Reference("").extract(deep) == "in"
    assert html_extract.Reference("").extract("a < b <p title=\"x>y\">c</p></div></p><p>d<!-- no --> e<![CDATA[f]]><script>x") == "a < b\n\nc\n\nd ef"
    assert html_extract.Reference("").extract("<" * 3000) == "<" * 3000
