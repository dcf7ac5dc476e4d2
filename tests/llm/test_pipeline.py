"""The pipeline and the registered queries on the driver's small tables, against plain versions."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from brute import components, contamination, fingerprint
from pii_brute import base_spans
from pyspark.sql import functions as F

import corpus_pipeline
from vigil.llm import quality
from vigil.llm.common import table
from vigil.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_pipeline_equals_plain_stages(spark, docs, items):
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = {d: t for d, t in docs.items() if model.score(quality.features(t)[None])[0] >= quality.THRESHOLD}
    groups = components({d: fingerprint(t) for d, t in kept.items()})
    kept = {d: t for d, t in kept.items() if groups[d] == d}
    dirty = contamination(list(kept.items()), items)
    kept = {d: t for d, t in kept.items() if not dirty[d][4]}
    want, lib = {}, tokenizer()
    for d, t in kept.items():
        spans = sorted((int(a), int(z), k) for k, a, z in (s.split(":") for s in base_spans(t)))
        out, at = [], 0
        for a, z, k in spans:
            if a >= at:
                out += [t[at:a], f"<{k.upper()}>"]
            at = max(at, z)
        want[d] = lib.encode("".join(out) + t[at:], add_special_tokens=False).ids
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {d: r.ids for d, r in got.items()} == want
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in got.values())


def test_stages_keep_columns_and_take_empty_tables(spark):
    d = table(spark, SF, "documents").withColumn("score", F.lit("s")).withColumn("pii", F.lit(1)).withColumn("items", F.lit(2)).withColumn("a.b", F.lit(3))
    for name, stage in corpus_pipeline.STAGES:
        for frame in (d, d.limit(0)):
            out = stage(spark, frame, SF)
            n = out.count()
            assert n <= frame.count() and (n > 0) == (frame is d), name
            if name != "tokens":
                assert out.columns == d.columns, name


def test_queries_without_sql(spark, docs):
    lib = tokenizer()
    for r in QUERIES["op4_bpe_codec"](spark, SF).collect():
        ids = lib.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    fps = {d: fingerprint(t) for d, t in docs.items()}
    want = components(fps)
    got = QUERIES["op5_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", want[d]) for d in docs}
    for r in QUERIES["op10_pii"](spark, SF).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(base_spans(docs[r.doc_id])).encode()).hexdigest()
        assert r.spans == ",".join(base_spans(docs[r.doc_id]))  # these texts hold no added kinds
    rows = QUERIES["op6_histogram_sharding"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in docs.items()}
    assert {r.shard for r in rows} <= set(range(40)) and len({(r.shard, r.slot) for r in rows}) == len(docs)
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(40)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


def test_extracted_text_is_the_article(spark):
    html = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    import html as entities
    for r in QUERIES["op2_html_extraction"](spark, SF).collect():
        article = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [r for r in QUERIES["op9_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97 and len(held) > 300
