"""The registered queries over whole tables, and the pipeline against a plain version."""

import glob
import hashlib
import os
import zlib

import numpy as np
import pytest

from tessella.llm import packing, quality_rules, queries, simhash, subword_classifier, toxicity_cnn
from tessella.llm.common import labelled_sample
from tests.llm.data import SF, awkward, frame
from tests.llm.test_storage_and_dedup import brute_removal
from tests.llm.test_near_copies import brute_least
from tests.llm.test_text_operators import brute_components

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
MEDIUM = "/root/testdata/sf0.1"


def texts(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    sql = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(sql.columns)
    assert sorted(map(tuple, df.select(*sql.columns).collect())) == sorted(map(tuple, sql.fetchall()))


@pytest.mark.parametrize("name, label, module, modulus, remainder", [("op3_quality_classifier", "quality", subword_classifier, 5, 0), ("op9_toxicity", "toxic", toxicity_cnn, 4, 2)])
def test_held_out_accuracy(spark, name, label, module, modulus, remainder):
    sf = MEDIUM if os.path.isdir(MEDIUM) else SF
    found = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    assert set(found) == set(texts(spark, sf))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % modulus == remainder) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in found.items())
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(found[i].score, y) for i, y in labels.items() if i in found and found[i].held_out]
    score, y = np.array([x for x, _ in held]), np.array([c for _, c in held])
    hits, alarms, ranked = (score >= 0.3)[y == 1].mean(), (score >= 0.3)[y == 0].mean(), auc(score, y)
    # a constant has an AUC of 0.5, and hits as often as it alarms
    assert ranked > 0.95 and hits > 0.8 and alarms < 0.1


def auc(score, y):
    """How often a text of class 1 scores above one of class 0 (a tie is half)."""
    pos, neg = np.sort(score[y == 1]), np.sort(score[y == 0])
    above = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
    return above.mean() / 2 / len(neg)


def test_constant_fails():
    y = np.array([0] * 80 + [1] * 14)
    assert auc(np.zeros(94), y) == 0.5


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = labelled_sample(docs, labels, "quality", 5, 0, 7)
    assert len(sample) <= 14 and sample == labelled_sample(docs, labels, "quality", 5, 0, 7)
    held = {texts(spark)[r.doc_id] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    other = {texts(spark)[r.doc_id] for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 0}
    assert not {t for t, _ in sample} & (held - other)


def test_op5_and_op6_against_plain_versions(spark):
    t = texts(spark)
    ids = sorted(t)
    prints = [simhash.fingerprint(t[i].encode(), 4) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, brute_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.queries()["op5_simhash"](spark, SF).collect()} == want
    removed = dict(zip(ids, brute_removal([t[i].encode() for i in ids]), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op6_suffix_dedup"](spark, SF).collect()}
    assert got == removed


def test_op7_and_op8(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in queries.queries()["op7_warc_zip"](spark, SF).collect()}
    assert got == {i: (len(b), hashlib.sha256(b).hexdigest()) for i, b in pages.items()}
    media = queries.queries()["op8_media_chunks"](spark, SF).collect()
    assert {r.doc_id: r.n_bytes for r in media} == {i: len(x.encode()) for i, x in texts(spark).items()}


def brute_pipeline(spark, sf):
    """The documents' texts as they should stand before packing, by doc_id."""
    judge = quality_rules.evaluator(quality_rules.QualityRules())
    docs = {i: quality_rules.clean_text(x) for i, x in texts(spark, sf).items() if judge(x.encode())[8]}
    rows = spark.createDataFrame([(i, x) for i, x in docs.items()], "doc_id long, text string")
    net = toxicity_cnn.train(labelled_sample(rows, spark.read.parquet(f"{sf}/labels.parquet"), "toxic", 4, 2, toxicity_cnn.MAX_PER_CLASS))
    run = net.scorer()
    docs = {i: x for i, x in docs.items() if run([x.encode()])[0] < 0.3}
    ids = sorted(docs)
    group = brute_least([docs[i] for i in ids])  # a stage's rule: five words, similarity 0.8
    docs = {i: docs[i] for k, i in enumerate(ids) if group[k] == k}
    ids, out, raw = sorted(docs), {}, [docs[i].encode() for i in sorted(docs)]
    count: dict = {}
    for b in raw:
        for k in range(len(b) - 199):
            count[b[k : k + 200]] = count.get(b[k : k + 200], 0) + 1
    for i, b in zip(ids, raw, strict=True):
        hit = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit[k : k + 200] = b"\1" * 200
        out[i] = bytes(c for c, h in zip(b, hit, strict=True) if not h).decode("utf-8", "ignore")
    return out


def test_pipeline(spark, path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "repeated_passages", "packing"]
    want = brute_pipeline(spark, SF)
    enc = packing.encoder(path("byte_bpe_50k.json"))
    got: dict = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    ids = {i: enc(x) + [1] for i, x in want.items()}
    assert {i: sorted(p) for i, p in got.items()} == {
        i: [(s, len(x[s : s + 2048]), zlib.crc32(np.array(x[s : s + 2048], "<u4").tobytes())) for s in range(0, len(x), 2048)] for i, x in ids.items()
    }


def test_stages_on_odd_tables(spark):
    import corpus_pipeline

    rows = awkward()
    docs = frame(spark, rows, ("kept", "score", "fp", "spans"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            if name != "packing":
                assert out.columns == table.columns
            n = out.count()
            assert n <= len(rows) or name == "packing"
            if name == "repeated_passages":
                assert n == table.count()


def test_sample_is_bounded(spark):
    """One document id on all rows, and long texts, give no more than one bounded text."""
    from pyspark.sql import functions as F

    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.union(spark.range(3).select(F.col("id") + 100, F.repeat(F.lit("x"), 200_000)))
    labels = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).alias("toxic"))
    labels = labels.union(spark.range(3).select(F.col("id") + 100, F.lit(0)))
    for _ in range(2):
        got = labelled_sample(docs, labels, "toxic", 4, 9, 5)
        assert len(got) == 1 and got[0][1] == 1 and got[0][0].startswith("text ")


def test_folders_are_forgotten(spark):
    from tessella.llm import common

    df = common.written(spark.range(3), "three")
    assert df.count() == 3 and common.forget(spark) >= 1 and not common._made


def test_quality_stage_removes_failing_lines(spark):
    import corpus_pipeline

    good = [" ".join(f"word{i}x{j}" for j in range(15)) + "." for i in range(8)]
    lines = [good[0], "Home | News | About", *good[1:4], "Tous droits réservés.", "no end", good[1], "", *good[4:]]
    rows = [(1, "\n".join(lines), "en", "s", 5), (2, "\n".join(good), "en", "s", 5), (3, "too short.", "en", "s", 5), (4, None, None, None, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.quality(spark, frame(spark, rows, ("kept",)), SF).collect()}
    clean = "\n".join([good[0], *good[1:4], "", *good[4:]])
    assert got == {1: (clean, len(clean)), 2: (rows[1][1], len(rows[1][1]))}
