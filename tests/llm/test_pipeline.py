"""The pipeline stage by stage, and the queries that need no SQL form."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as driver

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def good(k):
    return " ".join(f"w{k}x{j}" for j in range(40))


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(k, good(k), "en", f"s{k % 2}", len(good(k))) for k in range(20)]
    rows += [(100, good(3), "en", "s1", 1), (101, good(4) + " more", "en", "s0", 1), (102, "too short", "en", "s0", 9), (103, "again " * 60, "en", "s0", 360), (104, f'{good(104)} token = "{key}"', "en", "s0", 1), (105, None, "en", None, None), (None, good(200), None, None, 3)]
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SMALL).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return rows, [[r.asDict() for r in df.collect()] for df in out], out


def ids(rows):
    return sorted(str(r["doc_id"]) for r in rows)


def test_stages(staged):
    rows, found, frames = staged
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "secret scan", "mixing", "bpe encoding"]
    assert all(df.columns == COLUMNS for df in frames[:5])
    assert ids(found[1]) == sorted([*map(str, range(20)), "100", "101", "104", "None"])
    assert ids(found[2]) == sorted([*map(str, range(20)), "104", "None"])
    redacted = {r["doc_id"]: r for r in found[3]}
    assert redacted[104]["text"] == f'{good(104)} token = "[REDACTED]"' and redacted[104]["n_chars"] == len(redacted[104]["text"])
    assert all(redacted[k]["text"] == good(k) for k in range(20)) and ids(found[3]) == ids(found[2])
    assert set(ids(found[4])) == set(ids(found[3])) and len(found[4]) <= 2 * len(found[3])
    texts = {r["doc_id"]: r["text"] for r in found[4]}
    for r in found[5]:
        own = np.array(LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids, "<u4").tobytes()
        assert bytes(r["ids"]) == own and r["ids_sha256"] == hashlib.sha256(own).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_whole_run_and_queries(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0 < driver.queries()["pipeline"](spark, SMALL).select("doc_id").distinct().count() <= n
    names = sorted((q for q in driver.queries() if q.startswith("op")), key=lambda q: int(q[2:].split("_")[0]))
    assert [int(q[2:].split("_")[0]) for q in names] == list(range(1, 11))
    columns = {q: driver.queries()[q](spark, SMALL).columns for q in names}
    assert columns[names[0]] == ["page_id", "url", "text", "n_chars"] and columns[names[9]] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert driver.queries()[names[5]](spark, SMALL).agg(F.sum("n_findings")).first()[0] >= 0


def test_one_document_of_each_group_of_copies(spark):
    row = lambda i, k, lang="en": (i, good(k), lang, "s", len(good(k)))
    rows = [row(3, 1), row(7, 1), row(7, 2), *[row(8, 3)] * 3, row(9, 3), row(None, 4), row(None, 4), row(None, 4, "de"), row(None, 5), row(4, 5), row(8, 6), (8, good(6) + " more", "en", "s", 1), (10, "", "en", "s", 0), (10, "", "en", "s", 0)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    found = sorted((str(r.doc_id), (r.text or "").split(" ")[0]) for r in got.collect())
    assert got.columns == COLUMNS and found == sorted([("3", "w1x0"), ("7", "w2x0"), ("8", "w3x0"), ("None", "w4x0"), ("4", "w5x0"), ("8", "w6x0"), ("10", ""), ("10", "")])


def test_quality_stage_removes_boilerplate_lines(spark):
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    own = {k: " ".join(f"w{name(k)}x{name(j)}" for j in range(40)) for k in range(30)}
    rows = [(k, f"All rights reserved\n{t}", "en", "s", 1) for k, t in own.items()] + [(50, own[2], "en", "s", 7)]
    got = corpus_pipeline.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SMALL)
    assert got.columns == COLUMNS and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {k: (t, len(t)) for k, t in own.items()} | {50: (own[2], 7)}


def test_checkpoints_are_few_files_whatever_the_shuffle(spark, tmp_path):
    near = [(k, good(k // 4) + f" more{k}", "en", f"s{k % 2}", 1) for k in range(60)]
    docs = spark.createDataFrame([(k, f"All rights reserved\n{text}", *rest) for k, text, *rest in near], "doc_id long, text string, lang string, source string, n_chars long")
    parts = 30
    own = {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    folder = spark.sparkContext._jsc.sc().getCheckpointDir
    before = folder().get() if folder().isDefined() else None
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        files = {}
        for name, stage in corpus_pipeline.STAGES[:2]:
            spark.sparkContext.setCheckpointDir(str(tmp_path / name))
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema).coalesce(4)
            files[name] = len(list((tmp_path / name).rglob("part-*")))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
        if before:
            spark.sparkContext.setCheckpointDir(before)
    assert {r.doc_id for r in docs.collect()} == {4 * k for k in range(15)}
    # only signatures are as many files as the documents' parts; all others are one here
    assert files["quality rules"] < parts and files["near dedup"] < 2 * parts
