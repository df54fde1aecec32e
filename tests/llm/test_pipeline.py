"""The pipeline's stages, each judged on its own input."""

from __future__ import annotations

import random
import tempfile

import corpus_pipeline
from pathloom.llm import bpe, secrets

from .test_operators import alike_by_hand, base_by_hand


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "", None, None, 0), (-3, "1234 5678", "en", "s", 9), (-4, 'token = "abcdefghijklmnop1234"', "en", "s", 30)], docs.schema)
    before = {r["doc_id"]: r for r in docs.collect()}
    columns, rows, now = docs.columns, before, docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).checkpoint()
        assert now.columns == columns, name
        got = {r["doc_id"]: r for r in now.collect()}
        assert len(got) == now.count()
        if name == "language":
            assert not {-1, -2, -3} & set(got) and len(got) >= 0.98 * len(before)
        elif name == "near_dedup":
            ids = sorted(rows)
            want = {ids[c] for c in alike_by_hand([rows[i]["text"] for i in ids])}
            assert want <= set(got) and len(got) <= len(want) + 1 and len(want) < len(ids)
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            gone = {i for i, r in rows.items() if any(x in r["text"] for x in items)}
            assert gone and not gone & set(got) and len(rows) - len(got) <= len(gone) + 3
        else:
            assert set(got) == set(rows)
            for i, r in rows.items():
                assert (got[i]["text"] == r["text"]) == (not base_by_hand(r["text"]) and not secrets.novel_spans(r["text"], []))
                assert got[i]["n_chars"] == len(got[i]["text"])
        rows = got
    last = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r["doc_id"] for r in last} == set(rows) and all(r["round_trip"] for r in last)
    assert bpe.encode(now, corpus_pipeline.queries._tokenizer("byte_bpe_50k.tiktoken"), corpus_pipeline.queries._pattern()).count() == len(rows)


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60))
    a, b, c, d, e, item = (text() for _ in range(6))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, a), (2, d), (3, e), (3, e)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema), "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (None, b), (None, c), (2, d), (3, e)], key=str)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(None, f"{a} {item}"), (None, b), (4, f"{item} {c}"), (4, d), (5, None)]
    clean = corpus_pipeline.decontamination(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema), folder).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in clean), key=str) == sorted([(None, b), (4, d), (5, None)], key=str)


def test_stages_of_odd_tables(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone long, H long, clean string, spans string"
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, text, "en", None, 9, 1, 1, "c", "s"), (1, text, "en", None, 9, 1, 1, "c", "s"), (None, text + " now", None, None, None, None, None, None, None), (2, None, "en", "s", 7, 2, 2, "c", "s"), (3, "", None, "s", 0, 3, 3, "c", "s"), (4, f"{text} " * 20_000, "en", "s", 1, 4, 4, "c", "s")]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        kept[name] = sorted((str(r["doc_id"]) for r in out.collect()))
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert kept == {"language": ["1", "1", "4", "None"], "near_dedup": ["1", "2", "4"], "decontamination": ["1", "1", "2", "3", "4", "None"], "secret_scan": ["1", "1", "2", "3", "4", "None"]}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(last) == len(rows) and all(r["round_trip"] for r in last)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
