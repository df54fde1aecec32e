"""Fertility, alignment and code compression against brute-force versions, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pathloom.llm import alignment, codebooks, fertility, queries
from pathloom.llm.vocabularies import Vocabularies

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
LETTERS = "ab \n\r\t\xa0　▁é日🙂's,.1{})\x85\x1c"
ODD = [
    None, "", "a", " ", "   \n", "  lead", "trail  ", "▁x", "<|endoftext|> <s></s><unk><0x0A>", "don't  we'll", "日本語 テスト", "\x00 a", "}\r\n {\r", "x\r  ", "the and of " * 30, "the and of " * 30, "é " * 4000, "x" * 9000,
]


@pytest.fixture(scope="module")
def work():
    return Vocabularies(A, B)


def docs_of(spark, texts, langs=None):
    rows = [(k if k != 3 else None, t, langs[k] if langs else "en", "spare") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, links string")


def plain_ids(work, text):
    """Ids by the libraries' plain calls; None where the text has no tokens."""
    if not text:
        return None
    a, b = work.a.encode(" " + text, add_special_tokens=False).ids, work.b.encode(text)
    data = (" " + text).encode()
    same = b"".join(work.a_bytes[i] for i in a) == data == b"".join(work.b_bytes[i] for i in b)
    return (a, b) if same else None


def test_runs_give_the_ids_of_whole_texts(work):
    rnd = random.Random(7)
    texts = [*ODD, *("".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, 14))) for _ in range(3000))]
    for chunk in (3, 50_000):
        got = {}
        for k, a, b in work.texts(texts, chunk):
            old = got.get(k, ([], []))
            got[k] = None if a is None else (old[0] + a.tolist(), old[1] + b.tolist())
        assert [got.get(k) for k in range(len(texts))] == [plain_ids(work, t) for t in texts]
    assert len(work.recent) <= work.half + 50_000


def spans(ids, names):
    end, out = 0, []
    for i in ids:
        out.append((i, end, end + len(names[i])))
        end += len(names[i])
    return out


def aligned_by_hand(work, texts):
    groups, links = {}, {}
    for k, text in enumerate(texts):
        ids = plain_ids(work, text)
        if ids is None:
            groups[k], links[k] = None, []
            continue
        a, b = spans(ids[0], work.a_bytes), spans(ids[1], work.b_bytes)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        parts = [([x for x in a if lo < x[2] <= hi], [y for y in b if lo < y[2] <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        groups[k] = ";".join(",".join(str(x[0]) for x in p) + "|" + ",".join(str(y[0]) for y in q) for p, q in parts)
        links[k] = [(x[0], y[0]) for p, q in parts for x in p for y in q if max(x[1], y[1]) < min(x[2], y[2])]
    return groups, links


@pytest.mark.parametrize("block_links", [40, 1 << 20])
def test_alignment_by_hand(spark, work, monkeypatch, block_links):
    rnd = random.Random(3)
    texts = [*ODD[:14], "the and of " * 30, *(" ".join(rnd.choice(["unhappiness", "tokenization", "日本", "the", "éte", "12345", "{}"]) for _ in range(rnd.randint(1, 40))) for _ in range(40))]
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block_links)
    found = alignment.alignments(spark, docs_of(spark, texts).repartition(3), A, B).collect()
    groups, links = aligned_by_hand(work, texts)
    counts = Counter(x for some in links.values() for x in some)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert len(found) == len(texts)
    for r in found:
        k = 3 if r["id"] is None else r["id"]
        ids, own = plain_ids(work, texts[k]), links[k]
        want = (len(ids[0]), len(ids[1]), groups[k].count(";") + 1, hashlib.sha256(groups[k].encode()).hexdigest()) if ids else (0, 0, 0, "")
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) == want
        assert (r["n_links"], r["count_sum"], r["n_best"]) == (len(own), sum(counts[x] for x in own), sum(counts[x] == best[x[1]] for x in own))


def test_alignment_of_a_text_of_many_parts_and_of_none(spark, work, monkeypatch):
    monkeypatch.setattr(alignment, "PART_RUNS", 7)
    monkeypatch.setattr(alignment, "PART_TOKENS", 20)
    text = "unhappiness, éte 12345 \n" * 30
    row = alignment.alignments(spark, docs_of(spark, [text]), A, B).collect()[0]
    groups, links = aligned_by_hand(work, [text])
    counts = Counter(links[0])
    assert row["groups_sha256"] == hashlib.sha256(groups[0].encode()).hexdigest()
    assert (row["n_links"], row["count_sum"]) == (len(links[0]), sum(n * n for n in counts.values()))
    assert alignment.alignments(spark, docs_of(spark, []), A, B).count() == 0
    assert [r["n_links"] for r in alignment.alignments(spark, docs_of(spark, [None, ""]), A, B).collect()] == [0, 0]


def test_base_counts_by_hand():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a ", "b ", "c\n", "#", " ", "d\t", "\n", " "]) for _ in range(rnd.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        lines = text.split("\n")
        repeated = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
        assert fertility.base_counts(text) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


def test_fertility_measures_by_hand(spark, work):
    texts = [*ODD, "Some plain words of prose, and more of them. " * 4]
    for r in fertility.measure(docs_of(spark, texts).withColumn("entropy", F.lit("old")), A, B).collect():
        k = 3 if r["doc_id"] is None else r["doc_id"]
        ids = plain_ids(work, texts[k])
        assert (r["entropy"] is None) == (ids is None)
        if ids:
            n = len(ids[1])
            share = np.array(list(Counter(ids[1]).values())) / n
            assert r["chars_per_token"] == pytest.approx(len(texts[k]) / len(ids[0]))
            assert r["chars_per_piece"] == pytest.approx(len(texts[k]) / n)
            assert r["byte_share"] == pytest.approx(sum(work.b.is_byte(i) for i in ids[1]) / n)
            assert r["entropy"] == pytest.approx(-(share * np.log2(share)).sum() / np.log2(min(n, 1024)) if n > 1 else 1.0)


def test_scripts():
    assert [fertility.script_of(x) for x in ("", "12 !", "abc", "naïve ж", "жук a", "日本語", "テスト", "한국", "ab жж", "\U00020000")] == [None, None, "Latin", "Latin", "Cyrillic", "Han", "Kana", "Hangul", "Cyrillic", "Han"]


def test_junk_goes_and_prose_of_each_language_stays(spark, small):
    rnd = random.Random(11)
    prose = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("lang = 'en'").select("text").collect() if len(r["text"].split()) >= 60]
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    junk = [" ".join(word("0123456789abcdef+/=Q%Z$") for _ in range(80)), " ".join(word("\U00010400\U00010401\U00012000\U00013000") for _ in range(80)), " ".join("zq" + "q" * k for k in range(80))]
    good = fertility.filter_quality(spark, docs_of(spark, [*prose, *junk]), A, B).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    kept = {r["doc_id"]: r["kept"] for r in good}
    assert [kept[len(prose) + k] for k in range(len(junk))] == [False] * len(junk)
    assert all(kept[r["doc_id"]] or r["base_failed"] for r in good if r["doc_id"] is None or r["doc_id"] < len(prose))


def test_fertility_odd_rows(spark):
    df = docs_of(spark, ODD, [None] * len(ODD)).withColumn("kept", F.lit(True)).withColumn("n_words", F.lit("x"))
    found = fertility.filter_quality(spark, df, A, B).collect()
    assert len(found) == len(ODD)
    assert not any(r["kept"] for r in found if r["n_words"] < 50)
    assert fertility.filter_quality(spark, docs_of(spark, []), A, B).count() == 0
    few = fertility.filter_quality(spark, docs_of(spark, ["A few different words make this text long enough, as every one stands alone: " + " ".join(f"word{k}" for k in range(60))]), A, B, lang_col=None)
    assert [r["kept"] for r in few.collect()] == [True]  # a group without bands of its own


def test_many_groups_by_salted_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"g{k % 3}") for k in range(60)], "id long, _group string")
    groups = spark.createDataFrame([(f"g{k}", k) for k in range(2)], "_group string, n long")
    want = sorted(map(tuple, fertility._with_groups(rows, groups, "left").select("id", "_group", "n").collect()), key=str)
    monkeypatch.setattr(fertility, "BROADCAST_LANGUAGES", 0)
    assert sorted(map(tuple, fertility._with_groups(rows, groups, "left").select("id", "_group", "n").collect()), key=str) == want


def plain_lloyd(x, entries=codebooks.ENTRIES, rounds=codebooks.ROUNDS):
    """Codes, errors and codebooks of whole vectors in the order of their ids."""
    n, d = x.shape
    parts = [x[:, p * d // 4 : (p + 1) * d // 4].astype(object) for p in range(4)]
    codes, errors, books = [], np.zeros(n, object), []
    for part in parts:
        book = part[:entries].copy()
        for r in range(rounds + 1):
            dist = np.stack([((part - e) ** 2).sum(axis=1) for e in book])
            who = np.array([min(range(len(book)), key=lambda k: (dist[k, i], k)) for i in range(n)])
            if r < rounds:
                for k in range(len(book)):
                    if (who == k).any():
                        book[k] = part[who == k].sum(axis=0) // int((who == k).sum())
        errors += dist[who, np.arange(n)]
        codes.append(who)
        books.append(book)
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(n)], errors, ",".join(str(v) for b in books for e in b for v in e)


@pytest.mark.parametrize("scale", [1.0, 200.0])
def test_codes_against_plain_lloyd(spark, monkeypatch, scale):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8))
    v = ((centres[rng.integers(0, 40, 900)] + rng.normal(size=(900, 8)) * 0.2) * scale).astype(np.float32)
    v[100:400] = v[99]  # a third of all rows
    rows = [(int(i), v[i].tolist(), None if i % 5 == 0 else int(i % 3)) for i in range(len(v))]
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 128)
    monkeypatch.setattr(codebooks, "SCAN_ROWS", 64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["id"]: r for r in codebooks.compress(spark, df).collect()}
    codes, errors, book = plain_lloyd(np.floor(1024 * v.astype(np.float64)).astype(np.int64))
    by_label = Counter()
    for i, (_, _, label) in enumerate(rows):
        by_label[label] += errors[i]
    sha = hashlib.sha256(book.encode()).hexdigest()
    assert len(got) == len(rows)
    for i, (_, _, label) in enumerate(rows):
        assert (got[i]["code"], got[i]["error"], got[i]["label_error"], got[i]["codebooks_sha256"]) == (codes[i], errors[i], by_label[label], sha)
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 0)
    assert {r["id"]: r["label_error"] for r in codebooks.compress(spark, df).collect()} == {i: r["label_error"] for i, r in got.items()}


def test_heaps_pop_few_parts(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(64, 16)) * 10
    v = centres[rng.integers(0, 64, 4000)] + rng.normal(size=(4000, 16)) * 0.01
    df = spark.createDataFrame([(int(i), x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    _, blocks = codebooks.fit(spark, df, entries=64)
    assert blocks.agg(F.sum("popped")).first()[0] < 0.5 * 4 * 4000  # of the last assignment


def test_code_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<float>, label int, code string"
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1, "x"), (1, [1.0, 2.0, 3.0, 4.0], 1, "x"), (2, None, 1, "x"), (3, [1.0, None, 3.0, 4.0], 1, "x"), (4, [nan, 0.0, 0.0, 0.0], 1, "x"), (5, [inf, 0.0, 0.0, 0.0], 1, "x"), (None, [-1.0, 0.0, 0.0, 0.5], None, "x")]
    found = codebooks.compress(spark, spark.createDataFrame(rows, kind)).collect()
    assert sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in found) == [("1", "00000000", 0, 0), ("1", "00000000", 0, 0), ("None", "02020202", 0, 0)]
    assert codebooks.compress(spark, spark.createDataFrame([], kind)).count() == 0
    assert codebooks.compress(spark, spark.createDataFrame(rows[2:6], kind)).count() == 0
    for bad in ([1.0, 2.0, 3.0], [1.0] * 8, [1e9] * 4):
        with pytest.raises(Exception):  # noqa: B017  Spark's or the library's, by where the row is met
            codebooks.compress(spark, spark.createDataFrame([rows[0], (0, bad, 1, "x")], kind)).collect()


def test_queries_of_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    assert queries.op11_fertility(spark, small).count() == docs == queries.op12_alignment(spark, small).count()
    assert queries.op13_heap_lloyd(spark, small).count() == spark.read.parquet(f"{small}/embeddings.parquet").count()
