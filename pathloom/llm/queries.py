"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, codebooks, decontaminate, fertility, languages, licenses, secrets, simhash, tokenids, topk, urls, warc
from .common import new_folder, table

# The rules of the URL query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def language_model(docs: DataFrame) -> languages.LanguageModel:
    """Fitted on the documents that are not held out."""
    return languages.fit(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = languages.identify(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "ids")
    tokenids.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, _tokenizer("word_bpe_49k.json"))
    return tokenids.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.join_spans(F.col("spans"), secrets.KINDS[:3])
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("novel"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.join_spans(F.col("spans")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.pmod("vec_id", F.lit(50)) == 0))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer("byte_bpe_50k.tiktoken"), _pattern()
    found = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = fertility.filter_quality(spark, docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", *fertility.BASE, "base_failed", "kept", *fertility.MEASURES)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.alignments(spark, docs, _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict:
    own = (op1_language_id, op2_token_ids, op3_secrets, op4_decontamination, op5_licenses, op6_url_filter, op7_top_k, op8_simhash, op9_warc, op10_bpe, op11_fertility, op12_alignment, op13_heap_lloyd)
    return {f.__name__: f for f in own}


def _lloyd_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Plain Lloyd's algorithm, round by round: an assignment and a codebook for each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT x.p, x.n, min(list_sum(list_transform(list_zip(x.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + c.k) AS m
            FROM x JOIN c{r} c ON x.p = c.p GROUP BY x.p, x.n)""")
        if r < rounds:
            steps.append(f"""u{r} AS MATERIALIZED (SELECT p, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS e FROM
                (SELECT x.p, a.m % 256 AS k, j, CAST(sum(x.e[j]) AS DOUBLE) AS s, count(*) AS n FROM x JOIN a{r} a ON x.p = a.p AND x.n = a.n, unnest(range(1, len(x.e) + 1)) AS t(j) GROUP BY 1, 2, 3) GROUP BY p, k),
            c{r + 1} AS MATERIALIZED (SELECT c.p, c.k, coalesce(u.e, c.e) AS e FROM c{r} c LEFT JOIN u{r} u ON c.p = u.p AND c.k = u.k)""")
    last = f"a{rounds}"
    return f"""
            WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
            w AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS n, len(e) // 4 AS d FROM v),
            x AS MATERIALIZED (SELECT CAST(p AS BIGINT) AS p, n, e[p * d + 1 : (p + 1) * d] AS e FROM w, unnest(range(4)) AS t(p)),
            c0 AS MATERIALIZED (SELECT p, n AS k, e FROM x WHERE n < 256),
            {", ".join(steps)},
            book AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS h FROM c{rounds}),
            code AS (SELECT n, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM {last} GROUP BY n)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256 FROM w JOIN code USING (n)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL expresses; the others are tested against brute-force versions."""
    return {
        "op6_url_filter": """
            WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
            parts AS (SELECT page_id,
                coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM cut),
            rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
            fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                FROM (SELECT DISTINCT * FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
            SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
        "op7_top_k": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
            s AS (SELECT q.vec_id AS query_id, q.e AS own, r.vec_id, CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
                FROM q JOIN v r ON q.vec_id <> r.vec_id)
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) <= 5""",
        "op13_heap_lloyd": _lloyd_sql(),
    }
