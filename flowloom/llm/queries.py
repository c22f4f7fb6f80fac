"""The registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import decontam, divergence, html, jaccard, licences, media, mixing, quality, tokens, toxicity, urls, warc, whitening
from flowloom.llm.common import table

#: The chain's order. The table of ratings has one toxicity category; the quality rating goes before it, as "unfit".
CATEGORIES = ["unfit", "toxic"]
TOKENIZER = "piece_bpe_32k.model"


def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").withColumn("unfit", 1 - F.col("quality"))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.OrdinalModel:
    return quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def toxicity_chain(spark: SparkSession, sf_dir: str) -> list[toxicity.Link]:
    return toxicity.train(table(spark, sf_dir, "documents"), category_labels(spark, sf_dir), CATEGORIES)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade_documents(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    found = decontam.match_phrases(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir), CATEGORIES)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.evaluated_pages(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mixed).withColumnRenamed("id", "doc_id")


def op8_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.scan(docs, licences.train(docs))
    return found.withColumn("families", F.array_join("families", ",")).drop("hits")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.link_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.components_of(whitening.whiten(vectors, model), model)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_token_counts": op3_token_counts,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_url_filters": op6_url_filters,
    "op7_mixing": op7_mixing,
    "op8_licence_scans": op8_licence_scans,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_media_columns": op10_media_columns,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_warc": op13_warc,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Occurrences by comparing the next ten words at each position with all test phrases.
OP4_SQL = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, w[s:s + 9] AS phrase, len(w[s:s + 9]) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
ahead AS (SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM words),
hits AS (SELECT DISTINCT rid, pos, p.n, item FROM (SELECT rid, pos, n, l[1:n] AS phrase FROM ahead, (SELECT DISTINCT n FROM p) WHERE len(l) >= n) a JOIN p USING (phrase)),
n_hits AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + n)) AS x FROM hits) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n_hits USING (rid) LEFT JOIN items USING (rid)"""

#: Links by counting the shared shingles of all pairs that share one.
OP9_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d WHERE len(w) >= 5),
ahead AS (SELECT rid, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM words),
sh AS (SELECT DISTINCT rid, array_to_string(l, ' ') AS s FROM ahead WHERE len(l) = 5 UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
links AS (SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.rid < y.rid GROUP BY ALL) JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b
 WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT rid AS node, rid AS other FROM d UNION SELECT node, b FROM r JOIN e ON a = other),
low AS (SELECT node, min(doc_id) AS component_id FROM r JOIN d ON rid = other GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (rid) JOIN low ON node = rid"""

#: Five hexadecimal digits of the digest are four base32 ones.
OP13_SQL = """WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT rid, page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS n, sha1(payload) AS h FROM p),
b AS (SELECT rid, page_id, n, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
 CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) AS INTEGER), 1)), '') AS digest FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY page_id NULLS LAST, rid) AS k, first_value(page_id) OVER (PARTITION BY digest ORDER BY page_id NULLS LAST, rid) AS first FROM b)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM r"""

ORACLE_SQL: dict[str, str] = {
    "op12_source_divergence": divergence.SQL,
    "op13_warc": OP13_SQL,
    "op4_benchmark_decontamination": OP4_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
    "op6_url_filters": urls.SQL,
}
