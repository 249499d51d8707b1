"""The registered queries of the text operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedlab.llm.archives import read_archives, write_archives
from embedlab.llm.bpe import encode_decode
from embedlab.llm.collocations import collocations
from embedlab.llm.exact_dedup import exact_duplicates
from embedlab.llm.filter_audit import audit_filters
from embedlab.llm.language import identify_languages
from embedlab.llm.near_dedup import near_duplicates
from embedlab.llm.packing import pack_documents
from embedlab.llm.privacy import find_personal_data
from embedlab.llm.substring_dedup import remove_repeated_words
from embedlab.llm.suffix_dedup import remove_repeated_bytes
from embedlab.llm.topk import integer_vectors, top_products
from embedlab.llm.toxicity import score_toxicity
from embedlab.sources.tables import read_table


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_words(read_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(read_table(spark, folder, "documents"))


def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_bytes(read_table(spark, folder, "documents"), keep_first=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(read_table(spark, folder, "documents"))


def op6_top_products(spark: SparkSession, folder: str) -> DataFrame:
    vectors = integer_vectors(read_table(spark, folder, "embeddings"))
    return top_products(vectors, vectors.where(F.col("_id") % 100 == 0))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_decode(read_table(spark, folder, "documents"), outputs=False)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify_languages(read_table(spark, folder, "documents"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read_table(spark, folder, "documents")).drop("redacted")


def op10_web_archives(spark: SparkSession, folder: str) -> DataFrame:
    records = read_archives(write_archives(read_table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read_table(spark, folder, "documents"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels")).drop("restored")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_top_products": op6_top_products,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_personal_data": op9_personal_data,
    "op10_web_archives": op10_web_archives,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {
    "op2_exact_dedup": """
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM folded WINDOW same AS (PARTITION BY t)""",
    "op6_top_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, p.vec_id, list_dot_product(q.v, p.v)::BIGINT AS score
            FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER best)::INTEGER AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER best <= 10""",
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents WHERE text IS NOT NULL),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        grams AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m
            FROM w, unnest([1, 2, 3, 4]) AS k(m), unnest(range(1, len(w) - m + 2)) AS s(i)),
        f AS (SELECT lang, phrase, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
        cut AS (
            SELECT f.*, k, string_split(phrase, ' ') AS p FROM f, unnest([1, 2, 3]) AS c(k) WHERE m > k),
        score AS (
            SELECT c.lang, c.phrase, c.m, c.a, k, x.a AS l, y.a AS r,
                   ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
            FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
        covered AS (
            SELECT DISTINCT c.lang, c.phrase
            FROM f b, unnest([2, 3]) AS u(m2), unnest([1, 2, 3]) AS s(i), f c
            WHERE b.m > m2 AND i + m2 - 1 <= b.m AND c.lang = b.lang
              AND c.phrase = array_to_string(string_split(b.phrase, ' ')[i:i + m2 - 1], ' ')
              AND 100 * b.a::HUGEINT >= 80 * c.a)
        SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n, score
        FROM score ANTI JOIN covered USING (lang, phrase) JOIN totals USING (lang)
        WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
        QUALIFY row_number() OVER best <= 2000""",
    "op13_filter_audit": r"""
        WITH known AS (
            SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
            FROM labels GROUP BY doc_id),
        docs AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   coalesce(doc_id, 9223372036854775807) AS nr FROM documents),
        split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM docs),
        judged AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * (nr > min(nr) OVER (PARTITION BY t))::INT AS mask
            FROM split LEFT JOIN known USING (doc_id)),
        counts AS (SELECT part, mask, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
        letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
        orders AS (
            SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letter a JOIN letter b ON b.f <> a.f JOIN letter c ON c.f NOT IN (a.f, b.f)
            JOIN letter d ON d.f NOT IN (a.f, b.f, c.f) JOIN letter e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
        steps AS (
            SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS earlier
            FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s)),
        found AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN good AND mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN toxic AND mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT
                       AS toxic_lost
            FROM counts, steps GROUP BY ALL)
        SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found""",
}
