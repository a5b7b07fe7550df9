"""The numbered corpus queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_pairs import decode, encode
from .decontaminate import find_leaks
from .divergence import divergence
from .line_quality import line_quality
from .licenses import scan_licenses
from .mixing import TARGETS, mix_to_targets, quality_domains
from .ngram_join import ngram_join
from .prefix_trie import prefix_trie
from .quality import quality_scores
from .secrets import scan_secrets
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity_scores


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
                      (F.size("spans") > 0).alias("has_repeats"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mix_to_targets(docs, quality_domains(docs, _table(spark, sf_dir, "labels")), TARGETS)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op12_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_secret_scan": op10_secret_scan,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_prefix_trie": op13_prefix_trie,
}

# The same rows by brute force: all pairs of texts that share a shingle, and all strings of 400 bytes.
JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
e AS (SELECT r, len(g) AS n, unnest(g) AS h FROM s), p AS (SELECT a.r AS x, b.r AS y, a.n AS m, b.n AS n, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.r <> b.r GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (m + n - c)), c AS (SELECT r, r AS other FROM s UNION SELECT c.r, l.y FROM c JOIN l ON l.x = c.other), k AS (SELECT c.r, min(s.doc_id) AS component_id FROM c JOIN s ON s.r = c.other GROUP BY 1),
n AS (SELECT x AS r, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM s JOIN k USING (r) LEFT JOIN n USING (r)"""
REPEATS_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(to_hex(encode(coalesce(text, '')))) AS x FROM documents), b AS (SELECT r, doc_id, x, length(x) // 2 AS n FROM d),
w AS (SELECT r, unnest(range(0, n - 399)) AS i, x FROM b WHERE n >= 400), h AS (SELECT r, i, md5(substring(x, 2 * i + 1, 800)) AS h FROM w), t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
m AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM h JOIN t USING (h)), g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM m),
v AS (SELECT r, k, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY ALL), q AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, string_agg(a || '-' || z, ',' ORDER BY a) AS shown FROM v GROUP BY 1),
o AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM v), y AS (SELECT o.r, string_agg(substring(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(x), 2 * max(z) + 1) AS kept FROM o JOIN b USING (r) GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(kept, x))) AS kept_sha256, removed IS NOT NULL AS has_repeats, coalesce(shown, '') AS spans FROM b LEFT JOIN q USING (r) LEFT JOIN y USING (r)"""
# Terms kept by 30 documents of a language; shares in 128-bit integers.
DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d), k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM g) LEFT JOIN k USING (lang) GROUP BY lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p FROM s JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (max(nl) + 5 * max(v)) AS q FROM p JOIN v USING (lang) JOIN (SELECT lang, sum(total) AS nl FROM s GROUP BY 1) USING (lang) GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f ON f.lang = a.lang AND f.a = a.source AND f.b = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o) WHERE part = 'pair' OR rank <= 50"""
# Rebuilt conversations as lists, every prefix of each; crc32 bit by bit.
TRIE_SQL = r"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id AS c, turns FROM l),
b AS (SELECT c, coalesce(o.turns[1:h], []) || x.turns[h + 1:] AS turns FROM (SELECT c, turns, xor(list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM h) x LEFT JOIN l o ON o.conv_id = c - c % 100),
m AS (SELECT c, d, turns[1:d] AS path, d = len(turns) AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM m GROUP BY ALL), i AS (SELECT row_number() OVER () AS id, * FROM n),
e AS (SELECT a.id, b.id AS up, b.conv_id AS parent_conv_id FROM i a JOIN i b ON b.d = a.d - 1 AND b.path = a.path[1:a.d - 1]), k AS (SELECT up AS id, count(*) AS n_children FROM e GROUP BY 1),
s AS (SELECT b.id, sum((x.n_convs - 1) * CASE WHEN x.d > 0 THEN length(x.path[x.d].text) ELSE 0 END) AS saved, count(*) FILTER (k.id IS NULL) AS leaves FROM i x JOIN i b ON b.d <= x.d AND b.path = x.path[1:b.d] LEFT JOIN k ON k.id = x.id GROUP BY 1)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM i LEFT JOIN e USING (id) LEFT JOIN k USING (id) JOIN s USING (id)"""

ORACLE_SQL: dict[str, str] = {"op11_source_divergence": DIVERGENCE_SQL, "op13_prefix_trie": TRIE_SQL, "op2_ngram_jaccard_join": JACCARD_SQL, "op4_suffix_dedup": REPEATS_SQL}
