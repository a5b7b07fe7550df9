"""Queries of the text functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import intents, readability, text
from sitegauge.functions.scores import round2
from sitegauge.operators.blocks import without_repeats
from sitegauge.registry import query
from sitegauge.sources.signals import STOP_WORDS, keyword
from sitegauge.sources.tables import table

R2 = "CAST(floor(({0}) * 100 + 0.5) / 100 AS DOUBLE)".format
WORDS = r"list_filter(regexp_split_to_array({0}, '[ \t\n\r\f\v]+'), lambda w: w <> '')".format
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
VOWELS = "len(regexp_extract_all(x, '[aeiouy]+'))"


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w, len({SENTENCES}) AS ns FROM documents),
u AS (SELECT doc_id, len(w) AS n, ns, coalesce(list_sum(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^(?:{readability.ACRONYMS})$') OR regexp_matches(x, '[0-9]') THEN 1 ELSE greatest(1,
  {VOWELS} - CASE WHEN ends_with(x, 'e') AND {VOWELS} > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END) END)), 0) AS sy FROM t),
v AS (SELECT *, CASE WHEN n >= 100 AND ns > 0 THEN greatest(0.0, least(100.0, 206.835 - 1.015 * (n / ns) - 84.6 * (sy / n))) ELSE 0.0 END AS s FROM u)
SELECT doc_id, CAST(n AS INTEGER) AS n_words, CAST(ns AS INTEGER) AS n_sentences, CAST(sy AS INTEGER) AS n_syllables, {R2('s')} AS score, CASE WHEN n < 100 THEN 'Insufficient text' WHEN ns = 0 THEN 'Unknown'
  {' '.join(f"WHEN s >= {a} THEN '{g}'" for a, g in readability.GRADES)} ELSE 'Very Difficult (Graduate level)' END AS grade FROM v""")
def text_readability(spark, sf_dir):
    r = readability.readability(F.col("text")).alias("r")
    return table(spark, sf_dir, "documents").select("doc_id", r).select("doc_id", F.col("r.words").alias("n_words"), F.col("r.sentences").alias("n_sentences"), F.col("r.syllables").alias("n_syllables"), round2(F.col("r.score")).alias("score"), "r.grade")


STOPPED = "list_filter(list_transform(string_split(text, '.'), lambda s: trim(s)), lambda s: s <> '')"
KIND = rf"CASE WHEN len({WORDS('s')}) > 20 OR regexp_matches(lower(s), '{readability.CONJUNCTIONS}') THEN 2 WHEN len({WORDS('s')}) < 10 THEN 0 ELSE 1 END"


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), u AS (SELECT doc_id, text, len({WORDS('text')}) AS n, len(string_split(text, '.')) AS parts, list_transform({STOPPED}, lambda s: {KIND}) AS k FROM t)
SELECT doc_id, {R2("CASE WHEN text = '' THEN 0 WHEN n / parts <= 15 THEN 100 WHEN n / parts <= 20 THEN 80 WHEN n / parts <= 25 THEN 60 ELSE greatest(20, 100 - (n / parts - 25) * 2) END")} AS stepped,
CAST(len(k) AS INTEGER) AS total, CAST(len(list_filter(k, lambda x: x = 2)) AS INTEGER) AS complex, CAST(len(list_filter(k, lambda x: x = 0)) AS INTEGER) AS simple, CAST(len(list_filter(k, lambda x: x = 1)) AS INTEGER) AS structured,
CAST(CASE WHEN text = '' THEN 0 ELSE 20 * ((n >= 50)::INT + (parts > 1)::INT + (n / parts BETWEEN 10 AND 25)::INT + regexp_matches(text, '[?!,;]')::INT + regexp_matches(text, '^\p{{Lu}}')::INT) END AS DOUBLE) AS quality FROM u""")
def content_measures(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", round2(readability.stepped_readability(t)).alias("stepped"), readability.sentence_classes(t).alias("c"), readability.content_quality(t).alias("quality")).select(
        "doc_id", "stepped", "c.total", "c.complex", "c.simple", "c.structured", "quality")


ASKED = f"regexp_matches(lower({{0}}), '{readability.QUESTION_PATTERNS}')".format


@query(rf"""WITH t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS low, {SENTENCES} AS s FROM conversations),
u AS (SELECT conv_id, turn, len(regexp_extract_all(low, '{readability.QUESTION_PATTERNS}')) AS q, len(list_filter(range(1, len(s)), lambda i: {ASKED('s[i]')} AND len({WORDS('s[i + 1]')}) >= 5 AND length(s[i + 1]) > 20)) AS p,
  {' + '.join(f"regexp_matches(low, '{m}')::INT" for m in readability.FAQ_MARKS)} AS m, len(list_distinct(regexp_extract_all(low, '{readability.STEP_PATTERN}'))) AS st FROM t)
SELECT conv_id, turn, CAST(q AS INTEGER) AS questions, CAST(p AS INTEGER) AS pairs, CAST(m AS INTEGER) AS marks, p >= 3 OR (q >= 5 AND p >= 2) OR (m > 0 AND q >= 2) AS detected, CAST(st AS INTEGER) AS step_words FROM u""")
def faq_and_steps(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", readability.faq_signals(t).alias("f"), readability.step_words(t).alias("step_words")).select("conv_id", "turn", "f.questions", "f.pairs", "f.marks", "f.detected", "step_words")


def _weighted(table_) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) / {len(w)} * {n}" for w, n in table_.items())


@query(rf"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), u AS (SELECT doc_id, low, {', '.join(f'({_weighted(t)}) AS {k}' for k, t in intents.INTENT_WEIGHTS.items())} FROM t),
v AS (SELECT *, {' + '.join(intents.INTENT_WEIGHTS)} AS total FROM u)
SELECT doc_id, {', '.join(f"{R2(f'CASE WHEN low = {chr(39) * 2} THEN 25 WHEN total = 0 THEN {d} ELSE {k} * 100 / total END')} AS {k}" for k, d in zip(intents.INTENT_WEIGHTS, (40, 30, 15, 15), strict=True))}, CAST(total AS DOUBLE) AS total,
CASE WHEN low = '' THEN 'low' WHEN total = 0 THEN 'very_low' WHEN total >= 10 THEN 'high' WHEN total >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM v""")
def intent_distribution(spark, sf_dir):
    out = table(spark, sf_dir, "documents").select("doc_id", intents.intent_shares(F.col("text")).alias("i"))
    return out.select("doc_id", *[round2(F.col("i.shares")[k]).alias(k) for k in intents.INTENT_WEIGHTS], F.col("i.total").alias("total"), F.col("i.confidence").alias("confidence"))


@query(rf"""WITH w AS (SELECT doc_id, {WORDS("coalesce(text, '')")} AS w FROM documents), x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM w WHERE len(w) >= 40),
y AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos <= len(w) - 19 THEN array_to_string(w[pos:pos + 19], ' ') END AS run FROM x),
z AS (SELECT *, CASE WHEN run IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) > 1 THEN 1 ELSE 0 END AS again FROM y),
g AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM z),
k AS (SELECT doc_id, count(*) FILTER (gone = 0) AS n, coalesce(md5(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0)), md5('')) AS h FROM g GROUP BY doc_id)
SELECT doc_id, CAST(n AS INTEGER) AS n_words, h AS kept_md5 FROM k UNION ALL SELECT doc_id, CAST(len(w) AS INTEGER), md5(array_to_string(w, ' ')) FROM w WHERE len(w) < 40""")
def repeated_blocks_removed(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", text.word_count(F.col("kept")).alias("n_words"), F.md5("kept").alias("kept_md5"))


@query(rf"""SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '{intents.CONVERSATIONAL}')) AS INTEGER) AS conversational,
CAST(len(list_filter([{', '.join(repr(w) for w in intents.EMOTIONAL)}], lambda w: contains(lower(coalesce(text, '')), w))) AS INTEGER) AS emotional, CAST(len(regexp_extract_all(coalesce(text, ''), '\d+')) AS INTEGER) AS numbers,
{R2("100 * length(regexp_replace(coalesce(text, ''), '[\\x00-\\x7F]', '', 'g')) / greatest(1, length(coalesce(text, '')))")} AS non_ascii_percent FROM conversations""")
def conversation_cues(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", intents.conversational_count(t).alias("conversational"), F.size(intents.emotional_words(t)).alias("emotional"), F.size(intents.numbers(t)).alias("numbers"),
                                                       round2(readability.non_ascii_share(t) * 100).alias("non_ascii_percent"))


BARE = r"regexp_replace(w, '^[.,!?;:]+|[.,!?;:]+$', '', 'g')"


@query(rf"""WITH t AS (SELECT DISTINCT p_name || ' the guide, ' || p_type || ' of ' || p_brand || '!' AS title, p_brand FROM part), u AS (SELECT title, p_brand, {WORDS('lower(title)')} AS ws FROM t),
v AS (SELECT *, list_filter(list_transform(ws, lambda w: {BARE}), lambda w: w <> '') AS b FROM u)
SELECT title, CAST(length(title) * 8 AS INTEGER) AS pixels, CASE WHEN length(title) * 8 > 600 THEN 'FAIL' WHEN length(title) * 8 > 500 THEN 'WARNING' ELSE 'PASS' END AS desktop,
CASE WHEN length(title) * 8 > 500 THEN 'FAIL' WHEN length(title) * 8 > 400 THEN 'WARNING' ELSE 'PASS' END AS mobile, CAST(len(list_filter(b, lambda w: list_contains([{', '.join(repr(w) for w in intents.FILLERS)}], w))) AS INTEGER) AS fillers,
{R2("list_max(list_transform(b, lambda x: len(list_filter(b, lambda y: y = x)))) / len(ws)")} AS stuffing, CAST(list_position(b, lower(p_brand)) - 1 AS INTEGER) AS brand_at FROM v""")
def title_measures(spark, sf_dir):
    title = F.concat("p_name", F.lit(" the guide, "), "p_type", F.lit(" of "), "p_brand", F.lit("!"))
    t = F.col("title")
    out = table(spark, sf_dir, "part").select(title.alias("title"), "p_brand").distinct().select("title", intents.title_width(t).alias("w"), F.size(intents.filler_words(t)).alias("fillers"), round2(intents.stuffing(t)).alias("stuffing"),
                                                                                             intents.keyword_position(t, F.col("p_brand")).cast("int").alias("brand_at"))
    return out.select("title", "w.pixels", "w.desktop", "w.mobile", "fillers", "stuffing", "brand_at")


@query(rf"""WITH t AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'how to buy ' WHEN 1 THEN 'local ' WHEN 2 THEN 'video ' ELSE '' END || p_name AS keyword, CAST(p_size AS BIGINT) * 500 AS volume FROM part)
SELECT keyword, volume, array_to_string(list_filter(['organic', CASE WHEN volume > 10000 THEN 'ai_overview' END, {', '.join(f"CASE WHEN regexp_matches(keyword, '{p}') THEN '{n}' END" for n, p in intents.SERP.items())}], lambda x: x IS NOT NULL), ',') AS features FROM t""")
def keyword_serp_features(spark, sf_dir):
    lead = F.when(F.col("p_partkey") % 5 == 0, "how to buy ").when(F.col("p_partkey") % 5 == 1, "local ").when(F.col("p_partkey") % 5 == 2, "video ").otherwise("")
    rows = table(spark, sf_dir, "part").select(F.concat(lead, "p_name").alias("keyword"), (F.col("p_size").cast("long") * 500).alias("volume")).distinct()
    return rows.select("keyword", "volume", F.array_join(intents.serp_features(F.col("keyword"), F.col("volume")), ",").alias("features"))


@query(rf"""WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]+$')) AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first_at FROM x WHERE length(word) > 2 AND NOT list_contains([{', '.join(repr(w) for w in STOP_WORDS)}], word) GROUP BY 1, 2),
b AS (SELECT doc_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1)
SELECT w.doc_id, CASE WHEN ok THEN word END AS keyword, CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS n, {R2("CASE WHEN ok THEN n * 100 / len(ws) ELSE 0 END")} AS density
FROM (SELECT *, length(trim(coalesce(text, ''))) >= 50 AND len(ws) >= 10 AND EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id) AS ok FROM w) w LEFT JOIN b USING (doc_id)""")
def keyword_densities(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keyword(F.col("text")).alias("k")).select("doc_id", F.col("k.keyword").alias("keyword"), F.col("k.count").alias("n"), round2(F.col("k.density")).alias("density"))


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '~', 'g') AS t FROM documents)
SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(t, '{intents.PERSON}'))) AS INTEGER) AS people, CAST(len(list_distinct(regexp_extract_all(t, '{intents.PLACE}'))) AS INTEGER) AS places,
CAST(len({' || '.join(f"regexp_extract_all(lower(t), '{p}')" for p in intents.DATES)}) AS INTEGER) AS dates, CAST(len(list_distinct({' || '.join(f"regexp_extract_all(t, '{p}')" for p in intents.PHONES)})) AS INTEGER) AS phones,
regexp_matches(lower(t), '{intents.DATED}') AS dated, CAST(len(regexp_extract_all(t, '{intents.DEFINITIONS}')) AS INTEGER) AS definitions FROM t""")
def named_things(spark, sf_dir):
    """Counts over texts whose letters beyond ASCII are masked, as what ends a word there differs between pattern libraries."""
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "~")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(intents.people(t)).alias("people"), F.size(intents.places(t)).alias("places"), F.size(intents.dates(t)).alias("dates"), F.size(intents.phones(t)).alias("phones"),
                                                   intents.has_dated_note(t).alias("dated"), F.size(intents.definitions(t)).alias("definitions"))


@query(rf"""SELECT p_partkey, (length(regexp_replace(p_name, '\S', '', 'g')) >= 1 AND NOT regexp_matches(lower(p_name || ' ' || p_type), '{intents.NO_AUTHORS}')) AS human, NOT regexp_matches(lower(p_name), '{intents.NO_BUSINESS}') AS business,
CAST(100 - CASE WHEN len({WORDS('p_name')}) < 3 THEN 30 ELSE 0 END - CASE WHEN regexp_matches(p_name, 'image|picture|photo|graphic|icon|logo') THEN 15 ELSE 0 END AS INTEGER) AS alt_score,
CAST(p_size * 40 * p_size * 30 * 3 AS BIGINT) AS image_bytes, CASE WHEN p_size * 40 * p_size * 30 * 3 = 0 THEN 'unknown' WHEN p_size * 40 * p_size * 30 * 3 > 5242880 THEN 'very_large' WHEN p_size * 40 * p_size * 30 * 3 > 1048576 THEN 'large' WHEN p_size * 40 * p_size * 30 * 3 > 512000 THEN 'medium' ELSE 'small' END AS image_size FROM part""")
def names_and_images(spark, sf_dir):
    size = intents.image_weight((F.col("p_size") * 40).cast("string"), (F.col("p_size") * 30).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", intents.is_human_author(F.concat_ws(" ", "p_name", "p_type")).alias("human"), intents.is_business_name(F.col("p_name")).alias("business"), intents.alt_score(F.col("p_name")).alias("alt_score"),
                                              size["bytes"].alias("image_bytes"), size["size"].alias("image_size"))
