"""Rules that give scores: every rule is a Column of 0 to 10 points over a page's features.

features() derives what HTML shows; probes and metrics that come from other
tables are the columns of METRICS, null where unknown, and count as 0 or false.
A page's score is the weighted mean of its category scores, a category's the
mean of its rules' scores in percent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.scores import clamp, points, ranges, steps
from sitegauge.functions.text import QUESTION, sentences, words
from sitegauge.operators.entities import graph, has

METRICS = {"robots_ok": "boolean", "llms_txt": "boolean", "business_name": "string", "business_identical": "boolean", "response_time_ms": "int", "detected_type": "string",
           "table_rows": "int", "table_headers": "int", "howto_detected": "boolean", "maps_embed": "boolean", "sequence_valid": "boolean", "tables_present": "boolean"}
WEIGHTS = {"ai_impact": 15, "citation_probability": 15, "llm_readiness": 15, "aeo_score": 15, "topical_authority": 15, "voice_intent": 25}
BUSINESS = ("Organization", "LocalBusiness", "Corporation", "MarketingAgency")


def features(pages: DataFrame) -> DataFrame:
    """The page features of sources.html, widened by what the rules read."""
    add = {n: F.lit(None).cast(t) for n, t in METRICS.items() if n not in pages.columns}
    level = lambda n: F.size(F.filter("headings", lambda h: h["level"] == n))
    parts = sentences(F.col("text"))
    asked = F.size(F.filter("headings", lambda h: h["text"].rlike(QUESTION) | h["text"].endswith("?")))
    out = pages.withColumns(add).withColumns({
        "graph": graph(F.col("jsonld")), "h1": level(1), "h2": level(2), "h3": level(3), "questions": asked,
        "avg_sentence": F.coalesce(F.try_divide(F.col("word_count"), F.size(parts)), F.lit(0.0)),
        "qa_pairs": F.size(F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?]*\?\s+[^.!?]+[.!]"), F.lit(0)), lambda s: s != "")),
        "step_count": F.regexp_count(F.lower("text"), F.lit(r"\bstep\s*\d+")),
        "avg_paragraph": F.coalesce(F.try_divide(F.col("word_count"), F.greatest(F.lit(1), F.size(F.filter("headings", lambda h: h["text"] != "")))), F.lit(0.0)),
        "short_ratio": F.coalesce(F.try_divide(F.size(F.filter(parts, lambda s: F.size(words(s)) < 20)), F.size(parts)), F.lit(0.0)),
    })
    types = F.transform("graph", lambda e: e["@type"])
    return out.withColumns({"types": types, "entity_count": F.size("graph"), "has_primary": F.size("graph") > 0,
                            "faq_schema": F.array_contains(types, "FAQPage"), "faq_detected": F.array_contains(types, "FAQPage") | (F.col("questions") >= 3) | (F.col("qa_pairs") >= 3)})


def rules() -> dict[str, tuple[str, Column]]:
    """rule id -> (category, points)."""
    c = F.col
    g = c("graph")
    of = lambda *t: F.filter(g, lambda e: e["@type"].isin(*t))
    first = lambda *t: F.try_element_at(of(*t), F.lit(1))
    some = lambda f, *t: F.exists(of(*t) if t else g, f)
    held = lambda e, *names: sum((has(e[n]).cast("int") for n in names), F.lit(0))
    org, person = first("Organization"), first("Person")
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    is_any = lambda *t: F.size(of(*t)) > 0
    listed = lambda text: F.when(text.startswith("["), F.size(F.from_json(text, "array<string>"))).when(has(text), 1).otherwise(0)
    same_as = F.aggregate(g, F.lit(0), lambda n, e: n + listed(e["sameAs"]))
    text_points = F.aggregate(g, F.struct(F.lit(0.0).alias("p"), F.lit(False).alias("stop")), lambda a, e: F.when(a["stop"], a).otherwise(F.struct(
        (a["p"] + steps(F.coalesce(F.length(e["description"]), F.lit(0)), (50, 10), (30, 5), (10, 2))).alias("p"), F.coalesce(F.length(e["description"]) >= 50, F.lit(False)).alias("stop"))))["p"]
    dated = F.try_element_at(F.filter(g, lambda e: has(e["dateModified"]) | has(e["datePublished"])), F.lit(1))
    site_urls = F.size(F.array_distinct(F.filter(F.transform(of("WebPage"), lambda e: F.regexp_extract(F.lower(e["url"]), "about|contact|privacy|terms", 0)), lambda x: x != "")))
    phone = F.try_element_at(F.filter(F.transform(g, lambda e: F.coalesce(e["telephone"], e["phone"])), has), F.lit(1))
    source = first("Citation", "Dataset", "ResearchProject")
    density = F.try_divide(c("entity_count") * 1000.0, c("word_count"))
    kinds = F.size(F.array_distinct(F.array_compact("types")))
    offer = first("Service", "Product")
    words_n = c("word_count")
    refers = some(lambda e: F.contains(F.concat_ws(" ", e["isPartOf"], e["parentOrganization"], e["worksFor"]), org["@id"]))
    a, i, t, l, p, v = "aeo_score", "ai_impact", "topical_authority", "llm_readiness", "citation_probability", "voice_intent"
    return {
        "first_60_words_direct_answer": (a, steps(words_n, (60, 5), (40, 3), (20, 1)) + ranges(c("avg_paragraph"), (30, 80, 3), (20, 100, 2)) + points(c("faq_detected"), 2)),
        "faq_schema_matches_content": (a, points(c("faq_detected"), 4) + points(c("faq_schema"), 4) + steps(c("qa_pairs"), (3, 2), (1, 1))),
        "faq_section_5_to_10_questions": (a, F.when(c("questions").between(5, 10), 8.0).when(c("questions").between(3, 12), 5.0).when(c("questions") >= 1, 2.0).otherwise(0.0) + points(c("faq_schema"), 2)),
        "question_based_h2_headings": (a, steps(c("questions"), (3, 6), (2, 4), (1, 2)) + steps(c("h2"), (2, 2)) + points(F.try_divide(c("questions"), c("h2")) >= 0.5, 2)),
        "direct_answer_format": (a, ranges(c("avg_paragraph"), (30, 80, 4), (20, 100, 2)) + steps(c("qa_pairs"), (2, 3), (1, 2)) + ranges(c("avg_sentence"), (10, 18, 3), (8, 22, 2))),
        "content_cites_sources": (a, points(some(lambda e: has(e["citation"]) | has(e["isPartOf"]) | has(e["sameAs"]), "Citation", "CreativeWork", "Article"), 4)
                                  + points(some(lambda e: has(e["name"]) & has(e["url"]), "Person", "Organization"), 3) + points(is_any("Dataset", "ResearchProject"), 3)),
        "primary_organization_schema": (i, points(is_any("Organization"), 6) + points(has(org["name"]), 2) + points(has(org["url"]), 2)),
        "correct_type": (i, points(is_any(*BUSINESS), 8) + points(is_any("MarketingAgency", "LocalBusiness"), 2)),
        "schema_valid_jsonld": (i, points(F.size("graph") > 0, 10)),
        "context_exactly_schema_org": (i, F.when(some(lambda e: e["@context"] == "https://schema.org"), 10.0).when(some(lambda e: e["@context"].isin("http://schema.org", "https://schema.org/", "http://schema.org/")), 5.0).otherwise(0.0)),
        "name_field_matches_brand": (i, points(has(org["name"]), 10)), "url_points_to_canonical_homepage": (i, points(has(org["url"]), 10)), "logo_url_returns_200": (i, points(has(org["logo"]), 10)),
        "robots_txt_non_blocking": (i, points(flag("robots_ok"), 10)), "no_plugin_duplicate_schemas": (i, F.when(c("entity_count").between(1, 10), 10.0).when(c("entity_count") <= 15, 5.0).otherwise(0.0)),
        "llms_txt_file_exists": (i, points(flag("llms_txt"), 10)), "semantic_html_tags_used": (i, points(flag("sequence_valid"), 5) + steps(c("h1"), (1, 3)) + steps(c("h2"), (1, 2))),
        "breadcrumblist_schema": (i, points(is_any("BreadcrumbList"), 10)),
        "business_name_identical": (p, F.when(has(c("business_name")), F.when(flag("business_identical"), 10.0).otherwise(6.0)).otherwise(0.0)), "address_identical": (p, points(has(org["address"]), 10)),
        "nap_matches_footer_contact": (p, steps(held(org, "name", "address", "telephone"), (3, 10), (2, 6), (1, 3))),
        "no_entity_fragmentation": (p, points(c("has_primary"), 6) + F.when(c("entity_count").between(1, 10), 4.0).when(c("entity_count").between(1, 15), 2.0).otherwise(0.0)),
        "about_contact_privacy_terms_pages": (p, steps(site_urls, (4, 10), (3, 8), (2, 5), (1, 3))),
        "phone_e164_format": (p, points(F.regexp_replace(phone, "[ -]", "").rlike(r"^\+\d{7,17}$"), 10)), "visible_author_name": (p, points(some(lambda e: has(e["name"]), "Person", "Author"), 10)),
        "person_schema_linked_to_organization": (p, F.size(F.filter(of("Person"), lambda e: has(e["worksFor"]) | has(e["affiliation"]))) * 5.0 + points(is_any("Person") & is_any("Organization"), 5)),
        "author_bio_with_credentials": (p, steps(held(person, "jobTitle", "knowsAbout", "award", "alumniOf", "worksFor"), (3, 10), (2, 6), (1, 3))),
        "author_photo": (p, points(some(lambda e: has(e["image"]), "Person"), 10)), "dedicated_author_page": (p, points(some(lambda e: has(e["url"]), "Person"), 10)),
        "business_registration_details": (p, steps(held(org, "foundingDate", "taxID", "leiCode", "duns"), (2, 10), (1, 5))), "google_maps_embed_correct": (p, points(flag("maps_embed"), 10)),
        "service_pages_800_words": (l, F.when(c("detected_type") == "Service", steps(words_n, (800, 10), (600, 6), (400, 3), (200, 1))).otherwise(0.0)),
        "topic_clusters_internal_links": (l, steps(c("h2"), (3, 5), (2, 3), (1, 1)) + steps(density, (5, 3), (3, 2), (1, 1)) + steps(c("h3"), (2, 2))),
        "webp_avif_images_lazy_loading": (l, points(is_any("ImageObject"), 5) + F.when(c("response_time_ms") <= 1000, 3.0).when(c("response_time_ms") <= 2000, 1.0).otherwise(0.0)
                                          + points(is_any("ImageObject") | (c("response_time_ms") <= 2000), 2)),
        "clear_entity_first_150_words": (l, points(c("has_primary"), 6) + steps(density, (10, 4), (5, 2), (2, 1))), "sameas_array_links_active": (l, steps(same_as, (3, 10), (2, 6), (1, 3))),
        "geo_coordinates_in_schema": (l, points(is_any("GeoCoordinates") | some(lambda e: has(e["geo"]), "Place", "LocalBusiness"), 10)), "description_minimum_50_characters": (l, text_points),
        "area_served_defined": (l, points(some(lambda e: has(e["areaServed"])), 10)), "last_updated_date_visible": (l, F.when(has(dated["dateModified"]), 10.0).when(has(dated["datePublished"]), 5.0).otherwise(0.0)),
        "semantic_subtopics_covered": (l, steps(c("h3"), (3, 5), (2, 3), (1, 1)) + steps(kinds, (4, 3), (2, 2), (1, 1)) + steps(c("h2"), (2, 2))),
        "statistics_have_source_links": (l, F.when(source.isNotNull(), 6.0).when(some(lambda e: has(e["citation"]) | has(e["isPartOf"])), 4.0).otherwise(0.0) + points(same_as > 0, 4)),
        "short_paragraphs_3_to_5_lines": (l, F.when(c("short_ratio").between(0.3, 0.6), 6.0).when(c("short_ratio").between(0.2, 0.7), 4.0).when(c("short_ratio").between(0.1, 0.8), 2.0).when(c("short_ratio") > 0, 1.0).otherwise(0.0)
                                          + ranges(c("avg_paragraph"), (40, 100, 4), (30, 120, 2))),
        "only_one_primary_entity": (t, points(c("has_primary"), 6) + F.when(c("entity_count") <= 5, 4.0).when(c("entity_count") <= 10, 2.0).otherwise(0.0)),
        "consistent_id_across_pages": (t, points(some(lambda e: has(e["@id"])), 10)), "child_schemas_reference_main_id": (t, F.when(has(org["@id"]) & F.coalesce(refers, F.lit(False)), 10.0).when(has(org["@id"]), 5.0).otherwise(0.0)),
        "opening_hours_specification": (t, points(is_any(*BUSINESS) & some(lambda e: has(e["openingHoursSpecification"])), 10)), "event_schema": (t, points(is_any("Event"), 10)),
        "aggregate_rating_schema": (t, points(is_any("AggregateRating") | some(lambda e: has(e["aggregateRating"])), 10)),
        "service_product_schema_with_offers": (t, F.when(has(offer["offers"]), 10.0).when(offer.isNotNull(), 5.0).otherwise(0.0)),
        "bullet_numbered_lists_used": (v, F.when((c("h2") >= 2) | (c("h3") >= 3), 5.0).when((c("h2") >= 1) | (c("h3") >= 1), 3.0).otherwise(0.0) + steps(c("short_ratio"), (0.2, 3), (0.1, 2)) + steps(words_n, (300, 2), (150, 1))),
        "comparison_tables_present": (v, F.when(flag("tables_present"), F.when((c("table_rows") >= 3) & (c("table_headers") >= 2), 10.0).when(c("table_rows") >= 1, 7.0).otherwise(5.0)).otherwise(0.0)),
        "conversational_tone": (v, steps(c("questions"), (2, 4), (1, 2)) + steps(c("qa_pairs"), (3, 3), (1, 2)) + ranges(c("avg_sentence"), (8, 18, 3), (6, 22, 1))),
        "step_by_step_content": (v, steps(c("step_count"), (3, 5), (1, 3)) + points(flag("howto_detected"), 3) + steps(c("h3"), (3, 2))),
    }


REQUIRED = ("primary_organization_schema", "schema_valid_jsonld")


def page_scores(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """-> keep, a column for each category and final_score, in one projection; no row moves.  pages: the result of features(), best written once."""
    groups: dict[str, list[Column]] = {}
    for category, score in rules().values():
        groups.setdefault(category, []).append(clamp(F.coalesce(score, F.lit(0.0)), 0.0, 10.0) * 10)
    means = {n: clamp(sum(cs, F.lit(0.0)) / len(cs)) for n, cs in sorted(groups.items())}
    out = pages.select(*keep, *[m.alias(n) for n, m in means.items()])
    return out.withColumn("final_score", clamp(sum((F.col(n) * WEIGHTS[n] for n in sorted(WEIGHTS)), F.lit(0.0)) / 100))


def check_rules(weights: dict[str, float] | None = None) -> dict[str, int]:
    """Rules for each category; raises where weights don't sum to 100 or a rule's category has none."""
    weights = weights or WEIGHTS
    if abs(sum(weights.values()) - 100) > 0.001:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 100")
    counts: dict[str, int] = {}
    for name, (category, _) in rules().items():
        if category not in weights:
            raise ValueError(f"rule {name} has category {category}, which has no weight")
        counts[category] = counts.get(category, 0) + 1
    return counts


def checked_scores(scores: DataFrame, *names: str) -> DataFrame:
    """The rows themselves; reading them fails where a score is null or outside 0 to 100."""
    good = lambda n: F.assert_true(F.coalesce(F.col(n).between(0, 100), F.lit(False)), f"{n} must be from 0 to 100").isNull()
    return scores.withColumns({n: F.when(good(n), F.col(n)) for n in names})


def rule_scores(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """-> keep, rule_id, category, score (0 to 100); a row for each page and rule.  pages: the result of features()."""
    rows = F.array(*[F.struct(F.lit(k).alias("rule_id"), F.lit(category).alias("category"), (clamp(F.coalesce(score, F.lit(0.0)), 0.0, 10.0) * 10).alias("score")) for k, (category, score) in rules().items()])
    return pages.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def category_scores(scores: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    return scores.groupBy(*keep, "category").agg(clamp(F.avg("score")).alias("category_score"))


def overall_scores(categories: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: a column for each category, and final_score."""
    names = sorted(WEIGHTS)
    wide = categories.groupBy(*keep).agg(*[F.max(F.when(F.col("category") == n, F.col("category_score"))).alias(n) for n in names])
    return wide.withColumn("final_score", clamp(sum((F.coalesce(n, F.lit(0.0)) * WEIGHTS[n] for n in names), F.lit(0.0)) / 100))


def score_issues(scores: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Required rules under 70 and others under 40; high under 40, else medium."""
    required = F.col("rule_id").isin(*REQUIRED)
    return scores.filter((required & (F.col("score") < 70)) | (~required & (F.col("score") < 40))).select(
        *keep, "rule_id", "category", "score", F.when(F.col("score") < 40, "high").otherwise("medium").alias("severity"))


def spam_damped(score: Column, spam: Column, n_words: Column) -> Column:
    """A score damped for spam signals and for few words by logistic curves."""
    return score * (1 / (1 + F.exp(spam - 3))) * (0.3 + 0.7 / (1 + F.exp(-(n_words - 200) / 100)))
