"""The older pack of score rules: 55 rules with weights and maxima, as Columns.

legacy_features makes the columns that they read from sources.signals.page_signals:
counts of words, headings, paragraphs and questions, the reading ease, the
intent shares, and graph, an array of the page's entities as maps of text.
A rule's points are capped at its maximum; a category's score is the weighted
mean of its rules' percentages.  Signals of a crawl that are unknown are null
and count as 0 or false.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.intents import intent_shares
from sitegauge.functions.readability import faq_signals, paragraph_metrics, readability, step_words
from sitegauge.functions.scores import clamp, points, ranges, steps
from sitegauge.functions.text import QUESTION
from sitegauge.operators.entities import has
from sitegauge.operators.entity_audit import RELATIONS, nodes

UNKNOWN = {"status_code": "int", "response_time_ms": "int", "malformed": "boolean", "structure_score": "double", "transactional": "double"}


def legacy_features(pages: DataFrame) -> DataFrame:
    """Adds the columns that the rules read.  pages: the result of page_signals."""
    out = pages.withColumns({n: F.lit(None).cast(t) for n, t in UNKNOWN.items() if n not in pages.columns})
    level = lambda n: F.size(F.filter("headings", lambda h: h["level"] == n))
    node_maps = F.filter(F.transform(nodes(F.col("jsonld")), lambda n: F.from_json(n, "map<string, string>")), lambda m: has(m["@type"]) | has(m["@id"]))
    out = out.withColumns({
        "graph": node_maps, "_read": readability(F.col("text")), "_faq": faq_signals(F.col("text"), F.exists(F.col("jsonld"), lambda b: b.contains('"FAQPage"'))), "_par": paragraph_metrics(F.col("paragraphs")),
        "_intent": intent_shares(F.col("text")), "words": F.col("word_count"), "h1": level(1), "h2": level(2), "h3": level(3), "steps": F.greatest(F.col("n_list_items"), step_words(F.col("text"))),
        "question_heads": F.size(F.filter("headings", lambda h: h["text"].rlike(QUESTION) | h["text"].endswith("?"))),
        "in_order": ~F.exists(F.arrays_zip(F.slice("headings", 1, F.greatest(F.size("headings") - 1, F.lit(0))).alias("a"), F.slice("headings", 2, F.greatest(F.size("headings") - 1, F.lit(0))).alias("b")), lambda z: z["b"]["level"] - z["a"]["level"] > 1) & (F.size("headings") > 0),
    })
    types = F.transform("graph", lambda e: e["@type"])
    related = F.aggregate("graph", F.lit(0), lambda n, e: n + F.size(F.filter(F.map_keys(e), lambda k: k.isin(*RELATIONS) & e[k].contains('"@id"'))))
    name = F.try_element_at("graph", F.lit(1))["name"]
    density = lambda n: F.coalesce(F.try_divide(n * 1000.0, F.col("words")), F.lit(0.0))
    low = F.lower(F.coalesce("text", F.lit("")))
    return out.withColumns({
        "read": F.col("_read.score"), "sent": F.coalesce(F.try_divide(F.col("words"), F.col("_read.sentences")), F.lit(0.0)), "n_paragraphs": F.col("_par.n"), "par": F.col("_par.mean_words"),
        "short": F.col("_par.short_percent") / 100, "long": F.col("_par.long_percent") / 100, "questions": F.col("_faq.questions"), "qa": F.col("_faq.pairs"), "faq": F.col("_faq.detected"),
        "types": types, "n_entities": F.size("graph"), "n_types": F.size(F.array_distinct(F.array_compact(types))), "density": density(F.size("graph")), "n_relations": related,
        "n_relation_kinds": F.size(F.array_distinct(F.flatten(F.transform("graph", lambda e: F.filter(F.map_keys(e), lambda k: k.isin(*RELATIONS) & e[k].contains('"@id"')))))),
        "mentions": density(F.when(has(name), (F.length(low) - F.length(F.replace(low, F.lower(name), F.lit("")))) / F.length(name)).otherwise(0.0)),
        "main_content": F.col("has_main") | (F.col("word_count") >= 100), "low_words": F.col("word_count") < 300,
        "intent_top": F.array_max(F.map_values("_intent.shares")), "informational": F.col("_intent.shares")["informational"], "commercial": F.col("_intent.shares")["commercial"], "confidence": F.col("_intent.confidence"),
        "intent_next": F.try_element_at(F.sort_array(F.map_values("_intent.shares"), asc=False), F.lit(2)),
    }).drop("_read", "_faq", "_par", "_intent")


@dataclass(frozen=True)
class ScoreRule:
    rule_id: str
    category: str
    weight: float
    most: float
    raw: Column

    def percent(self) -> Column:
        """0 to 100 of the most that the rule gives."""
        return clamp(F.coalesce(self.raw, F.lit(0.0)), 0.0, self.most) * 100 / self.most


def rules() -> list[ScoreRule]:
    c, g = F.col, F.col("graph")
    flag = lambda n: F.coalesce(c(n), F.lit(False))
    of = lambda *t: F.filter(g, lambda e: e["@type"].isin(*t))
    total = lambda items, f: F.aggregate(items, F.lit(0.0), lambda a, e: a + f(e))
    any_of = lambda e, *names: F.coalesce(sum((has(e[n]).cast("int") for n in names), F.lit(0)) > 0, F.lit(False))
    all_of = lambda e, *names: F.coalesce(sum((has(e[n]).cast("int") for n in names), F.lit(0)) == len(names), F.lit(False))
    count = lambda f: F.size(F.filter(g, f))
    part = lambda x, whole, n: F.least(x / float(whole), F.lit(1.0)) * n
    listed = lambda v: F.when(v.startswith("["), F.size(F.from_json(v, "array<string>"))).when(has(v), 1).otherwise(0)
    same_as = total(g, lambda e: listed(e["sameAs"]).cast("double"))
    first = lambda items: F.try_element_at(items, F.lit(1))
    either = lambda *cases: _cases(cases)
    linked = count(lambda e: any_of(e, "sameAs", "url"))
    ratio = F.coalesce(F.try_divide(c("qa"), c("questions")), F.lit(0.0))
    grown = 1 / (1 + F.exp(-(ratio * 8 - 4)))
    multiplier = F.when(ratio < 0.5, 0.3).when(ratio < 0.8, 0.7).otherwise(1.0)
    h1, h2, h3, words, read, sent, par, short = (c(n) for n in ("h1", "h2", "h3", "words", "read", "sent", "par", "short"))
    sure = lambda high, medium, low: F.when(c("confidence") == "high", float(high)).when(c("confidence") == "medium", float(medium)).otherwise(float(low))
    asked = F.coalesce(F.try_divide(c("question_heads"), h2), F.lit(0.0))
    dates = ("datePublished", "dateModified", "dateCreated")
    dated = first(F.filter(g, lambda e: any_of(e, *dates)))
    rated = first(of("AggregateRating", "Review", "Rating"))
    contact = first(of("Organization", "LocalBusiness", "Person"))
    reached = sum((has(contact[n]).cast("int") for n in ("telephone", "email", "address", "url")), F.lit(0)) + F.when(has(contact["contactPoint"]), 2).otherwise(0)
    action = F.when(h2 > c("question_heads"), (h2 - c("question_heads")) / h2).otherwise(0.0)
    present = lambda *t: sum((F.array_contains("types", x).cast("int") for x in t), F.lit(0))
    images = of("ImageObject")
    ai, cite, llm, top, voice = "ai_impact", "citation_probability", "llm_readiness", "topical_authority", "voice_intent"
    R = ScoreRule
    per_section = F.coalesce(F.try_divide(c("n_paragraphs"), h2), F.lit(0.0))
    per_heading = F.coalesce(F.try_divide(words, h2 + h3), F.lit(0.0))
    depth = F.coalesce(c("n_paragraphs") / F.greatest(c("informational") / 20, F.lit(1.0)), F.lit(0.0))
    structure = F.when((ratio >= 0.9) & (c("questions") >= 30), 80.0).when((ratio >= 0.8) & (c("questions") >= 20), 60.0).otherwise(part(c("questions"), 5, 15.0))
    return [
        R("structured_data_completeness", ai, 2.0, 20, part(c("n_entities"), 5, 8) + part(c("n_types"), 3, 6) + points(count(lambda e: has(e["@context"])) > 0, 4) + points(F.size(of("Organization")) > 0, 2)),
        R("entity_graph_quality", ai, 1.5, 15, points(c("n_entities") > 0, 5) + part(c("n_entities"), 10, 5) + part(c("n_relations"), 5, 5)),
        R("content_semantic_clarity", ai, 1.0, 10, part(words, 1000, 3) + part(c("density"), 10, 4) + F.greatest(F.lit(0.0), 3 - F.abs(read - 60) / 40 * 3)),
        R("schema_markup_validation", ai, 1.5, 15, points(count(lambda e: has(e["@context"])) > 0, 3) + points((c("n_entities") > 0) & (count(lambda e: has(e["@type"])) == c("n_entities")), 4) + total(of("Organization"), lambda e: points(all_of(e, "name", "url"), 3))
          + total(of("WebPage"), lambda e: points(all_of(e, "name", "url"), 2)) + total(of("Article"), lambda e: points(all_of(e, "headline", "author"), 3))),
        R("ai_content_optimization", ai, 1.0, 10, points(c("in_order"), 3) + either((par.between(50, 150), 3), (par.between(30, 200), 2), (par > 0, 1)) + either(((h1 == 1) & (h2 >= 2), 4), ((h1 == 1) & (h2 >= 1), 2), (h1 >= 1, 1))),
        R("technical_ai_readiness", ai, 1.0, 10, points(c("status_code") == 200, 2) + either((c("response_time_ms") <= 1000, 2), (c("response_time_ms") <= 2000, 1)) + points(c("main_content"), 3) + points(~flag("malformed"), 3)),
        R("entity_consistency", ai, 1.0, 10, steps(c("mentions"), (5, 5), (2, 3), (1, 1)) + points(c("n_types").between(1, 5), 3) + points((count(lambda e: has(e["name"])) > 0) & (F.size(F.array_distinct(F.transform(F.filter(g, lambda e: has(e["name"])), lambda e: e["name"]))) == count(lambda e: has(e["name"]))), 2)),
        R("cross_reference_quality", ai, 1.0, 10, part(c("n_relations"), 5, 5) + part(same_as, 3, 3) + part(count(lambda e: has(e["url"])), 2, 2) + points((c("n_entities") > 0) & (count(lambda e: has(e["url"])) >= c("n_entities") * 0.8), 2)),
        R("breadcrumb_navigation", ai, 0.6, 10, points(F.size(of("BreadcrumbList")) > 0, 5) + steps(listed(first(of("BreadcrumbList"))["itemListElement"]), (3, 3), (2, 2), (1, 1))),
        R("content_freshness", ai, 0.5, 10, F.when(dated.isNotNull(), 4 + F.when(sum((has(dated[d]).cast("int") for d in dates), F.lit(0)) >= 2, 3.0).otherwise(1.0) + points(dated["@type"].isin("Article", "BlogPosting", "NewsArticle"), 3)).otherwise(0.0)),
        R("image_schema_completeness", ai, 0.7, 10, points(F.size(images) > 0, 3) + steps(F.size(F.filter(images, lambda e: any_of(e, "url", "contentUrl") & any_of(e, "width", "height", "caption"))), (2, 4), (1, 2)) + points(count(lambda e: any_of(e, "primaryImageOfPage", "logo")) > 0, 3)),
        R("authority_signals", cite, 2.0, 20, total(of("Organization"), lambda e: points(has(e["sameAs"]), 5) + points(all_of(e, "url", "name"), 3) + points(any_of(e, "foundingDate", "address"), 2))
          + total(of("Person", "Author"), lambda e: points(has(e["sameAs"]), 4) + points(any_of(e, "jobTitle", "worksFor"), 3)) + steps(F.size(of("Organization", "Person", "GovernmentOrganization")), (3, 3), (1, 1))),
        R("trustworthiness_indicators", cite, 1.5, 15, total(of("Organization"), lambda e: points(any_of(e, "telephone", "email", "contactPoint"), 4)) + points(words >= 500, 3) + points(c("n_entities") >= 2, 3)
          + total(of("WebPage"), lambda e: points(F.lower(e["url"]).rlike("about|contact"), 2)) + points(read.between(30, 70), 3)),
        R("content_depth", cite, 1.5, 15, steps(words, (2000, 5), (1000, 3), (500, 1)) + either(((h2 >= 5) & (h3 >= 3), 4), ((h2 >= 3) & (h3 >= 1), 2), (h2 >= 2, 1)) + F.when(c("faq"), steps(c("questions"), (5, 3), (3, 2), (1, 1))).otherwise(0.0) + steps(c("steps"), (5, 3), (3, 2), (1, 1))),
        R("expertise_indicators", cite, 1.0, 10, total(of("Person"), lambda e: points(any_of(e, "jobTitle", "knowsAbout", "award"), 3) + points(any_of(e, "alumniOf", "worksFor"), 2))
          + steps(F.size(of("MedicalEntity", "Drug", "MedicalProcedure", "MedicalTest", "ResearchProject", "ScholarlyArticle", "Thesis")), (2, 3), (1, 1)) + F.size(of("ScholarlyArticle", "MedicalWebPage", "Report")) * 2.0),
        R("data_and_sources", cite, 1.0, 10, F.size(of("Dataset")) * 4.0 + F.size(of("Citation", "CreativeWork")) * 3.0 + points(words >= 1000, 2) + F.size(F.filter(of("Organization"), lambda e: F.lower(e["name"]).rlike("research|university"))) * 1.0),
        R("uniqueness_value", cite, 1.0, 10, steps(c("n_types"), (5, 4), (3, 2), (1, 1)) + steps(words, (1500, 3), (800, 2), (300, 1)) + steps(c("density"), (8, 3), (5, 2), (2, 1))),
        R("technical_quality", cite, 1.0, 10, points(c("main_content"), 3) + points(~flag("malformed"), 2) + points(~c("low_words"), 2) + steps(c("n_paragraphs"), (5, 2), (3, 1)) + points(c("status_code") == 200, 1)),
        R("external_validation", cite, 1.0, 10, steps(same_as, (3, 5), (1, 3)) + steps(linked, (3, 3), (1, 1)) + F.size(of("Review", "Rating", "AggregateRating")) * 2.0),
        R("social_proof_signals", cite, 0.6, 10, F.when(rated.isNotNull(), 4 + points(has(rated["ratingValue"]), 2) + points(any_of(rated, "reviewCount", "ratingCount"), 2)).otherwise(0.0) + points(any_of(first(of("Product", "Service", "LocalBusiness")), "aggregateRating", "review"), 2)),
        R("contact_completeness", cite, 0.5, 10, steps(reached, (4, 7), (3, 5), (2, 3), (1, 1))),
        R("citation_format_readiness", cite, 0.7, 10, F.when(first(of("ScholarlyArticle", "Article", "Report", "Thesis")).isNotNull(), 5 + points(any_of(first(of("ScholarlyArticle", "Article", "Report", "Thesis")), "citation"), 2)).otherwise(0.0)
          + points(has(first(of("Person"))["name"]), 2) + points(any_of(first(of("Person")), "affiliation", "worksFor"), 1) + steps(words, (1500, 2), (1000, 1))),
        R("content_structure_clarity", llm, 2.0, 20, points(c("in_order"), 6) + F.when(h1 == 1, 4.0).when(h1 == 0, 0.0).otherwise(2.0) + steps(h2, (3, 4), (2, 3), (1, 2)) + steps(c("n_paragraphs"), (5, 3), (3, 2), (1, 1)) + steps(c("question_heads"), (2, 3), (1, 1))),
        R("readability_optimization", llm, 1.5, 15, either((read.between(50, 70), 6), (read.between(40, 80), 4), (read.between(30, 90), 2), (read > 0, 1)) + either((sent.between(15, 20), 4), (sent.between(12, 25), 3), (sent.between(10, 30), 2), (sent > 0, 1))
          + either(((short >= 0.2) & (c("long") <= 0.3), 3), ((short >= 0.1) & (c("long") <= 0.5), 2), (short >= 0.05, 1)) + ranges(par, (50, 150, 2), (30, 200, 1))),
        R("content_length_optimization", llm, 1.0, 10, F.greatest(F.lit(0.0), either((words.between(800, 2000), 5), (words.between(500, 3000), 4), (words.between(300, 4000), 3), (words.between(200, 5000), 2), (words >= 100, 1)) + steps(words, (300, 3), (150, 2), (50, 1)) - points(words < 50, 2))),
        R("language_clarity", llm, 1.0, 10, either((sent.between(10, 18), 4), (sent.between(8, 22), 3), (sent.between(6, 25), 2), (sent > 0, 1)) + ranges(par, (40, 120, 3), (30, 150, 2), (20, 180, 1)) + points(short.between(0.1, 0.4), 3)),
        R("semantic_coherence", llm, 1.0, 10, either((c("density").between(5, 15), 4), (c("density").between(3, 20), 3), (c("density").between(2, 25), 2), (c("density") >= 1, 1)) + either((c("mentions").between(2, 8), 3), (c("mentions").between(1, 12), 2), (c("mentions") >= 0.5, 1))
          + either((c("n_types").between(2, 6), 3), (c("n_types").between(1, 8), 2), (c("n_types") >= 1, 1))),
        R("technical_formatting", llm, 1.0, 10, points(~flag("malformed"), 4) + points(c("main_content"), 3) + steps(F.coalesce("structure_score", F.lit(0.0)), (80, 3), (60, 2), (40, 1))),
        R("vocabulary_complexity", llm, 1.0, 10, either((read.between(40, 70), 5), (read.between(30, 80), 4), (read.between(20, 85), 3), (read.between(10, 90), 2), (read > 0, 1)) + ranges(sent, (12, 22, 3), (10, 25, 2), (8, 28, 1)) + ranges(par, (60, 140, 2), (40, 180, 1))),
        R("content_organization", llm, 1.5, 15, either(((h1 == 1) & (h2 >= 2), 4), ((h1 == 1) & (h2 >= 1), 3), (h1 >= 1, 2)) + either(((h3 >= 1) & (h2 >= 2), 3), (h2 >= 3, 2), (h2 >= 1, 1)) + points(c("faq"), 2) + points(c("steps") > 0, 2) + steps(c("n_paragraphs"), (4, 2), (2, 1)) + points(c("question_heads") > 0, 2)),
        R("list_structure_quality", llm, 0.6, 10, steps(c("steps"), (5, 4), (3, 3), (1, 2)) + either((short.between(0.2, 0.5), 3), (short.between(0.1, 0.6), 2), (short >= 0.05, 1)) + either((c("n_paragraphs").between(3, 15), 3), (c("n_paragraphs").between(2, 20), 2), (c("n_paragraphs") >= 1, 1))),
        R("content_chunking", llm, 0.5, 10, either((par.between(40, 100), 4), (par.between(30, 120), 3), (par.between(20, 150), 2), (par > 0, 1)) + either((sent.between(12, 20), 3), (sent.between(10, 25), 2), (sent > 0, 1)) + steps(h2, (3, 3), (2, 2), (1, 1))),
        R("semantic_heading_quality", llm, 0.7, 10, F.when(h2 == 0, 2.0).otherwise(either((asked >= 0.3, 5), (asked >= 0.2, 4), (asked >= 0.1, 2), (asked > 0, 1))) + either(((h2 >= 2) & (h3 >= 2), 3), ((h2 >= 2) & (h3 >= 1), 2), (h2 >= 1, 1)) + points(c("faq"), 2)),
        R("entity_richness", top, 2.0, 20, part(c("n_entities"), 15, 6) + part(c("n_types"), 6, 6) + part(c("density"), 10, 4) + part(c("n_relations"), 5, 4)),
        R("topical_depth", top, 1.5, 15, steps(words, (2000, 5), (1500, 4), (1000, 3), (500, 2), (300, 1)) + either(((h2 >= 4) & (h3 >= 3), 4), ((h2 >= 3) & (h3 >= 2), 3), ((h2 >= 2) & (h3 >= 1), 2), (h2 >= 2, 1)) + steps(c("density"), (8, 3), (6, 2), (4, 1)) + steps(c("n_paragraphs"), (8, 3), (6, 2), (4, 1))),
        R("primary_entity_authority", top, 1.5, 15, points(c("n_entities") > 0, 5) + sum((points(has(first(g)[n]), 2) for n in ("name", "url", "sameAs")), F.lit(0.0)) + steps(c("mentions"), (5, 4), (3, 3), (2, 2), (1, 1))),
        R("entity_relationships", top, 1.0, 10, part(c("n_relations"), 5, 4) + part(c("n_relation_kinds"), 3, 3)),
        R("topic_consistency", top, 1.0, 10, either((c("density").between(5, 12), 4), (c("density").between(3, 15), 3), (c("density").between(2, 18), 2), (c("density") >= 1, 1)) + either((c("mentions").between(2, 6), 3), (c("mentions").between(1, 8), 2), (c("mentions") > 0, 1))
          + either((c("n_types").between(3, 5), 3), (c("n_types").between(2, 6), 2), (c("n_types").between(1, 7), 1))),
        R("expertise_signals", top, 1.0, 10, steps(F.size(of("Person", "Organization", "ProfessionalService", "MedicalOrganization", "EducationalOrganization")), (3, 4), (2, 3), (1, 2))
          + total(of("Person"), lambda e: points(any_of(e, "jobTitle", "knowsAbout", "award"), 3) + points(any_of(e, "alumniOf", "worksFor"), 2)) + total(of("Organization"), lambda e: points(any_of(e, "award", "hasCredential"), 2))),
        R("content_comprehensiveness", top, 1.0, 10, steps(words, (1500, 3), (1000, 2), (500, 1)) + steps(h2, (3, 2), (2, 1)) + steps(c("faq").cast("int") + (c("steps") > 0).cast("int") + (h3 >= 2).cast("int"), (2, 3), (1, 2)) + steps(c("n_paragraphs"), (6, 2), (4, 1))),
        R("entity_validation", top, 1.0, 10, steps(count(lambda e: all_of(e, "name", "@type")), (5, 4), (3, 3), (1, 2)) + steps(linked, (3, 3), (1, 2)) + points(c("n_entities") >= 2, 3)),
        R("entity_mention_distribution", top, 0.6, 10, either((c("mentions").between(3, 8), 4), (c("mentions").between(2, 10), 3), (c("mentions").between(1, 12), 2), (c("mentions") > 0, 1))
          + either((F.try_divide(c("n_entities"), c("n_types")).between(2, 5), 3), (F.try_divide(c("n_entities"), c("n_types")).between(1.5, 7), 2), (F.try_divide(c("n_entities"), c("n_types")) >= 1, 1)) + steps(c("n_relations"), (3, 3), (1, 1))),
        R("schema_type_diversity", top, 0.5, 10, steps(c("n_types"), (6, 5), (4, 4), (3, 3), (2, 2), (1, 1)) + steps(present("Organization", "Person", "WebPage", "Article"), (3, 3), (2, 2), (1, 1)) + steps(present("Product", "Service", "Event", "Place", "Dataset"), (2, 2), (1, 1))),
        R("content_depth_indicators", top, 0.7, 10, either(((h2 >= 3) & (h3 >= 3), 3), ((h2 >= 3) & (h3 >= 1), 2), (h2 >= 2, 1)) + either((per_section.between(2, 5), 3), (per_section.between(1.5, 6), 2), (per_section >= 1, 1))
          + either((c("density").between(6, 12), 3), (c("density").between(4, 15), 2), (c("density") >= 2, 1)) + ranges(per_heading, (150, 400, 2), (100, 500, 1))),
        R("intent_clarity_first", voice, 2.0, 30, sure(15, 10, 5) + steps(c("intent_top"), (60, 6), (40, 4), (25, 2), (15, 1)) + either((c("intent_top") >= c("intent_next") * 1.5, 4), (c("intent_top") >= c("intent_next") * 1.2, 2), (c("intent_top") > c("intent_next"), 1)) + points(c("informational") >= 30, 2)),
        R("conversational_language", voice, 1.5, 25, (points(sent.between(12, 18), 10) + either((read.between(60, 80), 8), (read.between(50, 85), 6), (read.between(40, 90), 4), (read > 0, 2)) + ranges(par, (40, 100, 3), (30, 120, 2), (20, 150, 1)) + steps(c("question_heads"), (2, 3), (1, 2))) * multiplier),
        R("voice_search_readiness", voice, 1.5, 100, points(c("faq"), 5) + F.when(c("questions") > 0, F.least(structure * grown, F.when(ratio < 0.5, 15.0).otherwise(100.0))).otherwise(0.0)
          + F.when(c("informational") > 0, F.when(depth >= 3, part(c("informational"), 50, 3)).when(depth >= 1.5, part(c("informational"), 60, 2)).otherwise(part(c("informational"), 80, 1))).otherwise(0.0)
          + F.when(read <= 0, 0.0).when(read.between(50, 75), F.when(words >= 300, 3.0).otherwise(2.0)).when(read.between(40, 85), F.when(words >= 500, 2.0).otherwise(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(read - 62.5) / 37.5))),
        R("question_optimization", voice, 1.0, 10, (steps(c("question_heads"), (4, 4), (2, 3), (1, 2)) + steps(c("qa"), (3, 3), (1, 2)) + steps(c("questions"), (6, 3), (3, 2), (1, 1))) * grown),
        R("natural_language_patterns", voice, 1.0, 10, (either((sent.between(14, 16), 4), (sent.between(12, 18), 3), (sent.between(10, 20), 2), (sent > 0, 1)) + ranges(par, (50, 80, 3), (40, 100, 2), (30, 120, 1)) + either((short.between(0.2, 0.4), 3), (short.between(0.1, 0.5), 2), (short >= 0.05, 1))) * multiplier),
        R("intent_clarity", voice, 1.5, 20, (steps(c("intent_top"), (50, 12), (35, 9), (25, 6), (15, 3)) + sure(8, 5, 2)) * multiplier),
        R("user_intent_alignment", voice, 1.0, 10, (steps(c("intent_top"), (50, 4), (35, 3), (25, 2), (15, 1)) + sure(3, 2, 1) + steps(c("informational"), (35, 3), (20, 2), (10, 1))) * multiplier),
        R("voice_query_compatibility", voice, 1.0, 10, (steps(c("qa"), (2, 3), (1, 2)) + steps(c("question_heads"), (2, 2), (1, 1)) + ranges(par, (30, 90, 2), (20, 120, 1)) + either((read.between(55, 75), 3), (read.between(45, 85), 2), (read > 0, 1))) * multiplier),
        R("contextual_relevance", voice, 1.0, 10, (either((words.between(500, 1500), 3), (words.between(300, 2000), 2), (words >= 200, 1)) + either((c("density").between(4, 10), 3), (c("density").between(3, 12), 2), (c("density") >= 2, 1)) + sure(4, 2, 1)) * multiplier),
        R("command_phrase_detection", voice, 0.6, 10, steps(F.greatest(F.coalesce("transactional", F.lit(0.0)), c("commercial")), (20, 3), (10, 2), (1e-9, 1)) + steps(action, (0.5, 4), (0.3, 3), (1e-9, 2)) + sure(3, 2, 1)),
        R("conversational_flow_quality", voice, 0.7, 10, F.when(c("faq"), steps(c("qa"), (3, 4), (1, 2))).otherwise(0.0) + either((sent.between(12, 18) & (short >= 0.1), 3), (sent.between(10, 20) & (short >= 0.05), 2), (sent > 0, 1))
          + either((read.between(55, 75), 3), (read.between(45, 80), 2), (read > 0, 1)) + steps(c("informational"), (40, 2), (25, 1))),
    ]


def _cases(cases) -> Column:
    """Points of the first condition that holds; 0 if none does."""
    out = F
    for condition, n in cases:
        out = out.when(condition, F.lit(float(n)))
    return out.otherwise(0.0)


def legacy_scores(pages: DataFrame, *keep: str) -> DataFrame:
    """-> keep and rule_scores, a map of rule id to 0..100; no row moves.  pages: the result of legacy_features, best written once."""
    found = rules()
    return pages.select(*keep, F.map_from_arrays(F.lit([r.rule_id for r in found]), F.array(*[r.percent() for r in found])).alias("rule_scores"))


def legacy_categories(pages: DataFrame, *keep: str) -> DataFrame:
    """-> keep and a column for each category: the weighted mean of its rules' percentages."""
    groups: dict[str, list[ScoreRule]] = {}
    for r in rules():
        groups.setdefault(r.category, []).append(r)
    return pages.select(*keep, *[(sum((r.percent() * r.weight for r in rs), F.lit(0.0)) / sum(r.weight for r in rs)).alias(name) for name, rs in sorted(groups.items())])
