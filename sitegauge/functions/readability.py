"""Readability and content measures as Columns.  Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.text import sentences, words

# Acronyms of one syllable, conjunctions of complex sentences, question and step patterns.
ACRONYMS = ("ai|seo|sem|ppc|crm|erp|cms|api|ui|ux|sql|nosql|html|css|js|xml|json|csv|pdf|ceo|cto|cfo|coo|hr|pr|qa|qc|"
            "b2b|b2c|saas|paas|iaas|iot|ar|vr|gdp|gnp|roi|kpi|okr|slp|cpc|cpm")
CONJUNCTIONS = "because|although|however|therefore|moreover"
QUESTION_PATTERNS = r"\b(?:what\s+is|how\s+to|why\s+does|when\s+can|where\s+is|who\s+can|which\s+is|do\s+i|can\s+i|should\s+i|will\s+i|are\s+there)\b"
FAQ_MARKS = (r"\bfaq\b", r"\bfrequently\s+asked\s+questions\b", r"\bquestions\s+and\s+answers\b", r"\bq\s*&\s*a\b")
STEP_PATTERN = r"\b(?:step\s+\d+|first|second|third|next|then|after\s+that|finally)\b"
GRADES = ((90, "Very Easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly Easy (7th grade)"), (60, "Standard (8th-9th grade)"),
          (50, "Fairly Difficult (10th-12th grade)"), (30, "Difficult (College level)"))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def terms(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.regexp_extract_all(_low(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def plain_sentences(text: Column) -> Column:
    """Sentences without the white space around them; none is empty."""
    return F.filter(F.transform(sentences(text), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def syllables_of_terms(term: Column) -> Column:
    """Vowel groups; a silent e less, one more for consonant + le; acronyms and terms with a digit have one."""
    n = F.regexp_count(term, F.lit("[aeiouy]+"))
    n = n - F.when(term.endswith("e") & (n > 1), 1).otherwise(0) + F.when(term.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(term.rlike(f"^(?:{ACRONYMS})$") | term.rlike("[0-9]"), 1).otherwise(F.greatest(n, F.lit(1)))


def readability(text: Column) -> Column:
    """struct<words, sentences, syllables, score, grade>: reading ease within 0 to 100; under 100 words there is none."""
    def judged(c: Column) -> Column:
        n, n_sentences, syllables = c["words"], c["sentences"], c["syllables"]
        score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * (n / n_sentences) - 84.6 * (syllables / n)))
        grade = F.when(n < 100, "Insufficient text").when(n_sentences == 0, "Unknown")
        for least, name in GRADES:
            grade = grade.when(score >= least, name)
        return F.struct(n.alias("words"), n_sentences.alias("sentences"), syllables.alias("syllables"), F.when((n >= 100) & (n_sentences > 0), score).otherwise(0.0).alias("score"),
                        grade.otherwise("Very Difficult (Graduate level)").alias("grade"))

    counts = let(terms(text), lambda t: F.struct(F.size(t).alias("words"), F.size(plain_sentences(text)).alias("sentences"), F.aggregate(t, F.lit(0), lambda n, w: n + syllables_of_terms(w).cast("int")).alias("syllables")))
    return let(counts, judged)


def stepped_readability(text: Column) -> Column:
    """100, 80, 60 or less by the mean length of sentences, which end at full stops only."""
    mean = F.size(words(text)) / F.size(F.split(F.coalesce(text, F.lit("")), r"\."))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(mean <= 15, 100.0).when(mean <= 20, 80.0).when(mean <= 25, 60.0).otherwise(
        F.greatest(F.lit(20.0), 100 - (mean - 25) * 2))


def _stopped(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\."), lambda s: F.trim(s)), lambda s: s != "")


def sentence_classes(text: Column) -> Column:
    """struct<total, complex, simple, structured>; complex: over 20 words or a conjunction, simple: under 10 words."""
    def kind(s: Column) -> Column:
        n = F.size(words(s))
        return F.when((n > 20) | F.lower(s).rlike(CONJUNCTIONS), 2).when(n < 10, 0).otherwise(1)

    def counted(kinds: Column) -> Column:
        count = lambda k: F.size(F.filter(kinds, lambda x: x == k))
        return F.struct(F.size(kinds).alias("total"), count(2).alias("complex"), count(0).alias("simple"), count(1).alias("structured"))

    return let(F.transform(_stopped(text), kind), counted)


def content_quality(text: Column) -> Column:
    """Percent of five signs: 50 words, several sentences, 10 to 25 words in each, punctuation, a capital first."""
    t = F.coalesce(text, F.lit(""))
    n, parts = F.size(words(t)), F.size(F.split(t, r"\."))
    signs = [n >= 50, parts > 1, (n / parts).between(10, 25), t.rlike("[?!,;]"), t.rlike(r"^\p{Lu}")]
    return F.when(t == "", 0.0).otherwise(sum((s.cast("int") for s in signs), F.lit(0)) * 20.0)


def faq_signals(text: Column, has_faq_schema: Column | None = None) -> Column:
    """struct<questions, pairs, marks, detected>: a pair is a question sentence and a following answer of five words and 21 characters."""
    low = _low(text)
    questions = F.regexp_count(low, F.lit(QUESTION_PATTERNS))
    asked = lambda s: F.lower(s).rlike(QUESTION_PATTERNS)
    answers = lambda s: (F.size(words(s)) >= 5) & (F.length(s) > 20)
    pairs = let(plain_sentences(text), lambda parts: F.size(F.filter(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s, i: asked(s) & answers(F.get(parts, i + 1))), lambda x: x)))
    marks = sum((low.rlike(m).cast("int") for m in FAQ_MARKS), F.lit(0))
    schema = F.lit(False) if has_faq_schema is None else F.coalesce(has_faq_schema, F.lit(False))
    def judged(c: Column) -> Column:
        q, p, m = c["questions"], c["pairs"], c["marks"]
        found = schema | (p >= 3) | ((q >= 5) & (p >= 2)) | ((m > 0) & (q >= 2))
        return F.struct(q.alias("questions"), p.alias("pairs"), m.alias("marks"), found.alias("detected"))

    return let(F.struct(questions.alias("questions"), pairs.alias("pairs"), marks.alias("marks")), judged)


def step_words(text: Column) -> Column:
    """Different step marks in the text (step 1, first, next, ...)."""
    return F.size(F.array_distinct(F.regexp_extract_all(_low(text), F.lit(STEP_PATTERN), F.lit(0))))


def paragraph_metrics(paragraphs: Column) -> Column:
    """struct<n, mean_words, short_percent, long_percent> of an array of paragraphs; short: under 120 words, long: over 300."""
    def judged(sizes: Column) -> Column:
        n = F.size(sizes)
        share = lambda f: F.coalesce(F.try_divide(F.size(F.filter(sizes, f)) * 100.0, n), F.lit(0.0))
        mean = F.coalesce(F.try_divide(F.aggregate(sizes, F.lit(0), lambda a, x: a + x), n), F.lit(0.0))
        return F.struct(n.alias("n"), mean.alias("mean_words"), share(lambda x: x < 120).alias("short_percent"), share(lambda x: x > 300).alias("long_percent"))

    return let(F.filter(F.transform(paragraphs, lambda p: F.size(words(p))), lambda n: n > 0), judged)


def non_ascii_share(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")), F.length(t)), F.lit(0.0))
