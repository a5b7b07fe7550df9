"""Text functions as Columns.  Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that show what a searcher wants, question starts, cue words.
INTENTS = (("transactional", "buy|price|cheap|deal|discount|order|purchase|shop"), ("commercial", "best|top|review|compare|vs"), ("informational", "how|what|why|guide|tutorial|tips"))
KEYWORD_INTENTS = (("commercial", "buy|price|cost|cheap|best|review|deal|discount"), ("navigational", "login|website|official|contact|near me"))
QUESTION = r"(?i)^\s*(what|how|why|when|where|who|which|can|does|do|is|are|should)\b"
POWER_WORDS = "free|easy|quick|best|top|proven|guaranteed|exclusive|limited|save|new|ultimate"
BUTTONS = "submit|send|click here|continue|next|previous|back"
CALL_WORDS = "get|try|buy|order|download|sign up|register|learn|discover|explore|start"


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased words; 0 if both are empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.trim(s) != "")


def syllables(word: Column) -> Column:
    """Vowel groups, a silent e less, at least one; words of up to three letters have one."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(n, F.lit(1)))


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)


def clean_text(text: Column) -> Column:
    """White space collapsed, words of buttons dropped, phone numbers and e-mail addresses masked."""
    out = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), f"(?i){BUTTONS}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]"), r"\b\+?1?[-.]?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}\b", "[PHONE]")
    return F.trim(F.regexp_replace(out, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"))


def intent(text: Column) -> Column:
    """The intent with the most words of its list present; ties go to the first."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [(name, sum((F.when(low.contains(w), 1).otherwise(0) for w in pattern.split("|")), F.lit(0))) for name, pattern in INTENTS]
    top = F.greatest(*[c for _, c in counts])
    out = F.when(top == 0, "informational")
    for name, c in counts:
        out = out.when(c == top, name)
    return out


def keyword_intent(keyword: Column) -> Column:
    low = F.lower(F.coalesce(keyword, F.lit("")))
    out = F
    for name, pattern in KEYWORD_INTENTS:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("informational")


def ctr_score(description: Column) -> Column:
    """50, 25 more for a power word and for a call, and points for the length; 0 if empty."""
    d = F.coalesce(description, F.lit(""))
    n, low = F.length(d), F.lower(d)
    score = 50 + F.when(low.rlike(POWER_WORDS), 25).otherwise(0) + F.when(low.rlike(CALL_WORDS), 25).otherwise(0) + F.when(
        n.between(150, 160), 10).when(n < 120, -10).when(n > 160, -5).otherwise(0)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), score)))


def content_hash(title: Column, description: Column, body: Column) -> Column:
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(e(title), e(description), F.left(e(body), F.lit(1000))))


def alt_quality(alt: Column) -> Column:
    a = F.trim(F.coalesce(alt, F.lit("")))
    return F.when(a == "", "missing").when(F.length(a) < 5, "poor").when(F.lower(a).rlike("^(image|img|photo|picture|untitled)"), "poor").otherwise("good")
