"""Search intents, cues of conversation and attention, and small extractors of names, dates and phones, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.functions.scores import let
from sitegauge.functions.text import words

# Words and phrases with the weight each occurrence has for an intent.
INTENT_WEIGHTS = {
    "informational": {"what": 3, "how": 3, "guide": 4, "tutorial": 4, "learn": 3, "understand": 3, "explain": 3, "definition": 2, "meaning": 2, "example": 2, "basics": 2, "introduction": 3, "overview": 2, "steps": 2,
                      "process": 2, "method": 2},
    "commercial": {"best": 4, "top": 4, "pricing": 5, "price": 4, "cost": 4, "service": 3, "product": 3, "buy": 5, "purchase": 5, "deal": 4, "discount": 4, "offer": 4, "review": 3, "compare": 4, "vs": 3, "versus": 3,
                   "cheap": 3, "affordable": 3, "premium": 3, "professional": 2, "enterprise": 3, "business": 2},
    "local": {"near me": 5, "nearby": 4, "location": 3, "address": 3, "phone": 3, "hours": 3, "directions": 4, "map": 3, "local": 3, "store": 3, "office": 3, "branch": 2, "in [city]": 2, "area": 2, "neighborhood": 2},
    "navigational": {"login": 5, "signin": 5, "contact": 4, "about": 3, "homepage": 4, "home": 4, "dashboard": 3, "account": 4, "profile": 3, "settings": 3, "support": 3, "help": 2, "faq": 2, "sitemap": 2, "search": 2,
                     "navigate": 2},
}
CONVERSATIONAL = r"\b(?:you|your|how to|step by step|easy way|quick guide|simple|best way)\b"
EMOTIONAL = ("amazing awesome best better biggest breakthrough complete comprehensive easy effective essential exclusive expert fast free guaranteed guide helpful incredible instant latest master new perfect "
             "powerful pro professional quick simple step-by-step top ultimate valuable").split()
FILLERS = ("the a an is are was were be been being have has had do does did will would shall should may might must can could of in to for with on at by from and or but not this that it its "
           "we our your you they").split()
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
DATES = (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b", rf"\b(?:{MONTHS})[a-z]* \d{{1,2}},? \d{{4}}\b", rf"\b\d{{1,2}}\s+(?:{MONTHS})[a-z]*,? \d{{4}}\b")
DATED = r"(?:updated|published|modified)\s+(?:on|:)?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
NO_AUTHORS = "agency|team|company|group|staff|admin|editor|service|solution"
NO_BUSINESS = "agency|services|solutions|results|globe|worldwide"
SERP = {"people_also_ask": "how|what|why|guide|tutorial", "local_pack": "near me|local|services|company", "video": "video|youtube"}
PHONES = (r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}", r"\+1\s*\d{3}[-.\s]?\d{3}[-.\s]?\d{4}")
ANSWER_CUES = "is defined as|refers to|means that|is a"
DEFINITIONS = r"(?i)\w+\s+(?:is\s+an?|refers\s+to|can\s+be\s+defined\s+as)\s+[^,.!?]+"
PERSON, PLACE = r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*[A-Z]{2}\b"
EEAT_TYPES_BY_URL = (("blog", "/blog/|/article/|/post/|/news/"), ("service", "/service/|/services/|/solution/"), ("product", "/product/|/products/|/item/"), ("about", "/about/|/team/|/company/"), ("contact", "/contact/|/support/"))
EEAT_TYPES_BY_TEXT = (("blog", "blog|article|post|guide|tutorial"), ("service", "service|solution|consulting|agency"), ("product", "product|price|buy|shop|cart"))
EEAT_TYPES_BY_HEADING = (("blog", "blog|article|guide"), ("service", "service|solution"), ("product", "product|price"))


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def occurrences(text: Column, phrase: str) -> Column:
    """How often the phrase occurs in the text, as it is."""
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)


def intent_shares(text: Column) -> Column:
    """struct<shares map<intent, percent>, total, confidence>: weighted counts of each intent's words.

    Percentages are of the total; without any such word they are 40, 30, 15 and 15, and for no text 25 each.
    Confidence: high from a total of 10, medium from 5, low below, very_low without any word."""
    names = list(INTENT_WEIGHTS)
    flat = lambda *v: F.map_from_arrays(F.lit(names), F.array(*[F.lit(float(x)) for x in v]))

    def sums(low: Column, n: Column) -> Column:
        return F.array(*[sum(((n - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) * weight for w, weight in table.items()), F.lit(0.0)) for table in INTENT_WEIGHTS.values()])

    def judged(low: Column, s: Column) -> Column:
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        share = F.map_from_arrays(F.lit(names), F.transform(s, lambda x: x * 100 / total))
        shares = F.when(low == "", flat(25, 25, 25, 25)).when(total == 0, flat(40, 30, 15, 15)).otherwise(share)
        sure = F.when(low == "", "low").when(total == 0, "very_low").when(total >= 10, "high").when(total >= 5, "medium").otherwise("low")
        return F.struct(shares.alias("shares"), total.alias("total"), sure.alias("confidence"))

    # the text is put into small letters and measured once, not for each word; the sums are made once
    return let(_low(text), lambda low: let(F.length(low), lambda n: let(sums(low, n), lambda s: judged(low, s))))


def conversational_count(text: Column) -> Column:
    return F.regexp_count(_low(text), F.lit(CONVERSATIONAL))


def emotional_words(text: Column) -> Column:
    """The listed words that the text holds, also inside others."""
    low = _low(text)
    return F.filter(F.lit(EMOTIONAL), lambda w: F.contains(low, w))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0))


def _bare(w: Column) -> Column:
    return F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")


def filler_words(title: Column) -> Column:
    return F.filter(words(_low(title)), lambda w: _bare(w).isin(*FILLERS))


def stuffing(title: Column) -> Column:
    """The most frequent word's share of the title's words; 0 without words."""
    w = words(_low(title))
    bare = F.filter(F.transform(w, _bare), lambda x: x != "")
    most = F.array_max(F.transform(F.array_distinct(bare), lambda x: F.size(F.filter(bare, lambda y: y == x))))
    return F.coalesce(F.try_divide(most, F.size(w)), F.lit(0.0))


def keyword_position(title: Column, keyword: Column) -> Column:
    """The keyword's place among the title's words, from 0; null if it is not there."""
    at = F.array_position(F.transform(words(_low(title)), _bare), F.lower(keyword))
    return F.when(at > 0, at - 1)


def dates(text: Column) -> Column:
    """Dates in the text, in lower case."""
    return F.flatten(F.array(*[F.regexp_extract_all(_low(text), F.lit(p), F.lit(0)) for p in DATES]))


def has_dated_note(text: Column) -> Column:
    """Whether the text says on what date it was updated, published or modified."""
    return _low(text).rlike(DATED)


def people(text: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PERSON), F.lit(0)))


def places(text: Column) -> Column:
    """Capitalised words, a comma and two capitals."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PLACE), F.lit(0)))


def phones(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in PHONES])))


def same_phone(a: Column, b: Column) -> Column:
    """Whether two phone numbers have the same digits."""
    digits = lambda x: F.regexp_replace(x, r"[^\d]", "")
    return (digits(a) == digits(b)) & (digits(a) != "")


def serp_features(keyword: Column, volume: Column) -> Column:
    """Result features that a keyword of a monthly search volume is likely to show."""
    low = F.trim(_low(keyword))
    more = [F.when(volume > 10_000, F.lit("ai_overview"))] + [F.when(low.rlike(p), F.lit(n)) for n, p in SERP.items()]
    return F.when(low == "", F.array(F.lit("organic"))).otherwise(F.array_compact(F.array(F.lit("organic"), *more)))


def is_human_author(name: Column) -> Column:
    """Two words or more, the first two of several letters, and no word that an organization's name holds."""
    w = words(name)
    return F.coalesce((F.size(w) >= 2) & (F.length(F.get(w, F.lit(0))) > 1) & (F.length(F.get(w, F.lit(1))) > 1) & ~F.lower(name).rlike(NO_AUTHORS), F.lit(False))


def is_business_name(name: Column) -> Column:
    """3 to 99 characters and no headline's word."""
    return F.coalesce(F.length(F.trim(name)).between(3, 99) & ~F.lower(name).rlike(NO_BUSINESS), F.lit(False))


def eeat_page_type(url: Column, text: Column, h1: Column) -> Column:
    """blog, service, product, about or contact by the URL, else by the text, else by the first heading; else general."""
    def first(value, table):
        out = F
        for name, pattern in table:
            out = out.when(value.rlike(pattern), F.lit(name))
        return out.otherwise(None)

    return F.coalesce(first(_low(url), EEAT_TYPES_BY_URL), first(_low(text), EEAT_TYPES_BY_TEXT), first(_low(h1), EEAT_TYPES_BY_HEADING), F.lit("general"))


def schema_fits(kind: Column, types: Column) -> Column:
    """Whether a page type allows the page's schema types: no Article on services and products, one on blogs."""
    article = F.array_contains(types, "Article")
    return F.when(kind.isin("service", "product"), ~article).when(kind == "blog", article | F.array_contains(types, "BlogPosting")).otherwise(True)


def direct_answers(paragraphs: Column) -> Column:
    """Paragraphs of 40 to 60 words with a cue of an answer."""
    return F.filter(paragraphs, lambda p: F.size(words(p)).between(40, 60) & F.lower(p).rlike(ANSWER_CUES))


def definitions(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DEFINITIONS), F.lit(0))


def title_width(title: Column) -> Column:
    """struct<pixels, desktop, mobile>: 8 pixels a character; desktop fails over 600 and warns over 500, mobile 500 and 400."""
    px = F.length(F.coalesce(title, F.lit(""))) * 8
    grade = lambda fail, warn: F.when(px > fail, "FAIL").when(px > warn, "WARNING").otherwise("PASS")
    return F.struct(px.alias("pixels"), grade(600, 500).alias("desktop"), grade(500, 400).alias("mobile"))


def alt_score(alt: Column) -> Column:
    """0 without text; else 100 less 30 for under three words, 20 for over 20, 20 for a file ending and 15 for a generic word."""
    a, low, n = F.coalesce(alt, F.lit("")), _low(alt), F.size(words(alt))
    minus = F.when(n < 3, 30).otherwise(0) + F.when(n > 20, 20).otherwise(0) + F.when(low.rlike(r"\.(?:jpg|png|gif|jpeg|webp)"), 20).otherwise(0) + F.when(low.rlike("image|picture|photo|graphic|icon|logo"), 15).otherwise(0)
    return F.when(a == "", 0).otherwise(100 - minus)


def image_weight(width: Column, height: Column) -> Column:
    """struct<bytes, size>: width x height x 3; small up to 500 KB, medium to 1 MB, large to 5 MB, else very_large; unknown without dimensions."""
    pixels = lambda x: F.nullif(F.regexp_extract(x, r"^\s*(\d{1,9})", 1), F.lit("")).cast("long")
    n = F.nullif(pixels(width) * pixels(height) * 3, F.lit(0))
    return F.struct(n.alias("bytes"), F.when(n.isNull(), "unknown").when(n > 5 << 20, "very_large").when(n > 1 << 20, "large").when(n > 500 << 10, "medium").otherwise("small").alias("size"))


def video_id(url: Column) -> Column:
    """The id in an address of the two large video hosts; null if there is none."""
    a = F.regexp_extract(url, r"(?:youtube\.com/(?:watch\?(?:.*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    b = F.regexp_extract(url, r"vimeo\.com/(?:video/)?(\d+)", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def iso_seconds(duration: Column) -> Column:
    """Seconds of an ISO 8601 duration of days, hours, minutes and seconds; null if it is none."""
    pattern = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    part = lambda i, n: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(duration, pattern, i), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0)) * n
    return F.when(duration.rlike(pattern) & (F.length(duration) > 2), part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1))
