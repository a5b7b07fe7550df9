"""Secret scan: a random forest that removes false positives.  DataFrame functions only.

A candidate is what follows a credential word and : or = (to the closing quote,
else to white space; in a URL to the next parameter), or a known prefix and its
key, or a run of 16 or more of [A-Za-z0-9+/_-] that holds a digit, with the ='s
that end it.  A name and the = behind it are no part of a candidate.  Its
features are length, character classes and transitions between them, distinct
characters, coverage by dictionary parts, path marks and neighbouring words.
The forest (pyspark.ml, on the JVM) is trained from labelled findings: a table
(before, candidate, after, label), by default one that default_findings()
builds from hashes of a counter for common credential and non-credential forms.

Results: scan_secrets gives one row for each candidate, in text order; null and
empty texts give none.  redact_secrets keeps every row and column; null stays
null, and text without a secret stays as it is.  Repeated rows repeat results.
Texts and candidates are read whole, however long.  A null id is passed through.
A probability of exactly THRESHOLD is a secret.  Columns of any name are kept.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_side

MASK = "[SECRET]"
BEFORE, AFTER = 48, 24
THRESHOLD = 0.5

# Words that name a credential, that name other identifiers, that mark
# placeholders, and frequent parts of English words.
CREDENTIAL = "token|secret|passw|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?key"
PREFIXES = r"(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{16,}+|github_pat_\w{16,}+|glpat-[\w-]{16,}+|sk-[\w-]{16,}+|[srp]k_(?:live|test)_\w{16,}+|xox[abeprs]-[\w-]{10,}+|AIza[\w-]{30,}+)"
_NAME = rf"(?i:{CREDENTIAL})[A-Za-z0-9_.-]{{0,16}}"
_GIVEN = rf"{_NAME}[\"']?[ \t]{{0,3}}(?::=|=>|[:=])[ \t]{{0,3}}"
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?:"
    rf"(?<=[\"'`])(?<=[:=>][ \t]{{0,3}}[\"'`])(?<={_GIVEN}[\"'`])[^\"'`\r\n]++(?=[\"'`])"
    rf"|(?<==)(?<=[?&]{_NAME}=)[^\s\"'<>&#]++"
    rf"|(?<=[:=>][ \t]{{0,3}})(?<={_GIVEN})(?!(?i:bearer|basic|token)\s)[^\s\"'`<>]+(?<![,;.)\]}}])"
    r"|(?<=\s)(?<=(?i:bearer)[ \t]{1,3})[A-Za-z0-9._~+/-]{8,}+={0,2}"
    rf"|{PREFIXES}(?![A-Za-z0-9+/_-])"
    r"|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2})"
)
IDENTIFIER = "sha1|sha256|sha512|md5|checksum|digest|commit|etag|uuid|guid|isbn|order|invoice|card|phone|build|revision|session.?id|page|version"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|xxxx|test|0000|1234567|abcdef"
PARTS = ("tion|ing|the|and|ment|able|con|pre|pro|inter|ness|ture|ance|ence|com|per|ver|ist|ize|ous|ful|less|page|user|name|file|data|time|test|"
         "code|key|line|list|node|main|path|home|local|lib|src|bin|python|java|index|image|config|setting|example|sample|value|number|chapter|"
         "version|release|report|section|article|order|item|home|about|contact|blog|news|product")
FEATURES = ("size", "digits", "uppers", "lowers", "hex_only", "digits_only", "turns", "distinct", "covered", "slashes", "dashes",
            "after_path", "named", "other_name", "assigned", "quoted", "placeholder", "known", "signs")


def features(before: Column, candidate: Column, after: Column) -> dict[str, Column]:
    n = F.length(candidate).cast("double")
    low, near = F.lower(candidate), F.lower(F.right(before, F.lit(24)))
    share = lambda p: F.regexp_count(candidate, F.lit(p)) / n
    flag = lambda c: c.cast("double")
    return {
        "size": F.log1p(n), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"),
        "hex_only": flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "digits_only": flag(candidate.rlike("^[0-9+/=_-]+$")),
        "turns": share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / F.least(n, F.lit(64.0)),
        "covered": 1 - F.length(F.regexp_replace(low, PARTS, "")) / n,
        "slashes": share("/"), "dashes": share("[-_]"), "after_path": flag(before.rlike(r"(/|\\|://\S*|\.)$")),
        "named": flag(near.rlike(CREDENTIAL)), "other_name": flag(near.rlike(IDENTIFIER)),
        "assigned": flag(before.rlike("[:=]\\s*[\"']?$")), "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "placeholder": flag(low.rlike(PLACEHOLDER)), "known": flag(candidate.rlike("^" + PREFIXES)), "signs": share("[^A-Za-z0-9]"),
    }


def default_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """Labelled findings: 16 forms of secrets and 19 of other strings, alternating, as _parts takes them from their texts."""
    h, g = (F.sha2(F.concat(F.lit(s), F.col("id").cast("string")), 256) for s in "ab")
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "=", "")
    digits = F.translate(h, "abcdef", "123456")
    pick = lambda *options: F.element_at(F.array(*[F.lit(o) if isinstance(o, str) else o for o in options]), (F.col("id") / 35).cast("int") % len(options) + 1)
    name = pick("token", "api_key", "API_KEY", "secret", "SECRET", "password", "access_key", "auth_token", "TOKEN", "client_secret")
    filler = pick("the page says", "and then", "of the", "de la", "und der", "que los", "see", "note")
    sep, quote = pick(" = ", "=", ": ", ":", " = ", " ", " := "), pick('"', "", "'", '"', '"')
    spaced = F.concat(filler, F.lit(" "))
    named = F.concat(spaced, name, sep, quote)
    given = F.concat(spaced, name, pick("=", ": ", "=", " = ", ":"), quote)
    letters = F.translate(h, "0123456789", "ghjkmnpqrs")
    signed = F.concat(F.initcap(F.left(letters, F.lit(4))), F.substring(digits, 1, 2), pick("&", "!", "$", "@", "#", "%", "*"), F.substring(letters, 9, 4))
    plain = pick("required", "the", "none", "true", "null", "string", "optional", "see", "is", "field", "invalid", "expired", "disabled", "your")
    word = pick("internationalization", "documentation_chapter", "configurationsettings", "thingsandothertexts", "releaseversionreport")
    secrets = [
        (named, F.left(h, F.lit(40)), quote), (named, F.upper(F.left(h, F.lit(40))), quote), (named, F.left(h, F.lit(32)), quote), (named, h, quote), (named, F.left(b64, F.lit(40)), quote), (named, F.left(b64, F.lit(24)), quote),
        (spaced, F.concat(F.lit("AKIA"), F.upper(F.left(g, F.lit(16)))), F.lit(" ")), (spaced, F.concat(F.lit("ghp_"), F.left(F.regexp_replace(b64, "[+/]", "a"), F.lit(36))), F.lit(" ")),
        (F.concat(spaced, F.lit("Authorization: Bearer ")), F.left(b64, F.lit(43)), F.lit(" ")), (named, F.concat(F.lit("sk-"), F.left(F.regexp_replace(b64, "[+/]", "b"), F.lit(40))), quote),
        (F.concat(spaced, name, F.lit("=")), F.left(h, F.lit(40)), F.lit(" ")), (F.concat(F.lit("https://www/x?"), name, F.lit("=")), F.left(h, F.lit(32)), F.lit("&page=2")),
        (given, F.concat(F.left(letters, F.lit(6)), F.upper(F.substring(letters, 7, 14))), quote), (given, signed, quote), (given, F.concat(F.left(letters, F.lit(5)), F.substring(digits, 1, 3)), quote),
        (spaced, F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), F.lit(" ")),
    ]
    others = [
        (spaced, F.left(digits, F.lit(16)), F.lit(" ")), (F.concat(spaced, F.lit("card ")), F.concat_ws("-", *[F.substring(digits, i, 4) for i in (1, 5, 9, 13)]), F.lit(".")),
        (spaced, F.concat(word, F.substring(digits, 1, 2)), F.lit(" ")), (F.concat(spaced, pick("commit ", "sha1: ", "md5 ", "checksum: ", "etag=")), F.left(h, F.lit(40)), F.lit(" ")),
        (F.concat(spaced, pick("sha256:", "digest: ")), h, F.lit(" ")), (F.concat(spaced, pick("uuid ", "guid=", "id: ")), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(" ")),
        (spaced, F.concat(F.lit("/usr/lib/python3/"), word, F.lit("/file"), F.substring(digits, 1, 1)), F.lit(".")), (F.concat(spaced, F.lit("https://")), F.concat(F.lit("www/blog/2024/05/"), word), F.lit(" ")),
        (named, pick("YOUR_API_KEY_HERE_1", "example_token_12345", "xxxxxxxxxxxxxxxxxxxx1", "changeme_placeholder1", "test_test_test_0000"), quote), (spaced, F.concat(F.lit("2024-05-17T10-20-"), F.substring(digits, 1, 2)), F.lit(" ")),
        (spaced, F.concat(F.lit("+1-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 6)), F.lit(" ")), (spaced, F.concat(word, F.lit("-"), word, F.lit("-"), F.substring(digits, 1, 3)), F.lit(" ")),
        (F.concat(spaced, F.lit("order ")), F.left(digits, F.lit(18)), F.lit(" ")), (spaced, F.concat(F.lit("----------------"), F.substring(digits, 1, 2)), F.lit(" ")),
        (given, plain, quote), (given, F.concat(plain, F.lit(" "), filler), quote), (given, pick("${TOKEN}", "$PASSWORD", "get_token()", "os.environ[TOKEN]", "<token>", "********", "changeme", "your_password", "example"), quote),
        (spaced, F.concat(F.lit("MY_SERVICE_API_KEY_"), F.substring(digits, 1, 1)), F.lit("=")), (F.concat(spaced, pick("build=", "session_id=", "etag=", "version=", "page=")), F.left(h, F.lit(32)), F.lit(" ")),
    ]
    forms = [(f, 1) for f in secrets] + [(f, 0) for f in others]
    rows = F.array(*[F.struct(b.alias("before"), c.alias("candidate"), a.alias("after"), F.lit(y).alias("label")) for (b, c, a), y in forms])
    made = spark.range(n).select(F.element_at(rows, (F.col("id") % len(forms) + 1).cast("int")).alias("r")).select(
        F.explode(_parts(F.concat("r.before", "r.candidate", "r.after"))).alias("p"), F.col("r.candidate").alias("of"), "r.label")
    own = F.contains("of", "p.candidate") | F.contains("p.candidate", "of")
    return made.select("p.before", "p.candidate", "p.after", F.when(own, F.col("label")).otherwise(0).alias("label"))


def _with_features(df: DataFrame) -> DataFrame:
    f = features(F.col("before"), F.col("candidate"), F.col("after"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(df.withColumns(f))


def fit_forest(findings: DataFrame, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, maxMemoryInMB=64,
                                    featureSubsetStrategy="sqrt", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_class")
    return forest.fit(_with_features(findings.select("before", "candidate", "after", F.col("label").cast("double").alias("label"))))


def _parts(text: Column) -> Column:
    """[(no, before, candidate, after)] of the text's candidates, from the pieces between them."""
    between, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.transform(F.arrays_zip(found.alias("c"), F.slice(between, 1, F.size(found)).alias("b"), F.slice(between, 2, F.size(found)).alias("a")), lambda z, i: F.struct(
        i.alias("no"), F.right(z["b"], F.lit(BEFORE)).alias("before"), z["c"].alias("candidate"), F.left(z["a"], F.lit(AFTER)).alias("after")))


def _judged(candidates: DataFrame, findings: DataFrame | None, spark: SparkSession) -> DataFrame:
    model = fit_forest(findings if findings is not None else default_findings(spark))
    out = model.transform(_with_features(candidates)).withColumn("probability", F.round(vector_to_array("_probability")[1], 6))
    return out.withColumn("is_secret", F.col("probability") >= THRESHOLD)


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """-> doc_id, finding_no, before, candidate, after, probability, is_secret."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike(CANDIDATE)).select(
        "doc_id", F.explode(_parts(F.col("text"))).alias("p")).select("doc_id", F.col("p.no").cast("long").alias("finding_no"), "p.before", "p.candidate", "p.after")
    return _judged(found, findings, docs.sparkSession).select("doc_id", "finding_no", "before", "candidate", "after", "probability", "is_secret")


def redact_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """The documents with every secret replaced by MASK; n_chars follows if there is one."""
    h, s, nos = fresh(docs, "h", "s", "nos")
    has = F.col("text").rlike(CANDIDATE)
    touched, rest = docs.filter(has), docs.filter(~F.coalesce(has, F.lit(False)))
    named = {h: F.xxhash64("text"), s: F.sha2("text", 256)}
    found = touched.select(named[h].alias(h), named[s].alias(s), F.explode(_parts(F.col("text"))).alias("p")).select(
        h, s, F.col("p.no").alias("no"), "p.before", "p.candidate", "p.after")
    scratch = Scratch(docs.sparkSession)
    secret = scratch.save(_judged(found, findings, docs.sparkSession).filter("is_secret").groupBy(h, s).agg(F.collect_set("no").alias(nos)), "secrets")
    joined = touched.withColumns(named).join(small_side(secret, scratch, "secrets"), [h, s], "left")
    pieces, found = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    rebuilt = F.array_join(F.transform(pieces, lambda s, i: F.concat(s, F.when(i >= F.size(found), F.lit(""))
                           .when(F.array_contains(nos, i), F.lit(MASK)).otherwise(F.coalesce(F.try_element_at(found, i + 1), F.lit(""))))), "")
    out = joined.withColumn("text", F.when(F.col(nos).isNull(), F.col("text")).otherwise(rebuilt))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(nos).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns).unionByName(rest)
