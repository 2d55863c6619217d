"""Text operators as column expressions: redaction, sanitising, injection scores, extraction, review, CV scoring.

Only Unicode normalisation and readability need Python; both are Arrow-batched and off the hot path.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import any_keyword, strip
from tidemark.functions.vocabulary import RISKY

#: Personal data by type, in the order of redaction. Our patterns, to the published contract.
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ni_number": r"\b[A-Za-z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-Za-z]\b",
    "phone_uk": r"(?:\+44 ?|\b0)[0-9]{4} ?[0-9]{6}\b",
    "dob": r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-](?:19|20)[0-9]{2}\b",
    "postcode_uk": r"\b[A-Z]{1,2}[0-9]{1,2}[A-Z]? ?[0-9][A-Z]{2}\b",
    "passport": r"(?:[Pp]assport:? ?[0-9]{9}|\b[A-Z][0-9]{7}\b)",
    "card": r"\b[0-9]{13,16}\b",
}

#: Phrases of prompt injection. Our patterns.
INJECTION = (
    r"ignore (?:all |any )?(?:previous|prior|above) instructions",
    r"(?:reveal|show|print) (?:the |your )?(?:system )?prompt",
    r"disregard (?:all |the )?(?:rules|instructions)",
    r"you are now (?:a|an|in) ",
    r"pretend (?:to be|you are)",
    r"jailbreak|developer mode",
    r"</?(?:system|instructions?)>",
)


#: What a text must hold for a type to occur in it. Redaction adds neither digits nor @, so this holds on the redacted text too.
_NEEDS = {"ni_number": "[0-9]{2} ?[0-9]{2} ?[0-9]{2}", "phone_uk": "[0-9]{4} ?[0-9]{6}", "dob": "[/-](?:19|20)[0-9]{2}", "postcode_uk": "[0-9][A-Z]{2}", "passport": "[0-9]{7}", "card": "[0-9]{13}"}
_NEVER = "\u0001never\u0002"


def _may_hold(c: Column, name: str) -> Column:
    return c.contains("@") if name == "email" else c.rlike(_NEEDS[name])


def scrub(c: Column) -> Column:
    """Every type redacted in turn, each on the last one's result; a type that cannot occur costs one cheap search."""
    out = c
    for name, pattern in PII.items():
        out = F.regexp_replace(out, F.when(_may_hold(c, name), F.lit(pattern)).otherwise(F.lit(_NEVER)), F.lit(f"[REDACTED:{name.upper()}]"))
    return out


def pii_types(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_may_hold(c, name) & c.rlike(p), F.lit(name)) for name, p in PII.items()]))


def without_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def sanitise(c: Column) -> Column:
    """Without outer blanks and control characters, in composed form."""
    return nfc(without_controls(F.trim(c)))


def too_long(c: Column, most: int = 4000) -> Column:
    return F.coalesce(F.length(c) > most, F.lit(False))


def injection_score(c: Column) -> Column:
    """Patterns met over 3, at most 1."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.round(F.least(sum(low.rlike(p).cast("int") for p in INJECTION) / 3, F.lit(1.0)), 3)


def threat_level(score: Column, rejected: Column, pii: Column) -> Column:
    return F.when((score >= 0.6) | rejected, "high").when(score > 0, "medium").when(F.size(pii) > 0, "low").otherwise("none")


def security_check(df: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """Sanitised text, injection score, types of personal data, redacted text, threat level, and whether it may pass."""
    out = df.select(key, sanitise(F.col(text)).alias("_t"), too_long(F.col(text), most).alias("rejected"))
    out = out.withColumn("injection_score", injection_score(F.col("_t"))).withColumn("pii", pii_types(F.col("_t")))
    out = out.withColumn("threat", threat_level(F.col("injection_score"), F.col("rejected"), F.col("pii")))
    return out.select(key, "rejected", "injection_score", "pii", scrub(F.col("_t")).alias("scrubbed"), "threat", (~F.col("rejected") & (F.col("injection_score") == 0)).alias("allowed"))


def threat_log(checked: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows of high or medium threat with the first 32 digits of the hash of the text's first 200 characters."""
    return checked.filter(F.col("threat").isin("high", "medium")).select(key, "threat", F.substring(F.sha2(F.substring(text, 1, 200), 256), 1, 32).alias("input_hash"))


def risky_terms(c: Column) -> Column:
    low = F.lower(c)
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in RISKY]))


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def review_score(c: Column) -> Column:
    """8, less 3 below 200 words or 1 above 700, less 2 without a digit."""
    n = words(c)
    return F.lit(8.0) - F.when(n < 200, 3).when(n > 700, 1).otherwise(0) - F.when(c.rlike("[0-9]"), 0).otherwise(2)


def review_quality(score: Column) -> Column:
    return F.when(score >= 7.5, "good").otherwise("warning")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", " ")


# --- extraction -----------------------------------------------------------------------------------------------


#: Role by title, first that fits.
ROLE_PATTERNS = (
    ("ai_safety_researcher", r"safety|alignment"),
    ("ai_product_manager", r"product manager|product owner"),
    ("mlops_engineer", r"ml ?ops|ml platform|ml infrastructure"),
    ("computer_vision_engineer", r"computer vision|perception|\bcv engineer"),
    ("nlp_engineer", r"\bnlp\b|natural language|language engineer"),
    ("research_scientist", r"research (?:scientist|engineer)"),
    ("applied_scientist", r"applied scientist"),
    ("data_engineer", r"data engineer|analytics engineer"),
    ("data_scientist", r"data scien"),
    ("ml_engineer", r"\bml\b|machine learning"),
    ("ai_engineer", r"\bai\b|artificial intelligence|\bllm\b|generative"),
)
LEVEL_PATTERNS = (("principal", r"principal|staff|distinguished"), ("lead", r"\blead\b|head of|manager"), ("senior", r"senior|\bsr\b"), ("junior", r"junior|graduate|intern|entry"), ("mid", r"\bmid"))


def _first(c: Column, patterns, otherwise: str) -> Column:
    low, out = F.lower(c), F.lit(otherwise)
    for name, pattern in reversed(patterns):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def classify_role(title: Column) -> Column:
    return _first(F.coalesce(title, F.lit("")), ROLE_PATTERNS, "other")


def classify_level(title: Column) -> Column:
    return _first(F.coalesce(title, F.lit("")), LEVEL_PATTERNS, "unknown")


def extract_salary(c: Column) -> Column:
    """struct(low, high) from amounts such as £90,000 or £90k; one amount is both."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"£ ?([0-9][0-9,]*(?:\.[0-9]+)?[kK]?)"), F.lit(1))
    number = lambda s: F.regexp_replace(s, "[,kK]", "").cast("double") * F.when(s.rlike("[kK]$"), 1000).otherwise(1)
    pay = F.filter(F.transform(raw, number), lambda x: (x >= 10000) & (x <= 1000000))
    return F.struct(F.array_min(pay).alias("low"), F.array_max(pay).alias("high"))


def offers_sponsorship(c: Column) -> Column:
    """True, false, or null where nothing is said."""
    low = F.lower(c)
    return F.when(low.rlike(r"(?:no|not|unable to|cannot)[^.]{0,30}sponsor"), False).when(low.rlike(r"(?:visa|sponsor)\w*[^.]{0,40}(?:available|offered|provided|considered)|(?:offer|provide)s?[^.]{0,20}sponsor"), True)


def citizens_only(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"(?:citizens? only|security clearance|must be a [a-z]+ citizen|\bsc cleared)"), F.lit(False))


def is_startup(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(r"start-?up|series [a-d]\b|seed(?:-| )(?:stage|funded|round)|venture-backed"), F.lit(False))


# --- CVs ------------------------------------------------------------------------------------------------------

SECTION = r"(?im)^[ \t]*(summary|profile|experience|employment|education|skills|projects|certifications|publications)[ \t]*:?[ \t]*$"
GRADES = ((90, "A+"), (80, "A"), (70, "B"), (60, "C"), (0, "D"))
VERBS = ("led", "built", "deployed", "reduced", "improved", "managed", "delivered", "architected", "trained", "designed", "launched")


def sections(c: Column) -> Column:
    """Section name in lower case to its text; what comes before the first header is preamble."""
    marked = F.regexp_replace(F.concat(F.lit("preamble\u0002"), c), SECTION, "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.struct(F.lower(F.split(p, "\u0002")[0]).alias("k"), strip(F.element_at(F.split(p, "\u0002"), 2)).alias("v")))
    kept = F.filter(parts, lambda p: (p["v"] != "") | (p["k"] != "preamble"))
    first = F.transform(F.array_distinct(F.transform(kept, lambda p: p["k"])), lambda k: F.struct(k.alias("key"), F.array_join(F.transform(F.filter(kept, lambda p: p["k"] == k), lambda p: p["v"]), "\n").alias("value")))
    return F.map_from_entries(first)


def years_of_experience(c: Column, today: int) -> Column:
    """From the earliest year named to the latest, or to today if only one is; null without any."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    years = F.filter(years, lambda y: y <= today)
    low, high = F.array_min(years), F.array_max(years)
    return F.when(F.size(years) > 0, F.when(low == high, today - low).otherwise(high - low)).cast("double")


def contact_flags(c: Column) -> Column:
    low = F.lower(c)
    return F.struct(c.rlike(PII["email"]).alias("has_email"), c.rlike(PII["phone_uk"]).alias("has_phone"), low.contains("linkedin.com/").alias("has_linkedin"), low.contains("github.com/").alias("has_github"))


@F.pandas_udf(T.DoubleType())
def reading_grade(s: pd.Series) -> pd.Series:
    """Flesch-Kincaid grade; null for a text without words."""
    import re

    vowels = re.compile(r"[aeiouy]+")

    def grade(text):
        found = re.findall(r"[A-Za-z]+", text or "")
        if not found:
            return None
        said = max(1, len([x for x in re.split(r"[.!?]+", text) if x.strip()]))
        syllables = sum(max(1, len(vowels.findall(w.lower()))) for w in found)
        return 0.39 * len(found) / said + 11.8 * syllables / len(found) - 15.59

    return s.map(grade).astype("float64")


def _issue(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))


def grade(total: Column) -> Column:
    letter = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES[:-1]):
        letter = F.when(total >= least, name).otherwise(letter)
    return letter


def ats_scores(cvs: DataFrame, role_words: Column) -> DataFrame:
    """Adds five scores from 0 to 100, their weighted total, a grade, and what is wrong.

    cvs: raw_text, sections (map), has_email, has_phone, page_count, has_tables, has_images. role_words: words looked for.
    """
    part = lambda k: F.coalesce(F.col("sections")[k], F.lit(""))
    low = F.lower(part("experience"))
    verbs = F.least(sum(low.contains(v).cast("int") for v in VERBS), F.lit(6))
    numbers = part("experience").rlike(r"[0-9]+ ?%|[0-9]+x\b|£ ?[0-9]|\b[0-9]{2,}\+")
    missing = {k: part(k) == "" for k in ("experience", "education", "skills")}
    structure = 100 - sum(F.when(m, 25).otherwise(0) for m in missing.values()) - F.when(numbers, 0).otherwise(10) - F.when(verbs >= 3, 0).otherwise(15 - verbs * 5)
    level = reading_grade("raw_text")
    readability = F.when(level.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.abs(level - 11) * 5)))
    dated = part("experience").rlike(r"(?:19|20)[0-9]{2}")
    few = words(part("skills")) < 2
    complete = 100 - F.when(F.col("has_email"), 0).otherwise(20) - F.when(F.col("has_phone"), 0).otherwise(10) - F.when(dated, 0).otherwise(20) - F.when(few, 20).otherwise(0) - F.when(missing["education"], 15).otherwise(0)
    form = 100 - F.when(F.col("has_tables"), 40).otherwise(0) - F.when(F.col("has_images"), 20).otherwise(0) - F.when(F.col("page_count") > 3, 15).otherwise(0)
    body = F.lower("raw_text")
    keyword = F.when(F.size(role_words) > 0, F.size(F.filter(role_words, lambda w: F.contains(body, F.lower(w)))) / F.size(role_words) * 100).otherwise(0.0)
    at_least_0 = lambda c: F.greatest(c.cast("double"), F.lit(0.0))
    out = cvs.withColumns({"keyword": keyword, "structure": at_least_0(structure), "readability": readability, "completeness": at_least_0(complete), "format": at_least_0(form)})
    total = F.round(0.3 * F.col("keyword") + 0.25 * F.col("structure") + 0.15 * F.col("readability") + 0.2 * F.col("completeness") + 0.1 * F.col("format"), 1)
    issues = F.array_compact(
        F.array(
            *[_issue(m, f"no {k} section") for k, m in missing.items()],
            _issue(~numbers, "no numbers or metrics in the experience"),
            _issue(~F.col("has_email"), "no email address"),
            _issue(~dated, "no dates in the experience"),
            _issue(few, "few skills listed"),
            _issue(F.col("has_tables"), "tables in the layout"),
            _issue(F.col("has_images"), "images or graphics in the layout"),
            _issue(F.col("page_count") > 3, "too many pages"),
        )
    )
    return out.withColumns({"total": total, "grade": grade(total), "issues": issues})


def gap_plan(gaps: DataFrame) -> DataFrame:
    """Priority demand x salary x recency (each 0 to 1) of each missing skill, and when to learn it: thirds by priority."""
    from pyspark.sql import Window

    out = gaps.withColumn("priority_score", F.round(F.col("demand") * F.col("salary") * F.col("recency"), 6))
    third = F.ntile(3).over(Window.partitionBy("person").orderBy(F.desc("priority_score"), "skill"))
    return out.withColumn("horizon", F.element_at(F.array(F.lit("short"), F.lit("mid"), F.lit("long")), third))


def session_token(seed: Column) -> Column:
    """32 hexadecimal digits, new at every evaluation."""
    return F.substring(F.sha2(F.concat(seed, F.uuid()), 256), 1, 32)


def is_ai_role(title: Column, description: Column) -> Column:
    from tidemark.functions.vocabulary import AI_KEYWORDS

    return any_keyword(F.concat_ws(" ", title, description), AI_KEYWORDS)
