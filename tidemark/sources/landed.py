"""Landed payloads of job boards, career pages and files as DataFrames of one schema.

Fetching is not a query; payloads are files that a fetcher left behind. Every parser is a projection
over `spark.read` or over a column that holds a payload.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable
from functools import reduce
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import any_keyword
from tidemark.functions.text import strip_html
from tidemark.functions.vocabulary import AI_KEYWORDS

POSTING = "job_id string, title string, company string, location string, description string, url string, source string, work_model string"
GREENHOUSE = "jobs array<struct<id:string,title:string,location:struct<name:string>,content:string,absolute_url:string>>"
LEVER = "array<struct<id:string,text:string,workplaceType:string,descriptionPlain:string,hostedUrl:string>>"
ASHBY = "jobs array<struct<id:string,title:string,location:string,department:string,descriptionHtml:string,description:string,organizationName:string,jobUrl:string>>"
LONGEST = 8000
LINKS = 15
#: The eight kinds of source that a collection run draws on.
SOURCES = ("adzuna", "reed", "wellfound", "ats_direct", "career_pages", "funding_news", "recruiter_boards", "specialist_boards")


def job_id(prefix: str, ident: Column, url: Column) -> Column:
    """Prefix and id, or a stable hash of the address where there is none."""
    return F.concat(F.lit(prefix), F.coalesce(ident, F.abs(F.xxhash64(url)).cast("string")))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files whole: board (the file's name without extension) and payload."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("board"), F.col("value").alias("payload"))


def _posting(df: DataFrame, prefix: str, ident, title, company, location, description, url, source, model=None) -> DataFrame:
    low = F.lower(F.coalesce(location, F.lit("")))
    kind = model if model is not None else F.when(low.contains("remote"), "remote").when(low.contains("hybrid"), "hybrid").otherwise("unknown")
    return df.select(
        job_id(prefix, ident, url).alias("job_id"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(company, F.lit("")).alias("company"), F.coalesce(location, F.lit("")).alias("location"),
        F.substring(F.coalesce(description, F.lit("")), 1, LONGEST).alias("description"), F.coalesce(url, F.lit("")).alias("url"), F.lit(source).alias("source"), kind.alias("work_model"),
    )


def greenhouse(df: DataFrame) -> DataFrame:
    """df: board, payload. A payload that is no such JSON yields nothing."""
    rows = df.select("board", F.explode(F.from_json("payload", GREENHOUSE)["jobs"]).alias("j"))
    return _posting(rows, "gh_", F.col("j.id"), F.col("j.title"), F.col("board"), F.col("j.location.name"), strip_html(F.col("j.content")), F.col("j.absolute_url"), "greenhouse")


def lever(df: DataFrame) -> DataFrame:
    rows = df.select("board", F.explode(F.from_json("payload", LEVER)).alias("j"))
    model = F.lower(F.coalesce("j.workplaceType", F.lit("unknown")))
    return _posting(rows, "lv_", F.col("j.id"), F.col("j.text"), F.col("board"), F.lit("UK"), F.col("j.descriptionPlain"), F.col("j.hostedUrl"), "lever", model)


def ashby(df: DataFrame) -> DataFrame:
    rows = df.select("board", F.explode(F.from_json("payload", ASHBY)["jobs"]).alias("j"))
    text = F.coalesce(F.nullif("j.descriptionHtml", F.lit("")), F.col("j.description"))
    return _posting(rows, "ab_", F.col("j.id"), F.col("j.title"), F.coalesce("j.organizationName", "board"), F.col("j.location"), strip_html(text), F.col("j.jobUrl"), "ashby")


def fan_in(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ai_roles(postings: DataFrame) -> DataFrame:
    return postings.filter(any_keyword(F.concat_ws(" ", "title", "description"), AI_KEYWORDS))


def company_of(url: Column) -> Column:
    """The path's part after /company/, in title case; Unknown Startup without one."""
    part = F.regexp_extract(url, r"/company/([^/?#]+)", 1)
    return F.when(part != "", F.initcap(F.replace(part, F.lit("-"), F.lit(" ")))).otherwise("Unknown Startup")


def first_of_copies(postings: DataFrame, order: list[Column]) -> DataFrame:
    """The first posting of each title and company, whatever the case."""
    key = Window.partitionBy(F.lower("title"), F.lower("company")).orderBy(*order)
    return postings.withColumn("_n", F.row_number().over(key)).filter("_n = 1").drop("_n")


def scout(results: DataFrame, site: str, order: list[Column]) -> DataFrame:
    """Search results (title, description, url) of one site as postings of start-ups: the first of each title and company."""
    rows = results.filter(F.col("url").contains(site) & (F.trim("title") != "")).withColumns({"title": F.trim("title"), "company": company_of(F.col("url"))})
    first = first_of_copies(rows, order)
    out = _posting(first, "wf_", F.lit(None).cast("string"), F.col("title"), F.col("company"), F.lit("UK"), F.col("description"), F.col("url"), "wellfound")
    return out.withColumn("is_startup", F.lit(True))


def watchlist(known: DataFrame, seeds: DataFrame, k: int = 80) -> DataFrame:
    """Known companies and the seeds not among them (whatever the case), by last yield, the first k."""
    new = seeds.withColumn("low", F.lower("company")).join(known.select(F.lower("company").alias("low")), "low", "left_anti").drop("low")
    return known.unionByName(new, allowMissingColumns=True).orderBy(F.coalesce("last_yield", F.lit(0)).desc(), "company").limit(k)


def jsonld(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Postings in ld+json scripts (an object or a list) whose title names an AI role."""
    script = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("s")
    shape = "array<struct<`@type`:string,title:string,description:string,url:string>>"
    as_list = F.when(F.trim("s").startswith("["), F.col("s")).otherwise(F.concat(F.lit("["), F.col("s"), F.lit("]")))
    rows = pages.select(F.col(key).alias(key), script).select(key, F.explode(F.from_json(as_list, shape)).alias("j"))
    return rows.filter(F.col("j.`@type`").isin("JobPosting", "jobPosting") & any_keyword(F.col("j.title"), AI_KEYWORDS)).select(
        key, F.col("j.title").alias("title"), strip_html(F.col("j.description")).alias("description"), F.col("j.url").alias("url")
    )


def links(pages: DataFrame, key: str, html: str, base: str, words: tuple[str, ...] | None = AI_KEYWORDS, k: int = LINKS) -> DataFrame:
    """Anchors whose text has 5 to 100 characters and holds one of the words: per page the first k distinct addresses, joined to the base where they start with a slash."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*?href=["']([^"']+)["'][^>]*>(.*?)</a>"""), F.lit(0))
    rows = pages.select(F.col(key).alias(key), F.col(base).alias("_base"), F.posexplode(found).alias("pos", "a"))
    href = F.regexp_extract("a", r"""(?is)href=["']([^"']+)["']""", 1)
    text = F.trim(F.regexp_replace(strip_html(F.col("a")), r"\s+", " "))
    root = F.regexp_extract("_base", r"^(https?://[^/]+)", 1)
    rows = rows.select(key, "pos", F.when(href.startswith("/"), F.concat(root, href)).otherwise(href).alias("href"), text.alias("text"))
    rows = rows.filter(F.length("text").between(5, 100))
    if words is not None:
        rows = rows.filter(any_keyword(F.col("text"), words))
    first = rows.groupBy(key, "href").agg(F.min(F.struct("pos", "text")).alias("f")).select(key, "href", "f.pos", "f.text")
    order = Window.partitionBy(key).orderBy("pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "rank", "href", "text")


def career_pages(pages: DataFrame, key: str, html: str, base: str) -> DataFrame:
    """Per page its ld+json postings, or its links where it has none."""
    structured = jsonld(pages, key, html).select(key, "title", "url", F.lit("jsonld").alias("strategy"))
    plain = links(pages, key, html, base).select(key, F.col("text").alias("title"), F.col("href").alias("url"), F.lit("links").alias("strategy"))
    return structured.unionByName(plain.join(structured.select(key).distinct(), key, "left_anti"))


def collect(spark: SparkSession, loaders: dict[str, Callable[[SparkSession], DataFrame]], states: dict[str, list[int]], disabled: set[str] = frozenset()) -> DataFrame:
    """The union of the sources that are on: not disabled, and not without yield in their last three runs."""
    on = [name for name in loaders if name not in disabled and not (len(y := states.get(name, [])) >= 3 and not any(y[-3:]))]
    return fan_in([loaders[name](spark) for name in on]) if on else spark.createDataFrame([], POSTING)


# --- files ----------------------------------------------------------------------------------------------------

LARGEST = 5 * 1024 * 1024
#: Times a file's size that its contents may unpack to where that is over LARGEST, and bytes that they may unpack to in any case.
BLOAT, UNPACKED = 100, 10 * LARGEST
SCANNED = T.StructType(
    [T.StructField("allowed", T.BooleanType()), T.StructField("file_type", T.StringType()), T.StructField("rejection_reason", T.StringType()), T.StructField("file_hash", T.StringType()), T.StructField("size_bytes", T.LongType())]
)
PARSED = T.StructType([T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType())])


def scan_bytes(data: bytes | None, largest: int = LARGEST) -> tuple:
    """Whether a CV file may be opened, and why not: by its first bytes, size, and what it carries."""
    data = data or b""
    seen = (hashlib.sha256(data).hexdigest(), len(data))
    reject = lambda reason, kind=None: (False, kind, reason, *seen)
    if not data:
        return reject("empty_file")
    if len(data) > largest:
        return reject("file_too_large")
    if data.startswith(b"%PDF"):
        if b"/Encrypt" in data:
            return reject("pdf_encrypted", "pdf")
        if any(x in data for x in (b"/JavaScript", b"/JS", b"/Launch", b"/EmbeddedFile", b"/OpenAction", b"/AA")):
            return reject("pdf_dangerous_content", "pdf")
        return (True, "pdf", None, *seen)
    if data.startswith(b"PK\x03\x04"):
        try:
            with zipfile.ZipFile(BytesIO(data)) as z:
                names, size = z.namelist(), sum(i.file_size for i in z.infolist())
        except (zipfile.BadZipFile, ValueError, NotImplementedError):
            return reject("docx_corrupt", "docx")
        if any("vbaproject" in n.lower() for n in names):
            return reject("docx_macro_detected", "docx")
        if size > UNPACKED or size > BLOAT * len(data) and size > largest:
            return reject("docx_zipbomb", "docx")
        if "word/document.xml" not in names:
            return reject("docx_corrupt", "docx")
        return (True, "docx", None, *seen)
    return reject("unsupported_file_type")


@F.pandas_udf(SCANNED)
def scan_file(content: pd.Series) -> pd.DataFrame:
    rows = [scan_bytes(c) for c in content]
    return pd.DataFrame(rows, columns=SCANNED.names)


def docx_text(data: bytes) -> str:
    """Paragraphs of a DOCX, a line each."""
    import re
    from html import unescape

    with zipfile.ZipFile(BytesIO(data)) as z:
        xml = z.read("word/document.xml").decode("utf-8", "replace")
    return "\n".join(unescape("".join(re.findall(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", p, re.S))) for p in re.findall(r"<w:p(?:\s[^>]*)?>(.*?)</w:p>", xml, re.S))


def pdf_text(data: bytes) -> str:
    """Strings shown by a PDF's content streams, plain or deflated; a text without layout. Streams that unpack to over UNPACKED bytes raise an error."""
    import re
    import zlib

    out, left = [], UNPACKED
    for body in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            unpacker = zlib.decompressobj()
            body = unpacker.decompress(body, left + 1)
        except zlib.error:
            pass
        left -= len(body)
        if left < 0:
            raise ValueError("the streams unpack to too much")
        for line in re.findall(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:[^\]])*\]\s*TJ", body):
            shown = b"".join(re.findall(rb"\(((?:\\.|[^\\()])*)\)", line))
            out.append(re.sub(rb"\\(.)", rb"\1", shown).decode("latin-1"))
    return "\n".join(out)


@F.pandas_udf(PARSED)
def parse_cv(content: pd.Series, file_type: pd.Series) -> pd.DataFrame:
    rows = []
    for data, kind in zip(content, file_type):
        try:
            rows.append((docx_text(data), None) if kind == "docx" else (pdf_text(data), None) if kind == "pdf" else ("", "unsupported_file_type"))
        except (zipfile.BadZipFile, KeyError, TypeError, ValueError):
            rows.append(("", "corrupt_file"))
    return pd.DataFrame(rows, columns=PARSED.names)


def cv_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder, scanned, and parsed where allowed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    out = raw.withColumn("scan", scan_file("content")).select("path", "content", "scan.*")
    parsed = F.when(F.col("allowed"), parse_cv("content", "file_type"))
    return out.withColumn("cv", parsed).select("path", "allowed", "file_type", "rejection_reason", "file_hash", "size_bytes", "cv.raw_text", "cv.error")
