"""Text, stores, windows, quality and page queries over the driver tables, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.functions import skills
from tidemark.functions import text as t
from tidemark.operators import quality, similarity, sketches, stores, timeline
from tidemark.operators.keyed import replaced, temporary
from tidemark.sources.binding import CTE, jobs
from tidemark.sources.landed import links
from tidemark.sources.tables import table
from tidemark.tables import write_table


#: Longer turns count as rejected input.
LONGEST = 900
#: A taxonomy over the prose of the driver's conversations.
PROSE = (("Article", "word", ("the", "la", "le")), ("Of the", "phrase", ()), ("And the", "phrase", ("et la",)), ("est", "word", ()), ("erth th st", "phrase", ()))


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- text -----------------------------------------------------------------------------------------------------


def pii_scrub(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.sha2(t.scrub(F.col("text")), 256).alias("scrubbed_sha256"), F.array_join(t.pii_types(F.col("text")), ",").alias("pii"))


def injection_scores(spark, sf):
    turns = table(spark, sf, "conversations")
    score = t.injection_score(F.col("text"))
    return turns.select("conv_id", "turn", score.alias("score"), t.threat_level(score, t.too_long(F.col("text"), LONGEST), F.array().cast("array<string>")).alias("threat"))


def threat_entries(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    checked = t.security_check(turns, "id", "text", LONGEST).join(turns.select("id", "text"), "id")
    return t.threat_log(checked, "id", F.col("text"))


def risky_terms(spark, sf):
    found = t.risky_terms(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("terms"))


def draft_review(spark, sf):
    score = t.review_score(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", score.alias("score"), t.review_quality(score).alias("quality"))


def control_characters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(t.without_controls(F.col("text"))).alias("n_clean"))


def dedup_hashes(spark, sf):
    cust = table(spark, sf, "customer")
    return cust.select("c_custkey", c.dedup_hash(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("dedup_hash"))


def exact_copies(spark, sf):
    docs = table(spark, sf, "documents")
    return similarity.exact_groups(docs, "doc_id", F.sha2("text", 256)).filter("first < doc_id")


def posting_classes(spark, sf):
    """X7 over conversations' texts: each turn with the least turn of its class, both as conv_id:turn."""
    return turn_classes(table(spark, sf, "conversations"))


def turn_classes(turns):
    """Turns are numbered in order of (conv_id, turn), so that no two share a number however long a conversation is."""
    ordered = turns.select("conv_id", "turn", "text").orderBy("conv_id", "turn", "text")
    numbered = write_table(ordered.withColumn("n", F.monotonically_increasing_id()), "turns")
    names = numbered.select("n", F.concat_ws(":", "conv_id", "turn").alias("id"))
    found = similarity.three_signals(numbered, "n", "text").join(names, "n")
    return found.join(names.toDF("first", "name"), "first").select("id", F.col("name").alias("first"))


def document_classes(spark, sf):
    """X7 with all three signals over documents, whose vectors are those of their number: each with the least of its class."""
    return vector_classes(table(spark, sf, "documents"), table(spark, sf, "embeddings"), 0.95)


def vector_classes(docs, vectors, least):
    """A vector without a document ties no documents together."""
    keyed = vectors.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    known = keyed.join(docs.select(F.col("doc_id").alias("key")), "key", "left_semi")
    return similarity.three_signals(docs, "doc_id", "text", known, least)


def near_vectors(spark, sf):
    """Pairs of any two vectors, of whatever labels, with cosine 0.3 or more."""
    return similarity.all_cosine_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.3)


def salary_display(spark, sf):
    orders = table(spark, sf, "orders")
    low = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    high = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") + 1000)
    return orders.select("o_orderkey", c.salary_display(F.floor(low).cast("double"), F.floor(high).cast("double")).alias("display"), F.round(c.midpoint(low, high), 2).alias("mid"))


def skill_mentions_in_text(spark, sf):
    """Gate 1 of skill extraction, over conversations: words of the prose stand in for aliases."""
    turns = table(spark, sf, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return skills.extract(turns, "id", "text", PROSE).groupBy("skill", "skill_category").agg(F.count("*").alias("n"))


# --- pages ----------------------------------------------------------------------------------------------------


def page_links(spark, sf):
    return links(table(spark, sf, "pages"), "page_id", "html", "url", None)


# --- events: stores, windows ----------------------------------------------------------------------------------

_DAY = "timestamp_ntz'2024-01-15 00:00:00'"


def _hits(spark, sf):
    return table(spark, sf, "events")


def events_by_key(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return _hits(spark, sf).groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def seen_store(spark, sf):
    """K8: a store of what was seen before the 15th, merged with that day's batch."""
    e = _hits(spark, sf)
    old = e.filter(F.expr(f"ts < {_DAY}")).groupBy(F.col("user_id").alias("dedup_hash")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("times_seen"))
    batch = e.filter(F.expr(f"ts >= {_DAY} and ts < {_DAY} + interval 1 day")).select(F.col("user_id").alias("dedup_hash"))
    store = temporary(old, ["dedup_hash"])
    store.merge(batch, lambda rows, new: stores.mark_seen(rows, new, F.expr(_DAY)))
    return store.read()


def new_within_ttl(spark, sf):
    """The batch's first rows of a user and type that were not seen within 3 days."""
    e = _hits(spark, sf).withColumn("dedup_hash", F.concat_ws(":", "user_id", "event_type"))
    seen = e.filter(F.expr(f"ts < {_DAY}")).groupBy("dedup_hash").agg(F.max("ts").alias("last_seen"))
    batch = e.filter(F.expr(f"ts >= {_DAY} and ts < {_DAY} + interval 1 day"))
    return stores.filter_new(batch, seen, F.expr(_DAY), [F.col("ts"), F.col("event_id")], 3).select("event_id", "user_id")


def weekly_dedup(spark, sf):
    """The first event of each ISO week, user and type."""
    e = _hits(spark, sf).withColumn("week", c.iso_week(F.col("ts")))
    return e.groupBy("week", "user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("week", "user_id", "event_type", F.col("f.event_id").alias("event_id"))


def upsert_postings(spark, sf):
    """K1: orders before 2001 as the store, all of 2001 and every tenth older one as the batch."""
    o = table(spark, sf, "orders")
    old = o.filter("o_orderdate < timestamp_ntz'2001-01-01'").select("o_orderkey", "o_totalprice", F.col("o_orderdate").alias("scraped_at"))
    batch = o.filter("o_orderdate >= timestamp_ntz'2001-01-01' or o_orderkey % 10 = 0").select("o_orderkey", F.lit(0.0).alias("o_totalprice"), F.expr("timestamp_ntz'2001-12-01'").alias("scraped_at"))
    store = temporary(old, ["o_orderkey"])
    store.merge(batch, lambda rows, new: stores.upsert_first_wins(rows, new, "o_orderkey", ("scraped_at",)))
    return store.read()


def upsert_history(spark, sf):
    """K4, K5: monthly pay by customer segment up to 1998, then the months from June 1998 on, computed anew and doubled, written over them; last write wins."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    month = F.date_trunc("month", "o_orderdate").cast("date")
    monthly = lambda rows, times: rows.groupBy(month.alias("month"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice") * times, 2).alias("top"))
    store = temporary(monthly(joined.filter("o_orderdate < timestamp_ntz'1999-01-01'"), 1), ["month", "segment"])
    store.merge(monthly(joined.filter("o_orderdate >= timestamp_ntz'1998-06-01'"), 2), lambda rows, new: replaced(rows, new, ["month", "segment"]))
    return store.read()


def touched(spark, sf):
    """K2: customers with a posting since July 2001 are touched."""
    cust = table(spark, sf, "customer").select("c_custkey", F.expr("timestamp_ntz'2000-01-01'").alias("scraped_at"))
    keys = table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'2001-07-01'").select(F.col("o_custkey").alias("c_custkey"))
    store = temporary(cust, ["c_custkey"])
    store.merge(keys, lambda rows, new: stores.touch(rows, new, "c_custkey", "scraped_at", F.expr("timestamp_ntz'2001-08-02'")))
    return store.read()


def insert_ignored(spark, sf):
    """Names that are not there yet."""
    have = table(spark, sf, "part").filter("p_size <= 25").select("p_name", "p_type").dropDuplicates(["p_name", "p_type"])
    first = have.groupBy("p_name").agg(F.min("p_type").alias("p_type"))
    store = temporary(first, ["p_name"])
    store.merge(table(spark, sf, "part").select("p_name", "p_type"), lambda rows, new: stores.append_unknown(rows, new, ["p_name"]))
    return store.read()


def roles_filled(spark, sf):
    """A role only where there is none."""
    return stores.backfill(jobs(spark, sf), "role_category", F.lit("other")).select("job_id", "role_category")


def expired_entries(spark, sf):
    """Orders as cache entries that live for 30 days, as of August 2001."""
    cache = table(spark, sf, "orders").select("o_orderkey", F.expr("o_orderdate + interval 30 days").alias("expires_at"))
    return stores.expired(cache, F.expr("timestamp_ntz'2001-08-02'"))


def run_log(spark, sf):
    """K9: state of each run (a user's day) from its events."""
    e = _hits(spark, sf)
    log = e.select(F.concat_ws("-", "user_id", F.date_format("ts", "dd")).alias("run_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "success").otherwise("running").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("figure"))
    return stores.runs(log)


def rolling_yields(spark, sf):
    """Per user and day the last four daily counts, and three empty days in a row."""
    days = _hits(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last4 = Window.partitionBy("user_id").orderBy("day").rowsBetween(-3, 0)
    return days.select("user_id", "day", F.array_join(F.transform(F.collect_list("n").over(last4), lambda x: x.cast("string")), ",").alias("last_four"), F.round(F.avg("n").over(last4), 4).alias("mean"))


def _timed(spark, sf):
    return _hits(spark, sf).withColumn("at", F.unix_micros(F.to_timestamp("ts")))


def rate_limiter(spark, sf):
    """Sliding window: an event is allowed below 3 earlier ones of its user within 6 hours; denied ones count too."""
    found = timeline.hits_before(_timed(spark, sf).select("event_id", "user_id", "at"), "user_id", "at", 6 * 3600 * 10**6)
    return found.select("event_id", "user_id", F.col("n").alias("before"), (F.col("n") < 3).alias("allowed"))


def sessions(spark, sf):
    """Sessions that end after 12 quiet hours."""
    marked = timeline.sessions(_timed(spark, sf).select("user_id", "at", "event_id", "ts"), "user_id", "at", "event_id", 12 * 3600 * 10**6)
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def cost_alerts(spark, sf):
    daily = _hits(spark, sf).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("cost"))
    return quality.cost_alerts(daily, "event_type", "day", "cost", 4, 1.2)


def adoption_lag(spark, sf):
    """Days from a type's first event of a user to the user's first purchase, mean by type (42 where nobody purchased)."""
    first = _hits(spark, sf).groupBy("user_id", "event_type").agg(F.min("ts").alias("seen"))
    bought = first.filter("event_type = 'purchase'").select("user_id", F.col("seen").alias("bought"))
    lag = F.datediff("bought", "seen")
    return first.filter("event_type <> 'purchase'").join(bought, "user_id", "left").groupBy("event_type").agg(F.coalesce(F.round(F.avg(lag), 4), F.lit(42.0)).alias("lag_days"))


# --- quality --------------------------------------------------------------------------------------------------


def integrity(spark, sf):
    docs = table(spark, sf, "documents").withColumn("maybe", F.when(F.col("doc_id") % 7 != 0, F.col("source")))
    return quality.integrity(docs, ("doc_id", "maybe"), "n_chars", 10, 20000, ("text",), "text", 40)


def psi(spark, sf):
    o = table(spark, sf, "orders")
    return quality.psi(o.filter("o_orderdate < timestamp_ntz'1998-01-01'"), o.filter("o_orderdate >= timestamp_ntz'1998-01-01'"), "o_totalprice", 0, 500000)


def sketch_drift(spark, sf):
    """Drift of order values from 1998 on against the years before, and customers of both, out of sketches by day merged over weeks."""
    days = write_table(sketches.daily(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_custkey"), "sketches")
    weeks = sketches.merged(days, (F.date_trunc("week", "day").cast("date").alias("week"),))
    old, new = (sketches.merged(weeks.filter(f"week {side} date'1998-01-05'")) for side in ("<", ">="))
    told = lambda df, name: df.select(F.col("n").alias(f"n_{name}"), sketches.distinct("items").alias(f"customers_{name}"), F.round(sketches.quantile("quantiles", 0.5), 2).alias(f"median_{name}"))
    return sketches.drift(old, new).crossJoin(told(old, "before")).crossJoin(told(new, "after"))  # a row each


def ops_status(spark, sf):
    e = _hits(spark, sf).groupBy("user_id").agg((F.sum("value") > 3000).alias("cost_over"), (F.count_if(F.col("event_type") == "error") > 18).alias("pipeline_failed"), (F.count_if(F.col("event_type") == "signup") > 14).alias("infra_down"))
    return quality.ops_status(e).select("user_id", F.array_join("issues", ",").alias("issues"), "status")


QUERIES = {
    f.__name__: f
    for f in (
        pii_scrub, injection_scores, threat_entries, risky_terms, draft_review, control_characters, dedup_hashes, exact_copies, posting_classes, document_classes, near_vectors, salary_display, skill_mentions_in_text, page_links,
        events_by_key, seen_store, new_within_ttl, weekly_dedup, upsert_postings, upsert_history, touched, insert_ignored, roles_filled, expired_entries, run_log, rolling_yields, rate_limiter, sessions, cost_alerts, adoption_lag,
        integrity, psi, sketch_drift, ops_status,
    )
}


def _scrub_sql(column: str) -> str:
    for name, pattern in t.PII.items():
        column = f"regexp_replace({column}, {_quote(pattern)}, '[REDACTED:{name.upper()}]', 'g')"
    return column


_PII_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_quote(p)}) THEN '{n}' END" for n, p in t.PII.items()) + "], lambda x: x IS NOT NULL), ',')"
_INJ_SQL = "round(least((" + " + ".join(f"regexp_matches(lower(text), {_quote(p)})::INT" for p in t.INJECTION) + ")::DOUBLE / 3, 1.0), 3)"
_RISKY_SQL = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in t.RISKY) + "], lambda x: x IS NOT NULL), ',')"
_THREAT = f"CASE WHEN score >= 0.6 OR length(text) > {LONGEST} THEN 'high' WHEN score > 0 THEN 'medium'"
_D = "TIMESTAMP '2024-01-15'"
_ALIAS = ", ".join(f"({_quote(a)}, {_quote(name)}, {_quote(cat)})" for name, cat, aliases in PROSE for a in sorted({name.lower(), *aliases}))
_US = "epoch_us(ts)"
ORACLES = {
    "pii_scrub": f"SELECT doc_id, sha256({_scrub_sql('text')}) AS scrubbed_sha256, {_PII_SQL} AS pii FROM documents",
    "injection_scores": f"WITH s AS (SELECT *, {_INJ_SQL} AS score FROM conversations) SELECT conv_id, turn, score, {_THREAT} ELSE 'none' END AS threat FROM s",
    "threat_entries": f"""WITH s AS (SELECT conv_id || ':' || turn AS id, text, regexp_replace(trim(text, ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS clean FROM conversations),
        r AS (SELECT id, text, length(text) > {LONGEST} AS long, {_INJ_SQL.replace('lower(text)', 'lower(clean)')} AS score FROM s), v AS (SELECT *, CASE WHEN score >= 0.6 OR long THEN 'high' WHEN score > 0 THEN 'medium' END AS threat FROM r)
        SELECT id, threat, substr(sha256(substr(text, 1, 200)), 1, 32) AS input_hash FROM v WHERE threat IS NOT NULL""",
    "risky_terms": f"SELECT conv_id, turn, {_RISKY_SQL} AS terms FROM conversations",
    "draft_review": """WITH w AS (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents),
        s AS (SELECT doc_id, 8.0::DOUBLE - CASE WHEN n < 200 THEN 3 WHEN n > 700 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(text, '[0-9]') THEN 0 ELSE 2 END AS score FROM w)
        SELECT doc_id, score, CASE WHEN score >= 7.5 THEN 'good' ELSE 'warning' END AS quality FROM s""",
    "control_characters": "SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'))::INT AS n_clean FROM documents",
    "dedup_hashes": "SELECT c_custkey, substr(sha256(lower(trim(c_name)) || '|' || lower(trim(c_mktsegment)) || '|' || c_nationkey), 1, 16) AS dedup_hash FROM customer",
    "exact_copies": "SELECT * FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE first < doc_id",
    "near_vectors": """WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)
        SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.3""",
    "salary_display": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS low, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice + 1000 END AS high FROM orders),
        f AS (SELECT *, '£' || format('{:,}', floor(low)::BIGINT) AS a, '£' || format('{:,}', floor(high)::BIGINT) AS b FROM o)
        SELECT o_orderkey, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN a || '–' || b WHEN low IS NOT NULL THEN 'From ' || a WHEN high IS NOT NULL THEN 'Up to ' || b ELSE 'Not disclosed' END AS display,
        round(CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN (low + high) / 2 ELSE coalesce(high, low) END, 2) AS mid FROM f""",
    "skill_mentions_in_text": f"""WITH k(alias, skill, skill_category) AS (VALUES {_ALIAS}),
        tk AS (SELECT conv_id || ':' || turn AS id, list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}+#./-]*'), lambda x: regexp_replace(x, '[./-]+$', '')) AS t FROM conversations),
        g AS (SELECT DISTINCT id, unnest(list_concat(list_concat(t, list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i+1], ' '))), list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')))) AS alias FROM tk)
        SELECT skill, skill_category, count(DISTINCT id) AS n FROM g JOIN k USING (alias) GROUP BY 1, 2""",
    "page_links": """WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\\b[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>'), 1) AS pos FROM pages),
        b AS (SELECT page_id, pos, regexp_extract(a, '(?is)href=["'']([^"'']+)["'']', 1) AS h, trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text, regexp_extract(url, '^(https?://[^/]+)', 1) AS root FROM a),
        d AS (SELECT page_id, CASE WHEN starts_with(h, '/') THEN root || h ELSE h END AS href, arg_min(text, pos) AS text, min(pos) AS pos FROM b WHERE length(text) BETWEEN 5 AND 100 GROUP BY 1, 2)
        SELECT page_id, rank::INT AS rank, href, text FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM d) WHERE rank <= 15""",
    "events_by_key": "SELECT event_type, sum((props::JSON->>'$.k')::INT)::BIGINT AS k_sum, max((props::JSON->>'$.k')::INT) AS k_max FROM events GROUP BY 1",
    "seen_store": f"""SELECT user_id AS dedup_hash, coalesce(min(ts) FILTER (ts < {_D}), {_D}) AS first_seen, CASE WHEN count(*) FILTER (ts >= {_D}) > 0 THEN {_D} ELSE max(ts) END AS last_seen, count(*) AS times_seen
        FROM events WHERE ts < {_D} + INTERVAL 1 DAY GROUP BY 1""",
    "new_within_ttl": f"""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts >= {_D} AND ts < {_D} + INTERVAL 1 DAY) WHERE n = 1
        AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE ts < {_D} GROUP BY user_id, event_type HAVING max(ts) > {_D} - INTERVAL 3 DAY)""",
    "weekly_dedup": "SELECT strftime(ts, '%G:%V') AS week, user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2, 3",
    "upsert_postings": """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' THEN o_totalprice ELSE 0.0 END AS o_totalprice,
        CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' OR o_orderkey % 10 = 0 THEN TIMESTAMP '2001-12-01' ELSE o_orderdate END AS scraped_at FROM orders""",
    "upsert_history": """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
        SELECT month, segment, n, round(top * CASE WHEN month >= DATE '1998-06-01' THEN 2 ELSE 1 END, 2) AS top FROM m""",
    "touched": "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01') THEN TIMESTAMP '2001-08-02' ELSE TIMESTAMP '2000-01-01' END AS scraped_at FROM customer",
    "insert_ignored": """WITH h AS (SELECT p_name, min(p_type) AS p_type FROM part WHERE p_size <= 25 GROUP BY 1) SELECT * FROM h
        UNION ALL SELECT p_name, min(p_type) FROM part WHERE p_name NOT IN (SELECT p_name FROM h) GROUP BY 1""",
    "roles_filled": f"WITH {CTE} SELECT job_id, coalesce(role_category, 'other') AS role_category FROM jobs",
    "expired_entries": "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS expires_at FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '2001-08-02'",
    "run_log": """WITH l AS (SELECT user_id || '-' || strftime(ts, '%d') AS run_id, ts AS t, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' ELSE 'running' END AS status, CASE WHEN event_type = 'purchase' THEN value END AS figure FROM events)
        SELECT run_id, min(t) AS started_at, max(t) FILTER (status <> 'running') AS completed_at, arg_max(status, t) AS status, arg_max(figure, t) FILTER (figure IS NOT NULL) AS figure FROM l GROUP BY 1""",
    "rolling_yields": """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT user_id, day, array_to_string(list(n) OVER w, ',') AS last_four, round(avg(n) OVER w, 4) AS mean FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "rate_limiter": f"""SELECT event_id, user_id, before, before < 3 AS allowed FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY {_US} RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) AS before FROM events)""",
    "sessions": f"""WITH g AS (SELECT *, coalesce(({_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 43200000000, true)::INT AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS events, min(ts) AS start, max(ts) AS "end" FROM s GROUP BY 1, 2""",
    "cost_alerts": """WITH d AS (SELECT event_type, ts::DATE AS day, round(sum(value), 4) AS cost FROM events GROUP BY 1, 2),
        u AS (SELECT *, round(avg(cost) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 4) AS usual FROM d) SELECT *, coalesce(cost > 1.2 * usual, false) AS over FROM u""",
    "adoption_lag": """WITH f AS (SELECT user_id, event_type, min(ts) AS seen FROM events GROUP BY 1, 2), b AS (SELECT user_id, seen AS bought FROM f WHERE event_type = 'purchase')
        SELECT event_type, coalesce(round(avg(bought::DATE - seen::DATE), 4), 42.0) AS lag_days FROM f LEFT JOIN b USING (user_id) WHERE event_type <> 'purchase' GROUP BY 1""",
    "integrity": """WITH d AS (SELECT *, CASE WHEN doc_id % 7 <> 0 THEN source END AS maybe FROM documents), c AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS copies FROM (SELECT count(*) AS n FROM d GROUP BY text))
        SELECT count(*) AS total_rows, round(avg((doc_id IS NULL)::INT), 6) AS null_doc_id, round(avg((maybe IS NULL)::INT), 6) AS null_maybe, count(*) FILTER (n_chars NOT BETWEEN 10 AND 20000) AS out_of_range,
        count(*) FILTER (length(coalesce(text, '')) < 40) AS short_texts, any_value(copies) AS copies FROM d, c""",
    "psi": """WITH b AS (SELECT least(greatest(floor(o_totalprice / 500000 * 10), 0), 9)::INT AS bin, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders),
        n AS (SELECT bin, coalesce(nullif(count(*) FILTER (old), 0)::DOUBLE, 0.5) AS e, coalesce(nullif(count(*) FILTER (NOT old), 0)::DOUBLE, 0.5) AS a FROM (SELECT * FROM b UNION ALL SELECT range::INT, NULL FROM range(10)) GROUP BY 1),
        s AS (SELECT e / sum(e) OVER () AS e, a / sum(a) OVER () AS a FROM n), v AS (SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM s) SELECT psi, psi > 0.2 AS drifted FROM v""",
    "ops_status": """WITH u AS (SELECT user_id, sum(value) > 3000 AS c, count(*) FILTER (event_type = 'error') > 18 AS p, count(*) FILTER (event_type = 'signup') > 14 AS i FROM events GROUP BY 1)
        SELECT user_id, concat_ws(',', CASE WHEN c THEN 'COST_OVERRUN' END, CASE WHEN p THEN 'PIPELINE_FAILURE' END, CASE WHEN i THEN 'INFRA_DEGRADED' END) AS issues,
        CASE WHEN c OR p THEN 'poor' WHEN i THEN 'warning' ELSE 'good' END AS status FROM u""",
}
