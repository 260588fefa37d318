"""Queries of messages: exports, digests, live messages, notifications, diagnostics. The test tables hold parsed rows, so
payloads are written from them first and then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.plans.register import Register
from vacantia.plans.texts import _FOLD, _normal
from vacantia.sources import digests, exports, mail, notifications, registry
from vacantia.tables import read

query = Register()

_CLEAN_URLS = f"list_distinct(list_filter(list_transform({{0}}, lambda u: CASE WHEN regexp_matches(u, '^https?://[^/?#]+') THEN {_normal('u')} ELSE '' END), lambda u: u <> ''))"
_VISIBLE = "list_transform(regexp_extract_all(coalesce(raw_text, ''), '(?i)https?://[^\\s<>()]+'), lambda x: regexp_replace(x, '[.,;:!?)\\]}\"'']+$', ''))"
#: The first of a list without repetitions keeps its place; DuckDB's list_distinct doesn't.
_ORDERED = "list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN list_position({0}, {0}[i]) = i THEN {0}[i] END), lambda v: v IS NOT NULL)"
_SPLIT = "list_filter(list_transform(string_split(replace(coalesce(raw_text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _messages(spark, d) -> DataFrame:
    return read(spark, d, "source_messages").distinct()


_STAMP = "CAST(1700000000 + CAST(source_message_id AS BIGINT) * 61 AS BIGINT)"


@query(f"""
WITH m AS (SELECT DISTINCT source_group, source_message_id, raw_text, sender FROM source_messages WHERE regexp_full_match(source_message_id, '[0-9]{{1,9}}') AND raw_text IS NOT NULL),
u AS (SELECT *, list_concat(['https://a.example/' || source_message_id], {_VISIBLE}) AS urls FROM m)
SELECT source_group, source_message_id, strftime(make_timestamp({_STAMP} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS message_date, sender, raw_text, array_to_string({_ORDERED.format('urls')}, ' ') AS urls FROM u""")
def channel_export(spark, d):
    """Messages of every channel, written as export files of at most fifty messages with rich text, links and a service
    record each, and read back."""
    number = F.col("source_message_id").cast("bigint")
    rows = _messages(spark, d).filter("source_message_id rlike '^[0-9]{1,9}$' and raw_text is not null").select("source_group", "source_message_id", "raw_text", "sender").distinct()
    link = F.concat(F.lit("https://a.example/"), F.col("source_message_id"))
    half = (F.length("raw_text") / 2).cast("int")
    head, tail = F.expr("substring(raw_text, 1, int(length(raw_text) / 2))"), F.expr("substring(raw_text, int(length(raw_text) / 2) + 1)")
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    entity = F.to_json(F.struct(F.lit("text_link").alias("type"), tail.alias("text"), link.alias("href")))
    rich = F.concat(F.lit("["), quoted(head), F.lit(","), entity, F.lit("]"))
    text = F.when(half > 0, rich).otherwise(quoted(F.col("raw_text")))
    date = (F.lit(1_700_000_000) + number * 61).cast("string")
    item = F.concat(F.lit('{"id":'), F.col("source_message_id"), F.lit(',"type":"message","date_unixtime":"'), date, F.lit('","from":'), F.coalesce(F.nullif(quoted(F.col("sender")), F.lit("")), F.lit("null")), F.lit(',"text":'), text, F.lit(',"text_entities":['), entity, F.lit("]}"))
    service = F.lit('{"id":-1,"type":"service","action":"pin"}')
    files = rows.groupBy("source_group", F.floor(number / 50).alias("part")).agg(F.concat(F.lit('{"name":"c","type":"public_channel","id":1,"messages":['), service, F.lit(","), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("payload"))
    got = exports.channel_messages(files, F.col("source_group"))
    return got.select("source_group", "source_message_id", "message_date", "sender", "raw_text", F.array_join("urls", " ").alias("urls"))


_FOLDED = _FOLD.replace("lower(coalesce({0}, ''))", "replace(replace(replace(lower(coalesce({0}, '')), 'ß', 'ss'), '…', '...'), 'º', 'o')")
_CHAT = "SELECT DISTINCT source_group, source_message_id, sender, raw_text, length(raw_text) % 28 + 1 AS n FROM source_messages WHERE sender IS NOT NULL AND trim(sender) <> '' AND NOT contains(sender, ': ') AND raw_text IS NOT NULL AND raw_text <> ''"


@query(f"""
WITH m AS ({_CHAT}), o AS (SELECT source_group, '2025-01-' || lpad(CAST(n AS VARCHAR), 2, '0') || 'T10:' || lpad(CAST(n AS VARCHAR), 2, '0') || ':00' AS message_date, sender, rtrim(raw_text) AS raw_text FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY source_group, message_date, {_FOLDED.format('sender')}, {_FOLDED.format('raw_text')} ORDER BY sender, raw_text) AS occurrence FROM o)
SELECT source_group, 'wa_' || sha256({_FOLDED.format('source_group')} || chr(10) || message_date || chr(10) || {_FOLDED.format('sender')} || chr(10) || {_FOLDED.format('raw_text')} || chr(10) || 'occurrence:' || occurrence) AS source_message_id, message_date, count(*) AS messages FROM k GROUP BY ALL""")
def group_export(spark, d):
    """Messages of every group, written as chat exports and read back; ids number equal messages."""
    rows = _messages(spark, d).filter("sender is not null and trim(sender) <> '' and not contains(sender, ': ') and raw_text is not null and raw_text <> ''").select("source_group", "source_message_id", "sender", "raw_text").distinct()
    n = F.length("raw_text") % 28 + 1
    line = F.concat(F.lit("1/"), n.cast("string"), F.lit("/25, 10:"), F.lpad(n.cast("string"), 2, "0"), F.lit(" - "), F.col("sender"), F.lit(": "), F.col("raw_text"))
    # Equal messages must meet in one numbering, whatever file they are in: a file is a hash bucket of a group.
    part = F.pmod(F.xxhash64("source_message_id"), F.lit(16))
    files = rows.groupBy("source_group", part.alias("part")).agg(F.array_join(F.collect_list(line), "\n").alias("payload")).withColumn("path", F.col("part").cast("string"))
    got = exports.group_messages(files, F.col("source_group"))
    return got.groupBy("source_group", "source_message_id", "message_date").agg(F.count("*").alias("messages"))


_LABEL = "nullif(trim(regexp_replace(list_filter(l[2:], lambda x: starts_with(lower(x), '{0}:'))[-1], '^[^:]*:', '')), '')"
_POSTED = _LABEL.format("posted on")
_CHANNEL = f"""
SELECT DISTINCT source_group || '/' || source_message_id AS k, title, company, location, posted_on, job_url, (CASE WHEN title IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN company IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN location IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN posted_on IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN job_url IS NOT NULL THEN 25 ELSE 0 END) / 100.0::DOUBLE AS parse_confidence
FROM (SELECT source_group, source_message_id, CASE WHEN contains(l[1], ' @ ') THEN nullif(trim(regexp_extract(l[1], '^(.*) @ (.*)$', 1)), '') ELSE nullif(l[1], '') END AS title, CASE WHEN contains(l[1], ' @ ') THEN nullif(trim(regexp_extract(l[1], '^(.*) @ (.*)$', 2)), '') END AS company, {_LABEL.format('location')} AS location,
strftime(coalesce(try_strptime({_POSTED}, '%d-%m-%Y'), try_strptime({_POSTED}, '%d/%m/%Y'), try_strptime({_POSTED}, '%Y-%m-%d')), '%Y-%m-%d') AS posted_on, list_filter(list_transform(coalesce(urls, []), lambda u: CASE WHEN regexp_matches(u, '^https?://[^/?#]+') THEN {_normal('u')} ELSE '' END), lambda u: u <> '')[1] AS job_url
FROM (SELECT *, {_SPLIT} AS l FROM source_messages WHERE source = 'telegram') WHERE len(l) > 0)"""


def _digest(jobs: DataFrame) -> DataFrame:
    return jobs.select(F.concat_ws("/", "source_group", "source_message_id").alias("k"), "title", "company", "location", "posted_on", "job_url", "parse_confidence").distinct()


@query(_CHANNEL)
def channel_digest(spark, d):
    return _digest(digests.channel_digest(read(spark, d, "source_messages").filter("source = 'telegram'")))


@query(f"SELECT DISTINCT source_group, source_message_id FROM (SELECT *, {_SPLIT} AS l FROM source_messages) WHERE len(l) > 0 AND contains(l[1], ' @ ') AND len(list_filter(l[2:], lambda x: starts_with(lower(x), 'posted on:'))) > 0 AND len(list_filter(l[2:], lambda x: starts_with(lower(x), 'location:'))) > 0 AND len(coalesce(urls, [])) > 0")
def channel_shape(spark, d):
    return digests.channel_shape(read(spark, d, "source_messages")).select("source_group", "source_message_id").distinct()


_PREVIEW = "(?i)\\b(?:developer|engineer|programmer|software|backend|front[\\s-]?end|full[\\s-]?stack|devops|qa|algorithm|embedded|data\\s+analyst)\\b"
_BARE = "trim(regexp_replace(trim(l[1]), '^\\*(.*)\\*$', '\\1'))"
_SHOWN = f"CASE WHEN {_BARE} <> '' AND length({_BARE}) <= 256 AND NOT contains({_BARE}, '://') AND regexp_matches({_BARE}, '{_PREVIEW}') THEN {_BARE} END"


def _group_sql(source: str, noted: str) -> str:
    return f"""
SELECT DISTINCT source_group || '/' || source_message_id AS k, title, CAST(NULL AS VARCHAR) AS company, CAST(NULL AS VARCHAR) AS location, CASE WHEN today AND u IS NOT NULL THEN substring(message_date, 1, 10) END AS posted_on, u AS job_url,
CASE WHEN u IS NULL THEN 0.35 ELSE (55 + CASE WHEN level THEN 10 ELSE 0 END + CASE WHEN today AND message_date IS NOT NULL THEN 10 ELSE 0 END) / 100.0::DOUBLE END AS parse_confidence
FROM (SELECT *, CASE WHEN u IS NULL THEN CASE WHEN noted AND len(l) = 1 THEN {_SHOWN} END WHEN regexp_full_match(l[1], '\\*(.+)\\*') THEN CASE WHEN level THEN nullif(trim(regexp_extract(l[1], '^\\*(.+)\\*$', 1)), '') END WHEN l[1] = '{digests.ALTERNATE_HEADER}' AND len(l) >= 2 THEN l[2] WHEN noted AND level THEN {_SHOWN} END AS title
FROM (SELECT *, {noted} AS noted, len(list_filter(l[2:], lambda x: starts_with(x, '{digests.LEVEL}'))) > 0 AS level, list_contains(l, 'Posted today') AS today, list_filter(list_transform(coalesce(urls, []), lambda u: CASE WHEN regexp_matches(u, '^https?://[^/?#]+') THEN {_normal('u')} ELSE '' END), lambda u: u <> '')[1] AS u
FROM (SELECT *, {_SPLIT} AS l FROM source_messages WHERE {source} AND sender IS NOT NULL) WHERE len(l) > 0)) WHERE title IS NOT NULL"""


_GROUP = _group_sql("source = 'whatsapp'", "FALSE")


@query(_GROUP)
def group_digest(spark, d):
    """Jobs of the chat groups' messages."""
    return _digest(digests.group_digest(read(spark, d, "source_messages").filter("source = 'whatsapp'")))


@query(_group_sql("TRUE", "TRUE").replace("source_group || '/' || source_message_id", "source_group || '/' || 'wa_notification_' || sha256('app' || chr(10) || source_group || chr(10) || source_message_id || chr(10) || coalesce(message_date, ''))"))
def notification_digest(spark, d):
    """All messages as if they came from notifications, whose ids are built from application, group, number and time; a
    lone title counts in them."""
    ident = digests.notification_id(F.lit("app"), F.col("source_group"), F.col("source_message_id"), F.coalesce("message_date", F.lit("")))
    return _digest(digests.group_digest(read(spark, d, "source_messages").withColumn("source_message_id", ident)))


@query(f"{_CHANNEL} UNION ALL {_GROUP}")
def parsed_messages(spark, d):
    """All messages, each by the parser that is registered for its source."""
    parsers = digests.ParserRegistry()
    parsers.register("Telegram", "*", digests.channel_digest)
    parsers.register("WhatsApp", "*", digests.group_digest)
    return _digest(parsers.parse(read(spark, d, "source_messages")))


@query(f"SELECT checked, parsed FROM (SELECT count(*) AS checked FROM source_messages WHERE source = 'telegram') a, (SELECT count(*) AS parsed FROM source_messages WHERE source = 'telegram' AND len({_SPLIT}) > 0) b")
def preview_counts(spark, d):
    return digests.preview(read(spark, d, "source_messages").filter("source = 'telegram'"), digests.channel_digest)[0]


@query(f"""
WITH r AS (SELECT DISTINCT source_group, source_message_id, raw_text, urls, source_message_url FROM source_messages),
m AS (SELECT *, list_concat([u FOR u IN coalesce(urls, [])], {_VISIBLE}, ['https://b.example/' || source_message_id || '?utm_source=x'], [source_message_url]) AS every FROM r),
n AS (SELECT source_group, source_message_id, list_filter(list_transform(every, lambda u: CASE WHEN regexp_matches(u, '^https?://[^/?#]+') THEN {_normal('u')} ELSE '' END), lambda u: u <> '') AS v FROM m)
SELECT source_group, source_message_id, array_to_string({_ORDERED.format('v')}, ' ') AS urls FROM n""")
def live_urls(spark, d):
    """The addresses of live messages: of entities, text, buttons and preview."""
    rows = _messages(spark, d)
    entities = F.transform("urls", lambda u: F.struct(F.lit("url").alias("type"), u.alias("text"), F.lit(None).cast("string").alias("href")))
    button = F.array(F.array(F.concat(F.lit("https://b.example/"), F.col("source_message_id"), F.lit("?utm_source=x"))))
    return rows.select("source_group", "source_message_id", F.array_join(digests.live_urls(entities, F.col("raw_text"), button, F.col("source_message_url")), " ").alias("urls"))


@query(f"SELECT source_group, source_message_id, list_filter(list_transform(urls, lambda u: {_normal('u')}), lambda u: regexp_full_match(u, 'https?://jobs[.]dudolomir[.]example/(postings|openings)/[0-9]+/?([?].*)?'))[1] AS url FROM (SELECT DISTINCT source_group, source_message_id, urls FROM source_messages WHERE urls IS NOT NULL)")
def allowed_urls(spark, d):
    """The first address of each message that is on one host and below a path."""
    rows = read(spark, d, "source_messages").filter("urls is not null").select("source_group", "source_message_id", "urls").distinct()
    return rows.select("source_group", "source_message_id", digests.allowed_url(F.col("urls"), "jobs.dudolomir.example", r"/(?:postings|openings)/\d+/?").alias("url"))


@query("SELECT CASE WHEN source_group <> 'devjobs_central' THEN 'wrong group' WHEN raw_text IS NULL OR raw_text = '' OR len(string_split(raw_text, chr(10))) > 200 THEN 'no or too many lines' ELSE 'accepted' END AS outcome, count(*) AS records FROM source_messages GROUP BY 1")
def notification_outcomes(spark, d):
    """The records of all messages, read for one group."""
    return notifications.checked(_records(spark, d), "devjobs_central").groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("records"))


def _records(spark, d, group: str | None = None) -> DataFrame:
    rows = read(spark, d, "source_messages")
    lines = F.when(F.coalesce("raw_text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("raw_text", "\n"))
    number = F.concat_ws("/", "source_group", "source_message_id")
    when = F.concat(F.lit("2025-01-"), F.lpad((F.length(number) % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00+00:00"))
    record = F.struct(F.lit("notification").alias("type"), F.lit(1).alias("protocol_version"), (F.lit(group) if group else F.col("source_group")).alias("group_identifier"), F.concat(F.lit("wa_notification_"), F.sha2(number, 256)).alias("source_message_id"), when.alias("message_date"), lines.alias("body_lines"))
    return rows.select(F.to_json(record).alias("value"))


@query("SELECT CASE WHEN raw_text IS NULL OR raw_text = '' OR len(string_split(raw_text, chr(10))) > 200 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS records FROM source_messages GROUP BY 1")
def notification_records(spark, d):
    checked = notifications.checked(_records(spark, d, "g"), "g")
    return checked.groupBy(F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("outcome")).agg(F.count("*").alias("records"))


@query("""
WITH m AS (SELECT DISTINCT source_group || '/' || source_message_id AS k, string_split(raw_text, chr(10)) AS l, raw_text FROM source_messages WHERE raw_text <> '' AND len(string_split(raw_text, chr(10))) <= 200),
p AS (SELECT *, contains(l[1], ': ') AND trim(split_part(l[1], ': ', 1)) <> '' AND length(trim(split_part(l[1], ': ', 1))) <= 256 AS named, len(l) >= 2 AND length(trim(l[1])) BETWEEN 1 AND 256 AND NOT regexp_matches(trim(l[1]), '^(\\*|https?://)') AND starts_with(ltrim(array_to_string(l[2:], chr(10))), '*') AS alone FROM m)
SELECT 'wa_notification_' || sha256(k) AS source_message_id, '2025-01-' || lpad(CAST(length(k) % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' AS message_date, CASE WHEN named THEN trim(split_part(l[1], ': ', 1)) WHEN alone THEN trim(l[1]) ELSE 'notification' END AS sender, CASE WHEN named THEN substring(raw_text, position(': ' IN raw_text) + 2) WHEN alone THEN array_to_string(l[2:], chr(10)) ELSE raw_text END AS raw_text FROM p""")
def notification_messages(spark, d):
    return notifications.messages(_records(spark, d, "g"), "g").select("source_message_id", "message_date", "sender", "raw_text").distinct()


# Records of diagnostics are made from events: the kind of event gives the form, its id and value the counts.
_FORM = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END"


def _diagnostics(spark, d) -> DataFrame:
    form = F.expr(_FORM)
    count = F.when(F.col("event_id") % 10 == 0, F.lit("-1")).otherwise(F.col("event_id").cast("string"))
    text = F.concat(F.lit('{"type":"diagnostic","protocol_version":1'), *(x for n in notifications.BASIC_COUNTS for x in (F.lit(f',"{n}":'), count)))
    for k, names in enumerate(notifications.LATER_COUNTS, 2):
        for n in names:
            value = F.lit('{"Fault, HRESULT 0x80070005":2}') if n == "application_info_error_categories" else count
            text = F.concat(text, F.when(form >= k, F.concat(F.lit(f',"{n}":'), value)).otherwise(""))
    return read(spark, d, "events").select(F.concat(text, F.when(F.col("event_id") % 11 == 0, ',"more":1}').otherwise("}")).alias("value"))


@query(f"SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_FORM} END AS form, event_id % 11 <> 0 AND event_id % 10 <> 0 AND event_id BETWEEN 0 AND 1000000 AS valid, count(*) AS records FROM events GROUP BY ALL")
def diagnostic_records(spark, d):
    return notifications.diagnostics(_diagnostics(spark, d)).groupBy("form", "valid").agg(F.count("*").alias("records"))


@query("SELECT count(*) AS records, " + ", ".join(f"CAST(coalesce(sum(event_id), 0) AS BIGINT) AS {n}" for n in notifications.BASIC_COUNTS) + " FROM events WHERE event_id % 11 <> 0 AND event_id % 10 <> 0 AND event_id BETWEEN 0 AND 1000000")
def diagnostic_totals(spark, d):
    return notifications.diagnostic_totals(_diagnostics(spark, d))


@query("SELECT id, CASE WHEN octet_length(encode(raw_text)) <= 600 AND raw_text <> '' THEN raw_text END AS raw_text, CASE WHEN raw_text = '' THEN 'no content' WHEN octet_length(encode(raw_text)) > 600 THEN 'too large' END AS reason FROM (SELECT id, coalesce(raw_text, '') AS raw_text FROM job_postings)")
def mail_contents(spark, d):
    """Texts in web-safe base64 without filling, read back where they aren't too large."""
    raw = F.regexp_replace(F.translate(F.base64(F.encode(F.coalesce("raw_text", F.lit("")), "utf-8")), "+/\r\n", "-_"), "=+$", "")
    rows = mail.decoded(read(spark, d, "job_postings").select("id", raw.alias("raw")), most=600)
    return rows.select("id", F.decode("content", "utf-8").alias("raw_text"), "reason")


@query("SELECT id, created_at FROM job_postings WHERE created_at <= TIMESTAMP '2025-06-01' AND created_at > TIMESTAMP '2025-05-18' ORDER BY created_at DESC, id LIMIT 50")
def recent_mail(spark, d):
    rows = read(spark, d, "job_postings").select("id", "created_at")
    return mail.recent(rows, "created_at", F.lit("2025-06-01").cast("timestamp_ntz"), 14, 50)


@query("""
SELECT * FROM (VALUES ('1', 'Data Engineer', 'Orlin Systems', 1.0::DOUBLE, 'https://jobs.orlin.example/1'), ('2', 'QA Engineer', 'Vask Energy', 1.0::DOUBLE, 'https://jobs.vask.example/2'), ('3', 'Data Engineer', 'Orlin Systems', 1.0::DOUBLE, 'https://jobs.orlin.example/1'), ('wa_1', 'Backend Developer', NULL, 0.75::DOUBLE, 'https://jobs.orlin.example/4')) t(source_message_id, title, company, parse_confidence, job_url)""")
def demo_jobs(spark, d):
    """The invented demo messages through the parsers; small talk gives none."""
    parsers = digests.ParserRegistry()
    parsers.register("telegram", "*", digests.channel_digest)
    parsers.register("whatsapp", "*", digests.group_digest)
    return parsers.parse(registry.demo_messages(spark)).select("source_message_id", "title", "company", "parse_confidence", "job_url")


QUERIES, ORACLE = query.queries, query.oracle
