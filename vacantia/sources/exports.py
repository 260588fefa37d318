"""Exports of chats: a channel's JSON file and a group's text file, to messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t
from vacantia.operators import records

HEADER = r"^(\d{1,2}/\d{1,2}/\d{2}), (\d{2}:\d{2}) - (.*)$"


def _fail(ok: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def channel_messages(files: DataFrame, group: str | Column, source: str = "telegram") -> DataFrame:
    """Messages of channel exports (one row a file, column ``payload``); service records are left out.

    A file that isn't a public channel's export, or holds a record of another type, without number or time, or a number
    twice, fails.
    """
    root = F.parse_json("payload")
    listed = _fail((F.try_variant_get(root, "$.type", "string") == "public_channel") & _kind(F.try_variant_get(root, "$.messages", "variant")).startswith("ARRAY"), F.try_variant_get(root, "$.messages", "array<variant>"), "not a public channel's export")
    numbers = F.transform(listed, lambda x: F.try_variant_get(x, "$.id", "string"))
    listed = _fail(F.size(F.array_distinct(F.array_compact(numbers))) == F.size(F.array_compact(numbers)), listed, "a message number occurs twice")
    rows = files.select((F.lit(group) if isinstance(group, str) else group).alias("g"), F.posexplode(listed).alias("n", "m"))
    get = lambda p, k="string": F.try_variant_get(F.col("m"), f"$.{p}", k)
    kind = _fail(get("type").isin("message", "service"), get("type"), "unknown type of record")
    rows = rows.withColumn("kind", kind).filter("kind = 'message'")
    text = F.when(_kind(get("text", "variant")) == "STRING", get("text")).otherwise(
        F.array_join(F.transform(get("text", "array<variant>"), lambda x: F.coalesce(F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.text", "string"))), "")
    )
    entities = F.coalesce(get("text_entities", "array<variant>"), F.array().cast("array<variant>"))
    linked = F.transform(entities, lambda x: F.when(F.try_variant_get(x, "$.type", "string") == "text_link", F.try_variant_get(x, "$.href", "string")).when(F.try_variant_get(x, "$.type", "string") == "url", F.try_variant_get(x, "$.text", "string")))
    seconds = _fail(get("date_unixtime").rlike(r"^\d{1,11}$"), get("date_unixtime"), "message without time").cast("bigint")
    number = _fail(get("id").rlike(r"^-?\d+$"), get("id"), "message without number")
    rows = rows.select("g", number.alias("source_message_id"), F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("message_date"), get("from").alias("sender"), text.alias("raw_text"), F.array_compact(linked).alias("linked"))
    visible = F.regexp_extract_all(F.coalesce("raw_text", F.lit("")), F.lit(r"(?i)(https?://[^\s<>()]+)"), F.lit(1))
    return rows.select(F.lit(source).alias("source"), F.col("g").alias("source_group"), "source_message_id", "message_date", "sender", "raw_text", F.array_distinct(F.concat("linked", visible)).alias("urls"), F.lit(None).cast("string").alias("source_message_url"))


def export_summary(files: DataFrame) -> DataFrame:
    """(messages, skipped_service_records) of channel exports."""
    kinds = F.transform(F.try_variant_get(F.parse_json("payload"), "$.messages", "array<variant>"), lambda x: F.try_variant_get(x, "$.type", "string"))
    return files.select(F.explode(kinds).alias("k")).agg(F.count_if(F.col("k") == "message").alias("messages"), F.count_if(F.col("k") == "service").alias("skipped_service_records"))


def group_messages(files: DataFrame, group: str | Column, source: str = "whatsapp") -> DataFrame:
    """Messages of text exports (columns ``path``, ``payload``): records begin at ``M/d/yy, HH:mm - `` and go on over the
    lines up to the next; text before the first fails. Ids are hashes that number equal messages."""
    lines = files.select((F.lit(group) if isinstance(group, str) else group).alias("g"), "path", F.posexplode(F.split("payload", "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]")).alias("i", "line"))
    header = F.col("line").rlike(HEADER)
    body = records.assembled(lines.withColumn("line", F.when((F.col("i") == 0) & ~header & (F.trim("line") != ""), F.raise_error(F.lit("text before the first message"))).otherwise(F.col("line"))), ["g", "path"], "i", "line", header)
    first = F.substring_index("body", "\n", 1)
    rest = F.when(F.col("body").contains("\n"), F.expr("substring(body, instr(body, '\n'))")).otherwise("")
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract(first, HEADER, 1), F.regexp_extract(first, HEADER, 2)), F.lit("M/d/yy HH:mm"))
    rows = body.select("g", "path", "record_no", F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss").alias("message_date"), F.regexp_extract(first, HEADER, 3).alias("head"), rest.alias("rest"))
    named = F.col("head").rlike(r"^.+?: ")
    rows = rows.select("g", "path", "record_no", "message_date", F.when(named, F.substring_index("head", ": ", 1)).alias("sender"), F.rtrim(F.concat(F.when(named, F.expr("substring(head, instr(head, ': ') + 2)")).otherwise(F.col("head")), F.col("rest"))).alias("raw_text"))
    rows = rows.withColumns({"__s": t.fingerprint_text(F.col("sender")), "__t": t.fingerprint_text(F.col("raw_text"))})
    rows = records.numbered(rows, ["g", "message_date", "__s", "__t"], ["path", "record_no"])
    ident = t.message_fingerprint(F.col("g"), F.col("message_date"), F.col("sender"), F.col("raw_text"), F.col("occurrence"))
    return rows.select(F.lit(source).alias("source"), F.col("g").alias("source_group"), ident.alias("source_message_id"), "message_date", "sender", "raw_text", t.visible_urls(F.col("raw_text")).alias("urls"), F.lit(None).cast("string").alias("source_message_url"))
