"""Records of a notification companion: one JSON object a line, strictly validated; rejects come out with their reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions import text as t

KEYS = ("body_lines", "group_identifier", "message_date", "protocol_version", "source_message_id", "type")
RECORD = "type string, protocol_version int, group_identifier string, source_message_id string, message_date string, body_lines array<string>"
ID = r"^wa_notification_[0-9a-f]{64}$"
MOST_LINE, MOST_LINES, MOST_SENDER = 65_536, 200, 256
# The fields of diagnostic records; each later form has all fields of the forms before.
BASIC_COUNTS = ("total_notifications", "application_identity_errors", "allowed_app_notifications", "exact_group_notifications", "accepted_notifications", "oversized_notifications")
LATER_COUNTS = (("application_info_errors", "app_user_model_id_errors", "reconstructed_application_identities"), ("application_info_error_categories",), ("official_package_family_matches",), ("visual_inspection_errors",))
MOST_COUNT, MOST_CATEGORIES = 1_000_000, 16
CATEGORY = r"^[A-Za-z][A-Za-z0-9]{0,127}, HRESULT 0x[0-9A-F]{8}$"


def checked(lines: DataFrame, group: str, column: str = "value") -> DataFrame:
    """Every line with its record and the reason it is rejected for, null if it isn't."""
    line = F.col(column)
    rows = lines.select(line.alias("line"), F.array_sort(F.json_object_keys(F.when(F.length(line) <= MOST_LINE, line))).alias("keys"), F.from_json(line, RECORD).alias("r"))
    r = F.col("r")
    reason = (
        F.when(F.length("line") > MOST_LINE, "too long")
        .when(F.col("keys").isNull(), "no JSON object")
        .when(F.col("keys") != F.array(*map(F.lit, KEYS)), "unexpected or missing fields")
        .when((F.coalesce(r["type"], F.lit("")) != "notification") | (F.coalesce(r["protocol_version"], F.lit(0)) != 1), "wrong type or protocol")
        .when(F.coalesce(r["group_identifier"], F.lit("")) != group, "wrong group")
        .when(~F.coalesce(r["source_message_id"], F.lit("")).rlike(ID), "invalid id")
        .when(F.try_to_timestamp(r["message_date"]).isNull(), "invalid date")
        .when(F.coalesce(F.size(r["body_lines"]), F.lit(0)).between(1, MOST_LINES) == F.lit(False), "no or too many lines")
    )
    return rows.select("line", "r", reason.alias("reason"))


def messages(lines: DataFrame, group: str, source: str = "whatsapp", column: str = "value") -> DataFrame:
    """The messages of the valid records: the sender stands before ``: `` or on a line of its own above a starred title."""
    rows = checked(lines, group, column).filter("reason is null").select("r.*")
    body = F.array_join("body_lines", "\n")
    first = F.substring_index(body, "\n", 1)
    before = F.trim(F.substring_index(first, ": ", 1))
    named = first.contains(": ") & before.rlike(r"\S") & (F.length(before) <= MOST_SENDER)
    alone = F.trim(F.element_at("body_lines", 1))
    below = F.array_join(F.slice("body_lines", 2, 1_000_000), "\n")
    own_line = (F.size("body_lines") >= 2) & F.length(alone).between(1, MOST_SENDER) & ~alone.rlike(r"^(?:\*|https?://)") & F.ltrim(below).startswith("*")
    sender = F.when(named, before).when(own_line, alone).otherwise("notification")
    text = F.when(named, F.expr("substring(array_join(body_lines, '\n'), instr(array_join(body_lines, '\n'), ': ') + 2)")).when(own_line, below).otherwise(body)
    rows = rows.select(F.lit(source).alias("source"), F.lit(group).alias("source_group"), "source_message_id", "message_date", sender.alias("sender"), text.alias("raw_text"))
    return rows.withColumns({"urls": t.visible_urls(F.col("raw_text")), "source_message_url": F.lit(None).cast("string")})


def diagnostic_forms() -> list[list[str]]:
    """The five sets of fields that a diagnostic record may have."""
    forms = [["protocol_version", "type", *BASIC_COUNTS]]
    for later in LATER_COUNTS:
        forms.append(forms[-1] + list(later))
    return [sorted(f) for f in forms]


def diagnostics(lines: DataFrame, column: str = "value", category: str = CATEGORY) -> DataFrame:
    """Every line of diagnostics with its form (1 to 5, null if it has none), its record and whether that is valid: all
    counts whole numbers from 0 to a million, at most 16 categories with counts from 1."""
    line = F.col(column)
    counts = [n for n in (*BASIC_COUNTS, *(x for later in LATER_COUNTS for x in later)) if n != "application_info_error_categories"]
    schema = "type string, protocol_version int, " + ", ".join(f"{n} bigint" for n in counts) + ", application_info_error_categories map<string,bigint>"
    keys = F.array_sort(F.json_object_keys(F.when(F.length(line) <= MOST_LINE, line)))
    form = F.lit(None).cast("int")
    for k, names in enumerate(diagnostic_forms(), 1):
        form = F.when(keys == F.array(*map(F.lit, names)), k).otherwise(form)
    # One row in, one row out: beyond a generator no filter repeats the parsing for each field it asks for.
    rows = lines.select(line.alias("line"), F.inline(F.array(F.struct(form.alias("form"), F.from_json(line, schema).alias("r")))))
    ok = F.col("form").isNotNull() & (F.col("r.type") == "diagnostic") & (F.col("r.protocol_version") == 1)
    for k, names in enumerate([BASIC_COUNTS, *LATER_COUNTS], 1):
        for n in names:
            good = F.col(f"r.{n}").between(0, MOST_COUNT) if n in counts else F.expr(f"size(r.{n}) <= {MOST_CATEGORIES} and forall(map_entries(r.{n}), e -> e.key rlike '{category}' and e.value between 1 and {MOST_COUNT})")
            ok = ok & ((F.col("form") < k) | F.coalesce(good, F.lit(False)))
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False)))


def diagnostic_totals(lines: DataFrame, column: str = "value") -> DataFrame:
    """The counters of all valid diagnostic records added up."""
    return diagnostics(lines, column).filter("valid").agg(F.count("*").alias("records"), *(F.coalesce(F.sum(f"r.{n}"), F.lit(0)).alias(n) for n in BASIC_COUNTS))
