"""Alerts for finished runs, rendered per channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The channels and the two colours of an embed; below, the titles and messages of alerts.
CHANNELS = ["telegram", "slack", "discord"]
GREEN, RED = 0x2ECC71, 0xE74C3C


def no_details() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def run_alerts(records: DataFrame, details: bool = False) -> DataFrame:
    """(id, title, message, success, details) for every run that ended; type and size are told only with ``details``."""
    done = records.filter(F.col("status").isin("SUCCESS", "FAILED"))
    good = F.col("status") == "SUCCESS"
    db = F.coalesce("profile_name", F.lit("default"))
    title = F.concat(F.when(good, "Backup Successful: ").otherwise("Backup Failed: "), db)
    went_well = F.concat(F.lit("Backup completed successfully for database '"), db, F.lit("' (ID: "), F.col("id"), F.lit(")"))
    went_wrong = F.concat(F.lit("Backup failed for database '"), db, F.lit("': "), F.coalesce("error_message", F.lit("null")))
    return done.select(
        "id",
        title.alias("title"),
        F.when(good, went_well).otherwise(went_wrong).alias("message"),
        good.alias("success"),
        (run_details() if details else no_details()).alias("details"),
    )


def run_details() -> Column:
    """Type and size of a run; a size that is unknown is left out."""
    entries = F.array(
        F.struct(F.lit("Type").alias("key"), F.col("backup_type").alias("value")),
        F.struct(F.lit("Size").alias("key"), F.col("file_size_bytes").cast("string").alias("value")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def restore_alerts(outcomes: DataFrame) -> DataFrame:
    """Alerts for restores: (target_id, error), error null when the whole chain was restored."""
    good = F.col("error").isNull()
    went_well = F.concat(F.lit("Successfully restored backup chain up to target "), F.col("target_id"))
    went_wrong = F.concat(F.lit("Failed to restore backup "), F.col("target_id"), F.lit(": "), F.col("error"))
    return outcomes.select(
        F.col("target_id").alias("id"),
        F.when(good, "Restore Successful").otherwise("Restore Failed").alias("title"),
        F.when(good, went_well).otherwise(went_wrong).alias("message"),
        good.alias("success"),
        no_details().alias("details"),
    )


def headline() -> Column:
    status = F.when(F.col("success"), F.lit("SUCCESS")).otherwise(F.lit("FAILED"))
    return F.concat(F.lit("["), status, F.lit("] "), F.col("title"))


def bullet_lines(start: str, middle: str) -> Column:
    """One bullet per detail, ``start`` and ``middle`` around its name."""
    line = lambda e: F.concat(F.lit("• " + start), e["key"], F.lit(middle + " "), e["value"], F.lit("\n"))
    return F.array_join(F.transform(F.map_entries("details"), line), "")


def with_details(heading: str, bullets: Column) -> Column:
    return F.when(F.size("details") > 0, F.concat(F.lit(heading), bullets)).otherwise(F.lit(""))


def telegram_text() -> Column:
    return F.concat(
        F.lit("<b>"), headline(), F.lit("</b>\nMessage: "), F.col("message"), F.lit("\n"),
        with_details("\n<b>Details:</b>\n", bullet_lines("<b>", ":</b>")),
    )


def telegram_body(chat_id: str) -> Column:
    return F.to_json(
        F.struct(F.lit(chat_id).alias("chat_id"), telegram_text().alias("text"), F.lit("HTML").alias("parse_mode"))
    )


def slack_body() -> Column:
    section = F.concat(
        F.lit("*Message:* "), F.col("message"), F.lit("\n"), with_details("\n*Details:*\n", bullet_lines("*", ":*"))
    )
    block = lambda kind, form, text: F.struct(
        F.lit(kind).alias("type"), F.struct(F.lit(form).alias("type"), text.alias("text")).alias("text")
    )
    blocks = F.array(block("header", "plain_text", headline()), block("section", "mrkdwn", section))
    return F.to_json(F.struct(F.concat(headline(), F.lit(": "), F.col("message")).alias("text"), blocks.alias("blocks")))


def discord_body() -> Column:
    field = lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"), F.lit(True).alias("inline"))
    fields = F.when(F.size("details") > 0, F.transform(F.map_entries("details"), field))
    embed = F.struct(
        headline().alias("title"),
        F.col("message").alias("description"),
        F.when(F.col("success"), F.lit(GREEN)).otherwise(F.lit(RED)).alias("color"),
        fields.alias("fields"),
    )
    return F.to_json(F.struct(F.array(embed).alias("embeds")))


def route(alerts: DataFrame, channels: str = "channels") -> DataFrame:
    """One row per alert and known channel, names in any case; unknown, null and missing channels are skipped."""
    each = alerts.withColumn("channel", F.explode(channels)).withColumn("channel", F.lower("channel"))
    return each.filter(F.col("channel").isin(*CHANNELS)).drop(channels)


def render(routed: DataFrame, chat_id: str = "") -> DataFrame:
    """(id, channel, body) of routed alerts."""
    body = (
        F.when(F.col("channel") == "telegram", telegram_body(chat_id))
        .when(F.col("channel") == "slack", slack_body())
        .when(F.col("channel") == "discord", discord_body())
    )
    return routed.select("id", "channel", body.alias("body"))
