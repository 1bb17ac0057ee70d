"""Deliveries to subscribers: signed envelopes, when they are tried again, and models fit for talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.values import hmac_sha256
from parlance.operators.joins import subscribed

# Seconds before each try, and parts of names of models that aren't for talk.
DELAYS = (0, 5, 300, 1_800, 7_200, 18_000, 36_000, 50_400, 72_000, 86_400)
NOT_FOR_CHAT = ("embedding", "embed", "tts", "whisper", "transcribe", "audio", "realtime", "dall-e", "image", "moderation", "rerank", "vision-encoder")
# What a provider's message says where waiting doesn't help.
NEEDS_ATTENTION = (
    "http 401", "http 402", "http 403", "http 404", "http 429", "unauthorized", "forbidden", "permission_denied", "authentication", "api key", "api_key", "invalid_api_key", "not logged", "log in",
    "please login", "please run /login", "login required", "quota", "resource_exhausted", "rate limit", "rate_limit", "usage limit", "billing", "credit balance", "not enough credits",
    "insufficient credits", "insufficient_quota", "context length", "context window", "maximum context", "prompt is too long", "input is too long", "too many tokens", "token limit", "max_tokens",
    "model not found", "does not exist",
)


def fan_out(meetings: DataFrame, subscriptions: DataFrame, guild: str, channel: str) -> DataFrame:
    """A row for each meeting and enabled subscription that takes it; see joins.subscribed()."""
    return subscribed(meetings, subscriptions.filter("enabled"), guild, channel)


def envelope(event: str, timestamp: Column, data: Column) -> Column:
    return F.to_json(F.struct(F.lit(event).alias("type"), timestamp.alias("timestamp"), data.alias("data")))


def signed(rows: DataFrame, message_id: Column, timestamp: Column, body: Column, secret: Column) -> DataFrame:
    """``rows`` with message_id, body and signature: v1 and the HMAC-SHA256 of id, timestamp and body, joined by dots.

    The id is the caller's, so every try of a delivery has the same; the secret is binary, 64 bytes at most.
    """
    made = rows.withColumn("message_id", message_id).withColumn("body", body)
    said = F.concat_ws(".", "message_id", timestamp, "body").cast("binary")
    return made.withColumn("signature", F.concat(F.lit("v1,"), hmac_sha256(secret, said)))


def tries(rows: DataFrame, key: Column, retry_after: Column) -> DataFrame:
    """A row for each try of a delivery: attempt from 1, and after_s, the seconds it waits for.

    A delay has up to a fifth more, by a hash of the delivery and try, so that not all come back at once;
    where the receiver says when to come back (retry_after seconds), that counts from the second try on.
    """
    each = rows.withColumn("_key", key).withColumn("_after", retry_after).select("*", F.posexplode(F.array(*map(F.lit, DELAYS))).alias("_nth", "_base"))
    most = F.greatest(F.floor(F.col("_base") / 5), F.lit(1))
    jitter = F.conv(F.substring(F.md5(F.concat_ws(":", "_key", "_nth")), 1, 8), 16, 10).cast("long") % (most + 1)
    wait = F.when(F.col("_base") == 0, 0).when(F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_base") + jitter)
    return each.withColumn("attempt", F.col("_nth") + 1).withColumn("after_s", wait.cast("long")).drop("_key", "_after", "_nth", "_base")


def for_chat(models: DataFrame, provider: str, name: str) -> DataFrame:
    """The models whose names don't say that they are for something else; all of a provider that would have none."""
    fit = ~F.greatest(*(F.contains(F.lower(name), F.lit(x)) for x in NOT_FOR_CHAT))
    some = F.bool_or("_fit").over(Window.partitionBy(provider))
    return models.withColumn("_fit", fit).withColumn("_some", some).filter("_fit OR NOT _some").drop("_fit", "_some")


def needs_attention(message: Column) -> Column:
    """True where a provider's message tells of something that trying again won't mend."""
    return F.greatest(*(F.contains(F.lower(message), F.lit(x)) for x in NEEDS_ATTENTION))
