"""Explicit schemas of the eight bronze collections, and ``conform``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STAMPS = "createdAt string, updatedAt string"

BRONZE = {
    "users": "id string, username string, displayName string, avatarSeed string, "
             f"lastSeenAt string, {_STAMPS}",
    "rooms": "id string, name string, slug string, isDM boolean, creatorId string, "
             f"aiEnabled boolean, {_STAMPS}",
    "messages": "id string, roomId string, senderId string, body string, clientMsgId string, "
                f"kind string, citations string, aiQuestion string, {_STAMPS}",
    "memberships": "id string, userId string, roomId string, lastReadMessageId string, "
                   f"lastReadAt string, {_STAMPS}",
    "aicalls": "id string, streamId string, userId string, kind string, provider string, "
               "model string, question string, answer string, sourceKeys string, "
               "retrievalHits int, tokensIn int, tokensOut int, latencyMs int, "
               f"cached boolean, ok boolean, errorCode string, verdict string, {_STAMPS}",
    "documents": "id string, roomId string, uploaderId string, filename string, "
                 "mimetype string, size bigint, status string, chunkCount int, error string, "
                 f"text string, pageOffsets string, {_STAMPS}",
    "invites": "id string, roomId string, createdBy string, expiresAt string, "
               f"maxRedemptions int, redemptionCount int, revokedAt string, {_STAMPS}",
    "pats": f"id string, userId string, name string, lastUsedAt string, revokedAt string, "
            f"{_STAMPS}",
}

# Without the opt-in text columns.
GOLD = {
    "dim_date": "date_key int, date date, year int, quarter int, month int, "
                "month_name string, day int, day_of_week int, day_name string, "
                "is_weekend boolean",
    "dim_user": "user_id string, username string, display_name string, "
                "account_created_at timestamp, last_seen_at timestamp",
    "dim_room": "room_id string, name string, slug string, is_dm boolean, "
                "ai_enabled boolean, creator_user_id string, room_created_at timestamp",
    "fact_message": "message_id string, room_id string, sender_id string, date_key int, "
                    "created_at timestamp, kind string, is_ai_answer boolean, "
                    "body_length int, word_count int, has_citations boolean, "
                    "citation_count int, has_ai_question boolean",
    "fact_ai_call": "stream_id string, user_id string, date_key int, created_at timestamp, "
                    "kind string, provider string, model string, tokens_in int, "
                    "tokens_out int, total_tokens int, latency_ms int, cached boolean, "
                    "ok boolean, error_code string, verdict string, retrieval_hits int, "
                    "source_count int, is_thumbs_up boolean, is_thumbs_down boolean",
    "fact_room_activity_daily": "room_id string, date_key int, message_count bigint, "
                                "ai_answer_count bigint, distinct_sender_count bigint, "
                                "total_words bigint",
}
GOLD_TABLES = tuple(GOLD)


def bronze_schema(name: str) -> StructType:
    return StructType.fromDDL(BRONZE[name])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its types, missing ones as nulls; extras are kept as they are.

    A value that does not fit the type becomes null.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({
        f.name: F.col(f.name).try_cast(f.dataType) if f.name in present
        else F.lit(None).cast(f.dataType)
        for f in schema.fields if present.get(f.name) != f.dataType
    })
