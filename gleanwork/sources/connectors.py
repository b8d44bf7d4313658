"""Payloads of mail and chat services as documents: pure projections, one output row for each input row.

Each takes a DataFrame whose columns are the service's own fields and returns schema, data (JSON text) and checksums (null where the
content decides). Absent fields may be missing columns. Nothing depends on the time of ingestion, so a repeated import gives
the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL, MESSAGE = "data/schema/message/email", "data/schema/message"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _get(df: DataFrame):
    """A field by its dotted path, null where the input has none such."""

    def get(path: str, kind: str = "string") -> Column:
        head, *rest = path.split(".")
        if head not in df.columns:
            return F.lit(None).cast(kind)
        t = df.schema[head].dataType
        for r in rest:
            if not hasattr(t, "names") or r not in t.names:
                return F.lit(None).cast(kind)
            t = t[r].dataType
        return F.col(path)

    return get


def _doc(df: DataFrame, schema: str, fields: dict[str, Column], checksums: Column | None = None) -> DataFrame:
    data = F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
    sums = F.lit(None).cast("array<string>") if checksums is None else checksums
    return df.select(F.lit(schema).alias("schema"), data.alias("data"), sums.alias("checksums"))


def address(c: Column) -> Column:
    """struct<address, name> of an address in lower case; null without one."""
    return F.when(F.trim(c["address"]) != "", F.struct(F.lower(F.trim(c["address"])).alias("address"), F.nullif(F.trim(c["name"]), F.lit("")).alias("name")))


def references(c: Column) -> Column:
    """Message ids of a References header, as an array, in order and each once."""
    return F.array_distinct(F.filter(F.split(F.trim(c), r"[\s,]+"), lambda x: x != ""))


def email_from_imap(df: DataFrame) -> DataFrame:
    """subject, text, html, from, to, cc, bcc, date, messageId, inReplyTo, references, uid, flags, attachments, folder."""
    get = _get(df)
    subject = F.coalesce(F.nullif(F.trim(get("subject")), F.lit("")), F.lit("(no subject)"))
    preview = F.nullif(F.substring(F.trim(F.regexp_replace(get("text"), r"\s+", " ")), 1, 200), F.lit(""))
    person = "struct<address:string,name:string>"
    sender = address(get("from", person))
    synthetic = F.concat(F.lit("imap-synthetic-"), F.sha1(F.concat_ws("|", F.coalesce(sender["address"], F.lit("unknown@localhost")), subject, F.coalesce(get("date").cast("string"), F.lit("")))))
    mid = F.coalesce(F.nullif(get("messageId"), F.lit("")), F.concat(F.lit("imap-uid-"), get("uid").cast("string")), synthetic)
    many = lambda n: F.filter(F.transform(get(n, f"array<{person}>"), address), lambda x: x.isNotNull())
    unknown = F.struct(F.lit("unknown@localhost").alias("address"), F.lit(None).cast("string").alias("name"))
    fields = {
        "title": subject, "subject": subject, "body": F.coalesce(get("text"), F.lit("")), "bodyHtml": get("html"), "bodyPreview": preview, "from": F.coalesce(sender, unknown), "to": F.coalesce(many("to"), F.array().cast(f"array<{person}>")),
        "cc": many("cc"), "bcc": many("bcc"), "date": get("date").cast("string"), "messageId": mid, "inReplyTo": get("inReplyTo"), "references": references(get("references")), "attachments": get("attachments", "array<string>"),
        "platform": F.lit("imap"), "folder": F.struct(get("folder").alias("path")), "platformMetadata": F.struct(get("uid").alias("uid"), get("flags", "array<string>").alias("flags")),
    }
    return _doc(df, EMAIL, fields, get("checksums", "array<string>"))


def email_from_graph(df: DataFrame) -> DataFrame:
    """Messages as the mail endpoint of a graph API gives them."""
    get = _get(df)
    who = "array<struct<emailAddress:struct<address:string,name:string>>>"
    many = lambda n: F.transform(get(n, who), lambda r: F.struct(r["emailAddress"]["address"].alias("address"), r["emailAddress"]["name"].alias("name")))
    html = F.when(get("body.contentType") == "html", get("body.content"))
    sender = F.struct(F.coalesce(get("from.emailAddress.address"), F.lit("")).alias("address"), get("from.emailAddress.name").alias("name"))
    fields = {
        "subject": F.coalesce(F.nullif(get("subject"), F.lit("")), F.lit("(no subject)")), "body": F.coalesce(F.nullif(get("bodyPreview"), F.lit("")), get("body.content"), F.lit("")), "bodyHtml": html, "bodyPreview": get("bodyPreview"),
        "from": sender, "to": F.coalesce(many("toRecipients"), F.array().cast("array<struct<address:string,name:string>>")), "cc": many("ccRecipients"), "bcc": many("bccRecipients"), "replyTo": many("replyTo"),
        "date": get("receivedDateTime").cast("string"), "sentAt": get("sentDateTime").cast("string"), "messageId": F.coalesce(get("internetMessageId"), get("id")), "conversationId": get("conversationId"), "isRead": get("isRead", "boolean"),
        "isFlagged": get("flag.flagStatus") == "flagged", "isDraft": get("isDraft", "boolean"), "importance": get("importance"), "categories": get("categories", "array<string>"), "platform": F.lit("graph"),
        "folder": F.struct(get("parentFolderId").alias("id")), "platformMetadata": F.struct(get("id").alias("graphId"), get("webLink").alias("webLink")),
    }
    return _doc(df, EMAIL, fields, get("checksums", "array<string>"))


def message_from_slack(df: DataFrame, channel_id: str, channel: str) -> DataFrame:
    get = _get(df)
    at = F.date_format(F.timestamp_millis(F.round(get("ts").cast("double") * 1000).cast("bigint")), _ISO)
    react = "array<struct<name:string,count:bigint,users:array<string>>>"
    fields = {
        "text": get("text"), "sender": F.struct(get("user").alias("id"), get("username").alias("username")), "channel": F.struct(F.lit(channel_id).alias("id"), F.lit(channel).alias("name"), F.coalesce(get("channel_type"), F.lit("channel")).alias("type")),
        "platform": F.lit("slack"), "timestamp": at, "threadId": get("thread_ts"), "reactions": F.transform(get("reactions", react), lambda r: F.struct(r["name"].alias("emoji"), r["count"].alias("count"), r["users"].alias("users"))),
        "platformMetadata": F.struct(get("ts").alias("messageId"), get("team").alias("teamId")),
    }
    return _doc(df, MESSAGE, fields)


def message_from_teams(df: DataFrame, channel: str) -> DataFrame:
    get = _get(df)
    user = get("from.user.userPrincipalName")
    mention = "array<struct<mentioned:struct<user:struct<id:string,displayName:string>>>>"
    fields = {
        "text": F.coalesce(get("body.content"), F.lit("")), "html": F.when(get("body.contentType") == "html", get("body.content")),
        "sender": F.struct(get("from.user.id").alias("id"), get("from.user.displayName").alias("displayName"), F.when(get("from.user.userIdentityType") == "aadUser", user).alias("email")),
        "channel": F.struct(get("channelIdentity.channelId").alias("id"), F.lit(channel).alias("name"), F.lit("channel").alias("type")), "platform": F.lit("teams"), "timestamp": get("createdDateTime").cast("string"),
        "editedAt": get("lastModifiedDateTime").cast("string"), "replyCount": get("replyCount", "bigint"),
        "mentions": F.transform(get("mentions", mention), lambda m: F.struct(m["mentioned"]["user"]["id"].alias("id"), m["mentioned"]["user"]["displayName"].alias("name"), F.lit("user").alias("type"))),
        "platformMetadata": F.struct(get("id").alias("messageId"), get("webUrl").alias("permalink")),
    }
    return _doc(df, MESSAGE, fields)


def message_from_irc(df: DataFrame) -> DataFrame:
    get = _get(df)
    nick, room = get("nick"), get("channel")
    fields = {
        "text": get("message"), "sender": F.struct(nick.alias("id"), nick.alias("username"), nick.alias("name")), "channel": F.struct(room.alias("id"), room.alias("name"), F.when(room.startswith("#"), "channel").otherwise("direct").alias("type")),
        "platform": F.lit("irc"), "timestamp": get("timestamp").cast("string"), "platformMetadata": F.struct(get("host").alias("host")),
    }
    return _doc(df, MESSAGE, fields)
