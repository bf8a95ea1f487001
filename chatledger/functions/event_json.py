"""Event JSON: encoding and decoding columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatledger import schemas as S


def encode_value(created_at: str = "created_at") -> Column:
    """The JSON text of a wide event row; fields the event lacks are left out."""
    name = F.col("name")
    in_id = name.isin(S.MESSAGE_CREATED, S.MESSAGE_EDITED)
    stamp = F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(
        F.struct(stamp.alias("createdAt")).alias("additionalData"),
        F.col("chat_id").alias("chatId"),
        F.col("title"),
        F.col("participant_ids").alias("participantIds"),
        F.col("participant_id").alias("participantId"),
        F.col("pinned"),
        F.when(in_id, F.col("message_id")).alias("id"),
        F.when(~in_id, F.col("message_id")).alias("messageId"),
        F.col("owner_id").alias("ownerId"),
        F.col("content"),
        F.col("unread_action").alias("unreadMessagesAction"),
        F.col("last_message_action").alias("lastMessageAction"),
        F.col("chat_common_action").alias("chatCommonAction"),
        F.col("increase_on").alias("increaseOn"),
    ))


def decode_value(value: str) -> Column:
    """A struct with the fields of all events; ``broken`` holds the text when it is not an event."""
    return F.from_json(
        value, S.EVENT_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}
    )


def strict_json(text: str) -> Column:
    """A variant if the text is exactly one JSON value, else null."""
    return F.try_variant_get(strict_box(text), "$[0]", "variant")


def strict_box(text: str) -> Column:
    """A variant array with the value first if the text is exactly one JSON value, else null. Reading fields through the
    array saves a copy of the value.

    Spark's parser stops after the first value; inside an array with a last element of our own, anything
    that follows the value is seen. A text that has our element in it is read once more with another one:
    no text can end both arrays.
    """
    def boxed(mark: str) -> Column:
        def checked(box: Column) -> Column:
            whole = F.try_variant_get(box, "$[1]", "string") == mark
            return F.when(whole & F.try_variant_get(box, "$[2]", "variant").isNull(), box)

        # As the only element of an array, so that the text is parsed once for all that is asked of it.
        box = F.try_parse_json(F.concat(F.lit("["), F.col(text), F.lit(f', "{mark}"]')))
        return F.get(F.transform(F.array(box), checked), F.lit(0))

    return F.when(F.col(text).contains('"end"'), F.when(boxed("end").isNotNull(), boxed("stop"))).otherwise(boxed("end"))


# The own fields of every event, apart from additionalData and chatId, which all have.
OWN_FIELDS = {
    S.CHAT_CREATED: ("title",), S.CHAT_EDITED: ("title",), S.CHAT_DELETED: (),
    S.PARTICIPANTS_ADDED: ("participantIds",), S.PARTICIPANT_DELETED: ("participantIds",),
    S.CHAT_PINNED: ("participantId", "pinned"), S.MESSAGE_CREATED: ("id", "ownerId", "content"),
    S.MESSAGE_EDITED: ("id", "content"),
    S.CHAT_VIEW_REFRESHED: ("participantIds", "title", "unreadMessagesAction", "lastMessageAction",
                            "chatCommonAction", "increaseOn", "ownerId"),
    S.MESSAGE_READED: ("participantId", "messageId"), S.MESSAGE_DELETED: ("messageId",),
}

# A date and time with zone as the events write it.
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def is_plain(text: str, parsed: str) -> Column:
    """A cheap test that sees at once that nearly every value the producers write is one JSON object with fields of the
    right types; ``is_event`` judges those that fail it.

    The typed parser was content; every name in the text is a field it found, once; texts are in double quotes; and both
    closing braces, that of additionalData and the last character, belong to the object, so nothing follows it.
    """
    text = F.col(text)
    found = lambda part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    stamp = F.col(f"{parsed}.additionalData.createdAt")
    names = F.lit(2)
    for field in S.EVENT_FIELDS:
        names = names + F.col(f"{parsed}.{field}").isNotNull().cast("int")
    return F.coalesce(
        F.col(f"{parsed}.broken").isNull() & stamp.isNotNull() & text.endswith("}") & (found("}") == 2)
        & (found('":') == names) & ~text.rlike('"(title|content|createdAt)"\\s*:\\s*[^"\\s]'), F.lit(False))


def is_event(plain: Column, value: str, name: str, parsed: str, clock: str) -> Column:
    """Whether a value (column ``value``: the variant of ``strict_json``, needed only if it is not ``plain``) is one JSON
    object whose fields, as far as its event has them, are of the right types. Absent and null fields are fine, and so
    are fields of other events, whatever they hold. ``clock`` is the column with ``utc_clock`` of its time."""
    def typed(value: Column) -> Column:
        at = lambda field: F.try_variant_get(value, f"$.{field}", "variant")
        kind = lambda field: F.coalesce(F.schema_of_variant(at(field)), F.lit("VOID"))

        def small(field: str) -> Column:
            return F.coalesce(F.try_variant_get(value, f"$.{field}", "smallint").isNotNull(), F.lit(False))

        right = {
            "title": kind("title").isin("VOID", "STRING"), "content": kind("content").isin("VOID", "STRING"),
            "pinned": kind("pinned").isin("VOID", "BOOLEAN"),
            "participantIds": kind("participantIds").isin("VOID", "ARRAY<BIGINT>", "ARRAY<VOID>"),
        }
        for field in ("unreadMessagesAction", "lastMessageAction", "chatCommonAction"):
            right[field] = (kind(field) == "VOID") | (kind(field) == "BIGINT") & small(field)
        for field in ("chatId", "participantId", "id", "messageId", "ownerId", "increaseOn"):
            right[field] = kind(field).isin("VOID", "BIGINT")

        def wrong(*fields: str) -> Column:
            return F.array_compact(F.array(*[F.when(~right[f], F.lit(f)) for f in fields]))

        owned = F.create_map(*[x for event, fields in OWN_FIELDS.items() for x in (
            F.lit(event), F.array(F.lit("chatId"), *map(F.lit, fields)))])[F.col(name)]
        extra = kind("additionalData").startswith("OBJECT") | (kind("additionalData") == "VOID")
        # Most values hold what they should: only those the typed parser stumbled over are looked at field by field. It
        # takes anything for text, though.
        found = F.when(F.col(f"{parsed}.broken").isNull(), wrong("title", "content")).otherwise(wrong(*right))
        fields = ~F.coalesce(F.arrays_overlap(found, owned), F.lit(False)) & (F.col(f"{parsed}.broken").isNull() | extra)
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)) & fields

    stamp = F.col(f"{parsed}.additionalData.createdAt")
    timed = stamp.isNull() | stamp.rlike(STAMP) & F.col(clock).isNotNull()
    # As the only element of an array: what few values need stays out of the code that is compiled for all of them.
    sound = F.when(plain, True).otherwise(F.get(F.transform(F.array(F.col(value)), typed), F.lit(0)))
    return sound & F.coalesce(timed, F.lit(False))


def utc_clock(stamp: str) -> Column:
    """RFC 3339 text with a zone as UTC wall time without zone, whatever the session zone is."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(try_cast({stamp} as timestamp)), timestamp_ntz'1970-01-01 00:00:00')")
