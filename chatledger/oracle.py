"""The registered queries in plain SQL over the same input, written without the library's closed forms:
correlated lookups where the library uses ordered passes, and a step-by-step recursion for the counters."""

from __future__ import annotations

OPEN = "9223372036854775807"

_SOURCE = """
src AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, user_id // 5 AS block
  FROM events
),
named AS (
  SELECT *, k // 4 AS s, block * 4 + k % 4 + 1 AS chat_id,
    CASE WHEN event_type = 'purchase' OR (event_type = 'view' AND k // 4 < 20) THEN 'msg'
         WHEN event_type = 'view' THEN 'pin'
         WHEN event_type = 'signup' AND k // 4 < 20 THEN 'add'
         WHEN event_type = 'signup' AND k // 4 = 20 THEN 'edit'
         WHEN event_type = 'signup' AND k // 4 = 21 THEN 'create'
         WHEN event_type = 'signup' OR (event_type = 'error' AND k // 4 BETWEEN 20 AND 23) THEN 'leave'
         WHEN event_type = 'click' THEN 'read'
         WHEN event_type = 'error' AND k // 4 < 10 THEN 'medit'
         WHEN event_type = 'error' AND k // 4 < 20 THEN 'mdel'
         WHEN event_type = 'error' THEN 'cdel' END AS act
  FROM src
),
acts AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY event_id) AS rn,
         count(*) FILTER (WHERE act = 'msg') OVER (PARTITION BY chat_id ORDER BY event_id) AS mx
  FROM named WHERE act IS NOT NULL
)"""

_FIELDS = {
    "participant_ids": "BIGINT[]", "title": "VARCHAR", "participant_id": "BIGINT", "pinned": "BOOLEAN",
    "message_id": "BIGINT", "owner_id": "BIGINT", "content": "VARCHAR", "unread_action": "SMALLINT",
    "last_message_action": "SMALLINT", "chat_common_action": "SMALLINT", "increase_on": "BIGINT",
}


def _branch(when: str, slot: int, name: str, **fields: str) -> str:
    columns = ", ".join(f"CAST({fields.get(f, 'NULL')} AS {kind}) AS {f}" for f, kind in _FIELDS.items())
    return (f"SELECT event_id * 4 + {slot} AS log_seq, chat_id, '{name}' AS name, ts AS created_at, {columns} "
            f"FROM acts WHERE {when}")


def _refresh(when: str, unread: int, message: int, common: int, **fields: str) -> str:
    given = {"title": "''", "increase_on": "0", "owner_id": "0", **fields}
    return _branch(when, 3, "chatViewRefreshed", participant_ids=_ALL, unread_action=str(unread),
                   last_message_action=str(message), chat_common_action=str(common), **given)


_ALL = "[block*5, block*5+1, block*5+2, block*5+3, block*5+4]"
_RECENT = "greatest(0, mx - s % 3)"
_DOOMED = "greatest(0, mx - s % 4)"
_STARTS = "rn = 1 OR act = 'create'"

_LOG = _SOURCE + ",\nraw AS (\n" + "\nUNION ALL ".join([
    _branch(_STARTS, 0, "chatCreated", title="'chat ' || chat_id || '.' || event_id"),
    _branch(_STARTS, 1, "participantsAdded", participant_ids="[block*5, block*5+1]"),
    _branch("act = 'msg'", 2, "messageCreated", message_id="mx", owner_id="user_id", content="'m' || event_id"),
    _refresh("act = 'msg'", 2, 1, 0, increase_on="1", owner_id="user_id"),
    _branch("act = 'pin'", 2, "chatPinned", participant_id="user_id", pinned="value >= 10"),
    _branch("act = 'add'", 2, "participantsAdded", participant_ids="[user_id]"),
    _branch("act = 'edit'", 2, "chatEdited", title="'t' || event_id"),
    _refresh("act = 'edit'", 0, 0, 1, title="'t' || event_id"),
    _branch("act = 'leave'", 2, "participantDeleted", participant_ids="[user_id]"),
    _branch("act = 'read'", 2, "messageReaded", participant_id="user_id", message_id=_RECENT),
    _branch("act = 'medit'", 2, "messageEdited", message_id=_RECENT, content="'e' || event_id"),
    _refresh("act = 'medit'", 0, 1, 0),
    _branch("act = 'mdel'", 2, "messageDeleted", message_id=_DOOMED),
    _refresh("act = 'mdel'", 1, 1, 0, owner_id="user_id"),
    _branch("act = 'cdel'", 2, "chatDeleted"),
    _branch("act = 'cdel'", 3, "participantDeleted", participant_ids=_ALL),
]) + """
),
log AS MATERIALIZED (
  SELECT *, CAST(chat_id % 3 AS INTEGER) AS partition,
         row_number() OVER (PARTITION BY chat_id % 3 ORDER BY log_seq) - 1 AS "offset"
  FROM raw
)"""


def _lives(name: str, begin: str, end: str, keys: list[str], source: str = "log") -> str:
    """Lives by looking around every event of a key."""
    same = lambda a: " AND ".join(f"{a}.{k} = c.{k}" for k in keys)
    return f"""
{name} AS MATERIALIZED (
  SELECT {', '.join('c.' + k for k in keys)}, c.log_seq AS from_seq,
    coalesce((SELECT min(d.log_seq) FROM {source} d WHERE d.name = '{end}' AND {same('d')} AND d.log_seq > c.log_seq),
             {OPEN}) AS to_seq
  FROM {source} c
  WHERE c.name = '{begin}' AND coalesce((
    SELECT arg_max(p.name, p.log_seq) FROM {source} p
    WHERE p.name IN ('{begin}', '{end}') AND {same('p')} AND p.log_seq < c.log_seq), '') <> '{begin}'
)"""


_CHAT_LIFE = "," + _lives("chat_life", "chatCreated", "chatDeleted", ["chat_id"])
_MESSAGE_LIFE = "," + _lives("message_life", "messageCreated", "messageDeleted", ["chat_id", "message_id"])

_ADDS = _CHAT_LIFE + """,
adds AS (
  SELECT l.*, EXISTS (SELECT 1 FROM chat_life c WHERE c.chat_id = l.chat_id
                      AND c.from_seq <= l.log_seq AND l.log_seq < c.to_seq) AS valid,
    (SELECT arg_max(t.title, t.log_seq) FROM log t WHERE t.chat_id = l.chat_id
     AND t.name IN ('chatCreated', 'chatEdited') AND t.log_seq < l.log_seq
     AND EXISTS (SELECT 1 FROM chat_life c WHERE c.chat_id = t.chat_id
                 AND c.from_seq <= t.log_seq AND t.log_seq < c.to_seq)) AS chat_title
  FROM log l WHERE l.name = 'participantsAdded'
),
membership AS MATERIALIZED (
  SELECT chat_id, unnest(list_distinct(participant_ids)) AS user_id, log_seq, 'join' AS name FROM adds WHERE valid
  UNION ALL
  SELECT chat_id, unnest(list_distinct(participant_ids)), log_seq, 'leave' FROM log WHERE name = 'participantDeleted'
)""" 

_MEMBER_LIFE = _ADDS + "," + _lives("member_life", "join", "leave", ["user_id", "chat_id"], "membership")

_MEMBERS = _MEMBER_LIFE + f""",
members AS (SELECT user_id, chat_id, from_seq FROM member_life WHERE to_seq = {OPEN})"""

_CHATS = _CHAT_LIFE + f""",
chats AS (
  SELECT c.chat_id AS id,
    (SELECT arg_max(t.title, t.log_seq) FROM log t WHERE t.chat_id = c.chat_id
     AND t.name IN ('chatCreated', 'chatEdited') AND t.log_seq >= c.from_seq) AS title,
    (SELECT max(t.created_at) FROM log t WHERE t.chat_id = c.chat_id AND t.name = 'chatCreated'
     AND t.log_seq = (SELECT max(u.log_seq) FROM log u WHERE u.chat_id = c.chat_id AND u.name = 'chatCreated')
    ) AS created_timestamp
  FROM chat_life c WHERE c.to_seq = {OPEN}
)"""

_MESSAGES = _MESSAGE_LIFE + f""",
messages AS MATERIALIZED (
  SELECT m.message_id AS id, m.chat_id, b.owner_id, w.content, b.created_at AS created_timestamp,
         CASE WHEN w.name = 'messageEdited' THEN w.created_at END AS updated_timestamp
  FROM message_life m
  JOIN log b ON b.log_seq = (SELECT max(log_seq) FROM log x WHERE x.name = 'messageCreated'
                             AND x.chat_id = m.chat_id AND x.message_id = m.message_id)
  JOIN log w ON w.log_seq = (SELECT max(log_seq) FROM log x WHERE x.name IN ('messageCreated', 'messageEdited')
                             AND x.chat_id = m.chat_id AND x.message_id = m.message_id)
  WHERE m.to_seq = {OPEN}
)"""

_VERSIONS = f""",
versions AS MATERIALIZED (
  SELECT e.chat_id, e.message_id AS id, m.from_seq AS born,
    (SELECT arg_max(x.owner_id, x.log_seq) FROM log x WHERE x.name = 'messageCreated' AND x.chat_id = e.chat_id
     AND x.message_id = e.message_id AND x.log_seq <= e.log_seq) AS owner_id,
    e.content, e.log_seq AS from_seq,
    coalesce((SELECT min(x.log_seq) FROM log x
              WHERE x.name IN ('messageCreated', 'messageEdited', 'messageDeleted')
              AND x.chat_id = e.chat_id AND x.message_id = e.message_id AND x.log_seq > e.log_seq), {OPEN}) AS to_seq
  FROM log e JOIN message_life m ON m.chat_id = e.chat_id AND m.message_id = e.message_id
    AND m.from_seq <= e.log_seq AND e.log_seq < m.to_seq
  WHERE e.name IN ('messageCreated', 'messageEdited')
)"""

# The view: operations since the current membership began.
_VIEW = _MEMBERS + _MESSAGE_LIFE + _VERSIONS + """,
view_ops AS MATERIALIZED (
  SELECT chat_id, unnest(list_distinct(participant_ids)) AS user_id, log_seq, created_at, chat_title AS title,
         false AS pinned, true AS preview, true AS touch FROM adds WHERE valid
  UNION ALL
  SELECT chat_id, unnest(list_distinct(participant_ids)), log_seq, created_at,
         CASE WHEN chat_common_action = 1 THEN title END, NULL, last_message_action = 1, true
  FROM log WHERE name = 'chatViewRefreshed'
  UNION ALL
  SELECT chat_id, participant_id, log_seq, created_at, NULL, pinned, false, false FROM log WHERE name = 'chatPinned'
),
view_keys AS (
  SELECT m.user_id, m.chat_id,
    arg_max(o.title, o.log_seq) FILTER (WHERE o.title IS NOT NULL) AS title,
    arg_max(o.pinned, o.log_seq) FILTER (WHERE o.pinned IS NOT NULL) AS pinned,
    arg_max(o.created_at, o.log_seq) FILTER (WHERE o.touch) AS updated_timestamp,
    max(o.log_seq) FILTER (WHERE o.preview) AS previewed
  FROM members m JOIN view_ops o ON o.user_id = m.user_id AND o.chat_id = m.chat_id AND o.log_seq >= m.from_seq
  GROUP BY m.user_id, m.chat_id
),
previews AS (
  SELECT k.user_id, k.chat_id, max(v.id) AS last_message_id, arg_max(v.content, v.id) AS last_message_content,
         arg_max(v.owner_id, v.id) AS last_message_owner_id
  FROM view_keys k JOIN versions v ON v.chat_id = k.chat_id AND v.from_seq <= k.previewed AND k.previewed < v.to_seq
  GROUP BY k.user_id, k.chat_id
),
user_view AS MATERIALIZED (
  SELECT k.chat_id AS id, k.title, k.pinned, k.user_id, k.updated_timestamp,
         p.last_message_id, p.last_message_content, p.last_message_owner_id
  FROM view_keys k LEFT JOIN previews p ON p.user_id = k.user_id AND p.chat_id = k.chat_id
)"""

# The counters: all operations of a (user, chat) taken one after the other.
_STEPS = """,
ops AS (
  SELECT chat_id, unnest(list_distinct(participant_ids)) AS user_id, log_seq, 'add' AS op, 0 AS given, 0 AS n
  FROM adds WHERE valid
  UNION ALL
  SELECT chat_id, unnest(list_distinct(participant_ids)), log_seq, 'refill', 0, 0
  FROM log WHERE name = 'chatViewRefreshed' AND unread_action = 1
  UNION ALL
  SELECT chat_id, participant_id, log_seq, 'read', message_id, 0 FROM log WHERE name = 'messageReaded'
  UNION ALL
  SELECT chat_id, u, log_seq, CASE WHEN u = owner_id THEN 'post' ELSE 'bump' END, 0, increase_on
  FROM (SELECT *, unnest(list_distinct(participant_ids)) AS u FROM log
        WHERE name = 'chatViewRefreshed' AND unread_action = 2)
),
alive AS (
  SELECT o.chat_id, o.log_seq, list(m.message_id) AS ids
  FROM (SELECT DISTINCT chat_id, log_seq FROM ops) o
  JOIN message_life m ON m.chat_id = o.chat_id AND m.from_seq <= o.log_seq AND o.log_seq < m.to_seq
  GROUP BY o.chat_id, o.log_seq
),
numbered_ops AS MATERIALIZED (
  SELECT o.*, coalesce(a.ids, []) AS ids, coalesce(list_max(a.ids), 0) AS top,
         row_number() OVER (PARTITION BY o.user_id, o.chat_id ORDER BY o.log_seq) AS i
  FROM ops o LEFT JOIN alive a ON a.chat_id = o.chat_id AND a.log_seq = o.log_seq
),
steps AS (
  SELECT user_id, chat_id, 0::BIGINT AS i, -1::BIGINT AS log_seq, false AS ex, 0::BIGINT AS marker, 0::BIGINT AS unread
  FROM (SELECT DISTINCT user_id, chat_id FROM numbered_ops)
  UNION ALL
  SELECT user_id, chat_id, i, log_seq, ex OR op IN ('add', 'refill', 'read'), next_marker,
    CASE WHEN op IN ('add', 'refill', 'read') THEN CAST(len([x FOR x IN ids IF x > next_marker]) AS BIGINT)
         WHEN op = 'bump' AND ex THEN unread + n ELSE unread END
  FROM (
    SELECT o.user_id, o.chat_id, o.i, o.log_seq, o.op, o.ids, CAST(o.n AS BIGINT) AS n, s.ex, s.unread,
      CAST(CASE WHEN o.op = 'read' THEN CASE WHEN list_contains(o.ids, o.given) THEN o.given ELSE o.top END
           WHEN o.op = 'post' THEN CASE WHEN s.ex THEN o.top ELSE s.marker END
           WHEN o.op = 'bump' THEN s.marker
           WHEN NOT s.ex OR s.marker <= 0 THEN 0
           WHEN list_contains(o.ids, s.marker) THEN s.marker
           WHEN o.op = 'refill' THEN o.top ELSE 0 END AS BIGINT) AS next_marker
    FROM steps s JOIN numbered_ops o ON o.user_id = s.user_id AND o.chat_id = s.chat_id AND o.i = s.i + 1
  )
),
all_steps AS MATERIALIZED (SELECT * FROM steps WHERE ex),
unread AS MATERIALIZED (
  SELECT user_id, chat_id, arg_max(unread, i) AS unread_messages, arg_max(marker, i) AS last_message_id
  FROM all_steps GROUP BY user_id, chat_id
)"""

_UNREAD = _MEMBERS + _MESSAGE_LIFE + _STEPS
_LIST = _VIEW + _STEPS + """,
chat_list AS (
  SELECT v.user_id, row_number() OVER (PARTITION BY v.user_id ORDER BY v.pinned DESC, v.updated_timestamp DESC, v.id DESC)
           AS pos, v.id, v.title, v.pinned, u.unread_messages, v.last_message_id, v.last_message_owner_id,
         v.last_message_content
  FROM user_view v JOIN unread u ON u.user_id = v.user_id AND u.chat_id = v.id
)"""

_WIDEST_USER = """(
  SELECT user_id FROM (SELECT DISTINCT chat_id, unnest(participant_ids) AS user_id FROM log WHERE name = 'participantsAdded')
  GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 1)"""

_COMMANDS = """,
cmds AS (
  SELECT event_id * 4 AS cmd_seq, act, user_id, chat_id, ts, k, value, event_id, block,
    CASE act WHEN 'medit' THEN greatest(0, mx - s % 3) WHEN 'mdel' THEN greatest(0, mx - s % 4)
             WHEN 'read' THEN greatest(0, mx - s % 3) + k % 2 END AS message_id
  FROM acts
)"""

_USERS_BEFORE = """coalesce((
    SELECT string_agg(CAST(m.user_id AS VARCHAR), ',' ORDER BY m.user_id) FROM member_life m
    WHERE m.chat_id = c.chat_id AND m.from_seq < c.cmd_seq AND c.cmd_seq <= m.to_seq), '')"""
# A membership that ends exactly at the command's own position is still seen by the command.

_NEWEST_BEFORE = """(SELECT max(m.message_id) FROM message_life m
    WHERE m.chat_id = c.chat_id AND m.from_seq < c.cmd_seq AND c.cmd_seq <= m.to_seq)"""


def _sql(ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + select.strip()


def _payload(content: str, owner: str, refreshed_owner: str, unread: int, message: int, increase: int) -> str:
    """What the event of slot 0 and the refresh of slot 1 carry."""
    at = lambda value, kind: f"CAST(CASE WHEN slot = 1 THEN {value} END AS {kind})"
    return f"""CAST(CASE WHEN slot = 0 THEN {content} END AS VARCHAR) AS content,
                   CAST(CASE slot WHEN 0 THEN {owner} ELSE {refreshed_owner} END AS BIGINT) AS owner_id,
                   {at(unread, "SMALLINT")} AS unread_action, {at(message, "SMALLINT")} AS last_message_action,
                   {at(0, "SMALLINT")} AS chat_common_action, {at(increase, "BIGINT")} AS increase_on, ts AS created_at"""


def _changes(act: str) -> str:
    """Edits and deletions of messages with the verdict of the owner rule."""
    return f""",
changes AS (
  SELECT c.*, v.owner_id AS true_owner, {_NEWEST_BEFORE} AS newest, {_USERS_BEFORE} AS users,
    CASE WHEN v.owner_id IS NULL THEN 'no such message' WHEN v.owner_id <> c.user_id THEN 'not the owner' END AS reason
  FROM cmds c LEFT JOIN versions v ON v.chat_id = c.chat_id AND v.id = c.message_id
    AND v.from_seq < c.cmd_seq AND c.cmd_seq <= v.to_seq
  WHERE c.act = '{act}'
)"""


_TEXT_IDS = "array_to_string(participant_ids, ',')"
_FIELDS_TEXT = ", ".join(_TEXT_IDS + " AS participant_ids" if f == "participant_ids" else f for f in _FIELDS)

_VERDICT = """
SELECT j.cmd_seq, CASE WHEN j.reason IS NULL THEN 'accept' ELSE 'reject' END AS decision, j.reason,
       e.slot, e.name, e.message_id, e.users, e.content, e.owner_id, e.unread_action, e.last_message_action,
       e.chat_common_action, e.increase_on, e.created_at
FROM {judged} j LEFT JOIN ({events}) e ON e.cmd_seq = j.cmd_seq AND j.reason IS NULL
"""



def _digest(columns: str) -> str:
    """The sum of the rows' MD5s as four numbers of 32 bits, in hex; a row is its columns by name, with their lengths."""
    text = ", ".join(
        f"CASE WHEN {c} IS NULL THEN 'n' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
        for c in sorted(columns.split()))
    parts = [f"format('{{:08x}}', CAST(coalesce(sum(CAST('0x' || substr(md5(concat({text})), {8 * i + 1}, 8) AS BIGINT)), 0)"
             " % 4294967296 AS BIGINT))" for i in range(4)]
    return " || ".join(parts) + " AS digest"


_SUMMARY = f"""
SELECT 'chat_common' AS table_name, count(*) AS rows,
  CAST(coalesce(sum(id + last_generated_message_id), 0) AS BIGINT) AS checksum,
  {_digest("id title last_generated_message_id created_timestamp")}
FROM (SELECT id, title, created_timestamp, coalesce((SELECT max(m.id) FROM messages m WHERE m.chat_id = chats.id), 0)
  AS last_generated_message_id FROM chats) c
UNION ALL SELECT 'chat_participant', count(*), CAST(sum(user_id * 31 + chat_id) AS BIGINT),
  {_digest("user_id chat_id")} FROM members
UNION ALL SELECT 'message', count(*), CAST(sum(id * 31 + owner_id + length(content)) AS BIGINT),
  {_digest("id chat_id owner_id content created_timestamp updated_timestamp")} FROM messages
UNION ALL SELECT 'chat_user_view', count(*),
  CAST(sum(user_id + coalesce(last_message_id, 0) * 31 + length(title)) AS BIGINT),
  {_digest("id title pinned user_id updated_timestamp last_message_id last_message_content last_message_owner_id")} FROM user_view
UNION ALL SELECT 'unread_messages_user_view', count(*),
  CAST(sum(unread_messages * 31 + last_message_id) AS BIGINT),
  {_digest("user_id chat_id unread_messages last_message_id")} FROM unread
"""

_NO_DIFF = """
SELECT t AS table_name, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra
FROM (VALUES ('chat_common'), ('chat_participant'), ('message'), ('chat_user_view'), ('unread_messages_user_view')) v(t)
"""

_SCAN = 'SELECT log_seq, partition, "offset", CAST(chat_id AS VARCHAR) AS key, name FROM log'

_SPOILED = """,
spoiled AS (
  SELECT * REPLACE (
    CASE WHEN name = 'chatEdited' THEN repeat(title, 200) ELSE title END AS title,
    CASE WHEN name = 'participantsAdded' AND chat_id % 2 = 0 THEN participant_ids || participant_ids
         ELSE participant_ids END AS participant_ids)
  FROM log
)"""


def _fill(users: str, fallback: str, ids: str = "ids") -> str:
    """The markers after a fill of ``users``: kept if their message lives, else the fallback; new ones are 0."""
    one = "list_filter(marks, lambda y: y.u = x)[1].m"
    return (f"list_concat(list_filter(marks, lambda y: NOT list_contains({users}, y.u)), list_transform({users}, lambda x: "
            f"{{'u': x, 'm': CASE WHEN {one} > 0 AND NOT list_contains({ids}, {one}) THEN {fallback} "
            f"ELSE greatest(coalesce({one}, 0), 0) END, 'n': 0}}))")


def _counted(marks: str, users: str, ids: str) -> str:
    """The markers with the counters of ``users`` taken anew."""
    return (f"list_transform({marks}, lambda z: CASE WHEN list_contains({users}, z.u) THEN {{'u': z.u, 'm': z.m, 'n': "
            f"len(list_filter({ids}, lambda w: w > z.m))}} ELSE z END)")


# All commands as a batch that starts from nothing, taken one after the other in every chat.
_BULK = """,
places AS (SELECT chat_id, row_number() OVER (ORDER BY chat_id) AS place FROM (SELECT DISTINCT chat_id FROM acts)),
batch AS (
  SELECT place AS cmd_seq, place AS chat, 'create' AS act, (chat_id - 1) // 4 * 5 AS u, CAST(NULL AS BIGINT) AS given,
         [(chat_id - 1) // 4 * 5, (chat_id - 1) // 4 * 5 + 1] AS listed FROM places
  UNION ALL
  SELECT event_id * 4 + (SELECT count(*) + 1 FROM places),
         CASE WHEN act = 'create' THEN (SELECT count(*) FROM places) + row_number() OVER (PARTITION BY act ORDER BY event_id)
              ELSE place END,
         act, user_id,
         CASE act WHEN 'medit' THEN greatest(0, mx - s % 3) WHEN 'mdel' THEN greatest(0, mx - s % 4)
                  WHEN 'read' THEN greatest(0, mx - s % 3) + k % 2 END,
         CASE WHEN act = 'create' THEN CASE WHEN user_id IN (block * 5, block * 5 + 1) THEN [block * 5, block * 5 + 1]
                                            ELSE [block * 5, block * 5 + 1, user_id] END
              WHEN act IN ('add', 'leave') OR act = 'edit' AND k % 2 = 0 THEN [user_id] ELSE [] END
  FROM acts JOIN places USING (chat_id)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY cmd_seq) AS i FROM batch),
steps AS (
  SELECT chat, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS cmd_seq, '' AS act, false AS alive, CAST([] AS BIGINT[]) AS members,
         CAST(0 AS BIGINT) AS cnt, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS owners,
         CAST([] AS STRUCT(u BIGINT, m BIGINT, n BIGINT)[]) AS marks, CAST(NULL AS BIGINT) AS message_id,
         CAST(NULL AS BIGINT[]) AS told, 0 AS n_events, CAST(NULL AS VARCHAR) AS reason
  FROM (SELECT DISTINCT chat FROM batch)
  UNION ALL
  SELECT chat, i, cmd_seq, act,
    CASE act WHEN 'create' THEN true WHEN 'cdel' THEN false ELSE alive END,
    CASE WHEN act = 'cdel' THEN [] WHEN act = 'leave' THEN list_filter(members, lambda x: NOT list_contains(listed, x))
         WHEN joins THEN list_distinct(list_concat(members, listed)) ELSE members END,
    CASE WHEN act = 'msg' AND alive THEN cnt + 1 ELSE cnt END,
    new_ids,
    CASE WHEN act = 'msg' AND alive THEN list_append(owners, u) ELSE owners END,
    CASE WHEN joins THEN """ + _counted(_fill("listed", "0"), "listed", "ids") + """
         WHEN act = 'msg' AND alive THEN list_transform(marks, lambda z: CASE WHEN NOT list_contains(members, z.u) THEN z
              WHEN z.u = u THEN {'u': z.u, 'm': cnt + 1, 'n': z.n} ELSE {'u': z.u, 'm': z.m, 'n': z.n + 1} END)
         WHEN act = 'mdel' AND reason IS NULL THEN """ + _counted(
             _fill("members", "coalesce(list_max(new_ids), 0)", "new_ids"), "members", "new_ids") + """
         WHEN moves THEN """ + _counted(
             "list_transform(marks, lambda z: CASE WHEN z.u = u THEN {'u': z.u, 'm': CASE WHEN list_contains(ids, clamped) "
             "THEN clamped ELSE list_max(ids) END, 'n': z.n} ELSE z END)", "[u]", "ids") + """
         ELSE marks END,
    CASE WHEN act = 'msg' AND alive THEN cnt + 1 WHEN act IN ('medit', 'mdel') AND reason IS NULL THEN given
         WHEN moves THEN clamped END,
    CASE WHEN act IN ('edit', 'cdel') OR act = 'msg' AND alive OR act = 'mdel' AND reason IS NULL
              OR act = 'medit' AND reason IS NULL AND given = list_max(ids) THEN members END,
    CASE WHEN reason IS NOT NULL THEN 0 WHEN act = 'edit' THEN 2 + len(listed) WHEN act IN ('create', 'cdel', 'msg', 'mdel') THEN 2
         WHEN act = 'medit' THEN CASE WHEN given = list_max(ids) THEN 2 ELSE 1 END
         WHEN act = 'read' THEN CASE WHEN moves THEN 1 ELSE 0 END ELSE 1 END,
    reason
  FROM (
    SELECT s.* EXCLUDE (i, cmd_seq, act, reason), r.i, r.cmd_seq, r.act, r.u, r.given, r.listed,
      r.act = 'create' OR r.act IN ('add', 'edit') AND s.alive AND len(r.listed) > 0 AS joins,
      least(r.given, list_max(s.ids)) AS clamped,
      CASE WHEN r.act = 'msg' AND NOT s.alive THEN 'no such chat'
           WHEN r.act IN ('medit', 'mdel') AND NOT list_contains(s.ids, r.given) THEN 'no such message'
           WHEN r.act IN ('medit', 'mdel') AND s.owners[r.given] <> r.u THEN 'not the owner'
           WHEN r.act = 'read' AND (len(s.ids) = 0 OR len(list_filter(s.marks, lambda z: z.u = r.u)) = 0) THEN 'no read state'
      END AS reason,
      CASE WHEN r.act = 'msg' AND s.alive THEN list_append(s.ids, s.cnt + 1)
           WHEN r.act = 'mdel' AND list_contains(s.ids, r.given) AND s.owners[r.given] = r.u
           THEN list_filter(s.ids, lambda x: x <> r.given) ELSE s.ids END AS new_ids,
      coalesce(r.act = 'read' AND len(s.ids) > 0 AND len(list_filter(s.marks, lambda z: z.u = r.u AND CASE
        WHEN list_contains(s.ids, z.m) THEN least(r.given, list_max(s.ids)) > z.m ELSE z.m = 0 END)) > 0, false) AS moves
    FROM steps s JOIN ranked r ON r.chat = s.chat AND r.i = s.i + 1
  )
)"""


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    log = _LOG
    out = {
        "log_scan": _sql(log, _SCAN),
        "log_import": _sql(log, _SCAN),
        "log_bounded_scan": _sql(log, """
            SELECT partition, count(*) AS rows, max("offset") + 1 AS end_offset
            FROM log l WHERE "offset" < (SELECT count(*) // 2 FROM log x WHERE x.partition = l.partition)
            GROUP BY partition"""),
        "log_stream_resumed": _sql(log, """
            SELECT partition, count(*) AS end_offset, count(*) // 2 AS committed, count(*) - count(*) // 2 AS lag,
                   count(*) AS rows, CAST(sum("offset") AS BIGINT) AS offsets
            FROM log GROUP BY partition"""),
        "log_append": _sql(log, 'SELECT partition, "offset", CAST(chat_id AS VARCHAR) AS key, chat_id FROM log'),
        "log_export": _sql(log, 'SELECT partition, "offset", CAST(chat_id AS VARCHAR) AS key, name, chat_id FROM log'),
        "import_validation": _sql(log, """
            SELECT partition, "offset", "offset" % 7 > 4 AS ok,
              CASE "offset" % 7 WHEN 0 THEN 'line is not JSON' WHEN 1 THEN 'key is not a string'
                   WHEN 2 THEN 'partition is not an integer' WHEN 3 THEN 'partition is not an integer'
                   WHEN 4 THEN 'header value is not a string' END AS reason
            FROM log"""),
        "import_rejects": _sql(log, """
            SELECT partition, "offset" + 1 AS line, 'line is not JSON' AS reason
            FROM (SELECT *, row_number() OVER (ORDER BY partition, "offset") AS pos FROM log) WHERE pos % 7 = 0"""),
        "import_append": _sql(log, 'SELECT partition, "offset", CAST(chat_id AS VARCHAR) AS key FROM log'),
        "decode_damaged": _sql(log, """
            SELECT log_seq, name, CASE WHEN fine THEN chat_id END AS chat_id,
              CASE WHEN fine THEN CASE WHEN lacks AND name = 'chatPinned' THEN false ELSE pinned END END AS pinned,
              CASE WHEN fine THEN CASE WHEN lacks AND name IN ('messageCreated', 'messageEdited') THEN '' ELSE content END
              END AS content,
              CASE WHEN fine THEN CASE WHEN lacks AND name IN ('chatCreated', 'chatEdited', 'chatViewRefreshed') THEN ''
                                       ELSE title END END AS title,
              CASE WHEN fine THEN CASE WHEN lacks AND name IN ('messageCreated', 'chatViewRefreshed') THEN 0
                                       ELSE owner_id END END AS owner_id,
              CASE WHEN NOT fine THEN 'value is not an event' END AS reason
            FROM (SELECT *, "offset" % 6 IN (2, 5) AS fine, "offset" % 6 = 2 AS lacks FROM log)"""),
        "unread_after_redelivery": _sql(log + _UNREAD, "SELECT user_id, chat_id, unread_messages, last_message_id FROM unread"),
        "roundtrip_diff": _NO_DIFF.strip(),
        "replay_incremental": _NO_DIFF.strip(),
        "events_decode": _sql(log, f'SELECT log_seq, partition, "offset", chat_id, name, created_at, {_FIELDS_TEXT} FROM log'),
        "events_by_type": _sql(log, """
            SELECT name, count(*) AS n, count(DISTINCT chat_id) AS chats, min(log_seq) AS first_seq,
                   max(log_seq) AS last_seq FROM log GROUP BY name"""),
        "events_unknown": _sql(log, """
            SELECT log_seq, name || 'V2' AS name, 'unknown event name' AS reason FROM log WHERE "offset" % 5 = 0"""),
        "partition_balance": _sql(log, """
            SELECT partition, count(DISTINCT chat_id) AS chats, count(*) AS events, CAST(0 AS BIGINT) AS split_chats
            FROM log GROUP BY partition"""),
        "events_ordered": _sql(log, """
            SELECT chat_id, log_seq, name, row_number() OVER w AS pos, lag(name) OVER w AS prev_name,
                   lead(name) OVER w AS next_name
            FROM log WINDOW w AS (PARTITION BY chat_id ORDER BY log_seq)"""),
        "log_dedup": _sql(log, """
            SELECT partition, count(*) + count(*) FILTER (WHERE "offset" % 3 = 0) AS rows_before, count(*) AS rows_after
            FROM log GROUP BY partition"""),
        "poison_events": _sql(log + _MESSAGE_LIFE + _SPOILED, """
            SELECT log_seq, 'title too long' AS reason FROM spoiled
            WHERE name IN ('chatCreated', 'chatEdited') AND length(title) > 512
            UNION ALL
            SELECT log_seq, 'participant listed twice' FROM spoiled
            WHERE (name = 'participantsAdded' OR (name = 'chatViewRefreshed' AND unread_action = 1))
              AND len(participant_ids) > len(list_distinct(participant_ids))
            UNION ALL
            SELECT -min(log_seq) - 1, 'owner increase in a chat without messages' FROM log
            WHERE name = 'chatCreated' GROUP BY chat_id
            UNION ALL
            SELECT log_seq, 'owner increase in a chat without messages' FROM log s
            WHERE name = 'chatViewRefreshed' AND unread_action = 2 AND list_contains(participant_ids, owner_id)
              AND NOT EXISTS (SELECT 1 FROM message_life m WHERE m.chat_id = s.chat_id
                              AND m.from_seq <= s.log_seq AND s.log_seq < m.to_seq)"""),
        "chat_lifetimes": _sql(log + _CHAT_LIFE, "SELECT chat_id, from_seq, to_seq FROM chat_life"),
        "chat_common": _sql(log + _CHATS, """
            SELECT id, title, CAST(0 AS BIGINT) AS last_generated_message_id, created_timestamp FROM chats"""),
        "adds_skipped": _sql(log + _ADDS, """
            SELECT log_seq, chat_id, unnest(list_distinct(participant_ids)) AS user_id FROM adds WHERE NOT valid"""),
        "chat_participant": _sql(log + _MEMBERS, "SELECT user_id, chat_id FROM members"),
        "membership_intervals": _sql(log + _MEMBER_LIFE, "SELECT user_id, chat_id, from_seq, to_seq FROM member_life"),
        "pinned_chats": _sql(log + _VIEW, "SELECT user_id, id AS chat_id FROM user_view WHERE pinned"),
        "chat_user_view": _sql(log + _VIEW, "SELECT * FROM user_view"),
        "last_message_view": _sql(log + _VIEW, """
            SELECT user_id, id AS chat_id, last_message_id, last_message_owner_id, last_message_content FROM user_view"""),
        "message_lifetimes": _sql(log + _MESSAGE_LIFE, """
            SELECT chat_id, message_id AS id, from_seq, to_seq FROM message_life"""),
        "message_versions": _sql(log + _MESSAGE_LIFE + _VERSIONS, """
            SELECT chat_id, id, owner_id, content, from_seq, to_seq FROM versions"""),
        "message_table": _sql(log + _MESSAGES, "SELECT * FROM messages"),
        "fanout_users": _sql(log, """
            SELECT log_seq, chat_id, unnest(list_distinct(participant_ids)) AS user_id FROM log"""),
        "marker_status": _sql(log + _UNREAD, f"""
            SELECT user_id, chat_id, marker, alive, max_id,
              CASE WHEN marker > 0 AND alive THEN marker ELSE 0 END AS carried_add,
              CASE WHEN marker <= 0 THEN 0 WHEN alive THEN marker ELSE max_id END AS carried_refresh
            FROM (
              SELECT user_id, chat_id, last_message_id AS marker,
                EXISTS (SELECT 1 FROM message_life m WHERE m.chat_id = u.chat_id AND m.message_id = u.last_message_id
                        AND m.to_seq = {OPEN}) AS alive,
                coalesce((SELECT max(m.message_id) FROM message_life m WHERE m.chat_id = u.chat_id
                          AND m.to_seq = {OPEN}), 0) AS max_id
              FROM unread u)"""),
        "read_normalized": _sql(log + _MESSAGE_LIFE, """
            SELECT l.log_seq, l.participant_id AS user_id, l.chat_id, l.message_id AS given,
              coalesce((SELECT m.message_id FROM message_life m WHERE m.chat_id = l.chat_id
                        AND m.message_id = l.message_id AND m.from_seq <= l.log_seq AND l.log_seq < m.to_seq),
                       (SELECT max(m.message_id) FROM message_life m WHERE m.chat_id = l.chat_id
                        AND m.from_seq <= l.log_seq AND l.log_seq < m.to_seq), 0) AS normalized
            FROM log l WHERE l.name = 'messageReaded'"""),
        "unread_counts": _sql(log + _UNREAD, f"""
            SELECT user_id, chat_id, last_message_id AS marker,
              (SELECT count(*) FROM message_life m WHERE m.chat_id = u.chat_id AND m.to_seq = {OPEN}
               AND m.message_id > u.last_message_id) AS n
            FROM unread u"""),
        "unread_view": _sql(log + _UNREAD, "SELECT user_id, chat_id, unread_messages, last_message_id FROM unread"),
        "refresh_batches": _sql(log + _UNREAD, "SELECT user_id, chat_id, unread_messages, last_message_id FROM unread"),
        "chats_for_user": _sql(log + _LIST, """
            SELECT * FROM chat_list WHERE user_id = (SELECT min(user_id) FROM user_view)"""),
        "chats_for_user_indexed": _sql(log + _LIST, f"SELECT * FROM chat_list WHERE user_id = {_WIDEST_USER}"),
        "chats_for_user_page": _sql(log + _LIST, f"""
            SELECT * EXCLUDE (pos) FROM chat_list WHERE user_id = {_WIDEST_USER} AND pos BETWEEN 4 AND 6"""),
        "chat_list_all": _sql(log + _LIST, "SELECT * FROM chat_list"),
        "messages_of_chat": _sql(log + _MESSAGES, """
            SELECT row_number() OVER (ORDER BY id DESC) AS pos, id, owner_id, content FROM messages WHERE chat_id = 1"""),
        "participants_of_chat": _sql(log + _MEMBERS, """
            SELECT row_number() OVER (ORDER BY user_id) AS pos, user_id FROM members WHERE chat_id = 1"""),
        "participants_all": _sql(log + _MEMBERS, """
            SELECT chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY user_id) AS pos, user_id FROM members"""),
        "chat_title_for_user": _sql(log + _MEMBERS + _CHATS.replace(_CHAT_LIFE, ""), """
            SELECT m.user_id, m.chat_id, c.title FROM members m JOIN chats c ON c.id = m.chat_id"""),
        "message_owner": _sql(log + _MESSAGES, """
            SELECT DISTINCT m.chat_id, m.id, m.owner_id FROM messages m
            JOIN log l ON l.chat_id = m.chat_id AND l.message_id = m.id
            WHERE l.name IN ('messageEdited', 'messageDeleted')"""),
        "read_state": _sql(log + _UNREAD, f"""
            SELECT user_id, chat_id, last_message_id AS marker,
              EXISTS (SELECT 1 FROM message_life m WHERE m.chat_id = u.chat_id AND m.message_id = u.last_message_id
                      AND m.to_seq = {OPEN}) AS marker_exists,
              (SELECT max(m.message_id) FROM message_life m WHERE m.chat_id = u.chat_id AND m.to_seq = {OPEN}) AS max_id
            FROM unread u"""),
        "last_message_id": _sql(log + _CHATS + _MESSAGES, """
            SELECT id AS chat_id, coalesce((SELECT max(m.id) FROM messages m WHERE m.chat_id = chats.id), 0) AS last_id
            FROM chats"""),
        "chat_ids": _sql(log + _CHATS, "SELECT row_number() OVER (ORDER BY id) AS pos, id FROM chats"),
        "cmd_chat_create": _sql(log + _COMMANDS, """
            SELECT cmd_seq, slot, name, chat_id, CASE WHEN slot = 1 THEN users END AS users,
                   CASE WHEN slot = 0 THEN 'c' || event_id END AS title
            FROM (SELECT cmd_seq, event_id,
                    (SELECT max(chat_id) FROM log) + row_number() OVER (ORDER BY cmd_seq) AS chat_id,
                    CASE WHEN user_id IN (block * 5, block * 5 + 1) THEN concat_ws(',', block * 5, block * 5 + 1)
                         ELSE concat_ws(',', block * 5, block * 5 + 1, user_id) END AS users
                  FROM cmds WHERE act = 'create'),
              (VALUES (0, 'chatCreated'), (1, 'participantsAdded')) v(slot, name)"""),
        "cmd_chat_edit": _sql(log + _MEMBER_LIFE + _COMMANDS, f"""
            SELECT cmd_seq, slot, name, chat_id,
              CASE slot WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN {_USERS_BEFORE} END AS users,
              CASE WHEN slot <> 1 THEN 't' || event_id END AS title,
              CAST(CASE WHEN slot = 2 THEN 0 END AS BIGINT) AS owner_id,
              CAST(CASE WHEN slot = 2 THEN 0 END AS SMALLINT) AS unread_action,
              CAST(CASE WHEN slot = 2 THEN 0 END AS SMALLINT) AS last_message_action,
              CAST(CASE WHEN slot = 2 THEN 1 END AS SMALLINT) AS chat_common_action,
              CAST(CASE WHEN slot = 2 THEN 0 END AS BIGINT) AS increase_on, ts AS created_at
            FROM cmds c, (VALUES (0, 'chatEdited'), (1, 'participantsAdded'), (2, 'chatViewRefreshed')) v(slot, name)
            WHERE act = 'edit' AND (slot <> 1 OR k % 2 = 0)"""),
        "cmd_chat_delete": _sql(log + _MEMBER_LIFE + _COMMANDS, f"""
            SELECT cmd_seq, slot, name, chat_id, CASE WHEN slot = 1 THEN {_USERS_BEFORE} END AS users
            FROM cmds c, (VALUES (0, 'chatDeleted'), (1, 'participantDeleted')) v(slot, name) WHERE act = 'cdel'"""),
        "cmd_participants": _sql(log + _COMMANDS, """
            SELECT cmd_seq, 0 AS slot, CASE act WHEN 'add' THEN 'participantsAdded' ELSE 'participantDeleted' END AS name,
                   chat_id, CAST(user_id AS VARCHAR) AS users FROM cmds WHERE act IN ('add', 'leave')"""),
        "cmd_chat_pin": _sql(log + _COMMANDS, """
            SELECT cmd_seq, 0 AS slot, 'chatPinned' AS name, chat_id, user_id AS participant_id, value >= 10 AS pinned
            FROM cmds WHERE act = 'pin'"""),
        "cmd_message_create": _sql(log + _MEMBER_LIFE + _COMMANDS + f""",
            posted AS (
              SELECT c.*, {_USERS_BEFORE} AS users,
                coalesce((SELECT max(l.message_id) FROM log l WHERE l.chat_id = c.chat_id AND l.name = 'messageCreated'
                          AND l.log_seq < c.cmd_seq), 0) + 1 AS new_id,
                CASE WHEN NOT EXISTS (SELECT 1 FROM chat_life x WHERE x.chat_id = c.chat_id AND x.from_seq < c.cmd_seq
                                      AND c.cmd_seq <= x.to_seq) THEN 'no such chat' END AS reason
              FROM cmds c WHERE act = 'msg')""", _VERDICT.format(judged="posted", events="""
            SELECT cmd_seq, slot, name, CASE WHEN slot = 0 THEN new_id END AS message_id,
                   CASE WHEN slot = 1 THEN users END AS users,
            """ + _payload("'m' || event_id", "user_id", "user_id", 2, 1, 1) + """
            FROM posted, (VALUES (0, 'messageCreated'), (1, 'chatViewRefreshed')) v(slot, name)""")),
        "cmd_message_edit": _sql(
            log + _MEMBER_LIFE + _MESSAGE_LIFE + _VERSIONS + _COMMANDS + _changes("medit"),
            _VERDICT.format(judged="changes", events="""
            SELECT cmd_seq, slot, name, CASE WHEN slot = 0 THEN message_id END AS message_id,
                   CASE WHEN slot = 1 THEN users END AS users,
            """ + _payload("'e' || event_id", "NULL", "0", 0, 1, 0) + """
            FROM changes, (VALUES (0, 'messageEdited'), (1, 'chatViewRefreshed')) v(slot, name)
            WHERE slot = 0 OR newest = message_id""")),
        "cmd_message_delete": _sql(
            log + _MEMBER_LIFE + _MESSAGE_LIFE + _VERSIONS + _COMMANDS + _changes("mdel"),
            _VERDICT.format(judged="changes", events="""
            SELECT cmd_seq, slot, name, CASE WHEN slot = 0 THEN message_id END AS message_id,
                   CASE WHEN slot = 1 THEN users END AS users,
            """ + _payload("NULL", "NULL", "user_id", 1, 1, 0) + """
            FROM changes, (VALUES (0, 'messageDeleted'), (1, 'chatViewRefreshed')) v(slot, name)""")),
        "cmd_rejects": _sql(log + _COMMANDS, """
            SELECT cmd_seq, CASE act WHEN 'msg' THEN 'message_create' WHEN 'medit' THEN 'message_edit'
                WHEN 'mdel' THEN 'message_delete' WHEN 'read' THEN 'message_read' WHEN 'pin' THEN 'chat_pin'
                WHEN 'add' THEN 'participant_add' WHEN 'leave' THEN 'participant_delete' WHEN 'edit' THEN 'chat_edit'
                WHEN 'create' THEN 'chat_create' ELSE 'chat_delete' END AS kind, 'id is not a number' AS reason
            FROM cmds WHERE cmd_seq % 20 = 0 OR (cmd_seq % 20 = 4 AND act <> 'create')
              OR (cmd_seq % 20 = 8 AND act IN ('medit', 'mdel', 'read'))"""),
        "read_admission": _sql(log + _UNREAD + _COMMANDS + f""",
            judged AS (
              SELECT c.cmd_seq, c.user_id, c.chat_id, c.message_id AS given, {_NEWEST_BEFORE} AS newest,
                (SELECT arg_max(s.marker, s.i) FROM all_steps s WHERE s.user_id = c.user_id AND s.chat_id = c.chat_id
                 AND s.log_seq < c.cmd_seq) AS marker
              FROM cmds c WHERE act = 'read')""", """
            SELECT cmd_seq, user_id, chat_id, given, CASE WHEN newest IS NOT NULL THEN least(given, newest) END AS clamped,
              CASE WHEN marker IS NULL OR newest IS NULL THEN 'error'
                   WHEN EXISTS (SELECT 1 FROM message_life m WHERE m.chat_id = j.chat_id AND m.message_id = j.marker
                                AND m.from_seq < j.cmd_seq AND j.cmd_seq <= m.to_seq)
                        THEN CASE WHEN least(given, newest) > marker THEN 'accept' ELSE 'ignore' END
                   WHEN marker = 0 THEN 'accept' ELSE 'ignore' END AS decision
            FROM judged j"""),
        "bulk_load": _sql(_SOURCE + _BULK, """
            SELECT s.cmd_seq, CASE s.act WHEN 'msg' THEN 'message_create' WHEN 'medit' THEN 'message_edit'
                WHEN 'mdel' THEN 'message_delete' WHEN 'read' THEN 'message_read' WHEN 'pin' THEN 'chat_pin'
                WHEN 'add' THEN 'participant_add' WHEN 'leave' THEN 'participant_delete' WHEN 'edit' THEN 'chat_edit'
                WHEN 'create' THEN 'chat_create' ELSE 'chat_delete' END AS kind,
              CASE WHEN n_events > 0 THEN chat END AS chat_id, message_id,
              array_to_string(list_sort(told), ',') AS users, CAST(n_events AS BIGINT) AS n_events,
              CASE WHEN reason IS NOT NULL THEN 'reject' WHEN n_events = 0 THEN 'ignore' ELSE 'accept' END AS decision, reason
            FROM steps s WHERE i > 0"""),
        "bulk_replay": _sql(_SOURCE + _BULK, """
            SELECT z.u AS user_id, chat AS chat_id, z.n AS unread_messages, z.m AS last_message_id
            FROM (SELECT chat, unnest(marks) AS z FROM steps QUALIFY row_number() OVER (PARTITION BY chat ORDER BY i DESC) = 1)"""),
        "participants_asof": _sql(log + _MEMBER_LIFE, """
            SELECT l.log_seq, l.chat_id, m.user_id FROM log l JOIN member_life m
              ON m.chat_id = l.chat_id AND m.from_seq <= l.log_seq AND l.log_seq < m.to_seq
            WHERE l.name = 'chatViewRefreshed'"""),
        "assign_chat_ids": _sql(log + _CHATS + _COMMANDS, """
            SELECT cmd_seq, (SELECT coalesce(max(id), 0) FROM chats) + row_number() OVER (ORDER BY cmd_seq) AS new_id
            FROM cmds WHERE act = 'create'"""),
        "assign_message_ids": _sql(log + _CHATS + _MESSAGES + _COMMANDS, """
            SELECT cmd_seq, chat_id,
              coalesce((SELECT max(m.id) FROM messages m JOIN chats x ON x.id = m.chat_id WHERE m.chat_id = c.chat_id), 0)
              + row_number() OVER (PARTITION BY chat_id ORDER BY cmd_seq) AS new_id
            FROM cmds c WHERE act = 'msg'"""),
        "chat_id_high_water": _sql(log + _CHATS, "SELECT coalesce(max(id), 0) AS mark FROM chats"),
        "message_id_high_water": _sql(log + _CHATS + _MESSAGES, """
            SELECT id AS chat_id, coalesce((SELECT max(m.id) FROM messages m WHERE m.chat_id = chats.id), 0) AS mark
            FROM chats"""),
        "consumer_lag": _sql(log, """
            SELECT partition, count(*) AS end_offset, CASE WHEN partition < 2 THEN count(*) * 3 // 4 ELSE -1 END AS committed,
                   count(*) - CASE WHEN partition < 2 THEN count(*) * 3 // 4 ELSE 0 END AS lag
            FROM log GROUP BY partition"""),
        "is_caught_up": _sql(log, """
            SELECT bool_and(count(*) * 3 // 4 = count(*)) OVER () AS caught_up
            FROM log WHERE partition < 2 GROUP BY partition LIMIT 1"""),
        "replay_full": _sql(log + _VIEW + _STEPS + _CHATS.replace(_CHAT_LIFE, "") + _MESSAGES.replace(_MESSAGE_LIFE, ""),
                            _SUMMARY),
    }
    hot = ("unread_view", "chat_user_view", "cmd_message_delete")
    return out | {f"{name}_hot": out[name] for name in hot}
