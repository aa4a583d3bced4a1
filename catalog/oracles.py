"""DuckDB SQL for the registered queries, written independently of the Spark plans.

All statements share one WITH clause that derives raw events from the given
tables and builds the datasets step by step; unused steps cost nothing.
"""

from __future__ import annotations

from feedloom.functions.text import QUESTION_PROMPT_HEAD, SUMMARY_PROMPT_HEAD, SUMMARY_PROMPT_TAIL

_D = """
d AS (SELECT doc_id, text, lang, source, sec,
        sec || '.' || lpad(CAST(doc_id % 1000000 AS VARCHAR), 6, '0') AS ts
      FROM (SELECT *, 1704067200 + (doc_id * 7919 % 43200) * 60 AS sec FROM documents))"""

_ON_POSTS = """
ev AS (SELECT e.event_id, e.user_id, e.event_type, CAST(floor(epoch(e.ts)) AS BIGINT) AS esec,
         d.doc_id, d.lang, d.source, d.ts
       FROM events e JOIN d ON d.doc_id = e.user_id)"""

_RAW = """
raw AS (
  SELECT doc_id * 4 AS id, make_timestamp(sec * 1000000) AS event_time, to_json({
    'type': 'message', 'event_ts': ts, 'ts': ts, 'channel': source, 'channel_type': 'channel',
    'client_msg_id': 'm' || doc_id, 'team': upper(lang), 'user': 'U' || (doc_id % 50),
    'text': CASE WHEN source < 'src14' THEN 'Anonymous feedback: ' || text ELSE text END,
    'bot_id': CASE WHEN source < 'src14' THEN 'B1' END, 'parent_user_id': CAST(NULL AS VARCHAR),
    'api_app_id': 'A1', 'event_id': 'Ev' || doc_id, 'event_context': 'ctx-' || source,
    'is_ext_shared_channel': false,
    'authorizations': [{'enterprise_id': CAST(NULL AS VARCHAR), 'is_bot': false, 'is_enterprise_install': false,
                        'team_id': upper(lang), 'user_id': 'A' || doc_id}],
    'blocks': [{'type': 'rich_text', 'block_id': 'b' || doc_id,
                'elements': [{'type': 'rich_text_section', 'elements': [{'type': 'text', 'text': source}]}]}],
    'bot_profile': CASE WHEN source < 'src14' THEN
      {'id': 'B1', 'name': 'feedback', 'team_id': upper(lang), 'updated': 1704067200} END}) AS raw_event
  FROM d
  UNION ALL
  SELECT (conv_id * 1000 + turn) * 4 + 1, make_timestamp(rsec * 1000000), to_json({
    'type': 'message', 'event_ts': rts, 'ts': rts, 'channel': source, 'team': upper(lang), 'user': role,
    'text': ctext, 'parent_user_id': 'U' || (conv_id % 50), 'thread_ts': ts})
  FROM (SELECT *, rsec || '.' || lpad(CAST(turn AS VARCHAR), 6, '0') AS rts
        FROM (SELECT c.conv_id, c.turn, c.role, c.text AS ctext, d.*, d.sec + (c.turn + 1) * 60 AS rsec
              FROM conversations c JOIN d ON d.doc_id = c.conv_id))
  UNION ALL
  SELECT event_id * 4 + 2, make_timestamp(esec * 1000000), to_json({
    'type': 'reaction_added', 'event_ts': esec || '.000000', 'team': upper(lang), 'user': 'U' || user_id,
    'reaction': CASE WHEN event_type = 'click' THEN 'thumbsup' ELSE 'eyes' END,
    'item': {'type': 'message', 'channel': source, 'ts': ts}, 'item_user': 'U' || (doc_id % 50)})
  FROM ev WHERE event_type IN ('click', 'view')
  UNION ALL
  SELECT event_id * 4 + 2, make_timestamp(esec * 1000000), to_json({
    'type': 'message', 'event_ts': esec || '.000000', 'ts': esec || '.000000', 'user': 'U' || user_id,
    'text': CAST(NULL AS VARCHAR)})
  FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS esec FROM events WHERE event_type = 'signup'))"""

_CONTROL = """
control AS (
  SELECT CASE WHEN event_type = 'error' THEN 'message_deleted' ELSE 'reaction_removed' END AS kind,
    make_timestamp(esec * 1000000) AS event_time, ts AS target_ts,
    CASE WHEN event_type = 'purchase' THEN 'eyes' END AS reaction,
    CASE WHEN event_type = 'purchase' THEN 'U' || user_id END AS "user"
  FROM ev WHERE event_type IN ('error', 'purchase'))"""


def _path(path: str, name: str, kind: str | None = None) -> str:
    value = f"json_extract_string(raw_event, '$.{path}')"
    return f"CAST({value} AS {kind}) AS {name}" if kind else f"{value} AS {name}"


_PATHS = [
    _path("api_app_id", "api_app_id"),
    _path("authorizations[0].enterprise_id", "enterprise_id"),
    _path("authorizations[0].is_bot", "is_bot", "BOOLEAN"),
    _path("authorizations[0].is_enterprise_install", "is_enterprise_install", "BOOLEAN"),
    _path("authorizations[0].team_id", "auth_team_id"),
    _path("authorizations[0].user_id", "auth_user_id"),
    _path("context_enterprise_id", "context_enterprise_id"),
    _path("context_team_id", "context_team_id"),
    _path("event_ts", "event_ts"),
    _path("channel", "event_channel"),
    _path("channel_type", "event_channel_type"),
    _path("client_msg_id", "event_client_msg_id"),
    "regexp_replace(json_extract_string(raw_event, '$.text'), '^Anonymous feedback: ', '') AS event_text",
    _path("type", "event_type"),
    _path("user", "event_user"),
    _path("parent_user_id", "event_parent_user_id"),
    _path("thread_ts", "event_thread_ts"),
    _path("item.channel", "reaction_item_channel"),
    _path("item.ts", "reaction_item_ts"),
    _path("item.type", "reaction_item_type"),
    _path("item_user", "reaction_item_user"),
    _path("reaction", "reaction"),
    _path("event_context", "event_context"),
    _path("event_id", "event_id"),
    _path("is_ext_shared_channel", "is_ext_shared_channel", "BOOLEAN"),
    _path("team", "team_id"),
    _path("token", "token"),
    _path("type", "type"),
    _path("bot_id", "bot_id"),
    _path("blocks", "blocks"),
    _path("blocks[0].block_id", "block_id"),
    _path("blocks[0].elements[0].elements[0].text", "block_text"),
    _path("blocks[0].elements[0].elements[0].type", "block_text_type"),
    _path("text", "anonymous_feedback_text"),
    _path("bot_profile.id", "bot_profile_id"),
    _path("bot_profile.name", "bot_profile_name"),
    _path("bot_profile.team_id", "bot_profile_team_id"),
    _path("bot_profile.updated", "bot_profile_updated"),
]
_BASE = f"base AS (SELECT id, event_time, {', '.join(_PATHS)} FROM raw)"

_ENVELOPE = """api_app_id, enterprise_id, is_bot, is_enterprise_install, auth_team_id, auth_user_id,
    context_enterprise_id, context_team_id"""

_POSITIVE = "('and','with','for','la','der','on','it')"
_NEGATIVE = "('of','to','is','de','die','que')"


def _score(text: str) -> str:
    words = f"regexp_split_to_array(lower({text}), '[^a-z]+')"
    ups = f"len(list_filter({words}, lambda w: w IN {_POSITIVE}))"
    downs = f"len(list_filter({words}, lambda w: w IN {_NEGATIVE}))"
    return f"CASE WHEN {ups} + {downs} = 0 THEN 0.0 ELSE CAST({ups} - {downs} AS DOUBLE) / ({ups} + {downs}) END"


_SETS = f"""
post_rows AS (SELECT *, bot_id IS NOT NULL AS is_bot_post FROM base
  WHERE event_type = 'message' AND event_parent_user_id IS NULL AND reaction IS NULL AND event_text IS NOT NULL),
posts AS (SELECT event_text, {_score("event_text")} AS sentiment_score, id, event_time, {_ENVELOPE},
    event_ts, event_channel, event_channel_type, event_client_msg_id, event_type, event_user, event_context,
    event_id, is_ext_shared_channel, team_id, token, type, is_bot_post
  FROM post_rows),
replies AS (SELECT id, event_time, {_ENVELOPE}, event_ts, event_channel, event_channel_type, event_client_msg_id,
    event_text, event_type, event_user, event_parent_user_id, event_thread_ts, event_context, event_id,
    is_ext_shared_channel, team_id, token, type
  FROM base WHERE event_type = 'message' AND event_parent_user_id IS NOT NULL),
reactions AS (SELECT id, event_time, reaction, {_ENVELOPE}, event_ts, reaction_item_channel, reaction_item_ts,
    reaction_item_type, reaction_item_user, event_user, event_context, event_id, is_ext_shared_channel, team_id,
    token, type
  FROM base WHERE reaction IS NOT NULL)"""

_WEIGHTED = """
weighted AS (SELECT *, 1 + num_replies * 0.5 + num_reactions * 0.1 AS weight FROM (
    SELECT p.*, (SELECT count(*) FROM replies r WHERE r.event_thread_ts = p.event_ts) AS num_replies,
      (SELECT count(*) FROM reactions x WHERE x.reaction_item_ts = p.event_ts) AS num_reactions FROM posts p))"""

_GROUP = "team_id, sentiment_category, feedback_start_date, feedback_end_date"
_WEEK_START = "CAST(date_trunc('week', event_time - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)"
# Characters at which texts are cut: the library's own, and one that gives many parts here.
_CUT, _SMALL_CUT = 16_000_000, 2_000


def _parts(cut: int) -> str:
    """Texts of each group, cut at every ``cut`` running characters; a longer post stands alone."""
    return f"""(SELECT {_GROUP}, part_no, avg_sentiment_score, number_of_posts,
      string_agg(weighted_text, '|' ORDER BY post_number) AS feedback_texts,
      string_agg(post_number || '. ' || weighted_text, ' ' ORDER BY post_number) AS numbered_posts_string
    FROM (SELECT *, CAST(1 + before // {cut} + 2 * long_before
          + CASE WHEN chars > {cut} AND before > 0 THEN 1 ELSE 0 END AS BIGINT) AS part_no
      FROM (SELECT *, coalesce(sum(chars) OVER earlier, 0) AS before,
              count(*) FILTER (WHERE chars > {cut}) OVER earlier AS long_before,
              round(avg(sentiment_score) OVER everyone, 6) AS avg_sentiment_score,
              count(*) OVER everyone AS number_of_posts
            FROM numbered WHERE team_id IS NOT NULL
            WINDOW everyone AS (PARTITION BY {_GROUP}), earlier AS (PARTITION BY {_GROUP}
              ORDER BY event_time, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    GROUP BY ALL)"""


def _summary(source: str) -> str:
    return f"""(SELECT w.team_id, w.sentiment_category, w.avg_sentiment_score, w.feedback_start_date, w.feedback_end_date,
    w.part_no, w.numbered_posts_string AS numbered_weighted_posts, b.detailed_summary, q.open_ended_question
  FROM {source} w JOIN bullets b USING (team_id, sentiment_category, feedback_start_date)
  JOIN questions q USING (team_id, sentiment_category, feedback_start_date))"""


_WEEKLY = f"""
numbered AS (SELECT *, length(weighted_text) + 16 AS chars, count(*) OVER (PARTITION BY {_GROUP}
      ORDER BY event_time, id ROWS UNBOUNDED PRECEDING) AS post_number
  FROM (SELECT *, event_text || ' (weight: ' || CAST(weight AS VARCHAR) || ')' AS weighted_text,
          CASE WHEN sentiment_score > 0 THEN 'positive' ELSE 'negative' END AS sentiment_category,
          {_WEEK_START} AS feedback_start_date, CAST({_WEEK_START} + INTERVAL 5 DAY AS DATE) AS feedback_end_date
        FROM weighted WHERE abs(sentiment_score) >= 0.10)),
combined AS (SELECT {_GROUP}, round(avg(sentiment_score), 6) AS avg_sentiment_score, count(*) AS number_of_posts
  FROM numbered GROUP BY ALL),
weekly AS {_parts(_CUT)}"""

_TEXTS = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY team_id, sentiment_category, feedback_start_date
    ORDER BY weight DESC, event_time, id) AS rank FROM numbered WHERE team_id IS NOT NULL),
bullets AS (SELECT team_id, sentiment_category, feedback_start_date, feedback_end_date,
    string_agg('- ' || event_text, chr(10) ORDER BY rank) AS detailed_summary
  FROM ranked WHERE rank <= 5 GROUP BY ALL),
topics AS (SELECT team_id, sentiment_category, feedback_start_date, word, count(*) AS n
  FROM (SELECT *, unnest(regexp_split_to_array(lower(event_text), '[^a-z]+')) AS word FROM ranked WHERE rank = 1)
  WHERE length(word) >= 4 GROUP BY ALL),
topic_list AS (SELECT team_id, sentiment_category, feedback_start_date, string_agg(word, ', ' ORDER BY place) AS list
  FROM (SELECT *, row_number() OVER (PARTITION BY team_id, sentiment_category, feedback_start_date
          ORDER BY n DESC, word) AS place FROM topics)
  WHERE place <= 3 GROUP BY ALL),
questions AS (SELECT b.team_id, b.sentiment_category, b.feedback_start_date, b.feedback_end_date,
    coalesce('What are your thoughts on ' || t.list || '?', 'What would you like to talk about this week?')
      AS open_ended_question
  FROM bullets b LEFT JOIN topic_list t ON t.team_id = b.team_id
    AND t.sentiment_category = b.sentiment_category AND t.feedback_start_date = b.feedback_start_date),
summary AS {_summary("weekly")},
latest AS (SELECT s.team_id, s.sentiment_category, s.detailed_summary, s.feedback_start_date, s.feedback_end_date
  FROM summary s WHERE part_no = 1 AND NOT EXISTS (SELECT 1 FROM summary n WHERE n.team_id = s.team_id
    AND n.sentiment_category = s.sentiment_category AND n.feedback_start_date > s.feedback_start_date)),
this_week AS (SELECT s.* FROM summary s WHERE part_no = 1 AND s.feedback_start_date =
    (SELECT max(m.feedback_start_date) FROM summary m WHERE m.team_id = s.team_id)),
digest AS (SELECT team_id, string_agg(chr(10) || 'Here is the feedback for the week of '
    || strftime(feedback_start_date, '%Y-%m-%d') || ' to ' || strftime(feedback_end_date, '%Y-%m-%d') || ':'
    || chr(10) || chr(10) || '*' || upper(sentiment_category[1]) || sentiment_category[2:] || ' Feedback:*'
    || chr(10) || detailed_summary || chr(10) || '      ', chr(10) || chr(10) ORDER BY sentiment_category) AS message
  FROM this_week GROUP BY team_id)"""

_WITH = ",\n".join(s.strip() for s in (_D, _ON_POSTS, _RAW, _CONTROL, _BASE, _SETS, _WEIGHTED, _WEEKLY, _TEXTS))

_TIME = "strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time"
_STAMP = "coalesce(reaction_item_ts, event_ts)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SURVIVES_MESSAGE = """NOT EXISTS (SELECT 1 FROM control c WHERE c.kind = 'message_deleted'
    AND c.target_ts = json_extract_string(raw.raw_event, '$.ts') AND raw.event_time <= c.event_time)"""
_SURVIVES_REACTION = """NOT EXISTS (SELECT 1 FROM control c WHERE c.kind = 'reaction_removed'
    AND c.target_ts = json_extract_string(raw.raw_event, '$.item.ts')
    AND c.reaction = json_extract_string(raw.raw_event, '$.reaction') AND raw.event_time <= c.event_time)"""
_SURVIVES_REACTION_BY_USER = """NOT EXISTS (SELECT 1 FROM control c WHERE c.kind = 'reaction_removed'
    AND c.target_ts = json_extract_string(raw.raw_event, '$.item.ts')
    AND c.reaction = json_extract_string(raw.raw_event, '$.reaction')
    AND c."user" = json_extract_string(raw.raw_event, '$.user') AND raw.event_time <= c.event_time)"""

_THREAD = f"""SELECT id, {_TIME}, {_ENVELOPE}, event_ts, event_channel, event_channel_type, event_client_msg_id,
    event_text, event_type, event_user, event_context, event_id, is_ext_shared_channel, team_id, token, type,
    is_bot_post, md5(event_ts) AS thread_id, NULL::VARCHAR AS parent_user_id, 'post' AS event_subtype FROM posts
  UNION ALL
  SELECT id, {_TIME}, {_ENVELOPE}, event_ts, event_channel, event_channel_type, event_client_msg_id,
    event_text, 'message', event_user, event_context, event_id, is_ext_shared_channel, team_id, token, type,
    NULL, md5(event_thread_ts), event_parent_user_id, 'reply' FROM replies
  UNION ALL
  SELECT id, {_TIME}, {_ENVELOPE}, event_ts, reaction_item_channel, reaction_item_type, NULL,
    reaction, md5('reaction_added'), event_user, event_context, event_id, is_ext_shared_channel, team_id, token, type,
    NULL, md5(reaction_item_ts), reaction_item_user, 'reaction' FROM reactions"""

_WEIGHTED_OUT = f"""SELECT id AS post_id, event_text, {_TIME}, {_ENVELOPE}, event_ts, event_channel, event_channel_type,
    event_client_msg_id, event_type, event_user, event_context, event_id, is_ext_shared_channel, team_id, token, type,
    is_bot_post, md5(event_ts) AS thread_id, NULL::VARCHAR AS parent_user_id, 'post' AS event_subtype,
    num_replies, num_reactions, CAST(weight AS VARCHAR) AS weight FROM weighted"""

_FRAME_CHARS = len(SUMMARY_PROMPT_HEAD) + len(SUMMARY_PROMPT_TAIL)


def _generated(source: str) -> str:
    """The stand-in model answers with the length of its prompt; several parts are answered once more together."""
    return f"""SELECT {_GROUP}, w.part_no, a.detailed_summary FROM {source} w JOIN (
      SELECT {_GROUP}, CASE WHEN count(*) = 1 THEN max(answer)
        ELSE CAST({_FRAME_CHARS} + length(string_agg(answer, ' ' ORDER BY part_no)) AS VARCHAR) END AS detailed_summary
      FROM (SELECT *, CAST({_FRAME_CHARS} + length(numbered_posts_string) AS VARCHAR) AS answer FROM {source})
      GROUP BY ALL) a USING ({_GROUP})"""


_LARGE_LEXICON = """SELECT d.doc_id, coalesce(round(s.score, 6), 0.0) AS sentiment_score FROM documents d LEFT JOIN (
    SELECT w.doc_id, CAST(sum(l.polarity) AS DOUBLE) / count(*) AS score
    FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM documents) w
    JOIN (SELECT token, CASE WHEN sum(CASE WHEN role = 'user' THEN 1 ELSE -1 END) > 0 THEN 1 ELSE -1 END AS polarity
          FROM (SELECT role, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS token FROM conversations)
          WHERE token <> '' GROUP BY token) l USING (token)
    GROUP BY w.doc_id) s ON s.doc_id = d.doc_id"""

_ROUTED = f"""SELECT 'stored' AS kind, id, {_TIME}, NULL::VARCHAR AS target_ts, NULL::VARCHAR AS reaction FROM raw
  UNION ALL SELECT kind, NULL, {_TIME}, target_ts, reaction FROM control"""


_VERDICTS = """SELECT 'store' AS tag, id FROM raw UNION ALL SELECT 'control', NULL FROM control
  UNION ALL SELECT CASE WHEN event_type = 'click' THEN 'store' ELSE 'rejected' END, event_id FROM events
  UNION ALL SELECT CASE WHEN text IS NULL OR json_valid(text) THEN 'store' ELSE 'malformed' END, doc_id FROM documents"""


def _answers() -> dict[str, str]:
    posts_out = f"SELECT * REPLACE ({_TIME}, round(sentiment_score, 6) AS sentiment_score) FROM posts"
    with_time = f"SELECT * REPLACE ({_TIME}) FROM"
    return {
        "raw_scan": f"SELECT id, {_TIME}, json_extract_string(raw_event, '$.text') AS text FROM raw",
        "event_append": """SELECT doc_id AS id, '2024-02-01 00:00:00' AS event_time, 'message' AS type, text, lang
            FROM documents""",
        "pack_json": "SELECT doc_id, text, doc_id AS packed_id FROM documents",
        "json_paths": """SELECT id, event_ts, event_channel, event_type, event_user, event_thread_ts, team_id, reaction,
            bot_id, reaction_item_channel, reaction_item_ts, reaction_item_type, bot_profile_id, bot_profile_updated
            FROM base""",
        "json_array_paths": """SELECT id, is_bot, auth_team_id, auth_user_id, block_id, block_text, block_text_type, blocks
            FROM base""",
        "malformed_events": """SELECT id, raw_event FROM (SELECT doc_id AS id, text AS raw_event FROM documents
            UNION ALL SELECT event_id, props FROM events) WHERE NOT json_valid(raw_event)""",
        "base_events": f"{with_time} base",
        "strip_prefix": """SELECT id, CASE WHEN starts_with(anonymous_feedback_text, 'Anonymous feedback: ')
            THEN anonymous_feedback_text[21:] ELSE anonymous_feedback_text END AS event_text, anonymous_feedback_text
            FROM base""",
        "anonymise": """SELECT doc_id, 'Anonymous feedback: ' || text AS text, NULL::VARCHAR AS "user", 'B1' AS bot_id
            FROM documents""",
        "posts": posts_out,
        "replies": f"{with_time} replies",
        "reactions": f"{with_time} reactions",
        "thread_events": _THREAD,
        "reply_counts": """SELECT md5(event_thread_ts) AS thread_id, count(*) AS num_replies FROM base
            WHERE event_type = 'message' AND event_parent_user_id IS NOT NULL GROUP BY 1""",
        "reaction_counts": """SELECT md5(reaction_item_ts) AS thread_id, count(*) AS num_reactions FROM base
            WHERE reaction IS NOT NULL GROUP BY 1""",
        "weighted_posts": _WEIGHTED_OUT,
        "scoped_weights": """SELECT *, CAST(1 + num_replies * 0.5 + num_reactions * 0.1 AS VARCHAR) AS weight FROM (
            SELECT p.id, (SELECT count(*) FROM replies r WHERE r.event_thread_ts = p.event_ts
                AND r.team_id = p.team_id) AS num_replies,
              (SELECT count(*) FROM reactions x WHERE x.reaction_item_ts = p.event_ts AND x.team_id = p.team_id)
                AS num_reactions FROM posts p)""",
        "posts_with_weights": """SELECT p.id, p.team_id, p.event_text, round(p.sentiment_score, 6) AS sentiment_score,
            CAST(w.weight AS VARCHAR) AS weight FROM posts p JOIN weighted w ON p.id = w.id""",
        "drop_neutral": """SELECT id, round(sentiment_score, 6) AS sentiment_score,
            CASE WHEN sentiment_score >= 0.10 THEN 'positive' ELSE 'negative' END AS category
            FROM posts WHERE NOT (sentiment_score > -0.10 AND sentiment_score < 0.10)""",
        "week_labels": f"""SELECT id, {_TIME}, strftime(date_trunc('week', event_time - INTERVAL 1 DAY),
              '%Y-%m-%d %H:%M:%S') AS bucket, {_WEEK_START} AS feedback_start_date,
            CAST({_WEEK_START} + INTERVAL 5 DAY AS DATE) AS feedback_end_date FROM raw""",
        "number_posts": f"SELECT id, {_GROUP}, post_number, weighted_text FROM numbered",
        "number_posts_heavy_groups": f"SELECT id, {_GROUP}, post_number, weighted_text FROM numbered",
        "weekly_feedback": f"SELECT {_GROUP}, part_no, avg_sentiment_score, number_of_posts, feedback_texts FROM weekly",
        "numbered_posts_string": f"SELECT {_GROUP}, part_no, numbered_posts_string FROM weekly",
        "text_parts_heavy_groups": f"""SELECT {_GROUP}, part_no, avg_sentiment_score, number_of_posts,
            numbered_posts_string FROM {_parts(_SMALL_CUT)}""",
        "prompts": f"""SELECT {_GROUP}, part_no, {_literal(SUMMARY_PROMPT_HEAD)} || numbered_posts_string
            || {_literal(SUMMARY_PROMPT_TAIL)} AS summary_prompt,
            {_literal(QUESTION_PROMPT_HEAD)} || numbered_posts_string AS question_prompt FROM weekly""",
        "extractive_summary": "SELECT * FROM bullets",
        "open_question": "SELECT * FROM questions",
        "generated_summary": _generated("weekly"),
        "generated_summary_parts": _generated(_parts(_SMALL_CUT)),
        "resumed_summary": f"""SELECT {_GROUP}, CASE WHEN length(numbered_posts_string) % 2 = 0 THEN 'first ' ELSE 'second ' END
            || length(numbered_posts_string) AS detailed_summary FROM weekly""",
        "post_summary": "SELECT * FROM summary",
        "post_summary_parts": f"SELECT * FROM {_summary(_parts(_SMALL_CUT))}",
        "incremental_summary": """SELECT team_id, sentiment_category, feedback_start_date, part_no, numbered_weighted_posts
            FROM summary WHERE feedback_start_date > DATE '2024-01-09' AND feedback_start_date < DATE '2024-01-23'""",
        "emit_closed_weeks": f"""SELECT id, {_WEEK_START} AS feedback_start_date FROM raw
            WHERE event_time < TIMESTAMP '2024-01-23 00:00:00'""",
        "feedback_table": """SELECT part_no, sentiment_category, avg_sentiment_score, numbered_weighted_posts, detailed_summary,
            open_ended_question FROM summary""",
        "full_refresh": """SELECT id AS post_id, num_replies, num_reactions, CAST(weight AS VARCHAR) AS weight
            FROM weighted""",
        "json_export": """SELECT part_no, sentiment_category, avg_sentiment_score, numbered_weighted_posts, detailed_summary,
            open_ended_question FROM summary""",
        "sentiment_series": f"""SELECT {_TIME}, round(sentiment_score, 6) AS sentiment_score,
            strftime(posts.event_time, '%-m/%-d/%Y') AS day FROM posts""",
        "sentiment_series_range": f"""SELECT {_TIME}, round(sentiment_score, 6) AS sentiment_score FROM posts
            WHERE posts.event_time BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""",
        "bot_post_counts": """SELECT is_bot_post, count(*) AS post_count,
            CASE WHEN is_bot_post THEN 'Anonymous' ELSE 'With Name' END AS label FROM post_rows GROUP BY ALL""",
        "latest_summary": """SELECT detailed_summary, feedback_start_date, feedback_end_date FROM summary
            WHERE sentiment_category = 'negative' AND team_id = 'EN' ORDER BY feedback_start_date DESC LIMIT 1""",
        "latest_per_key": "SELECT * FROM latest",
        "summary_message": """SELECT team_id, sentiment_category, 'For the week of ' || strftime(feedback_start_date, '%b %d')
            || ' to ' || strftime(feedback_end_date, '%b %d') || ', the summarized feedback is: ' || detailed_summary
            AS message FROM latest""",
        "weekly_digest": "SELECT * FROM digest",
        "digest_deliveries": """SELECT DISTINCT m.team_id, m.user_id, g.message
            FROM (SELECT upper(lang) AS team_id, 'U' || (doc_id % 50) AS user_id FROM documents) m
            JOIN digest g ON g.team_id = m.team_id""",
        "weekly_question": """SELECT team_id, open_ended_question AS question FROM (SELECT *, row_number() OVER (
            PARTITION BY team_id ORDER BY feedback_start_date DESC, sentiment_category) AS k FROM summary) WHERE k = 1""",
        "date_formats": """SELECT id, strftime(event_time, '%b %d') AS short_date,
            strftime(event_time, '%m-%d-%Y %I:%M%p') AS clock, strftime(event_time, '%Y-%m-%d') AS iso_date FROM raw""",
        "capitalise": "SELECT event_id, upper(event_type[1]) || event_type[2:] AS label FROM events",
        "route_events": _ROUTED,
        "split_valid": """SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'valid' ELSE 'rejected' END AS verdict
            FROM events""",
        "event_verdicts": _VERDICTS,
        "stream_event_verdicts": _VERDICTS,
        "ts_convert": f"""SELECT id, true AS valid,
            strftime(make_timestamp(CAST(CAST({_STAMP} AS DECIMAL(20, 6)) * 1000000 AS BIGINT)),
              '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
            CAST(CAST({_STAMP} AS DECIMAL(20, 6)) * 1000000 AS BIGINT) AS micros FROM base""",
        "message_deletes": f"SELECT id FROM raw WHERE {_SURVIVES_MESSAGE}",
        "reaction_removals": f"SELECT id FROM raw WHERE {_SURVIVES_REACTION}",
        "reaction_removals_by_user": f"SELECT id FROM raw WHERE {_SURVIVES_REACTION_BY_USER}",
        "deletes_in_flat_tables": f"""SELECT id, json_extract_string(raw_event, '$.type') AS event_type FROM raw
            WHERE {_SURVIVES_MESSAGE} AND {_SURVIVES_REACTION}""",
        "deletes_hot_keys": f"""SELECT id, json_extract_string(raw_event, '$.type') AS event_type FROM raw
            WHERE {_SURVIVES_MESSAGE} AND {_SURVIVES_REACTION}""",
        "upsert": """SELECT l.doc_id, coalesce(length(d.text), l.quality) AS quality, l.toxic
            FROM labels l LEFT JOIN documents d USING (doc_id)
            UNION ALL SELECT doc_id, length(text), 2 FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "update_columns": """SELECT l.doc_id, l.quality, CAST(coalesce((SELECT nullif(count(*), 0) FROM events e
              WHERE e.user_id = l.doc_id AND e.event_type = 'error'), l.toxic) AS INTEGER) AS toxic FROM labels l""",
        "merge_incremental": f"""SELECT id, {_TIME}, CASE WHEN base.event_time >= TIMESTAMP '2024-01-15 00:00:00'
            THEN lower(team_id) ELSE team_id END AS team_id FROM base""",
        "sync_schema": "SELECT doc_id, quality, NULL::VARCHAR AS lang FROM labels",
        "incremental_base": f"SELECT id, {_TIME}, event_type, team_id FROM base",
        "incremental_ties": """SELECT id, strftime(day, '%Y-%m-%d %H:%M:%S') AS event_time, event_type, team_id
            FROM (SELECT *, CASE WHEN id % 7 <> 0 THEN date_trunc('day', base.event_time) END AS day FROM base)
            WHERE id % 2 = 0 OR day IS NULL OR day >= (SELECT max(CASE WHEN id % 7 <> 0 AND id % 2 = 0 AND
                date_trunc('day', base.event_time) <= TIMESTAMP '2024-01-15 00:00:00' THEN date_trunc('day', base.event_time) END) FROM base)""",
        "high_water_mark": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
            WHERE ts = (SELECT max(ts) FROM events)""",
        "pipeline_run": f"""SELECT id, event_text, round(sentiment_score, 6) AS sentiment_score FROM posts
            WHERE id IN (SELECT id FROM raw WHERE {_SURVIVES_MESSAGE})""",
        "rescored_posts": "SELECT id, round((length(event_text) % 201) / 100.0 - 1, 6) AS sentiment_score FROM posts",
        "weekly_window": f"SELECT {_WEEK_START} AS week, team_id, count(*) AS n FROM base GROUP BY ALL",
        "stream_base": f"SELECT id, {_TIME}, event_type, event_text, team_id, reaction FROM base",
        "stream_changes": f"SELECT id, {_TIME} FROM raw WHERE {_SURVIVES_MESSAGE} AND {_SURVIVES_REACTION}",
        "stream_dedup": "SELECT id, 1 AS n FROM raw",
        "stream_weekly_sentiment": """SELECT feedback_start_date, team_id, sentiment_category,
            avg_sentiment_score, number_of_posts FROM combined WHERE team_id IS NOT NULL""",
        "stream_late_rows": """SELECT feedback_start_date, team_id, sentiment_category,
            avg_sentiment_score, number_of_posts FROM combined WHERE team_id IS NOT NULL""",
        "stream_closed_weeks": """SELECT feedback_start_date, team_id, sentiment_category,
            avg_sentiment_score, number_of_posts FROM combined WHERE feedback_start_date + INTERVAL 7 DAY
            <= (SELECT max(event_time) FROM numbered) - INTERVAL 1 HOUR""",
        "stream_thread_engagement": """SELECT thread_id, sum(r) AS num_replies, sum(1 - r) AS num_reactions FROM (
            SELECT md5(event_thread_ts) AS thread_id, 1 AS r FROM replies
            UNION ALL SELECT md5(reaction_item_ts), 0 FROM reactions) WHERE thread_id IS NOT NULL GROUP BY 1""",
        "lexicon_sentiment": f"SELECT doc_id, round({_score('text')}, 6) AS sentiment_score FROM documents",
        "remembered_sentiment": f"SELECT doc_id, round({_score('text')}, 6) AS sentiment_score FROM documents",
        "ml_sentiment": "SELECT doc_id, true AS in_range, true AS auc_above_half FROM documents",
        "large_lexicon_sentiment": _LARGE_LEXICON,
        "function_sentiment": """SELECT doc_id, round(greatest(-1.0, least(1.0,
            CAST((length(text) - length(replace(text, 'and', ''))) // 3
               - (length(text) - length(replace(text, 'the', ''))) // 3 AS DOUBLE) / 100.0)), 6) AS sentiment_score
            FROM documents""",
    }


def oracles() -> dict[str, str]:
    return {name: f"WITH {_WITH}\n{sql}" for name, sql in _answers().items()}
