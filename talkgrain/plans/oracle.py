"""DuckDB SQL giving the expected result of each registered query.

``_VIEWS`` restates the tables of ``plans.tables``; a query lists those it needs.
"""

from __future__ import annotations

import re

_LINES = "list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')"
_TOKENS = "list_filter(string_split({}, ' '), lambda t: t <> '')"
_SPEAKER = "CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END"
_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(13)"
_SNIP = "CASE WHEN length({0}) <= 100 THEN {0} ELSE substr({0}, 1, 100) || '...' END"
_SECONDS = (
    "coalesce(try_cast(nullif(regexp_extract({0}, '(\\d+)H', 1), '') AS BIGINT), 0) * 3600"
    " + coalesce(try_cast(nullif(regexp_extract({0}, '(\\d+)M', 1), '') AS BIGINT), 0) * 60"
    " + coalesce(try_cast(nullif(regexp_extract({0}, '(\\d+)S', 1), '') AS BIGINT), 0)"
)
_NULL_COLUMNS = (
    "cast(NULL AS VARCHAR) AS transcript_filename, cast(NULL AS DOUBLE) AS transcript_duration,"
    " cast(NULL AS BIGINT) AS transcript_utterances, cast(NULL AS BIGINT) AS speaker_count,"
    " cast(NULL AS VARCHAR) AS speaker_ids"
)
# The columns of a catalogue row; the fetched part of it, and what stages add.
_FETCHED = (
    "video_id, title, description, published_at, channel_id, channel_title, tags, duration,"
    " view_count, like_count, comment_count, thumbnail_url, webm_filename, audio_filename"
)
_ADDED = "transcript_filename, transcript_duration, transcript_utterances, speaker_count, speaker_ids"
_ROW = (
    f"{_FETCHED.replace('published_at', _ISO.format('published_at') + ' AS published_at')}, {_ADDED},"
    " cast(NULL AS VARCHAR) AS \"type\", cast(NULL AS BIGINT) AS duration_seconds,"
    " cast(NULL AS DOUBLE) AS coverage"
)

_VIEWS: dict[str, str] = {
    "lines": f"""
        SELECT conv_id, turn, role, unnest(range(0, len(ls))) AS line, unnest(ls) AS transcript
        FROM (SELECT *, {_LINES} AS ls FROM conversations)""",
    "counted": f"""
        SELECT *, row_number() OVER w - 1 AS pos,
          cast(sum(length(transcript)) OVER w AS BIGINT) - length(transcript) AS chars_before,
          cast(sum(len({_TOKENS.format('transcript')})) OVER w AS BIGINT)
            - len({_TOKENS.format('transcript')}) AS words_before
        FROM lines
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, line
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "utterances": f"""
        SELECT cast(conv_id AS VARCHAR) AS video_id, pos, {_SPEAKER} AS speaker, transcript,
          cast(chars_before * 60 AS DOUBLE) / 1000 AS "start",
          cast((chars_before + length(transcript)) * 60 AS DOUBLE) / 1000 AS "end",
          cast((conv_id * 31 + pos * 17) % 101 AS DOUBLE) / 100 AS confidence,
          CASE WHEN pos % 5 = 0 THEN NULL ELSE cast(pos * 7 % 10 AS DOUBLE) / 10 END
            AS speaker_confidence,
          chars_before, words_before
        FROM counted""",
    "tokens": f"""
        SELECT video_id, speaker, words_before, chars_before * 60 AS from_ms,
          length(transcript) * 60 AS line_ms, len(ts) AS n,
          unnest(range(0, len(ts))) AS i, unnest(ts) AS token
        FROM (SELECT *, {_TOKENS.format('transcript')} AS ts FROM utterances)""",
    "words": """
        SELECT video_id, words_before + i AS pos, nullif(speaker, 2) AS speaker,
          cast(from_ms + (line_ms * i) // n AS DOUBLE) / 1000 AS "start",
          translate(lower(token), '.,!?', '') AS word,
          CASE WHEN (words_before + i) % 9 = 4 THEN NULL ELSE token END AS punctuated_word
        FROM tokens""",
    "episodes": f"""
        SELECT cast(doc_id AS VARCHAR) AS video_id, substr(text, 1, 60) AS title,
          text AS description, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published_at,
          source AS channel_id, 'Channel ' || source AS channel_title,
          CASE WHEN n_chars % 4 = 0 THEN '' ELSE lang END AS tags,
          'PT' || n_chars // 3600 || 'H' || (n_chars % 3600) // 60 || 'M' || n_chars % 60 || 'S'
            AS duration,
          n_chars * 10 AS view_count,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS like_count,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 97 END AS comment_count,
          'https://img.example/' || doc_id || '.jpg' AS thumbnail_url,
          CASE doc_id % 3 WHEN 0 THEN doc_id || '.webm' WHEN 1 THEN '' END AS webm_filename,
          CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id || '.mp3' END AS audio_filename
        FROM documents""",
    "typed": f"""
        SELECT *, {_SECONDS.format('duration')} AS duration_seconds,
          CASE WHEN {_SECONDS.format('duration')} >= 180 THEN 'FULL' ELSE 'SHORT' END AS "type"
        FROM episodes""",
    "facts": f"""
        SELECT cast(conv_id AS VARCHAR) AS video_id, cast(sum(n) AS BIGINT) AS n_lines,
          cast(sum(chars) AS BIGINT) AS n_line_chars,
          cast(coalesce(sum(n) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS n_user,
          cast(coalesce(sum(n) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_assistant,
          cast(coalesce(sum(n) FILTER (WHERE role = 'system'), 0) AS BIGINT) AS n_system
        FROM (SELECT conv_id, role, len({_LINES}) AS n,
                coalesce(list_sum(list_transform({_LINES}, lambda l: length(l))), 0) AS chars
              FROM conversations)
        GROUP BY conv_id""",
    "catalogue": """
        SELECT t.*, CASE WHEN f.n_lines IS NOT NULL THEN t.video_id || '.json' END
            AS transcript_filename,
          cast(f.n_line_chars * 60 AS DOUBLE) / 1000 AS transcript_duration,
          f.n_lines AS transcript_utterances, cast(NULL AS BIGINT) AS speaker_count,
          f.n_user, f.n_assistant, f.n_system,
          CASE WHEN n_system > 0 THEN concat_ws(',', CASE WHEN n_user > 0 THEN '0' END,
            CASE WHEN n_assistant > 0 THEN '1' END, '2') END AS speaker_ids
        FROM typed t LEFT JOIN facts f USING (video_id)""",
    "covered": """
        SELECT *, CASE WHEN transcript_duration <> 0 AND duration_seconds <> 0
          THEN round(least(100.0::DOUBLE, transcript_duration / duration_seconds * 100), 2)
          END AS coverage
        FROM catalogue""",
    "inventory": """
        SELECT doc_id || '.mp3' AS file_name FROM labels
        UNION ALL
        SELECT DISTINCT conv_id || '.json' FROM conversations WHERE role = 'assistant'""",
    "updates": f"""
        SELECT e.video_id, 'Updated ' || coalesce(l.quality, 0) || ': ' || e.title AS title,
          e.description, e.published_at, e.channel_id, e.channel_title, e.tags, e.duration,
          e.view_count, e.like_count, e.comment_count, e.thumbnail_url, e.webm_filename,
          e.audio_filename, {_NULL_COLUMNS}, l.doc_id AS ordinal
        FROM episodes e JOIN labels l ON e.video_id = cast(l.doc_id AS VARCHAR)
        UNION ALL
        SELECT 'new-' || item_id, 'Take ' || take || ': ' || substr(text, 1, 40),
          text, TIMESTAMP '2025-01-01 00:00:00' + to_hours(item_id), 'bench', 'Channel bench', '',
          'PT' || length(text) || 'S', length(text), NULL, NULL, NULL, NULL, NULL, {_NULL_COLUMNS},
          item_id * 10 + take
        FROM benchmark CROSS JOIN (SELECT unnest([1, 2]) AS take)""",
    "latest_updates": """
        SELECT * FROM updates
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY ordinal DESC) = 1""",
    "responses": """
        SELECT cast(conv_id AS VARCHAR) AS video_id,
          CASE conv_id % 5
            WHEN 0 THEN '{"hosts": [{"name": "Host A' || conv_id % 3
              || '", "confidence": 0.9}, {"name": "Host B"}], "guests": []}'
            WHEN 1 THEN '{"hosts": [{"name": "Host A", "confidence": 0.6},'
              || ' {"name": "", "confidence": 0.5}, {"name": "Host A", "confidence": 0.95}],'
              || ' "guests": [{"name": "Guest ' || conv_id % 7 || '"}, {"name": "Guest Z",'
              || ' "confidence": 0.65, "mentioned_in": ["title"]}]}'
            WHEN 2 THEN 'Here you are:' || chr(10) || '{"guests": [{"name": "Guest '
              || conv_id % 7 || '", "confidence": 0.75}]}' || chr(10) || 'Hope this helps.'
            WHEN 3 THEN 'I cannot tell who is speaking.'
          END AS response
        FROM (SELECT DISTINCT conv_id FROM conversations)""",
    "parsed": """
        SELECT video_id, coalesce(r.hosts, []) AS hosts, coalesce(r.guests, []) AS guests
        FROM (SELECT video_id, from_json(
            CASE WHEN json_valid(response) THEN response
                 WHEN json_valid(regexp_extract(response, '(?s)(\\{.*\\})', 1))
                 THEN regexp_extract(response, '(?s)(\\{.*\\})', 1) ELSE '{}' END,
            '{"hosts": [{"name": "VARCHAR", "confidence": "DOUBLE"}],
              "guests": [{"name": "VARCHAR", "confidence": "DOUBLE"}]}') AS r
          FROM responses)""",
    "people": """
        SELECT video_id, 'host' AS kind, unnest(range(0, len(hosts))) AS ord,
          unnest(hosts) AS p, 0.8 AS unstated FROM parsed
        UNION ALL
        SELECT video_id, 'guest', unnest(range(0, len(guests))), unnest(guests), 0.7
        FROM parsed""",
    "candidates": """
        SELECT video_id, kind, name, confidence,
          row_number() OVER (PARTITION BY video_id, kind ORDER BY ord) AS name_rank
        FROM (SELECT video_id, kind, p.name AS name, min(ord) AS ord,
                arg_max(coalesce(p.confidence, cast(unstated AS DOUBLE)), ord) AS confidence
              FROM people WHERE coalesce(p.name, '') <> '' GROUP BY video_id, kind, p.name)""",
    "stats": """
        SELECT video_id, speaker, count(*) AS utterance_count, min(pos) AS first_pos,
          'Speaker ' || speaker AS speaker_tag
        FROM utterances WHERE speaker IS NOT NULL GROUP BY video_id, speaker""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY video_id
          ORDER BY utterance_count DESC, first_pos) AS speaker_rank
        FROM stats""",
    "hosted": """
        SELECT r.*, c.name AS host_name, c.confidence AS host_confidence
        FROM ranked r LEFT JOIN candidates c
          ON c.kind = 'host' AND c.video_id = r.video_id AND c.name_rank = r.speaker_rank""",
    "assigned": """
        SELECT h.video_id, h.speaker, h.speaker_tag, h.utterance_count, h.first_pos,
          coalesce(h.host_name, g.name, 'Unknown Speaker ' || h.speaker) AS name,
          CASE WHEN h.host_name IS NOT NULL THEN h.host_confidence
               WHEN g.name IS NOT NULL THEN g.confidence ELSE 0.1::DOUBLE END AS confidence,
          h.host_name IS NULL AND g.name IS NOT NULL AS is_guest,
          h.host_name IS NULL AND g.name IS NULL AS is_unknown,
          h.host_name IS NOT NULL OR g.name IS NOT NULL AS identified_by_llm
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id, host_name IS NULL
                ORDER BY first_pos) AS free_rank FROM hosted) h
        LEFT JOIN candidates g ON g.kind = 'guest' AND h.host_name IS NULL
          AND g.video_id = h.video_id AND g.name_rank = h.free_rank""",
    "forms": """
        SELECT *, 'whole' AS form FROM conversations
        UNION ALL
        SELECT *, unnest(['broken', 'bare', 'undated']) FROM conversations WHERE role = 'system'""",
    "docs": f"""
        SELECT *, conv_id || '-' || turn || CASE WHEN form = 'whole' THEN '' ELSE '-' || form END
            || '.json' AS file_name, {_LINES} AS ls, form = 'broken' AS rejected,
          CASE WHEN form IN ('whole', 'undated') THEN conv_id || '-' || turn END AS video_id,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) AS published_at
        FROM forms""",
    "doc_lines": f"""
        SELECT video_id, file_name, form, turn, published_at,
          unnest(range(0, len(ls))) AS pos, unnest(ls) AS transcript, conv_id,
          {_SPEAKER} AS speaker
        FROM docs WHERE NOT rejected""",
    "doc_utterances": """
        SELECT video_id, file_name, form, pos, transcript, cast(pos * 5 AS DOUBLE) AS "start",
          cast(pos * 5 AS DOUBLE) + 4.5::DOUBLE AS "end", speaker,
          CASE WHEN pos % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS speaker_confidence,
          cast((conv_id * 31 + pos * 17) % 101 AS DOUBLE) / 100 AS confidence,
          turn, published_at
        FROM doc_lines""",
    "doc_words": f"""
        SELECT video_id, file_name, form, pos, lower(token) AS word,
          CASE WHEN pos % 9 = 4 THEN NULL ELSE token END AS punctuated_word,
          cast(pos AS DOUBLE) / 2 AS "start",
          cast(CASE WHEN pos // 6 % 3 = 2 THEN NULL ELSE who + pos // 6 % 3 END AS INTEGER) AS speaker
        FROM (SELECT video_id, file_name, form, {_SPEAKER} AS who,
                unnest(range(0, len(ts))) AS pos, unnest(ts) AS token
              FROM (SELECT *, {_TOKENS.format("replace(text, chr(10), ' ')")} AS ts FROM docs
                    WHERE NOT rejected))""",
    "doc_runs": """
        SELECT *, sum(opens) OVER (PARTITION BY file_name ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM
                lag(speaker) OVER w THEN 1 ELSE 0 END AS opens
              FROM doc_words WHERE form = 'whole' WINDOW w AS (PARTITION BY file_name ORDER BY pos))""",
    "long": f"""
        SELECT *, cast(pos * 2 AS DOUBLE) AS "start", cast(pos * 2 AS DOUBLE) + 1.5::DOUBLE AS "end",
          cast(pos * 17 % 101 AS DOUBLE) / 100 AS confidence,
          CASE WHEN pos % 5 = 0 THEN NULL ELSE cast(pos * 7 % 10 AS DOUBLE) / 10 END
            AS speaker_confidence
        FROM (SELECT 'long-' || conv_id % 3 AS video_id, {_SPEAKER} AS speaker, transcript,
                row_number() OVER (PARTITION BY conv_id % 3 ORDER BY conv_id, turn, line) - 1 AS pos
              FROM lines)""",
    "long_context": f"""
        SELECT *, coalesce({_SNIP.format('before')}, '') AS previous,
          coalesce({_SNIP.format('after')}, '') AS "next"
        FROM (SELECT *, lag(transcript) OVER w AS before, lead(transcript) OVER w AS after
              FROM long WINDOW w AS (PARTITION BY video_id ORDER BY pos))""",
    "long_runs": """
        SELECT *, sum(opens) OVER (PARTITION BY video_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR who IS DISTINCT FROM
                lag(who) OVER w THEN 1 ELSE 0 END AS opens
              FROM (SELECT *, nullif(speaker, 2) AS who FROM long)
              WINDOW w AS (PARTITION BY video_id ORDER BY pos))""",
    "context": f"""
        SELECT *,
          coalesce({_SNIP.format('before')}, '') AS previous,
          coalesce({_SNIP.format('after')}, '') AS "next"
        FROM (SELECT *, lag(transcript) OVER w AS before, lead(transcript) OVER w AS after
              FROM utterances WINDOW w AS (PARTITION BY video_id ORDER BY pos))""",
    "runs": """
        SELECT *, sum(opens) OVER (PARTITION BY video_id ORDER BY pos
            ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR speaker IS DISTINCT FROM
                lag(speaker) OVER w THEN 1 ELSE 0 END AS opens
              FROM words WINDOW w AS (PARTITION BY video_id ORDER BY pos))""",
    "turns": """
        SELECT video_id, min(pos) AS turn_pos, arg_min(coalesce("start", 0), pos) AS "start",
          first(speaker ORDER BY pos) AS speaker, count(*) AS words,
          string_agg(coalesce(punctuated_word, word, ''), ' ' ORDER BY pos) AS "text"
        FROM runs GROUP BY video_id, run""",
    "header": """
        SELECT video_id, i - 100 AS line_no, line FROM (
          SELECT video_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (
            SELECT video_id, list_filter([
              '# ' || title, 'Video ID: ' || video_id,
              'Published: ' || strftime(published_at, '%Y-%m-%d'),
              CASE WHEN timed THEN 'Duration: ' || duration || ' (' || duration_seconds
                || ' seconds)' END,
              CASE WHEN timed THEN 'Transcript Duration: '
                || format('{:.2f}', transcript_duration) || ' seconds' END,
              CASE WHEN timed AND coalesce(coverage, 0) <> 0
                THEN 'Coverage: ' || coverage || '%' END,
              '', repeat('=', 80), ''], lambda x: x IS NOT NULL) AS ls
            FROM (SELECT *, coalesce(transcript_duration, 0) <> 0
                    AND coalesce(duration_seconds, 0) <> 0 AS timed FROM covered
                  {where})))""",
    "readable": """
        SELECT * FROM transcribed_header
        UNION ALL
        SELECT t.video_id, t.turn_pos, '[' || format('{:.1f}', t."start") || '] '
          || coalesce(a.name, 'Speaker ' || coalesce(cast(t.speaker AS VARCHAR), 'None'))
          || ': ' || t."text"
        FROM turns t JOIN catalogue c ON c.video_id = t.video_id
          AND c.transcript_filename IS NOT NULL
        LEFT JOIN assigned a ON a.video_id = t.video_id AND a.speaker = t.speaker
        UNION ALL
        SELECT video_id, 0, 'No transcript data found' FROM catalogue
        WHERE transcript_filename IS NOT NULL AND video_id NOT IN (SELECT video_id FROM words)""",
    "sections": """
        SELECT video_id, n, unnest([1, 2, 3]) AS section,
          unnest([0, n // 2, greatest(0, n - 20)]) AS first,
          unnest([least(20, n), least(20, n // 2), least(20, n)]) AS size
        FROM (SELECT f.video_id, count(u.pos) AS n FROM facts f
              LEFT JOIN utterances u USING (video_id) GROUP BY f.video_id)""",
    "sample_lines": """
        SELECT video_id, section, -1 AS pos, 0 AS chars, CASE WHEN first = 0
            THEN '--- BEGINNING OF TRANSCRIPT ---' WHEN first = n // 2
            THEN '--- MIDDLE OF TRANSCRIPT ---' ELSE '--- END OF TRANSCRIPT ---' END AS line
        FROM sections
        UNION ALL
        SELECT s.video_id, s.section, u.pos,
          length('Speaker ' || u.speaker || ': ' || u.transcript),
          'Speaker ' || u.speaker || ': ' || u.transcript
        FROM sections s JOIN utterances u ON u.video_id = s.video_id
          AND u.pos >= s.first AND u.pos < s.first + s.size
        WHERE u.speaker IS NOT NULL AND u.transcript IS NOT NULL""",
    "used": """
        SELECT *, coalesce(sum(chars) OVER (PARTITION BY video_id, section ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_chars
        FROM sample_lines""",
    "kept": "SELECT * FROM used WHERE used_chars * 3 <= 4000",
    "section_chars": """
        SELECT video_id, section, sum(chars) AS section_chars FROM kept
        GROUP BY video_id, section""",
    "sampled": """
        SELECT k.*, coalesce(sum(t.section_chars), 0) AS before
        FROM kept k LEFT JOIN section_chars t
          ON t.video_id = k.video_id AND t.section < k.section
        GROUP BY ALL""",
    "samples": """
        SELECT video_id, string_agg(line, chr(10) ORDER BY section, pos) AS sample
        FROM sampled WHERE before < 4000 GROUP BY video_id""",
    "talk_lines": """
        SELECT video_id, i, line, sum(CASE WHEN starts_with(line, 'Speaker ') THEN 1 ELSE 0 END)
            OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp
        FROM (SELECT video_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
              FROM (SELECT video_id, string_split(sample, chr(10)) AS ls FROM samples))""",
    "talk": f"""
        SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY grp) - 1 AS turn,
          speaker, "text" FROM (
          SELECT video_id, grp,
            arg_min(CASE WHEN contains(line, ':') THEN substr(line, 1, strpos(line, ':') - 1)
              ELSE line END, i) AS speaker,
            string_agg(CASE WHEN NOT starts_with(line, 'Speaker ')
                THEN ' ' || trim(line, {_SPACE})
              WHEN contains(line, ':')
                THEN trim(substr(line, strpos(line, ':') + 1), {_SPACE})
              ELSE '' END, '' ORDER BY i) AS "text"
          FROM talk_lines WHERE grp > 0 GROUP BY video_id, grp) WHERE "text" <> ''""",
    "hints": "SELECT video_id, hint.phrase AS phrase, hint.name AS name FROM (SELECT video_id, coalesce("
    + ", ".join(
        f"CASE WHEN length(trim(string_split_regex(string_split(lower(description), '{p}')[2],"
        f" '[.,!]')[1], {_SPACE})) > 3 THEN {{'phrase': '{p}', 'name':"
        f" trim(string_split_regex(string_split(lower(description), '{p}')[2],"
        f" '[.,!]')[1], {_SPACE})}} END"
        for p in ("with ", "featuring ", "guest ", "welcomes ")
    )
    + ") AS hint FROM episodes)",
    "items": f"""
        SELECT cast(doc_id AS VARCHAR) AS video_id, substr(text, 1, 60) AS title, text AS description,
          {_ISO.format("TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id)")} AS published_at,
          source AS channel_id, 'Channel ' || source AS channel_title, CASE WHEN n_chars % 4 = 0 THEN '' ELSE lang END AS tags,
          'PT' || n_chars || 'S' AS duration,
          CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars * 10 END AS view_count,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars END AS like_count,
          CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 97 END AS comment_count,
          'https://img.example/' || doc_id || '.jpg' AS thumbnail_url,
          cast(NULL AS VARCHAR) AS webm_filename, cast(NULL AS VARCHAR) AS audio_filename,
          {_NULL_COLUMNS}, cast(NULL AS VARCHAR) AS "type", cast(NULL AS BIGINT) AS duration_seconds,
          cast(NULL AS DOUBLE) AS coverage
        FROM documents""",
    "chunked": f"""
        SELECT u.video_id || '_' || u.pos AS chunk_id, u.video_id, u.pos AS chunk_index,
          u.transcript AS content, u."start" AS start_time, u."end" AS end_time,
          round(u."end" - u."start", 2) AS duration, u.speaker AS speaker_id,
          round(coalesce(u.speaker_confidence, 0), 3) AS speaker_confidence,
          round(u.confidence, 3) AS confidence_score, e.title AS episode_title,
          {_ISO.format('e.published_at')} AS published_at,
          coalesce(e."type", 'UNKNOWN') AS episode_type, e.duration_seconds AS episode_duration,
          coalesce(e.description, '') AS episode_description, u."start" AS "timestamp",
          coalesce(e.tags, '') AS tags, e.view_count, e.like_count, e.comment_count,
          round(u."end" - u."start", 2) AS metadata_seconds,
          coalesce(e."type", 'UNKNOWN') AS metadata_type,
          e.view_count AS views, e.like_count AS likes, e.comment_count AS comments,
          u.previous, u."next", cast(year(e.published_at) AS INTEGER) AS "year", cast(month(e.published_at) AS INTEGER) AS "month",
          cast(day(e.published_at) AS INTEGER) AS "day",
          CASE WHEN u.confidence > 0.9 THEN 'high' WHEN u.confidence > 0.7 THEN 'medium'
            ELSE 'low' END AS confidence_tier,
          coalesce(e.tags, '') <> '' AS has_tags
        FROM context u LEFT JOIN typed e USING (video_id)""",
    "doc_context": f"""
        SELECT *,
          coalesce({_SNIP.format('before')}, '') AS previous,
          coalesce({_SNIP.format('after')}, '') AS "next"
        FROM (SELECT *, lag(transcript) OVER w AS before, lead(transcript) OVER w AS after
              FROM doc_utterances WHERE form = 'whole'
              WINDOW w AS (PARTITION BY file_name ORDER BY pos))""",
    "doc_chunked": f"""
        SELECT u.video_id || '_' || u.pos AS chunk_id, u.video_id, u.pos AS chunk_index,
          u.transcript AS content, u."start" AS start_time, u."end" AS end_time,
          round(u."end" - u."start", 2) AS duration, u.speaker AS speaker_id,
          round(coalesce(u.speaker_confidence, 0), 3) AS speaker_confidence,
          round(u.confidence, 3) AS confidence_score, 'Part ' || u.turn AS episode_title,
          {_ISO.format('u.published_at')} AS published_at,
          coalesce(e."type", 'UNKNOWN') AS episode_type, e.duration_seconds AS episode_duration,
          coalesce(e.description, '') AS episode_description, u."start" AS "timestamp",
          coalesce(e.tags, '') AS tags, e.view_count, e.like_count, e.comment_count,
          round(u."end" - u."start", 2) AS metadata_seconds,
          coalesce(e."type", 'UNKNOWN') AS metadata_type,
          e.view_count AS views, e.like_count AS likes, e.comment_count AS comments,
          u.previous, u."next", cast(year(u.published_at) AS INTEGER) AS "year", cast(month(u.published_at) AS INTEGER) AS "month",
          cast(day(u.published_at) AS INTEGER) AS "day",
          CASE WHEN u.confidence > 0.9 THEN 'high' WHEN u.confidence > 0.7 THEN 'medium'
            ELSE 'low' END AS confidence_tier,
          coalesce(e.tags, '') <> '' AS has_tags
        FROM doc_context u LEFT JOIN typed e ON split_part(u.video_id, '-', 1) = e.video_id""",
    "merging": "{utterances} {512}",
    "merged": "{merging}",
    "long_merging": "{long} {40}",
    "long_merged": "{long_merging}",
    "thinned": """
        SELECT * REPLACE (row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS pos), pos AS at
        FROM utterances WHERE pos % 4 <> 2""",
    "thin_merging": "{thinned} {512}",
    "thin_merged": "{thin_merging}",
    "upserted": f"""
        SELECT {_ROW} FROM (
          SELECT {_FETCHED}, {_ADDED} FROM latest_updates
          UNION ALL
          SELECT {_FETCHED}, {_ADDED} FROM catalogue
          WHERE video_id NOT IN (SELECT video_id FROM updates))""",
}
_VIEWS["doc_whole"] = "SELECT * FROM doc_utterances WHERE form = 'whole'"
for _name in ("sections", "sample_lines", "used", "kept", "section_chars", "sampled", "samples"):
    _body = re.sub(r"\b(FROM|JOIN) (sections|sample_lines|used|kept|section_chars|sampled)\b",
                   r"\1 long_\2", _VIEWS[_name])
    _VIEWS[f"doc_{_name}"] = re.sub(r"\butterances\b", "doc_whole", _body.replace("long_", "doc_")).replace(
        "FROM facts f", "FROM (SELECT video_id FROM docs WHERE form = 'whole') f")
    _VIEWS[f"long_{_name}"] = re.sub(r"\butterances\b", "long", _body).replace(
        "FROM facts f", "FROM (SELECT DISTINCT video_id FROM long) f")
_VIEWS["transcribed_header"] = _VIEWS["header"].replace(
    "{where}", "WHERE transcript_filename IS NOT NULL"
)
_VIEWS["header"] = _VIEWS["header"].replace("{where}", "")



def _merging(name: str, rows: str, most: int) -> str:
    return f"""
        SELECT video_id, pos, pos AS first_pos, speaker, transcript AS "text", confidence
        FROM {rows} WHERE pos = 0
        UNION ALL
        SELECT u.video_id, u.pos,
          CASE WHEN fits THEN m.first_pos ELSE u.pos END, u.speaker,
          CASE WHEN fits THEN m."text" || ' ' || u.transcript ELSE u.transcript END,
          CASE WHEN fits THEN (m.confidence + u.confidence) / 2 ELSE u.confidence END
        FROM {name} m JOIN {rows} u ON u.video_id = m.video_id AND u.pos = m.pos + 1,
          LATERAL (SELECT u.speaker IS NOT DISTINCT FROM m.speaker
            AND length(m."text") + length(u.transcript) <= {most} AS fits)"""


for _name, _rows, _most in (("merging", "utterances", 512), ("long_merging", "long", 40),
                            ("thin_merging", "thinned", 512)):
    _VIEWS[_name] = _merging(_name, _rows, _most)
    _VIEWS[_name.replace("merging", "merged")] = f"""
        SELECT video_id, first_pos, max(pos) AS last_pos, arg_max("text", pos) AS "text",
          arg_max(confidence, pos) AS confidence
        FROM {_name} GROUP BY video_id, first_pos"""

_STOP_WORDS = "('the', 'and', 'of', 'to', 'is', 'a', 'in', 'on', 'der', 'die', 'le', 'la', 'de', 'el')"
_VIEWS["doc_terms"] = """
        SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM documents"""
_VIEWS["term_counts"] = f"""
        SELECT term, count(*) AS n FROM doc_terms WHERE term <> '' AND term NOT IN {_STOP_WORDS}
        GROUP BY term"""

_VIEWS["person_words"] = """
        SELECT name, term, cast(sum(n) AS BIGINT) AS n
        FROM (SELECT video_id, speaker, term, count(*) AS n
              FROM (SELECT video_id, speaker, unnest(list_transform(regexp_extract_all(transcript,
                      '[\\p{L}\\p{M}\\p{N}]+'), lambda w: lower(w))) AS term FROM utterances)
              GROUP BY ALL)
          JOIN assigned USING (video_id, speaker)
        GROUP BY ALL"""
_VIEWS["person_odds"] = """
        SELECT *, n + 500.0::DOUBLE * all_n / total AS here, all_n - n + 500.0::DOUBLE * all_n / total AS there
        FROM (SELECT *, sum(n) OVER (PARTITION BY term) AS all_n, sum(n) OVER (PARTITION BY name) AS own,
                sum(n) OVER () AS total FROM person_words)"""
_VIEWS["person_scores"] = """
        SELECT name, term, n, round((ln(here / (own + 500 - here)) - ln(there / (total - own + 500 - there)))
          / sqrt(1 / here + 1 / there), 6) AS z FROM person_odds"""
_VIEWS["published"] = """
        SELECT date_diff('day', (SELECT min(cast(published_at AS DATE)) FROM episodes), cast(published_at AS DATE)) AS t,
          list_distinct(list_transform(regexp_extract_all(description, '[\\p{L}\\p{M}\\p{N}]+'),
            lambda w: lower(w))) AS terms
        FROM episodes"""
_VIEWS["term_line"] = """
        SELECT term, t, coalesce(cases, 0) AS cases, coalesce(n, 0) AS n,
          sum(coalesce(cases, 0)) OVER (PARTITION BY term)::DOUBLE AS all_cases,
          sum(coalesce(n, 0)) OVER (PARTITION BY term) AS all_n, count(*) OVER (PARTITION BY term) AS days
        FROM (SELECT term, unnest(range(0, (SELECT max(t) + 1 FROM published))) AS t
              FROM (SELECT term FROM term_counts ORDER BY n DESC, term LIMIT 200))
          LEFT JOIN (SELECT t, count(*) AS cases FROM published GROUP BY t) USING (t)
          LEFT JOIN (SELECT t, term, count(*) AS n FROM (SELECT t, unnest(terms) AS term FROM published)
                     GROUP BY ALL) USING (t, term)"""
_VIEWS["term_costs"] = """
        SELECT term, t, n, days, ln(days) AS step,
          -(n * ln(least(0.9999, all_n / all_cases)) + (cases - n) * ln(1 - least(0.9999, all_n / all_cases))) AS usual,
          -(n * ln(least(0.9999, 2 * all_n / all_cases)) + (cases - n) * ln(1 - least(0.9999, 2 * all_n / all_cases)))
            AS burst
        FROM term_line WHERE all_n > 0"""
_VIEWS["term_ways"] = """
        SELECT term, -1::BIGINT AS t, 0.0::DOUBLE AS low, max(step) AS high, '' AS low_way, '' AS high_way
        FROM term_costs GROUP BY term
        UNION ALL
        SELECT w.term, c.t, usual + least(low, high), burst + least(low + step, high),
          CASE WHEN low > high THEN high_way ELSE low_way END || '0',
          CASE WHEN high <= low + step THEN high_way ELSE low_way END || '1'
        FROM term_ways w JOIN term_costs c ON c.term = w.term AND c.t = w.t + 1"""
_VIEWS["term_states"] = """
        SELECT term, t, n, usual - burst AS gain, state, sum(CASE WHEN state = 0 THEN 1 ELSE 0 END)
          OVER (PARTITION BY term ORDER BY t) AS run
        FROM (SELECT c.*, cast(substr(CASE WHEN low > high THEN high_way ELSE low_way END, (c.t + 1)::INT, 1) AS INT) AS state
              FROM term_costs c JOIN term_ways w ON w.term = c.term AND w.t = days - 1)"""
_VIEWS["pairs"] = """
        SELECT list_extract(w, i::INT) AS "first", list_extract(w, i::INT + 1) AS second, count(*) AS n
        FROM (SELECT w, unnest(range(1, len(w))) AS i
              FROM (SELECT list_transform(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+'), lambda w: lower(w)) AS w
                    FROM documents))
        GROUP BY ALL"""
_VIEWS["pair_table"] = """
        SELECT "first", second, n, a, a1 - a AS b, a2 - a AS c, s - a1 - a2 + a AS d, a1, a2, s
        FROM (SELECT *, n::DOUBLE AS a, sum(n) OVER (PARTITION BY "first")::DOUBLE AS a1,
                sum(n) OVER (PARTITION BY second)::DOUBLE AS a2, sum(n) OVER ()::DOUBLE AS s FROM pairs)"""
_VIEWS["typed_terms"] = """
        SELECT DISTINCT unnest([left(term, 1) || substr(term, 3), term || 'x', left(term, 1) || 'q' || substr(term, 3)]) AS typed
        FROM (SELECT term FROM term_counts ORDER BY n DESC, term LIMIT 60)"""

# Words of full-text search, and BM25 of them (k1 1.2, b 0.75).
_WORD = "[\\p{L}\\p{M}\\p{N}]+"
_VIEWS["spoken"] = f"""
        SELECT video_id || ':' || pos AS doc_id, transcript AS "text", speaker, "type",
          strftime(published_at, '%Y-%m-%d') AS "day",
          list_transform(regexp_extract_all(transcript, '{_WORD}'), lambda w: lower(w)) AS ws
        FROM utterances JOIN typed USING (video_id)"""
_VIEWS["asked"] = """
        SELECT * FROM (VALUES (1, ['the', 'and', 'of'], false), (2, ['of', 'the'], true), (3, ['the', 'the'], true),
          (4, ['that'], false), (5, ['to', 'the', 'a'], false), (6, ['nowhere'], false)) v(query_id, qs, phrase)"""
_VIEWS["counted_words"] = """
        SELECT doc_id, len(ws) AS length, term, count(*) AS n
        FROM (SELECT doc_id, ws, unnest(ws) AS term FROM spoken) GROUP BY ALL"""
_VIEWS["weighed"] = """
        SELECT doc_id, term, n, ln(1 + (total - df + 0.5) / (df + 0.5)) * n * 2.2::DOUBLE
          / (n + 1.2::DOUBLE * (0.25 + 0.75 * length / average)) AS weight
        FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM counted_words),
          (SELECT count(*)::DOUBLE AS total, avg(len(ws)) AS average FROM spoken)"""
_VIEWS["found"] = """
        SELECT query_id, phrase, qs, doc_id, round(sum(weight), 6) AS score, cast(sum(n) AS BIGINT) AS n
        FROM (SELECT *, unnest(list_distinct(qs)) AS term FROM asked) JOIN weighed USING (term)
        GROUP BY ALL HAVING count(*) = len(list_distinct(qs))"""
_VIEWS["answered"] = """
        SELECT * FROM (
          SELECT f.*, speaker, "type", "day", "text", list_filter(range(0, len(ws)),
            lambda i: list_slice(ws, i + 1, i + len(qs)) = qs) AS starts
          FROM found f JOIN spoken USING (doc_id))
        WHERE NOT phrase OR len(starts) > 0"""


def _marked(text: str, hit: str) -> str:
    """``text`` with the words in brackets whose index i and lower-case form w fulfil ``hit``."""
    words, gaps = f"regexp_extract_all({text}, '{_WORD}')", f"string_split_regex({text}, '{_WORD}')"
    shown = f"list_transform({words}, lambda v, i: CASE WHEN {hit} THEN '[' || v || ']' ELSE v END)"
    return f"array_to_string(list_transform(list_zip({gaps}, {shown}), lambda z: z[1] || coalesce(z[2], '')), '')"


_RECURSIVE = {"term_ways", "merging", "long_merging", "thin_merging"}


def _sql(body: str) -> str:
    """Put the views a body uses, and those they use, in front of it."""
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in _VIEWS:
            used = re.search(rf"(?:FROM|JOIN)\s+{name}\b", text)
            if used and name not in needed and name != inside:
                visit(_VIEWS[name], name)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    word = "WITH RECURSIVE" if _RECURSIVE & set(needed) else "WITH"
    return word + " " + ",\n".join(f"{n} AS ({_VIEWS[n]})" for n in needed) + "\n" + body


_BODIES: dict[str, str] = {
    "scan_episodes": f"SELECT {_ROW} FROM catalogue",
    "scan_catalogue_documents": f"SELECT {_ROW} FROM catalogue",
    "scan_catalogue_lines": f"SELECT {_ROW} FROM catalogue",
    "catalogue_version": f"""
        SELECT r.* REPLACE (t."type" AS "type", t.duration_seconds AS duration_seconds)
        FROM (SELECT {_ROW} FROM catalogue) r JOIN typed t USING (video_id)""",
    "dedup_catalogue_last": "SELECT * FROM upserted",
    "scan_transcripts": """
        SELECT file_name, rejected,
          CASE WHEN NOT rejected THEN cast(len(ls) * 5 AS DOUBLE) END AS duration,
          video_id, CASE WHEN NOT rejected THEN len(ls) END AS utterances
        FROM docs""",
    "file_inventory": """
        SELECT left(file_name, 1) AS digit, count(*) AS files, true AS filled FROM docs GROUP BY ALL""",
    "transcript_files": """
        SELECT file_name, rejected,
          CASE WHEN NOT rejected THEN cast(len(ls) * 5 AS DOUBLE) END AS duration,
          video_id, CASE WHEN NOT rejected THEN len(ls) END AS utterances
        FROM docs""",
    "rejected_transcripts": """
        SELECT file_name, CASE form WHEN 'broken' THEN 'not JSON' WHEN 'bare' THEN 'no episode metadata'
            ELSE 'unreadable date' END AS reason
        FROM docs WHERE form <> 'whole'""",
    "explode_utterances": """
        SELECT video_id, file_name, pos, transcript, "start", "end", speaker,
          speaker_confidence, confidence
        FROM doc_utterances""",
    "explode_words": """
        SELECT video_id, file_name, pos, word, punctuated_word, "start", speaker FROM doc_words
        UNION ALL
        SELECT video_id, file_name, NULL, NULL, NULL, NULL, NULL FROM docs
        WHERE NOT rejected AND file_name NOT IN (SELECT file_name FROM doc_words)""",
    "flatten_video_items": """
        SELECT * FROM items
        UNION ALL BY NAME
        SELECT doc_id || 'u' AS video_id, '' AS tags, 0 AS view_count FROM documents
        WHERE doc_id % 10 = 3""",
    "playlist_video_ids": "SELECT 'v' || doc_id AS video_id FROM documents",
    "transcript_to_json": """
        SELECT file_name, text AS transcript, array_to_string(ls, '|') AS utterances
        FROM docs WHERE NOT rejected""",
    "chunk_files": "SELECT * FROM chunked",
    "readable_files": """
        SELECT video_id, unnest(string_split(line, chr(10))) AS line FROM readable""",
    "episode_by_id": "SELECT video_id, title, duration FROM episodes WHERE video_id = '17'",
    "episodes_by_ids": """
        SELECT video_id, title, duration FROM episodes
        WHERE video_id IN ('3', '17', '99999999', '42')""",
    "search_episodes": """
        SELECT video_id, title FROM episodes
        WHERE contains(lower(title), 'this in') OR contains(lower(description), 'this in')""",
    "parse_duration": "SELECT video_id, duration, duration_seconds FROM typed",
    "classify_episodes": 'SELECT video_id, duration_seconds, "type" FROM typed',
    "full_episode_ids": "SELECT video_id FROM typed WHERE \"type\" = 'FULL'",
    "latest_episodes": f"""
        SELECT video_id, {_ISO.format('published_at')} AS published_at FROM (
          SELECT * FROM episodes ORDER BY published_at DESC, video_id LIMIT 10)""",
    "latest_full_episodes": """
        SELECT video_id FROM (SELECT * FROM typed WHERE "type" = 'FULL'
          ORDER BY published_at DESC, video_id LIMIT 5)""",
    "type_summary": 'SELECT "type", count(*) AS episodes FROM typed GROUP BY "type"',
    "episode_listing": """
        SELECT CASE WHEN "type" = 'FULL' THEN 0 ELSE 1 END AS part, video_id,
          CASE WHEN duration_seconds >= 86400 THEN duration_seconds // 86400
            || CASE WHEN duration_seconds // 86400 = 1 THEN ' day, ' ELSE ' days, ' END ELSE '' END
          || duration_seconds % 86400 // 3600 || ':'
          || lpad(cast(duration_seconds % 3600 // 60 AS VARCHAR), 2, '0') || ':'
          || lpad(cast(duration_seconds % 60 AS VARCHAR), 2, '0') AS duration,
          "type", substr(title, 1, 40) AS title
        FROM typed""",
    "needs_download": "SELECT video_id, duration FROM typed WHERE \"type\" = 'FULL'",
    "needs_convert": """
        SELECT video_id, webm_filename FROM episodes WHERE coalesce(webm_filename, '') <> ''""",
    "needs_transcribe": """
        SELECT video_id, audio_filename FROM episodes WHERE audio_filename IS NOT NULL""",
    "needs_speakers": """
        SELECT video_id, transcript_filename FROM catalogue
        WHERE transcript_filename IS NOT NULL AND speaker_ids IS NULL""",
    "derived_filenames": """
        SELECT video_id, video_id || '.mp3' AS audio_name,
          regexp_replace(audio_filename, '\\.[^.]*$', '') || '.json' AS transcript_name
        FROM episodes""",
    "guest_hint": "SELECT video_id, phrase, name FROM hints",
    "upsert_episodes": "SELECT * FROM upserted",
    "upsert_repairs": """
        SELECT * REPLACE (CASE WHEN try_cast(video_id AS BIGINT) % 5 = 0 AND video_id NOT IN (SELECT video_id FROM updates)
          THEN 'Later ' || title ELSE title END AS title) FROM upserted""",
    "names_by_file": """
        SELECT d.file_name, coalesce(c.video_id, CASE WHEN d.turn % 2 = 0 AND d.form IN ('whole', 'undated')
          THEN d.video_id END) AS video_id
        FROM docs d LEFT JOIN catalogue c ON c.transcript_filename IS NOT NULL AND c.video_id || '-1.json' = d.file_name
        WHERE NOT d.rejected""",
    "transcript_to_json_whole": """
        SELECT file_name, 'm-2' AS model, '1.5' AS tag, 'in short' AS summary,
          CASE WHEN d.turn % 2 = 0 AND d.form <> 'bare' THEN d.video_id ELSE cast(d.conv_id AS VARCHAR) END AS stamped_id,
          "text" AS transcript
        FROM docs d JOIN catalogue c ON c.video_id = cast(d.conv_id AS VARCHAR) WHERE NOT d.rejected""",
    "update_existing": f"""
        SELECT {_ROW} FROM latest_updates WHERE video_id IN (SELECT video_id FROM catalogue)
        UNION ALL
        SELECT {_ROW} FROM catalogue WHERE video_id NOT IN (SELECT video_id FROM updates)""",
    "unmatched_updates": """
        SELECT DISTINCT video_id FROM updates
        WHERE video_id NOT IN (SELECT video_id FROM catalogue)""",
    "upsert_preserve_metadata": """
        SELECT u.* REPLACE (
          coalesce(c.audio_filename, u.audio_filename) AS audio_filename,
          coalesce(c.transcript_filename, u.transcript_filename) AS transcript_filename,
          coalesce(c.transcript_duration, u.transcript_duration) AS transcript_duration,
          coalesce(c.transcript_utterances, u.transcript_utterances) AS transcript_utterances,
          coalesce(c.speaker_ids, u.speaker_ids) AS speaker_ids)
        FROM upserted u LEFT JOIN catalogue c USING (video_id)""",
    "missing_files": """
        SELECT video_id, 'audio' AS kind, audio_filename AS file_name FROM catalogue
        WHERE audio_filename IS NOT NULL
          AND audio_filename NOT IN (SELECT file_name FROM inventory)
        UNION ALL
        SELECT video_id, 'transcript', transcript_filename FROM catalogue
        WHERE transcript_filename IS NOT NULL
          AND transcript_filename NOT IN (SELECT file_name FROM inventory)""",
    "repair_catalogue": f"""
        SELECT {_ROW} FROM (SELECT * REPLACE (
          CASE WHEN audio_filename IN (SELECT file_name FROM inventory)
            THEN audio_filename END AS audio_filename,
          CASE WHEN transcript_filename IN (SELECT file_name FROM inventory)
            THEN transcript_filename END AS transcript_filename)
          FROM catalogue)""",
    "episodes_with_files": """
        SELECT video_id, audio_filename FROM episodes
        WHERE audio_filename IN (SELECT file_name FROM inventory)""",
    "transcript_coverage": "SELECT video_id, coverage FROM covered",
    "speaker_count_estimate": """
        SELECT video_id, CASE WHEN transcript_duration <> 0 AND duration_seconds <> 0
            AND transcript_utterances <> 0
          THEN least(4, greatest(1, transcript_utterances // 10)) END AS speaker_count
        FROM catalogue""",
    "verify_stats": """
        SELECT *, round(100.0::DOUBLE * with_audio / total_episodes, 1) AS audio_percent,
          round(100.0::DOUBLE * with_transcript / total_episodes, 1) AS transcript_percent,
          round(100.0::DOUBLE * with_speakers / total_episodes, 1) AS speakers_percent
        FROM (SELECT count(*) AS total_episodes,
            count(*) FILTER (WHERE "type" = 'FULL') AS full_episodes,
            count(*) FILTER (WHERE "type" = 'SHORT') AS shorts,
            count(*) FILTER (WHERE coalesce(audio_filename, '') <> '') AS with_audio,
            count(*) FILTER (WHERE coalesce(transcript_filename, '') <> '') AS with_transcript,
            count(*) FILTER (WHERE coalesce(speaker_ids, '') <> '') AS with_speakers
          FROM catalogue)""",
    "verify_missing": """
        SELECT category, cast(rank AS INTEGER) AS rank, video_id, title, missing,
          greatest(missing - 10, 0) AS more
        FROM (SELECT *, row_number() OVER (PARTITION BY category
                  ORDER BY published_at DESC, video_id) AS rank,
                count(*) OVER (PARTITION BY category) AS missing
              FROM (SELECT 'audio' AS category, * FROM catalogue
                      WHERE coalesce(audio_filename, '') = ''
                    UNION ALL SELECT 'transcript', * FROM catalogue
                      WHERE coalesce(transcript_filename, '') = ''
                    UNION ALL SELECT 'speakers', * FROM catalogue
                      WHERE coalesce(speaker_ids, '') = ''))
        WHERE rank <= 10""",
    "chunk_context": 'SELECT video_id, pos, previous, "next" FROM context',
    "confidence_tier": """
        SELECT video_id, pos, confidence, CASE WHEN confidence > 0.9 THEN 'high'
          WHEN confidence > 0.7 THEN 'medium' ELSE 'low' END AS tier
        FROM utterances""",
    "enrich_utterances": """
        SELECT u.video_id, u.pos, e.title AS episode_title,
          coalesce(e."type", 'UNKNOWN') AS episode_type, e.duration_seconds AS episode_duration,
          e.view_count, e.like_count, e.comment_count
        FROM utterances u LEFT JOIN typed e USING (video_id)""",
    "chunk_records": "SELECT * FROM chunked",
    "document_chunks": "SELECT * FROM doc_chunked",
    "attach_episode_metadata": f"""
        SELECT file_name, coalesce(d.stamp, c.video_id) AS stamped_id,
          CASE WHEN d.form = 'undated' AND d.stamp IS NOT NULL THEN 'some day'
            WHEN d.stamp IS NOT NULL THEN {_ISO.format('d.published_at')} || 'Z'
            ELSE {_ISO.format('c.published_at')} END AS published_at,
          CASE WHEN d.stamp IS NULL THEN c.duration_seconds END AS duration_seconds,
          CASE WHEN d.stamp IS NULL THEN c.transcript_duration END AS transcript_duration
        FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN video_id END AS stamp FROM docs) d
        JOIN catalogue c ON c.video_id = cast(d.conv_id AS VARCHAR)
        WHERE NOT d.rejected""",
    "merge_short_chunks": """
        SELECT m.video_id, m.first_pos AS pos, a.speaker, m."text" AS transcript, a."start",
          z."end", round(m.confidence, 6) AS confidence, a.speaker_confidence, a.previous, z."next"
        FROM merged m
        JOIN context a ON a.video_id = m.video_id AND a.pos = m.first_pos
        JOIN context z ON z.video_id = m.video_id AND z.pos = m.last_pos""",
    "long_merged_chunks": """
        SELECT m.video_id, m.first_pos AS pos, a.speaker, m."text" AS transcript, a."start",
          z."end", round(m.confidence, 6) AS confidence, a.speaker_confidence, a.previous, z."next"
        FROM long_merged m
        JOIN long_context a ON a.video_id = m.video_id AND a.pos = m.first_pos
        JOIN long_context z ON z.video_id = m.video_id AND z.pos = m.last_pos""",
    "merge_after_filter": """
        SELECT m.video_id, a.at AS pos, a.speaker, m."text" AS transcript, a."start",
          z."end", round(m.confidence, 6) AS confidence, a.speaker_confidence
        FROM thin_merged m
        JOIN thinned a ON a.video_id = m.video_id AND a.pos = m.first_pos
        JOIN thinned z ON z.video_id = m.video_id AND z.pos = m.last_pos""",
    "speaker_turns": """
        SELECT video_id, turn_pos, speaker, "start", words, "text" FROM turns""",
    "document_turns": """
        SELECT video_id, min(pos) AS turn_pos, arg_min("start", pos) AS "start",
          first(speaker ORDER BY pos) AS speaker, count(*) AS words,
          string_agg(coalesce(punctuated_word, word), ' ' ORDER BY pos) AS "text"
        FROM doc_runs GROUP BY video_id, file_name, run""",
    "long_chunk_context": 'SELECT video_id, pos, previous, "next" FROM long_context',
    "long_speaker_turns": """
        SELECT video_id, min(pos) AS turn_pos, arg_min("start", pos) AS "start",
          first(who ORDER BY pos) AS speaker, count(*) AS words,
          string_agg(transcript, ' ' ORDER BY pos) AS "text"
        FROM long_runs GROUP BY video_id, run""",
    "document_sample": "SELECT video_id, sample FROM doc_samples",
    "long_transcript_sample": "SELECT video_id, sample FROM long_samples",
    "readable_header": "SELECT * FROM header",
    "readable_transcript": "SELECT * FROM readable",
    "strip_labels": """
        SELECT video_id, line_no,
          regexp_replace(regexp_replace(line, '(?m)^(\\[\\d+\\.\\d\\] )[^:\\n]+: ', '\\1', 'g'),
            '(?m)^\\[\\d+\\.\\d\\] ', '', 'g') AS bare,
          regexp_replace(line, '(?m)^(\\[\\d+\\.\\d\\] )[^:\\n]+: ', '\\1', 'g') AS timed,
          'x ' || line AS bracketed
        FROM readable""",
    "transcript_sample": "SELECT video_id, sample FROM samples",
    "plain_transcript_sample": """
        SELECT video_id, array_to_string(CASE WHEN len(ls) > 30 THEN
            list_concat(['--- BEGINNING OF TRANSCRIPT ---'], ls[1:10],
              ['--- MIDDLE OF TRANSCRIPT ---'], ls[len(ls) // 2 - 4:len(ls) // 2 + 5],
              ['--- END OF TRANSCRIPT ---'], ls[-10:])
          ELSE ls END, chr(10)) AS sample
        FROM (SELECT video_id, string_split_regex(description, '[ \\n]+') AS ls FROM episodes)""",
    "head_sample": f"""
        SELECT video_id, array_to_string(list_transform(ls[1:10],
          lambda l: 'Speaker ' || ({_SPEAKER}) || ': ' || l), chr(10)) AS sample
        FROM docs WHERE form = 'whole'""",
    "conversation_turns": "SELECT video_id, turn, speaker, \"text\" FROM talk",
    "speaker_prompts": """
        SELECT e.video_id, 'Name the speakers of this recorded episode.' || chr(10) || chr(10)
          || 'Title: ' || e.title || chr(10) || chr(10)
          || 'Description: ' || e.description || chr(10) || chr(10)
          || CASE WHEN h.name IS NOT NULL THEN 'Announced guest (after "' || trim(h.phrase) || '"): '
            || h.name || chr(10) || chr(10) ELSE '' END
          || 'Transcript:' || chr(10) || coalesce(t.conversation, '') || chr(10) || chr(10)
          || 'Regular hosts:' || chr(10) || '1. Alex Moreau' || chr(10) || '2. Dana Whitfield'
          || chr(10) || 'How they speak:' || chr(10) || '- Alex Moreau: asks the questions'
          || chr(10) || '- Dana Whitfield: explains at length' || chr(10) || chr(10)
          || 'Say which of these hosts take part, which guests appear, and who each numbered'
          || ' speaker is.' || chr(10) || 'Answer with one JSON object of this form:' || chr(10)
          || '{"hosts": [{"name": "...", "confidence": 0.9, "mentioned_in": ["title"]}],'
          || ' "guests": [{"name": "...", "confidence": 0.8, "mentioned_in": ["description"]}]}'
          AS prompt
        FROM (SELECT * FROM catalogue WHERE transcript_filename IS NOT NULL) e JOIN hints h USING (video_id)
        LEFT JOIN (SELECT video_id, string_agg(speaker || ': ' || "text", chr(10) ORDER BY turn)
                AS conversation FROM talk GROUP BY video_id) t USING (video_id)""",
    "speaker_stats": "SELECT * FROM stats",
    "speaker_samples": """
        SELECT video_id, speaker, string_agg(transcript, '|' ORDER BY pos) AS samples
        FROM (SELECT * FROM utterances WHERE speaker IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY video_id, speaker ORDER BY pos) <= 10)
        GROUP BY video_id, speaker""",
    "speaker_count": """
        SELECT video_id, count(DISTINCT speaker) AS speaker_count FROM utterances
        GROUP BY video_id""",
    "transcript_stats": """
        SELECT video_id, count(*) AS transcript_utterances, max("end") AS transcript_duration
        FROM utterances GROUP BY video_id""",
    "document_stats": """
        SELECT video_id, len(ls) AS transcript_utterances,
          cast(len(ls) * 5 AS DOUBLE) AS transcript_duration
        FROM docs WHERE form = 'whole'""",
    "document_speakers": """
        SELECT video_id, speaker, count(*) AS utterance_count, min(pos) AS first_pos,
          'Speaker ' || speaker AS speaker_tag,
          array_to_string(list(transcript ORDER BY pos)[1:10], '|') AS samples
        FROM doc_utterances WHERE form = 'whole' AND speaker IS NOT NULL
        GROUP BY video_id, file_name, speaker""",
    "speaker_rank": "SELECT video_id, speaker, utterance_count, speaker_rank FROM ranked",
    "parse_speaker_response": """
        SELECT video_id,
          array_to_string(list_transform(hosts, lambda p: p.name || '='
            || coalesce(cast(p.confidence AS VARCHAR), '-')), '|') AS hosts,
          array_to_string(list_transform(guests, lambda p: p.name || '='
            || coalesce(cast(p.confidence AS VARCHAR), '-')), '|') AS guests
        FROM parsed""",
    "candidate_names": """
        SELECT * REPLACE (cast(name_rank AS INTEGER) AS name_rank) FROM candidates""",
    "assign_speakers": "SELECT * FROM assigned",
    "speaker_roles": """
        SELECT video_id, speaker, name, CASE WHEN is_unknown THEN 'UNKNOWN'
          WHEN is_guest THEN 'GUEST' ELSE 'HOST' END AS role
        FROM assigned""",
    "speakers_map": """
        SELECT video_id, string_agg(speaker || ':' || name || '/' || utterance_count, '|'
          ORDER BY cast(speaker AS VARCHAR)) AS speakers
        FROM assigned GROUP BY video_id""",
    "speakers_map_merge": """
        SELECT c.video_id, m.n AS speaker_count, m.speakers
        FROM catalogue c
        LEFT JOIN (SELECT video_id, count(*) AS n,
                     string_agg(speaker || ':' || name || '/' || utterance_count, '|'
                       ORDER BY cast(speaker AS VARCHAR)) AS speakers
                   FROM assigned GROUP BY video_id) m USING (video_id)""",
    "similar_vectors": """
        SELECT vec_id, round(list_cosine_similarity(cast(embedding AS DOUBLE[]), (
          SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 6) AS similarity
        FROM embeddings ORDER BY list_cosine_similarity(cast(embedding AS DOUBLE[]), (
          SELECT cast(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)) DESC, vec_id LIMIT 10""",
    "similar_vectors_many": """
        SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, round(near, 6) AS similarity
        FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(cast(q.embedding AS DOUBLE[]),
                cast(v.embedding AS DOUBLE[])) AS near,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY near DESC, v.vec_id) AS rank
              FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
        WHERE rank <= 10""",
    "search_ranked": """
        SELECT query_id, cast(rank AS INTEGER) AS rank, doc_id, score, hits
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
                CASE WHEN phrase THEN len(starts) ELSE n END AS hits FROM answered)
        WHERE rank <= 10""",
    "search_filtered": f"""
        SELECT query_id, cast(rank AS INTEGER) AS rank, doc_id, score, hits, {_marked('"text"', """
          CASE WHEN phrase THEN len(list_filter(starts, lambda p: p < i AND i <= p + len(qs))) > 0
          ELSE list_contains(qs, lower(v)) END""")} AS marked
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
                CASE WHEN phrase THEN len(starts) ELSE n END AS hits
              FROM answered
              WHERE speaker = 1 AND "type" = 'FULL' AND "day" BETWEEN '2024-01-01' AND '2024-01-03')
        WHERE rank <= 5""",
    "search_text": f"""
        SELECT doc_id, hits, {_marked('"text"', "lower(v) IN ('with', 'from')")} AS marked
        FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w)),
                lambda w: w IN ('with', 'from')) AS ws, len(ws) AS hits
              FROM documents WHERE lang = 'en')
        WHERE len(list_distinct(ws)) = 2""",
    "frequent_terms": "SELECT term, n FROM term_counts ORDER BY n DESC, term LIMIT 50",
    "topic_timeline": """
        SELECT strftime(published_at, '%Y-%m-%d') AS "day", term, count(*) AS n
        FROM (SELECT published_at, unnest(string_split_regex(lower(description), '[ \\n]+')) AS term
              FROM episodes)
        WHERE term IN (SELECT term FROM term_counts ORDER BY n DESC, term LIMIT 10)
        GROUP BY ALL""",
    "person_appearances": """
        SELECT name, count(DISTINCT video_id) AS recordings, count(*) AS utterances,
          min("start") AS first_start, max("end") AS last_end
        FROM utterances JOIN assigned USING (video_id, speaker) GROUP BY name""",
    "person_quotes": """
        SELECT name, video_id, cast(rank AS INTEGER) AS rank, "start", transcript
        FROM (SELECT *, row_number() OVER (PARTITION BY video_id, speaker
                ORDER BY length(transcript) DESC, pos) AS rank FROM utterances)
        JOIN assigned USING (video_id, speaker) WHERE rank <= 3""",
    "person_topics": """
        SELECT name, cast(rank AS INTEGER) AS rank, term, n, z
        FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY z DESC, term) AS rank FROM person_scores WHERE z > 0)
        WHERE rank <= 10""",
    "topic_bursts": """
        SELECT term, cast(min(t) AS INTEGER) AS first_day, cast(max(t) AS INTEGER) AS last_day,
          cast(sum(n) AS BIGINT) AS n, round(sum(gain), 6) AS strength
        FROM term_states WHERE state = 1 GROUP BY term, run""",
    "collocations": f"""
        SELECT "first", second, n, round(2 * (a * ln(a * s / (a1 * a2))
          + CASE WHEN b > 0 THEN b * ln(b * s / (a1 * (s - a2))) ELSE 0 END
          + CASE WHEN c > 0 THEN c * ln(c * s / ((s - a1) * a2)) ELSE 0 END
          + CASE WHEN d > 0 THEN d * ln(d * s / ((s - a1) * (s - a2))) ELSE 0 END), 4) AS score
        FROM pair_table
        WHERE n >= 5 AND a * s > a1 * a2 AND "first" NOT IN {_STOP_WORDS} AND second NOT IN {_STOP_WORDS}
        ORDER BY score DESC, "first", second LIMIT 50""",
    "corrections": """
        SELECT typed, cast(rank AS INTEGER) AS rank, term, n, cast(edits AS INTEGER) AS edits
        FROM (SELECT *, CASE WHEN typed = term THEN 0 ELSE 1 END AS edits,
                row_number() OVER (PARTITION BY typed ORDER BY edits, n DESC, term) AS rank
              FROM typed_terms JOIN term_counts ON abs(length(typed) - length(term)) <= 1
              WHERE CASE length(typed) - length(term)
                WHEN 0 THEN len(list_filter(range(1, length(term) + 1),
                  lambda i: substr(typed, i::INT, 1) <> substr(term, i::INT, 1))) <= 1
                WHEN 1 THEN list_contains(list_transform(range(1, length(typed) + 1),
                  lambda i: left(typed, i::INT - 1) || substr(typed, i::INT + 1)), term)
                ELSE list_contains(list_transform(range(1, length(term) + 1),
                  lambda i: left(term, i::INT - 1) || substr(term, i::INT + 1)), typed) END)
        WHERE rank <= 5""",
    "completions": """
        SELECT prefix, cast(rank AS INTEGER) AS rank, term, n
        FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY n DESC, term) AS rank
              FROM (SELECT left(term, size) AS prefix, term, n
                    FROM (SELECT *, unnest(range(1, least(length(term), 4) + 1)) AS size FROM term_counts)))
        WHERE rank <= 5""",
    "usage_by_day": """
        SELECT strftime(ts, '%Y-%m-%d') AS "day", event_type, count(*) AS events,
          count(DISTINCT user_id) AS users
        FROM events GROUP BY ALL""",
    "users_by_month": """
        SELECT strftime(ts, '%Y-%m') AS period, event_type, count(*) AS events, count(DISTINCT user_id) AS users
        FROM events GROUP BY ALL""",
    "session_funnel": """
        SELECT strftime(begun, '%Y-%m-%d') AS "day", count(*) AS sessions, cast(sum(n) AS BIGINT) AS events,
          count(*) FILTER (reached >= 1) AS step_1, count(*) FILTER (reached >= 2) AS step_2,
          count(*) FILTER (reached >= 3) AS step_3
        FROM (SELECT min(ts) AS begun, count(*) AS n, list_reduce(list_prepend(0, list(step ORDER BY ts, event_id)),
                lambda s, e: CASE WHEN e = s + 1 THEN e ELSE s END) AS reached
              FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session
                    FROM (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                            ELSE 0 END AS step, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                            + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events))
              GROUP BY user_id, session)
        GROUP BY ALL""",
    "stream_landing": "SELECT * FROM doc_chunked",
    "stream_rejects": """
        SELECT file_name, CASE form WHEN 'broken' THEN 'not JSON' WHEN 'bare' THEN 'no episode metadata'
            ELSE 'unreadable date' END AS reason
        FROM docs WHERE form <> 'whole'""",
    "stream_type_changes": """
        SELECT strftime(CASE WHEN cast(video_id AS BIGINT) % 8 = 5 THEN published_at + INTERVAL 1 DAY ELSE published_at END,
            '%Y-%m-%d') AS "day",
          CASE WHEN cast(video_id AS BIGINT) % 8 = 5 THEN 'SHORT' ELSE "type" END AS "type", count(*) AS episodes
        FROM typed GROUP BY ALL""",
    "stream_chunks": "SELECT * FROM doc_chunked",
    "stream_upsert": "SELECT * FROM upserted",
    "stream_type_counts": """
        SELECT strftime(published_at, '%Y-%m-%d') AS "day", "type", count(*) AS episodes
        FROM typed GROUP BY ALL""",
}

ORACLE: dict[str, str] = {name: _sql(body) for name, body in _BODIES.items()}
