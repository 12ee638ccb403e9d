"""Inputs in the shapes the operators read, derived from the given tables.

Each is one SQL text that runs unchanged on Spark and on the checking engine.
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES = {}

FIXTURES["fx_phrases"] = """
select * from (values
 (0,'Nova, set a timer for 7 minutes','assistant_directed','timer.set',420),
 (1,'set a timer','assistant_directed','open_request',null),
 (2,'could you start a countdown of an hour and a half please','assistant_directed','timer.set',5400),
 (3,'timer for half an hour','assistant_directed','timer.set',1800),
 (4,'timer for two and a half minutes','assistant_directed','timer.set',150),
 (5,'set a timer for three quarters of an hour','assistant_directed','timer.set',2700),
 (6,'set a timer for twenty five minutes','assistant_directed','timer.set',1500),
 (7,'kill the timer','assistant_directed','timer.cancel',null),
 (8,'what time is it?','assistant_directed','time.now',null),
 (9,'stop','assistant_directed','stop',null),
 (10,'he said I should stop','human_directed',null,null),
 (11,'turn it up','assistant_directed','volume.up',null),
 (12,'a bit quieter','assistant_directed','volume.down',null),
 (13,'pause the music','assistant_directed','media.pause',null),
 (14,'keep playing','assistant_directed','media.resume',null),
 (15,'say that again','assistant_directed','repeat',null),
 (16,'yes please','assistant_directed','confirm.yes',null),
 (17,'no thanks','assistant_directed','confirm.no',null),
 (18,'forget it','assistant_directed','cancel',null),
 (19,'how far is the sun from here?','assistant_directed','open_request',null),
 (20,'is Nova any good, do you think','human_directed',null,null),
 (21,'hey Nova','assistant_directed','open_request',null),
 (22,'can you pass me that cup','human_directed',null,null),
 (23,'remind me to grab the bag','assistant_directed','open_request',null),
 (24,'hold on a second','human_directed',null,null),
 (25,'yeah','human_directed',null,null),
 (26,'mate, did you see the match','human_directed',null,null),
 (27,'let''s go to the beach, shall we','human_directed',null,null),
 (28,'she told me it was closed','human_directed',null,null),
 (29,'the assistant never listens','human_directed',null,null),
 (30,'where did I leave my coat','human_directed',null,null),
 (31,'we should eat soon. what is the capital of Peru?','human_directed',null,null),
 (32,'make it ten instead','assistant_directed','open_request',null),
 (33,'scroll down','assistant_directed','open_request',null),
 (34,'scroll down when you get there','human_directed',null,null),
 (35,'tell me more','assistant_directed','open_request',null),
 (36,'go on then, what time is it','assistant_directed','time.now',null),
 (37,'and now the weather for the coast','background_or_media',null,null),
 (38,'','background_or_media',null,null),
 (39,'convert twelve miles to kilometers','assistant_directed','open_request',null)
) as t(i, text, g_addressed, g_intent, g_seconds)
"""

FIXTURES["fx_utterances"] = """
select e.event_id as utt_id, e.user_id as conv_id, e.ts, p.text, p.g_addressed, p.g_intent,
       p.g_seconds, e.event_id % 9 <> 0 as reliable,
       case when e.event_id % 4 = 0 then null else (e.event_id * 13 % 100) / 100.0 end as own_voice,
       case when e.event_id % 3 = 0 then (e.event_id % 10) / 9.0 end as llm_score
from events e join @fx_phrases p on p.i = (e.event_id * 7 + e.user_id) % 40
"""

FIXTURES["fx_texts"] = """
select (conv_id * 1000 + turn) * 2 as utt_id, text, turn % 5 <> 3 as reliable,
       case when turn % 4 = 1 then (conv_id % 10) / 10.0 end as own_voice, cast(null as double) as llm_score
from conversations
union all
select doc_id * 2 + 1, text, true, cast(null as double), (doc_id % 10) / 9.0 from documents
"""

FIXTURES["fx_turn_log"] = """
select concat('t', cast(event_id as string)) as turn, ts, 1 as ord, 'gate_scored' as event,
       value < 60 as would_skip, value / 10 as latency_ms,
       case when event_id % 5 = 0 then 0.0 else value / 20 end as feature_ms,
       cast(null as string) as reason
from events
union all
select concat('t', cast(event_id as string)), ts, 2,
       case event_type when 'purchase' then 'intent_accepted' when 'click' then 'intent_ignored'
                       when 'view' then 'intent_ignored' when 'error' then 'transcript_rejected'
                       else 'segment_dropped' end,
       cast(null as boolean), cast(null as double), cast(null as double),
       case when event_type = 'signup' then case when event_id % 2 = 0 then 'gate' else 'not_own_voice' end end
from events where event_id % 11 <> 0
union all
select concat('t', cast(event_id as string)), ts, 3, 'intent_accepted', cast(null as boolean),
       cast(null as double), cast(null as double), cast(null as string)
from events where event_type = 'error' and event_id % 7 = 0
"""

FIXTURES["fx_turns"] = """
select turn, max(would_skip) as would_skip, max(latency_ms) as latency_ms,
       max(feature_ms) as feature_ms,
       coalesce(max(case when event = 'intent_accepted' then 'accepted'
                         when event = 'intent_ignored' then 'ignored'
                         when event = 'segment_dropped' and reason = 'gate' then 'skipped' end),
                max(case when event = 'transcript_rejected' then 'no_transcript' end),
                'unknown') as verdict
from @fx_turn_log group by turn
"""

FIXTURES["fx_decision_log"] = """
select event_id as turn,
       case event_id % 3 when 0 then 'act' when 1 then 'ignore' else 'escalate' end as fast_route,
       concat('i', cast(event_id % 5 as string)) as fast_intent, event_id % 4 as fast_slot,
       value as fast_ms,
       case when event_id % 8 = 0 then null when user_id % 2 = 0 then 'act' else 'ignore' end as slow_route,
       concat('i', cast(user_id % 5 as string)) as slow_intent, user_id % 4 as slow_slot
from events
"""

FIXTURES["fx_gate_rows"] = """
select event_id as row_id,
       case when event_id % 20 < 6 then 'assistant_directed' when event_id % 20 < 13 then 'human_directed'
            when event_id % 20 < 19 then 'background_or_media' else 'uncertain' end as label,
       case event_id % 6 when 0 then 'ami' when 1 then 'common_voice' when 2 then 'custom' when 3 then 'consented'
                         when 4 then 'shadow_log' else 'podcast' end as source,
       case event_id % 6 when 0 then 'CC-BY-4.0' when 1 then 'CC0-1.0'
                         when 2 then case when user_id % 2 = 0 then 'MIT' else 'CC-BY-NC-4.0' end
                         when 3 then 'consent' else 'none' end as license,
       case when event_id % 6 = 3 then case user_id % 3 when 0 then 'release' when 1 then 'internal' else '' end
            else '' end as consent,
       concat('s', cast(event_id % 60 as string)) as speaker,
       concat('x', cast(cast(floor((event_id % 60) / 3) as bigint) as string)) as session,
       '' as room, concat('m', cast(event_id % 3 as string)) as mic,
       0.4 + (value * 7.0) % 12.0 as seconds, cast(60 + event_id % 41 as double) / 100 as confidence,
       (value * 3.0) % 90.0 as since_ai, event_id % 10 = 0 as awaiting_answer,
       event_id % 97 = 0 as confirming,
       event_id % 4 <> 0 as voice_confident, event_id % 12 = 1 as is_wearer,
       event_id % 5 as ignored_run
from events
"""

# Stored feature rows: the same segments as the 20 numbers a feature table holds.
FIXTURES["fx_feature_rows"] = """
select row_id, label, source, license, consent, speaker, session, room, mic,
       cast(100 + row_id % 120 as double) as f0_mean, cast(5 + row_id % 30 as double) as f0_std,
       cast((row_id % 11 - 5) / 50.0 as double) as f0_slope,
       cast(case when row_id % 37 = 0 then 0 else 0.3 + (row_id % 50) / 100.0 end as double) as voiced_ratio,
       cast(1200 + row_id % 600 as double) as spectral_centroid,
       cast(2500 + row_id % 900 as double) as spectral_rolloff,
       cast(4 + (row_id % 10) / 10.0 as double) as spectral_tilt_log,
       cast(0.05 + (row_id % 25) / 100.0 as double) as zcr,
       cast((row_id % 8) / 10.0 as double) as pause_before,
       cast(case when label = 'assistant_directed' then 1.0 + seconds / 6.0 else seconds end as double) as duration,
       cast(confidence as double) as vad_confidence,
       cast(case when voice_confident then (row_id % 100) / 100.0 else 0.5 end as double) as p_own,
       cast(case when voice_confident then 1 else 0 end as double) as voice_confident,
       cast(case when not voice_confident then 0.5 when is_wearer then 1 else 0 end as double) as is_wearer,
       ln(1.0 + since_ai) as since_ai_log,
       cast(ignored_run as double) as ignored_run,
       cast(case when ignored_run = 0 and row_id % 2 = 0 then 1 else 0 end as double) as accepted_recently,
       cast(case when awaiting_answer then 1 else 0 end as double) as awaiting_answer,
       cast(case when confirming then 1 else 0 end as double) as confirming,
       cast(0 as double) as offer_pending,
       cast((row_id % 70) / 10.0 as double) as feature_ms
from @fx_gate_rows
"""

FIXTURES["fx_bench"] = """
select concat('sys_', l_returnflag) as system, l_orderkey * 10 + l_linenumber as id,
       concat('cat', cast(l_partkey % 5 as string)) as category,
       case when l_suppkey % 3 = 0 then 'assistant_directed' else 'human_directed' end as gold_addressed,
       case when l_suppkey % 3 = 0 then concat('i', cast(l_partkey % 4 as string)) end as gold_intent,
       case when l_quantity > 25 then 'act' else 'ignore' end as decision,
       concat('i', cast(l_orderkey % 4 as string)) as intent,
       l_linestatus = 'F' as stt_called, l_extendedprice / 100 as ms
from lineitem
"""

FIXTURES["fx_context"] = """
select conv_id, turn, role,
       case when (conv_id + turn) % 4 = 0 then concat(text, '?') else text end as text,
       conv_id * 1000.0 + turn * 14.0 + (conv_id * turn) % 9 as at_s,
       case (conv_id + 2 * turn) % 5 when 0 then true when 1 then false when 2 then false end as ai_directed,
       (conv_id + turn) % 6 <> 0 as reliable
from conversations
"""

FIXTURES["fx_frames"] = """
select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx,
       ts, value / 1000 as rms,
       case when event_type in ('click', 'purchase') then 0.55 + (event_id % 40) / 100.0
            else (event_id % 45) / 100.0 end as prob
from events
"""

FIXTURES["fx_clips"] = """
select vec_id, concat('c', cast(vec_id as string)) as id, label,
       concat('s', cast(vec_id % 15 as string)) as speaker,
       case when label < 4 then 'assistant_directed' when label < 7 then 'human_directed'
            else 'background_or_media' end as g_addressed,
       case when label < 4 then
            case vec_id % 13 when 0 then 'stop' when 1 then 'cancel' when 2 then 'confirm.yes'
              when 3 then 'confirm.no' when 4 then 'repeat' when 5 then 'volume.up'
              when 6 then 'volume.down' when 7 then 'media.pause' when 8 then 'media.resume'
              when 9 then 'time.now' when 10 then 'timer.set' when 11 then 'timer.cancel'
              else 'open_request' end end as g_intent,
       case when label < 4 and vec_id % 13 = 10 then 60 * (1 + vec_id % 15) end as g_duration,
       case vec_id % 4 when 0 then 'noise' when 1 then 'ami' when 2 then 'speech_commands'
            else 'synthetic_say' end as source,
       case vec_id % 4 when 0 then 'CC0-1.0' when 3 then 'Apple-SLA-personal'
            else 'CC-BY-4.0' end as license,
       concat('cat', cast(vec_id % 3 as string)) as category,
       20.0 + vec_id % 50 as stt_ms, 5.0 + (vec_id % 17) / 4.0 as encode_ms
from embeddings
"""
