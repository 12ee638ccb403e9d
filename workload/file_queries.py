"""File round trips: tables written in the formats the library reads, read back, and compared."""

import uuid

from pyspark.sql import functions as F

from whofor.operators import teacher as K
from whofor.plans import student_training as ST
from whofor.session import ensure_checkpoint_dir
from whofor.sources import events as EV
from whofor.sources import manifests as M
from whofor.sources import sessions as SE
from workload.registry import fixture, query, run_sql
from workload.text_queries import ENGINE, LABEL_CTES, PARSED


def folder(spark, name: str) -> str:
    """A new folder under the one all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("manifest_round_trip", """
select id, round(vec_id / 8.0::double, 4) as start, 'said "' || vec_id || '"' as text, g_addressed, g_intent, g_duration::varchar as duration,
  case when vec_id % 7 = 0 then '/data/' || id || '.wav' else 'clips/' || id || '.wav' end as tail, vec_id % 7 <> 0 as resolved,
  case when vec_id % 5 = 0 then 2 end::bigint as babble, case when vec_id % 5 = 0 then '/noise/b.wav' end as second
from @fx_clips""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_clips").select(
        "id", F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("/data/"), "id", F.lit(".wav")))
        .otherwise(F.concat(F.lit("clips/"), "id", F.lit(".wav"))).alias("path"),
        (F.col("vec_id") / F.lit(8.0)).alias("start"), F.format_string('said "%d"', "vec_id").alias("text"), "g_addressed", "g_intent",
        F.when(F.col("g_duration").isNotNull(), F.create_map(F.lit("duration"), F.col("g_duration").cast("string"))).alias("g_slots"),
        F.when(F.col("vec_id") % 5 == 0, F.struct(F.col("vec_id").alias("seed"), F.array(
            F.lit("noise/a.wav"), F.lit("/noise/b.wav")).alias("babble"))).alias("augment"))
    path = folder(spark, "manifest")
    M.write_manifest(d, path)
    r = M.absolute_paths(M.read_manifest(spark, path))
    tail = F.regexp_extract("path", r"(/data/|clips/)[^/]*$", 0)
    return r.select("id", F.round("start", 4).alias("start"), "text", "g_addressed", "g_intent",
                    F.try_element_at("g_slots", F.lit("duration")).alias("duration"), tail.alias("tail"),
                    (F.col("path") != tail).alias("resolved"), F.when(F.col("augment").isNotNull(), F.size("augment.babble"))
                    .cast("long").alias("babble"), F.get("augment.babble", F.lit(1)).alias("second"))


@query("feature_table_round_trip", """
select label, source, speaker, count(*) as rows, round(sum(f0_mean), 3) as f0, round(sum(since_ai_log), 4) as since, round(sum(p_own), 4) as own,
  round(sum(voiced_ratio), 4) as voiced from @fx_feature_rows group by all""")
def _(spark, sf):
    path = folder(spark, "features")
    M.write_feature_rows(fixture(spark, sf, "fx_feature_rows"), path)
    return M.read_feature_rows(spark, path).groupBy("label", "source", "speaker").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("f0_mean"), 3).alias("f0"), F.round(F.sum("since_ai_log"), 4).alias("since"),
        F.round(F.sum("p_own"), 4).alias("own"), F.round(F.sum("voiced_ratio"), 4).alias("voiced"))


@query("event_log_round_trip", """
select turn, event, round(epoch_us(ts) / 1e6::double, 3) as t, ord::double as mono, reason, would_skip, round(latency_ms, 4) as latency_ms, round(feature_ms, 4) as feature_ms
from @fx_turn_log""")
def _(spark, sf):
    d = run_sql(spark, sf, """select cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 as t, cast(ord as double) as mono, 'gate' as stage,
      event, turn, reason, would_skip, cast(latency_ms as double) as latency_ms, cast(feature_ms as double) as feature_ms from @fx_turn_log""")
    path = folder(spark, "log")
    EV.write_event_log(d, path, ["reason", "would_skip", "latency_ms", "feature_ms"])
    return EV.read_event_log(spark, path).select(
        "turn", "event", F.round("t", 3).alias("t"), "mono", "reason", "would_skip",
        F.round(EV.gate_latency(), 4).alias("latency_ms"), F.round("feature_ms", 4).alias("feature_ms"))


@query("session_round_trip", """
select id, round(embedding[1]::double, 5) as first, 5.0::double as encode_ms, (select count(*) from embeddings) as session_rows, 2::bigint as encoders
from (select concat('c', vec_id::varchar) as id, embedding from embeddings where vec_id % 2 = 0)""")
def _(spark, sf):
    rows = fixture(spark, sf, "fx_clips").select("id", "g_addressed", "speaker")
    vectors = run_sql(spark, sf, """select concat('c', cast(vec_id as string)) as id, embedding as vector, 5.0D as encode_ms,
      case when vec_id % 2 = 0 then 'slice:64' else 'other/x@2' end as spec from embeddings""")
    path = folder(spark, "session")
    SE.write_session(rows, vectors, {"session": "s1", "consent": "internal"}, path)
    loaded = SE.load_vectors(spark, [f"{path}/vectors"], "slice:64")
    meta = SE.list_sessions(SE.read_metadata(spark, f"{path}/session/*"))
    back = M.read_manifest(spark, f"{path}/manifest").select("id").join(loaded, "id")
    return back.select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"), "encode_ms",
                       meta.select(F.max("rows")).scalar().alias("session_rows"),
                       meta.select(F.max(F.size("encoders"))).scalar().cast("long").alias("encoders"))


@query("labelled_clips", f"""
with {LABEL_CTES}, {PARSED}, l as (select u5.utt_id, reliable, case when named then 1.0 else heuristic end as c, trim(text) = '' as silent from u5)
select l.utt_id, c >= 0.62 and not silent as t_accept, round(case when silent then 0.0 else c end, 4) as t_confidence,
  case when not silent then n2.intent end as t_intent, (l.utt_id % 40)::double as stt_ms from l join n2 using (utt_id) where l.utt_id % 6 <> 0""")
def _(spark, sf):
    """Clips heard by a batch function that leaves some out, then labelled."""
    clips = fixture(spark, sf, "fx_utterances").select(
        "utt_id", F.col("utt_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("reliable").alias("pcm"))

    def transcribe(batches):
        for pdf in batches:
            pdf = pdf[pdf["utt_id"] % 6 != 0]
            yield pdf.assign(transcript=pdf["content"], reliable=pdf["pcm"], tail_reliable=pdf["pcm"],
                             stt_ms=(pdf["utt_id"] % 40).astype(float))[
                ["id", "transcript", "reliable", "tail_reliable", "stt_ms"]]
    return K.label(clips, transcribe, settings=ENGINE).select(
        "utt_id", "t_accept", F.round("t_confidence", 4).alias("t_confidence"), "t_intent", "stt_ms")


@query("swept_students")
def _(spark, sf):
    """A sweep over two kinds of targets; fitted, so no SQL."""
    from workload.model_queries import clips
    v = run_sql(spark, sf, "select concat('c', cast(vec_id as string)) as id, embedding as vector, 5.0D as encode_ms, 0 as seq, 'slice:64' as spec from embeddings")
    cfg = ST.StudentTraining(max_iter=10, allow_internal=True, max_false_ignore=0.2, max_wrong_act=0.5, max_false_activation=0.3)
    return ST.sweep(clips(spark, sf).drop("vector", "encode_ms"), {"slice:64": v}, ("gold", "mix"), (cfg.seed,), cfg)
