"""Head, router, report, speaker, frame and clip queries."""

import numpy as np
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import wilson_upper
from whofor.operators import clips as D
from whofor.operators import frames as E
from whofor.operators import heads as H
from whofor.operators import metrics as Q
from whofor.operators import router as P
from whofor.operators import shadow as R
from whofor.operators import speakers as SP
from whofor.operators.catalogue import CORE
from whofor.operators.quantiles import quantiles
from whofor.plans import student_training as ST
from whofor.sources import corpora as CP
from whofor.sources import sessions as SS
from workload.registry import fixture, query, run_sql
from workload.gate_queries import wilson

DIM = 64
ROUTES = P.Thresholds(ignore_below=0.25, act_addressed=0.4, act_intent=0.15, act_slot=0.08)
DURATIONS = "[" + ", ".join(str(d) for d in V.TIMER_DURATIONS) + "]"
NAMES = "[" + ", ".join(f"'{n}'" for n in CORE.names) + "]"


def slice_model() -> H.HeadsModel:
    """Heads that read fixed slices of the vector: softmax(10 x)."""
    def head(first, k):
        w = np.zeros((DIM, k))
        w[first:first + k, :] = np.eye(k) * 10.0
        return w, np.zeros(k)
    names = H.head_names(CORE)
    return H.HeadsModel(np.zeros(DIM), np.ones(DIM), {
        "addressed": head(0, 3), "intent": head(3, 13), "timer.set:duration": head(16, 23)},
        names, encoder="slice:64", thresholds=ROUTES)


def clips(spark, sf):
    """Labelled clips with teacher columns (gold flipped for one in seven) and a vector."""
    d = fixture(spark, sf, "fx_clips").join(
        run_sql(spark, sf, "select vec_id, embedding as vector from embeddings"), "vec_id")
    flip = F.col("vec_id") % 7 == 0
    assist = F.col("g_addressed") == V.ASSISTANT
    t_who = F.when(flip & assist, V.HUMAN).when(flip, V.ASSISTANT).otherwise(F.col("g_addressed"))
    slots = F.when(F.col("g_duration").isNotNull(), F.create_map(
        F.lit("duration"), F.col("g_duration").cast("string"))) \
        .otherwise(F.create_map().cast("map<string,string>"))
    probs = F.map_from_arrays(F.array(*[F.lit(a) for a in V.ADDRESSEES]), F.array(*[
        F.when(t_who == a, 0.9).otherwise(0.05) for a in V.ADDRESSEES]))
    return d.withColumns({
        "g_slots": slots, "t_addressed": probs, "t_accept": t_who == V.ASSISTANT,
        "t_intent": F.coalesce("g_intent", F.lit(V.OPEN_REQUEST)), "t_intent_p": F.lit(1.0),
        "t_slots": slots, "t_intent_probs": F.lit(None).cast("map<string,double>"),
        "consent": F.lit(""), "stt_ms": F.col("stt_ms").cast("double"),
        "encode_ms": F.col("encode_ms").cast("double")})


def scored(spark, sf):
    return H.score_heads(clips(spark, sf), slice_model())


def routed(spark, sf):
    return P.route(scored(spark, sf), ROUTES)


def judged(spark, sf):
    return Q.judged(routed(spark, sf))


SCORED = f"""v as (select vec_id, list_transform(embedding[1:3], lambda x: exp(10.0 * x::double)) as ea,
   list_transform(embedding[4:16], lambda x: exp(10.0 * x::double)) as ei,
   list_transform(embedding[17:39], lambda x: exp(10.0 * x::double)) as es from embeddings),
 h as (select vec_id, list_transform(ea, lambda x: x / list_sum(ea)) as a, list_transform(ei, lambda x: x / list_sum(ei)) as i,
   list_transform(es, lambda x: x / list_sum(es)) as s from v),
 t as (select c.*, a, i, s, a[1] as p_assistant, list_position(a, list_max(a)) as ka, list_max(a) as p_who,
   list_position(i, list_max(i)) as ki, list_max(i) as p_intent, list_position(s, list_max(s)) as ks, list_max(s) as p_slot
   from h join @fx_clips c using (vec_id)),
 r as (select *, ['assistant_directed', 'human_directed', 'background_or_media'][ka] as who, {NAMES}[ki] as intent,
   case when ki = 11 then coalesce({DURATIONS}[ks]::varchar, '__other__') end as slot,
   case when p_assistant < 0.25 then 'ignore' when p_assistant < 0.4 or ki = 13 or p_intent < 0.15 or ki in (3, 4, 12)
     or (ki = 11 and (ks = 23 or p_slot < 0.08)) then 'escalate' else 'act' end as route from t),
 j as (select *, g_addressed = 'assistant_directed' as assist, vec_id % 7 = 0 as flip,
   route = 'act' and g_addressed = 'assistant_directed' and intent = g_intent and (slot is null or slot = g_duration::varchar) as act_ok,
   (g_addressed = 'assistant_directed') <> (vec_id % 7 = 0) as t_accept, coalesce(g_intent, 'open_request') as t_intent from r)"""


# -- heads --------------------------------------------------------------------------------------

@query("scored_heads", f"""
with {SCORED} select vec_id, round(p_assistant, 4) as p_assistant, intent, round(p_intent, 4) as p_intent, round(p_slot, 4) as p_slot from r""")
def _(spark, sf):
    d = P.tops(scored(spark, sf))
    return d.select("vec_id", F.round("p_assistant", 4).alias("p_assistant"), "intent",
                    F.round("p_intent", 4).alias("p_intent"), F.round(F.array_max(F.map_values(
                        F.col("slot_probs")["timer.set:duration"])), 4).alias("p_slot"))


@query("joined_vectors", """
select c.vec_id, round(coalesce(n.embedding[1], e.embedding[1])::double, 5) as first, n.vec_id is not null as replaced from @fx_clips c join embeddings e on e.vec_id = c.vec_id
left join embeddings n on c.vec_id % 3 = 0 and n.vec_id = c.vec_id + 1""")
def _(spark, sf):
    rows = fixture(spark, sf, "fx_clips").select("vec_id", "id")
    v = run_sql(spark, sf, """select concat('c', cast(vec_id as string)) as id, embedding as vector, 1.0D as encode_ms, 1 as seq from embeddings
      union all select concat('c', cast(vec_id - 1 as string)), embedding, 2.0D, 2 from embeddings where (vec_id - 1) % 3 = 0""")
    d = H.join_vectors(rows, v)
    return d.select("vec_id", F.round(F.get("vector", F.lit(0)).cast("double"), 5).alias("first"),
                    (F.col("encode_ms") == 2.0).alias("replaced"))


@query("training_targets", f"""
with c as (select *, (g_addressed = 'assistant_directed') <> (vec_id % 7 = 0) as t_accept from @fx_clips),
p as (select *, 0.5::double * case when g_addressed = 'assistant_directed' then 1.0 else 0.0 end + 0.5::double * case when t_accept then 0.9 else 0.05 end as p_assistant from c)
select vec_id, round(p_assistant, 4) as p_assistant,
  case when round(p_assistant, 6) >= 0.5 then case when g_intent is not null then g_intent else 'open_request' end end as intent,
  case when round(p_assistant, 6) >= 0.5 and g_intent = 'timer.set' then list_contains({DURATIONS}, g_duration) end as on_list from p""")
def _(spark, sf):
    d = H.build_targets(clips(spark, sf), mode="mix")
    top = F.array_position("y_intent", F.array_max("y_intent")).cast("int")
    y = F.col("y_timer_set__duration")
    return d.select("vec_id", F.round(F.get("y_addressed", F.lit(0)), 4).alias("p_assistant"),
                    F.get(F.array(*[F.lit(n) for n in CORE.names]), top - 1).alias("intent"),
                    F.when(y.isNotNull(), F.element_at(y, -1) == 0.0).alias("on_list"))


GRID = "[" + ", ".join(repr(t) for t in H.TEMPERATURES) + "]::double[]"


@query("head_temperature", f"""
with {SCORED}, g as (select unnest({GRID}) as temp, unnest(range(0, 61)) as k),
z as (select list_transform(embedding[1:3], lambda x: 10.0 * x::double) as z, case when label < 4 then 1 when label < 7 then 2 else 3 end as y from embeddings),
l as (select k, temp, -ln(exp(z[y] / temp) / list_sum(list_transform(z, lambda x: exp(x / temp))) + 1e-9) as loss from z, g),
m as (select k, temp, avg(loss) as loss from l group by k, temp)
select round(arg_min(temp, (loss, k)), 4) as temperature from m""")
def _(spark, sf):
    d = clips(spark, sf).select(
        F.transform(F.slice("vector", 1, 3), lambda x: x.cast("double") * 10.0).alias("z"),
        F.array(*[F.when(F.col("g_addressed") == a, 1.0).otherwise(0.0) for a in V.ADDRESSEES]).alias("y"))
    return H.calibrate_temperature(d, "z", "y")


ECE = """select round(sum(n * abs(conf - acc)) / sum(n), 4) as ece from (
  select least(greatest(ceil({p} * 10) - 1, 0), 9) as b, count(*) as n, avg({p}) as conf, avg({ok}::int) as acc from {src} group by b)"""


@query("calibration_error", f"""with {SCORED} {ECE.format(p='p_who', ok='(who = g_addressed)', src='r')}""")
def _(spark, sf):
    return Q.expected_calibration_error(judged(spark, sf), F.col("p_who"), F.col("addr_ok")) \
        .select(F.round("ece", 4).alias("ece"))


@query("fitted_heads")
def _(spark, sf):
    d = H.build_targets(clips(spark, sf), mode="gold")
    m = H.fit_heads(d, max_iter=25)
    s = P.tops(H.score_heads(d, m))
    return s.groupBy((F.col("who") == F.col("g_addressed")).alias("right")).agg(F.count(F.lit(1)).alias("n"))


@query("trained_student")
def _(spark, sf):
    v = run_sql(spark, sf, "select concat('c', cast(vec_id as string)) as id, embedding as vector, 5.0D as encode_ms, 0 as seq, 'slice:64' as spec from embeddings")
    rows = clips(spark, sf).drop("vector", "encode_ms")
    cfg = ST.StudentTraining(targets="gold", max_iter=15, allow_internal=True, max_false_ignore=0.2,
                             max_wrong_act=0.5, max_false_activation=0.3)
    return ST.train_student(rows, v, cfg).report


# -- the router --------------------------------------------------------------------------------------

@query("routed_clips", f"with {SCORED} select vec_id, route, who, case when ki = 11 then slot end as slot from r")
def _(spark, sf):
    return routed(spark, sf).select("vec_id", "route", "who", F.try_element_at("slots", F.lit("duration"))["value"].alias("slot"))


@query("route_reasons", f"""
with {SCORED} select case when route = 'ignore' then 'low' when p_assistant < 0.4 then 'p(assistant)' when ki = 13 then 'open_request needs the words'
  when p_intent < 0.15 then 'p(intent)' when ki in (3, 4) then intent || ' only applies when awaiting_answer' when ki = 12 then 'timer.cancel only applies when timer_running'
  when ki = 11 and ks = 23 then 'duration is not one of the typed values' when ki = 11 and p_slot < 0.08 then 'p(slot)' else 'confident and complete' end as reason, count(*) as n
from r group by 1""")
def _(spark, sf):
    r = F.col("reason")
    short = F.when(F.col("route") == "ignore", "low").when(r.startswith("p(assistant)"), "p(assistant)") \
        .when(r.startswith("p(duration"), "p(slot)").when(r.startswith("p("), "p(intent)").otherwise(r)
    return routed(spark, sf).groupBy(short.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("routed_in_context", f"""
with {SCORED} select vec_id, case when p_assistant < 0.25 and vec_id % 4 = 0 then 'escalate' when p_assistant < 0.25 then 'ignore'
  when p_assistant < 0.4 or ki = 13 or p_intent < 0.15 or (ki in (3, 4) and vec_id % 4 <> 0) or (ki = 12 and vec_id % 3 <> 0)
   or (ki = 11 and (ks = 23 or p_slot < 0.08)) then 'escalate' else 'act' end as route from t""")
def _(spark, sf):
    state = P.StateColumns(awaiting_answer=F.col("vec_id") % 4 == 0, active=F.when(
        F.col("vec_id") % 3 == 0, F.array(F.lit("timer_running"))).otherwise(F.array().cast("array<string>")))
    return P.route(scored(spark, sf), ROUTES, CORE, state).select("vec_id", "route")


@query("ignore_vetoes", """
select event_id, case when event_id % 97 = 0 then 'a confirmation is open' when event_id % 31 = 0 then 'an offer is waiting for an answer'
  when event_id % 10 = 0 then 'the assistant asked a question' when (value * 3.0) % 90.0 < 20 then 'inside the follow-up window' end as veto from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, (value * 3.0) % 90.0 as since from events")
    e = F.col("event_id")
    return d.select("event_id", P.ignore_veto(P.StateColumns(
        F.col("since"), e % 10 == 0, e % 97 == 0, e % 31 == 0)).alias("veto"))


@query("tightened_thresholds", """
select event_id, case when event_id % 5 <> 0 then least((event_id % 90) / 100.0, (event_id % 70) / 100.0) end::double as ignore_below,
  case when event_id % 5 <> 0 then greatest((event_id % 90) / 100.0, (event_id % 70) / 100.0) end::double as act_intent,
  greatest(0.5, case when event_id % 3 = 0 then 0.9 end, case when event_id % 2 = 0 then 0.7 end)::double as needed from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, cast(event_id % 90 as double) / 100 as a, cast(event_id % 70 as double) / 100 as b from events")
    m = F.when(F.col("event_id") % 5 != 0, F.col("a"))
    cat = CORE.extended(type(CORE).of([{"name": "stop", "min_confidence": 0.9}]))
    who = F.when(F.col("event_id") % 6 == 0, "both").when(F.col("event_id") % 3 == 0, "stop") \
        .when(F.col("event_id") % 2 == 0, "cancel").otherwise("repeat")
    need = P.intent_threshold(F.when(who == "both", "stop").otherwise(who),
                              P.Thresholds(act_intent=0.5, per_intent={"cancel": 0.7}), cat)
    return d.select("event_id", P.tighten(m, F.col("b"), False).alias("ignore_below"),
                    P.tighten(m, F.col("b"), True).alias("act_intent"), need.alias("needed"))


@query("decision_problems", """
select event_id, case event_id % 6 when 0 then '' when 1 then 'unknown route' when 2 then 'an act decision needs an intent'
  when 3 then 'missing required slot duration' when 4 then 'the intent needs a transcript; it cannot be acted on' else 'unknown addressee,addressed: p must be a probability' end as problems from events""")
def _(spark, sf):
    d = run_sql(spark, sf, """select event_id, case event_id % 6
      when 0 then '{"route":"act","addressed":{"value":"assistant_directed","p":0.9},"intent":{"value":"timer.set","p":0.9},"slots":{"duration":{"value":"420","p":0.8}}}'
      when 1 then '{"route":"fly","addressed":{"value":"human_directed","p":0.9}}'
      when 2 then '{"route":"act","addressed":{"value":"assistant_directed","p":0.9}}'
      when 3 then '{"route":"act","addressed":{"value":"assistant_directed","p":0.9},"intent":{"value":"timer.set","p":0.9},"slots":{}}'
      when 4 then '{"route":"act","addressed":{"value":"assistant_directed","p":0.9},"intent":{"value":"open_request","p":0.9}}'
      else '{"route":"ignore","addressed":{"value":"nobody","p":1.5}}' end as decision from events""")
    return d.select("event_id", F.array_join(P.validate_decisions(F.col("decision")), ",").alias("problems"))


@query("decision_summaries", f"""
with {SCORED} select vec_id, intent || '(' || case when ki = 11 then 'duration=' || slot else '' end || ')' as summary from r where route = 'act'""")
def _(spark, sf):
    return routed(spark, sf).where("route = 'act'").select("vec_id", P.decision_summary(
        F.col("intent"), F.col("who"), F.col("slots")).alias("summary"))


@query("decision_records", f"""
with {SCORED} select vec_id, 'utterance-decision/1' as format, 'system_one' as source, route, who as addressed, round(p_who, 4) as p,
  round(a[1], 4) as p_assistant, round(a[2], 4) as p_human, case when route <> 'ignore' then intent end as intent,
  case when route <> 'ignore' then round(p_intent, 4) end as p_intent, case when route <> 'ignore' then round(i[13], 4) end as p_last_intent,
  case when route <> 'ignore' and ki = 11 then slot end as slot, case when route <> 'ignore' and ki = 11 then round(p_slot, 4) end as p_slot,
  case when route <> 'ignore' and ki = 11 then round(s[23], 4) end as p_other_slot, 'said ' || vec_id as transcript,
  case when vec_id % 3 <> 0 then 't' || vec_id end as turn, round(vec_id / 7.0::double, 2) as stt_ms, 'm1' as model, true as brief_is_brief from r""")
def _(spark, sf):
    more = dict(transcript=F.format_string("said %d", "vec_id"), turn=F.when(F.col("vec_id") % 3 != 0, F.format_string("t%d", "vec_id"))
                .otherwise(""), latency_ms=F.create_map(F.lit("stt"), F.col("vec_id") / F.lit(7.0)), model=F.lit("m1"))
    d = routed(spark, sf).withColumns({"j": P.decision_json(full=True, **more), "b": P.decision_json(**more)})

    def get(path, col="j"):
        return F.get_json_object(col, path)

    def number(path):
        return get(path).cast("double")
    shared = ("$.route", "$.addressed.value", "$.addressed.p", "$.intent.value", "$.intent.p", "$.slots.duration.value",
              "$.slots.duration.p", "$.transcript", "$.reason", "$.turn", "$.latency_ms.stt", "$.model")
    brief = ~F.contains("b", F.lit('"probs"'))
    for path in shared:
        brief = brief & get(path, "b").eqNullSafe(get(path))
    last = f"$.intent.probs['{CORE.names[12]}']"
    return d.select(
        "vec_id", get("$.format").alias("format"), get("$.source").alias("source"), get("$.route").alias("route"),
        get("$.addressed.value").alias("addressed"), number("$.addressed.p").alias("p"),
        number(f"$.addressed.probs['{V.ADDRESSEES[0]}']").alias("p_assistant"), number(f"$.addressed.probs['{V.ADDRESSEES[1]}']").alias("p_human"),
        get("$.intent.value").alias("intent"), number("$.intent.p").alias("p_intent"), number(last).alias("p_last_intent"),
        get("$.slots.duration.value").alias("slot"), number("$.slots.duration.p").alias("p_slot"),
        number(f"$.slots.duration.probs['{V.OTHER}']").alias("p_other_slot"), get("$.transcript").alias("transcript"),
        get("$.turn").alias("turn"), number("$.latency_ms.stt").alias("stt_ms"), get("$.model").alias("model"),
        brief.alias("brief_is_brief"))


@query("fast_decisions", f"""
with {SCORED} select vec_id, case when vec_id % 9 = 0 then 'escalate' else route end as route, vec_id % 9 = 0 as unscored,
  case when vec_id % 9 = 0 then 'assistant_directed' else who end as who, case when vec_id % 9 <> 0 and route <> 'ignore' then intent end as intent from r""")
def _(spark, sf):
    d = clips(spark, sf).withColumn("vector", F.when(F.col("vec_id") % 9 == 0, F.slice("vector", 1, 10))
                                    .otherwise(F.col("vector")))
    return ST.fast_decision(d, slice_model(), "slice:64").select(
        "vec_id", "route", (F.col("reason") == "the vector could not be scored").alias("unscored"), "who", "intent")


@query("top_intents", f"""
with {SCORED}, x as (select vec_id, unnest(i) as p, unnest(range(1, 14)) as k from r), y as (select *, row_number() over (partition by vec_id order by p desc, k) as rk from x)
select vec_id, string_agg({NAMES}[k], ',' order by rk) as top from y where rk <= 3 group by vec_id""")
def _(spark, sf):
    return scored(spark, sf).select("vec_id", F.array_join(F.transform(
        R.top_intents(F.col("intents")), lambda t: t["intent"]), ",").alias("top"))


# -- evaluation ---------------------------------------------------------------------------------------

@query("row_truth", """
select vec_id, case when vec_id % 5 <> 0 then g_addressed when (label < 4) <> (vec_id % 7 = 0) then 'assistant_directed' when vec_id % 7 <> 0 and label >= 7 then 'background_or_media' else 'human_directed' end as true_addressed,
  case when vec_id % 5 <> 0 then case when label < 4 then coalesce(case when vec_id % 2 = 0 then g_intent end, g_intent) end
       when (label < 4) <> (vec_id % 7 = 0) then coalesce(g_intent, 'open_request') end as true_intent from @fx_clips""")
def _(spark, sf):
    d = clips(spark, sf).withColumns({
        "g_intent": F.when(F.col("vec_id") % 2 == 0, F.col("g_intent")),
        "g_addressed": F.when(F.col("vec_id") % 5 != 0, F.col("g_addressed"))})
    return Q.truth(d).select("vec_id", "true_addressed", "true_intent")


@query("outcomes_correct", f"""
with {SCORED} select vec_id, act_ok, case when not assist then route = 'ignore' when route <> 'act' or intent <> g_intent then false when g_intent = 'open_request' then true
  else g_duration is null or coalesce(slot = g_duration::varchar, false) end as outcome from j""")
def _(spark, sf):
    d = judged(spark, sf)
    return d.select("vec_id", "act_ok", Q.outcome_correct(
        F.col("route"), F.col("intent"), F.col("slot_values"), F.col("true_addressed"),
        F.col("true_intent"), F.col("true_slots")).alias("outcome"))


@query("addressee_auc", f"""
with {SCORED}, k as (select assist, rank() over (order by p_assistant) + (count(*) over (partition by p_assistant) - 1) / 2.0 as rk from j)
select round((sum(rk) filter (assist) - count(*) filter (assist) * (count(*) filter (assist) + 1) / 2.0) / (count(*) filter (assist) * count(*) filter (not assist)), 4) as auc from k""")
def _(spark, sf):
    return Q.auc(judged(spark, sf), F.col("p_assistant"), F.col("is_assist")).select(F.round("auc", 4).alias("auc"))


def rate_sql(name, k, n):
    return (f"{k} as {name}_k, {n} as {name}_n, round({k} / {n}, 4) as {name}_rate, "
            f"case when {n} > 0 then round({wilson(k, n)}, 4) end as {name}_upper95")


@query("student_headline", f"""
with {SCORED}, a as (select count(*) as rows, count(*) filter (route = 'act') as act, count(*) filter (route = 'ignore') as ign, count(*) filter (route = 'escalate') as esc,
  count(*) filter (assist) as pos, count(*) filter (not assist) as non, count(*) filter (route = 'ignore' and assist) as fi, count(*) filter (route = 'act' and not assist) as fa,
  count(*) filter (route = 'ignore' and not assist) as ci, count(*) filter (route = 'act' and not coalesce(act_ok, false)) as wa,
  count(*) filter (act_ok and g_intent <> 'open_request') as ta, count(*) filter (assist and g_intent <> 'open_request') as typed,
  count(*) filter (who = g_addressed) as ok, count(*) filter (assist and intent = g_intent) as iok from j)
select rows, act, ign as "ignore", esc as escalate, round((act + ign) / rows, 4) as stt_avoided, {rate_sql('false_ignore', 'fi', 'pos')},
  {rate_sql('false_activation', 'fa', 'non')}, {rate_sql('correct_ignore', 'ci', 'non')}, {rate_sql('wrong_act', 'wa', 'act')}, {rate_sql('typed_acted', 'ta', 'typed')},
  round(ok / rows, 4) as addressed_accuracy, round(iok / pos, 4) as intent_accuracy from a""")
def _(spark, sf):
    return Q.evaluate(judged(spark, sf))


@query("student_report")
def _(spark, sf):
    return ST.full_report(judged(spark, sf))


@query("intent_confusions", f"""
with {SCORED} select g_intent as "true", intent as predicted, count(*) as n from j where assist and intent <> g_intent group by all order by n desc, 1, 2 limit 10""")
def _(spark, sf):
    return Q.intent_confusions(judged(spark, sf))


@query("teacher_against_gold", f"""
with {SCORED}, a as (select count(*) as n, count(*) filter (t_accept = assist) as hit, count(*) filter (t_accept and not assist) as fa, count(*) filter (not assist) as non,
  count(*) filter (not t_accept and assist) as miss, count(*) filter (assist) as pos, count(*) filter (t_accept and assist) as served from j)
select n as rows, round(hit / n, 4) as accuracy, {rate_sql('false_activation', 'fa', 'non')}, {rate_sql('missed', 'miss', 'pos')}, 1.0 as intent_accuracy_on_accepted from a""")
def _(spark, sf):
    return Q.teacher_vs_gold(clips(spark, sf))


@query("end_to_end_outcomes", f"""
with {SCORED}, o as (select *, case when not assist then not t_accept else t_accept and t_intent = g_intent end as t_ok,
  case when not assist then route = 'ignore' when route <> 'act' or intent <> g_intent then false when g_intent = 'open_request' then true else g_duration is null or coalesce(slot = g_duration::varchar, false) end as f_ok from j),
a as (select count(*) as rows, count(*) filter (case when route = 'escalate' then t_ok else f_ok end) as h, count(*) filter (t_ok) as t, count(*) filter (route = 'escalate') as calls,
  avg(stt_ms::double) as stt, avg(encode_ms::double) as enc from o)
select rows, round(h / rows, 4) as hybrid_correct, round(t / rows, 4) as teacher_only_correct, calls as stt_calls_hybrid, rows as stt_calls_teacher_only,
  round(stt, 2) as ms_teacher_only, round(enc + stt * calls / rows, 2) as ms_hybrid from a""")
def _(spark, sf):
    return Q.end_to_end(judged(spark, sf))


@query("category_breakdown", f"""
with {SCORED} select category, count(*) as n, count(*) filter (route = 'act') as act, count(*) filter (route = 'ignore') as "ignore", count(*) filter (route = 'escalate') as escalate,
  round(avg((who = g_addressed)::int), 4) as addressed_accuracy, count(*) filter ((route = 'ignore' and assist) or (route = 'act' and not coalesce(act_ok, false))) as wrong_decisions from j group by category""")
def _(spark, sf):
    return Q.breakdown(judged(spark, sf), "category")


@query("source_accuracy", f"""
with {SCORED}, s as (select source, count(*) as n, round(avg((who = g_addressed)::int), 4) as acc from j group by source)
select round(sum(acc * n) filter (source in ('ami', 'speech_commands', 'consented')) / sum(n) filter (source in ('ami', 'speech_commands', 'consented')), 4) as real_addressed_acc,
  round(sum(acc * n) filter (source in ('synthetic_say', 'noise')) / sum(n) filter (source in ('synthetic_say', 'noise')), 4) as synthetic_addressed_acc from s""")
def _(spark, sf):
    return Q.source_accuracy(Q.breakdown(judged(spark, sf), "source"))


@query("worst_false_ignores", f"""
with {SCORED} select id, round(p_assistant, 4) as p_assistant from j where route = 'ignore' and assist order by round(p_assistant, 4), id limit 10""")
def _(spark, sf):
    return Q.worst_false_ignores(judged(spark, sf))


@query("false_activations", f"""
with {SCORED} select vec_id, id, intent as acted_as, g_addressed as truth from j where route = 'act' and not assist order by vec_id limit 10""")
def _(spark, sf):
    return Q.false_activations(judged(spark, sf), "vec_id")


@query("slot_accuracy", f"""
with {SCORED}, k as (select coalesce({DURATIONS}[ks]::varchar, '__other__') as got, case when list_contains({DURATIONS}, g_duration) then g_duration::varchar else '__other__' end as want from j where g_duration is not null)
select count(*) as slots, round(avg((got = want)::int), 4) as accuracy from k""")
def _(spark, sf):
    return Q.slot_accuracy(judged(spark, sf)).select("slots", F.round("accuracy", 4).alias("accuracy"))


def bound_sql(k, n):
    return wilson(k, n, 1.0)


SEARCH = f"""{SCORED}, pos as (select p_assistant, row_number() over (order by p_assistant) - 1 as rk, count(*) over () as n from j where assist),
ib as (select round(least(coalesce((select p_assistant from pos where rk = floor(0.2 * n + 1e-9)), 0.5), 0.5), 6) as ignore_below),
f as (select *, not (ki in (3, 4, 12, 13) or (ki = 11 and ks = 23)) as actable, case when ki = 11 then p_slot else 1.0 end as ps,
  assist and intent = g_intent and (ki <> 11 or slot = g_duration::varchar) as correct from j),
g as (select unnest([{", ".join(str(x) for x in V.ACT_GRID)}])::double as g),
c as (select a.g as act_addressed, b.g as act_intent, s.g as act_slot, count(*) as acts, count(*) filter (not coalesce(correct, false)) as wrong, count(*) filter (not assist) as false_act
  from g a, g b, g s, f, ib where actable and p_assistant >= ignore_below and p_assistant >= a.g and p_intent >= b.g and ps >= s.g group by all),
k as (select *, (select greatest(count(*) filter (not assist), 1) from j) as non from c)"""


@query("act_thresholds", f"""
with {SEARCH} select act_addressed, act_intent, act_slot, acts, wrong, false_act from k
where {bound_sql('wrong', 'acts')} <= 1.0 + 1e-12 and {bound_sql('false_act', 'non')} <= 0.5 + 1e-12
order by acts - wrong desc, act_addressed + act_intent + act_slot desc, act_addressed, act_intent, act_slot limit 1""")
def _(spark, sf):
    d = ST.search_facts(Q.truth(scored(spark, sf)))
    from whofor.operators.gate import choose_threshold
    t = choose_threshold(d, F.col("p_assistant"), F.lit(True), F.col("is_assist"), 0.2).first()[0]
    return Q.choose_act_thresholds(d, round(t, 6), 1.0, 0.5)


@query("wilson_bounds", f"""
with a as (select l_suppkey as k, count(*) as n, count(*) filter (l_returnflag = 'R') as r from lineitem group by l_suppkey)
select k, n, r, round({wilson('r', 'n')}, 4) as upper95 from a""")
def _(spark, sf):
    d = run_sql(spark, sf, "select l_suppkey as k, count(*) as n, count_if(l_returnflag = 'R') as r from lineitem group by l_suppkey")
    return d.select("k", "n", "r", F.round(wilson_upper(F.col("r"), F.col("n")), 4).alias("upper95"))


@query("holdout_rows", "select vec_id from @fx_clips where vec_id % 3 = 0")
def _(spark, sf):
    d = fixture(spark, sf, "fx_clips")
    return Q.holdout_rows(d, d.where("vec_id % 3 = 0")).select("vec_id")


@query("sampled_rows")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, value from events")
    return Q.sample_rows(d, 500, 7, "event_id", ["event_id"])


@query("recorded_sessions", f"""
with {SCORED} select count(*) as rows, count(*) filter (route = 'act') as act from j where vec_id % 15 in (1, 2)""")
def _(spark, sf):
    d = clips(spark, sf).withColumn("session", F.col("speaker"))
    v = d.select("id", "vector", "encode_ms", "session", F.lit("slice__64").alias("spec_name"))
    return ST.evaluate_sessions(slice_model(), d.drop("vector", "encode_ms"), v.drop("x"), ["s1", "s2"]) \
        .select("rows", "act")


# -- bench summaries ------------------------------------------------------------------------------------

def bench(spark, sf):
    none = F.create_map().cast("map<string,string>")
    d = fixture(spark, sf, "fx_bench").withColumns({
        "slots": none, "gold_slots": none, "ms": F.col("ms").cast("double"),
        "decided_by": F.when(F.col("stt_called"), "system_two").otherwise("system_one")})
    return Q.bench_outcomes(d)


BENCH = """b as (select *, gold_addressed = 'assistant_directed' as a, decision = 'act' as t,
  case when gold_addressed <> 'assistant_directed' then decision = 'ignore' else decision = 'act' and intent = gold_intent end as ok from @fx_bench)"""


@query("bench_summary", f"""
with {BENCH}, s as (select system, count(*) as n, count(*) filter (ok) as ok, count(*) filter (not a and t) as fa, count(*) filter (not a) as non, count(*) filter (a and not t) as miss,
  count(*) filter (a) as pos, count(*) filter (a and t) as served, count(*) filter (a and t and intent = gold_intent) as same, count(*) filter (a and ok) as tok, count(*) filter (stt_called) as calls,
  avg(ms) as mean, quantile_cont(ms, 0.5) as q5, quantile_cont(ms, 0.95) as q95, quantile_cont(case when a then ms end, 0.5) as t5, quantile_cont(case when a then ms end, 0.95) as t95 from b group by system)
select system, n as clips, round(ok / n, 4) as correct, {rate_sql('false_activation', 'fa', 'non')}, {rate_sql('missed', 'miss', 'pos')}, round(same / served, 4) as intent_accuracy_when_served,
  round(tok / pos, 4) as typed_correct, calls as stt_calls, round((n - calls) / n, 4) as stt_avoided, round(q5, 2) as p50_ms, round(q95, 2) as p95_ms, round(mean, 2) as mean_ms,
  round(t5, 2) as typed_p50_ms, round(t95, 2) as typed_p95_ms from s""")
def _(spark, sf):
    return Q.bench_summary(bench(spark, sf))


@query("bench_by_category", f"with {BENCH} select system, category, count(*) as n, round(avg(ok::int), 4) as correct from b group by all")
def _(spark, sf):
    return Q.bench_shares(bench(spark, sf), "category")


@query("bench_decided_by", f"with {BENCH} select system, case when stt_called then 'system_two' else 'system_one' end as decided_by, count(*) as n, round(avg(ok::int), 4) as correct from b group by all")
def _(spark, sf):
    return Q.bench_shares(bench(spark, sf), "decided_by")


@query("latency_by_type", """
select event_type, count(*) as n, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95 from events group by event_type""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_type, value from events")
    return quantiles(d, ["event_type"], F.col("value"), {"p50": 0.5, "p95": 0.95}, 4)


# -- speakers -----------------------------------------------------------------------------------------

UNIT = """u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings),
d as (select label, k, avg(x) as m from (select label, unnest(u) as x, unnest(range(0, 64)) as k from u where vec_id % 5 < 3) group by label, k),
g as (select label, list(m order by k) as m from d group by label), p as (select label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) as profile from g)"""


def vectors(spark, sf):
    return run_sql(spark, sf, "select vec_id, embedding, label, 0.3D + cast(vec_id % 20 as double) / 10 as seconds from embeddings")


def profiles(spark, sf):
    return SP.enrol(vectors(spark, sf).where("vec_id % 5 < 3"), ["label"], "embedding", DIM)


@query("enrolled_profiles", f"with {UNIT} select label, round(profile[1], 5) as first, round(profile[64], 5) as last from p")
def _(spark, sf):
    return profiles(spark, sf).select("label", F.round(F.get("profile", F.lit(0)), 5).alias("first"),
                                      F.round(F.get("profile", F.lit(63)), 5).alias("last"))


@query("voice_similarity", f"with {UNIT} select vec_id, round(list_inner_product(u, profile), 5) as similarity from u join p using (label) where vec_id % 5 >= 3")
def _(spark, sf):
    d = vectors(spark, sf).where("vec_id % 5 >= 3")
    return SP.similarity(d, profiles(spark, sf), ["label"], "embedding") \
        .select("vec_id", F.round("similarity", 5).alias("similarity"))


def against_owner(spark, sf):
    owner = profiles(spark, sf).where("label = 0").select("profile").scalar()
    return vectors(spark, sf).where("vec_id % 5 >= 3").withColumn("profile", owner).select(
        "vec_id", "label", "seconds", SP.dot(SP.unit(F.col("embedding")), F.col("profile")).alias("similarity"))


OWNER = f"""{UNIT}, s as (select u.vec_id, u.label, 0.3 + (u.vec_id % 20) / 10.0 as seconds, list_inner_product(u.u, p.profile) as similarity from u, p where p.label = 0 and u.vec_id % 5 >= 3)"""


@query("voice_estimates", f"""
with {OWNER}, l as (select *, 0.3 * least(1.0, greatest(0.5, seconds / 1.2)) as line, vec_id % 11 <> 0 as ok from s)
select vec_id, case when ok then round(1.0 / (1.0 + exp(-(similarity - line) / 0.08)), 4) else 1.0 end as p_own, ok as voice_confident,
  ok and round(similarity, 4) >= round(line, 4) as is_wearer from l""")
def _(spark, sf):
    d = SP.voice_estimate(against_owner(spark, sf), F.lit(0.3),
                          F.when(F.col("vec_id") % 11 != 0, "desk mic"), F.lit("desk mic"))
    return d.select("vec_id", "p_own", "voice_confident", "is_wearer")


@query("voice_threshold_sweep", f"""
with {OWNER}, th as (select k / 20.0 as t from range(0, 19) r(k)), c as (select t, (select avg((similarity < t)::int) from s where label = 0) as sil, (select avg((similarity >= t)::int) from s where label <> 0) as pas from th),
m as (select *, sil + 3.0 * pas as cost from c), b as (select *, row_number() over (order by t) - 1 as rk, count(*) over () as n from m where cost <= (select min(cost) from m) + 1e-9),
q as (select quantile_cont(similarity, 0.5) filter (label = 0) as mine, quantile_cont(similarity, 0.5) filter (label <> 0) as theirs from s)
select round(t, 2) as threshold, round(sil, 3) as wearer_silenced, round(pas, 3) as bystander_passed, round(mine, 3) as wearer_median, round(theirs, 3) as bystander_median, mine - theirs > 0.15 as separated
from b, q where rk = n // 2""")
def _(spark, sf):
    d = against_owner(spark, sf).withColumn("is_owner", F.col("label") == 0)
    return SP.sweep_voice_threshold(d)


@query("admitted_enrolment", """
with c as (select *, row_number() over (partition by label, vec_id % 2 order by vec_id) as rank from embeddings where 0.3 + (vec_id % 20) / 10.0 >= 0.4)
select vec_id, label, vec_id % 2 as side, rank from c where rank <= 8""")
def _(spark, sf):
    d = vectors(spark, sf).withColumn("side", F.col("vec_id") % 2)
    return SP.admit_enrolment(d, ["vec_id"], keys=("label", "side"), clip_id="vec_id") \
        .select("vec_id", "label", "side", "rank")


@query("solo_voice_lines", """
with c as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u,
  row_number() over (partition by label order by vec_id) as rk from embeddings where 0.3 + (vec_id % 20) / 10.0 >= 0.4),
k as (select * from c where rk <= 8), d as (select label, i, avg(x) as m from (select label, unnest(u) as x, unnest(range(0, 64)) as i from k where rk <= 4) group by label, i),
p as (select label, list(m order by i) as m from d group by label), s as (select label, list_inner_product(u, m) / sqrt(list_inner_product(m, m)) as sim from k join p using (label) where rk > 4),
w as (select label, min(sim) as worst from s group by label)
select label, round(greatest(0.15, least(0.5, worst - 0.15)), 2) as threshold, round(worst, 3) as self_consistency from w""")
def _(spark, sf):
    d = SP.admit_enrolment(vectors(spark, sf), ["vec_id"], keys=("label",), clip_id="vec_id")
    return SP.solo_voice_threshold(d, ["label"], "embedding", DIM)


# -- frames ---------------------------------------------------------------------------------------------

def frames(spark, sf):
    return fixture(spark, sf, "fx_frames").withColumns({
        "rms": F.col("rms").cast("double"), "prob": F.col("prob").cast("double"),
        "at_s": F.col("frame_idx") * 0.032})


@query("voice_activity", """
with f as (select *, rms::double + 1e-9 as lv from @fx_frames), q as (select *, quantile_cont(lv, 0.2) over (partition by stream_id order by frame_idx rows between 99 preceding and current row) as q from f),
n as (select *, case when frame_idx + 1 >= 10 then greatest(q, 1e-5) else 1e-3 end as noise from q)
select stream_id, frame_idx, round(greatest(0.0, least(1.0, (log10(lv / (noise * 3.0) + 1e-9) + 0.5) / 1.2)), 4) as prob from n""")
def _(spark, sf):
    return E.energy_vad(frames(spark, sf).drop("prob")).select(
        "stream_id", "frame_idx", F.round("prob", 4).alias("prob"))


@query("level_meter", """
select stream_id, time_bucket(interval '10 minutes', ts) as at, round(20 * log10(greatest(max(rms), 1e-6)), 1) as db from @fx_frames group by all""")
def _(spark, sf):
    return E.level_meter(frames(spark, sf), "10 minutes")


@query("speech_segments", """
with recursive f as (select stream_id, frame_idx as i, frame_idx * 0.032::double as at_s, prob::double as p, prob >= 0.5 as v from @fx_frames),
s as (select distinct stream_id, -1::bigint as i, 0 as heard, 0 as quiet, 0 as len, 0.0::double as start_s, 0.0::double as ps, 0 as pn, []::double[] as pre,
  null::double as d_start, null::double as d_end, 0 as d_len, null::double as d_conf from f
union all
select stream_id, i, case when done or len1 > 0 then 0 else heard1 end, case when done then 0 else quiet1 end, case when done then 0 else len1 end, start1,
  case when done then 0.0 else ps1 end, case when done then 0 else pn1 end, case when done then [] else pre1 end,
  case when done then start1 end, case when done then at_s + 0.032 end, len1, case when done then ps1 / greatest(pn1, 1) end
from (select *, was and (quiet1 >= 3 or len1 >= 625) as done from (
  select *, case when was then len0 + 1 when heard1 >= 2 then len(pre1) else 0 end as len1, case when was then start_s when heard1 >= 2 then pre1[1] else start_s end as start1
  from (select f.stream_id, f.i, f.at_s, s.len as len0, s.len > 0 as was, s.start_s, case when s.len > 0 then 0 when f.v then s.heard + 1 else 0 end as heard1,
      case when s.len = 0 or f.v then 0 else s.quiet + 1 end as quiet1,
      case when f.v then s.ps + f.p when s.len = 0 then 0.0 else s.ps end as ps1, case when f.v then s.pn + 1 when s.len = 0 then 0 else s.pn end as pn1,
      case when s.len = 0 then list_append(s.pre, f.at_s)[-2:] else s.pre end as pre1
    from s join f on f.stream_id = s.stream_id and f.i = s.i + 1))))
select stream_id, round(d_start, 6) as start_s, round(d_end, 6) as end_s, round(d_len * 0.032, 6) as seconds, round(d_len * 0.032 - 0.096, 3) as speech_seconds,
  round(d_conf, 6) as confidence, d_len >= 625 as truncated from s where d_start is not null and d_len * 0.032 - 0.096 >= 0.032""")
def _(spark, sf):
    d = E.detect_segments(frames(spark, sf), E.SegmentSettings(
        min_speech_ms=64, min_silence_ms=96, min_segment_ms=32, preroll_s=0.064))
    return d.select("stream_id", *[F.round(c, 6).alias(c) for c in ("start_s", "end_s", "seconds")], "speech_seconds",
                    F.round("confidence", 6).alias("confidence"), "truncated")


@query("vad_confidence", """
select user_id as stream_id, round(coalesce(avg(case when value / 100 >= 0.5 then value / 100 end), 0), 6) as vad_confidence from events group by user_id""")
def _(spark, sf):
    d = run_sql(spark, sf, "select user_id as stream_id, value / 100 as p from events")
    return E.vad_confidence(d, ["stream_id"], F.col("p")).select(
        "stream_id", F.round("vad_confidence", 6).alias("vad_confidence"))


# -- clips and recipes ------------------------------------------------------------------------------------

@query("pooled_frames", """
with f as (select vec_id // 8 as id, vec_id % 8 as t, unnest(embedding)::double as x, unnest(range(0, 64)) as k from embeddings),
n as (select id, k, avg(x) as m, stddev_pop(x) as s, max(x) as mx, max(t) + 1 as n from f group by id, k),
h as (select f.id, f.k, avg(f.x) filter (f.t < n.n // 3 + (n.n % 3 > 0)::int) as third from f join n using (id, k) group by all)
select n.id, round(sum(m), 4) as means, round(sum(s), 4) as spreads, round(sum(mx), 4) as tops, round(sum(third), 4) as first_third from n join h using (id, k) group by n.id""")
def _(spark, sf):
    d = run_sql(spark, sf, "select vec_id div 8 as id, vec_id % 8 as t, transform(embedding, x -> cast(x as double)) as frame from embeddings")
    v = D.pool_frames(d, DIM, "stats_thirds")

    def part(k):
        return F.round(F.aggregate(F.slice("vector", k * DIM + 1, DIM), F.lit(0.0), lambda a, x: a + x), 4)
    return v.select("id", part(0).alias("means"), part(1).alias("spreads"), part(2).alias("tops"),
                    part(3).alias("first_third"))


@query("parsed_specs", """
select event_id, case event_id % 3 when 0 then 'parakeet' when 1 then 'logmel' else 'gate' end as kind, case event_id % 3 when 0 then 'org/m' || event_id when 1 then cast(32 + event_id % 64 as varchar) end as repo,
  case when event_id % 3 = 0 then cast(event_id % 17 as int) end as layers, case when event_id % 3 = 0 then 'stats_thirds' else 'stats' end as pooling from events""")
def _(spark, sf):
    d = run_sql(spark, sf, """select event_id, case event_id % 3 when 0 then concat('parakeet:org/m', cast(event_id as string), '@L', cast(event_id % 17 as string), ':stats_thirds')
      when 1 then concat('logmel:', cast(32 + event_id % 64 as string), ':stats') else 'gate:20' end as spec from events""")
    return d.withColumn("s", D.parse_spec(F.col("spec"))).select("event_id", "s.kind", "s.repo", "s.layers", "s.pooling")


@query("recipe_seeds", "select id, ('0x' || substr(sha1(id), 1, 8))::bigint as seed from @fx_clips")
def _(spark, sf):
    return fixture(spark, sf, "fx_clips").select("id", D.recipe_seed(F.col("id")).alias("seed"))


@query("expanded_recipes", f"""
with r as (select id as new_id, null as seed, 'tts' as room from @fx_clips union all
  select id || '-a' || k, ('0x' || substr(sha1(id || '-a' || k), 1, 8))::bigint, 'simulated' from @fx_clips, range(0, 2) t(k)),
p as (select 'audio/' || id as path, row_number() over (order by sha1(id), id) - 1 as spot from @fx_clips where g_addressed <> '{V.ASSISTANT}'),
d as (select new_id, j, ('0x' || substr(sha1(new_id || '#0-' || j), 1, 8))::bigint % (select count(*) from p) as spot from r, range(0, 3) t(j) where seed is not null),
f as (select new_id, path, min(j) as j from d join p using (spot) group by new_id, path),
b as (select new_id, string_agg(path, ',' order by j) as babble from f group by new_id)
select r.new_id as id, seed, room, babble from r left join b using (new_id)""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_clips").select("id", F.concat(F.lit("audio/"), F.col("id")).alias("path"), "g_addressed")
    return D.expand_recipes(d, 2).select("id", F.col("augment.seed").alias("seed"), "room",
                                         F.array_join("augment.babble", ",").alias("babble"))


@query("voiced_lines", """
select event_id, 'voice-' || substr(sha1('v' || event_id % 5), 1, 8) as speaker, printf('syn03-%05d', event_id) as id from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, event_id % 5 as pos from events")
    v = D.assign_voices(d, [f"v{i}" for i in range(5)], 3)
    return v.select("event_id", "speaker", F.format_string("syn03-%05d", "event_id").alias("id"))


@query("rebuilt_noise_clips")
def _(spark, sf):
    d = fixture(spark, sf, "fx_clips").select(
        "id", F.struct(F.lit("noise").alias("kind"), D.recipe_seed(F.col("id")).alias("seed")).alias("generate"),
        F.lit(None).cast("struct<seed:bigint,babble:array<string>>").alias("augment"), F.lit(None).cast("array<float>").alias("pcm"))
    return D.augment_clips(d).select("id", F.size("pcm").alias("samples"), "info")


def waves(spark, sf):
    """A clip per vector: the vector repeated as a waveform."""
    return run_sql(spark, sf, "select concat('c', cast(vec_id as string)) as id, flatten(array_repeat(embedding, 60 + cast(vec_id % 40 as int))) as pcm from embeddings")


@query("prosody_features")
def _(spark, sf):
    d = D.prosody_features(waves(spark, sf))
    return d.select("id", *[F.round(n, 6).alias(n) for n in V.PROSODY_NAMES], "error")


@query("gate_vectors")
def _(spark, sf):
    return D.gate_vector(waves(spark, sf)).select("id", F.size("vector").alias("dims"), "spec")


@query("embedded_clips")
def _(spark, sf):
    return D.embed(waves(spark, sf), D.logmel_vector, "logmel:64:stats").select("id", F.size("vector").alias("dims"), "spec")


@query("filterbank_frames")
def _(spark, sf):
    return D.fbank_frames(waves(spark, sf)).groupBy("id").agg(F.count(F.lit(1)).alias("frames"))


@query("sampled_commands", """
select event_type as word, least(count(*), 50) as kept from events group by event_type""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_type as word, cast(event_id as string) as name from events")
    return CP.sample_per_group(d, "word", 50, 3, "name").groupBy("word").agg(F.count(F.lit(1)).alias("kept"))


@query("corpus_rows", """
with m as (select user_id, count(*) as n from events group by user_id)
select 'ami-m' || user_id as speaker, 'human_directed' as g_addressed, least(n, 20) as clips from m
union all select 'all', 'assistant_directed', count(*) from (select * from (select *, row_number() over (partition by event_type order by event_id) as rk from events where event_type in ('click', 'view', 'error')) where rk <= 30)""")
def _(spark, sf):
    seg = run_sql(spark, sf, "select concat('m', cast(user_id as string)) as meeting, cast(event_id as double) as start, event_id + 1.0D as end from events")
    real = CP.meeting_rows(seg, 20).groupBy("speaker", "g_addressed").agg(F.count(F.lit(1)).alias("clips"))
    files = run_sql(spark, sf, "select case event_type when 'click' then 'stop' when 'view' then 'yes' when 'error' then 'no' else 'other' end as word, concat('spk', cast(user_id as string), '_nohash_', cast(event_id as string), '.wav') as name from events")
    words = CP.command_rows(files, 30).groupBy("g_addressed").agg(F.count(F.lit(1)).alias("clips"))
    return real.unionByName(words.select(F.lit("all").alias("speaker"), "g_addressed", "clips"))


@query("session_catalogue", """
select 's' || user_id as path, count(*) as rows, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') as collected_at from events group by user_id having user_id % 7 <> 0""")
def _(spark, sf):
    d = run_sql(spark, sf, """select concat('s', cast(user_id as string)) as path, case when user_id % 7 = 0 then '{broken' else to_json(named_struct('rows', count(*), 'collected_at', date_format(max(ts), "yyyy-MM-dd'T'HH:mm:ss"))) end as value from events group by user_id""")
    return SS.list_sessions(d).select("path", "rows", "collected_at")


@query("model_catalogue", """
select 'm' || user_id as path, case when user_id % 7 <> 0 then 'logmel:64:stats' end as encoder, case when user_id % 7 = 0 then 'not a model card' end as error from events group by user_id""")
def _(spark, sf):
    d = run_sql(spark, sf, """select concat('m', cast(user_id as string)) as path, case when user_id % 7 = 0 then '{}' else '{"encoder": "logmel:64:stats", "tag": "t"}' end as value, max(ts) as modified from events group by user_id""")
    return SS.list_models(d).select("path", "encoder", "error")


@query("replayed_turns")
def _(spark, sf):
    from whofor.plans.replay import ReplaySettings, replay
    return replay(segments(spark, sf), ReplaySettings("on", "shadow", True)).select(
        "turn", "conv_id", "step", "stage", "event", "detail")


@query("replay_funnel")
def _(spark, sf):
    from whofor.plans.replay import ReplaySettings, replay
    return R.stage_funnel(replay(segments(spark, sf), ReplaySettings("shadow", "shadow", True)))


def segments(spark, sf):
    """Recorded segments: the phrase table's lines with gate inputs and a fast decision."""
    d = run_sql(spark, sf, """
      select u.utt_id as turn, u.conv_id, u.conv_id * 100000.0D + u.utt_id * 7 as at_s, 'user' as role, u.text, u.reliable, false as driving,
        cast(u.llm_score as double) as llm_score, cast(g.seconds as double) as seconds, g.confidence, g.voice_confident, g.is_wearer or g.row_id % 3 <> 0 as is_wearer,
        0.8D as p_own, cast(g.since_ai as double) as since_ai, g.awaiting_answer, g.confirming, false as offer_pending, g.ignored_run,
        l.fast_route as route, l.fast_intent as intent
      from @fx_utterances u join @fx_gate_rows g on g.row_id = u.utt_id join @fx_decision_log l on l.turn = u.utt_id""")
    run = F.col("ignored_run").cast("int")
    return d.withColumn("recent_verdicts", F.when(run > 0, F.array_repeat(F.lit(False), run))
                        .otherwise(F.array().cast("array<boolean>"))).drop("ignored_run")
