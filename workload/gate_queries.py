"""Policy, gate and shadow-log queries."""

from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.operators import gate as G
from whofor.operators import gate_model as M
from whofor.operators import metrics as Q
from whofor.operators import policy as P
from whofor.operators import shadow as R
from whofor.operators import splits as S
from workload.registry import fixture, query, run_sql

MODEL = G.GateModel(
    weights=(0.002, -0.01, 0.5, 0.4, 0.0002, -0.0001, 0.1, -0.3, -0.2, -0.35, 2.0, 0.8, -0.1,
             0.3, -0.45, -0.3, 0.6, 1.5, 1.0, 0.7),
    bias=-0.4,
    mean=(160.0, 20.0, 0.0, 0.5, 1500.0, 2900.0, 4.5, 0.17, 0.35, 4.0, 0.8, 0.5, 0.75, 0.3,
          3.0, 2.0, 0.1, 0.1, 0.01, 0.0),
    scale=(35.0, 9.0, 0.06, 0.15, 170.0, 260.0, 0.3, 0.07, 0.23, 3.0, 0.12, 0.25, 0.43, 0.4,
           1.2, 1.4, 0.3, 0.3, 0.1, 1.0),
    threshold=0.35)


def terms():
    return [f"({n} - {m}::double) / {s}::double * {w}::double" for n, m, s, w in zip(
        V.FEATURE_NAMES, MODEL.mean, MODEL.scale, MODEL.weights)]


LOGIT = " + ".join(terms()) + f" + {MODEL.bias}::double"
P_SQL = f"round(1.0 / (1.0 + exp(-({LOGIT}))), 4)"
SINCE = "(exp(since_ai_log) - 1.0)"
CONTEXT_MUST = f"""case when confirming >= 0.5 then 'a confirmation is open'
  when offer_pending >= 0.5 then 'an offer is waiting for an answer'
  when awaiting_answer >= 0.5 then 'the assistant asked a question'
  when {SINCE} < 20 then 'inside the follow-up window'
  when voice_confident >= 0.5 and is_wearer > 0.6
  then 'the enrolled voice was confidently detected' end"""
PROBLEM = "case when voiced_ratio <= 0 then 'nothing voiced in the segment' when duration <= 0 then 'zero-length segment' end"
OPEN = ", ".join(f"'{x}'" for x in V.OPEN_LICENSES)


def gate_rows(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows", spread=True)
    run = F.col("ignored_run").cast("int")
    return d.withColumns({
        "seconds": F.col("seconds").cast("double"), "confidence": F.col("confidence").cast("double"),
        "since_ai": F.col("since_ai").cast("double"), "offer_pending": F.lit(False),
        "p_own": F.lit(None).cast("double"),
        "is_wearer": F.when(F.col("voice_confident"), F.col("is_wearer")),
        "recent_verdicts": F.when(run > 0, F.array_repeat(F.lit(False), run))
        .when(F.col("row_id") % 2 == 0, F.array(F.lit(True)))
        .otherwise(F.array().cast("array<boolean>"))})


def feature_rows(spark, sf):
    return fixture(spark, sf, "fx_feature_rows", spread=True)


def decided(spark, sf, model=None, mode="shadow"):
    return G.gate_decide(feature_rows(spark, sf), G.context_from_features(), mode, model,
                         learned=model is not None)


RULE_SQL = """
select row_id, 1.2
  + case when since_ai >= 20 then -1.1 else 0 end + case when since_ai >= 60 then -0.7 else 0 end
  + -0.55 * least(ignored_run, 3)
  + case when ignored_run = 0 and row_id % 2 = 0 then 0.9 else 0 end
  + case when voice_confident and not is_wearer then -3.0 else 0 end
  + case when seconds >= 10 then -0.8 when seconds <= 1.2 then -0.5 else 0 end
  + case when confidence < 0.90 then -0.6 else 0 end as logit,
  coalesce((voice_confident and not is_wearer) or seconds >= 10 or confidence < 0.90, false) as licensed,
  case when confirming then 'a confirmation is open'
       when awaiting_answer then 'the assistant asked a question'
       when since_ai < 20 then 'inside the follow-up window'
       when voice_confident and is_wearer then 'the enrolled voice was confidently detected'
       when not voice_confident then 'the voice could not be checked' end as must
from @fx_gate_rows"""
DECIDED_SQL = f"""
select f.*, {P_SQL} as p, coalesce({CONTEXT_MUST}, {PROBLEM}, '') as why,
  coalesce({CONTEXT_MUST}, {PROBLEM}, '') = '' and {P_SQL} < 0.35 as would_skip,
  coalesce({CONTEXT_MUST}, {PROBLEM}) is null as may_skip
from @fx_feature_rows f"""


# -- provenance ------------------------------------------------------------------------------

@query("row_provenance", f"""
select row_id, case when source = 'podcast' then 'unknown source podcast'
    when source = 'shadow_log' then 'shadow-log rows come from a log export'
    when source = 'consented' and consent not in ('release', 'internal') then 'consented rows need consent release or internal'
    when source = 'consented' then null
    when source = 'custom' and license not in ({OPEN}) then 'licence ' || license || ' is not open' end as refusal,
  case when source in ('ami', 'common_voice') or (source = 'consented' and consent <> '')
         or (source = 'custom' and license in ({OPEN})) then source end as p_source,
  case when source in ('ami', 'common_voice') or (source = 'consented' and consent <> '')
         or (source = 'custom' and license in ({OPEN})) then license end as p_license
from @fx_gate_rows""")
def _(spark, sf):
    return P.resolve_provenance(fixture(spark, sf, "fx_gate_rows")) \
        .select("row_id", "refusal", "p_source", "p_license")


@query("trainable_rows", f"""
select source, license, consent,
  source not in ('shadow_log', 'consented') and license in ({OPEN}) or (source = 'consented' and consent = 'release') as gate_ok,
  source not in ('shadow_log', 'consented') and license in ({OPEN}) or (source = 'consented' and consent in ('release', 'internal')) as gate_ok_internal,
  case when source = 'consented' then consent = 'release' when source = 'ami' then true else license in ({OPEN}) end as distributable,
  case when source = 'shadow_log' then false when source = 'consented' then consent = 'release' when source = 'ami' then true else license in ({OPEN}) end as clip_ok,
  case when source = 'shadow_log' then false when source = 'consented' then consent in ('release', 'internal') else true end as clip_ok_internal,
  count(*) as rows
from @fx_gate_rows group by all""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").withColumns({
        "gate_ok": P.gate_trainable(), "gate_ok_internal": P.gate_trainable(True),
        "distributable": P.row_distributable(), "clip_ok": P.row_trainable(),
        "clip_ok_internal": P.row_trainable(True)})
    return d.groupBy("source", "license", "consent", "gate_ok", "gate_ok_internal",
                     "distributable", "clip_ok", "clip_ok_internal") \
        .agg(F.count(F.lit(1)).alias("rows"))


@query("provenance_summary", f"""
select source, case source when 'ami' then 'AMI Meeting Corpus' when 'common_voice' then 'Mozilla Common Voice'
    when 'custom' then 'Other openly licensed data (licence column required)' when 'consented' then 'Consented recordings'
    when 'shadow_log' then 'Shadow-mode event log (evaluation only)' else source end as name,
  license, consent, count(*) as rows, license in ({OPEN}) or consent = 'release' as distributable
from @fx_gate_rows group by all""")
def _(spark, sf):
    return P.provenance_summary(fixture(spark, sf, "fx_gate_rows")) \
        .select("source", "name", "license", "consent", "rows", "distributable")


@query("refused_by_source", f"""
select source, count(*) as refused from @fx_gate_rows
where not (source not in ('shadow_log', 'consented') and license in ({OPEN}) or (source = 'consented' and consent = 'release'))
group by source""")
def _(spark, sf):
    return P.refusal_report(fixture(spark, sf, "fx_gate_rows"), P.gate_trainable())


@query("registered_sources", """
select f.source, s.license, count(*) as rows from @fx_gate_rows f join (values ('ami', 'CC-BY-4.0'),
  ('common_voice', 'CC0-1.0'), ('consented', 'consent'), ('custom', null), ('shadow_log', 'none')) s(source, license)
  on f.source = s.source group by f.source, s.license""")
def _(spark, sf):
    # The registry's size is fixed, so joining it as a broadcast table is bounded.
    reg = P.source_registry(spark).where("registry = 'gate'").select("source", "license")
    d = fixture(spark, sf, "fx_gate_rows").select("source")
    return d.join(F.broadcast(reg), "source").groupBy("source", "license") \
        .agg(F.count(F.lit(1)).alias("rows"))


# -- features and decisions -----------------------------------------------------------------

@query("gate_context_features", """
select row_id, round(ln(1.0 + least(since_ai, 3600.0)), 6) as since_ai_log,
  cast(least(ignored_run, 5) as double) as ignored_run,
  case when ignored_run = 0 and row_id % 2 = 0 then 1.0 else 0.0 end::double as accepted_recently,
  case when not voice_confident then 0.5 when is_wearer then 1.0 else 0.0 end::double as is_wearer,
  case when voice_confident then 1.0 else 0.0 end::double as voice_confident,
  0.5::double as p_own, round(seconds, 6) as duration,
  case when awaiting_answer then 1.0 else 0.0 end::double as awaiting_answer
from @fx_gate_rows""")
def _(spark, sf):
    f = G.gate_features(G.GateInputs())
    return gate_rows(spark, sf).select("row_id", *[
        (F.round(f[n], 6) if n in ("since_ai_log", "duration") else f[n]).alias(n)
        for n in ("since_ai_log", "ignored_run", "accepted_recently", "is_wearer",
                  "voice_confident", "p_own", "duration", "awaiting_answer")])


@query("manifest_context", """
select event_id, case when event_id % 4 = 0 then 1e9 else (event_id % 60)::double end as since_ai,
  event_id % 3 = 0 as awaiting_answer, event_id % 2 = 0 as voice_confident,
  case when event_id % 2 = 0 and event_id % 10 <> 8 then event_id % 10 = 0 end as is_wearer,
  case when event_id % 2 = 0 then (event_id % 100) / 100.0 end::double as p_own,
  event_id % 4 as ignored_run
from events""")
def _(spark, sf):
    d = run_sql(spark, sf, """select event_id,
      case when event_id % 4 = 0 then ' ' else cast(event_id % 60 as string) end as since_ai,
      case when event_id % 3 = 0 then ' Yes' else 'no' end as awaiting_answer,
      case when event_id % 2 = 0 then 'TRUE' else '' end as voice_confident,
      case when event_id % 10 = 8 then '' when event_id % 10 = 0 then 'y' else '0' end as is_wearer,
      cast((event_id % 100) / 100.0 as string) as p_own, '' as confirming,
      cast(null as string) as offer_pending, cast(event_id % 4 as string) as ignored_run,
      '' as accepted_recently from events""")
    c = G.context_from_manifest(F.lit(1.0), F.lit(1.0))
    return d.select("event_id", c.since_ai.alias("since_ai"),
                    c.awaiting_answer.alias("awaiting_answer"),
                    c.voice_confident.alias("voice_confident"), c.is_wearer.alias("is_wearer"),
                    c.p_own.alias("p_own"),
                    F.size(c.recent_verdicts).cast("long").alias("ignored_run"))


@query("features_to_context", f"""
select row_id, round({SINCE}, 4) as since_ai, awaiting_answer >= 0.5 as awaiting_answer,
  case when voice_confident >= 0.5 then is_wearer >= 0.5 end as is_wearer,
  case when voice_confident >= 0.5 then p_own end as p_own,
  case when ignored_run > 0 then ignored_run::int when accepted_recently >= 0.5 then 1 else 0 end as verdicts
from @fx_feature_rows""")
def _(spark, sf):
    c = G.context_from_features()
    return feature_rows(spark, sf).select(
        "row_id", F.round(c.since_ai, 4).alias("since_ai"),
        c.awaiting_answer.alias("awaiting_answer"), c.is_wearer.alias("is_wearer"),
        c.p_own.alias("p_own"), F.size(c.recent_verdicts).alias("verdicts"))


@query("gate_rule_decisions", f"""
with r as ({RULE_SQL})
select row_id, round(1.0 / (1.0 + exp(-logit)), 4) as gate_confidence, must,
  must is null and licensed and 1.0 / (1.0 + exp(-logit)) < 0.25 as would_skip,
  case when must is null and licensed and 1.0 / (1.0 + exp(-logit)) < 0.25 then '' else coalesce(must, '') end as reason
from r""")
def _(spark, sf):
    return G.gate_decide(gate_rows(spark, sf), G.GateInputs(), "skip").select(
        "row_id", "gate_confidence", "must", "would_skip", "reason")


@query("gate_signal_totals", """
with s as (
  select 'bias' as signal, 1.2 as w from @fx_gate_rows
  union all select 'cold_conversation', -1.1 from @fx_gate_rows where since_ai >= 20
  union all select 'very_cold_conversation', -0.7 from @fx_gate_rows where since_ai >= 60
  union all select 'ignored_run', -0.55 * least(ignored_run, 3) from @fx_gate_rows where ignored_run > 0
  union all select 'accepted_recently', 0.9 from @fx_gate_rows where ignored_run = 0 and row_id % 2 = 0
  union all select 'not_wearer', -3.0 from @fx_gate_rows where voice_confident and not is_wearer
  union all select 'very_long', -0.8 from @fx_gate_rows where seconds >= 10
  union all select 'very_short', -0.5 from @fx_gate_rows where seconds <= 1.2
  union all select 'low_vad_confidence', -0.6 from @fx_gate_rows where confidence < 0.90)
select signal, count(*) as fired, round(sum(w)::double, 2) as weight from s group by signal""")
def _(spark, sf):
    d = G.gate_decide(gate_rows(spark, sf), G.GateInputs(), "shadow")
    return d.select(F.explode("gate_signals").alias("s")).groupBy(F.col("s.signal").alias("signal")) \
        .agg(F.count(F.lit(1)).alias("fired"), F.round(F.sum("s.w"), 2).alias("weight"))


@query("gate_learned_decisions", f"""
with d as ({DECIDED_SQL}) select row_id, p as learned_confidence, why as learned_reason, would_skip from d""")
def _(spark, sf):
    return decided(spark, sf, MODEL).select("row_id", "learned_confidence", "learned_reason",
                                            "would_skip")


@query("gate_counters", f"""
with r as ({RULE_SQL}), d as (select *, must is null and licensed and 1.0 / (1.0 + exp(-logit)) < 0.25 as w from r)
select count(*) as scored, count(*) filter (w) as would_skip, count(*) filter (w) as skipped,
  count(*) filter (must is not null) as never_skip from d""")
def _(spark, sf):
    return G.gate_counters(G.gate_decide(gate_rows(spark, sf), G.GateInputs(), "skip"))


@query("gate_early_checks", """
select row_id, coalesce(confirming or awaiting_answer or since_ai < 20, false)
    or not (since_ai >= 60 and ignored_run >= 2) as worth_acknowledging,
  true as worth_head_start
from @fx_gate_rows""")
def _(spark, sf):
    inp = G.GateInputs()
    return gate_rows(spark, sf).select(
        "row_id", G.worth_acknowledging(inp).alias("worth_acknowledging"),
        G.worth_head_start(inp).alias("worth_head_start"))


@query("gate_log_records", f"""
with r as ({RULE_SQL})
select row_id, round(round(1.0 / (1.0 + exp(-logit)), 4), 3) as confidence,
  must is null and licensed and 1.0 / (1.0 + exp(-logit)) < 0.25 as would_skip,
  case when must is null and licensed and 1.0 / (1.0 + exp(-logit)) < 0.25 then '' else coalesce(must, '') end as reason
from r""")
def _(spark, sf):
    d = G.gate_decide(gate_rows(spark, sf), G.GateInputs(), "shadow") \
        .withColumn("log", G.gate_log())
    return d.select("row_id", F.get_json_object("log", "$.confidence").cast("double")
                    .alias("confidence"),
                    F.get_json_object("log", "$.would_skip").cast("boolean").alias("would_skip"),
                    F.get_json_object("log", "$.reason").alias("reason"))


@query("gate_model_checks", """
select event_id % 7 as model, case when event_id % 7 = 1 then 'model vectors must have 20 entries'
  when event_id % 7 = 2 then 'model contains non-finite values' end as problem, count(*) as n
from events group by all""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id % 7 as model from events")
    w = F.array_repeat(F.lit(0.5), F.when(F.col("model") == 1, 3).otherwise(20))
    mean = F.array_repeat(F.when(F.col("model") == 2, float("nan")).otherwise(0.0), 20)
    names = F.array(*[F.lit(n) for n in V.FEATURE_NAMES])
    return d.withColumn("problem", G.model_problem(names, w, mean, F.array_repeat(F.lit(1.0), 20))) \
        .groupBy("model", "problem").agg(F.count(F.lit(1)).alias("n"))


# -- thresholds and reports ------------------------------------------------------------------

@query("gate_skip_threshold", f"""
with d as ({DECIDED_SQL}), n as (select count(*) filter (label in ('assistant_directed', 'uncertain')) as n_pos from d),
x as (select p, row_number() over (order by p) - 1 as rk from d where may_skip and label in ('assistant_directed', 'uncertain'))
select least(coalesce((select p from x, n where rk = floor(0.02 * n_pos + 1e-9)), 0.5), 0.5) as threshold""")
def _(spark, sf):
    d = G.eligibility(feature_rows(spark, sf), MODEL)
    return G.choose_threshold(d, F.col("p"), F.col("may_skip"),
                              F.col("label").isin(V.ASSISTANT, V.UNCERTAIN), 0.02)


@query("gate_eligibility", f"with d as ({DECIDED_SQL}) select row_id, p, may_skip from d")
def _(spark, sf):
    return G.eligibility(feature_rows(spark, sf), MODEL).select("row_id", "p", "may_skip")


@query("gate_class_report", f"""
with d as ({DECIDED_SQL})
select label, count(*) as n, count(*) filter (would_skip) as skipped,
  round(count(*) filter (would_skip) / count(*), 4) as skip_rate from d group by label""")
def _(spark, sf):
    return Q.gate_classes(decided(spark, sf, MODEL))


WILSON = """least(1.0, ({k}::double / {n} + {z2} / (2.0 * {n}) + {z} * sqrt({k}::double / {n} * (1 - {k}::double / {n}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n}))"""


def wilson(k, n, z=1.96):
    return WILSON.format(k=k, n=n, z=f"{z}::double", z2=f"({z}::double * {z}::double)")


@query("gate_headline_report", f"""
with d as ({DECIDED_SQL}), a as (select count(*) as rows, count(*) filter (label = 'assistant_directed') as n,
  count(*) filter (label = 'assistant_directed' and would_skip) as k,
  count(*) filter (label = 'assistant_directed' and awaiting_answer >= 0.5) as asked from d)
select rows, round(k / n, 4) as false_skip_rate, round({wilson('k', 'n')}, 4) as false_skip_upper95,
  asked as asked_a_question_rows from a""")
def _(spark, sf):
    return Q.gate_headline(decided(spark, sf, MODEL))


@query("gate_worst_groups", f"""
with d as ({DECIDED_SQL}), u as (
  select 'speaker' as key, speaker as value, would_skip from d where label = 'assistant_directed' and speaker <> ''
  union all select 'session', session, would_skip from d where label = 'assistant_directed' and session <> ''
  union all select 'mic', mic, would_skip from d where label = 'assistant_directed' and mic <> ''),
g as (select key, value, count(*) as n, count(*) filter (would_skip) as k from u group by all),
r as (select *, row_number() over (partition by key order by k / n desc, n desc, value desc) as rk, count(*) over (partition by key) as groups from g)
select key, groups, value as worst, round(k / n, 4) as worst_false_skip_rate, n as worst_n from r where rk = 1""")
def _(spark, sf):
    return Q.gate_worst_groups(decided(spark, sf, MODEL))


@query("gate_latency", """
select round(quantile_cont(feature_ms, 0.5), 3) as p50, round(quantile_cont(feature_ms, 0.95), 3) as p95
from @fx_feature_rows where feature_ms > 0""")
def _(spark, sf):
    return Q.latency_percentiles(feature_rows(spark, sf).where("feature_ms > 0"),
                                 F.col("feature_ms")).select("p50", "p95")


CONTRIB = ", ".join(f"{{'logit': {t}, 'i': {i}, 'f': '{n}'}}"
                    for i, (t, n) in enumerate(zip(terms(), V.FEATURE_NAMES)))


@query("gate_wrong_skips", f"""
with d as ({DECIDED_SQL}), c as (select row_id, speaker, p, list_sort([{CONTRIB}]) as s
  from d where label = 'assistant_directed' and would_skip)
select row_id, speaker, p, s[1].f as first, s[2].f as second, s[3].f as third, round(s[1].logit, 3) as pushed from c""")
def _(spark, sf):
    d = Q.gate_misses(decided(spark, sf, MODEL), G.explain(MODEL))
    return d.select("row_id", "speaker", "p", F.col("why")[0]["feature"].alias("first"),
                    F.col("why")[1]["feature"].alias("second"),
                    F.col("why")[2]["feature"].alias("third"), F.col("why")[0]["logit"].alias("pushed"))


@query("gate_rules_against_model", f"""
with d as ({DECIDED_SQL}), r as (select row_id, case when {CONTEXT_MUST} is null and voice_confident >= 0.5
    and (is_wearer < 0.4 or duration >= 10 or vad_confidence < 0.90)
    and 1.0 / (1.0 + exp(-(1.2 + case when {SINCE} >= 20 then -1.1 else 0 end + case when {SINCE} >= 60 then -0.7 else 0 end
      - 0.55 * least(ignored_run, 3) + case when ignored_run = 0 and accepted_recently >= 0.5 then 0.9 else 0 end
      + case when voice_confident >= 0.5 and is_wearer < 0.4 then -3.0 else 0 end
      + case when duration >= 10 then -0.8 when duration <= 1.2 then -0.5 else 0 end
      + case when vad_confidence < 0.90 then -0.6 else 0 end))) < 0.25 then true else false end as w from @fx_feature_rows),
u as (select 'model' as layer, label, would_skip as w from d union all
  select 'rules', f.label, r.w from r join @fx_feature_rows f using (row_id)),
a as (select layer, count(*) as rows, count(*) filter (label = 'assistant_directed') as n,
  count(*) filter (label = 'assistant_directed' and w) as k from u group by layer)
select layer, rows, round(k / n, 4) as false_skip_rate, round({wilson('k', 'n')}, 4) as false_skip_upper95 from a""")
def _(spark, sf):
    from whofor.plans.gate_training import evaluate_gate
    return evaluate_gate(feature_rows(spark, sf), MODEL).drop("asked_a_question_rows")


# -- splits and training ------------------------------------------------------------------------

@query("linked_components", """
select concat('session=', session) as component, count(*) as rows from @fx_gate_rows group by session""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").select("row_id", "speaker", "session", "room")
    return S.row_components(d, ["speaker", "session", "room"], "row_id") \
        .groupBy("component").agg(F.count(F.lit(1)).alias("rows"))


@query("split_leaks", "select ''::varchar as key_value, 0::bigint as splits where false")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").select("row_id", "label", "speaker", "session", "room")
    return S.check_disjoint(S.group_split(d))


@query("split_label_counts", """
select cast(row_id % 3 as int) as split, label, count(*) as rows from @fx_gate_rows group by all""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").withColumn("split", (F.col("row_id") % 3).cast("int"))
    return S.split_counts(d)


@query("split_overlaps", """
with u as (select concat('speaker=', speaker) as key_value, row_id % 3 as split from @fx_gate_rows
  union all select concat('session=', session), row_id % 3 from @fx_gate_rows)
select key_value, count(distinct split) as splits from u group by key_value having count(distinct split) > 1""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").withColumn("split", (F.col("row_id") % 3).cast("int"))
    return S.check_disjoint(d, ("speaker", "session"))


@query("train_gate_model")
def _(spark, sf):
    from whofor.plans.gate_training import GateTraining, train_gate
    d = feature_rows(spark, sf).drop("feature_ms")
    r = train_gate(d, GateTraining(max_false_skip=0.05, ignore_uncertain=True))
    return r.headline.withColumn("threshold", F.lit(r.model.threshold))


@query("fit_gate_weights")
def _(spark, sf):
    m = M.platt_calibrate(feature_rows(spark, sf).where("row_id % 5 = 0"),
                          M.fit_logistic(feature_rows(spark, sf).where("row_id % 5 <> 0")))
    return M.model_row(spark, m)


# -- the shadow log -------------------------------------------------------------------------------

def turns(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) * 8 + F.col("ord")
    return R.gate_turns(fixture(spark, sf, "fx_turn_log"), at,
                        ["would_skip", "latency_ms", "feature_ms"])


@query("gate_turns", "select turn, would_skip, latency_ms, feature_ms, verdict from @fx_turns")
def _(spark, sf):
    return turns(spark, sf)


@query("would_skip_by_verdict", """
select verdict, count(*) as turns from @fx_turns where would_skip group by verdict""")
def _(spark, sf):
    return R.would_skip_by_verdict(turns(spark, sf))


@query("gate_shadow_report", """
select count(*) as scored, count(*) filter (would_skip) as would_skip,
  count(*) filter (would_skip and verdict = 'accepted') as would_skip_but_accepted,
  round(quantile_cont(latency_ms, 0.5), 3) as latency_p50, round(quantile_cont(latency_ms, 0.95), 3) as latency_p95,
  round(quantile_cont(nullif(feature_ms, 0), 0.5), 3) as feature_p50,
  round(quantile_cont(nullif(feature_ms, 0), 0.95), 3) as feature_p95
from @fx_turns""")
def _(spark, sf):
    return R.gate_shadow_report(turns(spark, sf))


@query("dangerous_skips", "select turn, verdict from @fx_turns where would_skip and verdict = 'accepted'")
def _(spark, sf):
    return R.dangerous_skips(turns(spark, sf)).select("turn", "verdict")


@query("shadow_feature_rows", """
select concat('t', cast(row_id as string)) as turn, 'shadow_log' as source, 'none' as license,
  case when row_id % 3 = 0 then 'accepted' else '' end as intent_verdict, f0_mean, round(since_ai_log, 6) as since_ai_log, ignored_run
from @fx_feature_rows where row_id % 4 <> 0""")
def _(spark, sf):
    d = feature_rows(spark, sf)
    pairs = [x for n in V.FEATURE_NAMES for x in (F.lit(n), F.col(n))]
    full = F.create_map(*pairs)
    t = d.select(F.concat(F.lit("t"), F.col("row_id").cast("string")).alias("turn"), "feature_ms",
                 F.when(F.col("row_id") % 3 == 0, "accepted").otherwise("unknown").alias("verdict"),
                 F.when(F.col("row_id") % 4 == 0, F.map_filter(full, lambda k, v: k != "zcr"))
                 .otherwise(full).alias("features"))
    return R.shadow_feature_rows(t).select("turn", "source", "license", "intent_verdict",
                                           "f0_mean", F.round("since_ai_log", 6).alias("since_ai_log"),
                                           "ignored_run")


def pairs(spark, sf):
    d = fixture(spark, sf, "fx_decision_log")

    def one(event, prefix, ms):
        return d.where(F.col(f"{prefix}_route").isNotNull()).select(
            "turn", F.lit(event).alias("event"), F.lit(1).alias("ord"),
            F.col(f"{prefix}_route").alias("route"), F.col(f"{prefix}_intent").alias("intent"),
            F.create_map(F.lit("n"), F.col(f"{prefix}_slot").cast("string")).alias("slots"),
            F.lit(None).cast("double").alias("p_assistant"),
            F.lit(None).cast("string").alias("transcript"), ms.alias("ms"))
    log = one("slu_decided", "fast", F.col("fast_ms")).unionByName(
        one("slu_system_two", "slow", F.lit(None).cast("double")))
    return R.decision_pairs(log, ["ord"])


KIND = """case when slow_route is null then null when fast_route = 'ignore' and slow_route = 'act' then 'would_have_missed'
  when fast_route = 'act' and slow_route <> 'act' then 'would_have_acted_on_ignored'
  when fast_route = 'act' and (fast_intent <> slow_intent or fast_slot <> slow_slot) then 'would_have_acted_differently' end"""


@query("fast_slow_agreement", """
select fast_route || ' / ' || coalesce(slow_route, 'system_two_not_run') as routes, count(*) as turns
from @fx_decision_log group by 1""")
def _(spark, sf):
    return R.agreement_matrix(pairs(spark, sf))


@query("fast_slow_disagreements", f"""
select turn, {KIND} as kind from @fx_decision_log where {KIND} is not null""")
def _(spark, sf):
    return R.disagreement(pairs(spark, sf)).where("kind is not null").select("turn", "kind")


@query("fast_slow_report", f"""
select count(*) as turns, count(*) filter (fast_route in ('act', 'ignore')) as would_have_avoided_stt,
  count(*) filter ({KIND} = 'would_have_missed') as would_have_missed,
  count(*) filter ({KIND} = 'would_have_acted_on_ignored') as would_have_acted_on_ignored,
  count(*) filter ({KIND} = 'would_have_acted_differently') as would_have_acted_differently,
  round(quantile_cont(fast_ms, 0.5), 2) as fast_p50_ms, round(quantile_cont(fast_ms, 0.95), 2) as fast_p95_ms
from @fx_decision_log""")
def _(spark, sf):
    return R.fast_vs_slow_report(pairs(spark, sf))


AGREE = """case when fast_route = 'escalate' then 'escalated'
  when fast_route = 'ignore' then case when coalesce(slow_route, 'ignore') = 'act' then 's1_would_miss' else 'agree' end
  when coalesce(slow_route, 'ignore') <> 'act' then 's1_would_act_on_ignored'
  when fast_intent = slow_intent and fast_slot = slow_slot then 'agree' else 'different_intent' end"""


def agreed(spark, sf):
    d = fixture(spark, sf, "fx_decision_log")

    def slots(c):
        return F.create_map(F.lit("n"), F.col(c).cast("string"))
    return d.select("turn", F.col("fast_route").alias("route"), F.col("fast_ms").alias("ms"),
                    R.agreement(F.col("fast_route"), F.col("fast_intent"), slots("fast_slot"),
                                F.col("slow_route") == "act", F.col("slow_intent"),
                                slots("slow_slot")).alias("agreement"))


@query("live_agreement", f"select turn, {AGREE} as agreement from @fx_decision_log")
def _(spark, sf):
    return agreed(spark, sf).select("turn", "agreement")


@query("live_totals", f"""
with a as (select fast_route as route, {AGREE} as g from @fx_decision_log),
t as (select count(*) as utterances, count(*) filter (route in ('act', 'ignore')) as decided_fast,
  count(*) filter (g in ('agree', 's1_would_miss', 's1_would_act_on_ignored', 'different_intent')) as compared,
  count(*) filter (g = 'agree') as agreed from a)
select *, round(decided_fast / utterances, 3) as stt_avoided, round(agreed / compared, 3) as agreement_rate from t""")
def _(spark, sf):
    return R.live_totals(agreed(spark, sf))


@query("live_recent_latency", """
with l as (select fast_ms from @fx_decision_log order by turn desc limit 200)
select round(quantile_cont(fast_ms, 0.5), 1) as p50_ms from l""")
def _(spark, sf):
    return R.recent_latency(agreed(spark, sf), [F.desc("turn")], "turn")


@query("latest_labels", """
select user_id as id, arg_max(event_type, (ts, event_id)) as label from events group by user_id""")
def _(spark, sf):
    d = run_sql(spark, sf, "select user_id as id, event_type as label, ts, event_id from events")
    return R.latest_labels(d, ["ts", "event_id"]).select("id", "label")


SESSION_VECTORS = """select vec_id as id, 'logmel:64:stats' as spec from embeddings
  union all select vec_id, 'gate:20' from embeddings where vec_id % 10 <> 3"""


@query("saved_session_vectors", """
select 'try-1-' || cast(vec_id as varchar) as id, 'logmel:64:stats' as spec from embeddings""")
def _(spark, sf):
    v = run_sql(spark, sf, SESSION_VECTORS)
    rows = run_sql(spark, sf, "select vec_id as id from embeddings")
    return R.save_labelled(rows, v, "try-1", "release", "kitchen", "p1")[1].select("id", "spec")


@query("discarded_clips", """
select vec_id as id, 'logmel:64:stats' as spec from embeddings where label <> 3
union all select vec_id, 'gate:20' from embeddings where vec_id % 10 <> 3 and label <> 3""")
def _(spark, sf):
    v = run_sql(spark, sf, SESSION_VECTORS)
    rows = run_sql(spark, sf, "select vec_id as id, label from embeddings")
    return R.discard(rows, v, rows.where("label = 3"))[1]


@query("session_summary", """
with t as (select session, count(*) as rows from @fx_gate_rows group by session),
l as (select session, string_agg(label || ':' || n, ',' order by label) as per_label from (
  select session, label, count(*) as n from @fx_gate_rows group by all) group by session),
s as (select session, string_agg(step || ':' || n, ',' order by step) as per_step from (
  select session, cast(row_id % 7 as varchar) as step, count(*) as n from @fx_gate_rows group by all) group by session)
select session, rows, per_label, per_step from t join l using (session) join s using (session)""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_gate_rows").select(
        "session", F.col("label").alias("g_addressed"), (F.col("row_id") % 7).alias("step"))

    def text(c):
        return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(
            ":", e["key"], e["value"].cast("string"))), ",")
    return R.session_summary(d).select("session", "rows", text("per_g_addressed").alias("per_label"),
                                       text("per_step").alias("per_step"))


@query("turn_timeline", """
with e as (select turn, event, epoch_us(ts) / 1e6 + ord * 0.125 as t from @fx_turn_log)
select turn, event, row_number() over w as step,
  round((t - lag(t) over w) * 1000.0, 3) as since_previous_ms,
  round((t - first_value(t) over w) * 1000.0, 3) as since_start_ms
from e window w as (partition by turn order by t)""")
def _(spark, sf):
    d = fixture(spark, sf, "fx_turn_log").withColumn(
        "t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + F.col("ord") * 0.125)
    return R.turn_timeline(d, ["t"]).drop("t")
