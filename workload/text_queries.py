"""Addressee signals, conversation context, parsing and labelling queries."""

from dataclasses import replace

from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.operators import catalogue as C
from whofor.operators import context as X
from whofor.operators import conversation as CV
from whofor.operators import corpus as CO
from whofor.operators import parsing as PA
from whofor.operators import signals as S
from whofor.operators import teacher as K
from workload.registry import fixture, query, run_sql

ENGINE = S.SignalSettings(bystanders=("sam", "robin"))


def utterances(spark, sf):
    return fixture(spark, sf, "fx_utterances", spread=True).withColumns({
        "own_voice": F.col("own_voice").cast("double"),
        "llm_score": F.col("llm_score").cast("double")})


def scored(spark, sf):
    ctx = S.TextContext(reliable=F.col("reliable"), own_voice=F.col("own_voice"),
                        llm_score=F.col("llm_score"), driving=F.col("utt_id") % 2 == 0)
    d = utterances(spark, sf)
    return S.classify(d, F.col("text"), ctx, ENGINE)


# -- the same rules as SQL ----------------------------------------------------------------------

def q(text):
    return text.replace("'", "''")


def has(body, pattern):
    return f"regexp_matches({body}, '{q(pattern)}')"


def clean_sql(text):
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


PHYSICAL_VERBS = "pass|hand|grab|carry|fetch|hold|pick|put|throw|shut|open"
PHYSICAL = (r"\b(pass|hand|grab|carry|fetch|hold|pick\s+(?:it|that|this|them|those)\s+up|"
            r"put\s+(?:it|that|this|them)\s+(?:down|back|over|there|here|away)|"
            r"throw|shut\s+the\s+(?:door|window|curtains)|"
            r"open\s+the\s+(?:door|window|curtains|fridge|box|bottle|jar))\b")


def physical_sql(body):
    """No look-behind here: drop what follows "to" and the discourse uses of "hold" first."""
    t = f"regexp_replace({body}, '\\bto ({PHYSICAL_VERBS})\\b', ' ', 'g')"
    t = (f"regexp_replace({t}, '\\bhold (on|that thought|tight|fire|still|steady|your horses)\\b',"
         " ' ', 'g')")
    return has(t, PHYSICAL)


NAME = r"\bn[\s\-\.']*o[\s\-\.']*v[\s\-\.']*a\b"


def vocative_sql(body):
    before = f"regexp_extract({body}, '^(.*?){q(NAME)}', 1)"
    after = f"regexp_extract({body}, '^.*?{q(NAME)}(.*)$', 1)"
    return (f"({has(before, V.PATTERNS['vocative_lead'])} or rtrim({before}) like '%,') and "
            f"{has(after, '^(?:[,.?! ]|$)')}")


def signals_sql(body, reliable, driving, own="own_voice", momentum=None):
    """``momentum`` adds signals of the conversation; these texts then come without bystanders."""
    w = V.SIGNAL_WEIGHTS

    def when(cond, weight):
        return f"case when {cond} then {weight}::double end"
    out = {"bias": f"{w['bias']}::double",
           "assistant_name": when(f"{has(body, NAME)} and {vocative_sql(body)}", w["assistant_name"]),
           "assistant_name_mentioned": when(f"{has(body, NAME)} and not ({vocative_sql(body)})",
                                            w["assistant_name_mentioned"]),
           "bystander_addressed": when(has(body, r"\b(sam|robin)\b"), w["bystander_addressed"])}
    for n in S.PATTERN_SIGNALS:
        out[n] = when(physical_sql(body) if n == "physical_request" else has(body, V.PATTERNS[n]),
                      w[n])
    out["question_mark"] = when(f"{body} like '%?'", w["question_mark"])
    p = f"least(greatest({own}, 0.001::double), 0.999::double)"
    against = f"greatest(-3.0::double, least(0.0::double, ln({p} / (1.0::double - {p}))))"
    out["not_own_voice"] = f"case when {own} is not null and {against} < 0 then round({against}, 3) end"
    if driving:
        lead = f"regexp_replace({body}, '{q(V.PATTERNS['driving_polite_lead'])}', '')"
        out["driving_browser"] = when(
            f"{driving} and not {has(lead, V.PATTERNS['driving_somebody_else'])} and "
            f"{has(body, V.PATTERNS['driving_browser'])}", w["driving_browser"])
    if momentum is not None:
        del out["bystander_addressed"]
        out |= momentum
    strong = " or ".join(f"({out[n]}) is not null" for n in V.STRONG_POSITIVE if n in out)
    words = f"case when {body} = '' then 0 else len(string_split({body}, ' ')) end"
    short = f"({words} <= 2 and {body} not like '%?' and not ({strong}))"
    out["very_short_fragment"] = when(short, w["very_short_fragment"])
    out["long_utterance"] = when(f"not {short} and {words} > 28", w["long_utterance"])
    out["unreliable_transcript"] = when(f"not {reliable}", w["unreliable_transcript"])
    return {n: out[n] for n in S.SIGNAL_ORDER if n in out}


def scored_ctes(source, driving, extra="own_voice, llm_score, reliable", own="own_voice"):
    whole = signals_sql("body", "reliable", driving, own)
    tail = signals_sql("tail_body", "reliable", None, own)
    w_cols = ", ".join(f"{e} as w_{n}" for n, e in whole.items())
    t_cols = ", ".join(f"{e} as t_{n}" for n, e in tail.items())
    merged = {n: (f"coalesce(t_{n}, w_{n})" if n in V.AUDIENCE_SIGNALS else f"t_{n}") for n in tail}
    sum_w = " + ".join(f"coalesce(w_{n}, 0)" for n in whole)
    sum_t = " + ".join(f"coalesce({e}, 0)" for e in merged.values())
    aud_w = " or ".join(f"coalesce(w_{n} < 0, false)" for n in V.AUDIENCE_SIGNALS if n in whole)
    aud_t = " or ".join(f"coalesce({merged[n]} < 0, false)" for n in V.AUDIENCE_SIGNALS if n in tail)
    return f"""u0 as (select utt_id, text, {extra}, {clean_sql('text')} as body,
    regexp_extract(trim(text), '^.*[.!?]\\s+(\\S.*)$', 1) as tail from {source}),
  u1 as (select *, {clean_sql('tail')} as tail_body, tail <> '' and len(string_split({clean_sql('tail')}, ' ')) >= 2 as has_tail from u0),
  u2 as (select *, {w_cols}, {t_cols} from u1),
  u3 as (select *, 1.0 / (1.0 + exp(-({sum_w}))) as p_w, case when has_tail then 1.0 / (1.0 + exp(-({sum_t}))) end as p_t from u2),
  u4 as (select *, coalesce(p_t > p_w, false) as use_tail, greatest(p_w, p_t) as heuristic from u3),
  u5 as (select *, case when use_tail then t_assistant_name is not null else w_assistant_name is not null end
      and not coalesce({own} < 0.35, false) as named, case when use_tail then {aud_t} else {aud_w} end as audience from u4)"""


UTT_CTES = scored_ctes("@fx_utterances", "utt_id % 2 = 0")
DECIDE = """u6 as (select *, case when named or heuristic >= 0.62 then 'accept' when heuristic < 0.34 then 'reject' else 'ambiguous' end as band,
    case when named then 'named' when heuristic >= 0.62 or heuristic < 0.34 then 'heuristic' when llm_score is null then 'heuristic_default' else 'llm' end as method,
    case when named then 1.0 when heuristic >= 0.62 or heuristic < 0.34 or llm_score is null then heuristic
      else 0.65::double * llm_score + 0.35::double * heuristic end as confidence from u5)"""


@query("addressee_decisions", f"""
with {UTT_CTES}, {DECIDE}
select utt_id, round(heuristic, 4) as heuristic, band, method, round(confidence, 4) as confidence,
  confidence >= 0.62 as ai_intent, case when confidence >= 0.62 then true when audience then false end as ai_directed
from u6""")
def _(spark, sf):
    return scored(spark, sf).select(
        "utt_id", F.round("heuristic", 4).alias("heuristic"), "band", "method",
        F.round("confidence", 4).alias("confidence"), "ai_intent", "ai_directed")


SIGNAL_UNION = " union all ".join(
    f"select '{n}' as signal, case when use_tail then "
    + (f"coalesce(t_{n}, w_{n})" if n in V.AUDIENCE_SIGNALS else
       ("null" if n == "driving_browser" else f"t_{n}")) + f" else w_{n} end as w from u5"
    for n in signals_sql("body", "reliable", "utt_id % 2 = 0"))


@query("addressee_signal_totals", f"""
with {UTT_CTES}, s as ({SIGNAL_UNION})
select signal, count(*) as fired, round(sum(w), 2) as weight from s where w is not null group by signal""")
def _(spark, sf):
    return scored(spark, sf).select(F.explode("signals").alias("s")) \
        .groupBy(F.col("s.signal").alias("signal")) \
        .agg(F.count(F.lit(1)).alias("fired"), F.round(F.sum("s.w"), 2).alias("weight"))


# Every given text, whole and in every language. The checking engine's word ends know ASCII letters
# only, so there other letters are replaced by one; the rules look for ASCII words.
TEXT_CTES = scored_ctes("(select * replace (regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g'), '\\s+', ' ', 'g') as text) from @fx_texts)",
                        "utt_id % 2 = 2")


def scored_texts(spark, sf):
    ctx = S.TextContext(reliable=F.col("reliable"), own_voice=F.col("own_voice"),
                        llm_score=F.col("llm_score"), driving=F.lit(False))
    d = fixture(spark, sf, "fx_texts", spread=True).withColumn("own_voice", F.col("own_voice").cast("double")) \
        .withColumn("llm_score", F.col("llm_score").cast("double"))
    # Whole documents seldom repeat.
    return S.classify(d, F.col("text"), ctx, replace(ENGINE, read_once=False))


@query("text_decisions", f"""
with {TEXT_CTES}, {DECIDE}
select utt_id, round(heuristic, 4) as heuristic, band, method, round(confidence, 4) as confidence from u6""")
def _(spark, sf):
    return scored_texts(spark, sf).select("utt_id", F.round("heuristic", 4).alias("heuristic"), "band", "method",
                                          F.round("confidence", 4).alias("confidence"))


@query("text_signal_totals", f"""
with {TEXT_CTES}, s as ({SIGNAL_UNION})
select signal, count(*) as fired, round(sum(w), 2) as weight from s where w is not null group by signal""")
def _(spark, sf):
    return scored_texts(spark, sf).select(F.explode("signals").alias("s")) \
        .groupBy(F.col("s.signal").alias("signal")) \
        .agg(F.count(F.lit(1)).alias("fired"), F.round(F.sum("s.w"), 2).alias("weight"))


@query("addressee_quality", f"""
with {UTT_CTES}, {DECIDE}, g as (select u6.*, f.g_addressed from u6 join @fx_utterances f using (utt_id))
select band, count(*) as n, count(*) filter (g_addressed = 'assistant_directed' and confidence < 0.62) as missed,
  count(*) filter (g_addressed <> 'assistant_directed' and confidence >= 0.62) as false_activations from g group by band""")
def _(spark, sf):
    gold = F.col("g_addressed") == V.ASSISTANT
    return scored(spark, sf).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(gold & ~F.col("ai_intent"), 1).otherwise(0)).alias("missed"),
        F.sum(F.when(~gold & F.col("ai_intent"), 1).otherwise(0)).alias("false_activations"))


@query("scored_clauses", f"""
with {UTT_CTES} select utt_id, tail as scored_clause from u5 where use_tail""")
def _(spark, sf):
    return scored(spark, sf).where("scored_clause is not null").select("utt_id", "scored_clause")


FIRED = " union all ".join(
    f"select utt_id, {i} as o, '{n}' as signal, case when use_tail then "
    + (f"coalesce(t_{n}, w_{n})" if n in V.AUDIENCE_SIGNALS else
       ("null" if n == "driving_browser" else f"t_{n}")) + f" else w_{n} end as w from u5"
    for i, n in enumerate(signals_sql("body", "reliable", "utt_id % 2 = 0")))


@query("addressee_explanations", f"""
with {UTT_CTES}, f as (select *, row_number() over (partition by utt_id order by -abs(w), o) as rk from ({FIRED}) where w is not null),
y as (select utt_id, string_agg(signal || case when w >= 0 then '+' else '' end || printf('%.2f', w + sign(w) * 1e-9), ', ' order by rk) as why from f where rk <= 6 group by utt_id),
h as (select utt_id, bool_or(signal like 'assistant_name%') as n, bool_or(signal = 'bystander_addressed') as b, bool_or(signal = 'not_own_voice') as v,
  bool_or(signal = 'tool_domain') as t, count(*) as signals from f group by utt_id),
s as (select *, case when use_tail then tail_body else body end as said from u5)
select utt_id, why, case when n then regexp_extract(said, '{q(NAME)}') end as heard_name, case when b then case when {has('said', chr(92) + 'bsam' + chr(92) + 'b')} then 'sam' else 'robin' end end as heard_bystander,
  case when v then printf('p_own=%.2f', own_voice) end as voice, case when t then regexp_extract(said, '{q(V.PATTERNS["tool_domain"])}') end as domain, signals from s join y using (utt_id) join h using (utt_id)""")
def _(spark, sf):
    d = scored(spark, sf).withColumn("r", S.decision_json())
    logged = F.from_json("r", "signals array<struct<signal string, w double, match string>>")["signals"]

    def match(like):
        return F.get(F.filter(logged, lambda s: s["signal"].like(like)), F.lit(0))["match"]
    return d.select("utt_id", S.explain().alias("why"), match("assistant_name%").alias("heard_name"),
                    match("bystander_addressed").alias("heard_bystander"), match("not_own_voice").alias("voice"),
                    match("tool_domain").alias("domain"), F.size(logged).cast("long").alias("signals"))


STEM = """case when w like '%ing' and length(w) > 5 then w[:-4] when w like '%ed' and length(w) > 4 then w[:-3]
  when w like '%s' and length(w) > 3 and not regexp_matches(w, '(ss|us|is|os|as)$') then w[:-2] else w end"""


def content_sql(text):
    stop = ", ".join(f"'{s}'" for s in V.STOPWORDS)
    heads = (f"list_transform(regexp_extract_all(lower({text}), '[a-z]+(?:''[a-z]+)?'), "
             "lambda w: regexp_replace(w, 'n''t.*$|''.*$', ''))")
    kept = f"list_filter({heads}, lambda w: length(w) >= 3 and w not in ({stop}))"
    cut = f"list_transform({kept}, lambda w: {STEM})"
    stem = f"list_transform({cut}, lambda w: regexp_replace(w, '^(.{{3,}})e$', '\\1'))"
    return f"list_distinct(list_filter({stem}, lambda w: w <> '' and w not in ({stop})))"


@query("topic_words", f"""
with w as (select unnest({content_sql('text')}) as word from (select text from documents union all select text from @fx_utterances))
select word, count(*) as n from w group by word""")
def _(spark, sf):
    d = run_sql(spark, sf, "select text from documents union all select text from @fx_utterances")
    return d.select(F.explode(T.content_words(F.col("text"))).alias("word")) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def only_sql(text, name):
    filler = "|".join((*V.FOLLOWUP_FILLER, "nova"))
    rest = f"regexp_replace(lower({text}), '{q(V.PATTERNS[name])}', ' ')"
    left = (f"trim(regexp_replace(regexp_replace({rest}, '\\b(?:{filler})\\b|[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
    return (f"{has(f'lower({text})', V.PATTERNS[name])} and "
            f"(case when {left} = '' then 0 else len(string_split({left}, ' ')) end) <= 1")


@query("followup_requests", f"""
select utt_id, {only_sql('text', 'wants_repeat')} as wants_repeat, {only_sql('text', 'wants_more_detail')} as wants_more_detail
from @fx_utterances""")
def _(spark, sf):
    return utterances(spark, sf).select("utt_id", T.wants_repeat(F.col("text")).alias("wants_repeat"),
                                        T.wants_more_detail(F.col("text")).alias("wants_more_detail"))


# -- context ------------------------------------------------------------------------------------

AS_OF = """c0 as (select *, row_number() over (partition by conv_id order by at_s, turn) - 1 as pos from @fx_context),
c1 as (select *, last_value(case when role = 'assistant' then text end ignore nulls) over w as last_ai_text,
  last_value(case when role = 'assistant' then at_s end ignore nulls) over w as last_ai_at,
  last_value(case when role = 'user' and trim(text) <> '' then text end ignore nulls) over w as last_user_text
  from c0 window w as (partition by conv_id order by pos rows between unbounded preceding and 1 preceding))"""
USERS = "c2 as (select * from c0 where role = 'user')"


def context(spark, sf):
    return fixture(spark, sf, "fx_context").withColumn("at_s", F.col("at_s").cast("double"))


@query("assistant_recency", f"""
with {AS_OF} select conv_id, turn, case when last_ai_at is null then 1e9 else greatest(0, at_s - last_ai_at) end::double as since_ai,
  coalesce(rtrim(last_ai_text) like '%?', false) as awaiting_answer,
  md5(coalesce(last_ai_text, '')) as ai_md5, md5(coalesce(last_user_text, '')) as user_md5 from c1""")
def _(spark, sf):
    d = X.last_words(context(spark, sf))
    return d.select("conv_id", "turn", X.since_ai(F.col("at_s"), F.col("last_ai_at")).alias("since_ai"),
                    X.awaiting_answer(F.col("last_ai_text")).alias("awaiting_answer"),
                    F.md5("last_ai_text").alias("ai_md5"), F.md5("last_user_text").alias("user_md5"))


@query("retained_turns", """
with c as (select *, row_number() over (partition by conv_id order by at_s desc, turn desc) as rk,
  max(at_s) over (partition by conv_id) as now from @fx_context)
select conv_id, turn from c where at_s >= now - 60 and rk <= 4""")
def _(spark, sf):
    return X.retain(context(spark, sf), 60.0, 4).select("conv_id", "turn")


@query("recent_utterances", f"""
with {AS_OF}, {USERS} select conv_id, turn, coalesce(md5(string_agg(text, '|') over w), md5('')) as recent from c2
window w as (partition by conv_id order by pos rows between 3 preceding and 1 preceding)""")
def _(spark, sf):
    return X.recent_utterances(context(spark, sf)).select(
        "conv_id", "turn", F.md5(F.array_join("recent", "|")).alias("recent"))


@query("recent_verdicts", f"""
with {AS_OF}, {USERS} select conv_id, turn, coalesce(string_agg(coalesce(ai_directed::varchar, 'null'), ',') over w, '') as verdicts from c2
window w as (partition by conv_id order by pos rows between 4 preceding and 1 preceding)""")
def _(spark, sf):
    return X.recent_verdicts(context(spark, sf)).select(
        "conv_id", "turn", F.array_join(F.transform("recent_verdicts", lambda v: F.coalesce(
            v.cast("string"), F.lit("null"))), ",").alias("verdicts"))


@query("overheard_speech", f"""
with {AS_OF}, {USERS}, p as (select a.conv_id, a.turn, a.pos, trim(regexp_replace(b.text, '\\s+', ' ', 'g')) as said, b.pos as bpos
  from c2 a join c2 b on a.conv_id = b.conv_id and b.pos < a.pos and b.pos >= a.pos - 40 and b.at_s >= a.at_s - 180
  and not coalesce(b.ai_directed, false) and b.reliable),
r as (select *, row_number() over (partition by conv_id, turn order by bpos desc) as rk from p where said like '% %'),
g as (select conv_id, turn, string_agg(substr(said, 1, 90), '|' order by bpos) as heard from r where rk <= 4 group by conv_id, turn)
select c2.conv_id, c2.turn, md5(coalesce(heard, '')) as overheard from c2 left join g using (conv_id, turn)""")
def _(spark, sf):
    return X.overheard(context(spark, sf)).select(
        "conv_id", "turn", F.md5(F.array_join("overheard", "|")).alias("overheard"))


@query("rendered_messages", f"""
with {AS_OF}, m as (select conv_id, turn, string_agg(case when role <> 'system' then role || ':' || length(text) end, ',') over w as messages from c0
  window w as (partition by conv_id order by pos rows between 12 preceding and 1 preceding))
select conv_id, turn, coalesce(messages, '') as messages from m""")
def _(spark, sf):
    # The given tables call the third role "system"; it stands in for tool turns.
    d = context(spark, sf).withColumn("role", F.when(F.col("role") == "system", "tool")
                                      .otherwise(F.col("role")))
    return X.render_messages(d).select("conv_id", "turn", F.array_join(F.transform(
        "messages", lambda m: F.concat_ws(":", m["role"], F.length(m["content"]).cast("string"))),
        ",").alias("messages"))


@query("conversation_snapshots", f"""
with {AS_OF}, {USERS}, v as (select conv_id, turn, count(*) over w as heard from c2
  window w as (partition by conv_id order by pos rows between 4 preceding and 1 preceding))
select c1.conv_id, c1.turn, case when last_ai_at is null then 1e9 else greatest(0, at_s - last_ai_at) end::double as since_ai,
  coalesce(rtrim(last_ai_text) like '%?', false) as awaiting_answer, v.heard as verdicts,
  case when coalesce(rtrim(last_ai_text) like '%?', false) then 'awaiting_answer' else '' end as contexts
from c1 join v using (conv_id, turn)""")
def _(spark, sf):
    s = "snapshot."
    return X.conversation_snapshot(context(spark, sf)).select(
        "conv_id", "turn", s + "since_ai", s + "awaiting_answer",
        F.size(s + "recent_verdicts").cast("long").alias("verdicts"),
        F.array_join(s + "contexts", ",").alias("contexts"))


@query("momentum_signals", f"""
with {AS_OF}, s as (select *, case when last_ai_at is not null then greatest(0, at_s - last_ai_at) end::double as since, list_intersect({content_sql('text')}, {content_sql('last_ai_text')}) as shared
  from c1 where role = 'user')
select conv_id, turn,
  case when since < 20 then round(0.6::double * (1.0 - (since / 20) * (since / 20)), 4) end as followup_window,
  case when since < 20 and rtrim(last_ai_text) like '%?' then 1.2::double end as answering_ai_question,
  case when since <= 45 and len(shared) > 0 then round(1.3::double * least(len(shared), 3) / 3.0 * (1.0 - 0.5 * (since / 45)), 3) end as topical_continuity,
  case when since < 20 and {has(clean_sql('text'), V.PATTERNS['anaphoric_reference'])} then 0.6::double end as anaphoric_reference
from s""")
def _(spark, sf):
    d = X.last_words(context(spark, sf)).where("role = 'user'")
    ctx = S.TextContext(since_ai=X.since_ai(F.col("at_s"), F.col("last_ai_at")),
                        last_ai_text=F.col("last_ai_text"))
    w = S.weigh(d, F.col("text"), ctx)
    return w.select("conv_id", "turn", F.round("whole.followup_window", 4).alias("followup_window"),
                    *[F.col(f"whole.{n}").alias(n) for n in (
                        "answering_ai_question", "topical_continuity", "anaphoric_reference")])


def spoken(spark, sf):
    """Conversations made of the phrase table's lines, with the assistant's turns between."""
    return run_sql(spark, sf, """
      select conv_id, event_id as turn, cast(unix_micros(cast(ts as timestamp)) as double) / 1e6 as at_s, 'user' as role, text,
        reliable, cast(own_voice as double) as own_voice, cast(llm_score as double) as llm_score,
        false as driving
      from (select conv_id, utt_id as event_id, timestamp_millis(cast(conv_id * 100000000 + utt_id * 7000 as bigint)) as ts, text, reliable, own_voice, llm_score from @fx_utterances)
      union all
      select user_id, event_id, user_id * 100000.0 + event_id * 7.0 + 3, 'assistant', 'shall I set it for ten minutes?',
        true, null, null, false from events where event_id % 5 = 0""", spread=True).withColumn(
        "at_s", F.col("at_s").cast("double"))


def momentum_sql(body):
    """What the assistant's last words tell, for rows with ``since`` and ``last_ai_text``."""
    presence = "coalesce(least(1.0::double, own_voice / 0.5::double), 1.0::double)"
    shared = f"len(list_intersect({content_sql(body)}, {content_sql('last_ai_text')}))"
    near = "since < 20 and last_ai_text like '%?'"
    return {
        "followup_window": f"case when since < 20 and {presence} > 0 then 0.6::double * (1.0 - (since / 20) * (since / 20)) * {presence} end",
        "answering_ai_question": f"case when {near} and {presence} > 0 then 1.2::double * {presence} end",
        "topical_continuity": f"case when since <= 45 and {shared} > 0 then round(1.3::double * least({shared}, 3) / 3.0 * (1.0 - 0.5 * (since / 45)), 3) end",
        "anaphoric_reference": f"case when since < 20 and {has(body, V.PATTERNS['anaphoric_reference'])} then {V.SIGNAL_WEIGHTS['anaphoric_reference']}::double end"}


def conversation_sql():
    """Verdicts in order by a recursive query: ``past`` holds the last four, 1 yes, 0 no, 2 open.

    The phrases of these conversations sound alike only where they are equal.
    """
    w = V.SIGNAL_WEIGHTS
    whole = signals_sql("body", "reliable", None, momentum=momentum_sql("body"))
    tail = signals_sql("tail_body", "reliable", None, momentum=momentum_sql("tail_body"))
    merged = {n: (f"coalesce(t_{n}, w_{n})" if n in V.AUDIENCE_SIGNALS else f"t_{n}") for n in tail}
    columns = ", ".join([f"{e} as w_{n}" for n, e in whole.items()] + [f"{e} as t_{n}" for n, e in tail.items()])
    logit_w = " + ".join(f"coalesce(w_{n}, 0)" for n in whole)
    logit_t = " + ".join(f"coalesce({e}, 0)" for e in merged.values())
    aud_w = " or ".join(f"coalesce(w_{n} < 0, false)" for n in V.AUDIENCE_SIGNALS if n in whole)
    aud_t = " or ".join(f"coalesce({merged[n]} < 0, false)" for n in V.AUDIENCE_SIGNALS if n in tail)
    return f"""with recursive a0 as (select user_id as conv_id, user_id * 100000.0::double + event_id * 7.0 + 3 as ai_at from events where event_id % 5 = 0),
u0 as (select conv_id, utt_id as turn, conv_id * 100000.0::double + utt_id * 7.0 as at_s, text, reliable, own_voice::double as own_voice, llm_score::double as llm_score from @fx_utterances),
u1 as (select u.*, ai_at, case when ai_at is null then '' else 'shall I set it for ten minutes?' end as last_ai_text, coalesce(at_s - ai_at, 1e9)::double as since,
  {clean_sql('text')} as body, regexp_extract(trim(text), '^.*[.!?]\\s+(\\S.*)$', 1) as tail, row_number() over (partition by u.conv_id order by at_s, turn) as n,
  at_s - lag(at_s) over (partition by u.conv_id order by at_s, turn) as gap from u0 u asof left join a0 a on u.conv_id = a.conv_id and u.at_s > a.ai_at),
u2 as (select *, {clean_sql('tail')} as tail_body, tail <> '' and len(string_split({clean_sql('tail')}, ' ')) >= 2 as has_tail from u1),
u3 as (select *, {columns} from u2),
b0 as (select x.conv_id, x.n, list(x.n - y.n) as backs from u1 x join u1 y on x.conv_id = y.conv_id and y.n between x.n - 4 and x.n - 1 and x.at_s - y.at_s <= 20 and x.body = y.body group by all),
r as (select u3.conv_id, u3.n, turn, reliable, own_voice, llm_score, coalesce(gap <= 25, false) as near, coalesce(backs, []) as backs, {logit_w} as lw, case when has_tail then {logit_t} end as lt,
  w_assistant_name is not null as nw, t_assistant_name is not null as nt, {aud_w} as aw, {aud_t} as aud_t from u3 left join b0 on u3.conv_id = b0.conv_id and u3.n = b0.n),
v as (select distinct conv_id, 0::bigint as n, [1, 1, 1, 1] as past, null::bigint as turn, null::double as heuristic, null::varchar as band, null::varchar as method, null::double as confidence, false as exchange, false as retry from r
union all
select conv_id, n, list_prepend(case when confidence >= 0.62 then 1 when audience then 0 else 2 end, past[1:3]), turn, p, band, method, confidence, exchange, retry from (
  select *, case when named or retry and reliable and not veto then 1.0 when p >= 0.62 or p < 0.34 or llm_score is null then p else 0.65::double * llm_score + 0.35::double * p end as confidence,
    case when named or retry and reliable and not veto or p >= 0.62 then 'accept' when p < 0.34 then 'reject' else 'ambiguous' end as band,
    case when named then 'named' when retry and reliable and not veto then 'retry' when p >= 0.62 or p < 0.34 then 'heuristic' when llm_score is null then 'heuristic_default' else 'llm' end as method
  from (select *, greatest(pw, pt) as p, case when coalesce(pt > pw, false) then nt else nw end and not veto as named, case when coalesce(pt > pw, false) then aud_t else aw end as audience,
      not coalesce(pt > pw, false) and again as retry
    from (select *, 1.0 / (1.0 + exp(-(lw + case when exchange then {w['human_exchange_in_progress']}::double else 0 end + case when again then {w['retry_of_ignored']}::double else 0 end))) as pw,
        1.0 / (1.0 + exp(-(lt + case when exchange then {w['human_exchange_in_progress']}::double else 0 end))) as pt
      from (select r.*, v.past, r.near and v.past[1] = 0 as exchange, coalesce(own_voice < 0.35, false) as veto, len(list_filter(r.backs, lambda b: v.past[b] <> 1)) > 0 as again
        from v join r on r.conv_id = v.conv_id and r.n = v.n + 1)))))
select conv_id, turn, round(heuristic, 4) as heuristic, band, method, round(confidence, 4) as confidence, confidence >= 0.62 as ai_intent,
  case past[1] when 1 then true when 0 then false end as ai_directed, exchange as human_exchange, retry from v where n > 0"""


@query("scored_conversations", conversation_sql())
def _(spark, sf):
    return CV.score_conversations(spoken(spark, sf)).select(
        "conv_id", "turn", F.round("heuristic", 4).alias("heuristic"), "band", "method",
        F.round("confidence", 4).alias("confidence"), "ai_intent", "ai_directed",
        "human_exchange", "retry")


SECOND_OPINION = conversation_sql().rsplit("select conv_id, turn, round(heuristic", 1)[0].rstrip() + """,
w as (select *, case past[1] when 1 then 'to the assistant' when 0 then 'to someone else' else 'unclear who to' end as whom from v where n > 0),
x as (select w.conv_id, w.n, w.turn, w.band, u.text, u.since, count(*) filter (past[1] = 0) over six as others, count(*) filter (past[1] = 1) over six as mine,
  list({'t': u.text, 'w': whom}) over (partition by w.conv_id order by w.n rows between 3 preceding and 1 preceding) as three
  from w join u1 u on u.conv_id = w.conv_id and u.n = w.n window six as (partition by w.conv_id order by w.n rows between 6 preceding and 1 preceding)),
y as (select *, list_concat(list_transform(list_filter(coalesce(three, []), lambda r: trim(r.t) <> trim(text)), lambda r: '- earlier, ' || r.w || ': "' || trim(r.t) || '"'),
  case when since < 60 then ['- the assistant said ' || printf('%.0f', since) || 's ago: "shall I set it for ten minutes?"'] else [] end) as lines from x where band = 'ambiguous')
select conv_id, turn, case when others > 0 then 'others' when mine >= 2 then 'solo' else 'unknown' end as setting,
  case when others = 0 and mine >= 2 then 'balanced' else 'cautious' end as tiebreak, 'Context:' || chr(10) || case when len(lines) = 0 then '- (no recent context)'
  else list_aggregate(lines, 'string_agg', chr(10)) end || chr(10) || chr(10) || 'Sentence just spoken: "' || trim(text) || '"' || chr(10) || chr(10) || 'Digit:' as user_prompt from y"""


@query("second_opinion_requests", SECOND_OPINION)
def _(spark, sf):
    d = CV.adjudication_requests(CV.score_conversations(spoken(spark, sf)))
    return d.select("conv_id", "turn", "setting", "tiebreak", "user_prompt")


@query("second_opinion_replies", """
select event_id, case when event_id % 3 = 0 then (event_id % 10) / 9.0 end::double as score, event_id % 3 <> 0 as failed from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, case when event_id % 3 = 0 then concat('Digit: ', cast(event_id % 10 as string)) else 'none' end as reply from events")
    score, error = CV.read_adjudication(F.col("reply"))
    return d.select("event_id", score.alias("score"), error.isNotNull().alias("failed"))


# -- parsing ---------------------------------------------------------------------------------------

def normalise_sql(text):
    t = f"regexp_replace(replace(lower({text}), '’', ''''), '[^a-z0-9'' ]+', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(?:hey|hi|ok(?:ay)?|yo)?\\s*(?:nova)\\b', ' ', 'g')"
    t = f"trim(regexp_replace({t}, ' +', ' ', 'g'))"
    for _ in range(3):
        t = f"trim(regexp_replace({t}, '{q(V.POLITE_LEAD)}', ''))"
        t = f"trim(regexp_replace({t}, '{q(V.POLITE_TAIL)}', ''))"
    return t


RULE = "case " + " ".join(f"when {has('norm', p)} then '{n}'" for n, p in V.INTENT_RULES) + " end"
NUMBERS = "map([" + ", ".join(f"'{k}'" for k in (*V.NUMBER_WORDS, *V.TENS_WORDS)) + "], [" \
    + ", ".join(str(v) for v in (*V.NUMBER_WORDS.values(), *V.TENS_WORDS.values())) + "])"


def duration_sql(text):
    """Look-behind is rewritten: "and a half" is hidden while half units are looked for."""
    unit = "case when {u} like 'h%' then 3600.0 when {u} like 'm%' then 60.0 else 1.0 end"
    t = f"replace(lower({text}), '-', ' ')"
    t1 = f"regexp_replace({t}, '{V.DURATION_THREE_QUARTERS}', ' ', 'g')"
    hidden = f"replace({t1}, 'and a half', 'and_a_half')"
    half = r"\bhalf\s+(?:an?\s+)?(hour|minute)\b"
    t2 = f"replace(regexp_replace({hidden}, '{half}', ' ', 'g'), 'and_a_half', 'and a half')"
    t3 = f"regexp_replace({t2}, '{V.DURATION_QUARTER_HOUR}', ' ', 'g')"
    amount = V.DURATION_AMOUNT
    number = (f"case when regexp_matches(regexp_extract(m, '{amount}', 1), '^[0-9.]+$') then regexp_extract(m, '{amount}', 1)::double "
              f"else list_sum(list_transform(string_split(regexp_extract(m, '{amount}', 1), ' '), lambda x: {NUMBERS}[x]::double)) end")
    seconds = (f"list_transform(regexp_extract_all({t3}, '{amount}'), lambda m: ({number} + "
               f"case when regexp_matches(m, 'and\\s+a\\s+half') then 0.5 else 0.0 end) * "
               + unit.format(u=f"regexp_extract(m, '{amount}', 3)") + ")")
    return (f"len(regexp_extract_all({t}, '{V.DURATION_THREE_QUARTERS}')) * 2700.0"
            f" + len(regexp_extract_all({t2}, '{V.DURATION_QUARTER_HOUR}')) * 900.0"
            f" + coalesce(list_sum(list_transform(regexp_extract_all({hidden}, '{half}', 1), lambda u: 0.5 * {unit.format(u='u')})), 0)"
            f" + coalesce(list_sum({seconds}), 0)")


PARSED = f"""n as (select utt_id, text, g_addressed, g_intent, g_seconds, reliable, {normalise_sql('text')} as norm from @fx_utterances),
n1 as (select *, {RULE} as rule, {duration_sql('norm')} as total from n),
n2 as (select *, case when norm = '' or rule is null or (rule = 'timer.set' and total <= 0) then 'open_request' else rule end as intent,
  case when norm = '' then 0.5 when rule is null then 0.9 when rule = 'timer.set' and total <= 0 then 0.8 else 1.0 end::double as p,
  case when norm = '' or rule is null then 'none' else 'rule' end as method,
  case when rule = 'timer.set' and total > 0 then total::bigint end as duration from n1)"""


@query("normalised_transcripts", f"select utt_id, {normalise_sql('text')} as normalised from @fx_utterances")
def _(spark, sf):
    return utterances(spark, sf).select("utt_id", T.normalise(F.col("text")).alias("normalised"))


@query("spoken_durations", f"""
select utt_id, case when {duration_sql('text')} > 0 then ({duration_sql('text')})::bigint end as seconds from @fx_utterances""")
def _(spark, sf):
    return utterances(spark, sf).select("utt_id", T.parse_duration(F.col("text")).alias("seconds"))


@query("parsed_intents", f"with {PARSED} select utt_id, intent, p, method, duration from n2")
def _(spark, sf):
    d = PA.parse_intent(utterances(spark, sf), F.col("text"))
    return d.select("utt_id", F.col("parse_intent").alias("intent"), F.col("parse_p").alias("p"),
                    F.col("parse_method").alias("method"),
                    F.try_element_at("parse_slots", F.lit("duration")).cast("long").alias("duration"))


@query("parse_quality", f"""
with {PARSED} select g_intent, count(*) as n, count(*) filter (intent = g_intent) as same,
  count(*) filter (g_seconds is not null and duration is not distinct from g_seconds) as same_length
from n2 where g_addressed = 'assistant_directed' group by g_intent""")
def _(spark, sf):
    d = PA.parse_intent(utterances(spark, sf), F.col("text")).where("g_addressed = 'assistant_directed'")
    got = F.try_element_at("parse_slots", F.lit("duration")).cast("long")
    return d.groupBy("g_intent").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("parse_intent") == F.col("g_intent")).alias("same"),
        F.count_if(F.col("g_seconds").isNotNull() & got.eqNullSafe(F.col("g_seconds")))
        .alias("same_length"))


AGENT = C.CORE.extended(C.Catalogue.of([
    {"name": "lights.set", "examples": ["set the lights to {level}", "lights {level}"],
     "slots": [{"name": "level", "type": "enum", "values": ["low", "high"], "required": True}]},
    {"name": "oven.heat", "examples": ["heat the oven to {degrees} degrees"],
     "slots": [{"name": "degrees", "type": "number", "values": ["180", "200"], "required": True}]}],
    "agent"))
LEVELS = "array('low', 'HIGH', 'medium', 'high')"


@query("matched_examples", """
select event_id, case when event_id % 3 = 0 then 'lights.set' when event_id % 3 = 1 then 'oven.heat' end as intent,
  case when event_id % 3 = 0 then case event_id % 4 when 0 then 'low' when 1 then 'high' when 3 then 'high' end
       when event_id % 3 = 1 then cast(180 + event_id % 40 as varchar) end as slot from events""")
def _(spark, sf):
    d = run_sql(spark, sf, f"""select event_id, case when event_id % 3 = 0 then concat('Nova, set the lights to ', {LEVELS}[event_id % 4])
      when event_id % 3 = 1 then concat('please heat the oven to ', cast(180 + event_id % 40 as string), ' degrees') else 'what a day' end as text from events""")
    p = PA.parse_intent(d, F.col("text"), AGENT)
    custom = F.col("parse_method") == "example"
    return p.select("event_id", F.when(custom, F.col("parse_intent")).alias("intent"),
                    F.when(custom, F.get(F.map_values("parse_slots"), F.lit(0))).alias("slot"))


@query("coerced_slots", """
select event_id, case when event_id % 4 in (1, 3) then 'high' when event_id % 4 = 0 then 'low' end as level,
  cast(event_id % 40 as varchar) as degrees, cast(60 * (event_id % 9 + 1) as varchar) as duration from events""")
def _(spark, sf):
    d = run_sql(spark, sf, f"select event_id, {LEVELS}[event_id % 4] as lv, cast(event_id % 40 as string) as dg, concat(cast(event_id % 9 + 1 as string), ' minutes') as du from events")
    enum, number = AGENT.slots("lights.set")[0], AGENT.slots("oven.heat")[0]
    return d.select("event_id", T.coerce_slot(F.col("lv"), enum).alias("level"),
                    T.coerce_slot(F.col("dg"), number).alias("degrees"),
                    T.coerce_slot(F.col("du"), AGENT.slots("timer.set")[0]).alias("duration"))


@query("model_replies", """
select event_id, case when event_id % 4 in (0, 1) then 'lights.set' when event_id % 4 = 2 then 'timer.set' end as intent,
  case when event_id % 4 = 0 then 'low' when event_id % 4 = 2 then '420' end as slot from events""")
def _(spark, sf):
    d = run_sql(spark, sf, """select event_id, case event_id % 4
      when 0 then 'Sure: {"intent": "lights.set", "slots": {"level": "LOW"}} done'
      when 1 then '{"intent": "lights.set", "slots": {"level": "purple"}}'
      when 2 then '{"intent": "timer.set", "slots": {"duration": "7 minutes"}}'
      else '{"intent": "fly.away", "slots": {}}' end as reply from events""")
    got = PA.validate_model_parses(F.col("reply"), AGENT)
    return d.withColumn("g", got).select("event_id", F.col("g.intent").alias("intent"),
                                         F.get(F.map_values("g.slots"), F.lit(0)).alias("slot"))


# -- catalogues ---------------------------------------------------------------------------------------

def catalogue_tables(spark, sf):
    intents = run_sql(spark, sf, """select p_brand as catalogue, '1' as version, p_partkey as position,
      case when p_partkey % 11 = 0 then p_name else replace(p_name, ' ', '.') end as intent, p_name as description,
      array(p_name) as examples, cast(null as array<struct<name:string,type:string,values:array<string>,required:boolean>>) as slots,
      case when p_size > 45 then p_size / 10.0D when p_size > 30 then p_size / 50.0D end as min_confidence, false as needs_transcript,
      case when p_partkey % 13 = 0 then array('whenever') else array('timer_running') end as contexts from part""")
    slots = run_sql(spark, sf, """select p_brand as catalogue, concat('i', cast(p_partkey as string)) as intent,
      case when p_size % 9 = 0 then 'Bad Name' else 'level' end as slot, case when p_size % 7 = 0 then 'text' else 'enum' end as type,
      case when p_size % 5 = 0 then array() when p_size % 4 = 0 then array('a', 'a') else array('a', 'b') end as values from part""")
    return intents, slots


@query("catalogue_problems", """
with i as (select p_brand as catalogue, case when p_partkey % 11 = 0 then p_name else replace(p_name, ' ', '.') end as intent,
   case when p_size > 45 then p_size / 10.0 when p_size > 30 then p_size / 50.0 end as c, p_partkey from part),
s as (select p_brand as catalogue, 'i' || p_partkey || ':' || case when p_size % 9 = 0 then 'Bad Name' else 'level' end as item, p_size from part),
u as (select catalogue, intent as item, 'bad intent name' as problem from i where not regexp_matches(intent, '^[a-z][a-z0-9_]*(\\.[a-z][a-z0-9_]*)*$')
 union all select catalogue, intent, 'min_confidence must be in (0, 1]' from i where c <= 0 or c > 1
 union all select catalogue, intent, 'unknown context' from i where p_partkey % 13 = 0
 union all select catalogue, intent, 'duplicate intent name' from i group by catalogue, intent having count(*) > 1
 union all select catalogue, item, 'bad slot name' from s where p_size % 9 = 0
 union all select catalogue, item, 'unknown slot type' from s where p_size % 7 = 0
 union all select catalogue, item, 'slot declares no values' from s where p_size % 5 = 0
 union all select catalogue, item, 'duplicate slot values' from s where p_size % 4 = 0 and p_size % 5 <> 0)
select problem, count(*) as n from u group by problem""")
def _(spark, sf):
    return C.check_catalogue(*catalogue_tables(spark, sf)).groupBy("problem") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("extended_catalogue", """
with b as (select replace(p_name, ' ', '.') as intent, min(p_partkey) as position from part where p_partkey % 2 = 0 group by 1),
o as (select replace(p_name, ' ', '.') as intent, min(p_partkey) + (select max(position) + 1 from b) as position from part where p_partkey % 3 = 0 group by 1),
m as (select * from b where intent not in (select intent from o) union all select * from o)
select intent, 'base+agent' as catalogue, false as needs_transcript, position from m
union all select 'open_request', 'base+agent', true, max(position) + 1 from m""")
def _(spark, sf):
    def rows(name, k):
        return run_sql(spark, sf, f"""select '{name}' as catalogue, '1' as version, min(p_partkey) as position, replace(p_name, ' ', '.') as intent,
          '' as description, array('x') as examples, cast(array() as {f"array<{C.SLOT_TYPE}>"}) as slots, cast(null as double) as min_confidence,
          false as needs_transcript, cast(array() as array<string>) as contexts from part where p_partkey % {k} = 0 group by p_name""")
    return C.extend_catalogue(rows("base", 2), rows("agent", 3)).select(
        "intent", "catalogue", "needs_transcript", F.col("position").cast("long").alias("position"))


@query("catalogue_round_trip", """
with p as (select p_brand as catalogue, list(p_partkey order by p_partkey) as keys, list(p_name order by p_partkey) as names from part group by p_brand)
select catalogue, len(keys) + 1 as intents, md5(list_aggregate(list_append(list_transform(keys, lambda k: 'i' || k::varchar), 'open_request'), 'string_agg', ',')) as names,
  md5(list_aggregate(names, 'string_agg', ',')) as examples, len(keys) as levels, 1 as need_transcript from p""")
def _(spark, sf):
    d = run_sql(spark, sf, """select p_brand as k, to_json(named_struct('name', p_brand, 'version', '2', 'intents', transform(
      array_sort(collect_list(named_struct('at', p_partkey, 'name', p_name))), x -> named_struct('name', concat('i', cast(x.at as string)),
        'examples', array(x.name), 'slots', array(named_struct('name', 'level', 'type', 'enum', 'values', array('a', 'b'))))))) as json
      from part group by p_brand""")
    rows = C.read_catalogue(d, "json")
    back = C.write_catalogue(rows.drop("k")).withColumn("c", F.from_json("json", C.CATALOGUE_TYPE))
    i = F.col("c.intents")
    return back.select(
        "catalogue", F.size(i).cast("long").alias("intents"), F.md5(F.array_join(F.transform(i, lambda x: x["name"]), ",")).alias("names"),
        F.md5(F.array_join(F.flatten(F.transform(i, lambda x: F.coalesce(x["examples"], F.array().cast("array<string>")))), ",")).alias("examples"),
        F.size(F.filter(i, lambda x: F.get(x["slots"], F.lit(0))["name"] == "level")).cast("long").alias("levels"),
        F.size(F.filter(i, lambda x: F.coalesce(x["needs_transcript"], F.lit(False)))).cast("long").alias("need_transcript"))


# -- labelling -----------------------------------------------------------------------------------------

LABEL_CTES = scored_ctes("@fx_utterances", None, "cast(null as double) as own, reliable", "own")


@query("teacher_labels", f"""
with {LABEL_CTES.replace("t_bystander", "t_bystander")}, {PARSED},
l as (select u5.utt_id, text, reliable, case when named then 1.0 else heuristic end as c,
  trim(text) = '' as silent from u5),
m as (select *, c >= 0.62 as acc, case when len(string_split(trim(text), ' ')) <= 1 and c < 0.62 then least(case when reliable then 0.85 else 0.35 end, 0.6)
  else case when reliable then 0.85 else 0.35 end end::double as share from l)
select m.utt_id, acc and not silent as t_accept, round(case when silent then 0.0 else c end, 4) as t_confidence,
  round(case when silent then 0.18 else (1 - c) * share end, 4) as p_human,
  round(case when silent then 0.80 else (1 - c) * (1 - share) end, 4) as p_media,
  case when not silent then n2.intent end as t_intent, case when silent then 0.0 else n2.p end as t_intent_p
from m join n2 using (utt_id)""")
def _(spark, sf):
    d = utterances(spark, sf).select("utt_id", F.col("text").alias("transcript"), "reliable",
                                     F.col("reliable").alias("tail_reliable"))
    k = K.label_transcripts(d, settings=ENGINE)
    return k.select("utt_id", "t_accept", F.round("t_confidence", 4).alias("t_confidence"),
                    F.round(F.col("t_addressed")[V.HUMAN], 4).alias("p_human"),
                    F.round(F.col("t_addressed")[V.MEDIA], 4).alias("p_media"),
                    "t_intent", "t_intent_p")


@query("relabelled_rows", """
select utt_id, utt_id % 40.0 as stt_ms from @fx_utterances where utt_id % 6 <> 0""")
def _(spark, sf):
    d = utterances(spark, sf).select(
        "utt_id", F.when(F.col("utt_id") % 6 != 0, F.col("text")).alias("transcript"),
        F.col("reliable").alias("t_reliable"), F.lit("old").alias("t_intent"),
        (F.col("utt_id") % 40).cast("double").alias("stt_ms"))
    return K.relabel(d).where("t_teacher = 'engine'").select("utt_id", "stt_ms")


@query("slow_path_decisions", f"""
with {scored_ctes("@fx_utterances", None)}, {DECIDE}, {PARSED}
select u6.utt_id, case when confidence >= 0.62 then 'act' else 'ignore' end as slow_route,
  case when confidence >= 0.62 then n2.intent end as slow_intent, case when confidence >= 0.62 then n2.duration end as duration
from u6 join n2 using (utt_id)""")
def _(spark, sf):
    ctx = S.TextContext(reliable=F.col("reliable"), own_voice=F.col("own_voice"),
                        llm_score=F.col("llm_score"))
    d = S.classify(utterances(spark, sf), F.col("text"), ctx, ENGINE)
    d = PA.parse_intent(d, F.col("text"))
    d = d.withColumn("addressed", K.addressed_distribution(
        F.col("text"), F.col("confidence"), F.col("ai_intent"), F.col("reliable")))
    return K.slow_path_decision(d).select(
        "utt_id", "slow_route", "slow_intent",
        F.try_element_at("slow_slots", F.lit("duration")).cast("long").alias("duration"))


def _who(texts):
    import numpy as np
    n = np.array([len(t) for t in texts])
    p = np.stack([(n % 10) / 10.0 + 0.02, 0.5 - (n % 5) / 20.0, np.full(len(n), 0.3)], axis=1)
    return p / p.sum(axis=1, keepdims=True)


def _what(texts):
    import numpy as np
    k = len(C.CORE.names)
    p = np.ones((len(texts), k))
    p[np.arange(len(texts)), [len(t) % k for t in texts]] = 10.0
    return p / p.sum(axis=1, keepdims=True)


@query("judged_texts", f"""
with k as (select {clean_sql('text')} as judge_key, min(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as t from @fx_utterances group by 1),
p as (select judge_key, length(t) as n from k)
select judge_key, round(case when judge_key = '' then 0.02 else ((n % 10) / 10.0 + 0.02) / ((n % 10) / 10.0 + 0.02 + 0.5 - (n % 5) / 20.0 + 0.3) end, 4) as p_assistant,
  judge_key <> '' and ((n % 10) / 10.0 + 0.02) / ((n % 10) / 10.0 + 0.02 + 0.5 - (n % 5) / 20.0 + 0.3) >= 0.2 as asked_intent from p""")
def _(spark, sf):
    j = K.judge_batch(utterances(spark, sf), "text", _who, _what)
    return j.select("judge_key", F.round(F.col("judge_addressed")[V.ASSISTANT], 4).alias("p_assistant"),
                    (F.size("judge_intent") > 0).alias("asked_intent"))


@query("judged_labels")
def _(spark, sf):
    u = utterances(spark, sf)
    d = u.select("utt_id", F.col("text").alias("transcript"), "reliable",
                 F.col("reliable").alias("tail_reliable"))
    k = K.label_transcripts(d, K.judge_batch(u, "text", _who, _what))
    return k.select("utt_id", "t_accept", F.round("t_confidence", 6).alias("t_confidence"),
                    "t_method", "t_intent")


@query("lettered_replies", """
select event_id, round(case event_id % 4 when 0 then 0.9 when 3 then 1.0 / 3 else 0.05 end, 4) as p_first,
  round(case event_id % 4 when 1 then 0.9 when 3 then 1.0 / 3 else 0.05 end, 4) as p_second from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, array('A', 'answer: b)', ' c ', '42?')[event_id % 4] as reply from events")
    p = K.option_probs(F.when(F.col("event_id") % 4 == 1, "(b) surely").otherwise(F.col("reply")), 3)
    return d.withColumn("p", p).select(
        "event_id", F.round(F.get("p", F.lit(0)), 4).alias("p_first"),
        F.round(F.get("p", F.lit(1)), 4).alias("p_second"))


JUDGED = """select event_id, concat('cat', cast(event_id % 4 as {s})) as category,
  case when event_id % 3 = 0 then 'assistant_directed' else 'human_directed' end as g_addressed,
  case when event_id % 6 = 0 then 'stop' end as g_intent, case when event_id % 12 = 0 then 'stop' else 'cancel' end as t_intent,
  cast(event_id * 37 % 101 as double) / 100 as j, cast(event_id * 53 % 97 as double) / 96 as e from events"""


@query("teacher_blends", f"""
with d as ({JUDGED.format(s='varchar')}), w as (select *, unnest([0.0, 0.5, 0.8, 1.0])::double as weight from d),
a as (select *, weight * j + (1.0 - weight) * e >= 0.5 as acc, g_addressed = 'assistant_directed' as gold from w)
select weight, count(*) as rows, round(count(*) filter (acc = gold) / count(*), 4) as who_for_accuracy,
  count(*) filter (gold and not acc) as missed_k, count(*) filter (not gold and acc) as false_activation_k,
  round(count(*) filter (gold and acc and t_intent = g_intent) / count(*) filter (gold and acc and g_intent is not null), 4) as intent_accuracy_when_accepted
from a group by weight""")
def _(spark, sf):
    d = run_sql(spark, sf, JUDGED.format(s="string"))

    def dist(c):
        return F.create_map(F.lit(V.ASSISTANT), F.col(c))
    r = K.teacher_report(d.withColumns({"t_judge_addressed": dist("j"), "t_engine_addressed": dist("e")}))
    return r.select("weight", "rows", "who_for_accuracy", "missed_k", "false_activation_k",
                    "intent_accuracy_when_accepted")


PIECES = """select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as pos, {t} as text,
  case when l_partkey % 50 = 0 then cast('NaN' as double) else -l_discount * 14.3 end as score, l_tax as no_speech from lineitem"""


@query("transcript_reliability", f"""
with p as ({PIECES.format(t="' w' || l_linenumber || ' '")}),
a as (select id, string_agg(trim(text), ' ' order by pos) as transcript, bool_or(isnan(score)) as bad, avg(case when not isnan(score) then score end) as m,
  arg_max(score, pos) as t, max(no_speech) as no_speech from p group by id)
select id, transcript, coalesce(case when not bad then round(m, 9) > -1.0 end, true) as reliable,
  case when isnan(t) then true else t > -1.0 end as tail_reliable, round(no_speech, 4) as no_speech from a""")
def _(spark, sf):
    d = run_sql(spark, sf, PIECES.format(t="concat(' w', cast(l_linenumber as string), ' ')"))
    return K.transcript_reliability(d).select("id", "transcript", "reliable", "tail_reliable",
                                              F.round("no_speech", 4).alias("no_speech"))


@query("token_reliability", """
with p as (select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos,
  cast(l_partkey % 97 as double) / 97.3 as score, count(*) over (partition by l_orderkey) as n from lineitem)
select id, avg(score) >= 0.5 as reliable, avg(case when pos >= n - greatest(1, floor(n / 3)) then score end) >= 0.5 as tail_reliable
from p group by id""")
def _(spark, sf):
    d = run_sql(spark, sf, """select l_orderkey as id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as pos,
      'x' as text, cast(l_partkey % 97 as double) / 97.3 as score, cast(null as double) as no_speech from lineitem""")
    return K.transcript_reliability(d, "tokens").select("id", "reliable", "tail_reliable")


# -- corpora ---------------------------------------------------------------------------------------------

CATEGORY = "case event_id % 5 when 0 then 'typed' when 1 then 'open' when 2 then 'human' when 3 then 'hard_negative' else 'background' end"


@query("scripted_lines")
def _(spark, sf):
    ids = run_sql(spark, sf, f"select concat('line-', cast(event_id as string)) as id, event_id as n, {CATEGORY} as category from events")
    return CO.script_lines(ids).select("id", "text", "g_addressed", "g_intent", "category")


@query("scripted_label_counts", f"""
select category, case category when 'typed' then 'assistant_directed' when 'open' then 'assistant_directed' when 'background' then 'background_or_media' else 'human_directed' end as g_addressed,
  count(*) as n from (select {CATEGORY} as category from events) group by category""")
def _(spark, sf):
    ids = run_sql(spark, sf, f"select concat('line-', cast(event_id as string)) as id, event_id as n, {CATEGORY} as category from events")
    return CO.script_lines(ids).groupBy("category", "g_addressed").agg(F.count(F.lit(1)).alias("n"))


@query("described_durations", """
with s as (select event_id, cast(floor(value * 60) as bigint) as s from events), p as (select event_id, s // 3600 as h, (s % 3600) // 60 as m, s % 60 as r from s)
select event_id, case when h + m + r = 0 then '0 seconds' else trim(
  case when h > 0 then h || ' hour' || case when h = 1 then '' else 's' end || ' ' else '' end ||
  case when m > 0 then m || ' minute' || case when m = 1 then '' else 's' end || ' ' else '' end ||
  case when r > 0 then r || ' second' || case when r = 1 then '' else 's' end else '' end) end as text from p""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, cast(floor(value * 60) as bigint) as s from events")
    return d.select("event_id", T.describe_duration(F.col("s")).alias("text"))


@query("filled_templates", """
select event_id, 'meet ' || event_type || ' at {unknown} ' || event_type as text from events""")
def _(spark, sf):
    d = run_sql(spark, sf, "select event_id, event_type from events")
    out = None
    for t in ("click", "error", "purchase", "signup", "view"):
        c = CO.fill_template(F.lit("meet {who} at {unknown} {who}"), {"who": [t]}, "s", F.col("event_id"))
        out = F.when(F.col("event_type") == t, c) if out is None else out.when(F.col("event_type") == t, c)
    return d.select("event_id", out.alias("text"))


SCRIPT = [{"label": V.ASSISTANT, "text": "ask it something", "seconds": 50, "intent": None},
          {"label": V.HUMAN, "text": "talk to each other", "seconds": 75, "who": "all"},
          {"label": V.ASSISTANT, "text": "set a timer", "seconds": 40, "intent": "timer.set"},
          {"label": V.MEDIA, "text": "play something", "seconds": 75, "who": "none"}]
SOLO = {V.HUMAN: "talk on the phone"}
SESSIONS_SQL = """select user_id as session, case when user_id % 3 = 0 then {a}'p1'{b} else {a}'p1', 'p2'{b} end as speakers from events group by user_id"""


@query("expanded_scripts", f"""
with s as ({SESSIONS_SQL.format(a='[', b=']')}), k as (select *, len(speakers) as k from s),
u as (select session, unnest(range(0, k)) as step, 'assistant_directed' as label, null as intent, 'ask it something' as text, unnest(speakers) as speaker from k
 union all select session, k, 'human_directed', null, case when k = 1 then 'talk on the phone' else 'talk to each other' end, array_to_string(speakers, '+') from k
 union all select session, unnest(range(k + 1, 2 * k + 1)), 'assistant_directed', 'timer.set', 'set a timer', unnest(speakers) from k
 union all select session, 2 * k + 1, 'background_or_media', null, 'play something', '' from k)
select session, step, label, intent, text, speaker from u""")
def _(spark, sf):
    s = run_sql(spark, sf, SESSIONS_SQL.format(a="array(", b=")"))
    return CO.expand_script(s, SCRIPT, SOLO).select("session", "step", "label", "intent", "text", "speaker")


@query("consented_clips", f"""
with s as ({SESSIONS_SQL.format(a='[', b=']')}), k as (select session, len(speakers) as k, speakers from s),
seg as (select event_id as id, user_id as session, event_id % (2 * k + 2) as step, k, speakers from events join k on user_id = session)
select id, case when step = k then 'human_directed' when step = 2 * k + 1 then 'background_or_media' else 'assistant_directed' end as g_addressed,
  case when step > k and step < 2 * k + 1 then 'timer.set' end as g_intent,
  case when step = k then array_to_string(speakers, '+') when step = 2 * k + 1 then 'media' when step < k then speakers[step + 1] else speakers[step - k] end as speaker from seg""")
def _(spark, sf):
    s = run_sql(spark, sf, SESSIONS_SQL.format(a="array(", b=")"))
    seg = run_sql(spark, sf, "select event_id as id, user_id as session, 'release' as consent, 'kitchen' as room, 'm' as mic, value as duration from events") \
        .join(s, "session").withColumn("step", F.col("id") % (2 * F.size("speakers") + 2)).drop("speakers")
    return CO.consented_rows(seg, CO.expand_script(s, SCRIPT, SOLO)).select(
        "id", "g_addressed", "g_intent", "speaker")
