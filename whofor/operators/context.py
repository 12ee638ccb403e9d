"""Conversation context: what was said, by whom, and how long ago.

Tables are ``conv_id, at_s, turn, role, text`` plus the columns a function
names. A conversation is numbered once (``numbered``) and then cut into
overlapping runs, so the longest conversation is spread over many tasks. The
reference keeps at most 40 utterances, which bounds every look-back but one:
the assistant's last words are carried forward however old they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.functions.scalars import is_true
from whofor.operators.ordering import overlap, own_rows, run_window

KEYS = ["conv_id"]
MAX_KEPT = 40
PIECE_SECONDS = 3600


def situate(df: DataFrame, silence: float = 25.0) -> DataFrame:
    """Every row placed in its conversation, with what was last said before it.

    Adds ``pos`` (over all rows), ``upos`` (over user rows), ``last_ai_text``,
    ``last_ai_at``, ``last_user_text``, ``gap_s`` (since the user row before)
    and ``episode`` (the ``upos`` where the current stretch without ``silence``
    seconds of quiet began).

    Rows are shuffled once, by (conversation, hour). Each hour is read in order
    where it lands; one summary row per hour is ordered over the conversation
    and joined back, so no task ever holds more than an hour of rows.
    """
    piece = F.floor(F.col("at_s") / PIECE_SECONDS).cast("long")
    here = Window.partitionBy(*KEYS, "__piece").orderBy("at_s", "turn")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    user, ai = F.col("role") == "user", F.col("role") == "assistant"

    def last(value, w):
        return F.last(value, ignorenulls=True).over(w)
    said = F.when(ai, F.struct(F.col("at_s").alias("at"), F.col("text").alias("text")))
    heard = F.when(user & (T.strip(F.coalesce("text", F.lit(""))) != ""), F.col("text"))
    d = df.withColumn("__piece", piece).withColumns({
        "__r": F.row_number().over(here) - 1,
        "__u": F.sum(F.when(user, 1).otherwise(0)).over(upto),
        "__at": last(F.when(user, F.col("at_s")), before),
        "__ai": last(said, before), "__heard": last(heard, before)})
    starts = user & (F.col("at_s") - F.col("__at") > silence)
    d = d.withColumn("__start", F.when(starts, F.col("__u")))
    d = d.withColumn("__episode", last(F.col("__start"), upto))

    def end(value):
        return F.max_by(value, F.when(value.isNotNull(), F.col("__r")))
    ends = d.groupBy(*KEYS, "__piece").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(user, 1).otherwise(0)).alias("nu"),
        end(said).alias("ai"), end(heard).alias("heard"),
        F.min(F.when(user, F.col("at_s"))).alias("first_at"),
        F.max(F.when(user, F.col("at_s"))).alias("last_at"),
        F.max("__start").alias("start"))
    earlier = (Window.partitionBy(*KEYS).orderBy("__piece")
               .rowsBetween(Window.unboundedPreceding, -1))
    s = ends.withColumns({
        "p0": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
        "u0": F.coalesce(F.sum("nu").over(earlier), F.lit(0)),
        "ai0": last(F.col("ai"), earlier), "heard0": last(F.col("heard"), earlier),
        "at0": last(F.col("last_at"), earlier)})
    opens = F.col("first_at").isNotNull() & (
        F.col("at0").isNull() | (F.col("first_at") - F.col("at0") > silence))
    s = s.withColumn("first_start", F.when(opens, F.col("u0") + 1))
    s = s.withColumn("episode0", last(F.coalesce(F.col("u0") + F.col("start"),
                                                 F.col("first_start")), earlier))
    s = s.select(*KEYS, "__piece", "p0", "u0", "ai0", "heard0", "at0", "first_start", "episode0")
    spoken = F.coalesce("__ai", "ai0")
    return d.join(s, [*KEYS, "__piece"]).select(
        *df.columns, (F.col("p0") + F.col("__r")).alias("pos"),
        F.when(user, F.col("u0") + F.col("__u") - 1).alias("upos"),
        F.coalesce(spoken["text"], F.lit("")).alias("last_ai_text"),
        spoken["at"].alias("last_ai_at"),
        F.coalesce("__heard", "heard0", F.lit("")).alias("last_user_text"),
        F.when(user, F.col("at_s") - F.coalesce("__at", "at0")).alias("gap_s"),
        F.when(user, F.coalesce(F.col("u0") + F.col("__episode"), "first_start", "episode0") - 1)
        .alias("episode"))


def users(df: DataFrame) -> DataFrame:
    return situate(df).where("role = 'user'")


def _lookback(df: DataFrame, pos: str, columns: dict[str, Column], back: int) -> DataFrame:
    """Array columns over the previous ``back`` rows of each row, oldest first."""
    w = run_window(KEYS, pos).rowsBetween(-back, -1)
    d = overlap(df, KEYS, pos, back=back)
    return own_rows(d.withColumns({n: F.collect_list(c).over(w) for n, c in columns.items()}))


def retain(df: DataFrame, ttl: float = 900.0, keep: int = MAX_KEPT) -> DataFrame:
    """What is still remembered at the end of each conversation: young enough, newest few."""
    d = situate(df)
    ends = d.groupBy(*KEYS).agg(F.max("at_s").alias("__now"), F.max("pos").alias("__last"))
    return d.join(ends, KEYS).where(
        (F.col("at_s") >= F.col("__now") - ttl) & (F.col("pos") > F.col("__last") - keep)) \
        .drop("__now", "__last")


def recent_utterances(df: DataFrame, n: int = 3) -> DataFrame:
    """User rows with ``recent``: the n utterances before each, oldest first."""
    return _lookback(users(df), "upos", {"recent": F.col("text")}, n)


def overheard(df: DataFrame, within: float = 180.0, limit: int = 4, max_chars: int = 90,
              keep: int = MAX_KEPT) -> DataFrame:
    """User rows with ``overheard``: recent reliable speech that was not answered.

    Only the last ``keep`` utterances are remembered, as by the assistant's own buffer; give a
    larger number to look through all of ``within`` seconds of denser speech.
    """
    said = F.struct("at_s", T.collapse(F.col("text")).alias("text"), "ai_directed", "reliable")
    d = _lookback(users(df), "upos", {"__kept": said}, keep)
    words = F.filter("__kept", lambda u: ~is_true(u["ai_directed"]) & is_true(u["reliable"])
                     & (u["at_s"] >= F.col("at_s") - within)
                     & (T.word_count(u["text"]) >= 2))
    texts = F.transform(words, lambda u: F.substring(u["text"], 1, max_chars))
    start = F.greatest(F.size(texts) - limit, F.lit(0)) + 1
    return d.withColumn("overheard", F.slice(texts, start, F.lit(limit))).drop("__kept")


def recent_verdicts(df: DataFrame, limit: int = 4) -> DataFrame:
    """User rows with ``recent_verdicts``: tri-state, newest last."""
    d = _lookback(users(df), "upos", {"__v": F.struct("ai_directed")}, limit)
    return d.withColumn("recent_verdicts",
                        F.transform("__v", lambda s: s["ai_directed"])).drop("__v")


def last_words(df: DataFrame) -> DataFrame:
    """Every row with ``last_ai_text, last_ai_at, last_user_text`` as of that row."""
    return situate(df)


def since_ai(at: Column, last_ai_at: Column) -> Column:
    """Seconds from the assistant's last words to the start of speech; 1e9 when never."""
    # ``greatest`` skips nulls, so "never" has to be told apart first.
    return F.when((at - last_ai_at).isNotNull(), F.greatest(F.lit(0.0), at - last_ai_at)) \
        .otherwise(F.lit(V.NEVER_SPOKEN))


def awaiting_answer(last_ai_text: Column) -> Column:
    return F.endswith(T.strip(F.coalesce(last_ai_text, F.lit(""))), F.lit("?"))


def render_messages(df: DataFrame, turns: int = 6) -> DataFrame:
    """Every row with ``messages``: the last 2*turns turns, tool turns dropped after the cut."""
    d = _lookback(situate(df), "pos", {
        "__m": F.struct("role", F.col("text").alias("content"))}, turns * 2)
    return d.withColumn("messages", F.filter("__m", lambda m: m["role"] != "tool")).drop("__m")


def conversation_snapshot(df: DataFrame, verdicts: int = 4) -> DataFrame:
    """User rows with a ``snapshot`` struct: timing, open question, recent verdicts, contexts."""
    d = _lookback(users(df), "upos", {"__v": F.struct("ai_directed")}, verdicts)
    asked = awaiting_answer(F.col("last_ai_text"))
    host = F.col("active") if "active" in df.columns else F.array().cast("array<string>")
    contexts = F.array_union(host, F.when(asked, F.array(F.lit("awaiting_answer")))
                             .otherwise(F.array().cast("array<string>")))
    return d.withColumn("snapshot", F.struct(
        since_ai(F.col("at_s"), F.col("last_ai_at")).alias("since_ai"),
        asked.alias("awaiting_answer"),
        F.transform("__v", lambda s: s["ai_directed"]).alias("recent_verdicts"),
        contexts.alias("contexts"))).drop("__v")
