"""Chat formatting from event logs: fold each conversation's events into messages, then render.

Events are ``conversation, seq, kind, message, role, text``. Within a conversation they are taken
by ``seq`` and folded:

* ``message`` opens a message with a role and the text it begins with;
* ``delta`` adds its text to the message;
* ``edit`` puts its text in place of the message's;
* ``regenerate`` does the same (most often with nothing, for deltas to follow), and drops the
  messages that were opened after that message and before this event: they answered the old text
  (also where that message was dropped itself).

An event without a message id belongs to the message opened last. A ``message`` event with an id
that was opened before opens another message. Events for an id that was never opened make a message
without a role. Null text and null role are empty. Other kinds and null kinds are passed over. Null
``seq`` comes first; ties go by kind in the order above, then role, then text; each of several equal
rows counts. A null conversation is one conversation. Other columns are not read. An empty log gives
an empty result. A conversation's rendered text is one value, so it has to fit into one.

All of it is DataFrame functions. Events are exchanged once, by conversation; windows and both
groupings use that partitioning.

A turn is rendered as ``<s>role[INST]text[/INST]</s>``. Control strings inside roles and texts get
one more backslash after their first character, which reading takes away again.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whofor.llm.pii import running_sum
from whofor.llm.tokens import read_table

KINDS = ("message", "regenerate", "edit", "delta")
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>"
#: The place after the first character of a control string, with the backslashes there.
INSIDE = r"(?<=<)\\*+(?=/?s>)|(?<=\[)\\*+(?=/?INST\])"
ESCAPED = r"(?<=<)\\(?=\\*+/?s>)|(?<=\[)\\(?=\\*+/?INST\])"
SPANS = "array<struct<start:bigint,stop:bigint>>"


def escaped(text: Column) -> Column:
    """The text without control strings; ``unescaped`` gives it back."""
    return F.regexp_replace(text, INSIDE, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "")


def fold_events(events: DataFrame, conversation: str = "conversation", seq: str = "seq", kind: str = "kind",
                message: str = "message", role: str = "role", text: str = "text") -> DataFrame:
    """``conversation, messages``: the final messages (role, text) in the order they were opened."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(f"`{kind}`").cast("string")).cast("int")
    log = events.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{seq}`").alias("seq"),
                        rank.alias("kind"), F.col(f"`{message}`").cast("string").alias("id"),
                        F.col(f"`{role}`").cast("string").alias("role"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    log = log.where(F.col("kind") > 0).repartition("conversation")
    whole = Window.partitionBy("conversation").orderBy(
        F.col("seq").asc_nulls_first(), "kind", F.col("role").asc_nulls_first(), "text")
    opens, begins = F.col("kind") == 1, F.col("kind") <= 3
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumns({
        "at": F.row_number().over(whole),
        "last_id": F.last(F.when(opens, F.struct("id")), ignorenulls=True).over(so_far)})
    log = log.withColumn("id", F.coalesce("id", F.col("last_id.id")))
    one = Window.partitionBy("conversation", "id").orderBy("at")
    log = log.withColumn("nth", F.sum(opens.cast("int")).over(
        one.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    key = Window.partitionBy("conversation", "id", "nth")
    log = log.withColumns({"opened": F.min("at").over(key), "from": F.max(F.when(begins, F.col("at"))).over(key)})
    # A later regeneration of an earlier message drops this one.
    later = Window.partitionBy("conversation").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("redone", F.min(F.when(F.col("kind") == 2, F.col("opened"))).over(later))
    part = F.when((F.col("at") >= F.col("from")) | F.col("from").isNull(), F.struct("at", "text"))
    messages = log.groupBy("conversation", "id", "nth").agg(
        F.min("opened").alias("opened"),
        F.max(F.when(F.col("at") == F.col("opened"), F.coalesce(F.col("redone") < F.col("opened"), F.lit(False))))
        .alias("dropped"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("at", "role"))).alias("last"),
        F.sort_array(F.collect_list(part)).alias("parts"))
    messages = messages.where(~F.col("dropped")).select("conversation", F.struct(
        "opened", F.coalesce("last.role", F.lit("")).alias("role"),
        F.array_join("parts.text", "").alias("text")).alias("m"))
    return messages.groupBy("conversation").agg(F.sort_array(F.collect_list("m")).alias("m")).select(
        "conversation", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
        .alias("messages"))


def render(folded: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conversation, n_turns, formatted, loss_spans``: one span a turn, empty but for ``learn``.

    Spans are code points of ``formatted``, end exclusive.
    """
    turns = F.transform("messages", lambda m: F.struct(escaped(m["role"]).alias("role"), escaped(m["text"]).alias("text"),
                                                       (m["role"] == learn).alias("learn")))
    shown = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE)))
    stops = running_sum(F.transform("turns", lambda t: (
        F.char_length(t["role"]) + F.char_length(t["text"]) + len(OPEN + MIDDLE + CLOSE)).cast("bigint")))
    spans = F.zip_with("turns", stops, lambda t, stop: F.struct(
        F.when(t["learn"], stop - len(CLOSE) - F.char_length(t["text"])).otherwise(stop).alias("start"),
        F.when(t["learn"], stop - len(CLOSE)).otherwise(stop).alias("stop")))
    return folded.withColumn("turns", turns).select(
        "conversation", F.size("messages").cast("long").alias("n_turns"),
        F.array_join(shown, "").alias("formatted"), spans.cast(SPANS).alias("loss_spans"))


def read_back(formatted: Column, spans: Column) -> dict[str, Column]:
    """``turns`` (role, text) and the ``learnt`` texts, from a rendered conversation alone."""
    parts = F.filter(F.split(formatted, OPEN, -1), lambda p, i: i > 0)
    role = lambda p: F.substring_index(p, MIDDLE, 1)

    def turn(p):
        begin = F.char_length(role(p)) + len(MIDDLE)
        return F.struct(unescaped(role(p)).alias("role"), unescaped(F.substring(
            p, begin + 1, F.char_length(p) - begin - len(CLOSE))).alias("text"))

    ends = running_sum(F.transform(parts, lambda p: (F.char_length(p) + len(OPEN)).cast("bigint")))
    placed = F.zip_with(parts, ends, lambda p, end: F.struct(p.alias("p"), (end - F.char_length(p)).alias("at")))
    learnt = F.zip_with(placed, spans, lambda x, s: F.when(s["start"] < s["stop"], unescaped(F.substring(
        x["p"], (s["start"] - x["at"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))).otherwise(""))
    return {"turns": F.transform(parts, turn), "learnt": learnt}


def format_chats(events: DataFrame, learn: str = "assistant", **columns: str) -> DataFrame:
    """Each conversation of an event log as one text with the spans to learn from."""
    return render(fold_events(events, **columns), learn)


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as an event log: each row opens a message and says it whole."""
    return conversations.select(F.col("conv_id").alias("conversation"), F.col("turn").cast("long").alias("seq"),
                                F.lit("message").alias("kind"), F.col("turn").cast("string").alias("message"),
                                "role", "text")


def op12_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -7 is a log of a streamed, edited and regenerated exchange."""
    said = "</s>[INST] ok [/INST]"
    planted = [(-7, 0, "message", "u", "user", "</s>[INST] no"), (-7, 1, "edit", "u", None, "</s>[INST] o"),
               (-7, 2, "delta", "u", None, "k [/INST]"), (-7, 3, "message", "a", "assistant", "<s>"),
               (-7, 4, "delta", "a", None, "first try"), (-7, 5, "regenerate", "a", None, None),
               (-7, 6, "delta", None, None, said[:7]), (-7, 7, "delta", None, None, said[7:])]
    names = ("conversation", "seq", "kind", "message", "role", "text")
    rows = F.array(*[F.struct(*[F.lit(v).cast("long" if n in names[:2] else "string").alias(n)
                                for n, v in zip(names, event)]) for event in planted])
    log = rows_as_events(read_table(spark, sf_dir, "conversations")).union(spark.range(1).select(F.inline(rows)))
    done = format_chats(log).select("*", *[c.alias(n) for n, c in read_back(
        F.col("formatted"), F.col("loss_spans")).items()])
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return done.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
