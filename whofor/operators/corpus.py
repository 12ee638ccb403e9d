"""Scripted corpora: lines with gold labels, generated where they are needed.

A corpus of any size is ``spark.range`` plus seeded picks: a line depends only
on (seed, id), so it is the same in any partitioning and can be rebuilt after
a lost executor. Wording is a parameter; the defaults are a small sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import hash_pick, hash_unit
from whofor.functions.text import describe_duration
from whofor.operators.catalogue import CORE, Catalogue, by_intent

DEFAULT_MIX = {"typed": 0.40, "open": 0.18, "human": 0.20, "hard_negative": 0.10,
               "background": 0.12}
GOLD = {"typed": V.ASSISTANT, "open": V.ASSISTANT, "human": V.HUMAN,
        "hard_negative": V.HUMAN, "background": V.MEDIA}
NO_POLITENESS = ("confirm.yes", "confirm.no", "stop", "cancel", "repeat")
NAME_FORMS = ("{name}, {x}", "hey {name}, {x}", "{x}, {name}")
POLITE_FORMS = ("{x}", "please {x}", "{x} please", "could you {x}")
IDIOMS = {30: ("half a minute", "thirty seconds"), 90: ("a minute and a half",),
          150: ("two and a half minutes",), 1800: ("half an hour", "thirty minutes"),
          2700: ("three quarters of an hour",), 3600: ("an hour", "sixty minutes"),
          5400: ("an hour and a half",), 7200: ("two hours",)}


@dataclass(frozen=True)
class Wording:
    """Templates per category; ``{key}`` is filled from ``options[key]``."""

    lines: dict = field(default_factory=lambda: {
        "open": ["what is the capital of {country}", "remind me to {chore}",
                 "how do I cook {food}", "is {place} open today"],
        "human": ["did you remember to {chore}", "shall we go to {place} later",
                  "I think the {food} is ready", "{person} said it was closed"],
        "hard_negative": ["what time is it, {person}", "{person}, stop it",
                          "turn it down a bit, I am on the phone", "sure, go ahead"],
        "background": ["and now the news from {place}", "more after the break",
                       "set a timer for ten minutes and let the {food} rest"]})
    options: dict = field(default_factory=lambda: {
        "country": ["Peru", "Kenya", "Norway"], "chore": ["water the plants", "pay the rent"],
        "food": ["soup", "bread", "rice"], "place": ["the market", "the station", "the coast"],
        "person": ["Robin", "Kim", "Ash"]})


def _choices(d: dict) -> Column:
    pairs = []
    for k, v in d.items():
        pairs += [F.lit(k), F.array(*[F.lit(x) for x in v])]
    return F.create_map(*pairs)


def _draw(options: Column, salt: str, *keys) -> Column:
    return F.get(options, hash_pick(salt, F.greatest(F.size(options), F.lit(1)), *keys))


def fill_template(template: Column, options: dict, seed: str, *keys) -> Column:
    """Every ``{key}`` replaced by its own seeded pick; unknown keys are left alone."""
    table = _choices(options)
    pieces = F.split(template, r"(?=\{)|(?<=\})")

    def fill(piece, i):
        picks = F.try_element_at(table, F.regexp_extract(piece, r"^\{([a-z_]+)\}$", 1))
        return F.coalesce(_draw(picks, seed, *keys, i), piece)
    return F.array_join(F.transform(pieces, fill), "")


def render_example(template: Column, slots: dict[str, Column]) -> Column:
    """``{slot}`` replaced by its text; a slot without one becomes empty."""
    out = template
    for name, text in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(text, F.lit("")))
    return out


def spoken_duration(seconds: Column, seed: str, *keys) -> Column:
    """An idiom for this length seven times in ten when there is one, else the plain form."""
    idioms = F.try_element_at(_choices({str(k): v for k, v in IDIOMS.items()}),
                              seconds.cast("string"))
    return F.when(idioms.isNotNull() & (hash_unit(seed + "idiom?", *keys) < 0.7),
                  _draw(idioms, seed + "idiom", *keys)).otherwise(describe_duration(seconds))


def wrap_phrase(phrase: Column, intent: Column, name: str, seed: str, *keys) -> Column:
    """Politeness (unless the intent never takes it) and the name, each by a seeded draw."""
    def form(forms, salt, x):
        t = _draw(F.array(*map(F.lit, forms)), salt, *keys)
        return F.replace(F.replace(t, F.lit("{name}"), F.lit(name)), F.lit("{x}"), x)
    kind = ~intent.isin(*NO_POLITENESS) & (hash_unit(seed + "polite?", *keys) < 0.35)
    polite = F.when(kind, form(POLITE_FORMS, seed + "polite", phrase)).otherwise(phrase)
    return F.when(hash_unit(seed + "name?", *keys) < 0.45,
                  form(NAME_FORMS, seed + "name", polite)).otherwise(polite)


def build_corpus(spark: SparkSession, catalogue: Catalogue = CORE, size: int = 2000,
                 seed: int = 0, name: str = V.DEFAULT_NAME, mix: dict | None = None,
                 wording: Wording = Wording()) -> DataFrame:
    """``size`` lines mixed by category, with a ``order_key`` that shuffles them."""
    out = None
    for category, share in (mix or DEFAULT_MIX).items():
        ids = spark.range(int(round(share * size))).select(
            F.concat(F.lit(category + "-"), F.col("id").cast("string")).alias("id"),
            F.col("id").alias("n"), F.lit(category).alias("category"))
        out = ids if out is None else out.unionByName(ids)
    return script_lines(out, catalogue, seed, name, wording)


def script_lines(ids: DataFrame, catalogue: Catalogue = CORE, seed: int = 0,
                 name: str = V.DEFAULT_NAME, wording: Wording = Wording()) -> DataFrame:
    """A scripted line with its gold label for every ``id, n, category``.

    ``n`` deals the typed intents in turn. One map stage, no shuffle.
    """
    s = f"corpus{seed}"
    d = _typed(ids, catalogue, s, name)
    typed = F.col("category") == "typed"
    prose = _prose(s, name, wording)
    return d.select(
        "id", F.when(typed, F.col("typed_text")).otherwise(prose).alias("text"),
        F.try_element_at(F.create_map(*[F.lit(x) for kv in GOLD.items() for x in kv]),
                         F.col("category")).alias("g_addressed"),
        F.when(typed, F.col("g_intent")).when(F.col("category") == "open", V.OPEN_REQUEST)
        .alias("g_intent"),
        F.when(typed, F.col("typed_slots")).otherwise(F.create_map().cast("map<string,string>"))
        .alias("g_slots"), "category", F.xxhash64(F.lit(s), "id").alias("order_key"))


def _typed(ids: DataFrame, catalogue: Catalogue, s: str, name: str) -> DataFrame:
    specs = [i for i in catalogue.intents
             if i["name"] != V.OPEN_REQUEST and not i.get("needs_transcript")]
    key = F.col("id")
    d = ids.withColumn("g_intent", F.get(F.array(*[F.lit(i["name"]) for i in specs]),
                                         (F.col("n") % len(specs)).cast("int")))
    phrases = by_intent(F.col("g_intent"), {
        i["name"]: i.get("examples") or [i["name"].replace(".", " ")] for i in specs}, None)
    d = d.withColumn("template", _draw(phrases, s + "template", key))
    entries, texts = [], {}
    for spec in specs:
        for slot in spec.get("slots") or []:
            here = F.col("g_intent") == spec["name"]
            on = F.array(*[F.lit(str(v)) for v in slot["values"]])
            value = _draw(on, s + slot["name"], key)
            if slot["type"] == "duration":
                off = F.array(*[F.lit(str(v)) for v in V.OFF_LIST_DURATIONS])
                value = F.when(hash_unit(s + "on?", key) < 0.85, value) \
                    .otherwise(_draw(off, s + "off", key))
            col = f"__{spec['name']}:{slot['name']}"
            d = d.withColumn(col, F.when(here, value))
            v = F.col(f"`{col}`")
            text = spoken_duration(v.cast("long"), s, key) if slot["type"] == "duration" else v
            entries.append(F.when(here, F.struct(F.lit(slot["name"]).alias("key"),
                                                 v.alias("value"))))
            texts[slot["name"]] = F.coalesce(texts[slot["name"]], F.when(here, text)) \
                if slot["name"] in texts else F.when(here, text)
    text = render_example(F.col("template"), texts)
    text = F.regexp_replace(text, r"\b(minute|second|hour)s timer", "$1 timer")
    slots = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.create_map()
    return d.withColumns({
        "typed_text": wrap_phrase(text, F.col("g_intent"), name, s, key),
        "typed_slots": slots.cast("map<string,string>")})


def _prose(s: str, name: str, wording: Wording) -> Column:
    key = F.col("id")
    lines = by_intent(F.col("category"), wording.lines, None)
    text = fill_template(_draw(lines, s + "line", key), wording.options, s + "fill", key)
    forms = F.array(*map(F.lit, NAME_FORMS))
    called = F.replace(F.replace(_draw(forms, s + "called", key), F.lit("{name}"),
                                 F.lit(name)), F.lit("{x}"), text)
    return F.when((F.col("category") == "open") & (hash_unit(s + "called?", key) < 0.4),
                  called).otherwise(text)


# -- prompted sessions ----------------------------------------------------------------------------

def expand_script(sessions: DataFrame, script: list[dict], solo_text: dict) -> DataFrame:
    """One row per session, prompt and target speaker, in script order.

    ``sessions`` has ``session, speakers``; a prompt is ``label, text, seconds,
    who`` and perhaps ``intent``. The script is a product constant, so it is
    exploded from a literal and every session is expanded where it already is.
    """
    prompts = F.array(*[F.struct(
        F.lit(i).alias("prompt"), F.lit(p["label"]).alias("label"),
        F.lit(p.get("intent")).cast("string").alias("intent"), F.lit(p["text"]).alias("text"),
        F.lit(float(p["seconds"])).alias("seconds"), F.lit(p.get("who", "each")).alias("who"))
        for i, p in enumerate(script)])
    solo = by_intent(F.col("p.label"), solo_text, None)
    targets = F.when(F.col("p.who") == "each", F.col("speakers")) \
        .when(F.col("p.who") == "all", F.array(F.array_join("speakers", "+"))) \
        .otherwise(F.array(F.lit("")))
    d = sessions.select("session", "speakers", F.explode(prompts).alias("p"))
    d = d.select("session", "p.*", F.size("speakers").alias("k"),
                 F.posexplode(targets).alias("at", "speaker"), solo.alias("solo"))
    # The step number is arithmetic on the script, so no session has to be ordered.
    each_before = [sum(1 for q in script[:i] if q.get("who", "each") == "each")
                   for i in range(len(script))]
    ones = F.get(F.array(*[F.lit(i - e) for i, e in enumerate(each_before)]), F.col("prompt"))
    many = F.get(F.array(*[F.lit(e) for e in each_before]), F.col("prompt"))
    text = F.when((F.col("k") == 1) & (F.col("who") == "all"),
                  F.coalesce("solo", "text")).otherwise(F.col("text"))
    return d.select("session", (ones + many * F.col("k") + F.col("at")).alias("step"), "label",
                    "intent", text.alias("text"), "seconds", "speaker", "who")


def consented_rows(segments: DataFrame, prompts: DataFrame) -> DataFrame:
    """Gold rows for recorded segments: the label is what the prompt asked for."""
    p = prompts.select("session", "step", "label", F.col("intent").alias("p_intent"),
                       F.col("speaker").alias("p_speaker"))
    d = segments.join(p, ["session", "step"])
    return d.select(
        "id", F.col("label").alias("g_addressed"),
        F.when(F.col("label") == V.ASSISTANT, F.col("p_intent")).alias("g_intent"),
        F.concat(F.lit("consented_"), F.col("label")).alias("category"),
        F.lit("consented").alias("source"), F.lit("consent").alias("license"), "consent",
        F.coalesce(F.nullif("p_speaker", F.lit("")), F.lit("media")).alias("speaker"),
        "session", "step", "room", "mic", F.round("duration", 3).alias("duration"))
