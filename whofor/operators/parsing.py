"""Transcript -> intent and slots, as column expressions over a transcript table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import text as T
from whofor.functions.scalars import is_true
from whofor.operators.catalogue import CORE, Catalogue, by_intent

NO_SLOTS = "map<string,string>"


def no_slots() -> Column:
    return F.create_map().cast(NO_SLOTS)


def match_examples(norm: Column, catalogue: Catalogue) -> Column:
    """struct<intent, slots> for the first custom example that matches in full, or null."""
    hits = []
    core = set(CORE.names)
    for spec in catalogue.intents:
        if spec["name"] in core:
            continue
        slots = {s["name"]: s for s in spec.get("slots") or []}
        for example in spec.get("examples") or []:
            pattern, groups = T.example_pattern(example, list(slots.values()))
            pairs = []
            for g, slot in enumerate(groups, 1):
                pairs += [F.lit(slot),
                          T.coerce_slot(F.regexp_extract(norm, pattern, g), slots[slot])]
            values = F.create_map(*pairs) if pairs else F.create_map()
            hits.append(F.when(norm.rlike(pattern), F.struct(
                F.lit(spec["name"]).alias("intent"), values.cast(NO_SLOTS).alias("slots"))))
    return F.coalesce(*hits) if hits else F.lit(None).cast(f"struct<intent:string,slots:{NO_SLOTS}>")


def first_rule(norm: Column, catalogue: Catalogue) -> Column:
    """The name of the first core rule found in the text, or null."""
    out = None
    for name, pattern in V.INTENT_RULES:
        if name in catalogue.names:
            out = F.when(norm.rlike(pattern), name) if out is None \
                else out.when(norm.rlike(pattern), name)
    return out if out is not None else F.lit(None).cast("string")


def parse_intent(df: DataFrame, text: Column, catalogue: Catalogue = CORE,
                 name: str = V.DEFAULT_NAME, aliases: tuple = (),
                 model_parse: Column | None = None, read_once: bool = True) -> DataFrame:
    """Adds ``normalised, parse_intent, parse_p, parse_slots, parse_method``.

    ``model_parse`` is an already validated struct<intent, slots> (see
    ``validate_model_parses``) used only where the words settle nothing. With
    ``read_once`` each distinct text of a table is parsed once and joined back.
    """
    def read(d, said):
        d = d.withColumn("normalised", T.normalise(F.coalesce(said, F.lit("")), name, aliases))
        norm = F.col("normalised")
        d = d.withColumn("__ex", match_examples(norm, catalogue))
        d = d.withColumn("__rule", F.when(F.col("__ex").isNull() & (norm != ""),
                                          first_rule(norm, catalogue)))
        return d.withColumn("__secs", F.when(F.col("__rule") == "timer.set", T.parse_duration(norm)))
    d = T.once_a_text(df, text, lambda t: read(t, F.col("__said"))) if read_once and not df.isStreaming \
        else read(df, text)
    norm = F.col("normalised")
    rule, ex, secs = F.col("__rule"), F.col("__ex"), F.col("__secs")
    untimed = (rule == "timer.set") & secs.isNull()
    asked = F.lit(None).cast(f"struct<intent:string,slots:{NO_SLOTS}>") \
        if model_parse is None else F.when(norm != "", model_parse)
    d = d.withColumn("__model", F.when(ex.isNull() & rule.isNull(), asked))
    model = F.col("__model")
    return d.withColumns({
        "parse_intent": (F.when(ex.isNotNull(), ex["intent"])
                         .when(untimed, V.OPEN_REQUEST).when(rule.isNotNull(), rule)
                         .when(model.isNotNull(), model["intent"]).otherwise(V.OPEN_REQUEST)),
        "parse_p": (F.when(norm == "", 0.5).when(ex.isNotNull(), 0.95).when(untimed, 0.8)
                    .when(rule.isNotNull(), 1.0).when(model.isNotNull(), 0.8).otherwise(0.9)),
        "parse_slots": (F.when(ex.isNotNull(), ex["slots"])
                        .when(secs.isNotNull(), F.create_map(F.lit("duration"),
                                                             secs.cast("string")))
                        .when(model.isNotNull(), model["slots"]).otherwise(no_slots())),
        "parse_method": (F.when(norm == "", "none").when(ex.isNotNull(), "example")
                         .when(rule.isNotNull(), "rule").when(model.isNotNull(), "llm")
                         .otherwise("none")),
    }).drop("__ex", "__rule", "__secs", "__model")


def validate_model_parses(reply: Column, catalogue: Catalogue) -> Column:
    """struct<intent, slots> from a model's reply; null when any part cannot be trusted."""
    text = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    obj = F.from_json(F.when(text != "", text), "intent string, slots map<string,string>")
    known = obj["intent"].isin(*catalogue.names)
    pairs = []
    for spec in catalogue.intents:
        for slot in spec.get("slots") or []:
            here = obj["intent"] == spec["name"]
            pairs.append(F.when(here, F.struct(
                F.lit(slot["name"]).alias("key"),
                T.coerce_slot(F.try_element_at(obj["slots"], F.lit(slot["name"])), slot)
                .alias("value"))))
    kept = F.filter(F.array_compact(F.array(*pairs)), lambda e: e["value"].isNotNull()) \
        if pairs else F.array().cast("array<struct<key:string,value:string>>")
    return F.when(is_true(known), F.struct(obj["intent"].alias("intent"),
                                           F.map_from_entries(kept).cast(NO_SLOTS).alias("slots")))


def missing_required(intent: Column, slots: Column, catalogue: Catalogue) -> Column:
    """Is a required slot of the intent absent from the map?"""
    needs = by_intent(intent, {k: v for k, v in catalogue.required().items() if v}, None)
    return F.coalesce(F.size(F.array_except(needs, F.map_keys(slots))) > 0, F.lit(False))
