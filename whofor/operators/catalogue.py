"""The intent catalogue: declaring it, checking it, combining it.

A catalogue is a product's list of intents, so it is small by nature. Tables
(``intents``/``slots``) carry it between jobs; ``Catalogue`` holds it where a
plan is built, where it turns into literals rather than a join.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whofor import fixed as V

SLOT_TYPE = "struct<name:string,type:string,values:array<string>,required:boolean>"
INTENT_TYPE = ("struct<name:string,description:string,examples:array<string>,"
               f"slots:array<{SLOT_TYPE}>,min_confidence:double,needs_transcript:boolean,"
               "when:array<string>>")
CATALOGUE_TYPE = f"struct<format:string,name:string,version:string,intents:array<{INTENT_TYPE}>>"
FORMAT = "intent-catalogue/1"
OPEN_SPEC = {"name": V.OPEN_REQUEST, "needs_transcript": True,
             "description": "meant for the assistant, but needs the words"}
NAME_PATTERN = r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$"
SLOT_NAME_PATTERN = r"^[a-z][a-z0-9_]*$"


@dataclass(frozen=True)
class Catalogue:
    """Where a plan is built, a catalogue is a tuple of plain intent records."""

    intents: tuple
    name: str = "core"
    version: str = "1"

    @staticmethod
    def of(intents, name: str = "core", version: str = "1") -> "Catalogue":
        intents = [i for i in intents if i["name"] != V.OPEN_REQUEST]
        return Catalogue((*intents, OPEN_SPEC), name, version)

    @property
    def names(self) -> list[str]:
        return [i["name"] for i in self.intents]

    def slots(self, intent: str) -> list[dict]:
        for i in self.intents:
            if i["name"] == intent:
                return list(i.get("slots") or [])
        return []

    def slot_heads(self) -> dict[str, list[str]]:
        """'intent:slot' -> its classes, with the off-list class last."""
        return {f"{i['name']}:{s['name']}": [str(v) for v in s["values"]] + [V.OTHER]
                for i in self.intents for s in i.get("slots") or []}

    def extended(self, other: "Catalogue") -> "Catalogue":
        theirs = set(other.names) - {V.OPEN_REQUEST}
        kept = [i for i in self.intents if i["name"] not in theirs]
        return Catalogue.of([*kept, *other.intents], f"{self.name}+{other.name}",
                            f"{self.version}+{other.version}")

    def required(self) -> dict[str, list[str]]:
        return {i["name"]: [s["name"] for s in i.get("slots") or [] if s.get("required", True)]
                for i in self.intents}


CORE = Catalogue.of(V.CORE_INTENTS)


def by_intent(intent: Column, values: dict, default) -> Column:
    """A catalogue fact looked up by intent name, as a literal map."""
    items = {k: v for k, v in values.items() if v is not None}
    if not items:
        return F.lit(default)
    pairs = []
    for k, v in items.items():
        pairs += [F.lit(k), F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple))
                  else F.lit(v)]
    got = F.try_element_at(F.create_map(*pairs), intent)
    return got if default is None else F.coalesce(got, F.lit(default))


def read_catalogue(df: DataFrame, json_col: str) -> DataFrame:
    """One row per (catalogue, position) from JSON text; open_request is always there."""
    parsed = df.withColumn("c", F.from_json(json_col, CATALOGUE_TYPE))
    listed = parsed.select(
        *[c for c in df.columns if c != json_col],
        F.coalesce(F.col("c.name"), F.lit("custom")).alias("catalogue"),
        F.coalesce(F.col("c.version"), F.lit("1")).alias("version"),
        F.posexplode(F.coalesce(F.col("c.intents"), F.array().cast(f"array<{INTENT_TYPE}>")))
        .alias("position", "i"))
    keys = [c for c in df.columns if c != json_col]
    rows = listed.select(*keys, "catalogue", "version", "position", F.col("i.name").alias("intent"),
                         F.coalesce("i.description", F.lit("")).alias("description"),
                         F.coalesce("i.examples", F.array().cast("array<string>"))
                         .alias("examples"),
                         F.coalesce("i.slots", F.array().cast(f"array<{SLOT_TYPE}>"))
                         .alias("slots"), "i.min_confidence",
                         F.coalesce("i.needs_transcript", F.lit(False)).alias("needs_transcript"),
                         F.coalesce("i.when", F.array().cast("array<string>")).alias("contexts"))
    return add_open_request(rows, keys)


def add_open_request(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The open request, once, at the end of every catalogue that lacks it."""
    ends = rows.groupBy(*keys, "catalogue", "version").agg(
        (F.max("position") + 1).alias("position"),
        F.bool_or(F.col("intent") == V.OPEN_REQUEST).alias("has"))
    missing = ends.where(~F.col("has")).drop("has").select(
        "*", F.lit(V.OPEN_REQUEST).alias("intent"),
        F.lit(OPEN_SPEC["description"]).alias("description"),
        F.array().cast("array<string>").alias("examples"),
        F.array().cast(f"array<{SLOT_TYPE}>").alias("slots"),
        F.lit(None).cast("double").alias("min_confidence"),
        F.lit(True).alias("needs_transcript"),
        F.array().cast("array<string>").alias("contexts"))
    return rows.unionByName(missing)


def slot_table(intents: DataFrame) -> DataFrame:
    return intents.select("catalogue", "intent", F.posexplode("slots").alias("slot_position", "s")) \
        .select("catalogue", "intent", "slot_position", F.col("s.name").alias("slot"),
                F.col("s.type").alias("type"), F.col("s.values").alias("values"),
                F.coalesce("s.required", F.lit(True)).alias("required"))


def write_catalogue(intents: DataFrame) -> DataFrame:
    """Back to one JSON text per catalogue; intents keep their order."""
    record = F.struct(
        "position", F.struct(
            F.col("intent").alias("name"), F.nullif("description", F.lit("")).alias("description"),
            F.when(F.size("examples") > 0, F.col("examples")).alias("examples"),
            F.when(F.size("slots") > 0, F.col("slots")).alias("slots"), "min_confidence",
            F.when(F.col("needs_transcript"), True).alias("needs_transcript"),
            F.when(F.size("contexts") > 0, F.col("contexts")).alias("when")).alias("i"))
    return intents.groupBy("catalogue", "version").agg(
        F.array_sort(F.collect_list(record)).alias("rows")).select(
        "catalogue", F.to_json(F.struct(
            F.lit(FORMAT).alias("format"), F.col("catalogue").alias("name"), "version",
            F.transform("rows", lambda r: r["i"]).alias("intents"))).alias("json"))


def from_rows(intents: DataFrame) -> Catalogue:
    """A catalogue table as plan literals (a product's intents: small by definition)."""
    limit = 2000
    rows = intents.orderBy("position").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a catalogue holds at most {limit} intents")
    return Catalogue.of([
        {"name": r["intent"], "description": r["description"], "examples": list(r["examples"]),
         "slots": [s.asDict() for s in r["slots"]], "min_confidence": r["min_confidence"],
         "needs_transcript": r["needs_transcript"], "when": list(r["contexts"])}
        for r in rows], rows[0]["catalogue"], rows[0]["version"])


def intent_rows(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    text = json.dumps({"format": FORMAT, "name": catalogue.name, "version": catalogue.version,
                       "intents": [{**i, "slots": [{**s, "values": [str(v) for v in s["values"]]}
                                                   for s in i.get("slots") or []]}
                                   for i in catalogue.intents]})
    return read_catalogue(spark.createDataFrame([(text,)], "json string"), "json")


def check_catalogue(intents: DataFrame, slots: DataFrame) -> DataFrame:
    """One row ``(catalogue, item, problem)`` per violation; none when it is sound."""
    def problems(df, item, keys, rules, twice):
        """One read: row rules as an array, duplicates by a count of the same exchange."""
        found = F.array_compact(F.array(*[F.when(cond, F.lit(problem)) for problem, cond in rules.items()]))
        per = df.select(*keys, item.alias("item"), found.alias("found")).groupBy(*keys, "item").agg(
            F.flatten(F.collect_list("found")).alias("found"), F.count(F.lit(1)).alias("n"))
        every = F.concat("found", F.when(F.col("n") > 1, F.array(F.lit(twice)))
                         .otherwise(F.array().cast("array<string>")))
        return per.select("catalogue", "item", F.explode(every).alias("problem"))
    return problems(intents, F.col("intent"), ["catalogue", "intent"], {
        "bad intent name": ~F.col("intent").rlike(NAME_PATTERN),
        "min_confidence must be in (0, 1]": F.col("min_confidence").isNotNull()
        & ((F.col("min_confidence") <= 0) | (F.col("min_confidence") > 1)),
        "unknown context": F.size(F.array_except("contexts", F.array(*map(F.lit, V.CONTEXTS)))) > 0,
    }, "duplicate intent name").unionByName(
        problems(slots, F.concat_ws(":", "intent", "slot"), ["catalogue", "intent", "slot"], {
            "bad slot name": ~F.col("slot").rlike(SLOT_NAME_PATTERN),
            "unknown slot type": ~F.col("type").isin(*V.SLOT_TYPES),
            "slot declares no values": F.coalesce(F.size("values"), F.lit(0)) <= 0,
            "duplicate slot values": F.size(F.array_distinct("values")) < F.size("values"),
        }, "duplicate slot name"))


def extend_catalogue(base: DataFrame, other: DataFrame) -> DataFrame:
    """Base intents plus the other's; the other wins a clash, the open request comes last.

    The other's positions follow the base's last one, whatever their size.
    """
    def core(df):
        return df.where(F.col("intent") != V.OPEN_REQUEST)
    after = F.coalesce(core(base).select(F.max("position") + 1).scalar(), F.lit(0))
    kept = core(base).join(core(other).select("intent"), "intent", "left_anti")
    new = core(other).withColumn("position", after + F.col("position"))

    def tag(column):
        return F.concat(F.lit(base.select(F.max(column)).scalar()), F.lit("+"),
                        F.lit(other.select(F.max(column)).scalar()))
    merged = kept.unionByName(new).withColumns({
        "catalogue": tag("catalogue"), "version": tag("version")})
    return add_open_request(merged)
