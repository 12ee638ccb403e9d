"""Clips in, numbers out: batch jobs over manifests of audio.

The audio itself only ever lives inside a task, one Arrow batch at a time.
Every job here is a map: it scales with the number of clips and shuffles only
where a manifest is joined to its files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions import audio as A
from whofor.functions.scalars import is_true
from whofor.operators.gate import GateInputs, context_from_manifest, gate_features
from whofor.operators.ordering import number_rows
from whofor.operators.policy import resolve_provenance
from whofor.session import small_batches

PROSODY_TYPE = ", ".join(f"{n} double" for n in V.PROSODY_NAMES)
PIECE_BYTES = 8 << 20


def _pieces(pdf: pd.DataFrame, keep: list[str], names: list[str], rows: Iterable[tuple]):
    """Frames of about ``PIECE_BYTES``: what ``rows`` makes of a batch, beside its columns ``keep``.

    A row of a few bytes can become a whole clip, so a bound on the batches that come in does not
    bound what they become.
    """
    done, held, size = 0, [], 0

    def piece():
        return pd.concat([pdf[keep].iloc[done:done + len(held)].reset_index(drop=True),
                          pd.DataFrame(held, columns=names)], axis=1)
    for row in rows:
        held.append(row)
        size += sum(x.nbytes for v in row for x in (v if isinstance(v, list) else [v])
                    if isinstance(x, np.ndarray))
        if size >= PIECE_BYTES:
            yield piece()
            done, held, size = done + len(held), [], 0
    if held:
        yield piece()


def _map_clips(df: DataFrame, work: Callable, extra: str) -> DataFrame:
    """Run ``work(row dict, pcm) -> dict`` over clips with ``pcm``; failures fill ``error``."""
    keep = [c for c in df.columns if c not in ("pcm", "error")]
    names = [c.split()[0] for c in extra.split(", ")]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
                       + [extra, "error string"])
    small_batches(df.sparkSession)

    def made(pdf):
        errors = pdf["error"] if "error" in pdf.columns else [None] * len(pdf)
        for pcm, err in zip(pdf["pcm"], errors):
            out = dict.fromkeys(names)
            if err is None and pcm is None:
                err = "no audio"
            if err is None:
                try:
                    out.update(work(np.asarray(pcm, dtype=np.float32)))
                except Exception as exc:
                    err = f"{type(exc).__name__}: {exc}"
            yield (*out.values(), err)

    def run(batches):
        for pdf in batches:
            yield from _pieces(pdf, keep, [*names, "error"], made(pdf))
    return df.mapInPandas(run, schema)


def scan_clips(manifest: DataFrame, files: DataFrame, rate: int = A.RATE) -> DataFrame:
    """Manifest rows with ``pcm`` or ``error``, from a ``binaryFile`` source.

    The join is on the path; each row decodes only its own slice. A bad clip
    keeps its row and says why instead of ending the job.
    """
    content = files.select(F.regexp_replace("path", "^file:/+", "/").alias("__path"), "content")
    d = manifest.join(content, F.col("path") == F.col("__path"), "left").drop("__path")
    keep = [c for c in d.columns if c not in ("content",)]
    schema = ", ".join([f"`{c}` {d.schema[c].dataType.simpleString()}" for c in keep]
                       + ["pcm array<float>", "seconds double", "error string"])
    has = {"start": "start" in keep, "end": "end" in keep}

    small_batches(d.sparkSession)

    def made(pdf):
        for i, content in enumerate(pdf["content"]):
            pcm = err = None
            try:
                if content is None:
                    raise FileNotFoundError("file not found")
                cut = {k: pdf[k].iat[i] if has[k] else None for k in has}
                cut = {k: None if v is None or v != v or v == "" else float(v)
                       for k, v in cut.items()}
                pcm, got = A.decode_wav(content, cut["start"], cut["end"])
                if got != rate:
                    raise ValueError(f"{got} Hz; clips must be {rate} Hz")
                if not pcm.size:
                    raise ValueError("empty clip")
            except Exception as exc:
                pcm, err = None, str(exc) or type(exc).__name__
            yield pcm, None if pcm is None else pcm.size / rate, err

    def run(batches):
        for pdf in batches:
            yield from _pieces(pdf, keep, ["pcm", "seconds", "error"], made(pdf))
    return d.mapInPandas(run, schema)


def prosody_features(clips: DataFrame) -> DataFrame:
    """Nine scale-invariant features per clip."""
    return _map_clips(clips, A.prosody, PROSODY_TYPE)


def build_gate_rows(manifest: DataFrame, files: DataFrame, rate: int = A.RATE) -> DataFrame:
    """Feature rows from a labelled manifest; refused or broken rows keep their ``error``.

    Rows refused on label or provenance are filtered out *before* the Python
    stage, so their audio is never read.
    """
    d = resolve_provenance(manifest)
    bad_label = ~is_true(F.trim(F.coalesce("label", F.lit(""))).isin(*V.GATE_LABELS))
    d = d.withColumn("refused", F.when(bad_label, "unknown label").otherwise(F.col("refusal")))
    d = d.drop("refusal")
    good = prosody_features(scan_clips(d.where("refused is null").drop("refused"), files, rate))
    given = F.nullif(F.trim(F.coalesce(F.col("vad_confidence").cast("string"), F.lit(""))),
                     F.lit("")).try_cast("double")
    inputs = context_from_manifest(F.col("seconds"), F.coalesce(given, F.lit(1.0)))
    good = good.withColumns({f"__{n}": c for n, c in gate_features(inputs).items()})
    out = good.select(
        "row_number", "path", "error", F.trim("label").alias("label"),
        F.col("p_source").alias("source"), F.col("p_license").alias("license"),
        F.col("p_consent").alias("consent"),
        *[F.trim(F.coalesce(F.col(k), F.lit(""))).alias(k) for k in V.GROUP_KEYS],
        *V.PROSODY_NAMES,
        *[F.col(f"__{n}").alias(n) for n in V.FEATURE_NAMES[len(V.PROSODY_NAMES):]])
    refused = d.where("refused is not null").select(
        "row_number", "path", F.col("refused").alias("error"))
    return out.unionByName(refused, allowMissingColumns=True)


def deletable_sources(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Consented files whose every clip was processed: the caller may delete these."""
    ours = manifest.where(F.lower(F.trim(F.coalesce("source", F.lit("")))) == "consented") \
        .select("path").distinct()
    return rows.join(ours, "path", "left_semi").groupBy("path").agg(
        F.bool_and(F.col("error").isNull()).alias("ok")).where("ok").select("path")


# -- embeddings ---------------------------------------------------------------------------------

def embed(clips: DataFrame, encoder: Callable[[np.ndarray], np.ndarray], spec: str) -> DataFrame:
    """``id, vector, encode_ms, spec`` for any encoder callable; failures are left out."""
    import time

    def work(pcm):
        t0 = time.perf_counter()
        v = np.asarray(encoder(pcm), dtype=np.float32)
        return {"vector": v, "encode_ms": (time.perf_counter() - t0) * 1000.0}
    d = _map_clips(clips.select("id", "pcm"), work, "vector array<float>, encode_ms double")
    return d.where("error is null").select("id", "vector", "encode_ms", F.lit(spec).alias("spec"))


def logmel_vector(pcm: np.ndarray, mode: str = "stats") -> np.ndarray:
    return A.pool(A.logmel_frames(pcm), mode)


def _frame_rows(clips: DataFrame, kernel) -> DataFrame:
    def work(pcm):
        return {"frames": list(np.asarray(kernel(pcm), dtype=np.float64))}
    d = _map_clips(clips.select("id", "pcm"), work, "frames array<array<double>>")
    return d.where("error is null").select("id", F.posexplode("frames").alias("t", "frame"))


def logmel_frames(clips: DataFrame) -> DataFrame:
    return _frame_rows(clips, A.logmel_frames)


def fbank_frames(clips: DataFrame) -> DataFrame:
    return _frame_rows(clips, A.fbank_frames)


def gate_vector(clips: DataFrame) -> DataFrame:
    """The 20 gate features of a clip at a cold start, as one vector."""
    d = prosody_features(clips.withColumn("seconds", F.size("pcm") / float(A.RATE)))
    cold = GateInputs(seconds=F.col("seconds"), confidence=F.lit(1.0),
                      p_own=F.lit(None).cast("double"), voice_confident=F.lit(False),
                      is_wearer=F.lit(None).cast("boolean"), since_ai=F.lit(V.NEVER_SPOKEN),
                      awaiting_answer=F.lit(False), confirming=F.lit(False),
                      offer_pending=F.lit(False),
                      recent_verdicts=F.array().cast("array<boolean>"))
    rest = gate_features(cold)
    return d.where("error is null").select("id", F.array(
        *[F.col(n) for n in V.PROSODY_NAMES], *rest.values()).alias("vector"),
        F.lit("gate:20").alias("spec"))


def pool_frames(frames: DataFrame, dim: int, mode: str = "stats") -> DataFrame:
    """``id, vector`` from ``id, t, frame``: mean, spread and maximum of each dimension.

    One summary per clip (and third) holds all dimensions in a buffer that tasks combine before the
    exchange, so the plan is the same for 64 dimensions and for 2048. The first ``n % 3`` thirds get
    the extra rows, by position and not by a sort. Frames of another length than ``dim`` fail.
    """
    whole = F.when(F.size("frame") == dim, F.col("frame").cast("array<double>")) \
        .otherwise(F.raise_error(F.lit(f"a frame does not have {dim} dimensions")))
    d = frames.select("id", "t", array_to_vector(whole).alias("x"))
    keys, stats = ["id"], Summarizer.metrics("mean", "variance", "max", "count")
    if mode == "stats_thirds":
        n = frames.groupBy("id").agg((F.max("t") + 1).alias("n"))
        d = d.join(n, "id")
        size, extra = F.floor(F.col("n") / 3), F.col("n") % 3
        first = size + F.when(extra > 0, 1).otherwise(0)
        second = first + size + F.when(extra > 1, 1).otherwise(0)
        d = d.withColumn("third", F.when(F.col("t") < first, 0).when(F.col("t") < second, 1).otherwise(2))
        thirds = d.groupBy("id", "third").agg(Summarizer.mean(F.col("x")).alias("m"))
        thirds = thirds.groupBy("id").agg(*[
            F.max(F.when(F.col("third") == k, vector_to_array("m"))).alias(f"m{k}") for k in range(3)])
    # The summary divides squares by n - 1, the pooled spread by n.
    done = d.groupBy(*keys).agg(stats.summary(F.col("x")).alias("s")).select(
        "id", vector_to_array("s.mean").alias("mean"), vector_to_array("s.max").alias("top"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(
            v * (F.col("s.count") - 1) / F.col("s.count"))).alias("spread"))
    parts = [F.col("mean"), F.col("spread"), F.col("top")]
    if mode == "stats_thirds":
        done = done.join(thirds, "id")
        parts += [F.coalesce(f"m{k}", "mean") for k in range(3)]
    return done.select("id", F.concat(*parts).alias("vector"))


def parse_spec(spec: Column) -> Column:
    """struct<kind, repo, layers, pooling> of an encoder spec string."""
    kind = F.regexp_extract(spec, r"^([^:]*)", 1)
    rest = F.regexp_extract(spec, r"^[^:]*:(.*)$", 1)
    bands = F.regexp_extract(rest, r"^([^:]*)", 1)
    tail = F.regexp_extract(rest, r"^[^:]*:(.*)$", 1)
    front = F.when(F.contains(rest, F.lit(":")), F.regexp_extract(rest, r"^(.*):[^:]*$", 1)) \
        .otherwise("")
    pooling = F.regexp_extract(rest, r"([^:]*)$", 1)
    layers = F.regexp_extract(front, r"@L(\d+)$", 1)
    repo = F.when(F.contains(front, F.lit("@L")), F.regexp_extract(front, r"^(.*)@L[^@]*$", 1)) \
        .otherwise(F.lit(""))

    def or_default(c, default):
        return F.when(c == "", default).otherwise(c)
    return (F.when(kind == "gate", F.struct(
        kind.alias("kind"), F.lit(None).cast("string").alias("repo"),
        F.lit(None).cast("int").alias("layers"), F.lit("stats").alias("pooling")))
        .when(kind == "logmel", F.struct(
            kind.alias("kind"), or_default(bands, "64").alias("repo"),
            F.lit(None).cast("int").alias("layers"), or_default(tail, "stats").alias("pooling")))
        .otherwise(F.struct(
            kind.alias("kind"), F.nullif(repo, F.lit("")).alias("repo"),
            layers.try_cast("int").alias("layers"), or_default(pooling, "stats").alias("pooling"))))


def format_spec(kind: Column, repo: Column, layers: Column, pooling: Column) -> Column:
    return (F.when(kind == "gate", "gate:20")
            .when(kind == "logmel", F.concat_ws(":", kind, repo, pooling))
            .otherwise(F.concat(kind, F.lit(":"), F.coalesce(repo, F.lit("")), F.lit("@L"),
                                F.coalesce(layers.cast("string"), F.lit("")), F.lit(":"),
                                pooling)))


# -- recipes --------------------------------------------------------------------------------------

def recipe_seed(clip_id: Column) -> Column:
    """The first 32 bits of SHA-1 of the id."""
    return F.conv(F.substring(F.sha1(clip_id), 1, 8), 16, 10).cast("long")


def expand_recipes(clips: DataFrame, copies: int = 1, seed: int = 0, noise: int = 0,
                   voices: int = 3, keep_clean: bool = True) -> DataFrame:
    """Clean rows plus k seeded recipes each, plus non-speech rows. No audio is touched.

    ``clips`` has ``id, path, g_addressed``. Babble is up to ``voices`` different paths drawn from
    all clips that are not for the assistant: those are numbered in the order of a hash of their
    id, a hash of the recipe's id draws numbers, and an equi-join fetches the paths.
    """
    pool = clips.where(F.col("g_addressed") != V.ASSISTANT).select(
        F.lit(0).alias("__all"), F.sha1("id").alias("__h"), F.col("id").alias("__from"), "path")
    size = F.nullif(pool.select(F.count(F.lit(1))).scalar(), F.lit(0))
    pool = number_rows(pool, ["__all"], ["__h", "__from"], F.substring("__h", 1, 2), "__at") \
        .select("__at", F.col("path").alias("__path"))
    k = F.explode(F.sequence(F.lit(-1 if keep_clean else 0), F.lit(copies - 1)))
    d = clips.withColumn("__k", k)
    new_id = F.when(F.col("__k") < 0, F.col("id")).otherwise(
        F.concat(F.col("id"), F.lit("-a"), F.col("__k").cast("string")))
    d = d.withColumn("__id", new_id)
    draw = recipe_seed(F.concat(F.col("__id"), F.lit(f"#{seed}-"), F.col("__j").cast("string")))
    draws = d.where("__k >= 0").select("__id", F.explode(F.sequence(F.lit(0), F.lit(voices - 1))).alias("__j")) \
        .withColumn("__at", F.pmod(draw, size)).join(pool, "__at") \
        .groupBy("__id").agg(F.array_sort(F.collect_set(F.struct("__j", "__path"))).alias("__drawn"))
    d = d.join(draws, "__id", "left")
    picks = F.coalesce(F.array_distinct(F.transform("__drawn", lambda s: s["__path"])),
                       F.array().cast("array<string>"))
    derived = F.col("__k") >= 0
    d = d.withColumns({
        "augment": F.when(derived, F.struct(recipe_seed(F.col("__id")).alias("seed"),
                                            picks.alias("babble"))),
        "room": F.when(derived, "simulated").otherwise("tts"),
        "mic": F.when(derived, "simulated").otherwise("tts"), "id": F.col("__id"),
        "generate": F.lit(None).cast("struct<kind:string,seed:bigint>")}) \
        .drop("__drawn", "__k", "__id")
    if not noise:
        return d
    nid = F.format_string("noise%02d-%04d", F.lit(seed), F.col("id"))
    made = clips.sparkSession.range(noise).select(nid.alias("id")).select(
        "id", F.lit(V.MEDIA).alias("g_addressed"),
        F.struct(F.lit("noise").alias("kind"), recipe_seed(F.col("id")).alias("seed"))
        .alias("generate"), F.lit("none").alias("room"), F.lit("none").alias("mic"))
    return d.unionByName(made, allowMissingColumns=True)


def augment_clips(clips: DataFrame) -> DataFrame:
    """Rebuild derived clips in memory: ``id, pcm, info`` from ``pcm``, ``augment``, ``generate``.

    The seed comes from the row, so the result does not depend on order or
    partitioning. ``babble_pcm`` (optional) is other people talking.
    """
    small_batches(clips.sparkSession)

    def made(pdf):
        for i in range(len(pdf)):
            gen, aug, pcm = (pdf[c].iat[i] for c in ("generate", "augment", "pcm"))
            babble = pdf["babble_pcm"].iat[i] if "babble_pcm" in pdf.columns else None
            info: dict = {}
            if gen is not None:
                pcm, info = A.noise_clip(int(gen["seed"]))
            elif aug is not None and pcm is not None:
                pcm, info = A.retake(np.asarray(pcm), int(aug["seed"]),
                                      None if babble is None else np.asarray(babble))
            yield pcm, json.dumps(info)

    def run(batches):
        for pdf in batches:
            yield from _pieces(pdf, ["id"], ["pcm", "info"], made(pdf))
    return clips.mapInPandas(run, "id string, pcm array<float>, info string")


def assign_voices(lines: DataFrame, voices: list[str], seed: int = 0) -> DataFrame:
    """A voice, a pseudonymous speaker, a rate and an id per scripted line (``pos`` is dense)."""
    from whofor.functions.scalars import hash_pick
    n = len(voices)
    table = F.array(*[F.lit(v) for v in voices])
    rates = F.array(*[F.lit(r).cast("int") for r in (None, 150, 170, 190, 210, 230)])
    at = F.when(F.col("pos") < n, F.col("pos").cast("int")).otherwise(
        hash_pick(f"voice{seed}", n, F.col("pos")))
    d = lines.withColumn("voice", F.get(table, at))
    return d.withColumns({
        "speaker": F.concat(F.lit("voice-"), F.substring(F.sha1("voice"), 1, 8)),
        "rate_wpm": F.get(rates, hash_pick(f"rate{seed}", 6, F.col("pos"))),
        "id": F.format_string("syn%02d-%05d", F.lit(seed), F.col("pos"))})
