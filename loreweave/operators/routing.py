"""Intents routed to specifications, by rules or by parsed model replies."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import unfence
from loreweave.session import materialise
from loreweave.sources.catalog import is_json

BLOCK_CHARS = 16 << 20  # of patterns in one automaton

# Executors get these functions with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPLY = (
    "implicated_features array<string>, clarification_needed boolean, clarification_message string"
)


def _searched(block):
    """Rows with a text, each pattern of the block that occurs in it."""

    def run(iterator):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for pattern in block.value:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        for batch in iterator:
            texts = batch.column("_text").to_pylist()
            found = [list({p for _, p in automaton.iter(t)}) if t else [] for t in texts]
            rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(rows), pa.array([p for f in found for p in f], pa.string())], ["_row", "_sub"])

    return run


def containing(texts: DataFrame, keys: list[str], text: str, patterns: DataFrame, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Texts joined with the patterns that occur in them, case-folded: ``keys`` and the patterns' columns.

    The distinct patterns make up one automaton, and every text passes it once:
    work grows with the texts and with what is found, whatever the patterns have in
    common.  Patterns of more than ``block_chars`` characters together are dealt to several
    automata, each of which is one more pass.  Empty patterns match nothing.
    """
    spark = texts.sparkSession
    wanted = patterns.withColumn("_sub", F.lower(pattern)).where("_sub <> ''")
    distinct = wanted.select("_sub").distinct()
    total = distinct.agg(F.sum(F.length("_sub"))).first()[0] or 0
    blocks = total // block_chars + 1
    numbered = distinct.withColumn("_block", F.pmod(F.xxhash64("_sub"), F.lit(blocks)))
    folded = texts.select(F.struct(*keys).alias("_row"), F.lower(text).alias("_text"))
    kind = folded.schema["_row"].dataType.simpleString()
    found = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast([r[0] for r in numbered.where(F.col("_block") == b).select("_sub").collect()])  # ``block_chars`` of them, about
        some = folded.mapInArrow(_searched(sent), f"_row {kind}, _sub string")
        found = some if found is None else found.unionAll(some)
    return found.select("_row.*", "_sub").join(wanted, "_sub").drop("_sub")


def _numbered(matches: DataFrame, keys: list[str], order: list[str], top: int | None) -> DataFrame:
    """Matches of an intent in order; they are at most as many as there are specifications."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = matches.withColumn("pos", F.row_number().over(w))
    return (placed if top is None else placed.where(F.col("pos") <= top)).select(*keys, "pos", "spec_id")


def direct_matches(intents: DataFrame, keys: list[str], catalog: DataFrame) -> DataFrame:
    """Specifications whose identifier occurs in the intent."""
    return containing(intents, keys, "intent", catalog.select("spec_id"), "spec_id")


def route_intents(
    intents: DataFrame, keys: list[str], rules: DataFrame, catalog: DataFrame, top: int | None = None
) -> DataFrame:
    """Specifications per intent, the first ``top`` if asked for: ``keys..., pos, spec_id``.

    Identifiers named in the intent come in catalogue order; only an intent that
    names none is matched against the keyword rules, in rank order.
    """
    named = materialise(direct_matches(intents, keys, catalog).select(*keys, F.lit(0).alias("rank"), "spec_id"))
    usable = rules.join(catalog.select("spec_id"), "spec_id", "left_semi")
    others = intents.join(named.select(*keys).distinct(), keys, "left_anti")
    ruled = containing(others, keys, "intent", usable, "keyword").groupBy(*keys, "spec_id").agg(
        F.min("rank").alias("rank")
    )
    return _numbered(named.unionByName(ruled.select(*keys, "rank", "spec_id")), keys, ["rank", "spec_id"], top)


def parse_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of each model reply; ``ok`` is false where it is no JSON object."""
    body = F.col("_body")
    ok = F.coalesce(F.startswith(body, F.lit("{")) & is_json(body), F.lit(False))
    parsed = replies.withColumn("_body", unfence(F.col("reply"))).select(
        *keys, ok.alias("ok"), F.from_json(F.when(ok, body), REPLY).alias("r")
    )
    return parsed.select(
        *keys,
        "ok",
        F.coalesce("r.implicated_features", F.array()).alias("spec_ids"),
        F.coalesce("r.clarification_needed", F.lit(False)).alias("needed"),
        F.col("r.clarification_message").alias("message"),
    )


def route_replies(parsed: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """Identifiers to retrieve, or a request to narrow the question."""
    broad = F.col("needed") if top is None else (F.size("spec_ids") > top) | F.col("needed")
    text = F.coalesce(F.nullif("message", F.lit("")), F.lit(K.TOO_BROAD_MESSAGE))
    return parsed.select(
        *keys,
        "ok",
        F.when(broad, F.array().cast("array<string>")).otherwise(F.col("spec_ids")).alias("spec_ids"),
        F.when(broad, text).alias("clarification"),
    )


def route_with_replies(
    intents: DataFrame, keys: list[str], replies: DataFrame, catalog: DataFrame, top: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Routes and clarifications from model replies.

    An intent whose reply is missing or unusable is routed by the identifiers it
    names.  Returns (``keys, pos, spec_id``; ``keys, clarification``).
    """
    decided = route_replies(parse_replies(replies, keys), keys, top).where("ok")
    told = decided.select(*keys, F.posexplode("spec_ids").alias("pos", "spec_id")).withColumn(
        "pos", F.col("pos") + 1
    )
    rest = intents.join(decided.select(*keys), keys, "left_anti")
    named = _numbered(direct_matches(rest, keys, catalog), keys, ["spec_id"], top)
    return told.unionByName(named), decided.where("clarification is not null").select(*keys, "clarification")
