"""Function renames between file versions, and healing of metadata that names them.

All matching happens inside the row of a version pair: the two function lists
of one file are arrays, so nothing is shuffled after versions are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreweave.functions import pysyntax
from loreweave.functions.text import extension
from loreweave.operators import skew
from loreweave.operators.ordered import with_previous, with_running
from loreweave.operators.pycode import function_names
from loreweave.session import materialise


def parse_versions(versions: DataFrame) -> DataFrame:
    """Replace each Python text by its functions: ``ok``, ``fns`` (name, fp) and ``names``.

    Parsing before pairing means every text is parsed once and never shuffled.
    """
    py = versions.where(F.lower(extension(F.col("path"))) == ".py")
    parsed = py.withColumn("_p", pysyntax.py_fingerprints("content"))
    return parsed.select(
        *[c for c in versions.columns if c != "content"],
        F.col("_p.ok").alias("ok"),
        F.col("_p.fns").alias("fns"),
        function_names(F.col("content")).alias("names"),
    )


def pair_versions(parsed: DataFrame, keys: list[str], order: str = "commit_seq") -> DataFrame:
    """Each parsed version beside the one before it; first versions are dropped."""
    return with_previous(parsed, keys, order, {"old_ok": "ok", "old_fns": "fns", "old_names": "names"})


def version_pairs(versions: DataFrame, keys: list[str], order: str = "commit_seq") -> DataFrame:
    """Each version with the text of the version before it."""
    return with_previous(versions, keys, order, {"old_content": "content"})


def fn_fingerprints(pairs: DataFrame, keys: list[str], order: str = "commit_seq") -> DataFrame:
    """Functions of each new version and whether their shape equals that of the version before."""
    both = pairs.where("ok and old_ok")
    before = F.map_from_arrays(F.col("old_fns.name"), F.col("old_fns.fp"))
    rows = both.select(*keys, order, before.alias("before"), F.explode("fns").alias("fn"))
    same = F.try_element_at("before", F.col("fn.name")) == F.col("fn.fp")
    return rows.select(
        *keys, order, F.col("fn.name").alias("name"), F.coalesce(same, F.lit(False)).alias("same_as_prev")
    )


def _without(fns: Column, names: Column) -> Column:
    return F.filter(fns, lambda f: ~F.array_contains(names, f["name"]))


def _exact(removed: Column, added: Column) -> Column:
    """Pairs of equal shape: within one shape the k-th removed meets the k-th added."""
    shared = F.array_intersect(removed["fp"], added["fp"])

    def matched(fp):
        olds = F.filter(removed, lambda f: f["fp"] == fp)["name"]
        news = F.filter(added, lambda f: f["fp"] == fp)["name"]
        n = F.least(F.size(olds), F.size(news))
        both = F.arrays_zip(F.slice(olds, F.lit(1), n).alias("a"), F.slice(news, F.lit(1), n).alias("b"))
        return F.transform(both, lambda z: F.struct(z["a"].alias("old_name"), z["b"].alias("new_name")))

    return F.flatten(F.transform(shared, matched))


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``exact``, ``singleton`` and ``regex``: arrays of (old_name, new_name) per version pair.

    ``regex`` is filled only where one of the texts did not parse, the others
    only where both did.
    """
    none = F.array().cast("array<struct<old_name:string,new_name:string>>")
    parsed = F.col("ok") & F.col("old_ok")
    staged = pairs.withColumn("removed", _without(F.col("old_fns"), F.col("fns.name"))).withColumn(
        "added", _without(F.col("fns"), F.col("old_fns.name"))
    )
    staged = staged.withColumn("exact", F.when(parsed, _exact(F.col("removed"), F.col("added"))).otherwise(none))
    left = F.array_except(F.col("removed.name"), F.col("exact.old_name"))
    right = F.array_except(F.col("added.name"), F.col("exact.new_name"))
    gone = F.array_except("old_names", "names")
    come = F.array_except("names", "old_names")

    def only(old, new):
        one = (F.size(old) == 1) & (F.size(new) == 1)
        pair = F.struct(F.get(old, F.lit(0)).alias("old_name"), F.get(new, F.lit(0)).alias("new_name"))
        return F.when(one, F.array(pair)).otherwise(none)

    return staged.withColumn("singleton", F.when(parsed, only(left, right)).otherwise(none)).withColumn(
        "regex", F.when(parsed, none).otherwise(only(gone, come))
    )


def renames(pairs: DataFrame, keep: list[str], kinds=("exact", "singleton", "regex")) -> DataFrame:
    """Rename rows of the chosen kinds: ``keep..., old_name, new_name``."""
    found = matched_pairs(pairs).select(*keep, F.explode(F.concat(*kinds)).alias("r"))
    return found.select(*keep, "r.old_name", "r.new_name")


def rename_map(found: DataFrame, order: list[str], keys: list[str] = []) -> DataFrame:
    """One new name per old name (and key): the last in ``order`` wins."""
    return found.groupBy(*keys, "old_name").agg(F.max_by("new_name", F.struct(*order)).alias("new_name"))


def rename_closure(found: DataFrame, order: str = "commit_no") -> DataFrame:
    """Where the renames of several commits lead: ``order, old_name, new_name, hops``, a row per rename.

    ``found`` has one ``new_name`` per ``order`` (a commit's place in time) and ``old_name``.
    A rename is followed by the first one of its new name in a later commit, so a
    name that is given back and used anew is followed as it was when the rename took
    place, and cycles end with time.  Each rename points to its follower; pointers are
    doubled until all point to an end, in as many rounds as the longest chain has
    binary digits.
    """
    edges = materialise(found.select(F.col(order).alias("at"), "old_name", "new_name"))
    # By falling time, arrivals at a name before departures of the same commit: the last departure seen is the follower.
    events = edges.select(F.col("old_name").alias("name"), (-F.col("at")).alias("back"), F.lit(1).alias("leaves"), (-F.col("at")).alias("left"), F.lit(None).cast("string").alias("origin")).unionByName(
        edges.select(F.col("new_name").alias("name"), (-F.col("at")).alias("back"), F.lit(0).alias("leaves"), F.lit(None).cast("long").alias("left"), F.col("old_name").alias("origin"))
    )
    seen = with_running(events, ["name"], "back", {"next": (F.col("left"), "max")}, ties=["leaves", "origin"])
    follower = seen.where("leaves = 0").select((-F.col("back")).alias("at"), F.col("origin").alias("old_name"), (-F.col("next")).alias("next_at"))
    # ``to_at, to_name``: the rename it points to, null at an end; ``new_name``: the name it leads to so far.
    now = materialise(
        edges.join(follower, ["at", "old_name"]).select(
            "at", "old_name", "new_name", F.lit(1).cast("long").alias("hops"), F.col("next_at").alias("to_at"), F.when(F.col("next_at").isNotNull(), F.col("new_name")).alias("to_name")
        )
    )
    while now.where("to_at is not null").limit(1).count():
        onward = now.select(F.col("at").alias("to_at"), F.col("old_name").alias("to_name"), F.col("new_name").alias("_new"), F.col("hops").alias("_hops"), F.col("to_at").alias("_at"), F.col("to_name").alias("_name"))
        moved = now.where("to_at is not null").join(onward, ["to_at", "to_name"]).select(
            "at", "old_name", F.col("_new").alias("new_name"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_at").alias("to_at"), F.col("_name").alias("to_name")
        )
        now = materialise(now.where("to_at is null").unionByName(moved))
    return now.select(F.col("at").alias(order), "old_name", "new_name", "hops")


def first_renames(closure: DataFrame, order: str = "commit_no") -> DataFrame:
    """Of each old name, where its first rename leads: the mapping for metadata older than all commits."""
    return closure.groupBy("old_name").agg(F.min_by("new_name", order).alias("new_name"))


def heal_dependencies(meta: DataFrame, mapping: DataFrame, keys: list[str] = []) -> DataFrame:
    """Metadata in which a dependency's whole name was renamed, with the new names.

    Only changed metadata is returned.  Names are looked up from the rows of the
    dependency lists, so the size of the mapping does not matter.
    """
    deps = meta.select("spec_id", F.posexplode("dependencies").alias("pos", "dep"))
    named = deps.select("spec_id", "pos", F.col("dep.name").alias("old_name"))
    # The mapping is the end of a long plan, and read for its counts and its rows.
    hits = skew.match(named, materialise(mapping), ["old_name"]).select(*keys, "spec_id", "pos", "new_name")
    changes = hits.groupBy(*keys, "spec_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "new_name"))).alias("changes")
    )
    healed = F.transform(
        "dependencies",
        lambda d, i: F.struct(
            d["type"].alias("type"),
            F.coalesce(F.try_element_at("changes", i), d["name"]).alias("name"),
            d["file"].alias("file"),
        ),
    )
    return changes.join(meta, "spec_id").withColumn("dependencies", healed).drop("changes")
