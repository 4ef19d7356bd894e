"""Path helpers against the patterns that define them, and look-ups that are reduced by hash."""

import itertools

from pyspark.sql import functions as F

from loreweave.functions import text as X
from loreweave.functions import constants as K
from loreweave.operators import resolve, tags


def test_helpers_against_patterns(spark):
    parts = ["", ".", "..", "a", ".a", "a.", "a.b", "..a.b.ts", "bin", "b\nc.x", "obj.d"]
    paths = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(parts, repeat=n)] + [None]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    p, parted = F.col("path"), F.split("path", "/")
    wanted = {
        "extension": (X.extension(p), F.regexp_extract(p, r"(?s)(?:^|/)\.*[^./][^/]*?(\.[^./]*)\z", 1)),
        "basename": (X.basename(p), F.element_at(parted, -1)),
        "dot": (X.has_dot_segment(p), p.rlike(r"(^|/)\.")),
        "within": (X.in_directory(p, ["bin", "a.b"]), F.arrays_overlap(F.slice(parted, F.lit(1), F.size(parted) - 1), F.array(F.lit("bin"), F.lit("a.b")))),
    }
    for name, (got, want) in wanted.items():
        assert df.where(~got.eqNullSafe(want)).collect() == [], name


def test_strip_takes_every_white_space(spark):
    rows = [(chr(i) + "a" + chr(i) + "b" + chr(i),) for i in range(1, 0x3100) if not 0xD800 <= i < 0xE000]
    c = F.col("c")
    assert spark.createDataFrame(rows, "c string").where(X.strip(c) != F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")).count() == 0


def test_verbs_against_their_pattern(spark):
    edges = ["", " ", "x", "_", "é", "@", "#[", "(", "Mapping", "mapping(", "\n", "-", "́"]
    words = ["GET", "get", "Get", "POST", "poſt", "PUT", "DELETE", "patch"]
    texts = [a + w + b for a in edges for w in words for b in edges] + ["GETGET GET", "@getmapping GETX", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    want = F.array_compact(F.array(*[F.when(t.rlike(rf"(?U)\b{v}\b|(?i:@{v}Mapping)|#\[{v.lower()}\("), F.lit(v)) for v in K.GENERIC_VERBS]))
    assert df.where(~tags.generic_verbs(t).eqNullSafe(want)).collect() == []


def test_roots_are_reduced_by_hash(spark):
    files = spark.createDataFrame([("r", p) for p in ("a/x.tsx", "a/x.ts", "a/x", "a/y.js", "b.ts/z.md", "b.tsx")], "repo_id string, path string")
    found = resolve.paths_by_root(resolve.file_index(files), K.RELATED_EXTENSIONS)
    assert {(r.root, r.file) for r in found.collect()} == {("a/x", "a/x.ts"), ("a/y", "a/y.js"), ("b", "b.tsx"), *((p, p) for p in ("a", "a/x.ts", "a/x.tsx", "a/y.js", "b.ts", "b.ts/z.md", "b.tsx"))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
