"""Import and export extraction from source text, as arrays built in the row.

Every dialect is one expression over the text, so a corpus becomes an edge table
in one pass without a shuffle; positions are array positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loreweave.functions.text import WHITE, basename, extension, first_of, last_part, strip

# Patterns are fixed values.  (?U) gives Unicode classes, (?m) anchors at lines,
# (?d) lets only "\n" end a line.
TS_IMPORT = r"""(?U)import\s+(?:(?:\{([^}]+)\}|(\w+))\s+from\s+)?["']([^"']+)["']"""
TS_REQUIRE = r"""(?U)require\s*\(\s*["']([^"']+)["']\s*\)"""
PY_FROM = r"(?Umd)^\s*from\s+([\w\.]+)\s+import\s+(.+)$"
PY_IMPORT = r"(?Umd)^\s*import\s+([\w\.]+)"
JAVA_IMPORT = r"(?Umd)^\s*import\s+([\w\.]+);"
RUST_USE = r"(?Umd)^\s*use\s+([\w:\*\{\},\s]+);"
RUST_MOD = r"(?Umd)^\s*mod\s+(\w+);"
RUBY_REQUIRE = r"""(?U)(?:require|require_relative)\s+["']([^"']+)["']"""
GO_SINGLE = r'(?U)import\s+"([^"]+)"'
GO_BLOCK = r"(?U)import\s+\(\s*([\s\S]*?)\s*\)"
CS_USING = r"(?Umd)^\s*using\s+([\w\.]+);"
C_INCLUDE = r"""(?Umd)^\s*#include\s+["<]([^">]+)[">]"""
TS_EXPORTS = [
    r"(?U)export\s+(?:async\s+)?function\s+(\w+)",
    r"(?U)export\s+const\s+(\w+)\s*[=:]",
    r"(?U)export\s+class\s+(\w+)",
]
LINE_BREAK = r"\R|[\x1c-\x1e]"

IMPORT_TYPE = T.ArrayType(
    T.StructType([T.StructField("from", T.StringType()), T.StructField("names", T.ArrayType(T.StringType()))])
)


def _import(path: Column, names: Column) -> Column:
    return F.struct(path.alias("from"), names.alias("names"))


def _each(text: Column, pattern: str, build) -> Column:
    """One element per match; ``build`` receives a function giving the groups of that match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m: build(lambda g: F.regexp_extract(m, pattern, g)))


def _found(text: Column, pattern: str, word: str, group: int = 0) -> Column:
    """All matches of a pattern that begins with ``word``; texts without it are not searched."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.contains(text, F.lit(word)), matches).when(text.isNotNull(), _no_names())


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _trimmed_items(c: Column) -> Column:
    return F.transform(F.split(c, ","), strip)


def ts_imports(text: Column, with_require: bool = True) -> Column:
    # The pattern runs once over a text.  What a statement holds follows from its first and last characters, by
    # plain string functions: a pattern per group and statement costs several times the search.
    def build(m):
        rest = F.ltrim(F.substr(m, F.lit(len("import") + 1)), F.lit(WHITE))
        braces = F.substring_index(F.substr(rest, F.lit(2)), "}", 1)
        inner = F.transform(
            F.filter(_trimmed_items(braces), lambda n: n != ""),
            lambda n: F.substring_index(n, " as ", 1),
        )
        default = F.substring_index(F.translate(rest, WHITE, " " * len(WHITE)), " ", 1)
        bare = F.startswith(rest, F.lit('"')) | F.startswith(rest, F.lit("'"))
        names = F.when(F.startswith(rest, F.lit("{")), inner).when(bare, _no_names()).otherwise(F.array(default))
        quoted = F.substring_index(F.replace(m, F.lit("'"), F.lit('"')), '"', -2)
        return _import(F.substring_index(quoted, '"', 1), names)

    statements = F.transform(_found(text, TS_IMPORT, "import"), build)
    return F.concat(statements, ts_requires(text)) if with_require else statements


def ts_requires(text: Column) -> Column:
    return F.transform(_found(text, TS_REQUIRE, "require", 1), lambda name: _import(name, _no_names()))


def py_imports(text: Column) -> Column:
    return F.concat(
        _each(text, PY_FROM, lambda g: _import(g(1), _trimmed_items(g(2)))),
        _each(text, PY_IMPORT, lambda g: _import(g(1), F.array(g(1)))),
    )


def java_imports(text: Column) -> Column:
    return _each(text, JAVA_IMPORT, lambda g: _import(g(1), F.array(last_part(g(1), "."))))


def rust_imports(text: Column) -> Column:
    def use(g):
        path = F.replace(strip(g(1)), F.lit(" "), F.lit(""))
        return _import(path, F.array(last_part(path, "::")))

    return F.concat(
        _each(text, RUST_USE, use),
        _each(text, RUST_MOD, lambda g: _import(F.concat(F.lit("./"), g(1)), F.array(g(1)))),
    )


def ruby_imports(text: Column) -> Column:
    return _each(text, RUBY_REQUIRE, lambda g: _import(g(1), F.array(basename(g(1)))))


def go_imports(text: Column) -> Column:
    blocks = _each(text, GO_BLOCK, lambda g: F.split(g(1), LINE_BREAK))
    lines = F.transform(F.flatten(blocks), lambda l: F.regexp_replace(strip(l), r'^"+|"+\z', ""))
    return F.concat(
        _each(text, GO_SINGLE, lambda g: _import(g(1), F.array(last_part(g(1), "/")))),
        F.transform(
            F.filter(lines, lambda l: l != ""), lambda l: _import(l, F.array(last_part(l, "/")))
        ),
    )


def cs_imports(text: Column) -> Column:
    return _each(text, CS_USING, lambda g: _import(g(1), F.array(last_part(g(1), "."))))


def c_imports(text: Column) -> Column:
    return _each(text, C_INCLUDE, lambda g: _import(g(1), F.array(basename(g(1)))))


# Extensions (lower case) and the dialect that reads them.
DIALECTS = {
    "ts": ([".ts", ".tsx", ".js", ".jsx"], ts_imports),
    "py": ([".py"], py_imports),
    "java": ([".java", ".kt"], java_imports),
    "rust": ([".rs"], rust_imports),
    "ruby": ([".rb"], ruby_imports),
    "go": ([".go"], go_imports),
    "cs": ([".cs"], cs_imports),
    "c": ([".c", ".cpp", ".h", ".hpp"], c_imports),
}


def imports_of(text: Column, ext: Column) -> Column:
    """Imports of a file in the dialect its extension selects."""
    ext = F.lower(ext)
    return first_of(
        [(ext.isin(suffixes), reader(text)) for suffixes, reader in DIALECTS.values()],
        F.array().cast(IMPORT_TYPE),
    )


def _edges(files: DataFrame, imports: Column) -> DataFrame:
    return files.select("repo_id", "path", F.posexplode(imports).alias("pos", "imp")).select(
        "repo_id",
        "path",
        "pos",
        F.col("imp.from").alias("import_path"),
        F.col("imp.names").alias("names"),
    )


def import_edges(files: DataFrame) -> DataFrame:
    """All imports of all files: ``repo_id, path, pos, import_path, names``."""
    return _edges(files, imports_of(F.col("content"), extension(F.col("path"))))


def dialect_edges(files: DataFrame, dialect: str) -> DataFrame:
    """Imports of the files of one dialect."""
    suffixes, reader = DIALECTS[dialect]
    chosen = files.where(F.lower(extension(F.col("path"))).isin(suffixes))
    return _edges(chosen, reader(F.col("content")))


def ts_import_edges(files: DataFrame) -> DataFrame:
    """Import statements (not ``require`` calls) of TypeScript and JavaScript files."""
    chosen = files.where(F.lower(extension(F.col("path"))).isin(DIALECTS["ts"][0]))
    return _edges(chosen, ts_imports(F.col("content"), with_require=False))


def ts_exports(files: DataFrame) -> DataFrame:
    """Exported names: functions, then constants, then classes."""
    chosen = files.where(F.lower(extension(F.col("path"))).isin(DIALECTS["ts"][0]))
    names = F.concat(
        *[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in TS_EXPORTS]
    )
    return chosen.select("repo_id", "path", F.posexplode(names).alias("pos", "name"))
