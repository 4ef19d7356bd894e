"""Auth-guard and HTTP-verb tags, as expressions over the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loreweave.functions import constants as K
from loreweave.functions.text import any_word, extension, first_of
from loreweave.operators.imports import DIALECTS

AUTH_CALL = r"(?U)\bauth\(\)"  # fixed value


def auth_label(text: Column, rules=K.AUTH_RULES_GENERIC) -> Column:
    """Label of the first matching rule, null if none matches."""
    def hit(label, every, some):
        if label == "auth()":
            return F.contains(text, F.lit("auth()")) & text.rlike(AUTH_CALL)
        found = any_word(text, some) if some else F.lit(True)
        for word in every:
            found = found & F.contains(text, F.lit(word))
        return found

    return first_of([(hit(*rule), F.lit(rule[0])) for rule in rules])


def generic_verbs(text: Column) -> Column:
    """Verbs as whole words, as mapping annotations or as route attributes."""
    def hit(v):
        # A pattern is tried only on texts that have its first characters; the verb is found before its edges are looked at.
        word = F.contains(text, F.lit(v)) & text.rlike(rf"(?U){v}(?<=\b{v})\b")
        mapped = any_word(text, ["@" + v[0], "@" + v[0].lower()]) & text.rlike(rf"(?U)(?i:@{v}Mapping)")
        return word | mapped | F.contains(text, F.lit(f"#[{v.lower()}("))

    return F.array_compact(F.array(*[F.when(hit(v), F.lit(v)) for v in K.GENERIC_VERBS]))


def ts_verbs(text: Column) -> Column:
    """Verbs of exported async handlers."""
    hits = [
        F.when(text.rlike(rf"(?U)export\s+async\s+function\s+{v}\b"), F.lit(v)) for v in K.TS_VERBS
    ]
    return F.array_compact(F.array(*hits))


def _of_dialect(files: DataFrame, dialect: str | None) -> DataFrame:
    if dialect is None:
        return files
    return files.where(F.lower(extension(F.col("path"))).isin(DIALECTS[dialect][0]))


def auth_tags(files: DataFrame, rules=K.AUTH_RULES_GENERIC, dialect: str | None = None) -> DataFrame:
    """Files with an auth label."""
    tagged = _of_dialect(files, dialect).select(
        "repo_id", "path", auth_label(F.col("content"), rules).alias("auth")
    )
    return tagged.where(F.col("auth").isNotNull())


def http_verbs(files: DataFrame, verbs=generic_verbs, dialect: str | None = None) -> DataFrame:
    """One row per file and verb, numbered in report order."""
    return _of_dialect(files, dialect).select(
        "repo_id", "path", F.posexplode(verbs(F.col("content"))).alias("pos", "verb")
    )
