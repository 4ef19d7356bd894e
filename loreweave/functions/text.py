"""Column helpers for paths, names and model replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def first_of(cases, default: Column | None = None) -> Column:
    """CASE over (condition, value) pairs, in order."""
    out = None
    for condition, value in cases:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out if default is None else out.otherwise(default)


def any_word(text: Column, words: list[str]) -> Column:
    """True if one of the words occurs in the text."""
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot and what follows in the file name; names such as ``.env`` have none."""
    # Plain string functions: paths are looked at many times, and a pattern costs ten times as much.
    name = F.ltrim(basename(path), F.lit("."))
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).when(name.isNotNull(), "")


def without_extension(path: Column) -> Column:
    return F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)))


def stem(path: Column) -> Column:
    return without_extension(basename(path))


def last_part(c: Column, sep: str) -> Column:
    return F.substring_index(c, sep, -1)


def has_dot_segment(path: Column) -> Column:
    """True for hidden files and for anything below a hidden directory."""
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))


def in_directory(path: Column, names: list[str]) -> Column:
    """True if one of the directories on the path bears one of the names."""
    rooted_path = F.concat(F.lit("/"), path)
    return any_word(rooted_path, [f"/{n}/" for n in names])


def rooted(import_path: Column) -> Column:
    """Import path as a path from the repository root: alias expanded, leading dots and slashes dropped."""
    expanded = F.replace(import_path, F.lit("@/"), F.lit("src/"))
    return F.regexp_replace(F.regexp_replace(expanded, r"^[./]+", ""), r"/(\./|/)+", "/")


def rank_in(c: Column, values: list[str]) -> Column:
    """1-based place of ``c`` in a fixed list, 0 when absent."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), c)


def first_rule(text: Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first rule of which any word occurs in the text."""
    return first_of([(any_word(text, words), F.lit(label)) for label, words in rules], F.lit(default))


def spec_id(name: Column) -> Column:
    """SCREAMING-KEBAB-CASE identifier of a human label."""
    kept = F.regexp_replace(name, r"(?U)[^a-zA-Z0-9\s\-_]", "")
    return F.upper(F.regexp_replace(strip(kept), r"(?U)[\s_]+", "-"))


def title(c: Column) -> Column:
    """Capitalise every run of letters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )


def display_name(name: Column) -> Column:
    return title(F.translate(name, "-_", "  "))


def unfence(reply: Column) -> Column:
    """Body of a model reply: the first fenced block if there is one, else the whole text."""
    text = strip(reply)
    after_json = F.substring_index(F.substr(text, F.locate("```json", text) + 7), "```", 1)
    after_any = F.element_at(F.split(text, "```"), 2)
    return (
        F.when(F.contains(text, F.lit("```json")), strip(after_json))
        .when(F.contains(text, F.lit("```")), strip(after_any))
        .otherwise(text)
    )
