"""License scans: an exact set-similarity join of templates with blocks of text.

Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; a null
is empty.  A block is any ``width`` consecutive words, and it meets a template if it
has ``CONTAINMENT`` of the template's distinct words.

Template words are ordered by how often the documents have them (one pass that
counts only these).  A block that meets a template must have one of the template's
rarest ``size - need + 1`` words, its prefix; texts without any are passed over.
The prefixes of all templates are an index from word to templates; a text's prefix
words are joined with it inside the row, so a pair of place and template arises only
where they share a prefix word.  Of such a pair only blocks around the place can
qualify (position bound), and only the words of that neighbourhood are compared.  A
phrase is met if its words stand in order without gaps: its prefix is its rarest word,
which also fixes the place.  Templates and index are one constant of the plan, which is as
large for one template as for hundreds; no join shuffles a text and no word is hot.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loreweave.llm._shared import packed, table, unpacked

CONTAINMENT = 0.9
SLACK = 2
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("this work is licensed under a creative commons attribution sharealike license", "cc-by-sa"),
    ("the person who associated a work with this deed has dedicated the work to the public domain by waiving all rights", "cc0"),
    ("made available under the terms of the eclipse public license", "epl"),
    ("in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
]
_NONE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    words: list[str]
    label: str
    need: int          # distinct words of a block that meets it
    width: int         # words of a block
    prefix: list[str]  # its rarest words, one of which a block must have


def _any_of(words: list[str]) -> str:
    """Pattern of whole words; A-Z match whatever their case."""
    return rf"(?i)(?<!{_WORD})(?:{'|'.join(words)})(?!{_WORD})"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_counts(texts: DataFrame, words: list[str]) -> dict[str, int]:
    """How often the texts have each of the words."""
    found = texts.select(F.explode(F.regexp_extract_all("_text", F.lit(_any_of(words)), F.lit(0))).alias("w"))
    rows = found.groupBy(F.translate("w", _UPPER, _LOWER).alias("w")).count().collect()  # at most one row per word
    return {w: 0 for w in words} | {r.w: r["count"] for r in rows}


def prepare(templates, phrases, counts: dict[str, int], containment: float) -> tuple[list[Template], list[Template]]:
    """Templates and phrases with their prefixes."""
    rare = lambda w: (counts[w], w)
    out = []
    for text, label in templates:
        words = sorted(set(text.split()))
        need = ceil(containment * len(words) - 1e-9)
        out.append(Template(words, label, need, ceil(len(words) / containment) + SLACK, sorted(words, key=rare)[: len(words) - need + 1]))
    exact = [Template(text.split(), label, len(text.split()), len(text.split()), [min(text.split(), key=rare)]) for text, label in phrases.items()]
    return out, exact


def _table(templates: list[Template]) -> tuple[Column, Column]:
    """Templates as an array of structs, and the places in it by prefix word."""
    fields = "array<struct<words:array<string>,label:string,need:int,width:int,offset:int>>"
    rows = [{"words": t.words, "label": t.label, "need": t.need, "width": t.width, "offset": t.words.index(t.prefix[0])} for t in templates]
    index: dict[str, list[int]] = {}
    for k, t in enumerate(templates):
        for w in t.prefix:
            index.setdefault(w, []).append(k)
    return F.from_json(F.lit(json.dumps(rows)), fields), F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")


def _pairs(hits: Column, templates: Column, index: Column) -> Column:
    """Places of prefix words, each with every template that has the word in its prefix."""
    of_word = lambda h: F.coalesce(F.try_element_at(index, h["w"]), F.array().cast("array<int>"))
    return F.flatten(F.transform(hits, lambda h: F.transform(of_word(h), lambda k: F.struct(h["i"].alias("i"), F.get(templates, k).alias("t")))))


def _places(words: Column, pairs: Column) -> Column:
    """(start from 0, label) of the phrases."""
    starts = F.transform(pairs, lambda p: F.struct((p["i"] - p["t"]["offset"]).alias("s"), p["t"].alias("t")))
    inside = F.filter(starts, lambda p: (p["s"] >= 0) & (p["s"] + p["t"]["width"] <= F.size(words)))
    met = F.filter(inside, lambda p: F.slice(words, F.greatest(p["s"], F.lit(0)) + 1, p["t"]["width"]) == p["t"]["words"])
    return F.transform(met, lambda p: F.struct(p["s"].alias("s"), p["t"]["label"].alias("label")))


def _met(words: Column, pairs: Column) -> Column:
    """(label, share) of the templates of which a block around a prefix word has as many distinct words as they need."""

    def most(p: Column) -> Column:
        width = p["t"]["width"]
        around = F.slice(words, F.greatest(p["i"] - width + 2, F.lit(1)), 2 * width - 1 - F.greatest(width - 1 - p["i"], F.lit(0)))
        blocks = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - width + 1, F.lit(1))), lambda o: F.size(F.array_intersect(F.slice(ws, o, width), p["t"]["words"])))
        return F.get(F.transform(F.array(around), lambda ws: F.array_max(blocks(ws))), F.lit(0))

    found = F.transform(pairs, lambda p: F.struct(p["t"]["label"].alias("label"), most(p).alias("most"), p["t"]["need"].alias("need"), F.size(p["t"]["words"]).alias("size")))
    return F.transform(F.filter(found, lambda m: m["most"] >= m["need"]), lambda m: F.struct(m["label"].alias("label"), (m["most"] / m["size"]).alias("share")))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Carried columns (all by default), ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base columns are about the phrases; ``labels`` also has those of the templates
    met, and ``score`` is the largest containment among all of them: 1 for a phrase,
    0 if there are no labels.
    """
    keep = docs.columns if keep is None else keep
    source = packed(docs, text, keep).withColumn("_text", F.coalesce("_text", F.lit("")))
    vocabulary = sorted({w for t, _ in templates for w in t.split()} | {w for t in phrases for w in t.split()})
    near, exact = prepare(templates, phrases, word_counts(source, vocabulary), containment)
    prefixes = sorted({w for t in [*near, *exact] for w in t.prefix})

    chosen = F.col("_text").rlike(_any_of(prefixes))
    split = F.regexp_extract_all(F.translate("_text", _UPPER, _LOWER), F.lit(f"{_WORD}+"), F.lit(0))
    rows = source.withColumn("n_words", F.regexp_count("_text", F.lit(f"{_WORD}+")).cast("long")).withColumn("_words", F.when(chosen, split).otherwise(_strings([]))).drop("_text")
    numbered = F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    rows = rows.withColumn("_hits", F.filter(numbered, lambda h: F.array_contains(_strings(prefixes), h["w"])))
    rows = rows.withColumn("_hits", F.when(F.size("_hits") > 0, F.col("_hits")))
    words, hits = F.col("_words"), F.col("_hits")
    rows = rows.select("_row", "n_words", _places(words, _pairs(hits, *_table(exact))).alias("_places"), _met(words, _pairs(hits, *_table(near))).alias("_met"))
    none = F.array().cast("array<string>")
    base, met = F.coalesce(F.col("_places.label"), none), F.coalesce(F.col("_met.label"), none)
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    out = rows.select(
        "_row", "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min("_places.s").cast("long").alias("first_word"),
        F.array_max("_places.s").cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, met)).alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max("_met.share"), F.lit(0.0))).alias("score"),
    )
    return unpacked(out, keep, RESULTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _sql() -> str:
    """Every block of every template, without prefixes."""
    phrases = " union all ".join(f"select {i} as t, {t.split()!r} as words, '{label}' as label" for i, (t, label) in enumerate(PHRASES.items()))
    near, _ = prepare(TEMPLATES, {}, {w: 0 for t, _ in TEMPLATES for w in t.split()}, CONTAINMENT)
    templates = " union all ".join(f"select {i} as t, {t.words!r} as words, '{t.label}' as label, {t.need} as need, {t.width} as width" for i, t in enumerate(near))
    return rf"""with d as (select row_number() over () as r, doc_id,
 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
phrases as ({phrases}), templates as ({templates}),
w as (select r, unnest(w) as word, unnest(range(len(w))) as i from d),
hit as (select d.r, i, label from w join phrases p on word = p.words[1] join d on d.r = w.r where d.w[i + 1 : i + len(p.words)] = p.words),
base as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word from hit group by r),
near as (select d.r, label, max(len(list_intersect(d.w[i + 1 : i + width], t.words)) / len(t.words)) as share
 from w join (select t, unnest(words) as word from templates) x using (word) join templates t using (t) join d on d.r = w.r
 where len(list_intersect(d.w[i + 1 : i + width], t.words)) >= need group by all),
named as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from hit union all select r, label from near) group by r),
named_base as (select r, string_agg(distinct label, ',' order by label) as base_labels from hit group by r),
best as (select r, max(share) as score from near group by r)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
 coalesce(labels, '') as labels, case when n_base > 0 then 1.0 else coalesce(score, 0.0) end as score
from d left join base using (r) left join named using (r) left join named_base using (r) left join best using (r)"""


SQL = _sql()
