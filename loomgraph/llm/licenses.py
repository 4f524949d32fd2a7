"""License scans by a positional index of rare words.

Templates are short passages of licenses. The index lists, for each word of theirs, the templates and places where it
stands. A file looks up the words of a template that are rarest in the corpus among those it has, so that few
places are looked at; each occurrence votes for the place in the file where the template would begin. Where
it would, all of the template's words are compared by relative position, and its mandatory key phrases must stand
there in full. The rarest mandatory word is always among those looked up, so no place that would be
accepted goes unseen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, slices, whole_texts
from loomgraph.llm.words import byte_table, word_codes

TABLE = byte_table([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)], lower=True)
RARE = 4  # words of a template that a file looks up
COVERED = 60  # percent of a template's words that must stand in place

#: Phrases that are labels by themselves.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Label, passage, and the key phrases without which it isn't that license.
PASSAGES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("general public license", "version 2")),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("general public license", "version 3")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


@dataclass(frozen=True)
class Template:
    """A passage as words; ``mandatory`` are places of the words of key phrases. A ``base`` label is its phrase, of which every word is mandatory."""

    label: str
    words: tuple[str, ...]
    mandatory: tuple[int, ...]
    base: bool = False


def template(label: str, passage: str, phrases: Sequence[str], base: bool = False) -> Template:
    words = tuple(passage.split())
    held = set()
    for p in phrases:
        p = p.split()
        at = next(i for i in range(len(words)) if list(words[i : i + len(p)]) == p)  # a phrase that isn't in its passage is an error
        held.update(range(at, at + len(p)))
    return Template(label, words, tuple(sorted(held)), base)


TEMPLATES = tuple(template(label, phrase, [phrase], True) for label, phrase in BASE) + tuple(template(*p) for p in PASSAGES)


@dataclass
class Index:
    """Words of templates by number, the order of each template's words by how rare they are, and postings."""

    templates: Sequence[Template]
    documents_with: dict[str, int]
    vocabulary: list[str] = field(init=False)

    def __post_init__(self):
        self.vocabulary = sorted({w for t in self.templates for w in t.words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.numbers = [np.array([number[w] for w in t.words]) for t in self.templates]
        rarity = lambda i: (self.documents_with.get(self.vocabulary[i], 0), i)
        self.needed = [np.unique(n[list(t.mandatory)]) for n, t in zip(self.numbers, self.templates, strict=True)]
        self.rarest = [np.array(sorted(set(n.tolist()), key=rarity)) for n in self.numbers]
        self.surest = [min(n.tolist(), key=rarity) for n in self.needed]

    def matches(self, codes: np.ndarray, of: np.ndarray, texts: int, rare: int = RARE, covered: int = COVERED) -> list[np.ndarray]:
        """For each template, rows (text, place among all words, words in place) where it stands. ``codes`` are numbers of words, -1 for others, and ``of`` is the text of each."""
        at = np.flatnonzero(codes >= 0)
        holds = np.zeros((texts, len(self.vocabulary)), bool)
        holds[of[at], codes[at]] = True
        by_word = at[np.argsort(codes[at], kind="stable")]
        edges = np.searchsorted(codes[by_word], np.arange(len(self.vocabulary) + 1))
        out = []
        for words, t, needed, rarest, surest in zip(self.numbers, self.templates, self.needed, self.rarest, self.surest, strict=True):
            has = holds[:, rarest]
            looked_up = has & (np.cumsum(has, axis=1) <= rare) | (rarest == surest)
            looked_up &= holds[:, needed].all(axis=1)[:, None]  # without a mandatory word it can't stand anywhere
            begins = []
            for k in np.flatnonzero(looked_up.any(axis=0)).tolist():
                places = by_word[edges[rarest[k]] : edges[rarest[k] + 1]]
                places = places[looked_up[of[places], k]]
                for j in np.flatnonzero(words == rarest[k]).tolist():
                    begins.append((places - j) + (of[places] << 40))
            begins = np.unique(np.concatenate(begins)) if begins else np.zeros(0, np.int64)
            text = (begins + (1 << 39)) >> 40
            begin = begins - (text << 40)
            x = begin[:, None] + np.arange(len(words))
            held = (x >= 0) & (x < len(codes))
            x = np.where(held, x, 0)
            same = held & (of[x] == text[:, None]) & (codes[x] == words)
            count = same.sum(axis=1)
            stands = (100 * count >= covered * len(words)) & same[:, list(t.mandatory)].all(axis=1)
            out.append(np.stack([text[stands], begin[stands], count[stands]], axis=1))
        return out


def licence_codes(texts: list[bytes], vocabulary: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, of): each word's number in ``vocabulary`` or -1, and its text."""
    codes, words, of, _ = word_codes(texts, TABLE)
    known = pc.fill_null(pc.index_in(words, pa.array([w.encode() for w in vocabulary], pa.large_binary())), -1).to_numpy(zero_copy_only=False)
    return known.astype(np.int64)[codes] if len(codes) else codes, of


def document_frequencies(texts: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many texts each word of ``vocabulary`` stands: a row for each word and task, added up; as many rows as templates have words reach the driver."""

    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                codes, of = licence_codes(part.column("text").to_pylist(), vocabulary)
                at = np.flatnonzero(codes >= 0)
                total += np.bincount(np.unique(of[at] * len(vocabulary) + codes[at]) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["word"]]: r["n"] for r in found}


def license_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places) for each row: the templates that stand in its text, as structs (label, base, start, length, in_place) by start.

    ``start`` counts words from 0, ``in_place`` of the template's ``length`` words stand where it has them. A base
    phrase stands in full. A null or empty text has no words and no places, rows that repeat an id are each scanned, an
    empty table gives an empty one. How rare a word is, is counted over all texts.
    """
    texts = whole_texts(df, id_col, text_col)
    vocabulary = sorted({w for t in templates for w in t.words})
    index = Index(templates, document_frequencies(texts, vocabulary))
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("length", pa.int64()), ("in_place", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                codes, of = licence_codes(texts, index.vocabulary)
                counts = np.bincount(of, minlength=len(texts))
                first = np.cumsum(counts) - counts
                found: list[list[dict]] = [[] for _ in texts]
                for t, rows in zip(templates, index.matches(codes, of, len(texts)), strict=True):
                    for k, at, n in rows.tolist():
                        found[k].append({"label": t.label, "base": t.base, "start": at - int(first[k]), "length": len(t.words), "in_place": n})
                for places in found:
                    places.sort(key=lambda p: (p["start"], p["label"], p["length"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "places"])

    schema = "doc_id long, n_words long, places array<struct<label: string, base: boolean, start: long, length: long, in_place: long>>"
    return texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def op13_license_scan(spark, sf_dir):
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    covered = F.array_max(F.transform("places", lambda p: p["in_place"] / p["length"]))
    return license_places(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(covered, F.lit(0.0)).alias("score"),
    )


def template_rows(templates: Sequence[Template] = TEMPLATES) -> str:
    """Templates' words as rows of SQL: template, label, base, place, word, mandatory, length, number of mandatory ones."""
    return ", ".join(f"({k}, '{t.label}', {t.base}, {j}, '{w}', {j in t.mandatory}, {len(t.words)}, {len(t.mandatory)})" for k, t in enumerate(templates) for j, w in enumerate(t.words))


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES = {
    "op13_license_scan": rf"""
        WITH l(template, label, base, place, word, mandatory, length, needed) AS (VALUES {template_rows()}),
             d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
             m AS (SELECT doc_id, template, label, base, i - place AS start, length, count(*) AS in_place
                   FROM t JOIN l USING (word) GROUP BY ALL
                   HAVING 100 * count(*) >= {COVERED} * length
                      AND count(*) FILTER (mandatory) = any_value(needed)),
             a AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                          string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(in_place / length) AS score FROM m GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM d LEFT JOIN a USING (doc_id)""",
}
