"""License scan by an exact containment join of text blocks with license templates.

A block is any run of consecutive words of a document, a quarter longer than the template. It meets a template
when it holds at least ``CONTAINMENT`` of the template's distinct words. Template words are ordered by the number
of documents that hold them, rarest first, counted over all documents. A block that meets the threshold holds
one of the first ``size - needed + 1`` words of that order (prefix filter), is long enough (length filter), and
the words from its first match on suffice (positional filter); only such blocks are counted exactly. The
templates are a fixed list, so they travel in the task closure.

Rows: null and empty texts have no words and no labels; rows without doc_id are left out; repeated rows are
scanned each; equal counts order words by their text. Other columns are ignored.
"""

from collections import Counter
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlag.llm.texts import ALNUM, keyed, rows_bytes

CONTAINMENT = 0.9
SLACK = 1.25

# Phrases that are found word by word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The wording of common license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
              " general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met"),
]


class Template:
    """A template with its words in global order."""

    def __init__(self, label: str, text: str, documents_with: dict[bytes, int]):
        words = text.encode().split()
        self.label, self.words = label, frozenset(words)
        self.block = ceil(SLACK * len(words))
        order = sorted(self.words, key=lambda w: (documents_with.get(w, 0), w))
        self.needed = ceil(CONTAINMENT * len(order) - 1e-9)
        self.prefix = order[: len(order) - self.needed + 1]

    def best(self, words: list[bytes]) -> tuple[int, int]:
        """Most template words in one block that passes the filters, and the number of blocks that meet."""
        if min(len(words), self.block) < self.needed:
            return 0, 0
        held = self.words
        spots = [(i, w) for i, w in enumerate(words) if w in held]
        starts = [i for i, w in spots if w in self.prefix]
        most = meeting = 0
        inside: Counter = Counter()
        left = 0
        reach = 0  # the next prefix hit at or after the window's left end
        for right, (i, w) in enumerate(spots):  # windows that end with a template word
            inside[w] += 1
            while spots[left][0] <= i - self.block:
                gone = spots[left][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                left += 1
            while reach < len(starts) and starts[reach] <= i - self.block:
                reach += 1
            if reach == len(starts) or starts[reach] > i or right - left + 1 < self.needed:
                continue
            most = max(most, len(inside))
            meeting += len(inside) >= self.needed
        return most, meeting


def word_lists(column: pa.Array) -> list[list[bytes]]:
    return [t.translate(ALNUM).split() for t in rows_bytes(column)]


def document_counts(docs: DataFrame, vocabulary: frozenset) -> dict[bytes, int]:
    """In how many documents each of a fixed set of words occurs."""

    def run(batches):
        counts: Counter = Counter()
        for b in batches:
            for words in word_lists(b["text"]):
                counts.update(vocabulary.intersection(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    found = keyed(docs).select("text").mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], phrases: list[tuple[list[bytes], int, str]]) -> list[tuple[int, str]]:
    """Start and label of every place of a phrase, found through its rarest word (at ``shift``)."""
    out = []
    for phrase, shift, label in phrases:
        rare, i = phrase[shift], -1
        for _ in range(words.count(rare)):
            i = words.index(rare, i + 1)
            if i >= shift and words[i - shift : i - shift + len(phrase)] == phrase:
                out.append((i - shift, label))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: word count, phrase places, labels, best containment and meeting blocks."""
    chosen = templates or TEMPLATES
    texts = [t for _, t in chosen] + list(PHRASES)
    counts = document_counts(docs, frozenset(w for t in texts for w in t.encode().split()))
    made = [Template(label, text, counts) for label, text in chosen]
    phrases = []
    for phrase, label in PHRASES.items():
        words = phrase.encode().split()
        phrases.append((words, min(range(len(words)), key=lambda i: (counts.get(words[i], 0), i)), label))
    seeds = frozenset(w for t in made for w in t.prefix) | frozenset(p[shift] for p, shift, _ in phrases)

    def run(batches):
        for b in batches:
            rows = []
            for words in word_lists(b["text"]):
                row = (len(words), 0, None, None, "", "", 0.0, 0)
                if not seeds.isdisjoint(words):
                    present = set(words)
                    places = phrase_places(words, phrases)
                    base = sorted({label for _, label in places})
                    labels, best, blocks = set(base), 1.0 if places else 0.0, 0
                    for t in made:
                        if present.isdisjoint(t.prefix):
                            continue
                        most, meeting = t.best(words)
                        best = max(best, most / len(t.words))
                        blocks += meeting
                        if meeting:
                            labels.add(t.label)
                    at = [i for i, _ in places]
                    row = (
                        len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base),
                        ",".join(sorted(labels)), best, blocks,
                    )
                rows.append(row)
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_blocks"],
            )

    return keyed(docs).mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double, n_blocks long",
    )
