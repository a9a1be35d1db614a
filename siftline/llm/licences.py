"""Licence scans: known licence sentences by identifier, ordered rules over the identifiers of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siftline.llm.slices import ready, text_slices

#: Sentences of public licences and licence notices, as their texts have them (fixed values).
SENTENCES: dict[str, str] = {
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

#: Rules: their licence, and the sentences that have to follow each other.
RULES: dict[str, tuple[str, Sequence[str]]] = {
    "apache-2.0-line": ("Apache-2.0", ["apache-line"]),
    "apache-2.0-header": (
        "Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-as-is", "apache-see"]
    ),
    "apache-2.0-notice": ("Apache-2.0", ["apache-notice", "apache-comply"]),
    "bsd-3-clause": ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    "bsd-2-clause": ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    "cc-by-4.0": ("CC-BY-4.0", ["cc-by-line"]),
    "cc-by-4.0-long": ("CC-BY-4.0", ["cc-by-long"]),
    "cc-by-nc-4.0": ("CC-BY-NC-4.0", ["cc-by-nc-line"]),
    "cc-by-nc-4.0-long": ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    "cc-by-sa-4.0": ("CC-BY-SA-4.0", ["cc-by-sa-line"]),
    "cc0-1.0": ("CC0-1.0", ["cc0-line"]),
    "gpl-3.0-line": ("GPL-3.0-only", ["gpl-3-line"]),
    "gpl-3.0-header": (
        "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-implied", "gpl-details", "gpl-received"]
    ),
    "isc": ("ISC", ["isc-grant"]),
    "mit-line": ("MIT", ["mit-line"]),
    "mit-licensed": ("MIT", ["mit-licensed"]),
    "mit-text": ("MIT", ["mit-grant", "mit-notice"]),
    "mpl-2.0": ("MPL-2.0", ["mpl-line", "mpl-copy"]),
}

#: Other sentences that may stand between two sentences of a rule.
GAP = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at a line end, or at a mark before a blank. What isn't a letter, a digit or one of . + - is blank.
BREAK, BLANK = r"[\r\n]+|[.!?;:]+[ \t]+", r"[^a-z0-9.+-]+"
#: What may stand before the words of a line: blanks, and marks of comments, quotes and lists.
MARKS = r"(?:[ \t]|[#*/;%!>|<'\"]|--+>?|[-+.](?=[ \t]|$)|(?:dnl|rem|REM)(?=[ \t]|$))*"
#: A sentence doesn't go on in the next line behind one of these.
END, LINE_END = re.compile(r"[.!?;:][ \t]*$"), re.compile(r"\r\n|\r|\n")
_BREAKS, _BLANKS, _START, _LOWER = (
    re.compile(f"({BREAK})"), re.compile(BLANK), re.compile(f"^{MARKS}"), str.maketrans(UPPER, LOWER)
)


def _blanked(text: str) -> str:
    """In lower case, with marks as blanks."""
    return _BLANKS.sub(" ", text.translate(_LOWER)).strip(" ")


def _plain(sentence: str) -> str:
    """The form in which sentences are compared."""
    return _blanked(sentence).strip(" .")


def _cut(text: str) -> list[tuple[int, str, str, bool]]:
    """(number, words, words behind the marks of a line's start, goes on) of the pieces that hold words.

    A text is cut by BREAK and all its pieces are numbered. A piece goes on with the sentence of the
    one before it if just one line end, and no mark that ends a sentence, is between their words.
    """
    parts = _BREAKS.split(text)
    found, at_start, lines, ended = [], True, 0, True
    for k in range(0, len(parts), 2):
        part = parts[k]
        whole = _blanked(part)
        behind = _blanked(_START.sub("", part)) if at_start else whole
        if behind.strip("."):
            found.append((k // 2, whole, behind, lines == 1 and not ended))
            at_start, lines, ended = False, 0, bool(END.search(part))
        if k + 1 < len(parts):
            if parts[k + 1][0] in "\r\n":
                at_start, lines = True, lines + len(LINE_END.findall(parts[k + 1]))
            elif not at_start:
                ended = True
    return found


def _sentences(text: str) -> tuple[str, ...]:
    """A known sentence as it is looked for: cut like a text, its lines joined."""
    found: list[str] = []
    for _, whole, behind, goes_on in _cut(text):
        found[-1:] = [f"{found[-1]} {behind}"] if goes_on else [*found[-1:], whole]
    return tuple(x.strip(" .") for x in found)


def _run(pieces: Sequence[tuple[int, str, str, bool]], first: int, known: str) -> int | None:
    """The last of the pieces from ``first`` on that hold ``known`` together, lines joined by blanks."""
    _, whole, behind, _ = pieces[first]
    if whole.strip(" .") == known:
        return first
    words, last = behind.lstrip(" ."), first
    while words.rstrip(" .") != known:
        last += 1
        if not known.startswith(words + " ") or last == len(pieces) or not pieces[last][3]:
            return None
        words += " " + pieces[last][2]
    return last


def _known_runs(known: Mapping[tuple[str, ...], str]) -> Callable[[str], Iterator[tuple[int, int, int, int, str]]]:
    """A function that gives (first piece, last, their ranks among the pieces with words, name) of known sentences."""
    by_first: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for steps, name in known.items():
        by_first.setdefault(steps[0].split(" ")[0].rstrip("."), []).append((steps, name))
    # a text without one of these words, as parts of its own words, holds no known sentence
    longest = sorted({max(" ".join(steps).split(" "), key=len) for steps in known}, key=len)
    needed = [w for k, w in enumerate(longest) if not any(v in w for v in longest[:k])]

    def run(text: str) -> Iterator[tuple[int, int, int, int, str]]:
        lower = text.lower()
        if not any(word in lower for word in needed):
            return
        pieces, rank = _cut(text), 0
        while rank < len(pieces):
            best, end = None, rank
            words = {w.lstrip(" .").split(" ")[0].rstrip(".") for w in pieces[rank][1:3]}
            for steps, name in (x for word in words for x in by_first.get(word, ())):
                last = rank - 1
                for step in steps:
                    last = _run(pieces, last + 1, step) if last + 1 < len(pieces) else None
                    if last is None:
                        break
                if last is not None and (best is None or last > end):
                    best, end = name, last
            if best is not None:
                yield pieces[rank][0], pieces[end][0], rank, end, best
            rank = end + 1

    return run


_HIT = ("text_hash", "at", "last_at", "rank", "last_rank", "name")


def _hits(known: Mapping[tuple[str, ...], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _known_runs(known)
        for batch, texts in text_slices(batches, "text"):
            found = [(k, *hit) for k, text in enumerate(texts) for hit in runs(text)]
            if found:
                rows, *columns = zip(*found)
                own = batch.select(["id", "text_hash"]).take(pa.array(rows, pa.int32()))
                kinds = [pa.int32()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))],
                    ["id", *_HIT],
                )

    return run


def found_licences(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Mapping[str, str] = SENTENCES,
    rules: Mapping[str, tuple[str, Sequence[str]]] = RULES,
    gap: int = GAP,
) -> DataFrame:
    """``(id, licence, rule, first_sentence, last_sentence)`` of every rule that a text matches.

    Texts are cut at line ends and at . ! ? ; : before a blank, and the pieces are numbered from 0. A
    known sentence is found as a piece or, where lines are wrapped, as pieces of lines that follow each
    other without a blank line or a mark that ends a sentence; marks of comments at the starts of lines
    don't count. Known sentences are cut in the same way, and their pieces have to follow each other. Of known sentences that begin with one piece the longest counts, and the next begins
    behind it. Sentences are compared in lower case, with marks other than . + - as blanks. A rule
    matches where its sentences follow each other among the known sentences of the text, with at most
    ``gap`` other pieces that hold words between two of them. Of rules that match from one sentence on
    only the longest counts, ties by name; a match inside the stretch of one that began before it
    doesn't count.

    Null and empty texts match nothing. Rows that repeat an id and a text are one document; rows
    that share an id only give rows of their own. Null ids stay. Other columns are not read. Both
    tables go to every executor: they are arguments from the driver's memory.
    """
    spark = df.sparkSession
    ready(spark)
    known = {_sentences(text): name for name, text in reversed(list(sentences.items())) if _sentences(text)}
    longest = max((len(steps) for _, steps in rules.values()), default=1)
    wanted = spark.createDataFrame(
        [(name, licence, list(steps), len(steps), steps[0]) for name, (licence, steps) in rules.items()],
        T.StructType.fromDDL("rule string, licence string, steps array<string>, size int, name string"),
    )
    texts = df.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")
    )
    kinds = [df.schema[id_col].dataType, T.LongType(), *[T.IntegerType()] * 4, T.StringType()]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(("id", *_HIT), kinds)])
    hits = texts.where("text <> ''").mapInArrow(_hits(known), schema).distinct()
    text = Window.partitionBy("id", "text_hash").orderBy("at")
    fields = ("name", "rank", "last_rank", "last_at")
    ahead = F.array(*(F.struct(*(F.lead(f, k).over(text).alias(f) for f in fields)) for k in range(longest)))
    ahead = hits.select("id", "text_hash", "at", "name", ahead.alias("ahead"))
    found = F.slice("ahead", F.lit(1), F.col("size"))
    near = F.forall(
        F.sequence(F.lit(1), F.col("size")),
        lambda k: (k == 1) | (F.get("found", k - 1)["rank"] - F.get("found", k - 2)["last_rank"] <= gap + 1),
    )
    matches = (
        ahead.join(F.broadcast(wanted), "name")
        .withColumn("found", found)
        .where(F.expr("found.name <=> steps"))
        .where(near)
        .withColumn("last", F.get("found", F.col("size") - 1)["last_at"])
    )
    here = Window.partitionBy("id", "text_hash", "at").orderBy(F.desc("size"), "rule")
    before = text.rowsBetween(Window.unboundedPreceding, -1)
    best = matches.withColumn("place", F.row_number().over(here)).where("place = 1")
    outer = best.withColumn("covered", F.max("last").over(before)).where("covered IS NULL OR last > covered")
    return outer.select(
        F.col("id").alias(id_col),
        "licence",
        "rule",
        F.col("at").cast("long").alias("first_sentence"),
        F.col("last").cast("long").alias("last_sentence"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licence_sql(table: str = "documents") -> str:
    """DuckDB SQL for ``found_licences`` with the built-in tables, on ids that are not null and not repeated.

    It finds known sentences only where they are one piece, so neither 'gpl-free' nor 'mpl-line', and
    counts pieces without words as gaps: its rows are those of texts whose licence sentences aren't
    wrapped, by the rules without these two.
    """

    def plain(value: str) -> str:
        lower = f"translate({value}, '{UPPER}', '{LOWER}')"
        return f"trim(regexp_replace({lower}, '{BLANK}', ' ', 'g'), ' .')"

    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in SENTENCES.items())
    wanted = ", ".join(
        f"({_quoted(name)}, {_quoted(licence)}, [{', '.join(map(_quoted, steps))}])"
        for name, (licence, steps) in RULES.items()
    )
    longest = max(len(steps) for _, steps in RULES.values())
    ahead = ", ".join(f"lead(name, {k}) OVER w AS n{k}, lead(pos, {k}) OVER w AS a{k}" for k in range(longest))
    follows = " AND ".join(
        f"(len(steps) <= {k} OR (n{k} = steps[{k + 1}] AND a{k} - a{max(k - 1, 0)} <= {GAP + 1}))"
        for k in range(longest)
    )
    last = "CASE len(steps) " + " ".join(f"WHEN {k + 1} THEN a{k}" for k in range(longest)) + " END"
    return f"""
WITH known AS (SELECT name, {plain("text")} AS sentence FROM (VALUES {known}) v(name, text)),
rules AS (SELECT * FROM (VALUES {wanted}) v(rule, licence, steps)),
parts AS (SELECT doc_id, string_split_regex(text, '{BREAK}') AS parts FROM {table}),
pieces AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM parts),
hits AS (SELECT doc_id, pos, name FROM pieces JOIN known ON sentence = {plain("part")}),
ahead AS (SELECT doc_id, pos, {ahead} FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
matches AS (SELECT doc_id, licence, rule, pos, {last} AS last, len(steps) AS size
            FROM ahead JOIN rules ON {follows}),
best AS (SELECT * FROM matches
         QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY size DESC, rule) = 1),
covering AS (SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY pos
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM best)
SELECT doc_id, licence, rule, pos AS first_sentence, last AS last_sentence FROM covering
WHERE covered IS NULL OR last > covered"""
