"""License notices inside documents, with DataFrame functions alone.

Documents and templates are cut into windows of word shingles. Each window has a few
MinHash values, one a band; a document window that has a value of a template window
in the same band retrieves that template. The template's shingles are then looked for
around the window, and the share of them that is there decides. Notices of sibling
licenses share most of their words, so of each such pair a share of what sets the notice
apart must be there too. All of it happens inside a row: nothing is shuffled, and no
window leaves its document.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.functions.once import once

SHINGLE = 5
CONTAINMENT = 0.8
# Notices of other licenses that share so much of a notice are its siblings; of the
# shingles that a sibling lacks so large a share must be there as well.
SIBLING = 0.5
OWN = 0.5
# Shingles of a window of long templates, and how far the next window begins.
WINDOW = 4
STEP = 2
# Two windows that share 3 of 5 shingles meet with this chance at least.
OVERLAP = 0.6
CHANCE = 0.97
# Templates that go into the plan at most, in characters; more are scanned in rounds.
TEMPLATE_CHARS = 200_000

# SPDX names and the words of common notices.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License v2.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 2 of the License, or (at your option) any later version",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ],
    "LGPL-2.1": [
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 2.1 of the License, or (at your option) any later version",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}

# A license whose words another one repeats and adds to: found beside that one, it goes.
WITHIN = {"BSD-2-Clause": "BSD-3-Clause"}


def bands_for(overlap: float = OVERLAP, chance: float = CHANCE) -> int:
    """Bands of one minimum so that windows of that Jaccard similarity meet with that chance."""
    return max(1, math.ceil(math.log(1.0 - chance) / math.log(1.0 - overlap)))


def templates(spark: SparkSession, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """``license`` and ``notice``, a row a notice."""
    rows = [(name, n) for name, all_ in (NOTICES if notices is None else notices).items() for n in all_]
    return spark.createDataFrame(rows, "license string, notice string")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(word: Column) -> Column:
    """Hashes of five words in a row; none for fewer words."""

    def shifted(hashes: Column, by: int) -> Column:
        return F.slice(hashes, by + 1, F.greatest(F.size(hashes) - (SHINGLE - 1), F.lit(0)))

    def joined(hashes: Column) -> Column:
        # A digest of a digest and the next word's, so the order of the words counts.
        out = shifted(hashes, 0)
        for by in range(1, SHINGLE):
            out = F.zip_with(out, shifted(hashes, by), lambda a, b: F.xxhash64(a, b))
        return out

    return once(F.transform(word, lambda w: F.xxhash64(w)), joined)


def _minimum(band: int):
    """The hash of a shingle that a band takes the minimum of."""
    return lambda s: F.xxhash64(s, F.lit(band))


def _keys(shingles: Column, size: int, step: int, bands: int) -> Column:
    """``key`` and ``at`` (the first shingle) of each band of each window.

    Windows of one shingle need one band. A window that the text ends before is left
    out, so the last windows begin at the last places that still hold a whole one.
    """

    def of_band(band: int) -> Column:
        def minima(h: Column) -> Column:
            n = F.size(h) - (size - 1)
            every = F.sequence(F.lit(0), n - 1, F.lit(step))
            # The last place too, where the steps end before it.
            every = every if step == 1 else F.array_union(every, F.array(n - 1))
            places = F.when(n > 0, every).otherwise(F.expr("array()").cast("array<int>"))

            def least(p: Column) -> Column:
                values = [F.get(h, p + k) for k in range(size)]
                return values[0] if size == 1 else F.least(*values)

            tag = F.lit(band if size > 1 else -1)
            return F.transform(places, lambda p: F.struct(F.xxhash64(least(p), tag).alias("key"), p.alias("at")))

        return once(F.transform(shingles, _minimum(band)), minima)

    return F.concat(*[of_band(b) for b in range(bands if size > 1 else 1)])


def scan(
    docs: DataFrame,
    notices: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """A row for each document and license that it has a notice of.

    ``doc_id``, ``license``, ``containment`` (share of the notice's five-word shingles
    within its own length around the place, of its best place) and ``first_word`` of
    that place's window. A notice counts only with a share ``OWN`` of what sets it apart
    from each of its siblings. A license that another found one
    repeats (``WITHIN``) is left out. A notice of under five words has no shingle and is
    never found. Null texts have no notices, null notices and licenses are left out, a null
    id stays null, repeated rows give repeated rows, other columns are not read,
    whatever their names.
    """
    known = notices.where(F.col("notice").isNotNull() & F.col("license").isNotNull()).select("license", "notice")
    known = _with_own(known)
    # Rounds are by license, so that each license's best place is found in one of them.
    chars = known.agg(F.sum(F.length("notice")).alias("n")).first()["n"] or 0
    rounds = max(1, math.ceil(chars / TEMPLATE_CHARS))
    result = None
    for k in range(rounds):
        part = known.where(F.pmod(F.xxhash64("license"), F.lit(rounds)) == k) if rounds > 1 else known
        found = _scan_round(docs, part, doc_id, text, containment)
        result = found if result is None else result.unionByName(found)
    return result


def _with_own(notices: DataFrame) -> DataFrame:
    """Add ``own``: for each sibling of a notice, the shingles that the sibling lacks."""
    cut = notices.distinct().withColumn("s", F.array_distinct(_shingles(words(F.col("notice")))))
    each = cut.select("license", "notice", "s", F.explode("s").alias("g"))
    other = each.select(F.col("license").alias("l2"), F.col("notice").alias("n2"), F.col("s").alias("s2"), "g")
    siblings = (
        each.join(other, "g")
        .where(F.col("license") != F.col("l2"))
        .groupBy("license", "notice", "s", "l2", "n2", "s2")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= F.lit(SIBLING) * F.size("s"))
    )
    apart = siblings.select("license", "notice", F.array_except("s", "s2").alias("o")).where(F.size("o") > 0)
    own = apart.groupBy("license", "notice").agg(F.collect_set(F.array_sort("o")).alias("own"))
    none = F.array().cast("array<array<long>>")
    return notices.join(own, ["license", "notice"], "left").withColumn("own", F.coalesce("own", none))


def _scan_round(
    docs: DataFrame, notices: DataFrame, doc_id: str, text: str, containment: float
) -> DataFrame:
    bands = bands_for()
    cut = notices.withColumn("words", words(F.col("notice"))).withColumn("shingles", _shingles(F.col("words")))
    whole = cut.where(F.size("shingles") > 0).orderBy("license", "notice").withColumn(
        "keys",
        F.when(F.size("shingles") < WINDOW, _keys(F.col("shingles"), 1, 1, bands)).otherwise(
            _keys(F.col("shingles"), WINDOW, 1, bands)
        ),
    )
    rows = whole.select("license", "shingles", "own", F.col("keys.key").alias("keys")).collect()
    if not rows:
        return docs.select(F.col(doc_id).alias("doc_id")).limit(0).selectExpr(
            "doc_id", "'' AS license", "0.0D AS containment", "0 AS first_word"
        )
    of_key: dict[int, set[int]] = {}
    for i, r in enumerate(rows):
        for key in r["keys"]:
            of_key.setdefault(key, set()).add(i)
    keys = sorted(of_key)
    # Literals of the plan: the templates, and which of them a key retrieves.
    table = F.from_json(
        F.lit(json.dumps([{"license": r["license"], "shingles": r["shingles"], "own": sorted(r["own"])} for r in rows])),
        "array<struct<license: string, shingles: array<bigint>, own: array<array<bigint>>>>",
    )
    retrieved = F.from_json(
        F.lit(json.dumps({str(key): sorted(of_key[key]) for key in keys})), "map<string, array<int>>"
    )

    def retrieve(shingles: Column) -> Column:
        """The keys of the document's windows that some template has."""
        windows = F.concat(_keys(shingles, 1, 1, 1), _keys(shingles, WINDOW, STEP, bands))
        return F.filter(windows, lambda w: w["key"].isin(keys))

    def verify(shingles: Column) -> Column:
        """Each retrieved template's shingles that are around the window."""

        def around(hit: Column, i: Column) -> Column:
            def place(template: Column) -> Column:
                size = F.size(template["shingles"])
                first = F.greatest(hit["at"] - size, F.lit(0))
                near = F.slice(shingles, first + 1, 2 * size + F.lit(WINDOW))
                share = F.size(F.array_intersect(template["shingles"], near)) / F.size(
                    F.array_distinct(template["shingles"])
                )
                own = F.forall(
                    template["own"], lambda o: F.size(F.array_intersect(o, near)) >= F.lit(OWN) * F.size(o)
                )
                return F.struct(
                    template["license"].alias("license"),
                    F.when(own, share).otherwise(F.lit(0.0)).alias("containment"),
                    (-hit["at"]).alias("back"),
                )

            return once(F.get(table, i), place)

        hits = F.transform(
            retrieve(shingles),
            lambda w: F.transform(F.element_at(retrieved, w["key"].cast("string")), lambda i: around(w, i)),
        )
        return F.filter(F.flatten(hits), lambda h: h["containment"] >= F.lit(containment))

    def best(found: Column) -> Column:
        """The best place of each license, of equal ones the first."""
        names = F.array_distinct(F.transform(found, lambda h: h["license"]))
        for inner, outer in WITHIN.items():
            names = F.when(F.array_contains(names, outer), F.array_remove(names, inner)).otherwise(names)
        return F.transform(
            names,
            lambda name: F.array_max(
                F.transform(
                    F.filter(found, lambda h: h["license"] == name),
                    lambda h: F.struct(h["containment"], h["back"], h["license"]),
                )
            ),
        )

    places = once(once(_shingles(words(F.col(text))), verify), best)
    hits = docs.select(F.col(doc_id).alias("doc_id"), F.explode(places).alias("hit"))
    return hits.select(
        "doc_id",
        F.col("hit.license").alias("license"),
        F.col("hit.containment").alias("containment"),
        (-F.col("hit.back")).alias("first_word"),
    )
