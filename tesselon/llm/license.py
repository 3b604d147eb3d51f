"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies.

Texts and templates become lower-case words of letters and digits, then 5-word shingles. For
each class of template lengths a text's shingles are cut into windows that overlap by so much
that any place of a template lies whole in one. Band b of a window is the smallest of its
shingle hashes XORed with a constant: which shingle is nearest to that constant, so two sets agree
in it with a chance of their Jaccard similarity. With one row in each of `bands` bands a window of
similarity J is missed with a chance of (1 - J) ** bands. A class's windows are little longer
than its templates, which bounds J from below, and it gets as many bands as keep the chance of a miss
under a given one (see classes_for()). Windows' bands meet those of the templates in a join with a table of
(class, band, minimum); a template found is verified by the exact share of its shingles that the whole text
holds. Plans do not grow with the number of templates but with their classes of length. All of this is DataFrame
expressions; only texts that hold a shingle that is some template's minimum get as far as the windows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: License notices in common use, by their identifier.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}
#: Letters and digits make words.
CUT = "[^\\\\p{L}\\\\p{N}]+"


@dataclass(frozen=True)
class Band:
    """Templates of `low` to `high` shingles: windows of `size` shingles every `step`."""

    low: int
    high: int
    size: int
    step: int
    bands: int

    def miss_chance(self, containment: float = 0.8) -> float:
        """Largest chance to miss a contiguous place that holds this share of a template."""
        shared = max(1, -(-int(self.low * containment * 1000) // 1000))
        return (1 - shared / (self.size + self.low - shared)) ** self.bands


def classes_for(lengths: Iterable[int], containment: float = 0.8, miss: float = 1e-3) -> list[Band]:
    """Classes of nearly equal lengths, each with so many bands that a place is missed with a chance of at most `miss`."""
    groups: list[list[int]] = []
    for n in sorted(set(lengths)):
        if groups and n > 4 and n <= groups[-1][0] * 1.2:
            groups[-1].append(n)
        else:
            groups.append([n])
    out = []
    for g in groups:
        size = g[-1] if g[-1] <= 4 else g[-1] + max(2, g[-1] // 6)
        bands = 1
        while Band(g[0], g[-1], size, size - g[-1] + 1, bands).miss_chance(containment) > miss:
            bands += 1
        out.append(Band(g[0], g[-1], size, size - g[-1] + 1, bands))
    return out


def shingles_sql(text: str) -> str:
    return f"array_remove(split(lower(coalesce({text}, '')), '{CUT}'), '')"


def _grams(words: str) -> str:
    return f"case when size({words}) = 0 then cast(array() as array<bigint>) when size({words}) <= {SHINGLE} then array(xxhash64(array_join({words}, ' '))) else transform(sequence(1, size({words}) - {SHINGLE - 1}), i -> xxhash64(array_join(slice({words}, i, {SHINGLE}), ' '))) end"


def _constants(n: int) -> list[int]:
    """Constants that differ in their leading bits, so that bands look at different ends of the hash range."""
    out = [((2 * i + 1) << 59) ^ (0x9E3779B97F4A7C15 * (i + 1) & (1 << 58) - 1) for i in range(n)]
    return [x - (1 << 64) if x >> 63 else x for x in (v & (1 << 64) - 1 for v in out)]


def _literal(xs: list[int]) -> str:
    return "cast(array(" + ", ".join(f"{x}L" if x != -(1 << 63) else "cast('-9223372036854775808' as bigint)" for x in xs) + ") as array<bigint>)"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-3) -> DataFrame:
    """One row per row of docs and template found: id, license, n_shared, n_shingles, containment.

    containment is the share of the template's different shingles that the text holds. A text or
    template of fewer than five words is one shingle. A template scattered over a text, no window of which is
    like it, is not looked for. Null and empty texts match nothing; without rows or templates the result is empty.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    rows = spark.createDataFrame(sorted(templates.items()), "name string, body string").withColumn("w", F.expr(shingles_sql("body")))
    known = {r["name"]: r["g"] for r in rows.select("name", F.expr(f"array_distinct({_grams('w')})").alias("g")).collect() if r["g"]}
    if not known:
        return docs.select(F.col(id_col)).limit(0).selectExpr("*", "'' as license", "0L as n_shared", "0L as n_shingles", "0D as containment")
    classes = classes_for((len(g) for g in known.values()), containment, miss)
    constants = _constants(max(b.bands for b in classes))
    # a window's minimum can be a template's only where the shingle that gave it is in the text: most texts hold none of these
    bands = [(k, b, name, min(h ^ constants[b] for h in g)) for k, band in enumerate(classes) for name, g in known.items() if band.low <= len(g) <= band.high for b in range(band.bands)]
    givers = sorted({least ^ constants[b] for _, b, _, least in bands})
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.expr(shingles_sql(f"`{text_col}`")).alias("w"))
    df = df.select("row", "id", F.expr(_grams("w")).alias("g")).where(F.expr(f"arrays_overlap(g, {_literal(givers)})"))
    keys = []
    for k, band in enumerate(classes):
        starts = f"sequence(1, greatest(1, size(g) - {band.size - band.step}), {band.step})"
        # bound by a lambda, so that the optimiser cannot move the hashing into the loop over windows
        minima = f"transform(array(transform(g, h -> h ^ c)), x -> transform({starts}, s -> xxhash64({k}, b, array_min(slice(x, s, {band.size})))))[0]"
        keys.append(f"flatten(transform({_literal(constants[: band.bands])}, (c, b) -> {minima}))")
    table = spark.createDataFrame([(k, b, name, least) for k, b, name, least in bands], "k int, b int, license string, least long")
    table = table.select(F.xxhash64("k", "b", "least").alias("key"), "license")
    shingled = spark.createDataFrame([(n, g, len(g)) for n, g in known.items()], "license string, tg array<bigint>, n_shingles long")
    found = df.select("row", "id", "g", F.explode(F.array_distinct(F.concat(*(F.expr(x) for x in keys)))).alias("key"))
    # both tables hold the templates alone: a row for each and band
    found = found.join(F.broadcast(table), "key").join(F.broadcast(shingled), "license")
    found = found.withColumn("n_shared", F.size(F.array_intersect("tg", "g")).cast("long")).select("row", "id", "license", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    found = found.where(F.col("containment") >= containment).dropDuplicates(["row", "license"])  # several bands find one
    return found.select(F.col("id").alias(id_col), "license", "n_shared", "n_shingles", "containment")
