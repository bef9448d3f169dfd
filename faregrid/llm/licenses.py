"""Licence notices by the Dice coefficient over word bigrams.

Texts are normalised to lower-case words of letters and digits. Each line, each paragraph and the
whole text is compared with the templates and, if ``inline``, each stretch of words wherever it
begins and ends, across line breaks too, whose number of bigrams is in the template's size range. A
coefficient of ``least`` or more bounds the size of the set of bigrams from both sides and the number
of shared bigrams from below, so most units, stretches and templates are never compared; none that
reaches the threshold is lost. The best stretches begin and end with a bigram of the template, so
only those are looked at.

Defined results: null, empty and one-word texts have no licence and score 0. Equal scores go to the
template first by name. Rows that repeat an id are scanned each on its own. Other columns take no
part. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faregrid.llm.words import Words, buffers, pieces, scan, words_of

LEAST = 0.75
# Notices as their licences ask for them, or as they are commonly put, and the opening or the conditions of whole licence texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-text": (
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        '1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'
    ),
    "Artistic-2.0": (
        "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "BSD": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-4-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes "
        "software developed by the organization. "
        "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "EPL-text": (
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE '
        "PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation."
    ),
    "GPL-2.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-3.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.0-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. "
        "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-text": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-text": (
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the '
        "creation of, or owns Covered Software."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "WTFPL": "Do What The Fuck You Want To Public License. Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:"
    ),
}
_TABLE_BITS = 16
_NOTICES = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64())]))


class Templates:
    """Bigram sets of the templates and the bounds that follow from the threshold."""

    def __init__(self, texts: Mapping[str, str], least: float) -> None:
        self.least, self.sets = least, []
        for name in sorted(texts):
            words = next(scan(pa.array([texts[name]]), lower=True, letters=True))[2]
            grams = np.unique(words.grams(2))
            if len(grams):
                self.sets.append((name, grams))
        self.known = np.unique(np.concatenate([g for _, g in self.sets])) if self.sets else np.empty(0, np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.known >> np.uint64(64 - _TABLE_BITS)] = True
        # Dice >= t for sizes a, b: a >= t b / (2 - t), a <= b (2 - t) / t, shared >= t b / (2 - t).
        self.ratio = least / (2 - least)
        self.fewest = min((len(g) * self.ratio for _, g in self.sets), default=np.inf)
        self.members = [np.isin(self.known, g) for _, g in self.sets]
        # Template within a larger one, and the score midway between the smaller one alone and the larger one in full.
        self.within = [
            (small, large, (1 + 2 * len(a) / (len(a) + len(b))) / 2)
            for small, a in self.sets
            for large, b in self.sets
            if len(a) < len(b) and np.isin(a, b).all()
        ]

    def main(self, notices: list[tuple[float, str]], inline: bool) -> tuple[float, str | None]:
        """First of the notices that isn't a stretch of a larger one."""
        score = {name: dice for dice, name in notices}
        parts = {small for small, large, least in self.within if inline and score.get(large, 0.0) > least}
        return next((n for n in notices if n[1] not in parts), (0.0, None))

    def reached(self, grams: np.ndarray) -> Iterator[tuple[float, str]]:
        """Templates that the bigrams of a unit reach the threshold for."""
        own = np.unique(grams)
        for name, other in self.sets:
            if len(other) * self.ratio <= len(own) + 1e-9 and len(own) * self.ratio <= len(other) + 1e-9:
                dice = 2 * len(np.intersect1d(own, other, assume_unique=True)) / (len(own) + len(other))
                if dice >= self.least:
                    yield dice, name


def _units(words: Words) -> Iterator[np.ndarray]:
    """Number of the line, the paragraph and the text that each word is in."""
    row = words.row_of()
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])[words.start]
    new_row, lines = np.diff(row) != 0, np.diff(breaks)
    for fresh in (new_row | (lines > 0), new_row | (lines > 1), new_row):
        yield np.concatenate([[0], np.cumsum(fresh)])


def _stretches(words: Words, templates: Templates) -> Iterator[tuple[int, float, str]]:
    """Row, score and template of the best stretch from each word on that reaches the threshold."""
    grams, row = words.grams(2), words.row_of()
    hit = np.flatnonzero((row[1:] == row[:-1]) & templates.table[grams >> np.uint64(64 - _TABLE_BITS)])
    which = np.minimum(np.searchsorted(templates.known, grams[hit]), len(templates.known) - 1)
    exact = templates.known[which] == grams[hit]
    hit, which = hit[exact], which[exact]
    last = words.first[1:][row[hit]] - 1
    for (name, other), member in zip(templates.sets, templates.members, strict=True):
        mine = member[which]
        at = hit[mine]
        fewest = len(other) * templates.ratio - 1e-9
        if len(at) < fewest:
            continue
        end = np.minimum(at + int(len(other) / templates.ratio + 1e-9), last[mine])
        enough = np.searchsorted(at, end) - np.arange(len(at)) >= fewest
        start, end = at[enough], end[enough]
        if not len(start):
            continue
        shared = np.zeros(len(grams), bool)
        shared[at] = True
        # Equal stretches are compared once.
        _, lead, same = np.unique(words.spans(words.start[start], words.end[end]), return_index=True, return_inverse=True)
        dice = np.zeros(len(lead))
        for i, (a, b) in enumerate(zip(start[lead].tolist(), end[lead].tolist(), strict=True)):
            fresh = np.zeros(b - a, bool)
            fresh[np.unique(grams[a:b], return_index=True)[1]] = True
            common = np.cumsum(fresh & shared[a:b])
            if common[-1] >= fewest:
                dice[i] = (2 * common / (np.cumsum(fresh) + len(other))).max()
        for i in np.flatnonzero(dice[same] >= templates.least):
            yield int(row[start[i]]), float(dice[same[i]]), name


def found(words: Words, templates: Templates, rows: int, inline: bool = False) -> list[list[tuple[float, str]]]:
    """Scores and templates that each row reaches the threshold for, best first."""
    out: list[dict[str, float]] = [{} for _ in range(rows)]
    grams = words.grams(2)
    if not len(grams) or not len(templates.known):
        return [[] for _ in out]
    row = words.row_of()
    known = templates.table[grams >> np.uint64(64 - _TABLE_BITS)]
    for unit in _units(words):
        inside = unit[1:] == unit[:-1]
        hits = np.bincount(unit[:-1][inside & known], minlength=int(unit[-1]) + 1)
        first = np.searchsorted(unit, np.arange(len(hits) + 1))
        for i in np.flatnonzero(hits >= templates.fewest - 1e-9):
            a, b = first[i], first[i + 1]
            at = out[row[a]]
            for score, name in templates.reached(grams[a : b - 1]):
                at[name] = max(score, at.get(name, 0.0))
    if inline:
        for of, score, name in _stretches(words, templates):
            out[of][name] = max(score, out[of].get(name, 0.0))
    return [sorted(((score, name) for name, score in at.items()), key=lambda x: (-x[0], x[1])) for at in out]


def scanned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    texts: Mapping[str, str] = TEMPLATES,
    least: float = LEAST,
    inline: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, license (null if none), dice, notices.

    ``notices`` has every template that reaches the threshold with its best score, best first, so
    also those of sister licences that are as near; license and dice are its first. With ``inline``, notices that share their line with other words are found too, and a template that
    lies within a larger one that is there as well (BSD-2-Clause in BSD-3-Clause) isn't the license.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, least)
        for batch in batches:
            data, at = buffers(batch.column(1))
            for row, to in pieces(at):
                words = words_of(data[at[row] : at[to]], at[row : to + 1] - at[row], lower=True, letters=True)
                every = found(words, templates, to - row, inline)
                best = [templates.main(notices, inline) for notices in every]
                columns = [
                    pa.array([n for _, n in best], pa.string()),
                    pa.array([s for s, _ in best], pa.float64()),
                    pa.array([[{"license": n, "dice": s} for s, n in notices] for notices in every], _NOTICES),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, to - row), *columns], ["doc_id", "license", "dice", "notices"])

    kind = dict(slim.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, license string, dice double, notices array<struct<license: string, dice: double>>")
