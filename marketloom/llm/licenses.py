"""License scan by conditional compression.

Around each cue word, over line ends and inside long lines, the templates are fitted into the words; the longest that fits marks
a block. A block that repeats the wording of a template shrinks when it is compressed with the template as dictionary. The
template with the largest reduction wins, and the winner is confirmed by the words that differ.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import whole

# Wordings of public licenses by their usual short names.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "Zlib grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT distributed": "Distributed under the MIT License.",
    "MIT style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "BSD style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0 mention": "under CC0 1.0",
} | {
    f"CC-{kind}-{version}{name}": wording.format(kind=kind, long=long, version=version, where="International" if version == "4.0" else "Unported")
    for kind, long in {
        "BY": "Attribution",
        "BY-SA": "Attribution-ShareAlike",
        "BY-NC": "Attribution-NonCommercial",
        "BY-ND": "Attribution-NoDerivatives",
        "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
        "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    }.items()
    for version in ("4.0", "3.0")
    for name, wording in {
        "": "Licensed under CC {kind} {version}.",
        " mention": "under CC {kind} {version}.",
        " notice": "This work is licensed under a Creative Commons {long} {version} {where} License.",
    }.items()
} | {
    f"{name} SPDX": f"SPDX-License-Identifier: {name}"
    for name in "Apache-2.0 MIT BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Unlicense Zlib BSL-1.0".split()
}
_GAP = r"[\s/*#;%>|!-]+"
CUES = r"(?i)licen[sc]e|copyright|permission~is|permission~to~use|redistribution~and~use|free~software|public~domain|SPDX-|creative~commons|\bCC~BY\b|\bCC0\b|\b[AL]?GPL|mozilla~public".replace("~", _GAP)
_CUE = re.compile(CUES)
#: Signs that begin or end the lines of a comment.
_LEADERS = re.compile(r"(?:/?[*#;%>|!-]+/?|//+|\(\*|\*\)|<!--|-->|rem|dnl)", re.I)
#: Words that tell one license from another; they and words with digits must be there.
_TELLING = set("lesser library affero noncommercial sharealike noderivatives mit bsd apache mozilla eclipse boost".split())


def _plain(word: str) -> str:
    return word.lower().strip(".,;:!?()[]{}<>\"'`*\u201c\u201d\u2018\u2019") or word


def _telling(word: str) -> bool:
    w = _plain(word)
    return any(c.isdigit() for c in w) or w in _TELLING or any(p in _TELLING for p in w.split("-")) or w.startswith("by-") or w == "by"


def fit(template: list[str], words: list[str], around: int | None = None) -> tuple[int, int, list[int], list[int]] | None:
    """Where `template` fits into `words` with the fewest words missing or added between: start, end, missing and added positions.

    With `around` the place must hold that position and at most a tenth of the template may be missing and be added; None if
    there is none.
    """
    n, m = len(template), len(words)
    index: dict[str, int] = {}
    a, b = (np.array([index.setdefault(w, len(index)) for w in x], np.int64) for x in (template, words))
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    step = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = cost[i - 1] + 1
        row[1:] = np.minimum(row[1:], np.where(b == a[i - 1], cost[i - 1, :-1], n + m + 1))
        cost[i] = np.minimum.accumulate(row - step) + step
    for end in np.argsort(cost[n], kind="stable").tolist():
        if around is not None and cost[n, end] > 0.2 * n:
            return None
        if around is not None and not around < end <= around + 2 * n + 1:
            continue
        i, j, missing, added = n, end, [], []
        while i:
            if j and a[i - 1] == b[j - 1] and cost[i, j] == cost[i - 1, j - 1]:
                i, j = i - 1, j - 1
            elif cost[i, j] == cost[i - 1, j] + 1:
                i -= 1
                missing.append(i)
            else:
                j -= 1
                added.append(j)
        if around is None or (j <= around and max(len(missing), len(added)) <= 0.1 * n):
            return j, end, missing[::-1], added[::-1]
    return None


def compare(block: str, templates: dict[str, str]) -> tuple[str, int, int, list[str], list[str], int]:
    """Best template, bytes of the block alone and with it, the words that the template lacks and that the block lacks, and how
    many of the former are inside the wording, not before or after it.

    Ties go to the template that differs in fewer words inside, then to the longer one, then to the first by name.
    """
    import zstandard

    data = block.encode()
    alone = len(zstandard.ZstdCompressor(level=19).compress(data))
    sizes = {}
    for name, wording in templates.items():
        d = zstandard.ZstdCompressionDict(wording.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes[name] = len(zstandard.ZstdCompressor(level=19, dict_data=d).compress(data))
    least = min(sizes.values())
    words = block.split()
    plain = [_plain(w) for w in words]

    def rank(name: str) -> tuple:
        own = templates[name].split()
        start, end, missing, added = fit([_plain(w) for w in own], plain)
        outside = [*words[:start], *(words[k] for k in added), *words[end:]]
        return len(missing) + len(added), -len(own), name, outside, [own[k] for k in missing], len(added)

    best = min((rank(n) for n in sizes if sizes[n] <= least + 2), key=lambda t: t[:3])
    return best[2], alone, sizes[best[2]], best[3], best[4], best[5]


_FOUND = "doc_id bigint, line int, block string, license string, bytes_alone int, bytes_with int, added array<string>, missing array<string>, confirmed boolean"


class _Scanner:
    def __init__(self, templates: dict[str, str], most_missing: float):
        self.templates, self.most_missing = templates, most_missing
        self.plain = {n: [_plain(w) for w in t.split()] for n, t in templates.items()}
        self.counts = {n: Counter(w) for n, w in self.plain.items()}
        self.reach = 2 + int(1.2 * max(len(w) for w in self.plain.values()))
        self.place, self.judge = cache(self._place), cache(self._judge)

    def _place(self, words: tuple[str, ...], around: int) -> tuple[int, int] | None:
        """The longest place around a position where a template fits."""
        have, best = Counter(words), None
        for name, own in self.plain.items():
            lacking = sum((self.counts[name] - have).values())
            if lacking > 0.1 * len(own) or (best and len(own) <= best[0]):
                continue
            found = fit(own, list(words), around)
            if found and not any(_telling(own[k]) for k in found[2]):
                best = (len(own), found[0], found[1])
        return best and best[1:]

    def _judge(self, block: str) -> tuple:
        name, alone, size, added, missing, inside = compare(block, self.templates)
        most = self.most_missing * len(self.plain[name])
        return name, alone, size, added, missing, bool(len(missing) <= most and inside <= most and size < alone and not any(_telling(w) for w in missing))

    def scan(self, text: str) -> Iterator[tuple]:
        """line, block and what is found for each wording, then for each further line with a cue."""
        lines = text.split("\n")
        words, line_of, starts = [], [], []
        for k, line in enumerate(lines):
            starts.append(len(words))
            own = line.split()
            while own and _LEADERS.fullmatch(own[0]):
                own.pop(0)
            while own and _LEADERS.fullmatch(own[-1]):
                own.pop()
            words += own
            line_of += [k] * len(own)
        starts.append(len(words))
        plain = [_plain(w) for w in words]
        joined = " ".join(words)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)])
        covered, upto = set(), 0
        for m in _CUE.finditer(joined):
            at = int(np.searchsorted(begins, m.start(), side="right")) - 1
            if at < upto:
                continue
            low = max(upto, at - self.reach)
            place = self.place(tuple(plain[low : at + self.reach]), at - low)
            if place is None:
                continue
            start, upto = low + place[0], low + place[1]
            first, last = line_of[start], line_of[upto - 1]
            a, b = starts[first], starts[last + 1]
            if b - a > 2 * (upto - start) + 10 or any(_CUE.search(" ".join(words[x:y])) for x, y in ((a, start), (upto, b))):
                a, b = start, upto
            covered.update(range(first, last + 1))
            yield first, " ".join(words[a:b]), *self.judge(" ".join(words[a:b]))
        for k, line in enumerate(lines):
            m = _CUE.search(line)
            if m and k not in covered:
                if starts[k + 1] - starts[k] > 2 * self.reach:  # the words around the cue of a long line
                    before, after = line[: m.start()].split(" "), line[m.start() :].split(" ")
                    line = " ".join(before[-self.reach :]) + " ".join(after[: self.reach])
                yield k, line, *self.judge(line)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, most_missing: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line, block, license, bytes_alone, bytes_with, added, missing, confirmed for each wording in `docs`, which may run
    over several lines (`line` is its first) or be a part of one, and for each further line with a cue.

    Blocks are whole lines, or the wording alone where these hold much more. A winner is confirmed if at most a tenth of the
    template's words are missing, none of them a number or a name of a license, and nothing is added between them beyond as many
    words. Null and empty texts have no blocks; every cue line is in a row, a line that matches nothing too (confirmed is false).
    """
    own = templates or TEMPLATES
    t = whole(text)
    cued = docs.where(t.rlike(CUES)).select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _Scanner(own, most_missing)
        for rows in it:
            out = [(i, *found) for i, text in zip(rows["doc_id"].array, rows["text"], strict=True) for found in scanner.scan(text)]
            frame = pd.DataFrame(out, columns=["doc_id", "line", "block", "license", "bytes_alone", "bytes_with", "added", "missing", "confirmed"])
            frame["doc_id"] = pd.array([None if pd.isna(i) else int(i) for i in frame["doc_id"]], dtype="Int64")
            yield frame

    return cued.mapInPandas(run, _FOUND)
