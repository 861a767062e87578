"""License scans by conditional compression.

Texts with a word that notices use are scanned as a whole, over lines and paragraphs. A candidate block is a stretch of
words in which most words of some template stand close together. Each block is compressed alone and with every template
as a raw zstandard dictionary. Templates are ranked by the bytes that saves; those that save a small share of what they
save of themselves, which does not depend on what stands around, are out. The winners are confirmed in this order by the
differences of wording: the words of the template that the block lacks, and its own words in between, may be a small
share. Words go to the first license confirmed for them; only exact wordings come before others, and may share words.

Null texts count as empty. Texts without such words give no rows; rows with null or repeated ids are scanned like
any other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of public license notices, by SPDX-like name. Fixed values.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0.",),
    "Proprietary": ("All rights reserved.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
}
#: Words of which a text that is scanned holds one.
TRIGGER = r"(?i)licen[cs]|copyright|all[\W_]+rights[\W_]+reserved|permission[\W_]+(?:is|to)[\W_]+(?:hereby|granted|use)|written[\W_]+permission|redistribution|public[\W_]+domain|creative[\W_]+commons"
#: Least saving by that of the template itself, and greatest share of differing words among those of the template.
REDUCTION, DIFFERENT = 0.3, 0.2
#: Compression level: that of optimal parsing, as lazy parsing ranks near templates by chance.
LEVEL = 19

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def _compressors() -> tuple:
    level = zstandard.ZstdCompressor(level=LEVEL)
    with_dict = {}
    for wordings in TEMPLATES.values():
        for wording in wordings:
            raw = zstandard.ZstdCompressionDict(" ".join(words(wording)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            with_dict[wording] = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)
    return level, with_dict


@cache
def _names() -> dict[str, str]:
    """The license of each template."""
    return {wording: name for name, wordings in TEMPLATES.items() for wording in wordings}


@cache
def _vocabulary() -> dict[str, list[str]]:
    """The templates that have a word."""
    found: dict[str, list[str]] = {}
    for wordings in TEMPLATES.values():
        for wording in wordings:
            for word in set(words(wording)):
                found.setdefault(word, []).append(wording)
    return found


def savings(block: list[str]) -> dict[str, int]:
    """The bytes by which each template as a dictionary shrinks the words of a block."""
    alone, with_dict = _compressors()
    data = " ".join(block).encode("utf-8", "replace")
    size = len(alone.compress(data))
    return {wording: size - len(c.compress(data)) for wording, c in with_dict.items()}


@cache
def _own_savings() -> dict[str, int]:
    """What each template saves of itself."""
    return {wording: savings(words(wording))[wording] for wordings in TEMPLATES.values() for wording in wordings}


def ranked(block: list[str]) -> list[tuple[str, int, float]]:
    """(template, bytes, share of what it saves of itself) of the templates that shrink a block enough, the best first."""
    found = [(wording, n, n / _own_savings()[wording]) for wording, n in savings(block).items()]
    return sorted((f for f in found if f[2] >= REDUCTION), key=lambda f: (-f[1], -f[2]))


def alignments(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(missing, added, start, end) of the best match of the words ``a`` that ends at each of the words ``b``.

    ``missing`` are words of ``a`` that the match lacks, in order, and ``added`` those of ``b`` between the ones found;
    their sum is the least there is and then ``missing`` is."""
    each = len(a) + len(b) + 1  # a sum counts before the share of it that is missing
    cost, start = list(range(0, (len(a) + 1) * (each + 1), each + 1)), [0] * (len(a) + 1)
    out = []
    for j, word in enumerate(b):
        diagonal, since = 0, j
        cost[0], start[0] = 0, j + 1
        for i, wanted in enumerate(a, 1):
            best, at = cost[i] + each, start[i]
            if cost[i - 1] + each + 1 < best:
                best, at = cost[i - 1] + each + 1, start[i - 1]
            if wanted == word and diagonal <= best:
                best, at = diagonal, since
            diagonal, since = cost[i], start[i]
            cost[i], start[i] = best, at
        total, missing = divmod(cost[-1], each)
        out.append((missing, total - missing, start[-1], j + 1))
    return out


def wording_difference(block: str, wording: str) -> tuple[int, int, int]:
    """(missing, added, template's): words of the template that the block lacks, in order, and words between those found."""
    a, b = words(wording), words(block)
    missing, added, _, _ = min(alignments(a, b), key=lambda m: (m[0] + m[1], m[0]), default=(len(a), 0, 0, 0))
    return missing, added, len(a)


def stretches(hits: list[int], least: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the unions of windows of ``longest`` words that hold ``least`` of the ``hits``."""
    start = end = -1
    for k in range(len(hits) - least + 1):
        if hits[k + least - 1] - hits[k] < longest:
            if hits[k] > end:
                if end >= 0:
                    yield start, end
                start = hits[k]
            end = hits[k] + longest
    if end >= 0:
        yield start, end


def candidate_blocks(block: list[str]) -> list[tuple[int, int, dict[str, list[tuple[int, int]]]]]:
    """(start, end, the stretches of templates in it) of the unions of stretches that hold most words of a template.

    A match of a template has all but a few of its words within few more, so it lies in a stretch."""
    hits: dict[str, list[int]] = {}
    for k, word in enumerate(block):
        for wording in _vocabulary().get(word, ()):
            hits.setdefault(wording, []).append(k)
    found = []
    for wording, own in hits.items():
        n = len(words(wording))
        most = int(DIFFERENT * n)
        found += [(low, min(high, len(block)), wording) for low, high in stretches(own, n - most, n + most)]
    out: list[tuple[int, int, dict[str, list[tuple[int, int]]]]] = []
    for low, high, wording in sorted(found):
        if out and low < out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]), out[-1][2])
        else:
            out.append((low, high, {}))
        out[-1][2].setdefault(wording, []).append((low, high))
    return out


def confirmed(block: list[str], name: str, wording: str, where: list[tuple[int, int]]) -> list[tuple[int, int, int, int, str]]:
    """(missing, added, start, end, name) of the places of ``where`` whose wording is the template's but for a few words."""
    a = words(wording)
    most = int(DIFFERENT * len(a))
    found = [(missing, added, low + i, low + j) for low, high in where for missing, added, i, j in alignments(a, block[low:high]) if missing + added <= most]
    return [(*f, name) for f in sorted(found)]


def scan_text(text: str | None) -> list[dict]:
    """The confirmed notices of a text."""
    text = text or ""
    spans = [m.span() for m in _WORD.finditer(text)]
    block = [text[i:j].lower() for i, j in spans]
    kept: list[dict] = []
    taken: dict[int, set[str]] = {}  # the licenses by word
    for low, high, near in candidate_blocks(block):
        found = []
        for rank, (wording, _, share) in enumerate(ranked(block[low:high])):
            if wording in near:
                tail = wording[[m.end() for m in _WORD.finditer(wording)][-1] :]
                found += [(bool(f[0] + f[1]), rank, f, share, tail) for f in confirmed(block, _names()[wording], wording, near[wording])]
        for inexact, _, (missing, added, i, j, name), share, tail in sorted(found):
            others = set().union(*(taken.get(k, ()) for k in range(i, j)))
            if name not in others and (not inexact or not others):
                for k in range(i, j):
                    taken.setdefault(k, set()).add(name)
                end = spans[j - 1][1]
                end += len(tail) if text.startswith(tail, end) else 0
                kept.append({"license": name, "start": spans[i][0], "end": end, "reduction": share, "missing": missing, "added": added, "exact": not inexact})
    return sorted(kept, key=lambda f: (f["start"], f["license"]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row (doc_id, license, start, end, reduction, missing, added, exact) per notice in ``docs`` (doc_id, text)."""
    kinds = [("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()), ("missing", pa.int64()), ("added", pa.int64()), ("exact", pa.bool_())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"doc_id": i.as_py(), **f} for i, t in zip(batch.column(0), batch.column(1), strict=True) for f in scan_text(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], [n for n, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(TRIGGER))
    return rows.mapInArrow(scan, "doc_id long, license string, start long, end long, reduction double, missing long, added long, exact boolean")
