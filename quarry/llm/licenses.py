"""License scans by conditional compression with templates as raw dictionaries."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: License id, wordings of its notices. The words between bars
#: tell it from its relatives and must stand in a block as they are.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("Apache-2.0", "|apache license| |version 2.0|", ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0")),
    ("MIT", "|mit license|", ("Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "This project is licensed under the terms of the MIT license.")),
    ("MIT", "|permission is hereby granted free of charge|", ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",)),
    ("GPL-3.0", "|gnu general public license| |version 3|", ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")),
    ("GPL-2.0", "|gnu general public license| |version 2|", ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.")),
    ("LGPL-3.0", "|gnu lesser general public license| |version 3|", ("This library is licensed under the GNU Lesser General Public License, version 3.",)),
    ("LGPL-2.1", "|gnu lesser general public license| |version 2.1|", ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.",)),
    ("AGPL-3.0", "|gnu affero general public license| |version 3|", ("This work is licensed under the GNU Affero General Public License, version 3.",)),
    ("MPL-2.0", "|mozilla public license| |2.0|", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",)),
    ("BSD-3-Clause", "|neither the name|", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",)),
    ("BSD-2-Clause", "|redistribution and use in source and binary forms|", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice.",)),
    ("ISC", "|permission to use copy modify and or distribute this software|", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",)),
    ("CC-BY-NC-4.0", "|cc by-nc 4.0|", ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.")),
    ("CC-BY-NC-4.0", "|attribution-noncommercial 4.0|", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",)),
    ("CC-BY-SA-4.0", "|cc by-sa 4.0|", ("Licensed under CC BY-SA 4.0.",)),
    ("CC-BY-SA-4.0", "|attribution-sharealike 4.0|", ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",)),
    ("CC-BY-4.0", "|cc by 4.0|", ("Licensed under CC BY 4.0.",)),
    ("CC-BY-4.0", "|attribution 4.0|", ("This work is licensed under a Creative Commons Attribution 4.0 International License.",)),
    ("CC0-1.0", "|cc0 1.0|", ("Released under CC0 1.0 Universal Public Domain Dedication.", "To the extent possible under law, the author has waived all copyright under CC0 1.0.")),
    ("EPL-2.0", "|eclipse public license| |2.0|", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.", "Licensed under the Eclipse Public License, version 2.0.")),
    ("CDDL-1.0", "|common development and distribution license|", ("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License.", "Licensed under the Common Development and Distribution License, version 1.0.")),
    ("Zlib", "|permission is granted to anyone to use this software for any purpose|", ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",)),
    ("BSL-1.0", "|boost software license|", ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",)),
    ("OFL-1.1", "|sil open font license|", ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",)),
    ("BSD-4-Clause", "|all advertising materials mentioning features or use of this software|", ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: All advertising materials mentioning features or use of this software must display the following acknowledgement.",)),
    ("Unlicense", "|released into the public domain|", ("This is free and unencumbered software released into the public domain.",)),
]
#: A block is a candidate where one of these stands in it (matched lower-cased).
CUES = ("licens", "licenc", "redistribut", "permission", "public domain", "cc by", "cc0")
#: Least saving, as a share of the compressed size of the template's shortest wording: how much
#: of a wording stands in the block, however long the block is.
LEAST_GAIN = 0.3
_CUE = re.compile("|".join(map(re.escape, CUES)), re.I)
_SENTENCE = r"(?<=[.!?;])(?<!\bv\.)(?<!\bver\.)\s+"
_STOP = re.compile(_SENTENCE + r"|\n[ \t\r]*\n\s*", re.I)
_LINE = re.compile(_SENTENCE + r"|\n", re.I)
#: Between two blocks that are one: a single line's end, or the mark of a list's next item.
_JOIN = re.compile(r"[^\w\n]*\n?[^\w\n]*|\W*\(?(?:\w{1,3}[.)]|[*\u2022-])\s*")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _places(block: list[str], phrase: list[str]) -> list[int]:
    """Where a phrase stands in a block, in words."""
    n = len(phrase)
    return [i for i, w in enumerate(block) if w == phrase[0] and block[i : i + n] == phrase]


def blocks_of(text: str | None, stop: re.Pattern = _STOP, lo_at: int = 0, hi_at: int | None = None) -> list[tuple[int, str]]:
    """(start, block) of the sentences with a cue and those next to them, whole text.

    A notice may be wrapped, so a single line's end is a space, and may go on
    over the items of a list. A sentence is taken whole, whatever its length.
    ``_LINE`` as ``stop`` gives blocks that end at lines.
    """
    text = text or ""
    first, last = lo_at, len(text) if hi_at is None else hi_at
    spans: list[list[int]] = []
    begin = first  # after the last stop before the cue
    stops = stop.finditer(text, first, last)
    ahead = next(stops, None)
    for m in _CUE.finditer(text, first, last):
        if spans and m.end() <= spans[-1][1]:
            continue
        while ahead and ahead.end() <= m.start():
            begin, ahead = ahead.end(), next(stops, None)
        lo = begin
        while ahead and ahead.start() < m.end():
            ahead = next(stops, None)
        end = ahead.start() if ahead else last
        # a notice may go on over sentences that have cues of their own
        joined = spans and (lo <= spans[-1][1] + 1 or stop is _STOP and _JOIN.fullmatch(text, spans[-1][1], lo))
        spans[-1].__setitem__(1, end) if joined else spans.append([lo, end])
    return [(a, text[a:b]) for a, b in spans]


class Scanner:
    """Compresses blocks plainly and with each template; built once per worker."""

    def __init__(self, templates=TEMPLATES, least: float = LEAST_GAIN) -> None:
        self.least = least
        self.plain = self._compressor(None)
        self.longest = max(len(w) for _, _, wordings in templates for w in wordings)
        self.templates = []
        for name, must, wordings in templates:
            raw = zstandard.ZstdCompressionDict("\n".join(wordings).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            least_size = min(len(self.plain.compress(w.lower().encode())) for w in wordings)
            self.templates.append((name, [words(p) for p in must.split("|") if p.strip()], [words(w) for w in wordings], self._compressor(raw), least_size))

    @staticmethod
    def _compressor(raw):
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def notices(self, text: str | None) -> list[tuple[int, int, str, float, int, int]]:
        """(start, length, license, gain, missing, extra) of a text's notices.

        A block's lines are looked at as well, since several notices, or a short
        one among lines without full stops, may stand in it: they are taken for
        the block's own license, and besides it unless its wording has theirs.
        """
        out = []
        for start, block in blocks_of(text):
            whole = self.scan(block)
            lines = [(a, x) for a, x in blocks_of(text, _LINE, start, start + len(block)) if x != block]
            hits = [(a, len(x), *hit) for a, x in lines for hit in self.scan(x)]
            more = [hit for hit in whole if all(h[2] != hit[0] for h in hits)]
            within = {name for hit in more for name in self._within(hit[0])}
            out.extend(sorted([*((start, len(block), *hit) for hit in more), *(h for h in hits if h[2] not in within)], key=lambda h: (h[0], -h[3], h[2])))
        return out

    def _within(self, license_name: str) -> set[str]:
        """Other licenses whose phrases all stand in a wording of this one."""
        wordings = [w for name, _, ws, *_ in self.templates if name == license_name for w in ws]
        return {name for name, phrases, *_ in self.templates if name != license_name and any(all(_places(w, p) for p in phrases) for w in wordings)}

    def scan(self, block: str) -> list[tuple[str, float, int, int]]:
        """(license, gain, missing, extra) of all confirmed templates, the largest gain first."""
        pieces = [(p, len(self.plain.compress(p))) for p in self._pieces(block)]
        ranked = sorted(((max((size - len(c.compress(p))) / least for p, size in pieces), -k) for k, (_, _, _, c, least) in enumerate(self.templates)), reverse=True)
        own = words(block)
        found: dict[str, tuple[str, float, int, int]] = {}
        for gain, k in ranked:
            name, phrases, wordings, *_ = self.templates[-k]
            if gain < self.least:
                break
            at = [_places(own, p) for p in phrases]
            if name not in found and all(at):
                found[name] = (name, gain, *min(self._differ(w, self._around(own, at, len(w))) for w in wordings))
        inner = {n for name in found for n in self._within(name)}
        return [hit for name, hit in found.items() if name not in inner]

    def _pieces(self, block: str) -> list[bytes]:
        """The block, or its overlapping pieces that have a cue, such that any wording lies whole in one.

        What a template saves is lost in the noise of a much longer block.
        """
        text = block.lower()
        if len(text) <= 2 * self.longest:
            return [text.encode("utf-8", "surrogatepass")]
        cut = (text[i : i + 2 * self.longest] for i in range(0, len(text), self.longest))
        return [p.encode("utf-8", "surrogatepass") for p in cut if _CUE.search(p)] or [b""]

    @staticmethod
    def _around(own: list[str], at: list[list[int]], size: int) -> list[str]:
        """The words of a block that a wording of ``size`` words may cover, given where its phrases stand."""
        return own[max(0, at[0][0] - size) : max(p[0] for p in at) + 2 * size]

    @staticmethod
    def _differ(wording: list[str], own: list[str]) -> tuple[int, int]:
        """Words of the wording that the block lacks, and words between them that it has besides."""
        found = [m for m in difflib.SequenceMatcher(None, wording, own, autojunk=False).get_matching_blocks() if m.size]
        same = sum(m.size for m in found)
        reach = found[-1].b + found[-1].size - found[0].b if found else 0
        return len(wording) - same, reach - same


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST_GAIN) -> DataFrame:
    """One row per license notice: ``id, start, length, license, gain, missing, extra``.

    Blocks around license words are compressed plainly and with each template
    as zstandard's raw dictionary; templates are ranked by what they save, as a
    share of their own size, and those whose own phrases stand in the block word
    for word are its licenses, however many. One that is only a part of another
    found (two clauses of three) is left out. ``missing`` and ``extra`` count the
    words that differ from its nearest wording. ``start`` (0-based) and ``length`` are code points.

    Defined results: null and empty texts, and texts without license words,
    have no rows; repeated rows and repeated notices each have theirs. Equal
    gains are ranked in the order of the templates. An empty table gives no
    rows. Every row is read whole, on its own, however long; nothing is
    shuffled. Other columns are ignored whatever their names.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("license", T.StringType()), T.StructField("gain", T.DoubleType()), T.StructField("missing", T.LongType()), T.StructField("extra", T.LongType())])

    def run(batches):
        scanner = Scanner(templates, least)
        for b in batches:
            out = []
            for i, text in zip(b["_id"], b["_text"], strict=True):
                out.extend((i, *hit) for hit in scanner.notices(text))
            yield pd.DataFrame(out, columns=schema.names).astype({"start": np.int64, "length": np.int64, "gain": np.float64, "missing": np.int64, "extra": np.int64})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    # the cue words are looked for in the plan first, so that other texts never leave it
    return rows.where(F.col("_text").rlike("(?i)" + "|".join(map(re.escape, CUES)))).mapInPandas(run, schema)
