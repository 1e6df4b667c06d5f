"""License scans by conditional compression.

Method: the lines of a text that read like licence wording form candidate blocks. A block, lower-cased, is compressed alone
and with each template as zstandard raw dictionary; templates are ranked by how much smaller that makes it.
From the top, a template wins when its exact wording differs from the block's by few enough words; the words
that differ are told. Words around the template inside the block do not count as differences of the wording, but
words missing, changed or added within it do. What stands before and after a confirmed wording is scanned again.

A line is looked at when it holds a word that speaks of licences or one of the given templates' telling words: of each
template its longest words, one more than it may miss.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from seqforge.llm.common import batches_of, from_numpy, two_columns

# Short public licence statements and notices.
TEMPLATES = {
    "MIT": ["Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"],
    "All-rights-reserved": ["All rights reserved."],
}
TRIGGER = re.compile(r"licen[sc]|copyright|rights\s+reserved|creative\s+commons|permission\s+is\s+hereby|redistribut|"
                     r"free\s+software|spdx", re.I)
WORDS = re.compile(r"[\w.\-+/:]*\w")

FOUND = pa.schema([("doc_id", pa.int64()), ("block_no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                   ("license_id", pa.string()), ("template_no", pa.int32()), ("reduction", pa.float64()),
                   ("n_differences", pa.int32()), ("exact", pa.bool_()), ("differences", pa.list_(pa.string()))])


def said(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


class Scanner:
    def __init__(self, templates: dict[str, list[str]], tolerance: float, level: int = 9):
        self.templates = [(name, k, text, said(text)) for name, texts in templates.items() for k, text in enumerate(texts)]
        self.vocabulary = {w for *_, ws in self.templates for w in ws}
        self.telling = {w for *_, ws in self.templates
                        for w in sorted(set(ws), key=lambda w: (-len(w), w))[:int(tolerance * len(ws)) + 1]}
        self.tolerance, self.level, self.packers = tolerance, level, None

    def __getstate__(self):                   # compressors are made anew where they are used
        return self.__dict__ | {"packers": None}

    def _ready(self) -> None:
        if self.packers is None:
            raw = lambda t: zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            make = lambda **k: zstandard.ZstdCompressor(level=self.level, write_content_size=False, **k)
            self.alone, self.packers = make(), [make(dict_data=raw(text)) for _, _, text, _ in self.templates]

    def candidate(self, text: str) -> bool:
        return bool(TRIGGER.search(text)) or not self.telling.isdisjoint(said(text))

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Runs of neighbouring lines in licence vocabulary around lines with a trigger, as (start, end)."""
        if not self.candidate(text):
            return []
        out, run, fired = [], None, False
        for line in re.finditer(r"[^\r\n]+", text):
            hit = self.candidate(line.group())
            ws = said(line.group()) if not hit else []
            near = hit or (len(ws) > 2 and 4 * sum(w in self.vocabulary for w in ws) >= 3 * len(ws))
            if near:
                run, fired = (run[0] if run else line.start(), line.end()), fired or hit
            else:
                if run and fired:
                    out.append(run)
                run, fired = None, False
        if run and fired:
            out.append(run)
        return out

    def differences(self, have: list[str], want: list[str]) -> tuple[list[str], int, int]:
        """Words missing (-) from and added (+) within the template's wording, and the words it spans."""
        edits = difflib.SequenceMatcher(None, have, want, autojunk=False).get_opcodes()
        out = []
        for at, (kind, a, b, c, d) in enumerate(edits):
            if kind == "equal":
                continue
            out += [f"-{w}" for w in want[c:d]]
            if 0 < at < len(edits) - 1:       # what stands before or after the wording is not part of it
                out += [f"+{w}" for w in have[a:b]]
        same = [(a, b) for kind, a, b, _, _ in edits if kind == "equal"]
        return out, *((same[0][0], same[-1][1]) if same else (0, 0))

    def confirmed(self, block: str) -> tuple[tuple, int, int] | None:
        """The first confirmed template of the ranking, and the characters of its wording."""
        raw, at = block.lower().encode("utf-8", "surrogatepass"), list(WORDS.finditer(block))
        have = [m.group().lower() for m in at]
        size = len(self.alone.compress(raw))
        ranked = sorted(((size - len(p.compress(raw))) / size, -k) for k, p in enumerate(self.packers))
        for reduction, k in reversed(ranked):
            if reduction <= 0:
                break
            name, turn, _, want = self.templates[-k]
            diff, a, b = self.differences(have, want)
            if a < b and len(diff) <= self.tolerance * len(want):
                return (name, turn, reduction, len(diff), not diff, diff), at[a].start(), at[b - 1].end()
        return None

    def scan(self, text: str | None) -> list[tuple]:
        self._ready()
        out = []
        for no, (start, end) in enumerate(self.blocks(text or "")):
            rest = [(start, end)]
            while rest:
                a, b = rest.pop()
                hit = self.confirmed(text[a:b]) if self.candidate(text[a:b]) else None
                if hit:
                    out.append((no, start, end, *hit[0]))
                    rest += [(a + hit[2], b), (a, a + hit[1])]
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, tolerance: float = 0.2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each template confirmed in a block.

    doc_id; block_no among the text's candidate blocks; start and end, its characters; license_id and
    template_no; reduction, the share of its compressed size that the template saves; n_differences, exact and the
    differing words. ``tolerance`` is the most differences a word of the template. Blocks that no template fits give no
    row, nor do null, empty and other texts without licence wording. Null and repeated ids do no harm: rows
    are independent. Ties in size go to the earlier template. Other columns are not looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Scanner(templates or TEMPLATES, tolerance))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows):
            found = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                     for hit in sent.value.scan(text)]
            if found:
                yield from_numpy(FOUND, *map(list, zip(*found)))

    schema = ("doc_id long, block_no int, start long, end long, license_id string, template_no int, reduction double, "
              "n_differences int, exact boolean, differences array<string>")
    return two_columns(docs, id_col, text_col).mapInArrow(run, schema)
