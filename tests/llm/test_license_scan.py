"""Planted licence wording, exact and changed."""

import random

from pyspark.sql import functions as F

from seqforge.llm.license_scan import TEMPLATES, Scanner, scan_licenses
from tests.conftest import SF_SMALL


def test_every_template_is_found_whole(spark):
    rnd = random.Random(2)
    filler = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(12))
    rows, want = [], {}
    for i, (name, k, text) in enumerate((n, k, t) for n, ts in TEMPLATES.items() for k, t in enumerate(ts)):
        ws = text.split()
        lines = [" ".join(ws[a:a + 9]) for a in range(0, len(ws), 9)] if len(ws) > 14 else [text]
        before = filler()
        rows.append((i, "\n".join([before, *lines, filler()])))
        want[i] = (name, k, len(before) + 1, len(before) + 1 + sum(map(len, lines)) + len(lines) - 1)
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.license_id, r.template_no, r.start, r.end) for r in got} == want
    assert all(r.exact and r.n_differences == 0 and r.differences == [] and r.reduction > 0 for r in got)


def test_changed_wording(spark):
    rows = [(1, "x\nThis work is licensed under the GNU General Public License, version 2.\ny"),
            (2, "This work was licensed under our own terms and nobody may read them, ever."),
            (3, "we saw a licensed driver"), (4, None), (5, ""), (6, "word " * 50_000 + "\nAll rights reserved.\n"),
            (7, "All rights reserved.\nnothing here\nReleased under the MIT License."), (7, "Released under the MIT License."),
            (None, "Licensed under CC BY-NC 4.0."), (8, "Copyright 2020 Someone. ALL RIGHTS RESERVED")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("start", "end", "exact")})
    got = {}
    for r in scan_licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.license_id, r.exact, tuple(r.differences)))
    assert got.pop(1) == [("GPL-3.0", False, ("-3",))]
    assert set(got) == {6, 7, None, 8}
    assert sorted(x[0] for x in got[7]) == ["All-rights-reserved", "MIT", "MIT"]
    assert got[8][0][:2] == ("All-rights-reserved", True)


def test_blocks_and_empty(spark):
    s = Scanner(TEMPLATES, 0.2)
    assert s.blocks("a b c\n\nAll rights reserved.\nd") == [(7, 27)]
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_against_a_plain_search(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    lines = {ts[0]: n for n, ts in TEMPLATES.items()}
    want = sorted((r.doc_id, lines[x]) for r in docs.collect() for x in r.text.split("\n") if x in lines)
    got = sorted((r.doc_id, r.license_id) for r in scan_licenses(docs).where("exact").collect())
    assert got == want and want


def test_every_notice_of_a_block_is_found():
    s = Scanner(TEMPLATES, 0.2)
    names = lambda text: sorted(r[3] for r in s.scan(text))
    apache, mit, reserved = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved."
    assert names(f"Copyright 2020 X. {reserved}\n\n{apache}") == ["All-rights-reserved", "Apache-2.0"]
    assert names(f"{apache}\n{mit}") == ["Apache-2.0", "MIT"]
    assert names(f"{mit} {'plain talk ' * 200}{apache} {'more of it ' * 200}{mit}") == ["Apache-2.0", "MIT", "MIT"]


def test_words_of_given_templates_make_candidates():
    s = Scanner({"PD": ["Dedicated to the public domain."]}, 0.2)
    assert [r[3] for r in s.scan("one\nDedicated to the public domain.\ntwo")] == ["PD"]
    assert [r[3] for r in s.scan("Given to the public domain.")] == ["PD"]
    assert s.scan("a plain line") == []
