"""Vocabulary JSON in segments: round trips, and the file as Python's json module reads and writes it."""

import json

import pytest

from seqforge.sources.json_vocab import read_vocab_json, write_vocab_json

TOKENS = ["a", "b,c", ",", '"', '",', "\\", '\\"', "é", "{", "}", ":", "a:1}", " ", "", "line\nbreak", "\t", "日本", '{"x":1,"y":2}']


def test_written_in_parts_and_read_from_any_split(spark, tmp_path):
    tokens = TOKENS + [f'w{i}"{i},' for i in range(300)]
    df = spark.createDataFrame(list(zip(tokens, range(len(tokens)))), "token string, id bigint").repartition(5)
    path = str(tmp_path / "vocab")
    write_vocab_json(df, path)
    parts = sorted((tmp_path / "vocab").glob("part-*"))
    text = "".join(p.read_text(encoding="utf-8") for p in parts)
    assert json.loads(text.split("\n")[0]) == dict(zip(tokens, range(len(tokens))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_vocab_json(spark, path).orderBy("pos").collect()
            assert [(r.pos, r.token, r.id) for r in got] == [(i, t, i) for i, t in enumerate(tokens)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_foreign_files(spark, tmp_path):
    path = tmp_path / "v.json"
    for more, ascii_only in (("", True), ('\n{"other": 1, "x": 2}\n', False)):
        path.write_text(json.dumps({t: 7 * i - 3 for i, t in enumerate(TOKENS)}, ensure_ascii=ascii_only) + more, encoding="utf-8")
        got = read_vocab_json(spark, str(path)).orderBy("pos").collect()
        assert [(r.token, r.id) for r in got] == [(t, 7 * i - 3) for i, t in enumerate(TOKENS)]
    path.write_text("{}\n")
    assert read_vocab_json(spark, str(path)).collect() == []
    path.write_text('{"a": 1, "b": x}\n')
    with pytest.raises(Exception, match="no vocabulary entry"):
        read_vocab_json(spark, str(path)).collect()
