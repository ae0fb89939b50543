from __future__ import annotations

from pyspark.sql import functions as F

from strataforge.operators import assets


def test_flattened(spark):
    doc = '{"images": [{"id": "a", "src": "x.png"}, {"name": "b", "url": "y.png"}], "audios": [{"id": "a", "src": "z.mp3"}]}'
    got = {(r.id, r.type, r.path) for r in assets.flattened(spark.createDataFrame([(1, doc), (2, "{")], "k int, j string"), "k", "j").collect()}
    assert got == {("a", "audio", "z.mp3"), ("b", "image", "y.png")}


def test_greedy_ids(spark):
    ids = spark.range(1).select(assets.greedy_ids(F.array(*map(F.lit, ["a", "a", "a_2", "b", "a"]))).alias("ids")).first().ids
    assert ids == ["a", "a_2", "a_2_2", "b", "a_3"]


def test_stems_and_texts(spark):
    row = spark.range(1).select(
        assets.file_stem(F.lit("dir/My file (1).png")).alias("stem"), assets.file_stem(F.lit("dir/...png")).alias("none"),
        assets.first_json(F.lit('text {"a": 1} more')).alias("inner"), assets.first_json(F.lit("nothing")).alias("nothing"), assets.trailing_number(F.lit("x-012")).alias("n"), assets.trailing_number(F.lit("x")).alias("one"),
    ).first()
    assert (row.stem, row.none, row.inner, row.nothing, row.n, row.one) == ("My_file_1", "resource", '{"a": 1}', None, 12, 1)
