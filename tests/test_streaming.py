"""Row-wise operators on a stream."""

from __future__ import annotations

from glossaria.streaming import recode_language, romanize


def test_romanize_stream(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([("mon", "Дом"), ("rus", "да")], "language string, text string")
    df.write.json(source)
    stream = spark.readStream.schema(df.schema).json(source)
    out = romanize(recode_language(stream, {"mon": "khk"}))
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    got = spark.read.schema(df.schema).parquet(str(tmp_path / "out"))
    assert rows(got) == [("khk-rom", "Dom"), ("rus-rom", "da")]
