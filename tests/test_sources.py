"""Readers, writers and the streams."""

import json
import struct

from vanikosh.sources import readers
from vanikosh.sources.writers import CSV, write_batches, write_csv, write_json, write_lines
from vanikosh.streaming import segments


def test_segment_files(spark, tmp_path):
    data = [{"start": 0.5, "end": 1.5, "speaker_id": 7, "text": "नमस्ते"}, {"start": 2, "end": 3, "speaker_id": None, "text": None}]
    (tmp_path / "825780_transcription.json").write_text(json.dumps(data, indent=1), encoding="utf8")
    rows = readers.segment_files(spark, str(tmp_path)).orderBy("seg_no").collect()
    assert [tuple(r) for r in rows] == [("825780", 0, 0.5, 1.5, 7, "नमस्ते"), ("825780", 1, 2.0, 3.0, None, None)]


def test_word_file_and_manifest(spark, tmp_path):
    (tmp_path / "w.csv").write_text("word\nक \n\nख\nक\n", encoding="utf8")
    assert {r.word for r in readers.word_file(spark, str(tmp_path / "w.csv")).collect()} == {"क", "ख"}
    (tmp_path / "m.csv").write_text("rid,lang\n1,hi\n2,en\n3,HI\n", encoding="utf8")
    assert [r.rid for r in readers.manifest(spark, str(tmp_path / "m.csv")).collect()] == ["1", "3"]


def test_audio_headers(spark, tmp_path):
    head = b"RIFF" + struct.pack("<I", 36 + 32000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 32000)
    (tmp_path / "a.wav").write_bytes(head + bytes(32000))
    (tmp_path / "b.wav").write_bytes(b"no wav")
    row = readers.audio_files(spark, str(tmp_path)).collect()
    assert [(r.rate, r.channels, r.seconds) for r in row] == [(16000, 1, 1.0)]


def test_audio_samples(spark, tmp_path):
    import wave

    for name, rate, frames in (("mono", 16000, [(0,), (16384,), (-32768,)]), ("stereo", 8000, [(8192, 24576), (0, 0)]), ("none", 16000, [])):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setparams((len(frames[0]) if frames else 1, 2, rate, 0, "NONE", "")) 
            w.writeframes(b"".join(struct.pack(f"<{len(f)}h", *f) for f in frames))
    (tmp_path / "bad.wav").write_bytes(b"no wav")
    got = {r.path.split("/")[-1]: r for r in readers.audio_samples(spark, str(tmp_path)).collect()}
    assert got["mono.wav"].samples == [0.0, 0.5, -1.0] and got["mono.wav"].seconds == 3 / 16000
    assert got["stereo.wav"].samples == [0.5, 0.25, 0.0, 0.0]
    assert got["none.wav"].samples == [] and got["bad.wav"].samples is None


def test_writers_keep_nulls_and_empty_texts(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, 'a "b", c'), (4, "दो\nपंक्ति"), (5, "\\N ")]
    df = spark.createDataFrame(rows, "id int, text string")
    write_json(df, f"{tmp_path}/j")
    write_csv(df, f"{tmp_path}/c", one_file=True)
    write_batches(df, f"{tmp_path}/p", 2)
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/j").collect())) == rows
    assert sorted(map(tuple, spark.read.schema(df.schema).options(**CSV).csv(f"{tmp_path}/c").collect()), key=lambda r: r[0]) == rows
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 3
    write_lines(df.where("id = 3").withColumnRenamed("text", "line"), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ['a "b", c']


def test_stream_equals_batch(spark):
    from vanikosh.plans.cleanup import cleanup_pipeline

    sf = "/root/testdata/sf0.001"
    batch = {(r.seg_id, r.tagged, r.tags) for r in cleanup_pipeline(spark, sf).collect()}
    assert {tuple(r) for r in segments.stream_cleanup(spark, sf).collect()} == batch
