"""Word queries on small tables, against brute force."""

from collections import Counter, defaultdict

from vanikosh.plans import words
from vanikosh.sources import readers

NAN, INF = float("nan"), float("inf")


def _table(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")


def test_segments_merge_keeps_segments_without_usable_times(spark, tmp_path):
    late = [(None, 1.0), (1.0, None), (-1.0, 2.0), (NAN, 2.0), (0.0, NAN), (3.0, INF), (5.0, 4.0), (2.0, 2.0)]
    rows = [("a", 9, 20.0, 21.0, "ख"), ("a", 0, 10.0, 11.0, "क"), ("a", None, None, None, "अंत"), ("a", 3, 0.0, 1.0, None)]
    rows += [("a", 20 - i, *t, f"{i}") for i, t in enumerate(late)]
    rows += [("long", 1, 7300.0, 7301.0, "ग"), ("long", 0, 5.0, 6.0, "घ"), ("long", 5, None, 1.0, "च"), ("long", 4, None, 1.0, "छ"), ("long", None, None, 1.0, "ज")]
    rows += [("none", 1, None, None, "ट"), ("none", 1, None, None, "ठ"), (None, 2, None, None, "ड"), (None, 1, 1.0, 2.0, "ढ")]
    rows = [(i, *r) for i, r in enumerate(rows)]
    _table(spark, tmp_path, "rid_transcription", rows, "seg_id bigint, rid string, seg_no int, start double, end double, text string")
    whole = {"a": "क ख 7 6 5 4 3 2 1 0 अंत", "long": "घ ग छ च ज", "none": "ट ठ", None: "ढ ड"}
    assert sum(r.segments for r in words.segments_merge(spark, str(tmp_path)).collect()) == 20
    for size in (1, 2, 3, 4096):
        parts = defaultdict(list)
        for r in words.segments_merge(spark, str(tmp_path), part_segments=size).collect():
            parts[r.rid].append((r.part, r.segments, r.text))
        assert {rid: " ".join(t for _, _, t in sorted(p)) for rid, p in parts.items()} == whole
        assert {rid: sum(n for _, n, _ in p) for rid, p in parts.items()} == {"a": 11, "long": 5, "none": 2, None: 2}
        assert all(n == len(t.split(" ")) <= size + 2 for p in parts.values() for _, n, t in p)
    assert sorted(parts["long"]) == [(0, 1, "घ"), (2, 4, "ग छ च ज")] and len(parts["a"]) == 1


def test_ngrams_of_training_and_validation_texts(spark, tmp_path):
    train, validation = ["क ख क", "क  ख", None, "", "xyz", "ग घ च छ ज"], ["क ख", None, "ट", "घ च छ ज"]
    _table(spark, tmp_path, "rid_transcription", [(t,) for t in train], "text string")
    _table(spark, tmp_path, "predictions", [(t,) for t in validation], "reference string")
    want = Counter()
    for text in train + validation:
        w = [t for t in (text or "").split() if t != "xyz"]
        want.update((n, " ".join(w[i : i + n])) for n in range(1, 5) for i in range(len(w) - n + 1))
    assert {(r.n, r.gram): r["count"] for r in words.ngram_counts(spark, str(tmp_path)).collect()} == want


def test_wordlist_drops_a_header_only_in_front(spark, tmp_path):
    _table(spark, tmp_path, "word_result", [(1, " "), (2, " Words "), (3, "क"), (4, "word"), (5, "words"), (6, "Words"), (7, "क "), (8, None)], "ord bigint, word string")
    assert {tuple(r) for r in words.wordlist_dedup(spark, str(tmp_path)).select("word", "ord").collect()} == {("क", 3), ("word", 4), ("words", 5), ("Words", 6)}
    _table(spark, tmp_path / "plain", "word_result", [(4, "word"), (3, "क")], "ord bigint, word string")
    assert {r.word for r in words.wordlist_dedup(spark, str(tmp_path / "plain")).collect()} == {"क", "word"}
    _table(spark, tmp_path / "empty", "word_result", [], "ord bigint, word string")
    assert words.wordlist_dedup(spark, str(tmp_path / "empty")).count() == 0
    files = tmp_path / "lists"
    files.mkdir()
    (files / "a.csv").write_text("word\nक\nwords\n", encoding="utf8")
    (files / "b.csv").write_text("unique words\nख\n", encoding="utf8")
    (files / "c.csv").write_text("ग\nunique_words\n", encoding="utf8")
    assert {r.word for r in readers.word_file(spark, str(files)).collect()} == {"क", "words", "ख", "ग", "unique_words"}
