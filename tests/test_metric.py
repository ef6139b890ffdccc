"""Rates from ids of tokens, and references joined with outputs."""

from vanikosh.functions.align import token_distance
from vanikosh.operators import lattice, metric
from pyspark.sql import functions as F


def test_corpus_metric(spark):
    vocabulary = spark.createDataFrame([(1, "घर", "x"), (2, " में", "x"), (3, " है", "x"), (9, "<s>", "x"), (0, "<pad>", "x")], "id bigint, piece string, row string")
    rows = [(1, [1, 2, -100, -100], [9, 1, 2, 0]), (2, [1, 3, -100], [1, 2, 3]), (3, None, []), (4, [], None), (5, [-100], [77])]
    df = spark.createDataFrame(rows, "row bigint, label_ids array<bigint>, pred_ids array<bigint>")
    text = {r.row: r.text for r in metric.decoded(df, "label_ids", vocabulary, 0, (9,)).collect()}
    assert text == {1: "घर में", 2: "घर है", 3: "", 4: "", 5: ""}
    assert metric.corpus_metric(df, vocabulary, 0, (9,)).first().wer == 25.0
    assert metric.corpus_metric(df.where("row > 2"), vocabulary, 0).first().wer is None


def test_outputs_get_their_reference(spark):
    refs = spark.createDataFrame([("a", "घर", 1), ("a", "घर", 2), ("b", None, 3), ("c", "x", 4)], "utt string, ref string, model int")
    outs = spark.createDataFrame([("a", "m", "घर"), ("a", "n", None), ("b", "m", ""), ("d", "m", "y"), (None, "m", "z")], "utt string, model string, hyp string")
    got = {tuple(r) for r in lattice.hypotheses_of(refs, outs, ["utt"]).collect()}
    assert got == {("a", "घर", "m", "घर"), ("a", "घर", "n", None), ("b", "", "m", "")}
    rates = {(r.utt, r.model): (r.standard_wer, r.lattice_wer) for r in lattice.evaluate(lattice.hypotheses_of(refs, outs.fillna({"hyp": ""}), ["utt"]), ["utt"]).collect()}
    assert rates == {("a", "m"): (0.0, 0.0), ("a", "n"): (1.0, 1.0), ("b", "m"): (0.0, 0.0)}
    assert lattice.lattice_bins(lattice.hypotheses_of(refs.where("false"), outs, ["utt"]), ["utt"]).collect() == []


def test_distance_beyond_the_short_alphabet(spark):
    many = [f"w{i}" for i in range(21_500)]
    df = spark.createDataFrame([(many[21_000:] + many[:21_000], many[21_000:])], "r array<string>, h array<string>")
    kinds = df.select(token_distance(F.slice("r", 1, 500), F.reverse("h")).alias("a"), token_distance(F.col("h"), F.col("h")).alias("b")).first()
    assert kinds.a == 500 and kinds.b == 0
    few = df.select(token_distance(F.array_append("r", "more"), F.concat(F.array(F.lit("new")), F.col("r"))).alias("d"))
    assert few.where("d = 2").count() == 1
