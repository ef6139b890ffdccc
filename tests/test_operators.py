"""Core operators on small tables, with their edge cases."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from vanikosh.operators import lattice
from vanikosh.operators.intervals import periods_and_gaps, to_ms, usable
from vanikosh.operators.scans import fill_down, running_sum
from vanikosh.operators.stage import stage
from vanikosh.plans import quality
from vanikosh.sources import samples


def _periods(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if None not in (k, s, e):
            by[k].append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged}
        out |= {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def test_periods_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), (s := rng.randint(0, 500)), s + rng.choice([0, 1, 5, 20, 90])) for _ in range(300)]
    rows += [("a", None, 3), ("b", 4, None), ("hot", 0, 10_000)] + [("hot", i, i + 1) for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "rid string, s bigint, e bigint, kind string")
    for block in (7, 1000, 3_600_000):
        got = periods_and_gaps(df, "rid", "s", "e", block).collect()
        assert {tuple(r) for r in got} == _periods(rows)
        assert len(got) == len(_periods(rows))


def test_periods_of_nothing(spark):
    assert periods_and_gaps(spark.createDataFrame([], "rid string, s bigint, e bigint"), "rid", "s", "e").collect() == []


def test_usable_times(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0.0, 1.0, True), (-0.1, 1.0, False), (1.0, 1.0, False), (2.0, 1.0, False), (None, 1.0, False), (0.0, None, False), (nan, 1.0, False), (0.0, nan, False), (0.0, inf, False), (0.0, 1e300, False)]
    df = spark.createDataFrame(rows, "s double, e double, ok boolean")
    assert all(r.u == r.ok for r in df.select("ok", usable(F.col("s"), F.col("e")).alias("u")).collect())
    assert [r[0] for r in spark.createDataFrame([(0.4914999,), (1.0005,)], "x double").select(to_ms(F.col("x"))).collect()] == [491, 1001]


def test_scans_over_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v int").withColumn("b", F.floor(F.col("t") / 9))
    got = {(r.k, r.t): (r.n, r.f, r.p) for r in fill_down(running_sum(df, ["k"], "b", ["t"], F.coalesce("v", F.lit(0)), "n"), ["k"], "b", ["t"], "v", "f", "p").collect()}
    state = {"a": (0, None), "b": (0, None)}
    for k, t, v in rows:
        n, last = state[k]
        state[k] = (n + (v or 0), v if v is not None else last)
        assert got[k, t] == (*state[k], last)


def test_stage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, stage(df).collect())) == sorted(map(tuple, df.collect()))
    assert stage(df.where("false")).schema == df.schema


def test_lattice_examples(spark):
    expected = {
        "Ex1": [(0.25, 0.0), (0.5, 0.5), (0.25, 0.25), (0.25, 0.25), (0.0, 0.0)], "Ex2": [(0.2, 0.0)] * 4 + [(0.0, 0.0)],
        "Ex3": [(0.0, 0.0), (0.25, 0.0), (0.25, 0.25), (0.25, 0.25), (0.25, 0.25)], "Ex4": [(0.1667, 0.0), (0.0, 0.0), (0.1667, 0.0), (0.1667, 0.1667), (0.1667, 0.0)],
    }
    rows = lattice.evaluate(samples.lattice_samples(spark), ["utt"]).collect()
    got = {u: [(r.standard_wer, r.lattice_wer) for r in sorted(rows, key=lambda r: r.model) if r.utt == u] for u in expected}
    assert got == expected
    assert sum(r.unfair for r in rows) == 9


def test_lattice_edges(spark):
    rows = [("e", "", "a", ""), ("e", "", "b", "x y"), ("l", "a b c d", "a", "a b c d e f")]
    got = {(r.utt, r.model): (r.standard_wer, r.lattice_wer) for r in lattice.evaluate(spark.createDataFrame(rows, "utt string, ref string, model string, hyp string"), ["utt"]).collect()}
    assert got == {("e", "a"): (0.0, 0.0), ("e", "b"): (1.0, 1.0), ("l", "a"): (0.5, 0.3333)}


def test_taxonomy_of_the_replicated_pairs(spark, tmp_path):
    samples.replicated_pairs(spark).selectExpr("id", "'r' as rid", "'run' as run_id", "reference", "baseline_pred", "ft_pred").write.parquet(f"{tmp_path}/predictions.parquet")
    counts = {r.cat: r.n for r in quality.error_taxonomy(spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == 530
    assert counts == {  # "और" has two code points, so all its 18 deletions are of function words
        "DELETION_FUNC": 159, "GRAM_INFLECTION": 123, "OTHER_SUBST": 122, "POSTPOSITION_ERROR": 90, "DELETION_CONTENT": 36,
        "PHONETIC_CONF": 0, "COMPOUND_SPLIT": 0, "NUMERIC_MISMATCH": 0, "INSERTION": 0,
    }
    severity = {r.severity: r.n for r in quality.wer_severity_counts(spark, str(tmp_path)).where("model = 'fine_tuned'").collect()}
    assert severity == {"mild": 261, "moderate": 54}
    assert quality.stratified_sample(spark, str(tmp_path)).count() == 26
    delta = {r.cat: (r.utterances, r.delta) for r in quality.repair_delta(spark, str(tmp_path)).collect()}
    assert delta["GRAM_INFLECTION"][1] == delta["POSTPOSITION_ERROR"][1] == 0.0
    assert delta["PHONETIC_CONF"] == (0, None)


def test_cycled_texts(spark):
    rows = samples.cycled(spark, ["क", "abc", "ख"], 7).orderBy("id").collect()
    assert [(r.id, r.text) for r in rows] == [(0, "क"), (2, "ख"), (3, "क"), (5, "ख"), (6, "क")]
    assert all(4 <= r.duration <= 18 for r in rows)
