"""Problems 4 and 5: the line parser, speaker turns and languages."""

import math
import random

import pytest

from vanikosh.llm import language, turns
from vanikosh.llm.canon import canonical
from vanikosh.llm.charlm import KneserNey, word_scores
from vanikosh.llm.speech import LineParser, squeeze

FILLERS = ["हम्म", "उम्म", "उह", "um", "uh", "hmm", "হুম", None, " "]
LINES = {
    "00:01:37.667 --> speaker_01: पहली बात: मन": [(None, []), ("n1", ["पहली", "बात:", "मन"])],
    "[00:07:59] [ मौन ] *अस्पष्ट*": [(None, [])],
    "(00:53) B: मुझे <3:25> काम": [(None, []), ("n2", ["मुझे", "काम"])],
    "@523.1s SPK1 - कभी {t=12.5} कभी": [(None, []), ("n1", ["कभी", "कभी"])],
    "<v Speaker 2> [1m05s] yes": [(None, []), ("n2", ["yes"])],
    "ID 601816: after Guide : ok [कॉलर] हाँ (वक्ता-१) जी": [(None, []), ("i601816", ["after"]), ("rguide", ["ok"]), ("rcaller", ["हाँ"]), ("n1", ["जी"])],
    "उह हम्मममम... हम चले um, (laughs 3s) (जो पास में है) [phone": [(None, ["हम", "चले", "(जो", "पास", "में", "है)"])],
    "नोट: 9:30 बजे": [(None, ["नोट:", "9:30", "बजे"])],
    "S2> मेज़बान - a S3>": [(None, []), ("n2", []), ("rhost", ["a"]), ("n3", [])],
    "": [],
}


@pytest.mark.parametrize("line", LINES)
def test_lines(line):
    assert LineParser(FILLERS).pieces(canonical(line)) == LINES[line]


def test_squeeze():
    assert squeeze("हम्ममममम") == "हम्म" and squeeze("हम्म्म्म") == "हम्म" and squeeze("uhhhh") == "uh" and squeeze("हम") == "हम"


def _turns_by_hand(segments, speakers):
    named = {}
    for rid, no, sid, role in speakers:
        for ref in (f"n{no}", f"r{role}", f"i{sid}"):
            named.setdefault((rid, ref), sid)
    parser, out = LineParser(FILLERS), []
    for rid in {s[1] for s in segments} - {None}:
        seen, rows = set(), []
        for seg, r, a, b, who, text in sorted(segments):
            if r != rid or None in (a, b, text) or math.isnan(a) or a < 0 or b <= a:
                continue
            a, b, form = round(a * 1000), round(b * 1000), canonical(text)
            if (a, b, who, form) not in seen:
                seen.add((a, b, who, form))
                rows.append((a, b, seg, who, form))
        last, turn = None, None
        for _, _, seg, who, form in sorted(rows, key=lambda x: x[:3]):
            for ref, words in parser.pieces(form):
                if words:
                    by = named.get((rid, ref)) or who or last
                    if by is None:
                        continue
                    if by == last:
                        turn[3] = seg
                    else:
                        out.append(turn := [rid, by, seg, seg])
                    last = by
    return {tuple(t) for t in out}


def test_turns_against_brute_force(spark):
    rng = random.Random(9)
    texts = ["हाँ जी", "Speaker 1: चलो S2> ठीक है", "[शोर]", "उह", None, "", "Guest: आइए host - बैठिए", "Speaker 7: कौन", "हाँ जी", "ID 12: मैं"]
    speakers = [(r, n, 10 * (r == "b") + n, role) for r in "ab" for n, role in ((1, "host"), (2, "guest"))]
    segments = []
    for i in range(120):
        start = rng.choice([None, float("nan"), -1.0, *[rng.randint(0, 40) / 4 for _ in range(30)]])
        end = rng.choice([None, 0.0, *[None if start is None else start + rng.choice([0.25, 3.0])] * 20])
        segments.append((i, rng.choice(["a", "a", "b", None]), start, end, rng.choice([None, None, 1, 2, 11]), rng.choice(texts)))
    seg = spark.createDataFrame([(*s, "x") for s in segments], "seg_id bigint, rid string, start double, end double, speaker_id bigint, text string, turn string")
    spk = spark.createDataFrame(speakers, "rid string, speaker_no int, speaker_id bigint, role string")
    for block in (1000, 3_600_000):
        kept = turns.pieces(seg, spk, [f for f in FILLERS if f], block=block)
        got = {(r.rid, r.speaker_id, r.first_seg_id, r.last_seg_id) for r in turns.turns(turns.numbered_pieces(kept)).collect()}
        assert got == _turns_by_hand(segments, speakers)
    assert turns.turns(turns.numbered_pieces(turns.pieces(seg.where("false"), spk, []))).collect() == []


def test_model_is_a_distribution():
    model = KneserNey({"abab": 3, "abc": 2, "b": 1}, order=3, alphabet=8)
    import itertools

    words = ["".join(w) for n in range(0, 7) for w in itertools.product("abcdefg", repeat=n)][:60_000]
    total = sum(math.exp(x) for x in word_scores([model], words)[:, 0])
    assert 0.8 < total <= 1.0001
    assert word_scores([model], ["abab"])[0, 0] > word_scores([model], ["gggg"])[0, 0]
    assert word_scores([model], []).shape == (0, 1)


@pytest.fixture(scope="module")
def model():
    import pandas as pd

    rows = pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet")
    return language.LanguageModel(list(zip(rows.lang, rows.script, rows.text)), ["उह", "um"])


def test_held_out_accuracy():
    import pandas as pd

    rows = pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet")
    right = total = 0
    for fold in range(3):
        train, test = rows[rows.index % 3 != fold], rows[rows.index % 3 == fold]
        labeller = language.Labeller(language.LanguageModel(list(zip(train.lang, train.script, train.text))))
        for lang, found in zip(test.lang, labeller.label(test.text)):
            right += len(found) == 1 and found[0]["lang"] == lang
            total += 1
    assert right / total >= 0.98


def test_stretches(spark, model):
    hi, en = "वहाँ पहुँचने में करीब तीन घंटे लग गए थे", "the food at the village was simple but everyone felt at home"
    rows = [
        (1, "hi_IN", hi), (2, "en", hi), (3, "hi", f"{hi} {en} {hi}"), (4, None, "हाँ जी"), (5, "und", f"Speaker 1: {hi} [noise] project"), (6, "hi", None), (7, "hi", ""),
        (8, "mr", "raste mein gaadi kharab hui toh hum paidal chale gaye"), (9, "HIN", f"उह {hi} um"),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "seg_id bigint, lang string, text string, stretches int")
    got = {r.seg_id: r for r in language.stretches(df, model).collect()}
    assert [[s.lang for s in got[i].stretches] for i in range(1, 10)] == [["hi"], ["hi"], ["hi", "en", "hi"], [], ["hi"], [], [], ["hi"], ["hi"]] or [s.lang for s in got[4].stretches] in (["hi"], ["mr"])
    assert {i: got[i].label for i in got} == {1: "hi", 2: "en", 3: "hi", 4: None, 5: None, 6: "hi", 7: "hi", 8: "mr", 9: "hi"}
    assert all(0 <= s.confidence <= 1 for r in got.values() for s in r.stretches)


def test_stretches_have_the_lowest_cross_entropy(model):
    import numpy as np

    hi, en = "वहाँ पहुँचने में करीब तीन घंटे लग गए थे", "the food at the village was simple but everyone felt at home"
    words = [w for w in f"{hi} project {en} मोबाइल again {hi}".split()]
    by = model.scores(words)
    path = language.best_paths(language.limited(by, model.clip), np.array([len(words)]), model.switch)
    for lang, a, b in language.decided(path, by):
        entropy = -by[a:b].sum(axis=0) / sum(len(w) + 1 for w in words[a:b])
        assert lang == entropy.argmin()
    assert [model.languages[x[0]] for x in language.decided(path, by)] == ["hi", "en", "hi"]


def test_sample_bound_of_languages(spark, tmp_path):
    spark.createDataFrame([(1, "en", "Latn", "a b"), (2, "en", "Latn", "c d")], "sample_id bigint, lang string, script string, text string").write.parquet(f"{tmp_path}/lang_samples.parquet")
    spark.createDataFrame([("um", "en")], "term string, lang string").write.parquet(f"{tmp_path}/filler_terms.parquet")
    assert language.fit(spark, str(tmp_path), 2).fillers == ("um",)
    with pytest.raises(ValueError):
        language.fit(spark, str(tmp_path), 1)


def test_rejects_what_is_no_known_language(model):
    found = language.Labeller(model).label(__import__("pandas").Series(["你好 世界 再见 朋友", "ქართული ენა არის ლამაზი"]))
    assert {s["lang"] for f in found for s in f} == {"und"}


def test_model_without_samples():
    labeller = language.Labeller(language.LanguageModel([]))
    assert labeller.label(__import__("pandas").Series([None, "", "क ख ग घ"]))[:2] == [[], []]
