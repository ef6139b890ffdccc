"""Problems 3, 6, 7 and 8: terms, tokens, mixtures and spam."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from vanikosh.llm import bpe, mix, spam, terms
from vanikosh.llm.canon import canonical

# --- terms --------------------------------------------------------------------------


def test_terms_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["Ａbc,", "abc", "(है।", "है", "--", "...", "नि:शुल्क", "café", "x²", "a\u3000b", "c\u2800d", "e\u00b4f", "\u200b", "क |", None]
    texts = [None if rng.random() < 0.1 else " ".join(x for x in (rng.choice(bits) for _ in range(rng.randint(0, 6))) if x) for _ in range(200)]
    occurrences, records = Counter(), Counter()
    for t in texts:
        if t is not None:
            said = [w for p in canonical(t, "lower").split(" ") if (w := regex.sub(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "", p))]
            occurrences.update(said)
            records.update(set(said))
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, term int").repartition(5)
    partial = terms.text_counts(df, "text").withColumn("field", F.lit("f"))
    got = terms.sum_by_range(partial, "field").collect()
    assert {r.term: (r.occurrences, r.records) for r in got} == {t: (occurrences[t], records[t]) for t in occurrences}
    assert len({r.term_id for r in got}) == len(got) == len(occurrences)
    assert terms.sum_by_range(partial.where("false"), "field").collect() == []


def test_identifiers_depend_on_terms_only(spark):
    rng = random.Random(5)
    rows = [(rng.choice("fgh"), f"t{rng.randint(0, 3000)}", 1, 1) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "field string, term string, occurrences bigint, records bigint")
    seen = []
    for parts, batch in ((1, 10_000), (7, 64), (3, 1)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        got = terms.sum_by_range(df.limit(30_000 if batch > 1 else 400).repartition(parts), "field").collect()
        want = Counter(r[:2] for r in rows[: 30_000 if batch > 1 else 400])
        assert {(r.field, r.term): r.occurrences for r in got} == want and len(got) == len(want)
        seen.append({(r.field, r.term): r.term_id for r in got})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seen[0] == seen[1]
    for ids in seen:
        for field in "fgh":
            own = sorted(i for (f, _), i in ids.items() if f == field)
            assert len(set(own)) == len(own)
            assert all(i & 0xFFFFFFFF == 0 or i - 1 in set(own) for i in own)  # places of a range follow each other


def test_values_count_sheets(spark):
    rows = [("a", 1), ("A ", 1), ("a", 2), (None, 2), ("", 3), ("  ", 3), ("b", None)]
    df = spark.createDataFrame(rows, "word string, sheet_id bigint")
    got = {r.term: (r.o, r.r) for r in terms.value_counts(df, "word", "sheet_id").groupBy("term").agg(F.sum("occurrences").alias("o"), F.sum("records").alias("r")).collect()}
    assert got == {"a": (3, 2), "b": (1, 0)}


# --- tokens -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.ByteBpe(bpe.default_path())


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(8)
    letters = "abeinorst  '\n\t🙂é½कखािं্আম。—٣0123456789<|endoftext|>\x00\x1c\x85\xa0　"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += [None, "", "<|endoftext|>", "a" * 3000, " " * 50, "I'll we've it's 'S", "ab" * 500, "\r\n\r\n x"]
    encoder = bpe.Encoder(tokenizer)
    assert encoder.encode(texts).to_pylist() == _library(texts)
    assert encoder.exact > 0
    assert encoder.lengths(texts).tolist() == [len(x) for x in _library(texts)]


def test_very_long_words(tokenizer):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(200_000)), "ab" * 300_000, "=" * 500_001]
    want = _library(texts)
    for text, ids in zip(texts, want):
        began = time.perf_counter()
        assert bpe.Encoder(tokenizer).encode([text]).to_pylist() == [ids]
        assert time.perf_counter() - began < 20


def test_forgetful_encoder_is_exact(tokenizer):
    texts = ["one two three", "three four", "five six seven eight one", None, "nine"]
    encoder = bpe.Encoder(tokenizer, memory=3)
    assert [encoder.encode([t]).to_pylist()[0] for t in texts] == _library(texts)


def test_pairs_are_compatible_exactly_if_they_stay(tokenizer):
    rng = np.random.default_rng(1)
    spelled = {}
    for i in rng.integers(0, 50_000, 1500).tolist():
        stack, out = [i], []
        while stack:
            t = stack.pop()
            if tokenizer.left[t] >= 0:
                stack += [tokenizer.right[t], tokenizer.left[t]]
            else:
                out.append(int(np.flatnonzero(tokenizer.byte_id == t)[0]))
        spelled[i] = bytes(out)
    ids = [i for i in spelled if tokenizer._merge_exactly(spelled[i]) == [i]]
    a, b = rng.choice(ids, 1500), rng.choice(ids, 1500)
    found = tokenizer._compatible(a, b)
    assert found.tolist() == [tokenizer._merge_exactly(spelled[x] + spelled[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]


def test_ids_of_a_table(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "  "), (1, "Hello world")]
    df = spark.createDataFrame([(*r, [0]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encoded(df).collect())
    assert got == sorted((i, x) for (i, _), x in zip(rows, _library([t for _, t in rows])))
    assert {(r.doc_id, r.n_tokens) for r in bpe.token_counts(df).collect()} == {(i, len(x)) for i, x in got}
    assert bpe.encoded(df.where("false")).collect() == []


# --- mixture --------------------------------------------------------------------------


def _mixture(spark, docs, targets, block_tokens=64):
    sized = mix.placed(spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "row bigint, doc_id bigint, source string, n_tokens bigint"))
    plan = mix.source_plan(sized, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    passes = mix.passes(sized, plan)
    return sized, plan, passes, mix.drawn_pieces(passes, plan, block_tokens, shard_blocks=50)


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, rng.choice(["big"] * 6 + ["mid", "mid", "small", None, "other"]), rng.randint(0, 400)) for i in range(600)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.15, 1), ("none", 0.05, 3)]
    sized, plan, passes, drawn = _mixture(spark, docs, targets)
    rows = {r.doc_id: r for r in mix.usage(sized, drawn).collect()}
    total = sum(n for _, _, n in docs)
    assert len(rows) == len(docs)
    for source, share, most in targets:
        own = [r for r in rows.values() if r.source == source and r.n_tokens]
        size, given = sum(r.n_tokens for r in own), sum(r.n_tokens * r.times for r in own)
        wanted = min(share * total, size * most)
        assert max((r.times for r in own), default=0) <= most
        assert wanted - 0.001 * total <= given <= wanted
        if own:
            least = min(r.times for r in own)
            assert max(r.times for r in own) - least <= 1
            fits = [r.n_tokens for r in own if r.times == least and r.times < most]
            assert size * most <= share * total or not fits or min(fits) > share * total - given  # nothing more would fit
    assert all(r.times == 0 for r in rows.values() if r.source in (None, "other") or not r.n_tokens)
    table = {r.source: r for r in mix.shares(drawn, plan).collect()}
    assert table["none"].tokens == 0 and table["none"].short and table["small"].short
    assert table["big"].actual_share == pytest.approx(0.5, abs=0.001)
    assert all(t.tokens == sum(r.n_tokens * r.times for r in rows.values() if r.source == s) for s, t in table.items())
    assert all(t.max_times == max((r.times for r in rows.values() if r.source == s), default=0) for s, t in table.items())

    pieces, blocks = mix.packed(passes, plan, block_tokens=64)
    cut = defaultdict(list)
    tokens = Counter()
    for r in pieces.collect():
        cut[r.source, r.block].append((r.offset, r.n_tokens))
        tokens[r.doc_id] += r.n_tokens
    assert tokens == Counter({r.doc_id: r.n_tokens * r.times for r in rows.values() if r.n_tokens * r.times})
    for spans in cut.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(n for _, n in spans) <= 64
    placed = mix.slots(spark, blocks, shard_blocks=50).collect()
    assert {(r.source, r.block) for r in placed} == set(cut) and len(placed) == len(cut)
    assert len({(r.shard, r.slot) for r in placed}) == len(placed)
    sizes = Counter(r.shard for r in placed)
    assert all(n == 50 for s, n in sizes.items() if s < max(sizes))


def test_blocks_hold_the_tokens(spark, tmp_path):
    rng = random.Random(12)
    docs = [(i % 70, "ab"[i % 2], " ".join(rng.choice(["one", "two", "three", "आए"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]  # ids come again
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, x int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 1)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    ids = dict(zip([(d[0], d[2]) for d in docs], _library([d[2] for d in docs])))
    rows = mix.p7_blocks(spark, str(tmp_path)).collect()
    said = Counter()
    for r in rows:
        assert len(r.ids) == sum(p.n_tokens for p in r.pieces) <= mix.BLOCK_TOKENS
        at = 0
        for p in r.pieces:
            part = r.ids[at : at + p.n_tokens]
            assert any(list(part) == v[p.first_token : p.first_token + p.n_tokens] for (d, _), v in ids.items() if d == p.doc_id)
            at += p.n_tokens
            said[p.doc_id] += p.n_tokens
    used = mix.p7_usage(spark, str(tmp_path)).collect()
    assert len(used) == len(docs)
    want = Counter()
    for r in used:
        want[r.doc_id] += r.n_tokens * r.times
    assert +said == +want


def test_mixture_edges(spark):
    sized, plan, _, drawn = _mixture(spark, [(1, "a", 5), (2, "b", 0), (3, None, 4)], [("a", 0.9, None), ("a", 0.1, 2), ("b", None, 1), (None, 0.1, 1)])
    assert {p["source"] for p in plan} == {"a", "b"}
    assert {r.doc_id: r.times for r in mix.usage(sized, drawn).collect()} == {1: 1, 2: 0, 3: 0}
    sized, plan, _, drawn = _mixture(spark, [], [("a", 1.0, 1)])
    assert mix.usage(sized, drawn).collect() == [] and mix.shares(drawn, plan).first().tokens == 0
    assert mix.slots(spark, []).collect() == []
    sized, plan, _, drawn = _mixture(spark, [(1, "a", 5)], [])
    assert [r.times for r in mix.usage(sized, drawn).collect()] == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4096, 5001])
def test_permutation(n):
    assert sorted(mix.permute(np.arange(n), n, 7).tolist()) == list(range(n))


@pytest.mark.parametrize("volume", [5, 500_000])
def test_draws_add_up(volume):
    counts = np.array([5000, 0, 17, 800])
    parts = [mix.shard_counts(counts, s, 12, 500, 3, volume) for s in range(12)]
    assert sum(p[0] for p in parts).tolist() == counts.tolist()
    assert all((b == sum((p[0] for p in parts[:i]), np.zeros(4, int))).all() for i, (_, b) in enumerate(parts))
    assert all(p[0].sum() == 500 for p in parts[:-1]) and min(p[0].min() for p in parts) >= 0


def test_draws_of_any_size():
    big = np.array([3_000_000_000, 5, 1_000_000_000])
    shards = -(-int(big.sum()) // 1024)
    parts = [mix.shard_counts(big, s, shards, 1024, 1) for s in (0, 1, 499_999, 500_000, shards - 2)]
    assert all(p[0].sum() == 1024 and p[0].min() >= 0 for p in parts)
    assert (parts[0][0] + parts[0][1] == parts[1][1]).all() and (parts[2][0] + parts[2][1] == parts[3][1]).all()


# --- spam -----------------------------------------------------------------------------

PROSE = "The food at the village was simple but everyone felt at home. We travelled to the river with two people last week. In the end the guide closed the gate and we moved on. "
SPAM = [
    "cheap headphones | best cheap headphones | cheap headphones online | buy cheap headphones | " * 4,
    "Looking for ringtone maker? Our ringtone maker page has ringtone maker, more ringtone maker and the best ringtone maker of town. " * 4,
    "\n".join(f"- free converter https://www.site{i}.example/p/{i}" for i in range(12)),
    "\n".join(f"headset mixer stand ₹{i}99" for i in range(12)),
    "#mic #stand #usb #mixer #mono #clip #foam #boom #case #dock #blue #black #stereo #grip #cable",
    "मुफ़्त रिंगटोन सस्ता माइक शब्दकोश डाउनलोड हिंदी टाइपिंग कोर्स " * 6,
]
FAIR = [
    PROSE * 3, PROSE + "https://a.example https://b.example", "#mic #stand\n" + PROSE, "Speaker 1: yes\nSpeaker 2: okay\n" * 10,
    "किताब, कपड़ा, मोबाइल, साइकिल\n" + PROSE, "O come with me, my love, to the sea. " * 6, PROSE + "\nmic ₹20; stand ₹30.",
    "recording: the sound that is kept in a file.\nsegment: a part of a recording that is heard as one.\nspeaker: the one who is talking in it.", "हाँ", "",
]


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Scores of the planted texts among documents of the test tables, by id: 100000 on for spam, 200000 on for others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit("x").alias("language"), F.lit(1).alias("z"))
    rows = [(100_000 + i, t) for i, t in enumerate(SPAM)] + [(200_000 + i, t) for i, t in enumerate(FAIR)] + [(300_000, None), (300_001, "  "), (300_002, "Zxq")]
    planted = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, language string, z int")
    # the language of songs is known from other texts that have it
    songs = spark.range(40).select((F.col("id") + 50_000).alias("doc_id"), F.concat(F.lit("When the "), "id", F.lit(" boats come home, my love and I look at the sea, and o how we sing with them.")).alias("text"), F.lit("x").alias("language"), F.lit(1).alias("z"))
    scored = spam.scores(docs.unionByName(songs).unionByName(planted), spark.read.parquet("/root/testdata/sf0.01/lang_samples.parquet"))
    return {r.doc_id: r for r in scored.where("doc_id >= 100000").collect()}


@pytest.mark.parametrize("i", range(len(SPAM)))
def test_spam_is_found(found, i):
    assert found[100_000 + i].flagged


@pytest.mark.parametrize("i", range(len(FAIR)))
def test_fair_texts_are_not(found, i):
    assert 200_000 + i not in found or not found[200_000 + i].flagged


def test_distance_and_direction_both_decide(found):
    assert 300_000 not in found and 300_001 not in found
    word = found[300_002]  # one unknown word lies in the direction of a list, but not far for its length
    assert word.toward > 0.5 and word.distance < spam.DISTANCE and not word.flagged


def test_features_against_brute_force():
    rng = random.Random(4)
    wide = {"the": ("en", 0.9), "of": ("en", 0.5), "is": ("en", 0.1), "है": ("hi", 0.8)}
    bits = ["the", "of", "is", "है", "mic", "Mic", "price", "7", "https://a.example/x", "(case),", "two-one", "a.b@c.de"]
    texts = [" ".join(rng.choice(bits[: rng.randint(2, 12)]) for _ in range(rng.randint(0, 40))) for _ in range(150)] + [None, ""]
    got = spam.Describer(wide, memory=5)
    got = [got.describe(texts[i : i + 30]) for i in range(0, len(texts), 30)]
    got = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
    for i, text in enumerate(texts):
        tokens = (text or "").split()
        links = sum("/x" in t or "@" in t for t in tokens)
        words = [t.strip("(),").lower() for t in tokens if "/x" not in t and "@" not in t and t != "7"]
        n = max(1, len(words) + links)
        pairs = list(zip(words, words[1:]))
        around = defaultdict(set)
        for p, before, after in zip(pairs, ["", *words], [*words[2:], ""]):
            if not set(p) <= {"the", "of", "है"}:
                around[p].add((before, after))
        keys = {p for p, a in around.items() if len(a) >= 3 and pairs.count(p) >= 0.02 * n}
        hit = {j + k for j, p in enumerate(pairs) if p in keys for k in (0, 1)}
        c = Counter(words)
        entropy = -sum(v / len(words) * np.log(v / len(words)) for v in c.values()) / np.log(len(words)) if len(words) > 1 else 1.0
        want = {"words": len(words) + links, "function": sum(w in wide for w in words) / n, "density": len(hit) / n, "entropy": entropy, "repetition": (len(pairs) - len(set(pairs))) / n, "links": links / n}
        for name, value in want.items():
            assert got[name][i] == pytest.approx(value), (name, text)


def test_words_are_learned_from_the_documents(spark):
    seeds = {"the": ("en", 1.0), "है": ("hi", 1.0)}
    rows = [(i, f"the river gauge{i}") for i in range(60)] + [(100 + i, f"यह है घर{i}") for i in range(60)] + [(200 + i, "cheap mic offer") for i in range(300)] + [(999, None)]
    wide = spam.widespread_words(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), seeds)
    assert {w: lang for w, (lang, _) in wide.items()} == {"the": "en", "river": "en", "यह": "hi", "है": "hi"}
    assert spam.widespread_words(spark.createDataFrame(rows, "doc_id bigint, text string"), {}) == {}


def test_sample_bound(spark):
    samples = spark.createDataFrame([(1, "en", "a b"), (2, "en", "a c"), (3, "hi", None)], "sample_id bigint, lang string, text string")
    assert spam.sample_words(samples) == {"a": ("en", 1.0)}
    with pytest.raises(ValueError):
        spam.sample_words(samples, max_samples=1)


def test_nothing_to_describe(spark, tmp_path):
    samples = spark.createDataFrame([], "sample_id bigint, lang string, text string")
    assert spam.scores(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), samples).collect() == []
    assert spam.scores(spark.createDataFrame([(1, "some words")], "doc_id bigint, text string"), samples).count() == 1
