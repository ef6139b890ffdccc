"""Languages of segments and of the stretches inside mixed ones (problem 5).

The spoken words of a segment (names of speakers, times, notes and hesitations are
left out by the line parser) get a log probability from one Kneser-Ney character
model per language and script. A best path over the words, on which changing the
language has a cost and one word can speak against a language up to a limit, cuts the
segment into stretches, so that single borrowed, misspelt or unknown words stay within
their stretch; stretches of fewer than ``MIN_RUN`` words join their neighbour. The
language of a stretch is the one of lowest cross-entropy per character. It is
rejected as ``und`` if that is above a bound.

Cost, limit, the bound and the temperature of the confidence are calibrated by
cross-validation: sentences held out are put together to segments with borrowed and
misspelt words and short insertions, and of the costs and limits within a standard
error of the fewest wrong segments the one most reluctant to change is taken; the bound
lies half-way between the level that all but ``REJECTED`` of the held-out runs reach and
that of random characters.

The models are fitted on ``lang_samples``, a fixed table; more than ``MAX_SAMPLES``
rows of a language and script are an error. ``english_word_tag.method`` isn't used:
it is a hint of varying worth, and the words themselves tell more.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.llm.canon import canonical_series
from vanikosh.llm.charlm import KneserNey, word_scores
from vanikosh.llm.speech import LineParser
from vanikosh.llm.turns import filler_terms
from vanikosh.operators.stage import spread
from vanikosh.session import ship_package

LANGUAGES = ("hi", "en", "mr", "bn")
MAX_SAMPLES = 20_000
ORDER = 5
MIN_RUN = 4
FOLDS = 5
#: Costs of a change of language, and limits of one word's say, among which cross-validation chooses.
SWITCHES = (5.0, 7.0, 9.0, 12.0, 16.0)
CLIPS = (4.0, 5.0, 8.0, 12.0)
#: Segments put together per fold, and the share of held-out runs below the level that calibrates rejection.
MADE = 200
#: Share of mixed segments that the choice allows for.
MIXED = 0.05
REJECTED = 0.001

# --- fixed values: notations of the languages' labels ------------------------------

NOTATIONS = {
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"),
    "en": ("en", "eng", "english", "अंग्रेज़ी", "अंग्रेजी"),
    "mr": ("mr", "mar", "marathi", "मराठी"),
    "bn": ("bn", "ben", "bengali", "bangla", "বাংলা"),
}


def label_column(column):
    """The language a label names in any notation (``hi_IN``, ``HIN``, ``hi-Latn``); null if it names none of ours."""
    head = F.regexp_extract(F.lower(F.trim(column)), r"^([^\s_\-.(]+)", 1)
    out = F.lit(None).cast("string")
    for lang, names in NOTATIONS.items():
        out = F.when(head.isin(*names), lang).otherwise(out)
    return out


class LanguageModel:
    """Models of all languages with what was calibrated on held-out samples; small and picklable."""

    def __init__(self, samples: list[tuple[str, str, str]], fillers=(), order: int = ORDER, languages=LANGUAGES):
        """``samples``: language, script, text."""
        self.languages, self.fillers = tuple(languages), tuple(fillers)
        parser = LineParser(())
        forms = canonical_series(pd.Series([s[2] for s in samples], dtype=object)) if samples else []
        rows = [(lang, script, [c.lower() for t in form.split(" ") if (c := parser.core(t))]) for (lang, script, _), form in zip(samples, forms) if lang in self.languages and form]
        self.kinds = sorted({(lang, script) for lang, script, _ in rows})
        self.kind_language = np.array([self.languages.index(lang) for lang, _ in self.kinds], dtype=int)
        count = lambda part: [KneserNey(Counter(w for k, s, ws in part if (k, s) == kind for w in ws), order) for kind in self.kinds]
        self.models = count(rows)
        self.clip, self.switch, self.temperature, self.reject_below = CLIPS[len(CLIPS) // 2], SWITCHES[len(SWITCHES) // 2], 1.0, -np.inf
        if len(rows) >= 10 * FOLDS and len(self.kinds) >= 2:
            self._calibrate(rows, count)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (rows) in each language (columns), by the better of its scripts; 0 for what has no letter."""
        each = word_scores(self.models, words)
        by = np.full((len(words), len(self.languages)), -1e9)
        for j, lang in enumerate(self.kind_language):
            by[:, lang] = np.maximum(by[:, lang], each[:, j])
        wordy = np.array([any(map(str.isalpha, w)) for w in words], dtype=bool)
        return np.where(wordy[:, None], by, 0.0) if len(words) else by

    def _calibrate(self, rows, count) -> None:
        rng = np.random.default_rng(len(rows))
        keep, texts, truth, kinds, windows, own, levels = self.models, [], [], [], [], [], []
        for fold in range(FOLDS):
            self.models = count([r for i, r in enumerate(rows) if i % FOLDS != fold])
            held = [(self.languages.index(lang), words) for lang, _, words in rows[fold::FOLDS] if len(words) >= MIN_RUN]
            made = [_made_up(held, rng) for _ in range(MADE)] if len({k for k, _ in held}) > 1 else []
            flat = [w for words, _ in made for w in words] + [w for _, words in held for w in words]
            by = self.scores(flat)
            sizes = [len(words) for words, _ in made]
            texts += np.split(by[: sum(sizes)], np.cumsum(sizes)[:-1]) if made else []
            truth += [languages for _, languages in made]
            at = sum(sizes)
            for k, words in held:
                part, lengths = by[at : at + len(words)], np.array([len(w) + 1 for w in words])
                at += len(words)
                for i in range(0, len(words) - MIN_RUN + 1, 2):
                    run = part[i : i + MIN_RUN]
                    windows.append(run)
                    own.append(k)
                    levels.append(run[:, k].sum() / lengths[i : i + MIN_RUN].sum())
        self.models = keep
        if not texts or not windows:
            return
        ends, every = np.cumsum([len(x) for x in texts]), np.concatenate(texts)
        wrong: dict[tuple[float, float], tuple[float, int, int]] = {}
        for clip in CLIPS:
            emissions = limited(every, clip)
            for switch in SWITCHES:
                path = best_paths(emissions, ends, switch)
                found = [decided(path[a:b], every[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
                missed = np.array([{k for k, a, b in f if b - a >= MIN_RUN} != t for f, t in zip(found, truth)])
                mixed = np.array([len(t) > 1 for t in truth])
                wrong[clip, switch] = (1 - MIXED) * missed[~mixed].mean() + MIXED * missed[mixed].mean(), int(missed[~mixed].sum()), int(missed[mixed].sum())
        least, pure, mixed = min(wrong.values())
        bound = least + ((1 - MIXED) * (pure + 1) ** 0.5 + MIXED * (mixed + 1) ** 0.5) / (len(truth) / 2)
        # of the choices within a standard error of the best, the one most reluctant to change the language
        self.clip, self.switch = max((c for c, w in wrong.items() if w[0] <= bound), key=lambda c: (c[1], -c[0]))
        z, t = np.array([limited(w, self.clip).sum(axis=0) for w in windows]), np.array(own)

        def loss(temperature: float) -> float:
            x = z / temperature
            return float(-(x[np.arange(len(t)), t] - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1)) - x.max(1)).mean())

        self.temperature = min((0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0), key=loss)
        random = -np.log(keep[0].alphabet)  # characters without any language
        self.reject_below = float(np.quantile(levels, REJECTED, method="lower") + random) / 2


def _made_up(held: list[tuple[int, list[str]]], rng: np.random.Generator) -> tuple[list[str], set[int]]:
    """A segment put together from held-out sentences, and the languages it has runs of at least ``MIN_RUN`` words of."""
    pick = lambda ok: held[rng.choice([i for i, h in enumerate(held) if ok(h[0])])]
    k, words = held[rng.integers(len(held))]
    j, other = pick(lambda x: x != k)
    words, other, kind = list(words), list(other), rng.integers(4)
    spot = int(rng.integers(len(words)))
    words[spot] = _misspelt(words[spot], rng)
    if kind == 0:  # one language, one borrowed word
        words.insert(int(rng.integers(len(words) + 1)), str(rng.choice(other)))
        return words, {k}
    if kind == 1:  # one after the other
        return words + other, {k, j}
    if kind == 2:  # a run in the middle, with a borrowed word in it
        run = other[: int(rng.integers(MIN_RUN, len(other) + 1))]
        run.insert(int(rng.integers(1, len(run))), str(rng.choice(words)))
        return words + run + pick(lambda x: x == k)[1], {k, j}
    return words + other[: int(rng.integers(1, 3))] + pick(lambda x: x == k)[1], {k}  # a word or two of another language


def _misspelt(word: str, rng: np.random.Generator) -> str:
    if len(word) < 3:
        return word
    i = int(rng.integers(1, len(word) - 1))
    return word[:i] + word[i + 1] + word[i] + word[i + 2 :] if rng.random() < 0.5 else word[:i] + word[i + 1 :]


def limited(by: np.ndarray, clip: float) -> np.ndarray:
    """How far each language is below the best one, word by word, at most ``clip``."""
    return np.maximum(by - by.max(axis=1, keepdims=True), -clip) if len(by) else by


def best_paths(emissions: np.ndarray, ends: np.ndarray, switch: float) -> np.ndarray:
    """The language of each word on the best path of its segment; all segments advance together, word by word."""
    n, langs = len(ends), emissions.shape[1]
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    path = np.zeros(len(emissions), dtype=np.int8)
    if not len(emissions):
        return path
    back = np.zeros((len(emissions), langs), dtype=np.int8)
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    level = np.zeros((n, langs))
    own = np.arange(langs, dtype=np.int8)
    for step, m in enumerate(alive):
        at = starts[:m] + step
        if step:
            prev = level[:m]
            top = prev.argmax(axis=1)
            jump = prev[np.arange(m), top] - switch
            stay = prev >= jump[:, None]
            back[at] = np.where(stay, own, top[:, None])
            level[:m] = np.where(stay, prev, jump[:, None])
        level[:m] += emissions[at]
    state = level.argmax(axis=1).astype(np.int8)
    for step in range(len(alive) - 1, -1, -1):
        m = alive[step]
        at = starts[:m] + step
        path[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return path


def _stretches(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(language, first word, end) of each stretch; short ones join the longer neighbour."""
    cut = np.flatnonzero(np.diff(path)) + 1
    runs = [[int(path[a]), int(a), int(b)] for a, b in zip([0, *cut], [*cut, len(path)])]
    while len(runs) > 1:
        short = min(range(len(runs)), key=lambda i: (runs[i][2] - runs[i][1], i))
        if runs[short][2] - runs[short][1] >= MIN_RUN:
            break
        near = [i for i in (short - 1, short + 1) if 0 <= i < len(runs)]
        runs[short][0] = runs[max(near, key=lambda i: runs[i][2] - runs[i][1])][0]
        merged: list[list[int]] = []
        for r in runs:
            if merged and merged[-1][0] == r[0]:
                merged[-1][2] = r[2]
            else:
                merged.append(r)
        runs = merged
    return [tuple(r) for r in runs]


def decided(path: np.ndarray, by: np.ndarray) -> list[tuple[int, int, int]]:
    """The stretches of a path, each with the language of lowest cross-entropy; neighbours that get the same one are one."""
    out: list[tuple[int, int, int]] = []
    for _, a, b in _stretches(path):
        lang = int(by[a:b].sum(axis=0).argmax())
        if out and out[-1][0] == lang:
            out[-1] = (lang, out[-1][1], b)
        else:
            out.append((lang, a, b))
    return out


class Labeller:
    """Labels batches of texts; remembers the scores of words, within a bound."""

    def __init__(self, model: LanguageModel, memory: int = 300_000):
        self.model, self.memory, self.parser = model, memory, LineParser(model.fillers)
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.by = np.zeros((0, len(self.model.languages)))

    def words(self, forms) -> list[list[str]]:
        core = self.parser.core
        return [[core(t) for _, tokens in self.parser.pieces(f) for t in tokens] if f else [] for f in forms]

    def label(self, texts: pd.Series) -> list[list[dict]]:
        """For each text its stretches: language, confidence, first word, number of words."""
        said = self.words(canonical_series(texts))
        flat = [w for ws in said for w in ws]
        if not flat:
            return [[] for _ in said]
        new = [w for w in dict.fromkeys(flat) if w not in self.at]
        if new:
            if len(self.at) + len(new) > self.memory:
                self._clear()
                new = list(dict.fromkeys(flat))
            by = self.model.scores([w.lower() for w in new])
            self.at.update(zip(new, range(len(self.by), len(self.by) + len(new))))
            self.by = np.concatenate([self.by, by])
        by = self.by[np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))]
        em = limited(by, self.model.clip)
        chars = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        ends = np.cumsum([len(ws) for ws in said])
        path = best_paths(em, ends, self.model.switch)
        starts = np.concatenate([[0], ends[:-1]])
        change = np.concatenate([[0], np.cumsum(path[1:] != path[:-1])])
        level = np.concatenate([np.zeros((1, by.shape[1])), np.cumsum(by, axis=0)])
        whole = (level[ends] - level[starts]).argmax(axis=1).tolist()
        spans: list[tuple[int, int, int, int]] = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
            if b > a:
                if change[a] == change[b - 1]:
                    spans.append((i, whole[i], a, b))
                else:
                    spans += [(i, lang, a + x, a + y) for lang, x, y in decided(path[a:b], by[a:b])]
        s = np.array(spans)
        total = np.concatenate([np.zeros((1, em.shape[1])), np.cumsum(em, axis=0)])
        z = (total[s[:, 3]] - total[s[:, 2]]) / self.model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        size = np.concatenate([[0], np.cumsum(chars)])
        each = np.arange(len(s))
        mean = (level[s[:, 3], s[:, 1]] - level[s[:, 2], s[:, 1]]) / (size[s[:, 3]] - size[s[:, 2]])
        sure = p[each, s[:, 1]]
        out: list[list[dict]] = [[] for _ in said]
        for (i, lang, a, b), c, m in zip(spans, sure.tolist(), mean.tolist()):
            known = m >= self.model.reject_below
            out[i].append({"lang": self.model.languages[lang] if known else "und", "confidence": c if known else 0.0, "first_word": a - int(starts[i]), "words": b - a})
        return out


_STRETCH = "array<struct<lang:string,confidence:double,first_word:int,words:int>>"


def fit(spark: SparkSession, sf_dir: str, max_samples: int = MAX_SAMPLES) -> LanguageModel:
    """The model fitted on the small fixed table ``lang_samples``; more than ``max_samples`` rows of a language and script are an error."""
    samples = spark.read.parquet(f"{sf_dir}/lang_samples.parquet").select("sample_id", "lang", "script", "text").where(F.col("text").isNotNull() & F.col("lang").isin(*LANGUAGES))
    most = samples.groupBy("lang", "script").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if most > max_samples:
        raise ValueError(f"more than {max_samples} samples of a language and script")
    rows = samples.orderBy("sample_id").collect()
    return LanguageModel([(r.lang, r.script, r.text) for r in rows], filler_terms(spark.read.parquet(f"{sf_dir}/filler_terms.parquet")))


def stretches(segments: DataFrame, model: LanguageModel) -> DataFrame:
    """``seg_id, label, stretches`` of each segment; a null, empty or wordless text has no stretch.

    ``segments``: ``seg_id, lang, text``; other columns are ignored. Rows that come
    again are labelled again. A text of any length is read whole.
    """
    ship_package(segments.sparkSession)
    shared = segments.sparkSession.sparkContext.broadcast(model)  # a few MB, from a table of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"seg_id": pdf["seg_id"], "label": pdf["label"], "stretches": labeller.label(pdf["text"])})

    return spread(segments.select("seg_id", label_column(F.col("lang")).alias("label"), "text")).mapInPandas(run, f"seg_id bigint, label string, stretches {_STRETCH}")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/rid_transcription.parquet").select("seg_id", "lang", "text")


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per stretch of one language."""
    return stretches(_read(spark, sf_dir), fit(spark, sf_dir)).select("seg_id", F.posexplode("stretches").alias("stretch", "s")).select("seg_id", "stretch", "s.*")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment: its main language (that of most words) with a confidence, and all languages of its stretches."""
    s = F.col("stretches")
    main = F.array_max(F.transform(s, lambda x: F.struct(x["words"], x["confidence"], x["lang"])))
    return stretches(_read(spark, sf_dir), fit(spark, sf_dir)).select(
        "seg_id", "label", F.coalesce(main["lang"], F.lit("und")).alias("lang"), F.coalesce(main["confidence"], F.lit(0.0)).alias("confidence"),
        F.array_join(F.array_sort(F.array_distinct(s["lang"])), ",").alias("langs"), F.coalesce(F.aggregate(s, F.lit(0), lambda a, x: a + x["words"]), F.lit(0)).alias("words"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = stretches(_read(spark, sf_dir), fit(spark, sf_dir))
    runs = F.filter("stretches", lambda x: (x["words"] >= MIN_RUN) & (x["lang"] != "und"))
    langs = F.array_distinct(runs["lang"])
    return (
        labelled.select("seg_id", "label", langs.alias("langs"))
        .where((F.size("langs") >= 2) | ((F.size("langs") == 1) & ~F.col("label").eqNullSafe(F.element_at("langs", 1))))
        .select("seg_id", F.explode("langs").alias("lang"))
    )


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments, "p5_stretches": p5_stretches}
