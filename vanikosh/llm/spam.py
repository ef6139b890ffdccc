"""Keyword-stuffed pages and lists of links, products or tags (problem 8).

Function words are learned: words that are widespread among the documents of a
language, where a document counts by the square of its share of words known from
``lang_samples``, so that lists count for nothing. Every document then gets five
features: its share of function words, the density of its key phrases, the entropy of
its words, its repetition, and its share of links.

Per language, and for all documents together, medians and median absolute deviations
find the core of every feature; over the core, lines in the logarithm of the length
centre the features and lines in the inverse length scale them (a share of few words
is known less well), and the covariance of the core's scores completes a robust
Mahalanobis distance. A document is found if its distance is beyond a quantile of the
chi-square distribution and it lies, seen from the language's centre, more than
half-way in a direction of spam: towards text without function words, towards links,
or towards sentences built around key phrases.

All documents take part in all counts and statistics. Languages are those of
``lang_samples``; a document none of whose words is widespread in any of them is
measured by the statistics of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vanikosh.llm.canon import canonical
from vanikosh.llm.tokentable import TokenTable, portions
from vanikosh.operators.stage import spread, stage
from vanikosh.session import ship_package

FEATURES = ("function", "density", "entropy", "repetition", "links")
#: The least scale of each feature, and its least variance per word: a share of n words is known to within 1 / (2 sqrt n).
LEAST_SCALE = {"function": 0.05, "density": 0.03, "entropy": 0.03, "repetition": 0.05, "links": 0.03}
LEAST_NOISE = {"function": 0.25, "density": 0.25, "entropy": 0.0, "repetition": 0.0, "links": 0.25}
#: Scores beyond this are no part of the core.
CUT = 4.0
#: Quantile 0.99 of the chi-square distribution with five degrees of freedom.
DISTANCE = 15.09
#: A word is widespread in a language if at least this share of the documents has it, two standard errors allowed for.
WIDESPREAD = 0.02
#: Of two words this widespread a pair is no key phrase.
STRONG = 0.2
#: A key phrase is a pair of words in at least this many different surroundings and with this share of all words.
KEY_SURROUNDINGS, KEY_SHARE = 3, 0.02
#: Sentences built around key phrases: the share of words in key phrases, and of the usual share of function words.
STUFFED = (0.7, 0.5)
#: Most rows of each language of ``lang_samples``; more are an error.
MAX_SAMPLES = 20_000
#: Documents' worth of the statistics of all documents that a language's own are mixed with.
PRIOR = 100
#: A word is widespread in at most 50 times as many cases as a document has distinct words; more than this is an error.
MAX_WIDESPREAD = 2_000_000

#: Letters, numbers, and the marks of the scripts around Latin and India.
_IN = "\\w" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x300, 0x36F), (0x900, 0x963), (0x966, 0xDFF)))
_WORD = re.compile(rf"[{_IN}][{_IN}'’-]*")
_LINK = re.compile(
    r"(?:https?://|ftp://|www\.)[^\s)\]>,|;]+|[\w.+-]+@[\w-]+\.[\w.-]+"
    r"|(?<![\w@.-])[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:[a-z]{2,}[/?#:][^\s)\]>,|;]+|(?:com|org|net|info|biz|example|test|invalid)/?(?![\w.-]))",
    re.A,
)


def _parse(token: str) -> tuple[list[str], int]:
    """The words of a token, numbers apart, and the number of links and addresses in it."""
    form, links = canonical(token, "lower"), 0
    if "." in form or "://" in form:
        form, links = _LINK.subn(" ", form)
    return [w for w in _WORD.findall(form) if not w.isnumeric()], links


def sample_words(samples: DataFrame, max_samples: int = MAX_SAMPLES) -> dict[str, tuple[str, float]]:
    """The words that at least two sample sentences of a language have, each with the language in which most have it."""
    rows = samples.where("lang is not null and text is not null").select("sample_id", "lang", "text")
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if most > max_samples:
        raise ValueError(f"more than {max_samples} samples of a language")
    table, seen, size = TokenTable(_parse), {}, {}
    for r in rows.orderBy("sample_id").collect():
        _, words, _ = table.read([r.text])
        size[r.lang] = size.get(r.lang, 0) + 1
        for w in set(words.tolist()):
            seen[r.lang, w] = seen.get((r.lang, w), 0) + 1
    best: dict[str, tuple[str, float]] = {}
    for (lang, w), n in sorted(seen.items()):
        word = table.words[w]
        if n >= 2 and any(map(str.isalpha, word)) and n / size[lang] > best.get(word, ("", 0.0))[1]:
            best[word] = (lang, n / size[lang])
    return best


class _Lexicon:
    """Words of languages, and for each word of a token table its language (-1: none)."""

    def __init__(self, words: dict[str, tuple[str, float]]):
        self.languages = sorted({lang for lang, _ in words.values()})
        number = {lang: i for i, lang in enumerate(self.languages)}
        self.language = {w: number[lang] for w, (lang, _) in words.items()}
        self.strong = frozenset(w for w, (_, share) in words.items() if share >= STRONG)

    def votes(self, of: np.ndarray, language: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the language of most of its words (-1: none), and how many words are of any."""
        if not self.languages:
            return np.full(n, -1), np.zeros(n, np.int64)
        each = np.stack([np.bincount(of[language == i], minlength=n) for i in range(len(self.languages))])
        total = each.sum(axis=0)
        return np.where(total > 0, each.argmax(axis=0), -1), total


def _texts(documents: DataFrame) -> DataFrame:
    return spread(documents.select("doc_id", "text").where("text is not null"))


def widespread_words(documents: DataFrame, seeds: dict[str, tuple[str, float]], share: float = WIDESPREAD) -> dict[str, tuple[str, float]]:
    """The widespread words of all documents: each with the language where it is most so, and its share of the documents there.

    A document belongs to the language of most of its seed words and counts by the square of their share.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(_Lexicon(seeds))  # words of a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, table = shared.value, TokenTable(_parse)
        langs = len(lexicon.languages)
        sums = np.zeros((langs, 0))
        whole = np.zeros(langs)

        def frame() -> pd.DataFrame:
            lang, word = np.nonzero(sums)
            names = [lexicon.languages[i] for i in lang.tolist()]
            return pd.DataFrame({"lang": names + lexicon.languages, "word": [table.words[w] for w in word.tolist()] + [None] * langs, "weight": np.concatenate([sums[lang, word], whole])})

        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                if table.full:
                    yield frame()
                    table.clear()
                    sums, whole = np.zeros((langs, 0)), np.zeros(langs)
                of, words, links = table.read(texts[part])
                n = part.stop - part.start
                sums = np.pad(sums, ((0, 0), (0, len(table.words) - sums.shape[1])))
                language = np.fromiter((lexicon.language.get(w, -1) for w in table.words), np.int64, len(table.words))
                own, known = lexicon.votes(of, language[words], n)
                weight = (known / np.maximum(1, np.bincount(of, minlength=n) + links)) ** 2
                width = max(1, len(table.words))
                pairs = np.unique(of * width + words)
                of, words = pairs // width, pairs % width
                ok = own[of] >= 0
                np.add.at(sums, (own[of[ok]], words[ok]), weight[of[ok]])
                np.add.at(whole, own[own >= 0], weight[own >= 0])
        if langs:
            yield frame()

    counted = _texts(documents).mapInPandas(run, "lang string, word string, weight double").groupBy("lang", "word").agg(F.sum("weight").alias("weight"))
    whole = {r.lang: r.weight for r in counted.where("word is null").collect()}  # a row per language
    total = F.broadcast(spark.createDataFrame(list(whole.items()), "lang string, total double"))
    low = (F.col("weight") - 2 * F.sqrt("weight")) / F.col("total")
    wide = counted.where("word is not null").join(total, "lang").select("lang", "word", low.alias("share")).where(F.col("share") >= share)
    rows = wide.groupBy("word").agg(F.max(F.struct("share", "lang")).alias("m")).limit(MAX_WIDESPREAD + 1).collect()
    if len(rows) > MAX_WIDESPREAD:
        raise ValueError(f"more than {MAX_WIDESPREAD} widespread words")
    return {r.word: (r.m.lang, r.m.share) for r in rows if any(map(str.isalpha, r.word))}


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each comes."""
    return np.unique(keys, return_counts=True)


class Describer:
    """Features of batches of texts."""

    def __init__(self, wide: dict[str, tuple[str, float]], memory: int = 400_000):
        self.lexicon, self.table = _Lexicon(wide), TokenTable(_parse, memory)
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.language, self.strong = np.zeros(0, np.int64), np.zeros(0, bool)

    def describe(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """``language`` (number, -1: none), ``words`` (links count as one) and the features of each text."""
        if self.table.full:
            self._clear()
        of, words, links = self.table.read(texts)
        new = self.table.words[len(self.language) :]
        self.language = np.concatenate([self.language, np.fromiter((self.lexicon.language.get(w, -1) for w in new), np.int64, len(new))])
        self.strong = np.concatenate([self.strong, np.fromiter((w in self.lexicon.strong for w in new), bool, len(new))])
        n, width = len(texts), max(1, len(self.table.words))
        said = np.bincount(of, minlength=n)
        total = np.maximum(1, said + links)
        own, known = self.lexicon.votes(of, self.language[words], n)
        kinds, counts = _runs(of * width + words)
        share = counts / said[kinds // width]
        entropy = np.bincount(kinds // width, -share * np.log(share), n) / np.log(np.maximum(2, said))
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs = (of[inside] * width + words[inside]) * width + words[inside + 1]
        repeated = np.bincount(of[inside], minlength=n) - np.bincount(np.unique(pairs) // (width * width), minlength=n)
        return {
            "language": own, "words": said + links, "function": known / total, "density": self._keyed(of, words, inside, pairs, total, n) / total,
            "entropy": np.where(said > 1, entropy, 1.0), "repetition": repeated / total, "links": links / total,
        }

    def _keyed(self, of, words, inside, pairs, total, n) -> np.ndarray:
        """The number of words of each text that stand in key phrases."""
        a, b = words[inside], words[inside + 1]
        fit = ~(self.strong[a] & self.strong[b])
        at, pair = inside[fit], pairs[fit]
        if not len(at):
            return np.zeros(n, np.int64)
        padded_of, padded = np.concatenate([[-1], of, [-1]]), np.concatenate([[0], words, [0]]) + 1
        before = np.where(padded_of[at] == of[at], padded[at], 0)
        after = np.where(padded_of[at + 3] == of[at], padded[at + 3], 0) if len(of) > 1 else before
        around = before * (len(self.table.words) + 1) + after
        order = np.lexsort((around, pair))
        p, s = pair[order], around[order]
        first = np.concatenate([[True], p[1:] != p[:-1]])
        group = np.cumsum(first) - 1
        fresh = first | np.concatenate([[True], s[1:] != s[:-1]])
        text = of[at[order]][first]
        key = (np.bincount(group, fresh) >= KEY_SURROUNDINGS) & (np.bincount(group) >= KEY_SHARE * total[text])
        hit = at[order][key[group]]
        covered = np.zeros(len(of), bool)
        covered[hit] = covered[hit + 1] = True
        return np.bincount(of[covered], minlength=n)


def features(documents: DataFrame, wide: dict[str, tuple[str, float]]) -> DataFrame:
    """``doc_id, language, words`` and the features of each text; nulls and texts without words or links have no row.

    ``documents``: ``doc_id, text``; other columns are ignored, repeated rows are described again, texts are read whole.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(wide)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        describer = Describer(shared.value)
        names = np.array([*describer.lexicon.languages, "und"], dtype=object)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts):
                got = pd.DataFrame(describer.describe(texts[part]))
                yield got.assign(doc_id=pdf["doc_id"].to_numpy()[part], language=names[got["language"]])[["doc_id", "language", "words", *FEATURES]]

    schema = "doc_id bigint, language string, words bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    return _texts(documents).mapInPandas(run, schema).where("words > 0")


def _per_language(rows, names: list[str]) -> dict[str, np.ndarray]:
    return {r.language: np.array([np.nan if r[c] is None else r[c] for c in names], float) for r in rows}


def _columns(values: dict[str, np.ndarray], names: list[str], spark: SparkSession) -> DataFrame:
    """One row per language, for a broadcast."""
    return F.broadcast(spark.createDataFrame([(k, *map(float, v)) for k, v in values.items()], "language string, " + ", ".join(f"{c} double" for c in names)))


def robust_statistics(described: DataFrame) -> dict[str, dict]:
    """Per language, and for all as ``*``: the lines of centre and variance of every feature, and the inverse covariance of the core's scores.

    All documents take part; what comes to the driver is a row per language. A
    language's statistics are mixed with those of all, which weigh as ``PRIOR``
    documents. No documents give no statistics.
    """
    spark = described.sparkSession
    both = described.withColumn("language", F.explode(F.array("language", F.lit("*"))))  # partial sums leave a row per language
    log, inverse = F.log("words"), 1 / F.col("words")
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    per = lambda prefix: [f"{prefix}_{f}" for f in FEATURES]
    grouped = lambda df, columns: df.groupBy("language").agg(*columns).collect()

    rows = grouped(both, [F.count(F.lit(1)).alias("n"), *[middle(F.col(f)).alias(f"m_{f}") for f in FEATURES]])
    size, middles = {r.language: r.n for r in rows}, _per_language(rows, per("m"))
    if not rows:
        return {}
    near = both.join(_columns(middles, per("m"), spark), "language")
    away = {f: F.abs(F.col(f) - F.col(f"m_{f}")) for f in FEATURES}
    rows = grouped(near, [middle(away[f]).alias(f"s_{f}") for f in FEATURES])
    scales = {k: np.maximum(1.4826 * v, list(LEAST_SCALE.values())) for k, v in _per_language(rows, per("s")).items()}
    near = near.join(_columns(scales, per("s"), spark), "language")
    core = {f: F.when(away[f] <= CUT * F.col(f"s_{f}"), F.col(f)) for f in FEATURES}
    line = lambda y, x: [F.covar_pop(y, x), F.var_pop(F.when(y.isNotNull(), x)), F.avg(y), F.avg(F.when(y.isNotNull(), x))]
    names = [f"{c}_{f}" for f in FEATURES for c in ("cov", "var", "y", "x")]
    lines = lambda ys, x: [c.alias(n) for c, n in zip([c for f in FEATURES for c in line(ys[f], x)], names)]
    fitted = lambda rows: {k: _lines(v.reshape(len(FEATURES), 4)) for k, v in _per_language(rows, names).items()}
    centre = _mixed(fitted(grouped(near, lines(core, log))), size)
    near = near.join(_columns({k: v.ravel() for k, v in centre.items()}, [f"{c}_{f}" for f in FEATURES for c in "ab"], spark), "language")
    rest = {f: F.col(f) - _usual(F.col(f"a_{f}"), F.col(f"b_{f}")) for f in FEATURES}
    square = {f: F.when(core[f].isNotNull(), rest[f] * rest[f]) for f in FEATURES}
    least, noise = np.array(list(LEAST_SCALE.values())) ** 2, np.array(list(LEAST_NOISE.values()))
    spreads = _mixed(fitted(grouped(near, lines(square, inverse))), size)
    spreads = {k: np.stack([np.maximum(v[:, 0], least), np.maximum(v[:, 1], noise)], axis=1) for k, v in spreads.items()}
    near = near.join(_columns({k: v.ravel() for k, v in spreads.items()}, [f"{c}_{f}" for f in FEATURES for c in "uv"], spark), "language")
    z = {f: rest[f] / F.sqrt(F.col(f"u_{f}") + F.col(f"v_{f}") * inverse) for f in FEATURES}
    scored = near.select("language", *[z[f].alias(f"z_{f}") for f in FEATURES]).where(F.greatest(*[F.abs(f"z_{f}") for f in FEATURES]) <= CUT)
    cells = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    rows = grouped(scored, [F.covar_pop(f"z_{FEATURES[i]}", f"z_{FEATURES[j]}").alias(f"c_{i}_{j}") for i, j in cells])
    covariances = {}
    for k, v in _per_language(rows, [f"c_{i}_{j}" for i, j in cells]).items():
        full = np.zeros((len(FEATURES),) * 2)
        for (i, j), c in zip(cells, v):
            full[i, j] = full[j, i] = c
        covariances[k] = full
    covariances = _mixed({k: covariances.get(k, np.eye(len(FEATURES))) for k in size}, size)
    # a variance below 1 comes from a least scale, which it must not undo
    lifted = {k: c + np.diag(np.maximum(0.05, 1 - np.diag(c))) for k, c in covariances.items()}
    return {k: {"centre": centre[k], "spread": spreads[k], "inverse": np.linalg.inv(lifted[k])} for k in size}


def _lines(sums: np.ndarray) -> np.ndarray:
    """Intercept and slope of each feature from covariance, variance of x, and means; level where x doesn't vary."""
    cov, var, y, x = np.nan_to_num(sums).T
    slope = np.where(var > 1e-12, cov / np.maximum(var, 1e-12), 0.0)
    return np.stack([y - slope * x, slope], axis=1)


def _mixed(values: dict[str, np.ndarray], size: dict[str, int]) -> dict[str, np.ndarray]:
    every = values["*"]
    return {k: v if k == "*" else (size[k] * v + PRIOR * every) / (size[k] + PRIOR) for k, v in values.items()}


def _usual(intercept: Column, slope: Column) -> Column:
    """A feature's centre at the document's length; all features are shares."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), intercept + slope * F.log("words")))


def with_distance(described: DataFrame, statistics: dict[str, dict]) -> DataFrame:
    """Adds ``distance`` (squared, by the statistics of the document's language or, if it has none, of all) and ``toward``: how
    far the document lies from the centre in the direction of spam in which it lies farthest; 1 is spam altogether."""
    if not statistics:
        return described.withColumn("distance", F.lit(0.0)).withColumn("toward", F.lit(0.0))
    k = len(FEATURES)
    rows = [(name, s["centre"].ravel().tolist(), s["spread"].ravel().tolist(), s["inverse"].ravel().tolist()) for name, s in statistics.items() if name != "und"]
    small = described.sparkSession.createDataFrame(rows, "of string, centre array<double>, spread array<double>, inverse array<double>")
    named = F.when(F.col("language").isin([r[0] for r in rows]), F.col("language")).otherwise("*")
    joined = described.withColumn("of", named).join(F.broadcast(small), "of")  # a row per language
    usual = [_usual(F.col("centre")[2 * i], F.col("centre")[2 * i + 1]) for i in range(k)]
    joined = joined.withColumn("z", F.array(*[(F.col(f) - usual[i]) / F.sqrt(F.col("spread")[2 * i] + F.col("spread")[2 * i + 1] / F.col("words")) for i, f in enumerate(FEATURES)]))
    z = [F.col("z")[i] for i in range(k)]
    distance = sum((z[i] * z[j] * F.col("inverse")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    lacking = 1 - F.col("function") / F.greatest(usual[0], F.lit(LEAST_SCALE["function"]))
    dense, left = STUFFED
    toward = F.greatest(lacking, F.col("links"), (lacking / (1 - left) + F.col("density") / dense) / 2)
    return joined.select(*described.columns, distance.alias("distance"), toward.alias("toward"))


def scores(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, language, words``, the features, ``distance``, ``toward`` and ``flagged`` of every document that has words."""
    wide = widespread_words(documents, sample_words(samples))
    described = stage(features(documents, wide), "p8-features")
    flagged = (F.col("distance") > DISTANCE) & (F.col("toward") > 0.5)
    return with_distance(described, robust_statistics(described)).withColumn("flagged", flagged)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/lang_samples.parquet")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, distance and direction of every document that has words."""
    return scores(*_tables(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents far out in a direction of spam."""
    return scores(*_tables(spark, sf_dir)).where("flagged").select("doc_id")


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
