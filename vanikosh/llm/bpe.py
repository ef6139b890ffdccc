"""Encoding of documents with a public byte-level BPE tokenizer (problem 6).

Speculate and verify: the distinct words of a batch are cut greedily into the
longest known tokens, all at once on a trie in sorted arrays; an array test then
asks of every adjacent pair whether the merges could have left it unmerged. A
sequence all of whose pairs pass is the encoding; only words with a failing pair
are merged exactly. Encodings of words are remembered, within a bound.

The tokenizer's file is read on the driver; the executors get its arrays.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from vanikosh.llm.tokentable import portions
from vanikosh.operators.stage import spread
from vanikosh.session import ship_package

# --- fixed values: the public pattern of the words, with white space spelled out ------

_WHITE = r"\t-\r \x85\xa0" + "".join("\\u%04x" % c for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
WORDS = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"

_NEVER = 1 << 30
#: Tokens after which a long word is no longer read together with the others.
STEPS = 64


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary as arrays; picklable and of a size that depends on the vocabulary only."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # when a token comes into being; -1: a byte
        pairs, ids = [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            self.left[made], self.right[made], self.rank[made] = vocab[a], vocab[b], rank
            pairs.append(vocab[a] << 32 | vocab[b])
            ids.append(made)
        order = np.argsort(pairs)
        self.pairs, self.made = np.array(pairs, np.int64)[order], np.array(ids, np.int64)[order]
        byte_id = np.zeros(256, np.int64)
        spelled: dict[int, bytes] = {}
        for text, i in vocab.items():
            if all(c in letters for c in text) and (len(text) == 1 or self.left[i] >= 0):
                spelled[i] = bytes(letters[c] for c in text)
                if len(text) == 1:
                    byte_id[letters[text]] = i
        self.byte_id = byte_id
        # a token that its own bytes don't lead to can't be proposed
        whole = np.array([i for i in spelled if self.left[i] >= 0])
        fine = self._compatible(self.left[whole], self.right[whole], self.rank[whole])
        usable = [i for i in spelled if self.left[i] < 0] + whole[fine].tolist()
        self._build_trie({i: spelled[i] for i in usable})

    def _build_trie(self, spelled: dict[int, bytes]) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for i, text in spelled.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token)
                    token.append(-1)
            token[node] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.edges, self.nodes, self.token = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order], np.array(token)

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank at which tokens a and b would merge; a huge number if never."""
        keys = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank[self.made[at]], _NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging leaves tokens a and b side by side (up to rank ``until``).

        Walks back in time: of the two tokens at the border the one made last is
        taken apart, and at every stage the pair must not have merged before that.
        Of equal ranks the merge further left comes first.
        """
        end = np.full(len(a), _NEVER, np.int64) if until is None else until.copy()
        a, b = a.copy(), b.copy()
        end_a, end_b = end.copy(), end.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            merged = self._merge_of(x, y)
            bad = (merged < end_a[live]) & (merged <= end_b[live]) & (merged < _NEVER)
            if until is not None:
                bad &= merged != until[live]
            good[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo_b = ry >= rx
            ib, ia = live[undo_b], live[~undo_b]
            end_b[ib], b[ib] = ry[undo_b], self.left[y[undo_b]]
            end_a[ia], a[ia] = rx[~undo_b], self.right[x[~undo_b]]
        return good

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each place and ends by ``ends``, and where it ends."""
        node, pos = np.zeros(len(at), np.int64), at.copy()
        best, best_end = np.full(len(at), -1, np.int64), at.copy()
        walk = np.arange(len(at))
        while len(walk):
            walk = walk[pos[walk] < ends[walk]]
            keys = node[walk] << 8 | data[pos[walk]]
            i = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            found = self.edges[i] == keys
            walk, i = walk[found], i[found]
            node[walk] = self.nodes[i]
            pos[walk] += 1
            token = self.token[node[walk]]
            hit = token >= 0
            best[walk[hit]], best_end[walk[hit]] = token[hit], pos[walk[hit]]
        return best, best_end

    def _propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest tokens of all words: (word, token) of each, in order.

        All words advance together by one token; what is left of long words after
        ``STEPS`` tokens is tried at every place at once, and its tokens are then followed.
        """
        at, word = starts.copy(), np.arange(len(starts))
        out_word, out_token, out_step = [], [], []
        for step in range(STEPS):
            if not len(word):
                break
            best, best_end = self._longest(data, at, ends[word])
            out_word.append(word)
            out_token.append(best)
            out_step.append(np.full(len(word), step))
            more = best_end < ends[word]
            word, at = word[more], best_end[more]
        for w, begin in zip(word.tolist(), at.tolist()):
            places = np.arange(begin, ends[w])
            best, best_end = self._longest(data, places, np.full(len(places), ends[w]))
            after, i, path = (best_end - begin).tolist(), 0, []
            while i < len(after):
                path.append(i)
                i = after[i]
            out_word.append(np.full(len(path), w))
            out_token.append(best[path])
            out_step.append(STEPS + np.arange(len(path)))
        w, t, s = np.concatenate(out_word), np.concatenate(out_token), np.concatenate(out_step)
        order = np.lexsort((s, w))
        return w[order], t[order]

    @cached_property
    def _made_of(self) -> dict[int, tuple[int, int]]:
        """Rank and result of each pair that merges."""
        return dict(zip(self.pairs.tolist(), zip(self.rank[self.made].tolist(), self.made.tolist())))

    def _merge_exactly(self, text: bytes) -> list[int]:
        """The merges one by one, lowest rank and leftmost first: a heap of pairs over a linked list of tokens, in n log n."""
        first = self.byte_id[np.frombuffer(text, np.uint8)]
        n = len(first)
        rank = self._merge_of(first[:-1], first[1:])
        live = np.flatnonzero(rank < _NEVER)
        heap = np.sort(rank[live] << 32 | live).tolist()  # a sorted list is a heap
        ids, ranks = first.tolist(), [*rank.tolist(), _NEVER]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        made, never, pop, push = self._made_of, (int(_NEVER), -1), heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if ranks[i] != r:
                continue
            j = after[i]
            k = after[j]
            ids[i] = now = made[ids[i] << 32 | ids[j]][1]
            ids[j], ranks[j], after[i] = -1, -1, k
            if k < n:
                before[k] = i
                ranks[i] = new = made.get(now << 32 | ids[k], never)[0]
                if new < _NEVER:
                    push(heap, new << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                ranks[h] = new = made.get(ids[h] << 32 | now, never)[0]
                if new < _NEVER:
                    push(heap, new << 32 | h)
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of all words one after the other, the number of ids of each, and how many words had to be merged exactly."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        word, token = self._propose(data, ends - lengths, ends)
        inside = word[1:] == word[:-1]
        left, right, of = token[:-1][inside], token[1:][inside], word[1:][inside]
        kinds, back = np.unique(left << 32 | right, return_inverse=True)
        failing = np.unique(of[~self._compatible(kinds >> 32, kinds & 0xFFFFFFFF)[back]]) if len(of) else of
        counts = np.bincount(word, minlength=len(raw))
        if not len(failing):
            return token, counts, 0
        parts = np.split(token, np.cumsum(counts)[:-1])
        for i in failing.tolist():
            parts[i] = np.array(self._merge_exactly(raw[i]), np.int64)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts)), len(failing)


class Encoder:
    """Encodes batches of texts, remembering the ids of words up to ``memory`` words."""

    def __init__(self, bpe: ByteBpe, memory: int = 400_000):
        self.bpe, self.memory, self.find = bpe, memory, regex.compile(WORDS).findall
        self.exact = 0
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of the texts in the memory, and the number of words of each text."""
        found = [self.find(t) if t else [] for t in texts]
        new = [w for ws in found for w in set(ws).difference(self.at)]
        new = list(dict.fromkeys(new))
        if new:
            if len(self.at) + len(new) > self.memory:
                self._clear()
                new = list(dict.fromkeys(w for ws in found for w in ws))
            ids, counts, exact = self.bpe.encode_words(new)
            self.exact += exact
            self.at.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])
        get = self.at.__getitem__
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = np.fromiter((get(w) for ws in found for w in ws), np.int64, int(sizes.sum()))
        return places, sizes

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        places, sizes = self._words(texts)
        return _sums(self.counts[places], sizes)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; a null or empty text has none."""
        places, sizes = self._words(texts)
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.starts[places] - (ends - counts), counts)]
        offsets = np.concatenate([[0], np.cumsum(_sums(counts, sizes))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _encoder(bpe: ByteBpe) -> Encoder:
    """The worker process's encoder, whose memory serves all its tasks."""
    if not hasattr(bpe, "_encoder"):
        bpe._encoder = Encoder(bpe)
    return bpe._encoder


def encoded(documents: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``ids``: the token ids of each text as it stands; special tokens in a text are ordinary text.

    A null and an empty text have an empty list, a text of any length is encoded whole, repeated rows are kept.
    """
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ByteBpe(path or default_path()))  # a few MB, fixed by the vocabulary
    rows = spread(documents.select(*keep, text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for part in portions(texts):
                kept = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, encoder.encode(texts[part])], [*keep, "ids"])

    return rows.mapInArrow(run, f"{fields}, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``n_tokens``: the number of tokens of each text, 0 for null and empty ones."""
    ship_package(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(ByteBpe(path or default_path()))
    rows = spread(documents.select(*keep, text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            counts = np.concatenate([encoder.lengths(texts[p]) for p in portions(texts)]) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], [*keep, "n_tokens"])

    return rows.mapInArrow(run, f"{fields}, n_tokens bigint")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p6_ids": p6_ids}
