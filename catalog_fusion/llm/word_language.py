"""Language identification by a linear-chain conditional random field over words.

Each word has features (the word itself, as a lexicon; prefixes and suffixes; character
n-grams) whose learned weights give it a potential for each language, and learned
transitions tie neighbours. Forward-backward gives every word of a text, which may
switch languages, its posterior; a document's language is the one with most of it.

The field is fitted by gradient ascent on a bounded sample of labelled documents, cut
into segments that are strung together across languages, so that the transitions see
switches. Long texts are read in blocks that overlap by ``CONTEXT`` words on both
sides, so that memory is bounded and every word is labelled with its neighbourhood.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalog_fusion.llm.tables import bound_batches, result_schema, runs_of, whole_text

UNDETERMINED = "und"
#: Words of a block that are labelled, and those read before and behind them.
BLOCK, CONTEXT = 192, 32
#: Blocks in one lock step, and words whose potentials a worker keeps.
_ROWS, _REMEMBERED = 1024, 150_000
#: Letters of a word. A longer run, as in scripts without spaces, is read in pieces of the chain.
LONGEST = 40
_WORD = regex.compile(rf"\p{{L}}{{1,{LONGEST}}}")
_BITS = 21  # of a code point


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and of the fit."""

    documents: int = 400  # of each language
    words: int = 400  # of each document, spread over it
    features: int = 150_000
    steps: int = 240
    batch: int = 64
    length: int = 64
    segment: int = 16  # mean words before a switch
    rate: float = 0.08
    decay: float = 2e-4
    seed: int = 11


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> set[str]:
    """Lexicon entry, affixes and character n-grams."""
    edged = f"^{word}$"
    out = {"=" + word}
    out.update("<" + word[:n] for n in (1, 2, 3) if n <= len(word))
    out.update(">" + word[-n:] for n in (1, 2, 3, 4) if n <= len(word))
    out.update(edged[i : i + n] for n in (2, 3) for i in range(len(edged) - n + 1))
    return out


def _packed(points: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Runs of up to three code points as one number each; no two runs share one."""
    return sum(points[first + j] << (_BITS * j) for j in range(size))


class _Features:
    """The numbers of kept features, to look up those of many words at once."""

    def __init__(self, index: dict[str, int]):
        # The whole word and its last four letters are looked up as text, all else by its code points.
        self.words = {f[1:]: i for f, i in index.items() if f[0] == "=" and len(f) > 1}
        self.ends = {f[1:]: i for f, i in index.items() if f[0] == ">" and len(f) == 5}
        self.none = len(index)
        short = {"<": [], ">": [], "": []}
        for f, i in index.items():
            if f[0] in "<>" and len(f) <= 4:
                short[f[0]].append((f[1:], i))
            elif f[0] not in "=<>":
                short[""].append((f, i))
        self.tables = {kind: self._table(entries) for kind, entries in short.items()}

    @staticmethod
    def _table(entries: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array([sum(ord(c) << (_BITS * j) for j, c in enumerate(f)) for f, _ in entries], np.int64)
        order = np.argsort(keys)
        return keys[order], np.array([i for _, i in entries], np.int64)[order]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words and their kept features, each pair once."""
        points = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lengths + 2) - lengths - 1  # letter of each word
        owner = np.repeat(np.arange(len(words)), lengths + 2)
        found = []

        def look_up(kind: str, places: np.ndarray, keys: np.ndarray) -> None:
            known, ids = self.tables[kind]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                found.append(places[hit] * (self.none + 1) + ids[at[hit]])

        for n in (2, 3):
            inside = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
            look_up("", owner[inside], _packed(points, inside, n))
        for n in (1, 2, 3):
            long = np.flatnonzero(lengths >= n)
            look_up("<", long, _packed(points, first[long], n))
            look_up(">", long, _packed(points, first[long] + lengths[long] - n, n))
        for known, texts in ((self.words, words), (self.ends, [w[-4:] if len(w) >= 4 else "" for w in words])):
            ids = np.fromiter((known.get(t, self.none) for t in texts), np.int64, len(words))
            hit = np.flatnonzero(ids < self.none)
            found.append(hit * (self.none + 1) + ids[hit])
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        return pairs // (self.none + 1), pairs % (self.none + 1)


def forward_backward(
    potentials: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors ``[time, row, language]`` of rows sorted by falling length, and of the moves summed.

    ``potentials`` has the same shape; ``start`` and ``moves`` are factors, not logs.
    """
    steps, rows, _ = potentials.shape
    active = [int(np.searchsorted(-lengths, -t)) for t in range(steps)]  # rows longer than t
    alpha = np.zeros_like(potentials)
    for t in range(steps):
        n = active[t]
        ahead = potentials[t, :n] * (start if t == 0 else alpha[t - 1, :n] @ moves)
        alpha[t, :n] = ahead / ahead.sum(1, keepdims=True)
    beta = np.ones((rows, len(start)), potentials.dtype)
    moved = np.zeros_like(moves)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        behind = potentials[t, :n] * beta[:n]
        if t:
            joint = (alpha[t - 1, :n] @ moves * behind).sum(1, keepdims=True)
            moved += moves * (alpha[t - 1, :n].T @ (behind / joint))
        both = alpha[t, :n] * beta[:n]
        alpha[t, :n] = both / both.sum(1, keepdims=True)
        before = behind @ moves.T
        beta[:n] = before / before.sum(1, keepdims=True)
    return alpha, moved


@dataclass
class LanguageField:
    """A fitted field."""

    languages: list[str]
    index: dict[str, int]
    weights: np.ndarray  # the last row, of unknown features, is 0
    start: np.ndarray  # logs
    moves: np.ndarray  # logs
    memory: dict[str, int] = field(default_factory=dict, repr=False)  # places in ``factors``
    factors: np.ndarray | None = field(default=None, repr=False)
    features: _Features | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": {}, "factors": None, "features": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum of the weights of each word's features, ``[word, language]``."""
        if self.features is None:
            self.features = _Features(self.index)
        at, feature = self.features.of(words)
        weights = self.weights[feature]
        return np.stack([np.bincount(at, weights[:, j], len(words)) for j in range(len(self.languages))], 1)

    def _potentials(self, words: list[str]) -> np.ndarray:
        """A row for each word: factors of the languages, the greatest 1."""
        known = self.memory
        new = list(set(words).difference(known))
        if self.factors is None or len(known) + len(new) > len(self.factors):
            known.clear()
            new = list(set(words))
            self.factors = np.empty((max(_REMEMBERED, len(new)), len(self.languages)), np.float32)
        if new:
            scores = self.scores(new)
            self.factors[len(known) : len(known) + len(new)] = np.exp(np.maximum(scores - scores.max(1, keepdims=True), -30))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return self.factors[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Summed posteriors of the words of each text, ``[text, language]``."""
        out = np.zeros((len(texts), len(self.languages)))
        blocks = []  # (text, first word read, last, first counted, last)
        for i, words in enumerate(texts):
            for low in range(0, len(words), BLOCK):
                high = min(low + BLOCK, len(words))
                blocks.append((i, max(0, low - CONTEXT), min(len(words), high + CONTEXT), low, high))
        blocks.sort(key=lambda b: b[1] - b[2])
        start, moves = np.exp(self.start).astype(np.float32), np.exp(self.moves).astype(np.float32)
        for at in range(0, len(blocks), _ROWS):
            rows = blocks[at : at + _ROWS]
            lengths = np.array([b[2] - b[1] for b in rows])
            read = self._potentials([w for b in rows for w in texts[b[0]][b[1] : b[2]]])
            row = np.repeat(np.arange(len(rows)), lengths)
            time = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            potentials = np.ones((lengths[0], len(rows), len(self.languages)), np.float32)
            potentials[time, row] = read
            share, _ = forward_backward(potentials, lengths, start, moves)
            first = np.array([b[3] - b[1] for b in rows])
            last = np.array([b[4] - b[1] for b in rows])
            counted = (time >= first[row]) & (time < last[row])
            owner, held = np.array([b[0] for b in rows])[row[counted]], share[time[counted], row[counted]]
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(owner, held[:, j], len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and its share of the words' posteriors; undetermined without letters."""
        runs = runs_of(map(len, texts))
        none = np.zeros((0, len(self.languages)))
        sums = np.concatenate([none, *(self.posteriors([words_of(t) for t in texts[a:b]]) for a, b in runs)])
        total = sums.sum(1)
        best = sums.argmax(1)
        names = [self.languages[b] if n > 0 else UNDETERMINED for b, n in zip(best, total, strict=True)]
        shares = np.divide(sums.max(1), total, out=np.zeros(len(total)), where=total > 0)
        return names, np.clip(shares, 0.0, 1.0).tolist()


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model is fitted to."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_labelled(documents: DataFrame, training: Training, key: str = "doc_id") -> list[tuple[str, str]]:
    """``(lang, text)`` of up to ``training.documents`` rows of each language, by a hash of the key.

    A rate from the languages' counts thins the rows before they are ranked, so that
    what is shuffled is bounded as well. Of a text only the up to ``training.words`` words
    that the fit reads reach the driver.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(_spread(words_of(t), training.words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["lang", "text"])

    labelled = documents.where("text is not null and lang is not null").select(
        F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col(key), "text").alias("draw"), "text"
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sorted(counts.items()):
        rate = min(1.0, 3 * training.documents / n + 200 / n)
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod("draw", F.lit(1 << 30)) < int(rate * (1 << 30)) + 1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    rows = labelled.where(chosen).withColumn("rank", rank).where(F.col("rank") <= training.documents)
    bound_batches(documents.sparkSession)
    return sorted((r["lang"], r["text"]) for r in rows.select("lang", "text").mapInArrow(cut, "lang string, text string").collect())


def _spread(words: list[str], most: int) -> list[str]:
    """Up to ``most`` words in runs of 40 from all over the list."""
    if len(words) <= most:
        return words
    runs = max(1, most // 40)
    return [w for r in range(runs) for w in words[r * len(words) // runs :][:40]]


def fit_language_field(labelled: list[tuple[str, str]], training: Training = Training()) -> LanguageField:
    """Fit the field to ``(lang, text)``. With one language, or none, it always says that one."""
    streams: dict[str, list[str]] = {}
    for lang, text in labelled:
        streams.setdefault(lang, []).extend(_spread(words_of(text), training.words))
    languages = sorted(lang for lang, words in streams.items() if words)
    if not languages:
        return LanguageField([UNDETERMINED], {}, np.zeros((1, 1), np.float32), np.zeros(1), np.zeros((1, 1)))
    # Features are made again for each use, so that only their counts are held.
    times = Counter(w for lang in languages for w in streams[lang])
    seen: Counter[str] = Counter()
    for w, n in times.items():
        for f in features_of(w):
            seen[f] += n
    often = sorted((-n, f) for f, n in seen.items() if n > 1)
    del seen
    index = {f: i for i, (_, f) in enumerate(often[: training.features])}
    # The last row stands for no feature and keeps the weight 0.
    k, none = len(languages), len(index)
    number = {w: i for i, w in enumerate(times)}
    at, feature = _Features(index).of(list(times))
    first = np.searchsorted(at, np.arange(len(times)))
    place = np.arange(len(at)) - first[at]
    width = int(place.max(initial=0)) + 1
    table = np.full((len(times), width), none, np.int32)
    table[at, place] = feature
    coded = [np.array([number[w] for w in streams[lang]]) for lang in languages]
    rng = np.random.default_rng(training.seed)
    params = [np.zeros((none + 1, k)), np.zeros(k), np.zeros((k, k))]
    means = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    lengths = np.full(training.batch, training.length)
    for step in range(1, training.steps + 1):
        words = np.empty((training.length, training.batch), np.int64)
        truth = np.empty_like(words)
        for b in range(training.batch):
            t = 0
            while t < training.length:
                lang = rng.integers(k)
                n = min(training.length - t, 2 + int(rng.geometric(1 / training.segment)))
                at = rng.integers(max(1, len(coded[lang]) - n))
                piece = coded[lang][at : at + n]
                words[t : t + len(piece), b], truth[t : t + len(piece), b] = piece, lang
                t += len(piece)
        ids = table[words]
        scores = params[0][ids].sum(2)
        potentials = np.exp(scores - scores.max(2, keepdims=True))
        share, moved = forward_backward(potentials, lengths, np.exp(params[1]), np.exp(params[2]))
        error = np.eye(k)[truth] - share
        flat = ids.reshape(-1)
        spread = np.repeat(error.reshape(-1, k), width, 0)
        slope = np.stack([np.bincount(flat, spread[:, j], none + 1) for j in range(k)], 1)
        slope[none] = 0
        seen_moves = np.zeros((k, k))
        np.add.at(seen_moves, (truth[:-1].ravel(), truth[1:].ravel()), 1)
        scale = training.batch * training.length
        slopes = [slope / scale - training.decay * params[0], error[0].sum(0) / training.batch, (seen_moves - moved) / scale]
        for p, g, m, v in zip(params, slopes, means, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += training.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LanguageField(languages, index, params[0].astype(np.float32), params[1], params[2])


def identify_languages(documents: DataFrame, model: LanguageField, key: str | Column = "doc_id") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, from its whole text only.

    ``key`` is a column's name, or any expression, then named ``key``. Null texts and texts
    without letters are ``und`` with score 0. Repeated rows get a prediction each; an
    empty table gives no rows. Other columns are not read. Letters that no training text had
    say nothing, so a text of them alone gets the likeliest language of the start.
    """
    bound_batches(documents.sparkSession)
    value = documents[key] if isinstance(key, str) else key
    source = documents.select(value.alias("key"), whole_text().alias("text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(1).to_pylist())
            arrays = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "lang_pred", "score"])

    judged = source.mapInArrow(predict, result_schema(source, "lang_pred string, score double"))
    return judged.withColumnRenamed("key", key) if isinstance(key, str) else judged
