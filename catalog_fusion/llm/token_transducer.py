"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic machines read a text.

The *splitter* reads classes of characters and says where pre-tokens begin. It is small,
so what a chunk of text does to it is a plain map from each state to the state behind
the chunk. Chunks are read in lock step from all states, the maps of neighbours are
composed by a parallel prefix scan, and a second reading from the true states marks the
beginnings. A text is thus counted the same however it is cut.

The *merger* reads the bytes of a pre-token. Each transition carries the number of
tokens that it adds to the count of what was read so far (which is the final count if
the pre-token ends there). A state holds, for each suffix read that can still grow into
a token, the token before it and the count there; that is all that the next byte
depends on, so there are finitely many, and they are compiled when first reached.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame

from catalog_fusion.llm.tables import bound_batches, result_schema, runs_of, whole_text

#: Characters read in one lock step, and the length of its chunks.
SLICE, CHUNK = 1 << 21, 1 << 10
#: Compiled transitions and counted pre-tokens that a worker keeps, and the longest of the latter.
TRANSITIONS, REMEMBERED, LONGEST = 600_000, 300_000, 64

# Classes of characters. The contraction letters have classes of their own.
_LETTER, _NUMBER, _OTHER, _QUOTE, _BLANK, _WHITE, _STMD, _E, _L, _RV, _END = range(11)
# States of the splitter, after what the last character is in. Two of a kind differ in
# whether that character begins a pre-token; of the last four the next one decides.
_START, _WORD, _WORD1, _DIGIT, _DIGIT1, _SIGN, _SIGN1, _QUOTED, _SHORT, _BLANK1, _WHITE1, _HALF_E, _HALF_L, _BLANKS, _WHITES = range(15)
_BEGINS = {_WORD1, _DIGIT1, _SIGN1, _QUOTED, _BLANK1, _WHITE1}
_RUNS = {_LETTER: (_WORD, _WORD1), _NUMBER: (_DIGIT, _DIGIT1), _OTHER: (_SIGN, _SIGN1), _QUOTE: (_SIGN, _QUOTED)}


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether the character before begins a pre-token."""
    white = state in (_BLANK1, _WHITE1, _BLANKS, _WHITES)
    begins = state in _BEGINS
    if state in (_HALF_E, _HALF_L):  # an apostrophe and one letter of two
        if kind == (_E if state == _HALF_E else _L):
            return _SHORT, False
        state, begins = _WORD, True
    if kind == _END:
        return _START, begins
    if kind in (_BLANK, _WHITE):
        if white:  # the run goes on
            return (_BLANKS if kind == _BLANK else _WHITES), begins
        return (_BLANK1 if kind == _BLANK else _WHITE1), begins
    if state in (_BLANKS, _WHITES):  # the last of a run before something stands alone
        begins = True
    if state == _QUOTED:
        if kind in (_STMD, _RV, _L):
            return {_STMD: _SHORT, _RV: _HALF_E, _L: _HALF_L}[kind], begins
        state = _SIGN
    kind = _LETTER if kind in (_STMD, _E, _L, _RV) else kind
    inner, first = _RUNS[kind]
    joined = state in (_BLANK1, _BLANKS)  # one blank goes with what follows
    kind_of = {_WORD: _LETTER, _WORD1: _LETTER, _DIGIT: _NUMBER, _DIGIT1: _NUMBER, _SIGN: _OTHER, _SIGN1: _OTHER}
    joined = joined or kind_of.get(state) == (_OTHER if kind == _QUOTE else kind)
    return (inner if joined else first), begins


_STATES, _KINDS = 15, 11
_NEXT = np.array([[_step(s, k)[0] for k in range(_KINDS)] for s in range(_STATES)], np.uint8)
_MARK = np.array([[_step(s, k)[1] for k in range(_KINDS)] for s in range(_STATES)], bool)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, by its Unicode category."""
    table = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for code in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(code))[0]
        if major == "L":
            table[code] = _LETTER
        elif major == "N":
            table[code] = _NUMBER
        elif major == "Z":
            table[code] = _WHITE
    table[[9, 10, 11, 12, 13, 0x85]] = _WHITE
    table[32] = _BLANK
    for letters, kind in (("'", _QUOTE), ("stmd", _STMD), ("e", _E), ("l", _L), ("rv", _RV)):
        table[[ord(c) for c in letters]] = kind
    return table


def chunk_maps(chunks: np.ndarray) -> np.ndarray:
    """For each row of classes, the state behind it from every state before it."""
    states = np.tile(np.arange(_STATES, dtype=np.uint8), (len(chunks), 1))
    columns = np.ascontiguousarray(chunks.T)
    for i, column in enumerate(columns):
        states = _NEXT[states, column[:, None]]
        if i % 8 == 7 and (states == states[:, :1]).all():  # one state is left for each chunk
            state = states[:, 0]
            for rest in columns[i + 1 :]:
                state = _NEXT[state, rest]
            return np.repeat(state[:, None], _STATES, 1)
    return states


def scan_maps(maps: np.ndarray) -> np.ndarray:
    """Map of each chunk and all before it, by doubling."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def beginnings(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin. ``kinds`` has an end mark behind each text."""
    marks = np.zeros(len(kinds) + 1, bool)
    entry = _START
    for low in range(0, len(kinds), SLICE):
        part = kinds[low : low + SLICE]
        short = -len(part) % chunk
        rows = np.concatenate((part, np.full(short, _END, np.uint8))).reshape(-1, chunk)
        through = scan_maps(chunk_maps(rows))
        state = np.concatenate(([entry], through[:-1, entry])).astype(np.uint8)
        columns = np.ascontiguousarray(rows.T)
        found = np.empty(columns.shape, bool)
        for i, column in enumerate(columns):
            found[i] = _MARK[state, column]
            state = _NEXT[state, column]
            if short and i == chunk - short - 1:
                entry_here = int(state[-1])
        entry = entry_here if short else int(state[-1])
        marks[low : low + len(part)] = found.T.reshape(-1)[: len(part)]
    return np.flatnonzero(marks) - 1  # a character is marked by the next


class MergeMachine:
    """Counting transducer of byte-pair merges.

    ``merges`` are pairs of byte strings, the earliest first. A token is a byte or the
    outcome of a merge, and has the rank of its merge.
    """

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank: dict[bytes, int] = {bytes([b]): b - 256 for b in range(256)}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (left, right) in enumerate(merges):
            if left + right not in self.parts:
                self.parts[left + right] = (left, right)
                self.rank[left + right] = i
        self.merge_rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        # Tokens that come out when their own bytes are merged; no other ever appears.
        tokens = [t for t in self.rank if len(t) == 1 or self.fits(*self.parts[t], whole=t)]
        self.heads = {t[:i] for t in tokens for i in range(1, len(t) + 1)}
        self.tokens = frozenset(tokens)
        self.clear()

    def clear(self) -> None:
        # A state: ((suffix, token before it, count there less the count here), ...),
        # longest suffix first and the empty one, with the last token, last.
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.size = 0
        self._state(((b"", None, 0),))

    def _state(self, key: tuple) -> int:
        number = self.states.get(key)
        if number is None:
            number = self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
        return number

    @functools.lru_cache(maxsize=1 << 18)  # noqa: B019  one machine for each worker
    def fits(self, left: bytes, right: bytes, whole: bytes | None = None) -> bool:
        """Whether the merges leave the two tokens side by side.

        Undone from the later merge on, the pieces that face each other must never have
        a merge that would have come first. With ``whole`` that token's own merge is the
        only one allowed to join them, at the very end.
        """
        edge, limit = (left, right), sys.maxsize
        while True:
            joint = self.merge_rank.get(edge, sys.maxsize)
            if joint < limit and not (edge == (left, right) and whole is not None):
                return False
            a, b = edge
            # The token that was made last is undone; of equal ranks the right one.
            if self.rank[a] > self.rank[b]:
                if a not in self.parts:
                    return True
                limit, edge = self.rank[a], (self.parts[a][1], b)
            else:
                if b not in self.parts:
                    return True
                limit, edge = self.rank[b] + 1, (a, self.parts[b][0])

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The state behind ``byte`` and the tokens that it adds."""
        one = bytes([byte])
        grown = [(suffix + one, before, count) for suffix, before, count in self.keys[state] if suffix + one in self.heads]
        for suffix, before, count in grown:  # the longest that fits is the last token
            if suffix in self.tokens and (before is None or self.fits(before, suffix)):
                last, added = suffix, count + 1
                break
        key = (*((s, b, c - added) for s, b, c in grown), (b"", last, 0))
        step = self.steps[state][byte] = self._state(key), added
        self.size += 1
        return step

    def count(self, data: bytes) -> int:
        state = total = 0
        steps = self.steps
        for byte in data:
            step = steps[state].get(byte)
            if step is None:
                step = self._compile(state, byte)
            state, added = step
            total += added
        if self.size > TRANSITIONS:
            self.clear()
        return total


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenCounter:
    """Counts the tokens of whole texts as the tokenizer file defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec["pre_tokenizer"], spec["model"]
        plain = before == before | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        added = spec["added_tokens"]
        if not plain or spec["normalizer"] or model["type"] != "BPE" or any(odd) or any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        letters = _byte_letters()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.machine = MergeMachine([tuple(bytes(letters[c] for c in side) for side in pair) for pair in pairs])
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.memory: dict[str, int] = {}

    def _count(self, piece: str) -> int:
        found = self.memory.get(piece)
        if found is None:
            found = self.machine.count(piece.encode())
            if len(piece) <= LONGEST:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[piece] = found
        return found

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text. Special strings in a text are one token and cut it."""
        totals, parts, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            totals[i] = len(pieces) - 1
            parts += [p for p in pieces if p]
            owner += [i] * (len(parts) - len(owner))
        if not parts:
            return totals
        lengths = np.array([len(p) for p in parts])
        stops = np.cumsum(lengths + 1) - 1
        codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le"), np.uint32)
        kinds = _classes()[codes]
        kinds[stops] = _END
        starts = beginnings(kinds, chunk)
        # A pre-token ends where the next begins or its part does.
        part = np.searchsorted(stops, starts)
        ends = np.minimum(np.append(starts[1:], len(kinds)), stops[part])
        firsts = stops - lengths
        local = list(zip((starts - firsts[part]).tolist(), (ends - firsts[part]).tolist(), strict=True))
        bounds = np.searchsorted(part, np.arange(len(parts) + 1)).tolist()
        count, known = self._count, self.memory.get
        for p, text in enumerate(parts):
            total = 0
            for a, b in local[bounds[p] : bounds[p + 1]]:
                piece = text[a:b]
                total += known(piece) or count(piece)
            totals[owner[p]] += total
        return totals


@functools.lru_cache(maxsize=4)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` and ``n_tokens`` of every row, by whole text.

    ``tokenizer`` is the path of a byte-level BPE tokenizer file that every executor has.
    Null and empty texts have none of either; repeated rows are counted each. An empty table
    gives no rows, and other columns are not read.
    """
    bound_batches(documents.sparkSession)
    source = documents.select(documents[key].alias("key"), whole_text(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            runs = runs_of(pa.compute.utf8_length(texts).to_pylist())
            counts = pa.array([n for a, b in runs for n in counter.counts(texts[a:b].to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], names=["key", "n_bytes", "n_tokens"])

    return source.mapInArrow(count, result_schema(source, "n_bytes long, n_tokens long")).withColumnRenamed("key", key)
