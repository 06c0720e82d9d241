"""Periodic runs: stretches of words that repeat themselves at least once, found while the words come in.

For every length B = 1, 2, 4, ... each completed aligned block of B words is a catcher: it waits for its own words to
come again at a distance of 2B to 4B - 1 (for B = 1: 1 to 3). A square of two halves of such a length holds a whole
catcher in its first half, so none escapes. Every appended word completes, for each B, the suffix of B words, which is
compared with the two catchers of that length at such a distance (hashes of blocks are made from the hashes of their
halves). A hit, and a chain of hits of neighbouring catchers at one distance, is extended word by word to both sides;
what is long enough is a run, what still reaches the last word stays open and grows with the words to come. Catchers
whose hit lies inside a known run of a period that divides the distance would only report that run again and are passed
over, so long stretches of one word cost no more than others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common
from newsflow.llm.fill_middle import by_bytes

U64 = np.uint64
MIN_LENGTH = 12  # words; a run also has twice its period at least
LEFT, RIGHT = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
SLICE_BYTES = 2 << 20  # text whose words are appended at once, or one text if it is longer
RUNS = "n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, kept string"


class Catchers:
    """Online search for runs in a growing sequence of numbers."""

    def __init__(self, min_length: int = MIN_LENGTH, max_period: int | None = None):
        """``max_period``: no run can have a longer one, for instance half of the longest text."""
        self.min_length, self.max_period = min_length, max_period
        self.words = np.empty(0, np.int64)
        self.size = 0
        self.levels: list[tuple[int, np.ndarray]] = []  # per B: first position and hashes of the last blocks
        self.found: dict[tuple[int, int], int] = {}  # (start, period) -> end of what is long enough
        self.open: dict[tuple[int, int], int] = {}  # the same for what reaches the last word
        self.cover_end = np.empty(0, np.int64)  # per word: how far a run over it reaches, and its period
        self.cover_period = np.empty(0, np.int64)

    def append(self, words: np.ndarray) -> None:
        """Take the next words, any number at a time."""
        old = self.size
        self._grow(words)
        for (start, q), end in list(self.open.items()):
            del self.open[start, q]
            self._note(start, end + self._forward(end, q), q)
        for level in range(self.size.bit_length()):
            block = 1 << level
            if 3 * block >= self.size or (block > 1 and 2 * block > (self.max_period or self.size)):
                break
            if not self._hash(level, block, old):
                break
            self._catch(level, block, old)

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of all runs of the words so far, by start and period."""
        best: dict[tuple[int, int], int] = {}
        for (start, q), end in self.found.items():
            best[start, end] = min(q, best.get((start, end), q))
        return sorted(((start, end - start, q) for (start, end), q in best.items()), key=lambda r: (r[0], r[2]))

    def _grow(self, words: np.ndarray) -> None:
        need = self.size + len(words)
        if need > len(self.words):
            room = max(need, 2 * len(self.words))
            for name in ("words", "cover_end", "cover_period"):
                held = np.zeros(room, np.int64)
                held[: self.size] = getattr(self, name)[: self.size]
                setattr(self, name, held)
        self.words[self.size : need] = words
        self.size = need

    def _hash(self, level: int, block: int, old: int) -> bool:
        """Hashes of the blocks that the new words complete; of older ones the last 4B stay."""
        first = max(0, old - block + 1)
        last = self.size - block + 1  # blocks start before it
        if level == 0:
            new = common.mix(self.words[first:last].astype(U64) + LEFT)
        else:
            at, half = self.levels[level - 1]
            a, b = half[first - at : last - at], half[first - at + block // 2 : last - at + block // 2]
            new = common.mix(a * LEFT + (b ^ (b >> U64(29))) * RIGHT)
        if level == len(self.levels):
            if first:  # a length met for the first time: its catchers reach back over all words so far
                first, new = 0, self._from_start(level, block, last)
            self.levels.append((0, new))
            return True
        at, held = self.levels[level]
        keep = max(at, (max(0, first - 4 * block) // block) * block)
        self.levels[level] = (keep, np.concatenate([held[keep - at : first - at], new]))
        return last > first

    def _from_start(self, level: int, block: int, last: int) -> np.ndarray:
        out = common.mix(self.words[: self.size].astype(U64) + LEFT)
        for k in range(1, level + 1):
            a, b = out[: self.size - (1 << k) + 1], out[1 << (k - 1) :]
            out = common.mix(a[: len(b)] * LEFT + (b[: len(a)] ^ (b[: len(a)] >> U64(29))) * RIGHT)
        return out[:last]

    def _catch(self, level: int, block: int, old: int) -> None:
        """Compare the suffixes that the new words complete with the catchers two and three blocks back."""
        at, hashes = self.levels[level]
        fresh = max(old - block + 1, 0)
        last = self.size - block + 1
        hits = []
        for back in (1, 2, 3) if block == 1 else (2, 3):
            first = max(fresh, at + back * block)  # the first word whose catcher is still held
            if first >= last:
                continue
            own = first // block
            catchers = hashes[(own - back) * block - at : ((last - 1) // block - back) * block - at + 1 : block]
            same = hashes[first - at : last - at] == np.repeat(catchers, block)[first - own * block : last - own * block]
            t = np.flatnonzero(same) + first
            hits.append(((t // block - back) * block, t))
        if not hits:
            return
        s, t = (np.concatenate(x) for x in zip(*hits))
        q = t - s
        known = (self.cover_end[s] >= t + block) & (q % np.maximum(self.cover_period[s], 1) == 0)
        s, q = s[~known], q[~known]
        if not len(s):
            return
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        cut = np.flatnonzero((np.diff(q) != 0) | (np.diff(s) != block)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]])
        s0, q0, blocks = s[starts], q[starts], ends - starts
        # So many whole blocks lie in the repeated part of any run; fewer are enough at the seams of appended words.
        least = np.maximum(self.min_length - q0, q0)
        enough = blocks >= np.maximum(1, (least - block + 1) // block)
        seam = (s0 + q0 < fresh + 2 * block) | (s0 + q0 + (blocks + 1) * block > self.size)
        for start, q, n in zip(*(x[enough | seam].tolist() for x in (s0, q0, blocks))):
            self._extend(start, start + n * block, q)

    def _extend(self, start: int, end: int, q: int) -> None:
        """The stretches around words start to end whose words come again q later."""
        low = start - self._backward(start, q)
        if (low, q) in self.open or self.found.get((low, q), 0) >= end + q:
            return
        high = end + self._forward(end + q, q)
        differ = np.flatnonzero(self.words[low:high] != self.words[low + q : high + q])
        edges = [low - 1, *(differ + low).tolist(), high]  # no word differs unless two hashes are equal by chance
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                self._note(a + 1, b + q, q)

    def _backward(self, start: int, q: int) -> int:
        """How many words before ``start`` equal those q later."""
        width, gone = 32, 0
        while gone < start:
            low = max(0, start - gone - width)
            a, b = self.words[low : start - gone], self.words[low + q : start - gone + q]
            differ = np.flatnonzero(a != b)
            if len(differ):
                return gone + len(a) - 1 - int(differ[-1])
            gone, width = start - low, width * 4
        return gone

    def _forward(self, end: int, q: int) -> int:
        """How many words from ``end`` on equal those q before."""
        width, gone = 32, 0
        while end + gone < self.size:
            high = min(self.size, end + gone + width)
            differ = np.flatnonzero(self.words[end + gone : high] != self.words[end + gone - q : high - q])
            if len(differ):
                return gone + int(differ[0])
            gone, width = high - end, width * 4
        return gone

    def _note(self, start: int, end: int, q: int) -> None:
        if end == self.size:
            self.open[start, q] = end
        if end - start < max(self.min_length, 2 * q):
            return
        self.found[start, q] = end
        further = self.cover_end[start:end] < end
        self.cover_end[start:end][further] = end
        self.cover_period[start:end][further] = q


def brute_force(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs by trying every period; for tests."""
    best: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = 0
        for i, equal in enumerate(same):
            if not equal:
                if i > start and i + q - start >= max(min_length, 2 * q):
                    best.setdefault((start, i + q), q)
                start = i + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


class Numbers(dict):
    """A number for each different word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def unrolled(ids: np.ndarray, digits: str) -> np.ndarray:
    """Positions of the words of the stated test rule: one document in ten repeats its own words from some place on."""
    n, h = len(ids), zlib.crc32(digits.encode())
    at = np.arange(n)
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, repeat_some: bool = False
) -> DataFrame:
    """(id, n_words, starts, lengths, periods, kept) of every row of ``docs``; other columns are left out.

    Words are what stands between ASCII white space. ``kept`` is the text without the repetitions: of every run the first
    period stays; words joined by one space. ``repeat_some`` first applies the rule of ``unrolled``. A NULL or empty text
    has no words and no runs, a NULL id counts as one without digits, equal rows give equal results, no rows none. A text
    is never cut; one task holds the words of one text, about 150 bytes each. No shuffle.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("digits"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    names = ["id", *(c.split()[0] for c in RUNS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 2, SLICE_BYTES):
            numbers = Numbers()
            texts, stream, edge = [], [], 0
            for digits, text in zip(part.column(1).to_pylist(), part.column(2)):
                words = text.as_buffer().to_pybytes().split()
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if repeat_some:
                    at = unrolled(ids, digits)
                    ids, words = ids[at], [words[i] for i in at.tolist()]
                texts.append((edge, words))
                stream += [ids, np.array([-1 - len(texts)])]  # a number of its own ends each text: no run goes over it
                edge += len(words) + 1
            catchers = Catchers(min_length, max(len(w) for _, w in texts) // 2)
            catchers.append(np.concatenate(stream))
            runs = np.array(catchers.runs(), np.int64).reshape(-1, 3)
            cut = np.searchsorted(runs[:, 0], [*(e for e, _ in texts), edge])
            gone = np.zeros(edge + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            gone = np.cumsum(gone) > 0
            kept = []
            for first, words in texts:
                out = gone[first : first + len(words)]
                kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x] if out.any() else words).decode())
            at = np.repeat([e for e, _ in texts], np.diff(cut))
            lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x)) for x in (runs[:, 0] - at, runs[:, 1], runs[:, 2])]
            columns = [part.column(0), pa.array([len(w) for _, w in texts], pa.int64()), *lists, pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {RUNS}").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Number, longest and checksum of the runs of every document, and the checksum of the text without repetitions."""
    made = find_runs(common.table(spark, sf_dir, "documents"), repeat_some=True)
    runs = F.arrays_zip("starts", "lengths", "periods")
    # The longest run; of equally long ones the first, then the one of the smaller period.
    longest = F.array_max(
        F.transform(runs, lambda r: F.struct(r.lengths.alias("length"), (-r.starts).alias("start"), (-r.periods).alias("period")))
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.starts, r.lengths, r.periods), F.lit("\n")))
    shown = made.select("doc_id", F.size("starts").cast("bigint").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "kept")
    length, period = F.col("top.length"), -F.col("top.period")
    return shown.select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.concat_ws("", "lines"), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
