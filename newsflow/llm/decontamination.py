"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A word is what stands between white space, in lower case and without ASCII punctuation. Two kinds of seeds join documents
and test items. Every run of three consecutive words of an item is one, however many documents hold it. The others are the
item's rarest words, by how often all documents hold them: a score of ``least`` needs ``least`` of the item's words, so of
its rarest ones, taken until ``SEEDS`` more than may be missing are chosen, at least ``SEEDS`` stand in the passage, and the
fewer words a passage shares, the shorter it must be to reach the score (``LEVELS``). So every passage that can reach the score is aligned,
also one without two words in a row. Items under ``SHORT`` words, half of which meet by chance, go by runs alone.

A document that holds seeds is aligned with the item around them; the score is that of the best local alignment, divided
by that of the item with itself. Regions that share too few words with the item to reach the score asked for are not
aligned; equal regions are aligned once.

The test items are read in blocks of at most ``BLOCK_WORDS`` words, so what the tasks get, and the counts of their words
that come back, is bounded; a larger benchmark takes more passes over the documents.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

U64 = np.uint64
GRAM = 3  # words of a run that is a seed
SEEDS = 6  # rare words of an item that a passage must hold
LEVELS = 4  # steps of the number of words in common, each with the length that a passage may have
SHORT = 8  # items of fewer words are found by runs alone
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.5  # score from which a document counts as contaminated
BLOCK_WORDS = 1_000_000
BASE = 0xC2B2AE3D27D4EB4F
TABLE = 1 << 22  # entries of the table that sorts out most runs
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() and not common.SPACE[b] for b in range(256)])


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words."""
    return common.word_hashes((text or "").lower().encode(), PUNCTUATION)


def grams_of(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    return common.mix(common.rolling(words, n, BASE))


class Lookup:
    """Finds which of many hashes are in a small set, and where."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(TABLE, bool)
        self.table[(self.keys & U64(TABLE - 1)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, indexes into ``keys``) of the members."""
        at = np.flatnonzero(self.table[(hashes & U64(TABLE - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        index = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[index] == hashes[at]
        return at[ok], index[ok]


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word-hash arrays: (score, first word, end word) in ``part``.

    Row by row; gaps along the row by a running maximum. Of equal scores the first end is taken.
    """
    n = len(part)
    ramp = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    start = np.arange(n + 1)  # where the alignment that ends here began
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where(part == word, MATCH, MISMATCH)
        up = row + GAP
        new = np.maximum(up, 0)
        origin = np.where(up > 0, start, np.arange(n + 1))
        better = diagonal > new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        origin[1:] = np.where(better, start[:-1], origin[1:])
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        from_ = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row = top - ramp
        start = np.where(row > new, origin[from_], origin)
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(start[end]), end)
    return best


def _joined(item: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Regions in order of (item, low), overlapping ones of an item as one."""
    if not len(item):
        return []
    apart = item * (length + 1)  # regions of two items never touch
    reach = np.maximum.accumulate(high + apart)
    new = np.flatnonzero(np.append(True, (low + apart)[1:] > reach[:-1]))
    ends = reach[np.append(new[1:], len(item)) - 1] - apart[new]
    return list(zip(item[new].tolist(), low[new].tolist(), ends.tolist()))


class Items:
    """A block of test items with their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words, self.bags, grams = [], [], [], []
        for item, text in rows:
            words = words_of(text)
            if len(words):
                self.ids.append(item)
                self.words.append(words)
                self.bags.append(np.unique(words, return_counts=True))
                grams.append(grams_of(words, min(GRAM, len(words))))
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        every = np.concatenate(grams) if grams else np.empty(0, U64)
        self.seeds = Lookup(every)
        # where each seed stands: entries first[k] to first[k + 1] of item and offset
        order = np.argsort(every, kind="stable")
        self.first = np.append(np.searchsorted(every[order], self.seeds.keys), len(every))
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.offset = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)[order]
        self.vocabulary = Lookup(np.concatenate([*self.words, np.empty(0, U64)]))

    def choose(self, counts: np.ndarray, least: float) -> None:
        """Take the rarest words of each item as seeds; ``counts`` are those of the vocabulary in all documents."""
        self.need = np.maximum(1, np.ceil(least * self.sizes - 1e-9)).astype(np.int64)
        self.hits = np.minimum(self.need, SEEDS)
        # with m words in common a passage of that score is at most 3 m - 2 least n words long: the fewer, the shorter
        steps = np.arange(LEVELS + 1)[:, None]
        bounds = self.need + (self.sizes + 1 - self.need) * steps // LEVELS
        reach = np.floor(3 * (bounds[1:] - 1) - MATCH * least * self.sizes + 1e-9).astype(np.int64)
        self.common, self.reach = bounds[:-1], np.where(bounds[1:] > bounds[:-1], np.maximum(reach, 0), 0)
        seeds, items = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for i, words in enumerate(self.words):
            if len(words) < SHORT:
                continue
            often = counts[np.searchsorted(self.vocabulary.keys, words)]
            taken = len(words) - self.need[i] + self.hits[i]
            seeds.append(np.unique(words[np.lexsort((words, often))[:taken]]))
            items.append(np.full(len(seeds[-1]), i))
        every = np.concatenate(seeds)
        order = np.argsort(every, kind="stable")
        self.rare = Lookup(every)
        self.rare_first = np.append(np.searchsorted(every[order], self.rare.keys), len(every))
        self.rare_item = np.concatenate(items)[order]

    def sparse_regions(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end word) where enough rare words of an item, and enough of all its words, stand together."""
        place, key = self.rare(hashes)
        if not len(place):
            return
        held = self.rare_first[key + 1] - self.rare_first[key]
        item = self.rare_item[np.repeat(self.rare_first[key] - np.cumsum(held) + held, held) + np.arange(held.sum())]
        place = np.repeat(place, held)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        kept = []
        for words, reach in zip(self.common, self.reach):
            last = np.arange(len(item)) + (words - self.need + self.hits)[item] - 1
            inside = np.flatnonzero(last < len(item))
            last = last[inside]
            close = (item[last] == item[inside]) & (place[last] - place[inside] < reach[item[inside]])
            kept.append((item[inside[close]], place[inside[close]], place[last[close]]))
        item, begin, end = (np.concatenate(part) for part in zip(*kept))
        if not len(item):
            return
        order = np.lexsort((end, item))
        item, begin, end = item[order], begin[order], end[order]
        widest = self.reach.max(0)[item]
        low, high = np.maximum(0, end - widest + 1), np.minimum(len(hashes), begin + widest)
        for i, low, high in _joined(item, low, high, len(hashes)):
            yield from self._dense(i, low, high, hashes[low:high])

    def _dense(self, item: int, low: int, high: int, part: np.ndarray) -> list[tuple[int, int, int]]:
        """Where ``part``, the words from ``low`` on, holds enough of the item's words near enough to each other.

        A word counts as often as the item holds it, so an occurrence counts for the stretches that begin after the
        one that many before it.
        """
        words, most = self.bags[item]
        at = np.minimum(np.searchsorted(words, part), len(words) - 1)
        place = np.flatnonzero(words[at] == part)
        if len(place) < self.need[item]:
            return []
        word = at[place]
        order = np.argsort(word, kind="stable")
        word, place = word[order], place[order]
        earlier = np.arange(len(word)) - most[word]
        again = (earlier >= 0) & (word[earlier] == word)
        after = np.where(again, place[earlier], -1)
        starts = []
        for least, reach in zip(self.common[:, item], self.reach[:, item]):
            first = np.maximum(after, place - reach) + 1
            edge = np.bincount(first, minlength=len(part) + 1) - np.bincount(place + 1, minlength=len(part) + 1)
            start = np.flatnonzero(np.cumsum(edge[:-1]) >= least)
            starts.append((start, np.minimum(start + reach, len(part))))
        begin, end = (np.concatenate(side) for side in zip(*starts))
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order] + low, end[order] + low
        return _joined(np.full(len(begin), item), begin, end, high)

    def regions(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first word, end word) around the seeds in a text, overlapping ones of an item as one."""
        lengths = np.minimum(GRAM, self.sizes)
        for n in np.unique(lengths):
            place, key = self.seeds(grams_of(hashes, int(n)))
            if not len(place):
                continue
            held = self.first[key + 1] - self.first[key]
            at = np.repeat(self.first[key] - np.cumsum(held) + held, held) + np.arange(held.sum())
            item, start = self.item[at], np.repeat(place, held) - self.offset[at]
            fits = lengths[item] == n
            item, start = item[fits], start[fits]
            slack = 4 + self.sizes[item] // 4
            low = np.maximum(0, start - slack)
            high = np.minimum(len(hashes), start + self.sizes[item] + slack)
            order = np.lexsort((low, item))
            item, low, high = item[order], low[order], high[order]
            yield from _joined(item, low, high, len(hashes))

    def shared(self, item: int, part: np.ndarray) -> int:
        """Words that the item and ``part`` have in common, repeats included: no alignment matches more."""
        words, most = self.bags[item]
        at = np.minimum(np.searchsorted(words, part), len(words) - 1)
        return int(np.minimum(np.bincount(at[words[at] == part], minlength=len(words)), most).sum())

    def matches(self, hashes: np.ndarray, least: float, memory: dict) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, end word) of the best alignment with each item that reaches ``least``."""
        found: dict[int, tuple[int, int, int]] = {}
        for item, low, high in itertools.chain(self.regions(hashes), self.sparse_regions(hashes)):
            if found.get(item, (0,))[0] == MATCH * len(self.words[item]):
                continue  # a whole copy
            part = hashes[low:high]
            if MATCH * self.shared(item, part) < least * MATCH * len(self.words[item]):
                continue
            key = item, part.tobytes()
            if key not in memory:
                if len(memory) > 20_000:
                    memory.clear()
                memory[key] = align(self.words[item], part)
            score, first, end = memory[key]
            if score > found.get(item, (0,))[0]:
                found[item] = score, low + first, low + end
        full = {i: MATCH * len(self.words[i]) for i in found}
        return [(self.ids[i], s / full[i], a, b) for i, (s, a, b) in sorted(found.items()) if s >= least * full[i]]


def blocks_of(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size, streamed to the driver; NULL texts and ids are left out."""
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        rows.append((r.item_id, r.text))
        held += r.text.count(" ") + 1
        if held >= BLOCK_WORDS:
            yield Items(rows)
            rows, held = [], 0
    if rows:
        yield Items(rows)


def word_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """How often all documents hold each word of the items."""
    known = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = known.value
        counts = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            for text in batch["text"]:
                word, n = np.unique(own(words_of(text))[1], return_counts=True)
                counts[word] += n
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"word": seen, "n": counts[seen]})

    found = docs.select("text").mapInPandas(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.vocabulary.keys), np.int64)
    counts[found["word"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, score, first_word, end_word): documents with a passage of a test item, one row for each item.

    ``score`` is 1 for a whole copy; the words first_word to end_word (exclusive) of the document are the passage (parts
    without a letter or digit are no words). NULL
    and empty texts hold nothing. Rows of ``docs`` with a repeated id are rows of their own, as are repeated items.
    Empty tables give no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {docs.schema['id'].dataType.simpleString()}, item_id bigint, score double, first_word int, end_word int"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in blocks_of(benchmark):
        items.choose(word_counts(docs, items), least)
        known = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            own, memory = known.value, {}
            for batch in batches:
                rows = [
                    (doc, *match)
                    for doc, text in zip(batch["id"], batch["text"])
                    for match in own.matches(words_of(text), least, memory)
                ]
                yield pd.DataFrame(rows, columns=["id", "item_id", "score", "first_word", "end_word"])

        out = out.unionAll(docs.mapInPandas(run, schema))
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with a passage of a test item."""
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    rows, back = common.apart(docs, "doc_id", "text")
    keyed = rows.withColumn("_row", F.struct("doc_id", F.xxhash64("text")))
    found = leaks(keyed, common.table(spark, sf_dir, "benchmark"), id_col="_row").select("_row").distinct()
    return keyed.join(found, "_row", "left_anti").select(*back)
