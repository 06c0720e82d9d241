"""Token ids in files compressed by Re-Pair grammars.

Documents are dealt by ranges of their id, so files in order hold ascending ids, and every task cuts its range into shards of
whole documents. In each shard the frequent pairs of neighbouring ids are replaced by nonterminals, again and again;
pairs never reach over the end of a document. A shard's row holds its rules, the expansion length of every rule and
the remaining symbols; the lengths lead to any token without expanding what stands before it.
"""

from __future__ import annotations

import codecs
import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import common

SHARD_TOKENS = 1 << 20  # a shard is closed after the document that reaches this
SLICE_BYTES = 4 << 20  # text encoded at once, beyond one document
MIN_PAIRS = 24  # times that a pair must stand in a shard to get a rule
ROUND_RULES = 4_096  # rules made in one round
ROUNDS = 6
SLOTS = 18  # bits of the table that sorts out rare pairs
END = 0  # id after every document
SHARD = (
    "part int, block int, doc_ids array<bigint>, doc_tokens array<bigint>, first_rule bigint, n_tokens bigint, "
    "rules binary, lengths binary, symbols binary, doc_symbols binary"
)


# ---- fixed values: how the byte-level pre-tokenizer cuts and spells text ----------------------------
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
SHORT, LONG = [*b"stmd"], [b"re", b"ve", b"ll"]  # what an apostrophe takes with it
RESPELLED = [*range(0x21), *range(0x7F, 0xA1), 0xAD]  # bytes spelled by characters from U+0100 on; others stand for themselves
SPELLED = "".join(chr(0x100 + RESPELLED.index(b) if b in RESPELLED else b) for b in range(0x100))
# -------------------------------------------------------------------------------------------------


class Cuts:
    """Where the byte-level pre-tokenizer cuts texts, for many texts at once.

    It cuts out contractions, runs of letters, of numbers and of other characters, each with one space in front, and white
    space. Which kind a character is, the pre-tokenizer itself tells, once for each character that is met.
    """

    def __init__(self, cut):
        self.cut = cut
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)

    def learn(self, points: np.ndarray) -> None:
        for c in np.unique(points).tolist():
            joins = [k for k, run in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.cut.pre_tokenize_str(run + chr(c))) == 1]
            self.kinds[c] = joins[0] if joins else SPACE

    def of_points(self, points: np.ndarray) -> np.ndarray:
        got = self.kinds[points]
        if (got == UNKNOWN).any():
            self.learn(points[got == UNKNOWN])
            got = self.kinds[points]
        return got

    def of_bytes(self, raw: np.ndarray) -> np.ndarray:
        """The kind of every byte: that of its character."""
        lead = np.flatnonzero(raw >= 0xC0)
        plain = np.full(256, UNKNOWN, np.uint8)
        plain[:0x80] = self.of_points(np.arange(0x80))
        kinds = plain[raw]
        if len(lead):
            b = raw[lead].astype(np.int64)
            width = 2 + (b >= 0xE0) + (b >= 0xF0)
            point = b & (0xFF >> (width + 1))
            for k in range(1, 4):
                more = width > k
                point[more] = (point[more] << 6) | (raw[lead[more] + k] & 0x3F)
            kind = self.of_points(point)
            for k in range(4):
                more = width > k
                kinds[lead[more] + k] = kind[more]
        return kinds

    def starts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The places in the bytes ``raw`` at which pieces start; ``edges``: those at which texts start, and the end."""
        size = len(raw)
        first = np.zeros(size + 3, bool)
        first[edges] = True
        kinds = self.of_bytes(raw)
        cut = first.copy()
        cut[1:size] |= kinds[1:] != kinds[:-1]
        # The last white space before something else is a piece of its own, or stands in front of what follows if it is a space.
        gap = kinds == SPACE
        at = np.flatnonzero(gap[:-1] > gap[1:]) + 1
        at = at[~first[at]]
        last = at - 1
        while (inside := (raw[last] & 0xC0) == 0x80).any():
            last = last - inside
        cut[last] = True
        cut[at] = raw[last] != 0x20
        # Contractions: an apostrophe that starts a piece takes one or two letters; the rest is another piece.
        mark = np.flatnonzero(raw == 0x27)
        mark = mark[cut[mark] & ~first[mark + 1]]
        after = np.append(raw, np.zeros(2, np.uint8))
        one, two = after[mark + 1], after[mark + 2]
        short = np.isin(one, SHORT)
        long = np.any([(one == a) & (two == b) for a, b in LONG], axis=0) & ~first[mark + 2]
        cut[mark[short | long] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[long] + 3] = True
        return np.flatnonzero(cut[:size])


class Pieces(dict):
    """Ids of what the pre-tokenizer cuts out, by the model itself; remembered in two generations."""

    def __init__(self, model):
        super().__init__()
        self.model = model
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= Encoder.KEPT:
            self.old = self.copy()
            self.clear()
        got = self.old.get(piece)
        if got is None:
            spelled, _ = codecs.charmap_decode(piece.encode(), "strict", SPELLED)
            ids = array("I", [t.id for t in self.model.tokenize(spelled)])
            if sys.byteorder == "big":
                ids.byteswap()
            got = ids.tobytes()
        self[piece] = got
        return got


class Encoder:
    """A tokenizers model that encodes many texts at once and remembers the ids of their pieces.

    Texts are cut as the byte-level pre-tokenizer does, equal pieces are brought together, and the model gives the ids of
    each once. Texts that hold added tokens, and those of tokenizers of another kind, are encoded whole.
    """

    KEPT = 700_000  # pieces remembered in each of two generations

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        pre = self.model.pre_tokenizer
        cut = json.loads(pre.__getstate__()) if pre is not None and self.model.normalizer is None else {}
        plain = BYTE_LEVEL.items() <= cut.items() and type(self.model.model).__name__ == "BPE"
        plain = plain and self.model.truncation is None and self.model.padding is None
        self.pieces = Pieces(self.model.model) if plain else None
        self.cuts = Cuts(pre)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, size = int(edges[0]), int(edges[-1] - edges[0])
        if not size:
            return np.empty(0, "<u4"), np.zeros(len(texts), np.int64)
        data, edges = data.slice(low, size), edges - low
        start = self.cuts.starts(np.frombuffer(data, np.uint8), edges)
        offsets = pa.py_buffer(np.append(start, size))
        coded = pa.Array.from_buffers(pa.large_string(), len(start), [None, offsets, data]).dictionary_encode()
        got = [*map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist())]
        ids = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        which = coded.indices.to_numpy()
        n = size[which]
        end = np.cumsum(n)
        shift = (np.cumsum(size) - size)[which] - (end - n)
        out = ids[np.repeat(shift, n) + np.arange(end[-1])]
        return out, np.diff(np.append(0, end)[np.searchsorted(start, edges)])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        whole = np.full(len(texts), self.pieces is None)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        got, n = self.by_pieces(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts) if whole.any() else texts)
        if whole.any():
            rows = np.split(got, np.cumsum(n)[:-1])
            for i in np.flatnonzero(whole).tolist():
                rows[i] = self.ids(texts[i].as_py())
            got, n = np.concatenate(rows), np.array([*map(len, rows)], np.int64)
        return got, n

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a worker, which keeps the pieces that earlier tasks have met."""
    return Encoder(path)


@dataclass
class Grammar:
    """Rules (two symbols each) from symbol ``first`` on, their expansion lengths, and the symbols left."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The tokens of the symbols; where these outnumber the rules, each rule is expanded once and then copied."""
        if len(symbols) > len(self.rules) > 0:
            flat = self.expand(np.arange(self.first, self.first + len(self.rules)))
            start, n = np.cumsum(self.lengths) - self.lengths, self.sizes(symbols)
            out, first = np.repeat(symbols, n), np.cumsum(n) - n
            at = np.flatnonzero(symbols >= self.first)
            shift = np.repeat(start[symbols[at] - self.first] - first[at], n[at])
            place = np.flatnonzero(out >= self.first)
            out[place] = flat[place + shift]
            return out
        while (at := symbols >= self.first).any():
            n = np.where(at, 2, 1)
            out = np.empty(n.sum(), np.int64)
            place = np.cumsum(n) - n
            out[place[~at]] = symbols[~at]
            pair = self.rules[symbols[at] - self.first]
            out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        size = np.ones(len(symbols), np.int64)
        at = symbols >= self.first
        size[at] = self.lengths[symbols[at] - self.first]
        return size

    def slice(self, low: int, high: int) -> np.ndarray:
        """Tokens low to high (exclusive): only symbols that reach into the range are expanded."""
        symbols, edge = self.symbols, np.concatenate([[0], np.cumsum(self.sizes(self.symbols))])
        while True:
            a, b = np.searchsorted(edge, low, "right") - 1, np.searchsorted(edge, high, "left")
            symbols, low, high = symbols[a:b], low - edge[a], high - edge[a]
            if len(symbols) > 2 or not (symbols >= self.first).any():
                break
            symbols = np.concatenate([self.rules[s - self.first] if s >= self.first else [s] for s in symbols])
            edge = np.concatenate([[0], np.cumsum(self.sizes(symbols))])
        return self.expand(symbols)[low:high]


def repair(tokens: np.ndarray, ends: np.ndarray, first: int) -> tuple[Grammar, np.ndarray]:
    """Grammar of a token array and the symbol places at which documents end; ``ends`` marks their last tokens.

    A round counts the pairs in a table, takes the most frequent and replaces them from left to right; new symbols take
    part in the next round.
    """
    symbols, last = tokens.astype(np.uint32), np.flatnonzero(ends)
    rules, lengths = [], []
    made = 0
    none = 1 << SLOTS
    pair_of = np.zeros(none + 1, np.uint64)
    for turn_ in range(ROUNDS):
        if len(symbols) < 2:
            break
        left, right = symbols[:-1], symbols[1:]
        slot = left * np.uint32(0x9E3779B1 ^ (turn_ << 8)) + right * np.uint32(0x85EBCA77)
        slot = (((slot ^ (slot >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SLOTS)).astype(np.intp)
        slot[last[last < len(slot)]] = none
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right
        # One pair stands for each slot of the table; another one in the same slot waits for the next round.
        pair_of[slot] = pairs
        np.putmask(slot, pair_of[slot] != pairs, none)
        count = np.bincount(slot, minlength=none + 1)[:none]
        best = np.flatnonzero(count >= MIN_PAIRS)
        if not len(best):
            break
        best = best[np.argsort(-count[best], kind="stable")[:ROUND_RULES]]
        number = np.full(none + 1, -1, np.int32)
        number[best] = np.arange(len(best), dtype=np.int32)
        rule = number[slot]
        at = np.flatnonzero(rule >= 0)
        rule = rule[at]
        # Of neighbouring places take every second one, from the left.
        run = np.flatnonzero(np.append(True, at[1:] - at[:-1] > 1))
        turn = (at - np.repeat(at[run], np.diff(np.append(run, len(at))))) & 1
        at, rule = at[turn == 0], rule[turn == 0]
        seen = np.bincount(rule, minlength=len(best)) > 0
        used, rule = np.flatnonzero(seen), (np.cumsum(seen) - 1)[rule]
        pair = pair_of[best[used]]
        pair = np.stack([pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)
        known = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
        size = np.ones(pair.shape, np.int64)
        inner = pair >= first
        size[inner] = known[pair[inner] - first]
        rules.append(pair)
        lengths.append(size.sum(axis=1))
        symbols[at] = (first + made + rule).astype(np.uint32)
        # The right symbol of each pair goes; a document that ended with it now ends with the rule before it.
        last = last - np.searchsorted(at + 1, last, "right")
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        made += len(used)
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    sizes = np.concatenate(lengths) if lengths else np.empty(0, np.int64)
    return Grammar(first, table, sizes, symbols.astype(np.int64)), last + 1


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of ids and texts in slices of about SLICE_BYTES of text; no text is cut."""
    if batch.num_rows:
        size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        place = (np.cumsum(size) - size) // SLICE_BYTES
        edge = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edge, edge[1:]))


def write_shards(docs: DataFrame, tokenizer: str, path: str, parts: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append END, and write the shards as a Parquet table of rows like SHARD.

    The order is that of the id, then of the text (for repeated ids); NULL ids come first, NULL texts are empty.
    Repeated rows are documents of their own. Other columns are not read; an empty table gives an empty file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        first = max(own.model.get_vocab_size(), END + 1)
        block, ids, rows, held = 0, [], [], 0

        def close() -> pa.RecordBatch:
            n = np.array([*map(len, rows)], np.int64)
            ends = np.zeros(int(n.sum()), bool)
            ends[np.cumsum(n) - 1] = True
            got, doc_symbols = repair(np.concatenate(rows), ends, first)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([n.tolist()], pa.list_(pa.int64())),
                pa.array([first], pa.int64()),
                pa.array([int(n.sum())], pa.int64()),
                *(pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (got.rules, got.lengths, got.symbols, doc_symbols)),
            ]
            names = [c.split()[0] for c in SHARD.split(", ")]
            return pa.RecordBatch.from_arrays(columns, names)

        for docs in (s for b in batches for s in text_slices(b)):
            tokens, n = own.encode_all(docs.column(1))
            edge = np.cumsum(n)
            tokens, edge = np.insert(tokens, edge, END), edge + np.arange(1, len(edge) + 1)
            for doc, a, b in zip(docs.column(0).to_pylist(), [0, *edge.tolist()], edge.tolist()):
                rows.append(tokens[a:b])
                ids.append(doc)
                held += b - a
                if held >= SHARD_TOKENS:
                    yield close()
                    block, ids, rows, held = block + 1, [], [], 0
        if rows:
            yield close()

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange(parts, "id")
        .sortWithinPartitions("id", "text")
    )
    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(path)


def grammar(row: dict) -> Grammar:
    numbers = lambda name: np.frombuffer(row[name], "<u4").astype(np.int64)
    return Grammar(row["first_rule"], numbers("rules").reshape(-1, 2), numbers("lengths"), numbers("symbols"))


def read_shards(spark, path: str) -> DataFrame:
    return spark.read.schema(SHARD).parquet(path)


def digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard_tokens, shard_symbols) of every document, read from its shard."""
    names = ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32", "shard_tokens", "shard_symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = grammar(row)
                raw = got.expand(got.symbols).astype("<u4").tobytes()
                n = np.array(row["doc_tokens"], np.int64)
                edge = np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge, edge[1:])]
                size = len(n)
                columns = [[row["part"]] * size, [row["block"]] * size, row["doc_ids"], edge[:-1], n, crc]
                columns += [[row["n_tokens"]] * size, [len(got.symbols) + 2 * len(got.rules)] * size]
                kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    schema = ", ".join(f"{n} {'int' if n in ('part', 'block') else 'bigint'}" for n in names)
    docs = shards.mapInArrow(run, schema)
    # Tokens before each shard: first per part, then over the parts, of which there are as many as write tasks.
    sizes = shards.select("part", "block", "n_tokens")
    inner = sizes.select(
        "part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")).alias("before")
    )
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    starts = inner.join(parts, "part").select("part", "block", (F.col("before") + F.col("base")).alias("first"))
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard_tokens", "shard_symbols"
    )


def tokens_at(shard: dict, doc: int, low: int = 0, high: int | None = None) -> list[int]:
    """Tokens low to high of the ``doc``-th document of a shard, by its grammar alone."""
    n = np.array(shard["doc_tokens"], np.int64)
    edge = int(n[:doc].sum())
    high = int(n[doc]) if high is None else min(high, int(n[doc]))
    return grammar(shard).slice(edge + low, edge + high).tolist()


def query(spark, sf_dir: str) -> DataFrame:
    """All documents to token files and, read back from them, where their tokens stand and the checksum of these."""
    import uuid

    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/newsflow-llm/tokens-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), path, parts)
    return digests(read_shards(spark, path))
