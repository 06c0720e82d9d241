"""SentencePiece encoding and decoding as a shortest path through composed weighted transducers.

Three transducers are compiled from the model: the normaliser (a space in front, spaces to U+2581), the pieces (an arc
for every piece, from the text it spells to its id) and byte fallback (an arc for every character without a piece, to
the ids of its UTF-8 bytes). An input is composed with them and the path of least weight in the tropical semiring
(weights add along a path, the least path counts) is read off.

The weights make this path the one that the model's merges give. In a merge model a sequence of pieces is the encoding of
its text exactly when every two neighbours are the encoding of theirs, so an arc weighs 1 after a piece it can follow
and infinity after any other. One path of finite weight remains, and one piece can end at each place of it, so the
search keeps one state for each place. No piece holds U+2581 behind another character: paths part at word beginnings
and words are composed one by one, the result of frequent ones being remembered.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
WORDS_KEPT = 250_000  # encodings remembered in each of two generations
PAIRS_KEPT = 500_000


class Remembered(dict):
    """A dictionary that computes what it misses; of what is not used again it keeps one generation more."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Transducer:
    """The composed transducer of a model: ``scores`` by piece, ``ids`` by piece, ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: list[int]):
        self.ids = {p: i for p, _, i in pieces}
        self.scores = {p: s for p, s, _ in pieces}
        self.trie: dict = {}  # arcs by character; "" holds the piece that ends here
        for p in self.ids:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.byte_ids = byte_ids
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on over the beginning of a word")
        self.spelled = {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.spelled.update({i: bytes([b]) for b, i in enumerate(byte_ids)})
        self.follows: dict[str, dict[str, bool]] = {"": {}}
        self.pairs = 0
        self.words = Remembered(self.encode_word, WORDS_KEPT)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the pair with the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, before: str, piece: str) -> bool:
        """Whether the arc of a piece has a finite weight after another; computed once for a pair."""
        if self.pairs >= PAIRS_KEPT:
            self.follows, self.pairs = {"": {}}, 0
        ok = not before or self.merged(before + piece) == [before, piece]
        self.follows.setdefault(before, {})[piece] = ok
        self.pairs += 1
        return ok

    def path(self, word: str) -> list[str]:
        """Labels of the shortest path: pieces, and single characters for byte fallback."""
        n, trie = len(word), self.trie
        last: list = [None] * (n + 1)  # the piece that ends the shortest path to a place
        last[0] = ""
        for start in range(n):
            before = last[start]
            if before is None:
                continue
            known = self.follows.get(before, {})
            node, end = trie, start
            while end < n:
                node = node.get(word[end])
                if node is None:
                    break
                end += 1
                if "" in node and last[end] is None:
                    piece = node[""]
                    ok = known.get(piece)
                    if self.compatible(before, piece) if ok is None else ok:
                        last[end] = piece
            char = word[start]
            if char not in self.ids and last[start + 1] is None and self.compatible(before, char):
                last[start + 1] = char
        out, end = [], n
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def encode_word(self, rest: str) -> bytes:
        """Ids of a word, as 32-bit little-endian numbers; ``rest`` is the word without its first U+2581."""
        ids, out = self.ids, array("I")
        for label in self.path(SPACE + rest):
            if label in ids:
                out.append(ids[label])
            else:
                out.extend(self.byte_ids[b] for b in label.encode())
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def normalised(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> bytes:
        said = self.normalised(text or "")
        if not said:
            return b""
        if SPACE + SPACE in said or said.endswith(SPACE):
            words = [w[1:] for w in WORD.findall(said)]
        else:
            words = said[1:].split(SPACE)
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, control ids nothing."""
        raw = b"".join([self.spelled.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace").removeprefix(" ")


def compile_model(path: str) -> Transducer:
    """Read pieces and scores of a merge model with byte fallback."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], [0] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((model.id_to_piece(i), model.get_score(i), i))
    return Transducer(pieces, byte_ids)


def _mapped(df: DataFrame, model: Transducer, source: str, made: dict[str, str], work) -> DataFrame:
    """``df`` with more columns (name: type), made from ``source`` by ``work(transducer, arrow array)``."""
    kept = df.drop(*(c for c in made if c != source))
    place = [f.name for f in kept.schema].index(source)
    plain = [(p, s, i) for (p, s), i in zip(model.scores.items(), model.ids.values())]
    known = df.sparkSession.sparkContext.broadcast((plain, model.byte_ids))  # the model: its vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Transducer(*known.value)
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *work(own, batch.column(place))], [*batch.schema.names, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*fields, *(f"`{n}` {t}" for n, t in made.items())]))


def _listed(rows: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode(docs: DataFrame, model: Transducer, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of every whole text.

    NULL and empty texts have no ids. Other columns pass, one named ``ids_col`` is replaced; an empty table stays one.
    """

    def work(own: Transducer, texts: pa.Array) -> list[pa.Array]:
        return [_listed([own.encode(t) for t in texts.to_pylist()])]

    return _mapped(docs, model, text_col, {ids_col: "array<int>"}, work)


def decode(docs: DataFrame, model: Transducer, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of every list of ids; NULL gives an empty text.

    The text of encoded ids is the text that was encoded, but that U+2581 comes back as a space.
    """

    def work(own: Transducer, ids: pa.Array) -> list[pa.Array]:
        return [pa.array([own.decode(i or []) for i in ids.to_pylist()], pa.string())]

    return _mapped(docs, model, ids_col, {text_col: "string"}, work)


def encode_checked(docs: DataFrame, model: Transducer, text_col: str = "text") -> DataFrame:
    """``docs`` with ids and round_trip: whether decoding the ids gives the text back, in one pass."""

    def work(own: Transducer, texts: pa.Array) -> list[pa.Array]:
        rows, same = [], []
        for text in texts:
            said = text.as_py() or ""
            rows.append(own.encode(said))
            same.append(own.decode(np.frombuffer(rows[-1], "<i4").tolist()) == said.replace(SPACE, " "))
        return [_listed(rows), pa.array(same, pa.bool_())]

    return _mapped(docs, model, text_col, {"ids": "array<int>", "round_trip": "boolean"}, work)


def coded(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): encoded, decoded again, and whether the text came back."""
    import public_tokenizers

    model = compile_model(public_tokenizers.path("piece_bpe_32k.model"))
    rows = encode_checked(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.size("ids").alias("n_tokens"), "ids", "round_trip")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents as piece ids, checked by decoding them."""
    return coded(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as piece ids."""
    return coded(docs)
