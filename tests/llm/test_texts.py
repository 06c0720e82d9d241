"""Near duplicates, repeated passages, decontamination, token files, pieces and the pipeline on small inputs."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import dart_minhash, decontamination, pieces, substrings, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("edit" + str(rng.randrange(999)) if rng.random() < share else w for w in text.split())


def brute_classes(rows):
    parts = {k: dart_minhash.shingles(t) for k, (_, t) in enumerate(rows)}
    root = {k: k for k in parts}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in parts:
        for b in range(a):
            same = (rows[a][1] or "") == (rows[b][1] or "")
            if same or len(parts[a]) and len(parts[b]) and dart_minhash.similarity(parts[a], parts[b]) >= 0.8:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, least[top(k)]) for k, (i, _) in enumerate(rows))


def test_signatures_estimate_similarity(prose):
    for seed in range(4):
        a = prose(400, seed)
        a += " " + a[: len(a) // 2]
        b = edited(a, 0.03, seed)
        x, y = dart_minhash.shingles(a), dart_minhash.shingles(b)
        s = dart_minhash.signatures([x, y], 512)
        assert abs((s[0] == s[1]).mean() - dart_minhash.similarity(x, y)) < 0.1
        assert (dart_minhash.signatures([y], 512)[0] == s[1]).all()


def test_fractional_weights_stay_below_the_weight():
    doc, key, level = np.zeros(3, np.int64), np.array([5, 5, 9], np.uint64), np.array([0, 1, 0])
    whole = dart_minhash.sketch(doc, key, level, np.array([2.0, 2.0, 1.0]), np.array([3.0]), 256)
    part = dart_minhash.sketch(doc, key, level, np.array([1.5, 1.5, 1.0]), np.array([2.5]), 256)
    assert 0.7 < (whole == part).mean() < 0.95


def test_classes_equal_brute_force(spark, documents, prose):
    rows = [(i, prose(120 + i, i)) for i in range(12)]
    rows += [(100 + i, edited(rows[3][1], 0.02, i)) for i in range(40)]
    rows += [(200 + i, rows[5][1]) for i in range(30)]
    rows += [(300, None), (301, ""), (302, "  "), (303, "one two"), (304, "one two"), (305, prose(20_000, 77))]
    rows += [(306, edited(rows[-1][1], 0.01, 1)), (4, rows[4][1])]
    docs = documents(rows).withColumn("rid", F.lit("clash")).withColumn("band", F.lit(1))
    got = dart_minhash.classes(docs)
    assert sorted((r.doc_id, r.class_id) for r in got.collect()) == brute_classes(rows)
    kept = dart_minhash.stage(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_classes(rows)})
    assert kept[0].asDict().keys() == set(docs.columns)
    assert dart_minhash.classes(documents([])).count() == 0
    nulls = documents([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words that stand here alone")])
    assert dart_minhash.stage(spark, nulls, "").count() == 2


def test_repeats_equal_brute_force(spark, documents, prose):
    shared, long_ = prose(60, 1), prose(25, 2)
    rows = [(i, f"{prose(30, 10 + i)} {shared} {prose(i, 40 + i)}") for i in range(25)]
    rows += [(50, f"{long_} {long_} x {long_}"), (51, prose(19, 3)), (52, prose(19, 3)), (53, prose(20, 4)), (54, prose(20, 4))]
    rows += [(60 + i, edited(rows[0][1], 0.05, i)) for i in range(10)]
    rows += [(80, None), (81, ""), (82, "w " * 5000), (83, "a b c " + shared.replace(" ", "\n", 7))]
    random.Random(1).shuffle(rows)
    got = substrings.trimmed(documents(rows).withColumn("crc", F.lit(1)).withColumn("dd_words", F.lit("clash")))
    want = substrings.brute_force([(i, t or "") for i, t in rows])
    found = got.select("doc_id", "dd_words", "dd_removed", "dd_sha256").collect()
    assert sorted(tuple(r) for r in found) == want
    texts = {r.doc_id: r for r in got.collect()}
    before = dict(rows)
    assert all(texts[i].text == (before[i] or "") for i, *_ in want if not texts[i].dd_removed)
    assert len(texts[54].text) == 0 and texts[54].dd_removed == 20
    assert substrings.trimmed(documents([])).count() == 0


def test_repeated_rows_are_one_document(spark, documents, prose):
    text = prose(50, 1)
    got = substrings.trimmed(documents([(1, text), (1, text), (None, text)])).collect()
    assert sorted((r.doc_id is None, r.dd_removed) for r in got) == [(False, 0), (False, 0), (True, 50)]
    assert len(substrings.stage(spark, documents([(1, text), (2, text)]), "").where("n_chars = 0").collect()) == 1


def test_equal_checksums_are_two_documents(spark, documents, prose):
    """Two texts of one id are told apart by more than a checksum that texts can share."""
    shared, seen, pair = prose(30, 1), {}, None
    for i in range(400_000):
        text = f"{hashlib.sha256(str(i).encode()).hexdigest()[:12]} {shared}"
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            pair = other, text
            break
    assert pair
    got = substrings.trimmed(documents([(None, t) for t in pair])).collect()
    assert sorted(r.dd_removed for r in got) == [0, 30]


def test_spans_do_not_grow_with_equal_rows(spark, documents, prose):
    shared = prose(40, 1)
    rows = [(1, f"{prose(30, 2)} {shared}"), (3, f"{shared} {prose(25, 4)}")] + [(2, f"{prose(22, 3)} {shared} tail {shared}")] * 300
    keyed = substrings.documents(documents(rows), "doc_id", "text")
    sizes = {r.doc: r.n for r in substrings.repeats(keyed).select("doc", F.size("spans").alias("n")).collect()}
    assert set(sizes) == {2, 3} and max(sizes.values()) <= 2 * 62
    got = substrings.trimmed(documents(rows)).select("doc_id", "dd_removed").distinct().collect()
    assert sorted(tuple(r) for r in got) == [(1, 0), (2, 80), (3, 40)]


CLASH = ["_row", "_text", "_id", "_once", "_rid", "dd_words", "dd_sha256", "tox_severity", "spans", "rid", "user_0_", "a.b"]


def clashing(docs):
    own = docs.columns
    return docs.select(*own, *(F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH))


def test_stages_give_back_columns_of_any_name(spark, documents, prose, tmp_path):
    rows = [(i, f"{prose(60, i)} {prose(40, 99)}") for i in range(8)] + [(7, f"{prose(60, 7)} {prose(40, 99)}")]
    bench = [(1, "x", prose(20, 3))]
    spark.createDataFrame(bench, "item_id bigint, name string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage in (substrings.stage, dart_minhash.stage, decontamination.stage):
        docs = clashing(documents(rows))
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        kept = got.collect()
        assert kept and all(r[c] == f"{c}{r.doc_id}" for r in kept for c in CLASH)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def brute_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 30))
        score, first, end = decontamination.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == brute_align(a, b)
        assert brute_align(a, b[first:end]) == score


def test_leaks(spark, documents, prose):
    items = [(1, prose(30, 1)), (2, prose(16, 2)), (3, "Two words"), (4, None), (5, ""), (None, prose(20, 9)), (6, prose(40, 6))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    copy = items[0][1]
    hidden = copy.split()
    for k in range(4, len(hidden), 5):
        hidden[k] = "changed"
    rows = [(i, f"{prose(80, 20 + i)} {copy} {prose(40, 50 + i)}") for i in range(20)]
    rows += [(100, f"{prose(50, 3)} {' '.join(hidden).upper()}. {prose(9, 4)}"), (101, prose(300, 5)), (102, None), (103, "")]
    rows += [(104, "these two, words"), (105, " ".join(items[1][1].split()[:5])), (101, prose(300, 5))]
    rows += [(106, prose(30_000, 8) + " " + items[6][1].replace(" ", " , "))]
    got = decontamination.leaks(documents(rows), bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(i, 1) for i in range(20)] + [(100, 1), (104, 3), (106, 6)]
    whole = next(r for r in got if r.doc_id == 0)
    assert whole.score == 1.0 and (whole.first_word, whole.end_word) == (80, 110)
    assert 0.5 <= next(r for r in got if r.doc_id == 100).score < 1
    assert decontamination.leaks(documents([]), bench).count() == 0
    assert decontamination.leaks(documents(rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("step, verbatim", [(4, 0), (5, 0), (5, 3)])
def test_many_copies_of_one_edited_item(spark, documents, prose, step, verbatim):
    item = prose(40, 71)
    words = item.split()
    for k in range(step - 1, len(words), step):
        words[k] = "changed"
    rows = [(i, f"{prose(30, 200 + i)} {' '.join(words)} {prose(10, 300 + i)}") for i in range(50)]
    rows += [(100 + i, item) for i in range(verbatim)] + [(200 + i, prose(60, 400 + i)) for i in range(5)]
    bench = spark.createDataFrame([(1, item), (2, prose(25, 72))], "item_id bigint, text string")
    got = decontamination.leaks(documents(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, 1) for i in [*range(50), *range(100, 100 + verbatim)]]
    assert all(r.score >= 0.6 for r in got)


def edited_words(words, step, how, rng):
    """Every ``step``-th word changed or left out, or a word put in after it."""
    out = []
    for k, word in enumerate(words):
        own = f"new{rng.randrange(10**6)}"
        if k % step != step - 1:
            out.append(word)
        elif how == "changed":
            out.append(own)
        elif how == "inserted":
            out += [word, own]
    return out


def test_leaks_equal_alignment_of_all_pairs(spark, documents):
    """No document that reaches the score is lost, whatever was done to the item; common words are very common."""
    rng = random.Random(23)
    common_words = ["the", "of", "and", "to", "in"]

    def words(n, own):
        return [rng.choice(common_words) if rng.random() < 0.45 else f"{own}{rng.randrange(60)}" for _ in range(n)]

    items = [(i, words(rng.choice([8, 15, 24, 40]), "w")) for i in range(12)] + [(12, common_words * 2), (13, ["one", "two", "three", "four"])]
    rows = [(i, words(rng.randrange(0, 90), "w")) for i in range(40)]
    for (item, copy), step, how in itertools.product(items, (1, 2, 3, 4, 6), ("changed", "left out", "inserted")):
        around = rng.choice([0, 3, 60])
        rows.append((len(rows), words(around, "x") + edited_words(copy, step, how, rng) + words(around, "y")))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    got = decontamination.leaks(documents([(i, " ".join(w)) for i, w in rows]), bench).collect()
    want, runs = {}, {}
    for doc, text in rows:
        held = decontamination.words_of(" ".join(text))
        for item, copy in items:
            own = decontamination.words_of(" ".join(copy))
            score = decontamination.align(own, held)[0] / (decontamination.MATCH * len(own))
            if score >= decontamination.LEAST and len(own) >= decontamination.SHORT:
                want[doc, item] = score
                runs[doc, item] = bool(np.isin(decontamination.grams_of(held), decontamination.grams_of(own)).any())
    assert {(r.doc_id, r.item_id): r.score for r in got if r.item_id != 13} == want
    assert len(want) > 100 and list(runs.values()).count(False) > 10  # many have no three words in a row left


def test_bound_of_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item = rng.integers(0, 9, rng.integers(1, 14))
        items = decontamination.Items([(0, " ".join(map(str, item)))])
        part = decontamination.words_of(" ".join(map(str, rng.integers(0, 9, 20))))
        assert decontamination.align(items.words[0], part)[0] <= decontamination.MATCH * items.shared(0, part)


ODD = ["", " ", "  ", "a  b   c ", "\x00\ttab\nnew", "x \n y\n\nz  \t w", " lead", "don't 'll we've a's", "日本 語🙂 é̈\xa0q",
       "<|endoftext|> a <|endoftext|>b", "▁x▁▁y", "<s></s><unk><0x0A>", "a" * 60 + " " + "ab" * 40, "  p \x85 s \x1c t"]


def test_token_files(spark, documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 3_000)
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 3, t) for i, t in enumerate(ODD)] + [(200 + i, prose(400, i % 3)) for i in range(20)]
    rows += [(500, None), (7, "tie b"), (7, "tie a"), (8, "same"), (8, "same"), (None, "no id")]
    token_files.write_shards(documents(rows), path, f"file://{tmp_path}/t", 3)
    shards = token_files.read_shards(spark, f"file://{tmp_path}/t")
    got = sorted(token_files.digests(shards).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    model, start = Tokenizer.from_file(path), 0
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    ids = [[*model.encode(t, add_special_tokens=False).ids, 0] for *_, t in ordered]
    for row, (known, i, _), own in zip(got, ordered, ids, strict=True):
        raw = np.array(own, "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i if known else None, start, len(own), zlib.crc32(raw))
        start += len(own)
    assert any(r.shard_symbols < r.shard_tokens for r in got)
    flat = []
    for s in sorted((r.asDict() for r in shards.collect()), key=lambda s: (s["part"], s["block"])):
        flat += [token_files.tokens_at(s, k) for k in range(len(s["doc_ids"]))]
        assert token_files.tokens_at(s, 0, 1, 3) == flat[-len(s["doc_ids"])][1:3]
    assert flat == ids
    token_files.write_shards(documents([]), path, f"file://{tmp_path}/e", 2)
    assert token_files.digests(token_files.read_shards(spark, f"file://{tmp_path}/e")).count() == 0


def test_encoder_meets_pieces_again_and_rules_expand_once():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_files.encoder(path) is token_files.encoder(path)  # later tasks of a worker find what earlier ones met
    own, rng = token_files.Encoder(path), random.Random(7)
    bits = ["'s", "'ll", "'", "a", "Zq", "12", "\n", "\t", " ", "  ", "\x00", "\x1c", "\x7f", "é", "\u00a0", "<|endoftext|>", "<|", "...", "!?", "\x0b", "日本"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(["", " b", " "]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.model.encode(text, add_special_tokens=False).ids, text
    own.encode("a few words, some of them words")
    assert own.pieces[" words"] == own.ids(" words").tobytes()
    tokens = np.array([rng.randrange(40) for _ in range(30_000)], "<u4")
    got, _ = token_files.repair(tokens, np.append(np.zeros(len(tokens) - 1, bool), True), 50_257)
    assert len(got.rules) and len(got.symbols) > len(got.rules)
    assert (got.expand(got.symbols) == tokens).all()


def test_encoder_gives_the_model_each_piece_once(monkeypatch):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(11)
    own, added = token_files.Encoder(path), "<|endoftext|>"
    bits = ["'s", "'ve", "'re", "'", "s", "ÉTÉ", "où", "²", "½", "٣", "\u0301", "\u2003", "\u3000", "\u0085", "\ufeff", "日本", "🙂", "𝒳", " ", "  ", "\n", "\t", "!", "7"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " b", " "]) for _ in range(rng.randint(0, 14))) for _ in range(2_000)]
    texts += ["".join(map(chr, rng.choices([*range(0x20, 0xD800), *range(0xE000, 0x11000)], k=8))) for _ in range(500)]
    want = [t.ids for t in own.model.encode_batch(texts, add_special_tokens=False)]
    whole, met = own.ids, []
    monkeypatch.setattr(own, "ids", lambda text: met.append(text) or whole(text))
    got, n = own.encode_all(pa.array([*texts, f"é {added} è", ""])[1:])  # a slice of a larger array
    assert met == [f"é {added} è"]
    rows = [r.tolist() for r in np.split(got, np.cumsum(n)[:-1])]
    assert rows == [*want[1:], own.model.encode(met[0], add_special_tokens=False).ids, []]
    asked = []
    monkeypatch.setattr(token_files.Pieces, "__missing__", lambda self, piece: asked.append(piece) or b"")
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts[1:]] == want[1:] and met == met[:1] and not asked


def test_pieces_are_kept_in_two_generations(monkeypatch):
    monkeypatch.setattr(token_files.Encoder, "KEPT", 5)
    own = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["a b c d e f g", "a b x y z é è", "f g x à"] * 3:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.model.encode(text, add_special_tokens=False).ids
        assert len(own.pieces) <= 5 and len(own.pieces.old) <= 5


def test_documents_end_where_their_symbols_do(spark, documents, prose, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE_BYTES", 500)  # slices of a few documents, one of a single long one
    rows = [(i, prose(60 * (i % 4), i % 5)) for i in range(40)] + [(50, prose(3_000, 1)), (51, None), (52, "été " * 400)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_shards(documents(rows), path, f"file://{tmp_path}/t", 2)
    own, met = token_files.Encoder(path), 0
    for shard in (r.asDict() for r in token_files.read_shards(spark, f"file://{tmp_path}/t").collect()):
        got = token_files.grammar(shard)
        edges = [0, *np.frombuffer(shard["doc_symbols"], "<u4").tolist()]
        for doc, a, b in zip(shard["doc_ids"], edges[:-1], edges[1:], strict=True):
            want = own.model.encode(dict(rows)[doc] or "", add_special_tokens=False).ids
            assert got.expand(got.symbols[a:b]).tolist() == [*want, 0]
            met += 1
    assert met == len(rows)


def test_pieces_equal_the_library(spark, documents, prose):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = pieces.compile_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate([*ODD, prose(3000, 1), "The committee's decision, reached on 12/05, wasn't final; see §3."]))
    docs = documents([*rows, (900, None), (None, "x")]).withColumn("ids", F.lit("clash"))
    got = pieces.decode(pieces.encode(docs, model), model).collect()
    for r in got:
        want = library.encode(r.text or "")
        assert list(r.ids) == want and r.decoded == library.decode(want), r.text
    assert pieces.encode(docs.limit(0), model).count() == 0
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in pieces.coded(docs).collect())


def test_memory_of_words_is_bounded():
    made = []
    known = pieces.Remembered(lambda k: made.append(k) or k, 10)
    for i in range(100):
        assert known[i % 25] == i % 25 and known[3] == 3
    assert len(known) <= 10 and len(known.old) <= 10


def test_pipeline(spark, documents, prose, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    item, passage = prose(30, 500), prose(60, 501)
    rows = [(i, prose(100, i)) for i in range(60)]
    marks = [(i, 1, int(i % 4 == 0)) for i in range(60)]
    rows = [(i, t + " blorg snarf" if i % 4 == 0 else t) for i, t in rows]
    one = rows[1][1].split()
    rows += [(100 + i, " ".join([*one[: 10 * i], "changed", *one[10 * i + 1 :]])) for i in range(8)] + [(200, f"{prose(40, 300)} {item} {prose(40, 301)}")]
    rows += [(300 + i, f"{prose(50, 400 + i)} {passage} {prose(50, 420 + i)}") for i in range(3)] + [(400, None)]
    rng.shuffle(rows)
    folder = f"file://{tmp_path}"
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    clean = {i for i in range(60) if i % 4}
    assert set(got) == clean | {300, 301, 302, 400}
    model = pieces.compile_model(public_tokenizers.path("piece_bpe_32k.model"))
    held = [passage in model.decode(list(got[i].ids)) for i in (300, 301, 302)]
    assert held == [True, False, False]
    assert len(corpus_pipeline.STAGES) == 5
