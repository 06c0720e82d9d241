"""The model against one counted with dictionaries, its probabilities as a distribution, and its edge cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from newsflow.llm import kneser_ney

END, PAD, OTHER = " end", " pad", " other"


def tokens_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


class Plain:
    def __init__(self, texts, order):
        self.order, self.words = order, Counter(w for t in texts for w in tokens_of(t))
        self.total = sum(self.words.values())
        grams = Counter()
        for text in texts:
            line = [PAD] * (order - 1) + tokens_of(text)
            grams.update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
        self.levels = [grams]
        for _ in range(order - 1):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.contexts = []
        for level in self.levels:
            by = defaultdict(Counter)
            for g, c in level.items():
                by[g[:-1]][g] = c
            self.contexts.append(by)
        self.discounts = []
        for level in self.levels:
            n = Counter(level.values())
            if n[1] and n[2] and n[3]:
                y = n[1] / (n[1] + 2 * n[2])
                d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            if not (n[1] and n[2] and n[3]) or min(d) <= 0:
                d = [0.5, 1.0, 1.5]
            self.discounts.append([0.0, *d])

    def p(self, gram):
        if not gram:
            return 1 / (len(self.words) + 1)
        level, d = self.contexts[len(gram) - 1].get(gram[:-1]), self.discounts[len(gram) - 1]
        if not level:
            return self.p(gram[1:])
        total, c = sum(level.values()), level.get(gram, 0)
        rest = sum(d[min(x, 3)] for x in level.values())
        return (max(c - d[min(c, 3)], 0) + rest * self.p(gram[1:])) / total

    def score(self, text):
        line = [PAD] * (self.order - 1) + [w if w in self.words else OTHER for w in tokens_of(text)]
        return sum(math.log10(self.p(tuple(line[i : i + self.order]))) for i in range(len(line) - self.order + 1))

    def row(self, text):
        words = tokens_of(text)
        base = sum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in words)
        return len(words), sum(w in self.words for w in words), base, self.score(text)


def corpus(prose, n=120):
    rng = random.Random(1)
    texts = [prose(rng.randint(0, 60), rng.randint(0, 80)) for _ in range(n)]
    texts += ["the " * 400, "The cat\tTHE cat\n the  cat É é </s> \x01", "", None, texts[3], texts[3]]
    return texts


def close(got, want):
    return got[:2] == want[:2] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[2:], want[2:]))


@pytest.mark.parametrize(("order", "parts", "chunk"), [(1, 3, 300), (2, 1, 1 << 21), (2, 5, 200), (3, 4, 1 << 21), (4, 3, 500)])
def test_equals_plain_model(spark, documents, prose, tmp_path, monkeypatch, order, parts, chunk):
    monkeypatch.setattr(kneser_ney, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(kneser_ney, "SLICE_BYTES", 700)
    texts = corpus(prose)
    plain = Plain(texts, order)
    docs = documents(list(enumerate(texts))).repartition(3)
    model = kneser_ney.train(docs, order, folder=str(tmp_path), parts=parts)
    assert (model.n_tokens, model.size) == (plain.total, len(plain.words))
    asked = [*texts, "never met words here", "the cat unknownword the cat", prose(50, 999)]
    rows = kneser_ney.score(documents(list(enumerate(asked))), model).collect()
    assert len(rows) == len(asked)
    for r in rows:
        assert close((r.n_tokens, r.n_known, r.base_score, r.score), plain.row(asked[r.doc_id])), asked[r.doc_id]
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


def test_probabilities_add_up_to_one(spark, documents, prose, tmp_path):
    texts = corpus(prose, 30)
    model = kneser_ney.train(documents(list(enumerate(texts))), 3, folder=str(tmp_path), parts=2)
    words = sorted({w for t in texts for w in tokens_of(t)} - {END})
    for context in ("", "the", "the cat", words[5], "unknownword the", "unknownword"):
        total = 0.0
        for word in [*words, "unmetword", None]:
            text = context if word is None else f"{context} {word}"
            logs, _ = model.log_probabilities(kneser_ney.hashed([text.encode()]))
            total += 10 ** logs[len(context.split())]
        assert math.isclose(total, 1, rel_tol=1e-9), context


def test_hot_contexts_are_split(spark, documents, tmp_path):
    texts = ["hot " + " hot ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    model = kneser_ney.train(documents(list(enumerate(texts))), 2, folder=str(tmp_path), parts=8)
    sizes = [len(np.load(tmp_path / f"grams-2-{s:06d}.npy")) for s in sorted(model.present[1])]
    assert len(sizes) == 8 and max(sizes) < 0.4 * sum(sizes)  # half of all n-grams begin with the hot word
    plain = Plain(texts, 2)
    for r in kneser_ney.score(documents(list(enumerate(texts))), model).collect():
        assert close((r.n_tokens, r.n_known, r.base_score, r.score), plain.row(texts[r.doc_id]))


def test_empty_corpus_and_columns(spark, documents, tmp_path):
    model = kneser_ney.train(documents([]), 2, folder=str(tmp_path), parts=3)
    docs = documents([(1, "some words"), (None, None)]).withColumnsRenamed({"lang": "score", "source": "id"})
    got = kneser_ney.score(docs, model)
    assert got.columns == ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    assert sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got.collect()) == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert kneser_ney.score(documents([]), model).collect() == []
    with pytest.raises(ValueError, match="mount"):
        kneser_ney.shared_path("hdfs://name/folder")
    assert kneser_ney.shared_path("file:///a/b") == "/a/b"


def test_query_scores_held_out_text_better_than_single_words(spark, documents, prose, tmp_path):
    lines = [prose(12, k) for k in range(40)]
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(5))) for i in range(200)]
    documents(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = kneser_ney.query(spark, f"file://{tmp_path}").collect()
    assert sorted(r.doc_id for r in got) == list(range(200))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert out and sum(r.score for r in out) > 0.7 * sum(r.base_score for r in out)
    want = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2], kneser_ney.ORDER)
    assert {r.train_tokens for r in got} == {want.total}
    text = dict(rows)
    assert all(close((r.n_tokens, r.n_known, r.base_score, r.score), want.row(text[r.doc_id])) for r in got)


def test_sql_agrees(spark, documents, prose, tmp_path):
    rows = [*enumerate(t for t in corpus(prose, 60))]
    documents(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(kneser_ney.SQL)
    names = [c[0] for c in want.description]
    rows = sorted(want.fetchall())
    got = sorted(tuple(r) for r in kneser_ney.query(spark, f"file://{tmp_path}").select(*names).collect())
    assert len(got) == len(rows)
    for a, b in zip(got, rows):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:]))
