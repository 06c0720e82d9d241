"""Runs against trying every period, at every step of a growing text, and the query against its plain statement."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from newsflow.llm import periodic_runs
from newsflow.llm.periodic_runs import Catchers, brute_force


def sequences():
    rng = random.Random(11)
    for n in (0, 1, 5, 11, 12, 13, 40):
        yield [7] * n
    for _ in range(60):
        n, letters = rng.randint(1, 220), rng.choice([1, 2, 2, 3, 5, 40])
        yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(60):  # planted powers, also inside each other and side by side
        out = []
        while len(out) < 150:
            piece = [rng.randrange(4) for _ in range(rng.randint(1, 30))]
            out += piece * rng.randint(1, 5) + piece[: rng.randint(0, len(piece))]
        yield out
    thue = [bin(i).count("1") % 2 for i in range(256)]
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 250:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    yield from (thue, fibonacci[1], [0] * 50 + [1] + [0] * 70, ([0] * 20 + [1]) * 6)


def test_runs_equal_brute_force():
    for words in sequences():
        found = Catchers()
        found.append(np.array(words, np.int64))
        assert found.runs() == brute_force(words), words


def test_appending_in_any_steps_is_online():
    rng = random.Random(2)
    for k, words in enumerate(sequences()):
        if k % 3:
            continue
        found, at = Catchers(), 0
        while at < len(words):
            step = 1 if k % 2 else rng.randint(0, 25)
            found.append(np.array(words[at : at + step], np.int64))
            at += step
            assert found.runs() == brute_force(words[:at]), (words, at)


def test_long_stretches_stay_cheap():
    found = Catchers()
    found.append(np.concatenate([np.zeros(300_000), np.arange(1, 1000), np.tile(np.arange(2_000, 7_000), 40)]).astype(np.int64))
    assert found.runs() == [(0, 300_000, 1), (300_999, 200_000, 5_000)]


def stated(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha


def rows_of(prose):
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(0, 160), i)) for i in range(150)]
    rows += [(1000 + i, " ".join([prose(1 + i, i)] * (30 // (1 + i) + 3))) for i in range(20)]
    rows += [(3, None), (4, ""), (5, " \n\t"), (6, "la " * 500), (6, "la " * 500), (None, "x y " * 20), (-9, "é  é  " * 9)]
    return rows


def test_query_equals_its_statement(spark, documents, prose, tmp_path):
    rows = rows_of(prose)
    documents(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic_runs.query(spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((stated(*r) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 20


@pytest.mark.parametrize("size", [1, 50, 4000])
def test_slices_do_not_change_results(spark, documents, prose, monkeypatch, size):
    rows = rows_of(prose)
    want = sorted(map(repr, periodic_runs.find_runs(documents(rows)).collect()))
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", size)
    docs = documents(rows).withColumnsRenamed({"lang": "starts", "source": "kept", "n_chars": "id"})
    got = periodic_runs.find_runs(docs)
    assert got.columns == ["doc_id", "n_words", "starts", "lengths", "periods", "kept"]
    assert sorted(map(repr, got.collect())) == want
    assert periodic_runs.find_runs(documents([])).collect() == []
