"""Fill-in-the-middle against a plain version, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pyarrow as pa

from newsflow.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x01", "\x02", "\x03", "\x00", "\x85", "\xa0", " ", "<", "P>", "<S", ">"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [*made, None, "", " ", "\n\n", "a", " a ", "x <P> y", "word " * 30_000, "w" * 200_000]


def test_equals_plain_version_and_restores(spark, documents):
    rows = [*enumerate(texts()), (5, "same row"), (5, "same row"), (None, "no id here at all"), (-3, "negative id, some words")]
    made = fill_middle.transform(documents(rows).withColumnRenamed("n_chars", "output"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert made.columns == names
    got = sorted((tuple(r) for r in made.select(*names).collect()), key=repr)
    assert got == sorted((plain_version(d, t) for d, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = made.select("doc_id", fill_middle.restore(made.output, made.form).alias("t")).collect()
    assert sorted((tuple(r) for r in back), key=repr) == sorted(((d, t or "") for d, t in rows), key=repr)


def test_rates_seed_and_empty_table(spark, documents):
    docs = documents([(i, f"one two three {i}") for i in range(300)])
    assert {r.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_middle.transform(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    one, two = ({r.doc_id: r.output for r in fill_middle.transform(docs, seed=s).collect()} for s in (1, 2))
    assert one != two
    assert fill_middle.transform(documents([])).collect() == []


def test_slices_hold_few_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 30, None, "b" * 30, "c" * 500, "d"])], ["t"])
    assert [s.num_rows for s in fill_middle.by_bytes([batch], 0, 64)] == [3, 1, 1]
    assert list(fill_middle.by_bytes([batch.slice(0, 0)], 0)) == []


def test_sql_agrees(spark, documents, tmp_path):
    docs = documents([(i, t) for i, t in enumerate(texts()) if "\x00" not in (t or "")])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(fill_middle.SQL)
    names = [c[0] for c in want.description]
    got = fill_middle.query(spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want.fetchall(), key=repr)
