"""Fill-in-the-middle: documents rearranged so that a model learns to write what stands between two given parts.

A unit is a run of other characters with the ASCII white space before it; white space at the end of a text is a unit of
its own. Two cuts between units, drawn from a hash of the document's id, part a text into prefix, middle and suffix.

Per Arrow batch the work is one ``pyarrow.compute`` pipeline over all texts at once: split into list arrays of units,
flatten with parent indices, number the units of each text, filter by role, rebuild lists, join the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.llm import common

UNIT = r"([ \t-\r]*[^ \t-\r]+|[ \t-\r]+)"
MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
RATE, SPM_RATE, SEED = 50, 80, 42  # percent of documents rearranged; percent of these with the suffix first; hash seed
SLICE_BYTES = 4 << 20  # text handled at once, or one text if it is longer
# Units are parted by ESCAPE + CUT; an ESCAPE of the text itself becomes ESCAPE + KEPT. None of the three is white space.
ESCAPE, KEPT, CUT = "\x01", "\x02", "\x03"
LARGE = pa.large_string()
MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of ``column`` have ``limit`` bytes in all, or one row where a text is longer."""
    for batch in batches:
        start = held = 0
        for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def units_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """All units of ``texts`` in a row, the text each belongs to, its number within it, and the units per text."""
    marked = pc.replace_substring(texts, ESCAPE, ESCAPE + KEPT)
    marked = pc.replace_substring_regex(marked, UNIT, rf"\1{ESCAPE}{CUT}")
    lists = pc.split_pattern(marked, ESCAPE + CUT)  # each ends with an empty piece
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    parents = pc.cast(pc.list_parent_indices(lists), pa.int64())
    pieces = pc.list_flatten(lists)
    first = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinals = pc.subtract(pa.array(np.arange(len(pieces))), pc.take(first, parents))
    real = pc.less(ordinals, pc.take(n, parents))
    pieces, parents, ordinals = (pc.filter(x, real) for x in (pieces, parents, ordinals))
    return pc.replace_substring(pieces, ESCAPE + KEPT, ESCAPE), parents, ordinals, n


def joined(units: pa.Array, parents: pa.Array, chosen: pa.Array, size: int) -> pa.Array:
    """The ``chosen`` units of every one of ``size`` texts, joined."""
    kept, counts = pc.filter(units, chosen), pc.value_counts(pc.filter(parents, chosen))
    per_text = pc.index_in(pa.array(np.arange(size)), value_set=counts.field("values"))
    lengths = pc.fill_null(pc.take(counts.field("counts"), per_text), 0)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(lengths)])
    lists = pa.LargeListArray.from_arrays(offsets, kept)
    return pc.binary_join(lists, pa.scalar("", LARGE))


def rearrange(texts: pa.Array, h1: pa.Array, h2: pa.Array, rearranged: pa.Array, suffix_first: pa.Array) -> list[pa.Array]:
    """The columns of ``MADE`` for texts without NULL."""
    units, parents, ordinals, n = units_of(texts)
    cuts = [pc.subtract(h, pc.multiply(pc.divide(h, pc.add(n, 1)), pc.add(n, 1))) for h in (h1, h2)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    before = pc.less(ordinals, pc.take(low, parents))
    behind = pc.greater_equal(ordinals, pc.take(high, parents))
    middle_units = pc.invert(pc.or_(before, behind))
    prefix, middle, suffix = (joined(units, parents, c, len(texts)) for c in (before, middle_units, behind))
    held = pc.match_substring(texts, MARKERS[0])
    for marker in MARKERS[1:]:
        held = pc.or_(held, pc.match_substring(texts, marker))
    plain = pc.or_(pc.or_(held, pc.equal(n, 0)), pc.invert(rearranged))
    p, s, m, end = (pa.scalar(x, LARGE) for x in (*MARKERS, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, end)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, end)
    form = pc.if_else(plain, "plain", pc.if_else(suffix_first, "spm", "psm"))
    output = pc.if_else(plain, texts, pc.if_else(suffix_first, spm, psm))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(x), pa.int64())) for x in (prefix, middle)]
    return [n, form, *chars, output.cast(pa.string())]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``; other columns are left out.

    ``form`` is plain, psm (prefix, suffix, middle) or spm (suffix, prefix, middle); ``rate`` percent of the documents are
    rearranged, ``spm_rate`` percent of these with the suffix first. Empty texts and texts that hold a marker stay plain.
    A NULL text counts as empty, a NULL id as an id without digits. Rows of the same id and text give equal results. A
    text is never cut: one longer than ``SLICE_BYTES`` is handled alone. No rows give no rows. No shuffle.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < rate).alias("rearranged"), (h[3] % 100 < spm_rate).alias("suffix_first"),
    )
    names = ["id", *(c.split()[0] for c in MADE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_bytes(batches, 1):
            columns = rearrange(part.column(1).cast(LARGE), *(part.column(i) for i in range(2, 6)))
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {MADE}").withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from what it returned: markers stand in a rearranged text once each."""
    parts = F.split(output, "|".join(MARKERS), -1)
    psm, spm = ([F.element_at(parts, i) for i in order] for order in ((2, 4, 3), (3, 4, 2)))
    return F.when(form == "psm", F.concat(*psm)).when(form == "spm", F.concat(*spm)).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document rearranged, and the checksums of the result and of the text rebuilt from it."""
    made = transform(common.table(spark, sf_dir, "documents"))
    output, form = F.col("output"), F.col("form")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"), F.sha2(restore(output, form), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT *, len(units) AS n,
    ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), pieces AS (
  SELECT *, array_to_string(units[:least(c1, c2)], '') AS prefix,
    array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
    array_to_string(units[greatest(c1, c2) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
"""
