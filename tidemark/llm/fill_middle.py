r"""Fill-in-the-middle transformation by DuckDB inside ``mapInArrow``.

Every text is cut into lines; two of the borders between lines, drawn from a
digest of seed and doc_id, part it into prefix, middle and suffix, which are
written in one of two orders with a sentinel before each part.  A task
registers each Arrow batch as a table of an in-memory DuckDB, runs SQL over it
and hands Arrow on, so no row passes through Python.  ``restored`` rebuilds the
exact text from output and form alone.

The rows are independent: nothing is shuffled, and a lost task is run again
with the same result.  Batches are handed to DuckDB in slices of about
``SLICE`` bytes of text, so memory follows the longest text, not the batch.

Cases: a null text is the empty one, which stays plain, as do texts that hold a
sentinel.  A text without line ends is one unit: two of its three parts are
empty.  A null doc_id counts as the empty string in the digest.  Ties do not
arise, as each row depends on itself only; repeated rows give repeated results.
An empty table gives no rows, and columns of any other name play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import claim, documents

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A line with its end, or the rest of the text after the last line end.
UNIT = r"[^\n]*\n|[^\n]+"
#: Bytes of text that DuckDB is given at once, about.
SLICE = 8 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _check(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may arise where parts and sentinels meet, else the output could be read in two ways."""
    if not all(sentinels):
        raise ValueError("sentinels must not be empty")
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if (i != j and a.startswith(b)) or b[0] in a[1:]:
                raise ValueError("sentinels must differ, none may begin another, and their first characters may occur nowhere else in them")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def transform_sql(seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, source: str = "batch") -> str:
    """SQL from the table ``source`` (doc_id, text) to the columns of ``SCHEMA``.

    ``rate`` of 100 texts are transformed; ``spm`` of 100 of these put the suffix first.
    """
    p, s, m = map(_quoted, sentinels)
    draw = lambda k: f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS UBIGINT)"
    return f"""
    WITH cut AS (
      SELECT doc_id, text, regexp_extract_all(text, {_quoted(UNIT)}) AS units, sha256('{int(seed)}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM {source}),
    drawn AS (
      SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
        CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(2)} % 100 >= {int(rate)} THEN 'plain'
             WHEN {draw(3)} % 100 < {int(spm)} THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parted AS (
      SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, CAST(least(a, b) AS BIGINT)), '') AS prefix,
        array_to_string(list_slice(units, CAST(least(a, b) AS BIGINT) + 1, CAST(greatest(a, b) AS BIGINT)), '') AS middle,
        array_to_string(list_slice(units, CAST(greatest(a, b) AS BIGINT) + 1, n), '') AS suffix FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
      CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
    FROM parted"""


def restore_sql(sentinels: tuple[str, str, str] = SENTINELS, columns: str = "*") -> str:
    """SQL from a table ``batch`` with ``form`` and ``output`` to ``columns`` and the exact text, ``restored``."""
    p, s, m = map(_quoted, sentinels)
    after = lambda mark, rest: f"substr({rest}, strpos({rest}, {mark}) + length({mark}))"
    before = lambda mark, rest: f"substr({rest}, 1, strpos({rest}, {mark}) - 1)"
    middle = after(m, "output")
    psm = f"{before(s, after(p, 'output'))} || {middle} || {before(m, after(s, 'output'))}"
    spm = f"{before(m, after(p, 'output'))} || {middle} || {before(p, after(s, 'output'))}"
    return f"SELECT {columns}, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {psm} ELSE {spm} END AS restored FROM batch"


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE`` bytes of text, one row at least."""
    sizes = pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False)
    first = held = 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= SLICE:
            yield batch.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _through_duckdb(df: DataFrame, sql: str, schema: str, text: str) -> DataFrame:
    """``df`` batch by batch through ``sql``, which reads the table ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("fill_middle")
        # one thread a task, as Spark has others beside it, and no files of its own
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "autoinstall_known_extensions": "false", "autoload_known_extensions": "false"})
        try:
            for batch in batches:
                for part in _slices(batch, text):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars (code points, null if plain) and the output text."""
    _check(sentinels)
    return _through_duckdb(documents(docs, id_col, text_col), transform_sql(seed, rate, spm, sentinels), SCHEMA, "text")


def restored(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The columns of ``SCHEMA`` with ``restored``, the text that output and form give."""
    _check(sentinels)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return _through_duckdb(transformed.select(*names), restore_sql(sentinels, ", ".join(names)), SCHEMA + ", restored string", "output")


#: The same over the whole table in one statement; the digests read what output and form give.
ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
batch AS ({transform_sql(source="texts")})
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM ({restore_sql()})
"""
