"""Chat formatting with loss masks, through incremental black-box rendering.

A template is any function from a list of (role, text) to a string.  It is
rendered for successive prefixes of a conversation; where each output continues
the one before, the new part is the span of the new turn, and where it does
not, the template rewrites history and the conversation is flagged.  The span
of a turn's text within its turn is found by rendering the turn once more with
a probe in place of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Characters that probes consist of and that escaping leaves alone.
EDGE, INNER = "\ue000", "\ue001"
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"### (.*?) ###\n(.*?)</turn>\n", re.S)


def escape(text: str) -> str:
    """Text in which neither ### nor </turn> occurs: a backslash is doubled, one splits each control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def default_template(turns: list[Turn]) -> str:
    """``### role ###``, the text, ``</turn>``; role and text escaped."""
    return "".join(f"### {escape(role)} ###\n{escape(text)}</turn>\n" for role, text in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns that ``default_template`` has written."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def probe_for(turns: list[Turn]) -> str:
    """A string that occurs in no role or text: it holds a longer run of INNER than any of them."""
    longest = max((len(run) for turn in turns for part in turn for run in re.findall(f"{INNER}+", part)), default=0)
    return EDGE + INNER * (longest + 1) + EDGE


def render_spans(turns: list[Turn], template: Template = default_template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """The rendered conversation and, per turn, (start, stop, text_start, text_stop); None if the template rewrites history."""
    out, spans, probe = template([]), [], probe_for(turns)
    for k in range(1, len(turns) + 1):
        role, text = turns[k - 1]
        now = template(turns[:k])
        probed = template([*turns[: k - 1], (role, probe)])
        if not now.startswith(out) or not probed.startswith(out):
            return template(turns), None
        head = probed.find(probe, len(out))
        tail = len(probed) - head - len(probe)
        if head < 0 or len(now) - tail < head or now[:head] != probed[:head] or now[len(now) - tail :] != probed[head + len(probe) :]:
            return template(turns), None
        spans.append((len(out), len(now), head, len(now) - tail))
        out = now
    return out, spans


_SPANS = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("text_start", pa.int64()), ("text_stop", pa.int64()), ("loss", pa.bool_())]))


def format_conversations(rows: DataFrame, template: Template = default_template, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, spans, rewrites for every conversation.

    ``rows`` has conv_id, turn, role and text; other columns, whatever their
    names, play no part.  Turns follow ``turn`` (nulls first; ties by role,
    then text; repeated rows count each), null roles and texts are empty, and a
    row without a conv_id is a conversation of its own.  An empty table gives
    an empty one.  A span is learned (``loss``) if its role is in ``learned``.
    With a template that rewrites history, or that does not show a turn's text
    as it would show any other, ``rewrites`` is true and ``spans`` null.  A
    conversation is rendered in one task, once per prefix: its cost grows with
    the square of its own length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [render_spans([(t["role"], t["text"]) for t in turns], template) for turns in batch["turns"].to_pylist()]
            spans = [
                None if s is None else [{"role": t["role"], "start": a, "stop": b, "text_start": c, "text_stop": d, "loss": t["role"] in learned} for t, (a, b, c, d) in zip(turns, s)]
                for turns, (_, s) in zip(batch["turns"].to_pylist(), made)
            ]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array([f for f, _ in made], pa.string()), pa.array(spans, _SPANS), pa.array([s is None for s in spans])], names=["conv_id", "formatted", "spans", "rewrites"])

    empty = F.lit("")
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    grouped = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    grouped = grouped.union(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    return grouped.mapInArrow(run, "conv_id long, formatted string, spans array<struct<role: string, start: long, stop: long, text_start: long, text_stop: long, loss: boolean>>, rewrites boolean")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted output: turns by parsing it, learned text by its mask.

    The output must be that of ``default_template``.  Without spans there is no
    mask: loss_chars and loss_sha256 are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["spans"].to_pylist()):
                turns = parse(text)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = None if spans is None else "".join(unescape(text[s["text_start"] : s["text_stop"]]) for s in spans if s["loss"])
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                out.append((conv_id, len(turns), sha(whole), None if learned is None else len(learned), None if learned is None else sha(learned), len(text)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same in DuckDB: of a text, each backslash, each # before ## and each </turn> takes one character more.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL),
e AS (
  SELECT *, length(x) + length(x) - length(replace(x, '\', '')) + (length(x) - length(replace(x, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(x, '#{3,}'), lambda r: length(r) - 2)), 0) AS chars
  FROM (SELECT *, unnest([role, text]) AS x FROM t)),
f AS (SELECT conv_id, lone, CAST(sum(chars) AS BIGINT) AS chars FROM e GROUP BY conv_id, lone),
g AS (
  SELECT conv_id, lone, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
  FROM t GROUP BY conv_id, lone)
SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, chars + n_turns * length(concat('### ', ' ###', chr(10), '</turn>', chr(10))) AS formatted_chars
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id AND g.lone IS NOT DISTINCT FROM f.lone
"""
