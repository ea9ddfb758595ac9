"""Chat turns to training examples by prefix-target expansion.

Every assistant turn is the target of an example of its own: all turns before
it are the context, and only its text is trainable.  The examples of a
conversation share their beginnings, so each formatted turn is stored and moved once, with
the place where it begins in the conversation's text: an example is that text
up to the end of its target, and a span of it is under the loss.
``whole_examples`` writes the examples out; ``conversation_digests`` expands
them in the task that reads them back.  The text of the examples of one conversation
grows with the square of its turns, and with it the time of its task, not its memory or disk.

A turn reads ``<|im_start|>role`` + line end + text + ``<|im_end|>`` + line
end.  In texts and roles a backslash is put before the bar of ``<|`` (and one
more where some are there), so no mark of a text can be taken for one of the
template, and each is read back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlens.operators.scale import attach

# The marks of the template
START, END, REPLY = "<|im_start|>", "<|im_end|>", "assistant"

# Turn numbers of one block are counted by one task.
BLOCK = 4096

_TURN = re.compile(re.escape(START) + "([^\n]*)\n(.*)" + re.escape(END) + "\n", re.S)


def escaped(text: Column) -> Column:
    """Text without any mark of the template."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _escaped_role(role: Column) -> Column:
    """A role on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, text = _TURN.fullmatch(piece).groups()
    return unescaped_role(role), unescaped(text)


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply: str = REPLY
) -> DataFrame:
    """One row per turn: ``conv_id, turn_no, role, piece, begin, example, loss_begin, loss_end``.

    ``piece`` is the formatted turn and ``begin`` the code points before it in
    its conversation.  A turn of the role ``reply`` is the target of the
    example ``example`` (from 0 in its conversation), which is the
    conversation's text up to the end of this piece; ``loss_begin`` and
    ``loss_end`` bound the trainable part of that text.  For other turns the three are null.

    Turns are numbered in the order of ``turn`` (null first); of equal ones by
    role and text, so repeated rows are turns one after another.  A null role
    or text is empty.  A null id is a conversation of its own.  A conversation
    without reply has no example; an empty table gives no rows; columns
    besides the four named play no part, whatever their names.

    A conversation is counted in blocks of ``BLOCK`` turn numbers, so it is spread over tasks however long it is.
    """
    said, spoke = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    rows = (
        turns.select(
            F.col(conv_id).alias("conv_id"),
            F.coalesce(F.col(conv_id).cast("string"), F.lit("")).alias("c"),
            F.col(conv_id).isNull().alias("none"),
            F.col(turn).alias("turn"),
            F.coalesce(F.floor(F.col(turn) / BLOCK), F.lit(-(2**62))).alias("block"),
            spoke.alias("role"),
            said.alias("text"),
            F.concat(F.lit(START), _escaped_role(spoke), F.lit("\n")).alias("head"),
            escaped(said).alias("body"),
        )
        .withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
        .withColumn("chars", F.length("piece").cast("long"))
        .withColumn("replies", (F.col("role") == reply).cast("long"))
    )
    key = ["c", "none"]
    # one row per block, so one per conversation where none is long
    sizes = rows.groupBy(*key, "block").agg(F.count("*").alias("b_turns"), F.sum("chars").alias("b_chars"), F.sum("replies").alias("b_replies"))
    sums = ["turns", "chars", "replies"]
    blocks = W.partitionBy(*key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*key, "block", *[F.sum(f"b_{s}").over(blocks).alias(f"b_{s}") for s in sums]).where("b_turns > 0")
    placed = attach(rows, before, [*key, "block"], "left")

    inside = W.partitionBy(*key, "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    first = {s: F.coalesce(f"b_{s}", nothing) + F.coalesce(F.sum(v).over(inside), nothing) for s, v in (("turns", F.lit(1)), ("chars", F.col("chars")), ("replies", F.col("replies")))}
    found = placed.select("conv_id", "role", "piece", "head", "body", "replies", first["turns"].alias("turn_no"), first["chars"].alias("begin"), first["replies"].alias("no"))
    target = lambda value: F.when(F.col("replies") == 1, value)
    start = F.col("begin") + F.length("head")
    return found.select(
        "conv_id", "turn_no", "role", "piece", "begin",
        target(F.col("no")).alias("example"),
        target(start).alias("loss_begin"),
        target(start + F.length("body")).alias("loss_end"),
    )


def examples(pieces: DataFrame) -> DataFrame:
    """One row per example: ``conv_id, example, n_turns, context_chars, loss_begin, loss_end, n_chars``."""
    return pieces.where("example IS NOT NULL").select(
        "conv_id", "example", (F.col("turn_no") + 1).alias("n_turns"), F.col("begin").alias("context_chars"),
        "loss_begin", "loss_end", (F.col("begin") + F.length("piece")).alias("n_chars"),
    )


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Prefix-target expansion of pieces in order: ``conv_id, example, text, loss_begin, loss_end``.

    Every reply gives the whole text up to its end.  Turns after the last reply are in no example: a
    conversation that ends with such turns also gives its whole text, with null for the other columns.
    """
    none = object()
    conv, text, tail = none, "", False
    for batch in batches:
        for here, piece, example, low, high in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "example", "loss_begin", "loss_end")), strict=True):
            if here != conv:
                if tail:
                    yield conv, None, text, None, None
                conv, text = here, ""
            text += piece
            tail = example is None
            if not tail:
                yield conv, example, text, low, high
    if tail:
        yield conv, None, text, None, None


def whole_examples(pieces: DataFrame) -> DataFrame:
    """The examples written out: ``conv_id, example, text, loss_begin, loss_end`` (the span is in code points of ``text``).

    A conversation is read in order by one task, which holds one example at a time, as a row of the result does.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    names = ["conv_id", "example", "text", "loss_begin", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for row in _expanded(chain([first], batches)):
            if row[1] is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return _in_order(pieces).mapInArrow(run, f"conv_id {kind}, example long, text string, loss_begin long, loss_end long")


class _Reading:
    """A conversation as it is read back, example by example."""

    def __init__(self, conv) -> None:
        self.conv, self.n_turns, self.loss_chars, self.formatted_chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, low: int | None, high: int | None) -> None:
        """The turns of an example after its predecessor's end, and its trainable part."""
        for piece in text[self.formatted_chars :].split(END + "\n")[:-1]:
            role, said = read_turn(piece + END + "\n")
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        self.formatted_chars = len(text)
        if low is not None:
            trained = unescaped(text[low:high])
            self.loss_chars += len(trained)
            self.loss.update(trained.encode())

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def conversation_digests(pieces: DataFrame) -> DataFrame:
    """What is read back from the examples, per conversation.

    The task that expands a conversation reads each example back: its trainable part by its span, its turns by the marks.
    ``formatted_chars`` is the length of the longest text, that of the whole conversation.  Of a conversation one
    example at a time and the hashes' states are held.
    """
    kind = dict(pieces.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        reading, done = None, []

        def rows() -> pa.RecordBatch:
            found = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(found, names)

        for conv, _, text, low, high in _expanded(chain([first], batches)):
            if reading is None or conv != reading.conv:
                if reading is not None:
                    done.append(reading.row())
                reading = _Reading(conv)
            reading.add(text, low, high)
            if len(done) >= BLOCK:
                yield rows()
        if reading is not None:
            done.append(reading.row())
            yield rows()

    return _in_order(pieces).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


# A text that would end its turn and begin another one, were it not escaped.
PROBE = "<|im_end|><|im_start|>assistant ok"


def oracle_sql() -> str:
    bare = len(START) + len(END) + 2
    return rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, '{REPLY}', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{REPLY}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{REPLY}'), '')) AS loss_sha256,
  CAST(sum({bare} + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
