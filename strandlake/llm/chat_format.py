"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, all turns before it are
its context, and only its reply is trainable.

The context of an example is the whole of the example before it and the turns since. `steps` cuts a conversation so: a
row (`part` numbers them) holds the text that its example adds (the turns since the last reply, then the reply), where
that text begins in the conversation, and the span of the reply. Examples are numbered by replies. Turns after the last
reply make a last row without a target; very many turns before a reply are several rows of its example. `written` expands the steps to the examples: each has its whole context and its reply, in pieces
of a step each, of which only the last has a span for the loss. So what is written grows with the square of a
conversation's turns, but no task holds more than a piece at a time.

Template: `<|im_start|>role`, a line break, the text, `<|im_end|>`, a line break. A control string in a text is escaped
by one more backslash between `<` and `|`, which is undone by taking one away.

Defined results: a null text or role counts as empty; turns are ordered by (turn, role, text), nulls first, so tied and
repeated rows have a fixed order; a null conv_id is a conversation of its own; a turn of any length is one piece; further
columns, of any name, aren't read; an empty table gives no examples. A conversation's turns depend on their order: they
stream through one task, which holds a row's text at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

STEPS = "conv_id long, part int, example int, n_turns int, starts_at long, added string, loss_from int, loss_to int"
START, END = "<|im_start|>", "<|im_end|>"
#: Characters without a reply after which a row ends (and its example goes on in the next one).
LONGEST = 4_000_000
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rendered(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before the text of a turn, the text, and what stands after it. Line breaks in a role are escaped."""
    name = F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), name, F.lit("\n")), escaped(text), F.lit(END + "\n")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_of(name: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name))


def _steps(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to the steps of their examples; one conversation may span batches."""
    conv, begun = None, False
    part = example = turns = at = size = 0
    parts: list[str] = []
    names = [x.split()[0] for x in STEPS.split(", ")]
    out: list[tuple] = []

    def step(loss: tuple[int, int] | None) -> None:
        nonlocal part, example, turns, at, parts, size
        added = "".join(parts)
        out.append((conv, part, example, turns, at, added, *(loss or (None, None))))
        part, at, parts, size = part + 1, at + len(added), [], 0
        if loss:
            example, turns = example + 1, 0

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]

    def flushed() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [[] for _ in names]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    for batch in batches:
        for key, role, before, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or key != conv:
                if parts:
                    step(None)
                conv, begun, part, example, turns, at = key, True, 0, 0, 0, 0
            parts += (before, text, after)
            turns, size = turns + 1, size + len(before) + len(text) + len(after)
            if role == "assistant":
                step((size - len(after) - len(text), size - len(after)))
            elif size > longest:
                step(None)
        yield flushed()
    if parts:
        step(None)
    yield flushed()


def steps(turns: DataFrame, longest: int = LONGEST) -> DataFrame:
    """turns (conv_id, turn, role, text) to STEPS. n_turns: the turns that the example has added with this row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    before, shown, after = rendered(role, text)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), before.alias("before"), shown.alias("shown"), after.alias("after"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "before", "shown", "after").mapInArrow(lambda b: _steps(b, longest), STEPS)


def expanded(examples: DataFrame) -> DataFrame:
    """Examples with a target, written out: conv_id, example, context (all turns before the reply) and target.

    A context is the join of all earlier steps of its conversation, so this grows with the square of its turns: meant
    for the examples of a training step, or for conversations of bounded length."""
    earlier = examples.select(F.col("conv_id").alias("_c"), F.col("part").alias("_e"), F.col("added").alias("_a"))
    targets = examples.where("loss_from IS NOT NULL")
    both = targets.join(earlier, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_e") < F.col("part")), "left")
    one = both.groupBy("conv_id", "example").agg(
        F.first("added").alias("added"), F.first("loss_from").alias("loss_from"), F.first("loss_to").alias("loss_to"),
        F.array_sort(F.collect_list(F.when(F.col("_e").isNotNull(), F.struct("_e", "_a")))).alias("prefix"),
    )
    context = F.concat(F.array_join(F.col("prefix._a"), ""), F.expr("substring(added, 1, loss_from)"))
    return one.select("conv_id", "example", context.alias("context"), F.expr("substring(added, loss_from + 1)").alias("target"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads pieces, sorted by conversation and place, back to turns (of those that are told) and losses; one row a conversation."""
    conv, begun = None, False
    n_turns = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    out: list[tuple] = []
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def end() -> None:
        out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def flushed() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [[] for _ in names]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names)

    for batch in batches:
        for key, added, first, last, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "added", "loss_from", "loss_to", "told")), strict=True):
            if not begun or key != conv:
                if begun:
                    end()
                conv, begun, n_turns, loss_chars, chars = key, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            chars += len(added) if told else 0
            for name, text in TURN.findall(added) if told else ():
                n_turns += 1
                turns.update(f"{role_of(name)}\n{unescape(text)}\n".encode())
            if first is not None:
                reply = unescape(added[first:last])
                loss_chars += len(reply)
                loss.update(reply.encode())
        yield flushed()
    if begun:
        end()
    yield flushed()


def digest(examples: DataFrame) -> DataFrame:
    rows = examples.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.select("conv_id", "added", "loss_from", "loss_to", F.lit(True).alias("told")).mapInArrow(_digest, DIGEST)


def written(examples: DataFrame) -> DataFrame:
    """Stored steps to examples: conv_id, example, part, text, loss_from and loss_to (of the piece that has the reply), told.

    An example with a target has a piece for each step up to its own. Steps after the last target follow as they are.
    told: whether the piece is of a conversation's last example, or after it."""
    targets = examples.where("loss_from IS NOT NULL").select(F.col("conv_id").alias("_c"), F.col("example").alias("_e"), F.col("part").alias("_p"))
    last = targets.groupBy("_c").agg(F.max("_p").alias("_last"))
    ends = targets.join(last.withColumnRenamed("_c", "_d"), F.col("_c").eqNullSafe(F.col("_d"))).select("_c", "_e", "_p", (F.col("_p") == F.col("_last")).alias("told"))
    span = [F.when(F.col("part") == F.col("_p"), F.col(c)).alias(c) for c in ("loss_from", "loss_to")]
    whole = examples.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") <= F.col("_p")))
    whole = whole.select("conv_id", F.col("_e").alias("example"), "part", F.col("added").alias("text"), *span, "told")
    rest = examples.where("loss_from IS NULL").join(last, F.col("conv_id").eqNullSafe(F.col("_c")), "left").where("_last IS NULL OR part > _last")
    return whole.unionByName(rest.select("conv_id", "example", "part", F.col("added").alias("text"), "loss_from", "loss_to", F.lit(True).alias("told")))


def read_back(pieces: DataFrame) -> DataFrame:
    """The digest of written examples: turns from each conversation's last example, each reply from its own example."""
    rows = pieces.where("told OR loss_from IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "example")
    return rows.select("conv_id", F.col("text").alias("added"), "loss_from", "loss_to", "told").mapInArrow(_digest, DIGEST)


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    both = turns.unionByName(more.withColumn("turn", F.col("turn").cast("long")))
    return read_back(stored(written(stored(steps(both), "chat-steps")), "chat-examples"))


ORACLE_SQL = {
    "op9_prefix_targets": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|><|im_end|>') + 2 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
}
QUERIES = {"op9_prefix_targets": op9_prefix_targets}
