"""Chat formatting at the level of tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .tokens import byte_bpe, byte_decode

#: The template: TURN role TEXT text END for each turn, each mark one reserved id beyond the vocabulary.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
FIRST_RESERVED = 50_257
#: Control strings, this template's and other wide-spread ones; none overlaps another. In contents a backslash parts each after its first character.
CONTROLS = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
FORMATTED = "conv_id long, ids array<int>, loss_mask array<boolean>, formatted string"


def escape(text: str) -> str:
    """No control string occurs in the result, and unescape() gives the text back."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = byte_bpe()
    mark = {m: np.array([FIRST_RESERVED + k], np.uint32) for k, m in enumerate(MARKS)}
    for batch in batches:
        rows = []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
            segments, learnt, said = [], [], []
            for t in turns:
                role, text = escape(t["role"]), escape(t["text"])
                segments += [mark[TURN], encode(role), mark[TEXT], encode(text), mark[END]]
                learnt += [0, 0, 0, int(t["role"] == "assistant"), 0]
                said += [TURN, role, TEXT, text, END]
            ends = np.cumsum([len(s) for s in segments], dtype=np.int64)
            step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)  # +1 where a learnt segment starts, -1 where it ends
            on = np.flatnonzero(learnt)
            sizes = np.array([len(s) for s in segments], np.int64)
            np.add.at(step, ends[on] - sizes[on], 1)
            np.add.at(step, ends[on], -1)
            rows.append((conv, np.concatenate(segments).astype(np.int32), np.cumsum(step)[:-1] > 0, "".join(said)))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.string()), strict=True)], ["conv_id", "ids", "loss_mask", "formatted"])


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, ids (tokens), loss_mask (true on the tokens of assistants' texts), formatted (the text that ids say).

    Segments are encoded each on its own and joined by reserved ids, so no text can spell a mark; the mask comes from the segments'
    lengths by prefix sums. Contents are escaped, reversibly.

    Rows go by turn (null first), then role, then text, so ties and repeated rows have a fixed order; each stays. Null roles and
    texts are empty. Rows with a null conv_id are one conversation. A conversation is one row, so it must fit into a task.
    An empty table gives no rows.
    """
    own = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")).mapInArrow(_format, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What ids and loss_mask say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = byte_decode()
        for batch in batches:
            rows = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask"), strict=True):
                ids, mask = np.asarray(ids.values), mask.values.to_numpy(zero_copy_only=False)
                marks = np.flatnonzero(ids >= FIRST_RESERVED)
                turns, learnt, n, chars = hashlib.sha256(), [], 0, 0
                for at, to in zip(marks, [*marks[1:], len(ids)], strict=True):
                    own = decode(ids[at + 1 : to])
                    name = MARKS[ids[at] - FIRST_RESERVED]
                    chars += len(name) + len(own)
                    n += name == TURN
                    if name != END:
                        turns.update((unescape(own) + "\n").encode())
                    if to > at + 1 and mask[at + 1 : to].any():
                        learnt.append(unescape(decode(ids[at + 1 : to][mask[at + 1 : to]])))
                loss = "".join(learnt)
                rows.append((conv, n, turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "ids", "loss_mask").mapInArrow(back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)))


def _escaped_sql(col: str) -> str:
    out = rf"replace({col}, '\', '\\')"
    for c in CONTROLS:
        out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
    return out


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {sum(map(len, MARKS))})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
