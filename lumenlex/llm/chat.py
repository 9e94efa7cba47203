"""Chat formatting by token-level assembly.

Roles and texts are encoded each for itself, so no token straddles a turn. Reserved ids beyond the vocabulary are
spliced between them: TURN role BODY text END. The loss mask comes from prefix sums over the segments' lengths and
covers the ids of assistant texts, nothing else. Control strings inside a role or text are escaped by a backslash
after their first character; a string that already looks escaped gets one more, so removing one restores it.

Encoding is a map over the rows. Only then do a conversation's rows meet, as each conversation is one output row.

Defined results: NULL text or role is empty. Turns are ordered by turn (NULL first), then role, then text, so ties
and repeated rows have a place each. A NULL conv_id is a conversation. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlex.llm import tokens

MARKS = ("<|turn|>", "<|body|>", "<|end|>")
#: The template's own control strings and those of other common templates.
CONTROLS = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def _pattern(slashes: str) -> str:
    return "|".join(f"{re.escape(c[0])}{slashes}{re.escape(c[1:])}" for c in CONTROLS)


ESCAPE, UNESCAPE = re.compile(_pattern(r"\\*")), re.compile(_pattern(r"\\+"))


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def encode_turns(rows: DataFrame, files: tuple[str, str]) -> DataFrame:
    """conv_id, turn, role, text, and the ids of both as packed 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(files)
        for b in batches:
            ids = [pa.array([bpe.encode(escape(x or "")) for x in b.column(c).to_pylist()], pa.binary()) for c in ("role", "text")]
            yield pa.RecordBatch.from_arrays([*b.columns, *ids], names=["conv_id", "turn", "role", "text", "role_ids", "text_ids"])

    picked = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "conv_id long, turn long, role string, text string, role_ids binary, text_ids binary")


def format_chats(rows: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """One row for each conversation: conv_id, input_ids, loss_mask (1 under the loss)."""
    files = files or tokens.default_files()
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "role_ids", "text_ids")
    grouped = encode_turns(rows, files).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    slim = grouped.select("conv_id", F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("learn"), t["role_ids"].alias("role_ids"), t["text_ids"].alias("text_ids"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = len(tokens.load(files).token_bytes())
        marks = [np.array([first + i], "<i4").tobytes() for i in range(3)]
        for b in batches:
            for i in range(b.num_rows):
                turns = b.column("turns")[i].as_py()
                parts = [p for t in turns for p in (marks[0], t["role_ids"], marks[1], t["text_ids"], marks[2])]
                ids = np.frombuffer(b"".join(parts), "<i4")
                learn = np.zeros(len(parts), bool)
                learn[3::5] = [t["learn"] for t in turns]
                ends = np.cumsum([len(p) // 4 for p in parts])  # prefix sums: a segment lies between two of them
                steps = np.zeros(len(ids) + 1, np.int32)
                np.add.at(steps, (ends - [len(p) // 4 for p in parts])[learn], 1)
                np.add.at(steps, ends[learn], -1)
                mask = np.cumsum(steps[:-1]).astype(np.int8)
                offsets = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("conv_id").slice(i, 1), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                    names=["conv_id", "input_ids", "loss_mask"],
                )

    return slim.mapInArrow(_merged(run), "conv_id long, input_ids array<int>, loss_mask array<tinyint>")


def _merged(run, rows: int = 512):
    """Joins the small batches that run yields."""

    def out(batches):
        held = []
        for b in run(batches):
            held.append(b)
            if len(held) == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def read_back(ids: np.ndarray, mask: np.ndarray, table: list[bytes]) -> tuple[list[tuple[str, str]], str, int]:
    """(role, text) of each turn, the text under the mask, and the code points of the formatted text."""
    first = len(table)
    cuts = np.flatnonzero(ids >= first)
    turns, learned, chars = [], [], sum(len(MARKS[int(ids[c]) - first]) for c in cuts)
    spell = lambda a: b"".join(table[i] for i in a.tolist()).decode("utf-8", "replace")
    for at, mid, end in cuts.reshape(-1, 3):
        role, text = spell(ids[at + 1 : mid]), spell(ids[mid + 1 : end])
        chars += len(role) + len(text)
        turns.append((unescape(role), unescape(text)))
        under = mask[mid + 1 : end].astype(bool)
        if under.any():
            learned.append(unescape(spell(ids[mid + 1 : end][under])))
    return turns, "".join(learned), chars


def digests(formatted: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """What op8 returns, read back from the ids and the mask alone."""
    files = files or tokens.default_files()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.load(files).token_bytes()
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for conv, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("input_ids"), b.column("loss_mask"), strict=True):
                turns, learned, chars = read_back(ids.values.to_numpy(), mask.values.to_numpy(), table)
                rows.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), chars))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: one row for each conversation, conversation -7 included."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(more)))


_SQL_ESCAPE = _pattern(r"\\*").replace("'", "''")
ORACLE = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({sum(map(len, MARKS))} + length(role) + length(text) + len(regexp_extract_all(role, '{_SQL_ESCAPE}')) + len(regexp_extract_all(text, '{_SQL_ESCAPE}'))) AS formatted_chars
FROM c GROUP BY conv_id"""
