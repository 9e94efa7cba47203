import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from lumenlex.llm import chat as C
from lumenlex.llm import tokens

SCHEMA = "conv_id long, turn long, role string, text string"


def test_escaping_is_reversible():
    parts, r = ["<", "|turn|>", "\\", "</s>", "[INST]", "s>", "<s>", "<\\s>", "[", "/INST]", "x", "<|end|>", "<<SYS>>"], random.Random(2)
    for _ in range(5000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        safe = C.escape(text)
        assert C.unescape(safe) == text and not any(c in safe for c in C.CONTROLS)


def brute(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for *_, r, t in turns if r == "assistant")
        chars = sum(sum(map(len, C.MARKS)) + len(C.escape(r)) + len(C.escape(t)) for *_, r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(learned), sha(learned), chars))
    return sorted(out, key=str)


def test_read_back(spark):
    rows = [
        *C.PLANTED, (1, 0, "system", "be <s>kind</s>"), (1, 2, "assistant", "漢字 <|turn|> <\\|turn|>"), (1, 1, "user", None), (1, 3, "assistant", ""), (2, 0, None, "x"),
        (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, "user", "same"), (None, None, "assistant", "who " * 4000), (4, 0, "<|body|>", "role"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("turns", "role_ids", "input_ids")})
    assert sorted((tuple(r) for r in C.digests(C.format_chats(df)).collect()), key=str) == brute(rows)
    assert C.digests(C.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []


def test_mask_covers_assistant_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general text")], SCHEMA)
    row = C.format_chats(df).first()
    ids, mask = np.array(row["input_ids"]), np.array(row["loss_mask"], bool)
    table = tokens.load(tokens.default_files()).token_bytes()
    assert (ids[mask] < len(table)).all()
    assert b"".join(table[i] for i in ids[mask]).decode() == "general text"
    assert [int(i) - len(table) for i in ids[ids >= len(table)]] == [0, 1, 2, 0, 1, 2]
