import hashlib
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|im_nl|>", "<", "|", "\\", "\n", "<\\|", "<\\\\|", "assistant", "é中", "im_end|>", " a ", "$1", ""]
ROLES = ["user", "assistant", "system", "tool\n<|im_end|>", ""]


def guard(text):
    out = ""
    for i, c in enumerate(text):
        out += c
        rest = text[i + 1 :]
        if c == "<" and rest.lstrip("\\").startswith("|"):
            out += "\\"
    return out


def brute(rows):
    """text, loss spans by characters, turns."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        text, loss = "", []
        for role, group in groupby(turns, key=lambda t: t[1]):
            text += "<|im_start|>" + guard(role).replace("\n", "<|im_nl|>") + "\n"
            for k, (_, _, x) in enumerate(group):
                text += "<|im_sep|>" * (k > 0)
                loss += [(len(text), len(text) + len(guard(x)))] * (role == "assistant")
                text += guard(x)
            text += "<|im_end|>\n"
        out[conv] = text, loss, [(r, x) for _, r, x in turns]
    return out


def conversations(n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, *["".join(rng.choices(BITS, k=rng.randrange(6))) for _ in range(5)]])
    rows = [(c, rng.choice([None, t, t // 2, t * 300]), rng.choice([*ROLES, None]), text()) for c in range(n) for t in range(rng.randrange(1, 14))]
    return [*rows, *rows[::7], (None, 1, "assistant", "<|")]


@pytest.mark.parametrize("run", [1, 3, 512])
def test_matches_brute_force(spark, run):
    rows = conversations(40, run)
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3), segment_turns=run).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        text, loss, _ = want[r.conv_id]
        assert r.text == text
        raw = r.text.encode()
        assert [(len(raw[: s.start].decode()), len(raw[: s.stop].decode())) for s in r.loss_spans] == loss


def test_reads_back_what_was_written(spark):
    rows = conversations(60, 9)
    formatted = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), segment_turns=4)
    want = brute(rows)
    for r in formatted.select("conv_id", chat.read_turns(F.col("text")).alias("turns"), chat.read_loss(F.col("text"), F.col("loss_spans")).alias("loss")).collect():
        turns = want[r.conv_id][2]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(x for role, x in turns if role == "assistant")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in chat.digests(formatted).collect():
        text, _, turns = want[r.conv_id]
        own = [x for role, x in turns if role == "assistant"]
        assert tuple(r)[1:] == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), sum(map(len, own)), digest("".join(own)), len(text))


def test_a_long_conversation_is_collected_in_runs(spark):
    n = 3000
    rows = [(5, t, ("user", "assistant", "assistant")[t % 3], f"text {t} " * 20) for t in range(n)]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r.n_turns, r.formatted_chars) for r in got] == [(n, len(brute(rows)[5][0]))]


def test_empty_table_clashing_columns_and_other_names(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame([(1, 1, "bot", "b", "x"), (1, 0, "user", "a", "y")], "c long, run int, plain string, body string, loss_spans string")
    got = chat.format_conversations(rows, "c", "run", "plain", "body", loss_roles=("bot",)).collect()
    assert [(r.conv_id, r.text, [tuple(s) for s in r.loss_spans]) for r in got] == [(1, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n", [(45, 46)])]


def test_no_python_worker(spark):
    plan = chat.digests(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
