import hashlib
import itertools
import random

import pytest
from faultline.llm import chatformat
from faultline.llm.chatformat import Template
from pyspark.sql import functions as F

MARKS = Template().marks


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    odd = [*MARKS, "\\", "\\\\", " ", "\n", "<", "</", "s>", "[", "/INST]", "é😀", "$1", "ok", "<</", "\\</s>"]
    text = lambda: "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 12)))
    out = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(60):
        roles = [rnd.choice(["system", "user", "assistant", "assistant", "tool", "", "<is>", "a <is> b\\", None]) for _ in range(rnd.randint(1, 9))]
        out += [(c, i, r, rnd.choice([None, text(), text(), text()])) for i, r in enumerate(roles)]
    out += [(100, i, "assistant" if i % 3 else "user", f"t{i} é") for i in range(1500)]
    out += [(101, i, "assistant", "x" * (i % 7)) for i in range(700)]
    out += [(102, 0, "user", "long " * 200_000), (102, 1, "assistant", "</s>" * 100_000 + "\\" * 50_000)]
    out += [(None, 1, "assistant", "two"), (None, 0, "user", "one"), (103, None, "user", "first"), (103, 0, "assistant", "same"), (103, 0, "assistant", "same")]
    return out


@pytest.fixture(scope="module")
def chats(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, blocks int")
    return chatformat.format_chats(df.repartition(5))


def grouped(rows):
    key = lambda r: (r[0] is None, r[0] or 0)
    order = sorted(rows, key=lambda r: (key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return {k[1] if not k[0] else None: [(r[2] or "", r[3] or "") for r in g] for k, g in itertools.groupby(order, key)}


def test_digests_equal_the_turns(chats, rows):
    want = {}
    for conv, turns in grouped(rows).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatformat.chat_digests(chats).collect()}
    assert got == want


def test_blocks_tile_the_string_and_the_mask_holds_each_learned_text(chats, rows):
    turns = grouped(rows)
    for r in chats.collect():
        at, learned = 0, []
        for b, (role, own) in zip(r.blocks, itertools.groupby(turns[r.conv_id], lambda t: t[0]), strict=True):
            assert b.start == at
            at += b.length
            learned += [r.formatted[b.start + s.start : b.start + s.end] for s in b.loss]
            assert len(b.loss) == (len(list(own)) if role == "assistant" else 0)
        assert at == len(r.formatted)
        plain = [t for role, t in turns[r.conv_id] if role == "assistant"]
        for x, t in zip(learned, plain, strict=True):
            for m in MARKS:
                x = x.replace("\\" + m, m)
            assert x == t


def test_marks_and_escapes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "</s>b"), (1, 2, "assistant", "\\[INST]"), (1, 3, "tool", "")], "conv_id long, turn long, role string, text string")
    row = chatformat.format_chats(df).first()
    assert row.formatted == "[INST] a <turn> \\</s>b [/INST]<s> \\\\[INST] </s><role> tool <is>  </role>"
    assert chatformat.format_chats(df.limit(0)).isEmpty()


def test_running_sums(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda x: x.cast("long")).alias("x"))
    got = df.select(chatformat.running_sums(F.col("x")).alias("s")).first().s
    assert got == [i * (i + 1) // 2 for i in range(1000)]
    assert df.select(chatformat.running_sums(F.filter("x", lambda x: x < 0)).alias("s")).first().s == []


def test_no_python_workers(chats):
    plan = chatformat.chat_digests(chats)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
