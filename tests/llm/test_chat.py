"""Chat formatting: round trips, the machine, and its SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from quern.llm import chat, oracle

PARTS = ["<|im_start|>", "<|im_end|>", "<|", "<", "|", "\\", "\\\\", "\n", "\\n", "a", "é", "assistant", " ", "🙂", "<\\|"]


def rows(seed=7):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, n)))
    out = []
    for c in range(60):
        order = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(1, 4)
        if c % 4 == 0:
            order += rng.choice([["user"], ["tool"], ["assistant"], [say(5)]])
        out += [(c, i, r, say(12)) for i, r in enumerate(order)]
    out += [(100, 0, None, None), (None, 1, "user", "x"), (None, 0, "system", "y"), (101, None, "user", "first"), (101, 0, "assistant", ""), (102, 0, "user", "tie"), (102, 0, "assistant", "tie"), (103, 0, "user", "same"), (103, 0, "user", "same")]
    rng.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, formatted string").repartition(3)


def test_round_trip_and_machine(spark):
    data = rows()
    got = chat.format_chats(frame(spark, data)).withColumn("turns", chat.read_chats(F.col("formatted"))).collect()
    want = {}
    for c, t, r, x in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        said = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert len([s for s in r.segments if s.loss]) == len(said)
        roles = [x for x, _ in want[r.conv_id]]
        core = roles[1:] if roles[0] == "system" else roles
        assert r.valid == (bool(core) and len(core) % 2 == 0 and core == ["user", "assistant"] * (len(core) // 2))
        assert r.formatted.count("<|im_start|>") == len(roles) == r.formatted.count("<|im_end|>")


def test_against_sql(spark, tmp_path):
    frame(spark, rows(8)).drop("formatted").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(oracle.CHAT).fetchall()
    got = [tuple(r) for r in chat.op5_chat(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert chat.format_chats(frame(spark, rows()).limit(0)).collect() == []
