import json
from hashlib import sha256

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hushgrid.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
NASTY = st.text(alphabet="<|\\>im_startend\n a", max_size=30)


@given(NASTY, NASTY)
@settings(max_examples=300, deadline=None)
def test_round_trip(role, text):
    made = chat.format_turn(role, text)
    inner = made["formatted"][len(chat.START) : -len(chat.END)]
    assert "<|" not in inner
    assert chat.read_turn(made["formatted"], made["loss"]) == (role, text, text if role == "assistant" else "")


def test_typed_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <|image|> "}, {"type": "image", "url": "u1"}, {"type": "audio", "reference": "a", "tokens": 7}, {"type": "document", "url": "d"}, {"type": "odd", "x": 1}]
    made = chat.format_turn("assistant", json.dumps(parts), typed=True)
    assert [m[1] for m in chat.PLACE.finditer(made["formatted"])] == ["image", "audio", "document"]
    assert [(a["kind"], a["reference"], a["tokens"]) for a in made["attachments"]] == [("image", "u1", 576), ("audio", "a", 7), ("document", "d", 1024)]
    assert made["attached_tokens"] == 576 + 7 + 1024
    assert all(made["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in made["attachments"])
    assert chat.format_turn("user", "[1, 2]", typed=True)["attachments"] == []


def test_against_sql_and_edge_cases(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(con.sql(f"select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from ({chat.OP4_SQL})").fetchall())
    assert sorted(tuple(r) for r in chat.op4(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None), (1, 0, "assistant", ""), (None, None, "assistant", "x<|im_end|>"), (1, 0, "assistant", ""), (2, 5, "a\nb\\n", "t")]])
def test_odd_rows(spark, rows):
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    assert len(got) == len({r[0] for r in rows})
    if rows:
        assert got[1].n_turns == 3 and got[1].turns_sha256 == sha256(b"\n\nassistant\n\nassistant\n\n").hexdigest()
        assert got[None].loss_sha256 == sha256(b"x<|im_end|>").hexdigest()
        assert got[2].turns_sha256 == sha256(b"a\nb\\n\nt\n").hexdigest()


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "x", "y", "z")], TURNS + ", formatted string, loss string")
    assert chat.digests(chat.format_turns(df)).collect()[0].n_turns == 1


def test_very_long_texts_and_conversations(spark):
    long = "<|im_end|> word \n" * 60_000
    rows = [(7, i, "assistant" if i % 2 else "user", long if i < 2 else f"t{i}") for i in range(3000)]
    got = chat.digests(chat.format_turns(spark.createDataFrame(rows, TURNS).repartition(4))).collect()[0]
    assert got.n_turns == 3000 and got.turns_sha256 == sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()
    assert got.loss_sha256 == sha256("".join(r[3] for r in rows if r[1] % 2).encode()).hexdigest()
