"""Chat formatting: the exact round trip, budgets and masks."""

import brute
import pytest

from bazaarlake.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = r"\<|end|> <|text|>\| <<SYS>> <\s> <</SYS>> </s>[INST] ok [/INST]\\"

ROWS = [
    *((1, i, "system" if not i else ("user", "assistant")[i % 2], f"{ODD} {i}" + " wé😀" * (i * 7)) for i in range(40)),
    (2, 0, "system", "only a system turn"),
    (None, None, None, None),
    (None, 0, "assistant", "x"),
    (None, 0, "assistant", "x"),
    *((3, i, ("user", "assistant")[i % 2], "a " * 3000 if i == 3 else "b") for i in range(6)),  # a long turn
    (4, 0, "system", "s"),
    (4, 0, "system", "s"),
    (4, 1, "assistant", ""),
    (5, 0, f"role {ODD}\n", "\n"),
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("budget", [64, 400, 2048])
def test_round_trip(conversations, budget):
    windows = chat.windows(conversations, budget, budget // 4, budget // 8)
    found = {r[0]: tuple(r)[1:5] for r in chat.conversation_digests(windows).collect()}
    assert found == brute.conversations(ROWS)


def test_windows_keep_the_system_turn_the_budget_and_some_history(conversations):
    made = chat.windows(conversations, 400, 100, 60).where("id = 1").orderBy("window").collect()
    assert len(made) > 3
    for r in made:
        assert r.text.startswith("<|turn|>system<|text|>")
        assert r.over_budget == (r.n_tokens > 400)
    short = [(1, i, "system" if not i else ("user", "assistant")[i % 2], f"turn {i}") for i in range(60)]
    more = chat.windows(conversations.sparkSession.createDataFrame(short, SCHEMA), 160, 20, 40).collect()
    assert len(more) > 3 and all(r.n_context > 2 for r in more if r.window > 1)
    targets = sum(len(r.loss) for r in made)
    assert targets == sum(1 for c, _, role, _ in ROWS if c == 1 and role == "assistant")
    for r in made:
        for span in r.loss:
            own = r.text[span.start : span.start + span.length]
            assert r.text[: span.start].endswith("<|turn|>assistant<|text|>") and "<|" not in own


def test_extra_columns_and_empty_table(spark, conversations):
    from pyspark.sql import functions as F

    extra = conversations.withColumns({n: F.lit("x") for n in ("id", "window", "tokens", "piece", "start", "new", "system")})
    assert chat.windows(extra).count() == chat.windows(conversations).count()
    assert chat.windows(conversations.limit(0)).count() == 0
    assert chat.conversation_digests(chat.windows(conversations.limit(0))).count() == 0


def test_budget_has_to_leave_room(conversations):
    with pytest.raises(ValueError):
        chat.windows(conversations, 100, 60, 40)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    found = queries.op1_chat_format(spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: tuple(r)[1:5] for r in found} == brute.conversations(rows)
    assert all(r.formatted_chars > r.loss_chars for r in found)
