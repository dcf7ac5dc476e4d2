"""The chat query against its SQL on conversations that quote: branching, nested, re-wrapped and unknown quotes."""

import random

import duckdb
import pandas as pd
import pytest

from vigil.llm import chat, oracle
from vigil.llm.common import prepare

WORDS = "build the shard index Later, fails again? merge window skew Plan é ok yes".split()


def said(r):
    paragraphs = ["\n".join(" ".join(r.choices(WORDS, k=r.randint(1, 5))) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 3))]
    return r.choice(["\n\n", "\n \n"]).join(paragraphs)


def quote(r, text):
    words = text.split(" ")
    if r.random() < 0.4:  # wrapped anew
        text = " ".join(words).replace("\n", " ")
        at = r.randint(0, len(words))
        text = " ".join(text.split(" ")[:at]) + "\n" + " ".join(text.split(" ")[at:])
    elif r.random() < 0.4:
        text = r.choice(text.split("\n\n"))
    mark = r.choice(["> ", ">", " > "])
    return "\n".join(mark + x for x in text.split("\n"))


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(12):
        texts = []
        for turn in sorted(r.sample(range(3000), r.randint(1, 40))):
            text = said(r)
            for _ in range(r.randint(0, 2)):
                if texts:
                    text = quote(r, r.choice(texts)) + "\n" + text
            if r.random() < 0.1:
                text = "> nobody said this\n" + text
            texts.append(text)
            rows.append((conv, turn, r.choice(["user", "assistant"]), text))
            if r.random() < 0.1:
                rows.append((conv, turn, "tool", r.choice([None, "", said(r), text])))
    return rows + rows[::9] + [(None, 1, "user", "x"), (1, None, "user", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_sql_where_messages_quote(spark, seed):
    prepare(spark)
    rows = conversations(seed)
    got = chat.op8(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(oracle.OP8).df()
    columns = ["conv_id", "segment", "n_messages", "n_linked", "parent_turns", "chat"]
    rows_of = lambda df: sorted(tuple(x) for x in df[columns].itertuples(index=False))
    assert rows_of(got) == rows_of(want)
    linked = sum(x[3] for x in rows_of(got))
    ordered = sum(x[4] == ",".join(sorted(x[4].split(","), key=lambda t: int(t or -1))) for x in rows_of(got))
    assert linked > 50 and ordered < len(got)
