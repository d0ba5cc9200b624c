"""SQL twins on texts that the given tables lack: nested quotations, and repeats across documents."""

import random

import duckdb
import pandas as pd
from conftest import same

from brackwater.llm import chat, suffixes


def test_nested_quotations(spark):
    rng, rows = random.Random(4), []
    for conv in range(40):
        said = []
        for turn in range(rng.randrange(1, 9)):
            lines = [f"{rng.choice(['Thanks', 'We ship it', 'No', 'It is late'])} {rng.randrange(6)}" for _ in range(rng.randrange(1, 4))]
            for old in rng.sample(said, min(len(said), rng.randrange(3))):
                lines[rng.randrange(len(lines)) : 0] = [rng.choice([">", "> ", " >"]) + x for x in old.split("\n")]
            text = "\n".join(lines)
            said.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    rows += [(50, 0, "user", None), (50, 1, "user", ""), (50, 2, None, "> \n>> deep"), (51, 0, "user", "a\n\nb"), (51, 1, "user", "> A\n> B\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.link_conversations(df)
    assert got.filter("n_linked > 0").count() > 20 and got.filter("quote_depth > 1").count() > 5
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    same(got, con, chat.OP4_SQL)


def test_threads_by_row(spark):
    """Several messages of one turn: only the one that quotes joins the thread, and short lines link nothing."""
    rows = [(1, 0, "user", "How do I reset it?"), (1, 1, "user", "What does it cost then?"), (1, 2, "bot", "> How do I reset it?\nHold the button"), (1, 2, "bot", "unrelated"), (1, 3, "user", "> Hold the button\nthanks"), (1, 4, "bot", "thanks\nBye now then"), (1, 5, "user", "> thanks\n> oh well\nhm"), (1, 6, "user", "> unrelated\nwhy"), (1, 2, "bot", "unrelated")]
    rows += [(2, 0, "user", "same words here"), (2, 0, "bot", "same words here"), (2, 0, "bot", "x\nsame words here"), (2, 1, "user", "> same words here\nyes")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(3)
    got = chat.link_conversations(df)
    by = {(r["conv_id"], r["turn"], r["content"]): r for r in got.collect()}
    assert by[1, 2, "Hold the button"]["thread"] == 0 and by[1, 2, "unrelated"]["thread"] == 2 and by[1, 3, "thanks"]["thread"] == 0
    assert by[1, 5, "hm"]["reply_to"] is None and by[1, 6, "why"]["reply_to"] == 2 and by[1, 6, "why"]["thread"] == 2
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    same(got, con, chat.OP4_SQL)


def test_repeats(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcdé \n") for _ in range(rng.choice([49, 50, 51, 90, 1200]))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.6 else str(rng.random()) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, rows[3][1]), (83, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    same(suffixes.deduplicate(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), con, suffixes.OP3_SQL)
