import random

import duckdb
import pytest

from cohortloom.llm import catalog, threads

COLUMNS = ["conv_id", "position", "turn", "role", "reply_to", "linked", "n_quoted", "text"]


def talk(seed):
    """Random conversations in which messages quote runs of earlier lines at one to three levels."""
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(12), None]:
        said = []
        for turn in range(rnd.randint(1, 14)):
            lines = [f"Line {conv} {turn} {i}" if rnd.random() < 0.8 else "common line" for i in range(rnd.randint(0, 6))]
            for _ in range(rnd.choice([0, 0, 1, 2])):
                if said:
                    earlier = rnd.choice(said) or [""]
                    start, marks = rnd.randrange(len(earlier)), rnd.choice(["> ", ">", " >  > ", ">>> "])
                    passage = [marks + rnd.choice([str.upper, str])(line) for line in earlier[start:start + rnd.randint(1, 5)]]
                    if rnd.random() < 0.2:
                        passage.insert(1, marks)
                    at = rnd.randint(0, len(lines))
                    lines[at:at] = passage
            said.append(lines)
            rows.append((conv, turn, rnd.choice(["user", "assistant"]), "\n".join(lines) if lines or rnd.random() < 0.5 else None))
    return rows


def expected(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    cur = con.execute(f"select {', '.join(COLUMNS)} from ({catalog.ORACLES['op8_reply_order']})")
    return sorted(cur.fetchall(), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_quotes_match_a_recursive_query(spark, seed):
    rows = talk(seed)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = threads.reply_order(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert any(r.linked for r in got) and any(r.position != i for i, r in enumerate(got))


def test_long_conversation_is_sliced(spark, tiny_slices):
    rows = talk(5)
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = threads.reply_order(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_a_passage_outweighs_a_common_line(spark):
    rows = [(1, 0, "a", "ok\nthanks"), (1, 1, "b", "first\nok\nsecond\nthird"), (1, 2, "a", "ok"), (1, 3, "b", "ok\nfirst"),
            (1, 4, "c", "> First\n>\n> ok\n>  second\nagreed"),  # whole passage: message 2, though message 1 says ok first
            (1, 5, "d", "> ok\n\n> thanks\nyes"),  # two passages of one line, both of message 1
            (1, 6, "e", ">> ok\n>> second\n> agreed\nso"),  # the least nested level decides
            (1, 7, "f", "> ok\n> changed\n> third\nhm")]  # falls back to single lines, the latest origin
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in threads.reply_order(docs).collect()}
    assert [got[t].reply_to for t in (4, 5, 6, 7)] == [2, 1, 5, 2] and all(got[t].linked for t in (4, 5, 6, 7))
    assert [got[t].text for t in (4, 5, 6)] == ["agreed", "\nyes", "so"] and got[4].n_quoted == 4
    assert sorted(map(tuple, (r[:] for r in threads.reply_order(docs).select(*COLUMNS).collect())), key=repr) == expected(rows)


def test_long_passage_is_found_by_doubling(spark):
    lines = [f"line {i % 7} {i // 3}" for i in range(300)]
    rows = [(1, 0, "a", "\n".join(lines[100:140])), (1, 1, "b", "\n".join(lines)), (1, 2, "c", "\n".join("> " + line for line in lines[50:250]))]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in threads.reply_order(docs).collect()}
    assert got[2].reply_to == 2 and got[2].linked and got[2].n_quoted == 200


def test_edge_cases(spark):
    rows = [(1, None, "a", "x"), (1, 0, "b", "> x\nreply"), (1, 0, "b", "> x\nreply"), (1, 2, "c", "> never said"), (2, 0, "d", None), (2, 1, "d", "")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {(r.conv_id, r.position): r for r in threads.reply_order(docs).collect()}
    assert len(got) == 6
    assert got[1, 1].turn is None and got[1, 2].reply_to == 1 and got[1, 2].text == "reply"
    assert [got[1, p].linked for p in (1, 2, 3, 4)] == [False, True, False, True] or [got[1, p].linked for p in (1, 2, 3, 4)] == [False, True, True, False]
    assert sum(r.n_quoted for r in got.values()) == 3 and got[2, 1].text == got[2, 2].text == ""
    assert threads.reply_order(docs.where("false")).count() == 0
