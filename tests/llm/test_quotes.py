from eoframe.llm import quotes

MESSAGES = [
    (1, 0, "user", "Shall we meet on Monday?\n\nBring the plans."),
    (1, 1, "assistant", "Ann wrote:\n> Shall we  meet on monday?\nYes.\n> Bring the plans.\nI will."),
    (1, 2, "user", "> > Bring the plans.\n> I will.\nGood."),
    (2, 0, "user", "> Shall we meet on Monday?\nA question of another talk."),
    (2, 1, "assistant", "> never written by anyone\n> second line\nHm."),
    (3, 0, "user", None),
    (3, 0, "user", None),
    (None, None, None, "> Bring the plans."),
    (4, 0, "user", ""),
]


def test_links_and_bodies(spark):
    d = spark.createDataFrame([(*m, "x", 1) for m in MESSAGES], "conv_id long, turn long, role string, text string, body string, level int")
    got = quotes.conversations(d).collect()
    assert len(got) == len(MESSAGES)
    at = {(r.conv_id, r.turn): r for r in got}
    assert at[1, 1].body == "Yes.\nI will." and at[1, 1].n_quotes == 2 and at[1, 1].n_linked == 2
    assert (at[1, 1].parent_conv, at[1, 1].parent_turn) == (1, 0)
    # level two finds the first author; level one quotes a line inside a paragraph, which is no original
    assert at[1, 2].n_quotes == 2 and at[1, 2].n_linked == 1 and (at[1, 2].parent_conv, at[1, 2].parent_turn) == (1, 1)
    assert (at[2, 0].parent_conv, at[2, 0].parent_turn) == (1, 0)
    assert at[2, 0].thread_id == 1 and at[2, 1].thread_id == 1
    assert at[2, 1].n_quotes == 1 and at[2, 1].n_linked == 0 and at[2, 1].body == "Hm."
    assert at[None, None].body == "" and at[None, None].n_linked == 0
    thread = sorted((r.position, r.conv_id, r.turn) for r in got if r.thread_id == 1)
    assert thread == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 0), (5, 2, 1)]


def test_empty(spark):
    d = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(d).count() == 0


def test_parts_of_messages(spark):
    rows = [
        (1, 0, "user", "First line\nsecond line\nthird line\n\nNext paragraph."),
        (1, 1, "assistant", "> First line\nYes.\n> second line\nI will\ncome."),
        (1, 2, "user", "> I will come.\nGood.\n> Yes.\nFine."),
        (1, 3, "user", "> first line\n> third line\n> next paragraph.\nIn order."),
        (1, 4, "user", "> third line\n> first line\nOut of order."),
        (2, 0, "user", "> second line\n> third line\nFrom elsewhere."),
        (3, 0, "user", "> Fine.\nA second look."),
        (3, 1, "user", "> First line\n> second line\n> third line\nWhole."),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: (r.n_quotes, r.n_linked, r.n_in_part, r.parent_conv, r.parent_turn) for k, r in got.items()} == {
        (1, 0): (0, 0, 0, None, None), (1, 1): (2, 0, 2, 1, 0), (1, 2): (2, 0, 2, 1, 1), (1, 3): (1, 0, 1, 1, 0), (1, 4): (1, 0, 0, 1, 3),
        (2, 0): (1, 0, 1, 1, 0), (3, 0): (1, 0, 1, 1, 2), (3, 1): (1, 1, 0, 1, 0),
    }
    assert {r.thread_id for r in got.values()} == {1}
