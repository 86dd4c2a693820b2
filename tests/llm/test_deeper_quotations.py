"""Quotations of which only a deeper level has an original."""

import random

from tactuslab.llm import chat


def test_reply_to_takes_the_shallowest_level_with_an_original(spark):
    rows = [
        (1, 0, "user", "How do I sort?"),
        (1, 1, "assistant", "Use sort."),
        (1, 2, "user", "Something else"),
        (1, 3, "user", "> reworded\n> > Use sort.\n> > > How do I sort?\nThanks"),
        (1, 4, "user", "> Something else\n> > Use sort. \n> > How do I sort?\nYes"),
        (1, 5, "user", "> gone\n> > also gone\nNo"),
    ]
    out = chat.link_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r["turn"]: (r["reply_to"], r["by_quote"]) for r in out} == {0: (None, False), 1: (0, False), 2: (1, False), 3: (1, True), 4: (2, True), 5: (4, False)}


def order(rows):
    """Positions by walking down the replies."""
    at, children = {}, {}
    for r in rows:
        children.setdefault((r["conv_id"], r["reply_to"]), []).append(r["turn"])

    def walk(conv, turn):
        at[conv, turn] = sum(1 for c, _ in at if c == conv)
        for t in sorted(children.get((conv, turn), [])):
            walk(conv, t)

    for conv in {r["conv_id"] for r in rows}:
        for t in sorted(children.get((conv, None), [])):
            walk(conv, t)
    return at


def test_passages_with_other_line_breaks_and_branches(spark):
    rows = [
        (1, 0, "user", "One long line that is\nbroken here\n\nand another paragraph"),
        (1, 1, "assistant", "First answer"),
        (1, 2, "user", "> One long line\n> that is broken here\nOther answer"),
        (1, 3, "user", "> First answer\nto one"),
        (1, 4, "user", "> Other answer\nto two"),
        (1, 5, "user", "> and another paragraph\nthird answer"),
        (1, 9, "user", "another root"),
    ]
    rng = random.Random(3)
    rows += [(2, k, "user", (f"> m{rng.randrange(k)}\n" if k and rng.random() < 0.8 else "") + f"m{k}") for k in range(60)]
    rows += [(3, k, "user", ("> m0\n" if k else "") + f"m{k}") for k in range(40)]
    out = chat.link_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = out.collect()
    assert {r["turn"]: r["reply_to"] for r in got if r["conv_id"] == 1} == {0: None, 1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 9: None}
    assert {(r["conv_id"], r["turn"]): r["position"] for r in got} == order(got)
    assert {r["depth"] for r in got if r["conv_id"] == 3} == {0, 1}
    texts = {(r["conv_id"], r["root"]): r["text"] for r in chat.write_threads(out).collect()}
    assert [x for x in texts[1, 0].split("\n") if x and x[0] != "<"][3:] == ["First answer", "to one", "Other answer", "to two", "third answer"]
