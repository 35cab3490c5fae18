from collections import Counter

from slotwise.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, h1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def plain(rows, part=64):
    convs = {}
    for c, t, r, x in dict.fromkeys(rows):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(vs)] for c, vs in convs.items()}
    out = {}
    for c, turns in convs.items():
        if any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values()) or any(o == turns and k < c for k, o in convs.items()):
            continue
        same = sum(o == turns for o in convs.values())
        for p in range(0, len(turns), part):
            out[c, p // part] = (len(turns), same, p, "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in turns[p : p + part]))
    return out


def got(df):
    return {(r.conv_id, r.part): (r.n_turns, r.collapsed, r.first_turn, r.text) for r in df.collect()}


def test_snapshots(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 5, "user", "a"), (3, 6, "assistant", "b"), (3, 9, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "x")]
    rows += [(5, 0, "user", "z"), (6, 0, "user", "z"), (6, 0, "user", "z"), (7, 0, None, None), (8, None, "user", ""), (None, 0, "user", "lost"), (9, 0, "user", "ab"), (10, 0, "userab", "")]
    rows += [(20, t, "user", f"turn {t}") for t in range(150)] + [(21, t, "user", f"turn {t}") for t in range(149)]
    assert got(chat.rendered(table(spark, rows))) == plain(rows)


def test_ties_of_turn_numbers_are_stable(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 1, "user", "c")]
    out = got(chat.rendered(table(spark, rows)))
    assert [k[0] for k in out] == [2] and Counter(out[2, 0][3]) == Counter(plain(rows)[2, 0][3])


def test_query(spark, empty):
    assert chat.op2_chat(spark, empty).count() == 0
