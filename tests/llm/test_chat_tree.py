import hashlib
import random

from tidemark.llm import chat_tree as t


def test_segments_round_trip():
    for role, text in [("user", "a"), ("", ""), ("a>\n", "\\"), ("user", r"\### Assistant: </turn> ok"), ("<turn:x>", "\n</turn>\n<turn:assistant>\n\\\\<"), ("é", "😀" * 3)]:
        s, a, b = t.segment(role, text)
        assert t.parse(s) == (role, text) and t.unescape(s[a:b]) == text


def test_deep_texts_parse():
    text = "<\\>" * 200_000
    assert t.parse(t.segment("user", text)[0]) == ("user", text)


def test_tree_and_reading_back(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(60):
        for k in range(rnd.randint(1, 6)):
            rows.append((c, k, ["user", "assistant"][k % 2], f"<t{rnd.randrange(2)}>", "x"))
    rows += [(70, None, None, None, "x"), (71, 0, "assistant", "", "x"), (None, 0, "user", "n", "x"), (72, 1, "user", "b", "x"), (72, 1, "user", "a", "x"), (72, 1, "user", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    nodes, turns = t.prefix_tree(df)
    got = {r["conv_id"]: r for r in t.read_back(nodes, turns).collect()}
    convs = {}
    for c, k, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turn in convs.items():
        loss = "".join(x for r, x in turn if r == "assistant")
        want = (c, len(turn), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turn).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(t.segment(r, x)[0]) for r, x in turn))
        assert tuple(got[c]) == want
    walk = t.walk(nodes).collect()
    prefixes = {tuple(turn[: k + 1]) for turn in convs.values() for k in range(len(turn))}
    assert len(walk) == len(prefixes)
    at, by = 0, {bytes(r["node"]): r for r in walk}
    stack = []
    for r in walk:  # contiguous, depth first, with the ancestors' stretches
        assert r["start"] == at
        at = r["end"]
        stack = stack[: r["depth"]]
        assert (bytes(r["parent"]) if r["parent"] else None) == (bytes(stack[-1]["node"]) if stack else None)
        assert r["position"] == sum(x["end"] - x["start"] for x in stack)
        seen = {i for a in r["ancestors"] for i in range(a["start"], a["end"])}
        assert seen == {i for x in stack for i in range(x["start"], x["end"])} and len(by) == len(walk)
        stack.append(r)
    none, _ = t.prefix_tree(df.where("false"))
    assert none.count() == 0
