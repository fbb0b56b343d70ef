import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from landweave.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "-", "<", "/", "s>", "[", "]", "INST", "<s>", "</s>", "[INST]", "[/ROLE]", "[ASST]", "é", "\n", "x", "<<SYS>>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "[ROLE]"]), PIECES), max_size=5))
def test_round_trip_and_no_control_string_in_texts(turns):
    t = chat.Template()
    w, r = chat.Writer(t), chat.Reader(t)
    parts = [w.segments(role, text) for role, text in turns]
    assert list(r.turns("".join(s for p in parts for s, _ in p))) == turns
    assert not any(c in p[1][0] for p in parts for c in t.controls())


def plain(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        said = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said)))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r)[:5] for r in chat.digest(df).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert run(df) == plain([*(tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()), *chat.PROBE])


def test_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "user", "long " * 100000), (5, None, "tool", "\\-"), (5, 2, "assistant", "[/ASST]</s>")]
    rows += [(6, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, state string, n int")
    assert run(df) == plain([*rows, *chat.PROBE])
    assert run(df.limit(0)) == plain(chat.PROBE)
    valid = {r.conv_id: r.valid for r in chat.digest(df).collect()}
    assert valid == {1: True, 2: False, 3: False, None: True, 4: False, 5: False, 6: True, -1: True}
