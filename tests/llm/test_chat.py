import hashlib
import random
from itertools import groupby

from pricewatch.llm import chat


def test_round_trip_of_hostile_turns():
    rng = random.Random(1)
    parts = [*chat._CONTROLS, "\\", "\\\\", " ", "a", "[", "]", "<", ">", "|", "/", "\n", "é", "INST", "s>"]
    roles = ["user", "assistant", "system", "", "tool", "x|>", "<|role:", "\\|>", "|", "a\\", " |> "]
    for _ in range(5000):
        turns = [(rng.choice(roles), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for _ in range(3)]
        rendered = "".join(chat.render_turn(r, t) for r, t in turns)
        assert [t[:2] for t in chat.parse(rendered)] == turns


def test_only_conflicting_text_is_escaped():
    assert chat.render_turn("user", "a \\ b [ok]") == "[INST] a \\ b [ok] [/INST]"
    assert chat.render_turn("user", "</s>") == "[INST] \\</s> [/INST]"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_digests_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (900, None, None, None),
             (900, 1, "tool", ""), (None, 0, "user", "no id"), (901, 1, "user", "tie b"), (901, 1, "user", "tie a"),
             (901, 1, "user", "tie a"), (902, 0, "assistant", "<|role: x |> y <|/role|>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")
    want = []
    for conv, turns in groupby(sorted(rows, key=order), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        said = [t for r, t in turns if r == "assistant"]
        want.append((conv, len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, said)), sha(said),
                     sum(len(chat.render_turn(r, t)) for r, t in turns)))
    got = chat.conversation_digests(chat.format_turns(df)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).where("conv_id is not null").count() == 0
