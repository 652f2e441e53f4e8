import hashlib
import random
import re

import pytest

from tests.llm.helpers import rows
from trustlens.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark, data, extra=()):
    cols = ", ".join([SCHEMA, *[f"{n} string" for n in extra]])
    return spark.createDataFrame([(*r, *["?"] * len(extra)) for r in data], cols).repartition(3)


def ordered(data):
    convs = {}
    for c, n, role, text in data:
        convs.setdefault(c, []).append(((n is not None, n or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}


def tokens(text):
    return len(re.findall(r"[^\W\d_]+|\d+|[^\s\w]|_", text)) + C.TURN_TOKENS


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def sample(seed=1):
    rnd = random.Random(seed)
    bits = ["a", "bc", "<", "\\", "\\l", "\\b", "<turn>", "</turn>", "<text>", "é", "\n", " ", "12", "!"]
    data = []
    for c in range(25):
        n = rnd.choice([1, 2, 5, 30])
        if rnd.random() < .5:
            data.append((c, -1, "system", "be <nice>"))
        for k in range(n):
            data.append((c, k, rnd.choice(["user", "assistant", "tool", None, "<x\\"]), rnd.choice([None, "", "x " * 90, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))])))
    data += [(50, 0, "system", "alone"), (51, 0, "assistant", "y " * 4000), (51, 1, "assistant", "z"), (None, 0, "user", "q"), (None, None, "assistant", "r"),
             (52, 3, "assistant", "same"), (52, 3, "assistant", "same"), (53, 0, "user", "u"), (53, 1, "system", "late"), (54, 0, None, None)]
    return data


@pytest.mark.parametrize("budget,history", [(C.BUDGET, C.HISTORY), (60, 25), (20, 0)])
def test_round_trip_and_budgets(spark, budget, history):
    data = sample()
    convs = ordered(data)
    windows = C.format_windows(conversations(spark, data, extra=("window", "loss", "no")), budget, history).cache()
    got = {r[0]: r[1:] for r in rows(C.digest(windows))}
    assert set(got) == set(convs)
    total = {c: 0 for c in convs}
    for c, w, text, n_turns, n_repeated, loss in rows(windows, "conv_id", "window"):
        total[c] += len(text)
        pieces = [p.removeprefix(C.OPEN).split(C.BODY) for p in text.split(C.CLOSE)[:-1]]
        back = [tuple(x.replace("\\l", "<").replace("\\b", "\\") for x in p) for p in pieces]
        assert len(back) == n_turns
        new = back[n_repeated:]
        system = [convs[c][0]] if convs[c][0][0] == "system" else []
        counted = [t for t in new if t not in system]
        room = max(1, budget - history - sum(tokens(t) for _, t in system))
        assert sum(tokens(t) for _, t in counted) <= room or len(counted) == 1
        repeated = back[:n_repeated]
        if repeated and system:
            assert repeated[0] == system[0]
        assert sum(tokens(t) for _, t in repeated[len(system) if repeated else 0:]) <= history
        learned = [text[s:s + n].replace("\\l", "<").replace("\\b", "\\") for s, n in loss]
        assert learned == [t for r, t in new if r == "assistant"]
    for c, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), total[c])
    windows.unpersist()


def test_empty_table(spark):
    assert rows(C.digest(C.format_windows(conversations(spark, []).filter("false")))) == []
