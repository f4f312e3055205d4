import math
import random
import re
from collections import Counter, defaultdict

from shuffled import written

from sedge.operators import statements
from sedge.plans import registry


def brute(said, asked):
    words = lambda x: {w for w in re.findall(r"\w+", (x or "").lower()) if len(w) > 1}
    n, df, hits = Counter(m[4] for m in said), Counter((m[4], w) for m in said for w in words(m[3])), defaultdict(float)
    for query, person, text in asked:
        for thread, at, role, x, who in said:
            for w in words(text) & words(x) if role == "assistant" and person is not None and who == person else ():
                hits[query, thread, at] += math.log(1 + (n[who] + 1) / (1 + df[who, w]))
    best = defaultdict(float)
    for (query, _, _), w in hits.items():
        best[query] = max(best[query], round(w, 6))
    return {k: w for k, w in hits.items() if round(w, 6) >= 0.5 * best[k[0]]}


def test_blocks_give_every_pair(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", *[" ".join(f"w{min(int(rng.expovariate(0.1)), 40)}" for _ in range(12))] * 8])
    said = [(f"t{k // 5}", k % 4, rng.choice(["user", "assistant", "assistant", None]), text(), rng.choice(["u", "u", "v", None])) for k in range(200)]
    said = [(f"{m[4]}{m[0]}", *m[1:]) for m in said]  # a thread is one person's
    asked = [(rng.choice([None, k, k, k, k]), rng.choice(["u", "v", "x", None]), text()) for k in range(60)]
    tables = spark.createDataFrame(said, "thread string, at int, role string, text string, person string"), spark.createDataFrame(asked, "query int, person string, text string")
    want = brute(said, asked)
    for sizes in ((16384, 32768), (7, 9)):
        monkeypatch.setattr(statements, "CHAT_QUESTIONS", sizes[0])
        monkeypatch.setattr(statements, "CHAT_MESSAGES", sizes[1])
        rows = statements.earlier_chats(*tables).collect()
        got = {(r.query, r.thread, r["at"]): r.weight for r in rows}
        assert len(got) == len(rows) and got.keys() == want.keys() and len(want) > 100 and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_pairs_are_not_exchanged(spark):
    got, size = written(spark, lambda: registry.queries()["earlier_chats"](spark, "/root/testdata/sf0.1").count())
    assert got == 52814 and size < 5_500_000, size
