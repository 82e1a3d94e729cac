from quartzite.operators import text_scores
from quartzite.queries_cuts import MOOD, NOT, VERY


def plain(text):
    """Marks taken characters one by one, longest terms first."""
    s, total = (text or "").strip(), 0.0
    free = [True] * len(s)
    for term in sorted(MOOD, key=lambda t: (-len(t), t)):
        for i in range(len(s) - len(term) + 1):
            if s[i : i + len(term)] == term and all(free[i : i + len(term)]):
                free[i : i + len(term)] = [False] * len(term)
                before = s[max(0, i - 6) : i]
                x = MOOD[term] * (-1 if any(before.endswith(n) for n in NOT) else 1)
                for v in sorted(VERY, key=lambda t: (-len(t), t)):
                    if v in before[-len(v) - 2 :]:
                        x *= VERY[v]
                        break
                total += x
    return max(-1.0, min(1.0, total / 8))


def test_scores_by_plain_loops(spark):
    texts = [None, "", "  ", "good", "not good", "very good, so bad", "very  great", "goodgoodgood", "no loss and hope", "true false " * 50, "greatgood bad"]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.s for r in text_scores.with_scores(d, "t", "s", MOOD, NOT, VERY).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert got[3] == 1 / 8 and got[4] == -1 / 8
    assert text_scores.with_scores(d.limit(0), "t", "s", MOOD, NOT, VERY).count() == 0
