import itertools
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quartzite.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, quality int, digest string, id string"
LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "a", 5, "x", "y"),
    (2, LONG, "b", 5, "x", "y"),
    (2, LONG, "b", 5, "x", "y"),
    (3, LONG.upper(), "a", 5, "x", "y"),
    (4, "same " * 300, "a", 5, "x", "y"),
    (5, "AB #", None, 5, "x", "y"),
    (6, None, "", 5, None, None),
    (7, "", "b", 5, None, None),
    (8, " \t\n", "b", 5, None, None),
    (None, LONG, "a", 5, None, None),
    (9, "é" * 50 + "A" + " ", "c", 5, None, None),
    (10, "é" * 48 + "A ", "c", 5, None, None),
    (11, "big " + LONG * 400 + " $", "c", 5, None, None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, None, 1), (None, 1, 1), (99, 1, 1), (9, 1, 1)]


def fails(row):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    first = min((r[0] for r in ROWS if (r[1] or "") == text and r[0] is not None), default=None)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": row[0] is not None and first is not None and row[0] > first,
    }


def brute():
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, t in LABELS if t == 1 and i is not None}
    docs = defaultdict(list)
    for r in ROWS:
        docs[r[2] or ""].append((fails(r), r[0] in good, r[0] in toxic))
    out = {}
    for part, rows in docs.items():
        share = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                all_fail = sum(r[0][f] for r in rows)
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                share[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_simulating_every_order(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(docs, labels).collect()
    assert len(got) == 600 * len({r[2] or "" for r in ROWS})
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert found == brute()


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audited(docs, labels).count() == 0
    one = spark.createDataFrame(ROWS[:1], SCHEMA)
    assert filter_audit.audited(one, labels).agg(F.sum("kept")).first()[0] == 600


def test_general_joint_counts(spark):
    """Any filters: three here, with sums over parts of the corpus."""
    rows = [("p", int(m & 1 > 0), int(m & 2 > 0), int(m & 4 > 0), m % 2, 0) for m in range(8) for _ in range(m + 1)]
    d = spark.createDataFrame(rows, "part string, X long, Y long, Z long, good long, toxic long")
    got = filter_audit.joint_failures(d, ["X", "Y", "Z"]).first()
    assert got.joint_all == [sum(r[1] >= (m & 1 > 0) and r[2] >= (m & 2 > 0) and r[3] >= (m & 4 > 0) for r in rows) for m in range(8)]
    assert filter_audit.audit(filter_audit.joint_failures(d, ["X", "Y", "Z"]), ["X", "Y", "Z"]).count() == 18
