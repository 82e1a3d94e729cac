"""Audit of how filters interact, by inclusion and exclusion.

Every document gets one flag for each filter that it fails. For each of the 2**n intersections of
filters the joint failures are counted as sums of flag products, per part of the corpus, in one
aggregation that combines within tasks first: what is shuffled is a row per part and task. All else
is arithmetic on these 2**n numbers of a part (times three weights: all, good and toxic documents):
- survivors of a set P of filters: the Moebius sum of (-1)**|T| * joint(T) over the subsets T of P;
- failures of one filter alone: the same sum over the sets that hold it, with the sign turned;
- removed and redundant at a step: differences of survivors, and joint({f}) less what is removed;
- Shapley: the game v(P) = documents that P removes has the Harsanyi dividends
  (-1)**(|T| + 1) * joint(T); each is shared equally by the filters of T, times n! orders.

Defined results: a null text is empty, a null part is the part ''. Repeated rows count each. A
document without an id, or with the smallest id of its text, is no copy; of rows that share both
text and id none is a copy of another. A label's rows with one id count as good (toxic) if any says
so; labels without a document count nowhere. An empty table gives an empty table. Other columns
are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: What separates words.
SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = ("all", "good", "toxic")


def text_failures(text: Column, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 2, signs: str = "#$%&*|") -> dict[str, Column]:
    """The conditions on the text alone: too short, repetitive, too many capitals, odd signs; words is an array column."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "words": words,
        "A": F.size("words") < least_words,
        "B": F.lit(100) * F.size(F.array_distinct("words")) < F.lit(distinct_percent) * F.size("words"),
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * capital_percent,
        "D": text.rlike("[" + "".join("\\" + s for s in signs) + "]"),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: part, the flags A to E (0 or 1), good, toxic."""
    text = F.col("text")
    rules = text_failures(text)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", rules.pop("words").alias("words"))
    flags = [rule.cast("long").alias(name) for name, rule in rules.items()]
    rows = written(rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("chars"), *flags), "audit-flags")
    firsts = rows.groupBy("digest", "chars").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    rows = rows.join(firsts, ["digest", "chars"], "left").withColumn("E", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("long"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    marks = marks.agg(F.max(F.col("quality").eqNullSafe(1).cast("long")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("long")).alias("toxic"))
    marked = rows.join(marks, "id", "left")
    return marked.select("part", *[name for name in rules], "E", *[F.coalesce(w, F.lit(0).cast("long")).alias(w) for w in WEIGHTS[1:]])


def joint_failures(flagged: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part; joint_all, joint_good, joint_toxic: for each set of filters (bit k: filters[k]) how many fail all of it."""
    sums = []
    for weight in WEIGHTS:
        for mask in range(1 << len(filters)):
            product = [F.col(f) for k, f in enumerate(filters) if mask >> k & 1] + [F.col(weight)] * (weight != "all")
            sums.append(F.sum(reduce(mul, product, F.lit(1).cast("long"))).alias(f"{weight}_{mask}"))
    counted = flagged.groupBy("part").agg(*sums)
    return counted.select("part", *[F.array(*[f"{w}_{mask}" for mask in range(1 << len(filters))]).alias(f"joint_{w}") for w in WEIGHTS])


def _size(mask: int) -> int:
    return bin(mask).count("1")


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0).cast("long"))


def orders(filters: list[str]) -> list[dict]:
    """Every order of the filters, step by step: the filter, the sets applied before and after."""
    found = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            found.append({"filter_order": "".join(filters[i] for i in order), "step": step, "k": k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    return found


def audit(joint: DataFrame, filters: list[str]) -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n = len(filters)
    masks = range(1 << n)
    signed = lambda w, t: F.col(f"joint_{w}")[t] * (-1) ** _size(t)
    left = [F.array(*[_sum([signed(w, t) for t in masks if t & p == t]) for p in masks]).alias(f"left_{w}") for w in WEIGHTS]
    alone = F.array(*[-_sum([signed("all", t) for t in masks if t >> k & 1]) for k in range(n)]).alias("alone")
    fails = F.array(*[F.col("joint_all")[1 << k] for k in range(n)]).alias("fails")
    shares = F.array(*[-_sum([signed("all", t) * (math.factorial(n) // _size(t)) for t in masks if t >> k & 1]) for k in range(n)]).alias("shares")
    steps = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order: string, step: int, k: int, before: int, after: int>>")
    rows = joint.select("part", *left, alone, fails, shares).withColumn("s", F.explode(steps))
    gone = lambda w: F.col(f"left_{w}")[F.col("s.before")] - F.col(f"left_{w}")[F.col("s.after")]
    k = F.col("s.k")
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        F.col("left_all")[F.col("s.after")].alias("kept"),
        gone("all").alias("removed"),
        (F.col("fails")[k] - gone("all")).alias("redundant"),
        F.col("alone")[k].alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        F.col("shares")[k].alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of the five filters A to E; columns as for failures()."""
    filters = ["A", "B", "C", "D", "E"]
    joint = written(joint_failures(failures(docs, labels, **columns), filters), "audit-joint", small=True)
    return audit(joint, filters)
