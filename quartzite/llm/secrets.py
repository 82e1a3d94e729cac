"""Secret scan with multipart credential linking.

Base spans are strong by themselves: assigned values, access identifiers, long hex runs. Weak
candidates (other identifiers, bare keys, endpoints) mean nothing alone; they are reported only
where complementary parts stand together. Parts are intervals of code points, scopes are
paragraphs (text between blank lines), and the parts of a scope are joined, or with `reach` those
that are at most so many code points apart: a weak identifier needs a secret, a bare key needs an identifier, an
endpoint needs both. The join sorts each kind once and looks up neighbours by bisection, so a
text with many parts costs n log n.

Every text is scanned whole, in the task that reads it; nothing is shuffled.

Defined results: null and empty texts have no spans; overlapping weak spans give way to base
spans; among weak spans of the same place the kind listed first stays; repeated rows give a row each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of the kinds of parts (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(r"""(?<![A-Za-z0-9])(?:(?:ASIA|AIDA|AROA)[A-Z0-9]{8,}|(?i:(?:client|account|user|tenant|access_?key|key)_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{4,})""", re.ASCII)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"""https?://[^\s"'<>]+""")
BLANK = re.compile(r"\n[ \t\r]*\n")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ID_MARKS = ("akia", "asia", "aida", "aroa", "id")
KINDS = ("assign", "access", "hex", "weak_id", "bare_key", "endpoint")
MIN_ASSIGN, MIN_ACCESS = 12, 18

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)


class _Near:
    """Intervals by start, asked for one that comes within reach."""

    def __init__(self, spans: list[Span]) -> None:
        found = sorted((s[0], s[1]) for s in spans)
        self.starts = [s for s, _ in found]
        self.ends = list(accumulate((e for _, e in found), max))

    def has(self, low: int, high: int) -> bool:
        """Whether an interval begins at high at most and ends at low at least."""
        k = bisect_right(self.starts, high)
        return k > 0 and self.ends[k - 1] >= low


def linked_spans(text: str, base: list[Span], reach: int | None) -> list[Span]:
    """The weak parts that complementary parts in the same scope, or within reach in it, bear out."""
    low = text.lower()
    if not any(m in low for m in ID_MARKS):
        return []
    taken = _Overlaps(base)
    weak_ids = [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text) if not taken.any(m.start(), m.end())]
    ids = [s for s in base if s[2] == "access"] + weak_ids
    if not ids:
        return []
    taken = _Overlaps(base + weak_ids)
    ends = [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if not taken.any(m.start(), m.end())]
    taken = _Overlaps(base + weak_ids + ends)
    keys = [(m.start(), m.end(), "bare_key") for m in BARE_KEY.finditer(text) if _mixed(m[0]) and not taken.any(m.start(), m.end())]
    secrets = [s for s in base if s[2] != "access"] + keys
    near_id, near_secret = _Near(ids), _Near(secrets)
    cuts = [m.start() for m in BLANK.finditer(text)]

    def window(s: Span) -> tuple[int, int]:
        k = bisect_right(cuts, s[0])
        # parts of the scope before end at its cut at most, those of the next begin after it
        low, high = (cuts[k - 1] + 1 if k else 0), (cuts[k] if k < len(cuts) else len(text))
        return (low, high) if reach is None else (max(low, s[0] - reach), min(high, s[1] + reach))

    out = [s for s in weak_ids if near_secret.has(*window(s))]
    out += [s for s in keys if near_id.has(*window(s))]
    return out + [s for s in ends if near_id.has(*window(s)) and near_secret.has(*window(s))]


class _Overlaps:
    def __init__(self, spans: list[Span]) -> None:
        self.spans = sorted((s[0], s[1]) for s in spans)
        self.starts = [s[0] for s in self.spans]
        self.reach: list[int] = []
        for _, end in self.spans:
            self.reach.append(max(end, self.reach[-1] if self.reach else 0))

    def any(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def scan(text: str | None, reach: int | None = None) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans, of a text."""
    base = base_spans(text or "")
    return base, in_order(base + linked_spans(text or "", base, reach))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


SPANS = "array<struct<start:int,end:int,kind:string,base:boolean>>"


def found_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int | None = None) -> DataFrame:
    """One row per document: the id, n_assign, n_access, n_hex, base_sha256, spans (joined), found (the spans as structs)."""
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], []]
            digests, texts, found = [], [], []
            for text in b.column(1):
                base, every = scan(text.as_py(), reach)
                for c, kind in zip(counts, KINDS, strict=False):
                    c.append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(every))
                strong = set(base)
                found.append([{"start": s, "end": e, "kind": k, "base": (s, e, k) in strong} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(found, pa.list_(struct))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {SPANS}"
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
