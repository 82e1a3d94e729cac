"""Packing documents into sequences by lexical retrieval.

1. Each document becomes its token ids and a closing id, and a signature of three min-hashes over
   its tokens; each task also counts the documents that hold each token. Both are written once.
2. The counts are summed over the corpus: N, the mean length, and the document frequency of each
   token. They are bounded by the vocabulary, not by the corpus, and give BM25's weights.
3. Documents are ranged by (signature, a hash of the document): such as share tokens become
   neighbours, and a signature that a third of all documents have is many ranges. A task cuts its
   sorted range into shards of about `shard_tokens` tokens, one after the other.
4. Each shard is an inverted index of BM25 weights. What is `window` tokens or longer gives whole
   sequences first. Then, sequence by sequence, a seed (the rest of the document that was cut last, or the
   first unused one) is the query; its unused neighbours fill the window by falling score,
   and what overflows is cut and seeds the next sequence. What doesn't fill a window goes on to the
   task's next shard.
5. What a task has left at its end, less than a window, is cut into sequences whose lengths are
   powers of two, which need no padding: no sequence is padded.

Defined results: a null text is empty and is its closing id alone. Repeated rows are documents of
their own. An empty table gives an empty table. A null id is kept. Other columns are ignored. The
bounds of the ranges are sampled in each job: write the result before using it twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder
from .scratch import written
from .textblocks import release, text_bytes

K1, B = 1.2, 0.75
_BYTES = 256  # ids of single bytes say little about a text
_HASHES = np.stack([np.random.default_rng([13, k]).permutation(1 << 16) for k in range(3)]).astype(np.uint16)
_HASHES[:, :_BYTES] = 0xFFFF


def _signatures(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    low = [np.minimum.reduceat(h[ids & 0xFFFF], first).astype(np.int64) for h in _HASHES]
    return low[0] << 32 | low[1] << 16 | low[2]


def _holders(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """How many documents hold each token."""
    out = np.zeros(size, np.int64)
    ends = np.cumsum(counts)
    for k in range(0, len(counts), 64):
        n = counts[k : k + 64]
        seen = np.zeros((len(n), size), bool)
        seen[np.repeat(np.arange(len(n)), n), ids[ends[k] - counts[k] : ends[k] - counts[k] + n.sum()]] = True
        out += seen.sum(axis=0)
    return out


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", close: int = 1) -> DataFrame:
    """id, ids (two or four bytes a token, little-endian), sig; and a row a task whose stats hold its counts.

    tokenizer: the file's name among those sent by addFile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(SparkFiles.get(tokenizer))
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        held, total, n_docs = np.zeros(e.size, np.int64), 0, 0
        names = ["id", "ids", "sig", "stats"]
        for b in batches:
            for i, j, ids, counts in e.encode(b.column(1)):
                ends = np.cumsum(counts)
                ids, counts = np.insert(ids, ends, close), counts + 1
                ends = np.cumsum(counts)
                held += _holders(ids, counts, e.size)
                total, n_docs = total + len(ids), n_docs + len(counts)
                body = np.ascontiguousarray(ids.astype(kind))
                offsets = np.concatenate([[0], ends]) * body.itemsize
                blobs = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), blobs.cast(pa.binary()), pa.array(_signatures(ids, ends - counts)), pa.nulls(j - i, pa.binary())], names)
        if n_docs:
            stats = zlib.compress(np.concatenate([[n_docs, total], held]).astype("<i8").tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, b.column(0).type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([stats], pa.binary())], names)
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids binary, sig long, stats binary")


def corpus_counts(tokens: DataFrame) -> tuple[int, int, np.ndarray]:
    """Documents, tokens, and the documents that hold each token, summed over all tasks' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for b in batches:
            for s in b.column(0):
                one = np.frombuffer(zlib.decompress(s.as_py()), "<i8")
                total = one.copy() if total is None else total + one
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at - 2), pa.array(total[at]), pa.array(np.full(len(at), len(total) - 2))], ["token", "n", "size"])

    parts = tokens.where("stats is not null").select("stats").mapInArrow(run, "token long, n long, size long")
    rows = parts.groupBy("token").agg(F.sum("n").alias("n"), F.max("size").alias("size")).toArrow()  # a row a token of the vocabulary
    token, n = rows["token"].to_numpy(), rows["n"].to_numpy()
    total = np.zeros(2 + (rows["size"][0].as_py() if len(rows) else 0), np.int64)
    total[token + 2] = n
    return int(total[0]), int(total[1]), total[2:]


class Index:
    """An inverted index of BM25 weights over the fragments of a shard."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float) -> None:
        n = self.n = len(sizes)
        keys = ids.astype(np.uint64) * np.uint64(n) + np.repeat(np.arange(n, dtype=np.uint64), sizes)
        if len(idf) * n < 1 << 32:
            keys = keys.astype(np.uint32)
        keys.sort()
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(keys))).astype(np.float32)
        token, at = np.divmod(keys[new], keys.dtype.type(n))
        norm = (K1 * (1 - B + B * sizes / mean)).astype(np.float32)
        self.at = at.astype(np.int32)
        self.weight = (idf[token].astype(np.float32) * (tf * np.float32(K1 + 1))) / (tf + norm[self.at])
        self.begin = np.searchsorted(token, np.arange(len(idf) + 1)).astype(np.int64)
        often = np.diff(self.begin)
        # postings of tokens in over an eighth of the fragments are rows of a matrix instead: eight times their number at most
        self.dense = np.full(len(idf), -1)
        common = np.flatnonzero(often * 8 > n)
        self.dense[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common):
            part = slice(self.begin[t], self.begin[t + 1])
            self.rows[k, self.at[part]] = self.weight[part]

    def scores(self, query: np.ndarray) -> np.ndarray:
        """BM25 of every fragment for the distinct tokens of the query."""
        tokens = np.unique(query)
        rows = self.dense[tokens]
        out = self.rows[rows[rows >= 0]].sum(axis=0)
        rare = tokens[rows < 0]
        sizes = self.begin[rare + 1] - self.begin[rare]
        ends = np.cumsum(sizes)
        places = np.repeat(self.begin[rare] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return out + np.bincount(self.at[places], self.weight[places], self.n)


class Packer:
    """Packs one task's range, shard by shard; pieces are (document, start, place of its tokens, length, sequence, offset)."""

    def __init__(self, idf: np.ndarray, mean: float, window: int, part: int) -> None:
        self.idf, self.mean, self.window = idf, mean, window
        self.sequence = part << 33

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def shard(self, ids: np.ndarray, sizes: np.ndarray, near: int = 24) -> tuple[list[tuple], list[tuple]]:
        """Pieces of full sequences, and what is left: (document, start, place, length)."""
        window = self.window
        first = np.cumsum(sizes) - sizes
        pieces: list[tuple] = []
        whole = sizes // window
        for d in np.flatnonzero(whole):
            for k in range(int(whole[d])):
                pieces.append((int(d), k * window, int(first[d]) + k * window, window, self._next(), 0))
        doc = np.flatnonzero(sizes - whole * window)
        start = (whole * window)[doc]
        size = sizes[doc] - start
        place = first[doc] + start
        if not len(doc):
            return pieces, []
        text = ids if not whole.any() else np.concatenate([ids[p : p + n] for p, n in zip(place, size, strict=True)])
        index = Index(text, place, size, self.idf, self.mean)
        used = np.zeros(len(doc), bool)
        doc, start, place, size = doc.tolist(), start.tolist(), place.tolist(), size.tolist()
        left, low, seed = sum(size), 0, -1
        while left >= window:
            while used[low]:
                low += 1
            seed = seed if seed >= 0 else low
            number, filled, cut = self._next(), 0, -1
            scores = None
            queue = [seed]
            while filled < window:
                for c in queue:
                    n = min(size[c], window - filled)
                    pieces.append((doc[c], start[c], place[c], n, number, filled))
                    filled += n
                    if n == size[c]:
                        used[c] = True
                    else:
                        start[c], place[c], size[c], cut = start[c] + n, place[c] + n, size[c] - n, c
                    if filled == window:
                        break
                if filled < window:
                    if scores is None:
                        scores = index.scores(ids[place[seed] : place[seed] + size[seed]])
                    scores[used] = -1.0
                    least = max(0.0, np.partition(scores, len(scores) - near)[-near]) if len(scores) > near else 0.0
                    best = np.flatnonzero(scores >= least)
                    queue = best[np.argsort(-scores[best], kind="stable")][:near].tolist()
            left -= window
            seed = cut
        rest = [int(c) for c in np.flatnonzero(~used)]
        return pieces, [(doc[c], start[c], place[c], size[c]) for c in rest]

    def tail(self, rest: list[tuple]) -> list[tuple]:
        """The rest of less than a window in sequences whose lengths are powers of two."""
        pieces, total = [], sum(r[3] for r in rest)
        room = number = offset = 0
        for d, start, place, n in rest:
            while n:
                if not room:
                    room, number, offset = 1 << (total.bit_length() - 1), self._next(), 0
                    total -= room
                k = min(n, room)
                pieces.append((d, start, place, k, number, offset))
                d, start, place, n, room, offset = d, start + k, place + k, n - k, room - k, offset + k
        return pieces


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, close: int = 1, shard_tokens: int = 1 << 20, task_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece: the id, start, length, doc_tokens, sequence_id, offset, ids (four bytes a token, little-endian)."""
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer, id_col, text_col, close), "packing-tokens")
    n_docs, total, held = corpus_counts(tokens)
    width = "<u2" if len(held) <= 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(np.log1p((n_docs - held + 0.5) / (held + 0.5)))  # as long as the vocabulary
    mean = total / max(n_docs, 1)
    kind = tokens.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(sent.value, mean, window, TaskContext.get().partitionId())
        names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def rows(doc_ids: pa.Array, begun: np.ndarray, whole: np.ndarray, ids: np.ndarray, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pieces), 4096):
                some = pieces[k : k + 4096]
                d, start, place, n, number, offset = (np.array(x, np.int64) for x in zip(*some, strict=True))
                blobs = pa.array([ids[p : p + m].astype("<u4").tobytes() for p, m in zip(place.tolist(), n.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d)), *(pa.array(x) for x in (begun[d] + start, n, whole[d], number, offset)), blobs], names)

        def packs(parts: list[tuple], last: bool) -> tuple[list[pa.RecordBatch], list[tuple]]:
            """Rows of a shard, and its rest as a part of the next one."""
            doc_ids = pa.concat_arrays([p[0] for p in parts])
            begun, whole = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            ids, sizes = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            pieces, rest = packer.shard(ids, sizes)
            if last:
                pieces += packer.tail(rest)
                rest = []
            out = list(rows(doc_ids, begun, whole, ids, pieces))
            if not rest:
                return out, []
            d = np.array([r[0] for r in rest])
            start, n = np.array([r[1] for r in rest]), np.array([r[3] for r in rest])
            return out, [(doc_ids.take(pa.array(d)), begun[d] + start, whole[d], np.concatenate([ids[r[2] : r[2] + r[3]] for r in rest]), n)]

        parts: list[tuple] = []
        held_tokens = 0
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            ids = raw.view(width)
            first = offsets // ids.itemsize
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(first, first[i] + shard_tokens - held_tokens, "left")))
                j = min(j, b.num_rows)
                n = np.diff(first[i : j + 1])
                parts.append((b.column(0).slice(i, j - i), np.zeros(j - i, np.int64), n, ids[first[i] : first[j]].astype(np.int32), n))
                held_tokens += int(n.sum())
                if held_tokens >= shard_tokens:
                    out, parts = packs(parts, False)
                    held_tokens = sum(int(p[4].sum()) for p in parts)
                    yield from out
                i = j
        if parts:
            yield from packs(parts, True)[0]
        release()

    rows = tokens.where("ids is not null").select("id", "ids", "sig", F.xxhash64("id", F.crc32("ids")).alias("salt"))
    ranged = rows.repartitionByRange(max(1, -(-total // task_tokens)), "sig", "salt").sortWithinPartitions("sig", "salt").select("id", "ids")
    done = ranged.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return done.withColumnRenamed("id", id_col)
