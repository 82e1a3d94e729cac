"""Exact Jaccard self-join on word n-grams, by signature trees over candidate clusters.

1. Shingle sets. Tasks hash the distinct n-grams of each text to 64 bits; equal sets of one Arrow
   batch are one set from there on.
2. Document frequencies. The hashes travel to buckets of the hash space, packed, and return with
   their frequency if more than one set has them. A linked pair shares at least 80 % of either
   set, so a set of which fewer n-grams are shared with anyone has no partner and is done. An
   n-gram that many sets of one batch share sends a flag, not a row for each set, so no n-gram
   is hot in its bucket.
3. Candidates. With the n-grams in one global order, rarest first, two linked sets share one of
   the first |x| - ceil(0.8 |x|) + 1 of each (prefix filter). Sets with a common prefix n-gram
   are joined to a hub, and the hubs' components are clusters that no link leaves.
4. Signature trees. Clusters are cut into blocks of sets of one size class (linked sets are of the
   same class or of the next). Each block gives its shared n-grams bits of their own and builds a
   tree whose nodes hold the OR of their members' bitmaps and the range of their sizes. Two nodes
   are traversed together and pruned if the sizes can't match or the common bits, the largest
   possible overlap, are too few. At the leaves the common bits are the exact overlap. The first
   members of a cluster's classes are copied into all blocks of their own and the next classes.
5. Links between blocks. Step 4 leaves one large component in a cluster of copies. The sets outside
   of their cluster's largest component go as queries to those blocks, of their size class and the
   next ones, in which a set has one of their prefix n-grams; dual traversal again, in pieces of
   bounded size.

Work in memory is bounded by bytes as well as by rows: batches of texts, buckets of hashes (their
number comes from the bytes of the corpus), blocks, bundles and bitmaps. A longer text is a batch
by itself. Nothing is capped or sampled. N-grams are equal if 64 bits of their hash are, so a pair of sets of
300 n-grams has one false match in 2 * 10**14 pairs.

Defined results: a null or empty text, or one of white space, has an empty set and links with
nothing; fewer than n words are one n-gram; a null id is left out of links and has a null
component; rows that repeat an id are documents of their own, whose texts link or not; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .components import components
from .scratch import written

_RNG = np.random.default_rng(0x51E7)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HOT_IN_BATCH = 32
BATCH_DOCS, BATCH_BYTES = 2048, 8 << 20
#: Bytes of text behind a bucket of hashes; n-grams of a block and of a bundle of blocks.
BUCKET_BYTES, BLOCK_GRAMS, BUNDLE_GRAMS = 32 << 20, 1 << 21, 1 << 23
HOT = np.int64(1 << 40)


# Shingles -----------------------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    out: list[np.ndarray] = []
    for i, j in tb.chunks(offsets):
        part = tb.LOWER[data[offsets[i] : offsets[j]]]
        starts, ends, first = tb.word_bounds(part, offsets[i : j + 1] - offsets[i])
        words = tb.word_hashes(part, starts, ends)
        if len(words) >= n:
            grams = words[: len(words) - n + 1] * _PLACE[0]
            for k in range(1, n):
                grams = grams + words[k : len(words) - n + 1 + k] * _PLACE[k]
            grams = tb.mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                one = np.array([b - a], np.uint64)
                for k in range(b - a):
                    one = one + words[a + k : a + k + 1] * _PLACE[k]
                out.append(tb.mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(blob) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return wide.view("<u8").ravel().astype(np.uint64)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending numbers below 2**16 as steps, of a byte each if that is enough."""
    steps = np.diff(places, prepend=0)
    return steps.astype(np.uint8 if steps.max(initial=0) < 256 else np.uint16).tobytes()


def unpack_places(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8 if len(blob) == n else np.uint16), dtype=np.int64)


def bucket_bits(partitions: int, corpus_bytes: int) -> int:
    """So many leading bits of a hash name its bucket that 7 bytes hold the others and a bucket stays small."""
    return max(8, (4 * partitions - 1).bit_length(), (corpus_bytes // BUCKET_BYTES).bit_length())


def unpack_in(bucket: int, bits: int, blob: bytes) -> np.ndarray:
    return unpack(blob, 7) | np.uint64(bucket << (64 - bits))


# 1 and 2: sets, frequencies -----------------------------------------------------------------

ROUTED = "bucket int, batch long, places binary, grams binary, df binary, flags binary, directory binary"
_ROUTED = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("places", pa.binary()), ("grams", pa.binary()), ("df", pa.binary()), ("flags", pa.binary()), ("directory", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROUTED.types, strict=True)], schema=_ROUTED)


def _scatter(n: int, bits: int):
    """Texts to packed n-grams by bucket, and a directory of the batch. A batch has at most a row for each n-gram."""
    buckets, shift = 1 << bits, np.uint64(64 - bits)

    def one(ids: list, column: pa.Array, batch: int) -> Iterator[pa.RecordBatch]:
        data, offsets = tb.text_bytes(column)
        sets = shingle_sets(data, offsets, n)
        texts = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        known: dict[bytes, int] = {}
        local = np.array([known.setdefault(d, len(known)) for d in digests], np.int32)
        own = [sets[i] for i in np.unique(local, return_index=True)[1].tolist()]
        sizes = np.array([len(s) for s in own], np.int64)
        grams = np.concatenate(own) if own else np.zeros(0, np.uint64)
        place = np.repeat(np.arange(len(own), dtype=np.int64), sizes)
        order = np.argsort(grams)
        full, place = grams[order], place[order].astype(np.uint16)
        bucket = (full >> shift).astype(np.int64)
        new = np.ones(len(full), bool)
        new[1:] = full[1:] != full[:-1]
        runs = np.diff(np.append(np.flatnonzero(new), len(full)))
        hot = np.repeat(runs >= HOT_IN_BATCH, runs)
        yield _batch([(batch % buckets, batch, None, None, None, None, pickle.dumps((ids, local, digests, texts, sizes, place[hot], full[hot])))])
        flagged = new & hot
        rows = []
        cold, cold_place, cold_bucket = full[~hot], place[~hot], bucket[~hot]
        at = np.searchsorted(cold_bucket, np.arange(buckets + 1))
        flag, flag_bucket = full[flagged], bucket[flagged]
        flag_at = np.searchsorted(flag_bucket, np.arange(buckets + 1))
        for k in range(buckets):
            a, b, c, d = at[k], at[k + 1], flag_at[k], flag_at[k + 1]
            if a == b and c == d:
                continue
            by_place = np.argsort(cold_place[a:b], kind="stable")
            rows.append((k, batch, pack_places(cold_place[a:b][by_place].astype(np.int64)), pack(cold[a:b][by_place], 7), None, pack(flag[c:d], 7), None))
            if len(rows) >= 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 24
        for b in batches:
            for i, j in tb.chunks(tb.text_bytes(b.column(1))[1], BATCH_BYTES, BATCH_DOCS):
                part = b.slice(i, j - i)
                yield from one(part.column(0).to_pylist(), part.column(1), batch)
                batch += 1
        tb.release()

    return run


def frequency_class(count: np.ndarray) -> np.ndarray:
    """Frequencies in steps of an eighth of a power of two, in one byte; the hot ones last."""
    return np.minimum(254, (np.log2(np.maximum(count, 1)) * 8).astype(np.int64)).astype(np.uint8)


def _frequencies(group: pa.Table) -> pa.Table:
    """Of one bucket: each batch gets back its n-grams that several sets have, with their frequency."""
    grams = [unpack(x, 7) if x else np.zeros(0, np.uint64) for x in group["grams"].to_pylist()]
    flags = [unpack(x, 7) for x in group["flags"].to_pylist() if x]
    lengths = [len(g) for g in grams]
    everything = np.concatenate([*grams, *flags]) if grams or flags else np.zeros(0, np.uint64)
    _, where, counts = np.unique(everything, return_inverse=True, return_counts=True)
    if flags:
        counts[where[sum(lengths) :]] = HOT
    df = np.where(counts >= HOT, np.uint8(255), frequency_class(counts))
    out, at = [], 0
    for bucket, batch, places, directory, gram in zip(group["bucket"].to_pylist(), group["batch"].to_pylist(), group["places"].to_pylist(), group["directory"].to_pylist(), grams, strict=True):
        mine = where[at : at + len(gram)]
        at += len(gram)
        if directory is not None:
            out.append((bucket, batch, None, None, None, None, directory))
            continue
        shared = counts[mine] > 1
        if shared.any():
            place = unpack_places(places, len(gram))[shared]
            out.append((bucket, batch, pack_places(place), pack(gram[shared], 7), df[mine][shared].tobytes(), None, None))
    return pa.Table.from_batches([_batch(out)] if out else [], _ROUTED)


SETS = "id long, n long, digest binary, text binary, node long, shared binary, keys array<long>"
_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()), ("node", pa.int64()), ("shared", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _prefixes(percent: int, bits: int):
    """Of one batch: every document's size and digests; of each set that may have a partner its shared n-grams and prefix.

    These are in one row of the set, which has a number of its own in the whole corpus, the node.
    """

    def run(group: pa.Table) -> pa.Table:
        found = [x for x in group["directory"].to_pylist() if x is not None]
        ids, local, digests, texts, sizes, hot_place, hot_grams = pickle.loads(found[0])
        batch = group["batch"][0].as_py()
        places, grams, df = [hot_place], [hot_grams], [np.full(len(hot_grams), 255, np.uint8)]
        for bucket, p, g, d in zip(group["bucket"].to_pylist(), group["places"].to_pylist(), group["grams"].to_pylist(), group["df"].to_pylist(), strict=True):
            if p is not None:
                places.append(unpack_places(p, len(d)))
                grams.append(unpack_in(bucket, bits, g))
                df.append(np.frombuffer(d, np.uint8))
        place, gram, rank = np.concatenate(places).astype(np.int64), np.concatenate(grams), np.concatenate(df)
        use = (np.bincount(place, minlength=len(sizes)) * 100 >= percent * sizes)[place]
        place, gram, rank = place[use], gram[use], rank[use]
        order = np.lexsort((gram, rank, place))
        place, gram = place[order], gram[order]
        bounds = np.searchsorted(place, np.arange(len(sizes) + 1))
        shared: list[bytes | None] = [None] * len(sizes)
        keys: list[np.ndarray | None] = [None] * len(sizes)
        for k, n in enumerate(sizes.tolist()):
            have = int(bounds[k + 1] - bounds[k])
            if n and have * 100 >= percent * n:
                mine = gram[bounds[k] : bounds[k + 1]]
                prefix = n - -(-percent * n // 100) + 1 - (n - have)
                keys[k] = mine[:prefix].view(np.int64)
                shared[k] = np.sort(mine).tobytes()
        least: dict[int, int] = {}  # of each set the row that carries it: that of the least id
        for row, k in enumerate(local.tolist()):
            if ids[row] is not None and (k not in least or ids[row] < ids[least[k]]):
                least[k] = row
        rows_shared: list[bytes | None] = [None] * len(ids)
        rows_keys: list[np.ndarray | None] = [None] * len(ids)
        nodes: list[int | None] = [None] * len(ids)
        for k, row in least.items():
            rows_shared[row], rows_keys[row] = shared[k], keys[k]
            if shared[k] is not None:
                nodes[row] = batch * BATCH_DOCS + k
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes[local]), pa.array(digests, pa.binary()), pa.array(texts, pa.binary()), pa.array(nodes, pa.int64()), pa.array(rows_shared, pa.binary()), pa.array(rows_keys, pa.list_(pa.int64()))], schema=_SETS)

    return run


def shingled(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = bucket_bits(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    routed = picked.mapInArrow(_scatter(n, bits), ROUTED)
    counted = routed.groupBy("bucket").applyInArrow(_frequencies, ROUTED)
    return counted.groupBy("batch").applyInArrow(_prefixes(percent, bits), SETS)


# 4 and 5: signature trees -------------------------------------------------------------------


class SignatureTree:
    """A complete tree of the given fan-out over rows of bitmaps: OR of the bitmaps, range of sizes, by level from the leaves."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, fan: int = 4) -> None:
        self.fan = fan
        self.levels = [(bits, sizes, sizes)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi = self.levels[-1]
            at = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the nodes below it, with the position of the node in `nodes`."""
        below = len(self.levels[level - 1][0])
        first = nodes * self.fan
        n = np.minimum(first + self.fan, below) - first
        owner = np.repeat(np.arange(len(nodes)), n)
        return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether members of the nodes can link, by size ranges and the largest possible overlap."""
    fit = (a[2][i] * 100 >= percent * b[1][j]) & (b[2][j] * 100 >= percent * a[1][i])
    least = a[1][i] + b[1][j]
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 4096):
        s = slice(at, at + 4096)
        k = np.flatnonzero(fit[s]) + at
        common = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(axis=1, dtype=np.int64)
        out[k] = common * (100 + percent) >= percent * least[k]
    return out


def dual_traversal(a: SignatureTree, b: SignatureTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves of both trees that link; within one tree, each pair once."""
    same = a is b
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    keep = possible(a.levels[la], i, b.levels[lb], j, percent)
    i, j = i[keep], j[keep]
    while len(i) and (la or lb):
        if la >= lb and la:
            owner, i = a.children(la, i)
            j, la = j[owner], la - 1
            if same:
                owner, j = b.children(lb, j)
                i, lb = i[owner], lb - 1
                i, j = i[i <= j], j[i <= j]
        else:
            owner, j = b.children(lb, j)
            i, lb = i[owner], lb - 1
        keep = possible(a.levels[la], i, b.levels[lb], j, percent)
        i, j = i[keep], j[keep]
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set: one for each n-gram that two or more of the sets have."""
    sizes = np.array([len(s) for s in sets])
    grams, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    width = max(1, -(-int((counts > 1).sum()) // 64))
    bits = np.zeros((len(sets), width * 8), np.uint8)
    row, use, at = np.zeros(width * 64, np.uint8), counts[where] > 1, 0
    for k, size in enumerate(sizes.tolist()):  # a row of flags at a time
        mine = slice(at, at + size)
        flags = number[where[mine][use[mine]]]
        row[flags] = 1
        bits[k] = np.packbits(row)
        row[flags] = 0
        at += size
    return bits.view(np.uint64)


def _order(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Similar sets side by side: by least n-gram, then size."""
    return np.lexsort((sizes, np.array([s[0] for s in sets])))


def linked(sets: list[np.ndarray], sizes: np.ndarray, queries: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Pairs of positions that link; with queries (a mask), only pairs of a query and another set."""
    bits = bitmaps(sets)
    if queries is None:
        order = _order(sets, sizes)
        tree = SignatureTree(bits[order], sizes[order])
        i, j = dual_traversal(tree, tree, percent)
        return list(zip(order[i].tolist(), order[j].tolist(), strict=True))
    q, r = np.flatnonzero(queries), np.flatnonzero(~queries)
    q, r = q[_order([sets[k] for k in q], sizes[q])], r[_order([sets[k] for k in r], sizes[r])]
    i, j = dual_traversal(SignatureTree(bits[q], sizes[q]), SignatureTree(bits[r], sizes[r]), percent)
    return list(zip(q[i].tolist(), r[j].tolist(), strict=True))


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The pairs that join two trees of a forest, in order: as many as connect what all pairs connect."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _blocks(percent: int):
    """Links within each block, or piece of one, of one bundle."""
    by = ["cluster", "block", "piece"]

    def run(group: pa.Table) -> pa.Table:
        g = group.sort_by([(c, "ascending") for c in [*by, "id"]])
        ids, sizes = g["id"].to_numpy(), g["n"].to_numpy()
        query, shared = g["query"].to_numpy(zero_copy_only=False), g["shared"].combine_chunks()
        changes = np.any([np.diff(g[c].to_numpy()) != 0 for c in by], axis=0)
        edge = np.flatnonzero(np.append(True, changes))
        out_a, out_b = [], []
        for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)], strict=True):
            mask = query[s:e]
            if e - s < 2 or mask.all():
                continue
            sets = [np.frombuffer(x, "<u8") for x in shared.slice(s, e - s).to_pylist()]
            for a, b in forest(linked(sets, sizes[s:e], mask if mask.any() else None, percent), e - s):
                out_a.append(ids[s + a])
                out_b.append(ids[s + b])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def size_class(n: str, percent: int) -> Column:
    """Sets that link have sizes of one class or of two that follow each other."""
    return F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)


def _sub_block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks))


def _block(size: str, sub: Column) -> Column:
    return (F.col(size) * F.lit(1 << 40) + sub).alias("block")


def links(sets: DataFrame, keyed: DataFrame, clusters: DataFrame, percent: int, block_docs: int, bundle_sets: int = 4096) -> DataFrame:
    """Rows (a, b) that connect what links connect. sets: id, n, shared; keyed: id, key; clusters: id, component of the candidates.

    An id that repeats may have several sets, of one size class or of more.
    """
    spark = sets.sparkSession
    sets = sets.withColumn("size", size_class("n", percent))
    grams = F.pow(F.lit(100.0 / percent), F.col("size") + 1)  # n-grams of a set of that class, or a little more
    block_sets = F.greatest(F.lit(1), F.least(F.lit(block_docs), F.floor(F.lit(BLOCK_GRAMS) / grams)))
    members = clusters.join(sets.select("id", "size").distinct(), "id").select("id", F.col("component").alias("cluster"), "size")
    classes = members.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("head"))
    classes = classes.withColumn("blocks", F.ceil(F.col("sets") / block_sets)).drop("sets")
    classes = written(classes, "ngram-classes", small=True)
    parts = members.join(classes.drop("head"), ["cluster", "size"]).select("id", "cluster", "size", _block("size", _sub_block("blocks")))
    parts = written(parts, "ngram-blocks", small=True)
    several = written(classes.groupBy("cluster").agg(F.sum("blocks").alias("blocks")).where("blocks > 1").select("cluster"), "ngram-large", small=True)

    def in_blocks(rows: DataFrame) -> DataFrame:
        """rows (id, size, cluster, block, piece, query) meet their sets and are joined piece by piece."""
        count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(grams), F.lit(0.0))).first()
        bundles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // bundle_sets), math.ceil(size / BUNDLE_GRAMS))
        full = rows.join(sets, ["id", "size"]).withColumn("bundle", F.pmod(F.xxhash64("cluster", "block", "piece"), F.lit(bundles)))
        return full.groupBy("bundle").applyInArrow(_blocks(percent), "a long, b long")

    def rows_of(df: DataFrame, query: bool) -> DataFrame:
        return df.select("id", "size", "cluster", "block", F.lit(0).cast("long").alias("piece"), F.lit(query).alias("query"))

    # The heads of three classes go to each block but their own.
    large = classes.join(several, "cluster", "left_semi")
    near = F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("near")
    heads = large.withColumn("id", F.col("head")).select("cluster", "id", "size", _block("size", _sub_block("blocks")).alias("own"), near)
    targets = large.select("cluster", F.col("size").alias("near"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("sub")).select("cluster", "near", _block("near", F.col("sub")))
    copies = heads.join(targets, ["cluster", "near"]).where("block <> own")
    first = written(rows_of(parts, False).union(rows_of(copies, False)), "ngram-rows", small=True)
    found = written(in_blocks(first), "ngram-links", small=True)
    if several.isEmpty():
        return found

    label = parts.join(several, "cluster", "left_semi").join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    label = written(label, "ngram-labels", small=True)
    sizes = label.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("sets"))
    most = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("sets", "component")).alias("most"))
    apart = written(label.join(most, "cluster").where("component <> most").select("id", "cluster", "size", "block"), "ngram-apart", small=True)
    if apart.isEmpty():
        return found
    wanted = apart.select("id", "size", F.col("block").alias("own"), near).join(keyed, "id")
    holders = parts.join(apart.select("cluster").distinct(), "cluster", "left_semi").join(keyed, "id").select("cluster", F.col("size").alias("near"), "block", "key").distinct()
    queries = wanted.join(holders, ["key", "near"]).where("block <> own").select("id", "size", "cluster", "block").distinct()
    queries = written(queries, "ngram-queries", small=True)
    pieces = queries.groupBy("cluster", "block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum(grams) / BLOCK_GRAMS)).alias("pieces"))
    pieces = written(pieces, "ngram-pieces", small=True)
    dealt = queries.join(pieces, ["cluster", "block"]).select("id", "size", "cluster", "block", F.pmod(F.xxhash64("id"), F.col("pieces")).alias("piece"), F.lit(True).alias("query"))
    held = parts.join(pieces, ["cluster", "block"]).select("id", "size", "cluster", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(False).alias("query"))
    across = written(held.union(dealt), "ngram-across", small=True)
    return found.union(in_blocks(across))


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, block_docs: int = 128) -> DataFrame:
    """One row per row of docs: id, n, text (SHA-256 of the bytes), component_id (least id reachable by links), kept.

    Of a component the row of the least id stays, of such rows the one with the least digest; rows that share both are one document.
    """
    sets = written(shingled(docs, id_col, text_col, n, percent), "ngram-sets")
    own = sets.where("n > 0 and id is not null")
    # Equal sets have one node from here on, that of the least id.
    node = F.min(F.when(F.col("node").isNotNull(), F.struct("id", "node"))).getField("node")
    least = written(own.groupBy("digest").agg(node.alias("node"), F.min(F.struct("id", "text")).alias("first")), "ngram-set-ids", small=True)

    chosen = least.where("node is not null").select("node")
    keyed = own.where("shared is not null").select("node", "keys").join(chosen, "node").select(F.col("node").alias("id"), F.explode("keys").alias("key"))
    keyed = written(keyed, "ngram-keys")
    hubs = written(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("sets")).where("sets > 1").drop("sets"), "ngram-hubs", small=True)
    star = keyed.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    carried = own.where("shared is not null").select(F.col("node").alias("id"), "n", "shared")
    joined = components(links(carried, keyed, components(star), percent, block_docs))

    groups = written(least.join(joined, least.node == joined.id, "left").select("digest", "first", "component"), "ngram-components", small=True)
    tops = groups.where("component is not null").groupBy("component").agg(F.min("first").alias("top"))
    named = groups.join(tops, "component", "left").select("digest", F.coalesce("top", "first").alias("top"))
    rows = sets.select("id", "n", "digest", "text").join(written(named, "ngram-tops", small=True), "digest", "left")
    grouped = (F.col("n") > 0) & F.col("id").isNotNull()
    return rows.select(
        "id",
        "n",
        "text",
        F.when(grouped, F.col("top.id")).otherwise(F.when(F.col("n") == 0, F.col("id"))).alias("component_id"),
        (~grouped | ((F.col("id") == F.col("top.id")) & (F.col("text") == F.col("top.text")))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    return decided(docs, id_col, text_col, **how).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """docs without the rows of a component but one; rows that share an id are told apart by 64 bits of their text's digest."""
    gone = decided(docs, id_col, text_col, **how).where("not kept").select("id", F.xxhash64("text").alias("text")).distinct()
    gone = written(gone, "near-copies", small=True)
    text = F.xxhash64(F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)))
    return docs.join(gone, (docs[id_col].cast("long") == gone["id"]) & (text == gone["text"]), "left_anti")
