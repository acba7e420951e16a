"""Near copies at a Jaccard similarity of word shingles: SimHash links by Golay keys first, then
an exact pass over what they cannot reach."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import LOWER, MOST_SENT, cut, few, raw, slices, small_batches
from vireo.llm.components import connected_components
from vireo.llm.simhash import near_links, simhash

_ROW = "h long, fp long, n int, i int"
#: 64-bit words of a set's parities: bit j tells whether an odd number of its shingles have j as
#: their hash's last nine bits.
PARITIES = 8


def shingles(text: bytes, k: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of k words, ascending; a shorter text is one run."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-k].tolist()]
    return np.unique(np.array([h(joined[s:e]) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())], dtype=np.uint64))


def parities(h: np.ndarray, bits: int = 64 * PARITIES) -> np.ndarray:
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def wide_parities(h: np.ndarray) -> np.ndarray:
    """Parities by as many last bits of the hash as give a place to each shingle, one byte for
    eight: in long sets every one of a fixed few parities is odd by chance."""
    return parities(h, max(64 * PARITIES, 1 << (len(h) - 1).bit_length() if len(h) else 0))


def unlike(x: np.ndarray, y: np.ndarray) -> int:
    """Parities in which two sets differ, by those of the smaller number of bits: of a set's
    parities, the halves' exclusive or is what half as many bits give."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.uint64), *values]).view(np.int64)))


def _common(docs: DataFrame, k: int, rows: int = 2000, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that `least` documents of a sample share, ascending, and their ranks by how
    many do. They only set the order in which shingles are looked at, not the result."""
    some = docs.where(F.xxhash64("key").cast("double") / 2.0**64 + 0.5 <= rows / max(docs.count(), 1))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                for t in raw(part, "text"):
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(t, k).view(np.int64))], names=["h"])

    found = some.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= least).toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def _keys(batch_of, run_of):
    """A mapInArrow function over rows sorted by h: run_of gets the columns of whole keys."""

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)]
            kept = cols if kept is None else [np.r_[x, y] for x, y in zip(kept, cols)]
            at = int(np.searchsorted(kept[0], kept[0][-1]))  # the last key may go on in the next batch
            if at:
                yield from map(batch_of, run_of([x[:at] for x in kept]))
                kept = [x[at:] for x in kept]
        if kept is not None:
            yield from map(batch_of, run_of(kept))

    return run


def _sizes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return start, np.diff(np.r_[start, len(h)])


def _shared(num: int, den: int, small: int = 64):
    """Rows that share their key; where `small` rows or fewer do, those with a possible partner."""

    def run(cols):
        start, size = _sizes(cols[0])
        of = np.repeat(size, size)
        keep = of > small
        a = np.flatnonzero((of > 1) & ~keep)
        for d in range(1, small):
            a = a[a + d < len(of)]
            a = a[cols[0][a] == cols[0][a + d]]
            if not len(a):
                break
            ok = a[_possible(cols, a, a + d, num, den)]
            keep[ok] = keep[ok + d] = True
        if keep.any():
            yield [x[keep] for x in cols]

    return run


def _possible(cols, a, b, num: int, den: int) -> np.ndarray:
    """Of pairs whose first shared shingle is this key's: whether what follows it is enough.
    Every pair that is similar enough passes at its first shared shingle."""
    _, _, n, i = (c.astype(np.int64) for c in cols[:4])
    most = np.minimum(n[a] - i[a], n[b] - i[b])
    return (num + den) * most >= num * (n[a] + n[b])


def _pairs(fp, a, b):
    x, y = np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b])
    return np.unique(np.stack([x, y], axis=1)[x != y], axis=0).T


def _close(cols, num: int, den: int):
    """A test of pairs by the parities of their sets. Every parity in which two sets differ needs
    a shingle that one of them has alone, so pairs that differ in more parities than similar
    sets may have such shingles are left out: none of them is similar enough."""
    n, odd = cols[2].astype(np.int64), np.stack(cols[4 : 4 + PARITIES], axis=1).astype(np.int64).view(np.uint64)
    return lambda a, b: (num + den) * np.bitwise_count(odd[a] ^ odd[b]).sum(axis=1, dtype=np.int64) <= (den - num) * (n[a] + n[b])


def _stars(num: int, den: int):
    """Candidates that join each key's rows cheaply: all with the first, and neighbours."""

    def run(cols):
        start, size = _sizes(cols[0])
        every = np.arange(len(cols[0]))
        first = np.repeat(start, size)
        a, b = np.r_[first, every[:-1]], np.r_[every, every[1:]]
        ok = (cols[0][a] == cols[0][b]) & (a != b)
        a, b = a[ok], b[ok]
        ok = _possible(cols, a, b, num, den) & _close(cols, num, den)(a, b)
        yield _pairs(cols[1], a[ok], b[ok])

    return run


def _others(num: int, den: int):
    """All candidates of each key that are not joined yet."""

    def run(cols):
        start, size = _sizes(cols[0])
        label, close = cols[4 + PARITIES], _close(cols, num, den)
        for s, m in zip(start.tolist(), size.tolist()):
            if (label[s : s + m] == label[s]).all():
                continue
            for x in range(s, s + m - 1):
                b = np.arange(x + 1, s + m)
                b = b[label[b] != label[x]]
                a = np.full(len(b), x)
                b = b[_possible(cols, a, b, num, den) & close(a, b)]
                if len(b):
                    yield _pairs(cols[1], np.full(len(b), x), b)

    return run


def _ab(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _first_links(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash is equal or, by Golay keys, at most four bits away:
    for every SimHash its first set stands, and the others are paired with it."""
    firsts = cut(reps.groupBy("sim").agg(F.min("fp").alias("fp")))
    equal = reps.select("sim", F.col("fp").alias("b")).join(firsts.withColumnRenamed("fp", "a"), "sim").where("a <> b").select("a", "b")
    near = near_links(firsts.select(F.col("sim").alias("fp")))
    near = near.join(firsts.select(F.col("sim").alias("a"), F.col("fp").alias("x")), "a").join(firsts.select(F.col("sim").alias("b"), F.col("fp").alias("y")), "b")
    return equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: Fraction = Fraction(4, 5), shingle: int = 5) -> DataFrame:
    """(id_col, component_id): the smallest id that links reach, where two texts are linked if
    the Jaccard similarity of their sets of `shingle`-word runs is `similarity` or more.

    SimHash fingerprints of the sets meet by Golay keys first, and what is at most four bits
    apart is verified by whole sets. That joins copies and close copies, but four bits miss
    most pairs near a similarity of 0.8 (they differ in about ten), so an exact pass follows:
    in any one order of all shingles, two sets that are similar enough share one of the first
    n - ceil(similarity n) + 1 of each, so documents meet at these, and every candidate not
    joined yet is verified. Shingles that many documents of a sample share come last in the
    order. Equal sets count as one. Of a shingle's documents, first a few pairs are verified
    that join most of a group of near copies, then all pairs not joined; none is dropped.

    Null text counts as empty; texts without words are equal. Ids must not be null; rows with
    equal ids must have equal texts, as they do by the key of the pipeline's stage.
    """
    spark, (num, den) = docs.sparkSession, similarity.as_integer_ratio()
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    common, rank = _common(docs, shingle)

    def begin(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp, sim, n, odd, wide, prefix = [], [], [], [], [], []
                for t in raw(part, "text"):
                    h = shingles(t, shingle)
                    fp.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                    sim.append(simhash(h))
                    n.append(len(h))
                    odd.append(parities(h))
                    wide.append(wide_parities(h).tobytes())
                    if len(common) and len(h):
                        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                        h = h[np.argsort(np.where(common[at] == h, rank[at], 0), kind="stable")]
                    prefix.append(h[: len(h) - -(-num * len(h) // den) + 1])
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), long(fp), long(sim), pa.array(n, pa.int32()), _lists(odd), pa.array(wide, pa.binary()), _lists(prefix)], names=["key", "fp", "sim", "n", "odd", "wide", "prefix"])

    sets = cut(docs.mapInArrow(begin, f"key {kind}, fp long, sim long, n int, odd array<long>, wide binary, prefix array<long>"))
    reps = cut(sets.groupBy("fp").agg(F.min("key").alias("least"), F.min("sim").alias("sim"), F.min("odd").alias("odd"), F.min("n").alias("n"), F.min("wide").alias("wide")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_key = lambda df: df.repartition(parts, "h").sortWithinPartitions("h", "fp")
    met = sets.select("fp", "n", "prefix").dropDuplicates(["fp"]).select("fp", "n", F.posexplode("prefix").alias("i", "h")).select("h", "fp", "n", "i")
    as_row = lambda c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["h", "fp", "n", "i"])
    met = cut(by_key(met).mapInArrow(_keys(as_row, _shared(num, den)), _ROW))
    # what the sets' parities are, for the sets that met; few are sent to where the rows are, and
    # keep the rows' order, many meet them by a shuffle
    own = [f"o{i}" for i in range(PARITIES)]
    odd = reps.join(few(met.select("fp").distinct()), "fp", "left_semi").select("fp", *[F.get("odd", i).alias(o) for i, o in enumerate(own)])
    odd = cut(odd)
    small = odd.count() <= MOST_SENT
    joined_odd = met.join(F.broadcast(odd) if small else odd, "fp").select("h", "fp", "n", "i", *own)
    met = joined_odd if small else cut(by_key(joined_odd))
    links = cut(_first_links(reps))

    def whole(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(squeeze, raw(part, "text"))), pa.binary())], names=["fp", "packed"])

    needed = odd.select("fp").union(links.select("a")).union(links.select("b")).distinct()
    needed = cut(needed.join(reps.select("fp", "least"), "fp").select("fp", F.col("least").alias("key")))
    texts = docs.join(few(needed), "key").select("fp", "text")
    full = cut(texts.mapInArrow(whole, "fp long, packed binary"))  # a repeated id gives equal rows, which do no harm

    def check(batches):
        unpack, last = zstandard.ZstdDecompressor().decompress, {}

        def own(x: int, packed) -> np.ndarray:
            if x not in last:
                if len(last) >= 64:
                    last.clear()
                last[x] = shingles(unpack(packed), shingle)
            return last[x]

        for batch in batches:
            a, b, x, y = batch.columns
            ok = []
            for c, d, p, q in zip(a.to_pylist(), b.to_pylist(), raw(batch, "x"), raw(batch, "y")):
                p, q = own(c, p), own(d, q)
                o = len(np.intersect1d(p, q, assume_unique=True))
                ok.append((num + den) * o >= num * (len(p) + len(q)))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def alike(batches):
        for batch in batches:
            a, b, n, m = (batch.column(i) for i in range(4))
            own = [np.frombuffer(v, "<u8") for c in ("x", "y") for v in raw(batch, c)]
            most = (den - num) * (n.to_numpy().astype(np.int64) + m.to_numpy())
            apart = np.fromiter(map(unlike, own[: len(a)], own[len(a) :]), np.int64, len(a))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array((num + den) * apart <= most))

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs that the sets' wide parities do not rule out: those are much shorter than texts."""
        of = lambda c, n, w: reps.select(F.col("fp").alias(c), F.col("n").alias(n), F.col("wide").alias(w))
        rows = pairs.join(of("b", "m", "y"), "b").join(of("a", "n", "x"), "a")
        return rows.select("a", "b", "n", "m", "x", "y").mapInArrow(alike, "a long, b long")

    def verified(pairs: DataFrame) -> DataFrame:
        rows = possible(pairs).join(full.select(F.col("fp").alias("b"), F.col("packed").alias("y")), "b").join(full.select(F.col("fp").alias("a"), F.col("packed").alias("x")), "a")
        return rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")

    stars = met.sortWithinPartitions("h", "fp").mapInArrow(_keys(_ab, _stars(num, den)), "a long, b long")
    stars = cut(verified(stars.union(links).distinct()))
    joined = connected_components(stars).withColumnRenamed("node", "fp")
    left = met.join(F.broadcast(joined) if small else joined, "fp", "left").select("h", "fp", "n", "i", *own, F.coalesce("label", "fp").alias("label"))
    left = left.sortWithinPartitions("h", "fp") if small else by_key(left)
    edges = stars.unionByName(verified(left.mapInArrow(_keys(_ab, _others(num, den)), "a long, b long").distinct()))
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    labelled = cut(reps.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    least = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    member = labelled.join(least, "label").select("fp", "component_id")
    return sets.select("key", "fp").join(member, "fp").select(F.col("key").alias(id_col), "component_id")
