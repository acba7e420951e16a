"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import LOWER, cut, raw, slices, small_batches
from vireo.llm.components import connected_components

#: Fixed value: generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101
#: Fixed value: where the fingerprint's segments start and how many bits they have.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """remainder of each 12 high bits; for each remainder the errors, up to 4 bits, that
    lead to a codeword, and how many there are (one, or six at distance three)."""
    rem = np.arange(1 << 12, dtype=np.uint32) << 11
    for bit in range(22, 10, -1):
        rem = np.where(rem >> bit & 1, rem ^ (GOLAY << (bit - 11)), rem).astype(np.uint32)

    def remainder(v: int) -> int:
        return int(rem[v >> 11]) ^ (v & 2047)

    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for n in range(5):
        for bits in combinations(range(23), n):
            e = sum(1 << b for b in bits)
            found[remainder(e)].append(e)
    # a word within two bits of a codeword has no other within four
    errors = np.zeros((1 << 11, 6), dtype=np.uint32)
    count = np.zeros(1 << 11, dtype=np.int64)
    for s, es in enumerate(found):
        count[s] = len(es)
        errors[s, : len(es)] = es
    return rem, errors, count


REMAINDERS, ERRORS, COUNTS = _tables()


def golay_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words the 12-bit indices of all codewords within four bits: an (n, 6) table
    and how many of each row hold. Words that differ in two bits or fewer share an index:
    the word halfway between them has a codeword within three bits, which is within four
    of both."""
    v = v.astype(np.uint32)
    s = REMAINDERS[v >> np.uint32(11)] ^ (v & np.uint32(2047))
    return (v[:, None] ^ ERRORS[s]) >> np.uint32(11), COUNTS[s]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that fingerprints at four or fewer differing bits share a key.

    With a, b, c errors in the three segments and a + b + c <= 4, either a <= 2 and b <= 2:
    then some pair of codeword indices is shared; or a >= 3, so b + c <= 1: segment B is
    equal, or C is equal and an index of B is shared; or b >= 3, likewise with A.
    """
    fp = fp.astype(np.uint64)
    a, b, c = ((fp >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS)
    (ka, na), (kb, nb) = golay_keys(a), golay_keys(b)
    rows, keys = [], []

    def add(family: int, row: np.ndarray, key: np.ndarray) -> None:
        rows.append(row)
        keys.append((np.uint64(family) << np.uint64(44)) | key.astype(np.uint64))

    n = len(fp)
    every = np.arange(n)
    for i in range(6):
        for j in range(6):
            r = np.flatnonzero((na > i) & (nb > j))
            add(1, r, (ka[r, i].astype(np.uint64) << np.uint64(12)) | kb[r, j])
    add(2, every, b)
    add(3, every, a)
    for family, k, m in ((4, kb, nb), (5, ka, na)):
        for i in range(6):
            r = np.flatnonzero(m > i)
            add(family, r, (k[r, i].astype(np.uint64) << np.uint64(18)) | c[r])
    return np.concatenate(rows), np.concatenate(keys)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the 64-bit hashes; without hashes zero."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 bits fit a byte, which numpy adds fastest
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[:-shingle].tolist()]
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    return simhash(np.array(hashes, dtype="<u8"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp long) of every row: the SimHash of the text's word shingles."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                fps = np.array([fingerprint(t, shingle) for t in raw(part, "_text")], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _keyed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = fuzzy_keys(fp.view(np.uint64))
            for i in range(0, len(row), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 100_000].view(np.int64)), pa.array(fp[row[i : i + 100_000]])], names=["key", "fp"])


def _tree(fp: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the fingerprints at most `most` bits apart. Each round
    compares one fingerprint with those not reached yet, so a tight group costs little
    more than one pass."""
    left, a, b = np.arange(1, len(fp)), [], []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(fp[left] ^ fp[at]) <= most
        got = left[near]
        a += [at] * len(got)
        b += got.tolist()
        queue += got.tolist()
        left = left[~near]
    return a, b


def link_sorted(most: int = 4, small: int = 8):
    """For rows (key, fp) sorted by key: edges (a, b) that link, within each key, all
    fingerprints at most `most` bits apart. Keys with a few rows are compared all at once;
    larger ones give the edges of a spanning forest only."""

    def links(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        a, b = [], []
        few = np.repeat((size <= small) & (size > 1), size)
        i = np.flatnonzero(few)
        for d in range(1, small):
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            ok = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= most]
            a.append(fp[ok])
            b.append(fp[ok + d])
        for s, n in zip(start[size > small].tolist(), size[size > small].tolist()):
            own = np.unique(fp[s : s + n])
            x, y = _tree(own, most)
            a.append(own[x])
            b.append(own[y])
        if not a:
            return
        x, y = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["a", "b"])

    def run(batches):
        kept: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.r_[kept[0], batch.column(0).to_numpy(zero_copy_only=False)]
            fp = np.r_[kept[1], batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            at = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            yield from links(key[:at], fp[:at])
            kept = [key[at:], fp[at:]]
        yield from links(*kept)

    return run


def near_links(distinct_fp: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of column fp: every two at most four
    bits apart are joined by a path of edges."""
    if most > 4:
        raise ValueError("the segments hold up to four errors")
    keyed = distinct_fp.select("fp").mapInArrow(_keyed, "key long, fp long")
    n = int(distinct_fp.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(link_sorted(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, shingle: int = 4) -> DataFrame:
    """(id_col, fp long, component_id): every row's fingerprint and the smallest id that
    links of `most` or fewer differing bits reach.

    Exact copies meet in one fingerprint before any key is made, so a group of copies costs
    one row; groups of near copies give spanning forests, not pairs. No candidate is
    dropped: every key's rows are compared whole.

    Null text counts as empty; texts without words have fingerprint zero, which links like
    any other. Rows with a null id keep their row; the smallest id skips nulls and is null
    only if all are. Equal ids are separate rows. An empty table gives no rows. Other
    columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    reps = fps.groupBy("fp").agg(F.min(id_col).alias("least"))
    labels = connected_components(near_links(reps, most))
    labelled = reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    labelled = cut(labelled)
    least = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")))  # apart from the join, which can then split a hot label
    member = labelled.join(least, "label").select("fp", "component_id")
    return fps.join(member, "fp").select(id_col, "fp", "component_id")
