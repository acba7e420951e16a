"""Removal of long word passages that an earlier document already holds.

A sparse de Bruijn graph holds the words. Nodes are runs of `kmer` words, of which only
minimisers are kept (the least hash of each window's runs), which two equal windows always
share; an edge leads from one minimiser of a document to the next, and is known by a hash
of all words from the one's start to the other's end. Nodes that one document alone has
are left out. Edges that are the only way out of one node and the only way into the next,
where no document starts or ends, are nonbranching: joins on their ends compact them to
paths, which every document that meets one of their nodes walks from end to end.

The source coordinates are then checked on the words of each document: a path that is as
long as a window is one span, compared as a whole by two hashes of all its words; windows
that no path holds whole (they reach over a branch or an end) are compared one by one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import cut, few, mix64, ordered, raw, rounds, scratch, slices, small_batches

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _odd(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


class Rolling:
    """Hashes of all runs of equal length in a sequence of 64-bit values: sums of values times
    powers of an odd number modulo 2**64, scaled back to the run's start."""

    def __init__(self, seed: int):
        self.base = int(_odd(seed, 1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            steps = np.full(n, self.base, dtype=np.uint64)
            back = np.full(n, self.inverse, dtype=np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix64((total[end] - total[start]) * self.down[start])


_BYTES, _EDGE, _ONE, _TWO, _BYTES2, _LINK = (Rolling(seed) for seed in (1, 2, 3, 4, 6, 8))
_LETTER, _LETTER2 = _odd(5, 256), _odd(7, 256)


def word_hashes(texts: list[bytes], twice: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """A 64-bit hash for each word of all texts in turn, if asked for a second one from the same
    bytes with other numbers, and where each text's words start (one entry more than texts)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)  # the separator ends a word, as white space does
    black = ~_WS[buf]
    edge = np.diff(np.r_[False, black, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.r_[0, np.cumsum(sizes + 1)]
    at = np.searchsorted(start, begins)
    at[-1] = len(start)
    return _BYTES.spans(_LETTER[buf], start, end), _BYTES2.spans(_LETTER2[buf], start, end) if twice else None, at


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over x[i : i + width] for every i that has so many."""
    have, out = 1, x
    while have * 2 <= width:
        out = f(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = f(out[: len(x) - width + 1], out[width - have :][: len(x) - width + 1])
    return out


class Windows:
    """The windows and edges of a block of texts. For position i in the words of all texts:
    edge[i] its k-mer's hash, least[i] the least hash of the window that starts there, valid[i]
    whether that window lies in one text."""

    def __init__(self, texts: list[bytes], window: int, kmer: int, twice: bool = False):
        self.window, self.kmer = window, kmer
        self.words, self.words2, self.at = word_hashes(texts, twice)
        n = len(self.words)
        self.count = max(0, n - window + 1)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.at))
        if not self.count:
            return
        p = np.arange(n - kmer + 1)
        self.edge = np.maximum(_EDGE.spans(self.words, p, p + kmer), np.uint64(1))
        width = window - kmer + 1
        self.least = _sliding(self.edge, width, np.minimum)
        self.valid = self.text[: self.count] == self.text[window - 1 :]

    def anchors(self) -> np.ndarray:
        """Positions of the edges that are least in some window."""
        if not self.count:
            return np.empty(0, np.int64)
        width = self.window - self.kmer + 1
        least = np.where(self.valid, self.least, np.uint64(0))
        pad = np.zeros(width - 1, dtype=np.uint64)
        return np.flatnonzero(_sliding(np.r_[pad, least, pad], width, np.maximum) == self.edge)

    def having(self, marked: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least edge is among the marked positions."""
        if not self.count:
            return np.empty(0, np.int64)
        masked = np.full(len(self.edge), _TOP)
        masked[marked] = self.edge[marked]
        return np.flatnonzero(self.valid & (_sliding(masked, self.window - self.kmer + 1, np.minimum) == self.least))

    def links(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For anchors: the edge that leads to it, the edge that leads on, and how many words
        on. Zero at a text's first and last anchor."""
        prev, following, gap = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32)
        i = np.flatnonzero(self.text[at[1:]] == self.text[at[:-1]])
        edge = np.maximum(_LINK.spans(self.words, at[i], at[i + 1] + self.kmer), np.uint64(1))
        prev[i + 1], following[i], gap[i] = edge, edge, at[i + 1] - at[i]
        return prev, following, gap

    def hashes(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of runs of words, from different hashes of each word."""
        return _ONE.spans(self.words, start, end), _TWO.spans(self.words2, start, end)


def _long(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x) for x in columns.values()], names=list(columns))


def _runs(*same: np.ndarray) -> np.ndarray:
    """Where, in sorted columns, a new combination starts."""
    new = np.zeros(len(same[0]), dtype=bool)
    if len(new):
        new[0] = True
        for x in same:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _ranges(did, rid, start, end):
    """Merges sorted, touching ranges of one document."""
    order = np.lexsort((start, rid, did))
    did, rid, start, end = did[order], rid[order], start[order], end[order]
    new = np.ones(len(did), dtype=bool)
    new[1:] = (did[1:] != did[:-1]) | (rid[1:] != rid[:-1]) | (start[1:] > end[:-1] + 1)
    i = np.flatnonzero(new)
    return did[i], rid[i], start[i], np.maximum.reduceat(end, i) if len(i) else end[:0]


def _anchors(window: int, kmer: int, block: int = 1 << 18):
    """Texts to anchors (h, did, rid, pos, known, prev, next, gap). Within a block of the task's rows equal
    anchors are settled at once: one row of each hash goes on to be compared with other
    tasks; the others only carry their place and edges, and that they are repeated."""

    def settle(rows):
        h, did, rid, pos, prev, following, gap = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((did, h))
        h, did, rid, pos, prev, following, gap = (x[order] for x in (h, did, rid, pos, prev, following, gap))
        first = _runs(h)
        size = np.diff(np.r_[first, len(h)])
        many = np.maximum.reduceat(did, first) > did[first]
        known = np.repeat(many, size)
        lead = np.zeros(len(h), dtype=bool)
        lead[first] = True
        # settled rows are dealt anywhere; an anchor that one document alone has here, at
        # several places, is not settled, and all its places go on
        away = mix64(rid.view(np.uint64) + pos.astype(np.uint64))
        key = np.where(known & ~lead, away, h)
        for i in range(0, len(key), 100_000):
            j = slice(i, i + 100_000)
            yield _record(key=key[j], h=h[j], did=did[j], rid=rid[j], pos=pos[j].astype(np.int32), known=known[j].astype(np.int8), prev=prev[j], next=following[j], gap=gap[j])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                w = Windows(raw(part, "text"), window, kmer)
                at = w.anchors()
                if len(at):
                    text = w.text[at]
                    held.append((w.edge[at], _long(part, "did")[text], _long(part, "rid")[text], at - w.at[text], *w.links(at)))
                    n += len(at)
                if n >= block:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _groups(batches, key: str):
    """Batches sorted by key, cut so that no key is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = _long(batch, key)
        at = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        if at or held and _long(held[-1], key)[-1] != k[0]:
            if at:
                held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _repeated(batches):
    """Anchors sorted by key to those that two documents have."""
    for b in _groups(batches, "key"):
        key, did, known = (_long(b, c) for c in ("key", "did", "known"))
        first = _runs(key)
        hit = (np.maximum.reduceat(did, first) > np.minimum.reduceat(did, first)) | (np.maximum.reduceat(known, first) > 0)
        keep = pa.array(np.repeat(hit, np.diff(np.r_[first, len(key)])))
        yield b.filter(keep).select(["h", "did", "rid", "pos", "prev", "next", "gap"])


def _shared_places(base: DataFrame, window: int, kmer: int) -> DataFrame:
    """(h, did, rid, pos, prev, next, gap): the minimisers that two documents share, as a table
    in the shared folder."""
    spark = base.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = base.select("did", "rid", "text").mapInArrow(_anchors(window, kmer), "key long, h long, did long, rid long, pos int, known byte, prev long, next long, gap int")
    repeated = anchors.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_repeated, "h long, did long, rid long, pos int, prev long, next long, gap int")
    path = scratch(spark, "places")
    repeated.write.parquet(path)
    return spark.read.schema(repeated.schema).parquet(path)


def _frequent(places: DataFrame, tasks: int) -> np.ndarray:
    """The nodes that hold more than one in 4 * tasks of all places: fewer than 4 * tasks."""
    most = places.count() / (4 * tasks)
    found = places.groupBy("h").count().where(F.col("count") > most).collect()
    return np.array([r.h for r in found], dtype=np.int64).view(np.uint64)


def _long_paths(places: DataFrame, window: int, kmer: int, part_rows: int = 500_000) -> DataFrame:
    """(h, length): the first node of every nonbranching path of `window` words or more, and
    how many words it has.

    Nodes and their only edges are found by partially aggregated minima and maxima, so that
    a node that many documents meet is one row a task before the shuffle. An edge joins the
    node it leaves with the node it reaches; then each node finds its path's first by
    pointer doubling, in as many joins as the longest path's length has binary digits. A
    path is never closed: every document enters its walk somewhere, and there a second way
    leads in."""
    with rounds(places.sparkSession, "paths") as keep:
        only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c))
        nodes = keep(places.groupBy("h").agg(only("prev").alias("way_in"), only("next").alias("way_out"), F.max("gap").alias("gap")))
        leaves = nodes.where("way_out is not null").select(F.col("h").alias("back"), F.col("way_out").alias("edge"), F.col("gap").cast("long").alias("far"))
        reached = nodes.where("way_in is not null").select("h", F.col("way_in").alias("edge"))
        back = keep(leaves.join(reached, "edge").select("h", "back", "far"))
        parts = max(1, -(-back.count() // part_rows))
        while True:
            far = back.select(F.col("h").alias("back"), F.col("back").alias("back2"), F.col("far").alias("far2"))
            step = back.join(far, "back", "left")
            step = step.select("h", F.coalesce("back2", "back").alias("back"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("back2").isNotNull().alias("moved"))
            back = keep(step.coalesce(parts))
            if back.where("moved").isEmpty():
                break
            back = back.drop("moved")
        paths = back.groupBy(F.col("back").alias("h")).agg((F.max("far") + kmer).cast("int").alias("length"))
        return cut(paths.where(F.col("length") >= window))


def _path_windows(window: int, kmer: int, frequent: np.ndarray, block: int = 1 << 18):
    """Documents with the places of their repeated nodes, and the lengths of the paths that
    start there, to rows of spans. A row holds one path of a document with the hashes of all
    its words, or consecutive windows outside of paths that share their least node (m), with
    the hashes of each. Windows around a frequent node are dealt by window: a row holds one of a
    document, and the places where it comes again (again).
    What a smaller document of the same block has is settled: it goes on
    as ranges, without hashes."""

    def settle(rows):
        m, h1, h2, did, rid, start, end, alone = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((did, h2, h1, m))
        sm, s1, s2, sd = m[order], h1[order], h2[order], did[order]
        first = _runs(sm, s1, s2)
        size = np.diff(np.r_[first, len(s1)])
        later = np.empty(len(s1), dtype=bool)
        later[order] = sd > np.repeat(sd[first], size)
        d, r, s, e = _ranges(did[later], rid[later], start[later], end[later])
        none = pa.array([b""] * len(d), pa.binary())
        if len(d):
            yield _record(m=mix64(r.view(np.uint64) + s.astype(np.uint64)), did=d, rid=r, start=s.astype(np.int32), end=e.astype(np.int32), hashes=none, again=none)
        left = np.flatnonzero(~later & alone)
        left = left[np.lexsort((start[left], rid[left], did[left], h2[left], h1[left], m[left]))]
        i = _runs(m[left], h1[left], h2[left], did[left], rid[left])
        ends, places = np.r_[i[1:], len(left)], start[left].astype(np.int32)
        for k in range(0, len(i), 20_000):
            f = left[i[k : k + 20_000]]
            hashes = [x.tobytes() for x in np.stack([h1[f], h2[f]], axis=1)]
            again = [places[a + 1 : b].tobytes() for a, b in zip(i[k : k + 20_000], ends[k : k + 20_000])]
            yield _record(m=m[f], did=did[f], rid=rid[f], start=start[f].astype(np.int32), end=start[f].astype(np.int32), hashes=pa.array(hashes, pa.binary()), again=pa.array(again, pa.binary()))
        left = np.flatnonzero(~later & ~alone)
        left = left[np.lexsort((start[left], rid[left], did[left]))]
        m, did, rid, start, end = m[left], did[left], rid[left], start[left], end[left]
        data = np.stack([h1[left], h2[left]], axis=1)
        long_ = end > start
        new = np.ones(len(left), dtype=bool)
        new[1:] = (did[1:] != did[:-1]) | (rid[1:] != rid[:-1]) | (start[1:] != start[:-1] + 1) | (m[1:] != m[:-1]) | long_[1:] | long_[:-1]
        i = np.flatnonzero(new)
        ends = np.r_[i[1:], len(left)]
        offsets = np.r_[i, len(left)].astype(np.int64) * 16
        for k in range(0, len(i), 20_000):
            j = slice(k, k + 20_000)
            off = offsets[k : k + 20_001]
            blob = data[i[k] : ends[j][-1]].tobytes()
            binary = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off - off[0]).astype(np.int32).tobytes()), pa.py_buffer(blob)])
            yield _record(m=m[i[j]], did=did[i[j]], rid=rid[i[j]], start=start[i[j]].astype(np.int32), end=end[ends[j] - 1].astype(np.int32), hashes=binary, again=pa.array([b""] * len(binary), pa.binary()))

    def run(batches):
        held, n = [], 0
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "packed", 1 << 20, zstandard.frame_content_size):
                texts = [unpack(x) for x in raw(part, "packed")]
                w = Windows(texts, window, kmer, twice=True)
                if not w.count:
                    continue
                spots = part.column(part.schema.get_field_index("spots"))
                places = spots.flatten()
                pos, length = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "length"))
                own = np.repeat(np.arange(len(texts)), np.diff(spots.offsets.to_numpy()))
                pos = pos + w.at[own]
                path = (length >= window) & (pos + length <= w.at[own + 1])
                p, size = pos[path], length[path]
                inside = np.zeros(w.count + 1, np.int64)
                np.add.at(inside, p, 1)
                np.add.at(inside, p + size - window + 1, -1)
                at = w.having(pos)
                at = at[np.cumsum(inside)[at] == 0]
                start, end = np.r_[at, p], np.r_[at, p + size - window]
                if len(start):
                    text = w.text[start]
                    # a path has a key of its own, apart from windows whose least node is its first
                    m = np.r_[w.least[at], mix64(w.edge[p])]
                    h1, h2 = w.hashes(start, end + window)
                    alone = (start == end) & np.isin(m, frequent)
                    m[alone] = mix64(m[alone] ^ h1[alone])
                    held.append((m, h1, h2, _long(part, "did")[text], _long(part, "rid")[text], start - w.at[text], end - w.at[text], alone))
                    n += len(start)
                if n >= block:
                    yield from settle(held)
                    held, n = [], 0
        if held:
            yield from settle(held)

    return run


def _first_seen(batches):
    """Rows of spans sorted by m to ranges (did, rid, start, end) of windows that a
    smaller document has."""
    for b in _groups(batches, "m"):
        m, did, rid, start, end = (_long(b, c) for c in ("m", "did", "rid", "start", "end"))
        blob = b.column(b.schema.get_field_index("hashes"))
        at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
        n = np.diff(at) // 16
        done = n == 0
        parts = [(did[done], rid[done], start[done], end[done])]
        data = np.frombuffer(blob.buffers()[2], np.uint64, (at[-1] - at[0]) // 8, at[0]).reshape(-1, 2) if at[-1] > at[0] else np.empty((0, 2), np.uint64)
        if len(data):
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) + start[row]
            last = np.where(n[row] == 1, end[row], place)
            order = np.lexsort((did[row], data[:, 1], data[:, 0], m[row]))
            h1, h2, d = data[order, 0], data[order, 1], did[row][order]
            first = _runs(m[row][order], h1, h2)
            later = order[d > np.repeat(d[first], np.diff(np.r_[first, len(h1)]))]
            parts.append((did[row][later], rid[row][later], place[later], last[later]))
            again = raw(b, "again")
            hit = [r for r in np.unique(row[later]).tolist() if again[r]]
            if hit:
                own = np.repeat(hit, [len(again[r]) // 4 for r in hit])
                other = np.frombuffer(b"".join(again[r] for r in hit), np.int32).astype(np.int64)
                parts.append((did[own], rid[own], other, other))
        d, r, s, e = _ranges(*(np.concatenate(x) for x in zip(*parts)))
        if len(d):
            yield _record(did=d, rid=r, start=s.astype(np.int32), end=e.astype(np.int32))


def _pack(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        i = batch.schema.get_field_index("text")
        for part in slices(batch, "text"):
            yield part.set_column(i, "packed", pa.array(list(map(pack, raw(part, "text"))), pa.binary()))


def _cut_texts(window: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for part in slices(batch, "packed", 1 << 20, zstandard.frame_content_size):
                out = []
                for packed, ranges in zip(raw(part, "packed"), part.column(part.schema.get_field_index("ranges")).to_pylist()):
                    words = unpack(packed).split()
                    gone = 0
                    if ranges:
                        keep = np.ones(len(words) + 1, dtype=np.int64)
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(change, [r["start"] for r in ranges], 1)
                        np.add.at(change, [r["end"] + window for r in ranges], -1)
                        keep = np.cumsum(change)[:-1] == 0
                        gone = len(words) - int(keep.sum())
                        left = [words[i] for i in np.flatnonzero(keep).tolist()]
                    else:
                        left = words
                    text = b" ".join(left)
                    out.append((len(words), gone, text.decode("utf-8", "replace"), hashlib.sha256(text).hexdigest()))
                n, gone, text, sha = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, kmer: int = 16) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text, kept_sha256) for every row: its text without
    each word that lies in a window of `window` words whose word sequence also starts in a
    row with a smaller id. Windows are judged on the input, never on what is left.

    Null text counts as empty. Texts with fewer words than a window keep all. A null id
    counts as the largest; rows of one id do not remove each other's words, whether equal or
    not. An empty table gives no rows. Other columns are ignored.

    Shuffled are: about one minimiser in 18 words, once; those that two documents share once
    more, reduced to nodes, and once to join their documents; texts (compressed) twice; and 16
    bytes for each path of a document, and for each window outside of paths whose minimiser
    two documents share. A passage that very many documents hold is reduced to one row a
    block of each task before the shuffle; the different windows around a node that very many
    documents hold are dealt each by itself, one row for all its places in a document. The places of shared minimisers stay as a table in
    the shared folder.
    """
    if not 1 <= kmer < window:
        raise ValueError("an edge must be shorter than a window")
    small_batches(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), ordered(F.col(id_col)).alias("did"), F.xxhash64(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    places = _shared_places(base, window, kmer)
    paths = few(_long_paths(places, window, kmer))
    frequent = _frequent(places, n)
    spots = places.select("h", "did", "rid", "pos").join(paths, "h", "left").select("did", "rid", F.struct("pos", F.coalesce("length", F.lit(0)).alias("length")).alias("spot"))
    spots = spots.groupBy("did", "rid").agg(F.collect_set("spot").alias("spots"))
    packed = base.mapInArrow(_pack, f"id {kind}, did long, rid long, packed binary")
    windows = packed.join(spots, ["did", "rid"]).select("did", "rid", "packed", "spots").mapInArrow(_path_windows(window, kmer, frequent), "m long, did long, rid long, start int, end int, hashes binary, again binary")
    ranges = windows.repartition(n, "m").sortWithinPartitions("m").mapInArrow(_first_seen, "did long, rid long, start int, end int")
    removed = ranges.groupBy("did", "rid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    out = packed.join(removed, ["did", "rid"], "left").select("id", "packed", "ranges").mapInArrow(_cut_texts(window), f"id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


#: The same for DuckDB, with the parameters of the registered query: every window is compared.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS did, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
win AS (SELECT r, did, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(did) AS least FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE did > least),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
