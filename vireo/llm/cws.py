"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vireo.llm.common import mix64, ordered, raw, slices, small_batches

_STEP = np.uint64(0x9E3779B97F4A7C15)


class Sampler:
    """Signatures of weighted word sets. For each word and sample, r and c are gamma(2, 1) and
    b uniform, all drawn from the word's hash alone; with weight w, t = floor(ln w / r + b)
    and a = c / exp(r (t - b + 1)); the sample is (word, t) of the least a. Two sets agree in
    a sample with the probability of their generalised Jaccard similarity, sum of least
    weights over sum of greatest.

    What a word of one weight gives is remembered, `remember` rows at most; then afresh.
    """

    def __init__(self, samples: int = 64, seed: int = 7, remember: int = 200_000):
        self.samples, self.seed, self.remember = samples, seed, remember
        self.draws = np.arange(1, 5 * samples + 1, dtype=np.uint64) * _STEP
        self._clear(4096)

    def _clear(self, rows: int) -> None:
        self.at: dict[tuple[bytes, int], int] = {}
        self.log_a = np.empty((rows, self.samples), dtype=np.float32)
        self.code = np.empty((rows, self.samples), dtype=np.uint16)

    def _learn(self, terms: list[tuple[bytes, int]]) -> None:
        n, k = len(self.at), self.samples
        need = n + len(terms)
        if need > len(self.log_a):
            more = max(need, 2 * len(self.log_a))
            for name in ("log_a", "code"):
                old = getattr(self, name)
                new = np.empty((more, k), dtype=old.dtype)
                new[:n] = old[:n]
                setattr(self, name, new)
        for i in range(0, len(terms), 512):
            some = terms[i : i + 512]
            h = np.array([xxhash.xxh64_intdigest(w, self.seed) for w, _ in some], dtype=np.uint64)
            weight = np.array([c for _, c in some], dtype=np.float64)[:, None]
            u = ((mix64(h[:, None] + self.draws) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            u1, u2, u3, u4, b = (u[:, j * k : (j + 1) * k] for j in range(5))
            r = -np.log(u1 * u2)
            log_c = np.log(-np.log(u3 * u4))
            t = np.floor(np.log(weight) / r + b)
            rows = slice(n + i, n + i + len(some))
            self.log_a[rows] = log_c - r * (t - b + 1.0)
            self.code[rows] = mix64(h[:, None] ^ (t.astype(np.int64).astype(np.uint64) * _STEP + self.draws[:k])) >> np.uint64(48)
        self.at.update(zip(terms, range(n, need)))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """samples x uint16; without words, all zero."""
        if not words:
            return np.zeros(self.samples, dtype=np.uint16)
        terms = list(Counter(words).items())
        got = list(map(self.at.get, terms))
        if None in got:
            if len(self.at) > self.remember:
                self._clear(len(self.log_a))
                got = [None] * len(terms)
            self._learn([t for t, x in zip(terms, got) if x is None])
            got = list(map(self.at.get, terms))
        i = np.array(got)
        best = i[np.argmin(self.log_a[i], axis=0)]
        return self.code[best, np.arange(self.samples)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def signature(text: bytes, samples: int = 64) -> np.ndarray:
    return sampler(samples)(text.split())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 64) -> DataFrame:
    """(id_col, fingerprint) of every row: the samples of its words by their counts, four
    hex digits each. Null text counts as empty, and texts without words have zeros."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = [signature(t, samples).astype(">u2").tobytes().hex() for t in raw(part, "text")]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by the start of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 64) -> DataFrame:
    """Every row with the next in descending id order (after the last the first): (id_col,
    n_chars, edited_text, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). The edited text is the row's with its last third replaced by the start of the
    next row's; the likenesses are shares of equal samples.

    Null text counts as empty. A null id counts as the largest. Rows of one id are ordered by
    a hash of their text; equal rows are each other's next. A table of one row is its own
    next; an empty table gives no rows. Other columns are ignored.

    The rows are dealt once, into ranges of ids; each range also gets a copy of the row that
    follows its last. The bounds come from a quantile sketch of the ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), ordered(F.col(id_col)).alias("did"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tie"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = docs.select(ordered(F.col(id_col)).alias("did"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.approxQuantile("did", [i / n for i in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = F.array(*[F.lit(x) for x in sorted({min(int(x), 2**63 - 1) for x in cuts})]).cast("array<long>")

    def part(did):  # range 0 holds the largest ids
        return F.size(F.filter(bounds, lambda x: x > did))

    ranges = ids.groupBy(part(F.col("did")).alias("part")).agg(F.max("did").alias("top")).orderBy("part").collect()  # n rows at most
    above = F.create_map(*[F.lit(x).cast("long") for i, r in enumerate(ranges) for x in (r.top, ranges[i - 1].part)]) if ranges else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for b in slices(batch, "text"):
                i = b.schema.get_field_index("text")
                yield b.set_column(i, "packed", pa.array(list(map(squeeze, raw(b, "text"))), pa.binary()))

    # the rows of a range's largest id also go to the range above it, which uses the first of
    # them; the first range's go to the last
    place = lambda p, copy: F.struct(p.cast("long").alias("part"), F.lit(copy).alias("copy"))
    up = F.element_at(above, F.col("did"))
    places = F.when(up.isNull(), F.array(place(part(F.col("did")), False))).otherwise(F.array(place(part(F.col("did")), False), place(up, True)))
    dealt = rows.mapInArrow(pack, f"id {kind}, did long, tie long, packed binary").withColumn("to", F.explode(places))
    dealt = dealt.select("id", "did", "tie", "packed", F.col("to.part").alias("to"), F.col("to.copy").alias("copy"))
    dealt = dealt.repartitionById(n, F.col("to").cast("int")).sortWithinPartitions("to", "copy", F.desc("did"), "tie")

    def run(batches):
        sample = sampler(samples)
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # the row whose next comes now: (id, part, text, signature)
        out: list[tuple] = []

        def emit():
            names = ["id", "n_chars", "edited_text", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        size = 0
        for batch in batches:
            id_type = batch.column(0).type
            ids, parts, copies = batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for d, p, is_copy, packed in zip(ids, parts, copies, raw(batch, "packed")):
                if is_copy and (last is None or last[1] != p):
                    continue
                data = unpack(packed)
                text, mark = data.decode("utf-8", "replace"), sample(data.split())
                if last and last[1] == p:
                    new = edit(last[2], text)
                    coded = new.encode()
                    changed = sample(coded.split())
                    out.append((last[0], len(last[2]), new, hashlib.sha256(coded).hexdigest(), last[3].astype(">u2").tobytes().hex(), changed.astype(">u2").tobytes().hex(), likeness(last[3], changed), likeness(last[3], mark)))
                    size += len(coded)
                last = None if is_copy else (d, p, text, mark)
                if size > 1 << 21:
                    yield emit()
                    size = 0
        if out:
            yield emit()

    return dealt.mapInArrow(run, f"id {kind}, n_chars long, edited_text string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
