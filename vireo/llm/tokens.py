"""Token ids by the tokenizers library: each distinct word of a block of texts once."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes that may follow a space at which a text is cut: not white space, and not the first
#: byte of a character that may be white space (U+0085, U+00A0, U+1680, U+2000 and so on).
_AFTER = np.ones(256, dtype=bool)
_AFTER[:0x21] = False
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts, as uint32 arrays.

    Texts are cut before spaces that a character other than white space follows: byte-level
    pre-tokenisation always starts a token there, so a text's ids are those of its parts in
    turn. The library encodes the distinct parts of a block of texts; their ids are then
    laid out for all. From one block to the next are kept, `remember` at most, the parts
    that the last block had twice or that were kept before and came again. A special token
    that a text spells out is one id, as the library's plain call gives it.
    """

    def __init__(self, path: str, remember: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # executors have one task a core already
        self.tokenizer = Tokenizer.from_file(path)
        self.remember, self.known = remember, None
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.starts = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)])  # how the vocabulary writes a space

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts, and for each part where they start and how many there are. Parts
        whose only space is their first letter are encoded as one text, in which just their
        first tokens start with a space; others for themselves."""
        at = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
        data = np.frombuffer(parts.buffers()[2], np.uint8)
        spaces = np.add.reduceat(data[: at[-1]] == 0x20, at[:-1], dtype=np.int64)
        plain = np.flatnonzero((spaces == 1) & (data[at[:-1]] == 0x20))
        odd = [np.flatnonzero((spaces != 1) | (data[at[:-1]] != 0x20))]
        flat, where, count = [], [], []
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = self._encode(["".join(parts.take(pa.array(some)).to_pylist())])[0]
            first = np.flatnonzero(self.starts[ids])
            if len(first) != len(some) or first[0]:
                odd.append(some)
                continue
            flat.append(ids)
            where.append(some)
            count.append(np.diff(np.r_[first, len(ids)]))
        rest = np.concatenate(odd)
        for i in range(0, len(rest), 4096):
            some = rest[i : i + 4096]
            ids = self._encode(parts.take(pa.array(some)).to_pylist())
            flat += ids
            where.append(some)
            count.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        order, n = np.concatenate(where), np.concatenate(count)
        size, first = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        size[order], first[order] = n, np.cumsum(n) - n
        return np.concatenate(flat), first, size

    def _lookup(self, parts: pa.StringArray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _distinct, for parts of which some may be known; counts says how often they came."""
        if self.known is None:
            flat, first, size = self._distinct(parts)
            again = counts > 1
        else:
            own, flat, first_k, size_k = self.known
            at = pc.index_in(parts, value_set=own).fill_null(-1).to_numpy()
            new = np.flatnonzero(at < 0)
            first, size = first_k[at], size_k[at]
            if len(new):
                more, first[new], size[new] = self._distinct(parts.take(pa.array(new)))
                first[new] += len(flat)
                flat = np.r_[flat, more]
            again = (counts > 1) | (at >= 0)
        keep = np.flatnonzero(again)
        if len(keep) > self.remember:
            keep = keep[np.argsort(-counts[keep], kind="stable")[: self.remember]]
        n = size[keep]
        begin = np.cumsum(n) - n
        self.known = (parts.take(pa.array(keep)), flat[np.repeat(first[keep] - begin, n) + np.arange(n.sum())], begin, n) if len(keep) else None
        return flat, first, size

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        return [ids for some in self.groups(texts) for ids in some]

    def groups(self, texts: list[bytes], group_bytes: int = 1 << 21):
        """The ids of the texts in turn, as lists for runs of texts of about group_bytes: all
        texts' distinct parts are encoded first, but ids are laid out for one run at a time."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        if not data:
            yield [np.empty(0, "<u4")] * len(texts)
            return
        buf = np.frombuffer(data, np.uint8)
        begins = np.r_[0, np.cumsum(sizes)]
        cut = np.zeros(len(buf) + 1, dtype=bool)
        cut[: len(buf) - 1] = (buf[:-1] == 0x20) & _AFTER[buf[1:]]
        cut[begins] = True
        at = np.flatnonzero(cut).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        which = parts.indices.to_numpy(zero_copy_only=False)
        flat, first, size = self._lookup(parts.dictionary, np.bincount(which))
        begin_part = np.searchsorted(at, begins)  # empty texts have no part
        del parts, at, cut, buf, data
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(begins, begins[i] + group_bytes, side="right")) - 1)
            own = which[begin_part[i] : begin_part[j]]
            n = size[own]
            ends = np.cumsum(n)
            out = flat[np.repeat(first[own] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            stops = np.r_[0, ends][begin_part[i : j + 1] - begin_part[i]].tolist()
            yield [out[a:b] for a, b in zip(stops, stops[1:])]
            i = j


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder of a vocabulary file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
