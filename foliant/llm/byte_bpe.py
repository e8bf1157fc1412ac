"""Byte-level BPE over whole batches: pieces found by a scan, distinct pieces merged once, ids gathered."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm import common as c
from foliant.llm.pretokens import pieces
from foliant.llm.words import hash_words

#: Distinct pieces a worker remembers; beyond, it forgets all and starts anew.
CACHE = 1 << 18
_WIDE = 40
_NONE = np.int64(1 << 40)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, offsets array<int>"


class Ranks:
    """A rank file's tokens, and the rank of each pair of tokens that may merge."""

    _loaded: dict[str, "Ranks"] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.rank.values()) + 1
        self.bytes = [b""] * size
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.size = size
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.rank[t[:k]] * size + self.rank[t[k:]], r) for t, r in self.rank.items() for k in range(1, len(t)) if t[:k] in self.rank and t[k:] in self.rank]
        pairs.sort()
        self.pair, self.pair_rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    @classmethod
    def load(cls, path: str) -> "Ranks":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[i] == key) & (left >= 0) & (right >= 0), self.pair_rank[i], _NONE)

    def merge(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each piece, as packed unsigned 32-bit integers: pieces of like length are merged together."""
        out: list[bytes] = [b""] * len(texts)
        size = np.array([len(t) for t in texts], np.int64)
        whole = [self.rank.get(t) for t in texts]
        todo = np.array([w is None for w in whole], bool)
        for i, w in enumerate(whole):
            if w is not None:
                out[i] = w.to_bytes(4, "little")
        for width in (4, 8, 12, 20, _WIDE):
            some = np.flatnonzero(todo & (size <= width))
            todo[some] = False
            if len(some):
                grid = np.frombuffer(b"".join(texts[i].ljust(width, b"\0") for i in some), np.uint8).reshape(len(some), width)
                ids = np.where(np.arange(width) < size[some, None], self.single[grid], -1)
                for i, row, n in zip(some, *self._merge_grid(ids)):
                    out[i] = row[:n].astype("<u4").tobytes()
        for i in np.flatnonzero(todo):
            out[i] = self._merge_one(texts[i])
        return out

    def _merge_grid(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = ids.shape
        rank = self.of_pairs(ids[:, :-1], ids[:, 1:])
        rank = np.concatenate([rank, np.full((n, 1), _NONE)], axis=1)
        column = np.arange(width)
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(axis=1)
            best = rank[live, j]
            going = best < _NONE
            live, j, best = live[going], j[going], best[going]
            if not len(live):
                break
            take = np.minimum(column + (column > j[:, None]), width - 1)
            new = np.take_along_axis(ids[live], take, axis=1)
            new[:, -1] = -1
            r = np.take_along_axis(rank[live], take, axis=1)
            r[:, -1] = _NONE
            k = np.arange(len(live))
            new[k, j] = best
            r[k, j] = self.of_pairs(best, new[k, np.minimum(j + 1, width - 1)])
            before = j > 0
            r[k[before], j[before] - 1] = self.of_pairs(new[k[before], j[before] - 1], best[before])
            ids[live], rank[live] = new, r
        return ids, (ids >= 0).sum(axis=1)

    def _merge_one(self, text: bytes) -> bytes:
        """One long piece: least rank first, leftmost among equals, by a heap over a linked list."""
        ids: list[int | None] = self.single[np.frombuffer(text, np.uint8)].tolist()
        after = [*range(1, len(ids)), -1]
        prior = [-1, *range(len(ids) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.rank.get(self.bytes[ids[i]] + self.bytes[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, None
            after[i] = after[j]
            if after[j] >= 0:
                prior[after[j]] = i
            offer(i)
            if prior[i] >= 0:
                offer(prior[i])
        return np.array([x for x in ids if x is not None], "<u4").tobytes()

    def decode(self, ids: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and where each range's bytes are."""
        return gather(self.flat, self.at, self.length, ids, ranges)


def gather(flat: np.ndarray, at: np.ndarray, length: np.ndarray, which: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the numbered runs of ``flat``, and where each range of ``which`` ends up in it."""
    size = length[which]
    end = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(end[-1]) + np.repeat(at[which] - end[:-1], size)
    return flat[index], end[ranges]


class Encoder:
    """Ids of whole batches; ``merge`` maps distinct new pieces to packed ids. Over ``most`` pieces (about 40 bytes each) are forgotten."""

    def __init__(self, merge: Callable[[list[bytes]], list[bytes]], most: int = CACHE):
        self.merge, self.most = merge, most
        self._forget()

    def _forget(self) -> None:
        """Known pieces: hashes in their order, where the ids of each are in ``ids``, and how many."""
        self.known, self.at, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, place: np.ndarray, hashes: np.ndarray, packed: list[bytes]) -> None:
        length = np.array([len(p) for p in packed], np.int64) // 4
        self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(length) - length)
        self.known, self.length = np.insert(self.known, place, hashes), np.insert(self.length, place, length)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), "<u4")])

    def __call__(self, data: np.ndarray, offs: np.ndarray):
        """(ids, each text's range in them, pieces' byte starts, each piece's range of ids, texts' ranges of pieces)."""
        starts, ends, ranges = pieces(data, offs)
        hashes = hash_words(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[place] != distinct
        new |= place == len(self.known)
        if new.any():
            text, some = data.tobytes(), first[new]
            got = self.merge([text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])
            self._learn(place[new], distinct[new], got)
            place += np.cumsum(new) - new
        ids, bounds = gather(self.ids, self.at, self.length, place[which], np.arange(len(which) + 1))
        return ids, bounds[ranges], starts, bounds, ranges


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each text's ids by the ranks in ``path``, and the digest of the bytes they decode to.

    One row for each input row, in no set order. A null or empty text has no ids; a null id stays null. Other columns
    are ignored. ids_sha256 is of the decimal ids joined by one space. With keep_ids, ids and offsets (the byte in the
    text where each id begins) are given, else null. Pieces compare by 64-bit hashes. A worker's memory is bounded by
    a slice of texts (one text, if it is longer) and CACHE pieces.
    """

    def run(batches):
        ranks = Ranks.load(path)
        encoder = Encoder(ranks.merge)
        decimal = [str(i) for i in range(ranks.size)]
        for whole in batches:
            for batch in c.slices(whole, "text", c.FINE_BYTES):
                data, offs = c.flat(batch.column("text"))
                ids, ranges, *_ = encoder(data, offs)
                text, bounds = ranks.decode(ids, ranges)
                begins = np.cumsum(ranks.length[ids]) - ranks.length[ids] if keep_ids else None
                listed = ids.tolist()
                rows = []
                for i in range(batch.num_rows):
                    a, b = ranges[i], ranges[i + 1]
                    joined = " ".join([decimal[x] for x in listed[a:b]])
                    rows.append((int(b - a), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text[bounds[i] : bounds[i + 1]].tobytes()).hexdigest(), ids[a:b].astype(np.int32) if keep_ids else None, (begins[a:b] - bounds[i]).astype(np.int32) if keep_ids else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_id").to_pylist(), pa.int64()), *(pa.array(list(v), t) for v, t in zip(zip(*rows), kinds))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"coalesce(cast(`{text_col}` as string), '') text").mapInArrow(run, SCHEMA)
