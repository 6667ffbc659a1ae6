"""Problem 6: encoding of the whole corpus with a public byte-level BPE tokenizer.

Texts are cut into pieces by the tokenizer's public pattern; the pieces that a batch has not met yet are sorted
into length buckets, laid out as padded numpy matrices of symbol ids, and merged round by round: in each round every row
merges its leftmost pair of minimum rank. Ranks come from a hashed table of pairs; merged rows are compacted, and rows
that have no pair left leave the matrix. Null and empty texts give an empty list.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.common import batches

TOKENIZERS = "/opt/tokenizers"
#: A vocabulary file may be this large; it is broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Rows of more than 2**WIDE_BITS bytes find their least rank from the least ranks of blocks of so many places.
WIDE_BITS = 9

_NONE = np.int64(1 << 40)
_EMPTY = np.int64(-1)


def byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary file writes for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Open addressing over int64 keys: rank of a pair of symbols, looked up for whole matrices at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.merged = merged
        bits = int(np.ceil(np.log2(max(2, len(left))))) + 2
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, _EMPTY)
        self.ranks = np.full(1 << bits, _NONE)
        self.probes = 0
        keys = (left << 32) | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[at] == _EMPTY
            # of the keys that want the same free slot the one written last holds it
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.ranks[at[won]] = todo[won]
            todo, at = todo[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << 32) | right
        flat = keys.ravel()
        at = self._slot(flat)
        out = np.where(self.keys[at] == flat, self.ranks[at], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[at] != _EMPTY))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == flat[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out.reshape(keys.shape)


class Encoder:
    """Encodes many pieces at once; keeps the ids of pieces seen, up to a bound of entries."""

    def __init__(self, vocabulary: bytes, keep: int = 300_000, cells: int = 1 << 20):
        model = json.loads(vocabulary)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pairs = PairTable(left, right, merged)
        self.pattern = regex.compile(PATTERN)
        self.seen: dict[str, np.ndarray] = {}
        self.keep, self.cells = keep, cells

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.seen) > self.keep:
            self.seen.clear()
        cut = [self.pieces(t) if t else [] for t in texts]
        new = list({p for ps in cut for p in ps if p not in self.seen})
        self._learn(new)
        seen, none = self.seen, np.empty(0, np.int32)
        return [np.concatenate([seen[p] for p in ps]) if ps else none for ps in cut]

    def _learn(self, pieces: list[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "replace")
            buckets.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((p, raw))
        for p, raw in (x for bits in [b for b in buckets if b > WIDE_BITS] for x in buckets.pop(bits)):
            self.seen[p] = self._merge_wide(raw)
        for bits, members in buckets.items():
            step = max(1, self.cells >> bits)
            for start in range(0, len(members), step):
                part = members[start : start + step]
                for (p, _), ids in zip(part, self._merge([raw for _, raw in part]), strict=True):
                    self.seen[p] = ids

    def _merge(self, rows: list[bytes]) -> list[np.ndarray]:
        """Symbols right of a row's end are -1; a pair with one of them is in no table."""
        width = max(map(len, rows))
        m = np.full((len(rows), width), -1, np.int64)
        for k, raw in enumerate(rows):
            m[k, : len(raw)] = self.of_byte[np.frombuffer(raw, np.uint8)]
        where, out = np.arange(len(rows)), [np.empty(0, np.int32)] * len(rows)
        ranks = self._ranks(m)
        while len(m):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(m), np.int64)  # the first of equal ranks is the leftmost
            least = ranks[np.arange(len(m)), best] if ranks.shape[1] else np.full(len(m), _NONE)
            ended = least == _NONE
            if ended.any():
                for k in np.flatnonzero(ended):
                    row = m[k]
                    out[where[k]] = row[row >= 0].astype(np.int32)
                m, where, ranks, best, least = m[~ended], where[~ended], ranks[~ended], best[~ended], least[~ended]
                if not len(m):
                    break
                used = int((m >= 0).sum(axis=1).max())
                m, ranks = m[:, :used], ranks[:, : used - 1]
            rows_ = np.arange(len(m))
            m[rows_, best] = self.pairs.merged[least]
            columns = np.arange(m.shape[1] - 1)
            # close the gap: what stood right of the merged pair moves one place left
            source = columns + (columns[None, :] > best[:, None])
            closed = np.take_along_axis(m, source, axis=1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=_NONE), source, axis=1)[:, : closed.shape[1] - 1]
            m = closed
            for at in (best - 1, best):  # only the pairs beside the merged symbol change
                ok = (at >= 0) & (at < m.shape[1] - 1)
                if ok.any():
                    r = rows_[ok]
                    ranks[r, at[ok]] = self._pair(m[r, at[ok]], m[r, at[ok] + 1])
        return out

    def _merge_wide(self, raw: bytes) -> np.ndarray:
        """A row too wide to search and close up in each round: again its leftmost pair of minimum rank is merged a round.

        Symbols keep their places and know the next and the one before; the ranks stand as a matrix of blocks, so a round
        looks at the blocks' least ranks, at one block, and renews at most three.
        """
        width, n = 1 << WIDE_BITS, len(raw)
        sym = self.of_byte[np.frombuffer(raw, np.uint8)]
        ranks = np.full((-(-n // width), width), _NONE)
        flat = ranks.reshape(-1)
        flat[: n - 1] = self.pairs.rank(sym[:-1], sym[1:])
        least = ranks.min(axis=1)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        while True:
            block = int(least.argmin())
            if least[block] == _NONE:
                break
            at = (block << WIDE_BITS) + int(ranks[block].argmin())
            gone = int(after[at])
            sym[at] = self.pairs.merged[flat[at]]
            sym[gone], flat[gone] = -1, _NONE
            right, left = int(after[gone]), int(before[at])
            after[at] = right
            if right < n:
                before[right] = at
            flat[at] = self.pairs.rank(sym[at : at + 1], sym[right : right + 1])[0] if right < n else _NONE
            if left >= 0:
                flat[left] = self.pairs.rank(sym[left : left + 1], sym[at : at + 1])[0]
            for b in {block, gone >> WIDE_BITS, max(0, left) >> WIDE_BITS}:
                least[b] = ranks[b].min()
        return sym[sym >= 0].astype(np.int32)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where((left >= 0) & (right >= 0), self.pairs.rank(np.maximum(left, 0), np.maximum(right, 0)), _NONE)

    def _ranks(self, m: np.ndarray) -> np.ndarray:
        return self._pair(m[:, :-1], m[:, 1:])


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast; its size is checked."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row of docs, repeated rows included.

    Special tokens' strings are ordinary text. Null and empty texts give an empty list; other columns of docs are ignored.
    """
    raw = vocabulary(docs.sparkSession, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches(rows):
            ids = enc.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[id_col, "ids"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"{id_col} {chosen.schema[id_col].dataType.simpleString()}, ids array<int>")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """(id_col, n_tokens INT): the number of tokens of every row; 0 for null and empty texts."""
    raw = vocabulary(docs.sparkSession, path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in batches(rows):
            n = [len(x) for x in enc.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=[id_col, "n_tokens"])

    chosen = docs.select(id_col, text_col)
    return chosen.mapInArrow(run, f"{id_col} {chosen.schema[id_col].dataType.simpleString()}, n_tokens int")
