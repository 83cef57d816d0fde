"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

Texts are cut into pieces by the pre-tokenisation pattern. The distinct pieces of a slice are laid out as rows of padded matrices, one matrix for each range of lengths. In every round each row merges its leftmost pair of minimum rank; pair ranks come from a hash table of all (left id, right id) pairs whose bytes form a token. Rows without a mergeable pair leave the matrix (compaction). Pieces beyond ``LONG`` bytes are rows of their own; there all leftmost disjoint occurrences of the minimum rank merge in one round, unless such a merge would open a pair of lower rank, in which case only the leftmost merges, so the order of merges is the same.

Nulls count as empty texts; an empty text has no ids, the digest of the empty string, and decodes to no bytes. Repeated rows and repeated ids give one output row for each input row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashtable import HashTable
from .shared import in_batches, in_slices, kept, table

LONG = 64
CELLS = 1 << 19
#: Distinct pieces remembered by a worker before it starts anew.
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.bytes_of_text = {str(i): t for t, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(i)
        self.pairs = HashTable(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(rank, np.int32))
        self.known: dict[str, str] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.lookup(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where(found < 0, _NONE, found)

    def _matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Ids of pieces of ``width`` bytes at most."""
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.byte_id[raw]
        out: list[list[int]] = [[]] * len(pieces)
        where = np.arange(len(pieces))
        rank = np.full(ids.shape, _NONE, np.int32)  # the last column stands for no pair
        real = np.arange(1, width)[None, :] < n[:, None]
        rank[:, :-1][real] = self._ranks(ids[:, :-1][real], ids[:, 1:][real])
        while len(where):
            rows = np.arange(len(where))
            at = rank.argmin(axis=1)
            best = rank[rows, at]
            done = best == _NONE
            if done.any():
                for w, k, row in zip(where[done], n[done].tolist(), ids[done].tolist(), strict=True):
                    out[w] = row[:k]
                go = ~done
                ids, rank, n, where, at, best = ids[go], rank[go], n[go], where[go], at[go], best[go]
                if not len(where):
                    break
                width = int(n.max())
                ids, rank = ids[:, :width], rank[:, :width]
                rows = np.arange(len(where))
            ids[rows, at] = best
            if width > 1:
                move = np.arange(1, width - 1)[None, :] > at[:, None]
                ids[:, 1:-1] = np.where(move, ids[:, 2:], ids[:, 1:-1])
                rank[:, 1:-1] = np.where(move, rank[:, 2:], rank[:, 1:-1])
                rank[:, -1] = _NONE
            n = n - 1
            for shift in (-1, 0):
                left = at + shift
                ok = (left >= 0) & (left + 1 < n)
                r, c = rows[ok], left[ok]
                rank[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
                if shift == 0:
                    rank[rows[~ok], at[~ok]] = _NONE
        return out

    def _long(self, piece: bytes) -> list[int]:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self._ranks(ids[:-1], ids[1:])
        while len(ids) > 1:
            best = rank.min()
            if best == _NONE:
                break
            at = np.flatnonzero(rank == best)
            if len(at) > 1:
                run = np.cumsum(np.r_[True, np.diff(at) != 1])
                first = at[np.r_[True, np.diff(run) != 0]]
                at = at[(at - first[run - 1]) % 2 == 0]
            for chosen in (at, at[:1]):
                keep = np.ones(len(ids), bool)
                keep[chosen + 1] = False
                kept = np.flatnonzero(keep)
                new = chosen - np.arange(len(chosen))
                merged, ranks = ids[kept], rank[kept[1:] - 1]
                merged[new] = best
                near = np.unique(np.r_[new - 1, new])
                near = near[(near >= 0) & (near + 1 < len(merged))]
                ranks[near] = fresh = self._ranks(merged[near], merged[near + 1])
                if len(chosen) == 1 or not len(near) or fresh.min() > best:
                    break
            ids, rank = merged, ranks
        return ids.tolist()

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; the pieces are taken as they are, without the pattern."""
        out: list[list[int]] = [[]] * len(pieces)
        order = sorted((i for i in range(len(pieces)) if pieces[i]), key=lambda i: len(pieces[i]))
        start = 0
        while start < len(order):
            shortest = len(pieces[order[start]])
            if shortest > LONG:
                for i in order[start:]:
                    out[i] = self._long(pieces[i])
                break
            limit = min(LONG, shortest + max(1, shortest // 4))
            end = start
            while end < len(order) and len(pieces[order[end]]) <= limit and (end - start) * limit < CELLS:
                end += 1
            part = order[start:end]
            for i, ids in zip(part, self._matrix([pieces[i] for i in part], len(pieces[part[-1]])), strict=True):
                out[i] = ids
            start = end
        return out

    def encode_texts(self, texts: list[str]) -> list[str]:
        """For each text its ids in decimal, joined by one space."""
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*cut).difference(self.known)
        if new:
            new = list(new)
            self.known.update(zip(new, (" ".join(map(str, ids)) for ids in self.encode_pieces([p.encode() for p in new])), strict=True))
        get = self.known.__getitem__
        return [" ".join(map(get, pieces)) for pieces in cut]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode_text_ids(self, ids: list[str]) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, ids))


def encoder(path: str, pattern: str) -> ByteBpe:
    return kept((path, pattern), lambda: ByteBpe.from_file(path, pattern))


def _public() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = encoder(path, pattern)
    for batch in batches:
        keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        for start, end in in_slices(texts):
            part = texts[start:end]
            counts, ids_sha, decoded_sha, all_ids = [], [], [], []
            for joined in bpe.encode_texts(part):
                ids = joined.split(" ") if joined else []
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode_text_ids(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32) if ids else np.empty(0, np.int32))
            arrays = [keys.slice(start, end - start), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes each text and decodes its ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``with_ids``, the ids. No shuffle; a task holds one slice of texts and a bounded memory of pieces.
    """
    default = _public()
    path, pattern = path or default[0], pattern or default[1]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return in_batches(rows, lambda batches: _encoded(batches, path, pattern, with_ids), schema)


def decode(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes of a column of ids; null ids give no bytes."""
    default = _public()
    path, pattern = path or default[0], pattern or default[1]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return in_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
