"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is itself in the vocabulary is found by a minimal perfect hash: keys
fall into buckets, a bucket's displacement sends its keys to free slots of a table
that has exactly one slot a key, and the key stored there is compared. All other
pre-tokens are merged by rank, with a heap of candidate pairs over a linked list of
their bytes. Both results are kept, packed, in a bounded cache of the worker.
"""

from __future__ import annotations

import base64
import heapq
import itertools

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, small_batches, texts

#: Pre-tokens that a worker remembers; the cache starts anew when it is full.
REMEMBERED = 100_000
#: Pre-tokens of one step over a text, so that very long texts need little memory.
STEP = 1 << 17

_MASK = (1 << 64) - 1
_remembered: dict[bytes, dict] = {}


def _slot(h: int, d: int, n: int) -> int:
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``index(key)`` is its place, or -1 for any other."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        self.moves, self.keys, self.places = [0] * self.buckets, [b""] * n, [-1] * n
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            buckets[h % self.buckets].append((h, i))
        order = sorted(range(self.buckets), key=lambda b: -len(buckets[b]))
        free = iter(())
        for b in order:
            held = buckets[b]
            if len(held) > 1:
                d = 0
                while True:
                    slots = {_slot(h, d, n) for h, _ in held}
                    if len(slots) == len(held) and all(self.places[s] < 0 for s in slots):
                        break
                    d += 1
                self.moves[b] = d
                for h, i in held:
                    self._put(_slot(h, d, n), i, keys)
            elif held:  # a bucket of one key takes the next free slot outright
                s = next(free, None)
                if s is None:
                    free = iter([s for s in range(n) if self.places[s] < 0])
                    s = next(free)
                self.moves[b] = -s - 1
                self._put(s, held[0][1], keys)

    def _put(self, slot: int, i: int, keys: list[bytes]) -> None:
        self.keys[slot], self.places[slot] = keys[i], i

    def index(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.moves[h % self.buckets]
        s = -d - 1 if d < 0 else _slot(h, d, self.n)
        return self.places[s] if self.keys[s] == key else -1


class Codec:
    """A vocabulary of ranks with the pattern that splits texts before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in tokens]
        self.whole = PerfectHash(tokens)
        self.mark = xxhash.xxh3_128_digest(pattern.encode() + b"\0".join(tokens))

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Codec:
        """A file of lines: base64 of the token's bytes, blank, rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token: lowest rank first, leftmost among equals."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = after[i]
            if mid < 0 or mid >= n or after[mid] != end:  # one of the two is merged already
                continue
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                far = after[end]
                if (r := rank(word[i:far])) is not None:
                    heapq.heappush(heap, (r, i, far))
            if (p := before[i]) >= 0 and (r := rank(word[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def piece(self, word: bytes) -> list[int]:
        at = self.whole.index(word)
        return [self.ids[at]] if at >= 0 else self.merged(word)

    def encoder(self):
        """A function from a text to its ids, packed as little-endian unsigned 32-bit integers."""
        codec, split = self, regex.compile(self.pattern)

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                got = self[piece] = np.array(codec.piece(piece.encode()), "<u4").tobytes()
                return got

        known = _remembered.setdefault(self.mark, Pieces())

        def encode(text: str) -> bytes:
            if len(known) > REMEMBERED:
                known.clear()
            if len(text) <= STEP:
                return b"".join([known[p] for p in split.findall(text)])
            out, found = [], (m.group() for m in split.finditer(text))
            while step := list(itertools.islice(found, STEP)):
                out += [known[p] for p in step]
                if len(known) > REMEMBERED:
                    known.clear()
            return b"".join(out)

        return encode

    def decoder(self):
        """A function from packed ids to bytes."""
        token = {i: t for t, i in self.ranks.items()}.__getitem__
        return lambda ids: b"".join(map(token, memoryview(ids).cast("I")))


def encode_batch(codec: Codec, column: pa.Array, encode=None) -> pa.Array:
    """Texts (null: empty) to lists of ids."""
    encode = encode or codec.encoder()
    packed = [encode(t) for t in texts(column)]
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    ids = np.frombuffer(b"".join(packed), "<u4").view(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def decode_batch(codec: Codec, ids: pa.Array, decode=None) -> pa.Array:
    """Lists of ids (null: empty) to the bytes that they stand for."""
    decode = decode or codec.decoder()
    return pa.array([decode(np.asarray(x.values if x.is_valid else [], np.int32).tobytes()) for x in ids], pa.binary())


def encode(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) of the whole texts.

    Null and empty texts get an empty list; a column of that name is replaced; repeated
    rows and empty tables need nothing special. No shuffle; each batch is on its own.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(ids)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = codec.encoder()
        for b in batches:
            got = encode_batch(codec, b.column(b.schema.get_field_index(text)), enc)
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, ids])

    return rest.mapInArrow(lean(run), schema)


def decode(docs: DataFrame, codec: Codec, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``docs`` with ``data`` (binary), the bytes of ``ids``; a null list gives no bytes.

    An id that the vocabulary lacks is an error. A column named ``data`` is replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(data)
    schema = T.StructType([*rest.schema.fields, T.StructField(data, T.BinaryType())])

    def run(batches):
        dec = codec.decoder()
        for b in batches:
            got = decode_batch(codec, b.column(b.schema.get_field_index(ids)), dec)
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, data])

    return rest.mapInArrow(lean(run), schema)


def encode_checked(docs: DataFrame, codec: Codec, text: str = "text", ids: str = "ids", ok: str = "round_trip") -> DataFrame:
    """As ``encode``, and ``ok``: whether the ids decode to the text's bytes. One worker does both."""
    small_batches(docs.sparkSession)
    rest = docs.drop(ids, ok)
    schema = T.StructType([*rest.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(ok, T.BooleanType())])

    def run(batches):
        enc, dec = codec.encoder(), codec.decoder()
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            got = encode_batch(codec, column, enc)
            same = [x == t.encode() for x, t in zip(decode_batch(codec, got, dec).to_pylist(), texts(column), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, got, pa.array(same, pa.bool_())], [*b.schema.names, ids, ok])

    return rest.mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and digests both.

    The lists of ids go from encoder to decoder inside the worker.
    """
    import hashlib

    small_batches(docs.sparkSession)
    base = docs.select("doc_id", "text")
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        enc, dec = codec.encoder(), codec.decoder()
        hexed = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            ids = encode_batch(codec, b.column(1), enc)
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            packed = [flat[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
            cols = [b.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array([hexed(p) for p in packed], pa.string()), pa.array([hexed(dec(p)) for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return base.mapInArrow(lean(run), schema)
