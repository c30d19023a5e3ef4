"""Media payloads in content-defined chunks.

A rolling gear hash cuts each payload where its top bits are zero, between LEAST and MOST bytes. Chunks that the corpus
has more than once go to a shared table, each digest once; all others stay with their payload. A row of the media
table has the stored form of a payload: lengths, the ordered list of its chunks (length, digest, whether shared) and its
own chunks' bytes. A payload is put together from that form and the shared chunks that it names, and verified; what is
said about the form (its size and hash) is measured on the bytes read back.

Which digests are shared: digests are counted by a Spark aggregate, and those with a count over one set bits in a
fixed bitmap of BITMAP bits, which workers get. A bit that is set by another digest only makes a chunk take the shared
way. So the payloads that share nothing, nearly all bytes, are read back where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, new_path, pick, small_batches

#: A payload is a multiple of a tile of 24 x 24 samples.
SIDE = 24
TILE = SIDE * SIDE
LEAST, MASK_BITS, MOST = 1024, 11, 8192
#: Bits of the bitmap of shared digests: 8 MB at most, whatever the corpus.
BITMAP = 1 << 26
MAGIC = b"CDC1"
DIGEST = 32
ENTRY = struct.Struct(f"<I?{DIGEST}s")


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded with 255 to a positive multiple of a tile; and how many they are without."""
    raw = as_bytes(text)
    return raw + b"\xff" * (max(TILE, -(-len(raw) // TILE) * TILE) - len(raw)), len(raw)


@lru_cache(1)
def gear() -> np.ndarray:
    """A number of 32 bits for each byte, from a digest of it."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def rolling(raw: bytes) -> np.ndarray:
    """The gear hash after each byte: h = 2h + gear[b] modulo 2 ** 32, so of the last 32 bytes; by doubling."""
    h = gear()[np.frombuffer(raw, np.uint8)]
    for k in range(5):
        step = 1 << k
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(raw)
    if n <= LEAST:
        return [n]
    places = (np.flatnonzero(rolling(raw) >> np.uint32(32 - MASK_BITS) == 0) + 1).tolist()
    out, at, i = [], 0, 0
    while n - at > LEAST:
        while i < len(places) and places[i] < at + LEAST:
            i += 1
        at = min(places[i] if i < len(places) else n, at + MOST, n)
        out.append(at)
    if not out or out[-1] < n:
        out.append(n)
    return out


def chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in their order."""
    ends = cuts(raw)
    return [(hashlib.sha256(part := raw[a:b]).digest(), part) for a, b in zip([0, *ends], ends, strict=False)]


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % BITMAP


HEAD = struct.Struct("<4sQQI")


def form_of(raw: bytes, n_bytes: int, parts: list[tuple[bytes, bytes, bool]]) -> bytes:
    """The stored form: magic, lengths, the list of chunks (digest, bytes, whether shared), the own ones' bytes in order."""
    return b"".join([HEAD.pack(MAGIC, n_bytes, len(raw), len(parts)), *[ENTRY.pack(len(p), s, d) for d, p, s in parts], *[p for _, p, s in parts if not s]])


def read_form(form: bytes) -> tuple[int, int, list[tuple[int, bool, bytes]], int]:
    """Unpadded and padded length of the payload, its chunks (length, whether shared, digest), and where own bytes start."""
    magic, n_bytes, length, n = HEAD.unpack_from(form)
    if magic != MAGIC:
        raise ValueError("not a stored payload")
    to = HEAD.size + n * ENTRY.size
    return n_bytes, length, list(ENTRY.iter_unpack(form[HEAD.size : to])), to


def _shared_bitmap(docs: DataFrame) -> np.ndarray:
    """Bits of digests that occur more than once. Only hashes of digests are shuffled."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for t in batch.column("text").to_pylist():
                for d, _ in chunks(payload(t)[0]):
                    h = int.from_bytes(d[:8], "little", signed=True)
                    found[h] = found.get(h, 0) + 1
            yield pa.RecordBatch.from_pydict({"h": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    counted = docs.mapInArrow(digests, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    # The unsigned hash modulo 2 ** 26 is its low bits. Grouped by words of 64 bits: 2 ** 20 rows at most.
    bit = F.col("h").bitwiseAND(F.lit(BITMAP - 1))
    words = counted.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(F.lit(63)).alias("k"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, cast(k as int))")).alias("b"))
    out = np.zeros(BITMAP // 64, dtype="<i8")
    for part in words.toArrow().to_batches():
        out[part.column("w").to_numpy()] = part.column("b").to_numpy()
    return out.view(np.uint8)


_MEDIA = pa.schema([("doc_id", pa.int64()), ("payload_sha256", pa.string()), ("shared", pa.list_(pa.binary())), ("form", pa.binary())])
_MEDIA_DDL = "doc_id bigint, payload_sha256 string, shared array<binary>, form binary"


def store(docs: DataFrame, path: str) -> None:
    """Write the payloads of all rows' texts: path/media and path/shared.

    Null texts are empty: a tile of padding. Equal texts have equal chunks, which are then in the shared table once.
    An empty table makes tables without rows. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, "doc_id", "text")
    bitmap = spark.sparkContext.broadcast(_shared_bitmap(rows.select("text")).tobytes())

    def media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            out: list[list] = [[] for _ in _MEDIA]
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw, n = payload(t)
                parts = [(d, p, bool(bits[_bit(d) >> 3] >> (_bit(d) & 7) & 1)) for d, p in chunks(raw)]
                row = (doc_id, hashlib.sha256(raw).hexdigest(), list(dict.fromkeys(d for d, _, s in parts if s)), form_of(raw, n, parts))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _MEDIA.types, strict=True)], schema=_MEDIA)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            found = {d: p for t in batch.column("text").to_pylist() for d, p in chunks(payload(t)[0]) if bits[_bit(d) >> 3] >> (_bit(d) & 7) & 1}
            yield pa.RecordBatch.from_pydict({"digest": pa.array(found.keys(), pa.binary()), "bytes": pa.array(found.values(), pa.binary())})

    rows.mapInArrow(media, _MEDIA_DDL).write.option("compression", "zstd").parquet(f"{path}/media")
    rows.select("text").mapInArrow(shared, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes")).write.option("compression", "zstd").parquet(f"{path}/shared")


def _assembled(form: bytes, sha256: str, shared: dict[bytes, bytes]) -> tuple[int, bytes]:
    """The unpadded length and the payload."""
    n_bytes, length, entries, at = read_form(form)
    out = []
    for n, is_shared, digest in entries:
        out.append(shared[digest] if is_shared else form[at : at + n])
        at += 0 if is_shared else n
    raw = b"".join(out)
    if len(raw) != length or hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("a payload read back isn't the one stored")
    return n_bytes, raw


def features(raw: bytes) -> str:
    """A perceptual hash of the mean tile (16 hex digits: block means against their median), mean and deviation."""
    x = np.frombuffer(raw, np.uint8).reshape(-1, SIDE, SIDE)
    blocks = x.mean(axis=0).reshape(8, 3, 8, 3).mean(axis=(1, 3)).ravel()
    bits = int.from_bytes(np.packbits(blocks > np.median(blocks)).tobytes(), "big")
    return f"{bits:016x}:{x.mean():.6f}:{x.std():.6f}"


_READ = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_READ_DDL = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _measures(form: bytes, sha256: str, shared: dict[bytes, bytes]) -> tuple:
    n_bytes, raw = _assembled(form, sha256, shared)
    return n_bytes, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(form), hashlib.sha256(form).hexdigest(), features(raw)


def _with_shared(spark: SparkSession, path: str) -> DataFrame:
    """payload_sha256, form, parts of each different payload that has shared chunks.

    parts: (digest, bytes) of its shared chunks, joined by their digests. Copies of a payload are taken together before
    anything is shuffled. A digest or payload that many rows have is a join key: Spark's adaptive joins split its rows.
    """
    media = spark.read.parquet(f"{path}/media").where(F.size("shared") > 0)
    different = media.groupBy("payload_sha256").agg(F.first("form").alias("form"))
    lists = media.groupBy("payload_sha256").agg(F.first("shared").alias("shared"))  # narrow: forms aren't read here
    wanted = lists.select("payload_sha256", F.explode("shared").alias("digest"))
    parts = wanted.join(spark.read.parquet(f"{path}/shared"), "digest").groupBy("payload_sha256").agg(F.collect_list(F.struct("digest", "bytes")).alias("parts"))
    return different.join(parts, "payload_sha256")


def _each(rows: DataFrame, f: Callable[[bytes, str, dict[bytes, bytes]], tuple], schema: pa.Schema, ddl: str, *carried: str) -> DataFrame:
    """Carried columns and f(form, payload_sha256, shared chunks) of every row; rows without a column parts have none."""
    whole = pa.schema([*[(c, pa.int64()) for c in carried], *schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in whole]
            parts = batch.column("parts").to_pylist() if "parts" in batch.schema.names else [[]] * batch.num_rows
            for sha, form, own, *kept in zip(batch.column("payload_sha256").to_pylist(), batch.column("form").to_pylist(), parts, *[batch.column(c).to_pylist() for c in carried], strict=True):
                for column, x in zip(out, (*kept, *f(form, sha, {p["digest"]: p["bytes"] for p in own})), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, whole.types, strict=True)], schema=whole)

    return rows.mapInArrow(run, ", ".join([*[f"{c} bigint" for c in carried], ddl]))


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_sha256, payload (unpadded) of each different payload, put together and verified."""

    def whole(form: bytes, sha256: str, shared: dict[bytes, bytes]) -> tuple[str, bytes]:
        n, raw = _assembled(form, sha256, shared)
        return sha256, raw[:n]

    small_batches(spark)
    schema, ddl = pa.schema([("payload_sha256", pa.string()), ("payload", pa.binary())]), "payload_sha256 string, payload binary"
    alone = spark.read.parquet(f"{path}/media").where(F.size("shared") == 0).select("payload_sha256", "form")
    return _each(alone, whole, schema, ddl).unionByName(_each(_with_shared(spark, path), whole, schema, ddl))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and measures of every row's payload and stored form, all from the stored bytes."""
    small_batches(spark)
    media = spark.read.parquet(f"{path}/media")
    single = _each(media.where(F.size("shared") == 0).select("doc_id", "payload_sha256", "form"), _measures, _READ, _READ_DDL, "doc_id")
    measured = _each(_with_shared(spark, path), _measures, _READ, _READ_DDL)
    several = media.where(F.size("shared") > 0).select("doc_id", "payload_sha256").join(measured, "payload_sha256")
    return single.unionByName(several)


def stored_and_read(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the measures of read_back() for every row of docs, stored at path or in the shared folder.

    Null texts are empty ones: a tile of padding. Repeated rows come out as often; equal texts have equal measures. A null
    doc_id stays null. An empty table gives no rows. Other columns of docs don't matter.
    """
    path = path or new_path(docs.sparkSession, "media")
    store(docs, path)
    return read_back(docs.sparkSession, path)
