"""Training-order materialisation (operator 10).

Token sequences get dense numbers 0..N-1, a keyed Feistel network with cycle-walking
permutes them, and each sequence's image is its global slot. Slots are dealt by range:
shard k holds slots k*S to (k+1)*S-1 in order, one fixed-stride record each, so slot s is at byte
(s mod S) * stride of shard s div S. A trainer reads sequentially, or resumes anywhere
by seeking. Shards are named by a digest of the key, the layout, the vocabulary and all sequences: a writer that is run
again keeps whole shards of the same order and no others. The manifest comes last, then shards of other orders go.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_fs, enter, mix64, put_file, settle, shared_dir, written
from .tokens import default_vocabulary, load, slices

SEQ_LEN, PER_SHARD, ROUNDS = 2048, 2048, 6
#: Tasks that write shards at most; each writes a run of them, one after the other.
MAX_WRITERS = 1 << 14
PAD_ID = 49407
#: Sequence number, ids that are not padding, CRC-32 of the ids' bytes.
HEAD, HEAD_BYTES = "<QII", 16


def stride(seq_len: int) -> int:
    return HEAD_BYTES + 2 * seq_len


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the numbers ``index`` under the keyed permutation of 0..n-1."""
    if n < 2:
        return np.zeros(len(index), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & 0xFFFFFFFFFFFFFFFF))

    def once(x):
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        return left << shift | right

    x = once(np.asarray(index, np.int64).astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])  # walk the cycle until it is back inside
    return x.astype(np.int64)


def _sequences(path: str, seq_len: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        enter("tokens")
        tok, part, n, left, pack = load(path), TaskContext.get().partitionId(), 0, b"", zstandard.ZstdCompressor(level=3)
        end, size = np.array([end_id], "<u2").tobytes(), 2 * seq_len

        def out(raw: list[bytes]):
            nonlocal n
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part] * len(raw), pa.int32()), pa.array(range(n, n + len(raw)), pa.int64()), pa.array([len(r) // 2 for r in raw], pa.int32()), pa.array([pack.compress(r) for r in raw], pa.binary())],
                ["part", "local", "n_tokens", "packed"],
            )
            n += len(raw)
            return batch

        for batch in batches:
            for part_ in slices(batch, 0, 2 << 20):
                left += b"".join(x + end for x in tok.encode(part_.column(0).to_pylist()))
                whole = len(left) // size * size
                if whole:
                    yield out([left[i : i + size] for i in range(0, whole, size)])
                    left = left[whole:]
        if left:
            yield out([left])
        settle()

    return run


def token_sequences(docs: DataFrame, text_col: str, vocabulary: str, seq_len: int, end_id: int) -> DataFrame:
    """All texts' ids, each text ended, cut into sequences; one shorter sequence at most a partition. Ids are packed (zstd)."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sequences(vocabulary, seq_len, end_id), "part int, local long, n_tokens int, packed binary")


def shard_name(order: str, shard: int) -> str:
    return f"shard-{order}-{shard:07d}.bin"


def _whole(system, path: str, size: int, count: int) -> bool:
    """Whether a file holds ``count`` records whose checksums fit."""
    info = system.get_file_info(path)
    if not (info.is_file and info.size == count * size):
        return False
    with system.open_input_stream(path) as f:
        for _ in range(count):
            raw = f.read(size)
            if zlib.crc32(raw[HEAD_BYTES:]) != struct.unpack_from(HEAD, raw)[2]:
                return False
    return True


def _write(folder: str, order: str, n: int, seq_len: int, per_shard: int, pad_id: int):
    size = stride(seq_len)
    pad = np.array([pad_id], "<u2").tobytes()

    def write(shard: int, rows):
        uri = f"{folder}/{shard_name(order, shard)}"
        count = min(per_shard, n - shard * per_shard)
        if not _whole(*arrow_fs(uri), size, count):
            unpack = zstandard.ZstdDecompressor()

            def to(out):
                seen = 0
                for slot, number, tokens, packed in rows:
                    if slot != shard * per_shard + seen:
                        raise ValueError(f"slot {slot} where {shard * per_shard + seen} is due")
                    ids = unpack.decompress(packed, max_output_size=2 * seq_len)
                    ids += pad * (seq_len - len(ids) // 2)
                    out.write(struct.pack(HEAD, number, tokens, zlib.crc32(ids)) + ids)
                    seen += 1
                if seen != count:
                    raise ValueError(f"shard {shard} has {seen} of {count} slots")

            put_file(uri, to)
        else:
            for _ in rows:
                pass
        return uri, count

    def run(batches):
        import itertools

        rows = ((r[0].as_py(), r[1].as_py(), r[2].as_py(), r[3].as_py()) for b in batches for r in zip(*b.columns, strict=True))
        done = [write(shard, group) for shard, group in itertools.groupby(rows, lambda r: r[0] // per_shard)]
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["shard", "sequences"])

    return run


def write_order(
    docs: DataFrame, folder: str, key: int, text_col: str = "text", vocabulary: str | None = None, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD,
    end_id: int = PAD_ID, pad_id: int = PAD_ID,
) -> dict:
    """Write shards and ``manifest.json`` below ``folder``; returns the manifest.

    A null or empty text is its end id alone. Repeated rows are written each; a text of any length is cut into sequences.
    Sequences are numbered as the input's partitions hold them, so other partitions give another order (and other shards). Other
    columns are ignored. An empty table gives a manifest of no sequences. The driver holds one count and hash for each partition of the input.
    """
    path = vocabulary or default_vocabulary()
    seqs = written(token_sequences(docs, text_col, path, seq_len, end_id), "sequences")
    held = seqs.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("local", "n_tokens", "packed")).alias("x"), F.bit_xor(F.xxhash64("packed", "local")).alias("y"))
    held = sorted(tuple(r) for r in held.collect())
    first, n = {}, 0
    for p, count, *_ in held:
        first[p], n = n, n + count
    with open(path, "rb") as f:
        words = hashlib.sha256(f.read()).hexdigest()
    order = hashlib.sha256(json.dumps([key, n, seq_len, per_shard, end_id, pad_id, words, held]).encode()).hexdigest()[:24]
    manifest = {"order": order, "sequences": n, "seq_len": seq_len, "per_shard": per_shard, "stride": stride(seq_len), "key": key, "dtype": "<u2", "pad_id": pad_id}
    if n:
        _write_shards(seqs, first, folder, manifest)
    put_file(f"{folder}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    system, root = arrow_fs(folder)
    from pyarrow import fs

    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name.startswith("shard-") and not f.base_name.startswith(f"shard-{order}-"):
            system.delete_file(f.path)
    return manifest


def _write_shards(seqs: DataFrame, first: dict[int, int], folder: str, m: dict) -> None:
    n, key, per_shard = m["sequences"], m["key"], m["per_shard"]

    def slots(number):
        import pandas as pd

        return pd.Series(permute(number.to_numpy(), n, key))

    offsets = seqs.sparkSession.createDataFrame([(p, o) for p, o in first.items()], "part int, first long")
    # one row for each partition of the input, so small at any size of it
    numbered = seqs.join(F.broadcast(offsets), "part").withColumn("number", F.col("first") + F.col("local"))
    numbered = numbered.select(F.pandas_udf(slots, T.LongType())("number").alias("slot"), "number", "n_tokens", "packed")
    shards = -(-n // per_shard)
    writers = min(shards, MAX_WRITERS)
    # each writer has a run of shards: the range bounds are known, nothing has to be sampled
    dealt = numbered.repartitionById(writers, F.expr(f"cast((slot div {per_shard}) * {writers} div {shards} as int)")).sortWithinPartitions("slot")
    written(dealt.mapInArrow(_write(folder, m["order"], n, m["seq_len"], per_shard, m["pad_id"]), "shard string, sequences long"), "shards")


def read_slots(folder: str, start: int, count: int):
    """Yield ``(slot, number, n_tokens, ids)`` from slot ``start`` on, seeking in the shards: a trainer's sequential or resumed read."""
    system, root = arrow_fs(folder)
    with system.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    slot, stop = start, min(m["sequences"], start + count)
    while slot < stop:
        with system.open_input_file(f"{root}/{shard_name(m['order'], slot // m['per_shard'])}") as f:
            f.seek(slot % m["per_shard"] * m["stride"])
            while slot < stop:
                raw = f.read(m["stride"])
                if not raw:
                    break
                number, tokens, crc = struct.unpack_from(HEAD, raw)
                if len(raw) != m["stride"] or zlib.crc32(raw[HEAD_BYTES :]) != crc:
                    raise ValueError(f"slot {slot} is damaged")
                yield slot, number, tokens, np.frombuffer(raw, "<u2", offset=HEAD_BYTES)
                slot += 1


def _check(seq_len: int, per_shard: int):
    size = stride(seq_len)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name, raw = path.as_py(), memoryview(content.as_py())
                first = int(name.rsplit("-", 1)[1][:-4]) * per_shard
                if len(raw) % size:
                    raise ValueError(f"{name} ends within a record")
                rows = []
                for i in range(len(raw) // size):
                    number, tokens, crc = struct.unpack_from(HEAD, raw, i * size)
                    if zlib.crc32(raw[i * size + HEAD_BYTES : (i + 1) * size]) != crc:
                        raise ValueError(f"{name}, record {i}: the checksum differs")
                    rows.append((first + i, number, first // per_shard, i * size, tokens, crc))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32"])

    return run


def order_rows(spark, folder: str, m: dict) -> DataFrame:
    """One row per slot of the order with manifest ``m``, read back from its shards (one in a task's memory at a time)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"shard-{m['order']}-*.bin").load(folder)
    return files.select("path", "content").mapInArrow(
        _check(m["seq_len"], m["per_shard"]), "slot long, sequence long, shard long, byte_offset long, n_tokens long, ids_crc32 long"
    )


def materialised_order(docs: DataFrame, key: int, **options) -> DataFrame:
    """Shards written to shared storage and read back, one row per slot."""
    folder = shared_dir(docs.sparkSession) + "/order"
    m = write_order(docs, folder, key, **options)
    if not m["sequences"]:
        return docs.sparkSession.createDataFrame([], "slot long, sequence long, shard long, byte_offset long, n_tokens long, ids_crc32 long")
    return order_rows(docs.sparkSession, folder, m)
