"""Token ids as binary shards in training order.

Documents are encoded and cut into sequences of at most ``seq_len`` tokens. A keyed Feistel network, with
cycle-walking for domains that aren't a power of four, permutes the numbers of all sequences, which gives each a
global slot. Ranges of slots are shards: files of records of one fixed stride, in slot order, so a reader runs
through them in sequence and resumes at any record by multiplication.

Texts are encoded once. How many sequences a text has is known only afterwards, but it has at most one per
``seq_len`` bytes. A cheap first pass adds up these bounds by input partition, which numbers every possible
sequence before any is made; slots of sequences that don't exist stay empty, and records close ranks. A record's
``position`` in the whole order is its number within the shard plus the records of the shards before.

Slots are dealt to partitions by their range itself, one range a shard, so there is no sampling and no partition has
two shards. A shard is written under a temporary name and moved into place, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import shared_folder, written

ROUNDS, PAD = 6, 0xFFFF
SHARD_TEXT_BYTES = 24 << 20  # bytes of text to each shard, on average


def feistel(x: np.ndarray, size: int, key: int) -> np.ndarray:
    """A permutation of 0 ... size - 1, keyed; values that leave the domain walk on until they are back in it."""
    half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            f = (right + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


@cache
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    try:
        f = open(path, "rb")  # noqa: SIM115
    except FileNotFoundError:
        f = open(SparkFiles.get(path.rpartition("/")[2]), "rb")  # noqa: SIM115
    with f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) >= PAD:
        raise ValueError("records hold ids below 65,535")
    return tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_shards(df: DataFrame, vocabulary: str, pattern: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 512, key: int = 1) -> DataFrame:
    """Write the shards and return one row per sequence: id, seq (from 0), n_tokens, slot, position, shard,
    byte_offset, ids_sha256 (of the decimal ids joined by commas).

    ``df`` must be read from stored files, so that two passes see the same partitions; this is checked. Null and
    empty texts have no sequences. Repeated rows are written repeatedly; null ids are kept; an empty table writes
    no shard. Without a folder a new one in the shared folder is used."""
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/lodestone/shards-{uuid.uuid4().hex}"
    src = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    bound = F.ceil(F.octet_length("text") / F.lit(seq_len)).cast("long")
    parts = src.select(F.spark_partition_id().alias("p"), bound.alias("b"), F.octet_length("text").alias("n")).groupBy("p").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()
    first, slots = {}, 0
    for r in sorted(parts, key=lambda r: r["p"]):
        first[r["p"]] = (slots, slots := slots + r["b"])
    shards = max(1, -(-sum(r["n"] for r in parts) // SHARD_TEXT_BYTES))
    id_type = src.schema["id"].dataType
    starts = spark.sparkContext.broadcast(first)

    def encode(batches):
        enc = _encoding(vocabulary, pattern)
        at, end = starts.value.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            rows, seqs, counts, numbers, records = [], [], [], [], []
            for i, text in enumerate(texts.to_pylist()):
                tokens = enc.encode_to_numpy(text, disallowed_special=()).astype("<u2")
                for s in range(0, len(tokens), seq_len):
                    rows.append(i)
                    seqs.append(s // seq_len)
                    numbers.append(at + s // seq_len)
                    records.append(tokens[s : s + seq_len].tobytes())
                    counts.append(min(seq_len, len(tokens) - s))
                at += -(-len(text.encode("utf-8", "surrogatepass")) // seq_len)
            slot = feistel(np.array(numbers, np.int64), slots, key)
            shard = (slot.astype(object) * shards // max(1, slots)).astype(np.int32) if slots >= 1 << 40 else (slot * shards // max(1, slots)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), ids.take(pa.array(rows, pa.int64())), pa.array(seqs, pa.int32()), pa.array(counts, pa.int32()), pa.array(records, pa.binary())], names=["shard", "slot", "id", "seq", "n_tokens", "record"])
        if at != end:
            raise RuntimeError("the input's partitions changed between two passes: write it to files first")

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get()
        now, stream, n = None, None, 0
        temporary = f"{root}/.{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"

        def close():
            if stream is not None:
                stream.close()
                store.move(temporary, f"{root}/{name(now)}")

        for batch in batches:
            offsets, digests = [], []
            for shard, record in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, stream, n = shard, store.open_output_stream(temporary), 0
                tokens = np.frombuffer(record, "<u2")
                offsets.append(n * 2 * seq_len)
                digests.append(hashlib.sha256(",".join(map(str, tokens.tolist())).encode()).hexdigest())
                stream.write(record + b"\xff" * (2 * seq_len - len(record)))
                n += 1
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), batch.column(4), batch.column(1), batch.column(0), pa.array(offsets, pa.int64()), pa.array(digests)], names=["id", "seq", "n_tokens", "slot", "shard", "byte_offset", "ids_sha256"])
        close()

    kind = id_type.simpleString()
    made = src.mapInArrow(encode, f"shard int, slot long, id {kind}, seq int, n_tokens int, record binary")
    sorted_ = made.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")  # a partition is a range of slots, and a shard
    index = written(sorted_.mapInArrow(write, f"id {kind}, seq int, n_tokens int, slot long, shard int, byte_offset long, ids_sha256 string"), "index")
    sizes = index.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    position = F.col("before") + F.col("byte_offset") / F.lit(2 * seq_len)
    out = index.join(before, "shard").select(F.col("id").alias(id_col), "seq", "n_tokens", "slot", position.cast("long").alias("position"), "shard", "byte_offset", "ids_sha256")
    out._lodestone_folder = folder
    return out


def name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def read_records(folder: str, shard: int, record: int, count: int, seq_len: int = 512) -> list[np.ndarray]:
    """``count`` records of a shard from number ``record`` on, without padding."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/{name(shard)}") as f:
        f.seek(record * 2 * seq_len)
        rows = np.frombuffer(f.read(count * 2 * seq_len), "<u2").reshape(-1, seq_len)
    return [r[r != PAD] for r in rows]
