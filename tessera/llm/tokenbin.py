"""Token ids in a binary format of patched frame-of-reference blocks.

A segment is self-contained:

    magic 'PFR1' | u32 documents | u32 ids | u32 ids a block | u32 blocks
    documents x (i64 doc_id, u8 null flag, u32 ids)       the document table
    (blocks + 1) x u64                                    where each block starts, and the end
    blocks: u32 minimum | u8 width | u16 exceptions | packed ids | exceptions x u16 place | exceptions x u32 value

Ids of a block have its minimum subtracted and are packed at a width (bits) that holds the given share of them; the others
are exceptions, kept whole in the list, with zeros in the packed part. Numbers are little-endian.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BLOCK = 1024
SHARE = 0.98
SEGMENT_IDS = 1 << 20


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block of up to 65,535 ids (u32)."""
    low = int(ids.min())
    rest = ids - np.uint32(low)
    width = max(1, int(np.sort(rest)[int((len(rest) - 1) * share)]).bit_length())
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = ids[odd]
    rest[odd] = 0
    if width == 8 or width == 16 or width == 32:
        packed = rest.astype(f"<u{width // 8}").tobytes()
    else:
        bits = np.unpackbits(rest.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        packed = np.packbits(bits[:, :width].reshape(-1), bitorder="little").tobytes()
    return struct.pack("<IBH", low, width, len(odd)) + packed + odd.astype("<u2").tobytes() + values.astype("<u4").tobytes()


def unpack_block(data: memoryview, n: int) -> np.ndarray:
    """The n ids of a block."""
    low, width, odd = struct.unpack_from("<IBH", data)
    end = 7 + (n * width + 7) // 8
    if width == 8 or width == 16 or width == 32:
        ids = np.frombuffer(data, f"<u{width // 8}", n, 7).astype(np.uint32)
    else:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, end - 7, 7), count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, :width] = bits
        ids = np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)
    ids += np.uint32(low)
    if odd:
        ids[np.frombuffer(data, "<u2", odd, end)] = np.frombuffer(data, "<u4", odd, end + 2 * odd)
    return ids


def pack_segment(keys: list[int | None], counts: list[int], ids: np.ndarray, block: int = BLOCK, share: float = SHARE) -> bytes:
    blocks = [pack_block(ids[i : i + block], share) for i in range(0, len(ids), block)]
    head = struct.pack("<4sIIII", b"PFR1", len(keys), len(ids), block, len(blocks))
    docs = np.zeros(len(keys), dtype=[("k", "<i8"), ("null", "u1"), ("n", "<u4")])
    docs["k"], docs["null"], docs["n"] = [k or 0 for k in keys], [k is None for k in keys], counts
    starts = np.cumsum([len(head) + docs.nbytes + 8 * (len(blocks) + 1), *map(len, blocks)]).astype("<u8")
    return b"".join([head, docs.tobytes(), starts.tobytes(), *blocks])


def segment_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids first to last (exclusive) of a segment; only the blocks that hold them are read."""
    magic, docs, total, block, blocks = struct.unpack_from("<4sIIII", data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    last = total if last is None else last
    if last <= first:
        return np.empty(0, np.uint32)
    starts, view = np.frombuffer(data, "<u8", blocks + 1, 20 + 13 * docs), memoryview(data)
    a, b = first // block, -(-last // block)
    out = [unpack_block(view[int(starts[i]) : int(starts[i + 1])], min(block, total - i * block)) for i in range(a, b)]
    return np.concatenate(out)[first - a * block : last - a * block]


def segment_docs(data: bytes) -> np.ndarray:
    """The document table of a segment: k, null, n."""
    return np.frombuffer(data, [("k", "<i8"), ("null", "u1"), ("n", "<u4")], struct.unpack_from("<I", data, 4)[0], 20)


class Encoder:
    """Ids (u32, as bytes) of texts under a byte-level BPE tokenizer file of the tokenizers library.

    The pre-tokenizer always cuts before a space, and around a line end, that stands alone between other characters, so a text
    without two white-space characters in a row is encoded as its words, each with the space or the line end before it. Arrow
    splits texts, lists their distinct words, finds these in the table and gathers their ids; only new words become Python objects, some thousands at a time.
    The table is two Arrow arrays, words and their ids; once it has more than `many` words it starts again from those of the
    portion at hand, which has all frequent ones. New words are encoded together, one a line: their ids are the library's,
    whatever the order. A word that is empty or has white space at an end has null ids, and its text is given to the library
    whole.
    """

    many, together = 800_000, 8_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.line = self._whole("\n")
        #: Whether the tokenizer cuts as said.
        self.cuts = len(self.line) == 4 and self._whole("a's b,\n12 x") == b"".join(map(self._whole, ("a's", " b,", "\n", "12", " x")))

    def _numbers(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _whole(self, text: str) -> bytes:
        return self._numbers(text).tobytes()

    def _lines(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all lines in one array, and how many each has. Lines are not empty and have no line end."""
        end, ids, counts = int.from_bytes(self.line, "little"), [], []
        for i in range(0, len(lines), self.together):
            own = lines.slice(i, self.together)
            found = self._numbers("\n".join(own.to_pylist()))
            ends = np.flatnonzero(found == end)
            if len(ends) == len(own) - 1:
                ids.append(found[found != end])
                counts.append(np.diff(np.concatenate([[-1], ends, [len(found)]])) - 1)
            else:
                each = [self._numbers(x) for x in own.to_pylist()]
                ids.extend(each)
                counts.append(np.array([len(x) for x in each], np.int64))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, "<u4"), np.empty(0, np.int64))

    def _learn(self, new: pa.Array) -> pa.Array:
        """The ids of words, with a line end before them or else a space that is left out; null where the text must go whole."""
        broken = pc.starts_with(new, "\n")
        core = pc.ascii_ltrim(new, "\n")
        plain = pc.and_(pc.not_equal(core, ""), pc.equal(core, pc.utf8_trim_whitespace(core)))
        special = pc.and_(plain, pc.match_substring(core, "<|"))  # special tokens may be in any word
        plain = pc.and_not(plain, special).to_numpy(zero_copy_only=False)
        lines = pc.if_else(broken, core, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), core, pa.scalar(" ", pa.large_string())))
        ids, counts = self._lines(lines.filter(plain))
        # where the line end goes before a word's ids, it is set in front of them
        first = broken.to_numpy(zero_copy_only=False)[plain].astype(np.int64)
        stops = np.cumsum(counts + first)
        data = np.full(int(stops[-1]) if len(stops) else 0, int.from_bytes(self.line, "little"), "<u4")
        data[np.arange(len(ids)) + np.repeat(np.cumsum(first), counts)] = ids
        own = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], 4 * stops]).astype(np.int64)), pa.py_buffer(data)])
        at = np.cumsum(plain) - 1
        out = own.take(pa.array(at, mask=~plain)) if len(own) else pa.nulls(len(new), pa.large_binary())
        odd = special.to_numpy(zero_copy_only=False)
        if odd.any():
            given = [self.line + self._whole(x[1:]) if x[0] == "\n" else self._whole(" " + x) for x in new.filter(odd).to_pylist()]
            out = pc.replace_with_mask(out, odd, pa.array(given, pa.large_binary()))
        return out

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are in the table, after those that it lacks were added."""
        found = pc.index_in(words, value_set=self.words)
        if found.null_count:
            new = words.filter(found.is_null())
            ids = self._learn(new)
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
            at = found.to_numpy(zero_copy_only=False)
            lacked = np.isnan(at)
            at[lacked] = np.arange(len(self.words) - len(new), len(self.words))
            found = pa.array(at.astype(np.int64))
            if len(self.words) > self.many and len(self.words) > len(words):
                self.words, self.ids, found = words, self.ids.take(found), pa.array(np.arange(len(words)))
        return found.to_numpy(zero_copy_only=False)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Meant for some megabytes of texts at a time; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.cuts:
            return [self._whole(t) for t in texts.to_pylist()]
        marked = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string()))
        split = pc.split_pattern(marked, " ")
        coded, at = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        del marked, split
        own = self._places(coded.dictionary)[coded.indices.to_numpy()]
        taken = self.ids.take(pa.array(own))
        stops = (np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[at] if len(taken) else at).tolist()
        data = memoryview(taken.buffers()[2] or b"")
        if taken.null_count:
            odd = (np.add.reduceat(taken.is_null().to_numpy(zero_copy_only=False).astype(np.int64), at[:-1]) > 0).tolist()
        else:
            odd = [False] * len(texts)
        # the line end that each text was given goes
        out = [self._whole(texts[i].as_py()) if odd[i] else bytes(data[stops[i] + 4 : stops[i + 1]]) for i in range(len(texts))]
        del coded, taken, data
        pa.default_memory_pool().release_unused()
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One to a process: its table serves all tasks that run there."""
    return Encoder(path)


def portions(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes in the second column, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop


SEGMENT = "part int, seq int, n_docs long, n_ids long, payload binary"
INDEX = "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", segment: int = SEGMENT_IDS, share: float = SHARE) -> DataFrame:
    """Encode every whole text, append end_id, and write the ids as segments in ascending key order.

    Returns the written table (part, seq, n_docs, n_ids, payload), in order of part and seq. A null text is empty; null keys
    come first; rows that repeat a key follow each other in order of their texts. Documents aren't split between segments.
    tokenizer: path of the tokenizer file, the same on all executors.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            payload = pack_segment(keys, [len(x) // 4 for x in held], ids, share=share)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": [len(keys)], "n_ids": [len(ids)], "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for rows in portions(batch):
                for k, ids in zip(rows.column(0).to_pylist(), encode_all(rows.column(1)), strict=True):
                    keys.append(k)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= segment:
                        yield flush()
                        seq, size = seq + 1, 0
                        keys.clear()
                        held.clear()
        if keys:
            yield flush()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # the ranges are in ascending order of their number
    ranged = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ranged.mapInArrow(encode, SEGMENT), "tokens", "none")


def read(segments: DataFrame) -> DataFrame:
    """The documents of written segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, data = segment_docs(payload), segment_ids(payload).astype("<u4").tobytes()
                ends = np.cumsum(docs["n"], dtype=np.int64)
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), docs["n"].tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()), "seq": pa.array([seq] * n, pa.int32()), "doc_id": pa.array(docs["k"], pa.int64(), mask=docs["null"] > 0),
                    "before": pa.array(ends - docs["n"], pa.int64()), "n_tokens": pa.array(docs["n"].astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64()),
                })

    rows = segments.select("part", "seq", "payload").mapInArrow(decode, INDEX)
    # sums within each part, then over parts: as many rows as there are range partitions
    sizes = segments.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    earlier = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_parts"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_segments"))
    first = inside.join(earlier, "part").select("part", "seq", (F.col("_parts") + F.col("_segments")).alias("_first"))
    return rows.join(first, ["part", "seq"]).select("doc_id", (F.col("_first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Write segments as files `part-seq.pfr` to a folder that driver and executors share as a local path; returns their index.

    Index: name, first (ids of all files before), n_docs, n_ids, bytes, crc32, in order of name. Each file is written beside its place
    and renamed, so a task that runs again leaves the same file, and an index row stands for a whole file only.
    """
    os.makedirs(folder, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for part, seq, n_docs, n_ids, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                name = f"{part:06d}-{seq:06d}.pfr"
                with open(f"{folder}/.{name}.{attempt}", "wb") as out:
                    out.write(payload)
                os.replace(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "bytes": [len(payload)], "crc32": [zlib.crc32(payload)]})

    rows = cut(segments.select("part", "seq", "n_docs", "n_ids", "payload").mapInArrow(put, "part int, name string, n_docs long, n_ids long, bytes long, crc32 long"), "exported")
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("_all"))
    earlier = parts.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_parts"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", inside).join(earlier, "part").select("name", (F.col("_parts") + F.col("_own")).alias("first"), "n_docs", "n_ids", "bytes", "crc32")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder of exported files, by any store that Spark reads; read() takes them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfr").load(folder)
    name = F.regexp_extract("path", r"(\d+-\d+)\.pfr$", 1)
    head = lambda at: F.conv(F.hex(F.reverse(F.substring(F.col("content"), at + 1, 4))), 16, 10).cast("long")
    return files.select(F.split_part(name, F.lit("-"), F.lit(1)).cast("int").alias("part"), F.split_part(name, F.lit("-"), F.lit(2)).cast("int").alias("seq"), head(4).alias("n_docs"), head(8).alias("n_ids"), F.col("content").alias("payload"))
