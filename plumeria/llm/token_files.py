"""Token ids in fixed-width bit packing: every id takes the least bits that hold the vocabulary.

A table of files, one a shard, in ascending order of doc_id. A row is a block: its place (shard, block), the id it
begins with within its shard, its documents with their numbers of ids, and the packed ids, lowest bit first. As every
id has the same width, numpy unpacks a block or any span of it at once.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import stored
from plumeria.llm.pieces import REMEMBERED_MORE, ChunkEncoder, WordCutter, checked, ranges, text_groups
from plumeria.llm.words import lean, slices

#: A block is closed at so many ids; a document isn't cut, so a longer one is a block of its own.
BLOCK_IDS = 1 << 16
#: Documents of a shard, about; shards whose ids are summed together; ids packed at once, a multiple of 8.
SHARD_DOCS, SHARD_GROUP, CHUNK = 4096, 1024, 8192

BLOCKS = (
    "shard int, block int, first_id long, n_ids long, bits int, doc_ids array<long>, lengths array<long>, packed binary"
)


def bits_for(size: int) -> int:
    """The least bits that hold the ids 0 .. size-1."""
    return max(1, int(size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):  # the same bytes, as they are
        return ids.astype(f"<u{bits // 8}").tobytes()
    places, parts = np.arange(bits, dtype=np.uint32), []
    for at in range(0, len(ids), CHUNK):
        flat = (ids[at : at + CHUNK].astype(np.uint32)[:, None] >> places & np.uint32(1)).astype(np.uint8)
        parts.append(np.packbits(flat.ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(packed: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """The ids first .. first+count-1 of a block, reading only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    places, whole = np.arange(bits, dtype=np.uint32), np.frombuffer(packed, np.uint8)
    out = np.empty(count, np.uint32)
    for at in range(0, count, CHUNK):
        size = min(CHUNK, count - at)
        begin = (first + at) * bits
        data = whole[begin // 8 : (begin + size * bits + 7) // 8]
        flat = np.unpackbits(data, bitorder="little")[begin % 8 : begin % 8 + size * bits].reshape(size, bits)
        out[at : at + size] = (flat.astype(np.uint32) << places).sum(axis=1, dtype=np.uint32)
    return out


@lru_cache(maxsize=2)
def library(path: str) -> tuple[ChunkEncoder, int]:
    """An encoder by the tokenizers library, and the size of its vocabulary.

    New words that begin with a space go to the library as one text, and the offsets of its tokens tell whose they
    are; the others go alone.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        checked(json.load(file))
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = [i for i, x in enumerate(words) if x[0] == " " and not x[-1].isspace()]
        one = tokenizer.encode("".join([words[i] for i in joined]), add_special_tokens=False)
        ends = np.cumsum(np.fromiter(map(len, [words[i] for i in joined]), np.int64, len(joined)))
        begins = np.fromiter((a for a, _ in one.offsets), np.int64, len(one.ids))
        counts = np.zeros(len(words), np.int64)
        counts[joined] = np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(joined))[: len(joined)]
        rest = sorted(set(range(len(words))) - set(joined))
        alone = [x.ids for x in tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)]
        counts[rest] = [len(x) for x in alone]
        ids = np.empty(int(counts.sum()), np.int64)
        starts = np.cumsum(counts) - counts
        ids[ranges(starts[joined], counts[joined])] = one.ids
        ids[ranges(starts[rest], counts[rest])] = list(chain.from_iterable(alone))
        return ids, counts

    special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
    return ChunkEncoder(WordCutter(encode, special, REMEMBERED_MORE), REMEMBERED_MORE), tokenizer.get_vocab_size(with_added_tokens=True)


def _written(path: str, end_id: int | None, bits: int | None):
    """The blocks of a task's documents, which come in order of doc_id; the task is the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = library(path)
        width = bits or bits_for(max(vocabulary, (end_id or 0) + 1))
        extra = np.array([] if end_id is None else [end_id], np.uint32)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            row = [shard, block, first, len(ids), width, [x for x, _ in held], [len(x) for _, x in held], pack(ids, width)]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        size = 0
        for batch in slices(batches):
            whole = batch.column(1).fill_null("").to_pylist()
            numbers = batch.column(0).to_pylist()
            for a, b in text_groups(whole):
                ids, counts = encoder(whole[a:b])
                for number, part in zip(numbers[a:b], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    document = np.concatenate((part.astype(np.uint32), extra))
                    if held and size + len(document) > BLOCK_IDS:
                        yield closed()
                        block, first = block + 1, first + size
                        held, size = [], 0
                    held.append((number, document))
                    size += len(document)
        if held:
            yield closed()

    return run


def write_token_files(
    docs: DataFrame, path: str, end_id: int | None = 0, text: str = "text", doc_id: str = "doc_id",
    shard_docs: int = SHARD_DOCS, bits: int | None = None,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, and write packed blocks in ascending doc_id; returns the table read.

    Shards are ranges of doc_id between quantiles that Spark samples, about one for ``shard_docs`` documents, and the
    files of the table follow one another as they do. A null text counts as empty; a null doc_id comes first; rows
    with one doc_id follow one another by a hash of their text, in several shards where they are many; an empty table
    gives no blocks. ``bits`` are those of the vocabulary unless given. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = max(1, rows.count() // shard_docs)
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(lean(_written(path, end_id, bits)), BLOCKS), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 8):
        for base, first, bits, doc_ids, lengths, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            starts = np.cumsum([0, *lengths])
            crc = [zlib.crc32(unpack(packed, bits, int(a), int(n)).astype("<u4").tobytes()) for a, n in zip(starts, lengths, strict=False)]
            columns = [pa.array(doc_ids, pa.int64()), pa.array(starts[:-1] + first + base), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in ``files``, from the packed ids themselves."""
    # Prefix sums in two steps, over groups of shards and within them.
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("ids")).withColumn("group", F.floor(F.col("shard") / SHARD_GROUP))
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sums.groupBy("group").agg(F.sum("ids").alias("ids")).select("group", earlier(Window.orderBy("group")).alias("base"))
    bases = sums.withColumn("own", earlier(Window.partitionBy("group").orderBy("shard"))).join(groups, "group")
    bases = bases.select("shard", (F.col("base") + F.col("own")).alias("base"))
    placed = files.join(bases, "shard").select("base", "first_id", "bits", "doc_ids", "lengths", "packed")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
