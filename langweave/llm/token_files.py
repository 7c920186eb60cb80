"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks that are read in place.

The ids of all documents, each followed by an end id, are written in ascending order of document id. A shard is one
Arrow IPC file: the streaming format's batches and a footer for random access. Each row is one sequence: ``ids`` and
``mask`` are fixed-size lists of ``sequence_length``, the mask (one bit each) true on ids, false on a shard's padding.
Every batch but the last holds ``BATCH_SEQUENCES`` rows, so any sequence is found by division, and memory-mapped arrays
are views of the file.

One task writes one shard, streaming. Shards carry the attempt in their names; only those of attempts whose index rows
Spark committed are in the index, so a lost or repeated task leaves at worst a file nobody reads.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from langweave.llm.batches import text_rows
from langweave.llm.columns import whole
from langweave.scratch import materialize, scratch_path

SEQUENCE_LENGTH = 2048
BATCH_SEQUENCES = 64
SHARD_DOCUMENTS = 20_000
END_ID = 2
# A Python worker keeps encoded words up to so many bytes, then starts anew, and none longer than so many characters.
KEPT_BYTES = 330 << 20
KEPT_LENGTH = 64
# What an entry takes besides the bytes of word and ids.
ENTRY_BYTES = 200


class KnownWords(dict):
    """Ids of words, as little-endian bytes; a word it does not know is encoded when it is asked for.

    A full stop or comma after a letter, and the case of ASCII words, are taken off first where that is what the
    tokenizer does itself: it splits letters from other characters and lowers them. A letter is one by its normalised
    form, which may end in a mark; a mark and the stop after it stay together.
    """

    def __init__(self, tokenizer, dtype: np.dtype, splits_ends: bool, lowers: bool):
        super().__init__()
        self.tokenizer, self.dtype, self.splits_ends, self.lowers = tokenizer, dtype, splits_ends, lowers
        self.size = 0

    def _letter_before_end(self, word: str) -> bool:
        if word.isascii() or self.tokenizer.normalizer is None:
            return word[-2].isalpha()
        normal = self.tokenizer.normalizer.normalize_str(word)
        return word[-2].isalpha() and normal[-1] == word[-1] and normal[-2].isalpha()

    def __missing__(self, word: str) -> bytes:
        if self.splits_ends and len(word) > 1 and word[-1] in ".," and self._letter_before_end(word):
            ids = self[word[:-1]] + self[word[-1]]
        elif self.lowers and word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(word) > KEPT_LENGTH:
            return ids
        taken = ENTRY_BYTES + 4 * len(word) + len(ids)
        if self.size + taken > KEPT_BYTES:
            self.clear()
            self.size = 0
        self.size += taken
        self[word] = ids
        return ids


class WordEncoder:
    """Encodes whole texts by way of their words: the tokenizer splits at white space, so the ids of a text are those
    of its words, and words recur."""

    def __init__(self, tokenizer_json: str):
        # One thread a worker: Spark runs a worker on each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")

        def same(a: list[str], b: list[str]) -> bool:
            one, other = ([i for t in x for i in tokenizer.encode(t, add_special_tokens=False).ids] for x in (a, b))
            return one == other

        ends = all(same([f"word{c}", f"\u00e9{c}"], ["word", c, "\u00e9", c]) for c in ".,")
        lowers = same(["Word", "WORD", "The"], ["word", "word", "the"])
        self.known = KnownWords(tokenizer, self.dtype, ends, lowers)

    def encode(self, text: str) -> bytes:
        # Space and line feed alone: other characters that Python takes for white space the tokenizer may not.
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer_json: str) -> WordEncoder:
    return WordEncoder(tokenizer_json)


class TokenFileWriter:
    """Writes a stream of ids as equal-length sequences; memory holds one batch."""

    def __init__(self, sink, dtype: np.dtype, sequence_length: int):
        self.length, self.dtype = sequence_length, dtype
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema(
            [("ids", pa.list_(item, sequence_length)), ("mask", pa.list_(pa.bool_(), sequence_length))]
        )
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = bytearray()

    def append(self, ids: bytes) -> None:
        self.waiting += ids
        size = BATCH_SEQUENCES * self.length * self.dtype.itemsize
        whole_batches = len(self.waiting) // size * size
        for at in range(0, whole_batches, size):
            self._write(np.frombuffer(bytes(self.waiting[at : at + size]), self.dtype))
        del self.waiting[:whole_batches]

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
        padded[: len(ids)], mask[: len(ids)] = ids, True
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(np.frombuffer(bytes(self.waiting), self.dtype))
        self.writer.close()


class TokenFile:
    """A shard, read in place. ``sequence(i)`` is a view; ``span`` copies only where batches meet."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(place) if local else system.open_input_file(place))
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch = functools.lru_cache(maxsize=4)(self._load)

    def _load(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = (column.flatten() for column in self.reader.get_batch(number).columns)
        return ids.to_numpy(zero_copy_only=True), mask

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence, both views."""
        ids, mask = self._batch(i // BATCH_SEQUENCES)
        at = i % BATCH_SEQUENCES * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def span(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from position ``start`` of the shard."""
        size, parts, end = BATCH_SEQUENCES * self.length, [], start + count
        while start < end:
            number, at = divmod(start, size)
            parts.append(self._batch(number)[0][at : min(size, at + end - start)])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame,
    tokenizer_json: str,
    folder: str | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    end_id: int = END_ID,
    sequence_length: int = SEQUENCE_LENGTH,
    shard_documents: int = SHARD_DOCUMENTS,
) -> DataFrame:
    """Write the files and return their index: ``doc_id, shard, path, shard_start, n_tokens, start``.

    ``shard_start`` and ``start`` count the ids before the document in its shard and in all; padding counts in neither.
    ``folder`` is one that every executor reaches, by default in the session's shared folder. A null or empty text is
    the end id alone. Null ids come first; repeated rows are written each, equal ids in order of their texts. Empty
    tables write no file and give an empty index. No other column of ``docs`` is read.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    kind = docs.schema[doc_id].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard_documents))
    ordered = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    ordered = ordered.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        context = TaskContext.get()
        shard = context.partitionId()
        path = f"{folder}/shard-{shard:06d}-{context.attemptNumber()}-{uuid.uuid4().hex}.arrow"
        writer, written = None, 0
        for batch in batches:
            if writer is None:
                system, place = fs.FileSystem.from_uri(path)
                system.create_dir(os.path.dirname(place), recursive=True)
                sink = system.open_output_stream(place)
                writer = TokenFileWriter(sink, encoder.dtype, sequence_length)
            starts, counts = [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text)
                writer.append(ids + end)
                starts.append(written)
                counts.append(len(ids) // encoder.dtype.itemsize + 1)
                written += counts[-1]
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array([shard] * len(starts), pa.int32()),
                    pa.array([path] * len(starts), pa.string()),
                    pa.array(starts, pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                names=["doc_id", "shard", "path", "shard_start", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    index = text_rows(ordered).mapInArrow(
        write, f"doc_id {kind}, shard int, path string, shard_start long, n_tokens long"
    )
    index = materialize(index, "token-index")
    # One row a shard; their running total is short enough for one task.
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    bases = materialize(bases, "shard-bases")
    return index.join(bases, "shard").withColumn("start", F.col("base") + F.col("shard_start")).drop("base")


def read_checksums(index: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files: the checksum of the ids as little-endian 32-bit integers."""
    kind = index.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = functools.lru_cache(maxsize=4)(TokenFile)
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("path", "shard_start", "n_tokens")))
            sums = [zlib.crc32(opened(p).span(start, count).astype("<u4").tobytes()) for p, start, count in places]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.record_batch(
                [*columns, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    columns = index.select("doc_id", "path", "shard_start", "start", "n_tokens")
    return columns.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
