"""Token-ID output in Arrow files of equal-length sequences (operator 3).

Documents are dealt to tasks by ranges of doc_id and sorted there, encoded with
the tokenizers library, closed with the end id and packed end to end into
sequences of ``LENGTH`` ids. A file holds record batches of two fixed-size-list
columns, ``ids`` and ``mask`` (false after a file's last id): any sequence is a
zero-copy slice of a memory map. Beside it stands an index file (doc_id, first,
n_tokens). The manifest names one pair of files for each task, with its part
number, in ascending order of doc_id.

White space only separates in this vocabulary (it is dropped by the pattern and
no merge or normalisation reaches across it), so a text's ids are those of its
white-space separated chunks; a bounded memo keeps the ids of chunks seen before.

Files are moved into place when complete and only those in the manifest are read,
so a lost or repeated task leaves nothing half written. Nulls: a null text is
empty (the end id alone); rows with a null doc_id come first. Rows of equal
doc_id are ordered by the hash of their text. Other columns are not read; an
empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, open_fs, table, text_rows

#: Ids of a sequence, sequences of a record batch, chunks remembered by a worker, the longest of them.
LENGTH, BATCH, MEMO, MEMO_LENGTH = 2048, 128, 600_000, 64
END_ID = 2
#: Characters of Unicode's White_Space; str.split() also splits at the four separators \x1c to \x1f.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return "".join(chr(b if b in prints else 256 + rest.index(b)) for b in range(256))


class ChunkEncoder(dict):
    """Ids (as bytes) of white-space separated chunks; what is asked for and missing is encoded."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        # letters with marks behind are two words of the pattern; letters in lower case and composed form are one word as they stand
        head = chunk.rstrip(_MARKS)
        if head and head.isalpha() and "\u03a3" not in head and (head.isascii() or unicodedata.is_normalized("NFC", head)) and (word := head.lower()).isalpha():
            got = self.get(word)
            if got is None:
                plain = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.letters)[0]
                got = np.array([t.id for t in self.model.tokenize(plain)], self.dtype).tobytes()
                if len(word) <= MEMO_LENGTH:
                    self[word] = got
            if len(head) < len(chunk):
                got += self[chunk[len(head) :]]
        else:
            got = np.array(self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        if len(chunk) <= MEMO_LENGTH:
            self[chunk] = got
        return got

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, with the end id."""
        if len(self) > MEMO:
            self.clear()
        last, get, out = np.array([end], self.dtype).tobytes(), self.__getitem__, []
        for t in texts:
            chunks = filter(None, _SPACE.split(t)) if _SEPARATORS.search(t) else t.split()
            out.append(np.frombuffer(b"".join(map(get, chunks)) + last, self.dtype))
        return out


@lru_cache(2)
def encoder_of(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


class SequenceWriter:
    """Packs ids into sequences and writes them in batches."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH) -> None:
        value = pa.from_numpy_dtype(dtype)
        self.length, self.batch, self.held, self.n = length, batch, [], 0
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", value, nullable=False), length), nullable=False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length), nullable=False)])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat, size = np.concatenate(self.held), self.length * self.batch
        whole = len(flat) // size * size
        for at in range(0, whole, size):
            self._write(flat[at : at + size], size)
        rest = flat[whole:]
        if last and len(rest):
            full = np.zeros(-(-len(rest) // self.length) * self.length, flat.dtype)
            full[: len(rest)] = rest
            self._write(full, len(rest))
            rest = rest[:0]
        self.held, self.n = [rest.copy()], len(rest)

    def _write(self, ids: np.ndarray, n: int) -> None:
        parts = [pa.FixedSizeListArray.from_arrays(x, type=f.type) for x, f in zip((pa.array(ids), pa.array(np.arange(len(ids)) < n)), self.schema, strict=True)]
        self.writer.write_batch(pa.record_batch(parts, schema=self.schema))

    def close(self) -> None:
        if self.n:
            self._flush(True)
        self.writer.close()


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, uri: str, end_id: int = END_ID) -> DataFrame:
    """Write token and index files below ``uri`` and return the manifest: part, path, index_path, documents, tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = text_rows(batches, ("doc_id", "text"), 1024)
        first = next(rows, None)
        if first is None:
            return
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        fs, base = open_fs(uri)
        fs.create_dir(base, recursive=True)
        name = f"{part:07d}-{uuid.uuid4().hex}"
        doc_ids, counts = [], []
        with fs.open_output_stream(f"{base}/{name}.tmp") as sink:
            out = SequenceWriter(sink, encoder.dtype)
            while first is not None:
                for ids in encoder.encode([t or "" for t in first[1]], end_id):
                    counts.append(len(ids))
                    out.add(ids)
                doc_ids += first[0]
                first = next(rows, None)
            out.close()
        n = np.array(counts, np.int64)
        index = pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)], ["doc_id", "first", "n_tokens"])
        with fs.open_output_stream(f"{base}/{name}.index.arrow") as sink, pa.ipc.new_file(sink, index.schema) as w:
            w.write_batch(index)
        fs.move(f"{base}/{name}.tmp", f"{base}/{name}.arrow")
        yield pa.record_batch([pa.array([part], pa.int64()), pa.array([f"{uri}/{name}.arrow"]), pa.array([f"{uri}/{name}.index.arrow"]), pa.array([len(n)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["part", "path", "index_path", "documents", "tokens"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = f"{uri}/manifest"
    dealt.mapInArrow(write, "part long, path string, index_path string, documents long, tokens long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def open_arrow(uri: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a token or index file; local files are mapped, not read."""
    fs, local = open_fs(uri)
    return pa.ipc.open_file(pa.memory_map(local) if fs.type_name == "local" else fs.open_input_file(local))


def sequence(file: pa.ipc.RecordBatchFileReader, k: int, batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """ids (zero-copy) and mask of the k-th sequence of a token file."""
    got = file.get_batch(k // batch)
    return got.column(0)[k % batch].values.to_numpy(zero_copy_only=True), got.column(1)[k % batch].values.to_numpy(zero_copy_only=False)


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def document_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, indexes, bases in text_rows(batches, ("path", "index_path", "base")):
            for path, index_path, base in zip(paths, indexes, bases, strict=True):
                index = open_arrow(index_path).read_all()
                n = index["n_tokens"].to_numpy()
                ends, crc, doc, at = np.cumsum(n).tolist(), np.zeros(len(n), np.int64), 0, 0
                file = open_arrow(path)
                for k in range(file.num_record_batches):
                    batch = file.get_batch(k)
                    flat = batch.column(0).values.to_numpy(zero_copy_only=True)
                    size = batch.column(1).values.true_count
                    pos = 0
                    while doc < len(ends) and pos < size:
                        stop = min(size, ends[doc] - at)
                        crc[doc] = zlib.crc32(flat[pos:stop].astype("<u4").tobytes(), int(crc[doc]))
                        pos = stop
                        doc += ends[doc] - at == stop
                    at += size
                if doc != len(ends):
                    raise ValueError(f"{path} has fewer ids than its index")
                yield pa.record_batch([index["doc_id"].combine_chunks(), pa.array(index["first"].to_numpy() + base), pa.array(n), pa.array(crc)], schema=_READ)

    files = manifest.withColumn("base", F.sum("tokens").over(W.orderBy("part")) - F.col("tokens"))  # one row for each file
    return files.select("path", "index_path", "base").repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), fresh_dir(spark, "tokens"))
    return document_digests(manifest)


QUERIES = {"op3_token_files": op3_token_files}
ORACLES: dict[str, str] = {}
