"""Token ids in binary files with Elias-Fano document boundaries.

Documents are put in ascending id order by a range shuffle, each task
encodes its documents and writes files of at most ``FILE_IDS`` ids (or one
document) under the shared folder. A file holds

    magic ``EFTK1\\0\\0\\0``, then little-endian u32: version, id bytes (2 or 4),
    documents, ids, low bits, high bytes, select samples, reserved;
    ids (u16 if the vocabulary fits, else u32);
    Elias-Fano code of the document ends (low bits packed, high bits unary);
    u32 positions of every 256th one bit, for select.

A document's offset is ``select(i)``: one sample, a few popcounts and the
low bits, about 2 + log2(ids / documents) bits a document and no 64-bit
table. Readers get manifest rows and open those files in their tasks.

Tokenizing: the vocabulary's words never reach over white space, nor from a
letter to a mark or digit, so a text is cut there and each distinct part is
encoded once per worker (a bounded cache); tests compare it with encoding
whole texts.

Defined results: a null text is empty and has only the end id; null ids come
first; rows with equal ids are ordered by a hash of the text, so reruns
agree; an empty table gives no files and an empty result; extra columns are
ignored. A retried task writes under a new name and the manifest names the
files that count.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.llm.common import LOWER, UPPER, new_path, staged, table
from loanlens.llm.registry import register

END_ID = 2
FILE_IDS = 4_000_000
CACHE_WORDS = 400_000
READ_TASKS = 10_000
PLACES = 4096        # documents of one block when places are looked up in files
MAGIC = b"EFTK1\0\0\0"
SAMPLE = 256
_HEAD = struct.Struct("<8I")


# ---- Elias-Fano ----------------------------------------------------------------

def ef_encode(ends: np.ndarray) -> tuple[int, bytes, bytes, np.ndarray]:
    """(low bits, packed low parts, high bit vector, select samples) of ascending ``ends``."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = np.unpackbits((ends & ((1 << low_bits) - 1)).astype("<u4").view(np.uint8).reshape(n, 4), axis=1,
                        bitorder="little")[:, :low_bits] if low_bits else np.zeros((n, 0), np.uint8)
    ones = (ends >> low_bits).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return (low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Boundaries:
    """Document ends of one file: random access by select, or all at once."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.samples = n, low_bits, low, samples
        self.high = np.frombuffer(high, np.uint8)

    def _low(self, i: int) -> int:
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        part = int.from_bytes(self.low[first // 8:(last + 7) // 8], "little")
        return (part >> first % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """End of document ``i`` (the start of document i + 1)."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> at % 8 << at % 8
        while left >= bin(word).count("1"):
            left -= bin(word).count("1")
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[:self.n * self.low_bits]
            out |= bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits))
        return out


# ---- file format ---------------------------------------------------------------

def pack(ids: np.ndarray, ends: np.ndarray, id_bytes: int) -> bytes:
    low_bits, low, high, samples = ef_encode(ends)
    head = _HEAD.pack(1, id_bytes, len(ends), len(ids), low_bits, len(high), len(samples), 0)
    return b"".join([MAGIC, head, ids.astype(f"<u{id_bytes}").tobytes(), low, high, samples.tobytes()])


def unpack(blob: bytes) -> tuple[np.ndarray, Boundaries]:
    if blob[:8] != MAGIC:
        raise ValueError("not a token file")
    version, id_bytes, n, n_ids, low_bits, n_high, n_samples, _ = _HEAD.unpack_from(blob, 8)
    if version != 1:
        raise ValueError(f"unknown version {version}")
    at = 8 + _HEAD.size
    ids = np.frombuffer(blob, f"<u{id_bytes}", n_ids, at)
    at += n_ids * id_bytes
    n_low = (n * low_bits + 7) // 8
    low, high = blob[at:at + n_low], blob[at + n_low:at + n_low + n_high]
    samples = np.frombuffer(blob, "<u4", n_samples, at + n_low + n_high)
    return ids, Boundaries(n, low_bits, low, high, samples)


# ---- tokenizing ----------------------------------------------------------------

def _table(pairs) -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for chars, to in pairs:
        out[np.frombuffer(chars, np.uint8)] = np.frombuffer(to, np.uint8)
    return out


_BLANK = _table([(b"\t\n\v\f\r", b" ")])
_FOLD = _table([(b"\t\n\v\f\r", b" "), (UPPER.encode(), LOWER.encode())])
#: Kinds of bytes between which the vocabulary always cuts: letters, marks, digits (each alone); 0 is never cut.
_LETTER, _MARK, _DIGIT = 1, 2, 3
_KIND = np.array([0 if c > 126 or c < 33 or c == ord("'") else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit()
                  else _MARK for c in range(256)], np.uint8)
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
#: Byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes follow from U+0100.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {c: 256 + k for k, c in enumerate(c for c in range(256) if c not in _OWN)}


def split_parts(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(parts of all texts that are encoded on their own, number of parts of each text).

    The vocabulary is lower case, drops white space and cuts where letters,
    marks and digits meet, so A-Z are lowered and the texts cut there; that
    leaves few distinct parts. Apostrophes and characters beyond U+00FF are
    left to the tokenizer. Texts with a special token's brackets, which are
    matched as they stand, are cut at white space only.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[off[0]:off[-1]] if held is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    data = _FOLD[raw]
    kind = _KIND[data]
    # U+00C0-U+00FF are letters but for the signs of multiplication and division
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    special = np.asarray(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False), bool)
    if special.any():
        inside = np.repeat(special, np.diff(off))
        data[inside] = _BLANK[raw[inside]]
        kind[inside] = 0
    word = data != 32
    first = np.zeros(len(data), bool)
    if len(data):
        left, right = kind[:-1], kind[1:]
        first[1:] = ~word[:-1] | (left > 0) & (right > 0) & ((left != right) | (right == _DIGIT))
        first[off[:-1][off[:-1] < len(data)]] = True
        first &= word
    upto = np.concatenate([[0], np.cumsum(first)])
    data = data[word]
    at = np.append(np.flatnonzero(first[word]), len(data))
    parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return parts.dictionary_encode(), np.diff(upto[off])


class WordEncoder:
    """Encodes texts part by part with a bounded cache of distinct parts."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cache_words = cache_words
        self._clear()

    def _clear(self):
        self.slot: dict[bytes, int] = {}
        self.flat = np.zeros(0, f"<u{self.id_bytes}")
        self.start = np.zeros(1, np.int64)

    def _ids(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of parts; lower-case Latin words need no normalizing and go straight to the model."""
        found: list = [None] * len(parts)
        rest = []
        model = self.model
        for k, part in enumerate(parts):
            if part.isalpha() and part.islower():
                found[k] = [t.id for t in model.tokenize(part.decode())]
            elif _PLAIN.fullmatch(part.decode()):
                found[k] = [t.id for t in model.tokenize(part.decode("latin-1").translate(_BYTE_CHARS))]
            else:
                rest.append(k)
        others = self.tokenizer.encode_batch_fast([parts[k].decode() for k in rest], add_special_tokens=False)
        for k, e in zip(rest, others, strict=True):
            found[k] = e.ids
        return found

    def _learn(self, parts: list[bytes]):
        """Encode new parts and append their ids to the flat store."""
        found = self._ids(parts)
        base = len(self.slot)
        self.slot.update(zip(parts, range(base, base + len(parts)), strict=True))
        lens = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter(chain.from_iterable(found), self.flat.dtype, int(lens.sum()))
        self.flat = np.concatenate([self.flat, new])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with the end ids, number of ids of each text)."""
        if len(self.slot) > self.cache_words:
            self._clear()
        parts, counts = split_parts(texts)
        distinct = parts.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.slot]
        if new:
            self._learn(new)
        # the end id is one more store entry behind the parts
        flat = np.append(self.flat, np.array([end_id], self.flat.dtype))
        lens = np.append(np.diff(self.start), 1)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))
        ends = np.cumsum(counts)
        at = np.insert(slots[parts.indices.to_numpy()], ends, len(self.slot))
        n = lens[at]
        upto = np.cumsum(n)
        ids = flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(self.start[at] - (upto - n), n)]
        return ids, np.diff(np.concatenate([[0], upto[ends + np.arange(len(ends))]]))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# ---- writing and reading -------------------------------------------------------

_MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


def _writer(folder: str, vocab: str, end_id: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        enc = encoder(vocab)
        ids, docs, lens, held, seq = [], [], [], 0, 0

        def flush():
            nonlocal ids, docs, lens, held, seq
            n = np.concatenate(lens)
            name = f"part-{part:06d}-{seq:05d}-{uuid.uuid4().hex[:8]}.eftk"
            blob = pack(np.concatenate(ids), np.cumsum(n), enc.id_bytes)
            doc = pa.concat_arrays(docs)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(blob)
            # ids of the documents stand beside the ids, in the same order
            with store.open_output_stream(f"{root}/{name}.docs") as out, pa.ipc.new_stream(
                    out, pa.schema([("doc_id", doc.type)])) as w:
                w.write_batch(pa.record_batch([doc], names=["doc_id"]))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name],
                "n_docs": pa.array([len(n)], pa.int64()), "n_ids": pa.array([int(n.sum())], pa.int64())})
            ids, docs, lens, held = [], [], [], 0
            seq += 1
            return row

        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            for lo in range(0, len(texts), 256):
                got, n = enc.encode(texts.slice(lo, 256), end_id)
                ids.append(got)
                lens.append(n)
                docs.append(b.column(b.schema.get_field_index("doc_id")).slice(lo, 256))
                held += len(got)
                if held >= file_ids:
                    yield flush()
        if held:
            yield flush()
    return write


def write_tokens(docs: DataFrame, vocab: str, folder: str, end_id: int = END_ID, file_ids: int = FILE_IDS,
                 partitions: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` under ``folder``; returns the written manifest.

    The manifest has (part, seq, file, n_docs, n_ids) and ``start``, the ids
    before each file; it has one row a file.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    n = [partitions] if partitions else []
    ordered = keyed.repartitionByRange(*n, F.col("doc_id").asc_nulls_first(), "_tie")
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    manifest = staged(ordered.drop("_tie").mapInArrow(_writer(qualified(spark, folder), vocab, end_id, file_ids), _MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _store(folder: str):
    """(file system, root) of a qualified folder, on the driver or in a task."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme and host that Hadoop's settings give it; a local one as ``file:///...``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "long", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (array<int>).

    Tasks open the files of their manifest rows; contents are not shuffled.
    """
    at = _dealt(manifest.select("file", "start"))
    ids = ", ids array<int>" if with_ids else ""
    return at.mapInArrow(_decode(qualified(spark, folder), with_ids), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long{ids}")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, ids) of documents by their place in the whole corpus (``numbers``: one long column, from 0).

    Places outside the corpus give no row. A file is opened once for all
    places asked of it; their ends come from its select structure, not from
    decoding the others.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("first", F.coalesce(F.sum("n_docs").over(before), F.lit(0)))
    files = files.select("file", "first", (F.col("first") + F.col("n_docs")).alias("last"))
    wanted = numbers.toDF("number").filter("number IS NOT NULL").distinct()
    # a place lies in one file: both sides meet by blocks of places, the files' rows once for each block they reach
    block = files.select("*", F.explode(F.expr(f"sequence(first div {PLACES}, (last - 1) div {PLACES})")).alias("block"))
    hit = wanted.withColumn("block", F.expr(f"number div {PLACES}")).join(block, "block").filter("number >= first AND number < last")
    return (hit.select("file", (F.col("number") - F.col("first")).alias("at"), "number")
            .repartition("file").sortWithinPartitions("file", "at").mapInArrow(_select(qualified(spark, folder)), "number long, ids array<int>"))


def _dealt(files: DataFrame) -> DataFrame:
    """One task for each file up to ``READ_TASKS``; rows are a file's name and a number, so dealing them costs nothing."""
    return files.repartition(max(1, min(READ_TASKS, files.count())))


def _select(folder: str):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        opened, name = None, None          # the last file read
        for b in batches:
            numbers, found = [], []
            for file, at, number in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "at", "number")), strict=True):
                if file != name:
                    with store.open_input_file(f"{root}/{file}") as f:
                        opened, name = unpack(f.read()), file
                ids, bounds = opened
                numbers.append(number)
                found.append(ids[bounds.select(at - 1) if at else 0:bounds.select(at)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["number", "ids"])
    return select


def _decode(folder: str, with_ids: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for b in batches:
            for file, start in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "start")), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    ids, bounds = unpack(f.read())
                with store.open_input_file(f"{root}/{file}.docs") as f:
                    doc = pa.ipc.open_stream(f).read_all().column("doc_id").combine_chunks()
                ends = bounds.all()
                starts = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(starts, ends, strict=True)]
                out = [doc, pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    out.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)
    return decode


def tokens_of(docs: DataFrame, vocab: str, end_id: int = END_ID) -> DataFrame:
    """Write the files of ``docs`` into a new shared folder and read every document back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return read_tokens(spark, folder, write_tokens(docs, vocab, folder, end_id), docs.schema["doc_id"].dataType.simpleString())


@register("op9_token_ids")
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset, length and checksum of every document's ids, read back from the files."""
    import public_tokenizers
    return tokens_of(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
