"""Token ids in flat binary files.

Documents are encoded where they are read, and their ids, not their texts, are dealt out by ranges of doc_id and sorted; every
partition writes three files to the shared folder:
  part-NNNNN.bin  the ids of its documents one after another, little-endian unsigned integers, 16 bits wide where
                  the vocabulary and the end id allow it, else 32
  part-NNNNN.idx  n_docs + 1 little-endian unsigned 64-bit offsets into the .bin file, in ids
  part-NNNNN.ids  n_docs little-endian signed 64-bit document ids (the smallest integer stands for null)
and manifest.json lists the partitions in order with their bases: the number of ids before each, which are the prefix
sums of the partitions' counts. A document's place in the whole corpus is its partition's base plus its offset.
Readers map the files into memory.

The ranges are cut from a sample of the documents' ids and sizes, so that partitions hold about PART_BYTES of text each, or
less where that keeps all tasks busy. Rows that share an id are ordered and cut by a hash of their text and then by their place
in the input, so an id of very many rows fills several partitions.

Encoding a frequent word once for each task is what keeps it within budget; a test holds the ids against the
library's own for whole texts.

A task writes under a name of its own attempt and renames at the end, so a repeated or lost task leaves whole files.
The driver handles one row per partition.

Defined results: null and empty texts give the end id alone; a null doc_id comes first; repeated ids stand next to each
other, by a hash of their texts; an empty table gives no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import give_back_memory, numbered, shared_dir, small_batches
from lodestone.sources.tables import spread

NULL_ID = np.iinfo(np.int64).min
END_ID = 1
CHUNK_BYTES = 1 << 20  # of text that is encoded at once
KEEP_WORDS = 200_000  # words that a task remembers
PART_BYTES = 32 << 20  # of text whose ids one partition holds
SAMPLED = 100  # rows for each partition from which the ranges are cut
MOST_SAMPLED = 1_000_000

ENCODED = "doc_id long, digest long, file long, at long, part int, n int, ids binary"
PARTS = "part int, name string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat numbered at, one after another, and the positions at which they begin and the last one ends."""
    each = lengths[at]
    upto = np.cumsum(each)
    total = int(upto[-1]) if len(upto) else 0
    small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    index = np.repeat((starts[at] - (upto - each)).astype(small), each)
    index += np.arange(total, dtype=small)
    return flat[index], np.concatenate([[0], upto])


def _texts(words: pa.Array) -> list[str]:
    """Words without white space as Python strings, by one split."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), "\n")[0].as_py().split("\n") if len(words) else []


class Encoder:
    """Ids of texts by the tokenizers library, each distinct piece of plain text once.

    A plain text holds only ASCII, Latin letters and common punctuation, for which composition changes nothing. Such
    texts are lower-cased and cut at white space, a chunk at a time; the chunk's distinct words are looked up, and those
    not met before are cut by the vocabulary's own pattern into pieces for the library's merge model. All other texts go
    through the library whole. The first KEEP_WORDS words are remembered, later ones only for their chunk."""

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]|<\|(?:start|end)oftext\|>"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._read()
        give_back_memory()

    def _read(self) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        kinds = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and splits == [self.PIECES, None] and spec["model"]["end_of_word_suffix"] == "</w>"
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.shown = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in visible)}  # the byte-level alphabet
        self.clear()

    def clear(self) -> None:
        """Forgets all words. A worker outlives its task, and what it remembers would be missed by those that follow."""
        self.place: dict[str, int] = {"": 0}
        self.lengths, self.starts, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and the number of each's."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        text = " ".join(pieces).encode().decode("latin-1").replace(" ", "\n").translate(self.shown | {10: 32})
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(pieces):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, np.diff(upto, prepend=0)

    def _learn(self, words: pa.Array) -> list[str]:
        """Appends the ids of new words to the table: one word is one piece if it is all letters, else cut by the pattern."""
        alike = pc.utf8_is_alpha(words)
        words = pa.concat_arrays([words.filter(alike), words.filter(pc.invert(alike))])
        whole = pc.sum(alike).as_py() or 0
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(words.slice(whole), f"({self.PIECES})", r"\1 ")))
        column = pc.list_flatten(lists).dictionary_encode()
        own = _texts(words.slice(0, whole))
        ids, lengths = self._merge(own + _texts(column.dictionary))
        at = np.concatenate([np.arange(whole), whole + column.indices.to_numpy(zero_copy_only=False)])
        flat, ends = _gather(ids, np.cumsum(lengths) - lengths, lengths, at)
        n = np.diff(ends[np.cumsum(np.concatenate([np.ones(whole, np.int64), _lengths(lists)]))], prepend=0)
        new = _texts(words)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.lengths = np.concatenate([self.lengths, n])
        self.flat = np.concatenate([self.flat, flat])
        return new

    def _forget(self, new: list[str], words: int, ids: int) -> None:
        for w in new:
            del self.place[w]
        self.lengths, self.starts, self.flat = self.lengths[:words], self.starts[:words], self.flat[:ids]

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.utf8_lower(texts)))
        column = pc.list_flatten(lists).dictionary_encode()
        size, ids = len(self.place), len(self.flat)
        words = _texts(column.dictionary)
        place = self.place.get
        at = np.fromiter((place(w, -1) for w in words), np.int64, len(words))
        new = []
        if (unknown := np.flatnonzero(at < 0)).size:
            new = self._learn(column.dictionary.take(pa.array(unknown)))
            at[unknown] = np.fromiter(map(self.place.__getitem__, map(words.__getitem__, unknown.tolist())), np.int64, len(unknown))
        flat, ends = _gather(self.flat, self.starts, self.lengths, at[column.indices.to_numpy(zero_copy_only=False)])
        if new and len(self.place) > KEEP_WORDS:
            self._forget(new, size, ids)
        return flat, np.diff(ends[np.cumsum(_lengths(lists))], prepend=0)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END_ID, and the number of ids of each."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.NOT_PLAIN).to_numpy(zero_copy_only=False) if self.known else np.ones(len(texts), bool)
        if not odd.any():
            flat, n = self._plain(texts)
        else:
            plain, counts = self._plain(texts.filter(pa.array(~odd)))
            own, parts, n = np.split(plain, np.cumsum(counts)[:-1]) if len(counts) else [], [], []
            whole = iter(self.tokenizer.encode_batch(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
            own = iter(own)
            for is_odd in odd:
                parts.append(np.array(next(whole).ids if is_odd else next(own), np.uint32))
                n.append(len(parts[-1]))
            flat, n = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.array(n, np.int64)
        return np.insert(flat, np.cumsum(n), np.uint32(END_ID)), n + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_BYTES of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK_BYTES)) + 1
        yield batch.slice(at, end - at)
        at = end


def _id_type(tokenizer) -> str:
    return "<u2" if max(tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else "<u4"


# --- ranges -------------------------------------------------------------------------------------------------

KEY = ("doc_id", "digest", "file", "at")  # tells rows apart and puts them in order; a null id counts as NULL_ID


def _cuts(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """Keys between which the partitions lie, the last of each partition but the last one's."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    parts = min(n, max(-(-size // PART_BYTES), min(tasks, -(-size // (1 << 20)))))
    if parts < 2:
        return []
    every = max(1, n // min(SAMPLED * parts, MOST_SAMPLED))
    sample = rows.where(F.pmod(F.xxhash64(*KEY), F.lit(every)) == 0).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), *KEY[1:], "size")
    found = sorted(tuple(r) for r in sample.collect())
    upto = np.cumsum([1 + r[-1] for r in found])
    places = np.searchsorted(upto, upto[-1] / parts * np.arange(1, parts)) if len(found) else []
    return sorted({found[k][:-1] for k in places})


def _part_of(cuts: list[tuple[int, int, int, int]]):
    """The partition of each of a batch's keys: how many cuts come before it."""
    firsts = np.array([c[0] for c in cuts], np.int64)

    def part(ids: np.ndarray, rest: list[pa.Array]) -> np.ndarray:
        low, high = np.searchsorted(firsts, ids), np.searchsorted(firsts, ids, side="right")
        for k in np.flatnonzero(low < high):  # the id itself is cut
            key = (int(ids[k]), *(c[k].as_py() for c in rest))
            low[k] = bisect_left(cuts, key, low[k], high[k])
        return low

    return part


# --- files --------------------------------------------------------------------------------------------------


def _encoder(vocabulary: str, cuts: list[tuple[int, int, int, int]]):
    part_of = _part_of(cuts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            for chunk in _chunks(batch):
                encoder = encoder_for(vocabulary)
                kind = _id_type(encoder.tokenizer)
                flat, n = encoder(chunk.column(1))
                ends = np.concatenate([[0], np.cumsum(n)]) * np.dtype(kind).itemsize
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.astype(kind))])
                doc_ids = pc.fill_null(chunk.column(0), NULL_ID)
                rest = chunk.columns[2:5]
                part = part_of(doc_ids.to_numpy(zero_copy_only=False), rest)
                yield pa.RecordBatch.from_arrays([doc_ids, *rest, pa.array(part, pa.int32()), pa.array(n, pa.int32()), ids.cast(pa.binary())], names=["doc_id", "digest", "file", "at", "part", "n", "ids"])
            if k % 8 == 7:
                give_back_memory()
        _ENCODERS.pop(vocabulary, None)  # the worker lives on, and the next task may be another's
        give_back_memory()

    return encode


def _writer(uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(uri)
        part = TaskContext.get().partitionId()
        name, attempt = f"part-{part:05d}", uuid.uuid4().hex
        out, lengths, doc_ids, total = None, [], [], 0
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{root}/{name}.bin.{attempt}")
            ids, n = batch.column(2), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            out.write(memoryview(ids.buffers()[2])[starts[0] : starts[-1]] if len(ids) else b"")
            lengths.append(n)
            doc_ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
            total += int(n.sum())
        if out is None:
            return
        out.close()
        offsets = np.concatenate([np.zeros(1, "<u8"), np.cumsum(np.concatenate(lengths)).astype("<u8")])
        for kind_, data in (("idx", offsets), ("ids", np.concatenate(doc_ids))):
            with store.open_output_stream(f"{root}/{name}.{kind_}.{attempt}") as f:
                f.write(data.tobytes())
        for kind_ in ("bin", "idx", "ids"):
            store.move(f"{root}/{name}.{kind_}.{attempt}", f"{root}/{name}.{kind_}")
        yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(offsets) - 1, "n_tokens": total}], schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, uri: str, vocabulary: str) -> list[dict]:
    """Writes the files of docs (doc_id, text) under uri; returns the manifest's partitions, in order, with their bases."""
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    rows, (file, at) = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.col(file).alias("file"), F.col(at).alias("at"))
    cuts = _cuts(rows.select(*KEY, F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")))
    encoded = spread(rows).mapInArrow(_encoder(vocabulary, cuts), ENCODED)
    ordered = encoded.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions(*KEY).select("doc_id", "n", "ids")
    parts, base = [], 0
    with small_batches(docs.sparkSession):
        found = sorted(ordered.mapInArrow(_writer(uri), PARTS).collect())
    for r in found:
        parts.append(r.asDict() | {"base": base})
        base += r.n_tokens
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"end_id": END_ID, "parts": parts}).encode())
    return parts


def mapped(uri: str, name: str, kind: str) -> np.ndarray:
    """A file's integers: mapped into memory where the folder is mounted, else read."""
    store, root = fs.FileSystem.from_uri(uri)
    path = f"{root}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=kind)


def _reader(uri: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                offsets, ids = mapped(uri, f"{part['name']}.idx", "<u8").astype(np.int64), mapped(uri, f"{part['name']}.ids", "<i8")
                size = fs.FileSystem.from_uri(uri)[0].get_file_info(f"{fs.FileSystem.from_uri(uri)[1]}/{part['name']}.bin").size
                flat = mapped(uri, f"{part['name']}.bin", "<u2" if size == 2 * part["n_tokens"] else "<u4")
                crc = np.fromiter((zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids), mask=np.array(ids == NULL_ID)), pa.array(part["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(crc)], schema=schema)

    return read


def read_tokens(docs: DataFrame, uri: str, parts: list[dict]) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    rows = spark.createDataFrame([(p["name"], p["base"], p["n_tokens"]) for p in parts], "name string, base long, n_tokens long")
    return rows.mapInArrow(_reader(uri), ROWS)


def op6_token_output(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    uri = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    parts = write_tokens(docs, uri, vocabulary or vocabulary_path())
    return read_tokens(docs, uri, parts)
