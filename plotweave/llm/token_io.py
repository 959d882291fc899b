"""Token ids as Parquet list columns: sorted documents, bounded row groups, page indexes.

Two tables under one folder:

* ``tokens``: doc_id, part, start_in_part, n_tokens, ids. Ids are written with
  the version 2 writer: the id list dictionary-encoded (token ids repeat) and
  the integer metadata delta-encoded, with small pages so that column indexes
  let a reader skip to a document.
* ``parts``: part, start. One row per written partition; a document's start in
  the whole stream is its part's start plus its start in the part.

Reading metadata leaves the id column alone, and a filter on doc_id reaches the
row-group and page statistics because rows are written in doc_id order.

Defined results: a null text is empty and has the end id alone; null ids come
first; rows repeated under one id are written one after another; an empty table
writes no row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, columns, text_of

FORMAT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "compression": "zstd",
}
TOKENS_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens int, ids array<int>"
#: Bytes of units, ids and their bookkeeping that a worker remembers before it starts afresh.
REMEMBER_BYTES = 256 << 20
#: What an entry costs beside its characters and ids, and the longest unit worth an entry.
_ENTRY_BYTES, _LONGEST = 200, 256
#: Bytes of text that are encoded at a time; a longer text is a slice of its own.
SLICE = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Kinds of bytes: 1 letters, 2 digits, 3 other signs; 0 white space and whatever is not cut from what stands beside it.
_KIND = np.array([0 if b < 33 or b > 126 or b == 39 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)
#: First bytes of the characters of `_OTHER_SPACE`, in UTF-8.
_LEADS = np.zeros(256, dtype=bool)
_LEADS[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Other white space could be part of a run that a segment cuts; such texts are encoded whole.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
# The byte-level pre-tokeniser's published pattern, and characters whose classes are beyond doubt.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
_BLANK = _byte_letters()[32]


class UnitEncoder:
    """Encodes texts with a tokenizers file, unit by unit, and remembers the ids of units that keep occurring.

    A unit is a run of ASCII white space and what follows it up to the next
    change between letters, digits and other signs (an apostrophe is not cut
    from its neighbours). A byte-level pre-tokeniser cuts at all these places,
    so the ids of units join to the ids of the text. The file says whether that
    holds: with another pre-tokeniser, a normaliser, or added tokens that take
    white space with them, whole texts are encoded, as are texts that hold an
    added token or other white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cutter, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
        self.added = [t["content"] for t in added]
        byte_level = cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        spaced = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or _SPACE[list(t["content"].encode())].any() for t in added)
        self.by_unit = bool(byte_level and not spec.get("normalizer") and not spaced)
        # nothing but merges decides the ids of a piece
        more = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        self.by_piece = self.by_unit and model.get("type") == "BPE" and not any(model.get(k) for k in more)
        self.by_word = self.by_piece and not any(t.strip().isalpha() for t in self.added)
        self._forget()

    def _forget(self) -> None:
        """`place` of a unit: which entry of the pool holds its ids; an entry has a size and follows the one before."""
        self.place: dict[str, int] = {}
        self.pool, self.sizes, self.held = array("i"), array("i"), 0

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]

    def _ids(self, unit: str) -> list[int]:
        """Ids of a new unit: from the model piece by piece, which spares what the encoding of a text adds to that."""
        # letters, perhaps after a blank, need no pattern
        if self.by_word and unit.isascii():
            if unit.isalpha():
                return [t.id for t in self.model.tokenize(unit)]
            if unit[0] == " " and unit[1:].isalpha():
                return [t.id for t in self.model.tokenize(_BLANK + unit[1:])]
        if not self.by_piece or not _PLAIN(unit) or any(t in unit for t in self.added):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        return [i for p in _PIECES(unit) for i in self._piece(p)]

    def _starts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where units start in `data`, the bytes of all texts, which `bounds` part."""
        first = bounds[:-1][np.diff(bounds) > 0]
        if not self.by_unit or not len(data):
            return first
        space, kind = _SPACE[data], _KIND[data]
        # two-byte letters from U+00C0 to U+00FF; the signs of multiplication and division are left as they are
        accent = np.flatnonzero(data[:-1] == 0xC3)
        accent = accent[(data[accent + 1] != 0x97) & (data[accent + 1] != 0xB7)]
        kind[accent] = kind[accent + 1] = 1
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        start[first] = True
        doubt, blob = _LEADS[data], data.tobytes() if self.added else b""
        for t in self.added:
            token = t.encode()
            if token in blob:
                doubt |= data == token[0]
        for r in np.unique(np.searchsorted(bounds, np.flatnonzero(doubt), side="right") - 1):
            text = data[bounds[r] : bounds[r + 1]].tobytes().decode()
            if _OTHER_SPACE(text) or any(t in text for t in self.added):
                start[bounds[r] + 1 : bounds[r + 1]] = False
        return np.flatnonzero(start)

    def _places(self, units: list[str]) -> np.ndarray:
        """The pool's entries of the units; new ones are added."""
        out, find, place, n, held = [], self.place.get, self.place, len(self.sizes), 0
        for unit in units:
            at = find(unit)
            if at is None:
                ids, at = self._ids(unit), n
                self.pool.extend(ids)
                self.sizes.append(len(ids))
                n, held = n + 1, held + 4 * len(ids)
                if len(unit) <= _LONGEST:
                    place[unit] = at
                    held += len(unit) + _ENTRY_BYTES
            out.append(at)
        self.held += held
        return np.array(out, dtype=np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with `end_id` after them, and how many each text has."""
        if self.held > REMEMBER_BYTES:
            self._forget()
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        bounds = bounds - bounds[0]
        starts = self._starts(data, bounds)
        edges = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(starts), edges, pa.py_buffer(data)).dictionary_encode()
        known = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # the pool with the end id as one more entry, which follows the units of each text
        sizes = np.append(np.frombuffer(self.sizes, dtype=np.int32), 1).astype(np.int64)
        pool = np.append(np.frombuffer(self.pool, dtype=np.int32), np.int32(end_id))
        ends = np.searchsorted(starts, bounds[1:]) + np.arange(len(texts))
        order = np.full(len(starts) + len(texts), len(sizes) - 1)
        inner = np.ones(len(order), dtype=bool)
        inner[ends] = False
        order[inner] = known[coded.indices.to_numpy()]
        first, many = (np.cumsum(sizes) - sizes)[order], sizes[order]
        upto = np.cumsum(many)
        at = np.repeat(first - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)
        return pool[at], np.diff(upto[ends], prepend=0)


#: Encoders of this worker by file: a worker runs many tasks, and what it remembers serves them all.
_ENCODERS: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some SLICE bytes of text each; one longer text makes a range of its own."""
    upto, start = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    while start < len(texts):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE)) + 1
        yield start, min(end, len(texts))
        start = min(end, len(texts))


def _encoding_task(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for a, b in _slices(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a), end_id)
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(at + ends - sizes), pa.array(sizes.astype(np.int32)), lists], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                at += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append `end_id` and write the two tables under `folder`, in ascending id order.

    `tokenizer` is the path of a byte-level tokenizers file that each executor
    can open. Rows are dealt by ranges of (id, text hash): one id with many
    rows is spread unless the texts are equal too.
    """
    spark = docs.sparkSession
    bounded_batches(spark, "8m")
    own = columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = own.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    ordered.mapInArrow(_encoding_task(tokenizer, end_id), TOKENS_SCHEMA).write.options(**FORMAT).parquet(f"{folder}/tokens")
    # one row per written partition goes through one task
    totals = spark.read.schema(TOKENS_SCHEMA).parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.cast("long").alias("start")).coalesce(1).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens (and ids) of the documents that `where` selects; without `ids` only metadata is read."""
    tokens = spark.read.schema(TOKENS_SCHEMA).parquet(f"{folder}/tokens")
    if where is not None:
        tokens = tokens.where(where)
    parts = spark.read.schema("part int, start long").parquet(f"{folder}/parts")
    # one row per written partition: a few bytes for each task of the writing job
    return tokens.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *(["ids"] if ids else []))


def checksums(tokens: DataFrame) -> DataFrame:
    """Replace ids by ids_crc32, the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
