"""Byte-pair encoding in batched numpy merge rounds, and decoding, with the vocabulary of a tokenizers file.

Texts are cut into chunks (at white space, where the tokenizer's rules drop it;
otherwise a text is one chunk), chunks into the pieces of the pre-tokenizer.
What a worker has not met before is merged in one go: the symbols of all new
pieces lie in one flat array, each round finds the ranks of all adjacent pairs
by binary search over the sorted pair keys, takes the lowest rank of each piece
and merges its pairs, and pieces without a known pair leave the array.

Merging all pairs of the lowest rank at once equals merging them one by one
from the left as long as the new symbol has no pair of a still lower rank;
merges where it has (a symbol that several pairs make) are done one at a time.
Pieces of more than `LONG` symbols go through a heap of pairs, whose cost grows
with n log n where rounds would grow with n squared; the ids are the same.

Defined results: a null text has no ids and decodes to the empty text (null
packed or listed ids likewise); strings of added tokens in a text are these
tokens, as in the library; texts of any length are whole; repeated rows and
null ids of documents are rows like others; an empty table gives an empty
table; other columns pass through, and a column named like a new one is
replaced by it.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, text_of

#: Bytes of text that are encoded at a time, and ids that are decoded at a time; a longer text is a slice of its own.
SLICE = 2 << 20
SLICE_IDS = 1 << 19
#: Bytes of chunks, pieces, ids and their bookkeeping that a worker remembers before it starts afresh.
REMEMBER_BYTES = 192 << 20
#: What an entry costs beside its characters and ids, and the longest chunk or piece worth an entry.
_ENTRY_BYTES, _LONGEST = 200, 256
#: Symbols from which a piece is merged by a heap.
LONG = 1024
_NEVER = np.iinfo(np.int32).max
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

# The rules of a published word tokenizer, under which white space parts words and is dropped.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_CUTTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}

#: Characters that normalization leaves alone and whose lower case and classes are beyond doubt.
_PLAIN = re.compile("[!-~\xa1-ɏ]+").fullmatch
_WORD_PIECES = regex.compile(WORD_PATTERN).findall


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = str.maketrans({chr(b): c for b, c in _byte_letters().items()})


def gather(pool: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The pool's entries (of `sizes`, one after another) in `order`, joined."""
    first, many = (np.cumsum(sizes) - sizes)[order], sizes[order]
    upto = np.cumsum(many)
    return pool[np.repeat(first - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)]


class Merger:
    """The merge table of a BPE model: pair keys in order, with the rank and the symbol of each."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("only BPE models that merges alone decide are supported")
        vocab: dict[str, int] = model["vocab"]
        ahead, behind = model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or ""
        self.base = max(vocab.values()) + 1
        pairs: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a] * self.base + vocab[b]] = (rank, vocab[a + b.removeprefix(ahead)])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.makes = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        # lowest rank among the pairs that a symbol is part of
        least = np.full(self.base, _NEVER, dtype=np.int32)
        for side in (self.keys // self.base, self.keys % self.base):
            np.minimum.at(least, side, self.ranks)
        self.singly = least[self.makes] < self.ranks
        # symbols of single characters: alone, first, inner and last in a piece
        top = max((ord(c) for t in vocab if len(c := t.removeprefix(ahead).removesuffix(behind)) == 1), default=0) + 1
        self.symbols = np.full((4, top + 1), -1, dtype=np.int32)
        for kind, (before, after) in enumerate((("", behind), ("", ""), (ahead, ""), (ahead, behind))):
            for code in range(top):
                self.symbols[kind, code] = vocab.get(before + chr(code) + after, -1)

    def _start(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        kind = np.full(len(codes), 2)
        kind[(ends - sizes)[sizes > 0]] = 1
        kind[ends[sizes > 0] - 1] = 3
        kind[ends[sizes == 1] - 1] = 0
        found = self.symbols[kind, np.minimum(codes, self.symbols.shape[1] - 1)]
        known = found >= 0
        return found[known], np.repeat(np.arange(len(pieces), dtype=np.int64), sizes)[known]

    def merge(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each piece has."""
        symbols, owner = self._start(pieces)
        sizes = np.bincount(owner, minlength=len(pieces)) if len(owner) else np.zeros(len(pieces), dtype=np.int64)
        long = sizes > LONG
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if long.any():
            bounds = np.cumsum(sizes)
            for i in np.flatnonzero(long):
                ids = self._by_heap(symbols[bounds[i] - sizes[i] : bounds[i]].tolist())
                done.append((np.array(ids, dtype=np.int32), np.full(len(ids), i, dtype=np.int64)))
            short = ~long[owner]
            symbols, owner = symbols[short], owner[short]
        while len(symbols):
            symbols, owner = self._round(symbols, owner, done)
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(pieces), dtype=np.int64)
        owner = np.concatenate([o for _, o in done])
        order = np.argsort(owner, kind="stable")
        return np.concatenate([s for s, _ in done])[order], np.bincount(owner, minlength=len(pieces))

    def _round(self, symbols: np.ndarray, owner: np.ndarray, done: list) -> tuple[np.ndarray, np.ndarray]:
        """One merge round over the flat array; pieces that are ready move to `done`."""
        key = symbols[:-1].astype(np.int64) * self.base + symbols[1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(len(key), dtype=np.int64)
        hit = (owner[:-1] == owner[1:]) & (self.keys[at] == key if len(self.keys) else False)
        rank = np.append(np.where(hit, self.ranks[at] if len(self.keys) else 0, _NEVER), _NEVER).astype(np.int32)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, starts)
        each = np.repeat(lowest, np.diff(np.append(starts, len(symbols))))
        ready = each == _NEVER
        if ready.any():
            done.append((symbols[ready], owner[ready]))
        take = np.flatnonzero((rank == each) & ~ready)
        if not len(take):
            return symbols[:0], owner[:0]
        # of pairs that overlap (a symbol followed by itself) every other one from the left
        follows = np.append(False, take[1:] == take[:-1] + 1)
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(take))))
        take = take[(np.arange(len(take)) - run) % 2 == 0]
        alone = self.singly[at[take]]
        if alone.any():
            first = np.append(True, owner[take][1:] != owner[take][:-1])
            take = take[first | ~alone]
        out = symbols.copy()
        out[take] = self.makes[at[take]]
        keep = ~ready
        keep[take + 1] = False
        return out[keep], owner[keep]

    def _by_heap(self, symbols: list[int]) -> list[int]:
        n, pairs, base = len(symbols), self.pairs, self.base
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[k][0], i, k) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (k := a * base + b) in pairs]
        heapq.heapify(heap)
        while heap:
            _, i, key = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] * base + symbols[j] != key:
                continue
            symbols[i], symbols[j] = pairs[key][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (found := pairs.get(symbols[left] * base + symbols[right])):
                    heapq.heappush(heap, (found[0], left, symbols[left] * base + symbols[right]))
        return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes texts chunk by chunk and remembers chunks and pieces that keep occurring."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Merger(spec["model"])
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.by_chunk = spec.get("normalizer") == WORD_NORMALIZER and spec.get("pre_tokenizer") == WORD_CUTTER and not any(c in t for t in self.added for c in " \t\n\v\f\r")
        self._forget()

    def _forget(self) -> None:
        self.chunks, self.chunk_ids, self.chunk_sizes = {}, array("i"), array("i")
        self.pieces, self.piece_ids, self.piece_sizes = {}, array("i"), array("i")
        for token, at in self.added.items():
            # no piece starts with a line feed
            self.pieces["\n" + token] = len(self.piece_sizes)
            self.piece_ids.append(at)
            self.piece_sizes.append(1)
        self.held = 0

    def _cut(self, chunk: str) -> list[str]:
        """The pieces of a chunk, in the letters of the vocabulary."""
        if self.by_chunk and _PLAIN(chunk) and not (self.cut_added and self.cut_added.search(chunk)):
            found = _WORD_PIECES(chunk.lower())
            return found if chunk.isascii() else [p if p.isascii() else p.encode().decode("latin-1").translate(_LETTERS) for p in found]
        out = []
        for i, part in enumerate(self.cut_added.split(chunk) if self.cut_added else [chunk]):
            if i % 2:
                out.append("\n" + part)
            elif part:
                if self.tokenizer.normalizer is not None:
                    part = self.tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if self.tokenizer.pre_tokenizer is not None else [part]
        return out

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The entries of the chunks; new ones are cut, their new pieces merged together, and added."""
        places, new, counts, refs, fresh = [], len(self.chunk_sizes), [], [], []
        next_piece = len(self.piece_sizes)
        for chunk in chunks:
            at = self.chunks.get(chunk)
            if at is None:
                at, before = new, len(refs)
                for piece in self._cut(chunk):
                    ref = self.pieces.get(piece)
                    if ref is None:
                        ref = self.pieces[piece] = next_piece
                        next_piece += 1
                        fresh.append(piece)
                        self.held += _ENTRY_BYTES + 2 * len(piece)
                    refs.append(ref)
                counts.append(len(refs) - before)
                if len(chunk) <= _LONGEST:
                    self.chunks[chunk] = new
                self.held += _ENTRY_BYTES + 2 * len(chunk)
                new += 1
            places.append(at)
        if fresh:
            ids, sizes = self.merger.merge(fresh)
            self.piece_ids.frombytes(ids.astype(np.int32).tobytes())
            self.piece_sizes.frombytes(sizes.astype(np.int32).tobytes())
            for piece in fresh:
                if len(piece) > _LONGEST:
                    del self.pieces[piece]
        if counts:
            sizes, refs = np.frombuffer(self.piece_sizes, dtype=np.int32).astype(np.int64), np.array(refs, dtype=np.int64)
            ids = gather(np.frombuffer(self.piece_ids, dtype=np.int32), sizes, refs)
            upto = np.append(0, np.cumsum(sizes[refs]))
            ends = np.cumsum(counts)
            self.chunk_ids.frombytes(ids.astype(np.int32).tobytes())
            self.chunk_sizes.frombytes((upto[ends] - upto[ends - counts]).astype(np.int32).tobytes())
            self.held += 8 * len(ids)
        return np.array(places, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without null), one after another, and how many each text has."""
        if self.held > REMEMBER_BYTES:
            self._forget()
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
        bounds = bounds - bounds[0]
        if self.by_chunk:
            inner = ~_SPACE[data]
            start = inner.copy()
            start[1:] &= ~inner[:-1]
            start[bounds[:-1][np.diff(bounds) > 0]] = True
            start &= inner
            starts = np.flatnonzero(start)
            kept = np.append(0, np.cumsum(inner))
            edges, data = np.append(kept[starts], kept[-1]), data[inner]
        else:
            starts = bounds[:-1][np.diff(bounds) > 0]
            edges = np.append(starts, len(data))
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        order = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = np.frombuffer(self.chunk_sizes, dtype=np.int32).astype(np.int64)
        ids = gather(np.frombuffer(self.chunk_ids, dtype=np.int32), sizes, order) if len(order) else np.zeros(0, dtype=np.int32)
        upto = np.append(0, np.cumsum(sizes[order])) if len(order) else np.zeros(1, dtype=np.int64)
        return ids, np.diff(upto[np.searchsorted(starts, bounds)])


class Decoder:
    """Turns ids into texts: without a decoder in the file tokens are joined by blanks, in one pass over bytes; otherwise the library decodes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.joined = self.tokenizer.decoder is None
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocab.values(), default=-1) + 1)
        self.known = np.zeros(len(tokens), dtype=bool)
        for token, at in vocab.items():
            tokens[at] = b" " + token.encode()
            self.known[at] = True
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        ends = np.cumsum(sizes)
        if not self.joined:
            return pa.array(self.tokenizer.decode_batch([ids[b - n : b].tolist() for b, n in zip(ends, sizes, strict=True)], skip_special_tokens=False), pa.string())
        # ids that the vocabulary lacks are left out, as in the library
        known = (ids >= 0) & (ids < len(self.known))
        known[known] = self.known[ids[known]]
        upto = np.append(0, np.cumsum(known))
        ids, ends = ids[known], upto[ends]
        data, length = gather(self.pool, self.sizes, ids), np.append(0, np.cumsum(self.sizes[ids]))
        at = length[np.append(0, ends)]
        # the blank before a text's first token goes
        lead = at[:-1][np.diff(at) > 0]
        data = np.delete(data, lead)
        gone = np.append(0, np.cumsum(np.diff(at) > 0))
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer((at - gone).astype(np.int32)), pa.py_buffer(data))


#: Coders of this worker by kind and file: a worker runs many tasks, and what it remembers serves them all.
_CODERS: dict = {}


def _coder(kind: type, path: str):
    if (kind, path) not in _CODERS:
        _CODERS[kind, path] = kind(path)
    return _CODERS[kind, path]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of some `most` units each; one longer row makes a range of its own."""
    upto, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = min(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most)) + 1, len(sizes))
        yield start, end
        start = end


def _with_columns(df: DataFrame, kinds: dict[str, T.DataType]) -> T.StructType:
    """The schema of `df` with the named columns at its end, in place of any of these names."""
    return T.StructType([f for f in df.schema if f.name not in kinds] + [T.StructField(n, k) for n, k in kinds.items()])


def _numbered_columns(df: DataFrame, names: list[str], last: Column) -> DataFrame:
    """The named columns and `last` under numbers for names, which clash with none."""
    return df.select(*[F.col(n).alias(str(i)) for i, n in enumerate(names)], last.alias(str(len(names))))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", packed: bool = False) -> DataFrame:
    """All columns of `docs`, with `ids` of the whole text and `n_tokens`.

    `ids` is an array of ints, or with `packed` their little-endian 32-bit
    integers as binary. `tokenizer` is the path of a BPE tokenizers file that
    each executor can open; special tokens are not added.
    """
    bounded_batches(docs.sparkSession, "8m")
    schema = _with_columns(docs, {"ids": T.BinaryType() if packed else T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()})
    names = [f.name for f in schema][:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _coder(Encoder, tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.string())
            for a, b in _slices(pc.binary_length(texts).to_numpy(), SLICE):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                ends = np.append(0, np.cumsum(sizes))
                if packed:
                    coded = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<i4"))])
                else:
                    coded = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(names))] + [coded, pa.array(sizes)], names=[*names, "ids", "n_tokens"])

    return _numbered_columns(docs, names, text_of(text_col)).mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """All columns of `rows`, with the text of the ids in `ids_col` (packed or listed), special tokens included, as `name`."""
    bounded_batches(rows.sparkSession, "8m")
    schema = _with_columns(rows, {name: T.StringType()})
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _coder(Decoder, tokenizer)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            if pa.types.is_binary(ids.type) or pa.types.is_large_binary(ids.type):
                sizes = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            else:
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in _slices(sizes, SLICE_IDS):
                own = ids.slice(a, b - a)
                if pa.types.is_binary(own.type) or pa.types.is_large_binary(own.type):
                    flat = np.frombuffer(b"".join(own.drop_null().to_pylist()), dtype="<i4")
                else:
                    flat = own.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(names))] + [decoder.decode(flat, sizes[a:b])], names=[*names, name])

    return _numbered_columns(rows, names, F.col(ids_col)).mapInArrow(run, schema)
