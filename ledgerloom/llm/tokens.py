"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: forced boundaries. Two bytes that stand side by side inside no vocabulary token can never end up in one token,
so the text may be cut between them and the pieces encoded on their own. Two further conditions keep the tokenizer's
splitting pattern from seeing a difference: the byte before a cut is no white space (the pattern looks ahead over
it) and the byte after it is no apostrophe (the pattern has contractions). Pieces repeat far more often than texts do, so
each is encoded once per batch and worker, and the ids of a text are those of its pieces, in order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from ..session import ship

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k"
# Fixed value: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Bytes of pieces and ids that a worker remembers; beyond it the memory starts anew. Long pieces hardly repeat and aren't
# remembered. Both bound memory and never the result.
REMEMBERED = 64 << 20
LONG_PIECE = 200

_encoders: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Encoder of one rank file, with its table of certain cuts."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.cuts = certain_cuts(self.ranks)
        self.known: dict[bytes, list[int]] = {}
        self.size = 0

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text without cutting it."""
        return self.core.encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        """Ids of one text by its pieces."""
        return self.encode_column(pa.array([text], pa.string()))[0].tolist()

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text's ids). Null and empty texts have no ids.

        Pieces are views of the column's own bytes. Arrow finds the distinct ones, only those are looked up or encoded,
        and their ids are gathered in the order of the pieces.
        """
        texts = pa.compute.fill_null(texts, "") if texts.null_count else texts
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        first, size = (int(bounds[0]), int(bounds[-1] - bounds[0])) if len(texts) else (0, 0)
        if not size:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        bounds -= first
        data = np.frombuffer(texts.buffers()[2], np.uint8)[first : first + size]
        starts = np.zeros(size + 1, bool)
        starts[1:size] = self.cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        starts[bounds] = True
        edges = np.flatnonzero(starts).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        lists = self._known_lists(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = lists.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy(zero_copy_only=False))[codes], dtype=np.int64)))
        return ids, ends[np.searchsorted(edges, bounds)]

    def _known_lists(self, pieces: list[bytes]) -> pa.ListArray:
        known, plain, flat, ends = self.known, self.core.encode_ordinary, [], [0]
        for piece in pieces:
            ids = known.get(piece)
            if ids is None:
                ids = plain(piece.decode())
                if len(piece) <= LONG_PIECE:
                    if self.size > REMEMBERED:
                        known.clear()
                        self.size = 0
                    known[piece] = ids
                    self.size += len(piece) + 36 * len(ids) + 200
            flat.extend(ids)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def certain_cuts(ranks: dict[bytes, int]) -> np.ndarray:
    """For each pair of bytes (first * 256 + second), whether a cut between them is certain.

    No cut lies inside a character: a pair whose second byte continues a character is none.
    """
    inside = np.zeros(65536, bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1].astype(np.uint16) << 8 | b[1:]] = True
    first, second = np.divmod(np.arange(65536), 256)
    # White space that the pattern knows ends in one of these bytes in UTF-8; all other bytes above 127 are cut after
    # only if they are certain to end no such character, so those that may are left out.
    space = np.isin(first, [*range(9, 14), *range(28, 33)]) | (first == 0x80) | (first == 0x85) | (first == 0xA0) | ((first >= 0x81) & (first <= 0x8A)) | np.isin(first, [0xA8, 0xA9, 0xAF, 0x9F])
    continues = (second >= 0x80) & (second < 0xC0)
    return ~inside & ~space & ~continues & (second != ord("'"))


def encoder(folder: str = TOKENIZER_DIR, name: str = BYTE_BPE_50K) -> Encoder:
    """The worker's encoder of a rank file, read once."""
    if (folder, name) not in _encoders:
        _encoders[folder, name] = Encoder(folder, name)
    return _encoders[folder, name]


def encode_corpus(
    documents: DataFrame, key: str = "doc_id", text: str = "text", ids: str = "ids", folder: str = TOKENIZER_DIR, name: str = BYTE_BPE_50K
) -> DataFrame:
    """(key, ids ARRAY<INT>) of each row, without special tokens; their strings in a text are ordinary text.

    Null and empty texts give an empty list; blanks are text and have ids. Repeated rows come out as often as they go in,
    a null key stays null, an empty table gives no rows, and other columns are not read. Texts of any length are encoded whole.
    No shuffle: each batch is encoded where it is read.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            for part in by_bytes(b, 1):
                values, offsets = enc.encode_column(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, ids])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_corpus(
    documents: DataFrame, *keep: str, text: str = "text", count: str = "n_tokens", folder: str = TOKENIZER_DIR, name: str = BYTE_BPE_50K
) -> DataFrame:
    """The kept columns and the number of tokens of each row's text; 0 for null and empty texts."""
    ship(documents.sparkSession)
    keep_names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            last = b.num_columns - 1
            for part in by_bytes(b, last):
                _, offsets = enc.encode_column(part.column(last))
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(np.diff(offsets))], names=[*keep_names, count])

    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, text).mapInArrow(run, f"{kinds}, `{count}` bigint")


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes, so that memory follows bytes, not rows."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
