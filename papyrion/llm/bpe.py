"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

A word's parts are held as two contiguous arrays: the part boundaries, and the rank of each adjacent pair. The smallest
rank is looked up again and again, the boundary it stands for is deleted, and the two neighbouring ranks are refreshed.
Both arrays are short for a word, so scanning them beats any linked structure; a word of more than ``SHORT`` bytes goes
through a heap instead, which keeps one endless word from costing the square of its length. Words repeat, so each Python
worker remembers the ids of those it has seen.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from papyrion.session import read_table

#: Folder of the public tokenizers' vocabulary files, and the vocabulary used by the queries.
TOKENIZER_DIR, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k"
# Fixed value: the word pattern of the byte-level vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of more bytes are merged by a heap.
SHORT = 200
#: Most words that a worker remembers; beyond that it begins anew.
REMEMBERED = 400_000
_NONE = 1 << 60


class ByteBpe(dict):
    """Encoder of one vocabulary; as a mapping it gives the ids of a word."""

    def __init__(self, path: str) -> None:
        super().__init__()
        lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.words = regex.compile(WORD_PATTERN)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        # A lone surrogate can't stand in UTF-8; it is encoded as the replacement character.
        data = word.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
        whole = self.ranks.get(data)
        ids = (whole,) if whole is not None else self._short(data) if len(data) <= SHORT else self._long(data)
        if len(word) <= SHORT:
            self[word] = ids
        return ids

    def _short(self, data: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        bounds = list(range(len(data) + 1))
        pairs = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == _NONE:
                break
            at = pairs.index(least)
            del bounds[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(data[bounds[at] : bounds[at + 2]], _NONE)
            if at:
                pairs[at - 1] = rank(data[bounds[at - 1] : bounds[at + 1]], _NONE)
        return tuple(self.ranks[data[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))

    def _long(self, data: bytes) -> tuple[int, ...]:
        rank, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, width = heapq.heappop(heap)
            mid = after[i]
            # An entry is out of date once one of its two parts has been merged.
            if mid < 0 or mid >= n or after[mid] - i != width:
                continue
            end = after[mid]
            after[i], after[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := rank(data[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end] - i))
            if (p := before[i]) >= 0 and (r := rank(data[p:end])) is not None:
                heapq.heappush(heap, (r, p, end - p))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.__getitem__, self.words.findall(text))))


_loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, one a process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def vocabulary(name: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[array]]]:
    """Ids (first column) and token ids (of the second column's texts) of each batch."""
    bpe = encoder(path)
    for b in batches:
        yield b.column(0), [bpe.encode(t) if t else array("i") for t in b.column(1).to_pylist()]


def encode_corpus(documents: DataFrame, id_column: str, text_column: str, path: str | None = None) -> DataFrame:
    """id and ids (ARRAY<INT>), one row for each row of ``documents``, without special tokens.

    Special tokens' names in a text are ordinary text. Defined cases: null and empty texts have the empty list; a null id
    and repeated rows stay as they are; texts are encoded whole at any length; other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    path = path or vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tokens in encode_batches(batches, path):
            offsets = np.zeros(len(tokens) + 1, dtype=np.int32)
            np.cumsum([len(t) for t in tokens], out=offsets[1:])
            flat = np.frombuffer(b"".join(t.tobytes() for t in tokens), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    return rows.mapInArrow(encode, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")
