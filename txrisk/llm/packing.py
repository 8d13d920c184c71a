"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the powers of two of its length (the largest
length as often as needed, then the binary digits of the rest). Every piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of equal length form a bucket.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.batches import small_batches

#: Words a Python worker remembers per generation; the generation before is kept too.
CACHE_WORDS = 400_000
#: About how many pieces share a numbering slot.
SLOT_PIECES = 1 << 16


def _kinds() -> np.ndarray:
    """Per byte: 1 for ASCII letters and digits, 2 for ASCII signs but the apostrophe, else 0."""
    kinds = np.zeros(256, dtype=np.int8)
    kinds[33:127] = 2
    kinds[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8)] = 1
    kinds[ord("'")] = 0
    return kinds


_KIND = _kinds()


def cut_words(raws: list[bytes]) -> list[list[bytes]]:
    """Words of texts, also cut between ASCII letters or digits and signs, where every pre-token ends.

    An apostrophe may begin a pre-token with letters in it, so there is no cut next to one; nor is there next to
    other characters, whose kind depends on more than a byte.
    """
    special = [b"<|" in raw for raw in raws]  # a special token keeps its signs and its case
    ends = np.cumsum([0 if as_is else len(raw) + 1 for raw, as_is in zip(raws, special)])
    joined = np.frombuffer(b"".join([raw.lower() + b" " for raw, as_is in zip(raws, special) if not as_is]), dtype=np.uint8)
    kinds = _KIND[joined]
    at = np.flatnonzero(kinds[1:] * kinds[:-1] == 2) + 1
    cut = np.insert(joined, at, 32).tobytes()
    ends = (ends + np.searchsorted(at, ends)).tolist()
    return [raw.split() if as_is else cut[i:j].split() for raw, as_is, i, j in zip(raws, special, [0, *ends], ends)]


#: Words of ASCII characters but the apostrophe, and Latin-1 letters: their normal form and pre-tokens are plain.
_PLAIN = re.compile("[!-&(-~\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PRE_TOKEN = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+")
#: Words on which the plain way is compared with the library before it is taken.
_PROBES = ["Word", "straße,", "a1b22--c", "\u00c0\u00d6\u00d8\u00de\u00aa\u00b5\u00ba\u00ff", "(x).", "~!", "q" * 300]


def _byte_signs() -> dict[int, str]:
    """What the byte-level alphabet has for bytes that are no visible character of Latin-1."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {byte: chr(256 + i) for i, byte in enumerate(b for b in range(256) if b not in seen)}


_BYTE_SIGN = _byte_signs()


class WordIds(dict):
    """Ids of texts by way of their words: this tokenizer's pre-tokens never hold white space.

    Ids are kept as little-endian unsigned 32-bit bytes; a word that is missing is learned. Plain words are cut into
    their pre-tokens here, which go to the library's model; other words go through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer = Tokenizer.from_file(file)
        self._tokenize = self._tokenizer.model.tokenize
        self._old: dict[bytes, bytes] = {}
        self._plain = all(self._plain_ids(text) == self._library_ids(text) for text in _PROBES)

    def _library_ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _plain_ids(self, text: str) -> list[int]:
        pieces = _PRE_TOKEN.findall(text.lower())
        signs = [piece.encode("utf-8").decode("latin-1").translate(_BYTE_SIGN) for piece in pieces]
        return [token.id for piece in signs for token in self._tokenize(piece)]

    def __missing__(self, word: bytes) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            if self._plain and word.isalpha():  # ASCII letters only
                found = [token.id for token in self._tokenize(word.lower().decode("ascii"))]
            else:
                text = word.decode("utf-8")
                plain = self._plain and _PLAIN.fullmatch(text) and "<|" not in text
                found = self._plain_ids(text) if plain else self._library_ids(text)
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        if len(self) >= CACHE_WORDS:
            self._old = dict(self)
            self.clear()
        last = struct.pack("<I", end)
        return [b"".join(map(self.__getitem__, words)) + last for words in cut_words([text.encode("utf-8") for text in texts])]


@functools.lru_cache(maxsize=1)
def word_ids(file: str) -> WordIds:
    """The words that this Python worker knows; its later tasks need not learn them again."""
    return WordIds(file)


def binary_pieces(n: int, longest: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; ``longest`` is a power of two."""
    start = 0
    while n - start >= longest:
        yield start, longest
        start += longest
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def pack(documents: DataFrame, tokenizer_file: str, longest: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of ``documents(doc_id, text, ...)``.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length).
    A null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed each on
    its own. Other columns are ignored. Sequence ids are unique and depend on the rows only; they are numbered in
    slots spread by a hash of the piece, so no task numbers more than a slot.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = word_ids(tokenizer_file)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, rows = batch.iloc[at : at + 256], []
                encoded = words.encode_batch([text or "" for text in part["text"]], end_id)
                for doc_id, raw in zip(part["doc_id"].astype("Int64"), encoded):
                    n = len(raw) // 4
                    for start, length in binary_pieces(n, longest):
                        rows.append((doc_id, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                yield out.astype({"doc_id": "Int64"})

    small_batches(documents.sparkSession)
    slots = max(1, documents.count() // (SLOT_PIECES // 8))
    pieces = documents.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = pieces.withColumn("slot", F.pmod(F.xxhash64(*columns), F.lit(slots)))
    place = F.row_number().over(Window.partitionBy("slot").orderBy(*columns)) - 1
    bucket = F.log2("length").cast("int")
    buckets = longest.bit_length()
    return pieces.select(
        *columns,
        ((place * slots + F.col("slot")) * buckets + bucket).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        bucket.alias("bucket"),
    )
