"""Byte-level BPE encoding and decoding by a global distinct-word shuffle (operator 6).

1. *Explode*: each scan task cuts its texts into words (the matches of the vocabulary's pattern) and gathers them in
   blocks of about ``block_chars`` characters. A block knows each distinct word once, most frequent first; a text is
   then the list of its words' numbers, in order of position.
2. *Shuffle the distinct words*: each block deals its distinct words into ``BUCKETS`` by a checksum of the word. A
   bucket gathers the words of up to ``salt_blocks`` blocks, encodes each distinct word once, and answers every block.
   Frequent words cannot gather: a block sends a word once, however often it occurs.
3. *Join back*: answers and the block's word numbers meet by block id, and ids are reassembled by position.
4. *Decode*: the emitted ids of a text are joined with the token-byte table, which is broadcast (its size is that of the
   vocabulary, whatever the data), and the bytes are put together by position.

Both sides of the last join cut the same scan into the same blocks, so neither texts nor word numbers need to be
written in between; a checksum of each block's words travels with the answers and a mismatch raises. The input must
therefore be a scan whose rows come in the same order when it is repeated (tables are; the result of a shuffle should
be written first).
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.text import LATIN_DIGITS, LATIN_LETTERS, NOT_LATIN, SPACES

BUCKETS = 256
BLOCK_CHARS = 9_000_000
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_WHITE = " \\t-\\r\\x85\\xa0"
_LATIN_WORDS = re.compile(
    f"{_SHORT}| ?[{LATIN_LETTERS}]+| ?[{LATIN_DIGITS}]+| ?[^{_WHITE}{LATIN_LETTERS}{LATIN_DIGITS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_any_words: list = []


def words_of(text: str) -> list[str]:
    """Matches of the public pattern, by a faster equal one where all characters are Latin."""
    if not NOT_LATIN.search(text):
        return _LATIN_WORDS.findall(text)
    if not _any_words:
        import regex

        white = " " + SPACES
        _any_words.append(regex.compile(rf"{_SHORT}| ?\p{{L}}+| ?\p{{N}}+| ?[^{white}\p{{L}}\p{{N}}]+|[{white}]+(?![^{white}])|[{white}]+"))
    return _any_words[0].findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _pack(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpack(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _numbers(values: np.ndarray) -> bytes:
    """32-bit numbers as byte planes, which compress well when most are small."""
    return _pack(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _read_numbers(raw: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(_unpack(raw, 4 * count), dtype=np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Numbering(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _blocks(frames: Iterator[pd.DataFrame], block_chars: int) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """(block id, rows' ids, rows' word numbers, words by number)."""
    base, done = (TaskContext.get().partitionId() << 32), 0
    numbers, ids, codes, chars = _Numbering(), [], [], 0

    def close():
        counts = np.bincount(np.concatenate(codes), minlength=len(numbers)) if numbers else np.zeros(0, dtype=np.int64)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(order), dtype=np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        words = list(numbers)
        return base + done, ids, [number[c] for c in codes], [words[i] for i in order.tolist()]

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
            found = words_of(text) if text else []
            codes.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.uint32, count=len(found)))
            ids.append(doc_id)
            chars += len(text or "")
            if chars >= block_chars:
                yield close()
                done += 1
                numbers, ids, codes, chars = _Numbering(), [], [], 0
    if ids:
        yield close()


def _dealt(words: list[str]) -> tuple[list[bytes], np.ndarray, int]:
    """Words as bytes, their buckets, and a checksum of them all."""
    raw = [w.encode() for w in words]
    sums = np.fromiter(map(zlib.crc32, raw), dtype=np.uint32, count=len(raw))
    return raw, (sums % BUCKETS).astype(np.uint8), zlib.crc32(sums.tobytes())


def _schema(fields: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


_WORDS = _schema("block long, check long, bucket int, n int, size long, lengths binary, words binary")


def _word_rows(frames: Iterator[pd.DataFrame], block_chars: int) -> Iterator[pd.DataFrame]:
    for block, _, _, words in _blocks(frames, block_chars):
        raw, buckets, check = _dealt(words)
        rows = []
        for bucket in range(BUCKETS):
            own = [raw[i] for i in np.flatnonzero(buckets == bucket).tolist()]
            if own:
                joined = b"".join(own)
                rows.append((block, check, bucket, len(own), len(joined), _numbers(np.array([len(w) for w in own])), _pack(joined)))
        yield pd.DataFrame(rows, columns=_WORDS.names)


_ANSWERS = _schema("block long, check long, bucket int, n int, n_ids int, lengths binary, ids binary")

_library: dict = {}


def encode_words(words: list[str], path: str) -> list[list[int]]:
    """Ids of words, each taken as one match of the pattern."""
    if path not in _library:
        import tiktoken

        _library[path] = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})
    return _library[path].encode_ordinary_batch(words, num_threads=1)


_tokens: dict[str, list[bytes]] = {}


def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: bytes of each id."""
    if path not in _tokens:
        ranks = read_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _tokens[path] = table
    return _tokens[path]


def _encode_bucket(frame: pd.DataFrame, path: str) -> pd.DataFrame:
    """All rows of one bucket and salt: each distinct word is encoded once."""
    numbers, asked = _Numbering(), []
    for n, size, lengths, words in zip(frame["n"], frame["size"], frame["lengths"], frame["words"], strict=True):
        ends = np.cumsum(_read_numbers(lengths, n)).tolist()
        raw, begin, own = _unpack(words, int(size)), 0, []
        for end in ends:
            own.append(numbers[raw[begin:end]])
            begin = end
        asked.append(own)
    ids = encode_words([w.decode() for w in numbers], path)
    packed = [np.array(x, dtype="<u4").tobytes() for x in ids]
    rows = []
    for block, check, bucket, own in zip(frame["block"], frame["check"], frame["bucket"], asked, strict=True):
        all_ids = np.frombuffer(b"".join([packed[i] for i in own]), dtype="<u4")
        lengths = np.array([len(ids[i]) for i in own])
        rows.append((block, check, bucket, len(own), len(all_ids), _numbers(lengths), _numbers(all_ids)))
    return pd.DataFrame(rows, columns=_ANSWERS.names)


#: Ids travel through pandas as text: a column of numbers with nulls would become floating-point there.
_CODES = _schema("block long, check long, doc_id string, place int, n long, codes binary")


def _code_rows(frames: Iterator[pd.DataFrame], block_chars: int) -> Iterator[pd.DataFrame]:
    """One row a text, and one (place -1) with the buckets of the block's words."""
    for block, ids, codes, words in _blocks(frames, block_chars):
        _, buckets, check = _dealt(words)
        rows = [(block, check, None, -1, len(words), _pack(buckets.tobytes()))]
        rows += [(block, check, doc_id, k, len(c), _numbers(c)) for k, (doc_id, c) in enumerate(zip(ids, codes, strict=True))]
        yield pd.DataFrame(rows, columns=_CODES.names)


_ENCODED = _schema("doc_id string, ids binary")


def _reassemble(codes: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    head = codes["place"] == -1
    if codes.empty or set(answers["check"]) - set(codes.loc[head, "check"]):
        raise RuntimeError("the scan gave other rows when it was repeated; write the input to a table first")
    n = int(codes.loc[head, "n"].iloc[0])
    buckets = np.frombuffer(_unpack(codes.loc[head, "codes"].iloc[0], n), dtype=np.uint8)
    ids = [b""] * n
    answered = 0
    for row in answers.itertuples(index=False):
        places = np.flatnonzero(buckets == row.bucket).tolist()
        answered += row.n
        all_ids, at = _read_numbers(row.ids, row.n_ids).tobytes(), 0
        for place, to in zip(places, (4 * np.cumsum(_read_numbers(row.lengths, row.n))).tolist(), strict=True):
            ids[place] = all_ids[at:to]
            at = to
    if answered != n:
        raise RuntimeError("words of a block were not answered")
    out_ids = []
    rest = codes[~head]
    for count, raw in zip(rest["n"], rest["codes"], strict=True):
        out_ids.append(b"".join(map(ids.__getitem__, _read_numbers(raw, int(count)).tolist())))
    return pd.DataFrame({"doc_id": rest["doc_id"], "ids": out_ids})


def encode(docs: DataFrame, ranks_path: str, block_chars: int = BLOCK_CHARS, salt_blocks: int = 1024) -> DataFrame:
    """Encode the texts of ``docs`` (doc_id, text).

    One row per row: doc_id, ``ids`` (little-endian unsigned 32-bit). Each match of the pattern is
    encoded separately, without special tokens. A null text is empty; an empty one has no ids; a null doc_id is kept;
    repeated rows are encoded each; an empty table gives no rows; other columns are ignored. A text longer than a block
    is a block of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    # the same block always meets the same salt_blocks blocks; within them a word is encoded once
    salt = (F.shiftright("block", 32) / salt_blocks).cast("long")
    words = rows.mapInPandas(partial(_word_rows, block_chars=block_chars), _WORDS).withColumn("salt", salt)
    answers = words.groupBy("bucket", "salt").applyInPandas(lambda frame: _encode_bucket(frame, ranks_path), _ANSWERS)
    codes = rows.mapInPandas(partial(_code_rows, block_chars=block_chars), _CODES)
    return codes.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_reassemble, _ENCODED).withColumn("doc_id", F.col("doc_id").cast("long"))


class TokenTable:
    """The token-byte table as one run of bytes, and where each id's bytes begin and how many they are."""

    def __init__(self, path: str) -> None:
        tokens = token_bytes(path)
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int32)
        self.begins = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids`` in order. An id outside of the vocabulary raises."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int64)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.raw[at + np.arange(len(at))].tobytes()


def _decode(frames: Iterator[pd.DataFrame], table, slice_: int = 1 << 18) -> Iterator[pd.DataFrame]:
    for frame in frames:
        decoded = []
        for raw in frame["ids"]:
            ids = np.frombuffer(raw or b"", dtype="<u4")
            decoded.append(b"".join(table.value.joined(ids[at : at + slice_]) for at in range(0, len(ids), slice_)))
        yield frame.assign(decoded=decoded)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the bytes of its ids by the token-byte table. Null or empty ids give no
    bytes; an id outside of the vocabulary raises; rows are decoded each, and other columns are left out."""
    table = encoded.sparkSession.sparkContext.broadcast(TokenTable(ranks_path))
    # ids that may be null are not sent through pandas as numbers
    rows = encoded.select(F.col("doc_id").cast("string"), "ids").mapInPandas(partial(_decode, table=table), "doc_id string, ids binary, decoded binary")
    return rows.withColumn("doc_id", F.col("doc_id").cast(encoded.schema["doc_id"].dataType))
