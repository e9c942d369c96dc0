"""Packing of documents into training windows by Karmarkar-Karp multiway differencing (operator 10).

1. *Tokenise and cut* (one Arrow scan): a document's ids, then an end id, are cut into pieces: whole windows, and a rest
   in near-equal parts of at most ``piece_tokens``. Only the pieces' numbers leave the scan, never the ids: their
   checksums are taken there. The piece table is written to the shared folder.
2. *Group*: whole windows are sequences already. The rests are dealt at random (by a hash of their row, so a key that
   repeats cannot gather) into groups of about ``group_windows`` windows.
3. *Difference*: in each group, partial partitions are merged two at a time, always the two with the greatest spread,
   the largest sums of one with the smallest of the other. This gives near-equal windows; while one of them exceeds the
   capacity, the number of windows rises and the group is packed again.

The shuffle moves some 40 bytes a piece. Groups are bounded by construction, whatever the data.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.text import LATIN_DIGITS, LATIN_LETTERS, NOT_LATIN
from quillgraph.storage import materialize

CACHED = 1 << 20
LONGEST_CACHED = 48
#: What the vocabulary's own splitter takes as one word, for lower-case Latin texts.
_LATIN_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTERS}]+|[{LATIN_DIGITS}]|[^\\t-\\r \\xa0{LATIN_LETTERS}{LATIN_DIGITS}]+"
)
#: Ids travel through pandas as text: a column of numbers with nulls would become floating-point there.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


#: The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_ALPHABET = {byte: byte if byte in _PRINTABLE else 256 + sum(b not in _PRINTABLE for b in range(byte)) for byte in range(256)}


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` vocabulary file.

    Words of Latin texts are looked up in a bounded memory of words seen before; the library's model merges new ones.
    Texts with other scripts, control characters or special strings go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Have the library's model merge each word, spelt in its alphabet of bytes."""
        if len(self.known) + len(words) > CACHED:
            self.known.clear()
        for word in words:
            merged = self.model.tokenize(word.encode().decode("latin-1").translate(_ALPHABET))
            self.known[word] = struct.pack(f"<{len(merged)}I", *[token.id for token in merged])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text (null: empty)."""
        split: list[list[str] | str] = []
        new: set[str] = set()
        for text in texts:
            if text is None or text == "":
                split.append([])
                continue
            small = text.lower()  # some Latin capitals have small letters beyond the Latin range
            if NOT_LATIN.search(text) or NOT_LATIN.search(small) or any(s in text for s in self.special):
                split.append(text)
            else:
                words = _LATIN_WORDS.findall(small)
                new.update(words)
                split.append(words)
        if missing := sorted(w for w in new if w not in self.known and len(w) <= LONGEST_CACHED):
            if len(missing) > CACHED // 2:
                for part in split:  # more new words than are ever held: no memory
                    yield b"".join(map(self.whole, part)) if isinstance(part, list) else self.whole(part)
                return
            if len(self.known) + len(missing) > CACHED:
                self.known.clear()
                missing = sorted(w for w in new if len(w) <= LONGEST_CACHED)
            self.learn(missing)
        known = self.known.get
        for part in split:
            if isinstance(part, str):
                yield self.whole(part)
            else:
                found = list(map(known, part))
                if None in found:
                    found = [x if x is not None else self.whole(w) for x, w in zip(found, part, strict=True)]
                yield b"".join(found)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cuts(tokens: int, window: int, piece_tokens: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then the rest in near-equal parts."""
    whole, rest = divmod(tokens, window)
    for k in range(whole):
        yield k * window, window
    parts, at = -(-rest // piece_tokens), whole * window
    for k in range(parts):
        length = rest // parts + (k < rest % parts)
        yield at, length
        at += length


def _pieces(frames: Iterator[pd.DataFrame], path: str, end_id: int, window: int, piece_tokens: int):
    end = np.array([end_id], dtype="<u4").tobytes()
    encode = encoder(path).encode
    for frame in frames:
        rows = []
        ids = frame["doc_id"].tolist()
        texts = frame["text"].tolist()
        for at in range(0, len(ids), 256):
            for doc_id, raw in zip(ids[at : at + 256], encode(texts[at : at + 256]), strict=True):
                raw += end
                tokens, view = len(raw) // 4, memoryview(raw)
                rows += [(doc_id, s, n, zlib.crc32(view[4 * s : 4 * (s + n)]), tokens) for s, n in cuts(tokens, window, piece_tokens)]
        yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def token_pieces(docs: DataFrame, vocabulary_path: str, end_id: int, window: int = 4096, piece_tokens: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    cut = partial(_pieces, path=vocabulary_path, end_id=end_id, window=window, piece_tokens=piece_tokens)
    return rows.mapInPandas(cut, PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: ``k`` subsets of the indexes of ``sizes`` with near-equal sums.

    A partial partition is its subsets in use, by falling sum, with the least sum taken off all once none of the k is
    empty. The two with the greatest spread are merged until one is left: the subsets of both side by side while there
    is room, beyond that the smallest of one with the smallest of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone, also = min(len(a), k - len(b)), min(len(b), k - len(a))
        merged = a[:alone] + b[:also]
        merged += [(x + y, m + n) for (x, m), (y, n) in zip(a[alone:], reversed(b[also:]), strict=True)]
        merged.sort(key=_by_sum)
        if len(merged) == k and (least := merged[-1][0]):
            merged = [(s - least, m) for s, m in merged]
        order += 1
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, order, merged))
    return [m for _, m in heap[0][2]] if heap else []


def _by_sum(subset: tuple[int, list[int]]) -> int:
    return -subset[0]


def windows(sizes: list[int], window: int) -> list[list[int]]:
    """Subsets of at most ``window``: as many near-equal ones as it takes."""
    total = sum(sizes)
    k = max(1, -(-total // window))
    while True:
        found = [part for part in difference(sizes, k) if part]
        most = max((sum(sizes[i] for i in part) for part in found), default=0)
        if most <= window:
            return found
        k += max(1, (most - window) * k // (4 * window))


def _pack_group(key: tuple, frame: pd.DataFrame, window: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
    sizes = frame["length"].tolist()
    sequence, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    for number, part in enumerate(windows(sizes, window)):
        at = 0
        for i in part:
            sequence[i], offset[i] = number, at
            at += sizes[i]
    # below 2**62 by group and number; whole windows have the ids from 2**62 on
    frame = frame.assign(sequence_id=(int(key[0]) << 24) + sequence, offset=offset)
    return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(pieces: DataFrame, window: int = 4096, group_windows: int = 128) -> DataFrame:
    """Give each piece its ``sequence_id`` and ``offset``. ``pieces`` must be a written table: it is read twice and its
    rows are numbered by their place.

    A group has about ``group_windows`` windows of rests, so the shortfall of its last window, and the padding, stay
    below one in that many. Group numbers and in-group numbers make unique ids.
    """
    rests = pieces.where(F.col("length") < window)
    total = rests.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (window * group_windows)))
    packed = (
        rests.withColumns({"doc_id": F.col("doc_id").cast("string"), "_group": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))})
        .groupBy("_group")
        .applyInPandas(lambda key, frame: _pack_group(key, frame, window), f"{PIECES}, sequence_id long, offset long")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    whole = pieces.where(F.col("length") == window).select(
        "*", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, window: int = 4096, piece_tokens: int = 512, group_windows: int = 128) -> DataFrame:
    """Pack the texts of ``docs`` (doc_id, text) into sequences of at most ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32 (of little-endian 32-bit ids), doc_tokens (with the end id),
    sequence_id, offset. Every id lies in exactly one piece. A null or empty text is its end id alone; a null doc_id is
    kept; repeated rows are packed each on their own; an empty table gives no rows; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, vocabulary_path, end_id, window, piece_tokens), "pieces")
    return pack(pieces, window, group_windows)
