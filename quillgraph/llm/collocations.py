"""Phrase collocation mining by hierarchical pair naming (operator 11).

A phrase of k words is the pair of its first and its last k - 1 words, so a frequent phrase is named by a pair of names of
frequent shorter ones, and the pair stays as its two parents.

1. *Cut*: a scan cuts texts into pieces and words and gathers blocks of about ``block_chars`` characters of one language.
   A block has its words' local numbers in order, and each distinct word once with its count. Blocks are a written table.
2. *Name*: the distinct entries of all blocks (words at first, then pairs of names) meet by their content. Those that
   occur often enough are named by the place of their first entry: block and number. One shuffle counts and names.
3. *Replace*: names go back to their blocks, and neighbouring named entries become the next level's pairs, in order of
   place. An entry that is not frequent ends a phrase, for no longer one around it can be frequent.
4. *Look up*: a phrase has the counts of its front parts from its left parent and of its back parts from its right one;
   what lies inside of a longer candidate is found among that one's parents.

What moves is a distinct entry a block, never a row an occurrence: the commonest word sends a row a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.storage import discard, materialize

BLOCK_CHARS = 4_000_000
#: Blocks in a file: a task that writes or reads blocks holds no more of them at once, however many it has.
FILE_BLOCKS = 4
#: Bits of a name: below these, the number of an entry in its block; above, the block's in its task and the task's.
NUMBER_BITS, BLOCK_BITS = 26, 15
END = b"."
#: What ends a piece becomes a full stop; A-Z become small.
_TABLE = bytes.maketrans(ascii_uppercase.encode() + b",;:!?\n\x0b\x0c\r", ascii_lowercase.encode() + END * 9)
_BLOCKS = "block long, lang string, codes binary, words array<string>, counts array<long>"
_PAIRS = "block long, codes binary, lefts array<long>, rights array<long>, counts array<long>"


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), codec="zstd", asbytes=True) if len(codes) else b""


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, decompressed_size=4 * size, codec="zstd", asbytes=True), dtype="<i4") if size else np.zeros(0, dtype="<i4")


class _Block:
    """Words of one language: numbers by word (0 ends a piece), and the words of the texts so far by number."""

    def __init__(self) -> None:
        self.numbers, self.codes, self.chars = {END: 0}, [], 0

    def add(self, text: bytes) -> None:
        give, numbers = self.numbers.setdefault, self.numbers
        tokens = text.replace(END, b" . ").split()
        self.codes.append(np.fromiter((give(t, len(numbers)) for t in tokens), dtype=np.int32, count=len(tokens)))
        self.codes.append(np.zeros(1, dtype=np.int32))
        self.chars += len(text)


def _chunks(text: bytes, size: int) -> Iterator[bytes]:
    """``text`` cut at ends of pieces, each part as short as can be but ``size`` at least."""
    at = 0
    while len(text) - at > size:
        end = text.find(END, at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _blocks(frames: Iterator[pd.DataFrame], block_chars: int) -> Iterator[pd.DataFrame]:
    base, serial, held = TaskContext.get().partitionId() << BLOCK_BITS, 0, {}

    def closed(lang: str) -> pd.DataFrame:
        nonlocal serial
        block = held.pop(lang)
        if serial >> BLOCK_BITS or len(block.numbers) >> NUMBER_BITS:
            raise OverflowError("too many blocks in a task, or words in a block")
        codes = np.concatenate(block.codes)
        counts = np.bincount(codes, minlength=len(block.numbers))
        row = (base + serial, lang, len(codes).to_bytes(8, "little") + _packed(codes), [w.decode() for w in block.numbers], counts.tolist())
        serial += 1
        return pd.DataFrame([row], columns=["block", "lang", "codes", "words", "counts"])

    for frame in frames:
        for lang, text in zip(frame["lang"].tolist(), frame["text"].tolist(), strict=True):
            for part in _chunks((text or "").encode().translate(_TABLE), block_chars):
                held.setdefault(lang, _Block()).add(part)
                if held[lang].chars >= block_chars:
                    yield closed(lang)
        while sum(b.chars for b in held.values()) >= 2 * block_chars:  # many languages at once: the largest goes
            yield closed(max(held, key=lambda x: held[x].chars))
    for lang in list(held):
        yield closed(lang)


def _paired(blocks: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """A block's pairs of neighbouring named entries: their places, and each distinct pair with its count."""
    if blocks.empty or names.empty:
        return pd.DataFrame([], columns=["block", "codes", "lefts", "rights", "counts"])
    raw = blocks["codes"].iloc[0]
    codes = _unpacked(raw[8:], int.from_bytes(raw[:8], "little"))
    ids, known = names["id"].to_numpy(dtype=np.int64), np.full(int(max(codes.max(initial=0), names["no"].max())) + 2, -1, dtype=np.int64)
    known[names["no"].to_numpy()] = np.arange(len(ids))
    entries = known[codes]  # of -1: the last one, which is not known
    places = np.flatnonzero((entries[:-1] >= 0) & (entries[1:] >= 0))
    keys, inverse, counts = np.unique(entries[places] * len(ids) + entries[places + 1], return_inverse=True, return_counts=True)
    pairs = np.full(max(0, len(codes) - 1), -1, dtype=np.int32)
    pairs[places] = inverse
    if len(keys) >> NUMBER_BITS:
        raise OverflowError("too many pairs in a block")
    row = (blocks["block"].iloc[0], len(pairs).to_bytes(8, "little") + _packed(pairs), ids[keys // len(ids)].tolist(), ids[keys % len(ids)].tolist(), counts.tolist())
    return pd.DataFrame([row], columns=["block", "codes", "lefts", "rights", "counts"])


def _entries(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row per distinct entry of a block: block, no, the named array columns without their final s, count."""
    kept = [c for c in ("block", "lang") if c in blocks.columns]
    rows = blocks.select(*kept, F.posexplode(F.arrays_zip(*columns, "counts")).alias("no", "e"))
    return rows.select(*kept, "no", *(F.col(f"e.{c}").alias(c[:-1]) for c in columns), F.col("e.counts").alias("count"))


def _named(entries: DataFrame, *content: str, least: int) -> DataFrame:
    """Entries whose ``content`` occurs ``least`` times in all, with ``f`` and ``id``, the place of its first entry."""
    alike = Window.partitionBy(*content)
    place = F.shiftleft("block", NUMBER_BITS).bitwiseOR(F.col("no").cast("long"))
    seen = entries.withColumn("place", place).withColumns({"f": F.sum("count").over(alike), "id": F.min("place").over(alike)})
    return seen.where(F.col("f") >= least).drop("count")


def _lowest_cut(words: int) -> Column:
    """The score, size and parts of the cut with the lowest score (ties: the shortest first part)."""
    exact = lambda c: c.cast("decimal(19,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("fronts")[k - 1], F.col("backs")[words - k - 1]
        score = F.call_function("div", exact(F.col("f")) * exact(F.col("f")) * F.lit(1_000_000).cast("decimal(7,0)"), exact(left) * exact(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, max_words: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words of each language of ``docs`` (lang, text).

    One row per phrase: lang, rank, phrase, a, l, r, n, score. ``a`` counts the phrase in all pieces, overlaps included,
    and is ``least`` or more; l and r count both parts at its lowest-scoring cut; score is floor(1000000 a a / (l r)), exactly; n is all words
    of the language. A phrase inside of a longer candidate that occurs at least ``inside_percent`` times in a hundred as
    often is left out. Ranks go by score, a (both falling), phrase (UTF-8). Words are in small letters (A-Z only).

    A null lang is ``und``; null and empty texts have no words; repeated rows count each; an empty table gives no rows;
    other columns are ignored. A text longer than a block is cut at ends of pieces only; more than 2^26 different words or
    pairs in one block raise. A language without a candidate has no rows.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    blocks = materialize(rows.mapInPandas(partial(_blocks, block_chars=block_chars), _BLOCKS), "colloc_blocks", FILE_BLOCKS)
    entries = _entries(blocks, "words").where("no > 0")  # number 0 ends pieces
    totals = materialize(entries.groupBy("lang").agg(F.sum("count").alias("n")), "colloc_totals")
    named = materialize(_named(entries, "lang", "word", least=least), "colloc_named")
    own = F.col("id") == F.col("place")
    words = named.where(own).select("id", "lang", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("fronts"), F.array("f").alias("backs"))
    levels = [materialize(words, "colloc_grams")]
    for k in range(2, max_words + 1):
        pairs = blocks.select("block", "codes").groupBy("block").cogroup(named.select("block", "no", "id").groupBy("block")).applyInPandas(_paired, _PAIRS)
        pairs = materialize(pairs, "colloc_pairs", FILE_BLOCKS)
        discard(blocks, named)
        blocks, entries = pairs, _entries(pairs, "lefts", "rights")
        if k < max_words:
            named = materialize(_named(entries, "left", "right", least=least), "colloc_named")
            found = named.where(own).select("id", "left", "right", "f")
        else:
            sums = entries.groupBy("left", "right").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
            found = sums.select(F.monotonically_increasing_id().alias("id"), "left", "right", "f")
        below = levels[-1]
        fronts = below.select(F.col("id").alias("left"), "lang", "phrase", "fronts")
        backs = below.select(F.col("id").alias("right"), "last", "backs")
        joined = found.join(fronts, "left").join(backs, "right")
        grams = joined.select("id", "lang", "f", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("fronts", F.array("f")).alias("fronts"), F.concat("backs", F.array("f")).alias("backs"), "left", "right")
        levels.append(materialize(grams, "colloc_grams"))
    discard(blocks)
    out = []
    for k, grams in enumerate(levels[1:], 2):
        if k < max_words:
            around = levels[k].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
            grams = grams.join(around, "id", "left").where(F.coalesce(100 * F.col("around") < inside_percent * F.col("f"), F.lit(True)))
        out.append(grams.withColumn("cut", _lowest_cut(k)).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
