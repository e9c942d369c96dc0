"""Token counts without identifiers (operator 9).

A text's pieces under a merge-based vocabulary are counted by the heap-and-linked-list form of byte-pair merging: the
adjacent pair of lowest rank is popped again and again, and the count is the number of initial symbols less the number
of merges. No identifier is ever made.

Texts are cut where no piece of the vocabulary can reach across: before a run of the space mark and at line feeds. The
parts merge independently of each other, so the counts of short parts are remembered in each Python worker (at most
``CACHED`` of them, so memory is bounded); the work on a text is then close to one dictionary lookup a word.

The whole operator is one Arrow-batched scan: no shuffle, no broadcast, nothing to skew. A lost executor costs its
unfinished scan tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHED = 1 << 20
LONGEST_CACHED = 48


def load_ranks(model_path: str) -> tuple[dict[str, int], bool]:
    """Mergeable pieces of a sentencepiece BPE model with their ranks (0 merges first), and whether a space mark is
    put before each text. Only what the counting relies on is accepted: BPE, identity normalisation, byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
        raise ValueError("a BPE model with byte fallback is needed")
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError("a model that leaves texts as they are is needed")
    pieces = sorted(((-p.score, p.piece) for p in model.pieces if p.type == 1))
    ranks = {piece: rank for rank, (_, piece) in enumerate(pieces)}
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece in ranks):
        raise ValueError("pieces that reach across words are not supported")
    return ranks, spec.add_dummy_prefix


class PartCounts(dict):
    """part of a text -> number of its tokens, computed when first asked for."""

    def __init__(self, ranks: dict[str, int]) -> None:
        super().__init__()
        self.ranks = ranks

    def __missing__(self, part: str) -> int:
        count = self.count(part)
        if len(part) <= LONGEST_CACHED:
            if len(self) >= CACHED:
                self.clear()
            self[part] = count
        return count

    def count(self, part: str) -> int:
        ranks = self.ranks
        symbols: list[str] = list(part)
        size = len(symbols)
        # a character that is no piece falls back to its bytes
        initial = sum(1 if c in ranks else len(c.encode()) for c in symbols)
        rank_of = ranks.get
        heap = []
        for i in range(size - 1):
            pair = part[i : i + 2]
            rank = rank_of(pair)
            if rank is not None:
                heap.append((rank, i, i + 1, 2))
        if not heap:
            return initial
        heapify(heap)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        merges = 0
        while heap:
            _, left, right, length = heappop(heap)
            joined, other = symbols[left], symbols[right]
            if not joined or not other or len(joined) + len(other) != length:
                continue  # one side has merged meanwhile
            joined += other
            symbols[left], symbols[right] = joined, ""
            merges += 1
            beyond = after[left] = after[right]
            if beyond >= 0:
                before[beyond] = left
                rank = rank_of(joined + symbols[beyond])
                if rank is not None:
                    heappush(heap, (rank, left, beyond, length + len(symbols[beyond])))
            ahead = before[left]
            if ahead >= 0:
                rank = rank_of(symbols[ahead] + joined)
                if rank is not None:
                    heappush(heap, (rank, ahead, left, len(symbols[ahead]) + length))
        return initial - merges


_PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_loaded: dict[str, tuple[PartCounts, bool]] = {}


def count_text(text: str | None, model_path: str) -> int:
    """Tokens of one text (null: empty) under the model at ``model_path``."""
    if model_path not in _loaded:
        ranks, prefix = load_ranks(model_path)
        _loaded[model_path] = PartCounts(ranks), prefix
    counts, prefix = _loaded[model_path]
    if not text:
        return 0
    return sum(map(counts.__getitem__, _PARTS.findall((SPACE if prefix else "") + text.replace(" ", SPACE))))


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > limit``).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted row by row; an empty table gives an empty
    result. Columns of ``docs`` that are named like the three new ones are replaced; all others are kept. A text of
    any length is counted whole, in time proportional to n log n of its longest part without spaces.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_text(x, model_path) for x in texts], dtype="int64")

    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(F.col(text_col)).cast("long"), F.lit(0).cast("long")),
            "n_tokens": counted(F.col(text_col)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
