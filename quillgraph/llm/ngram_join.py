"""N-gram Jaccard join as a blocked sparse matrix product (operator 1).

Documents are rows of an incidence matrix over word n-grams; two link when their sets' Jaccard similarity reaches a
threshold. Sets, not rows, are compared: documents with equal sets are one class, under a 64-bit digest of the set.

All n-grams have one global order: by hash, but those that very many documents share come last. Two sets that reach the
threshold must share a gram among the first ``n - ceil(t n) + 1`` of each (their *heads*), so:

1. *Count*: heads by hash alone are counted, in blocks of grams; the grams most shared are put last from now on.
2. *Product over heads*: blocks of (gram, class) entries of the new heads. A block accumulates overlap counts of the
   pairs within its lists; counts are summed over blocks, and pairs below the bound that follows from the two sizes are
   discarded. The lists of more than ``long_list`` classes (families of near copies) give no pairs; they only tie their
   members together.
3. *Families*: what surviving pairs and long lists tie together, by connected components.
4. *Product over whole sets*: the sets of each family's classes, in blocks of about ``block`` classes. Each block pair
   accumulates its overlap counts over all grams (a dense product of two small matrices) and gives a spanning forest of
   its links. Families of many blocks are cut by size first: classes can only link within a range of sizes and with the
   next one. There, the links within blocks and with the first block of a range come first; after that, only classes
   outside of the family's largest component are compared with the others.

So every pair that can reach the threshold is either compared exactly, or known to be in one component already. No step
gathers a gram's documents in one place: lists are cut where they are made (a task sends at most ``long_list + 1``
entries of a gram to its block), and families are cut in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.components import star_components
from quillgraph.storage import discard, materialize

U = np.uint64
_random = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U(int(_random.integers(1, 2**62)) * 8 + 5)
_UNBASE = U(pow(int(_BASE), -1, 2**64))
_STEP = _random.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
#: Bytes of text that are hashed at a time; a longer text is hashed on its own. A worker holds about 60 bytes for each, and
#: keeps 16 of them while it waits for other work.
CHUNK = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[str, np.ndarray] = {}


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < size:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(max(size, CHUNK), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:size], _powers["down"][:size]


def _hashed(raw: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; ``ends`` are the texts' ends in ``raw``."""
    begins = np.concatenate(([0], ends[:-1]))
    size = len(raw)
    up, down = _power(size + 1)
    inside = ~_SPACE[raw]
    edge = np.zeros(size + 1, dtype=bool)
    edge[begins[begins < size]] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:size]
    last[:-1] &= ~inside[1:] | edge[1:size]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * up[:size])))
    words = _mixed((sums[stops] - sums[starts]) * down[starts])
    of = np.searchsorted(starts, np.concatenate((begins, ends[-1:])))
    width = max(0, len(words) - n + 1)
    grams = np.zeros(width, dtype=np.uint64)
    for k in range(n):
        grams += words[k : k + width] * _STEP[k]
    grams = _mixed(grams)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:  # fewer words: the whole sequence is the one gram
            yield _mixed((words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + U(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def gram_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The set of each text (null: empty) as sorted hashes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        yield from _hashed(raw[offsets[at] : offsets[to]], offsets[at + 1 : to + 1] - offsets[at], n)
        at = to


def digest(grams: np.ndarray) -> int:
    """64-bit digest of a set, as Spark's signed long."""
    value = xxhash.xxh3_64_intdigest(grams.tobytes())
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Rule:
    """n-grams of ``n`` words; a link from ``percent`` on of Jaccard similarity."""

    n: int = 5
    percent: int = 80

    def head(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def sizes_fit(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def linked(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame(columns)


def _cut(keys: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of ``keys`` by block (their low bits)."""
    if not len(keys):
        return
    block = (keys & U(blocks - 1)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    found, begins = np.unique(block[order], return_index=True)
    for b, own in zip(found.tolist(), np.split(order, begins[1:]), strict=True):
        yield b, own


def _named(grams: np.ndarray, blocks: int) -> np.ndarray:
    """A gram's name: its high 32 bits and its block. Grams with equal names only make candidates, never links."""
    return grams & U(0xFFFFFFFF00000000 | (blocks - 1))


# ---- 1. count

_COUNTED = "block long, names binary, counts binary, doc_id long, n long, dg long"


def _count_rows(batches: Iterator[pa.RecordBatch], rule: Rule, blocks: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("dg", pa.int64())])
    for batch in batches:
        heads, sizes, digests = [np.zeros(0, dtype=np.uint64)], [], []
        for s in gram_sets(batch.column(1), rule.n):
            sizes.append(len(s))
            digests.append(digest(s) if len(s) else None)
            heads.append(s[: rule.head(len(s))] if len(s) else s)
        names, counts = np.unique(_named(np.concatenate(heads), blocks), return_counts=True)
        rows = [(b, (names[own] >> U(32)).astype("<u4").tobytes(), np.minimum(counts[own], 2**32 - 1).astype("<u4").tobytes()) for b, own in _cut(names, blocks)]
        k, m = len(rows), len(sizes)
        yield pa.record_batch(
            [
                pa.array([r[0] for r in rows] + [at % blocks for at in range(m)], pa.int64()),
                pa.array([r[1] for r in rows] + [None] * m, pa.binary()),
                pa.array([r[2] for r in rows] + [None] * m, pa.binary()),
                pa.array([None] * k + batch.column(0).to_pylist(), pa.int64()),
                pa.array([None] * k + sizes, pa.int64()),
                pa.array([None] * k + digests, pa.int64()),
            ],
            schema=schema,
        )


_COUNTS = "name long, found long, doc_id long, n long, dg long"


def _count_block(key: tuple, table: pa.Table, above: int) -> pa.Table:
    entries = table.filter(pc.is_valid(table["names"]))
    docs = table.filter(pc.is_null(table["names"])).select(["doc_id", "n", "dg"])
    numbers = lambda column: np.frombuffer(b"".join(entries[column].to_pylist()), dtype="<u4")
    distinct, place = np.unique(numbers("names"), return_inverse=True)
    totals = np.bincount(place, weights=numbers("counts"), minlength=len(distinct))
    hot = totals > above
    full = (distinct[hot].astype(np.uint64) << U(32)) | U(key[0].as_py())
    grams = pa.table({"name": pa.array(full.view(np.int64)), "found": pa.array(totals[hot].astype(np.int64))})
    return pa.concat_tables([grams, docs], promote_options="default").select(["name", "found", "doc_id", "n", "dg"])


# ---- 2. product over heads


class _Last:
    """Grams that come last in the order: a small table of flags first, the sorted names for the few that pass it."""

    def __init__(self, names: np.ndarray, blocks: int) -> None:
        self.names, self.blocks = np.sort(names), blocks
        self.flags = np.zeros(1 << 22, dtype=bool)
        self.flags[self._slot(self.names)] = True

    @staticmethod
    def _slot(names: np.ndarray) -> np.ndarray:
        return (names >> U(42)).astype(np.int64)

    def has(self, grams: np.ndarray) -> np.ndarray:
        found = self.flags[self._slot(grams)]
        if len(self.names) and (maybe := np.flatnonzero(found)).size:
            names = _named(grams[maybe], self.blocks)
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            found[maybe] = self.names[at] == names
        return found


_ENTRIES = "block long, names binary, digests binary, sizes binary"


def _entry_rows(batches: Iterator[pa.RecordBatch], rule: Rule, blocks: int, last, long_list: int) -> Iterator[pa.RecordBatch]:
    """Entries of the heads by block. Lists that are long within one batch go out as they are, under block -1 - k."""
    schema = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("digests", pa.binary()), ("sizes", pa.binary())])
    order = _Last(last.value, blocks)
    for number, batch in enumerate(batches):
        heads, of, sizes, digests, seen = [np.zeros(0, dtype=np.uint64)], [], [], [], set()
        for s in gram_sets(batch.column(0), rule.n):
            if not len(s) or (d := digest(s)) in seen:
                continue
            seen.add(d)
            late, p = order.has(s), rule.head(len(s))
            head = s[~late][:p]
            if len(head) < p:
                head = np.concatenate((head, s[late][: p - len(head)]))
            heads.append(head)
            of.append(len(head))
            sizes.append(len(s))
            digests.append(d)
        names = _named(np.concatenate(heads), blocks)
        owner = np.repeat(np.arange(len(of)), of)
        digest_of, size_of = np.array(digests, dtype=np.int64), np.array(sizes, dtype=np.uint32)
        by = np.argsort(names, kind="stable")
        names, owner = names[by], owner[by]
        _, begin, count = np.unique(names, return_index=True, return_counts=True)
        nth = np.arange(len(names)) - np.repeat(begin, count)
        in_long = np.repeat(count > long_list, count)
        row = lambda b, own: (b, own)
        send = np.flatnonzero(~in_long | (nth <= long_list))
        parts = [row(b, send[own]) for b, own in _cut(names[send], blocks)]
        if in_long.any():
            parts.append(row(-1 - (int(digest_of[owner[np.argmax(in_long)]]) + number) % blocks, np.flatnonzero(in_long)))
        yield pa.record_batch(
            [
                pa.array([b for b, _ in parts], pa.int64()),
                pa.array([(names[own] if b < 0 else (names[own] >> U(32)).astype("<u4")).tobytes() for b, own in parts], pa.binary()),
                pa.array([digest_of[owner[own]].tobytes() for _, own in parts], pa.binary()),
                pa.array([size_of[owner[own]].tobytes() for _, own in parts], pa.binary()),
            ],
            schema=schema,
        )


#: A pair of classes (a < b) with their sizes and shared head grams, or (c null) a long list's name and a member.
_TIES = "a long, b long, na long, nb long, c long"


def _multiply_block(key: tuple, frame: pd.DataFrame, rule: Rule, long_list: int) -> pd.DataFrame:
    block = int(key[0])
    kind = "<u8" if block < 0 else "<u4"
    names = np.concatenate([np.frombuffer(x, dtype=kind) for x in frame["names"]])
    batch = np.repeat(np.arange(len(frame)), [len(x) // np.dtype(kind).itemsize for x in frame["names"]])
    digests = np.concatenate([np.frombuffer(x, dtype="<i8") for x in frame["digests"]])
    sizes = np.concatenate([np.frombuffer(x, dtype="<u4") for x in frame["sizes"]]).astype(np.int64)
    ints = lambda x: pd.array(np.asarray(x, dtype=np.int64), dtype="Int64")
    if block < 0:
        return _frame(a=ints(names.view(np.int64)), b=ints(digests), na=pd.NA, nb=ints(sizes), c=pd.NA).astype("Int64")
    # a class comes from every batch that has a copy of it, and counts once; grams of one class that share a name are told
    # apart by their number within the batch
    by = np.lexsort((batch, digests, names))
    names, digests, sizes, batch = names[by], digests[by], sizes[by], batch[by]
    if len(names):
        change = np.concatenate(([True], (names[1:] != names[:-1]) | (digests[1:] != digests[:-1]) | (batch[1:] != batch[:-1])))
        number = np.arange(len(names)) - np.maximum.accumulate(np.where(change, np.arange(len(names)), 0))
        by = np.lexsort((number, digests, names))
        names, digests, sizes, number = names[by], digests[by], sizes[by], number[by]
        new = np.concatenate(([True], (names[1:] != names[:-1]) | (digests[1:] != digests[:-1]) | (number[1:] != number[:-1])))
        names, digests, sizes = names[new], digests[new], sizes[new]
    _, begin, count = np.unique(names, return_index=True, return_counts=True)
    found = []
    for length in np.unique(count[(count > 1) & (count <= long_list)]).tolist():
        rows = begin[count == length][:, None] + np.arange(length)
        i, j = np.triu_indices(length, 1)
        left, right = rows[:, i].ravel(), rows[:, j].ravel()
        fits = rule.sizes_fit(sizes[left], sizes[right]) & (digests[left] != digests[right])
        found.append((left[fits], right[fits]))
    left = np.concatenate([np.zeros(0, dtype=np.int64), *(x for x, _ in found)])
    right = np.concatenate([np.zeros(0, dtype=np.int64), *(x for _, x in found)])
    by = np.lexsort((digests[right], digests[left]))
    left, right = left[by], right[by]
    a, b = digests[left], digests[right]
    edge = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, dtype=np.int64)
    c = np.diff(np.concatenate((edge, [len(a)])))
    left, right = left[edge], right[edge]
    pairs = _frame(a=ints(digests[left]), b=ints(digests[right]), na=ints(sizes[left]), nb=ints(sizes[right]), c=ints(c))
    in_long = np.repeat(count > long_list, count)
    full = (names[in_long].astype(np.uint64) << U(32)) | U(block)
    ties = _frame(a=ints(full.view(np.int64)), b=ints(digests[in_long]), na=pd.NA, nb=ints(sizes[in_long]), c=pd.NA)
    return pd.concat([pairs, ties.astype("Int64")])[["a", "b", "na", "nb", "c"]].astype("Int64")


# ---- 4. product over whole sets


def _flags(frames: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    flags = np.zeros(bits, dtype=bool)
    for frame in frames:
        flags[frame["h"].to_numpy(dtype=np.int64)] = True
    yield pd.DataFrame({"flags": [np.packbits(flags).tobytes()]})


def _set_rows(batches: Iterator[pa.RecordBatch], rule: Rule, flags) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose id's flag is up, each once a batch."""
    schema = pa.schema([("dg", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])
    up = np.unpackbits(np.frombuffer(flags.value, dtype=np.uint8)).astype(bool)
    for batch in batches:
        wanted = up[np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)]
        texts = batch.column(1).filter(pa.array(wanted))
        found = {digest(s): s for s in gram_sets(texts, rule.n) if len(s)}
        yield pa.record_batch(
            [pa.array(list(found), pa.int64()), pa.array([len(s) for s in found.values()], pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())],
            schema=schema,
        )


def _overlaps(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Overlap counts of all sets, or of the first ``first`` with the rest, accumulated over slices of the grams."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = count > 1
    renumbered = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = renumbered[column[keep]], owner[keep]
    width, slice_ = int(shared.sum()), max(1, (1 << 22) // len(sets))
    total = np.zeros((first, len(sets) - first) if first else (len(sets), len(sets)), dtype=np.float32)
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    for at in range(0, width, slice_):
        lo, hi = np.searchsorted(column, (at, at + slice_))
        part = np.zeros((len(sets), min(slice_, width - at)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part[:first] @ part[first:].T if first else part @ part.T
    return total.astype(np.int64)


def _forest(links: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left, right, free = [], [], np.ones(len(links), dtype=bool)
    for root in range(len(links)):
        if not free[root]:
            continue
        free[root] = False
        front = np.array([root])
        while front.size:
            reached = links[front][:, free]
            new = np.flatnonzero(free)[reached.any(axis=0)]
            parents = front[reached.argmax(axis=0)[reached.any(axis=0)]]
            left += parents.tolist()
            right += new.tolist()
            free[new] = False
            front = new
    return left, right


def _multiply_sets(frame: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Links of the block pairs in ``frame``, as a spanning forest of each."""
    out = [(np.zeros(0, dtype=np.int64),) * 2]
    for _, own in frame.groupby(["family", "i", "j"], sort=False):
        own = own.sort_values(["side", "dg"]).drop_duplicates(["side", "dg"])
        sets = [np.frombuffer(x, dtype="<u8") for x in own["grams"]]
        size, digests = own["n"].to_numpy(dtype=np.int64), own["dg"].to_numpy(dtype=np.int64)
        first = int((own["side"] == 0).sum()) if own["i"].iloc[0] != own["j"].iloc[0] else 0
        if len(sets) < 2 or (first and first == len(sets)):
            continue
        overlap = _overlaps(sets, first)
        links = np.zeros((len(sets), len(sets)), dtype=bool)
        if first:
            links[:first, first:] = rule.linked(overlap, size[:first, None], size[None, first:])
            links |= links.T
        else:
            links = rule.linked(overlap, size[:, None], size[None, :])
        left, right = _forest(links)
        out.append((digests[left], digests[right]))
    return _frame(src=np.concatenate([x for x, _ in out]), dst=np.concatenate([x for _, x in out]))


def _code(range_: Column, b: Column) -> Column:
    """A block's name: its range of sizes and its number there."""
    return range_.cast("long") * (1 << 32) + b.cast("long")


def _upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _met(i: Column, j: Column, side: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))


def _first_pairs() -> Column:
    """The block pairs of a class: its own block, and the first block of its own range and of the one before."""
    r, b, own = F.col("range"), F.col("b"), _code(F.col("range"), F.col("b"))
    first = b == 0
    with_own = F.when(first, F.transform(F.filter(_upto(F.col("nb")), lambda o: o > 0), lambda o: _met(own, _code(r, o), F.lit(0)))).otherwise(F.array(_met(_code(r, F.lit(0)), own, F.lit(1))))
    with_next = F.transform(_upto(F.when(first, F.col("next")).otherwise(0)), lambda o: _met(own, _code(r + 1, o), F.lit(0)))
    with_last = F.transform(_upto((F.col("last") > 0).cast("int")), lambda o: _met(_code(r - 1, o), own, F.lit(1)))
    return F.concat(F.array(_met(own, own, F.lit(0))), with_own, with_next, with_last)


def _other_pairs() -> Column:
    """The block pairs of a class that have a block of classes outside of the largest component (these come first)."""
    r, b, own = F.col("range"), F.col("b"), _code(F.col("range"), F.col("b"))
    some = lambda outside, inside: _upto(F.when(F.col("outside"), F.col(outside) + F.col(inside)).otherwise(F.col(outside)))
    with_own = F.transform(some("nd", "ne"), lambda o: _met(_code(r, F.least(b, o)), _code(r, F.greatest(b, o)), b > o))
    with_next = F.transform(some("nd_next", "ne_next"), lambda o: _met(own, _code(r + 1, o), F.lit(0)))
    with_last = F.transform(some("nd_last", "ne_last"), lambda o: _met(_code(r - 1, o), own, F.lit(1)))
    return F.concat(with_own, with_next, with_last)


def _with_neighbours(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``cells`` (family, range, ...) with columns of the next and the last range, 0 where there is none."""
    for name, step in (("next", -1), ("last", 1)):
        other = cells.select("family", (F.col("range") + step).alias("range"), *(F.col(c).alias(to.format(name)) for c, to in columns.items()))
        cells = cells.join(other, ["family", "range"], "left")
    return cells.na.fill(0)


def ngram_classes(docs: DataFrame, rule: Rule = Rule(), hot_above: int = 8, most_hot: int = 1 << 20, long_list: int = 64, block: int = 512, block_grams: int = 1 << 20) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text).

    One row per row: doc_id, n_shingles (size of its set of word n-grams), component_id (least doc_id reachable by
    links, itself included). Words are ASCII-lower-cased and cut at ASCII white space; a text with fewer than n words is
    one gram; a null, empty or blank text has no grams and links with nothing. Rows with equal sets are linked,
    whatever their ids, so repeated rows share a component; a null doc_id stays null unless its component has another
    id. An empty table gives no rows; other columns are ignored.

    ``hot_above``, ``most_hot``: grams in more heads than this, at most so many, come last in the order (what is
    broadcast has ``8 * most_hot`` bytes at most). ``long_list``, ``block``, ``block_grams``: see the module; they
    change the work, never the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = 1 << max(4, math.ceil(math.log2(max(parts, rows.count() / 20_000))))
    # 1. count
    counted = rows.mapInArrow(partial(_count_rows, rule=rule, blocks=blocks), _COUNTED)
    counts = materialize(counted.groupBy("block").applyInArrow(lambda key, table: _count_block(key, table, hot_above), _COUNTS), "gram_counts")
    signatures = counts.where("n is not null").select("doc_id", "n", "dg")
    hot = counts.where("name is not null").orderBy(F.desc("found"), "name").limit(most_hot).select("name").toPandas()["name"]
    last = spark.sparkContext.broadcast(hot.to_numpy(dtype=np.int64).view(np.uint64))
    # 2. product over heads
    entries = rows.select("text").mapInArrow(partial(_entry_rows, rule=rule, blocks=blocks, last=last, long_list=long_list), _ENTRIES)
    ties = materialize(entries.groupBy("block").applyInPandas(lambda key, frame: _multiply_block(key, frame, rule, long_list), _TIES), "ties")
    lists = ties.where("c is null").select("a", "b").distinct()
    in_lists = lists.groupBy("b").agg(F.count("*").alias("k"))
    pairs = ties.where("c is not null").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
    p = rule.percent
    rest = lambda n: F.col(n) - (F.col(n) - F.ceil(F.lit(p) * F.col(n) / 100) + 1)  # noqa: E731  grams after the head
    need = F.ceil(F.lit(p) * (F.col("na") + F.col("nb")) / (100 + p))
    # what long lists may add to a pair's count is not counted; it is bounded by the fewer lists of the two
    possible = pairs.join(in_lists.select(F.col("b").alias("a"), F.col("k").alias("ka")), "a", "left").join(in_lists.select("b", F.col("k").alias("kb")), "b", "left")
    more = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    possible = possible.where(F.col("c") + more + F.greatest(rest("na"), rest("nb")) >= need)
    # 3. families
    stars = star_components(possible.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(lists.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    families = stars.withColumnsRenamed({"node": "dg", "label": "family"})
    classes = signatures.where("n > 0").groupBy("dg").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"))
    members = materialize(classes.join(families, "dg"), "families")
    discard(ties, stars)
    labels = _linked_classes(rows, members, rule, block, block_grams)
    discard(members)
    # components of classes, then of documents
    rooted = classes.join(labels, classes["dg"] == labels["node"], "left").select("dg", "first_id", F.coalesce("label", "dg").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    component = rooted.join(least, "root").select("dg", "component")
    out = signatures.join(component, "dg", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _linked_classes(rows: DataFrame, members: DataFrame, rule: Rule, block: int, block_grams: int) -> DataFrame:
    """(node, label): components of the linked classes of all families. ``members``: dg, first_id, n, family."""
    spark = rows.sparkSession
    count, grams = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << min(26, max(16, math.ceil(math.log2(16 * max(count, 1)))))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    flagged = members.select(F.pmod(F.xxhash64(F.col("first_id")), F.lit(bits)).alias("h")).coalesce(4).mapInPandas(partial(_flags, bits=bits), "flags binary").collect()
    both = np.zeros(bits // 8, dtype=np.uint8)
    for row in flagged:  # four tables of flags of at most 8 MB, whatever the data
        both |= np.frombuffer(row["flags"], dtype=np.uint8)
    flags = spark.sparkContext.broadcast(both.tobytes())
    sets = rows.select(slot.alias("h"), "text").mapInArrow(partial(_set_rows, rule=rule, flags=flags), "dg long, n long, grams binary")

    def blocks(classes: Column, weight: Column) -> Column:
        return F.greatest(F.ceil(classes / block), F.ceil(weight / block_grams)).cast("int")

    sized = members.groupBy("family").agg((blocks(F.count("*"), F.sum("n")) > 2).alias("many"))
    # two sizes that fit each other are in the same range or in neighbouring ones; a range is a little wider than need be
    range_ = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / min(rule.percent, 99)) * (1 + 1e-9))).cast("int")
    placed = members.join(sized, "family").select("dg", "family", "n", "many", F.when(F.col("many"), range_).otherwise(0).alias("range"))
    cells = _with_neighbours(placed.groupBy("family", "range").agg(blocks(F.count("*"), F.sum("n")).alias("nb")), {"nb": "{}"})
    placed = placed.drop("n").join(cells, ["family", "range"]).withColumn("b", F.pmod(F.xxhash64("dg"), F.col("nb")).cast("int"))
    held = materialize(sets.join(placed, "dg"), "family_sets")
    # small families go together, so that a task has enough to do; block pairs of large ones are dealt singly
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / 4096), math.ceil(grams / (2 * block_grams)))
    key = F.when(F.col("i") == 0, F.when((F.col("j") == 0) & ~F.col("many"), F.pmod(F.xxhash64("family"), F.lit(packs))))
    key = F.coalesce(key, F.xxhash64("family", "i", "j"))

    def multiply(classes: DataFrame, pairs: Column) -> DataFrame:
        met = classes.select("family", "many", "dg", "n", "grams", F.explode(pairs).alias("p")).select("*", "p.*")
        return met.withColumn("key", key).select("key", "family", "i", "j", "side", "dg", "n", "grams").groupBy("key").applyInPandas(lambda frame: _multiply_sets(frame, rule), "src long, dst long")

    edges = materialize(multiply(held, _first_pairs()), "links")
    labels = star_components(edges)
    large = held.where("many")
    if large.isEmpty():
        discard(held, edges)
        return labels
    # large families: what is not in the largest component yet, with all that its size may fit
    at = large.select("dg", "family", "range").distinct().join(labels, F.col("dg") == labels["node"], "left").select("dg", "family", "range", F.coalesce("label", "dg").alias("label"))
    per = at.groupBy("family", "label").agg(F.count("*").alias("k"))
    top = per.groupBy("family").agg(F.max_by("label", F.struct("k", "label")).alias("top"), (F.sum("k") > F.max("k")).alias("any")).where("any")
    again = at.join(top, "family").withColumn("outside", F.col("label") != F.col("top"))
    number = lambda c: F.ceil(F.count(F.when(c, 1)) / block).cast("int")
    cells = again.groupBy("family", "range").agg(number(F.col("outside")).alias("nd"), number(~F.col("outside")).alias("ne"))
    cells = _with_neighbours(cells, {"nd": "nd_{}", "ne": "ne_{}"})
    h = F.xxhash64("dg")
    again = again.join(cells, ["family", "range"]).withColumn("b", F.when(F.col("outside"), F.pmod(h, F.col("nd"))).otherwise(F.col("nd") + F.pmod(h, F.col("ne"))).cast("int"))
    rest = multiply(large.select("dg", "n", "grams", "many").join(again, "dg"), _other_pairs())
    more = materialize(rest, "links")
    before, labels = labels, star_components(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")).unionByName(more))
    discard(held, edges, more, before)
    return labels
