"""Chat formatting in prefix trees (operator 7).

Each turn is formatted as ``<turn:ROLE>TEXT</turn>`` and a line feed; ``\\`` and ``<`` in texts (and ``>`` in roles) are
escaped by ``\\``, so no text can forge a control string and all texts can be read back. Positions count code points of
the formatted text; each turn is formatted on its own, so a tokenizer may be applied to each node.

1. *Paths*: a conversation is the path of its turns' prefix digests. Equal conversations share a leaf.
2. *Segments*: paths (digests, without texts) are sorted once over ranges; ``most`` neighbours in that order are a
   segment. Neighbours share what the first difference of their paths leaves, so what a leaf shares with other segments
   is the longest prefix that it has in common with the leaf before its segment or the one behind it. Nodes in that
   prefix are *trunk* nodes with a segment of their own each.
3. *Depth-first emission*: segments go to a task together; within a segment, leaves are sorted by path; each emits the nodes that it does not share with
   the one before. Every node, and so every shared turn, is emitted once in the whole output.
4. Each node has its place (segment, start, end), the position id of its first symbol (the length of its ancestors), the
   places of its ancestors as merged attention intervals, and the part of it that is under the loss mask (an
   assistant's text).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.storage import discard, materialize

TURN = re.compile(r"<turn:((?:\\.|[^\\>])*+)>((?:\\.|[^\\<])*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, also: str = "") -> str:
    for c in "\\<" + also:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn and the part of it under the loss mask (empty unless an assistant speaks)."""
    head = f"<turn:{escape(role or '', '>')}>"
    body = escape(text or "")
    return f"{head}{body}</turn>\n", len(head), len(head) + (len(body) if role == "assistant" else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    at, turns = 0, []
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(turn[1]), unescape(turn[2])))
        at = turn.end()
    return turns


def _paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, turns in zip(frame["conv_id"], frame["turns"], strict=True):
            path, texts, low, high, key = [], [], [], [], ""
            for turn in turns:
                text, a, b = format_turn(turn["role"], turn["text"])
                key = xxhash.xxh3_128_hexdigest(key + text)
                path.append(key)
                texts.append(text)
                low.append(a)
                high.append(b)
            rows.append((conv, key, path, texts, low, high))
        yield pd.DataFrame(rows, columns=["conv_id", "leaf", "path", "texts", "low", "high"])


_PLACE = "array<struct<segment:string,start:long,stop:long>>"
_NODES = f"node string, parent string, segment string, start long, stop long, depth int, position long, text string, mask_start int, mask_stop int, ancestors {_PLACE}"


def _joined(places: list[tuple], place: tuple) -> list[tuple]:
    """Attention intervals with one more; touching ones become one."""
    if places and places[-1][0] == place[0] and places[-1][2] == place[1]:
        return [*places[:-1], (place[0], places[-1][1], place[2])]
    return [*places, place]


def _emit(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes of some whole segments, depth-first. Trunk nodes (above a leaf's ``cut``) are emitted for their own segments
    by every segment that needs them; equal rows are dropped afterwards."""
    rows, now, at, before, state = [], None, 0, [], []
    leaves = zip(frame["segment"], map(list, frame["path"]), frame["cut"], frame["texts"], frame["low"], frame["high"], strict=True)
    for segment, path, cut, texts, low, high in sorted(leaves, key=lambda leaf: leaf[:2]):
        if segment != now:
            now, at, before, state = segment, 0, [], []
        shared = 0
        while shared < min(len(path), len(before)) and path[shared] == before[shared]:
            shared += 1
        del state[shared:]
        for d in range(shared, len(path)):
            position, places = (state[-1][0], state[-1][1]) if state else (0, [])
            size = len(texts[d])
            if d < cut:
                place = (path[d], 0, size)
            else:
                place, at = (segment, at, at + size), at + size
            own = [{"segment": s, "start": a, "stop": b} for s, a, b in places]
            rows.append((path[d], path[d - 1] if d else None, *place, d, position, texts[d], low[d], high[d], own))
            state.append((position + size, _joined(places, place)))
        before = path
    return pd.DataFrame(rows, columns=["node", "parent", "segment", "start", "stop", "depth", "position", "text", "mask_start", "mask_stop", "ancestors"])


def _bucket(segment: str, rows: DataFrame, size: int) -> Column:
    """Deals segments into buckets of about ``size`` rows of the written table ``rows``: a task calls Python once for
    many small segments."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.pmod(F.xxhash64(segment), F.lit(max(parts, -(-rows.count() // size))))


def _segments(paths: DataFrame, most: int) -> DataFrame:
    """(leaf, segment, cut) of the different leaves of ``paths`` (leaf, path, ...), a written table: segments of at most
    ``most`` neighbours in the order of paths, and the number of a leaf's first nodes that other segments have too.

    An element of a path stands for all turns up to it, so two paths share as many first elements as elements. A range of
    the order is sorted by one task; all its paths differ, so a common first turn makes no range larger. Of each range,
    its first and last path meet those of its neighbours: two rows a range."""
    ranges = materialize(paths.select("leaf", "path").dropDuplicates(["leaf"]).repartitionByRange("path").withColumn("range", F.spark_partition_id()), "chat_order")
    in_order = Window.orderBy("range")
    ends = ranges.groupBy("range").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    ends = ends.select("range", F.lag("high").over(in_order).alias("ahead"), F.lead("low").over(in_order).alias("behind"))
    in_range = Window.partitionBy("range").orderBy("path")
    shared = lambda other: F.coalesce(F.size(F.array_intersect("path", other)), F.lit(0))
    rows = ranges.withColumns({"before": F.lag("path").over(in_range), "after": F.lead("path").over(in_range), "place": F.floor((F.row_number().over(in_range) - 1) / most)})
    rows = rows.join(ends, "range").select(
        "leaf", "range", "place", "path", shared(F.coalesce("before", "ahead")).alias("with_before"), shared(F.coalesce("after", "behind")).alias("with_after")
    )
    # with the leaf before the segment a leaf shares the least that neighbours between share; so it is behind
    part = Window.partitionBy("range", "place").orderBy("path")
    above = F.min("with_before").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.min("with_after").over(part.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    segment = F.concat_ws(".", F.lit("s"), "range", "place")
    out = materialize(rows.select("leaf", segment.alias("segment"), F.greatest(above, below).alias("cut")), "chat_segments")
    discard(ranges)
    return out


def prefix_trees(turns: DataFrame, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of ``turns`` (conv_id, turn, role, text), both written tables.

    nodes: node, parent, segment, start, stop, depth, position, text (formatted), mask_start, mask_stop (in the node),
    ancestors (intervals). conversations: conv_id, n_turns, leaf (its last node).

    Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have a defined order. A null
    role or text is empty. Rows with a null conv_id are one conversation. An empty table gives no rows; other columns
    are ignored.
    """
    spoken = turns.select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = "conv_id string, leaf string, path array<string>, texts array<string>, low array<int>, high array<int>"
    paths = materialize(spoken.select(F.col("conv_id").cast("string"), "turns").mapInPandas(_paths, kind), "chat_paths")
    leaves = paths.groupBy("leaf").agg(*(F.first(c).alias(c) for c in ("path", "texts", "low", "high")))
    segments = _segments(paths, most)
    dealt = leaves.join(segments.withColumn("bucket", _bucket("segment", segments, 1024)), "leaf")
    emitted = dealt.groupBy("bucket").applyInPandas(_emit, _NODES)
    nodes = materialize(emitted.dropDuplicates(["node"]), "chat_nodes")
    discard(segments)
    return nodes, paths.select(F.col("conv_id").cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.size("path").cast("long").alias("n_turns"), "leaf")


def _slices(requests: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Texts of intervals of some whole segments, with the loss masks in them."""
    streams: dict[str, tuple[list, list, list]] = {}  # segment -> texts in order, begins and ends of its masks
    for segment, start, text, a, b in sorted(zip(nodes["segment"], nodes["start"], nodes["text"], nodes["mask_start"], nodes["mask_stop"], strict=True)):
        texts, begins, ends = streams.setdefault(segment, ([], [], []))
        texts.append(text)
        if a < b:
            begins.append(start + a)
            ends.append(start + b)
    whole = {segment: ("".join(texts), begins, ends) for segment, (texts, begins, ends) in streams.items()}
    rows = []
    for leaf, order, segment, start, stop in zip(requests["leaf"], requests["k"], requests["at"], requests["a"], requests["b"], strict=True):
        stream, begins, ends = whole[segment]
        first, last = bisect_left(begins, start), bisect_right(ends, stop)
        rows.append((leaf, order, stream[start:stop], [{"a": begins[m] - start, "b": ends[m] - start} for m in range(first, last)]))
    return pd.DataFrame(rows, columns=["leaf", "k", "text", "masks"])


_PIECE = "leaf string, k int, text string, masks array<struct<a:long,b:long>>"


def _read(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, pieces: texts and loss masks of the places ``wanted`` (leaf, k, at, a, b), in order."""
    trunk = nodes.where("segment = node")
    mask = F.when(F.col("mask_stop") > F.col("mask_start"), F.array(F.struct(F.col("mask_start").cast("long").alias("a"), F.col("mask_stop").cast("long").alias("b"))))
    none = F.expr("cast(array() as array<struct<a:long,b:long>>)")
    # a trunk node is taken whole: a plain join, whose hot keys can be split
    of_trunk = wanted.join(trunk.select(F.col("segment").alias("at"), "text", F.coalesce(mask, none).alias("masks")), "at").select("leaf", "k", "text", "masks")
    rest = nodes.where("segment <> node").select("segment", "start", "text", "mask_start", "mask_stop")
    asked = wanted.join(trunk.select(F.col("segment").alias("at")), "at", "left_anti").withColumn("bucket", _bucket("at", nodes, 4096))
    in_segments = asked.groupBy("bucket").cogroup(rest.withColumn("bucket", _bucket("segment", nodes, 4096)).groupBy("bucket")).applyInPandas(_slices, _PIECE)
    return of_trunk.unionByName(in_segments).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("k", "text", "masks"))).alias("pieces"))


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for leaf, pieces in zip(frame["leaf"], frame["pieces"], strict=True):
            text = "".join(p["text"] for p in pieces)
            turns = parse(text)
            under = "".join(unescape(p["text"][m["a"] : m["b"]]) for p in pieces for m in p["masks"])
            spoken = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((leaf, len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the nodes: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Conversations with a common leaf are read once."""
    leaves = conversations.select("leaf").distinct()
    asked = nodes.join(leaves.withColumnRenamed("leaf", "node"), "node", "left_semi")
    own = F.array(F.struct("segment", "start", "stop"))
    wanted = asked.select(F.col("node").alias("leaf"), F.posexplode(F.concat("ancestors", own)).alias("k", "p"))
    wanted = wanted.select("leaf", "k", F.col("p.segment").alias("at"), F.col("p.start").alias("a"), F.col("p.stop").alias("b"))
    read = _read(nodes, wanted).mapInPandas(_digest, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return conversations.select("conv_id", "leaf").join(read, "leaf").drop("leaf")
