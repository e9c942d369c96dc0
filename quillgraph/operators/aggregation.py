"""Aggregation of vertices by voting rounds.

Each round is a set operation on a snapshot: every vertex looks at its strongest neighbour (*vote*), undecided vertices
give their weight to that neighbour's root (*tally*), and vertices become seeds or join one (*mark*). States: U
undecided, S seed, D decided, R root of a closed aggregate, N decided but open to be joined (neighbours of neighbours). Ties go to the larger neighbour id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators import dealt, linalg
from quillgraph.operators.graph import conductance_ratio
from quillgraph.storage import discard, materialize, measured

#: Members of one root that are ranked in one task.
PART_MEMBERS = 1 << 16


def initial(ids: DataFrame) -> DataFrame:
    """(i, ind, state, votes)"""
    return ids.select("i", F.col("i").alias("ind"), F.lit("U").alias("state"), F.lit(0.0).alias("votes"))


def vote(strength: DataFrame, states: DataFrame, threshold: float) -> DataFrame:
    """(i, prio, weight, j, ind): the best neighbour: open seeds above the threshold, then undecided ones, then others;
    within those the strongest."""
    met = dealt.meet(strength, states.select("i", "ind", "state").hint("merge"))
    prio = F.when(F.col("state").isin("S", "N") & (F.col("v") > threshold), 2).when(F.col("state") == "U", 1).otherwise(0)
    best = met.groupBy("i").agg(F.max(F.struct(prio.alias("prio"), F.col("v").alias("weight"), "j", "ind")).alias("b"))
    return best.select("i", "b.*")


def _voting_for(votes: DataFrame, threshold: float) -> DataFrame:
    """(i, target, weight) of the ``votes`` of undecided vertices."""
    return votes.where((F.col("weight") >= threshold) & (F.col("ind") != F.col("i"))).select("i", F.col("ind").alias("target"), "weight")


def _given(voting_for: DataFrame) -> DataFrame:
    return voting_for.groupBy(F.col("target").alias("i")).agg(F.sum("weight").alias("given"))


def _total() -> Column:
    """What a vertex has got, with what it gets in this round."""
    return F.col("votes") + F.coalesce("given", F.lit(0.0))


def tally(states: DataFrame, votes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(voting_for (i, target, weight), totals (i, votes)): totals add to those of earlier rounds."""
    voting_for = _voting_for(states.where("state = 'U'").select("i").join(votes, "i"), threshold)
    return voting_for, states.select("i", "votes").join(_given(voting_for), "i", "left").select("i", _total().alias("votes"))


def _mutual(voting_for: DataFrame) -> DataFrame:
    """(i, partner): vertices that vote for each other."""
    back = voting_for.select(F.col("i").alias("target"), F.col("target").alias("i"))
    return voting_for.select("i", "target").join(back.hint("merge"), ["i", "target"]).withColumnRenamed("target", "partner")


def mark(all_: DataFrame, votes_to_seed: float = 1.0, max_size: int = -1, spread: bool = False) -> DataFrame:
    """The states after a round: of vertices (i, ind, state, votes, sum: the weight of all their edges) beside what they
    voted for (prio, seen) and their partner, if any: of two that pair up the smaller id is the seed."""
    s, i, partner = F.col("state"), F.col("i"), F.col("partner")
    joins, seeds = F.col("prio") == 2, F.col("votes") >= F.lit(votes_to_seed) * F.col("sum")
    ind = F.when(s != "U", F.col("ind")).when(partner.isNotNull(), F.least(i, partner)).when(joins, F.col("seen")).when(seeds, i).otherwise(F.col("ind"))
    closed = F.when(F.col("votes") > max_size, "R").otherwise("S")
    state = F.when(s.isin("D", "R", "N"), s).when(s == "S", closed).when(partner.isNotNull(), F.when(i < partner, "S").otherwise("D")).when(joins, "N" if spread else "D").when(seeds, "S").otherwise(s)
    return all_.select("i", ind.alias("ind"), state.alias("state"), "votes", "sum")


def one_round(states: DataFrame, votes: DataFrame, threshold: float, first: bool, votes_to_seed: float = 1.0, max_size: int = -1, spread: bool = False) -> DataFrame:
    """``states`` (i, ind, state, votes, sum) after a round, from a written table of the ``votes`` of undecided vertices. Only
    in the first round do vertices pair up. All joins are merges: what is small enough for a broadcast in a late round is
    still millions of rows on a large graph, and a round has several of them, all built by the driver."""
    voting_for = _voting_for(votes, threshold)
    all_ = states.join(_given(voting_for).hint("merge"), "i", "left").withColumn("votes", _total()).drop("given")
    all_ = all_.join(votes.select("i", "prio", F.col("ind").alias("seen")).hint("merge"), "i", "left")
    all_ = all_.join(_mutual(voting_for).hint("merge"), "i", "left") if first else all_.withColumn("partner", F.lit(None).cast("long"))
    return mark(all_, votes_to_seed, max_size, spread)


def reject_large(states: DataFrame, strength: DataFrame, max_size: int) -> DataFrame:
    """Close the roots with more than ``max_size`` members besides them; of those, the ones tied to the root most
    strongly stay (ties: smaller id), the others are undecided again."""
    sizes = states.where("ind <> i").groupBy("ind").agg(F.count("*").alias("size")).where(F.col("size") > max_size)
    tie = strength.select("i", F.col("j").alias("ind"), F.col("v").alias("tie"))
    members = states.where("ind <> i").select("i", "ind").join(sizes.hint("merge"), "ind").join(tie.hint("merge"), ["i", "ind"], "left")
    # a root may have most vertices: the best are found among the best of each part of its members
    order = F.desc(F.coalesce("tie", F.lit(0.0))), F.col("i")
    parts = Window.partitionBy("ind", F.pmod(F.xxhash64("i"), F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(PART_MEMBERS))))).orderBy(*order)
    best = members.withColumn("place", F.row_number().over(parts)).where(F.col("place") <= max_size)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("ind").orderBy(*order))).where(F.col("place") <= max_size)
    surplus = members.select("i").join(best.select("i").hint("merge"), "i", "left_anti").select("i", F.lit(True).alias("goes"))
    closing = sizes.select(F.col("ind").alias("i"), F.lit(True).alias("closes"))
    all_ = states.join(surplus.hint("merge"), "i", "left").join(closing.hint("merge"), "i", "left")
    ind = F.when(F.col("goes"), F.col("i")).otherwise(F.col("ind"))
    state = F.when(F.col("goes"), "U").when(F.col("closes"), "R").otherwise(F.col("state"))
    return all_.withColumns({"ind": ind, "state": state}).select(states.columns)


def reject_loose(states: DataFrame, adj: DataFrame, ratio: float, to_seed: bool = False) -> DataFrame:
    """Decided vertices with more than ``ratio`` times as much edge weight outside of their aggregate as inside leave."""
    loose = conductance_ratio(adj, states.select("i", F.col("ind").alias("agg"))).where(F.col("ratio") > ratio).select("i", F.lit(True).alias("loose"))
    leaves = F.col("state").isin("D", "N") & F.coalesce("loose", F.lit(False))
    all_ = states.join(loose.hint("merge"), "i", "left")
    ind, state = F.when(leaves, F.col("i")).otherwise(F.col("ind")), F.when(leaves, "S" if to_seed else "U").otherwise(F.col("state"))
    return all_.withColumns({"ind": ind, "state": state}).select(states.columns)


def aggregate(strength: DataFrame, ids: DataFrame, rounds: int = 10, init_factor: float = 0.5, iter_factor: float = 0.5, votes_to_seed: float = 1.0,
              max_size: int = -1, adj: DataFrame | None = None, rejection_ratio: float = -1.0, rejection_to_seed: bool = False, spread: bool = False,
              start: DataFrame | None = None, trace: dict[str, DataFrame] | None = None) -> DataFrame:
    """States after all rounds, a written table; rounds that could change nothing are left out. ``strength`` must be cheap
    to read again (written). ``spread``: those who join a seed may be joined in turn. ``start``: states to go on from.
    ``trace``: gets each round's ``agg_state_<k>`` and ``voting_for_<k>``, which then stay."""
    sums = linalg.reduce_columns(strength).withColumnRenamed("v", "sum")
    rejects = max_size > 0 or (adj is not None and rejection_ratio >= 0)
    count = {"open": F.count(F.when(F.col("state").isin("U", "S"), 1)), "undecided": F.count(F.when(F.col("state") == "U", 1))}
    states, s = measured((initial(ids) if start is None else start).join(sums.hint("merge"), "i", "left"), "states", **count)
    live, of = strength, s["undecided"]  # the rows that may still vote, and how many vertices were undecided when they were written
    for k in range(rounds):
        threshold = init_factor * iter_factor**k
        undecided = states.where("state = 'U'").select("i").hint("merge")
        if not rejects and s["undecided"] < of / 2:  # nobody is undecided again
            before, live, of = live, _same_hubs(materialize(live.select("i", "j", "v").join(undecided, "i", "left_semi"), "live"), strength), s["undecided"]
            if before is not strength:
                discard(before)
        votes = materialize(vote(live, states, threshold).join(undecided, "i", "left_semi"), "votes")
        if trace is not None:
            trace[f"agg_state_{k}"], trace[f"voting_for_{k}"] = _plain(states), materialize(_voting_for(votes, threshold), "voting_for")
        after = one_round(states, votes, threshold, k == 0 and start is None, votes_to_seed, max_size, spread)
        if max_size > 0:
            after = reject_large(after, strength, max_size)
        if adj is not None and rejection_ratio >= 0 and k >= rounds / 2:
            after = reject_loose(after, adj, rejection_ratio, rejection_to_seed)
        before = states
        states, s = measured(after, "states", **count)
        discard(votes)
        if trace is None:
            discard(before)
        if not s["open"] and max_size <= 0 and rejection_ratio < 0:
            break  # nobody is undecided and every seed is closed
    if live is not strength:
        discard(live)
    return _plain(states)


def _plain(states: DataFrame) -> DataFrame:
    out = states.select("i", "ind", "state", "votes")
    out._quill_path = states._quill_path
    return out


def _same_hubs(live: DataFrame, strength: DataFrame) -> DataFrame:
    live._quill_hubs = getattr(strength, "_quill_hubs", None)
    return live


def restriction(states: DataFrame) -> DataFrame:
    """(i, agg): every vertex has one aggregate, and the ids of aggregates are ids of vertices. A vertex whose root has
    moved on to another aggregate follows it once."""
    roots = states.select(F.col("i").alias("ind"), F.col("ind").alias("root"))
    return states.select("i", "ind").join(roots.hint("merge"), "ind", "left").select("i", F.coalesce("root", "ind").alias("agg"))


def contiguous(assign: DataFrame) -> DataFrame:
    """(i, agg) with aggregates numbered from 0 in order of their ids."""
    order = linalg.renumber(assign.select(F.col("agg").alias("i")))
    return assign.join(order.select(F.col("i").alias("agg"), "new"), "agg").select("i", F.col("new").alias("agg"))
