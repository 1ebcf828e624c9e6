"""Links between bucket mates without all pairs, and connected groups of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over the undirected links ``edges`` (a, b); only linked ids are returned.

    Every round each id points at the least of itself and its neighbours (in the order of a hash, so that no numbering
    makes long descents), takes over what that one points at, and the links between the ids pointed at are what is left:
    a star, however large, is gone after two rounds, and a chain shrinks by a factor. Minima are pre-aggregated before the
    shuffle. Rounds are written to the shared folder.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while left.limit(1).count():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("m")), F.struct(F.col("b").alias("id"), F.col("a").alias("m")))).alias("x")).select("x.*")
        low = ends.withColumn("h", F.xxhash64("m")).groupBy("id").agg(F.min(F.struct("h", "m")).alias("low"))
        own = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("m"))
        to = cut(low.select("id", F.least("low", own)["m"].alias("m")), "steps")
        on = to.select(F.col("id").alias("m"), F.col("m").alias("mm"))
        to = cut(to.join(on, "m").select("id", F.col("mm").alias("m")), "steps")
        steps.append(to)
        a, b = to.select(F.col("id").alias("a"), F.col("m").alias("ma")), to.select(F.col("id").alias("b"), F.col("m").alias("mb"))
        moved = left.join(a, "a").join(b, "b").where("ma <> mb")
        left = cut(moved.select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), "links")
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    # An id is named by its step's name in the later, smaller rounds; ids that are settled are in no later round.
    names = steps[-1].select("id", F.col("m").alias("root"))
    for to in reversed(steps[:-1]):
        names = to.join(names.withColumnRenamed("id", "m"), "m", "left").select("id", F.coalesce("root", "m").alias("root"))
    names = cut(names, "roots")
    return cut(names.join(names.groupBy("root").agg(F.min("id").alias("comp")), "root").select("id", "comp"), "components")


def bucket_mates(members: DataFrame) -> DataFrame:
    """(bucket, id, n): ids that share a bucket with another, with the bucket's size."""
    w = Window.partitionBy("bucket")
    sized = members.select("bucket", "id", F.min("id").over(w).alias("low"), F.max("id").over(w).alias("top"), F.count("*").over(w).alias("n"))
    return sized.where("low <> top").select("bucket", "id", "n")


WAVES = (1, 4, 16, None)  # neighbours that a group is tested with at a time; None: all
WAVES_FROM = 20_000  # open pairs; fewer are tested at once


def linked_groups(mates: DataFrame, verify: Callable[[DataFrame], DataFrame], candidates: Callable[[DataFrame], DataFrame] | None = None, *, rounds: int = 8, spare: int = 2, known: DataFrame | None = None, tried: DataFrame | None = None, signs: DataFrame | None = None, close: str | None = None) -> DataFrame:
    """(id, comp): the groups that verifying all pairs of bucket mates would connect; only linked ids are returned.

    ``mates`` is a written ``bucket_mates`` table; ``verify`` keeps the true links among pairs (a, b). Each bucket first
    tests its members against its centre, the member that meets most ids in all its buckets and so is likely to lie in
    the middle. Members that have become connected, in this or in any other bucket, need no test between each other. So
    the next round looks at the members that were no centre yet: a bucket with few open pairs between different groups
    (at most ``spare`` times its members) tests them all. The ids (id, comp) of all other buckets go to ``candidates``,
    which has to return every pair of them that could be a true link between groups. Without it such buckets take
    further centres, the members with most links, and after ``rounds`` of them all open pairs are tested: the number of
    rounds decides how a pair is reached, not whether. The pairs of a round are tested in waves, so that many members that are
    all alike take a link each and not all (``settle``). ``known``: true links (a, b) found before, of the pairs ``tried``
    (a, b, a < b), which are not tested again. ``close``: SQL that holds for every true link, over the columns of ``signs``
    (id, ...), once as c_a and once as c_b; of a bucket's open pairs only those leave the join that it holds for.
    """

    def signed(x: DataFrame, id_: str, side: str) -> DataFrame:
        if signs is None:
            return x
        return x.join(signs.select(F.col("id").alias(id_), *[F.col(c).alias(f"{c}_{side}") for c in signs.columns if c != "id"]), id_)

    holds = F.lit(True) if close is None else F.expr(close)

    def likely(x: DataFrame) -> DataFrame:
        return x if signs is None else signed(signed(x, "a", "a"), "b", "b").where(holds).select("a", "b")

    def settle(pairs: DataFrame, labels: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``labels`` and ``found`` with the true links among ``pairs``. Many members that are all alike have very many pairs, and few
        links join them: every group is tested with one neighbour first, of all its neighbours the same for all that have it, then
        with more, then with all that are still apart."""
        for share in WAVES:
            a, b = [labels.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
            g, o = [F.coalesce(f"comp_{x}", x) for x in "ab"]
            left = cut(pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", g.alias("g"), o.alias("o")).where("g <> o"), "open")
            n, pairs = left.count(), left.select("a", "b")
            if n == 0:
                break
            last = share is None or n < WAVES_FROM
            if not last:
                ways = left.union(left.select("a", "b", F.col("o").alias("g"), F.col("g").alias("o")))
                best = F.min(F.struct(F.xxhash64("o"), F.xxhash64("a", "b"), "a", "b")).alias("x")
                some = cut(ways.groupBy("g", F.pmod(F.xxhash64("o"), F.lit(share)).alias("part")).agg(best).select("x.a", "x.b").distinct(), "pairs")
                pairs, later = some, pairs.join(some, ["a", "b"], "left_anti")
            good = cut(verify(pairs).select("a", "b"), "found")
            if good.limit(1).count():
                found = found.union(good)
                labels = components(found)
            if last:
                break
            pairs = later
        return labels, found

    met = mates.groupBy("id").agg(F.sum("n").alias("met"))
    crowd = mates.where("n > 2").join(met, "id")
    centres = crowd.groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "id")).alias("x")).select("bucket", F.col("x.id").alias("centre"))
    crowd = cut(crowd.select("bucket", "id").join(centres, "bucket").where("id <> centre"), "crowd")
    twos = mates.where("n = 2").groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("a", "b")
    pairs = cut(likely(crowd.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).union(twos).where("a <> b").distinct()), "pairs")
    if tried is not None:
        pairs = cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = cut(verify(pairs).select("a", "b"), "found")
    if known is not None:
        found = found.union(known)
    labels = components(found)
    live, tested = crowd.select("bucket", "id").distinct(), pairs if tried is None else pairs.union(tried)
    for turn in range(rounds):
        known = live.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        sizes = known.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("open"), F.count("*").alias("groups"))
        state = cut(known.join(sizes.where("groups > 1"), "bucket"), "state")
        if not state.limit(1).count():
            break
        few = F.lit(True) if turn == rounds - 1 else F.col("open") <= spare * F.col("n")
        small, large = state.where(few), state.where(~few)
        left = signed(small.select("bucket", F.col("id").alias("a"), "comp"), "a", "a")
        right = signed(small.select("bucket", F.col("id").alias("b"), F.col("comp").alias("comp_b")), "b", "b")
        pairs = left.join(right, "bucket").where("a < b and comp <> comp_b").where(holds).select("a", "b")
        if candidates is not None:
            pairs = pairs.union(candidates(large.select("id", "comp").distinct()).select("a", "b"))
        elif turn < rounds - 1:
            degree = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
            large = large.join(degree, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
            best = F.min(F.struct(-F.col("deg"), "id", "comp")).alias("best")
            centre = large.groupBy("bucket").agg(best).select("bucket", F.col("best.id").alias("centre"), F.col("best.comp").alias("comp_b"))
            large = cut(large.join(centre, "bucket").select("bucket", "id", "comp", "centre", "comp_b"), "large")
            pairs = pairs.union(likely(large.where("comp <> comp_b").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()))
        pairs = cut(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        labels, found = settle(pairs, labels, found)
        if candidates is not None or turn == rounds - 1:
            break
        tested = tested.union(pairs)
        live = large.where("id <> centre").select("bucket", "id")
    return labels
