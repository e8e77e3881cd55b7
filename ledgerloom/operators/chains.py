"""Chains of links: from every link on to the next one, by doubling, in bounded rows.

A link leads from a wallet to the next in one asset, at most one for each wallet and asset.  A walk starts at a
link and goes on until none follows, the amount grows past a factor, or the next wallet has come already.
What a walk's end, length and extremes are is found for all starts at once: each round joins what is
known of a stretch with what is known of the stretch behind it, so rounds are as many as the longest
walk's length has binary digits and a row stays a row, however long its walk.  Paths are laid out afterwards, a row
for each place, for the starts that are asked for alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut, sized


#: Walks that are laid out link by link: at most so many, of at most so many links.
FEW_STARTS, FEW_STEPS = 1_000, 64


def _closed(state: DataFrame) -> bool:
    return state.filter("jump is not null").isEmpty()


@dataclass
class Chains:
    """links: wallet, asset, next, amount and the columns named in ``least`` and ``most``, whose smallest and
    largest value over a walk's links are wanted."""

    links: DataFrame
    grows: float | None = None
    least: tuple[str, ...] = ()
    most: tuple[str, ...] = ()

    @cached_property
    def own(self) -> DataFrame:
        return cut(self.links.select("wallet", "asset", "next", "amount", *self.least, *self.most).withColumn("id", F.monotonically_increasing_id()))

    @cached_property
    def n(self) -> int:
        """How many links there are: no table by id has more rows."""
        return self.own.count()

    def _of(self, rows: DataFrame) -> DataFrame:
        """A table by id as one side of a join with another."""
        return sized(rows, self.n)

    @cached_property
    def base(self) -> DataFrame:
        """id, wallet, asset, next, succ (id of the link that follows), broken (id of one that would, were its
        amount not too large), and the measures."""
        own = self.own
        after = own.select(F.col("id").alias("to"), F.col("wallet").alias("w"), F.col("asset").alias("a"), F.col("amount").alias("m"))
        rows = own.join(self._of(after), (F.col("next") == F.col("w")) & (F.col("asset") == F.col("a")), "left")
        goes = F.lit(True) if self.grows is None else F.col("m") <= F.col("amount") * self.grows
        return cut(rows.withColumn("succ", F.when(goes, F.col("to"))).withColumn("broken", F.when(~goes, F.col("to"))).drop("to", "w", "a", "m"))

    def _both(self, a: str, b: str):
        return [*(F.least(f"{a}.{c}", f"{b}.{c}").alias(c) for c in self.least), *(F.greatest(f"{a}.{c}", f"{b}.{c}").alias(c) for c in self.most)]

    def _doubled(self, state: DataFrame, rounds: int | None = None) -> DataFrame:
        """state (id, jump, dist, tail, measures): stretches joined until none goes on, or so many times."""
        names, k = ["dist", "tail", *self.least, *self.most], 0
        while not _closed(state) and (rounds is None or k < rounds):
            on = state.filter("jump is not null").alias("x").join(self._of(state).alias("y"), F.col("x.jump") == F.col("y.id"))
            on = on.select("x.id", "y.jump", (F.col("x.dist") + F.col("y.dist")).alias("dist"), "y.tail", *self._both("x", "y"))
            state, k = cut(state.filter("jump is null").select("id", "jump", *names).unionByName(on)), k + 1
        return state

    def _begun(self, rows: DataFrame, ends=None) -> DataFrame:
        jump = F.col("succ") if ends is None else F.when(~ends, F.col("succ"))
        return rows.select("id", jump.alias("jump"), F.lit(1).cast("long").alias("dist"), F.col("id").alias("tail"), *self.least, *self.most)

    @cached_property
    def walks(self) -> DataFrame:
        """wallet, asset, links (how many), last (the walk's last wallet) and the measures, for every start."""
        base = self.base
        done = self._doubled(self._begun(base), max(self.n, 1).bit_length())
        straight, round_ = done.filter("jump is null"), done.filter("jump is not null")
        ends = base.select(F.col("id").alias("tail"), F.col("next").alias("last"), "broken")
        straight = cut(straight.join(self._of(ends), "tail"))
        # the last link leads back into the walk where the one that would follow it stands in the walk
        again = straight.filter("broken = id").select("tail", F.col("id").alias("back"))
        special = []
        if not again.isEmpty():
            special.append(self._returning(straight, again))
        if not round_.isEmpty():
            special.append(self._circling(cut(round_.select("id", "jump"))))
        names = [*self.least, *self.most]
        plain = straight.select("id", "dist", "last", *names)
        if special:
            counted = special[0] if len(special) == 1 else special[0].unionByName(special[1])
            counted = cut(counted)
            plain = plain.join(self._of(counted.select("id")), "id", "left_anti").unionByName(self._measured(counted))
        return cut(plain.join(self._of(base.select("id", "wallet", "asset")), "id").select("id", "wallet", "asset", F.col("dist").alias("links"), "last", *names))

    def _returning(self, straight: DataFrame, again: DataFrame) -> DataFrame:
        """id, dist: of walks that pass the link their end would lead to; the last link falls away."""
        own = straight.join(self._of(again), "tail").select("id", (F.col("id") == F.col("back")).alias("here"))
        state = cut(own.join(self._of(self.base.select("id", "succ")), "id").select("id", F.col("succ").alias("jump"), "here"))
        while not _closed(state):
            on = state.filter("jump is not null").alias("x").join(self._of(state).alias("y"), F.col("x.jump") == F.col("y.id"))
            on = on.select("x.id", "y.jump", (F.col("x.here") | F.col("y.here")).alias("here"))
            state = cut(state.filter("jump is null").unionByName(on))
        return straight.join(self._of(state.filter("here").select("id")), "id").select("id", F.greatest(F.col("dist") - 1, F.lit(1)).alias("dist"))

    def _circling(self, open_: DataFrame) -> DataFrame:
        """id, dist: of walks that lead into a circle: the way to it and all of it but the link that closes it.
        Where so many jumps have led, one is on the circle, and everything on it is reached so."""
        inside = cut(open_.select(F.col("jump").alias("id")).distinct())
        ring = cut(self.base.join(self._of(inside), "id", "left_semi").select("id", "succ"))
        state = ring.select("id", F.col("succ").alias("jump"), F.least("id", "succ").alias("lead"))
        for _ in range(max(ring.count(), 1).bit_length()):
            on = state.alias("x").join(self._of(state).alias("y"), F.col("x.jump") == F.col("y.id"))
            state = cut(on.select("x.id", "y.jump", F.least("x.lead", "y.lead").alias("lead")))
        size = state.groupBy("lead").agg(F.count("*").alias("size"))
        on_ring = state.join(self._of(size), "lead").select("id", "size")
        way = self.base.join(self._of(open_.select("id")), "id", "left_semi").join(self._of(inside), "id", "left_anti")
        way = way.join(self._of(on_ring.select(F.col("id").alias("succ"), "size")), "succ", "left")
        begun = way.select("id", F.when(F.col("size").isNull(), F.col("succ")).alias("jump"), F.lit(1).cast("long").alias("dist"), F.col("id").alias("tail"), "size")
        state = cut(begun)
        while not _closed(state):
            on = state.filter("jump is not null").alias("x").join(self._of(state).alias("y"), F.col("x.jump") == F.col("y.id"))
            on = on.select("x.id", "y.jump", (F.col("x.dist") + F.col("y.dist")).alias("dist"), "y.tail", "y.size")
            state = cut(state.filter("jump is null").unionByName(on))
        # a link that leads to its own wallet is a walk of one
        return on_ring.select("id", F.greatest(F.col("size") - 1, F.lit(1)).alias("dist")).unionByName(state.select("id", (F.col("dist") + F.col("size") - 1).alias("dist")))

    def _jumps(self, rows: DataFrame):
        """Tables of id, to (2^k links on; none past the end) and the measures of those links, k after k."""
        at = cut(rows.select("id", F.col("succ").alias("to"), *self.least, *self.most))
        while True:
            yield at
            on = at.alias("x").join(self._of(at).alias("y"), F.col("x.to") == F.col("y.id"))
            at = cut(on.select("x.id", "y.to", *self._both("x", "y")))

    def _measured(self, counted: DataFrame) -> DataFrame:
        """id, dist, last, measures of walks (id, dist) of a known number of links."""
        names = [*self.least, *self.most]
        state = counted.select("id", "dist", F.col("id").alias("at"), *(F.lit(None).cast(self.base.schema[c].dataType).alias(c) for c in names))
        most = counted.agg(F.max("dist")).first()[0]
        for k, jump in zip(range(most.bit_length()), self._jumps(self.base)):
            on = (F.col("y.id") == F.col("x.at")) & (F.shiftright("x.dist", k) % 2 == 1)
            state = cut(state.alias("x").join(self._of(jump).alias("y"), on, "left").select("x.id", "x.dist", F.coalesce("y.to", "x.at").alias("at"), *self._both("x", "y")))
        return state.join(self._of(self.base.select(F.col("id").alias("at"), F.col("wallet").alias("last"))), "at").select("id", "dist", "last", *names)

    def places(self, starts: DataFrame) -> DataFrame:
        """wallet, asset, place, member: the wallets of the walks of ``starts`` (rows of ``walks``) in order."""
        own = cut(starts.select("id", "wallet", "asset", "links", "last"))
        n, most = own.agg(F.count("*"), F.coalesce(F.max("links"), F.lit(0))).first()
        amount = self.base.schema["amount"].dataType
        ends = own.select("wallet", "asset", F.col("links").alias("place"), F.col("last").alias("member"), F.lit(None).cast(amount).alias("amount"))
        if n <= FEW_STARTS and most <= FEW_STEPS:
            return self._stepped(own, most).unionByName(ends)
        state = own.select("wallet", "asset", F.col("id").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("links") - 1)).alias("place"))
        for k, jump in zip(range(max(most - 1, 0).bit_length()), self._jumps(self.base)):
            on = (F.col("y.id") == F.col("x.at")) & (F.shiftright("x.place", k) % 2 == 1)
            state = cut(state.alias("x").join(self._of(jump).alias("y"), on, "left").select("x.wallet", "x.asset", F.coalesce("y.to", "x.at").alias("at"), "x.place"))
        inner = state.join(self._of(self.base.select(F.col("id").alias("at"), F.col("wallet").alias("member"), "amount")), "at").select("wallet", "asset", "place", "member", "amount")
        return inner.unionByName(ends)

    def _stepped(self, own: DataFrame, most: int) -> DataFrame:
        """``places`` but the last of a few short walks, link by link: the table of links is read once for each, never shuffled."""
        state, out = own.select("wallet", "asset", "links", F.col("id").alias("at")), []
        for place in range(most):
            link = self.base.select(F.col("id").alias("at"), F.col("wallet").alias("member"), "amount", "succ")
            step = cut(link.join(F.broadcast(state), "at").select("wallet", "asset", "links", F.lit(place).cast("long").alias("place"), "member", "amount", "succ"))
            state = step.filter(F.col("links") > place + 1).select("wallet", "asset", "links", F.col("succ").alias("at"))
            out.append(step.select("wallet", "asset", "place", "member", "amount"))
        return reduce(DataFrame.unionByName, out, own.filter("false").select("wallet", "asset", F.col("links").alias("place"), F.col("last").alias("member"), F.lit(None).cast(self.base.schema["amount"].dataType).alias("amount")))

    def covered(self, starts: DataFrame) -> DataFrame:
        """wallet: all that stand in a walk of ``starts``, without laying the walks out."""
        marked = cut(starts.select("id").distinct())
        for jump in self._jumps(self.base):
            # whatever follows a marked link by 2^k links is marked; after k rounds the next 2^k links are
            after = self.base.join(self._of(marked), "id", "left_semi").filter("succ is not null").select(F.col("succ").alias("id"))
            if after.join(self._of(marked), "id", "left_anti").isEmpty():
                break
            on = jump.filter("to is not null").join(self._of(marked), "id", "left_semi").select(F.col("to").alias("id"))
            marked = cut(marked.unionByName(on).distinct())
        return marked.join(self._of(self.base.select("id", "wallet")), "id").select("wallet").unionByName(starts.select(F.col("last").alias("wallet"))).distinct()
