"""Which of many new entries become books, and which are answered by an earlier one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadshelf.plans.lineage import cut, cut_counted


@dataclass
class Rule:
    """An entry is answered by the first kept entry that offers what it asks for; NULL asks or
    offers nothing. Rules are tried in order."""

    asks: Column
    offers: Column


def settle(entries: DataFrame, place: str, rules: list[Rule]) -> DataFrame:
    """(place, root): the earlier kept entry that answers each entry, or the entry itself.

    The result is that of going through the entries by `place`: only an entry that was kept
    answers later ones. In every round an open entry is dropped if a kept one answers it, and
    kept if no earlier open one could. An entry that hangs on a single other open one is kept if
    that is dropped and dropped if that is kept, so chains of these are followed by pointer
    doubling: a chain of any length takes as many steps as its length has bits. Entries that hang
    on several others wait for the next round, which sees the open entries only.
    """
    return _Settling(entries, place, rules).run()


class _Settling:
    def __init__(self, entries: DataFrame, place: str, rules: list[Rule]):
        self.name = place
        spot = F.col(place).alias("_place")
        listed = [self._listed(entries, [rule.asks for rule in rules]), self._listed(entries, [rule.offers for rule in rules])]
        self.all = cut(entries.select(spot, *[x.alias(n) for x, n in zip(listed, ("_asks", "_offers"), strict=True)]))
        # one row for every thing asked for or offered; what is NULL meets nothing
        self.asks = self.all.select("_place", F.inline("_asks"))
        self.offers = self.all.select("_place", F.inline("_offers"))
        self.steps = 0

    @staticmethod
    def _listed(entries: DataFrame, columns: list[Column]) -> Column:
        """The things that are not NULL, as (rule, key)."""

        def key(c: Column) -> Column:
            kind = entries.select(c).schema[0].dataType
            if isinstance(kind, T.StructType):
                # an ask and an offer may call the same fields by other names
                c = c.cast(T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(kind)]))
            return F.to_json(F.struct(c.alias("k")))

        given = [F.when(c.isNotNull(), F.struct(F.lit(i).alias("rule"), key(c).alias("key"))) for i, c in enumerate(columns)]
        return F.filter(F.array(*given), lambda x: x.isNotNull())

    def run(self) -> DataFrame:
        open_ = self.all.select("_place")
        fresh = open_.limit(0)  # kept in the round before
        kept, dropped = [], []
        while True:
            judged, still_open, hanging = self._judged(open_, fresh)
            if hanging:
                judged, still_open = self._followed(judged)
            fresh = judged.where("_state = 'kept'").select("_place")
            kept.append(fresh)
            dropped.append(judged.where("_state = 'dropped'").select("_place"))
            open_ = judged.where("_state = 'open'").select("_place")
            if not still_open:
                return self._with_roots(_union(kept), _union(dropped))

    def _judged(self, open_: DataFrame, fresh: DataFrame) -> tuple[DataFrame, int, int]:
        """(_place, _state, _on): kept, dropped, open, or hanging on one open entry; and how many
        are open and hanging."""
        self.steps += 1
        alive = open_.withColumn("_kept", F.lit(False)).unionByName(fresh.withColumn("_kept", F.lit(True)))
        known = self.offers.join(alive, "_place").groupBy("rule", "key").agg(
            F.min(F.when(F.col("_kept"), F.col("_place"))).alias("_kept_at"),
            F.min(F.when(~F.col("_kept"), F.col("_place"))).alias("_open_at"),
            F.count(F.when(~F.col("_kept"), 1)).alias("_n"),
        )
        earlier = F.col("_open_at") < F.col("_place")
        met = self.asks.join(open_, "_place").join(known, ["rule", "key"])
        answered = met.groupBy("_place").agg(
            F.bool_or(F.col("_kept_at") < F.col("_place")).alias("_answered"),
            F.min(F.when(earlier, F.col("_open_at"))).alias("_on"),
            F.max(F.when(earlier, F.col("_open_at"))).alias("_last"),
            F.max(F.when(earlier, F.col("_n"))).alias("_n"),
        )
        single = (F.col("_on") == F.col("_last")) & (F.col("_n") == 1)
        state = (
            F.when(F.coalesce("_answered", F.lit(False)), "dropped")
            .when(F.col("_on").isNull(), "kept")
            .when(single, "hanging")
            .otherwise("open")
        )
        judged = open_.join(answered, "_place", "left").select("_place", state.alias("_state"), "_on")
        judged, n = cut_counted(judged, open=F.count_if(F.col("_state") == "open"), hanging=F.count_if(F.col("_state") == "hanging"))
        return judged, n["open"], n["hanging"]

    def _followed(self, judged: DataFrame) -> tuple[DataFrame, int]:
        """Entries that hang on others, judged by where their chain ends; and how many are open."""
        hanging = cut(judged.where("_state = 'hanging'").select("_place", "_on", F.lit(1).alias("_odd")))
        while True:
            self.steps += 1
            above = hanging.select(F.col("_place").alias("_on"), F.col("_on").alias("_next"), F.col("_odd").alias("_more"))
            hanging, n = cut_counted(
                hanging.join(above, "_on", "left").select(
                    "_place",
                    F.coalesce("_next", "_on").alias("_on"),
                    F.when(F.col("_next").isNull(), F.col("_odd")).otherwise((F.col("_odd") + F.col("_more")) % 2).alias("_odd"),
                    F.col("_next").isNotNull().alias("_moved"),
                ),
                moved=F.count_if(F.col("_moved")),
            )
            hanging = hanging.drop("_moved")
            if not n["moved"]:
                break
        ends = judged.where("_state <> 'hanging'").select(F.col("_place").alias("_on"), F.col("_state").alias("_end"))
        other = F.when(F.col("_end") == "kept", "dropped").otherwise("kept")
        state = F.when(F.col("_end") == "open", "open").when(F.col("_odd") == 1, other).otherwise(F.col("_end"))
        told = hanging.join(ends, "_on").select("_place", state.alias("_state"))
        settled = judged.where("_state <> 'hanging'").select("_place", "_state").unionByName(told)
        settled, n = cut_counted(settled, open=F.count_if(F.col("_state") == "open"))
        return settled, n["open"]

    def _with_roots(self, kept: DataFrame, dropped: DataFrame) -> DataFrame:
        first = self.offers.join(kept, "_place").groupBy("rule", "key").agg(F.min("_place").alias("_root"))
        met = self.asks.join(dropped, "_place").join(first, ["rule", "key"]).where(F.col("_root") < F.col("_place"))
        roots = met.groupBy("_place").agg(F.min(F.struct("rule", "_root"))["_root"].alias("root"))
        own = kept.select("_place", F.col("_place").alias("root"))
        return own.unionByName(roots).withColumnRenamed("_place", self.name)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
