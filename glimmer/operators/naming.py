"""Names that nothing else has: files of an archive, restored files, albums.

Rows take names one after the other: a row gets its own name if that is free, else the name with the least number that is
free by then, as in "a.jpg", "a-2.jpg", "a-3.jpg" or "x (restored).jpg", "x (restored 2).jpg". A numbered name may be another
row's own name, before or after, and so push it to a number of its own ("a-2-2.jpg").

No order of rows is walked through. A numbered name has one parent, so names make trees, whose levels are settled from the
top. Of a name with j further rows and no own names among its numbers, the j-th gets the j-th number. Where a number n is
a row's own name, first used when r further rows had come, it is passed over if and only if the row that reaches it comes
later: with s numbers passed over so far, if n - first - s >= r. That takes one number for each such name; those that are passed
over shift the rest, and those that are not are lost to the rows whose own name they are. Rows are numbered in ranges
(`numbered`), so a name that a third of all rows have is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.shipping import ship
from glimmer.store import written

_PARTS = r"^(.*?)(\.[^./]*)?$"


def numbered(rows: DataFrame, keys: list[str], order: list[str], place: str = "place") -> DataFrame:
    """rows with their place, from 1, by `order` within keys: counts of sorted ranges and what comes before each, no task a key."""
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = written(ranged.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}), "ranges")
    firsts = held.groupBy(*keys, "__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), (F.col("__first") - before).alias("__from"))
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = held.join(firsts, same).withColumn(place, F.col("__i") - F.col("__from") + 1)
    return out.drop("__p", "__i", "__q", "__from", *[f"__k{i}" for i in range(len(keys))])


@dataclass(frozen=True)
class Style:
    """How a number is written behind a name's stem, and read again; `first` is the least one. one: what the first is, if special."""

    before: str
    after: str
    first: int
    one: str | None = None

    def write(self, name: Column, n: Column) -> Column:
        stem, ending = F.regexp_extract(name, _PARTS, 1), F.regexp_extract(name, _PARTS, 2)
        mark = F.concat(F.lit(self.before), n.cast("string"), F.lit(self.after))
        return F.concat(stem, mark if self.one is None else F.when(n == self.first, F.lit(self.one)).otherwise(mark), ending)

    def _marks(self) -> str:
        quote = lambda s: "".join("\\" + c if c in "()-.+*" else c for c in s)
        many = f"{quote(self.before)}([1-9][0-9]{{0,17}}){quote(self.after)}"
        return many if self.one is None else f"(?:{many}|{quote(self.one)})"

    def read(self, name: Column) -> tuple[Column, Column, Column]:
        """The parent, the number and the depth of a name; without a number the parent is null."""
        stem, ending = F.regexp_extract(name, _PARTS, 1), F.regexp_extract(name, _PARTS, 2)
        found = F.regexp_extract(stem, f"^(.*){self._marks()}$", 2)
        n = F.when(found != "", found.cast("long"))
        least = self.first if self.one is None else self.first + 1
        n = F.when(n >= least, n)
        if self.one is not None:
            n = F.when(F.endswith(stem, F.lit(self.one)), F.lit(self.first).cast("long")).otherwise(n)
        parent = F.when(n.isNotNull(), F.concat(F.regexp_extract(stem, f"^(.*){self._marks()}$", 1), ending))
        depth = F.size(F.regexp_extract_all(F.regexp_extract(stem, f"(?:{self._marks()})*$", 0), F.lit(self._marks()), F.lit(0)))
        return parent, n, depth


DASHED = Style("-", "", 2)
RESTORED = Style(" (restored ", ")", 1, " (restored)")


def _passed(first: int):
    """Of one name's numbers in use, by number: which are passed over, and by which further row each is reached."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        passed, reach, s = [], [], 0
        for n, r in zip(pdf["n"].tolist(), pdf["r"].tolist(), strict=True):
            j = n - first + 1 - s  # the further row that would get this number
            reach.append(j)
            passed.append(j > r)
            s += j > r
        return pdf.assign(passed=passed, reach=reach)

    return run


def free_names(rows: DataFrame, name: str, keys: list[str], order: list[str], style: Style, out: str = "entry", taken: DataFrame | None = None) -> DataFrame:
    """rows with a column `out`: a name that no row of the same keys has, as if rows took theirs in `order`.

    taken: keys and names in use from the start. order tells rows apart within keys. Null and empty names stay as they are.
    """
    ship(rows.sparkSession)
    group = [f"__g{i}" for i in range(len(keys))] or ["__g"]
    of_keys = [F.struct(k) for k in keys] or [F.lit(0)]  # structs of nulls are equal
    placed = numbered(rows.withColumns({"__name": F.col(name), **dict(zip(group, of_keys, strict=True))}), group, order, "__pos")
    asked = placed.filter(F.col("__name") != "")
    plain = asked.select(*group, "__name", F.col("__pos").alias("pos"))
    used = taken.select(*[k.alias(g) for k, g in zip(of_keys, group, strict=True)], F.col(name).alias("__name")).filter("__name <> ''").distinct().withColumn("pos", F.lit(0).cast("long")) if taken is not None else plain.limit(0)
    each = written(numbered(plain, [*group, "__name"], ["pos"], "k"), "names")
    parent, n, depth = style.read(F.col("__name"))
    names = each.groupBy(*group, "__name").agg(F.min("pos").alias("pos"), F.count("*").alias("rows")).unionByName(used.withColumn("rows", F.lit(0).cast("long")))
    names = written(names.groupBy(*group, "__name").agg(F.min("pos").alias("pos"), F.sum("rows").alias("rows")).withColumns({"parent": parent, "n": n, "depth": depth}), "names")
    # numbers in use, of names that several rows want or that are taken
    wanting = names.filter("rows > 1 OR (pos = 0 AND rows > 0) OR parent IS NOT NULL")
    families = names.filter("parent IS NOT NULL").select(*group, F.col("__name").alias("child"), "pos", "n", F.col("parent").alias("__name"))
    specials = written(families.join(wanting.select(*group, "__name", "depth"), [*group, "__name"]), "numbers")
    depths = [r[0] for r in specials.select("depth").distinct().orderBy("depth").collect()]  # as many as marks fit a name
    lost = names.filter("pos = 0").select(*group, "__name")  # names that their own rows do not get
    shifted = None
    for d in depths:
        level = specials.filter(F.col("depth") == d).drop("depth")
        own = each.join(level.select(*group, "__name").distinct(), [*group, "__name"], "left_semi").join(lost.withColumn("lost", F.lit(True)), [*group, "__name"], "left")
        further = written(own.withColumn("j", F.when(F.col("lost"), F.col("k")).otherwise(F.col("k") - 1)).filter("j > 0").select(*group, "__name", "pos", "j"), "further")
        events = level.select(*group, "__name", "n", "pos").unionByName(further.select(*group, "__name", F.lit(None).cast("long").alias("n"), "pos"))
        both = numbered(events.withColumn("e", F.coalesce("n", F.lit(0))), [*group, "__name"], ["pos", "e"], "all").filter("n IS NOT NULL")
        alone = numbered(both, [*group, "__name"], ["pos", "e"], "own").withColumn("r", F.col("all") - F.col("own"))
        kinds = dict(alone.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, "__name", "n", "r"]) + ", passed boolean, reach long"
        settled = written(alone.select(*group, "__name", "n", "r").groupBy(*group, "__name").applyInPandas(_passed(style.first), schema), "settled")
        most = further.groupBy(*group, "__name").agg(F.max("j").alias("most"))
        taken_over = settled.join(most, [*group, "__name"]).filter("NOT passed AND reach <= most")
        lost = written(lost.unionByName(taken_over.join(level.select(*group, "__name", "n", "child"), [*group, "__name", "n"]).select(*group, F.col("child").alias("__name"))).distinct(), "lost")
        steps = further.select(*group, "__name", "pos", "j", F.lit(1).alias("e")).unionByName(settled.filter("passed").select(*group, "__name", F.lit(None).cast("long").alias("pos"), F.col("reach").alias("j"), F.lit(0).alias("e")).withColumn("e", F.lit(0)))
        numbers = numbered(steps.withColumn("u", F.monotonically_increasing_id()), [*group, "__name"], ["j", "e", "u"], "m").filter("e = 1").select(*group, "pos", F.col("m"))
        shifted = written(numbers if shifted is None else shifted.unionByName(numbers), "shifted")
    all_rows = each.join(lost.withColumn("lost", F.lit(True)), [*group, "__name"], "left").withColumn("j", F.when(F.col("lost"), F.col("k")).otherwise(F.col("k") - 1))
    if shifted is not None:
        all_rows = all_rows.join(shifted, [*group, "pos"], "left")
    number = (F.coalesce("m", "j") if shifted is not None else F.col("j")) + (style.first - 1)
    given = all_rows.select(*group, F.col("pos").alias("__pos"), F.when(F.col("j") == 0, F.col("__name")).otherwise(style.write(F.col("__name"), number)).alias("__given"))
    joined = placed.join(given, [*group, "__pos"], "left")
    return joined.withColumn(out, F.coalesce("__given", "__name")).drop(*group, "__pos", "__name", "__given")
