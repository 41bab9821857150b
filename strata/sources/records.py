"""Records of split text files whose quoted values hold line breaks.

A line break ends a record only where the number of quotes before it, from
the start of the file, is even (a doubled quote counts twice). A task that
reads one split can't know that number, but it takes one bit per split: the
parity of its quotes. So every split is counted by itself, the bits are summed
over the splits of each file, and each split then knows whether it begins
inside a quoted value. Lines before its first record start belong to the last
record that an earlier split started.

Lines of one split are ordered by a window over (file, split), so no task
holds more than a split and the record that runs out of it. A quote that is
never closed makes the rest of its file one record, as in any CSV reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_quoted_lines(lines: DataFrame, quote: str, line: str, file: str, split: str, position: str) -> DataFrame:
    """One row per record: ``line`` holds its whole text, joined by ``\\n``.

    ``lines`` has the physical lines of files in UTF-8 or a one-byte encoding,
    cut at ``\\n``: their text, file, the offset of their split and an id that
    rises inside the split. Other columns must be the same for all lines of a
    file; they are kept.
    """
    others = [c for c in lines.columns if c not in (line, file, split, position)]
    text = F.col(line)
    quotes = (F.length(text) - F.length(F.replace(text, F.lit(quote), F.lit("")))) % 2
    in_split = Window.partitionBy(file, split).orderBy(position)
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumn("_odd", quotes).withColumn("_p", F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2)

    # one row per split; the windows over a file see its splits only
    splits = d.groupBy(file, split).agg(
        (F.sum("_odd") % 2).alias("_odd"), F.count_if(F.col("_p") == 0).alias("_n0"), F.count_if(F.col("_p") == 1).alias("_n1")
    )
    before = Window.partitionBy(file).orderBy(split).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_inside", F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2)
    splits = splits.withColumn("_n", F.when(F.col("_inside") == 0, F.col("_n0")).otherwise(F.col("_n1")))
    last = F.last(F.when(F.col("_n") > 0, F.struct(F.col(split).alias("at"), F.col("_n").alias("n"))), ignorenulls=True)
    splits = splits.select(file, split, "_inside", last.over(before).alias("_owner"))

    d = d.join(splits, [file, split])  # both lie by (file, split) already
    d = d.withColumn("_start", (F.col("_p") + F.col("_inside")) % 2 == 0)
    d = d.withColumns(
        {
            "_rec": F.count_if("_start").over(in_split.rowsBetween(Window.unboundedPreceding, 0)),
            "_alone": F.col("_start") & F.coalesce(F.lead("_start").over(in_split), F.lit(False)),
        }
    )
    alone = d.where("_alone").select(line, file, *others)
    own = F.col("_rec") > 0
    key = [F.when(own, F.col(split)).otherwise(F.col("_owner.at")).alias("_at"), F.when(own, F.col("_rec")).otherwise(F.col("_owner.n")).alias("_nr")]
    parts = F.array_sort(F.collect_list(F.struct(F.col(split).alias("s"), F.col(position).alias("p"), F.col(line).alias("t"))))
    joined = d.where(~F.col("_alone")).groupBy(file, *key).agg(
        F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias(line), *[F.first(c).alias(c) for c in others]
    )
    return alone.unionByName(joined.select(line, file, *others))
