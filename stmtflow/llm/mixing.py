"""Operator 7: mix sources to target weights by pivotal dependent rounding.

Every source gets a target in words. Dividing it by the source's words gives the number
of copies that each of its documents should have, whole part and fraction. Pivotal
rounding then settles the fractions: two documents exchange word mass, in a random
direction whose odds keep both expectations, until one of them has a whole number of
copies; the other meets the next document. The word total of a source never changes in
an exchange, so a source misses its target by less than one document.

The exchange runs as a reduction tree: chunks of a source (hash of the document) are
settled independently and each leaves at most one open document, chunks of open documents
are settled at the next level, until one document per source is left and is rounded by
its own odds. A source with a third of all rows is many chunks like any other.

Cases: null text has size 0; a null source is a source of its own, last in order; rows
that repeat (same id, source and text) are one unit and get the same copies; null ids
are ordinary ids; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, whole_text, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
CHUNK = 2048
UNIT_KEYS = ("doc_id", "source", "size", "text_key")
STATE = ("doc_id bigint, source string, size bigint, text_key bigint, rows bigint, source_size bigint, "
         "target double, whole bigint, part double, chunk bigint, open boolean")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of (source, size, rows).

    With every source at ``level * weight`` or at its ceiling, the level is the largest
    over the sources in order of ceiling per weight (below it more sources would be at
    their ceiling, above it fewer). The table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"),
                                      F.count(F.lit(1)).alias("units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ceiling", F.col("source_size").cast("double") * most)
    before = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = (F.sum("source_size").over(everything) * share
            - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("reach", left / weight_left).withColumn("level", F.max("reach").over(everything))
    target = F.least(F.col("ceiling"), F.greatest(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return per.select("source", "source_size", "units", target.alias("target"))


def settle(units: pd.DataFrame, seed: int, last: bool) -> pd.DataFrame:
    """Pivotal exchanges among the open units of one chunk, the largest units first.

    Of two units the smaller one tends to settle; starting with the large ones leaves time for
    them to settle among smaller ones, and a small unit open at the end.
    ``whole`` and ``part`` are a unit's settled copies and open fraction; mass is counted in
    words (size * rows). When ``last``, the one unit left open is rounded by its odds.
    """
    units = units.sort_values(["size", "doc_id", "text_key"], ascending=[False, True, True], kind="stable",
                              na_position="last").reset_index(drop=True)
    words = (units["size"].to_numpy(np.int64) * units["rows"].to_numpy(np.int64)).astype(float).tolist()
    part, whole = units["part"].tolist(), units["whole"].tolist()
    draws = np.random.Generator(np.random.PCG64(seed)).random(len(units) + 1).tolist()
    held = -1
    for i, w in enumerate(words):
        if held < 0:
            held = i
            continue
        a, b = part[held] * words[held], part[i] * w
        # First outcome: held gives all it can to i; second: i gives all it can to held.
        give, take = min(a, w - b), min(b, words[held] - a)
        if draws[i] * (give + take) < take:
            full, empty = i, held
            settled = held if a <= w - b else i
            a, b = a - give, b + give
        else:
            full, empty = held, i
            settled = i if b <= words[held] - a else held
            a, b = a + take, b - take
        part[held], part[i] = a / words[held], b / w
        if settled == full:
            whole[settled] += 1
        part[settled] = 0.0
        held = full if settled == empty else empty
    is_open = np.zeros(len(units), dtype=bool)
    if held >= 0:
        if last or not 1e-12 < part[held] < 1 - 1e-12:
            whole[held] += int(draws[-1] < part[held])
            part[held] = 0.0
        else:
            is_open[held] = True
    units["whole"], units["part"], units["open"] = whole, part, is_open
    return units


def _settler(seed: int, level: int, last: bool):
    """The settling of one (source, chunk) group; its draws depend on these names only."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, part = pdf["source"].iloc[0], int(pdf["chunk"].iloc[0])
        entropy = np.random.SeedSequence([seed, level, part, *str(name).encode()]).generate_state(1, np.uint64)
        return settle(pdf, int(entropy[0]), last)

    return run


def mixed_units(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
                seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """One row per unit: its keys, ``rows`` (how often it occurs), source_size, target, copies."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        word_count(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("text_key"))
    units = cut(sized.groupBy(*UNIT_KEYS).agg(F.count(F.lit(1)).alias("rows")))
    per = source_targets(units, weights, share, most).withColumnRenamed("source", "of")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = (units.join(per, F.col("source").eqNullSafe(F.col("of")))
             .withColumn("copies", F.least(copies, F.lit(float(most))))
             .withColumn("whole", F.when(F.col("size") > 0, F.floor("copies")).otherwise(0).cast("bigint"))
             .withColumn("part", F.when(F.col("size") > 0, F.col("copies") - F.floor("copies")).otherwise(0.0))
             .withColumn("open", F.col("part") > 0)
             .withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_key"),
                                         F.ceil(F.col("units") / chunk))))
    most_chunks = per.agg(F.max(F.ceil(F.col("units") / chunk))).first()[0] or 1
    fields = [c.split()[0] for c in STATE.split(", ")]
    level, done = 0, state.filter(~F.col("open")).select(*fields)
    state = state.filter("open").select(*fields)
    while True:
        last = most_chunks <= 1

        out = cut(state.groupBy("source", "chunk").applyInPandas(_settler(seed, level, last), STATE))
        done = done.unionByName(out.filter(~F.col("open")))
        if last:
            break
        level, most_chunks = level + 1, -(-most_chunks // chunk)
        state = out.filter("open").withColumn("chunk", F.floor(F.col("chunk") / chunk).cast("bigint"))
    return done.select(*UNIT_KEYS, "rows", "source_size", "target", F.col("whole").alias("copies"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (words)."""
    per = mixed_units(docs, **options)
    return (per.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    per = mixed_units(docs, **options).filter("copies > 0").select(
        *[F.col(c).alias(f"unit_{c}") for c in UNIT_KEYS], "copies")
    rows = packed(docs, doc_id=F.col("doc_id").cast("bigint"), source=F.col("source").cast("string"),
                  size=word_count(whole_text()), text_key=F.xxhash64(whole_text()))
    same = F.lit(True)
    for c in UNIT_KEYS:
        same = same & F.col(c).eqNullSafe(F.col(f"unit_{c}"))
    return (rows.join(per, same).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
            .select("row.*"))
