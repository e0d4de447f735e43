"""Mixing sources to target weights by systematic sampling.

Within a source every document expects the same number of copies, its target
over its size in words. Running through the source in order, the expected copies
are summed, one random offset per source is added, and a document is emitted
once for each whole number that its step crosses.

Documents stand by (size, doc_id), so neighbours are alike in size and the words
taken differ from the target by about one document, the largest, at most.

* No text, or none with words: size 0; the document may be emitted, with 0 words.
* A null source is a source of its own, after all others.
* Repeated rows are documents of their own; ties in size go by doc_id.
* A source without words has target 0 and emits nothing. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, fresh, running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash that tells texts of one id apart."""
    return documents.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("text_hash"),
    )


def targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """source, source_size, target: `share` of all words dealt to sources by weight.

    Weights repeat along the sources by code point, null last. No target exceeds
    `most` times its source's size; the rest is shared again. That ends where
    each source has the smaller of its bound and a common level times its
    weight; with sources by bound over weight, the level is the largest of what
    is left for a source and those after it, over their weights.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = {"place": F.lit(1).cast("long")}
    placed = running(per, [], [F.col("source").asc_nulls_last()], one)
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    weighed = placed.withColumns(
        {
            "weight": F.get(dealt, ((F.col("place") - 1) % len(weights)).cast("int")),
            "bound": F.col("source_size") * F.lit(float(most)),
        }
    )
    order = [F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()]
    sums = {"bounds": F.col("bound"), "weights": F.col("weight")}
    filled = running(weighed, [], order, sums)
    whole = weighed.agg(F.sum("source_size") * F.lit(float(share)), F.sum("weight")).first()
    left = F.lit(whole[0]) - (F.col("bounds") - F.col("bound"))
    room = F.lit(whole[1]) - (F.col("weights") - F.col("weight"))
    level = filled.agg(F.max(left / room)).first()[0]
    return filled.select(
        "source",
        "source_size",
        F.least(F.col("bound"), F.lit(level) * F.col("weight")).alias("target"),
    )


def offset(seed: int):
    """A number from 0 up to 1 for each source, the same in every run."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def allotted(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 1,
) -> DataFrame:
    """doc_id, source, size, text_hash, source_size, target, copies: a row per document."""
    sizes = cut_lineage(sized(documents))
    wanted = targets(sizes, weights, share, most).withColumnRenamed("source", "its_source")
    order = [F.col("size"), F.col("doc_id"), F.col("text_hash")]
    placed = running(sizes, ["source"], order, {"place": F.lit(1).cast("long")})
    joined = placed.join(wanted, F.col("source").eqNullSafe(F.col("its_source")))
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.floor(F.col("place") * F.col("step") + F.col("start"))
    past = F.floor((F.col("place") - 1) * F.col("step") + F.col("start"))
    crossed = F.least(upto - past, F.ceil("step"))
    return (
        joined.withColumns({"step": step, "start": offset(seed)})
        .withColumn("copies", crossed)
        .drop("its_source", "place", "step", "start")
    )


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 1,
    copy: str = "copy",
) -> DataFrame:
    """The mixed documents: each as often as it is taken, numbered from 1 in `copy`.

    Where the documents have a column of that name, case aside, it stays and the
    numbers get a name like it.
    """
    (copy,) = fresh(documents, copy)
    plan = allotted(documents, weights, share, most, seed)
    same = Window.partitionBy("doc_id", "source", "text_hash").orderBy("copies")
    digest, nth, *own = fresh(documents, "_digest", "_nth", "_doc", "_source", "_text", "_n", "_times")
    its_doc, its_source, its_text, its_nth, times = own
    plan = plan.withColumn("nth", F.row_number().over(same)).select(
        F.col("doc_id").alias(its_doc),
        F.col("source").alias(its_source),
        F.col("text_hash").alias(its_text),
        F.col("nth").alias(its_nth),
        F.col("copies").alias(times),
    )
    # Rows alike in these may differ in others: a rerun must number them alike.
    hashed = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]
    alike = Window.partitionBy("doc_id", "source", digest).orderBy(F.xxhash64(*hashed))
    rows = documents.withColumn(digest, F.xxhash64("text"))
    rows = rows.withColumn(nth, F.row_number().over(alike))
    joined = rows.join(
        plan.where(F.col(times) > 0),
        F.col("doc_id").eqNullSafe(F.col(its_doc))
        & F.col("source").eqNullSafe(F.col(its_source))
        & (F.col(digest) == F.col(its_text))
        & (F.col(nth) == F.col(its_nth)),
    )
    numbers = F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))).alias(copy)
    kept = [F.col(f"`{c}`") for c in documents.columns]
    return joined.select(*kept, numbers)
