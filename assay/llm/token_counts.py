"""Exact token counts of a corpus by context limit.

Documents are counted by their encoded length. Sums along that histogram, which has
a row per distinct length, answer every question about a limit: how many
documents fit, how many tokens there are in all, and how many are left when longer
documents are cut.

* A null or empty text has length 0 and counts as a document.
* Repeated rows count each. An empty table gives no lengths.
* Texts of any length are encoded whole. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.common import cut_lineage, running
from assay.llm.words import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level vocabulary of this kind splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoding of a vocabulary file, loaded once for each worker."""
    if path not in _ENCODINGS:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        _ENCODINGS[path] = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[path]


def token_lengths(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """n_tokens: a row for each document, in no order.

    `path` is a file that every executor has, like an installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            texts = batch.column(0)
            for first, last in chunks(texts):
                part = texts.slice(first, last - first).to_pylist()
                sizes = [len(encode(t)) if t else 0 for t in part]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n_tokens"])

    return documents.select("text").mapInArrow(run, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """A row per distinct length, with what a context limit of that many tokens gives.

    docs and tokens of that length; docs_within and tokens_within of at most that
    length; docs_over of more; tokens_cut: all tokens when longer documents are cut;
    share_within: the share of documents within, so that a quantile q is the first
    length whose share is at least q.
    """
    counted = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))
    # A row per length, written out: it is read twice, and the texts are to be encoded once.
    counted = cut_lineage(counted.withColumn("tokens", F.col("docs") * F.col("n_tokens")))
    summed = running(
        counted.withColumns({"docs_within": F.col("docs"), "tokens_within": F.col("tokens")}),
        [],
        [F.col("n_tokens")],
        {"docs_within": F.col("docs"), "tokens_within": F.col("tokens")},
    )
    all_docs = counted.agg(F.sum("docs")).first()[0] or 0
    over = F.lit(all_docs) - F.col("docs_within")
    return summed.select(
        F.col("n_tokens").alias("context"),
        "docs",
        "tokens",
        "docs_within",
        "tokens_within",
        over.alias("docs_over"),
        (F.col("tokens_within") + over * F.col("n_tokens")).alias("tokens_cut"),
        (F.col("docs_within") / F.lit(all_docs)).alias("share_within"),
    )


def at_limit(counts: DataFrame, limit: int) -> dict[str, int]:
    """Totals for any limit, a length of the histogram or not."""
    below = counts.where(F.col("context") <= limit)
    row = below.orderBy(F.col("context").desc()).first()
    docs, tokens = (row["docs_within"], row["tokens_within"]) if row else (0, 0)
    over = counts.where(F.col("context") > limit).agg(F.sum("docs")).first()[0] or 0
    return {"docs_within": docs, "tokens_within": tokens, "tokens_cut": tokens + over * limit}


def quantile(counts: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed."""
    row = counts.where(F.col("share_within") >= q).orderBy("context").first()
    return row["context"] if row else None
