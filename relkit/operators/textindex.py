"""Inverted index as DataFrames.

``TextIndex`` is lazy: one row a document with its terms and counts, from which
postings and statistics follow without a shuffle of the texts.

``StoredIndex`` is written once and then only read:

    postings/bucket=B   term, docno, tf, dl   sorted by (term, docno)
    terms/bucket=B      term, df, cf
    documents           docno, dl, terms with counts
    collection          n_docs, n_tokens

The corpus is tokenized once, at the build.  Postings lie in buckets of terms, so
a query whose terms are broadcast prunes buckets at run time (dynamic partition
pruning) and row groups by the order of terms; a term of very many documents goes
on over several files of its bucket, cut by docno.

Stop list (X3): terms in more than ``stop_percent`` of the documents are left out of
postings, lengths and statistics, as an index-time stop list does.  There are at
most (distinct terms of an average document) * 100 / ``stop_percent`` of them,
however large the corpus, so the list is a literal set in the plan of the build.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.functions.text import add_term_frequencies, tokenize

STOP_PERCENT = 10
BUCKETS = 32


@dataclass
class TextIndex:
    base: DataFrame  # (docno, dl, tfs array<struct<term, tf>>)

    @classmethod
    def build(cls, docs: DataFrame, docno: str = "docno", text: str = "text",
              stopwords: Iterable[str] | None = None) -> TextIndex:
        tok = docs.select(F.col(docno).cast("string").alias("docno"),
                          tokenize(text, stopwords).alias("_tok"))
        tok = add_term_frequencies(tok, "_tok", "tfs")
        return cls(tok.select("docno", F.size("_tok").cast("long").alias("dl"), "tfs"))

    @property
    def postings(self) -> DataFrame:
        # inline_outer + filter: a plain ``inline`` makes the optimizer infer
        # ``size(tfs) > 0`` and push it below the projections, re-evaluating
        # the whole sort-and-run expression inside that filter
        return self.base.select("docno", "dl", F.inline_outer("tfs")).where(F.col("term").isNotNull())

    @property
    def doc_lengths(self) -> DataFrame:
        return self.base.select("docno", "dl")

    def term_stats(self) -> DataFrame:
        """(term, df, cf)"""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))

    def coll_stats(self) -> DataFrame:
        return self.doc_lengths.agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("n_tokens"),
        ).withColumn("avgdl", F.try_divide(F.col("n_tokens").cast("double"), F.col("n_docs").cast("double")))


def stop_terms(term_stats: DataFrame, n_docs: Column, percent: int = STOP_PERCENT) -> DataFrame:
    """(term, df) of the terms in more than ``percent`` % of the documents."""
    return term_stats.where(F.col("df") * 100 > n_docs * percent).select("term", "df")


def bucket_of(term: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _read(self, name: str, schema: str) -> DataFrame:
        # with the schema given, no job looks for it
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self._read("postings", "term string, docno string, tf int, dl bigint, bucket int")

    @property
    def terms(self) -> DataFrame:
        return self._read("terms", "term string, df bigint, cf bigint, bucket int")

    @property
    def doc_lengths(self) -> DataFrame:
        return self._read("documents", "docno string, dl bigint")

    @property
    def collection(self) -> DataFrame:
        return self._read("collection", "n_docs bigint, n_tokens bigint")

    def coll_scalar(self) -> Column:
        """The collection statistics as one scalar-subquery struct column."""
        return self.collection.select(F.struct(F.col("n_docs").cast("double").alias("n_docs"),
                                               F.col("n_tokens").cast("double").alias("n_tokens"))).scalar()


def store(index: TextIndex, path: str, stop_percent: int = STOP_PERCENT, buckets: int = BUCKETS) -> StoredIndex:
    """Write the index to ``path``; 100 for ``stop_percent`` keeps every term."""
    spark = index.base.sparkSession

    def put(df: DataFrame, name: str, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{path}/{name}")

    put(index.base, "tokenized")
    base = spark.read.schema(index.base.schema).parquet(f"{path}/tokenized")
    whole = TextIndex(base)
    put(whole.term_stats(), "all_terms")
    stats = spark.read.schema("term string, df bigint, cf bigint").parquet(f"{path}/all_terms")
    n_docs = base.agg(F.count(F.lit(1))).scalar()
    stop = [r.term for r in stop_terms(stats, n_docs, stop_percent).select("term").collect()]

    def kept(term: Column) -> Column:
        return ~term.isin(stop) if stop else F.lit(True)

    # written before it is exploded: lengths and filtered terms are computed once a document
    docs = base.select("docno", F.filter("tfs", lambda x: kept(x["term"])).alias("tfs"))
    put(docs.select("docno", F.aggregate("tfs", F.lit(0).cast("long"), lambda n, x: n + x["tf"]).alias("dl"), "tfs"),
        "documents")
    docs = TextIndex(spark.read.schema(index.base.schema).parquet(f"{path}/documents"))
    out = StoredIndex(spark, path, buckets)
    put(stats.where(kept(F.col("term"))).select("*", bucket_of("term", buckets)).repartition("bucket"), "terms", "bucket")
    place = ["bucket", "term", "docno"]
    put(docs.postings.select("term", "docno", "tf", "dl", bucket_of("term", buckets))
        .repartitionByRange(*place).sortWithinPartitions(*place), "postings", "bucket")
    put(out.doc_lengths.agg(F.count(F.lit(1)).alias("n_docs"),
                            F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")), "collection")
    return out
