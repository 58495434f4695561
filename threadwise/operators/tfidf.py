"""TF-IDF weights as DataFrame rows (document, term, weight)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from threadwise import constants as C
from threadwise.functions import patterns as P


def terms(text: Column, stop_words: list[str]) -> Column:
    """Terms of two or more word characters, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(P.TERM), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(stop_words))


def vocabulary(documents: DataFrame, text: str = "text", stop_words: list[str] = C.ENGLISH_STOP_WORDS,
               max_terms: int = C.MAX_TERMS, min_df: int = C.MIN_DOC_FREQ) -> DataFrame:
    """The most frequent terms found in at least min_df documents: never more than max_terms rows.

    The terms of a document are sorted in its row and the first of equal ones is marked, so that document and
    term counts come out of one aggregate on the term alone, combined before the shuffle.
    """
    listed = documents.select(F.sort_array(terms(F.col(text), stop_words)).alias("__terms"))
    listing = F.col("__terms")
    marked = F.transform(listing, lambda t, i: F.struct(
        t.alias("term"), ((i == 0) | (F.get(listing, i - 1) != t)).alias("first")))
    # The outer form, because the other one would copy the whole expression into a filter.
    exploded = listed.select(F.explode_outer(marked).alias("t")).filter("t is not null")
    counts = exploded.groupBy("t.term").agg(F.count_if("t.first").alias("df"), F.count("*").alias("total"))
    return counts.filter(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_terms).drop("total")


def tfidf(documents: DataFrame, key: str, text: str = "text", stop_words: list[str] = C.ENGLISH_STOP_WORDS,
          max_terms: int = C.MAX_TERMS, min_df: int = C.MIN_DOC_FREQ) -> DataFrame:
    """Smoothed, L2-normalised TF-IDF weights over the top terms.

    The vocabulary is bounded by max_terms and broadcast. Its terms are counted per document before they are shuffled;
    one row for each term of a document meets the others for the norm.
    """
    known = vocabulary(documents, text, stop_words, max_terms, min_df)
    documents_total = documents.agg(F.count("*")).scalar()
    idf = F.log((documents_total + 1) / (F.col("df") + 1)) + 1
    found = documents.select(key, F.explode(terms(F.col(text), stop_words)).alias("term"))
    hits = found.join(F.broadcast(known), "term")
    weighted = hits.groupBy(key, "term", "df").agg(F.count("*").alias("tf")).withColumn("__w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", "tf", (F.col("__w") / norm).alias("weight"))
