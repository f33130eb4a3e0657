"""Word frequencies, TF-IDF and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.exprs import col
from tallyfold.operators.transform import need

#: Frequent English words that say little.
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her him his how i if in into is it its just me more most my no not of on or our out "
    "she so some such than that the their them then there these they this those to up us was we were what when where which who whom why will with would you your"
).split()


def _tokens(df: DataFrame, column: str, least: int, stopwords: bool, pattern: str) -> DataFrame:
    need(df, column)
    words = F.explode(F.regexp_extract_all(F.lower(col(column)), F.lit(pattern), F.lit(0)))
    out = df.select(words.alias("term")).where(F.length("term") >= least)
    return out.where(~F.col("term").isin(STOPWORDS)) if stopwords else out


def text_frequency(df: DataFrame, column: str, top: int = 20, stopwords: bool = False) -> DataFrame:
    """term, count and percent of the most frequent words of two ASCII letters or more, without case."""
    tokens = _tokens(df, column, 2, stopwords, "[a-z]+")
    counts = tokens.groupBy("term").count()
    total = counts.agg(F.sum("count").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).select("term", "count", (100 * F.col("count") / F.col("__n")).alias("percent")).orderBy(F.desc("count"), "term").limit(top)


def tfidf(df: DataFrame, column: str, key: str, top: int = 20, max_features: int = 1000, stopwords: bool = True) -> DataFrame:
    """term and mean_tfidf of the top terms: idf ln((1 + n) / (1 + df)) + 1, rows scaled to length 1, the max_features most frequent terms."""
    need(df, column, key)
    docs = df.where(col(column).isNotNull())
    n = docs.agg(F.count("*").alias("__n"))
    tokens = docs.select(col(key).alias("__k"), F.explode(F.regexp_extract_all(F.lower(col(column)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term"))
    if stopwords:
        tokens = tokens.where(~F.col("term").isin(STOPWORDS))
    counts = tokens.groupBy("__k", "term").agg(F.count("*").alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    weighed = counts.join(F.broadcast(vocabulary), "term").crossJoin(F.broadcast(n)).select("__k", "term", "__n", (F.col("tf") * (F.ln((1 + F.col("__n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = weighed.groupBy("__k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "__k").groupBy("term").agg((F.sum(F.col("w") / F.col("norm")) / F.first("__n")).alias("mean_tfidf")).orderBy(F.desc("mean_tfidf"), "term").limit(top)


def lda(df: DataFrame, column: str, topics: int = 5, words: int = 10, iterations: int = 10, seed: int = 42) -> DataFrame:
    """topic, rank, term and weight of each topic's first words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    need(df, column)
    tokens = df.select(F.filter(F.regexp_extract_all(F.lower(col(column)), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)).alias("words")).where("words is not null")
    counter = CountVectorizer(inputCol="words", outputCol="features", minDF=2, vocabSize=2000).fit(tokens)
    model = LDA(k=topics, maxIter=iterations, seed=seed).fit(counter.transform(tokens))
    names = F.array(*map(F.lit, counter.vocabulary))
    found = model.describeTopics(words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    return found.select("topic", (F.col("rank") + 1).alias("rank"), F.get(names, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))
