"""Keyword search: a positional inverted index, BM25, and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.text import porter, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def inverted_index(rows: DataFrame, key: str, columns: list[str], stems: bool = True) -> DataFrame:
    """(key, field, pos, term): every token of every column, stemmed.

    Stems are computed once a distinct word, not once a token.
    """
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(columns)]))
    flat = rows.select(F.col(key).alias("key"), fields.alias("f")).select("key", "f.field", F.posexplode(tokens(F.col("f.text"))).alias("pos", "word"))
    if not stems:
        return flat.withColumnRenamed("word", "term")
    words = flat.select("word").distinct().select("word", porter("word").alias("term"))
    return flat.join(words, "word").select("key", "field", "pos", "term")


def phrases(keywords: DataFrame, stems: bool = True) -> DataFrame:
    """(query, phrase, i, term): each keyword as a phrase of its tokens; quotes are dropped, empty phrases too."""
    flat = keywords.select("query", F.posexplode(F.array_distinct("keywords")).alias("phrase", "word")).select(
        "query", "phrase", F.posexplode(tokens(F.replace("word", F.lit('"'), F.lit(" ")))).alias("i", "term")
    )
    return flat.withColumn("term", porter("term")) if stems else flat


def phrase_hits(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, phrase, key, tf): occurrences of each phrase, its tokens adjacent in one field."""
    n = wanted.groupBy("query", "phrase").agg(F.count(F.lit(1)).alias("n"))
    hit = index.join(wanted, "term").select("query", "phrase", "key", "field", (F.col("pos") - F.col("i")).alias("at"), "i")
    whole = hit.groupBy("query", "phrase", "key", "field", "at").agg(F.countDistinct("i").alias("m")).join(n, ["query", "phrase"]).where("m = n")
    return whole.groupBy("query", "phrase", "key").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, wanted: DataFrame, rows: int | None = None) -> DataFrame:
    """(query, key, score, matched): all phrases of a query must match; only if no row has all, any may.

    Rows are as long as all their tokens; IDF is never under a tiny positive value.
    """
    size = index.groupBy("key").agg(F.count(F.lit(1)).alias("len"))
    total = size.agg(F.count(F.lit(1)).alias("rows"), F.avg("len").alias("avg"))
    hits = phrase_hits(index, wanted)
    df = hits.groupBy("query", "phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    tf = F.col("tf")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    n = wanted.groupBy("query").agg(F.countDistinct("phrase").alias("n"))
    scored = (
        hits.join(df, ["query", "phrase"]).join(size, "key").join(F.broadcast(total)).select("query", "key", part.alias("part"))
        .groupBy("query", "key").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched")).join(n, "query")
    )
    best = scored.groupBy("query").agg(F.max(F.col("matched") == F.col("n")).alias("all"))
    return scored.join(best, "query").where(~F.col("all") | (F.col("matched") == F.col("n"))).select("query", "key", "score", "matched")


def top_k(scored: DataFrame, k: int = 10, pool: bool = True) -> DataFrame:
    """(query, key, score, matched, rank): the best k of each query.

    With pool, the best max(5k, 25) by score are ordered again by the number of phrases matched, stably.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    ranked = scored.withColumn("at", F.row_number().over(w))
    if pool:
        ranked = ranked.where(F.col("at") <= max(5 * k, 25)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("matched"), "at")))
    else:
        ranked = ranked.withColumn("rank", F.col("at"))
    return ranked.where(F.col("rank") <= k).drop("at")


def rank_score(base: float, i: Column) -> Column:
    """base - 0.01 i, in doubles."""
    return F.lit(base) - F.lit(0.01) * i


def hybrid(results: DataFrame, k: int = 10) -> DataFrame:
    """(query, layer, id, score, match, position): best score of each id, ties in the order first seen.

    results: (query, layer, id, match, score, seq).
    """
    by_id = Window.partitionBy("query", "layer", "id")
    kept = (
        results.withColumn("first", F.min("seq").over(by_id))
        .withColumn("i", F.row_number().over(by_id.orderBy(F.desc("score"), "seq"))).where("i = 1")
    )
    w = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    return kept.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k).select("query", "layer", "id", "score", "match", "position")
