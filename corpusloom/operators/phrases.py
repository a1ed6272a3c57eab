"""Which phrases of a table occur in which texts, by an index of the texts' words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch

#: Letters of the key by which pieces of words meet.
KEY = 3


def _anchor() -> Column:
    """(word, side) of a phrase: what any text that holds the phrase must have as a word or in one.

    A phrase of three words or more has inner words, which stand whole in the text: the longest. Of two words the first
    ends a word of the text and the second begins one: the longer. A single one may be anywhere in a word.
    """
    words, n = F.col("words"), F.size("words")
    inner = F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))
    longest = F.aggregate(inner, F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    pair = F.when(F.length(words[0]) >= F.length(F.get(words, F.lit(1))), F.struct(words[0].alias("word"), F.lit("end").alias("side"))).otherwise(F.struct(F.get(words, F.lit(1)).alias("word"), F.lit("start").alias("side")))
    outer = F.when(F.length(words[0]) >= F.length(F.element_at(words, -1)), F.struct(words[0].alias("word"), F.lit("end").alias("side"))).otherwise(F.struct(F.element_at(words, -1).alias("word"), F.lit("start").alias("side")))
    many = F.when(longest != "", F.struct(longest.alias("word"), F.lit("whole").alias("side"))).otherwise(outer)
    return F.when(n == 1, F.struct(words[0].alias("word"), F.lit("in").alias("side"))).when(n == 2, pair).otherwise(many)


def phrases_of_table(texts: DataFrame, phrases: DataFrame, *, key: str = "doc_id", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """(key, phrases): for each text that holds any, the distinct phrases of the table that are in it, sorted.

    A phrase is in a text if it is a substring, as for vocabularies that are given as lists. That costs one test for each
    phrase and text; here the texts' distinct words are a table, phrases find theirs in it by pieces of ``KEY`` letters and
    only what has them is tested. Phrases and texts have words parted by single spaces. The words that matter are
    written first: while they are few, the texts' words meet them without a shuffle. Else hot words are split by
    adaptive joins, as each join is followed by no grouping until texts meet their own candidates.

    Empty phrases and nulls are in no text; a key that is repeated has what any of its texts holds.
    """
    rows = texts.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text is not null")
    wanted = phrases.select(F.col(phrase).alias("phrase")).where("phrase is not null and trim(phrase) <> ''").distinct()
    words = rows.select("_id", F.explode(F.array_distinct(F.split("_text", " "))).alias("word")).where("word <> ''")
    anchored = wanted.select("phrase", F.split("phrase", " ").alias("words")).select("phrase", _anchor().alias("a")).select("phrase", "a.word", "a.side")
    dictionary = words.select("word").distinct()

    whole = anchored.where("side = 'whole'").select("phrase", "word")
    part = anchored.where("side <> 'whole'").withColumnRenamed("word", "piece").withColumn("key", F.substring("piece", 1, KEY))
    sizes = F.sequence(F.lit(1), F.least(F.lit(KEY), F.length("word")))
    pieces = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length("word") - k + 1), lambda i: F.substring("word", i, k))))
    keyed = dictionary.select("word", F.explode(F.array_distinct(pieces)).alias("key"))
    fits = F.when(F.col("side") == "end", F.endswith("word", "piece")).when(F.col("side") == "start", F.startswith("word", "piece")).otherwise(F.contains("word", "piece"))
    found = part.join(keyed, "key").where(fits).select("phrase", "word").unionAll(whole)
    spark, path = texts.sparkSession, f"{scratch(texts.sparkSession, 'phrases')}/found"
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)

    may = words.join(found, "word").select("_id", "phrase").groupBy("_id").agg(F.collect_set("phrase").alias("may"))
    held = rows.join(may, "_id").select("_id", F.filter("may", lambda p: F.contains("_text", p)).alias("held")).where(F.size("held") > 0)
    return held.groupBy("_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("phrases")).withColumnRenamed("_id", key)
