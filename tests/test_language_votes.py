"""Language votes: edge cases, and that a text's words are read once for all languages."""

from pyspark.sql import functions as F

from sedge.functions import text as t


def _votes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.vote for r in df.select("id", t.latin_language(F.col("text")).alias("vote")).orderBy("id").collect()]


def test_votes_of_plain_and_empty_texts(spark):
    texts = [None, "", "12 34", "the cat and the dog", "der Hund und die Katze", "el perro y los gatos", "łąka", "schön", "zzz", "zzß"]
    assert _votes(spark, texts) == ["und", "und", "und", "en", "de", "es", "pl", "de", "en", "de"]


def test_only_the_sample_votes_however_far_it_reaches(spark):
    assert _votes(spark, ["the " * 200 + "und " * 900, "x" * 9000 + " und" * 150 + " the" * 400]) == ["en", "de"]


def test_words_are_read_once(spark):
    plan = spark.range(1).select(t.latin_language(F.col("id").cast("string")).alias("vote"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # of the head, and of the whole text where the head isn't enough
