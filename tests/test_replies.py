"""Replies are read on all cores, whichever way their table was cut."""

from pyspark.sql import functions as F

from quern.functions import replies as J

ONE = '{"id": "q", "stem": "S", "correct": "R", "explanation": "E", "distractors": ["a", "b", "c"], "items": [{"label": "l", "detail": "d"}]}'


def parts(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_part_of_replies_is_read_in_several(spark):
    one = spark.range(200).coalesce(1).select(F.col("id").alias("reply_id"), F.lit(ONE).alias("text"), F.lit("d").alias("deck"))
    assert parts(one) == 1
    assert parts(J._exploded(one)) > 1 and J._exploded(one).count() == 200
    assert parts(J.extraction(one)) > 1 and J.questions(one).count() == 200
