"""Table shapes shared by all operators."""

from pyspark.sql import types as T

HIGHEST, LOWEST, TIME = "highest", "lowest", "time"
SCORE_TYPES = (HIGHEST, LOWEST, TIME)

SCORE = T.DecimalType(12, 2)

SCORES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("score", SCORE),
        T.StructField("submitted_at", T.TimestampNTZType()),
        T.StructField("metadata", T.StringType()),
    ]
)

GAMES = T.StructType(
    [
        T.StructField("game_id", T.LongType()),
        T.StructField("game_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("score_type", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("email", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("is_staff", T.BooleanType()),
        T.StructField("date_joined", T.TimestampNTZType()),
    ]
)

# A submission before validation: the score is still text, so bad numbers can be told apart.
SUBMISSIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("game_id", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("submitted_at", T.TimestampNTZType()),
        T.StructField("metadata", T.StringType()),
    ]
)
