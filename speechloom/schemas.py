"""Schemas of the tables that the operators read and write."""

from pyspark.sql import types as T

WORD = T.StructType([T.StructField("word", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("score", T.DoubleType())])
MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("audio_path", "transcript", "split", "speaker_id", "chapter_id", "utterance_id")])
ALIGNMENT = T.StructType(
    [
        *(T.StructField(c, T.StringType()) for c in ("utterance_id", "split", "speaker_id", "chapter_id", "dataset")),
        T.StructField("audio_duration", T.DoubleType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("words", T.ArrayType(WORD)),
        *(T.StructField(c, T.StringType()) for c in ("alignment_model", "processed_at")),
    ]
)
FEATURES = T.StructType([T.StructField("utterance_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("feat_len", T.IntegerType())])
BIN = T.StructType([*(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("input_ids", "labels", "attention_mask")), T.StructField("audio_features", T.ArrayType(T.ArrayType(T.FloatType()))), T.StructField("audio_lengths", T.ArrayType(T.IntegerType()))])

IGNORED_LABEL, AUDIO_TOKEN = -100, 151655
