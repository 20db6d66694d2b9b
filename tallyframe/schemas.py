"""Read schemas of the tables the operators work on."""

from pyspark.sql import types as T

PROBLEMS = T.StructType([
    T.StructField("problem", T.StringType()),
    T.StructField("solution", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("type", T.StringType()),
])

EXAMPLES = T.StructType([
    T.StructField("id", T.LongType()),
    *PROBLEMS.fields,
    T.StructField("prompt", T.StringType()),
])

GENERATIONS = T.StructType([
    *EXAMPLES.fields,
    T.StructField("generated_solution", T.StringType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
])

NESTED_OUTPUTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prompt_token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("outputs", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    ]))),
])

RESULTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("sample_idx", T.IntegerType()),
    T.StructField("level", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("is_correct", T.BooleanType()),
    T.StructField("match_type", T.StringType()),
    T.StructField("generated_answer", T.StringType()),
    T.StructField("ground_truth_answer", T.StringType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("prompt_tokens", T.LongType()),
])
