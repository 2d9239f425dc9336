"""Declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()

RESPONSE_SCHEMA = T.StructType([
    T.StructField("required_fields", T.ArrayType(STR)),
    T.StructField("types", T.MapType(STR, STR)),
])

# M1 / M2: instruction record and eval record
INSTRUCTION = T.StructType([T.StructField("instruction", STR), T.StructField("input", STR),
                            T.StructField("output", STR)])
EVAL_RECORD = T.StructType(INSTRUCTION.fields + [T.StructField("task_type", STR),
                                                 T.StructField("schema", RESPONSE_SCHEMA)])
# M4: task template
TEMPLATE = T.StructType([T.StructField("task_type", STR), T.StructField("instruction", STR),
                         T.StructField("input", STR)])
# M7: wide response row
WIDE_RESPONSE = T.StructType([T.StructField(c, STR) for c in (
    "instruction", "input", "expected_output", "baseline_response", "phase1_alpaca_response",
    "phase2_json_response")])
# M8: suite container, an object of arrays of wide rows.
# The names of its arrays.
SUITES = ("alpaca", "json")
# M9: model-keyed container, an object of arrays of these
MODEL_RESPONSE = T.StructType([T.StructField("prompt_idx", T.LongType()),
                               T.StructField("instruction", STR), T.StructField("response", STR)])
# Run metadata
RUN_METADATA = T.StructType([
    T.StructField("epochs", T.IntegerType()), T.StructField("learning_rate", T.DoubleType()),
    T.StructField("batch_size", T.IntegerType()),
    T.StructField("gradient_accumulation_steps", T.IntegerType()),
    T.StructField("training_loss", T.DoubleType()), T.StructField("checkpoint_path", STR),
    T.StructField("output_dir", STR)])
# Trainer state
LOG_ENTRY = T.StructType([T.StructField("epoch", T.DoubleType()),
                          T.StructField("grad_norm", T.DoubleType()),
                          T.StructField("learning_rate", T.DoubleType()),
                          T.StructField("loss", T.DoubleType()), T.StructField("step", T.IntegerType())])
TRAINER_STATE = T.StructType([
    T.StructField("epoch", T.DoubleType()), T.StructField("global_step", T.IntegerType()),
    T.StructField("max_steps", T.IntegerType()), T.StructField("num_train_epochs", T.IntegerType()),
    T.StructField("log_history", T.ArrayType(LOG_ENTRY))])
# Chat messages
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", STR), T.StructField("content", STR)]))
# raw judge replies (input of H1)
RAW_VERDICT = T.StructType([T.StructField("comparison", STR), T.StructField("prompt_id", T.LongType()),
                            T.StructField("swap", T.IntegerType()), T.StructField("raw", STR),
                            T.StructField("arrived_at", T.TimestampType())])

# The pairwise comparisons (comparison, challenger, opponent).
COMPARISONS = (("cp1_vs_cp0", "cp1", "cp0"), ("cp2_vs_cp0", "cp2", "cp0"),
               ("cp2_vs_cp1", "cp2", "cp1"))
# Judge dimensions, in the reference's order.
DIMENSIONS = ("instruction_following", "correctness", "clarity", "completeness",
              "structured_output_validity", "hallucination_risk")
