"""Chat prompts and finetuning records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "array<struct<type:string,content:string,has_loss:boolean>>"

# Fixed values of the chat format.
BEGIN, HEADER, HEADER_END, TURN_END = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|endoftext|>"


def chat_prompts(turns: DataFrame, key: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key, prompt: all turns in order with their headers, then the header of the answer to come. An answer follows its header
    directly, other turns after an empty line."""
    gap = F.when(F.col(role_col) == "assistant", F.lit("")).otherwise(F.lit("\n\n"))
    part = F.concat(F.lit(HEADER), F.col(role_col), F.lit(HEADER_END), gap, F.col(text_col), F.lit(TURN_END))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), part.alias("p")))), lambda s: s["p"])
    return turns.groupBy(key).agg(F.concat(F.lit(BEGIN), F.array_join(parts, ""), F.lit(f"{HEADER}assistant{HEADER_END}")).alias("prompt"))


def finetuning_records(turns: DataFrame, key: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key, line: a JSON array of parts; the assistant's have a loss."""
    part = F.struct(F.lit("text").alias("type"), F.col(text_col).alias("content"), (F.col(role_col) == "assistant").alias("has_loss"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("t"), part.alias("p")))), lambda s: s["p"])
    return turns.groupBy(key).agg(F.to_json(parts).alias("line"))


def parsed_records(lines: DataFrame, key: str, line_col: str = "line") -> DataFrame:
    """key, part, text, loss_weight; a part that is no text raises."""
    parts = lines.select(key, F.posexplode(F.from_json(F.col(line_col), RECORD)).alias("part", "p"))
    text = F.when(F.col("p.type") == "text", F.col("p.content")).otherwise(F.raise_error(F.concat(F.lit("not a text part: "), F.coalesce("p.type", F.lit("null")))))
    return parts.select(key, "part", text.alias("text"), F.when(F.col("p.has_loss"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("loss_weight"))
