"""Chat formatting by perspective rotation: each participant in turn is the assistant, all others are named users.

A dialogue is rendered piece by piece, one row per turn and perspective, with the place of each piece in the
whole, so that a dialogue of any length needs no task that holds it. render() joins the pieces where
dialogues are known to fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SYSTEM, UNKNOWN = "system", "unknown"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, participant, turn, speaker, role, name, piece, train, start, stop: one row per turn of turns and participant of its dialogue.

    role is system for the speaker system, assistant for the participant, and user with a name for all others.
    The speaker system is no participant; a null or empty speaker is the participant unknown. train is
    true for what the participant said; start and stop are the characters of the said text in the whole
    rendering, the mask where train is true. Turns go by turn, speaker and text; null turns are first, null text is
    empty, repeated rows are repeated turns. Rows without a dialogue id form one dialogue of their own. A
    dialogue of system turns alone has no perspective and an empty table none. Other columns are left out.
    """
    speaker = F.when(F.coalesce(F.trim(speaker_col), F.lit("")) == "", UNKNOWN).otherwise(F.col(speaker_col))
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(text_col, F.lit("")).alias("text"))
    people = said.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("participant")).distinct()
    each = said.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("participant"), "assistant").otherwise("user")
    each = each.withColumns({"role": role, "name": F.when(role == "user", F.col("speaker"))})
    head = F.concat(F.lit("<|"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("|>\n"))
    each = each.withColumns({"piece": F.concat(head, F.col("text"), F.lit("\n<|end|>\n")), "train": F.col("role") == "assistant", "__head": F.char_length(head)})
    earlier = W.partitionBy("conv_id", "participant").orderBy("turn", "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("piece")).over(earlier), F.lit(0)) + F.col("__head")
    out = each.withColumn("start", start.cast("long"))
    return out.select("conv_id", "participant", "turn", "speaker", "role", "name", "piece", "train", "start", (F.col("start") + F.char_length("text")).cast("long").alias("stop"))


def render(pieces: DataFrame) -> DataFrame:
    """conv_id, participant, rendered, spans (array of start, stop to train on), for pieces of dialogues that fit a row."""
    order = F.array_sort(F.collect_list(F.struct("start", "stop", "train", "piece")))
    whole = pieces.groupBy("conv_id", "participant").agg(order.alias("p"))
    spans = F.transform(F.filter("p", lambda p: p["train"]), lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop")))
    return whole.select("conv_id", "participant", F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("rendered"), spans.alias("spans"))
