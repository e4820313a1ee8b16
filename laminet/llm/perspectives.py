"""Chat formatting by multi-party perspective rotation, with DataFrame functions.

For every participant (each role) of a conversation the dialogue is rendered with that speaker as the assistant and all
others as users named by their roles, with the spans of the assistant's words as masks. A conversation's turns are dealt
into parts of PART turn numbers, so that no row holds an unbounded dialogue: parts in order, joined, give the whole. Turns without a
number come first, in parts -1, -2 and so on by a hash, as many as make PART turns a part.

Texts and roles can't forge a turn: in them `<|` and `|>` are written with a zero-width space (U+200B) between the two, and line ends in roles
are spaces, so that all markers are the format's own. Masks count the characters as they are written.

Cases: turns go by number (null first), then role, then text; repeated rows are repeated turns; a null or empty role is
`unknown`, and a role of that name, or with underscores after it, gets one more underscore; a null text is empty; a null conversation id is one
conversation; an empty table gives an empty one; texts are rendered whole. Any other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 64
UNKNOWN = "unknown"
GAP = "\u200b"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|"), F.lit(f"<{GAP}|")), F.lit("|>"), F.lit(f"|{GAP}>"))


def participant(role: Column) -> Column:
    name = escaped(F.regexp_replace(role, r"[\r\n]", " "))
    return F.when(F.coalesce(role, F.lit("")) == "", UNKNOWN).when(role.rlike(rf"^{UNKNOWN}_*$"), F.concat(role, F.lit("_"))).otherwise(name)


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    """conv_id, perspective string, part long, n_turns long, rendered string, masks array<struct<start int, end int>>
    (code points in rendered, end exclusive, of the assistant's texts)."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        participant(F.col(role)).alias("role"),
        escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    unnumbered = rows.where("turn is null").groupBy(F.col("conv_id").alias("_c")).agg(F.ceil(F.count("*") / part).alias("_parts"))
    rows = rows.join(unnumbered, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").isNull(), "left").drop("_c")
    who = rows.select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    seen = rows.join(who, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    mine = F.col("role") == F.col("perspective")
    seen = seen.withColumns(
        {
            "part": F.coalesce(F.floor(F.col("turn") / part), -1 - F.pmod(F.xxhash64("role", "text"), F.col("_parts"))).cast("long"),
            "head": F.when(mine, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), F.col("role"), F.lit("|>\n"))),
            "mine": mine,
        }
    )
    grouped = seen.groupBy("conv_id", "perspective", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "mine"))).alias("turns"))
    piece = lambda t: F.concat(t["head"], t["text"], F.lit("<|end|>\n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("masks"))

    def add(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((acc["at"] + F.length(piece(t))).alias("at"), F.when(t["mine"], F.concat(acc["masks"], span)).otherwise(acc["masks"]).alias("masks"))

    return grouped.select(
        "conv_id",
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", piece), "").alias("rendered"),
        F.aggregate("turns", start, add, lambda acc: acc["masks"]).alias("masks"),
    )
