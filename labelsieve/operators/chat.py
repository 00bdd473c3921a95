"""Conversations as one text each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.parts import PIECE_ROWS, join_in_order


def render_chat(
    df: DataFrame,
    conversation: Sequence[str],
    turn: str,
    role: str,
    text: str,
    role_tag: str = "<|{role}|>\n",
    end_tag: str = "\n",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Turns of each conversation, tagged with their role, in order of ``turn``.

    ``turn`` is a whole number, unique within its conversation. A conversation is one
    row with all its turns, however many it has. A missing role or text is an empty one,
    so every turn that is counted has its tags in the text.
    """
    before, _, after = role_tag.partition("{role}")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    piece = F.concat(F.lit(before), said[0], F.lit(after), said[1], F.lit(end_tag))
    joined = join_in_order(
        df, conversation, turn, piece, "", "_rendered", {"n_turns": F.lit(1).cast("long")}, piece_rows=piece_rows
    )
    return joined.select(*conversation, "n_turns", F.col("_rendered").alias("text"))
