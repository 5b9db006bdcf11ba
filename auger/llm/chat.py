r"""Chat formatting with a grammar round trip, in Spark columns only.

Template of a turn (``role`` is percent-encoded, so it holds no colon, hash or line end)::

    ### role: text</turn>\n

Grammar: a conversation is a row of turns; a turn is one header, a body without control strings, one
end mark. The parser cuts at end marks and headers only, so it is deterministic. A control string inside
a text is escaped by one backslash after its first character, and runs of such backslashes grow by one:
``</turn>`` <-> ``<\/turn>`` <-> ``<\\/turn>``; ``### x: `` <-> ``#\## x: ``. That map is one to one.

Each turn is first rendered as it is, parsed again and compared with its source; only turns that come
back different, or whose body holds control strings, are escaped and checked again. The whole
conversation is then parsed once more and compared in number and content; ``round_trip`` reports it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Template, fixed values.
HEAD, SEP, END = "### ", ": ", "</turn>\n"
_ROLE = r"[A-Za-z0-9_.*%+\-]*"
_CONTROL = rf"</turn>|### {_ROLE}: "


def escape(text: Column) -> Column:
    t = F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>")
    return F.regexp_replace(t, rf"#(\\*)## ({_ROLE}): ", r"#\\$1## $2: ")


def unescape(body: Column) -> Column:
    t = F.regexp_replace(body, rf"#\\(\\*)## ({_ROLE}): ", r"#$1## $2: ")
    return F.regexp_replace(t, r"<\\(\\*)/turn>", r"<$1/turn>")


def _head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.url_encode(role), F.lit(SEP))


def _parse_piece(piece: Column) -> Column:
    """One turn without its end mark -> struct(role, text); null where it breaks the grammar."""
    cut = F.locate(SEP, piece)
    body = F.substr(piece, cut + F.lit(len(SEP)))
    sound = piece.rlike(rf"^### {_ROLE}: ") & ~body.rlike(_CONTROL)
    role = F.substr(piece, F.lit(len(HEAD) + 1), cut - F.lit(len(HEAD) + 1))
    return F.when(sound, F.struct(F.url_decode(role).alias("role"), unescape(body).alias("text")))


def parse(formatted: Column) -> Column:
    """Formatted conversation -> array of struct(role, text), in order; a null entry marks a piece
    that is no turn."""
    pieces = F.split(formatted, END, -1)
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), _parse_piece)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans, escaped_turns, round_trip``.

    ``loss_spans``: (start, length) in code points of ``formatted``, the bodies of ``loss_role``.
    Rows are ordered by turn (null first), then role, then text, so ties and repeated rows have one
    order and are all kept. Null role or text: empty. Rows with a null conversation id form one
    conversation. Other columns are ignored; an empty table gives an empty result. Rendering, parsing
    and escaping happen per row; only the finished strings of a conversation meet."""
    src = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                       F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = _head(F.col("role"))
    plain = F.struct("role", "text")
    back = _parse_piece(F.concat(head, F.col("text")))
    src = src.withColumn("conflict", ~back.eqNullSafe(plain))
    src = src.withColumn("body", F.when(F.col("conflict"), escape(F.col("text"))).otherwise(F.col("text")))
    src = src.withColumn("sound", _parse_piece(F.concat(head, F.col("body"))).eqNullSafe(plain))
    src = src.withColumn("out", F.concat(head, F.col("body"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    begin = F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("out")
    span = F.struct((begin + F.length(head)).cast("long").alias("start"), F.length("body").cast("long").alias("length"))
    placed = src.select("conv_id", "sound", "conflict", "out",
                        F.row_number().over(order).alias("at"),
                        F.xxhash64("role", "text").alias("sum"),
                        F.when(F.col("role") == loss_role, span).alias("loss"))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "out", "loss", "sum"))).alias("rows"),
        F.min("sound").alias("sound"), F.sum(F.col("conflict").cast("int")).alias("escaped_turns"))
    text_of = F.array_join(F.transform("rows", lambda r: r["out"]), "")
    whole = whole.withColumn("formatted", text_of)
    again = F.transform(parse(F.col("formatted")), lambda t: F.xxhash64(t["role"], t["text"]))
    return whole.select(
        "conv_id", "formatted",
        F.filter(F.transform("rows", lambda r: r["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.col("escaped_turns").cast("long"),
        (F.col("sound") & (again == F.transform("rows", lambda r: r["sum"]))).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_spans, round_trip``: turns by the
    parser, the loss text cut out of the formatted text by the spans of the loss mask and unescaped."""
    got = formatted.select("conv_id", "formatted", "loss_spans", "round_trip", parse(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = lambda s: unescape(F.substr("formatted", s["start"].cast("int") + 1, s["length"].cast("int")))
    got = got.select("conv_id", "formatted", "round_trip", F.size("turns").cast("long").alias("n_turns"),
                     F.size("loss_spans").cast("long").alias("n_spans"), F.array_join(lines, "").alias("all"),
                     F.array_join(F.transform("loss_spans", masked), "").alias("loss"))
    return got.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"), "n_spans", "round_trip")
