r"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*        turn := "### " Role ": " text "</turn>\\n"

The parser is deterministic: it cuts at "</turn>\\n", takes the role between "### " and the first ": ", refuses a turn
that holds another "###" or "</turn>", and resolves the codes \\s \\h \\l (for \\ # <). A text is first rendered as it
stands; the rendered turn is parsed and compared with its source, and where they differ the conflicting characters are
escaped, after which no control string is left in it and the codes resolve to the source again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .fingerprints import let

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
CODES = [("\\", "\\s"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]


def escape(text: Column) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(SEP), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null for a turn that the grammar refuses."""
    pieces = F.split(formatted, r"</turn>\n", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _turn)


def _turn(piece: Column) -> Column:
    at = F.locate(SEP, piece)
    body = F.substr(piece, at + len(SEP))
    fits = F.startswith(piece, F.lit(OPEN)) & (at > 0) & ~F.contains(F.substr(piece, F.lit(len(OPEN))), F.lit("###")) & ~F.contains(piece, F.lit("</turn>"))
    turn = F.struct(unescape(F.substr(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(body).alias("text"))
    return F.when(fits, turn)


def round_trip(role: Column, text: Column) -> Column:
    """The turn as it stands if it parses back to itself, else escaped."""
    plain = render(role, text)

    def checked(p: Column) -> Column:
        turns = parse(p)
        same = let(turns, lambda t: (F.size(t) == 1) & F.coalesce((F.element_at(t, 1).role == role) & (F.element_at(t, 1).text == text), F.lit(False)))
        return F.when(same, p).otherwise(render(escape(role), escape(text)))

    return let(plain, checked)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and turns (parsed back from formatted) of each conversation of turns (conv_id, turn, role, text).

    Rows are ordered by turn, ties by role and text, null turns first; repeated rows are turns of their own; null texts
    and roles are empty; null conv_ids form one conversation. Each turn is checked on its own row; only then are a
    conversation's turns gathered, into the one row that is its output. An empty table gives an empty result.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text"), round_trip(role, text).alias("out")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t.out), "").alias("formatted"))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))


def _pieces(formatted: Column) -> Column:
    """The turns as they stand in the formatted text, each without its closing string."""
    pieces = F.split(formatted, r"</turn>\n", -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _mask(piece: Column, learned: str) -> Column:
    """(own, at): whether the loss mask covers a piece's text, and after how many code points that begins."""
    at = F.locate(SEP, piece)
    own = unescape(F.substr(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)) == learned
    return F.struct(own.alias("own"), (at + len(SEP) - 1).alias("at"))


def conversation_digest(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the formatted conversations.

    Nulls, ties, repeated rows and empty tables are as in format_conversations().
    """
    done = format_conversations(turns)
    masked = F.transform(_pieces(F.col("formatted")), lambda p: F.struct(p.alias("p"), _mask(p, learned).alias("m")))
    loss = F.array_join(F.transform(F.filter(masked, lambda x: x.m.own), lambda x: unescape(F.substr(x.p, x.m.at + 1))), "")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = done.select("conv_id", "formatted", "turns", loss.alias("loss"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def loss_spans(formatted: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id and spans: the places (start, end, in code points of formatted) that the loss mask covers.

    formatted: (conv_id, formatted), one row for each conversation; a null or empty text has no spans.
    """
    each = formatted.select("conv_id", F.posexplode_outer(_pieces(F.coalesce("formatted", F.lit("")))).alias("n", "p"))
    before = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("base", F.coalesce(F.sum(F.char_length("p") + len(CLOSE)).over(before), F.lit(0))).withColumn("m", _mask(F.col("p"), learned))
    span = F.struct((F.col("base") + F.col("m.at")).cast("int").alias("start"), (F.col("base") + F.char_length("p")).cast("int").alias("end"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("m.own"), span))).alias("spans"))
