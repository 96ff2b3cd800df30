r"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "### " role mark ": " body "</turn>\n"
    mark         = "" for a body as it was, "!" for an escaped one

No role and no body holds "###" or "</turn>", so the parser splits at the closing string and reads each header up to its
first ": ". A body is first rendered as it is, reparsed and compared with its source. Where they differ, or the body holds
a control string, it is escaped: "\" as "\b", "#" as "\h", "<" as "\l", after which none can occur. Roles are always
escaped, ":", "!" and line ends ("\c", "\x", "\n") too. Undoing takes the backslash last, which makes it exact. The whole
conversation is then parsed again; rows that still differ from their source would be an error, not a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, SEP, CLOSE, MARK, CONTROL = "### ", ": ", "</turn>\n", "!", ("###", "</turn>")
_BODY = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE = (*_BODY, (":", "\\c"), ("!", "\\x"), ("\n", "\\n"))


def _escape(c: Column, table) -> Column:
    for plain, coded in table:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def _undo(c: Column, table) -> Column:
    for plain, coded in reversed(table):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _piece(role: Column, body: Column, mark: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape(role, _ROLE), mark, F.lit(SEP), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (role, text, escaped) that the grammar reads; a null member where a piece breaks it."""
    pieces = F.split(formatted, "</turn>\n", -1)
    inner = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p):
        at = F.instr(p, SEP)
        head, body = F.substring(p, F.lit(5), at - 5), F.substring(p, at + 2, F.length(p))
        coded = F.endswith(head, F.lit(MARK))
        role = F.when(coded, F.substring(head, F.lit(1), F.length(head) - 1)).otherwise(head)
        broken = ~F.startswith(p, F.lit(OPEN)) | (at == 0)
        for c in CONTROL:
            broken = broken | F.contains(body, F.lit(c))
        return F.when(~broken, F.struct(_undo(role, _ROLE).alias("role"), F.when(coded, _undo(body, _BODY)).otherwise(body)
                                        .alias("text"), coded.alias("escaped")))

    return F.transform(inner, turn)


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """(conv, formatted, loss): one row a conversation; ``loss`` lists (start, length, escaped) in code points of the
    bodies to learn from.

    Rows follow ``turn_col``, nulls first, ties by role, then text; equal rows are all kept. Null roles and texts count
    as empty. Rows without a conversation make one of their own, with a null id. A conversation is one training text and
    so one row; its turns meet in one task because the result does. An empty table gives no rows.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = _piece(F.col("role"), F.col("text"), F.lit(""))
    again = parse(plain)
    same = F.coalesce((F.size(again) == 1) & (again[0]["role"] == F.col("role")) & (again[0]["text"] == F.col("text")), F.lit(False))
    t = t.withColumn("same", same)
    body = F.when(F.col("same"), F.col("text")).otherwise(_escape(F.col("text"), _BODY))
    t = t.withColumn("body", body)
    t = t.withColumn("piece", _piece(F.col("role"), F.col("body"), F.when(F.col("same"), "").otherwise(MARK)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumns({"pos": F.row_number().over(order),
                       "upto": F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("upto") - F.length(F.lit(CLOSE)) - F.length("body")
    loss = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), F.length("body").cast("long").alias("length"),
                                                       (~F.col("same")).alias("escaped")))
    rows = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", loss.alias("loss"), "role", "text"))).alias("r"))
    source = F.transform("r", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["piece"]), "").alias("formatted"),
                        F.filter(F.transform("r", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"), source.alias("source"))
    read = F.transform(parse(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    fine = F.when(read == F.col("source"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return whole.select("conv_id", fine.alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): the parsed turns, and the text under the loss mask with escapes undone."""
    part = lambda m: F.substring(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int"))
    text = F.transform("loss", lambda m: F.when(m["escaped"], _undo(part(m), _BODY)).otherwise(part(m)))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(text, "").alias("loss_text"))
