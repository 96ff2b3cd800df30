"""Agenda and minutes texts to numbered items and to paragraphs, inside the row that holds the text (no shuffle, no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rule rows: what a line may be, with the label and the text as groups. An item whose letter continues no open list is
# no item and is looked at again by the rows below it.
LINE_RULES = {
    "item": r"^\s*(\d{1,2}|[a-zA-Z])[.)]\s+(\S.*)$",
    "docket": r"^\s*([A-Z]{1,2}\d{2}-\d{3}[A-Z]?)\s+-\s+(\S.*)$",
    "section": r"^\s*(?=[^a-z]*$)(?:[IVX]{1,5}[.,]?\s+)?([A-Z][A-Z0-9 .,&'/()-]{4,})\s*$",
}
HANGING = 2         # columns: a line further right than this hangs below what is open
LONGEST_HEADING = 50  # of minutes; longer capitals are a title, which is text
SHORTEST_PARAGRAPH = 40

_LINE = """named_struct(
  'at', i, 'indent', length(regexp_replace(regexp_extract(l, r"^\\s*", 0), r" {8}| {0,7}\\t", '        ')),
  'label', regexp_extract(l, r"<item>", 1), 'text', regexp_extract(l, r"<item>", 2),
  'docket', regexp_extract(l, r"<docket>", 1), 'rest', regexp_extract(l, r"<docket>", 2),
  'heading', trim(regexp_extract(l, r"<section>", 1)))"""

# One open entry for each level. ``ord`` counts within a list: the number, or the code of the letter.
_ENTRY = """named_struct('indent', x.indent, 'kind', CASE WHEN x.docket <> '' THEN 'd' WHEN x.label RLIKE '^[0-9]' THEN '1' ELSE 'a' END,
  'ord', CASE WHEN x.label RLIKE '^[0-9]' THEN CAST(x.label AS INT) ELSE ascii(x.label) END,
  'label', if(x.docket <> '', x.docket, x.label))"""

# Levels at which the new entry may stand: in place of its predecessor (of several, the one nearest in columns, then the
# deepest), or right below the nearest entry that is further left, or that is level with it and of another kind when the
# new one begins a list.
_LEVELS = """named_struct(
  'instead', coalesce(-array_min(filter(transform(acc.now.open, (o, k) -> if(o.kind = e.kind AND o.ord = e.ord - 1,
     named_struct('off', abs(o.indent - e.indent), 'up', -k), NULL)), s -> s IS NOT NULL)).up, -1),
  'below', coalesce(array_max(transform(acc.now.open, (o, k) -> if(o.indent < e.indent - <hang> OR (
     abs(o.indent - e.indent) <= <hang> AND o.kind <> e.kind AND e.label IN ('1', 'a', 'A')), k, -1))), -1))"""

# What a line makes of the state. Only the small state is bound to names, since binding copies; its mark joins the list of
# marks one step later.
_STEP = """element_at(transform(array(<entry>), e -> element_at(transform(array(<levels>), v -> CASE
  WHEN e.kind = 'd' OR (x.label <> '' AND (e.kind = '1' OR e.label IN ('a', 'A') OR v.instead >= 0)) THEN
    element_at(transform(array(concat(slice(acc.now.open, 1, CASE WHEN e.kind = 'd' THEN 0 WHEN v.instead >= 0 THEN v.instead
        ELSE v.below + 1 END), array(e))), path -> named_struct('open', path, 'section', acc.now.section, 'edge', x.indent,
      'mark', named_struct('at', x.at, 'number', array_join(transform(path, o -> o.label), '.'),
        'section', acc.now.section, 'text', if(e.kind = 'd', x.rest, x.text)))), 1)
  WHEN x.heading <> '' AND (acc.now.edge IS NULL OR x.indent <= acc.now.edge + <hang>) THEN
    named_struct('open', slice(acc.now.open, 1, 0), 'section', x.heading, 'edge', CAST(NULL AS INT),
      'mark', named_struct('at', x.at, 'number', CAST(NULL AS STRING), 'section', x.heading, 'text', ''))
  ELSE named_struct('open', acc.now.open, 'section', acc.now.section, 'edge', acc.now.edge, 'mark', CAST(NULL AS <mark>))
  END), 1)), 1)"""

_GROWN = "if(acc.now.mark IS NULL, acc.marks, concat(acc.marks, array(acc.now.mark)))"
_MARK = "struct<at:int,number:string,section:string,text:string>"
_ZERO = """named_struct('now', named_struct('open', CAST(array() AS array<struct<indent:int,kind:string,ord:int,label:string>>),
  'section', '', 'edge', CAST(NULL AS INT), 'mark', CAST(NULL AS <mark>)), 'marks', CAST(array() AS array<<mark>>))"""

# An item's text runs on to the line before the next mark.
_ITEMS = r"""element_at(transform(array(split(<body>, r"\R")), ls -> element_at(transform(array(aggregate(
  filter(transform(ls, (l, i) -> <line>), x -> x.label <> '' OR x.docket <> '' OR x.heading <> ''),
  <zero>, (acc, x) -> named_struct('now', <step>, 'marks', <grown>), acc -> <grown>)), marks ->
  filter(transform(marks, (m, j) -> named_struct('number', m.number, 'title', trim(regexp_replace(concat_ws(' ', m.text,
    array_join(slice(ls, m.at + 2, coalesce(try_element_at(marks, j + 2).at, size(ls)) - m.at - 1), ' ')), r"(?U)\s+", ' ')),
    'section', m.section)), it -> it.number IS NOT NULL)), 1)), 1)"""


def items_sql(body: str) -> str:
    """SQL expression: an agenda text to an array of (number, title, section)."""
    out = _ITEMS
    for name, part in (("step", _STEP), ("entry", _ENTRY), ("levels", _LEVELS), ("line", _LINE), ("zero", _ZERO),
                       ("grown", _GROWN), ("mark", _MARK), ("hang", str(HANGING)), *LINE_RULES.items(), ("body", body)):
        out = out.replace(f"<{name}>", part)
    return out


def agenda_items(docs: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """(keep, item_no, number, title, section): agenda texts to items with nested numbers ("7.a.4").

    A label takes the place of the open one that it continues (of several, the one nearest in columns); another one stands below the nearest open entry that is
    further left (two columns are level), or level and of another kind where it begins a list. A letter other than the
    first counts only where it continues a list, so that initials stay text. A docket number starts an item of its own, a
    line of capitals a section, unless it hangs to the right of the open item, whose text it then is. A null or empty text
    has no items.
    """
    return docs.select(*keep, F.posexplode(F.expr(items_sql(f"`{body}`"))).alias("item_no", "i")).select(
        *keep, "item_no", "i.number", "i.title", "i.section")


def minutes_paragraphs(docs: DataFrame, keep: Sequence[str], body: str) -> DataFrame:
    """(keep, para, paragraph, section): prose minutes to their paragraphs, ``p1`` on, under the heading above them.

    Blank lines and headings end a paragraph; runs of under 40 characters (page numbers, stamps) are none. Capitals that are
    long or begin with RESOLUTION or ORDINANCE are the title of what follows and stay text. A null text has no paragraphs.
    """
    marked = F.transform(F.split(F.translate(body, "\x01", ""), r"\R"), _heading_line)
    pieces = F.split(F.array_join(marked, "\n"), "\x01")

    def paragraphs(piece, i):
        section = F.when(i == 0, F.lit("")).otherwise(F.substring_index(piece, "\n", 1))
        rest = F.when(i == 0, piece).otherwise(F.regexp_replace(piece, r"\A[^\n]*\n?", ""))
        runs = F.transform(F.split(rest, r"\n(?:[^\S\n]*\n)+"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
        return F.transform(F.filter(runs, lambda p: F.length(p) >= SHORTEST_PARAGRAPH),
                           lambda p: F.struct(p.alias("paragraph"), section.alias("section")))
    return docs.select(*keep, F.posexplode(F.flatten(F.transform(pieces, paragraphs))).alias("n", "p")).select(
        *keep, F.concat(F.lit("p"), F.col("n") + 1).alias("para"), "p.paragraph", "p.section")


def _heading_line(line):
    """The line itself, or its heading between marks."""
    head = F.trim(F.regexp_extract(line, LINE_RULES["section"], 1))
    is_head = (head != "") & (F.length(head) <= LONGEST_HEADING) & ~head.rlike(r"^(?:RESOLUTION|ORDINANCE)\b")
    return F.when(is_head, F.concat(F.lit("\x01"), head)).otherwise(line)
