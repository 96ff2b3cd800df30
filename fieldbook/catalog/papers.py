"""Document jobs. Every document's whole text is read; a few lines derived from its own columns are appended so that
the facts the checks look for occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.registry import query
from fieldbook.functions.register import label_by_rules, register_functions
from fieldbook.operators import agendas, ranking
from fieldbook.operators import documents as docs
from fieldbook.sources import markup, table, text_table

_UN = "lb/hr|lbs/hr|lb/hour|tons/year|tons/yr|ton/yr|tpy|lb/mmbtu|lbs/mmbtu|mmbtu/hour|mmbtu/hr|%|feet|ft|deg f|degf|acfm|scfm|dscfm|gpm"

_TEXT = """t AS (SELECT doc_id, lang, source, text || chr(10) || 'Total VOC ' || (95 + doc_id % 10) || '.5 tpy at ' || (doc_id % 120) ||
 ' % efficiency, stack height ' || (doc_id % 700) || ' ft' || chr(10) || 'Permit No. ' || CASE WHEN doc_id % 50 = 0 THEN '777-00936-00' ELSE
 '7777-0093' || (doc_id % 3) || '-00' END || ' AI No. ' || (41475 + doc_id % 2) || ' issued 01/' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ||
 '/2020' || chr(10) || 'Permit expires March ' || (doc_id % 28 + 1) || ', ' || (2018 + doc_id % 5) || chr(10) || 'Range 70%-99% rate 1.30E-0'
 || (doc_id % 9 + 1) || ' lb/hr' AS body FROM documents),
l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM t)"""

_FACTS = f"""{_TEXT},
h AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, '(?i)(?:^|[^%0-9.])(-?[0-9][0-9,]*\\.?[0-9]*(?:e[+-]?[0-9]+)?)\\s*({_UN})(?:\\W|$)', 1))
 AS n, unnest(regexp_extract_all(line, '(?i)(?:^|[^%0-9.])(-?[0-9][0-9,]*\\.?[0-9]*(?:e[+-]?[0-9]+)?)\\s*({_UN})(?:\\W|$)', 2)) AS u FROM l
 WHERE NOT starts_with(line, 'Range 70%')),
f AS (SELECT doc_id, line_no, line AS context, replace(n, ',', '')::DOUBLE AS value, CASE lower(u) WHEN 'tpy' THEN 'TPY' WHEN '%' THEN 'PERCENT'
 WHEN 'ft' THEN 'FT' WHEN 'lb/hr' THEN 'LB_HR' ELSE lower(u) END AS unit FROM h
 UNION ALL SELECT doc_id, line_no, line, v, u FROM l, (VALUES (70.0::DOUBLE, 'PERCENT'), (99.0, 'PERCENT')) x(v, u) WHERE starts_with(line, 'Range 70%')
 UNION ALL SELECT doc_id, line_no, line, ('1.30E-0' || (doc_id % 9 + 1))::DOUBLE, 'LB_HR' FROM l WHERE starts_with(line, 'Range 70%'))"""


def bodies(spark, d):
    k = F.col("doc_id")
    permit = F.when(k % 50 == 0, "777-00936-00").otherwise(F.concat(F.lit("7777-0093"), k % 3, F.lit("-00")))
    body = F.concat(
        F.col("text"), F.lit("\nTotal VOC "), k % 10 + 95, F.lit(".5 tpy at "), k % 120,
        F.lit(" % efficiency, stack height "), k % 700, F.lit(" ft\nPermit No. "), permit, F.lit(" AI No. "), k % 2 + 41475,
        F.lit(" issued 01/"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("/2020\nPermit expires March "), k % 28 + 1,
        F.lit(", "), k % 5 + 2018, F.lit("\nRange 70%-99% rate 1.30E-0"), k % 9 + 1, F.lit(" lb/hr"))
    return text_table(spark, d, "documents", "doc_id").select("doc_id", "lang", "source", body.alias("body"))


def lines(spark, d):
    return markup.text_lines(bodies(spark, d), ["doc_id"], "body")


def facts(spark, d):
    return docs.number_facts(lines(spark, d), ["doc_id", "line_no"])


@query("t1_number_facts", f"WITH {_FACTS} SELECT doc_id, line_no::BIGINT AS line_no, value, unit FROM f")
def t1(spark, d):
    return facts(spark, d).drop("context")


@query("t1_date_and_identifier_facts", f"""
WITH {_TEXT} SELECT doc_id, 'date:issuance' AS kind, '2020-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS value FROM t UNION ALL
SELECT doc_id, 'date:expiration', make_date(2018 + doc_id % 5, 3, doc_id % 28 + 1)::VARCHAR FROM t UNION ALL
SELECT doc_id, 'AI_NUMBER', (41475 + doc_id % 2)::VARCHAR FROM t UNION ALL
SELECT doc_id, 'PERMIT_NUMBER', '7777-0093' || (doc_id % 3) || '-00' FROM t WHERE doc_id % 50 <> 0""")
def t1_b(spark, d):
    ls = lines(spark, d)
    dated = docs.date_facts(ls, ["doc_id", "line_no"]).select("doc_id", F.concat(F.lit("date:"), "role").alias("kind"),
                                                               F.col("date").cast("string").alias("value"))
    ids = docs.identifier_facts(ls, ["doc_id", "line_no"]).select("doc_id", "kind", "value")
    return dated.unionByName(ids)


@query("t3_just_below_threshold", f"""
WITH {_FACTS} SELECT doc_id, value, th AS threshold FROM f, (SELECT unnest([100.0, 250.0, 10.0, 25.0])::DOUBLE AS th) WHERE unit = 'TPY' AND value < th
 AND (th - value) / th <= 0.02""")
def t3(spark, d):
    return docs.check_threshold(facts(spark, d)).select("doc_id", "value", "threshold")


@query("t4_plausibility", f"""
WITH {_FACTS} SELECT doc_id, value, unit, CASE WHEN unit IN ('LB_HR', 'TPY') AND value < 0 THEN 'RED' WHEN unit = 'PERCENT' AND
 contains(lower(context), 'efficiency') AND (value < 0 OR value > 100) THEN 'RED' WHEN unit = 'PERCENT' AND contains(lower(context), 'opacity') AND
 value > 100 THEN 'RED' WHEN unit = 'FT' AND contains(lower(context), 'height') AND (value < 5 OR value > 600) THEN 'WARN' END AS severity FROM f
WHERE severity IS NOT NULL""")
def t4(spark, d):
    return docs.check_plausibility(facts(spark, d)).select("doc_id", "value", "unit", "severity")


@query("t5_date_order", """
SELECT doc_id, 'issuance' AS earlier_role, 'expiration' AS later_role, DATE '2020-01-01' + (doc_id % 28)::INT AS earlier, make_date(2018 + doc_id % 5,
 3, doc_id % 28 + 1) AS later, 1::BIGINT AS pairs FROM documents WHERE make_date(2018 + doc_id % 5, 3, doc_id % 28 + 1) < DATE '2020-01-01' +
 (doc_id % 28)::INT""")
def t5(spark, d):
    return docs.check_date_order(docs.date_facts(lines(spark, d), ["doc_id", "line_no"]), ["doc_id"])


@query("t6_identifier_format", """
WITH i AS (SELECT doc_id, 'PERMIT' AS kind, CASE WHEN doc_id % 50 = 0 THEN '777-00936-00' ELSE '7777-0093' || (doc_id % 3) || '-00' END AS value FROM documents)
SELECT doc_id, kind, value, 10::BIGINT AS digits, 11::BIGINT AS majority FROM i WHERE doc_id % 50 = 0""")
def t6(spark, d):
    ids = docs.identifier_facts(lines(spark, d), ["doc_id"], patterns={"PERMIT": r"\b(\d{3,4}-\d{4,5}-\d{2})\b"})
    return ranking.odd_lengths(ids, "kind", "value").select("doc_id", "kind", "value", "digits", "majority")


@query("t7_cross_document_values", """
WITH i AS (SELECT doc_id, 'PERMIT' AS kind, CASE WHEN doc_id % 50 = 0 THEN '777-00936-00' ELSE '7777-0093' || (doc_id % 3) || '-00' END AS value FROM documents
 UNION ALL SELECT doc_id, 'AI', (41475 + doc_id % 2)::VARCHAR FROM documents), n AS (SELECT kind, value, count(DISTINCT doc_id) AS docs, min(doc_id) AS f
 FROM i GROUP BY 1, 2), m AS (SELECT kind, arg_max(value, (docs, -f, value)) AS majority, count(*) AS values, sum(docs)::BIGINT AS documents FROM n GROUP BY 1)
SELECT kind, majority, "values", documents, (SELECT bool_and(levenshtein(n.value, m.majority) <= 2) FROM n WHERE n.kind = m.kind) AS near_neighbours FROM m""")
def t7(spark, d):
    ids = docs.identifier_facts(lines(spark, d), ["doc_id"], patterns={
        "PERMIT": r"\b(\d{3,4}-\d{4,5}-\d{2})\b", "AI": r"\bAI No\. (\d{3,7})\b"})
    return docs.check_cross_document(ids, "doc_id")


_CELLS = """h AS (SELECT o_custkey AS doc, unnest([{'row': -1, 'col': 0, 'text': 'Pollutant (ton)'}, {'row': -1, 'col': 1, 'text': 'Rate LB/HR'},
  {'row': -1, 'col': 2, 'text': 'Limit TPY'}, {'row': -1, 'col': 3, 'text': 'lb/MMBtu'}, {'row': -1, 'col': 4, 'text': 'MMBtu/hr heat'}], recursive := true)
  FROM (SELECT DISTINCT o_custkey FROM orders)),
o AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 97 AS lb, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 1 END AS f, o_orderkey % 4 AS m,
  o_orderpriority AS p FROM orders),
v AS (SELECT *, CASE WHEN m = 2 THEN lb * 219 ELSE lb * 438 * f END AS cents FROM o),
r AS (SELECT doc, k AS row, CASE WHEN k % 40 = 7 THEN 'TOTAL emissions' ELSE p END AS label, CASE WHEN k % 13 = 0 THEN NULL ELSE lb::DOUBLE END AS LB_HR,
  CASE WHEN k % 17 = 0 THEN NULL ELSE (cents // 100 || '.' || lpad((cents % 100)::VARCHAR, 2, '0'))::DOUBLE END AS TPY, 2.0::DOUBLE AS LB_MMBTU,
  CASE WHEN k % 3 = 0 THEN (lb // 2)::DOUBLE ELSE (lb + 9)::DOUBLE END AS MMBTU_HR FROM v)"""


def cells(spark, d):
    """A table per customer, a row per order: rate, yearly limit, heat rate, heat input as cell texts."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    lb, m = k % 97, k % 4
    cents = F.when(m == 2, lb * 219).when(m == 1, lb * 876).otherwise(lb * 438)
    body = o.select(F.col("o_custkey").alias("doc"), k.alias("row"), F.array(
        F.when(k % 40 == 7, "TOTAL emissions").otherwise(F.col("o_orderpriority")),
        F.when(k % 13 == 0, " ").otherwise(lb.cast("string")),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.floor(cents / 100), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))),
        F.lit("2.0 lb"), F.when(k % 3 == 0, F.floor(lb / 2)).otherwise(lb + 9).cast("string")).alias("t"))
    head = o.select(F.col("o_custkey").alias("doc")).distinct().select("doc", F.lit(-1).cast("long").alias("row"), F.array(
        *[F.lit(x) for x in ("Pollutant (ton)", "Rate LB/HR", "Limit TPY", "lb/MMBtu", "MMBtu/hr heat")]).alias("t"))
    return body.unionByName(head).select("doc", "row", F.posexplode("t").alias("col", "text"))


_KW = {"lb/hr": "LB_HR", "tpy": "TPY", "ton": "TPY", "lb/mmbtu": "LB_MMBTU", "mmbtu/hr": "MMBTU_HR"}


def data_rows(spark, d):
    return docs.table_rows(cells(spark, d), ["doc"], _KW)


@query("t2_table_rows_from_cells", f"""WITH {_CELLS} SELECT doc, row, label, LB_HR AS "LB_HR", TPY AS "TPY", LB_MMBTU AS "LB_MMBTU", MMBTU_HR AS "MMBTU_HR" FROM r""")
def t2(spark, d):
    return data_rows(spark, d).select("doc", "row", "label", "LB_HR", "TPY", "LB_MMBTU", "MMBTU_HR")


@query("t8_rate_against_year", f"""WITH {_CELLS} SELECT doc, row, TPY AS "TPY", CASE WHEN TPY > LB_HR * 4.38 * 1.02 THEN 'RED' ELSE 'CONFIRM' END AS severity FROM r
WHERE LB_HR > 0 AND (TPY > LB_HR * 4.38 * 1.02 OR TPY < LB_HR * 4.38 * 0.95)""")
def t8(spark, d):
    return docs.check_rate_against_year(data_rows(spark, d)).select("doc", "row", "TPY", "severity")


@query("t9_heat_balance", f"""WITH {_CELLS} SELECT doc, row, LB_HR AS "LB_HR", LB_MMBTU * MMBTU_HR AS expected FROM r WHERE LB_HR <> 0 AND abs(LB_MMBTU *
 MMBTU_HR - LB_HR) / abs(LB_HR) > 0.05""")
def t9(spark, d):
    return docs.check_heat(data_rows(spark, d)).select("doc", "row", "LB_HR", "expected")


@query("t10_subtotal", f"""WITH {_CELLS}, g AS (SELECT doc, count(*) FILTER (contains(lower(label), 'total')) AS t, max(TPY) FILTER (contains(lower(label), 'total'))
 AS stated, sum(TPY) FILTER (NOT contains(lower(label), 'total')) AS parts FROM r GROUP BY 1)
SELECT doc, stated, round(parts, 4) AS parts_sum FROM g WHERE t = 1 AND abs(parts - stated) > greatest(0.005 * stated, 0.1)""")
def t10(spark, d):
    return docs.check_subtotal(data_rows(spark, d), ["doc"], "TPY").select("doc", "stated", F.round("parts_sum", 4).alias("parts_sum"))


@query("t11_magnitude", f"""WITH {_CELLS}, x AS (SELECT doc % 40 AS grp, row, label, TPY FROM r WHERE TPY > 0 AND NOT contains(lower(label), 'total')),
m AS (SELECT grp, label, median(TPY) AS med, count(*) AS n FROM x GROUP BY 1, 2)
SELECT row, TPY AS "TPY", round(med, 4) AS sibling_median FROM x JOIN m USING (grp, label) WHERE n >= 3 AND (TPY > med * 10 OR TPY < med * 0.1)""")
def t11(spark, d):
    r = data_rows(spark, d).where(~F.lower("label").contains("total")).withColumn("grp", F.col("doc") % 40)
    return ranking.sibling_outliers(r, ["grp", "label"], "TPY").select("row", "TPY", F.round("sibling_median", 4)
                                                                      .alias("sibling_median"))


@query("t11_zero_versus_blank", f"""WITH {_CELLS} SELECT doc, row, u AS unit FROM (SELECT doc, row, 'LB_HR' AS u FROM r WHERE LB_HR IS NULL UNION ALL SELECT doc, row,
 'TPY' FROM r WHERE TPY IS NULL)""")
def t11_b(spark, d):
    return docs.check_blank_cells(data_rows(spark, d), ["LB_HR", "TPY", "LB_MMBTU", "MMBTU_HR"]).select("doc", "row", "unit")


@query("t12_near_variant_tally", """
WITH k AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x,
 '^[,;:()\\[\\]"''.]+|[,;:()\\[\\]"''.]+$', '', 'g')), lambda x: length(x) BETWEEN 3 AND 7)) AS reading FROM documents),
n AS (SELECT *, levenshtein(regexp_replace(reading, '[^\\x00-\\x7F]', '#', 'g'), 'anthe') AS distance FROM k), p AS (SELECT * FROM n WHERE distance <= 2),
r AS (SELECT reading, distance, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM p GROUP BY 1, 2),
t AS (SELECT arg_min(reading, (-hits, distance, reading)) AS top FROM r)
SELECT reading, distance, hits, documents, reading = (SELECT top FROM t) AS majority, (SELECT bool_and(b) FROM (SELECT bool_or(reading = (SELECT top FROM t)) AS b
 FROM p GROUP BY doc_id)) AS minority_confined FROM r""")
def t12(spark, d):
    return docs.value_tally(text_table(spark, d, "documents", "doc_id"), "doc_id", "text", "anthe")


_BOX = """b AS (SELECT l_orderkey // 4 AS page, l_linenumber AS r, (l_suppkey % 10) * 100 + (l_partkey % 2) * 3.0::DOUBLE AS x0, CASE WHEN l_quantity > 40 THEN 500 ELSE 80
 END AS w, CASE WHEN l_returnflag = 'A' THEN 'abc' ELSE l_quantity::INT::VARCHAR END AS txt FROM lineitem),
rw AS (SELECT page, r, count(*) AS n, min(w) AS wmin, max(w) AS wmax, count(*) FILTER (txt <> 'abc') AS num FROM b GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY r) AS idx FROM rw),
base AS (SELECT page, sum(n)::BIGINT AS lines, count(*) AS rows, count(*) FILTER (n >= 2 AND wmin < 300) AS cell_rows, round(sum(num) / sum(n), 6) AS numeric_frac
 FROM rw GROUP BY 1),
cl AS (SELECT page, floor(x0 / 100) AS c, count(*) AS n FROM b JOIN rw USING (page, r) WHERE rw.n >= 2 AND wmin < 300 GROUP BY 1, 2),
co AS (SELECT page, count(*) FILTER (n >= 3) AS columns FROM cl GROUP BY 1),
hd AS (SELECT page, r, idx FROM rk WHERE n >= 4 AND wmax < 300),
hc AS (SELECT hd.page, hd.idx, b.x0, row_number() OVER (PARTITION BY hd.page, hd.idx ORDER BY b.x0) AS i FROM hd JOIN b ON b.page = hd.page AND b.r = hd.r),
al AS (SELECT hc.page, hc.idx, hc.i FROM hc JOIN rk ON rk.page = hc.page AND rk.idx BETWEEN hc.idx + 1 AND hc.idx + 6 JOIN b ON b.page = rk.page AND b.r = rk.r
 AND b.w < 300 AND abs(b.x0 - hc.x0) <= 20 WHERE hc.i > 1 GROUP BY 1, 2, 3),
hh AS (SELECT DISTINCT page FROM (SELECT page, idx FROM al GROUP BY 1, 2 HAVING count(*) >= 2)),
f AS (SELECT base.*, coalesce(columns, 0) AS columns, hh.page IS NOT NULL AS header_row FROM base LEFT JOIN co USING (page) LEFT JOIN hh ON hh.page = base.page),
pf AS (SELECT *, (cell_rows >= 4 AND columns >= 2) OR header_row AS tabular, ((cell_rows >= 4 AND columns >= 2) OR header_row) AND columns >= 3 AS strong FROM f)"""


def boxes(spark, d):
    li = table(spark, d, "lineitem")
    y = F.col("l_linenumber") * 40.0 + F.col("l_partkey") % 3
    x = (F.col("l_suppkey") % 10) * 100 + (F.col("l_partkey") % 2) * 3.0
    return li.select(F.floor(F.col("l_orderkey") / 4).alias("page"), (y - 10).alias("y0"), (y + 10).alias("y1"), x.alias("x0"), (x + F.when(
        F.col("l_quantity") > 40, 500).otherwise(80)).alias("x1"), F.when(F.col("l_returnflag") == "A", "abc").otherwise(
        F.col("l_quantity").cast("int").cast("string")).alias("text"))


@query("t13_page_layout_features", f"WITH {_BOX} SELECT * FROM pf")
def t13(spark, d):
    return docs.page_features(boxes(spark, d), ["page"], 1000.0).withColumn("numeric_frac", F.round("numeric_frac", 6))


@query("t13_pages_with_neighbours", f"""WITH {_BOX} SELECT page FROM pf WHERE page // 30 IN (SELECT page // 30 FROM pf p WHERE p.strong AND p.page BETWEEN pf.page - 1 AND
 pf.page + 1 AND p.page // 30 = pf.page // 30)""")
def t13_b(spark, d):
    f = docs.page_features(boxes(spark, d), ["page"], 1000.0).withColumn("doc", F.floor(F.col("page") / 30))
    return docs.with_neighbours(f, ["doc"], "page", "strong").select("page")


@query("t13_page_selection", f"""WITH {_BOX}, q AS (SELECT page // 30 AS doc, page, tabular FROM pf),
s AS (SELECT doc, page FROM q WHERE EXISTS (SELECT 1 FROM q o WHERE o.doc = q.doc AND o.tabular AND o.page BETWEEN q.page - 1 AND q.page + 1)),
r AS (SELECT *, page - row_number() OVER (PARTITION BY doc ORDER BY page) AS r FROM s),
i AS (SELECT doc, min(page) AS a, max(page) AS b, count(*) AS n FROM r GROUP BY doc, r),
x AS (SELECT doc, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec, sum(n)::BIGINT AS n FROM i GROUP BY 1),
t AS (SELECT doc, count(*) AS pages, count(*) FILTER (tabular) AS flagged FROM q GROUP BY 1)
SELECT t.doc, pages, flagged, coalesce(n, 0) AS selected, coalesce(spec, '') AS spec, CASE WHEN n IS NULL THEN 'none' WHEN n >= pages * 0.5 THEN
 'whole' ELSE 'pages' END AS advice FROM t LEFT JOIN x ON x.doc = t.doc""")
def t13_c(spark, d):
    f = docs.page_features(boxes(spark, d), ["page"], 1000.0).withColumn("doc", F.floor(F.col("page") / 30))
    return docs.page_selection(f, ["doc"], "page", "tabular")


@query("t14_reader_votes")
def t14(spark, d):
    """Two noisy readers against the printed lines of every page of every document (rows only)."""
    ls = markup.text_lines(text_table(spark, d, "documents", "doc_id", 4), ["doc_id"], "text").withColumn(
        "page", F.floor((F.col("line_no") - 1) / 20))
    n = F.col("line_no")
    one = ls.where(n % 7 != 0).select("doc_id", "page", F.lit("one").alias("reader"), n.alias("unit_no"), F.when(
        n % 5 == 0, F.regexp_replace("line", "e", "c")).otherwise(F.col("line")).alias("unit"))
    two = ls.where(n % 3 == 0).select("doc_id", "page", F.lit("two").alias("reader"), n.alias("unit_no"), F.col("line")
                                      .alias("unit"))
    return docs.reader_votes(ls, one.unionByName(two), ["doc_id", "page"], "reader")


@query("t15_elision_marks", """
SELECT doc_id, (1 + doc_id % 3)::BIGINT AS elisions FROM documents WHERE doc_id % 4 = 0""")
def t15(spark, d):
    k = F.col("doc_id")
    body = F.when(k % 4 == 0, F.concat("text", F.repeat(F.lit(" <!-- 12 rows omitted -->"), (k % 3 + 1).cast("int")))).otherwise(
        F.concat("text", F.lit(" <!-- page 3 -->")))
    return docs.elision_marks(text_table(spark, d, "documents", "doc_id").select("doc_id", body.alias("b")), ["doc_id"], "b")


@query("t16_category_tags", """
WITH c AS (SELECT * FROM (VALUES ('air', '(?i)(?:theand)|(?:inger)'), ('water', '(?i)(?:eaux)'), ('land', '(?i)(?: der )|(?: die )')) x(category, p))
SELECT doc_id, category, regexp_extract(text, p) AS match FROM documents, c WHERE regexp_matches(text, p)""")
def t16(spark, d):
    return docs.tag_items(text_table(spark, d, "documents", "doc_id"), ["doc_id"], "text", {
        "air": ["theand", "inger"], "water": ["eaux"], "land": [" der ", " die "]})


@query("t17_track_cases", """
WITH i AS (SELECT o_orderkey, 'Case 2024-' || (o_orderkey % 500) || '-CUP filed by ' || CASE WHEN o_orderkey % 3 = 0 THEN 'Delta Works' ELSE 'others' END AS t
 FROM orders), c AS (SELECT s_suppkey, '2024-' || s_suppkey || '-cup' AS k1, CASE WHEN s_suppkey % 20 = 0 THEN 'delta works' END AS k2 FROM supplier)
SELECT o_orderkey, s_suppkey, (contains(lower(t), k1)::INT + coalesce(contains(lower(t), k2), false)::INT)::BIGINT AS keys FROM i, c WHERE contains(lower(t), k1) OR
 coalesce(contains(lower(t), k2), false)""")
def t17(spark, d):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    items = table(spark, d, "orders").select(k, F.concat(F.lit("Case 2024-"), k % 500, F.lit("-CUP filed by "), F.when(
        k % 3 == 0, "Delta Works").otherwise("others")).alias("t"))
    cases = table(spark, d, "supplier").select(s, F.concat(F.lit("rezoning 2024-"), s, F.lit("-CUP"), F.when(
        s % 20 == 0, " for Delta Works, LLC").otherwise("")).alias("title"))
    return docs.track_cases(items, "o_orderkey", "t", cases, "s_suppkey", "title")


@query("t18_docket_fields", """
SELECT o_orderkey, 'L' || lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || '-' || lpad((o_orderkey % 900)::VARCHAR, 3, '0') AS docket, CASE WHEN o_orderkey % 4 <> 3
 THEN (1 + o_orderkey % 70) * 1000000 END::BIGINT AS par_amount, CASE WHEN o_orderkey % 4 <> 3 THEN 'Revenue Bonds' END AS bond_type, CASE WHEN o_orderkey % 2 = 0 THEN
 '75' ELSE '' END AS other_amounts, o_orderkey % 5 = 0 AS volume_cap FROM orders""")
def t18(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("L"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 900).cast("string"), 3, "0"),
        F.lit(" - Some Parish School Board - "), F.when(k % 4 != 3, F.concat(F.lit("Not exceeding $"), k % 70 + 1, F.lit(
            ",000,000 Revenue Bonds, not exceeding 6%"))).otherwise("Amendment"),
        F.when(k % 2 == 0, " and a service charge of $75").otherwise(""), F.when(k % 5 == 0, ", from the Volume Cap").otherwise(""))
    f = docs.docket_fields(table(spark, d, "orders").select(k, body.alias("b")), ["o_orderkey"], "b")
    return f.withColumn("other_amounts", F.array_join(F.transform("other_amounts", lambda v: v.cast("string")), ","))


@query("t21_citation_against_record", """
WITH r AS (SELECT s_suppkey AS docket, 100 + s_suppkey % 80 || ' So. 3d 1' AS reporter, 'Party ' || s_suppkey % 90 AS caption, 2000 + s_suppkey % 20 AS year,
 s_suppkey % 5 AS circuit FROM supplier),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 100 + c_custkey % 95 || ' So. 3d 1' END AS reporter, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 130 END AS
 docket, 'Party ' || c_custkey % 120 AS caption, 2000 + c_custkey % 20 AS year, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_custkey % 5 END AS circuit FROM customer),
g0 AS (SELECT reporter AS k, count(*) AS n, min((docket, year, circuit, reporter)) AS o FROM r GROUP BY 1), g1 AS (SELECT docket AS k, count(DISTINCT docket) AS n,
 min((docket, year, circuit, reporter)) AS o FROM r GROUP BY 1), g2 AS (SELECT caption AS k, count(*) AS n, min((docket, year, circuit, reporter)) AS o FROM r GROUP BY 1),
j AS (SELECT c.*, CASE WHEN g0.n > 0 THEN 'reporter citation' WHEN g1.n > 0 THEN 'docket' WHEN g2.n > 0 THEN 'caption' END AS how, coalesce(g0.n, g1.n, g2.n, 0) AS n,
 coalesce(g0.o, g1.o, g2.o) AS o FROM c LEFT JOIN g0 ON g0.k = c.reporter LEFT JOIN g1 ON g1.k = c.docket LEFT JOIN g2 ON g2.k = c.caption),
x AS (SELECT *, concat_ws(',', CASE WHEN year <> o[2] THEN 'year' END, CASE WHEN circuit <> o[3] THEN 'court' END, CASE WHEN reporter <> o[4] THEN 'reporter' END) AS cf,
 n = 1 OR how = 'docket' AS alone FROM j)
SELECT c_custkey, how AS matched_by, n AS matches, CASE WHEN n = 0 THEN 'not found' WHEN NOT alone THEN 'ambiguous' WHEN cf <> '' THEN 'conflicting' ELSE 'found' END AS
 status, CASE WHEN alone THEN cf ELSE '' END AS conflicts FROM x""")
def t21(spark, d):
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    rep = lambda n: F.concat((n + 100).cast("string"), F.lit(" So. 3d 1"))
    r = table(spark, d, "supplier").select(s.alias("docket"), rep(s % 80).alias("reporter"), F.concat(F.lit("Party "), s % 90).alias(
        "caption"), (s % 20 + 2000).alias("year"), (s % 5).alias("circuit"))
    cl = table(spark, d, "customer").select(
        c, F.when(c % 3 == 0, rep(c % 95)).alias("reporter"), F.when(c % 2 == 0, c % 130).alias("docket"), F.concat(
            F.lit("Party "), c % 120).alias("caption"), (c % 20 + 2000).alias("year"), F.when(c % 4 != 0, c % 5).alias("circuit"))
    return docs.verify_citations(cl, r, "c_custkey", "reporter", "docket", "caption", "year", "circuit")


@query("t23_phrase_history", """
WITH v AS (SELECT source, doc_id, len(regexp_extract_all(text, '(?i)the')) AS n FROM documents)
SELECT source, count(*) AS versions, count(*) FILTER (n > 0) AS with_phrase, min(doc_id) FILTER (n > 0) AS first_seen, max(doc_id) FILTER (n > 0) AS last_seen,
 sum(n)::BIGINT AS matches FROM v GROUP BY 1""")
def t23(spark, d):
    return docs.phrase_history(text_table(spark, d, "documents", "doc_id"), ["source"], "doc_id", "text", "the")


@query("t24_term_search_by_page", """
WITH p AS (SELECT doc_id, length(trim(text, chr(32))) < 200 AS short, unnest(string_split(replace(text, chr(10), chr(12)), chr(12))) AS t, generate_subscripts(string_split(
 replace(text, chr(10), chr(12)), chr(12)), 1) AS page FROM documents)
SELECT doc_id, CASE WHEN short THEN 'needs OCR' ELSE 'searched' END AS status, page::BIGINT AS page, CASE WHEN NOT short THEN len(regexp_extract_all(t, '(?i)tion|eaux'))
 END::BIGINT AS hits FROM p WHERE short OR len(regexp_extract_all(t, '(?i)tion|eaux')) > 0""")
def t24(spark, d):
    dd = text_table(spark, d, "documents", "doc_id").select("doc_id", F.regexp_replace("text", "\n", "\f").alias("t"))
    return docs.term_search(dd, "doc_id", "t", ["tion", "eaux"])


@query("t25_notice_fields", """
SELECT o_orderkey, '$' || (o_orderkey % 90 + 1) || ',000,000' AS amount, 'on May ' || (o_orderkey % 28 + 1) || ', 2026 at 10 a.m.' AS hearing, CASE WHEN o_orderkey % 2 = 0 THEN
 'River Delta Plant, LLC' END AS borrower, 'Port ' || o_orderkey % 50 AS location, CASE WHEN o_orderkey % 9 = 0 THEN
 'Persons may submit their views in writing to Ms. Jane Doe at the Authority.' WHEN o_orderkey % 3 = 0 THEN
 'Persons may submit their views in writing to the Authority.' END AS written_comments FROM orders""")
def t25(spark, d):
    k = F.col("o_orderkey")
    body = F.concat(
        F.lit("The Authority will hold a public hearing on May "), k % 28 + 1, F.lit(", 2026 at 10 a.m.\n with respect to bonds not to exceed $"),
        k % 90 + 1, F.lit(",000,000 for a plant (the \"Project\") located at Port "), k % 50, F.lit("; and more. "), F.when(
            k % 2 == 0, "The proceeds are loaned by the Authority to River Delta  Plant, LLC (the \"Company\"). ").otherwise(""),
        F.when(k % 9 == 0, "Persons may submit their views in writing to Ms. Jane Doe at the Authority. All are heard.").when(
            k % 3 == 0, "Persons may submit their views in writing to the Authority.").otherwise(""))
    return docs.notice_fields(table(spark, d, "orders").select(k, body.alias("b")), ["o_orderkey"], "b")


@query("w23_passages_of_matching_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, n, n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS gap FROM l WHERE regexp_matches(line, '\\b[Tt]he\\b')),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS p FROM h),
g AS (SELECT doc_id, p, min(n) AS a, max(n) AS b, count(*) AS hits FROM i GROUP BY 1, 2)
SELECT doc_id, p::BIGINT AS passage, a AS first_line, b AS last_line, hits, (SELECT string_agg(trim(line, chr(32)), ' ' ORDER BY n) FROM l WHERE l.doc_id = g.doc_id AND
 n BETWEEN a - 1 AND b + 1 AND trim(line, chr(32)) <> '') AS context FROM g""")
def w23(spark, d):
    ls = markup.text_lines(text_table(spark, d, "documents", "doc_id"), ["doc_id"], "text")
    return docs.passages(ls, ["doc_id"], r"\b[Tt]he\b")


@query("w18_agenda_items", """
WITH a AS (SELECT o_orderkey FROM orders)
SELECT o_orderkey, n.i::BIGINT AS item_no, n.num AS number, n.title, n.sec AS section FROM a, LATERAL (SELECT unnest([
 {'i': 0, 'num': '1', 'title': 'Call to order ' || o_orderkey, 'sec': 'PUBLIC HEARINGS'}, {'i': 1, 'num': '2', 'title': 'Permit of J. Smith wrapped over', 'sec': 'PUBLIC HEARINGS'},
 {'i': 2, 'num': '2.a', 'title': 'first part', 'sec': 'PUBLIC HEARINGS'}, {'i': 3, 'num': '2.b', 'title': 'second part', 'sec': 'PUBLIC HEARINGS'},
 {'i': 4, 'num': '3', 'title': 'Adjourn', 'sec': 'PUBLIC HEARINGS'}, {'i': 5, 'num': '1', 'title': 'Minutes', 'sec': 'CONSENT AGENDA'}], recursive := true)) n(i, num, title, sec)""")
def w18(spark, d):
    k = F.col("o_orderkey")
    return agendas.agenda_items(table(spark, d, "orders").select(k, _agenda_text(k).alias("b")), ["o_orderkey"], "b")


def _agenda_text(k):
    return F.concat(F.lit("II. PUBLIC HEARINGS\n1. Call to order "), k, F.lit(
        "\n2. Permit of\nJ. Smith wrapped\nover\n   a) first part\n   b) second part\n3. Adjourn\nCONSENT AGENDA\n1. Minutes\n"))


@query("w18_nested_agenda_pieces", """
SELECT o_orderkey, n.i::BIGINT AS item_no, n.num AS number, n.title, n.sec AS section FROM orders, LATERAL (SELECT unnest([
 {'i': 0, 'num': '4', 'title': 'Ordinances', 'sec': 'OLD BUSINESS'}, {'i': 1, 'num': '4.a', 'title': 'Lot ' || o_orderkey || ' AN ORDINANCE TO REZONE', 'sec': 'OLD BUSINESS'},
 {'i': 2, 'num': '4.a.1', 'title': 'drainage of C. Roe', 'sec': 'OLD BUSINESS'}, {'i': 3, 'num': '4.a.2', 'title': 'access', 'sec': 'OLD BUSINESS'},
 {'i': 4, 'num': '4.b', 'title': 'Lot two', 'sec': 'OLD BUSINESS'}, {'i': 5, 'num': '5', 'title': 'Budget', 'sec': 'OLD BUSINESS'},
 {'i': 6, 'num': 'L' || (10 + o_orderkey % 90) || '-012', 'title': 'School board, not exceeding $5', 'sec': 'NEW BUSINESS'},
 {'i': 7, 'num': 'L' || (10 + o_orderkey % 90) || '-012.a', 'title': 'fees', 'sec': 'NEW BUSINESS'}], recursive := true)) n(i, num, title, sec)""")
def w18_b(spark, d):
    """Three levels, an initial, capitals that hang below an item, docket numbers as starts."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("OLD BUSINESS\n4. Ordinances\n\ta) Lot "), k, F.lit(
        "\n\t\t AN ORDINANCE TO REZONE\n\t    1. drainage of\n\t       C. Roe\n\t    2. access\n\tb) Lot two\n5. Budget\n\nNEW BUSINESS\nL"),
        k % 90 + 10, F.lit("-012 - School board,\nnot exceeding $5\n   a. fees"))
    return agendas.agenda_items(table(spark, d, "orders").select(k, body.alias("b")), ["o_orderkey"], "b")


@query("w18_minutes_paragraphs", """
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, list_concat(['CALL TO ORDER'], string_split(text, chr(10)), ['',
 'II. REPORTS', 'Page 3', '', 'RESOLUTION 7', 'That the report on document ' || doc_id, 'be received and filed.']) AS ls FROM documents)),
k AS (SELECT *, CASE WHEN NOT regexp_matches(line, '[a-z]') THEN trim(regexp_extract(line, '^\\s*(?:[IVX]{1,5}[.,]?\\s+)?([A-Z][A-Z0-9 .,&''/()-]{4,})\\s*$', 1)) ELSE '' END AS h FROM l),
m AS (SELECT *, h <> '' AND length(h) <= 50 AND NOT regexp_matches(h, '^(RESOLUTION|ORDINANCE)\\b') AS head, regexp_matches(line, '^\\s*$') AS blank FROM k),
g AS (SELECT *, sum((head OR blank)::INT) OVER w AS run, last_value(CASE WHEN head THEN h END IGNORE NULLS) OVER w AS section FROM m
 WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
p AS (SELECT doc_id, run, any_value(section) AS section, trim(regexp_replace(string_agg(line, ' ' ORDER BY n), '\\s+', ' ', 'g')) AS paragraph FROM g WHERE NOT head AND NOT blank GROUP BY 1, 2)
SELECT doc_id, 'p' || row_number() OVER (PARTITION BY doc_id ORDER BY run) AS para, paragraph, section FROM p WHERE length(paragraph) >= 40""")
def w18_c(spark, d):
    """Whole documents as the minutes of a meeting."""
    body = F.concat(F.lit("CALL TO ORDER\n"), "text", F.lit(
        "\n\nII. REPORTS\nPage 3\n\nRESOLUTION 7\nThat the report on document "), "doc_id", F.lit("\nbe received and filed."))
    return agendas.minutes_paragraphs(text_table(spark, d, "documents", "doc_id").select("doc_id", body.alias("b")), ["doc_id"], "b")


@query("u1_rules_from_a_table", """
WITH r AS (SELECT n_nationkey AS o, '(?i)' || substr(n_name, 1, 3) AS p, r_name || ' ' || n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT doc_id, coalesce(arg_min(label, o), 'none') AS topic FROM documents LEFT JOIN r ON regexp_matches(text, p) GROUP BY 1""")
def u1_b(spark, d):
    """Documents by the first rule of a table that occurs in them; the rules are rows that come from a join."""
    rules = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("o"), F.concat(F.lit("(?i)"), F.substring("n_name", 1, 3)).alias("p"),
        F.concat_ws(" ", "r_name", "n_name").alias("label"))
    return label_by_rules(text_table(spark, d, "documents", "doc_id").select("doc_id", "text"), "text", rules, "o", "p", "label",
                          "topic", "none").drop("text")


@query("u1_segmenter_as_table_function", """
SELECT o_orderkey, count(*) AS items, count(*) FILTER (n = 2) AS nested FROM orders, LATERAL (SELECT unnest([1, 1, 2, 2, 1, 1]) AS n) GROUP BY 1""")
def u1(spark, d):
    """The agenda segmenter called from SQL as a table function."""
    register_functions(spark)
    k = F.col("o_orderkey")
    table(spark, d, "orders").select(k, _agenda_text(k).alias("body")).createOrReplaceTempView("fieldbook_agendas")
    return spark.sql("""SELECT o_orderkey, count(*) AS items, count_if(instr(number, '.') > 0) AS nested
                        FROM fieldbook_agendas, LATERAL agenda_items(body) GROUP BY o_orderkey""")


@query("t16_meetings_without_agenda", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def t16_b(spark, d):
    m = table(spark, d, "orders").select("o_orderkey")
    return m.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("w11_page_versions_by_digest", """
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pv FROM conversations)
SELECT conv_id, turn FROM p WHERE pv IS NULL OR pv <> text""")
def w11_b(spark, d):
    from fieldbook.operators import temporal
    return temporal.drop_repeats(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text").select(
        "conv_id", "turn")
