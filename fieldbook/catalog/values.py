"""Predicates, value rules and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldbook.catalog.registry import query
from fieldbook.functions import dates, keys, text, units, values
from fieldbook.operators import lookup
from fieldbook.sources import table, text_table


def sql_fold(c):
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def sql_words(c):
    return f"list_filter(string_split({sql_fold(c)}, ' '), lambda x: x <> '')"


@query("p1_sentinel_to_null", """
SELECT c_custkey, CASE WHEN c_custkey % 10 IN (0, 1, 2) THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def p1(spark, d):
    k = F.col("c_custkey") % 10
    raw = F.when(k == 0, "-999").when(k == 1, " ").when(k == 2, "0").otherwise(F.col("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", values.sentinel_null(raw, [-999], True).alias("balance"))


@query("p2_coded_values", """
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN NULL WHEN p_partkey % 5 = 2 THEN 1234.0::DOUBLE ELSE 0.0 END AS value,
 CASE p_partkey % 5 WHEN 0 THEN 'confidential' WHEN 1 THEN 'withheld' WHEN 4 THEN 'not reported' ELSE 'value' END AS status
FROM part""")
def p2(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "CBI").when(k == 1, "w").when(k == 2, "1,234").when(k == 3, "0").otherwise("")
    v, s = values.number_or_status(raw, {"CBI": "confidential", "W": "withheld"})
    return table(spark, d, "part").select("p_partkey", v.alias("value"), s.alias("status"))


@query("p3_zero_only_when_filed", """
SELECT event_id, CASE WHEN k % 5 <> 0 THEN (k % 5)::DOUBLE WHEN event_type IN ('error', 'view') THEN NULL ELSE 0.0 END
 AS jobs FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def p3(spark, d):
    e = table(spark, d, "events")
    statuses = F.when(F.col("event_type") == "error", F.array(F.lit("migrator"))).when(
        F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(F.array(F.lit("user")))
    e = e.withColumn("st", statuses).withColumn("k", values.nested("props", "k").cast("int") % 5)
    return e.select("event_id", values.trusted_number("k", F.size("st") > 0, F.exists("st", lambda s: s == "migrator"))
                    .alias("jobs"))


@query("p4_optional_predicates", """
SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND upper(c_mktsegment) = 'BUILDING'
 AND contains(lower(c_name), '00')""")
def p4(spark, d):
    given = {"nation": 7, "segment": "building", "name": "00", "min_balance": None}
    c = table(spark, d, "customer")
    cond = values.all_given([
        F.col("c_nationkey") == given["nation"] if given["nation"] is not None else None,
        F.upper("c_mktsegment") == given["segment"].upper() if given["segment"] else None,
        F.lower("c_name").contains(given["name"].lower()) if given["name"] else None,
        F.col("c_acctbal") >= given["min_balance"] if given["min_balance"] is not None else None])
    return c.where(cond).select("c_custkey", "c_name")


@query("p5_whole_word_containment", f"""
SELECT doc_id, list_has_all({sql_words('text')}, ['the', 'and', 'of']) AS has_all,
 list_has_all({sql_words('text')}, ['the', 'for']) OR list_has_all({sql_words('text')}, ['der']) AS has_alias
FROM documents""")
def p5(spark, d):
    return text_table(spark, d, "documents", "doc_id").select(
        "doc_id", keys.has_words(F.lit("The AND of"), "text").alias("has_all"),
        keys.has_any_alias("the for|der", "text").alias("has_alias"))


@query("p6_keep_open_rows", """
SELECT o_orderkey, o_orderdate::DATE AS begin, o_orderstatus FROM orders
WHERE o_orderdate >= DATE '2000-01-01' OR o_orderstatus = 'O'""")
def p6(spark, d):
    return table(spark, d, "orders").where(
        (F.col("o_orderdate") >= F.lit("2000-01-01").cast("date")) | F.col("o_orderstatus").isin("O")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("begin"), "o_orderstatus")


@query("p9_first_match_category", """
SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'promotion' WHEN contains(upper(p_name), 'RING') THEN 'ring'
 WHEN contains(upper(p_name), 'BOLT') AND p_type <> 'SMALL' THEN 'fastener' WHEN p_size > 40 THEN 'bulky' ELSE 'other' END
 AS category FROM part""")
def p9(spark, d):
    nm = F.upper("p_name")
    return table(spark, d, "part").select("p_partkey", values.first_match([
        (F.col("p_type") == "PROMO", "promotion"), (nm.contains("RING"), "ring"),
        (nm.contains("BOLT") & (F.col("p_type") != "SMALL"), "fastener"), (F.col("p_size") > 40, "bulky")], "other")
        .alias("category"))


_RES_Q = """SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1
 THEN substr(split_part(p_name, ' ', 2), 1, 3) ELSE p_name || ' zz' END AS q FROM part"""


@query("p10_exact_resolution_with_candidates", f"""
WITH q AS ({_RES_Q}), v AS (SELECT DISTINCT p_name AS v FROM part),
e AS (SELECT q, min(v) AS match FROM q LEFT JOIN v ON {sql_fold('q')} = {sql_fold('v')} GROUP BY 1),
c AS (SELECT q, count(*) AS n, min(v) AS f FROM e, v WHERE match IS NULL
  AND len(list_filter({sql_words('q')}, lambda w: NOT contains({sql_fold('v')}, w))) = 0 GROUP BY 1)
SELECT e.q, match, coalesce(n, 0) AS candidates, f AS first_candidate, CASE WHEN match IS NOT NULL THEN 'exact'
 WHEN n > 0 THEN 'candidates' ELSE 'nothing similar' END AS status FROM e LEFT JOIN c USING (q)""")
def p10(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    q = p.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.substring(F.split("p_name", " ")[1], 1, 3))
                 .otherwise(F.concat("p_name", F.lit(" zz"))).alias("q")).distinct()
    return lookup.resolve_exact(q, p.select(F.col("p_name").alias("v")), "q", "v")


@query("p10_ordered_candidates", f"""
WITH q AS ({_RES_Q} UNION ALL SELECT NULL), v AS (SELECT DISTINCT p_name AS v FROM part UNION ALL SELECT DISTINCT upper(p_name) FROM part
 WHERE p_partkey % 7 = 0),
e AS (SELECT q, count(v) AS n FROM q LEFT JOIN v ON {sql_fold('q')} = {sql_fold('v')} GROUP BY 1),
x AS (SELECT q, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS status, v, n AS hits FROM e JOIN v ON {sql_fold('q')} = {sql_fold('v')} WHERE n > 0),
c AS (SELECT q, 'candidates' AS status, v, count(*) OVER (PARTITION BY q) AS hits FROM e, v WHERE n = 0
  AND len(list_filter({sql_words('q')}, lambda w: NOT contains({sql_fold('v')}, w))) = 0)
SELECT q, status, row_number() OVER (PARTITION BY q ORDER BY length(v), v) AS rank, v, hits FROM (FROM x UNION ALL FROM c)
QUALIFY rank <= 12
UNION ALL SELECT q, 'nothing similar', NULL, NULL, 0 FROM e WHERE n = 0 AND NOT EXISTS (SELECT 1 FROM c WHERE c.q = e.q)""")
def p10_b(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey") % 3
    q = p.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.substring(F.split("p_name", " ")[1], 1, 3))
                 .otherwise(F.concat("p_name", F.lit(" zz"))).alias("q")).distinct()
    q = q.unionByName(p.limit(1).select(F.lit(None).cast("string").alias("q")))
    v = p.select(F.col("p_name").alias("v")).unionByName(p.where("p_partkey % 7 = 0").select(F.upper("p_name").alias("v")))
    return lookup.resolve_candidates(q, v, "q", "v")


@query("p11_privacy_projection", """
WITH g AS (SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment, sum(c_acctbal) AS v, count(*) AS people FROM customer
 GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, people, CASE WHEN v = 0 THEN 0 ELSE round_even(v * pow(10, 1 - floor(log10(abs(v)))), 0)
 / pow(10, 1 - floor(log10(abs(v)))) END AS balance FROM g""")
def p11(spark, d):
    g = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.sum("c_acctbal").alias("v"), F.count(F.lit(1)).alias("people"))
    return g.select("c_nationkey", "c_mktsegment", "people", values.two_figures("v").alias("balance"))


@query("p12_vintage_and_provenance", """
SELECT o_orderstatus, count(*) AS orders, 'orders table' AS source, (SELECT max(o_orderdate)::DATE FROM orders)
 AS data_through FROM orders GROUP BY 1""")
def p12(spark, d):
    o = table(spark, d, "orders")
    through = o.agg(F.to_date(F.max("o_orderdate")).alias("m")).select("m").scalar()
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders")).select(
        "o_orderstatus", "orders", F.lit("orders table").alias("source"), through.alias("data_through"))


@query("p13_range_prefix_like_filters", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
 AND o_orderpriority LIKE '1-%' AND o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('F', 'O')""")
def p13(spark, d):
    return table(spark, d, "orders").where(
        F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))
        & F.col("o_orderpriority").like("1-%") & F.col("o_totalprice").between(100000, 300000)
        & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_totalprice")


@query("p14_population_predicate", """
SELECT s_suppkey, (s_suppkey % 4)::BIGINT AS air_ids FROM supplier WHERE s_suppkey = 12 OR s_suppkey % 4 > 0""")
def p14(spark, d):
    s = table(spark, d, "supplier")
    ids = F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(1), F.col("s_suppkey") % 4))
    s = s.withColumn("air", ids)
    return s.where((F.col("s_suppkey") == 12) | (F.size("air") > 0)).select("s_suppkey", F.size("air").alias("air_ids"))


@query("p15_exceedance_not_plain_no", """
SELECT event_id, j::BIGINT AS result_no, flag FROM (SELECT event_id, j, CASE ((props->>'$.k')::BIGINT + j) % 6 WHEN 0 THEN 'N'
 WHEN 1 THEN ' no ' WHEN 2 THEN 'Y' WHEN 3 THEN 'Over' WHEN 4 THEN 'N/A' ELSE NULL END AS flag
 FROM events, range(3) t(j)) WHERE flag IN ('Y', 'Over')""")
def p15(spark, d):
    k = values.nested("props", "k").cast("int")

    def flag(j):
        m = (k + j) % 6
        return (F.when(m == 0, "N").when(m == 1, " no ").when(m == 2, "Y").when(m == 3, "Over").when(m == 4, "N/A"))
    results = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.struct(j.alias("no"), flag(j).alias("flag")))
    r = table(spark, d, "events").select("event_id", F.explode(results).alias("r"))
    return r.where(~values.plain_no("r.flag")).select("event_id", F.col("r.no").alias("result_no"), "r.flag")


@query("p16_catalog_query_parameters", f"""
SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 AND list_has_all({sql_words('c_mktsegment')},
 ['building']) GROUP BY 1 ORDER BY n DESC LIMIT 5""")
def p16(spark, d):
    from fieldbook.operators.catalog_query import catalog_query
    return catalog_query(table(spark, d, "customer"), where=F.col("c_acctbal") > 1000, full_text="building",
                         text_columns=["c_mktsegment"], group=["c_mktsegment"], order=[F.col("n").desc()], limit=5)


@query("p16_catalog_order_and_limit", """
SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey < 5 ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def p16_b(spark, d):
    from fieldbook.operators.catalog_query import catalog_query
    return catalog_query(table(spark, d, "customer"), select=["c_custkey", "c_acctbal"], where=F.col("c_nationkey") < 5,
                         order=[F.col("c_acctbal").desc(), F.col("c_custkey")], limit=25)


@query("p17_public_files_only", """
SELECT doc_id, f AS file_name FROM (SELECT doc_id, source, unnest(['report_' || lang || '.pdf',
 CASE WHEN doc_id % 3 = 0 THEN 'CONFIDENTIAL_' ELSE 'public_' END || doc_id || '.pdf', 'Exhibit_sealed.pdf']) AS f
 FROM documents) WHERE NOT regexp_matches(f, '(?i)confidential|sealed') AND regexp_matches(source || ' ' || f, '(?i)src1')""")
def p17(spark, d):
    name = lambda e: F.struct(e.alias("name"))
    files = F.array(name(F.concat(F.lit("report_"), "lang", F.lit(".pdf"))),
                    name(F.concat(F.when(F.col("doc_id") % 3 == 0, "CONFIDENTIAL_").otherwise("public_"),
                                  F.col("doc_id").cast("string"), F.lit(".pdf"))), name(F.lit("Exhibit_sealed.pdf")))
    x = text_table(spark, d, "documents", "doc_id").select("doc_id", "source", F.explode(F.filter(
        files, lambda f: ~f["name"].rlike("(?i)confidential|sealed"))).alias("f"))
    return x.where(F.concat_ws(" ", "source", "f.name").rlike("(?i)src1")).select(
        "doc_id", F.col("f.name").alias("file_name"))


_UNIT = "CASE l_linenumber % 5 WHEN 0 THEN 'TPY' WHEN 1 THEN 'lbs/yr' WHEN 2 THEN 'lb/hr' WHEN 3 THEN 'g/yr' ELSE 'cup' END"


@query("f6_yearly_mass", f"""
WITH u AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS a, {_UNIT} AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, a, CASE u WHEN 'TPY' THEN a * 2000 WHEN 'lbs/yr' THEN a WHEN 'lb/hr' THEN a * 8760
 WHEN 'g/yr' THEN a END AS value, CASE WHEN u = 'g/yr' THEN 'g' WHEN u <> 'cup' THEN 'lb' END AS layer,
 round(CASE u WHEN 'TPY' THEN a * 2000 WHEN 'lbs/yr' THEN a WHEN 'lb/hr' THEN a * 8760 END * 453.59237 / 31536000.0, 8)
 AS lb_grams_per_second FROM u""")
def f6(spark, d):
    k = F.col("l_linenumber") % 5
    u = F.when(k == 0, "TPY").when(k == 1, "lbs/yr").when(k == 2, "lb/hr").when(k == 3, "g/yr").otherwise("cup")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), u.alias("u"))
    m = units.yearly_mass("a", "u")
    gps = F.when(m["layer"] == "lb", F.round(units.grams_per_second("a", "u"), 8))
    return li.select("l_orderkey", "l_linenumber", "a", m["value"].alias("value"), m["layer"].alias("layer"),
                     gps.alias("lb_grams_per_second"))


@query("f7_humidity_correction", """
SELECT event_id, round(CASE WHEN value * 10 <= 343 THEN 0.52 * value * 10 - 0.086 * k + 5.75
 ELSE 0.46 * value * 10 + 3.93e-4 * pow(value * 10, 2) + 2.97 END, 6) AS pm25
FROM (SELECT *, (props->>'$.k')::DOUBLE AS k FROM events)""")
def f7(spark, d):
    return table(spark, d, "events").select("event_id", F.round(units.corrected_pm25(
        F.col("value") * 10, values.nested("props", "k").cast("double")), 6).alias("pm25"))


@query("f8_folded_keys", """
SELECT c_custkey, CASE WHEN t = '' THEN s ELSE t END AS id, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS name,
 regexp_replace(replace(regexp_replace(lower(trim(p)), '\\s+(parish|county)$', ''), 'saint ', 'st '), '[\\s.]', '', 'g')
   AS place, 'CUSTOMER ' || c_custkey AS owner, 'CUSTOMER' AS token,
 regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM (SELECT *, upper(regexp_replace(raw, '[^0-9A-Za-z]', '', 'g')) AS s,
  regexp_replace(upper(regexp_replace(raw, '[^0-9A-Za-z]', '', 'g')), '^0+', '') AS t FROM (
  SELECT c_custkey, '00-' || c_custkey AS raw, 'The ' || c_name || ', Inc.' AS n,
   'Saint ' || c_mktsegment || ' Parish' AS p FROM customer))""")
def f8(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    n = F.concat(F.lit("The "), "c_name", F.lit(", Inc."))
    place = F.concat(F.lit("Saint "), "c_mktsegment", F.lit(" Parish"))
    owner = F.concat(F.lit("Customer "), k, F.lit(", LLC ELTO"))
    return c.select("c_custkey", keys.fold_id(F.concat(F.lit("00-"), k)).alias("id"), keys.fold_name(n).alias("name"),
                    keys.fold_place(place).alias("place"), keys.fold_owner(owner).alias("owner"),
                    keys.name_token(n).alias("token"), keys.slug(n).alias("slug"))


@query("f8_filer_and_county_folding", """
SELECT p_partkey, replace(p_name, ' ', 's ') AS raw, regexp_replace(split_part(p_name, ' ', 1), 's$', '') IS NOT NULL AS ok,
 'E ST ' || upper(p_type) AS county FROM part""")
def f8_b(spark, d):
    p = table(spark, d, "part")
    raw = F.regexp_replace("p_name", " ", "s ")
    county = F.concat(F.lit("East Saint "), "p_type", F.lit(" Parish."))
    return p.select("p_partkey", raw.alias("raw"), keys.fold_filer(raw).isNotNull().alias("ok"),
                    keys.fold_county(county).alias("county"))


@query("f9_mixed_dates", """
SELECT o_orderkey, o_orderdate::DATE AS date, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END)::BIGINT
 AS fiscal_year FROM orders""")
def f9(spark, d):
    """Order dates written five ways (serial day, m/d/yyyy, ISO with time, month name, m/d/yy) and read back."""
    t = F.col("o_orderdate")
    m = F.col("o_orderkey") % 5
    serial = F.datediff(F.to_date(t), F.lit("1899-12-30").cast("date")).cast("string")
    raw = (F.when(m == 0, serial).when(m == 1, F.date_format(t, "M/d/yyyy"))
           .when(m == 2, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit("-13:46")))
           .when(m == 3, F.date_format(t, "MMMM d, yyyy")).otherwise(F.date_format(t, "M/d/yy")))
    o = table(spark, d, "orders").select("o_orderkey", dates.mixed_date(raw).alias("date"))
    return o.withColumn("fiscal_year", dates.fiscal_year("date"))


@query("f10_prefix_flags", """
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'Fire; ' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'Spill; ' ELSE '' END ||
 'other: note' AS hazards FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""")
def f10(spark, d):
    k = values.nested("props", "k").cast("int")
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    m = F.create_map(F.lit("MH_Fire"), yes(k % 2 == 0), F.lit("MH_Spill"), yes(k % 3 == 0), F.lit("MH_None"),
                     F.lit("Yes"), F.lit("MH_OtherText"), F.lit("note"), F.lit("PC_Alarm"), F.lit("Yes"))
    return table(spark, d, "events").select("event_id", F.array_join(values.yes_flags(m, "MH_"), "; ").alias("hazards"))


@query("f11_matches_pages_snippets", r"""
SELECT doc_id, len(regexp_extract_all(text, '\bth[a-z]+\b'))::BIGINT AS hits,
 len(string_split(text, '. '))::BIGINT AS pieces,
 coalesce((SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM (SELECT unnest(string_split(text, chr(10))) AS p,
  generate_subscripts(string_split(text, chr(10)), 1) AS i) WHERE regexp_matches(p, '(?i)\bthe\b')), '') AS pages FROM documents""")
def f11(spark, d):
    t = F.regexp_replace("text", "\n", "\f")
    return text_table(spark, d, "documents", "doc_id").select(
        "doc_id", F.size(text.all_matches("text", r"\bth[a-z]+\b")).alias("hits"),
        F.size(F.split("text", r"\. ")).alias("pieces"),
        F.array_join(F.transform(text.pages_matching(t, r"\bthe\b"), lambda v: v.cast("string")), ",").alias("pages"))


@query("f11_context_snippet", r"""
SELECT doc_id, replace(substr(text, greatest(1, p - 20), p + 8 + 20 - greatest(1, p - 20)), chr(10), ' | ') AS snippet
FROM (SELECT doc_id, text, strpos(text, 'shhation') AS p FROM (SELECT doc_id, text || ' end shhation.' AS text FROM documents))""")
def f11_b(spark, d):
    t = F.concat("text", F.lit(" end shhation."))
    return text_table(spark, d, "documents", "doc_id").select("doc_id", text.snippet(t, "shhation", 20).alias("snippet"))


@query("f12_docket_parser", """
WITH o AS (SELECT o_orderkey, year(o_orderdate) AS y, 100 + o_orderkey % 900 AS n, o_orderkey % 5 AS f FROM orders)
SELECT o_orderkey, (CASE f WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END)::BIGINT AS circuit,
 CASE f WHEN 0 THEN 'appeal:2::CA:' || (12000 + n) WHEN 1 THEN 'appeal:1:' || y || ':CA:' || n
  WHEN 2 THEN 'appeal:3:' || y || ':CW:' || n WHEN 3 THEN 'appeal:4:' || y || ':CA:' || n
  ELSE 'appeal:5:' || y || ':CA:' || n END AS key,
 CASE f WHEN 0 THEN '12,' || n WHEN 1 THEN CASE WHEN y < 2000 THEN right(y::VARCHAR, 2) ELSE y::VARCHAR END || '-0' || n
  WHEN 2 THEN right(y::VARCHAR, 2) || '-' || n WHEN 3 THEN CASE WHEN y < 2000 THEN right(y::VARCHAR, 2) ELSE y::VARCHAR END
  || '-0' || n ELSE right(y::VARCHAR, 2) || '-' || n END AS cite FROM o""")
def f12(spark, d):
    k = F.col("o_orderkey")
    y, n, f = F.year("o_orderdate").cast("string"), (k % 900 + 100).cast("string"), k % 5
    yy = F.substring(y, 3, 2)
    raw = (F.when(f == 0, F.concat(F.lit("No. 12,"), n, F.lit("-CA")))
           .when(f == 1, F.concat(y, F.lit(" CA "), n)).when(f == 2, F.concat(F.lit("CW "), yy, F.lit("-"), n))
           .when(f == 3, F.concat(F.lit("Docket No. "), y, F.lit("-CA-"), n)).otherwise(
               F.concat(yy, F.lit("-ca-"), n)))
    o = table(spark, d, "orders").select("o_orderkey", keys.docket_parts(raw).alias("p"))
    return o.select("o_orderkey", "p.circuit", "p.key", keys.docket_citation(F.col("p")).alias("cite"))


@query("f13_edit_distance_and_digit_cap", """
WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x,
 '^[,;:()\\[\\]"''.]+|[,;:()\\[\\]"''.]+$', '', 'g')), lambda x: x <> '') AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS tokens, levenshtein(lower(t[1]), 'the')::BIGINT AS distance,
 (CASE WHEN doc_id % 2 = 0 THEN 89 ELSE 100 END)::BIGINT AS cap FROM t WHERE len(t) > 0 AND regexp_matches(t[1], '^[A-Za-z]+$')""")
def f13(spark, d):
    t = text_table(spark, d, "documents", "doc_id").withColumn("t", text.trimmed_tokens("text")).where(F.size("t") > 0)
    cap = text.digit_run_cap(F.lit("7777-00936-00"), F.when(F.col("doc_id") % 2 == 0, "777-00936-00").otherwise(
        "7777-00936-00"))
    return t.where(F.col("t")[0].rlike("^[A-Za-z]+$")).select(
        "doc_id", F.size("t").alias("tokens"), F.levenshtein(F.lower(F.col("t")[0]), F.lit("the")).alias("distance"),
        cap.alias("cap"))


@query("f14_normal_text")
def f14(spark, d):
    """Unicode compatibility form and case folding of whole documents (rows only: no DuckDB equivalent)."""
    return text_table(spark, d, "documents", "doc_id").select("doc_id", text.normal_text("text").alias("normal"))


@query("f15_speakable_text")
def f15(spark, d):
    """Ordered substitutions, accent fallback and whitespace clean-up (rows only)."""
    spoken = text.speakable("text", [(r"\[(\d+)\]", "reference $1"), (r"\{([^}]*)\}", "$1")], {"§": "section ", "–": ", "})
    return text_table(spark, d, "documents", "doc_id").select("doc_id", spoken.alias("spoken"))


@query("f15_non_ascii_audit", """
SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS ch
 FROM documents) WHERE ch <> '' GROUP BY 1""")
def f15_b(spark, d):
    return text.non_ascii_audit(text_table(spark, d, "documents", "doc_id"), "text").select("ch", "n")


@query("f16_decode_and_nested_default", """
SELECT event_id, CASE (props->>'$.k')::BIGINT % 4 WHEN 0 THEN 'spill' WHEN 1 THEN 'fire' ELSE ((props->>'$.k')::BIGINT % 4)::VARCHAR
 END AS cause, 'unknown' AS unit FROM events""")
def f16(spark, d):
    k = (values.nested("props", "k").cast("int") % 4).cast("string")
    return table(spark, d, "events").select("event_id", values.decode(k, {"0": "spill", "1": "fire"}).alias("cause"),
                                            values.nested("props", "unit.name", "unknown").alias("unit"))


@query("f17_vortex_frequency", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN l_returnflag <> 'R' AND l_tax > 0
 THEN round(0.2 * l_quantity / l_tax, 6) END AS hz FROM lineitem""")
def f17(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(units.vortex_frequency(
        "l_quantity", "l_tax", F.col("l_returnflag") == "R"), 6).alias("hz"))


@query("f18_rehyphenated_ids", """
SELECT p_name AS name, min(p_partkey) AS first_key, arg_min((10000 + p_partkey) || '-' || '07-3', p_partkey) AS cas
FROM part GROUP BY 1""")
def f18(spark, d):
    p = table(spark, d, "part").withColumn("raw", F.concat(F.lit("000"), (F.col("p_partkey") + 10000).cast("string"),
                                                           F.lit("073")))
    return p.groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("first_key"), F.min_by(keys.rehyphenate_cas("raw"), "p_partkey").alias("cas"))
