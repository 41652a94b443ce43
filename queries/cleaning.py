"""Cleaning and semantic type queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import plain, query, rounded
from tablelab.functions import fixed_values
from tablelab.functions import texts
from tablelab.functions.columns import clamp, normalize_nulls, to_number
from tablelab.operators import semantic
from tablelab.plans import basic_cleaning as basic
from tablelab.plans import universal_cleaning as universal

CUSTOMER = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM {customer}"""
LINES = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount FROM {lineitem}"
FLAGS = "SELECT l_returnflag, l_linestatus, l_quantity, l_tax FROM {lineitem}"
PARTS = """SELECT p_partkey,
  CASE WHEN p_size % 2 = 0 THEN ' Yes' ELSE 'no' END AS flag,
  CASE p_size % 3 WHEN 0 THEN 'Low' WHEN 1 THEN 'medium' ELSE 'HIGH ' END AS lvl,
  concat(p_size, ' kg') AS weight,
  concat(p_size, '-', p_size + 5) AS span,
  concat(p_size % 50, '/50') AS mark,
  concat('$', p_size, 'M') AS money,
  concat('user', p_partkey % 97, CASE WHEN p_size % 4 = 0 THEN '@gmail.com' ELSE '@Shop.co.uk' END) AS owner_mail,
  concat('a', p_size % 5, '|b', p_size % 7) AS code,
  CASE p_size % 4 WHEN 0 THEN 'two hundred five' WHEN 1 THEN 'three thousand forty'
    WHEN 2 THEN 'one million two' ELSE 'seventy seven' END AS spoken,
  concat('10.0.', p_size, '.1') AS host,
  concat('2024-0', 1 + p_size % 9, '-', 10 + p_size % 15) AS day_text,
  CASE WHEN p_size % 10 = 0 THEN 999 WHEN p_size % 10 = 1 THEN -9999 ELSE p_size END AS num,
  CASE WHEN p_size % 6 = 0 THEN ' N/A' WHEN p_size % 6 = 1 THEN 'error' ELSE p_type END AS kind,
  CASE WHEN p_size % 3 = 0 THEN '1.234,56' WHEN p_size % 3 = 1 THEN concat('$', p_size, ',000.50') ELSE concat(p_size, ' EUR') END AS price
  FROM {part}"""


@query("c1_standard_names", """SELECT o_orderkey AS order_key, o_custkey AS order_key_2, o_orderstatus AS order_key_3,
  round(o_totalprice, 2) AS total_usd FROM orders""")
def c1(t):
    raw = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2))
    return basic.standardise_columns(raw.toDF("Order Key", "order  key", " ORDER-KEY ", "total (USD)"))[0]


@query("c2_median_fill", f"""WITH d AS ({CUSTOMER}), m AS (SELECT quantile_cont(bal, 0.5) AS q FROM d)
  SELECT c_custkey, round(coalesce(bal, (SELECT q FROM m)), 4) AS bal FROM d""")
def c2(t):
    d = t.sql(CUSTOMER).select("c_custkey", "bal")
    return rounded(basic.apply_fill(d, basic.fit_numeric_fill(d)))


@query("c3_mode_fill", f"""WITH d AS ({CUSTOMER}), m AS (SELECT seg FROM d WHERE seg IS NOT NULL GROUP BY seg
  ORDER BY count(*) DESC, seg LIMIT 1) SELECT c_custkey, coalesce(seg, (SELECT seg FROM m)) AS seg FROM d""")
def c3(t):
    d = t.sql(CUSTOMER).select("c_custkey", "seg")
    return basic.apply_fill(d, basic.fit_text_fill(d))


@query("c4_drop_duplicates", f"SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, round(l_tax, 4) AS l_tax FROM ({FLAGS})")
def c4(t):
    return rounded(t.sql(FLAGS).dropDuplicates())


TYPES = """SELECT p_partkey, CAST(p_size AS STRING) AS size_text, CASE WHEN p_partkey = 7 THEN 'x' ELSE CAST(p_size AS STRING) END AS mixed,
  concat('2024-0', 1 + p_size % 9, '-', 10 + p_size % 15) AS day_text FROM {part}"""


@query("c5_text_to_number", f"SELECT p_partkey, CAST(size_text AS DOUBLE) AS size_text, mixed FROM ({TYPES})")
def c5(t):
    d = t.sql(TYPES).drop("day_text")
    return basic.apply_types(d, basic.fit_types(d))


@query("c6_text_to_time", f"SELECT p_partkey, epoch(CAST(day_text AS TIMESTAMP))::BIGINT AS day_seconds FROM ({TYPES})")
def c6(t):
    d = t.sql(TYPES).select("p_partkey", "day_text")
    out = basic.apply_types(d, basic.fit_types(d))
    return out.select("p_partkey", F.unix_timestamp("day_text").alias("day_seconds"))


@query("c7_iqr_clip", f"""WITH d AS ({LINES}), q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b,
  quantile_cont(l_quantity, 0.25) qa, quantile_cont(l_quantity, 0.75) qb FROM d)
  SELECT l_orderkey, l_linenumber,
  round(greatest(least(l_quantity, qb + 0.5 * (qb - qa)), qa - 0.5 * (qb - qa)), 4) AS l_quantity,
  round(greatest(least(l_extendedprice, b + 0.5 * (b - a)), a - 0.5 * (b - a)), 4) AS l_extendedprice FROM d, q""")
def c7(t):
    d = t.sql(LINES).drop("l_discount")
    clips = basic.fit_clips(d, factor=0.5, columns=["l_quantity", "l_extendedprice"])
    return rounded(basic.apply_clips(d, clips))


DIRTY = """SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS `Account Balance`,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS `Mkt-Segment`,
  CAST(c_nationkey AS STRING) AS nation FROM {customer}"""


@query("c8_basic_cleaning", """WITH d AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg, c_nationkey AS nation FROM customer),
  f AS (SELECT DISTINCT coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM d)) AS bal,
   coalesce(seg, (SELECT seg FROM d WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg LIMIT 1)) AS seg, nation FROM d),
  q AS (SELECT quantile_cont(bal, 0.25) a, quantile_cont(bal, 0.75) b, quantile_cont(nation, 0.25) na, quantile_cont(nation, 0.75) nb FROM f)
  SELECT round(greatest(least(bal, b + 1.5 * (b - a)), a - 1.5 * (b - a)), 4) AS account_balance, seg AS mkt_segment,
  round(greatest(least(nation, nb + 1.5 * (nb - na)), na - 1.5 * (nb - na)), 4)::DOUBLE AS nation FROM f, q""")
def c8(t):
    d = t.sql(DIRTY)
    return rounded(basic.BasicCleaning.fit(d).transform(d))


@query("c8_basic_summary", """WITH d AS (SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q FROM lineitem),
  f AS (SELECT l_returnflag, l_linestatus, coalesce(q, (SELECT quantile_cont(q, 0.5) FROM d)) AS q FROM d)
  SELECT count(*)::BIGINT AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM f))::BIGINT AS rows_after,
  (SELECT count(*) FROM d WHERE q IS NULL)::BIGINT AS filled FROM d""")
def c8_summary(t):
    d = t.sql("SELECT l_returnflag, l_linestatus, CASE WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS q FROM {lineitem}")
    _, s = basic.clean(d)
    row = [(s["rows_before"], s["rows_after"], s["numeric_filled"]["q"])]
    return t.spark.createDataFrame(row, "rows_before bigint, rows_after bigint, filled bigint")


@query("u1_trim_blank_tokens", f"""SELECT p_partkey, CASE WHEN trim(lvl) IN ('nan', 'none', 'None', '') THEN NULL ELSE trim(lvl) END AS lvl,
  trim(flag) AS flag FROM ({PARTS})""")
def u1(t):
    return t.sql(PARTS).select("p_partkey", universal.tidy_text(F.col("lvl")).alias("lvl"), universal.tidy_text(F.col("flag")).alias("flag"))


@query("u3_u4_drop_empty_and_constant", "SELECT o_orderkey, o_custkey FROM orders")
def u3(t):
    d = t.orders.select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("empty"), F.lit("k").alias("constant"))
    plan = universal.UniversalCleaning.fit(d)
    gone = [*plan.report["empty_dropped"], *plan.report["constant_dropped"]]
    return d.drop(*gone)


@query("u5_lower_short_vocabulary", f"SELECT p_partkey, lower(kind) AS kind FROM ({PARTS})")
def u5(t):
    from tablelab.operators.counts import distinct_over

    d = t.sql(PARTS).select("p_partkey", "kind")
    return d if distinct_over(d, {"kind": 50})["kind"] else d.withColumn("kind", F.lower("kind"))


@query("u6_number_sentinels", f"""SELECT p_partkey, CASE WHEN num IN (999, -999, 9999, -9999, 99999, -99999) THEN NULL ELSE num END AS num FROM ({PARTS})""")
def u6(t):
    return t.sql(PARTS).select("p_partkey", universal.drop_number_sentinels(F.col("num")).alias("num"))


@query("u7_text_sentinels", f"""SELECT p_partkey, CASE WHEN lower(trim(kind)) IN ('error','err','#n/a','#value!','missing','n/a','na','nil','null','nan','inf','-inf')
  THEN NULL ELSE kind END AS kind FROM ({PARTS})""")
def u7(t):
    return t.sql(PARTS).select("p_partkey", universal.drop_text_sentinels(F.col("kind")).alias("kind"))


@query("u8_binary_text", f"SELECT p_partkey, CASE lower(trim(flag)) WHEN 'yes' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE END AS flag FROM ({PARTS})")
def u8(t):
    return t.sql(PARTS).select("p_partkey", universal.binary_code(F.col("flag"), ["yes", "no"]).alias("flag"))


@query("u9_ordinal_text", f"SELECT p_partkey, CASE lower(trim(lvl)) WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 2.0::DOUBLE WHEN 'high' THEN 3.0::DOUBLE END AS lvl FROM ({PARTS})")
def u9(t):
    scale = ["very low", "low", "medium", "high", "very high"]
    return t.sql(PARTS).select("p_partkey", universal.ordinal_code(F.col("lvl"), scale).alias("lvl"))


@query("u10_units", f"""SELECT p_partkey, CAST(replace(weight, ' kg', '') AS DOUBLE) AS weight,
  CAST(regexp_extract(money, '([0-9]+)', 1) AS DOUBLE) * 1000000 AS money FROM ({PARTS})""")
def u10(t):
    return t.sql(PARTS).select("p_partkey", texts.units(F.col("weight")).alias("weight"), texts.units(F.col("money")).alias("money"))


@query("u11_capped_and_ranges", f"""SELECT p_partkey, (CAST(split_part(span, '-', 1) AS DOUBLE) + CAST(split_part(span, '-', 2) AS DOUBLE)) / 2 AS span,
  p_partkey::DOUBLE AS low, (p_partkey * 1000)::DOUBLE AS grouped FROM ({PARTS})""")
def u11(t):
    d = t.sql(PARTS)
    return d.select(
        "p_partkey", texts.capped(F.col("span")).alias("span"),
        texts.capped(F.concat(F.lit("<"), F.col("p_partkey"))).alias("low"),
        texts.capped(F.concat(F.col("p_partkey"), F.lit(",000+"))).alias("grouped"),
    )


@query("u12_ratio", f"SELECT p_partkey, CAST(split_part(mark, '/', 1) AS DOUBLE) AS mark FROM ({PARTS})")
def u12(t):
    return t.sql(PARTS).select("p_partkey", texts.numerator(F.col("mark")).alias("mark"))


@query("u13_mail_features", f"""SELECT p_partkey, split_part(split_part(lower(owner_mail), '@', 2), '.', 1) AS owner_mail_domain,
  CASE WHEN split_part(split_part(lower(owner_mail), '@', 2), '.', 1) = 'gmail' THEN 1 ELSE 0 END AS owner_mail_is_free FROM ({PARTS})""")
def u13(t):
    return t.sql(PARTS).select(
        "p_partkey", texts.mail_host(F.col("owner_mail")).alias("owner_mail_domain"),
        texts.mail_is_free(F.col("owner_mail")).alias("owner_mail_is_free"),
    )


@query("u14_web_domain", """WITH h AS (SELECT page_id, string_split(split_part(regexp_replace(lower(trim(url)), '^https?://|^ftp://|^www\\.', ''), '/', 1), '.') AS p FROM pages)
  SELECT page_id, CASE WHEN len(p) >= 2 THEN p[len(p) - 1] ELSE p[1] END AS url_domain FROM h""")
def u14(t):
    return t.pages.select("page_id", texts.web_domain(F.col("url")).alias("url_domain"))


TEXT_SQL = """WITH w AS (SELECT doc_id, length(trim(text, E' \\t\\n\\r\\f\\v')) AS n,
  list_filter(string_split_regex(lower(trim(text, E' \\t\\n\\r\\f\\v')), '[\\t\\n\\f\\r\\v ]+'), lambda x: x <> '') AS w FROM documents)
  SELECT doc_id, len(w)::INTEGER AS text_word_count, n::INTEGER AS text_char_length,
  CASE WHEN len(w) = 0 THEN 0.0 ELSE round((len(list_filter(w, lambda x: x IN ('good','great','excellent','amazing','wonderful','fantastic','best','positive','happy','success','win','love','perfect','outstanding')))
   - len(list_filter(w, lambda x: x IN ('bad','poor','terrible','awful','worst','negative','fail','failed','error','broken','missing','lost','dead','inactive','disabled'))))::DOUBLE / len(w), 4) END AS text_sentiment FROM w"""


@query("u15_text_features", TEXT_SQL)
def u15(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id", texts.word_count(c).alias("text_word_count"), texts.char_length(c).alias("text_char_length"),
        texts.sentiment(c).alias("text_sentiment"),
    )


@query("u16_time_parts", """SELECT o_orderkey, year(o_orderdate)::INTEGER AS d_year, month(o_orderdate)::INTEGER AS d_month, day(o_orderdate)::INTEGER AS d_day,
  (isodow(o_orderdate) - 1)::INTEGER AS d_weekday FROM orders""")
def u16(t):
    d = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return d.select("o_orderkey", *[universal.time_part(F.col("d"), p).alias(f"d_{p}") for p in ("year", "month", "day", "weekday")])


@query("u17_split_compound", """SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS priority_part1,
  nullif(trim(substr(o_orderpriority, instr(o_orderpriority, '-') + 1)), '') AS priority_part2 FROM orders""")
def u17(t):
    c = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey", universal.part_of(c, "-", 0).alias("priority_part1"), universal.part_of(c, "-", 1).alias("priority_part2")
    )


@query("u18_word_numbers", f"""SELECT p_partkey, CASE spoken WHEN 'two hundred five' THEN 205.0::DOUBLE WHEN 'three thousand forty' THEN 3040.0::DOUBLE
  WHEN 'one million two' THEN 1000002.0::DOUBLE ELSE 77.0::DOUBLE END AS spoken FROM ({PARTS})""")
def u18(t):
    return t.sql(PARTS).select("p_partkey", texts.word_number(F.col("spoken")).alias("spoken"))


@query("u19_near_unique", "SELECT o_orderpriority FROM orders")
def u19(t):
    from tablelab.operators.counts import distinct_over

    d = t.orders.select(F.concat(F.lit("k"), F.col("o_orderkey")).alias("key_text"), "o_orderpriority")
    over = distinct_over(d, {c: 0.95 * d.count() for c in d.columns})
    return d.drop(*[c for c, drop in over.items() if drop])


@query("u20_phone_check", "SELECT p_partkey FROM part")
def u20(t):
    d = t.part.select("p_partkey", (F.col("p_size") % 100).alias("phone"))
    plan = universal.UniversalCleaning.fit(d)
    return d.drop(*plan.report["phones_dropped"])


@query("u21_coerce_numbers", "SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_size END::DOUBLE AS v FROM part")
def u21(t):
    d = t.part.select("p_partkey", F.when(F.col("p_size") == 7, F.lit("12d")).otherwise(F.col("p_size").cast("string")).alias("v"))
    return d.select("p_partkey", to_number(F.col("v")).alias("v"))


@query("u22_domain_clamp", "SELECT p_partkey, greatest(least(p_size - 10, 10), 0)::DOUBLE AS rating FROM part")
def u22(t):
    return t.part.select("p_partkey", clamp((F.col("p_size") - 10).cast("double"), 0.0, 10.0).alias("rating"))


@query("u23_wide_clip", """WITH d AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 100 ELSE value END AS v FROM events),
  q AS (SELECT quantile_cont(v, 0.25) a, quantile_cont(v, 0.75) b FROM d)
  SELECT event_id, round(greatest(least(v, b + 3 * (b - a)), a - 3 * (b - a)), 4) AS v FROM d, q""")
def u23(t):
    d = t.sql("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value * 100 ELSE value END AS v FROM {events}")
    clips = basic.fit_clips(d.select("v"), factor=3.0)
    return rounded(basic.apply_clips(d, clips))


@query("u24_no_infinities", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 4) END AS v FROM customer")
def u24(t):
    d = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal")).alias("v"))
    return rounded(normalize_nulls(d))


@query("u25_impute", f"""WITH d AS ({CUSTOMER}) SELECT c_custkey, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM d)), 4) AS bal,
  coalesce(seg, 'Unknown') AS seg FROM d""")
def u25(t):
    d = t.sql(CUSTOMER)
    fills = basic.fit_numeric_fill(d)
    return rounded(basic.apply_fill(d, {**fills, "seg": "Unknown"}))


@query("u26_flags_to_numbers", "SELECT p_partkey, (p_size > 25)::INTEGER AS big FROM part")
def u26(t):
    d = t.part.select("p_partkey", (F.col("p_size") > 25).alias("big"))
    return d.select("p_partkey", universal.OPERATIONS["flag"](F.col("big")).alias("big"))


@query("u27_universal_cleaning", f"""WITH d AS (SELECT DISTINCT flag, lvl, weight, owner_mail, code FROM ({PARTS})),
  e AS (SELECT CASE lower(trim(flag)) WHEN 'yes' THEN 1.0 ELSE 0.0 END AS flag,
   CASE lower(trim(lvl)) WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 ELSE 3.0 END AS lvl,
   CAST(replace(weight, ' kg', '') AS DOUBLE) AS weight,
   split_part(split_part(lower(owner_mail), '@', 2), '.', 1) AS owner_mail_domain,
   CASE WHEN owner_mail LIKE '%@gmail.com' THEN 1.0 ELSE 0.0 END AS owner_mail_is_free,
   split_part(code, '|', 1) AS code_part1, split_part(code, '|', 2) AS code_part2 FROM d),
  q AS (SELECT quantile_cont(flag, 0.25) f1, quantile_cont(flag, 0.75) f3, quantile_cont(lvl, 0.25) l1, quantile_cont(lvl, 0.75) l3,
   quantile_cont(weight, 0.25) w1, quantile_cont(weight, 0.75) w3, quantile_cont(owner_mail_is_free, 0.25) m1, quantile_cont(owner_mail_is_free, 0.75) m3 FROM e)
  SELECT CASE WHEN f1 = f3 THEN flag ELSE greatest(least(flag, f3 + 3 * (f3 - f1)), f1 - 3 * (f3 - f1)) END::DOUBLE AS flag,
   CASE WHEN l1 = l3 THEN lvl ELSE greatest(least(lvl, l3 + 3 * (l3 - l1)), l1 - 3 * (l3 - l1)) END::DOUBLE AS lvl,
   greatest(least(weight, w3 + 3 * (w3 - w1)), w1 - 3 * (w3 - w1)) AS weight, owner_mail_domain,
   CASE WHEN m1 = m3 THEN owner_mail_is_free ELSE greatest(least(owner_mail_is_free, m3 + 3 * (m3 - m1)), m1 - 3 * (m3 - m1)) END::DOUBLE AS owner_mail_is_free,
   code_part1, code_part2 FROM e, q""")
def u27(t):
    d = t.sql(PARTS).select("flag", "lvl", "weight", "owner_mail", "code")
    return rounded(universal.UniversalCleaning.fit(d).transform(d))


@query("u28_training_names", "SELECT o_orderkey AS Order_Key, o_orderstatus AS Status_ FROM orders")
def u28(t):
    raw = t.orders.select("o_orderkey", "o_orderstatus")
    return raw.toDF(*basic.training_names(["Order Key ", "Status (!)"]))


@query("t1_pattern_rates", """WITH d AS (SELECT 'c_name' AS "column", c_name AS value FROM customer UNION ALL SELECT 'phone', concat('+1 555-', 1000 + c_custkey % 9000) FROM customer
   UNION ALL SELECT 'mail', concat('u', c_custkey, '@mail.com') FROM customer)
  SELECT "column", pattern, count(*)::BIGINT AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) AS match_rate, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 4) >= 0.6 AS matches
  FROM (SELECT "column", unnest(['phone', 'dashed_id', 'email', 'url', 'ip']) AS pattern, unnest([
    regexp_matches(trim(value), '^[+]?[0-9][0-9\\s\\-.()/\\\\]{5,18}$'),
    regexp_matches(trim(value), '^[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)+$'),
    regexp_matches(trim(value), '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}$'),
    regexp_matches(trim(value), '^(?:https?://|ftp://|www\\.)[^\\s]{4,}$', 'i'),
    regexp_matches(trim(value), '^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}(?::\\d+)?$')]) AS hit FROM d) GROUP BY 1, 2""")
def t1(t):
    d = t.sql("SELECT c_name, concat('+1 555-', 1000 + c_custkey % 9000) AS phone, concat('u', c_custkey, '@mail.com') AS mail FROM {customer}")
    return semantic.pattern_rates(d).filter("pattern in ('phone', 'dashed_id', 'email', 'url', 'ip')")


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_HITS = ", ".join(f"regexp_matches(trim(value, {_quoted(fixed_values.BLANKS)}), {_quoted(p)})" for _, p in fixed_values.SEMANTIC_PATTERNS)
_NAMES = ", ".join(_quoted(n) for n, _ in fixed_values.SEMANTIC_PATTERNS)


@query("t1_document_pattern_rates", f"""WITH d AS (SELECT 'lang' AS "column", lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'text', text FROM documents)
  SELECT "column", pattern, count(*)::BIGINT AS n, round(avg(hit::INT), 4) AS match_rate, round(avg(hit::INT), 4) >= 0.6 AS matches
  FROM (SELECT "column", unnest([{_NAMES}]) AS pattern, unnest([{_HITS}]) AS hit FROM d WHERE value IS NOT NULL) GROUP BY 1, 2""")
def t1_documents(t):
    return semantic.pattern_rates(t.documents, ["lang", "source", "text"])


@query("t2_national_ids", """SELECT 'c_name' AS "column", NULL::VARCHAR AS national_id FROM customer HAVING count(*) > 0
  UNION ALL SELECT 'ssn', 'USA_SSN' FROM customer HAVING count(*) > 0 UNION ALL SELECT 'pan', 'IND_PAN' FROM customer HAVING count(*) > 0""")
def t2(t):
    d = t.sql("""SELECT c_name, concat(100 + c_custkey % 900, '-', 10 + c_custkey % 90, '-', 1000 + c_custkey % 9000) AS ssn,
      concat('ABCDE', 1000 + c_custkey % 9000, 'F') AS pan FROM {customer}""")
    return semantic.national_ids(d)


@query("t3_prices", f"""SELECT p_partkey, CASE WHEN price = '1.234,56' THEN 1234.56 WHEN price LIKE '$%' THEN CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE)
  ELSE CAST(replace(price, ' EUR', '') AS DOUBLE) END AS price FROM ({PARTS})""")
def t3(t):
    return semantic.prices(t.sql(PARTS), "price").select("p_partkey", "price")
