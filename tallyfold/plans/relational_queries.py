"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.operators import aggregate as A
from tallyfold.operators import joins as J
from tallyfold.operators import sets as S
from tallyfold.operators import transform as X
from tallyfold.plans.catalogue import Tables, query, register, rounded


@query("""SELECT l_returnflag, l_linestatus, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS l_quantity_sum, round(avg(disc_price), 4) AS disc_price_mean,
  round(median(l_discount), 6) AS l_discount_median, count(l_quantity) AS l_quantity_count
  FROM (SELECT *, l_extendedprice * (1 - l_discount) AS disc_price FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02') GROUP BY ALL""")
def entry_report(spark, d):
    df = X.filter_rows(Tables(spark, d).lineitem, 'l_shipdate <= ts("1998-09-02")')
    df = X.derive(df, "disc_price", "l_extendedprice * (1 - l_discount)")
    out = A.group_by(df, ["l_returnflag", "l_linestatus"], [("l_quantity", "sum"), ("disc_price", "mean"), ("l_discount", "median"), ("l_quantity", "count")])
    return out.withColumn("l_quantity_sum", F.round("l_quantity_sum", 2)).withColumn("disc_price_mean", F.round("disc_price_mean", 4)).withColumn("l_discount_median", F.round("l_discount_median", 6))


register("filter_expr", lambda s, d: X.select(X.filter_rows(Tables(s, d).lineitem, "l_quantity > 45 and (l_returnflag == 'R' or not l_discount < 0.05)"), ["l_orderkey", "l_linenumber", "l_quantity"]),
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR NOT l_discount < 0.05)")
register("derive_arith", lambda s, d: rounded(X.derive(X.derive(Tables(s, d).lineitem, "net", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"), "ratio", "l_quantity / l_discount").selectExpr("l_orderkey", "l_linenumber", "net", "case when ratio = double('inf') then -1 else ratio end as ratio"), 1),
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1) AS net, CASE WHEN l_discount = 0 THEN -1 ELSE round(l_quantity / l_discount, 1) END AS ratio FROM lineitem")
register("derive_mod", lambda s, d: X.select(X.derive(Tables(s, d).orders, "m", "(o_custkey - 700) % 7"), ["o_orderkey", "m"]),
    "SELECT o_orderkey, CAST((o_custkey - 700) - 7 * floor((o_custkey - 700) / 7) AS BIGINT) AS m FROM orders")
register("derive_functions", lambda s, d: rounded(X.derive(X.derive(X.derive(X.derive(Tables(s, d).part, "u", "upper(p_brand)"), "n", "len_chars(p_name)"), "lg", "round(log10(p_retailprice), 6)"), "sq", "p_size ** 2").select("p_partkey", "u", "n", "lg", "sq"), 6),
    "SELECT p_partkey, upper(p_brand) AS u, CAST(length(p_name) AS BIGINT) AS n, round(log10(p_retailprice), 6) AS lg, CAST(p_size * p_size AS BIGINT) AS sq FROM part")
register("filter_contains", lambda s, d: X.select(X.filter_rows(Tables(s, d).part, "contains(p_name, 'a.*e') and is_not_null(p_type)"), ["p_partkey", "p_name"]),
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'a.*e') AND p_type IS NOT NULL")
register("select_rename_cast", lambda s, d: X.cast(X.rename(X.select(Tables(s, d).orders, ["o_orderkey", "o_totalprice", "o_orderstatus"]), "o_totalprice", "price"), {"price": "int"}),
    "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price, o_orderstatus FROM orders")
register("describe", lambda s, d: X.describe(Tables(s, d).nation.select("n_nationkey", "n_name", "n_regionkey")).drop("type"),
    """SELECT 'n_nationkey' AS "column", count(n_nationkey) AS non_null, count(*) - count(n_nationkey) AS missing, count(DISTINCT n_nationkey) AS "unique" FROM nation
  UNION ALL SELECT 'n_name', count(n_name), count(*) - count(n_name), count(DISTINCT n_name) FROM nation
  UNION ALL SELECT 'n_regionkey', count(n_regionkey), count(*) - count(n_regionkey), count(DISTINCT n_regionkey) FROM nation""")
register("count", lambda s, d: X.count(Tables(s, d).lineitem), 'SELECT count(*) AS rows, CAST(11 AS BIGINT) AS "columns" FROM lineitem')
register("head", lambda s, d: X.head(Tables(s, d).orders, 10, ["o_orderkey"]).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
register("tail", lambda s, d: X.tail(Tables(s, d).orders, 10, ["o_orderkey"]).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 10")
register("sort_topk", lambda s, d: X.sort(Tables(s, d).orders, ["o_totalprice", "o_orderkey"], desc=True).limit(20).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")


def _holes(s, d):
    """events with nulls put in: the tables have none."""
    return Tables(s, d).events.selectExpr("event_id", "ts", "user_id", "event_type", "case when event_id % 7 = 0 then null else value end as value", "case when event_id % 11 = 0 then null else event_type end as kind")


_H = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS kind FROM events)"
register("dropna", lambda s, d: X.drop_null(_holes(s, d), ["value", "kind"]).select("event_id"), f"SELECT event_id FROM {_H} WHERE value IS NOT NULL AND kind IS NOT NULL")
register("mdpattern", lambda s, d: rounded(A.missing_pattern(_holes(s, d), ["value", "kind"])),
    f"""SELECT 'value' AS variable, count(*) - count(value) AS missing, round(100.0 * (count(*) - count(value)) / count(*), 6) AS percent FROM {_H}
  UNION ALL SELECT 'kind', count(*) - count(kind), round(100.0 * (count(*) - count(kind)) / count(*), 6) FROM {_H}
  UNION ALL SELECT 'complete cases', count(*) FILTER (value IS NOT NULL AND kind IS NOT NULL), round(100.0 * count(*) FILTER (value IS NOT NULL AND kind IS NOT NULL) / count(*), 6) FROM {_H}""")
register("fillna_mean", lambda s, d: rounded(X.fill_null(_holes(s, d), "value", "mean").select("event_id", "value")), f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {_H})), 6) AS value FROM {_H}")
register("fillna_median", lambda s, d: rounded(X.fill_null(_holes(s, d), "value", "median").select("event_id", "value")), f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {_H})), 6) AS value FROM {_H}")
register("fillna_mode", lambda s, d: X.fill_null(_holes(s, d), "kind", "mode").select("event_id", "kind"),
    f"SELECT event_id, coalesce(kind, (SELECT kind FROM {_H} WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {_H}")
register("fillna_value", lambda s, d: rounded(X.fill_null(_holes(s, d), "value", "value", 0.0).select("event_id", "value")), f"SELECT event_id, round(coalesce(value, 0.0), 6) AS value FROM {_H}")
register("fillna_forward", lambda s, d: rounded(X.fill_null(_holes(s, d), "value", "forward", order=["event_id"]).select("event_id", "value")), f"SELECT event_id, round(last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS value FROM {_H}")
register("fillna_backward", lambda s, d: rounded(X.fill_null(_holes(s, d), "value", "backward", order=["event_id"]).select("event_id", "value")), f"SELECT event_id, round(first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS value FROM {_H}")
register("replace", lambda s, d: X.replace(Tables(s, d).orders, "o_orderstatus", "F", "Filled").select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Filled' ELSE o_orderstatus END AS o_orderstatus FROM orders")
register("recode", lambda s, d: X.recode(Tables(s, d).orders, "o_orderstatus", {"F": "O", "O": "P"}).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders")
register("encode", lambda s, d: X.encode(_holes(s, d), "kind", "code").select("event_id", "code"), f"SELECT event_id, CAST(dense_rank() OVER (ORDER BY kind NULLS FIRST) - 1 AS BIGINT) AS code FROM {_H}")
register("decode", lambda s, d: X.decode(X.encode(Tables(s, d).customer, "c_mktsegment", "code"), "code", "c_mktsegment", "label").select("c_custkey", "label"), "SELECT c_custkey, c_mktsegment AS label FROM customer")
register("bin_equal", lambda s, d: X.bin_values(Tables(s, d).customer, "c_acctbal", 4, "b", ["a", "b", "c", "d"]).select("c_custkey", "b"),
    """SELECT c_custkey, CASE WHEN c_acctbal <= lo + (hi - lo) / 4 THEN 'a' WHEN c_acctbal <= lo + (hi - lo) * 2 / 4 THEN 'b' WHEN c_acctbal <= lo + (hi - lo) * 3 / 4 THEN 'c' ELSE 'd' END AS b
  FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
register("bin_freq", lambda s, d: X.bin_values(Tables(s, d).customer, "c_acctbal", 3, "b", ["a", "b", "c"], equal_freq=True).select("c_custkey", "b"),
    """SELECT c_custkey, CASE WHEN c_acctbal <= q1 THEN 'a' WHEN c_acctbal <= q2 THEN 'b' ELSE 'c' END AS b
  FROM customer, (SELECT quantile_cont(c_acctbal, 1.0 / 3) AS q1, quantile_cont(c_acctbal, 2.0 / 3) AS q2 FROM customer)""")
register("anonymize_mask", lambda s, d: X.anonymize(Tables(s, d).customer, ["c_name"]).select("c_custkey", "c_name"), "SELECT c_custkey, CASE WHEN length(c_name) <= 2 THEN repeat('*', length(c_name)) ELSE left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) END AS c_name FROM customer")
register("anonymize_hash", lambda s, d: X.anonymize(Tables(s, d).customer, ["c_name"], "hash").select("c_custkey", "c_name"), "SELECT c_custkey, sha256(c_name) AS c_name FROM customer")
register("winsor", lambda s, d: rounded(X.winsor(Tables(s, d).customer, "c_acctbal", 0.05, "w").select("c_custkey", "w"), 4),
    """WITH r AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) - 1 AS k, count(*) OVER () AS n FROM customer),
  q AS (SELECT min(c_acctbal) FILTER (k = CAST(round_even(0.05 * (n - 1), 0) AS BIGINT)) AS lo, min(c_acctbal) FILTER (k = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS hi FROM r)
  SELECT c_custkey, round(least(greatest(c_acctbal, lo), hi), 4) AS w FROM customer, q""")
register("standardize", lambda s, d: rounded(X.standardize(Tables(s, d).customer, ["c_acctbal"]).select("c_custkey", "c_acctbal_z")), "SELECT c_custkey, round((c_acctbal - m) / s, 6) + 0.0 AS c_acctbal_z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
register("normalize", lambda s, d: rounded(X.normalize(Tables(s, d).customer, ["c_acctbal"]).select("c_custkey", "c_acctbal_norm")), "SELECT c_custkey, round((c_acctbal - a) / (b - a), 6) AS c_acctbal_norm FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
for _part, _sql in (("year", "year(o_orderdate)"), ("month", "month(o_orderdate)"), ("day", "day(o_orderdate)"), ("hour", "hour(o_orderdate)"), ("weekday", "isodow(o_orderdate)"), ("quarter", "quarter(o_orderdate)")):
    register(f"datetime_extract_{_part}", lambda s, d, p=_part: X.datetime_extract(Tables(s, d).orders, "o_orderdate", p, "x").select("o_orderkey", "x"), f"SELECT o_orderkey, CAST({_sql} AS BIGINT) AS x FROM orders")
register("datetime_diff", lambda s, d: rounded(X.datetime_diff(Tables(s, d).events.selectExpr("event_id", "ts", "timestamp_ntz'2024-01-01 00:00:00' as t0"), "ts", "t0", "hours", "h").select("event_id", "h")), "SELECT event_id, round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 3.6e9, 6) AS h FROM events")
register("datetime_format", lambda s, d: X.datetime_format(Tables(s, d).orders, "o_orderdate", "%d/%m/%Y %H:%M", "x").select("o_orderkey", "x"), "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H:%M') AS x FROM orders")
register("datetime_parse", lambda s, d: X.datetime_parse(X.datetime_format(Tables(s, d).orders, "o_orderdate", "%Y-%m-%d", "t"), "t", "%Y-%m-%d", "x").select("o_orderkey", "x"), "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS x FROM orders")
register("datetime_shift", lambda s, d: X.datetime_shift(Tables(s, d).orders, "o_orderdate", 36, "hours", "x").select("o_orderkey", "x"), "SELECT o_orderkey, o_orderdate + INTERVAL 36 HOUR AS x FROM orders")
register("regex_extract", lambda s, d: X.regex_extract(Tables(s, d).pages, "url", "https?://([^/]+)/", "host").select("page_id", "host"), "SELECT page_id, CASE WHEN regexp_matches(url, 'https?://([^/]+)/') THEN regexp_extract(url, 'https?://([^/]+)/', 1) END AS host FROM pages")
register("regex_replace", lambda s, d: X.regex_replace(Tables(s, d).pages, "url", "[0-9]+", "#").select("page_id", "url"), "SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS url FROM pages")
register("regex_match", lambda s, d: X.regex_match(Tables(s, d).documents, "text", "(?i)the", "m").selectExpr("doc_id", "cast(m as bigint) m"), "SELECT doc_id, CAST(regexp_matches(text, '(?i)the') AS BIGINT) AS m FROM documents")
register("regex_split", lambda s, d: X.regex_split(Tables(s, d).part, "p_type", "[ ]+", "w").selectExpr("p_partkey", "cast(size(w) as bigint) n", "w[0] as first"), "SELECT p_partkey, CAST(len(string_split_regex(p_type, '[ ]+')) AS BIGINT) AS n, string_split_regex(p_type, '[ ]+')[1] AS first FROM part")
register("split", lambda s, d: X.split_text(Tables(s, d).customer, "c_name", "#", "w", 2).select("c_custkey", "w1", "w2"), "SELECT c_custkey, string_split(c_name, '#')[1] AS w1, string_split(c_name, '#')[2] AS w2 FROM customer")
register("strtrim", lambda s, d: X.text_trim(Tables(s, d).part.selectExpr("p_partkey", "concat(' \t', p_name, '\n ') as x"), "x"), "SELECT p_partkey, p_name AS x FROM part")
register("strupper", lambda s, d: X.text_upper(Tables(s, d).part, "p_name").select("p_partkey", "p_name"), "SELECT p_partkey, upper(p_name) AS p_name FROM part")
register("strlower", lambda s, d: X.text_lower(Tables(s, d).part, "p_brand").select("p_partkey", "p_brand"), "SELECT p_partkey, lower(p_brand) AS p_brand FROM part")
register("strreplace", lambda s, d: X.text_replace(Tables(s, d).part, "p_brand", "[aeiou]", "_").select("p_partkey", "p_brand"), "SELECT p_partkey, regexp_replace(p_brand, '[aeiou]', '_', 'g') AS p_brand FROM part")

# joins
#: Rows beside the whole tables that meet no partner: a null key, and keys of one side only.
_LEFT_ONLY, _RIGHT_ONLY = [(None, -1), (-5, -2)], [(None, "none"), (-7, "other")]


def _OC(s, d):
    left = Tables(s, d).orders.selectExpr("o_custkey as k", "o_orderkey").unionByName(s.createDataFrame(_LEFT_ONLY, "k long, o_orderkey long"))
    return left, Tables(s, d).customer.selectExpr("c_custkey as k", "c_name").unionByName(s.createDataFrame(_RIGHT_ONLY, "k long, c_name string"))


_OS, _CS = "(SELECT o_custkey AS k, o_orderkey FROM orders UNION ALL VALUES (NULL, -1), (-5, -2))", "(SELECT c_custkey AS k, c_name FROM customer UNION ALL VALUES (NULL, 'none'), (-7, 'other'))"
register("merge_inner", lambda s, d: J.merge(*_OC(s, d), "k"), f"SELECT o.k, o_orderkey, c_name FROM {_OS} o JOIN {_CS} c USING (k)")
register("merge_left", lambda s, d: J.merge(*_OC(s, d), "k", "left"), f"SELECT o.k, o_orderkey, c_name FROM {_OS} o LEFT JOIN {_CS} c USING (k)")
register("merge_right", lambda s, d: J.merge(*_OC(s, d), "k", "right"), f"SELECT c.k, o_orderkey, c_name FROM {_OS} o RIGHT JOIN {_CS} c ON o.k = c.k")
register("merge_full", lambda s, d: J.merge(*_OC(s, d), "k", "outer"), f"SELECT o.k AS k, o_orderkey, c.k AS k_right, c_name FROM {_OS} o FULL JOIN {_CS} c ON o.k = c.k")
register("merge_cross", lambda s, d: J.merge(Tables(s, d).nation.select("n_name"), Tables(s, d).region.select("r_name"), "", "cross"), "SELECT n_name, r_name FROM nation, region")
register("antijoin", lambda s, d: J.anti_join(*_OC(s, d), "k"), f"SELECT * FROM {_OS} o WHERE NOT EXISTS (SELECT 1 FROM {_CS} c WHERE c.k = o.k)")
register("semijoin", lambda s, d: J.semi_join(*_OC(s, d), "k"), f"SELECT * FROM {_OS} o WHERE EXISTS (SELECT 1 FROM {_CS} c WHERE c.k = o.k)")
_NAMES = "concat(p_name, ' ', p_brand, ' ', p_type) as name"
register("fuzzyjoin", lambda s, d: rounded(J.fuzzy_join(Tables(s, d).part.selectExpr("p_partkey", "concat(p_name, ' ', p_brand, ' ', p_type, 'x') as name"), Tables(s, d).part.selectExpr(_NAMES).distinct(), "name", 95)),
    "SELECT p_partkey, concat(name, 'x') AS name, name AS _fuzzy_match, round(200.0 * length(name) / (2 * length(name) + 1), 6) AS _fuzzy_score, name AS _r_name FROM (SELECT p_partkey, concat(p_name, ' ', p_brand, ' ', p_type) AS name FROM part)")
register("asof_join", lambda s, d: rounded(J.asof_join(Tables(s, d).events.where("event_type = 'purchase'").select("event_id", "ts", "user_id"), Tables(s, d).events.where("event_type <> 'purchase'").select("ts", "user_id", "value"), "ts", "user_id", "value").select("event_id", "value_asof")),
    """SELECT event_id, round(value, 6) AS value_asof FROM (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') a
  LEFT JOIN (SELECT ts, user_id, max_by(value, event_id) AS value FROM events WHERE event_type <> 'purchase' GROUP BY ts, user_id) b ON a.user_id = b.user_id AND b.ts = (SELECT max(ts) FROM events e WHERE e.event_type <> 'purchase' AND e.user_id = a.user_id AND e.ts <= a.ts)""")

# set operations and samples
register("append_force", lambda s, d: S.append(Tables(s, d).customer.select("c_custkey", "c_name"), Tables(s, d).supplier.selectExpr("s_name as c_name", "s_acctbal"), force=True), "SELECT c_custkey, c_name, NULL::DOUBLE AS s_acctbal FROM customer UNION ALL SELECT NULL, s_name, s_acctbal FROM supplier")
register("duplicates_count", lambda s, d: S.duplicates(Tables(s, d).lineitem, ["l_orderkey", "l_linenumber"]), 'SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS "unique", count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem')
register("duplicates_drop", lambda s, d: S.drop_duplicates(Tables(s, d).orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey"), "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
register("unique", lambda s, d: S.unique(Tables(s, d).part, "p_brand"), "SELECT DISTINCT p_brand FROM part")
register("sample_n", lambda s, d: S.sample(Tables(s, d).orders, 100).agg(F.count("*").alias("n")), "SELECT least(100, count(*)) AS n FROM orders")
register("sample_fraction", lambda s, d: S.sample(Tables(s, d).orders, fraction=0.1).agg(F.count("*").alias("n")), "SELECT greatest(1, CAST(floor(count(*) * 0.1) AS BIGINT)) AS n FROM orders")
register("sample_rows", lambda s, d: S.sample(Tables(s, d).orders, 100).join(Tables(s, d).orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")), F.col("o_orderkey") == F.col("k")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.max(F.abs(F.col("o_totalprice") - F.col("p"))).alias("gap")), "SELECT least(100, count(*)) AS n, least(100, count(*)) AS keys, 0.0::DOUBLE AS gap FROM orders")
register("merge_two_keys", lambda s, d: J.merge(Tables(s, d).lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), Tables(s, d).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "n"),
    "SELECT l_orderkey, l_linenumber, l_quantity, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem")
register("sample_stratified", lambda s, d: S.sample_stratified(Tables(s, d).customer, "c_mktsegment", 20, order=["c_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, least(20, count(*)) AS n FROM customer GROUP BY 1")

# aggregation and windows
register("groupby_all_funcs", lambda s, d: rounded(A.group_by(Tables(s, d).orders, ["o_orderpriority"], [("o_totalprice", f, f) for f in ("mean", "sum", "min", "max", "std", "var", "median", "count")] + [("o_custkey", "nunique", "nu"), ("o_totalprice", "first", "fi"), ("o_totalprice", "last", "la")], ["o_orderkey"]), 2),
    """SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(sum(o_totalprice), 2) AS sum, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, round(stddev_samp(o_totalprice), 2) AS std, round(var_samp(o_totalprice), 2) AS var,
  round(median(o_totalprice), 2) AS median, count(o_totalprice) AS count, count(DISTINCT o_custkey) AS nu, round(min_by(o_totalprice, o_orderkey), 2) AS fi, round(max_by(o_totalprice, o_orderkey), 2) AS la FROM orders GROUP BY 1""")
register("collapse", lambda s, d: rounded(A.collapse(Tables(s, d).customer, "median", ["c_acctbal"], ["c_mktsegment"]), 4), "SELECT c_mktsegment, round(median(c_acctbal), 4) AS c_acctbal FROM customer GROUP BY 1")
register("collapse_global", lambda s, d: rounded(A.collapse(Tables(s, d).customer, "mean", ["c_acctbal"]), 4), "SELECT round(avg(c_acctbal), 4) AS c_acctbal FROM customer")
register("egen_by", lambda s, d: rounded(A.egen(Tables(s, d).orders, "m", "mean", ["o_totalprice"], ["o_orderpriority"]).select("o_orderkey", "m"), 4), "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS m FROM orders")
register("egen_rank", lambda s, d: A.egen(Tables(s, d).customer, "r", "rank", ["c_acctbal"], ["c_nationkey"], ["c_custkey"]).selectExpr("c_custkey", "cast(r as bigint) r"), "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r FROM customer")
register("egen_rank_all", lambda s, d: A.egen(Tables(s, d).customer, "r", "rank", ["c_acctbal"], order=["c_custkey"]).select("c_custkey", "r"), "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer")
register("egen_group", lambda s, d: A.egen(Tables(s, d).part, "g", "group", ["p_brand"]).select("p_partkey", "g"), "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS g FROM part")
register("egen_row", lambda s, d: rounded(A.egen(A.egen(Tables(s, d).lineitem.limit(0).unionByName(Tables(s, d).lineitem), "t", "rowtotal", ["l_quantity", "l_tax"]), "m", "rowmean", ["l_quantity", "l_tax"]).groupBy("l_returnflag").agg(F.sum("t").alias("t"), F.sum("m").alias("m")), 4), "SELECT l_returnflag, round(sum(l_quantity + l_tax), 4) AS t, round(sum((l_quantity + l_tax) / 2), 4) AS m FROM lineitem GROUP BY 1")
register("pivot_sum", lambda s, d: rounded(A.pivot(Tables(s, d).orders, "o_totalprice", "o_orderstatus", ["o_orderpriority"], "sum"), 2), "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{x}'), 2) AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY 1")
register("pivot_count", lambda s, d: A.pivot(Tables(s, d).orders, "o_totalprice", "o_orderstatus", ["o_orderpriority"], "count"), "SELECT o_orderpriority, " + ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{x}'), 0) AS \"{x}\"" for x in "FOP") + " FROM orders GROUP BY 1")
register("melt", lambda s, d: A.melt(Tables(s, d).lineitem, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"]).selectExpr("l_orderkey", "l_linenumber", "variable", "value + 0.0 as value"),
    "SELECT l_orderkey, l_linenumber, 'l_discount' AS variable, l_discount + 0.0 AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax + 0.0 FROM lineitem")
register("reshape_long", lambda s, d: A.reshape_long(Tables(s, d).part.selectExpr("p_partkey", "p_size as v1", "p_size * 2 as v2"), "v", ["p_partkey"], "j").selectExpr("p_partkey", "j", "cast(v as bigint) v"), "SELECT p_partkey, '1' AS j, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey, '2', CAST(p_size * 2 AS BIGINT) FROM part")
_KINDS = ("click", "error", "purchase", "signup", "view")
register("reshape_wide", lambda s, d: rounded(A.reshape_wide(Tables(s, d).events.groupBy("user_id", "event_type").agg(F.max("value").alias("v")), ["v"], ["user_id"], "event_type"), 6),
    "SELECT user_id, " + ", ".join(f"round(max(value) FILTER (event_type = '{k}'), 6) AS v{k}" for k in _KINDS) + " FROM events GROUP BY 1")
register("lag", lambda s, d: rounded(X.lag(Tables(s, d).events, "value", 2, ["event_id"], "x").select("event_id", "x")), "SELECT event_id, round(lag(value, 2) OVER (ORDER BY event_id), 6) AS x FROM events")
register("lead", lambda s, d: rounded(X.lead(Tables(s, d).events, "value", 1, ["event_id"], "x").select("event_id", "x")), "SELECT event_id, round(lead(value, 1) OVER (ORDER BY event_id), 6) AS x FROM events")
register("lag_by", lambda s, d: rounded(X.lag(Tables(s, d).events, "value", 1, ["event_id"], "x", ["user_id"]).select("event_id", "x")), "SELECT event_id, round(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS x FROM events")
for _f, _sql in (("sum", "sum"), ("max", "max"), ("min", "min"), ("count", "count")):
    register(f"cumulative_{_f}", lambda s, d, f=_f: rounded(X.cumulative(_holes(s, d), "value", f, ["event_id"], "x").select("event_id", "x"), 4), f"SELECT event_id, {'' if _f == 'count' else 'CASE WHEN value IS NOT NULL THEN round('}{_sql}(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING){'' if _f == 'count' else ', 4) END'} AS x FROM {_H}")
register("cumulative_prod", lambda s, d: rounded(X.cumulative(Tables(s, d).events.selectExpr("event_id", "1 + value / 1e7 as v"), "v", "prod", ["event_id"], "x").select("event_id", "x"), 6), "SELECT event_id, round(exp(sum(ln(1 + value / 1e7)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 6) AS x FROM events")
for _f, _sql in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"), ("median", "median")):
    register(f"rolling_{_f}", lambda s, d, f=_f: rounded(X.rolling(_holes(s, d), "value", 5, f, ["event_id"], "x", min_periods=2).select("event_id", "x"), 4),
        f"SELECT event_id, CASE WHEN count(value) OVER w >= 2 THEN round({_sql}(value) OVER w, 4) + 0.0 END AS x FROM {_H} WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
register("rolling_center", lambda s, d: rounded(X.rolling(Tables(s, d).events, "value", 5, "mean", ["event_id"], "x", center=True).select("event_id", "x"), 4), "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 4) AS x FROM events")
register("tssmooth_ma", lambda s, d: rounded(A.smooth_ma(Tables(s, d).events, "value", 3, ["event_id"], "x").select("event_id", "x"), 4), "SELECT event_id, round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS x FROM events")
register("tssmooth_exp", lambda s, d: rounded(A.smooth_exp(Tables(s, d).events, "value", 0.3, ["event_id"], ["user_id"], "x").select("event_id", "x"), 4),
    """WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  r AS (SELECT event_id, user_id, k, value AS x FROM e WHERE k = 1 UNION ALL SELECT e.event_id, e.user_id, e.k, 0.3 * e.value + 0.7 * r.x FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, round(x, 4) AS x FROM r""")
register("sql_cte_window", lambda s, d: _sql_on(s, Tables(s, d).orders, "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM data) SELECT o_custkey, o_orderkey FROM t WHERE r = 1"), "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM t WHERE r = 1")
register("sql_rollup", lambda s, d: rounded(_sql_on(s, Tables(s, d).orders, "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS v FROM data GROUP BY ROLLUP (o_orderpriority, o_orderstatus)"), 2), "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
register("sql_intersect", lambda s, d: _sql_on(s, Tables(s, d).orders, "SELECT o_custkey FROM data WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM data WHERE o_orderstatus = 'O'"), "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
register("sql_except", lambda s, d: _sql_on(s, Tables(s, d).orders, "SELECT o_custkey FROM data EXCEPT SELECT o_custkey FROM data WHERE o_orderstatus = 'O'"), "SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")


def _sql_on(spark, df, text):
    from tallyfold.sources.sql import run_sql

    return run_sql(df, text)


register("sql_cube", lambda s, d: rounded(_sql_on(s, Tables(s, d).orders, "SELECT o_orderpriority, o_orderstatus, count(*) AS n, sum(o_totalprice) AS v FROM data GROUP BY CUBE (o_orderpriority, o_orderstatus)"), 2), "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
register("sql_range_frame", lambda s, d: rounded(_sql_on(s, Tables(s, d).events, "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS v FROM data"), 4), "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 4) AS v FROM events")
register("sql_arrays", lambda s, d: _sql_on(s, Tables(s, d).events, "SELECT user_id, array_join(array_sort(collect_set(event_type)), ',') AS kinds, cast(size(map_from_entries(collect_set(struct(event_type, 1)))) AS bigint) AS n FROM data GROUP BY user_id"), "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY 1")
register("sql_union", lambda s, d: _sql_on(s, Tables(s, d).orders, "SELECT o_custkey FROM data WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM data WHERE o_orderstatus = 'P'"), "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
register("derive_logs", lambda s, d: rounded(X.derive(X.derive(X.derive(X.derive(X.derive(Tables(s, d).part, "a", "log(p_retailprice)"), "b", "sqrt(p_size)"), "c", "abs(p_size - 25)"), "e", "exp(p_size / 50)"), "t", "cast_str(cast_int(p_retailprice))").selectExpr("p_partkey", "a", "b", "cast(c as bigint) c", "e", "t"), 6),
    "SELECT p_partkey, round(ln(p_retailprice), 6) AS a, round(sqrt(p_size), 6) AS b, CAST(abs(p_size - 25) AS BIGINT) AS c, round(exp(p_size / 50.0), 6) AS e, CAST(CAST(trunc(p_retailprice) AS BIGINT) AS VARCHAR) AS t FROM part")
register("derive_text", lambda s, d: X.derive(X.derive(X.derive(_holes(s, d), "a", "strip(lower(kind))"), "b", "is_null(kind)"), "c", "fill_null(value, 0.5)").selectExpr("event_id", "a", "cast(b as int) b", "round(c, 6) c"), f"SELECT event_id, trim(lower(kind)) AS a, CAST(kind IS NULL AS INT) AS b, round(coalesce(value, 0.5), 6) AS c FROM {_H}")
