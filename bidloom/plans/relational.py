"""Queries of the relational operators: lateral, join, aggregate, window, sort and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions import cleaning as C
from bidloom.operators import aggregates as A
from bidloom.operators import tables as T
from bidloom.operators.ranking import tied_ranks
from bidloom.plans.book import Book, Tables

BOOK = Book()
QUERIES, ORACLE = BOOK.QUERIES, BOOK.ORACLE
c = F.col
W = Window


# lateral and nested

@BOOK.query("SELECT source_row_id, trim(x) AS token FROM (SELECT source_row_id, unnest(string_split(win_name, '---')) AS x FROM can_2017) WHERE nullif(trim(x), '') IS NOT NULL")
def lat_01_split(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", F.explode(F.split("win_name", "---")).alias("x")).select("source_row_id", C.clean_text(c("x")).alias("token")).filter("token is not null")


@BOOK.query("""SELECT DISTINCT source_row_id, nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS code FROM (
  SELECT source_row_id, cpv AS x FROM cn_2017 UNION ALL SELECT source_row_id, unnest(string_split(additional_cpvs, '---')) FROM cn_2017) WHERE nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') IS NOT NULL""")
def lat_02_codes(t: Tables) -> DataFrame:
    codes = F.concat(F.array("cpv"), F.coalesce(F.split("additional_cpvs", "---"), F.array().cast("array<string>")))
    return t.cn_2017.select("source_row_id", F.explode(codes).alias("x")).select("source_row_id", C.cpv_digits(c("x")).alias("code")).filter("code is not null").distinct()


@BOOK.query("SELECT source_row_id, trim(x) AS region FROM (SELECT source_row_id, unnest(regexp_split_to_array(tal_location_nuts, '[,;|]+')) AS x FROM can_2017) WHERE nullif(trim(x), '') IS NOT NULL")
def lat_03_regex_split(t: Tables) -> DataFrame:
    return t.can_2017.select("source_row_id", F.explode(F.split("tal_location_nuts", "[,;|]+")).alias("x")).select("source_row_id", C.clean_text(c("x")).alias("region")).filter("region is not null")


_D = "regexp_replace(cpv, '[^0-9]', '', 'g')"


@BOOK.query(f"""SELECT level, code, count(*) AS n FROM (SELECT unnest([2, 3, 4, 8]) AS level, {_D} AS d FROM cn_2017), LATERAL (SELECT substr(d, 1, level) AS code) WHERE length(d) >= level GROUP BY ALL""")
def lat_04_hierarchy(t: Tables) -> DataFrame:
    d = C.cpv_digits(c("cpv"))
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.when(F.length(d) >= k, F.substring(d, 1, k)).alias("code")) for k in (2, 3, 4, 8)])
    return t.cn_2017.select(F.inline(levels)).filter("code is not null").groupBy("level", "code").agg(F.count("*").alias("n"))


_FLAGS = ("b_gpa", "b_eu_funds", "b_on_behalf", "b_electronic_auction", "b_fra_agreement")
_B = "CASE WHEN upper(trim({0})) IN ('Y','YES','1','TRUE','T') THEN true WHEN upper(trim({0})) IN ('N','NO','0','FALSE','F') THEN false END"


@BOOK.query("SELECT field, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {_B.format(f)} AS value FROM can_2017" for f in _FLAGS) + ") GROUP BY 1, 2")
def lat_05_unpivot(t: Tables) -> DataFrame:
    flags = t.can_2017.select(*[C.parse_bool(c(f)).alias(f) for f in _FLAGS])
    return flags.unpivot([], list(_FLAGS), "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


@BOOK.query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS tokens FROM orders GROUP BY 1")
def lat_06_token_sets(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("tokens"))


@BOOK.query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS k_sum FROM events GROUP BY 1")
def lat_07_json(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.from_json("props", "k int").getField("k").alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"))


@BOOK.query("SELECT o_custkey, array_to_string(list_sort(list('#' || o_orderkey)), ',') AS refs FROM orders GROUP BY 1")
def lat_08_nested_walk(t: Tables) -> DataFrame:
    got = t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus")).alias("items"))
    return got.select("o_custkey", F.array_join(F.sort_array(F.transform("items", lambda x: F.concat(F.lit("#"), x["o_orderkey"].cast("string")))), ",").alias("refs"))


# joins

@BOOK.query("SELECT n_name, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def jon_01_inner(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@BOOK.query("SELECT n.record_id, f.trust_rank FROM cn_notice n LEFT JOIN notice_feed f USING (feed_name)")
def jon_02_left(t: Tables) -> DataFrame:
    return t.cn_notice.join(t.notice_feed, "feed_name", "left").select("record_id", "trust_rank")


@BOOK.query("SELECT source_row_id FROM can_2017 c LEFT JOIN can_withdrawn w USING (id_notice_can) WHERE w.id_notice_can IS NULL")
def jon_03_anti(t: Tables) -> DataFrame:
    return t.can_2017.join(t.can_withdrawn, "id_notice_can", "left_anti").select("source_row_id")


@BOOK.query("SELECT source_row_id FROM can_2017 WHERE id_notice_can IN (SELECT id_notice_can FROM can_2017 GROUP BY 1 HAVING count(*) > 3)")
def jon_04_semi(t: Tables) -> DataFrame:
    large = t.can_2017.groupBy("id_notice_can").agg(F.count("*").alias("n")).filter("n > 3")
    return t.can_2017.join(large, "id_notice_can", "left_semi").select("source_row_id")


@BOOK.query("""SELECT o_orderkey, coalesce(a.c_name, b.s_name, d.p_name, 'none') AS found, CASE WHEN a.c_name IS NOT NULL THEN 'customer' WHEN b.s_name IS NOT NULL THEN 'supplier' WHEN d.p_name IS NOT NULL THEN 'part' ELSE 'none' END AS via
  FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_acctbal > 5000 LEFT JOIN supplier b ON o_custkey = b.s_suppkey LEFT JOIN part d ON o_custkey = d.p_partkey""")
def jon_05_lookup_ladder(t: Tables) -> DataFrame:
    out = t.orders.join(t.customer.filter("c_acctbal > 5000"), c("o_custkey") == c("c_custkey"), "left").join(t.supplier, c("o_custkey") == c("s_suppkey"), "left").join(t.part, c("o_custkey") == c("p_partkey"), "left")
    via = C.first_of((c("c_name").isNotNull(), "customer"), (c("s_name").isNotNull(), "supplier"), (c("p_name").isNotNull(), "part"), otherwise="none")
    return out.select("o_orderkey", F.coalesce("c_name", "s_name", "p_name", F.lit("none")).alias("found"), via.alias("via"))


@BOOK.query("""SELECT l_partkey, l_suppkey, count(*) AS n, round(max(m.q), 2) AS q FROM lineitem JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) m USING (l_partkey, l_suppkey) GROUP BY 1, 2""")
def jon_06_multi_column(t: Tables) -> DataFrame:
    most = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    return t.lineitem.join(most, ["l_partkey", "l_suppkey"]).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.max("q"), 2).alias("q"))


@BOOK.query("SELECT (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01') AS last_history, (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') AS first_target")
def jon_07_two_scalars(t: Tables) -> DataFrame:
    """Two one-row aggregates from one scan instead of a cross join of the tables."""
    cutoff = F.lit("2000-01-01").cast("timestamp")
    d = c("o_orderdate").cast("timestamp")
    return t.orders.agg(F.max(F.when(d < cutoff, c("o_orderdate"))).alias("last_history"), F.min(F.when(d >= cutoff, c("o_orderdate"))).alias("first_target"))


@BOOK.query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def jon_08_join_back(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.round(c("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey")), 9).alias("share"))


@BOOK.query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jon_09_many_to_one(t: Tables) -> DataFrame:
    """A join that first proves the right side's key unique."""
    return t.orders.join(T.assert_unique(t.customer, ["c_custkey"]), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@BOOK.query("SELECT CASE WHEN c.k IS NULL THEN 'right_only' WHEN w.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT id_notice_can AS k FROM can_2017) c FULL JOIN (SELECT id_notice_can AS k FROM can_withdrawn) w ON c.k = w.k GROUP BY 1")
def jon_10_reconcile(t: Tables) -> DataFrame:
    a = t.can_2017.select(c("id_notice_can").alias("a")).distinct()
    b = t.can_withdrawn.select(c("id_notice_can").alias("b"))
    side = C.first_of((c("a").isNull(), "right_only"), (c("b").isNull(), "left_only"), otherwise="both")
    return a.join(b, c("a") == c("b"), "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@BOOK.query("SELECT o_orderkey, (SELECT round(avg(o_totalprice), 4) FROM orders) AS mean_price FROM orders WHERE o_totalprice > 1.5 * (SELECT avg(o_totalprice) FROM orders)")
def jon_13_scalar_subquery(t: Tables) -> DataFrame:
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    return t.orders.filter(c("o_totalprice") > 1.5 * mean).select("o_orderkey", F.round(mean, 4).alias("mean_price"))


# aggregates

@BOOK.query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1, 2")
def agg_01_hash(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"))


@BOOK.query("SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_quantity > 25) AS large FROM lineitem GROUP BY 1")
def agg_02_filtered(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").alias("returned"), F.count_if(c("l_quantity") > 25).alias("large"))


@BOOK.query("SELECT p_type, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def agg_03_distinct(t: Tables) -> DataFrame:
    """Both distinct counts from one pre-aggregated set instead of an expanded input."""
    pairs = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.max((c("l_returnflag") == "R").cast("int")).alias("r"))
    return pairs.groupBy("p_type").agg(F.count("l_suppkey").alias("suppliers"), F.sum("r").alias("returned"))


@BOOK.query("SELECT id_notice_can, max(cae_name) AS cae_name, max(title) FILTER (WHERE win_name IS NOT NULL) AS title, min(loaded_at) AS first_loaded FROM can_2017 GROUP BY 1")
def agg_04_any_value(t: Tables) -> DataFrame:
    return t.can_2017.groupBy("id_notice_can").agg(F.max("cae_name").alias("cae_name"), F.max(F.when(c("win_name").isNotNull(), c("title"))).alias("title"), F.min("loaded_at").alias("first_loaded"))


@BOOK.query("SELECT id_notice_can, CASE WHEN count(DISTINCT cpv) = 1 THEN max(cpv) END AS cpv, CASE WHEN count(DISTINCT cae_type) = 1 THEN max(cae_type) END AS cae_type FROM can_2017 GROUP BY 1")
def agg_05_unanimous(t: Tables) -> DataFrame:
    return t.can_2017.groupBy("id_notice_can").agg(A.unanimous(c("cpv")).alias("cpv"), A.unanimous(c("cae_type")).alias("cae_type"))


@BOOK.query(f"SELECT id_notice_can, bool_or({_B.format('b_eu_funds')}) AS any_funds, bool_and({_B.format('b_eu_funds')}) AS all_funds FROM can_2017 GROUP BY 1")
def agg_06_bool(t: Tables) -> DataFrame:
    b = C.parse_bool(c("b_eu_funds"))
    return t.can_2017.groupBy("id_notice_can").agg(F.bool_or(b).alias("any_funds"), F.bool_and(b).alias("all_funds"))


@BOOK.query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY 1")
def agg_07_quantile(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("p50"), F.round(F.percentile("o_totalprice", 0.9), 4).alias("p90"))


@BOOK.query("SELECT id_notice_can, array_to_string(list_sort(list(DISTINCT win_country_code)), ' | ') AS countries FROM can_2017 WHERE win_country_code IS NOT NULL GROUP BY 1")
def agg_08_joined(t: Tables) -> DataFrame:
    return t.can_2017.filter("win_country_code is not null").groupBy("id_notice_can").agg(A.joined_set(c("win_country_code")).alias("countries"))


@BOOK.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def agg_09_repeated_keys(t: Tables) -> DataFrame:
    return T.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@BOOK.query("SELECT DISTINCT win_name, win_town FROM can_2017")
def agg_10_distinct_rows(t: Tables) -> DataFrame:
    return t.can_2017.select("win_name", "win_town").distinct()


@BOOK.query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (source_row_id, loaded_at) FROM can_2017)) AS n_repeats FROM can_2017")
def agg_11_exact_repeats(t: Tables) -> DataFrame:
    return A.repeated_rows(t.can_2017, [x for x in t.can_2017.columns if x not in ("source_row_id", "loaded_at")])


@BOOK.query("SELECT l_suppkey, round(sum(n * n) / pow(sum(n), 2), 9) AS hhi, count(*) AS n_members FROM (SELECT l_suppkey, o_custkey, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def agg_12_buyer_hhi(t: Tables) -> DataFrame:
    base = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    return A.concentration(base, ["l_suppkey"], "o_custkey").withColumn("hhi", F.round("hhi", 9))


@BOOK.query("SELECT l_suppkey, p_type, round(n / nullif(sum(n) OVER (PARTITION BY l_suppkey), 0), 9) AS share FROM (SELECT l_suppkey, p_type, count(*)::DOUBLE AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)")
def agg_13_share(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
    return per.select("l_suppkey", "p_type", F.round(A.share(c("n"), F.sum("n").over(W.partitionBy("l_suppkey"))), 9).alias("share"))


_CORE = ("win_name", "win_nationalid", "win_town", "cpv", "dt_award", "award_value_euro", "title")


@BOOK.query("SELECT *, " + " OR ".join(f"{f}_differs" for f in _CORE) + " AS in_conflict FROM (SELECT id_notice_can, id_award, count(*) AS n_rows, " + ", ".join(f"count(DISTINCT {f}) > 1 AS {f}_differs" for f in _CORE) + " FROM can_2017 GROUP BY 1, 2)")
def agg_14_conflicts(t: Tables) -> DataFrame:
    return A.conflicts(t.can_2017, ["id_notice_can", "id_award"], list(_CORE))


@BOOK.query("SELECT rows_per_key, count(*) AS n_keys FROM (SELECT id_notice_can, count(*) AS rows_per_key FROM can_2017 GROUP BY 1) GROUP BY 1")
def agg_15_counts_of_counts(t: Tables) -> DataFrame:
    return A.counts_of_counts(t.can_2017, ["id_notice_can"])


@BOOK.query("SELECT iso_country_code, cae_type, count(*) AS n, count(DISTINCT cae_name) AS names FROM cn_2017 GROUP BY 1, 2")
def agg_16_null_groups(t: Tables) -> DataFrame:
    """Null keys form groups of their own."""
    return t.cn_2017.groupBy("iso_country_code", "cae_type").agg(F.count("*").alias("n"), F.count_distinct("cae_name").alias("names"))


@BOOK.query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def agg_17_pivot(t: Tables) -> DataFrame:
    return A.pivoted(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], F.count(F.lit(1))).fillna(0)


@BOOK.query("""WITH s AS (SELECT count(*) AS n, count(*) FILTER (WHERE win_name IS NOT NULL) AS a, count(*) FILTER (WHERE win_name IS NOT NULL AND win_country_code IS NOT NULL) AS b,
  count(*) FILTER (WHERE win_name IS NOT NULL AND win_country_code IS NOT NULL AND win_nationalid IS NOT NULL) AS d FROM can_2017)
SELECT 1 AS step, 'named' AS stage, a AS n_left, round(a / n, 6) AS share_of_all, round(a / n, 6) AS share_of_previous FROM s
UNION ALL SELECT 2, 'with_country', b, round(b / n, 6), round(b / a, 6) FROM s UNION ALL SELECT 3, 'with_identifier', d, round(d / n, 6), round(d / b, 6) FROM s""")
def agg_18_funnel(t: Tables) -> DataFrame:
    return A.funnel(t.can_2017, [("named", c("win_name").isNotNull()), ("with_country", c("win_country_code").isNotNull()), ("with_identifier", c("win_nationalid").isNotNull())])


@BOOK.query("SELECT unnest(['rows', 'notices', 'winners']) AS metric, unnest([count(*), count(DISTINCT id_notice_can), count(win_name)])::DOUBLE AS value FROM can_2017")
def agg_19_ledger(t: Tables) -> DataFrame:
    return T.ledger(t.can_2017, {"rows": F.count("*"), "notices": F.count_distinct("id_notice_can"), "winners": F.count("win_name")})


_COV = ("cae_name", "cae_town", "cpv", "win_name", "win_nationalid", "win_town", "dt_award", "title", "crit_weights")


@BOOK.query(" UNION ALL ".join(f"SELECT '{x}' AS column_name, count(*) AS n_rows, count(nullif(trim({x}), '')) AS n_values, round(count(nullif(trim({x}), '')) / count(*), 6) AS share FROM can_2017" for x in _COV))
def agg_20_coverage(t: Tables) -> DataFrame:
    return T.coverage(t.can_2017, list(_COV))


# windows

@BOOK.query("SELECT k, name FROM (SELECT iso_country_code AS k, cae_name AS name, row_number() OVER (PARTITION BY iso_country_code ORDER BY count(*) DESC, max(loaded_at) DESC NULLS LAST, length(cae_name) DESC, cae_name) AS r FROM cn_2017 WHERE cae_name IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def win_01_canonical(t: Tables) -> DataFrame:
    """The first by an order, as one aggregate: greatest struct per key, no sort."""
    per = t.cn_2017.filter("cae_name is not null").groupBy(c("iso_country_code").alias("k"), c("cae_name").alias("name")).agg(F.count("*").alias("n"), F.max("loaded_at").alias("at"))
    r = F.row_number().over(W.partitionBy("k").orderBy(F.desc("n"), F.desc_nulls_last("at"), F.desc(F.length("name")), "name"))
    return per.withColumn("r", r).filter("r = 1").select("k", "name")


@BOOK.query("SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def win_02_share_of_all(t: Tables) -> DataFrame:
    per = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    return per.select("event_type", "n", F.round(c("n") / per.agg(F.sum("n")).scalar(), 9).alias("share"))


@BOOK.query("SELECT user_id, event_type, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 9) AS share FROM events GROUP BY 1, 2")
def win_03_share_of_group(t: Tables) -> DataFrame:
    per = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.select("user_id", "event_type", F.round(c("n") / F.sum("n").over(W.partitionBy("user_id")), 9).alias("share"))


@BOOK.query("""SELECT *, best + ties - 1 AS worst, (best + best + ties - 1) / 2.0 AS mid FROM (
  SELECT p_type, l_suppkey, n, rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS best, count(*) OVER (PARTITION BY p_type, n) AS ties
  FROM (SELECT p_type, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))""")
def win_04_tied_ranks(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.count("*").alias("n"))
    return tied_ranks(per, ["p_type"], "n").select("p_type", "l_suppkey", "n", "best", "worst", "mid", "ties")


@BOOK.query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def win_06_ordinal(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@BOOK.query("SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def win_07_lag(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


# sorting and limits: the limit is the feature

@BOOK.query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END AS class FROM orders ORDER BY class, o_totalprice DESC, o_orderkey")
def srt_01_order(t: Tables) -> DataFrame:
    cls = F.when(c("o_orderpriority").like("1%"), 0).otherwise(1)
    return t.orders.select("o_orderkey", "o_totalprice", cls.alias("class")).orderBy("class", F.desc("o_totalprice"), "o_orderkey")


@BOOK.query("SELECT win_town AS value, count(*) AS n FROM can_2017 WHERE win_town IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def srt_02_top_values(t: Tables) -> DataFrame:
    return t.can_2017.filter("win_town is not null").groupBy(c("win_town").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(20)


@BOOK.query("SELECT p_type, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, l_suppkey) AS r FROM (SELECT p_type, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE r <= 10")
def srt_03_top_k(t: Tables) -> DataFrame:
    per = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.count("*").alias("n"))
    return per.withColumn("r", F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("n"), "l_suppkey"))).filter("r <= 10").drop("r")


@BOOK.query("""SELECT p_type, l_suppkey, n FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, l_suppkey) AS r FROM (SELECT p_type, l_suppkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_suppkey <> (SELECT min(l_suppkey) FROM lineitem) GROUP BY 1, 2)) WHERE r <= 5""")
def srt_05_hard_negatives(t: Tables) -> DataFrame:
    """The best that are not the winner (here the supplier with the least key)."""
    winner = t.lineitem.agg(F.min("l_suppkey")).scalar()
    per = t.lineitem.filter(c("l_suppkey") != winner).join(t.part, c("l_partkey") == c("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.count("*").alias("n"))
    return per.withColumn("r", F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("n"), "l_suppkey"))).filter("r <= 5").drop("r")


@BOOK.query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|42'), o_orderkey LIMIT 500")
def srt_06_sample(t: Tables) -> DataFrame:
    """A sample of 500 orders that depends on nothing but their keys and a seed."""
    return t.orders.orderBy(F.md5(F.concat_ws("|", "o_orderkey", F.lit(42))), "o_orderkey").limit(500).select("o_orderkey")


# set operations

@BOOK.query("SELECT source_row_id, cae_name, win_name FROM can_2017 UNION ALL BY NAME SELECT source_row_id, cae_name, duration FROM cn_2017")
def set_01_union_by_name(t: Tables) -> DataFrame:
    return T.union_by_name(t.can_2017.select("source_row_id", "cae_name", "win_name"), t.cn_2017.select("source_row_id", "cae_name", "duration"))


@BOOK.query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_02_union_all(t: Tables) -> DataFrame:
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@BOOK.query("""WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS f, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1)
SELECT k, len(list_intersect(coalesce(f, []), coalesce(o, []))) AS n_both, len(list_distinct(list_concat(coalesce(f, []), coalesce(o, [])))) AS n_any FROM a""")
def set_03_algebra(t: Tables) -> DataFrame:
    sets = t.orders.groupBy(c("o_custkey").alias("k")).agg(*[F.collect_set(F.when(c("o_orderstatus") == s, c("o_orderpriority"))).alias(s) for s in "FO"])
    return sets.select("k", F.size(F.array_intersect("F", "O")).alias("n_both"), F.size(F.array_union("F", "O")).alias("n_any"))
