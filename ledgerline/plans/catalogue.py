"""The registered queries: each operator over the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions import addresses, geometry, names, printed, transcribed, values
from ledgerline.operators import aggregates as A
from ledgerline.operators import folds, fuzzy, joins, linkage, spatial, statistics
from ledgerline.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt out by its key, for what is dear by row: a file of a few MB is read as one partition."""
    return _t(spark, sf_dir, name).repartition(key)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years' override joined with the orders' composition."""
    return city_year_override(spark, sf_dir).crossJoin(F.broadcast(household_composition(spark, sf_dir).filter("o_orderpriority = '1-URGENT'").select("with_returns", "pct_mixed")))


@_query("""
WITH base AS (SELECT CAST(year(o_orderdate) AS INTEGER) yr, CAST(count(*) AS BIGINT) households, CAST(round(sum(o_totalprice)) AS BIGINT) population FROM orders GROUP BY 1),
newer AS (SELECT CAST(year(l_shipdate) AS INTEGER) yr, CAST(sum(l_quantity) AS BIGINT) population FROM lineitem GROUP BY 1)
SELECT coalesce(b.yr, n.yr) yr, b.households, CASE WHEN n.yr IS NOT NULL THEN n.population ELSE b.population END population FROM base b FULL JOIN newer n ON b.yr = n.yr""")
def city_year_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years by orders, overridden by what was shipped; households stay those of the orders."""
    base = _t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("households"), F.round(F.sum("o_totalprice")).cast("bigint").alias("population"))
    newer = _t(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("yr")).agg(F.sum("l_quantity").cast("bigint").alias("population"))
    return joins.override(base, newer, ["yr"], ["households"])


@_query("""
WITH o AS (SELECT l_orderkey, count(*) n, count(*) FILTER (l_returnflag = 'R') fb FROM lineitem GROUP BY 1)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) orders, CAST(count(*) FILTER (fb > 0) AS BIGINT) with_returns, CAST(count(*) FILTER (fb > 0 AND n - fb <= 0) AS BIGINT) only_returns,
 CAST(count(*) FILTER (fb > 0 AND n - fb > 0) AS BIGINT) mixed, CAST(sum(fb) AS BIGINT) returned, round(count(*) FILTER (fb > 0 AND n - fb > 0) * 100.0 / nullif(count(*) FILTER (fb > 0), 0), 1) pct_mixed
FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def household_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with returned lines only, mixed ones, and their share: one pass of conditional counts."""
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("fb"))
    rest = F.col("n") - F.col("fb")
    has, mixed = F.col("fb") > 0, (F.col("fb") > 0) & (rest > 0)
    rows = per.join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority")
    return rows.agg(F.count("*").alias("orders"), F.count_if(has).alias("with_returns"), F.count_if(has & (rest <= 0)).alias("only_returns"), F.count_if(mixed).alias("mixed"), F.sum("fb").alias("returned"), A.pct(F.count_if(mixed), F.count_if(has), 1).alias("pct_mixed"))


@_query("""
WITH o AS (SELECT l_orderkey, count(*) n FROM lineitem GROUP BY 1)
SELECT o_orderpriority, CAST(count(*) AS BIGINT) n, CAST(list_sort(list(o.n))[count(*) // 2 + 1] AS BIGINT) upper_median FROM o JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def holding_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    rows = per.join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return A.upper_median(rows, ["o_orderpriority"], "lines")


_BANDS = [("0-9", 0, 10), ("10-19", 10, 20), ("20-34", 20, 35), ("35-50", 35, 51), ("51+", 51, 900), ("unknown", 900, 1000)]
_BANDS_SQL = ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in _BANDS)


@_query(f"""
SELECT band, CAST(count(p_partkey) AS BIGINT) n, CAST(count(*) FILTER (p_type = 'ECONOMY') AS BIGINT) economy, CAST(count(*) FILTER (p_type = 'STANDARD') AS BIGINT) standard,
 CAST(count(*) FILTER (p_type NOT IN ('ECONOMY', 'STANDARD')) AS BIGINT) other FROM (VALUES {_BANDS_SQL}) b(band, low, high) LEFT JOIN part ON p_size >= low AND p_size < high GROUP BY band HAVING band <> 'unknown' OR count(p_partkey) > 0""")
def age_sex_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open bands by codes; empty bands appear, the sentinel band only if it has rows."""
    kind = F.col("p_type")
    return A.banded(_t(spark, sf_dir, "part"), "p_size", _BANDS, sentinels=["unknown"], aggregates=[F.count("p_partkey").alias("n"), F.count_if(kind == "ECONOMY").alias("economy"), F.count_if(kind == "STANDARD").alias("standard"), F.count_if(~kind.isin("ECONOMY", "STANDARD")).alias("other")])


_CLOSED = [("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11+", 11, 1_000_000)]


@_query(f"""
SELECT band, CAST(count(l_orderkey) AS BIGINT) people, CAST(count(DISTINCT l_orderkey) AS BIGINT) holdings FROM (VALUES {", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in _CLOSED)}) b(band, low, high)
LEFT JOIN lineitem ON l_quantity >= low AND l_quantity <= high GROUP BY band""")
def holding_bands_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.banded(_t(spark, sf_dir, "lineitem"), "l_quantity", _CLOSED, [F.count("l_orderkey").alias("people"), F.count_distinct("l_orderkey").alias("holdings")], closed=True)


def _wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("ward")).agg(F.count("*").alias("black"))
    s = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("ward")).agg(F.count("*").alias("white"))
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ward"))
    rows = n.join(c, "ward", "left").join(s, "ward", "left").select("ward", F.coalesce("black", F.lit(0)).alias("black"), F.coalesce("white", F.lit(0)).alias("white"))
    return rows.withColumn("aggregate", F.col("black") + F.col("white"))


_WARDS = """WITH w AS (SELECT n_nationkey ward, coalesce(b, 0) black, coalesce(s, 0) white, coalesce(b, 0) + coalesce(s, 0) aggregate FROM nation
 LEFT JOIN (SELECT c_nationkey, count(*) b FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"""


@_query(_WARDS + " SELECT ward, CAST(black AS BIGINT) black, CAST(white AS BIGINT) white, CAST(aggregate AS BIGINT) aggregate, round(black * 100.0 / nullif(aggregate, 0), 2) black_pct FROM w")
def ward_shares_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares by ward, after the rows' identities and the columns' totals were checked against the source tables."""
    printed = {"black": _t(spark, sf_dir, "customer").count(), "white": _t(spark, sf_dir, "supplier").count()}
    return A.reconciled(_wards(spark, sf_dir), ["black", "white"], "aggregate", printed).withColumn("black_pct", A.pct(F.col("black"), F.col("aggregate")))


@_query(_WARDS + " SELECT round(0.5 * sum(abs(black / (SELECT sum(black) FROM w)::DOUBLE - white / (SELECT sum(white) FROM w)::DOUBLE)), 6) dissimilarity FROM w")
def dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.dissimilarity(_wards(spark, sf_dir), "black", "white").select(F.round("dissimilarity", 6).alias("dissimilarity"))


@_query(_WARDS + ", p AS (SELECT black * 100.0 / nullif(aggregate, 0) pct FROM w) SELECT round(stddev_samp(pct), 6) sd, round(stddev_samp(pct) / avg(pct), 6) cv FROM p")
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _wards(spark, sf_dir).select((F.col("black") * 100.0 / F.nullif(F.col("aggregate"), F.lit(0))).alias("pct"))
    return statistics.dispersion(rows, "pct").select(F.round("sd", 6).alias("sd"), F.round("cv", 6).alias("cv"))


@_query(_WARDS + " SELECT ward, round((black / nullif(aggregate, 0)::DOUBLE) / ((SELECT sum(black) FROM w) / (SELECT sum(aggregate) FROM w)::DOUBLE), 6) quotient FROM w")
def location_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.location_quotient(_wards(spark, sf_dir), "black", "aggregate").select("ward", F.round("quotient", 6).alias("quotient"))


@_query(_WARDS + " SELECT round(corr(black, white), 6) r FROM w")
def ward_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wards(spark, sf_dir).agg(F.round(F.corr("black", "white"), 6).alias("r"))


@_query(_WARDS + " SELECT ward, round((white / (SELECT sum(white) FROM w)::DOUBLE) / nullif(black / (SELECT sum(black) FROM w)::DOUBLE, 0), 6) representation FROM w")
def representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ward's share of the directory over its share of the census."""
    rows = _wards(spark, sf_dir)
    whole = rows.agg(F.sum("white").alias("w"), F.sum("black").alias("b"))
    return rows.crossJoin(F.broadcast(whole)).select("ward", F.round((F.col("white") / F.col("w")) / F.nullif(F.col("black") / F.col("b"), F.lit(0.0)), 6).alias("representation"))


@_query("""
WITH r AS (SELECT n_name ward, year(o_orderdate) yr, sum(o_totalprice) v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT a.ward, round(a.v, 2) before, round(b.v, 2) after, round(b.v - a.v, 2) delta FROM r a JOIN r b ON a.ward = b.ward AND a.yr = 1995 AND b.yr = 1996""")
def year_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years side by side: one aggregate with conditional sums instead of a self-join."""
    o = _t(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate")).filter(F.col("yr").isin(1995, 1996))
    rows = o.join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(F.when(F.col("yr") == 1995, F.col("o_totalprice"))).alias("a"), F.sum(F.when(F.col("yr") == 1996, F.col("o_totalprice"))).alias("b"))
    rows = rows.filter("a is not null and b is not null").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("ward"), F.round("a", 2).alias("before"), F.round("b", 2).alias("after"), F.round(F.col("b") - F.col("a"), 2).alias("delta"))


@_query("""
SELECT n_name ward, CAST(round(sum(coalesce(o_totalprice, 0))) AS BIGINT) AS value, CAST(count(o_orderkey) AS BIGINT) dwellings, CAST(CASE WHEN count(o_orderkey) = 0 THEN 0 ELSE round(sum(o_totalprice) / count(o_orderkey)) END AS BIGINT) value_per_dwelling
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def valuation_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("d"))
    rows = _t(spark, sf_dir, "nation").join(o, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return rows.select(F.col("n_name").alias("ward"), F.round(F.coalesce("v", F.lit(0.0))).cast("bigint").alias("value"), F.coalesce("d", F.lit(0)).cast("bigint").alias("dwellings"), F.coalesce(F.round(F.col("v") / F.nullif(F.col("d"), F.lit(0))), F.lit(0.0)).cast("bigint").alias("value_per_dwelling"))


@_query("""
WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) term FROM documents),
c AS (SELECT lang, term, CAST(count(*) AS BIGINT) n FROM t GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS INTEGER) rank FROM c)
SELECT lang, term, n, rank FROM r WHERE rank <= 40""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 most frequent terms of each language, ties by term."""
    words = _t(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term"))
    return A.top_k(words.groupBy("lang", "term").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.col("term")], 40)


_PERSON = "split_part(p_name, ' ', 1) surname, '' given, CASE p_partkey % 6 WHEN 0 THEN 'grocer and dealer' WHEN 1 THEN 'barber' WHEN 2 THEN 'works at smith''s store' WHEN 3 THEN 'laborer' WHEN 4 THEN 'oyster house' ELSE '' END occupation"


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    occ = F.when(k == 0, "grocer and dealer").when(k == 1, "barber").when(k == 2, "works at smith's store").when(k == 3, "laborer").when(k == 4, "oyster house").otherwise("")
    return _t(spark, sf_dir, "part").select("p_partkey", F.get(F.split("p_name", " "), 0).alias("surname"), F.lit("").alias("given"), occ.alias("occupation"))


@_query(f"""
WITH p AS (SELECT p_partkey, {_PERSON} FROM part)
SELECT p_partkey, CASE WHEN occupation <> '' AND NOT regexp_matches(occupation, '\\b(in|at|for)\\s+\\w+(''s)?\\s+(store|shop|house)\\b') AND regexp_matches(occupation, 'grocer|oyster (dealer|house)|barber') THEN 'business' ELSE 'resident' END category,
 CASE WHEN occupation IN ('grocer and dealer', 'oyster house') THEN 'food' WHEN occupation = 'barber' THEN 'service' ELSE '' END subtype FROM p""")
def classify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _people(spark, sf_dir).withColumn("c", names.record_class(F.col("surname"), F.col("given"), F.col("occupation")))
    return rows.select("p_partkey", "c.category", "c.subtype")


@_query("""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'apache license|mit license|cc by|gnu general') THEN 'licensed' WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'contact'
 WHEN regexp_matches(text, '\\|[^\\n]*\\|') THEN 'table' ELSE 'prose' END kind FROM documents""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules, the first that matches."""
    text = F.col("text")
    kind = F.when(F.lower(text).rlike("apache license|mit license|cc by|gnu general"), "licensed").when(text.rlike("[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "contact").when(text.rlike(r"\|[^\n]*\|"), "table").otherwise("prose")
    return _t(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


_STREET = "CASE c_custkey % 5 WHEN 0 THEN n_name || ' (N.)' WHEN 1 THEN 's ' || n_name || ' al' WHEN 2 THEN 'L. ' || n_name WHEN 3 THEN 'N ' || n_name || ' ST' ELSE n_name || ', (W)' END"


def _streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey") % 5, F.col("n_name")
    raw = F.when(k == 0, F.concat(n, F.lit(" (N.)"))).when(k == 1, F.concat(F.lit("s "), n, F.lit(" al"))).when(k == 2, F.concat(F.lit("L. "), n)).when(k == 3, F.concat(F.lit("N "), n, F.lit(" ST"))).otherwise(F.concat(n, F.lit(", (W)")))
    rows = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "n_name", raw.alias("raw"))


@_query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 2 THEN 'LITTLE ' ELSE '' END || regexp_replace(upper(n_name), '[^A-Z0-9'' ]', ' ', 'g') core, CASE c_custkey % 5 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN '' WHEN 3 THEN 'N' ELSE 'W' END dir
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def street_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streets(spark, sf_dir).select("c_custkey", names.street_key(F.col("raw")).alias("k")).select("c_custkey", "k.core", "k.dir")


@_query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'numbered' WHEN 1 THEN 'relative' WHEN 2 THEN 'street_only' ELSE 'relative' END addr_type, CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN '12' ELSE '' END house_no,
 n_name || ' st' street, CASE c_custkey % 4 WHEN 1 THEN 's' WHEN 3 THEN 'w' ELSE '' END bearing, CASE c_custkey % 4 WHEN 1 THEN 'Fleet' WHEN 3 THEN 'Pearl' ELSE '' END cross_street, CASE WHEN c_custkey % 4 = 2 THEN 'e' ELSE '' END side
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def address_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, st = F.col("c_custkey") % 4, F.concat("n_name", F.lit(" st"))
    raw = F.when(k == 0, F.concat(F.col("c_custkey").cast("string"), F.lit(" "), st)).when(k == 1, F.concat(st, F.lit(" s of Fleet."))).when(k == 2, F.concat(F.lit("e. side "), st, F.lit(","))).otherwise(F.concat(F.lit("12 "), st, F.lit(" w oi Pearl")))
    return _streets(spark, sf_dir).select("c_custkey", addresses.address(raw).alias("a")).select("c_custkey", "a.*")


@_query("""
WITH l AS (SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)),
 lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '') lines FROM pages)
SELECT page_id, CAST(len(lines) AS BIGINT) n_lines, CAST(list_sum(list_transform(lines, lambda x: length(x))) AS BIGINT) n_chars, lines[1] first_line FROM l""")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.array(readers.html_lines(F.col("html")))).alias("lines"))
    return rows.select("page_id", F.size("lines").cast("bigint").alias("n_lines"), F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)).cast("bigint").alias("n_chars"), F.get("lines", F.lit(0)).alias("first_line"))


@_query("""
WITH s AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) run FROM s)
SELECT conv_id, CAST(run AS BIGINT) run, role, CAST(count(*) AS BIGINT) turns, CAST(sum(length(text)) AS BIGINT) chars FROM g GROUP BY 1, 2, 3""")
def line_join_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role."""
    rows = _t(spark, sf_dir, "conversations")
    starts = ~F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).eqNullSafe(F.col("role"))
    return folds.runs(rows.withColumn("_f", starts), ["conv_id"], ["turn"], F.col("_f")).groupBy("conv_id", "run", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@_query("""
WITH m AS (SELECT *, min(ts) FILTER (event_type = 'purchase') OVER w a, max(ts) FILTER (event_type = 'purchase') OVER w z FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, CAST(count(*) AS BIGINT) n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) errors FROM m WHERE ts >= a AND ts <= z GROUP BY 1""")
def section_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.between_markers(_t(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "purchase")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@_query("""
WITH r AS (SELECT user_id, epoch_us(ts) // 1000000 s, min(value) v FROM events WHERE event_type = 'view' GROUP BY 1, 2), p AS (SELECT *, lead(s) OVER w s2, lead(v) OVER w v2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s)),
q AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 s FROM events WHERE event_type = 'error')
, m AS (SELECT q.user_id, q.s probe, round(v + (v2 - v) * (q.s - p.s) / (p.s2 - p.s), 4) interpolated, row_number() OVER (PARTITION BY q.user_id, q.s ORDER BY p.s) rn FROM q JOIN p ON q.user_id = p.user_id AND p.s <= q.s AND q.s <= s2)
SELECT q.user_id, CAST(q.s AS BIGINT) probe, interpolated FROM q LEFT JOIN m ON q.user_id = m.user_id AND q.s = m.probe AND rn = 1""")
def bracket_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    rungs = events.filter("event_type = 'view'").groupBy("user_id", "s").agg(F.min("value").alias("v"))
    probes = events.filter("event_type = 'error'").select("user_id", F.col("s").alias("probe")).distinct()
    return joins.bracket(rungs, probes, "user_id", "s", "v", "probe").select("user_id", "probe", F.round("interpolated", 4).alias("interpolated"))


@_query("""
SELECT event_id, user_id, (SELECT min(epoch_us(b.ts)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND epoch_us(b.ts) > epoch_us(a.ts)) next_error FROM events a WHERE event_type = 'purchase'""")
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next error strictly after each purchase of a user."""
    events = _t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    right = events.filter("event_type = 'error'").select("user_id", F.col("us").alias("next_error"))
    return joins.next_after(left, right, "user_id", "us", "next_error").drop("us")


@_query("""
WITH o AS (SELECT o_custkey, o_totalprice v, row_number() OVER w i, lag(o_totalprice) OVER w p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), d AS (SELECT o_custkey, CASE WHEN sum(sign(v - p)) < 0 THEN -1 ELSE 1 END way FROM o GROUP BY 1),
r AS (SELECT o.o_custkey, v * way s, way, max(v * way) OVER (PARTITION BY o.o_custkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) best FROM o JOIN d ON o.o_custkey = d.o_custkey)
SELECT o_custkey, CAST(count(*) AS INTEGER) n, CAST(count(*) FILTER (best IS NULL OR s > best) AS INTEGER) kept, round(max(s) * any_value(way), 2) AS last FROM r GROUP BY 1""")
def monotone_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a customer's orders kept in the direction that most steps take: what SQL sees as records of a running maximum."""
    orders = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))).alias("o"))
    kept = folds.monotone(F.transform("o", lambda x: x["o_totalprice"]))
    return orders.select("o_custkey", F.size("o").alias("n"), F.size(kept).alias("kept"), F.round(F.element_at(kept, -1), 2).alias("last"))


@_query("SELECT c_nationkey, c_mktsegment, c_custkey, round(c_acctbal, 2) c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) rn FROM customer) WHERE rn = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.first_wins(_t(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])
    return rows.select("c_nationkey", "c_mktsegment", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@_query("SELECT user_id, event_type, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.last_wins(_t(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 4).alias("value"))


@_query("SELECT DISTINCT p_brand AS old, p_type AS new FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size <= 10 AND q.p_brand = p.p_brand AND q.p_type = p.p_type)")
def alias_append_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("old"), F.col("p_type").alias("new"), "p_size")
    return joins.append_new(pairs.filter("p_size <= 10"), pairs.filter("p_size > 25").drop("p_size"), ["old", "new"])


@_query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS entry FROM part), p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN 'was ' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || 'x' END probe, split_part(p_name, ' ', 1) f FROM part),
n AS (SELECT DISTINCT probe FROM p WHERE p_partkey % 3 = 2), d AS (SELECT probe, entry, levenshtein(probe, entry) dist FROM n JOIN w ON levenshtein(probe, entry) <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY dist, entry) rn FROM d)
SELECT p.p_partkey, p.probe, CASE WHEN p.p_partkey % 3 < 2 THEN f ELSE b.entry END resolved, CASE p.p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'alias' ELSE CASE WHEN b.entry IS NOT NULL THEN 'fuzzy' END END how FROM p LEFT JOIN b ON b.probe = p.probe AND rn = 1""")
def cascade_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    first = F.get(F.split("p_name", " "), 0)
    k = F.col("p_partkey") % 3
    probes = part.select("p_partkey", F.when(k == 0, first).when(k == 1, F.concat(F.lit("was "), first)).otherwise(F.concat(first, F.lit("x"))).alias("probe"))
    lexicon = part.select(F.explode(F.split("p_name", " ")).alias("entry"))
    aliases = part.select(F.concat(F.lit("was "), first).alias("old"), first.alias("new")).distinct()
    return joins.cascade(probes, "probe", lexicon, "entry", aliases, "old", "new", 2)


@_query("""
SELECT CAST(count(*) AS BIGINT) n, CAST(count(*) FILTER (quality = toxic) AS BIGINT) agree, CAST(count(*) FILTER (quality <> toxic) AS BIGINT) disagree, CAST(count(*) FILTER (quality IS NULL OR toxic IS NULL) AS BIGINT) unknown FROM documents LEFT JOIN labels USING (doc_id)""")
def links_agree_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("quality") == F.col("toxic")
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if(~same).alias("disagree"), F.count_if(same.isNull()).alias("unknown"))


@_query("SELECT quality, CAST(count(*) AS BIGINT) n, CAST(count(*) FILTER (toxic = 1) AS BIGINT) found FROM labels GROUP BY ROLLUP (quality)")
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").rollup("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("found"))


@_query("""
WITH s AS (SELECT count(*)::DOUBLE n, sum(l_quantity) x, sum(l_extendedprice) y, sum(l_quantity * l_quantity) xx, sum(l_quantity * l_extendedprice) xy, sum(l_extendedprice * l_extendedprice) yy FROM lineitem), c AS (SELECT *, (n * xy - x * y) / (n * xx - x * x) b FROM s), d AS (SELECT *, (y - b * x) / n a FROM c)
SELECT round(a, 2) intercept, round(b, 2) slope, round(sqrt((yy - a * y - b * xy) / n), 2) rmse FROM d""")
def affine_fit_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, b), rmse = statistics.least_squares(_t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(a, 2), round(b, 2), round(rmse, 2))], "intercept double, slope double, rmse double")


@_query("""
WITH b AS (SELECT min(c_acctbal) x0, max(c_acctbal) x1, min(c_custkey) y0, max(c_custkey) y1 FROM customer)
SELECT c_custkey, round((c_acctbal - x0) * (1000.0 / (x1 - x0)), 1) sx, round((y1 - c_custkey) * (1000.0 / (x1 - x0)), 1) sy FROM customer, b""")
def screen_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer")
    box = rows.agg(F.min("c_acctbal").alias("x0"), F.max("c_acctbal").alias("x1"), F.max("c_custkey").alias("y1"))
    at = geometry.to_screen(F.col("c_acctbal"), F.col("c_custkey"), F.col("x0"), F.lit(0), F.col("y1"), F.lit(1000.0) / (F.col("x1") - F.col("x0")))
    return rows.crossJoin(F.broadcast(box)).select("c_custkey", at.alias("p")).select("c_custkey", "p.sx", "p.sy")


@_query("""
WITH p AS (SELECT s_suppkey, s_acctbal x, s_suppkey * 10.0 y FROM supplier), g AS (SELECT i, j, i * 2000.0 x0, j * 200.0 y0, (i + 1) * 2000.0 x1, (j + 1) * 200.0 y1 FROM range(-1, 5) a(i), range(0, 50) b(j))
SELECT s_suppkey, CAST(i AS BIGINT) i, CAST(j AS BIGINT) j FROM p JOIN g ON x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def point_in_box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 10.0).alias("y"))
    i = spark.range(-1, 5).withColumnRenamed("id", "i")
    boxes = i.select("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(49).cast("bigint"))).alias("j"))
    boxes = boxes.select("i", "j", (F.col("i") * 2000.0).alias("x0"), (F.col("j") * 200.0).alias("y0"), ((F.col("i") + 1) * 2000.0).alias("x1"), ((F.col("j") + 1) * 200.0).alias("y1"))
    return joins.in_boxes(points, boxes, "x", "y", 1000.0).select("s_suppkey", "i", "j")


@_query("SELECT p_brand, CAST(count(*) AS BIGINT) n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def unmatched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _t(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, sf_dir, "part").join(used, "p_partkey", "left_anti").groupBy("p_brand").agg(F.count("*").alias("n"))


@_query("SELECT lang, CAST(count(*) AS BIGINT) parsed, CAST(count(l.doc_id) AS BIGINT) placed, round(count(l.doc_id) * 100.0 / nullif(count(*), 0), 2) pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def coverage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    return _t(spark, sf_dir, "documents").select("doc_id", "lang").join(known, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("parsed"), F.count("l").alias("placed"), A.pct(F.count("l"), F.count("*")).alias("pct"))


@_query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name || ' ' || r_name), 'a')")
def category_filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose rendered text holds the letters searched for."""
    rows = _t(spark, sf_dir, "nation").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.filter(F.lower(F.concat_ws(" ", "n_name", "r_name")).contains("a")).select("n_nationkey", "n_name", "r_name")


@_query("""
WITH h AS (SELECT s_suppkey + 1000 AS key_b, CAST(s_suppkey % 50 * 10 AS DOUBLE) x0, s_suppkey % 50 * 10 + 95.0 x1, s_acctbal y FROM supplier), v AS (SELECT n_nationkey AS key_a, n_nationkey * 20 + 5.5 x FROM nation)
SELECT CAST(key_a AS BIGINT) key_a, CAST(key_b AS BIGINT) key_b, CAST(x AS DOUBLE) x, round(y, 2) y FROM h JOIN v ON x BETWEEN x0 AND x1""")
def line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the nations' upright lines cross the suppliers' level ones."""
    x = F.col("s_suppkey") % 50 * 10
    level = _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).cast("bigint").alias("key"), F.array(_point(x, F.col("s_acctbal")), _point(x + 95, F.col("s_acctbal"))).alias("points"))
    at = F.col("n_nationkey") * 20 + 5.5
    upright = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.array(_point(at, F.lit(-2000)), _point(at, F.lit(12000))).alias("points"))
    return spatial.crossings(level.unionByName(upright), "key", "points", 500.0).select("key_a", "key_b", "x", F.round("y", 2).alias("y"))


def _point(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 10 by 10 metres in rows of 40, one a supplier."""
    x, y = F.col("s_suppkey") % 40 * 10.5, F.floor(F.col("s_suppkey") / 40) * 10.25
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("key"), "s_acctbal", F.array(_point(x, y), _point(x + 10, y), _point(x + 10, y + 10), _point(x, y + 10)).alias("ring"))


_BLOCKS_SQL = "WITH b AS (SELECT CAST(s_suppkey AS BIGINT) k, s_acctbal v, s_suppkey % 40 * 10.5::DOUBLE x, floor(s_suppkey / 40) * 10.25::DOUBLE y FROM supplier)"


@_query(f"""
{_BLOCKS_SQL}, d AS (SELECT p.k key_a, q.k key_b, greatest(0, abs(p.x - q.x) - 10) dx, greatest(0, abs(p.y - q.y) - 10) dy FROM b p JOIN b q ON p.k < q.k)
SELECT key_a, key_b, round(sqrt(dx * dx + dy * dy), 4) distance FROM d WHERE sqrt(dx * dx + dy * dy) < 0.52""")
def polygon_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks less than 0.52 m apart: the next of a row and that of the row above, not those across the corner."""
    return spatial.adjacent(_blocks(spark, sf_dir), "key", "ring", 0.52, 25.0).select("key_a", "key_b", F.round("distance", 4).alias("distance"))


@_query(f"""
{_BLOCKS_SQL}, t AS (SELECT CAST(p_partkey AS BIGINT) ward, p_partkey % 20 * 23.0 x, floor(p_partkey / 20) * 21.0 y FROM part), o AS (SELECT ward, v, greatest(0, least(b.x + 10, t.x + 23) - greatest(b.x, t.x)) * greatest(0, least(b.y + 10, t.y + 21) - greatest(b.y, t.y)) a FROM b JOIN t ON b.x < t.x + 23 AND t.x < b.x + 10 AND b.y < t.y + 21 AND t.y < b.y + 10)
SELECT ward, round(sum(v * a / 100), 2) balance FROM o GROUP BY 1""")
def areal_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' balances, spread evenly over their blocks, by the wards that the blocks overlap."""
    x, y = F.col("p_partkey") % 20 * 23.0, F.floor(F.col("p_partkey") / 20) * 21.0
    wards = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("bigint").alias("ward"), F.array(_point(x, y), _point(x + 23, y), _point(x + 23, y + 21), _point(x, y + 21)).alias("ring"))
    return spatial.areal_interpolate(_blocks(spark, sf_dir), "ring", ["s_acctbal"], wards, "ward", "ring", 40.0).select("ward", F.round("s_acctbal", 2).alias("balance"))


@_query("""
WITH p AS (SELECT c_custkey, c_nationkey n, c_custkey % 10 k, CASE c_custkey % 3 WHEN 0 THEN 'e' WHEN 1 THEN 'w' ELSE '' END b FROM customer),
d AS (SELECT *, k * 100.0 + n AS d, CASE b WHEN 'e' THEN CASE WHEN k < 9 THEN 40.0 ELSE 12.0 END WHEN 'w' THEN CASE WHEN k > 0 THEN -40.0 ELSE -12.0 END ELSE 0.0 END s FROM p)
SELECT c_custkey, CAST(round(greatest(0.0, least(1000.0, d + s)), 4) AS DOUBLE) x, CAST(n * 100 + 7 AS DOUBLE) y, CASE WHEN b = '' THEN 'corner' ELSE 'block_face' END tier FROM d""")
def block_face_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on level streets, one a nation, with ten crossings each: north side, towards east or west."""
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("street"), (F.col("c_custkey") % 10).cast("int").alias("cross"), F.when(F.col("c_custkey") % 3 == 0, "e").when(F.col("c_custkey") % 3 == 1, "w").otherwise("").alias("bearing"), F.lit("n").alias("side"))
    streets = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("street"), F.array(_point(F.lit(0), F.col("n_nationkey") * 100), _point(F.lit(1000), F.col("n_nationkey") * 100)).alias("line"))
    meets = streets.select("street", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("cross")).withColumn("at", F.col("cross") * 100.0 + F.col("street"))
    placed = spatial.place_on_blocks(people, "street", "cross", "bearing", "side", streets, "line", meets, "at")
    return placed.select("c_custkey", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "tier")


@_query("""
WITH w AS (SELECT p_partkey, p_partkey % 3 k, upper(split_part(p_name, ' ', 1)) a, upper(split_part(p_name, ' ', 2)) b FROM part), s AS (SELECT * FROM w WHERE a <> b AND length(a) > 2 AND length(b) > 2)
SELECT p_partkey, a AS old, b AS new, 'now' AS relation FROM s WHERE k = 0 UNION ALL SELECT p_partkey, b, a, 'was' FROM s WHERE k = 1 UNION ALL SELECT p_partkey, a, b, 'see' FROM s WHERE k = 2 UNION ALL SELECT p_partkey, b, a, 'see' FROM s WHERE k = 2""")
def alias_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of old and new names that lines of an index state."""
    k, words = F.col("p_partkey") % 3, F.split("p_name", " ")
    relation = F.when(k == 0, ": now ").when(k == 1, ": was ").otherwise(": see ")
    line = F.concat(F.get(words, 0), F.lit(" Alley (old)"), relation, F.get(words, 1), F.when(k == 0, " 1850 and later").otherwise(""))
    return _dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.explode(names.alias_pairs(line)).alias("p")).select("p_partkey", "p.old", "p.new", "p.relation")


@_query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'Madden' ELSE 'Adams' END surname, CASE c_custkey % 3 WHEN 2 THEN 'John' ELSE 'Dennis' END given, 'labourer' occupation, CASE c_custkey % 3 WHEN 2 THEN c_custkey || ' Montgomery' ELSE '' END dwelling_raw,
CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' Temple' WHEN 1 THEN 'Pierce st w of Pearl' ELSE c_custkey || ' Montgomery' END addr_raw, CASE c_custkey % 3 WHEN 1 THEN 'relative' ELSE 'numbered' END addr_type FROM customer""")
def directory_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a directory parsed to people and the kind of their address."""
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("Adams Dennis, labourer, "), n, F.lit(" Temple"))).when(k == 1, "f Adams Dennis, labourer. Pierce st w of Pearl").otherwise(F.concat(F.lit("Madden, John, labourer, Pratt st, dw "), n, F.lit(" Montgomery")))
    parsed = _dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", addresses.entry(line).alias("e"))
    parsed = parsed.select("c_custkey", "e.surname", "e.given", "e.occupation", "e.dwelling_raw", "e.addr_raw")
    return parsed.withColumn("addr_type", addresses.address(F.col("addr_raw"))["addr_type"])


@_query()
def fuzzy_weighted_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, some with a letter more or their words turned round, and the name they resolve to."""
    part = _t(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    probe = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("x"), "p_name")).otherwise(F.array_join(F.reverse(F.split("p_name", " ")), " "))
    return fuzzy.best_match(part.select("p_partkey", probe.alias("probe")), "probe", part, "p_name")


@_query("""
WITH p AS (SELECT p_partkey, upper(split_part(p_name, ' ', 1)) a, upper(split_part(p_name, ' ', 2)) b FROM part)
SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN a ELSE b END AS old, CASE p_partkey % 2 WHEN 0 THEN b ELSE a END AS new, CASE p_partkey % 2 WHEN 0 THEN 'now' ELSE 'formerly' END AS relation FROM p WHERE a <> b AND length(b) > 2""")
def note_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of old and new names that the notes beside streets give."""
    words = F.split("p_name", " ")
    note = F.concat(F.when(F.col("p_partkey") % 2 == 0, "now called ").otherwise("(formerly "), F.get(words, 1), F.lit(" alley from the water"))
    return _dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", F.explode(names.note_alias_pairs(F.concat(F.get(words, 0), F.lit(" st")), note)).alias("p")).select("p_partkey", "p.old", "p.new", "p.relation")


@_query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM events""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's latest purchase so far."""
    rows = _t(spark, sf_dir, "events").withColumn("since", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return folds.carried(rows, ["user_id"], ["ts", "event_id"], ["since"]).select("event_id", "user_id", "since")


@_query("""
SELECT CAST(year(l_shipdate) AS INTEGER) yr, CAST(sum(CASE year(l_shipdate) WHEN 1993 THEN l_quantity WHEN 1994 THEN l_quantity + l_linenumber WHEN 1995 THEN l_quantity + l_linenumber ELSE l_linenumber END) AS BIGINT) counted FROM lineitem GROUP BY 1""")
def year_keyed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the columns that each year asks for."""
    year, bands = F.year("l_shipdate"), {1993: ["l_quantity"], 1994: ["l_quantity", "l_linenumber"], 1995: ["l_quantity", "l_linenumber"]}
    rows = _t(spark, sf_dir, "lineitem").select(year.alias("yr"), values.year_keyed(year, bands, F.col("l_linenumber")).alias("c"))
    return rows.groupBy("yr").agg(F.sum("c").cast("bigint").alias("counted"))


@_query("""
SELECT 'households' AS kind, CAST(count(*) AS BIGINT) n FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY' UNION ALL SELECT 'schedules', CAST(count(*) AS BIGINT) FROM customer WHERE c_nationkey = 3""")
def city_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place by all its codes, and by those that another file shares."""
    rows = _t(spark, sf_dir, "customer")
    whole, shared = values.coded(rows, {"c_nationkey": 3, "c_mktsegment": "MACHINERY"}), values.coded(rows, {"c_nationkey": 3})
    return whole.agg(F.lit("households").alias("kind"), F.count("*").alias("n")).unionByName(shared.agg(F.lit("schedules").alias("kind"), F.count("*").alias("n")))


_RAW = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN 'x12' WHEN 3 THEN NULL ELSE '1.5' END"


@_query(f"WITH r AS (SELECT p_partkey, {_RAW} raw FROM part) SELECT p_partkey, TRY_CAST(raw AS DOUBLE) AS number, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN CAST(raw AS INTEGER) END digits, nullif(trim(raw), '') AS bare FROM r")
def guarded_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that may be missing, blank or something else."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.col("p_size").cast("string")).when(k == 1, "").when(k == 2, "x12").when(k == 4, "1.5")
    return _t(spark, sf_dir, "part").select("p_partkey", values.number(raw).alias("number"), values.digits(raw).alias("digits"), values.blank_to_null(raw).alias("bare"))


@_query("""
SELECT p_partkey, p_partkey % 5 IN (1, 2, 3) AS prose, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS code, CASE WHEN p_size >= 21 THEN 4 WHEN p_size >= 15 THEN 3 WHEN p_size >= 10 THEN 2 WHEN p_size >= 5 THEN 1 ELSE 0 END AS map_class FROM part""")
def prose_tiers_and_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are running text, codes of tiers, and classes of a map."""
    k, t = F.col("p_partkey") % 5, F.col("p_partkey") % 4
    name = F.when(k == 0, "Saratoga").when(k == 1, "any house as you see on it").when(k == 2, "E Hence").when(k == 3, "on Pratt").otherwise("fayette")
    tier = F.when(t == 0, "bracketed").when(t == 1, "extrapolated").when(t == 2, "street_proportional")
    return _t(spark, sf_dir, "part").select("p_partkey", values.is_prose(name).alias("prose"), values.tier_code(tier).alias("code"), values.map_class(F.col("p_size"), values.PCT_CUTS).alias("map_class"))


@_query("""
WITH r AS (SELECT s_nationkey k, CASE s_suppkey % 2 WHEN 0 THEN 'left' ELSE 'right' END sd, s_suppkey a, s_suppkey * 3.0 + s_nationkey v, row_number() OVER w i, count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 2) n FROM supplier WINDOW w AS (PARTITION BY s_nationkey, s_suppkey % 2 ORDER BY s_suppkey)),
pr AS (SELECT x.k, x.sd, x.a a0, x.v v0, y.a a1, y.v v1, x.i, x.n FROM r x JOIN r y ON x.k = y.k AND x.sd = y.sd AND y.i = x.i + 1), q AS (SELECT c_custkey id, c_nationkey k, c_custkey % 130 p FROM customer),
m AS (SELECT id, sd, v0 + (v1 - v0) * (p - a0) / (a1 - a0) d, CASE WHEN p BETWEEN a0 AND a1 THEN 'bracketed' ELSE 'extrapolated' END conf, row_number() OVER (PARTITION BY id, sd ORDER BY CASE WHEN p BETWEEN a0 AND a1 THEN 0 ELSE 1 END, i) rn FROM q JOIN pr USING (k) WHERE p BETWEEN a0 AND a1 OR (p < a0 AND i = 1) OR (p > a1 AND i = n - 1)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE conf WHEN 'bracketed' THEN 0 ELSE 1 END, sd) r2 FROM m WHERE rn = 1)
SELECT c_custkey, CASE WHEN conf IS NOT NULL THEN round(greatest(0.0, least(300.0, d)), 4) END::DOUBLE distance, sd AS side, conf AS confidence FROM customer LEFT JOIN b ON id = c_custkey AND r2 = 1""")
def ladder_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers along their nation's line, by the ladder of the side that brackets their number, else beyond its ends."""
    side = F.when(F.col("s_suppkey") % 2 == 0, "left").otherwise("right")
    rungs = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("street"), side.alias("side"), F.col("s_suppkey").alias("no"), (F.col("s_suppkey") * 3.0 + F.col("s_nationkey")).alias("at"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("street"), (F.col("c_custkey") % 130).alias("house"), F.lit(300.0).alias("length"))
    return joins.two_sided(rungs, people, "street", "side", "no", "at", "house", "c_custkey", "length").select("c_custkey", F.round("distance", 4).alias("distance"), "side", "confidence")


@_query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_nationkey % 2 = 0 THEN 100 + c_nationkey ELSE c_nationkey END::BIGINT AS at FROM customer""")
def directional_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The northern half of a street where it is known, else the whole."""
    direction = F.when(F.col("c_custkey") % 3 == 0, "N").when(F.col("c_custkey") % 3 == 1, "S").otherwise("")
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("core"), direction.alias("dir"))
    nations = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("core"))
    known = nations.select("core", F.lit("").alias("dir"), F.col("core").cast("bigint").alias("at")).unionByName(nations.filter("core % 2 = 0").select("core", F.lit("N").alias("dir"), (F.col("core") + 100).cast("bigint").alias("at")))
    return joins.directional(people, "core", "dir", known, "core", "dir", "at").select("c_custkey", "at")


@_query("""
SELECT event_id, user_id, (SELECT max(epoch_us(b.ts)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND epoch_us(b.ts) < epoch_us(a.ts)) last_error FROM events a WHERE event_type = 'purchase'""")
def asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last error strictly before each purchase of a user."""
    events = _t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    right = events.filter("event_type = 'error'").select("user_id", F.col("us").alias("last_error"))
    return joins.last_before(events.filter("event_type = 'purchase'").select("event_id", "user_id", "us"), right, "user_id", "us", "last_error").drop("us")


@_query("""
WITH e AS (SELECT user_id, event_type, count(*) n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS types FROM e GROUP BY 1""")
def group_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each user's kinds of events as one map."""
    counts = _t(spark, sf_dir, "events").filter("event_type is not null").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return A.to_map(counts, ["user_id"], "event_type", "n", "types").select("user_id", F.to_json("types").alias("types"))


@_query("SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) total FROM lineitem GROUP BY 1 HAVING sum(l_quantity) >= 300 ORDER BY total DESC, l_partkey LIMIT 35")
def length_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 35 largest totals of those that reach a threshold."""
    return A.largest_totals(_t(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", 300, 35)


@_query("""
WITH p AS (SELECT c_custkey, c_acctbal x, c_custkey % 1000 * 10.0 y FROM customer), s AS (SELECT s_suppkey, s_acctbal x, s_suppkey * 10.0 y FROM supplier),
m AS (SELECT c_custkey, s_suppkey, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) d, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) rn FROM p JOIN s ON (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 160000)
SELECT p.c_custkey, s_suppkey, round(d, 4) distance FROM p LEFT JOIN m ON p.c_custkey = m.c_custkey AND rn = 1""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier nearest to each customer, within 400 m."""
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("px"), (F.col("c_custkey") % 1000 * 10.0).alias("py"))
    points = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 10.0).alias("y"))
    return spatial.nearest_within(people, "c_custkey", "px", "py", points, "s_suppkey", "x", "y", 400.0).select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"))


@_query(f"""
{_BLOCKS_SQL}, p AS (SELECT c_custkey, c_custkey % 400 + 0.25 px, c_nationkey * 4 + 0.125 py FROM customer) SELECT c_custkey, k AS key FROM p JOIN b ON px > x AND px < x + 10 AND py > y AND py < y + 10""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the block that they stand in."""
    points = _t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 400 + 0.25).alias("px"), (F.col("c_nationkey") * 4 + 0.125).alias("py"))
    return spatial.contained(points, "px", "py", _blocks(spark, sf_dir), "key", "ring", 25.0).select("c_custkey", "key")


_TRANSCRIBED = (
    ("German, near Market, fp", "near", "", "German", "", "Market", ""), ("cor. Gough st. & Star alley", "corner", "", "Gough st", "", "Star alley", ""), ("Argyle al. n Fleet st", "relative", "", "Argyle al", "n", "Fleet st", ""),
    ("Strawberry alley, e side s of Smith st, fp", "relative", "", "Strawberry alley", "s", "Smith st", "e"), ("71 Charles st (??)", "numbered", "71", "Charles st", "", "", ""), ("Pitt st ot.", "street_only", "", "Pitt st", "", "", ""),
)
_ADDRESS_FIELDS = ("addr_type", "house_no", "street", "bearing", "cross_street", "side")


@_query("SELECT c_custkey, " + ", ".join(f"CASE c_custkey % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{row[j + 1]}{chr(39)}' for i, row in enumerate(_TRANSCRIBED))} END {name}" for j, name in enumerate(_ADDRESS_FIELDS)) + " FROM customer")
def transcribed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as transcribers write them."""
    raw = F.lit(None).cast("string")
    for i, row in enumerate(_TRANSCRIBED):
        raw = F.when(F.col("c_custkey") % 6 == i, F.lit(row[0])).otherwise(raw)
    return _t(spark, sf_dir, "customer").select("c_custkey", transcribed.address(raw).alias("a")).select("c_custkey", "a.*")


_HEADINGS = (("CHARLES (N.) going north from 228 W Baltimore", "CHARLES (N.)", "going north from 228 W Baltimore"), ("L. McELDERRY—st. east", "L", "McELDERRY st. east"), ("PIN AL.", "PIN AL", ""), ("any house", "", "any house"))


@_query("SELECT c_custkey, " + ", ".join(f"CASE c_custkey % 4 {' '.join(f'WHEN {i} THEN {chr(39)}{row[j + 1]}{chr(39)}' for i, row in enumerate(_HEADINGS))} END AS {name}" for j, name in enumerate(("name", "extent"))) + " FROM customer")
def street_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and extents of streets as a table's heading prints them."""
    raw = F.lit(None).cast("string")
    for i, row in enumerate(_HEADINGS):
        raw = F.when(F.col("c_custkey") % 4 == i, F.lit(row[0])).otherwise(raw)
    return _t(spark, sf_dir, "customer").select("c_custkey", printed.heading(raw).alias("h")).select("c_custkey", "h.*")


@_query("""
SELECT p_partkey, CASE WHEN p_size <= 12 THEN '7' ELSE '' END AS left_no, CASE WHEN p_size > 12 THEN '7' ELSE '' END AS right_no, 'Pratt st' AS cross_street FROM part""")
def printed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows below mangled heads at 4 and 20: a number at p_size and a cross street."""
    word = lambda x, t: F.struct(x.cast("int").alias("x"), F.lit(t).alias("word"))
    heads = printed.column_heads(F.array(word(F.lit(4), "Lejl."), word(F.lit(20), "Ei'ht.")))
    row = F.array(word(F.col("p_size"), "7."), word(F.lit(60), "Pratt"), word(F.lit(70), "st.,"))
    return _t(spark, sf_dir, "part").select("p_partkey", heads.alias("h"), row.alias("r")).select("p_partkey", printed.table_row(F.col("r"), F.col("h.left"), F.col("h.right"), F.lit(60)).alias("t")).select("p_partkey", "t.*")


@_query("SELECT lang, CAST(count(*) AS BIGINT) n FROM documents WHERE length(text) >= 12 AND NOT regexp_matches(text, '^[A-Z\\s.,''&]+$') GROUP BY 1")
def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that can be entries, by language."""
    return _t(spark, sf_dir, "documents").filter(printed.is_entry(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


@_query("""
WITH r AS (SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) i FROM events), m AS (SELECT user_id, min(i) a, max(i) z FROM r WHERE event_type = 'purchase' GROUP BY 1),
e AS (SELECT r.user_id, min(i) stop FROM r JOIN m ON r.user_id = m.user_id AND event_type = 'error' AND i > a GROUP BY 1)
SELECT r.user_id, i AS place, event_type FROM r JOIN m ON r.user_id = m.user_id LEFT JOIN e ON r.user_id = e.user_id WHERE i >= a AND i < coalesce(stop, z + 5) AND event_type IS DISTINCT FROM 'purchase'""")
def headed_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events after the first purchase up to the first error, else five places past the last purchase."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    rows = _t(spark, sf_dir, "events").select("user_id", "event_type", place.alias("place"))
    return folds.section(rows, ["user_id"], "place", F.col("event_type") == "purchase", F.col("event_type") == "error", 5).select("user_id", "place", "event_type")


@_query("""
WITH p AS (SELECT s_nationkey k, CAST(s_suppkey % 7 AS VARCHAR) w FROM supplier WHERE s_acctbal >= 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1),
c AS (SELECT c_custkey, coalesce(w, CAST(c_custkey % 5 AS VARCHAR)) ward, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey % 7 AS VARCHAR) END census FROM customer LEFT JOIN p ON k = c_nationkey)
SELECT c_custkey, ward, CASE WHEN census <> '' THEN ward = census END AS agree FROM c""")
def live_wards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wards by the present placement, else as recorded, and whether they agree with another source's."""
    checks = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), (F.col("c_custkey") % 5).cast("string").alias("recorded"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise((F.col("c_custkey") % 7).cast("string")).alias("census"))
    placed = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), "s_suppkey", F.when(F.col("s_acctbal") >= 0, (F.col("s_suppkey") % 7).cast("string")).alias("ward"))
    return linkage.live(checks, placed, ["key"], "ward", ["s_suppkey"], "recorded").select("c_custkey", "ward", linkage.agreement(F.col("ward"), F.col("census")).alias("agree"))


@_query("""
WITH r AS (SELECT s_suppkey, s_nationkey b, s_suppkey % 4 t, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 5 END o FROM supplier), p AS (SELECT c_custkey, c_nationkey b, c_custkey % 4 t, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 5 END o FROM customer),
f AS (SELECT c_custkey, p.o po, count(s_suppkey) m, count(r.o) told, min(s_suppkey) sole, count(*) FILTER (p.o = r.o) n, min(s_suppkey) FILTER (p.o = r.o) same FROM p LEFT JOIN r USING (b, t) GROUP BY 1, 2)
SELECT c_custkey, CAST(CASE WHEN n = 1 THEN same WHEN m = 1 AND (po IS NULL OR told = 0) THEN sole END AS BIGINT) s_suppkey, CASE WHEN n = 1 THEN 'trait' WHEN m = 1 AND (po IS NULL OR told = 0) THEN 'block' END AS how FROM f""")
def record_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the one supplier of their block that fits."""
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b"), (F.col("c_custkey") % 4).alias("t"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 5).alias("o"))
    records = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), F.col("s_nationkey").alias("b"), (F.col("s_suppkey") % 4).alias("t"), F.when(F.col("s_suppkey") % 6 > 0, F.col("s_suppkey") % 5).alias("o"))
    return linkage.linked(people, records, ["b", "t"], "o", "s_suppkey").select("c_custkey", "s_suppkey", "how")


@_query("""
WITH c AS (SELECT l_suppkey % 40 AS name, CAST(count(*) AS BIGINT) n FROM lineitem GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, name LIMIT 18) SELECT name, n, round(n * 100.0 / (SELECT max(n) FROM t), 1) width FROM t""")
def top_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 18 longest bars with their widths."""
    return A.bars(_t(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("name")).agg(F.count("*").alias("n")), "name", "n")


def _cases(table: str, cases: tuple[tuple[str, ...], ...], columns: tuple[str, ...]) -> str:
    """SQL that gives the expected columns of the case that each customer's key picks."""
    quoted = [[("NULL" if v is None else "'" + v.replace("'", "''") + "'") for v in row] for row in cases]
    return f"SELECT c_custkey, {', '.join(f'CASE c_custkey % {len(cases)} ' + ' '.join(f'WHEN {i} THEN {row[j + 1]}' for i, row in enumerate(quoted)) + f' END AS {c}' for j, c in enumerate(columns))} FROM {table}"


def _picked(cases: tuple[tuple[str, ...], ...]):
    raw = F.lit(None).cast("string")
    for i, row in enumerate(cases):
        raw = F.when(F.col("c_custkey") % len(cases) == i, F.lit(row[0])).otherwise(raw)
    return raw


_LABELS = (("N MCHENRY ST", "N McHenry St"), ("MC EXPWY", "Mc Expwy"), (" BLUE  BALL BLVD", "Blue Ball Blvd"), ("NEW O'DONNELL LANE", "New O'donnell Lane"), ("", ""))


@_query(_cases("customer", _LABELS, ("label",)))
def street_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of streets as labels print them."""
    return _t(spark, sf_dir, "customer").select("c_custkey", names.street_label(_picked(_LABELS)).alias("label"))


_TRADES = (("Labr.", "laborer"), ("White washer", "whitewasher"), ("wash'r", "laundress"), ("ob", None), ("boot and shoemaker", "shoemaker"), ("rag  man", "rag man"), ("keeper of the old lamps", None), ("DRAYMAN, free", "drayman"))


@_query(_cases("customer", _TRADES, ("trade",)))
def occupation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What variants of an occupation are counted as."""
    return _t(spark, sf_dir, "customer").select("c_custkey", names.occupation_key(_picked(_TRADES)).alias("trade"))


@_query("""
WITH c AS (SELECT p_brand, p_type, CAST(count(*) AS BIGINT) n, min(p_partkey) seen FROM part GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, seen) AS INTEGER) rank FROM c)
SELECT p_brand, p_type, n, rank FROM r WHERE rank <= 3""")
def top_by_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent types of each brand, ties by first appearance."""
    counts = _t(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("seen"))
    return A.top_k(counts, ["p_brand"], [F.desc("n"), F.col("seen")], 3).drop("seen")


@_query("""
WITH k AS (SELECT s_nationkey a, s_suppkey % 3 b, arg_min(s_acctbal, s_suppkey) v FROM supplier GROUP BY 1, 2)
SELECT c_custkey, round(v, 2) balance FROM customer LEFT JOIN k ON a = c_nationkey AND b = c_custkey % 4""")
def back_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balance of the first supplier with a customer's two keys, however they are written."""
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" n"), "c_nationkey", F.lit(" ")).alias("a"), (F.col("c_custkey") % 4).alias("b"))
    known = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("a"), (F.col("s_suppkey") % 3).alias("b"), F.round("s_acctbal", 2).alias("balance"), "s_suppkey")
    return joins.back_joined(people, known, ["a", "b"], "balance", ["s_suppkey"]).select("c_custkey", "balance")


@_query("""
WITH l AS (SELECT o_custkey k, max(o_orderkey) o FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 IN (1, 2) GROUP BY 1)
SELECT c_custkey, '1845|ab' || c_custkey || '|jo' AS person, CAST(o AS BIGINT) linked FROM customer LEFT JOIN l ON k = c_custkey""")
def trusted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People with the last link that was found with confidence, by their key."""
    key = lambda c: names.person_key(F.lit(1845), F.concat(F.lit(" Ab"), c), F.lit("Jo  Ann"))
    found = F.when(F.col("o_orderkey") % 3 == 0, "no").otherwise("yes")
    sure = F.when(F.col("o_orderkey") % 5 == 1, "high").when(F.col("o_orderkey") % 5 == 2, "medium").when(F.col("o_orderkey") % 5 == 3, "low")
    links = _t(spark, sf_dir, "orders").filter(values.trusted(found, sure)).select(key("o_custkey").alias("key"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", key("c_custkey").alias("person"))
    known = joins.last_wins(links, ["key"], ["o_orderkey"]).withColumnRenamed("key", "person")
    return linkage.enriched(people, known, "person", ["o_orderkey"]).select("c_custkey", "person", F.col("link.o_orderkey").alias("linked"))


@_query("""
WITH e AS (SELECT c_nationkey k, min(c_custkey) lo, max(c_custkey) hi FROM customer GROUP BY 1), p AS (SELECT c_custkey, c_custkey % 5 t, c_nationkey % 3 - 1 dx, c_nationkey % 2 * 2 - 1 dy, lo, hi, CASE WHEN hi = lo THEN 0.5 ELSE (c_custkey - lo) / (hi - lo)::DOUBLE END s FROM customer JOIN e ON k = c_nationkey)
SELECT c_custkey, round(CASE WHEN hi <> lo AND ((t = 0 AND dy < 0) OR (t = 1 AND dy > 0) OR (t = 2 AND dx < 0) OR (t = 3 AND dx > 0)) THEN 1 - s ELSE s END, 6) share FROM p""")
def proportional_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers between the lowest and highest number seen in their nation, turned by what a note says."""
    rows = _t(spark, sf_dir, "customer")
    ends = rows.groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    t = F.col("c_custkey") % 5
    note = F.when(t == 0, "runs North then south").when(t == 1, "SOUTH from the water").when(t == 2, "east").when(t == 3, "to the west")
    share = joins.proportional(F.col("c_custkey"), F.col("lo"), F.col("hi"), note, F.col("c_nationkey") % 3 - 1, F.col("c_nationkey") % 2 * 2 - 1)
    return rows.join(ends, "c_nationkey").select("c_custkey", F.round(share, 6).alias("share"))


@_query("""
WITH l AS (SELECT s_nationkey k, s_suppkey % 3 lad, min(s_suppkey) low, max(s_suppkey) high, count(*) rungs FROM supplier GROUP BY 1, 2, s_suppkey % 2), p AS (SELECT c_custkey, c_nationkey k, c_custkey % 100 v FROM customer),
s AS (SELECT c_custkey, lad, max(CASE WHEN rungs >= 2 AND v BETWEEN low AND high THEN rungs ELSE 0 END) score, min(low) o FROM p JOIN l USING (k) GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, o) rn, count(*) OVER (PARTITION BY c_custkey) n FROM s)
SELECT c.c_custkey, CAST(lad AS BIGINT) ladder FROM customer c LEFT JOIN b ON b.c_custkey = c.c_custkey AND rn = 1 AND (n = 1 OR score > 0)""")
def ladder_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a nation's ladders, the one with the longest side that brackets a customer's number."""
    sides = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 3).cast("bigint").alias("ladder"), (F.col("s_suppkey") % 2).alias("side"))
    sides = sides.agg(F.min("s_suppkey").alias("low"), F.max("s_suppkey").alias("high"), F.count("*").alias("rungs")).withColumn("o", F.col("low"))
    people = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("street"), (F.col("c_custkey") % 100).alias("v"))
    return joins.best_ladder(people, "c_custkey", "street", "v", sides, "k", "ladder", "o").select("c_custkey", "ladder")


@_query("WITH a AS (SELECT c_custkey, atan2(c_custkey - 50.0, c_acctbal) a FROM customer) SELECT c_custkey, round(CASE WHEN a > pi() / 2 THEN a - pi() WHEN a < -pi() / 2 THEN a + pi() ELSE a END, 4) angle FROM a")
def label_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", geometry.label_angle(F.col("c_acctbal"), F.col("c_custkey") - 50.0).alias("angle"))


@_query(f"{_BLOCKS_SQL} SELECT k AS key, round(x + 5, 4) cx, round(y + 5, 4) cy FROM b")
def block_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each block's corners."""
    return _blocks(spark, sf_dir).select("key", geometry.vertex_mean(F.col("ring")).alias("c")).select("key", F.round("c.x", 4).alias("cx"), F.round("c.y", 4).alias("cy"))


@_query("""
WITH b AS (SELECT p_partkey, p_brand, p_type FROM part WHERE p_size <= 5) SELECT p_partkey, p_brand, p_type FROM b UNION ALL SELECT p_partkey, p_brand, p_type FROM part p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM b WHERE b.p_brand = p.p_brand AND b.p_type = p.p_type)""")
def filled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of one source, and those of the next whose keys it lacks."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return joins.filled(part.filter("p_size <= 5").drop("p_size"), part.filter("p_size > 25"), ["p_brand", "p_type"])


@_query("SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || split_part(p_name, ' ', 2) || ' end' AS line FROM part")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one entry as one, across hyphens."""
    words = F.split("p_name", " ")
    first = F.concat(F.get(words, 0), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", folds.join_lines(F.array(first, F.get(words, 1), F.lit("end"))).alias("line"))


@_query("""
WITH v AS (SELECT p_brand, list_sort(list(CAST(p_size AS DOUBLE))) v FROM part GROUP BY 1), h AS (SELECT p_brand, list_reduce(list_transform(v, lambda x: [x]), lambda seen, x: list_append(seen, CASE WHEN x[1] - seen[-1] > 4 THEN x[1] ELSE seen[-1] END)) heads FROM v)
SELECT p_brand, CAST(len(heads) AS INTEGER) words, CAST(list_unique(heads) AS INTEGER) visual_rows, heads[-1] AS last_head FROM h""")
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places gathered to rows: one further than 4 from the first of its row opens another."""
    # Equal places have one head, so what is gathered of a brand is its different places, however many words stand there.
    places = _t(spark, sf_dir, "part").groupBy("p_brand", F.col("p_size").cast("double").alias("at")).agg(F.count("p_size").alias("n"))
    rows = places.groupBy("p_brand").agg(F.sum("n").cast("int").alias("words"), F.sort_array(F.collect_list("at")).alias("v"))
    heads = rows.select("p_brand", "words", folds.cluster_heads(F.col("v"), 4.0).alias("h"))
    return heads.select("p_brand", "words", F.size(F.array_distinct("h")).alias("visual_rows"), F.try_element_at("h", F.lit(-1)).alias("last_head"))


@_query("SELECT s_nationkey, string_agg(s_suppkey % 4 || ':' || s_suppkey, ' ' ORDER BY s_suppkey % 4, s_suppkey) AS rungs FROM supplier GROUP BY 1")
def stable_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs of each ladder by number alone, in printed order where numbers repeat."""
    rungs = _t(spark, sf_dir, "supplier").select("s_nationkey", (F.col("s_suppkey") % 4).alias("no"), F.col("s_suppkey").alias("seq"))
    text = F.array_join(F.transform("rungs", lambda r: F.concat_ws(":", r["no"].cast("string"), r["seq"].cast("string"))), " ")
    return A.to_list(rungs, ["s_nationkey"], ["no", "seq"], "rungs").select("s_nationkey", text.alias("rungs"))


@_query("""
WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) yr, count(*) n, count(*) FILTER (o_orderpriority = '1-URGENT') p FROM orders GROUP BY 1)
SELECT yr, CASE WHEN p = 0 THEN '' WHEN yr % 2 = 0 THEN format('{:,}', n) || ' residents parsed from the volume, ' || format('{:,}', p) || ' placed on a map.' ELSE format('{:,}', p) || ' residents placed on a map.' END AS line FROM y""")
def counted_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each year, by which counts are known of it."""
    years = _t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("p"))
    return years.select("yr", values.counted(F.when(F.col("yr") % 2 == 0, F.col("n")), F.col("p")).alias("line"))


@_query("""
WITH p AS (SELECT n_nationkey k, i FROM nation, range(0, 10) r(i) WHERE i % 4 <> n_nationkey % 4), g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) run FROM p), l AS (SELECT k, min(i) * 10.0 x, count(*) * 10.0 length FROM g GROUP BY k, run),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length DESC, x) rn FROM l) SELECT k AS key, CAST(x AS DOUBLE) AS starts, CAST(length AS DOUBLE) length FROM r WHERE rn = 1""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each nation's level line, with gaps, merged: where the longest whole one starts, and its length."""
    pieces = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).filter("i % 4 <> key % 4")
    lines = pieces.select("key", F.array(_point(F.col("i") * 10, F.lit(0)), _point(F.col("i") * 10 + 10, F.lit(0))).alias("points"))
    whole = spatial.longest_line(lines, "key", "points")
    return whole.select("key", F.array_min(F.transform("points", lambda p: p["x"])).alias("starts"), geometry.line_length(F.col("points")).alias("length"))


@_query("SELECT n_nationkey AS key, CAST(CASE WHEN n_nationkey * 0.25 > 2 THEN 3 ELSE 2 END AS INTEGER) points FROM nation")
def simplified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points left of lines whose middle one lies further and further off."""
    bump = F.array(_point(F.lit(0), F.lit(0)), _point(F.lit(50), F.col("n_nationkey") * 0.25), _point(F.lit(100), F.lit(0)))
    lines = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), bump.alias("points"))
    return spatial.simplify(lines, "points", 2.0).select("key", F.size("points").alias("points"))
