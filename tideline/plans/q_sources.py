"""Queries of sources and sinks; files are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.plans.catalog import query
from tideline.sources import readers
from tideline.storage import new_path


@query("a02_match_csv", "SELECT o_orderkey, concat('Cup, ', o_orderpriority) AS name, cast(o_orderdate AS DATE) AS d FROM orders WHERE o_orderkey % 10 > 0")
def a02(t):
    path = new_path(t.spark, "csv")
    day = F.when(F.col("o_orderkey") % 10 > 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon")
    t.orders.select("o_orderkey", F.concat(F.lit("Cup, "), "o_orderpriority").alias("name"), day.alias("d")).write.option("header", True).csv(path)
    return readers.load_csv(t.spark, path, {"o_orderkey": "bigint", "name": "string", "d": "compact_date"})


@query("a03_rankings", "SELECT cast(o_orderdate AS DATE) AS date, cast(o_orderkey % 500 AS INTEGER) AS rank, lower(concat(cast(c_custkey AS VARCHAR), ' customer')) AS name_key FROM orders JOIN customer ON o_custkey = c_custkey")
def a03(t):
    a, b = new_path(t.spark, "ranks"), new_path(t.spark, "players")
    t.orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"), (F.col("o_orderkey") % 500).alias("rank"), F.col("o_custkey").alias("player")).write.option("header", True).csv(a)
    t.customer.select(F.col("c_custkey").alias("player"), F.concat(F.lit("Customer "), F.col("c_custkey")).alias("name")).write.option("header", True).csv(b)
    r, p = readers.load_rankings(t.spark, a, b)
    return r.join(p, "player").select("date", "rank", "name_key")


def payloads(t):
    one = F.concat(F.lit('{"rank": '), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "player": "'), "user_id", F.lit('"'))).otherwise(F.concat(F.lit(', "name": "'), "user_id", F.lit('"'))), F.lit("}"))
    wrapped = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"items": ['), one, F.lit("]}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("["), one, F.lit("]"))).when(F.col("event_id") % 4 == 2, one).otherwise("oops")
    return t.events.select("event_id", wrapped.alias("payload"))


@query("a04_flatten_json", "SELECT event_id, cast(user_id AS VARCHAR) AS who, json_extract_string(props, '$.k') AS rank FROM events WHERE event_id % 4 < 3")
def a04(t):
    good, _ = readers.flatten_json(payloads(t), "payload", {"who": ["name", "player"], "rank": ["rank"]}, ["who", "rank"])
    return good.select("event_id", "who", "rank")


@query("a04_json_rejects", "SELECT event_id, 'no record' AS reason FROM events WHERE event_id % 4 = 3")
def a04r(t):
    return readers.flatten_json(payloads(t), "payload", {"who": ["name", "player"], "rank": ["rank"]}, ["who", "rank"])[1].select("event_id", "reason")


@query("a05_registry", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'cancelled' WHEN n_regionkey = 2 THEN 'moved' ELSE 'active' END AS status FROM nation")
def a05(t):
    path = new_path(t.spark, "registry")
    for part, status in (("a", "planned"), ("b", "cancelled")):  # the later file wins
        rows = t.region.where("r_regionkey = 1").select(F.col("r_regionkey").alias("key"), F.lit(f" {status} ").alias("status"))
        extra = t.region.where("r_regionkey = 2").select(F.col("r_regionkey").alias("key"), F.lit("moved").alias("status"))
        rows.unionByName(extra).unionByName(extra).coalesce(1).write.option("header", True).csv(f"{path}/{part}")
    rules = readers.load_registry(t.spark, [f"{path}/a", f"{path}/b"], "key int, status string", ["key"])
    return t.nation.join(rules, F.col("n_regionkey") == F.col("key"), "left").select("n_nationkey", F.coalesce("status", F.lit("active")).alias("status"))


@query("a06_extract_records", r"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents) SELECT doc_id, cast(n AS INTEGER) AS line_no, regexp_extract(line, '^([A-Z][a-z]+) ([a-z]+)', 1) AS name, regexp_extract(line, '^([A-Z][a-z]+) ([a-z]+)', 2) AS code FROM l WHERE regexp_matches(line, '^([A-Z][a-z]+) ([a-z]+)')")
def a06(t):
    return readers.extract_records(t.documents, "doc_id", "text", "^([A-Z][a-z]+) ([a-z]+)", ["name", "code"])


@query("a07_movements", "SELECT event_id, unnest(['withdrawal', 'withdrawal', 'promotion', 'reported-next']) AS kind, unnest([concat('p', user_id), concat('q', user_id), concat('r', user_id), 's']) AS player FROM events")
def a07(t):
    note = F.concat(F.lit("OUT: p"), "user_id", F.lit(", q"), "user_id", F.lit(" IN: r"), "user_id", F.lit(" Next: s"))
    return readers.parse_movements(t.events.select("event_id", note.alias("note")), "event_id", "note")


@query("a08_codes", r"SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), '')) AS code FROM pages")
def a08(t):
    return t.pages.select("page_id", readers.extract_code(["url"], [r"[?&]page=([0-9]+)", r"/([a-z]{2})/[0-9]+"]).alias("code"))


@query("a08_latest_code", r"SELECT page_id % 50 AS k, arg_max(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), page_id) AS code FROM pages WHERE regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) <> '' GROUP BY 1")
def a08l(t):
    p = t.pages.select((F.col("page_id") % 50).alias("k"), "page_id", readers.extract_code(["url"], [r"/([a-z]{2})/[0-9]+"]).alias("code"))
    return readers.latest_code(p, "k", "code", "page_id")


@query("a09_write_scope", "SELECT yr, count(*) AS n, cast(sum(v) AS BIGINT) AS v FROM (SELECT yr, CASE WHEN yr = 1996 THEN 2 ELSE 1 END AS v FROM v_ed) GROUP BY yr")
def a09(t):
    path = new_path(t.spark, "scopes")
    readers.write_scope(t.v_ed.select("ed_id", "yr", F.lit(1).alias("v")), path, ["yr"])
    readers.write_scope(t.v_ed.where("yr = 1996").select("ed_id", "yr", F.lit(2).alias("v")), path, ["yr"])
    return t.spark.read.parquet(path).groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query("a11_fill_down", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents), s AS (SELECT *, sum(CASE WHEN starts_with(line, 'The') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l), c AS (SELECT *, last_value(nullif(regexp_extract(line, '([a-z]{9,})', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id, sec ORDER BY n ROWS UNBOUNDED PRECEDING) AS context FROM s) SELECT doc_id, cast(n AS INTEGER) AS line_no, cast(sec AS BIGINT) AS section_no, context, CASE WHEN line = '' THEN 'empty' END AS skipped FROM c")
def a11(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.col("line")
    return readers.fill_down(lines, "doc_id", line.startswith("The"), F.nullif(F.regexp_extract(line, "([a-z]{9,})", 1), F.lit("")), F.when(line == "", "empty")).drop("line")


@query("a11_unique_lines", "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents), s AS (SELECT *, sum(CASE WHEN starts_with(line, 'The') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM l), c AS (SELECT *, last_value(nullif(regexp_extract(line, '([a-z]{9,})', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id, sec ORDER BY n ROWS UNBOUNDED PRECEDING) AS context, regexp_replace(translate(substring(line, 1, 12), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '', 'g') AS name_key FROM s) SELECT doc_id, context, name_key, cast(min(n) AS INTEGER) AS line_no FROM c WHERE line <> '' GROUP BY ALL")
def a11u(t):
    """Lines by (document, context, name): the first of equal ones."""
    lines = t.documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    line = F.col("line")
    filled = readers.fill_down(lines, "doc_id", line.startswith("The"), F.nullif(F.regexp_extract(line, "([a-z]{9,})", 1), F.lit("")), F.when(line == "", "empty"))
    low = F.translate(F.substring("line", 1, 12), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    named = filled.withColumn("name_key", F.regexp_replace(low, "[^a-z0-9]+", ""))
    return readers.unique_lines(named, "doc_id", ["context", "name_key"]).select("doc_id", "context", "name_key", "line_no")


@query("a12_validate_rows", "SELECT o_orderkey, CASE WHEN NOT o_totalprice > 50000 THEN 'price' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END AS reason FROM orders WHERE NOT (o_totalprice > 50000 AND o_orderstatus IN ('F', 'O'))")
def a12(t):
    _, bad = readers.validate_rows(t.orders, [("price", F.col("o_totalprice") > 50000), ("status", F.col("o_orderstatus").isin("F", "O"))])
    return bad.select("o_orderkey", "reason")
