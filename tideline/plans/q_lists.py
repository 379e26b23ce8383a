"""Queries of entry lists, movements and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators import lists
from tideline.plans.catalog import query
from tideline.streaming import jobs

CHANGES = "SELECT src, seq FROM (SELECT *, lag(content) OVER (PARTITION BY src ORDER BY seq) AS p FROM v_hash) WHERE p IS DISTINCT FROM content"


@query("n01_snapshot_changes", CHANGES)
def n01(t):
    return lists.snapshot_changes(t.v_hash, "src", "content", ["seq"]).select("src", "seq")


def hash_stream(t):
    content = F.concat("event_type", F.lit("|"), F.floor(F.col("value") / 50).cast("int").cast("string"))
    return jobs.read_stream(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("src"), F.col("event_id").alias("seq"), "ts", content.alias("content"))


@query("n01_stream_changes", CHANGES)
def n01s(t):
    return jobs.run_to_table(jobs.snapshot_changes(hash_stream(t), "src", "content", "seq"), "changes").select("src", "seq")


@query("n02_unique_snapshots", "SELECT src, min(seq) AS seq FROM v_hash GROUP BY src, content")
def n02(t):
    return lists.unique_snapshots(t.v_hash, "src", "content", ["seq"]).select("src", "seq")


@query("n02_stream_unique", "SELECT DISTINCT src, content FROM v_hash")
def n02s(t):
    return jobs.run_to_table(jobs.unique_snapshots(hash_stream(t), "src", "content", "ts"), "unique")


@query("n03_stream_ledger", "SELECT list, player, kind, count(*) AS n FROM (SELECT DISTINCT user_id % 20 AS list, user_id AS player, event_type AS kind, cast(ts AS DATE) AS d FROM events) GROUP BY 1, 2, 3")
def n03(t):
    m = jobs.read_stream(t.spark, t.sf_dir, "events").select((F.col("user_id") % 20).alias("list"), F.col("user_id").alias("player"), F.col("event_type").alias("kind"), "ts", F.to_date("ts").alias("d"))
    got = jobs.run_to_table(jobs.movement_ledger(m, ["list", "player", "kind", "d"], "ts"), "ledger")
    return got.groupBy("list", "player", "kind").agg(F.count(F.lit(1)).alias("n"))


#: Last movements, reports left out; the state of each entry. v_entries lacks some players, whose movements match nobody.
LAST = "l AS (SELECT list, player, arg_max(kind, (ts, seq)) AS kind FROM v_moves WHERE kind <> 'reported-next' GROUP BY 1, 2)"
#: Standings are those of the first afternoon: later every alternate has moved.
EARLY = "ts < timestamp '2024-01-01 18:00:00'"
STATE = f"{LAST.replace('WHERE', 'WHERE ' + EARLY + ' AND')}, s AS (SELECT e.*, CASE WHEN kind IN ('withdrawal', 'alternate-withdrawal') THEN 'withdrawn' WHEN status = 'accepted' OR kind = 'promotion' THEN 'accepted' ELSE 'alternate' END AS state FROM v_entries e LEFT JOIN l ON l.list = e.list AND l.player = e.player)"


@query("n04_derive_state", f"WITH {STATE} SELECT *, CASE WHEN state = 'alternate' THEN cast(sum(CASE WHEN state = 'alternate' THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY position, player ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS queue FROM s")
def n04(t):
    return lists.derive_state(t.v_entries, t.v_moves.where(EARLY), ["list"])


@query("n04_reported_next", "SELECT list, arg_max(player, (ts, seq)) AS player FROM v_moves WHERE kind = 'reported-next' GROUP BY list")
def n04r(t):
    return lists.reported_next(t.v_moves, ["list"])


@query("n04_unmatched", "SELECT list, seq, kind FROM v_moves m WHERE NOT EXISTS (SELECT 1 FROM v_entries e WHERE e.list = m.list AND e.player = m.player)")
def n04u(t):
    return lists.unmatched_movements(t.v_entries, t.v_moves, ["list"]).select("list", "seq", "kind")


#: The label of every entry after every prefix of its list's movements, written from the rule: the state by the last movement up to the
#: step, then the place among the alternates that are active there.
LABELS = """m AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY ts, seq) AS step FROM v_moves), p AS (SELECT list, step FROM m UNION ALL SELECT DISTINCT list, 0 FROM v_entries),
k AS (SELECT e.*, p.step, arg_max(m.kind, m.step) AS kind FROM v_entries e JOIN p ON p.list = e.list LEFT JOIN m ON m.list = e.list AND m.player = e.player AND m.step <= p.step AND m.kind <> 'reported-next' GROUP BY ALL),
s AS (SELECT *, CASE WHEN kind IN ('withdrawal', 'alternate-withdrawal') THEN 'OUT' WHEN status = 'accepted' THEN 'MD' WHEN kind = 'promotion' THEN 'MD IN' END AS fixed FROM k),
lb AS (SELECT list, player, step, coalesce(fixed, concat('MD ALT ', sum(CASE WHEN fixed IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY list, step ORDER BY position, player ROWS UNBOUNDED PRECEDING))) AS label FROM s)"""


@query("n05_trajectory", f"WITH {LABELS} SELECT list, player, step, label FROM (SELECT *, lag(label) OVER (PARTITION BY list, player ORDER BY step) AS was FROM lb) WHERE was IS DISTINCT FROM label")
def n05(t):
    return lists.trajectory(t.v_entries, t.v_moves, ["list"])


@query("n05_standing_at", f"WITH {LABELS} SELECT m.list, m.player, m.step AS at, label FROM m JOIN lb ON lb.list = m.list AND lb.player = m.player AND lb.step = m.step")
def n05s(t):
    """The label of each moved player right after the movement."""
    steps = t.v_moves.withColumn("at", F.row_number().over(W.partitionBy("list").orderBy("ts", "seq")).cast("long"))
    return lists.standing_at(t.v_entries, t.v_moves, ["list"], steps)


@query("n06_inherit_departures", f"WITH {LAST}, q AS (SELECT list, player FROM v_moves WHERE value > 50 GROUP BY 1, 2) SELECT q.list, q.player, coalesce(l.kind = 'alternate-withdrawal', false) AS departed, 'qualifying' AS origin FROM q LEFT JOIN l ON l.list = q.list AND l.player = q.player UNION ALL SELECT list, player, false, 'promoted' FROM l WHERE kind = 'promotion' AND NOT EXISTS (SELECT 1 FROM q WHERE q.list = l.list AND q.player = l.player)")
def n06(t):
    q = t.v_moves.where("value > 50").select("list", "player").distinct()
    return lists.inherit_departures(q, lists.last_movements(t.v_moves, ["list"]), ["list", "player"])


#: One list for each edition: when it was last checked (some never were), whether it is active and its event held.
SOURCES = """src AS (SELECT ed_id AS src, start_date, ed_id % 17 > 0 AS active, ed_id % 13 > 0 AS held, CASE WHEN ed_id % 10 > 0 THEN TIMESTAMP '1998-06-15 09:30:00' - to_hours(cast(ed_id % 40 AS INTEGER)) END AS checked_at FROM v_ed),
nx AS (SELECT *, checked_at + to_hours(CASE WHEN ceil((epoch(cast(start_date AS TIMESTAMP)) + 43200 - epoch(checked_at)) / 86400) <= 21 THEN 6 ELSE 24 END) AS next_check FROM src)"""


def sources(t):
    k = F.col("ed_id")
    at = F.when(k % 10 > 0, F.to_timestamp(F.lit("1998-06-15 09:30:00")) - F.make_interval(hours=(k % 40).cast("int")))
    s = t.v_ed.select(k.alias("src"), "start_date", (k % 17 > 0).alias("active"), (k % 13 > 0).alias("held"), at.alias("checked_at"))
    return s.withColumn("next_check", lists.next_check(F.col("start_date"), F.col("checked_at")))


@query("n07_due_sources", f"WITH {SOURCES} SELECT src, next_check FROM nx WHERE active AND held AND start_date - DATE '1998-06-15' BETWEEN -2 AND 35 AND (next_check IS NULL OR next_check <= TIMESTAMP '1998-06-15 10:00:00')")
def n07(t):
    got = lists.due_sources(sources(t), F.to_timestamp(F.lit("1998-06-15 10:00:00")))
    return got.select("src", F.col("next_check").cast("timestamp_ntz").alias("next_check"))


#: Every event of a user is a check of the user's list; a check that comes before the next one is due moves it.
DUE = """c AS (SELECT user_id AS src, ts, event_type = 'error' AS failed, DATE '2024-01-20' + cast(user_id % 40 AS INTEGER) AS start_date, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
d AS (SELECT *, n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY src ORDER BY ts), 0) AS failures, lead(ts) OVER (PARTITION BY src ORDER BY ts) AS nxt, ts + to_hours(CASE WHEN ceil((epoch_us(cast(start_date AS TIMESTAMP)) + 43200000000 - epoch_us(ts)) / 86400000000) <= 21 THEN 6 ELSE 24 END) AS due FROM c)"""


def checks(df):
    return df.select(F.col("user_id").alias("src"), "ts", (F.col("event_type") == "error").alias("failed"), F.date_add(F.lit("2024-01-20").cast("date"), (F.col("user_id") % 40).cast("int")).alias("start_date"))


@query("n07_due_between", f"WITH {DUE} SELECT src, due, failures FROM d WHERE due < coalesce(nxt, TIMESTAMP '2024-01-30 12:00:00')")
def n07b(t):
    return lists.due_between(checks(t.events), F.to_timestamp(F.lit("2024-01-30 12:00:00"))).withColumn("due", F.col("due").cast("timestamp_ntz"))


@query("n07_stream_due", f"WITH {DUE} SELECT src, due, failures FROM d WHERE due < coalesce(nxt, (SELECT max(ts) FROM events))")
def n07st(t):
    """Timers of the state fire when event time passes them; the stream's last event ends them."""
    got = jobs.run_to_table(jobs.due_checks(checks(jobs.read_stream(t.spark, t.sf_dir, "events"))), "due-checks")
    return got.select("src", F.timestamp_micros("due").cast("timestamp_ntz").alias("due"), "failures")


@query("n08_claim_reminders", "SELECT DISTINCT user_id AS subscriber, concat(event_type, cast(cast(floor(value) AS INTEGER) AS VARCHAR)) AS deadline FROM events WHERE day(ts) > 20 EXCEPT SELECT user_id, concat(event_type, cast(cast(floor(value) AS INTEGER) AS VARCHAR)) FROM events WHERE day(ts) <= 20")
def n08(t):
    k = [F.col("user_id").alias("subscriber"), F.concat("event_type", F.floor("value").cast("int").cast("string")).alias("deadline")]
    day = F.dayofmonth("ts")
    return lists.claim_reminders(t.events.where(day > 20).select(*k), t.events.where(day <= 20).select(*k), ["subscriber", "deadline"])


@query("n09_weekly_coverage", "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def n09(t):
    return lists.weekly_coverage(t.events, "ts").withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("n09_stream_coverage", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, min(ts), TIMESTAMP '1970-01-01') + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def n09s(t):
    got = jobs.run_to_table(jobs.weekly_coverage(jobs.read_stream(t.spark, t.sf_dir, "events"), "ts", "1 day", "2 days"), "coverage")
    return got.withColumn("week", F.col("week").cast("timestamp_ntz"))


@query("n10_position_moves", "WITH s AS (SELECT cast(ts AS DATE) AS d, user_id, min(event_id) AS pos FROM events GROUP BY 1, 2), k AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS k FROM (SELECT DISTINCT d FROM s)), b AS (SELECT user_id, max(pos) FILTER (WHERE k = 2) AS old, max(pos) FILTER (WHERE k = 1) AS new FROM s JOIN k USING (d) WHERE k <= 2 GROUP BY 1) SELECT user_id, old, new, CASE WHEN old IS NULL THEN 'entered' WHEN new IS NULL THEN 'left' ELSE cast(old - new AS VARCHAR) END AS move FROM b")
def n10(t):
    s = t.events.groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.min("event_id").alias("pos"))
    return lists.position_moves(s, "user_id", "d", "pos")


#: A third of the names are shared by two players, and some notes name nobody known.
NOTED = """p AS (SELECT concat('n', CASE WHEN c_custkey % 3 = 0 THEN c_custkey - 1 ELSE c_custkey END) AS k, c_custkey AS player FROM customer), m AS (SELECT k, count(*) AS n, min(player) AS player FROM p GROUP BY 1),
nt AS (SELECT event_id, ts, user_id, user_id % 20 AS list, CASE event_type WHEN 'click' THEN 'q_alt_to_q' WHEN 'view' THEN 'q_to_md' WHEN 'signup' THEN 'q_to_md' ELSE 'q_withdrawal' END AS kind FROM events)"""


@query("n12_classify_notes", f"WITH {NOTED} SELECT event_id, kind, CASE WHEN kind = 'q_alt_to_q' THEN 0 ELSE 1 END AS q_spots_delta, CASE WHEN m.n = 1 THEN cast(m.player AS VARCHAR) ELSE concat('N', user_id) END AS who, coalesce(m.n = 1, false) AS resolved, cast(sum(CASE WHEN kind = 'q_alt_to_q' THEN 0 ELSE 1 END) OVER (PARTITION BY list ORDER BY ts, event_id) AS BIGINT) AS open FROM nt LEFT JOIN m ON m.k = concat('n', user_id)")
def n12(t):
    note = F.when(F.col("event_type") == "click", "Alternate used").when(F.col("event_type") == "view", "moved to Main Draw").when(F.col("event_type") == "signup", "MDWC").otherwise("injury")
    u, c = F.col("user_id").cast("string"), F.col("c_custkey")
    rows = t.events.select("event_id", "ts", (F.col("user_id") % 20).alias("list"), "event_type", F.concat(F.lit("n"), u).alias("name_key"), F.concat(F.lit("N"), u).alias("printed"))
    players = t.customer.select(F.concat(F.lit("n"), F.when(c % 3 == 0, c - 1).otherwise(c).cast("string")).alias("name_key"), c.alias("player"))
    return lists.open_places(lists.classify_notes(rows, note, players), ["list"], ["ts", "event_id"]).select("event_id", "kind", "q_spots_delta", "who", "resolved", "open")


@query("n03_disappearances", "WITH s AS (SELECT DISTINCT user_id % 20 AS list, cast(ts AS DATE) AS d, user_id AS player FROM events), o AS (SELECT list, d, lead(d) OVER (PARTITION BY list ORDER BY d) AS nxt FROM (SELECT DISTINCT list, d FROM s)) SELECT s.list, s.player, s.d AS from_snap, o.nxt AS to_snap, 'removed_unknown' AS kind FROM s JOIN o ON o.list = s.list AND o.d = s.d WHERE o.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x WHERE x.list = s.list AND x.d = o.nxt AND x.player = s.player)")
def n03d(t):
    s = t.events.select((F.col("user_id") % 20).alias("list"), F.to_date("ts").alias("d"), F.col("user_id").alias("player"))
    return lists.disappearances(s, ["list"], "d", "player").drop("fingerprint")


@query("n07_check_outcomes", "WITH c AS (SELECT user_id AS src, ts, event_type = 'error' AS failed FROM events WHERE day(ts) > 15), s AS (SELECT user_id AS src, max(ts) AS checked_at, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events WHERE day(ts) <= 15 GROUP BY 1), g AS (SELECT src, max(ts) AS ts, max(ts) FILTER (WHERE NOT failed) AS good FROM c GROUP BY 1), b AS (SELECT c.src, count(*) AS bad FROM c JOIN g ON g.src = c.src WHERE failed AND (good IS NULL OR c.ts > good) GROUP BY 1) SELECT src, coalesce(g.ts, checked_at) AS checked_at, CASE WHEN good IS NULL THEN coalesce(failures, 0) ELSE 0 END + coalesce(bad, 0) AS failures FROM s FULL JOIN g USING (src) LEFT JOIN b USING (src)")
def n07c(t):
    day = F.dayofmonth("ts")
    failed = F.col("event_type") == "error"
    status = t.events.where(day <= 15).groupBy(F.col("user_id").alias("src")).agg(F.max("ts").alias("checked_at"), F.count(F.when(failed, 1)).alias("failures"))
    return lists.check_outcomes(status, t.events.where(day > 15).select(F.col("user_id").alias("src"), "ts", failed.alias("failed")))


@query("n08_stream_claims", "SELECT DISTINCT user_id AS subscriber, event_type AS deadline FROM events")
def n08s(t):
    from tideline.storage import new_path

    due = jobs.read_stream(t.spark, t.sf_dir, "events").select(F.col("user_id").alias("subscriber"), F.col("event_type").alias("deadline"))
    claims = new_path(t.spark, "claims")
    for _ in range(2):  # a second run, with a new checkpoint, claims nothing again
        jobs.claim_stream(due, claims, ["subscriber", "deadline"], new_path(t.spark, "ckpt-claims")).awaitTermination()
    return t.spark.read.parquet(claims)


@query("n11_late_movements", f"WITH {STATE} SELECT list, player, state FROM s")
def n11(t):
    """Movements come through the stream's ledger in the order of arrival; event time decides."""
    m = jobs.read_stream(t.spark, t.sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "withdrawal").when(F.col("event_type") == "view", "promotion").when(F.col("event_type") == "purchase", "alternate-withdrawal").otherwise("reported-next")
    moves = m.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("list"), F.col("user_id").alias("player"), "ts", kind.alias("kind"))
    got = jobs.run_to_table(jobs.movement_ledger(moves, ["seq"], "ts"), "late")
    return lists.derive_state(t.v_entries, got.where(EARLY), ["list"]).select("list", "player", "state")


@query("n04_stream_state", f"WITH {STATE} SELECT list, player, state, CASE WHEN state = 'alternate' THEN cast(sum(CASE WHEN state = 'alternate' THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY position, player ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS queue FROM s")
def n04s(t):
    """Snapshots and movements come as one stream, keyed by list; what it gave last is the standing."""
    from tideline.storage import materialise

    e = t.v_entries.select("list", "player", F.to_timestamp(F.lit("2024-01-01")).alias("ts"), "status", "position", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("seq"))
    m = t.v_moves.where(EARLY).select("list", "player", F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("position"), "kind", "seq")
    rows = materialise(e.unionByName(m), "list-rows")
    stream = t.spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    return jobs.latest_standing(jobs.run_to_table(jobs.list_states(stream), "list-states"))[0]


@query("n03_stream_disappearances", "WITH s AS (SELECT DISTINCT user_id % 20 AS list, cast(ts AS DATE) AS d, user_id AS player FROM events), o AS (SELECT list, d, lead(d) OVER (PARTITION BY list ORDER BY d) AS nxt FROM (SELECT DISTINCT list, d FROM s)) SELECT s.list, s.player, s.d AS from_snap, o.nxt AS to_snap FROM s JOIN o ON o.list = s.list AND o.d = s.d WHERE o.nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x WHERE x.list = s.list AND x.d = o.nxt AND x.player = s.player)")
def n03ds(t):
    from tideline.storage import new_path

    snaps = jobs.read_stream(t.spark, t.sf_dir, "events").select((F.col("user_id") % 20).alias("list"), F.to_date("ts").alias("d"), F.col("user_id").alias("player"))
    store = new_path(t.spark, "disappearances")
    jobs.disappearance_stream(snaps, store, ["list"], "d", "player", new_path(t.spark, "ckpt-disappearances")).awaitTermination()
    return t.spark.read.parquet(f"{store}/ledger").select("list", "player", "from_snap", "to_snap")


@query("n08_two_phase", """WITH d AS (SELECT DISTINCT user_id AS subscriber, event_type AS deadline, CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS run FROM events),
c0 AS (SELECT subscriber, deadline FROM d WHERE run = 0), s0 AS (SELECT * FROM c0 WHERE subscriber % 3 <> 0),
c1 AS (SELECT subscriber, deadline FROM d WHERE run = 1 EXCEPT SELECT * FROM s0), s1 AS (SELECT * FROM c1 WHERE subscriber % 3 <> 1),
c2 AS (SELECT subscriber, deadline FROM d WHERE run = 2 EXCEPT SELECT * FROM s0 EXCEPT SELECT * FROM s1)
SELECT *, 0 AS run, CASE WHEN subscriber % 3 = 0 THEN 'released' ELSE 'sent' END AS state FROM c0 UNION ALL SELECT *, 1, CASE WHEN subscriber % 3 = 1 THEN 'released' ELSE 'sent' END FROM c1 UNION ALL SELECT *, 2, CASE WHEN subscriber % 3 = 2 THEN 'released' ELSE 'sent' END FROM c2""")
def n08t(t):
    """Three runs over the month; in each the messages to a third of the subscribers fail, and their claims come back."""
    keys = ["subscriber", "deadline"]
    day = F.dayofmonth("ts")
    run = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    due = t.events.select(F.col("user_id").alias("subscriber"), F.col("event_type").alias("deadline"), run.alias("run")).distinct()
    log, out = due.select(*keys, F.lit("").alias("state"), F.lit(0).cast("long").alias("at")).where("false"), []
    for k in range(3):
        claims = lists.claim_due(due.where(F.col("run") == k), log, keys)
        outcome = claims.select("subscriber", (F.col("subscriber") % 3 != k).alias("ok")).distinct()
        result = lists.settle(claims, outcome, keys, "subscriber", k)
        log = log.unionByName(result)
        out.append(result.select(*keys, F.lit(k).alias("run"), "state"))
    return out[0].unionByName(out[1]).unionByName(out[2])
