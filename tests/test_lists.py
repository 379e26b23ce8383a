"""Entry lists and their streams against the rules carried out step by step."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import containment, joins, lists
from tideline.operators.dominance import dominance_sum
from tideline.storage import new_path
from tideline.streaming import jobs

ENTRIES = "list long, player long, status string, position long"
MOVES = "list long, player long, kind string, ts timestamp, seq long"


def standing(entries, moves):
    """What each entry is after the movements, in their order; whom the last report named; movements of nobody on the list."""
    known, last, reported, unmatched = {e[1] for e in entries}, {}, None, []
    for m in sorted(moves, key=lambda m: (m[3], m[4])):
        if m[1] not in known:
            unmatched.append(m[4])
        if m[2] == "reported-next":
            reported = m[1]
        elif m[1] in known:
            last[m[1]] = m[2]
    out, queue = {}, 0
    for _, player, status, _ in sorted(entries, key=lambda e: (e[3], e[1])):
        kind = last.get(player)
        state = "withdrawn" if kind in ("withdrawal", "alternate-withdrawal") else "accepted" if status == "accepted" or kind == "promotion" else "alternate"
        queue += state == "alternate"
        out[player] = (state, queue if state == "alternate" else None, status)
    return out, reported, unmatched


def label(state, queue, status):
    return "OUT" if state == "withdrawn" else "MD" if status == "accepted" else "MD IN" if state == "accepted" else f"MD ALT {queue}"


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(6)
    entries = [(n, p, "accepted" if rng.random() < 0.3 else "alternate", rng.randint(0, 9)) for n in (1, 2) for p in range(14)]
    kinds = ["withdrawal", "promotion", "alternate-withdrawal", "reported-next"]
    moves = [(1 + k % 2, rng.randint(0, 17), rng.choice(kinds), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randint(0, 40)), k) for k in range(90)]
    return entries, [*moves, (1, 3, "withdrawal", dt.datetime(2024, 2, 1), 900), (1, 3, "reported-next", dt.datetime(2024, 2, 2), 901)]


def of(rows, n):
    return [r for r in rows if r[0] == n]


def test_state_reports_and_unmatched_movements(spark, sample):
    e, m = spark.createDataFrame(sample[0], ENTRIES), spark.createDataFrame(sample[1], MOVES)
    got = lists.derive_state(e, m, ["list"]).collect()
    nexts = {r.list: r.player for r in lists.reported_next(m, ["list"]).collect()}
    nobody = {r.seq for r in lists.unmatched_movements(e, m, ["list"]).collect()}
    for n in (1, 2):
        want, reported, unmatched = standing(of(sample[0], n), of(sample[1], n))
        assert {r.player: (r.state, r.queue, r.status) for r in got if r.list == n} == want
        assert nexts[n] == reported and set(unmatched) <= nobody
    assert {r.state for r in got if (r.list, r.player) == (1, 3)} == {"withdrawn"}  # a later report changes nothing
    assert lists.derive_state(e, m.where("false"), ["list"]).where("state = 'withdrawn'").count() == 0
    assert lists.derive_state(e.where("false"), m, ["list"]).count() == 0


def test_trajectories_equal_every_prefix(spark, sample):
    e, m = spark.createDataFrame(sample[0], ENTRIES), spark.createDataFrame(sample[1], MOVES)
    got = {}
    for r in lists.trajectory(e, m, ["list"]).orderBy("step").collect():
        got.setdefault((r.list, r.player), []).append((r.step, r.label))
    asked = spark.createDataFrame([(n, p, k) for n in (1, 2) for p in range(18) for k in (0, 5, 17, 30, 47)], "list long, player long, at long")
    at = {(r.list, r.player, r.at): r.label for r in lists.standing_at(e, m, ["list"], asked).collect()}
    want, want_at = {}, {}
    for n in (1, 2):
        moves = sorted(of(sample[1], n), key=lambda x: (x[3], x[4]))
        for k in range(len(moves) + 1):
            for player, now in standing(of(sample[0], n), moves[:k])[0].items():
                seen = want.setdefault((n, player), [])
                if not seen or seen[-1][1] != label(*now):
                    seen.append((k, label(*now)))
                if k in (0, 5, 17, 30, 47):
                    want_at[n, player, k] = label(*now)
    assert got == want and {k: v for k, v in at.items() if k in want_at} == want_at
    assert {x.split()[1] for v in got.values() for _, x in v if " " in x} == {"ALT", "IN"}
    assert lists.trajectory(e, m.where("false"), ["list"]).count() == len(sample[0])


def test_dominance_sum_equals_pairs(spark):
    rng = random.Random(1)
    points = [("a" if k % 3 else "b", rng.randint(0, 30), rng.randint(0, 20), rng.randint(-3, 3)) for k in range(150)]
    asked = [("a" if k % 2 else "b", rng.randint(-1, 31), rng.randint(0, 25), k) for k in range(60)] + [("c", 5, 5, 99)]
    got = dominance_sum(spark.createDataFrame(points, "g string, x long, y long, v long"), spark.createDataFrame(asked, "g string, x long, y long, id long"), ["g"], "x", "y", "v", "s")
    assert {r.id: r.s for r in got.collect()} == {i: sum(v for h, a, b, v in points if h == g and a < x and b < y) for g, x, y, i in asked}


def test_list_stream_equals_batch_whatever_the_arrival(spark, sample, tmp_path):
    """The snapshot and the movements come shuffled over several batches; unknown players wait for the watermark."""
    rng = random.Random(2)
    rows = [(n, p, dt.datetime(2024, 1, 1), s, pos, None, None) for n, p, s, pos in sample[0]] + [(n, p, ts, None, None, kind, seq) for n, p, kind, ts, seq in sample[1]]
    rng.shuffle(rows)
    schema = "list long, player long, ts timestamp, status string, position long, kind string, seq long"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    end = [(n, 0, dt.datetime(2024, 6, 1), "alternate", 0, None, None) for n in (1, 2)]  # the watermark passes all movements
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    entries, nexts, nobody = jobs.latest_standing(jobs.run_to_table(jobs.list_states(stream, "ts", "60 days"), "states-test"))
    got, named = entries.collect(), {r.list: r.player for r in nexts.collect()}
    unmatched = {r.seq for r in nobody.collect()}
    every = set()
    for n in (1, 2):
        want, reported, lost = standing(of(sample[0], n), of(sample[1], n))
        assert {r.player: (r.state, r.queue) for r in got if r.list == n} == {p: v[:2] for p, v in want.items()} and named[n] == reported
        every |= set(lost)
    assert unmatched == every


def test_disappearances_stream_and_replayed_batches(spark, tmp_path):
    """Each file is a snapshot; a batch that runs again, and a second run over the same store, add nothing."""
    snaps = [{1, 2, 3, 4}, {1, 3, 5}, {1, 2, 5}, {5}]
    rows = [[(7, k, p) for p in s] for k, s in enumerate(snaps)]
    schema = "list long, snap int, player long"
    store = f"{tmp_path}/store"

    def run(files):
        """``files`` one by one under one checkpoint."""
        for k in files:
            spark.createDataFrame(rows[k], schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{k}")
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            jobs.disappearance_stream(stream, store, ["list"], "snap", "player", f"{tmp_path}/ckpt").awaitTermination()

    run(range(4))
    read = lambda: sorted((r.player, r.from_snap, r.to_snap) for r in spark.read.parquet(f"{store}/ledger").collect())
    want = sorted((p, k, k + 1) for k in range(3) for p in snaps[k] - snaps[k + 1])
    assert read() == want
    whole = spark.createDataFrame([r for x in rows for r in x], schema)
    assert sorted((r.player, r.from_snap, r.to_snap) for r in lists.disappearances(whole, ["list"], "snap", "player").collect()) == want
    for name in ("3", ".3.crc"):  # the last batch was not known to have ended
        (tmp_path / "ckpt" / "commits" / name).unlink()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    jobs.disappearance_stream(stream, store, ["list"], "snap", "player", f"{tmp_path}/ckpt").awaitTermination()
    assert read() == want


def test_failed_sends_come_back(spark, tmp_path):
    schema = "subscriber long, deadline string, window int"
    due = [(1, "a", 24), (1, "b", 24), (2, "a", 24), (3, "a", 24)]
    fails = {0: {1}, 1: set(), 2: set()}
    log = f"{tmp_path}/log"

    def outcomes(claims, number):
        bad = list(fails[number])
        return claims.select("subscriber", (~F.col("subscriber").isin(bad) if bad else F.lit(True)).alias("ok"))

    for k in range(3):
        spark.createDataFrame(due, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        jobs.send_stream(stream, log, ["subscriber", "deadline", "window"], "subscriber", outcomes, f"{tmp_path}/ckpt").awaitTermination()
    got = {(r.run, r.subscriber, r.deadline, r.state) for r in spark.read.parquet(f"{log}/results").collect()}
    assert got == {(0, 1, "a", "released"), (0, 1, "b", "released"), (0, 2, "a", "sent"), (0, 3, "a", "sent"), (1, 1, "a", "sent"), (1, 1, "b", "sent")}


def test_due_timers_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k % 4, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), rng.random() < 0.4, dt.date(2024, 1, 5) + dt.timedelta(days=10 * (k % 4))) for k, m in enumerate(sorted(rng.sample(range(9000), 60)))]
    schema = "src long, ts timestamp, failed boolean, start_date date"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        q = jobs.due_checks(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.src, r.due, r.failures) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    until = F.lit(rows[-1][1])
    want = sorted((r.src, r.us, r.failures) for r in lists.due_between(spark.createDataFrame(rows, schema), until).withColumn("us", F.unix_micros("due")).collect())
    assert got == want and any(f for _, _, f in got)


def test_contained_keys_equal_pairs(spark):
    rng = random.Random(5)
    words = ["america", "amerinord", "americanorth", "nordamerica", "rome", "ostia", "abcde", "abcdef", "xabcdefy", "bcde", None, ""]
    words += ["".join(rng.choice("abr") for _ in range(rng.randint(3, 9))) for _ in range(120)]
    left, right = ([(k % 2, w) for k, w in enumerate(words[i:])] for i in (0, 3))
    a, b = (spark.createDataFrame(x, "g int, key string") for x in (left, right))
    got = sorted(tuple(r) for r in containment.contained_keys(a, b, ["g"]).collect())
    keys = lambda rows: {(g, w) for g, w in rows if w and len(w) >= 5}
    want = sorted((g, x, y) for g, x in keys(left) for h, y in keys(right) if g == h and x != y and (x in y or y in x))
    assert got == want and len(want) > 20


def test_ladder_reaches_every_rung(spark):
    """One generic row for each rung; levels, dates and held status decide which rows count."""
    day = dt.date(2024, 5, 6)
    late = day + dt.timedelta(days=60)
    kind = "ed_id long, yr int, start_date date, level string, slug string, name string, city string, status string, updated date"
    exact = [
        (101, 2024, day, "Challenger 75", "alpha-slug", "n1", "c1", "held", day),
        (102, 2024, day, "Challenger 75", "s2", "Bravo Open 3", "c2", "held", day),
        (103, 2024, day, "challenger  100", "sx", "nx", "Charlie", "held", day),
        (104, 2024, late, "Challenger 125", "delta-slug", "nd", "cd", "held", day),
        (105, 2024, late, "Challenger 50", "se", "Echo Open", "ce", "held", day),
        (106, 2024, late, "Challenger 175", "sf", "nf", "Foxtrot", "held", day),
        (107, 2024, late, "Challenger 75", "the-golf-slug", "ng", "cg", "held", day),
        (108, 2024, late, "Challenger 75", "sh", "Grand Hotel Open", "ch", "held", day),
        (109, 2024, late, "Challenger 75", "si", "ni", "Greater Indigo", "held", day),
        (110, 2024, day, "ATP 250", "alpha-slug", "n1", "c1", "held", day),
        (111, 2024, day, "Challenger 75", "kilo-slug", "nk", "ck", "not_held", day),
    ]
    g = [("alpha-slug", "zz", "yy"), ("zz", "Bravo Open 3", "yy"), ("zz", "zz", "charlie"), ("delta-slug ch", "zz", "yy"), ("zz", "echo open", "yy"), ("zz", "zz", "foxtrot"), ("golf-slug", "zz", "yy"), ("zz", "hotel open", "yy"), ("zz", "zz", "indigo"), ("kilo-slug", "zz", "yy")]
    generic = [(k + 1, 2024, day, "Challenger", *x, "held", day) for k, x in enumerate(g)] + [(50, 2024, day, "ATP 500", "alpha-slug", "zz", "yy", "held", day)]
    gs, xs = (spark.createDataFrame(x, kind) for x in (generic, exact))
    got = {r.gid: (r.x_ed_id, r.score) for r in joins.ladder_match(gs, xs).collect()}
    want = {1: (101, 100), 2: (102, 95), 3: (103, 90), 4: (104, 80), 5: (105, 78), 6: (106, 76), 7: (107, 70), 8: (108, 68), 9: (109, 66)}
    assert got == want
    assert {r.gid: r.x_ed_id for r in joins.ladder_match(gs, xs, by_score=False).collect()} == {k: v[0] for k, v in want.items()}
    assert {(r.gid, r.xid) for r in joins.mutual_ladder(gs, xs).collect()} == {(k, v[0]) for k, v in want.items()}
