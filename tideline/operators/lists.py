"""Entry lists and movements: batch forms of the stateful behaviours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.dominance import dominance_sum
from tideline.operators.windows import prefix_sum
from tideline.storage import materialise


def snapshot_changes(df: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """Rows whose content differs from the key's row before (A, B, A keeps three)."""
    prev = F.lag(F.sha2(content, 256)).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_p", prev).where(~F.col("_p").eqNullSafe(F.sha2(content, 256))).drop("_p")


def unique_snapshots(df: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """The first row of each content (A, B, A keeps two)."""
    rn = F.row_number().over(W.partitionBy(key, content).orderBy(*order))
    return df.withColumn("_n", rn).where("_n = 1").drop("_n")


#: Movements that take a player off a list, and the one that takes them in. ``reported-next`` only names a player.
OUT_KINDS, IN_KIND, NEXT_KIND = ["withdrawal", "alternate-withdrawal"], "promotion", "reported-next"


def last_movements(moves: DataFrame, lists: list[str]) -> DataFrame:
    """``lists, player, kind, ts, seq``: the last movement of each player in (time, arrival) order, reports of who is next left out."""
    real = moves.where(F.col("kind") != NEXT_KIND)
    return real.groupBy(*lists, "player").agg(F.max(F.struct("ts", "seq", "kind")).alias("m")).select(*lists, "player", "m.kind", "m.ts", "m.seq")


def derive_state(entries: DataFrame, moves: DataFrame, lists: list[str]) -> DataFrame:
    """``lists, player, status, position, state, queue``: the standing of each entry after all movements.

    ``entries`` is the snapshot (lists, player, status: accepted or alternate, position), which never changes. A player's last movement
    decides: withdrawn, accepted (or accepted from the start), else alternate; active alternates are numbered in the order of their
    first position. Movements of players that are not on the list do nothing here (``unmatched_movements``). A list of any
    length is numbered by ranges.
    """
    last = last_movements(moves, lists).select(*lists, "player", "kind")
    rows = entries.select(*lists, "player", "status", "position").join(last, [*lists, "player"], "left")
    taken = (F.col("status") == "accepted") | F.col("kind").eqNullSafe(IN_KIND)
    state = F.when(F.coalesce(F.col("kind").isin(OUT_KINDS), F.lit(False)), "withdrawn").when(taken, "accepted").otherwise("alternate")
    # An accepted player who withdrew and came back is accepted; an alternate is active while neither out nor in.
    s = rows.withColumn("state", state).withColumn("_active", (F.col("state") == "alternate").cast("long"))
    numbered = prefix_sum(s, lists, ["position", "player"], "_active", "_n")
    return numbered.select(*lists, "player", "status", "position", "state", F.when(F.col("_active") == 1, F.col("_n")).alias("queue"))


def reported_next(moves: DataFrame, lists: list[str]) -> DataFrame:
    """``lists, player``: whom the last report of each list names as next, on the list or not."""
    return moves.where(F.col("kind") == NEXT_KIND).groupBy(*lists).agg(F.max_by("player", F.struct("ts", "seq")).alias("player"))


def unmatched_movements(entries: DataFrame, moves: DataFrame, lists: list[str]) -> DataFrame:
    """Movements and reports of players that the list does not have."""
    return moves.join(entries.select(*lists, "player").distinct(), [*lists, "player"], "left_anti")


def _numbered(moves: DataFrame, lists: list[str]) -> DataFrame:
    """``lists, player, kind, step``: the movements of each list by their number, from 1, in (time, arrival) order."""
    return prefix_sum(moves.withColumn("_one", F.lit(1).cast("long")), lists, ["ts", "seq"], "_one", "step").select(*lists, "player", "kind", "step")


def _spans(entries: DataFrame, steps: DataFrame, lists: list[str]) -> DataFrame:
    """``lists, player, status, place, waits, state, step, until``, written: the states of each entry (alternate, in or out) with their first step
    and the first of the next; ``place`` numbers a list's entries and ``waits`` its alternates in the order of their positions.

    No movement makes an alternate of a player again, so an entry has one span as an alternate at most, from step 0.
    """
    mine = [*lists, "player"]
    e = entries.withColumn("_one", F.lit(1).cast("long")).withColumn("_alt", (F.col("status") == "alternate").cast("long"))
    e = prefix_sum(prefix_sum(e, lists, ["position", "player"], "_one", "place"), lists, ["position", "player"], "_alt", "waits").select(*mine, "status", "place", "waits")
    kind = F.col("kind")
    start = e.select(*mine, "status", "place", "waits", F.lit(0).cast("long").alias("step"), F.when(F.col("status") == "accepted", "in").otherwise("alternate").alias("state"))
    turned = steps.where(kind != NEXT_KIND).join(e, mine).select(*mine, "status", "place", "waits", "step", F.when(kind == IN_KIND, "in").otherwise("out").alias("state"))
    w = W.partitionBy(*mine).orderBy("step")
    changed = start.unionByName(turned).withColumn("_was", F.lag("state").over(w)).where(~F.col("_was").eqNullSafe(F.col("state")))
    return materialise(changed.withColumn("until", F.lead("step").over(w)).drop("_was"), "spans")


def _label(prefix: str, queue: Column) -> Column:
    return F.when(F.col("state") == "alternate", F.concat(F.lit(f"{prefix} ALT "), queue.cast("string"))).when(F.col("state") == "out", "OUT").when(F.col("status") == "accepted", prefix).otherwise(f"{prefix} IN")


def trajectory(entries: DataFrame, moves: DataFrame, lists: list[str], prefix: str = "MD") -> DataFrame:
    """``lists, player, step, label``: the labels of each entry after every prefix of the list's movements, equal ones in a row once.

    ``step`` numbers the movements of a list in (time, arrival) order, 0 being the snapshot. Labels: OUT; ``prefix`` for accepted entries; ``prefix``
    IN for alternates that were taken in; ``prefix`` ALT n for the n-th active alternate. ``entries`` as for ``derive_state``.

    A label changes with the player's own state, or when an alternate in front goes out or in. Departures meet the spans of waiting
    entries by nodes of a binary tree over the steps, so pairs whose steps do not fit are never made, and no movement
    meets an entry that it leaves alone because that one was gone before.
    """
    mine = [*lists, "player"]
    steps = materialise(_numbered(moves, lists), "steps")
    spans = _spans(entries, steps, lists)
    top = int(steps.agg(F.max("step")).first()[0] or 0).bit_length()
    waiting = spans.where("state = 'alternate'").withColumn("until", F.coalesce("until", F.lit(1 << top)))
    gone = spans.where("state = 'alternate' and until is not null").select(*lists, F.col("place").alias("_place"), F.col("until").alias("step"))
    # Steps 1 to until - 1 as nodes: on level k node n holds the steps from n * 2^k on; of a level at most the first and the last are needed.
    first, end = "shiftright(1 + shiftleft(1L, k) - 1, k)", "shiftright(until, k)"
    nodes = F.expr(f"""filter(flatten(transform(sequence(0, {top}), k -> if({first} < {end}, array(
        if({first} % 2 = 1, named_struct('k', k, 'n', {first}), null), if({end} % 2 = 1, named_struct('k', k, 'n', {end} - 1), null)), array()))), x -> x is not null)""")
    asked = waiting.select(*mine, "place", F.explode(F.array_distinct(nodes)).alias("x")).select(*mine, "place", "x.k", "x.n")
    marks = gone.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("n", F.expr("shiftright(step, k)"))
    passed = asked.join(marks, [*lists, "k", "n"]).where("_place < place").select(*mine, "step", F.lit(-1).cast("long").alias("v"))
    every = passed.unionByName(waiting.select(*mine, "step", F.col("waits").alias("v")))
    queue = every.withColumn("_q", F.sum("v").over(W.partitionBy(*mine).orderBy("step").rowsBetween(W.unboundedPreceding, 0)))
    waits = queue.select(*mine, "step", F.lit("alternate").alias("state"), F.lit("alternate").alias("status"), "_q")
    settled = spans.where("state <> 'alternate'").select(*mine, "step", "state", "status", F.lit(None).cast("long").alias("_q"))
    return waits.unionByName(settled).select(*mine, "step", _label(prefix, F.col("_q")).alias("label"))


def standing_at(entries: DataFrame, moves: DataFrame, lists: list[str], asked: DataFrame, prefix: str = "MD") -> DataFrame:
    """``lists, player, at, label``: what an entry's label was after ``at`` movements of its list. ``asked`` has lists, player and at; players that
    are not on the list have no row.

    The alternates in front that had gone by then are counted by dominance: those of smaller place and smaller step. Neither the movements of
    a list nor its entries are gone through for a question.
    """
    mine = [*lists, "player"]
    spans = _spans(entries, _numbered(moves, lists), lists)
    at = asked.select(*mine, "at").distinct()
    held = at.join(spans, mine).where((F.col("step") <= F.col("at")) & (F.col("until").isNull() | (F.col("until") > F.col("at"))))
    held = materialise(held.withColumn("id", F.monotonically_increasing_id()), "asked")
    gone = spans.where("state = 'alternate' and until is not null").select(*lists, F.col("until").alias("step"), "place", F.lit(1).cast("long").alias("v"))
    waiting = held.where("state = 'alternate'").select(*lists, (F.col("at") + 1).alias("step"), "place", "id")
    ahead = dominance_sum(gone, waiting, lists, "step", "place", "v", "gone").select("id", "gone")
    return held.join(ahead, "id", "left").select(*mine, "at", _label(prefix, F.col("waits") - F.col("gone")).alias("label"))


def inherit_departures(qualifying: DataFrame, alternates: DataFrame, keys: list[str]) -> DataFrame:
    """Qualifying rows take over a departure from the alternates (``keys``, kind: their last movement); promoted alternates are added once."""
    gone = alternates.where("kind = 'alternate-withdrawal'").select(*keys, F.lit(True).alias("departed"))
    base = qualifying.join(gone, keys, "left").select(*keys, F.coalesce("departed", F.lit(False)).alias("departed"), F.lit("qualifying").alias("origin"))
    new = alternates.where(F.col("kind") == IN_KIND).join(qualifying, keys, "left_anti").select(*keys, F.lit(False).alias("departed"), F.lit("promoted").alias("origin")).distinct()
    return base.unionByName(new)


#: Hours to the next check of a list whose event is at most so many days away, and of any other; days around today in which
#: an event's list is checked at all.
SOON_DAYS, SOON_HOURS, LATE_HOURS, CHECKED_DAYS = 21, 6, 24, (-2, 35)


def next_check(start_date: Column, checked_at: Column) -> Column:
    """When a list is to be checked again: the days to noon of its event's start are rounded up."""
    days = F.ceil((F.unix_micros(start_date.cast("timestamp")) + 43_200_000_000 - F.unix_micros(checked_at)) / 86_400_000_000)
    return checked_at + F.make_interval(hours=F.when(days <= SOON_DAYS, SOON_HOURS).otherwise(LATE_HOURS))


def due_sources(sources: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Active sources of held events around today whose next check has come or was never set, those first, then by time and start.

    ``sources`` has active, held, start_date, next_check.
    """
    days = F.datediff("start_date", F.to_date(now))
    due = sources.where(F.col("active") & F.col("held") & days.between(*CHECKED_DAYS) & (F.col("next_check").isNull() | (F.col("next_check") <= now)))
    return due if limit is None else due.orderBy(F.col("next_check").asc_nulls_first(), "start_date", "src").limit(limit)


def due_between(checks: DataFrame, until: Column) -> DataFrame:
    """``src, due, failures``: checks (src, ts, failed, start_date) after which the next one fell due, up to ``until``, before another came."""
    w = W.partitionBy("src").orderBy("ts")
    good = F.coalesce(F.max(F.when(~F.col("failed"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    c = checks.withColumn("_n", F.row_number().over(w)).withColumn("failures", (F.col("_n") - good).cast("long")).withColumn("due", next_check(F.col("start_date"), F.col("ts").cast("timestamp")))
    return c.withColumn("_next", F.lead(F.col("ts").cast("timestamp")).over(w)).where((F.col("due") < F.coalesce("_next", until))).select("src", "due", "failures")


def claim_reminders(due: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    return due.select(*keys).distinct().join(sent, keys, "left_anti")


def claim_due(due: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """What is due and neither claimed nor sent: ``log`` has keys, state (claimed, sent, released) and at; its last entry of a key counts."""
    open_ = log.groupBy(*keys).agg(F.max_by("state", "at").alias("state")).where("state <> 'released'")
    return due.select(*keys).distinct().join(open_, keys, "left_anti")


def settle(claims: DataFrame, outcomes: DataFrame, keys: list[str], receiver: str, at: int) -> DataFrame:
    """``keys, state, at`` of a run's claims after sending: sent, or released where the receiver's message failed or has no outcome."""
    ok = outcomes.groupBy(receiver).agg(F.bool_and("ok").alias("_ok"))
    state = F.when(F.coalesce("_ok", F.lit(False)), "sent").otherwise("released")
    return claims.join(ok, receiver, "left").select(*keys, state.alias("state"), F.lit(at).cast("long").alias("at"))


def position_moves(snaps: DataFrame, key: str, snap: str, position: str) -> DataFrame:
    """Old and new position of each player between the latest two snapshots."""
    latest = snaps.select(snap).distinct().orderBy(F.col(snap).desc()).limit(2).withColumn("_k", F.row_number().over(W.orderBy(F.col(snap).desc())))
    got = snaps.join(F.broadcast(latest), snap)  # two rows
    both = got.groupBy(key).agg(F.max(F.when(F.col("_k") == 2, F.col(position))).alias("old"), F.max(F.when(F.col("_k") == 1, F.col(position))).alias("new"))
    return both.withColumn("move", F.when(F.col("old").isNull(), "entered").when(F.col("new").isNull(), "left").otherwise((F.col("old") - F.col("new")).cast("string")))


def disappearances(snaps: DataFrame, lists: list[str], snap: str, player: str) -> DataFrame:
    """``lists, player, from_snap, to_snap, kind, fingerprint``: players of a list's snapshot that the next one lacks. Whether they withdrew
    or moved up is unknown until another source says so; the fingerprint keeps a second run from adding them again."""
    order = snaps.select(*lists, snap).distinct().withColumn("to_snap", F.lead(snap).over(W.partitionBy(*lists).orderBy(snap)))
    before = snaps.select(*lists, snap, player).distinct().join(order, [*lists, snap]).where("to_snap is not null")
    after = snaps.select(*lists, F.col(snap).alias("to_snap"), player).distinct()
    gone = before.join(after, [*lists, "to_snap", player], "left_anti").withColumn("kind", F.lit("removed_unknown"))
    parts = [F.col(c).cast("string") for c in (*lists, player, "kind", "to_snap")]
    return gone.select(*lists, player, F.col(snap).alias("from_snap"), "to_snap", "kind", F.sha2(F.concat_ws("|", *parts), 256).alias("fingerprint"))


def classify_notes(df: DataFrame, note: Column, players: DataFrame) -> DataFrame:
    """Kind of a sheet note, the change of open qualifying places, and the player: a printed name that matches no player, or more than
    one, stays as printed. ``df`` has name_key and printed, ``players`` name_key and player."""
    from tideline.operators.joins import match_names

    n = F.lower(note)
    kind = F.when(n.rlike("alternate"), "q_alt_to_q").when(n.rlike("main draw|mdwc"), "q_to_md").otherwise("q_withdrawal")
    tagged = match_names(df.withColumn("kind", kind), players)
    return tagged.withColumn("q_spots_delta", F.when(F.col("kind") == "q_alt_to_q", 0).otherwise(1)).withColumn("who", F.coalesce(F.col("player").cast("string"), F.col("printed"))).withColumn("resolved", F.col("player").isNotNull())


def open_places(notes: DataFrame, lists: list[str], order: list[str]) -> DataFrame:
    """``notes`` (``classify_notes``) with ``open``: the places of the qualifying draw that are open after each note of its list."""
    return prefix_sum(notes, lists, order, "q_spots_delta", "open")


def check_outcomes(status: DataFrame, checks: DataFrame) -> DataFrame:
    """``src, checked_at, failures`` after the checks (src, ts, failed): failures in a row since the last success, on top of those before."""
    last_good = checks.where("not failed").groupBy("src").agg(F.max("ts").alias("good"))
    tail = checks.join(last_good, "src", "left").where(F.col("failed") & (F.col("good").isNull() | (F.col("ts") > F.col("good")))).groupBy("src").agg(F.count(F.lit(1)).alias("bad"))
    newest = checks.groupBy("src").agg(F.max("ts").alias("ts"))
    both = status.join(newest, "src", "full_outer").join(last_good, "src", "left").join(tail, "src", "left")
    base = F.when(F.col("good").isNull(), F.coalesce("failures", F.lit(0))).otherwise(0)
    return both.select("src", F.coalesce("ts", "checked_at").alias("checked_at"), (base + F.coalesce("bad", F.lit(0))).alias("failures"))


def weekly_coverage(events: DataFrame, ts: str, width: str = "7 days") -> DataFrame:
    w = events.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))
    return w.select(F.col("w.start").alias("week"), "event_type", "n", "users")
