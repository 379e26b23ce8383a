"""Registration of queries and the derived views that they run on.

The driver's tables hold no event calendar, so views map orders to editions of events (one for an entity and year), customers to entities,
and editions to threshold snapshots. A view's text is valid in Spark and in ANSI SQL engines alike, so that a query and its oracle
start from the same rows (two spellings of the engines apart).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideline.storage import materialise, read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_ent": """
select c_custkey as ent, c_name as name, n_name as country, r_name as region,
  concat(n_name, ' ', cast(c_custkey % 40 as varchar(10))) as city,
  concat(lower(n_name), '-', cast(c_custkey as varchar(20))) as slug,
  cast(n_nationkey * 37 % 120 - 60 as double) + c_custkey % 10 * 0.3e0 as lat,
  cast(n_nationkey * 53 % 360 - 180 as double) + c_custkey % 7 * 0.3e0 as lon,
  case c_custkey % 3 when 0 then 'Clay' when 1 then 'Hard' else 'Grass' end as surface, c_acctbal as bal
from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    "v_ed": """
select ed_id, ent, yr, start_date,
  greatest(1, cast(floor(cast(start_date - cast(date_trunc('week', make_date(yr, 1, 5)) as date) as int) / 7) as int) + 1) as wk,
  level, price
from (select o_orderkey as ed_id, o_custkey as ent, cast(year(o_orderdate) as int) as yr, cast(o_orderdate as date) as start_date,
        case substring(o_orderpriority, 1, 1) when '1' then 'ATP 500' when '2' then 'ATP 250'
             when '3' then 'Challenger 125' when '4' then 'Challenger 75' else 'ITF M25' end as level,
        o_totalprice as price,
        row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate desc, o_orderkey desc) as rn
      from {orders}) x where rn = 1""",
    "v_snap": """
select ed_id, ev, dr,
  case when (ed_id + k) % 11 = 0 then null else cast(floor(price / 500e0) as int) + 3 + k * 40 end as direct_rank,
  case when (ed_id + k) % 7 = 0 then cast(floor(price / 500e0) as int) + 15 + k * 40 end as alt_rank,
  case when ev = 'doubles' and ed_id % 5 = 0 then cast(floor(price / 400e0) as int) + 3 end as adv_rank,
  case when (ed_id + k) % 22 = 0 then 4 end as byes
from {v_ed} cross join (select * from (values ('singles','main',0),('singles','qualifying',1),('doubles','main',2)) as d(ev, dr, k)) d""",
    "v_obs": """
select e.ed_id, e.ent, e.yr, e.wk, e.level, n.country, n.lat, n.lon, n.surface, s.ev, s.dr, s.direct_rank, s.alt_rank, s.adv_rank, s.byes,
  case when s.ev = 'doubles' then coalesce(s.adv_rank, s.alt_rank, s.direct_rank) else coalesce(s.alt_rank, s.direct_rank) end as cut
from {v_ed} e join {v_ent} n on n.ent = e.ent join {v_snap} s on s.ed_id = e.ed_id""",
    "v_cal": """
select ed_id, ent, yr, wk, start_date, price,
  case ed_id % 37 when 0 then 'Grand Slam' when 1 then 'Grand Slam Qualifying' when 2 then 'ATP 1000' when 3 then 'Exhibition' when 4 then 'ATP Finals'
    when 5 then 'Challenger 175' when 6 then 'ITF M15' when 7 then 'Challenger' else level end as level,
  case ed_id % 5 when 0 then true when 1 then false end as indoor,
  case when ed_id % 3 = 0 then cast(16 + ed_id % 5 * 16 as int) end as draw_size
from {v_ed}""",
    "v_placed": """
select c.ed_id, c.ent, c.yr, c.wk, c.start_date, c.level, c.indoor, c.draw_size, n.surface,
  case when c.ent % 23 > 0 then n.lat end as lat, n.lon
from {v_cal} c join {v_ent} n on n.ent = c.ent""",
    "v_named": """
select e.ed_id, e.ent, e.yr, e.start_date, e.level, n.surface, e.updated,
  concat('ev-', n.letters) as slug, concat(n.region, ' ', n.letters, case when e.ent % 4 = 0 then ' 2' else '' end) as name, n.town as city,
  case when e.ed_id % 13 = 0 then 'not_held' else 'held' end as status
from (select *, date_add(start_date, cast(ed_id % 9 as int)) as updated from {v_ed}) e
join (select ent, region, surface, translate(cast(ent as varchar(20)), '0123456789', 'abcdefghij') as letters, translate(city, '0123456789', 'abcdefghij') as town from {v_ent}) n on n.ent = e.ent""",
    "v_generic": """
select o.ed_id, o.ent, o.yr, o.start_date, 'Challenger' as level, n.surface, o.start_date as updated,
  case o.ed_id % 8 when 0 then concat('ev-', n.letters) when 3 then concat('ev-', n.letters, ' ch 2') when 5 then concat('grand-ev-', n.letters) else concat('zz-', translate(cast(o.ed_id as varchar(20)), '0123456789', 'abcdefghij')) end as slug,
  case o.ed_id % 8 when 1 then concat(n.region, ' ', n.letters) when 4 then concat('the ', n.region, ' ', n.letters) else concat('zz ', translate(cast(o.ed_id as varchar(20)), '0123456789', 'abcdefghij')) end as name,
  case o.ed_id % 8 when 2 then n.town when 6 then concat('greater ', n.town) else concat('yy ', translate(cast(o.ed_id as varchar(20)), '0123456789', 'abcdefghij')) end as city
from (select o_orderkey as ed_id, o_custkey as ent, cast(year(o_orderdate) as int) as yr, cast(o_orderdate as date) as start_date from {orders}) o
join (select ent, region, surface, translate(cast(ent as varchar(20)), '0123456789', 'abcdefghij') as letters, translate(city, '0123456789', 'abcdefghij') as town from {v_ent}) n on n.ent = o.ent
left anti join {v_ed} e on e.ed_id = o.ed_id""",
    "v_moves": """
select event_id as seq, user_id % 20 as list, user_id as player, ts,
  case event_type when 'click' then 'withdrawal' when 'view' then 'promotion' when 'purchase' then 'alternate-withdrawal' else 'reported-next' end as kind, value
from {events}""",
    "v_entries": """
select distinct user_id % 20 as list, user_id as player, case when user_id % 7 < 2 then 'accepted' else 'alternate' end as status, user_id * 37 % 1009 as position
from {events} where user_id % 11 > 0""",
    "v_hash": """
select user_id as src, event_id as seq, ts, concat(event_type, '|', cast(cast(floor(value / 50e0) as int) as varchar(10))) as content
from {events}""",
}

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


class Tables:
    """Tables and views of one folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        if name not in VIEWS:
            raise AttributeError(name)
        needs = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
        return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in needs})

    def keep(self, *names: str) -> None:
        """Write views that a query reads several times; they and the views on them are read from there afterwards."""
        for name in names:
            self.__dict__[name] = materialise(getattr(self, name), name)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with the SQL that gives the same rows."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = (fn, sql)
        return fn

    return wrap


def _with_views(sql: str) -> str:
    needed: list[str] = []

    def add(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in needed:
                add(VIEWS[v])
                if v not in needed:
                    needed.append(v)

    add(sql)
    if not needed:
        return sql
    names = {n: n for n in [*TABLES, *VIEWS]}
    heads = ", ".join(f"{v} AS ({VIEWS[v].format_map(names)})" for v in needed).replace("left anti join", "anti join").replace("date_add(start_date, cast(ed_id % 9 as int))", "start_date + cast(ed_id % 9 as int)")
    body = sql.strip()
    if m := re.match(r"(?i)with\s+recursive\s+", body):
        return f"WITH RECURSIVE {heads}, {body[m.end():]}"
    return f"WITH {heads}, {body[5:]}" if re.match(r"(?i)with\s", body) else f"WITH {heads} {body}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _with_views(sql) for name, (_, sql) in REGISTRY.items() if sql}
