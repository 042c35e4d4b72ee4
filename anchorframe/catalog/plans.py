"""Composite jobs on proxy data.

A case is a user whose first purchase from day 10 on fell before noon, the other users are controls with
one candidate date per event type. Users lie in the region of their customer record, and also in the
next region when their balance is negative. Cover comes from the customer's orders, 24 years earlier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from anchorframe.catalog.base import query, rounded, rsql
from anchorframe.catalog.models import SIGNAL, _terms_sql, newton_sql, signal_table
from anchorframe.catalog.proxies import ANCHORS, COVER, OBS, anchored_events, anchors, order_cover
from anchorframe.catalog.sampling import SEED, _match_sql, key_sql
from anchorframe.functions.dates import day_offset
from anchorframe.functions.text import level_rank
from anchorframe.operators.aggregates import DROUGHT_WINDOWS, WEATHER_WINDOWS, window_specs
from anchorframe.operators.joins import anchor_join
from anchorframe.plans.controls import restrict_dates, select_controls
from anchorframe.plans.presence import Names, build_absence, build_presence, presence_absence
from anchorframe.plans.regional import drought_at_event, regional_models
from anchorframe.session import materialize

NAMES = Names(id="user_id", anchor="anchor_ts", obs="ts")
TYPES = ["click", "error", "purchase", "signup", "view"]
START, END = "1991-01-01", "2021-12-31"


def users(t):
    """(user, region) pairs."""
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("n_regionkey").alias("k"), "c_acctbal")
    k = F.when(F.col("c_acctbal") < 0, F.array("k", (F.col("k") + 1) % 5)).otherwise(F.array("k"))
    pairs = c.select("user_id", F.explode(k).alias("r_regionkey"))
    return pairs.join(t.region, "r_regionkey").select("user_id", F.col("r_name").alias("region"))


USERS = """pairs AS (SELECT c_custkey AS user_id, n_regionkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
 SELECT c_custkey, (n_regionkey + 1) % 5 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0),
 users AS (SELECT user_id, r_name AS region FROM pairs JOIN region ON k = r_regionkey)"""


def _back(ts):
    return F.add_months(F.to_date(ts), -288)


def case_events(t):
    a = anchors(t).filter(F.hour("anchor_ts") < 12)
    return users(t).join(a, "user_id").select("user_id", "region", "anchor_ts", _back("anchor_ts").alias("ig_date"))


def control_dates(t):
    """Candidate dates of controls: the first event of each type from day 10 on."""
    late = anchors(t).filter(F.hour("anchor_ts") >= 12).select("user_id")
    e = t.events.filter(F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz"))
    first = e.groupBy("user_id", level_rank("event_type", TYPES).alias("ignition_id")).agg(F.min("ts").alias("anchor_ts"))
    return first.join(late, "user_id")


def control_events(t):
    return users(t).join(control_dates(t), "user_id").select(
        "user_id", "region", "ignition_id", "anchor_ts", _back("anchor_ts").alias("ig_date"))


CASES = f"""{ANCHORS}, {USERS}, cases AS (SELECT user_id, region, anchor_ts, CAST(CAST(anchor_ts AS DATE) - INTERVAL 288 MONTH AS DATE) AS ig_date
 FROM users JOIN anchors USING (user_id) WHERE hour(anchor_ts) < 12),
 cdates AS (SELECT user_id, list_position({TYPES}, event_type)::INTEGER AS ignition_id, min(ts) AS anchor_ts FROM events
  WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' AND user_id IN (SELECT user_id FROM anchors WHERE hour(anchor_ts) >= 12) GROUP BY 1, 2),
 controls AS (SELECT user_id, region, ignition_id, anchor_ts, CAST(CAST(anchor_ts AS DATE) - INTERVAL 288 MONTH AS DATE) AS ig_date FROM users JOIN cdates USING (user_id))"""


def measures(df):
    """Daily measures carried by the event types."""
    of = lambda kind, x: F.when(F.col("event_type") == kind, x)
    v = F.col("value")
    return df.withColumns({"pdsi": of("view", v / 20 - 5), "spei14d": of("click", v / 50 - 1), "vpd": of("error", v / 10), "vs": of("signup", v / 8)})


def case_daily(t):
    return measures(anchor_join(t.events, case_events(t).select("user_id", "anchor_ts").distinct(), ["user_id"]))


def control_daily(t):
    return measures(anchor_join(t.events, control_dates(t), ["user_id"]))


def cover_tables(t):
    y = t.orders.select(F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("year"), "o_orderstatus", "o_totalprice")
    woody = y.filter("o_orderstatus = 'F'").groupBy("user_id", "year").agg(F.sum("o_totalprice").alias("woody_hectares"))
    return woody, y.groupBy("user_id", "year").agg(F.sum("o_totalprice").alias("evaluated_hectares"))


_M = """CASE WHEN event_type = 'view' THEN value / 20 - 5 END AS pdsi, CASE WHEN event_type = 'click' THEN value / 50 - 1 END AS spei14d,
 CASE WHEN event_type = 'error' THEN value / 10 END AS vpd, CASE WHEN event_type = 'signup' THEN value / 8 END AS vs"""
_SPECS_D, _SPECS_W = window_specs(["spei14d", "pdsi"], DROUGHT_WINDOWS), window_specs(["vpd", "vs"], WEATHER_WINDOWS)
_FEATURES = ", ".join([f"avg(CASE WHEN tr BETWEEN {s.lo} AND {s.hi} THEN {s.measure} END) AS {s.out}" for s in _SPECS_D] +
                      [f"avg(CASE WHEN d BETWEEN {s.lo} AND {s.hi} THEN {s.measure} END) AS {s.out}" for s in _SPECS_W])
_OUT = ", ".join(f"{rsql(s.out)} AS {s.out}" for s in _SPECS_D + _SPECS_W)
_WOODY = """wood AS (SELECT o_custkey AS user_id, year(o_orderdate) AS year, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / sum(o_totalprice) AS percent_woody FROM orders GROUP BY 1, 2)"""


def _rows_sql(name: str, base: str, pa: int) -> str:
    """Feature CTE ``name`` over the (user, region, date) rows of ``base``."""
    return f"""{name}_o AS (SELECT user_id, date_diff('day', CAST(a.anchor_ts AS DATE), CAST(ts AS DATE)) AS d,
  trunc((epoch_us(ts) - epoch_us(a.anchor_ts)) / 86400000000.0::DOUBLE) AS tr, {_M} FROM events JOIN (SELECT DISTINCT user_id, anchor_ts FROM {base}) a USING (user_id)),
 {name}_f AS (SELECT user_id, {_FEATURES} FROM {name}_o GROUP BY 1),
 {name} AS (SELECT b.user_id, b.region, b.ig_date, w.percent_woody, f.* EXCLUDE (user_id), {pa} AS pa FROM {base} b LEFT JOIN {name}_f f ON f.user_id = b.user_id
  LEFT JOIN wood w ON w.user_id = b.user_id AND w.year = year(b.ig_date) - 1 WHERE b.ig_date BETWEEN DATE '{START}' AND DATE '{END}')"""


_DAY0 = "floor((epoch_us(ts) - epoch_us(anchor_ts)) / 86400000000.0::DOUBLE) = 0"
_CHOSEN = f"""{CASES}, lim AS (SELECT region, max(acc) AS lim FROM (SELECT region, user_id, sum(value) AS acc FROM cases JOIN events USING (user_id) WHERE {_DAY0} GROUP BY 1, 2) GROUP BY 1),
 okd AS (SELECT DISTINCT user_id, ignition_id FROM (SELECT region, user_id, ignition_id, sum(value) AS acc FROM controls JOIN events USING (user_id) WHERE {_DAY0} GROUP BY 1, 2, 3) JOIN lim USING (region) WHERE acc <= lim),
 chosen AS (SELECT user_id, ignition_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql('one', 'user_id', 'ignition_id')}) AS rn FROM okd) WHERE rn = 1)"""


def chosen_dates(t):
    case_rows = anchor_join(t.events, case_events(t), ["user_id"])
    control_rows = anchor_join(t.events, control_events(t), ["user_id"])
    return restrict_dates(case_rows, control_rows, "region", "user_id", "ignition_id", "value", "ts", "anchor_ts", SEED)


@query("restrict_dates", f"WITH {_CHOSEN} SELECT user_id, ignition_id FROM chosen")
def dates(t):
    return chosen_dates(t)


_SEL_P = f"user_id, region, ig_date, {rsql('percent_woody')} AS percent_woody, {_OUT}, pa"
_P = f"WITH {_CHOSEN}, {_WOODY}, {_rows_sql('p', 'cases', 1)}"
_A = f"{_P}, cc AS (SELECT c.* FROM controls c JOIN chosen USING (user_id, ignition_id)), {_rows_sql('a', 'cc', 0)}"


def _presence(t):
    woody, evaluated = cover_tables(t)
    daily = case_daily(t)
    return build_presence(case_events(t), woody, evaluated, daily, daily, START, END, NAMES)


def _absence(t):
    woody, evaluated = cover_tables(t)
    daily, chosen = control_daily(t), materialize(chosen_dates(t))
    return build_absence(control_events(t), chosen.select("user_id"), chosen, woody, evaluated, daily, daily, START, END, NAMES)


@query("build_presence", f"{_P} SELECT {_SEL_P} FROM p")
def presence(t):
    return rounded(_presence(t))


@query("build_absence", f"{_A} SELECT {_SEL_P} FROM a")
def absence(t):
    return rounded(_absence(t))


@query("presence_absence", f"{_A} SELECT {_SEL_P} FROM p UNION ALL SELECT {_SEL_P} FROM a")
def both(t):
    return rounded(presence_absence(_presence(t), _absence(t), SEED, NAMES)[0])


@query("presence_absence_coarse", f"""{_A}, pr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql('region', 'user_id', 'region')}) AS rn FROM p),
 drops AS (SELECT region, count(*) AS n_drop FROM pr WHERE rn > 1 GROUP BY 1), ar AS (SELECT a.user_id, a.region, coalesce(n_drop, 0) AS n_drop,
 row_number() OVER (PARTITION BY a.region ORDER BY {key_sql('rebalance', 'a.user_id', 'a.region')}) AS k FROM a LEFT JOIN drops USING (region))
 SELECT user_id, region, 1 AS pa FROM pr WHERE rn = 1 UNION ALL SELECT user_id, region, 0 FROM ar WHERE k > n_drop""")
def coarse(t):
    return presence_absence(_presence(t), _absence(t), SEED, NAMES)[1].select("user_id", "region", "pa")


@query("drought_at_event_regions", f"""WITH {OBS}, k AS (SELECT event_type FROM obs GROUP BY 1 HAVING count(DISTINCT user_id) >= 10), w AS (SELECT event_type AS region, * EXCLUDE (event_type) FROM obs WHERE event_type IN (SELECT event_type FROM k)
 UNION ALL SELECT 'all regions', * EXCLUDE (event_type) FROM obs)
 SELECT region, user_id, {rsql('avg(value)')} AS value FROM w WHERE "offset" BETWEEN -5 AND 5 GROUP BY 1, 2""")
def drought(t):
    e = anchored_events(t).withColumn("offset", day_offset("ts", "anchor_ts")).withColumnRenamed("event_type", "region")
    return rounded(drought_at_event(e, "region", "user_id", ["value"]))


@query("select_controls", "WITH " + COVER + ", " + """li AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END)::DOUBLE AS water, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END)::DOUBLE AS developed_low,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END)::DOUBLE AS developed_high FROM lineitem GROUP BY 1),
 cl AS (SELECT * FROM cover JOIN li ON l_orderkey = o_orderkey), lim AS (SELECT region, max(water) AS w, max(developed_low) AS dl, max(developed_high) AS dh FROM cl WHERE pa = 1 AND o_totalprice < 250000 GROUP BY 1),
 inr AS (SELECT cl.* FROM cl JOIN lim USING (region) WHERE pa = 0 AND NOT (water > w AND (developed_low > dl OR developed_high > dh))), """ +
       (_match_sql("m1", "inr", "crop", 0.05, "(CASE WHEN count(*) < 90 THEN count(*) + 150 ELSE count(*) + 5 END)", "half_even") + ", " +
        _match_sql("m2", "m1", "hay", 0.1, "count(*)", "floor")).replace("FROM cover WHERE pa = 1", "FROM cover WHERE pa = 1 AND o_totalprice < 250000") +
       " SELECT region, o_orderkey FROM m2")
def chosen_controls(t):
    q = F.col("l_quantity")
    flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0.0))
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        flag("R").alias("water"), flag("A").alias("developed_low"), flag("N").alias("developed_high"))
    d = materialize(order_cover(t).join(li, "o_orderkey"))
    cases = d.filter("pa = 1 and o_totalprice < 250000")
    stages = select_controls(cases, d.filter("pa = 0"), "region", ["o_orderkey"], "water", ["developed_low", "developed_high"],
                             "crop", "hay", SEED, mult=1)
    return stages.matched.select("region", "o_orderkey")


_REG = f"""WITH RECURSIVE {SIGNAL}, big AS (SELECT * FROM sig WHERE nation IN (SELECT nation FROM sig WHERE y = 1 GROUP BY 1 HAVING count(*) >= 150)),
 {newton_sql('m', "(SELECT * FROM big WHERE nation NOT IN ('NATION_3', 'NATION_11'))", 'nation', 'y', 'price', 'crop')},
 {newton_sql('o', "(SELECT * FROM big WHERE nation IN ('NATION_3', 'NATION_11'))", 'nation', 'y', 'price', 'price * crop')}"""
_REG_COLS = f"nation, term, {rsql('est')} AS estimate, {rsql('est - 1.959963984540054::DOUBLE * se')} AS ci_lo, {rsql('est + 1.959963984540054::DOUBLE * se')} AS ci_hi, {rsql('exp(est)')} AS odds_ratio"


@query("regional_models", f"{_REG} {_terms_sql('m', 'nation', ['price', 'crop'], _REG_COLS)} UNION ALL {_terms_sql('o', 'nation', ['price', 'price:crop'], _REG_COLS)}")
def regional(t):
    own = ["price", ("price", "crop")]
    r = regional_models(signal_table(t), "y", "nation", ["price", "crop"], {"NATION_3": own, "NATION_11": own}, min_cases=150)
    return rounded(r.select("nation", "term", "estimate", "ci_lo", "ci_hi", "odds_ratio"))
