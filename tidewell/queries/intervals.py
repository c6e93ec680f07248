"""Interval and fluent queries (B-01 … B-45) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import fluents
from tidewell.operators import intervals as iv
from tidewell.operators.ordered import width_if_hot
from tidewell.queries import Registry
from tidewell.session import shared_dir, table
from tidewell.sources import tables

R = Registry()
K = ["user_id"]
WIDTH = 30 * 86400

# event times in whole seconds; simple fluents by inertia; one macro per list of intervals
BASE = f"""ev AS (SELECT user_id, event_type, value, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t, event_id FROM events)"""


def _inertia(name: str, up: str, down: str) -> str:
    return f"""{name}_p AS (SELECT user_id, t + 1 AS t, CASE WHEN bool_or({down}) THEN 0 ELSE 1 END AS s FROM ev WHERE ({up}) OR ({down}) GROUP BY 1, 2),
{name}_c AS (SELECT *, lag(s, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS p FROM {name}_p),
{name} AS (SELECT user_id, t AS "start", e AS "end" FROM (SELECT user_id, t, s, lead(t, 1, {iv.INF}) OVER (PARTITION BY user_id ORDER BY t) AS e FROM {name}_c WHERE s <> p) WHERE s = 1)"""


A = _inertia("a", "event_type = 'view'", "event_type = 'purchase'")
B = _inertia("b", "event_type = 'click'", "event_type = 'error'")
AB = f"WITH {BASE}, {A}, {B}"


def _sweep_sql(cond: str, head: str = AB) -> str:
    return f"""{head}, d AS (SELECT user_id, t, sum(da) AS da, sum(db) AS db FROM (
 SELECT user_id, "start" AS t, 1 AS da, 0 AS db FROM a UNION ALL SELECT user_id, "end", -1, 0 FROM a WHERE "end" < {iv.INF}
 UNION ALL SELECT user_id, "start", 0, 1 FROM b UNION ALL SELECT user_id, "end", 0, -1 FROM b WHERE "end" < {iv.INF}) GROUP BY 1, 2),
c AS (SELECT user_id, t, sum(da) OVER w AS ca, sum(db) OVER w AS cb FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
h AS (SELECT user_id, t, CASE WHEN {cond} THEN 1 ELSE 0 END AS s FROM c),
g AS (SELECT *, lag(s, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS p FROM h)
SELECT user_id, t AS "start", e AS "end" FROM (SELECT user_id, t, s, lead(t, 1, {iv.INF}) OVER (PARTITION BY user_id ORDER BY t) AS e FROM g WHERE s <> p) WHERE s = 1"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("t"), "event_id")


def _w(spark: SparkSession, sf: str) -> int | None:
    """Blocks of 30 days if a user has too many events for one task."""
    return width_if_hot(table(spark, sf, "events"), K, WIDTH)


def _of(spark: SparkSession, sf: str, up: str, down: str, width: int | None = None) -> DataFrame:
    e = _events(spark, sf).filter(F.col("event_type").isin(up, down)).withColumn("initiates", F.col("event_type") == up)
    return iv.from_points(e, K, width=width or _w(spark, sf))


def _a(spark: SparkSession, sf: str) -> DataFrame:
    return _of(spark, sf, "view", "purchase")


def _b(spark: SparkSession, sf: str) -> DataFrame:
    return _of(spark, sf, "click", "error")


@R.add("b07_inertia", f'{AB} SELECT * FROM a')
def b07_inertia(spark: SparkSession, sf: str) -> DataFrame:
    """initiatedAt, terminatedAt and inertia (B-03, B-04, B-07)."""
    return _a(spark, sf)


@R.add("b20_union", _sweep_sql("ca >= 1 OR cb >= 1"))
def b20_union(spark: SparkSession, sf: str) -> DataFrame:
    return iv.union_all([_a(spark, sf), _b(spark, sf)], K, _w(spark, sf))


@R.add("b21_intersect", _sweep_sql("ca >= 1 AND cb >= 1"))
def b21_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return iv.intersect_all([_a(spark, sf), _b(spark, sf)], K, _w(spark, sf))


@R.add("b22_relative_complement", _sweep_sql("ca >= 1 AND cb = 0"))
def b22_relative_complement(spark: SparkSession, sf: str) -> DataFrame:
    return iv.relative_complement_all(_a(spark, sf), [_b(spark, sf)], K, _w(spark, sf))


@R.add("b23_complement", f"""{AB}, e AS (SELECT user_id, 1704067200 AS t FROM (SELECT DISTINCT user_id FROM a) UNION ALL SELECT user_id, "end" FROM a WHERE "end" < {iv.INF}),
n AS (SELECT user_id, t AS "start", (SELECT coalesce(min(a."start"), {iv.INF}) FROM a WHERE a.user_id = e.user_id AND a."start" >= e.t) AS "end" FROM e) SELECT * FROM n WHERE "start" < "end" """)
def b23_complement(spark: SparkSession, sf: str) -> DataFrame:
    return iv.complement_all([_a(spark, sf)], K, 1704067200, _w(spark, sf))


@R.add("b09_boundaries", f"""{AB} SELECT user_id, 'start' AS event, "start" - 1 AS t, "start" AS at FROM a UNION ALL SELECT user_id, 'end', "end" - 1, "end" FROM a WHERE "end" < {iv.INF}""")
def b09_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """start/end events (B-09) beside startI/endI at the bound (B-10)."""
    x = _a(spark, sf)
    return iv.boundaries(x, K).withColumn("at", iv.next_point(F.col("t")))


@R.add("b13_holds_at", f"""{AB} SELECT event_id FROM ev WHERE event_type = 'signup' AND EXISTS (SELECT 1 FROM a WHERE a.user_id = ev.user_id AND a."start" <= ev.t AND ev.t < a."end")""")
def b13_holds_at(spark: SparkSession, sf: str) -> DataFrame:
    p = _events(spark, sf).filter("event_type = 'signup'").select("user_id", "event_id", "t")
    return iv.holds_at(p, _a(spark, sf), K, width=_w(spark, sf)).select("event_id")


@R.add("b14_not_holds_at", f"""{AB} SELECT event_id FROM ev WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = ev.user_id AND a."start" <= ev.t AND ev.t < a."end")""")
def b14_not_holds_at(spark: SparkSession, sf: str) -> DataFrame:
    p = _events(spark, sf).filter("event_type = 'signup'").select("user_id", "event_id", "t")
    return iv.holds_at(p, _a(spark, sf), K, negated=True, width=_w(spark, sf)).select("event_id")


ISLES = f"""WITH {BASE}, p AS (SELECT DISTINCT user_id, t FROM ev WHERE event_type = 'view'), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {{gap}} THEN 0 ELSE 1 END AS n FROM p),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t) AS isle FROM g)"""


@R.add("b17_extendable", ISLES.format(gap=86400) + " SELECT user_id, max(t) + 86400 AS t FROM i GROUP BY user_id, isle")
def b17_extendable(spark: SparkSession, sf: str) -> DataFrame:
    return iv.extendable_deadlines(_events(spark, sf).filter("event_type = 'view'"), K, 86400, width=_w(spark, sf))


@R.add("b19_samples", ISLES.format(gap=3600) + ' SELECT user_id, min(t) AS "start", max(t) // 3600 * 3600 + 3600 AS "end" FROM i GROUP BY user_id, isle')
def b19_samples(spark: SparkSession, sf: str) -> DataFrame:
    return iv.from_samples(_events(spark, sf).filter("event_type = 'view'"), K, step=3600, width=_w(spark, sf))


@R.add("b16_fixed_deadline", f"""WITH RECURSIVE {BASE}, p AS (SELECT user_id, t, min(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS up FROM ev WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM p),
s(user_id, k, n, since, due) AS (SELECT DISTINCT user_id, 0::BIGINT, n, NULL::BIGINT, NULL::BIGINT FROM r UNION ALL SELECT r.user_id, r.k, r.n, CASE WHEN r.up = 0 THEN NULL WHEN s.since IS NULL OR r.t >= s.since + 86400 THEN r.t ELSE s.since END, CASE WHEN s.since IS NOT NULL AND r.t >= s.since + 86400 THEN s.since + 86400 END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT user_id, due AS t FROM s WHERE due IS NOT NULL UNION ALL SELECT user_id, since + 86400 FROM s WHERE k = n AND since IS NOT NULL""")
def b16_fixed_deadline(spark: SparkSession, sf: str) -> DataFrame:
    """A view starts a state that ends by itself after a day, unless a purchase ends it first."""
    e = _events(spark, sf)
    return iv.fixed_deadlines(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), K, 86400, width=_w(spark, sf))


@R.add("b25_durations", f"""{AB}, q AS (SELECT max(t) AS q FROM ev) SELECT 'longer' AS kind, user_id, "start", "end" FROM a, q WHERE least("end", q) - "start" > 200000 UNION ALL SELECT 'shorter', user_id, "start", "end" FROM a WHERE "end" < {iv.INF} AND "end" - "start" < 50000""")
def b25_durations(spark: SparkSession, sf: str) -> DataFrame:
    now = _events(spark, sf).agg(F.max("t")).first()[0] or 0
    a = _a(spark, sf)
    return iv.longer_than(a, 200000, now).withColumn("kind", F.lit("longer")).unionByName(iv.shorter_than(a, 50000).withColumn("kind", F.lit("shorter"))).select("kind", "user_id", "start", "end")


ALLEN_ON = {
    "before": 'b."start" >= a."end"',
    "meets": 'a."end" - 1 = b."start" AND a."end" - a."start" > 1',
    "starts": 'a."start" = b."start" AND a."end" < b."end"',
    "finishes": 'a."start" > b."start" AND a."end" = b."end"',
    "during": 'a."start" > b."start" AND a."end" < b."end"',
    "overlaps": 'a."start" < b."start" AND a."end" - 1 > b."start" AND a."end" < b."end"',
    "equal": 'a."start" = b."start" AND a."end" = b."end"',
}


# meets, starts and equal need lists that share bounds: (up, down, earlier) of source and target
SHARED = {
    "meets": (("view", "purchase", 0), ("purchase", "error", 1)),
    "starts": (("view", "purchase", 0), ("view", "error", 0)),
    "equal": (("view", "purchase", 0), ("view", "purchase|error", 0)),
}


def _list_sql(name: str, up: str, down: str, earlier: int) -> str:
    quoted = ", ".join(f"'{x}'" for x in down.split("|"))
    return _inertia(name, f"event_type = '{up}'", f"event_type IN ({quoted})").replace("SELECT user_id, t + 1 AS t", f"SELECT user_id, t + {1 - earlier} AS t")


def _list(spark: SparkSession, sf: str, up: str, down: str, earlier: int) -> DataFrame:
    e = _events(spark, sf).filter(F.col("event_type").isin(up, *down.split("|"))).withColumns({"initiates": F.col("event_type") == up, "t": F.col("t") - earlier})
    return iv.from_points(e, K, width=_w(spark, sf))


def _allen_query(relation: str) -> None:
    n = 30 + list(ALLEN_ON).index(relation)
    one, two = SHARED.get(relation, (("view", "purchase", 0), ("click", "error", 0)))
    head = f"WITH {BASE}, {_list_sql('a', *one)}, {_list_sql('b', *two)}"

    @R.add(f"b{n}_{relation}", f"""{head} SELECT a.user_id, a."start" AS start_1, a."end" AS end_1, b."start" AS start_2, b."end" AS end_2 FROM a JOIN b ON a.user_id = b.user_id AND {ALLEN_ON[relation]}""")
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return iv.allen(_list(spark, sf, *one), _list(spark, sf, *two), relation, K, _w(spark, sf))


for _r in ALLEN_ON:
    _allen_query(_r)


def _mode_sql() -> str:
    """Six modes: the lists of sources and targets of the relation, and sweeps over the two."""
    head = f"""{AB}, p AS (SELECT a.user_id, a."start" AS s1, a."end" AS e1, b."start" AS s2, b."end" AS e2 FROM a JOIN b ON a.user_id = b.user_id AND {ALLEN_ON['overlaps']}), one AS (SELECT DISTINCT user_id, s1 AS "start", e1 AS "end" FROM p), two AS (SELECT DISTINCT user_id, s2 AS "start", e2 AS "end" FROM p)"""
    parts = ["SELECT 'source' AS mode, * FROM one", "SELECT 'target' AS mode, * FROM two"]
    for k, (mode, cond) in enumerate({"union": "ca >= 1 OR cb >= 1", "intersection": "ca >= 1 AND cb >= 1", "relative_complement": "ca >= 1 AND cb = 0", "relative_complement_inverse": "cb >= 1 AND ca = 0"}.items()):
        sweep = _sweep_sql(cond, "").replace("FROM a", "FROM one").replace("FROM b", "FROM two").lstrip(", ")
        for name in ("d", "c", "h", "g"):
            sweep = sweep.replace(f"{name} AS (", f"{name}{k} AS (").replace(f"FROM {name} ", f"FROM {name}{k} ").replace(f"FROM {name})", f"FROM {name}{k})")
        ctes, _, last = sweep.rpartition("\nSELECT ")
        head += ", " + ctes
        parts.append(f"SELECT '{mode}' AS mode, * FROM (SELECT {last})")
    return head + " " + " UNION ALL ".join(parts)


@R.add("b37_allen_modes", _mode_sql())
def b37_allen_modes(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for mode in ("source", "target", "union", "intersection", "relative_complement", "relative_complement_inverse"):
        d = iv.allen_intervals(_a(spark, sf), _b(spark, sf), "overlaps", K, mode, _w(spark, sf)).withColumn("mode", F.lit(mode))
        out = d if out is None else out.unionByName(d)
    return out


STEP, MEMORY = 2 * 86400, 4 * 86400


def _known_sql(name: str, up: str, down: str, keep: int = 0) -> str:
    """By definition: at each query the inertia of every point that some query up to then has seen."""
    return f"""{name}_p AS (SELECT *, t + (event_id % 7) * 60000 AS arrival FROM ev WHERE event_type IN ('{up}', '{down}')), {name}_f AS (SELECT p.user_id, p.t, p.event_type, min(q) AS f FROM {name}_p p JOIN q ON q >= t AND q >= arrival GROUP BY p.event_id, p.user_id, p.t, p.event_type),
{name}_s AS (SELECT q, user_id, t + 1 AS t, CASE WHEN bool_or(event_type = '{down}') THEN 0 ELSE 1 END AS s FROM {name}_f JOIN q ON f <= q WHERE t > f - {MEMORY} GROUP BY 1, 2, 3),
{name}_c AS (SELECT *, lag(s, 1, 0) OVER (PARTITION BY q, user_id ORDER BY t) AS p FROM {name}_s),
{name} AS (SELECT user_id, q, t AS "start", e AS "end" FROM (SELECT user_id, q, t, s, lead(t, 1, {iv.INF}) OVER (PARTITION BY q, user_id ORDER BY t) AS e FROM {name}_c WHERE s <> p) WHERE s = 1 AND e > q - {MEMORY + keep} + 1)"""


QUERIES = f"WITH {BASE}, q AS (SELECT unnest(range(min(t) // 86400 * 86400, max(t) + {MEMORY} + 1, {STEP})) AS q FROM ev)"


def _known(spark: SparkSession, sf: str, up: str, down: str, keep: int = 0) -> DataFrame:
    e = _events(spark, sf)
    low, high = e.agg(F.min("t"), F.max("t")).first()
    first = (low or 0) // 86400 * 86400
    last = first + ((high or 0) + MEMORY - first) // STEP * STEP
    p = e.filter(F.col("event_type").isin(up, down)).withColumns({"arrival": F.col("t") + (F.col("event_id") % 7) * 60000, "initiates": F.col("event_type") == up})
    return iv.windowed_fluent(p, K, first, last, STEP, MEMORY, keep=keep)


@R.add("b08_windows", f"{QUERIES}, {_known_sql('a', 'view', 'purchase')} SELECT * FROM a")
def b08_windows(spark: SparkSession, sf: str) -> DataFrame:
    """A fluent at every query time, with late arrivals, forgetting and carry-over (B-08, B-42, S-19)."""
    return _known(spark, sf, "view", "purchase")


@R.add("b09_windows", f"""{QUERIES}, {_known_sql('a', 'view', 'purchase')} SELECT user_id, q, 'start' AS event, "start" - 1 AS t FROM a WHERE "start" - 1 > q - {MEMORY} AND "start" - 1 <= q UNION ALL SELECT user_id, q, 'end', "end" - 1 FROM a WHERE "end" < {iv.INF} AND "end" - 1 <= q""")
def b09_windows(spark: SparkSession, sf: str) -> DataFrame:
    """start and end events per window; none for an interval that only goes on (B-09)."""
    return iv.windowed_boundaries(_known(spark, sf, "view", "purchase"), K, MEMORY)


@R.add("b38_allen_windows", f"""{QUERIES}, {_known_sql('a', 'view', 'purchase', 2 * STEP)}, {_known_sql('b', 'click', 'error')} SELECT a.user_id, a.q, a."start" AS start_1, a."end" AS end_1, b."start" AS start_2, b."end" AS end_2 FROM a JOIN b ON a.user_id = b.user_id AND a.q = b.q AND {ALLEN_ON['before']}""")
def b38_allen_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of a relation are remembered longer than the window (B-38)."""
    return iv.allen(_known(spark, sf, "view", "purchase", 2 * STEP), _known(spark, sf, "click", "error"), "before", [*K, "q"])


@R.add("s19_per_window", f"{QUERIES}, {_known_sql('a', 'view', 'purchase')} SELECT q, count(*) AS n, CAST(sum(\"start\") AS BIGINT) AS starts FROM a GROUP BY 1")
def s19_per_window(spark: SparkSession, sf: str) -> DataFrame:
    """The intervals of each window written to a folder of its own, and read back (S-19)."""
    path = shared_dir(spark)
    tables.write_windows(_known(spark, sf, "view", "purchase"), path)
    return tables.read_windows(spark, path).groupBy("q").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@R.add("b40_windows", f"""WITH {BASE}, q AS (SELECT unnest(range(1704067200 + 86400, 1704067200 + 86400 * 21, 86400)) AS q), x AS (SELECT *, t + (event_id % 5) * 40000 AS arrival FROM ev)
SELECT q, event_type, count(*) AS n FROM x JOIN q ON t > q - 172800 AND t <= q AND arrival <= q GROUP BY 1, 2""")
def b40_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding query windows with late arrivals (B-40, B-41, B-42, S-18) at twenty fixed query times,
    as its SQL has them; b40_all_windows covers the whole table."""
    e = _events(spark, sf).withColumn("arrival", F.col("t") + (F.col("event_id") % 5) * 40000)
    w = iv.query_windows(e, "t", "arrival", 1704067200 + 86400, 1704067200 + 86400 * 20, 86400, 172800)
    return w.groupBy("q", "event_type").agg(F.count("*").alias("n"))


@R.add("b40_all_windows", f"""WITH {BASE}, q AS (SELECT unnest(range(min(t) // 86400 * 86400, max(t) + 172800 + 1, 86400)) AS q FROM ev), x AS (SELECT *, t + (event_id % 5) * 40000 AS arrival FROM ev)
SELECT q, event_type, count(*) AS n FROM x JOIN q ON t > q - 172800 AND t <= q AND arrival <= q GROUP BY 1, 2""")
def b40_all_windows(spark: SparkSession, sf: str) -> DataFrame:
    """b40_windows at every query time that can see an event: from the first event, rounded up to
    the step, to the last one plus the memory."""
    step, memory = 86400, 172800
    e = _events(spark, sf).withColumn("arrival", F.col("t") + (F.col("event_id") % 5) * 40000)
    low, high = e.agg(F.min("t"), F.max("t")).first()
    first = -(-(low or 0) // step) * step
    last = max(first, ((high or 0) + memory - 1) // step * step)
    w = iv.query_windows(e, "t", "arrival", first, last, step, memory)
    return w.groupBy("q", "event_type").agg(F.count("*").alias("n"))


@R.add("b43_clip", f"""{AB} SELECT user_id, greatest("start", 1704500000) AS "start", least("end", 1705500000) AS "end" FROM a WHERE greatest("start", 1704500000) < least("end", 1705500000)""")
def b43_clip(spark: SparkSession, sf: str) -> DataFrame:
    return iv.clip(_a(spark, sf), 1704500000, 1705500000)


@R.add("b01_program", _sweep_sql("ca >= 1 AND cb = 0").replace("SELECT user_id, t AS", "SELECT 'lost' AS name, user_id, t AS") + f""" UNION ALL SELECT 'big', user_id, t, t + 1 FROM ev WHERE event_type = 'purchase' AND value > 50""")
def b01_program(spark: SparkSession, sf: str) -> DataFrame:
    """A program: events, a derived event, two simple fluents, a tree (B-01, B-02, B-11, B-12, B-18, B-44, B-45)."""
    e = _events(spark, sf)
    p = fluents.Program(K, width=_w(spark, sf))
    for kind in ("view", "click", "purchase", "error"):
        p.event(kind, e.filter(F.col("event_type") == kind))
    p.derived("big", ["purchase"], lambda x: x["purchase"].filter("value > 50").select("user_id", "t"))
    p.simple("interested", ["view"], ["purchase"])
    p.simple("active", ["click"], ["error"])
    p.tree("lost", ("and", "interested", ("not", "active")))
    got = p.evaluate("lost", "big")
    big = got["big"].select(F.lit("big").alias("name"), "user_id", F.col("t").alias("start"), (F.col("t") + 1).alias("end"))
    return got["lost"].select(F.lit("lost").alias("name"), "user_id", "start", "end").unionByName(big)


@R.add("b05_values", f"""WITH {BASE}, {_inertia("v", "event_type = 'view'", "event_type IN ('click', 'error')")}, {_inertia("c", "event_type = 'click'", "event_type IN ('view', 'error')")}
SELECT 'view' AS value, * FROM v UNION ALL SELECT 'click', * FROM c""")
def b05_values(spark: SparkSession, sf: str) -> DataFrame:
    """Two values of one fluent: starting one ends the other (B-05)."""
    e = _events(spark, sf)
    p = fluents.Program(K, width=_w(spark, sf))
    for kind in ("view", "click", "error"):
        p.event(kind, e.filter(F.col("event_type") == kind))
    p.simple("v", ["view"], ["error"], values=["click"])
    p.simple("c", ["click"], ["error"], values=["view"])
    got = p.evaluate("v", "c")
    return got["v"].withColumn("value", F.lit("view")).unionByName(got["c"].withColumn("value", F.lit("click")))


@R.add("b06_initially", f"""WITH {BASE}, x AS (SELECT user_id, min(t) FILTER (WHERE event_type = 'purchase') AS e, min(t) FILTER (WHERE event_type = 'view') AS v FROM ev GROUP BY 1) SELECT user_id, 0 AS "start", coalesce(e + 1, {iv.INF}) AS "end" FROM x""")
def b06_initially(spark: SparkSession, sf: str) -> DataFrame:
    """A fluent that holds from 0 until the first purchase."""
    e = _events(spark, sf)
    p = fluents.Program(K, width=None)
    p.event("never", e.limit(0))
    p.event("purchase", e.filter("event_type = 'purchase'"))
    p.simple("fresh", ["never"], ["purchase"], initially=e.select("user_id").distinct())
    return p.evaluate("fresh")["fresh"]


@R.add("b15_cyclic", f"""WITH RECURSIVE {BASE}, g AS (SELECT user_id, t, bool_or(event_type = 'purchase') AS buys, bool_or(event_type = 'error') AS errs, bool_or(event_type = 'signup') AS signs FROM ev GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM g),
s(user_id, k, t, trust, susp) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, false, false FROM r UNION ALL SELECT r.user_id, r.k, r.t, CASE WHEN s.susp AND signs THEN false WHEN NOT s.susp AND buys THEN true ELSE s.trust END, CASE WHEN s.susp AND signs THEN false WHEN s.trust AND errs THEN true ELSE s.susp END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1),
u AS (SELECT user_id, k, t, 'trust' AS fluent, trust AS v FROM s UNION ALL SELECT user_id, k, t, 'suspicion', susp FROM s),
c AS (SELECT *, lag(v, 1, false) OVER (PARTITION BY user_id, fluent ORDER BY k) AS was FROM u), x AS (SELECT *, lead(t + 1, 1, {iv.INF}) OVER (PARTITION BY user_id, fluent ORDER BY k) AS e FROM c WHERE v <> was)
SELECT user_id, fluent, t + 1 AS "start", e AS "end" FROM x WHERE v""")
def b15_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    """Two fluents that depend on each other: trust needs no suspicion to start, suspicion needs trust."""
    return fluents.cyclic(_events(spark, sf), K, _trust, ["trust", "suspicion"], name="event_type")


def _trust(s: dict[str, bool], event: str) -> dict[str, bool]:
    if event == "purchase" and not s["suspicion"]:
        return {"trust": True}
    if event == "error" and s["trust"]:
        return {"suspicion": True}
    if event == "signup" and s["suspicion"]:
        return {"trust": False, "suspicion": False}
    return {}


@R.add("b26_facts", f"""{AB} SELECT a.user_id, a."start", n.n_name FROM a JOIN customer c ON a.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 1""")
def b26_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Static knowledge looked up in a rule; whether it is broadcast is left to its measured size."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return _a(spark, sf).join(c, F.col("user_id") == F.col("c_custkey")).join(n.filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey")).select("user_id", "start", "n_name")


@R.add("b27_arithmetic", "SELECT event_id, least(abs(value * 7 % 360 - value * 3 % 360), 360 - abs(value * 7 % 360 - value * 3 % 360)) AS angle, value % 7 AS rest, value > 10 AND value < 20 AS inside FROM events")
def b27_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Angle difference, modulo and open range; in rules they are columns."""
    v = F.col("value")
    d = F.abs(v * 7 % 360 - v * 3 % 360)
    return table(spark, sf, "events").select("event_id", F.least(d, 360 - d).alias("angle"), F.pmod(v, F.lit(7.0)).alias("rest"), ((v > 10) & (v < 20)).alias("inside"))


@R.add("b28_findall", f"""{AB} SELECT a.user_id, a."start", count(*) AS clicks, string_agg(CAST(ev.event_id AS VARCHAR), ',' ORDER BY ev.event_id) AS ids FROM a JOIN ev ON ev.user_id = a.user_id AND a."start" <= ev.t AND ev.t < a."end" WHERE ev.event_type = 'click' GROUP BY 1, 2""")
def b28_findall(spark: SparkSession, sf: str) -> DataFrame:
    """All clicks inside an interval, as a list."""
    clicks = _events(spark, sf).filter("event_type = 'click'")
    inside = iv.lookup(clicks, _a(spark, sf), K, width=_w(spark, sf)).filter("t < hold_end")
    return inside.groupBy("user_id", F.col("hold_start").alias("start")).agg(F.count("*").alias("clicks"), F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("ids"))
