"""Registered queries over the test tables, each with its oracle SQL (DuckDB dialect).

Every query reads whole tables. Parameters are fixed values of the fixture
mapping (split instant, time-weight window, seed user, damping, rounds, city).
Doubles are rounded to 9 places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopweave.functions.core import folded_name, round6, round9
from shopweave.operators import features as FE
from shopweave.operators import graph as G
from shopweave.operators import rank as R
from shopweave.plans.recommend import city_graph, named, recommend_shops, recommendation_graph
from shopweave.session import ensure_checkpoint_dir, stored
from shopweave.sources import files as IO
from shopweave.sources.tables import base_ctes, pay_log, shop_table, view_log

# Fixed parameters of the registered queries.
SPLIT = "2000-01-01"
START = "1995-01-01"
AS_OF = "2001-08-02"
SEED_USER = 7
DAMPING = 0.85
ROUNDS = 15
TOP_K = 10
CITY = "NATION_3"
CITIES = ["NATION_0", "NATION_1", "NATION_2", "NATION_3", "NATION_4"]

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def portable_rounding(sql: str) -> str:
    """Rewrite every ``round(expr, p)`` into ``(floor((expr) * 1ep + 0.5) / 1ep)``.

    The same formula as ``round_half_up`` on the Spark side, so both engines
    round exact binary halves the same way.
    """
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, comma = 0, j + len("round("), -1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                comma = k
            k += 1
        expr = portable_rounding(sql[j + len("round("):comma])
        places = int(sql[comma + 1:k].strip())
        out.append(f"(floor(({expr}) * 1e{places} + 0.5) / 1e{places})")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = portable_rounding(sql)
        return fn

    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _logs(spark: SparkSession, sf: str):
    return pay_log(spark, sf), view_log(spark, sf), shop_table(spark, sf)


# --------------------------------------------------------------------------
# SQL building blocks (DuckDB), mirroring the DataFrame operators.
# --------------------------------------------------------------------------

def _bucket_sql(buckets: int = 100, salt: str = "") -> str:
    tail = f", '{salt}'" if salt else ""
    return f"cast(('0x' || substr(md5(concat_ws('|', user_id, shop_id{tail})), 1, 8)) as bigint) % {buckets}"


def _f(x: float) -> str:
    return f"cast({x!r} as double)"


def _tw_sql(mode: str = "recent", ts: str = "ts") -> str:
    age = f"cast(date_diff('second', {ts}, timestamp '{AS_OF}') as double)"
    span = f"cast(date_diff('second', timestamp '{START}', timestamp '{AS_OF}') as double)"
    if mode == "recent":
        return f"least(1.0, greatest(0.0, 1.0 - {age} / {span}))"
    return f"(1.0 + {age} / {span})"


def _events_sql(mode: str = "recent", with_view: bool = True) -> str:
    s = f"select user_id, shop_id, {_f(1.0)} * {_tw_sql(mode)} as weight from pay_log"
    if with_view:
        s += f"\n  union all select user_id, shop_id, {_f(0.5)} * {_tw_sql(mode)} as weight from view_log"
    return s


def _graph_ctes(mode: str = "recent") -> str:
    """ev (events), es (summed two-way edges), en (normalised edges)."""
    return f""",
ev as ({_events_sql(mode)}),
e2 as (select 'u' || user_id as src, 's' || shop_id as dst, weight from ev
       union all select 's' || shop_id as src, 'u' || user_id as dst, weight from ev),
es as (select src, dst, sum(weight) as weight from e2 group by src, dst having sum(weight) <> 0),
eo as (select src, sum(weight) as tot from es group by src),
en as (select es.src, es.dst, es.weight / eo.tot as weight from es join eo on es.src = eo.src)"""


def _subgraph_ctes(user_id: int = SEED_USER) -> str:
    return f""",
uc as (select distinct user_id, city from
        (select user_id, shop_id from pay_log union all select user_id, shop_id from view_log) x
        join shop_info on x.shop_id = shop_info.shop_id),
allowed as (select 's' || shop_id as id from shop_info where city in (select city from uc where user_id = {user_id})),
sub as (select * from en
        where (src like 'u%' or src in (select id from allowed))
          and (dst like 'u%' or dst in (select id from allowed)))"""


def _rank_ctes(edge_table: str, seed: str, weighted: bool, d: float = DAMPING, rounds: int = ROUNDS) -> str:
    if weighted:
        t = f"t as (select src, dst, weight as p from {edge_table})"
    else:
        t = (f"t as (select e.src, e.dst, 1.0 / g.deg as p from {edge_table} e join "
             f"(select src, count(*) as deg from {edge_table} group by src) g on e.src = g.src)")
    parts = [
        t,
        f"r0 as (select '{seed}' as id, {_f(1.0 - d)} as rank "
        f"where exists (select 1 from t where src = '{seed}' or dst = '{seed}'))",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"r{k} as (select id, sum(rank) as rank from ("
            f"select t.dst as id, {_f(d)} * r.rank * t.p as rank from r{k - 1} r join t on r.id = t.src "
            f"union all select id, rank from r0) x group by id)"
        )
    return ",\n" + ",\n".join(parts)


# --------------------------------------------------------------------------
# Counts, labels, shop table, features
# --------------------------------------------------------------------------

@register("pay_pair_counts", base_ctes() + f"""
select user_id, shop_id, count(*) as count from pay_log where ts < timestamp '{SPLIT}' group by user_id, shop_id""")
def q_pay_pair_counts(spark, sf):
    return FE.pair_counts(FE.before(pay_log(spark, sf), SPLIT))


@register("view_pair_counts", base_ctes() + f"""
select user_id, shop_id, count(*) as count from view_log where ts < timestamp '{SPLIT}' group by user_id, shop_id""")
def q_view_pair_counts(spark, sf):
    return FE.pair_counts(FE.before(view_log(spark, sf), SPLIT))


@register("bought_after_label", base_ctes() + f"""
select distinct user_id, shop_id, 1 as label from pay_log where ts >= timestamp '{SPLIT}'""")
def q_bought_after_label(spark, sf):
    return FE.bought_after_label(pay_log(spark, sf), SPLIT)


@register("after_buy_count", base_ctes() + f"""
select user_id, shop_id, count(*) as count from pay_log where ts >= timestamp '{SPLIT}' group by user_id, shop_id""")
def q_after_buy_count(spark, sf):
    return FE.after_buy_count(pay_log(spark, sf), SPLIT)


@register("shop_dim", base_ctes() + """
select shop_id, city, location_id, per_pay, score, comment_cnt, shop_level,
       coalesce(score, -1) as score_filled, coalesce(comment_cnt, -1) as comment_cnt_filled from shop_info""")
def q_shop_dim(spark, sf):
    s = shop_table(spark, sf)
    return s.select(
        "*",
        F.coalesce("score", F.lit(-1)).alias("score_filled"),
        F.coalesce("comment_cnt", F.lit(-1)).alias("comment_cnt_filled"),
    )


def _features_sql(task: str) -> str:
    # The source job's form: full outer joins of pay counts, labels and view counts.
    if task == "classification":
        lab = f"select distinct user_id, shop_id, 1 as v from pay_log where ts >= timestamp '{SPLIT}'"
        out = "cast(coalesce(pl.lab, 0) as integer) as bought_after"
    else:
        lab = (f"select user_id, shop_id, count(*) as v from pay_log where ts >= timestamp '{SPLIT}' "
               f"group by user_id, shop_id")
        out = "cast(coalesce(pl.lab, 0) as bigint) as after_buy_count"
    return base_ctes() + f""",
pc as (select user_id, shop_id, count(*) as n from pay_log where ts < timestamp '{SPLIT}' group by user_id, shop_id),
vc as (select user_id, shop_id, count(*) as n from view_log where ts < timestamp '{SPLIT}' group by user_id, shop_id),
lb as ({lab}),
pl as (select coalesce(pc.user_id, lb.user_id) as user_id, coalesce(pc.shop_id, lb.shop_id) as shop_id,
              coalesce(pc.n, 0) as n_pay, lb.v as lab
       from pc full outer join lb on pc.user_id = lb.user_id and pc.shop_id = lb.shop_id),
pv as (select coalesce(pl.user_id, vc.user_id) as user_id, coalesce(pl.shop_id, vc.shop_id) as shop_id,
              coalesce(pl.n_pay, 0) as num_pay, coalesce(vc.n, 0) as num_view, pl.lab
       from pl full outer join vc on pl.user_id = vc.user_id and pl.shop_id = vc.shop_id)
select pv.user_id, pv.shop_id, cast(pv.num_pay as bigint) as num_pay, cast(pv.num_view as bigint) as num_view,
       s.location_id, s.per_pay, cast(coalesce(s.score, -1) as integer) as score,
       cast(coalesce(s.comment_cnt, -1) as integer) as comment_cnt, s.shop_level,
       {out.replace('pl.lab', 'pv.lab')}
from pv join shop_info s on pv.shop_id = s.shop_id"""


@register("pair_features_cls", _features_sql("classification"))
def q_pair_features_cls(spark, sf):
    pay, view, shop = _logs(spark, sf)
    return FE.pair_features(pay, view, shop, SPLIT, "classification")


@register("pair_features_reg", _features_sql("regression"))
def q_pair_features_reg(spark, sf):
    pay, view, shop = _logs(spark, sf)
    return FE.pair_features(pay, view, shop, SPLIT, "regression")


@register("label_stats", _features_sql("regression").replace(
    "\nselect pv.user_id", "\n, feat as (select pv.user_id", 1) + """)
select cast(min(after_buy_count) as bigint) as label_min, cast(max(after_buy_count) as bigint) as label_max,
       round(avg(cast(after_buy_count as double)), 9) as label_mean,
       round(var_pop(cast(after_buy_count as double)), 9) as label_var,
       round(stddev_pop(cast(after_buy_count as double)), 9) as label_std, count(*) as n from feat""")
def q_label_stats(spark, sf):
    pay, view, shop = _logs(spark, sf)
    st = FE.label_stats(FE.pair_features(pay, view, shop, SPLIT, "regression"))
    return st.select("label_min", "label_max", *[round9(c).alias(c) for c in ["label_mean", "label_var", "label_std"]], "n")


# --------------------------------------------------------------------------
# Cities, edges, subgraph
# --------------------------------------------------------------------------

@register("user_cities", base_ctes() + """,
x as (select user_id, shop_id from pay_log union all select user_id, shop_id from view_log),
uc as (select distinct user_id, city from x join shop_info s on x.shop_id = s.shop_id)
select user_id, string_agg(city, ',' order by city) as cities, cast(count(*) as integer) as n_cities
from uc group by user_id""")
def q_user_cities(spark, sf):
    pay, view, shop = _logs(spark, sf)
    uc = G.user_cities(pay, view, shop)
    return uc.select("user_id", F.array_join("cities", ",").alias("cities"), F.size("cities").alias("n_cities"))


@register("city_shops", base_ctes() + f"""
select shop_id, city, '{CITY}' = city as in_city from shop_info
where city in ({", ".join(f"'{c}'" for c in CITIES)})""")
def q_city_shops(spark, sf):
    shop = shop_table(spark, sf)
    return G.city_shops(shop, CITIES).select("shop_id", "city", (F.col("city") == CITY).alias("in_city"))


@register("edges_decay", base_ctes() + _graph_ctes("recent") + """
select src, dst, round(weight, 9) as weight from es""")
def q_edges_decay(spark, sf):
    pay, view, _ = _logs(spark, sf)
    e = G.user_shop_edges(G.weighted_events(pay, view, START, AS_OF, "recent"))
    return e.select("src", "dst", round9("weight").alias("weight"))


@register("edges_age", base_ctes() + _graph_ctes("age") + """
select src, dst, round(weight, 9) as weight from es""")
def q_edges_age(spark, sf):
    pay, view, _ = _logs(spark, sf)
    e = G.user_shop_edges(G.weighted_events(pay, view, START, AS_OF, "age"))
    return e.select("src", "dst", round9("weight").alias("weight"))


@register("edges_normalized", base_ctes() + _graph_ctes("recent") + """
select src, dst, round(weight, 9) as weight from en""")
def q_edges_normalized(spark, sf):
    pay, view, _ = _logs(spark, sf)
    e = recommendation_graph(pay, view, START, AS_OF)
    return e.select("src", "dst", round9("weight").alias("weight"))


@register("edges_bidirectional", base_ctes() + f""",
ev as ({_events_sql()}),
es as (select user_id as src, shop_id as dst, sum(weight) as weight from ev group by user_id, shop_id
       having sum(weight) <> 0),
en as (select es.src, es.dst, es.weight / o.tot as weight from es
       join (select src, sum(weight) as tot from es group by src) o on es.src = o.src)
select src, dst, round(weight, 9) as weight, 'forward' as direction from en
union all select dst as src, src as dst, round(weight, 9) as weight, 'reverse' as direction from en""")
def q_edges_bidirectional(spark, sf):
    # User→shop edges normalised per user plus their reverse (numeric ids: the
    # bipartite clustering input).
    en = _user_shop_norm(spark, sf)
    fwd = en.select("src", "dst", round9("weight").alias("weight"), F.lit("forward").alias("direction"))
    rev = G.reverse_edges(en).select("src", "dst", round9("weight").alias("weight"), F.lit("reverse").alias("direction"))
    return fwd.unionByName(rev)


@register("edges_union", base_ctes() + f""",
pe as ({_events_sql(with_view=False)}),
ve as (select user_id, shop_id, {_f(0.5)} * {_tw_sql()} as weight from view_log),
a as (select 'u' || user_id as src, 's' || shop_id as dst, weight from pe
      union all select 's' || shop_id, 'u' || user_id, weight from pe),
b as (select 'u' || user_id as src, 's' || shop_id as dst, weight from ve
      union all select 's' || shop_id, 'u' || user_id, weight from ve),
pa as (select src, dst, sum(weight) as weight from a group by src, dst having sum(weight) <> 0),
pb as (select src, dst, sum(weight) as weight from b group by src, dst having sum(weight) <> 0),
u as (select * from pa union all select * from pb)
select src, dst, round(sum(weight), 9) as weight, cast(count(*) as bigint) as n_lists
from u group by src, dst having sum(weight) <> 0""")
def q_edges_union(spark, sf):
    # Pay edges and view edges built apart, then merged (parallel edges summed). Both lists are symmetric, so
    # one direction is merged on the bare ids; the other one and the names come last.
    pay, view, _ = _logs(spark, sf)
    pe = G.user_shop_edges(G.weighted_events(pay, None, START, AS_OF), both_directions=False, prefixed=False)
    ve = G.user_shop_edges(
        view.select("user_id", "shop_id", (F.lit(G.VIEW_WEIGHT) * G.time_weight("ts", START, AS_OF)).alias("weight")),
        both_directions=False, prefixed=False,
    )
    u = G.union_edges(pe, ve).groupBy(F.col("src").alias("user_id"), F.col("dst").alias("shop_id"))
    merged = u.agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_lists")).filter("weight != 0")
    return G.mirror_merged(merged).select("src", "dst", round9("weight").alias("weight"), "n_lists")


@register("out_degrees", base_ctes() + _graph_ctes("recent") + """,
v as (select src as id from en union select dst as id from en)
select v.id, cast(coalesce(g.n, 0) as bigint) as out_degree
from v left join (select src, count(*) as n from en group by src) g on v.id = g.src""")
def q_out_degrees(spark, sf):
    pay, view, _ = _logs(spark, sf)
    return G.out_degrees(recommendation_graph(pay, view, START, AS_OF))


@register("city_subgraph", base_ctes() + _graph_ctes("recent") + _subgraph_ctes() + """
select src, dst, round(weight, 9) as weight from sub""")
def q_city_subgraph(spark, sf):
    pay, view, shop = _logs(spark, sf)
    e = city_graph(pay, view, shop, SEED_USER, START, AS_OF)
    return e.select("src", "dst", round9("weight").alias("weight"))


# --------------------------------------------------------------------------
# Personalised rank and recommendation
# --------------------------------------------------------------------------

def _rank_query(spark, sf, weighted: bool) -> DataFrame:
    pay, view, shop = _logs(spark, sf)
    e = city_graph(pay, view, shop, SEED_USER, START, AS_OF, ids="fold")
    return named(R.personal_rank(e, 2 * SEED_USER, d=DAMPING, max_iter=ROUNDS, weighted=weighted))


def _rank_sql(weighted: bool, tail: str) -> str:
    return (base_ctes() + _graph_ctes("recent") + _subgraph_ctes()
            + _rank_ctes("sub", f"u{SEED_USER}", weighted) + "\n" + tail)


_RANK_TAIL = (f"select id, case when id like 's%' then 'shop' else 'user' end as kind, "
              f"round(rank, 9) as rank from r{ROUNDS}")
_TOP_TAIL = (f"select id, round(rank, 9) as rank from (select * from r{ROUNDS} where id like 's%' "
             f"order by rank desc, id limit {TOP_K}) best")


@register("rank_weighted", _rank_sql(True, _RANK_TAIL))
def q_rank_weighted(spark, sf):
    r = _rank_query(spark, sf, True)
    return r.select("id", "kind", round9("rank").alias("rank"))


@register("rank_unweighted", _rank_sql(False, _RANK_TAIL))
def q_rank_unweighted(spark, sf):
    r = _rank_query(spark, sf, False)
    return r.select("id", "kind", round9("rank").alias("rank"))


@register("top_shops", _rank_sql(True, _TOP_TAIL))
def q_top_shops(spark, sf):
    return R.top_shops(_rank_query(spark, sf, True), TOP_K).select("id", round9("rank").alias("rank"))


@register("top_shops_unweighted", _rank_sql(False, _TOP_TAIL))
def q_top_shops_unweighted(spark, sf):
    return R.top_shops(_rank_query(spark, sf, False), TOP_K).select("id", round9("rank").alias("rank"))


# Users served together by the many-seed query.
SEED_USERS = [7, 19, 42]


def _many_rank_sql() -> str:
    seeds = " union all ".join(f"select 'u{u}' as seed" for u in SEED_USERS)
    parts = ["t as (select src, dst, weight as p from en)",
             f"r0 as (select seed, seed as id, {_f(1.0 - DAMPING)} as rank from ({seeds}) s "
             f"where seed in (select src from t union select dst from t))"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"r{k} as (select seed, id, sum(rank) as rank from (select r.seed, t.dst as id, {_f(DAMPING)} * r.rank * t.p as rank "
                     f"from r{k - 1} r join t on r.id = t.src union all select seed, id, rank from r0) x group by seed, id)")
    return base_ctes() + _graph_ctes("recent") + ",\n" + ",\n".join(parts) + f"""
select seed, id, round(rank, 9) as rank, cast(pos as integer) as pos from (
  select *, row_number() over (partition by seed order by rank desc, id) as pos from r{ROUNDS} where id like 's%') x
where pos <= {TOP_K}"""


@register("top_shops_many", _many_rank_sql())
def q_top_shops_many(spark, sf):
    pay, view, _ = _logs(spark, sf)
    e = recommendation_graph(pay, view, START, AS_OF, ids="fold")
    seeds = spark.createDataFrame([(2 * u,) for u in SEED_USERS], "seed long")
    ranks = named(R.personal_rank_many(e, seeds, DAMPING, ROUNDS)).withColumn("seed", folded_name("seed"))
    return R.top_shops_many(ranks, TOP_K).select("seed", "id", round9("rank").alias("rank"), "pos")


# recommend_many serves every user, recommend_many_unweighted those with an id divisible by this.
USER_STEP = 100


def _recommend_many_sql(weighted: bool, served: str = "") -> str:
    parts = [f"sd as (select distinct user_id, 'u' || user_id as seed from uc{served})",
             "ok as (select distinct sd.seed, 's' || i.shop_id as id from sd join uc on uc.user_id = sd.user_id join shop_info i on i.city = uc.city)",
             "sub as (select ok.seed, en.* from en join ok on en.src = ok.id or en.dst = ok.id)",
             "p as (select seed, src, dst, weight as p from sub)" if weighted else
             "p as (select seed, src, dst, 1.0 / count(*) over (partition by seed, src) as p from sub)",
             f"r0 as (select seed, seed as id, {_f(1.0 - DAMPING)} as rank from sd)"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"r{k} as (select seed, id, sum(rank) as rank from (select p.seed, p.dst as id, {_f(DAMPING)} * r.rank * p.p as rank "
                     f"from r{k - 1} r join p on r.id = p.src and r.seed = p.seed union all select seed, id, rank from r0) x group by seed, id)")
    uc = ("uc as (select distinct user_id, city from (select user_id, shop_id from pay_log union all select user_id, shop_id from view_log) x "
          "join shop_info on x.shop_id = shop_info.shop_id)")
    return base_ctes() + _graph_ctes("recent") + ",\n" + ",\n".join([uc, *parts]) + f"""
select cast(substr(seed, 2) as bigint) as user_id, id, round(rank, 9) as rank, cast(pos as integer) as pos from (
  select *, row_number() over (partition by seed order by rank desc, id) as pos from r{ROUNDS} where id like 's%') x
where pos <= {TOP_K}"""


def _recommend_many(spark, sf, weighted: bool, step: int | None = None) -> DataFrame:
    from shopweave.plans.recommend import recommend_many

    pay, view, shop = _logs(spark, sf)
    served = F.col("user_id").isNotNull() if step is None else F.col("user_id") % step == 0
    users = pay.select("user_id").unionByName(view.select("user_id")).filter(served).distinct()
    best = recommend_many(pay, view, shop, users, START, AS_OF, TOP_K, DAMPING, ROUNDS, weighted)
    return best.select("user_id", "id", round9("rank").alias("rank"), "pos")


@register("recommend_many", _recommend_many_sql(True))
def q_recommend_many(spark, sf):
    return _recommend_many(spark, sf, True)


@register("recommend_many_unweighted", _recommend_many_sql(False, f" where user_id % {USER_STEP} = 0"))
def q_recommend_many_unweighted(spark, sf):
    return _recommend_many(spark, sf, False, USER_STEP)


# Ranks to a stated accuracy, for many users on the whole graph.
PUSH_STEP = 15
PUSH_EPS = 1e-8
PUSH_ROUNDS = 6


def _push_sql() -> str:
    parts = ["dg as (select src as id, count(*) as n from en group by src)",
             f"s0 as (select distinct src as seed, src as id, 0.0::double as est, {_f(1.0 - DAMPING)} as res from en where src like 'u%' and cast(substr(src, 2) as bigint) % {PUSH_STEP} = 0)"]
    for k in range(1, PUSH_ROUNDS + 1):
        parts.append(f"p{k} as (select s.seed, s.id, s.res from s{k - 1} s left join dg on dg.id = s.id where s.res > {PUSH_EPS} * greatest(coalesce(dg.n, 0), 1))")
        parts.append(f"s{k} as (select seed, id, sum(est) as est, sum(res) as res from (select * from s{k - 1} union all select seed, id, res, -res from p{k} "
                     f"union all select p.seed, en.dst, 0.0, {_f(DAMPING)} * p.res * en.weight from p{k} p join en on en.src = p.id) x group by seed, id)")
    return base_ctes() + _graph_ctes("recent") + ",\n" + ",\n".join(parts) + f"""
select cast(substr(seed, 2) as bigint) as user_id, id, round(est, 9) as rank, round(res, 9) as residual from s{PUSH_ROUNDS} where est > 0"""


@register("push_rank_many", _push_sql())
def q_push_rank_many(spark, sf):
    pay, view, _ = _logs(spark, sf)
    e = recommendation_graph(pay, view, START, AS_OF, ids="fold")
    seeds = pay.select("user_id").unionByName(view.select("user_id")).filter(F.col("user_id") % PUSH_STEP == 0).distinct().select(G.fold_user("user_id").alias("seed"))
    ranks, _ = R.push_rank_many(e, seeds, PUSH_EPS, DAMPING, max_rounds=PUSH_ROUNDS)
    return named(ranks).select(F.floor(F.col("seed") / 2).cast("long").alias("user_id"), "id", round9("rank").alias("rank"), round9("residual").alias("residual"))


# The same results by vertex programs over triplets.

@register("pregel_normalized", base_ctes() + _graph_ctes("recent") + """
select src, dst, round(weight, 9) as weight from en""")
def q_pregel_normalized(spark, sf):
    from shopweave.operators.pregel import out_weight_normalized

    pay, view, _ = _logs(spark, sf)
    e = out_weight_normalized(G.mirror(G.pair_weights(G.weighted_events(pay, view, START, AS_OF)), "weight", "weight", "fold"))
    return e.select(folded_name("src").alias("src"), folded_name("dst").alias("dst"), round9("weight").alias("weight"))


def _rank_by_program(spark, sf, weighted: bool) -> DataFrame:
    from shopweave.operators.pregel import rank_program

    pay, view, shop = _logs(spark, sf)
    e = stored(city_graph(pay, view, shop, SEED_USER, START, AS_OF, ids="fold"), "edges")
    r = rank_program(e, 2 * SEED_USER, DAMPING, ROUNDS, weighted).filter("rank > 0")
    return r.select(folded_name("id").alias("id"), R.kind_of(r).alias("kind"), round9("rank").alias("rank"))


@register("pregel_rank", _rank_sql(True, _RANK_TAIL))
def q_pregel_rank(spark, sf):
    return _rank_by_program(spark, sf, True)


@register("pregel_rank_unweighted", _rank_sql(False, _RANK_TAIL))
def q_pregel_rank_unweighted(spark, sf):
    return _rank_by_program(spark, sf, False)


@register("recommend_age_unseen", base_ctes() + _graph_ctes("age") + _subgraph_ctes() + _rank_ctes("sub", f"u{SEED_USER}", True) + f""",
seen as (select 's' || shop_id as id from (select user_id, shop_id from pay_log union all select user_id, shop_id from view_log) x
         where user_id = {SEED_USER})
select id, round(rank, 9) as rank from (select * from r{ROUNDS} where id like 's%' and id not in (select id from seen)
  order by rank desc, id limit {TOP_K}) best""")
def q_recommend_age_unseen(spark, sf):
    pay, view, shop = _logs(spark, sf)
    best = recommend_shops(pay, view, shop, SEED_USER, START, AS_OF, TOP_K, DAMPING, ROUNDS, exclude_seen=True, mode="age")
    return best.select("id", round9("rank").alias("rank"))


# --------------------------------------------------------------------------
# Hub similarity, clusters, cut weight, shortest paths, silhouette
# --------------------------------------------------------------------------

def _sim_ctes(city: str | None = None) -> str:
    filt = ""
    if city is not None:
        filt = f" where shop_id in (select shop_id from shop_info where city = '{city}')"
    return f""",
pf as (select * from pay_log{filt}),
vf as (select * from view_log{filt}),
ev as (select user_id, shop_id, {_f(1.0)} * {_tw_sql()} as weight from pf
       union all select user_id, shop_id, {_f(0.5)} * {_tw_sql()} as weight from vf),
us as (select user_id as src, shop_id as dst, sum(weight) as weight from ev group by user_id, shop_id
       having sum(weight) <> 0),
un as (select us.src, us.dst, us.weight / o.tot as weight from us
       join (select src, sum(weight) as tot from us group by src) o on us.src = o.src),
hub as (select shop_id, hub, hub_weight from (
          select dst as shop_id, src as hub, weight as hub_weight,
                 row_number() over (partition by dst order by weight desc, src) as rn from un) h where rn = 1),
star as (select u.src as usr, h.hub, u.weight * h.hub_weight as w, u.dst as via_shop
         from un u join hub h on u.dst = h.shop_id),
sim as (select usr as src, hub as dst, w as weight, via_shop from star where usr <> hub
        union all select hub as src, usr as dst, w as weight, via_shop from star where usr <> hub)"""


def _sim_norm_ctes() -> str:
    """simn: similarity edges normalised per source; cl: home-city clusters."""
    return _sim_ctes() + """,
simn as (select s.src, s.dst, s.weight / o.tot as weight from sim s
         join (select src, sum(weight) as tot from sim group by src) o on s.src = o.src),
cl as (select id, cast(location_id as integer) as cluster from (
         select src as id, dst as shop_id, row_number() over (partition by src order by weight desc, dst) as rn
         from un) t join shop_info s on t.shop_id = s.shop_id where rn = 1)"""


def _similarity(spark, sf, city=None) -> DataFrame:
    from shopweave.operators.similarity import similarity_graph

    pay, view, shop = _logs(spark, sf)
    return similarity_graph(pay, view, shop, START, AS_OF, city=city)


def _graph_and_clusters(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Normalised similarity edges and home clusters, both from one stored user-shop table."""
    from shopweave.operators.clusters import home_city_clusters
    from shopweave.operators.similarity import hub_similarity

    user_shop = _user_shop_norm(spark, sf)
    sim = stored(hub_similarity(user_shop).select("src", "dst", "weight"), "similarity")
    return stored(G.normalize_out_weights(sim), "similarity-norm"), stored(home_city_clusters(user_shop, shop_table(spark, sf)), "clusters")


def _user_shop_norm(spark, sf) -> DataFrame:
    from shopweave.operators.similarity import normalized_user_shop

    pay, view, _ = _logs(spark, sf)
    return normalized_user_shop(pay, view, START, AS_OF)


def _sim_normalized(spark, sf) -> DataFrame:
    return G.normalize_out_weights(stored(_similarity(spark, sf).select("src", "dst", "weight"), "similarity"))


def _home_clusters(spark, sf) -> DataFrame:
    from shopweave.operators.clusters import home_city_clusters

    return home_city_clusters(_user_shop_norm(spark, sf), shop_table(spark, sf))


@register("shop_hub", base_ctes() + _sim_ctes() + """
select shop_id, hub, round(hub_weight, 9) as hub_weight from hub""")
def q_shop_hub(spark, sf):
    from shopweave.operators.similarity import shop_hubs

    h = shop_hubs(_user_shop_norm(spark, sf))
    return h.select("shop_id", "hub", round9("hub_weight").alias("hub_weight"))


@register("hub_similarity", base_ctes() + _sim_ctes() + """
select src, dst, round(weight, 9) as weight, via_shop from sim""")
def q_hub_similarity(spark, sf):
    s = _similarity(spark, sf)
    return s.select("src", "dst", round9("weight").alias("weight"), "via_shop")


@register("city_similarity", base_ctes() + _sim_ctes(CITY) + """
select src, dst, round(weight, 9) as weight, via_shop from sim""")
def q_city_similarity(spark, sf):
    s = _similarity(spark, sf, city=CITY)
    return s.select("src", "dst", round9("weight").alias("weight"), "via_shop")


@register("similarity_pairs", base_ctes() + _sim_ctes() + """
select least(src, dst) as src, greatest(src, dst) as dst, round(sum(weight), 9) as weight
from sim group by least(src, dst), greatest(src, dst)""")
def q_similarity_pairs(spark, sf):
    from shopweave.operators.similarity import symmetric_pairs

    p = symmetric_pairs(_similarity(spark, sf))
    return p.select("src", "dst", round9("weight").alias("weight"))


@register("home_clusters", base_ctes() + _sim_norm_ctes() + """
select id, cluster from cl""")
def q_home_clusters(spark, sf):
    return _home_clusters(spark, sf)


@register("cut_weight", base_ctes() + _sim_norm_ctes() + """,
lab as (select e.weight, coalesce(a.cluster, 0) as cs, coalesce(b.cluster, 0) as cd
        from simn e left join cl a on e.src = a.id left join cl b on e.dst = b.id)
select round(sum(case when cs <> cd then weight else 0.0 end), 6) as cut_weight,
       round(sum(weight), 6) as total_weight,
       cast(sum(case when cs <> cd then 1 else 0 end) as bigint) as cut_edges, count(*) as edges from lab""")
def q_cut_weight(spark, sf):
    from shopweave.operators.clusters import cut_weight

    c = cut_weight(*_graph_and_clusters(spark, sf))
    return c.select(round6("cut_weight").alias("cut_weight"), round6("total_weight").alias("total_weight"),
                    "cut_edges", "edges")


@register("cut_weight_written", _SQL["cut_weight"])
def q_cut_weight_written(spark, sf):
    # The same sums, from the labelled edges as written.
    from shopweave.operators.clusters import write_labelled_edges

    c = write_labelled_edges(*_graph_and_clusters(spark, sf), _folder(spark, "labelled"))
    return c.select(round6("cut_weight").alias("cut_weight"), round6("total_weight").alias("total_weight"), "cut_edges", "edges")


SSSP_SQL_ROUNDS = 16


def _sssp_ctes(sources_sql: str, rounds: int = SSSP_SQL_ROUNDS) -> str:
    parts = [
        "de as (select src, dst, 1.0 / weight as w from simn)",
        f"d0 as (select source, source as id, 0.0 as dist from ({sources_sql}) s)",
    ]
    for k in range(1, rounds + 1):
        parts.append(
            f"d{k} as (select source, id, min(dist) as dist from ("
            f"select source, id, dist from d{k - 1} union all "
            f"select d.source, de.dst as id, d.dist + de.w as dist from d{k - 1} d join de on d.id = de.src"
            f") x group by source, id)"
        )
    return ",\n" + ",\n".join(parts)


# Path and silhouette queries ask for draws from every cluster (DRAWS each), for a sample of all members, or for six users by name.
SAMPLE_USERS = [7, 19, 42, 77, 101, 128]
DRAWS = 3
MEMBER_FRACTION = 0.05


def _samples_sql(draws: int = DRAWS) -> str:
    parts = []
    for j in range(draws):
        key = f"cast(('0x' || substr(md5(cast(id as varchar) || '|{j}'), 1, 8)) as bigint)"
        parts.append(f"select id, cluster from (select id, cluster, row_number() over "
                     f"(partition by cluster order by {key}, id) as rn from cl) t{j} where rn = 1")
    return ",\nsamp as (select distinct id, cluster from (" + " union all ".join(parts) + ") s)"


_SEED_SOURCES = f"select cast({SEED_USER} as bigint) as source"
_USER_SOURCES = " union all ".join(f"select cast({u} as bigint) as source" for u in SAMPLE_USERS)
_IN_SAMPLE = f"cast(('0x' || substr(md5(cast(id as varchar) || '|member'), 1, 8)) as bigint) / 4294967296.0 < {MEMBER_FRACTION}"
_SAMPLE_SOURCES = f"select id as source from cl where {_IN_SAMPLE}"


def _sources(spark, users: list[int], name: str = "source") -> DataFrame:
    return spark.createDataFrame([(u,) for u in users], f"{name} long")


@register("sssp", base_ctes() + _sim_norm_ctes() + _sssp_ctes(_SEED_SOURCES) + f"""
select source, id, round(dist, 6) as dist from d{SSSP_SQL_ROUNDS}""")
def q_sssp(spark, sf):
    from shopweave.operators.clusters import shortest_paths, to_distances

    sim = stored(_similarity(spark, sf).select("src", "dst", "weight"), "similarity")
    d = shortest_paths(to_distances(G.normalize_out_weights(sim)), _sources(spark, [SEED_USER]), spent=[sim])
    return d.select("source", "id", round6("dist").alias("dist"))


@register("pregel_paths", base_ctes() + _sim_norm_ctes() + _sssp_ctes(_SEED_SOURCES) + f"""
select id, round(dist, 6) as dist from d{SSSP_SQL_ROUNDS}""")
def q_pregel_paths(spark, sf):
    from shopweave.operators.clusters import to_distances
    from shopweave.operators.pregel import path_program

    d = path_program(to_distances(_sim_normalized(spark, sf)), SEED_USER)
    return d.select("id", round6("dist").alias("dist"))


@register("cluster_samples", base_ctes() + _sim_norm_ctes() + _samples_sql() + """
select id, cluster from samp""")
def q_cluster_samples(spark, sf):
    from shopweave.operators.clusters import cluster_samples

    return cluster_samples(_home_clusters(spark, sf), DRAWS)


@register("member_sample", base_ctes() + _sim_norm_ctes() + f"""
select id, cluster from cl where {_IN_SAMPLE}""")
def q_member_sample(spark, sf):
    from shopweave.operators.clusters import sample_members

    return sample_members(_home_clusters(spark, sf), MEMBER_FRACTION, "member")


def _poisson_sql(rate: float, salt: str) -> str:
    from shopweave.operators.clusters import poisson_steps

    u = f"cast(('0x' || substr(md5(cast(id as varchar) || '|{salt}'), 1, 8)) as bigint) / 4294967296.0"
    return " + ".join(f"case when {u} >= {_f(step)} then 1 else 0 end" for step in poisson_steps(rate))


@register("bootstrap_sample", base_ctes() + _sim_norm_ctes() + f""",
n as (select id, cluster, {_poisson_sql(1.0, "boot")} as times from cl)
select id, cluster, cast(unnest(range(1, times + 1)) as integer) as copy from n""")
def q_bootstrap_sample(spark, sf):
    # As many draws as members, with replacement.
    from shopweave.operators.clusters import bootstrap_sample

    return bootstrap_sample(_home_clusters(spark, sf), 1.0, "boot")


@register("member_sample_replaced", base_ctes() + _sim_norm_ctes() + f""",
n as (select id, cluster, {_poisson_sql(MEMBER_FRACTION, "member")} as times from cl)
select id, cluster, cast(unnest(range(1, times + 1)) as integer) as copy from n""")
def q_member_sample_replaced(spark, sf):
    from shopweave.operators.clusters import bootstrap_sample

    return bootstrap_sample(_home_clusters(spark, sf), MEMBER_FRACTION, "member")


def _summary_sql(sources: str, ctes: str = "") -> str:
    return base_ctes() + _sim_norm_ctes() + ctes + _sssp_ctes(sources) + f"""
select d.source, cl.cluster, count(*) as reached, round(min(dist), 6) as nearest, round(max(dist), 6) as farthest,
       round(sum(dist), 6) as total
from d{SSSP_SQL_ROUNDS} d join cl on d.id = cl.id group by d.source, cl.cluster"""


def _rounded_summary(per: DataFrame) -> DataFrame:
    return per.select("source", "cluster", "reached", *[round6(c).alias(c) for c in ("nearest", "farthest", "total")])


def _draw_sources(clusters: DataFrame, name: str) -> DataFrame:
    from shopweave.operators.clusters import cluster_samples

    return cluster_samples(clusters, DRAWS).select(F.col("id").alias(name))


def _member_sources(clusters: DataFrame, name: str) -> DataFrame:
    from shopweave.operators.clusters import sample_members

    return sample_members(clusters, MEMBER_FRACTION, "member").select(F.col("id").alias(name))


def _path_summary(spark, sf, sources) -> DataFrame:
    from shopweave.operators.clusters import path_summary, to_distances

    sim, clusters = _graph_and_clusters(spark, sf)
    return _rounded_summary(path_summary(to_distances(sim), sources(clusters, "source"), clusters))


@register("sssp_many", _summary_sql("select id as source from samp", _samples_sql()))
def q_sssp_many(spark, sf):
    return _path_summary(spark, sf, _draw_sources)


@register("sssp_sample", _summary_sql(_SAMPLE_SOURCES))
def q_sssp_sample(spark, sf):
    return _path_summary(spark, sf, _member_sources)


@register("sssp_users", _summary_sql(_USER_SOURCES))
def q_sssp_users(spark, sf):
    from shopweave.operators.clusters import distance_summary, shortest_paths, to_distances

    sim, clusters = _graph_and_clusters(spark, sf)
    return _rounded_summary(distance_summary(shortest_paths(to_distances(sim), _sources(spark, SAMPLE_USERS)), clusters))


def _silhouette_sql(sources: str, ctes: str = "") -> str:
    return base_ctes() + _sim_norm_ctes() + ctes + f""",
mem as (select id, cluster from cl union all
        select id, 0 from (select src as id from simn union select dst from simn) v where id not in (select id from cl)),
own as (select mem.id as source, mem.cluster as own from mem where id in ({sources}))""" + _sssp_ctes(
    "select source from own") + f""",
sizes as (select cluster, count(*) as size from mem group by cluster),
reach as (select d.source, m.cluster, sum(d.dist) as total, count(*) as reached
          from d{SSSP_SQL_ROUNDS} d join mem m on d.id = m.id group by d.source, m.cluster),
per as (select r.source, r.cluster, case when r.reached < s.size then 'infinity'::double else r.total / s.size end as mean
        from reach r join sizes s on r.cluster = s.cluster),
ab as (select o.source, o.own, max(case when p.cluster = o.own then p.mean end) as a,
              coalesce(min(case when p.cluster <> o.own then p.mean end), 'infinity'::double) as b
       from own o join per p on p.source = o.source group by o.source, o.own),
sil as (select source as id, own as cluster, a, b,
               case when greatest(a, b) = 0 then 'nan'::double else (b - a) / greatest(a, b) end as coefficient from ab)"""


_SILHOUETTE_TAIL = """
select id, cluster, round(a, 6) as a, round(b, 6) as b, round(coefficient, 9) as coefficient from sil"""
_MEAN_TAIL = """
select round(avg(coefficient), 9) as silhouette, count(*) as samples from sil"""
_DRAWN = _silhouette_sql("select id as source from samp", _samples_sql())


def _silhouettes(spark, sf, sources) -> DataFrame:
    from shopweave.operators.clusters import silhouette

    sim, clusters = _graph_and_clusters(spark, sf)
    return silhouette(sim, clusters, sources(clusters, "id"), unreachable="inf")


def _each_silhouette(spark, sf, sources) -> DataFrame:
    s = _silhouettes(spark, sf, sources)
    return s.select("id", "cluster", round6("a").alias("a"), round6("b").alias("b"), round9("coefficient").alias("coefficient"))


def _mean_of(spark, sf, sources) -> DataFrame:
    from shopweave.operators.clusters import mean_silhouette

    return mean_silhouette(_silhouettes(spark, sf, sources)).select(round9("silhouette").alias("silhouette"), "samples")


@register("silhouette", _DRAWN + _SILHOUETTE_TAIL)
def q_silhouette(spark, sf):
    return _each_silhouette(spark, sf, _draw_sources)


@register("mean_silhouette", _DRAWN + _MEAN_TAIL)
def q_mean_silhouette(spark, sf):
    return _mean_of(spark, sf, _draw_sources)


@register("silhouette_sample", _silhouette_sql(_SAMPLE_SOURCES) + _SILHOUETTE_TAIL)
def q_silhouette_sample(spark, sf):
    return _each_silhouette(spark, sf, _member_sources)


@register("mean_silhouette_sample", _silhouette_sql(_SAMPLE_SOURCES) + _MEAN_TAIL)
def q_mean_silhouette_sample(spark, sf):
    return _mean_of(spark, sf, _member_sources)


# --------------------------------------------------------------------------
# Models, metrics, splits (baseline predictor num_pay has exact SQL oracles)
# --------------------------------------------------------------------------

def _feat_cte(task: str) -> str:
    return _features_sql(task).replace("\nselect pv.user_id", "\n, feat as (select pv.user_id", 1) + ")"


def _features(spark, sf, task: str) -> DataFrame:
    pay, view, shop = _logs(spark, sf)
    return FE.pair_features(pay, view, shop, SPLIT, task)


@register("residuals", _feat_cte("regression") + """
select user_id, shop_id, cast(num_pay as double) as prediction, cast(after_buy_count as double) as label,
       cast(num_pay as double) - cast(after_buy_count as double) as residual from feat""")
def q_residuals(spark, sf):
    from shopweave.operators.models import residuals

    f = _features(spark, sf, "regression").select(
        "user_id", "shop_id", F.col("num_pay").cast("double").alias("prediction"),
        F.col("after_buy_count").cast("double").alias("label"))
    return residuals(f, "prediction", "label")


@register("rmse_simple", _feat_cte("regression") + """
select round(sqrt(avg((cast(num_pay as double) - cast(after_buy_count as double))
                    * (cast(num_pay as double) - cast(after_buy_count as double)))), 9) as rmse, count(*) as n from feat""")
def q_rmse_simple(spark, sf):
    from shopweave.operators.models import rmse

    r = rmse(_features(spark, sf, "regression"), "num_pay", "after_buy_count")
    return r.select(round9("rmse").alias("rmse"), "n")


@register("auc_simple", _feat_cte("classification") + """,
g as (select num_pay as s, sum(case when bought_after = 1 then 1 else 0 end) as pos,
             sum(case when bought_after = 1 then 0 else 1 end) as neg from feat group by num_pay),
c as (select s, pos, neg,
             coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as neg_below
      from g)
select round(sum(pos * (neg_below + neg * 0.5)) / (cast(sum(pos) as double) * cast(sum(neg) as double)), 9) as auc,
       cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from c""")
def q_auc_simple(spark, sf):
    from shopweave.operators.models import auc

    a = auc(_features(spark, sf, "classification"), "num_pay", "bought_after")
    return a.select(round9("auc").alias("auc"), "positives", "negatives")


@register("hash_split", _feat_cte("classification") + """
select user_id, shop_id,
       cast(cast(('0x' || substr(md5(concat_ws('|', user_id, shop_id)), 1, 8)) as bigint) % 100 as integer) as bucket,
       cast(('0x' || substr(md5(concat_ws('|', user_id, shop_id)), 1, 8)) as bigint) % 100 < 80 as is_train
from feat""")
def q_hash_split(spark, sf):
    from shopweave.operators.models import hash_split

    f = _features(spark, sf, "classification").select("user_id", "shop_id")
    return hash_split(f, ["user_id", "shop_id"])




# Held-out rows (20 %), and of those the rows that the stacked models hold out in turn.
_HELD = f"{_bucket_sql()} >= 80"
_STACK_HELD = f"{_HELD} and {_bucket_sql(salt='stack')} >= 80"


@register("sample_split", _feat_cte("regression") + f"""
select *, case when {_HELD} then 'test' else 'train' end as part from feat where {_bucket_sql(1000, 'fit')} < 200""")
def q_sample_split(spark, sf):
    from shopweave.operators.models import KEYS, sample_split

    train, test = sample_split(_features(spark, sf, "regression"), KEYS)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register("label_index", _feat_cte("regression") + """,
c as (select cast(after_buy_count as varchar) as label, count(*) as n from feat group by 1)
select label, cast(row_number() over (order by n desc, label) - 1 as double) as label_index, n from c""")
def q_label_index(spark, sf):
    from shopweave.operators.models import index_labels

    rows = index_labels(_features(spark, sf, "regression").select("after_buy_count"), "after_buy_count")
    return rows.groupBy(F.col("after_buy_count").cast("string").alias("label"), "label_index").agg(F.count(F.lit(1)).alias("n"))


# Trained models have no SQL form. What SQL does say is checked: which rows are held out,
# their labels and counts, and that the library's metrics agree with the evaluators.

@register("rf_class_predictions", _feat_cte("classification") + f"""
select user_id, shop_id, cast(bought_after as double) as label, true as valid from feat where {_HELD}""")
def q_rf_class_predictions(spark, sf):
    from shopweave.operators.models import classifier_predictions

    pred = classifier_predictions(_features(spark, sf, "classification"))
    valid = F.col("p_buy").between(0, 1) & ((F.col("p_buy") > 0.5) == (F.col("prediction") == 1.0))
    return pred.select("user_id", "shop_id", "label", valid.alias("valid"))


@register("rf_class_auc", _feat_cte("classification") + f"""
select count(*) as n, cast(sum(bought_after) as bigint) as positives, true as auc_agrees, true as better_than_chance
from feat where {_HELD}""")
def q_rf_class_auc(spark, sf):
    from shopweave.operators.models import auc, classifier_predictions, roc_auc_evaluator

    pred = stored(classifier_predictions(_features(spark, sf, "classification")), "predictions")
    value = roc_auc_evaluator(pred)
    own = auc(pred, "p_buy", "label")
    return own.select(
        (F.col("positives") + F.col("negatives")).alias("n"), "positives",
        (F.abs(F.col("auc") - F.lit(value)) < 1e-9).alias("auc_agrees"), (F.col("auc") > 0.5).alias("better_than_chance"),
    )


def _regression(spark, sf) -> DataFrame:
    from shopweave.operators.models import regression_predictions

    return regression_predictions(_features(spark, sf, "regression"))


def _finite(name: str):
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))


@register("reg_predictions", _feat_cte("regression") + f"""
select user_id, shop_id, cast(after_buy_count as double) as label, true as rf_finite, true as gbt_finite from feat where {_HELD}""")
def q_reg_predictions(spark, sf):
    p = _regression(spark, sf)
    return p.select("user_id", "shop_id", "label", _finite("rf_prediction").alias("rf_finite"), _finite("gbt_prediction").alias("gbt_finite"))


@register("model_residuals", _feat_cte("regression") + f"""
select user_id, shop_id, cast(after_buy_count as double) as label, true as rf_residual, true as gbt_residual from feat where {_HELD}""")
def q_model_residuals(spark, sf):
    # Two models' predictions side by side, each with its residual.
    from shopweave.operators.models import join_predictions, residuals

    p = _regression(spark, sf)
    a = residuals(p.select("user_id", "shop_id", "label", "rf_prediction"), "rf_prediction", "label", "rf_res")
    b = residuals(p.select("user_id", "shop_id", F.col("label").alias("gbt_label"), "gbt_prediction"), "gbt_prediction", "gbt_label", "gbt_res")
    j = join_predictions(a, b)
    return j.select(
        "user_id", "shop_id", "label",
        (F.abs(F.col("rf_prediction") - F.col("rf_res") - F.col("label")) < 1e-9).alias("rf_residual"),
        (F.abs(F.col("gbt_prediction") - F.col("gbt_res") - F.col("gbt_label")) < 1e-9).alias("gbt_residual"),
    )


def _rmse_row(pred: DataFrame, model: str, prediction: str) -> DataFrame:
    from shopweave.operators.models import rmse, rmse_evaluator

    pred = stored(pred.select("label", prediction), "scored")
    value = rmse_evaluator(pred, prediction)
    agrees = F.abs(F.col("rmse") - F.lit(value)) < 1e-9
    spread = pred.agg(F.stddev_pop("label").alias("std"), F.avg("label").alias("mean"))
    row = rmse(pred, prediction, "label").join(F.broadcast(spread))  # a row each
    return row.select(F.lit(model).alias("model"), "n", agrees.alias("rmse_agrees"), round9("mean").alias("label_mean"), round9("std").alias("label_std"), (F.col("rmse") < F.col("std")).alias("beats_mean"))


_SPREAD = "round(avg(cast(after_buy_count as double)), 9) as label_mean, round(stddev_pop(cast(after_buy_count as double)), 9) as label_std, true as beats_mean"


@register("reg_rmse", _feat_cte("regression") + f"""
select model, count(*) as n, true as rmse_agrees, {_SPREAD} from feat, (values ('rf'), ('gbt')) m(model) where {_HELD} group by model""")
def q_reg_rmse(spark, sf):
    p = _regression(spark, sf)
    return _rmse_row(p, "rf", "rf_prediction").unionByName(_rmse_row(p, "gbt", "gbt_prediction"))


@register("stack_lr_rmse", _feat_cte("regression") + f"""
select 'lr_stack' as model, count(*) as n, true as rmse_agrees, {_SPREAD.replace(", true as beats_mean", "")} from feat where {_STACK_HELD}""")
def q_stack_lr_rmse(spark, sf):
    from shopweave.operators.models import stack_logistic

    p = stored(stack_logistic(_regression(spark, sf)).select("label", "lr_prediction"), "stack")
    return _rmse_row(p, "lr_stack", "lr_prediction").drop("beats_mean")  # its penalty leaves the most frequent count, which needn't


@register("stack_gbt_rmse", _feat_cte("regression") + f"""
select 'gbt_stack' as model, count(*) as n, true as rmse_agrees, {_SPREAD} from feat where {_STACK_HELD}""")
def q_stack_gbt_rmse(spark, sf):
    from shopweave.operators.models import stack_gbt

    p = stored(stack_gbt(_regression(spark, sf)).select("label", "gbt2_prediction"), "stack")
    return _rmse_row(p, "gbt_stack", "gbt2_prediction")


# --------------------------------------------------------------------------
# Power iteration clustering: which cluster a vertex gets has no SQL form; that every
# vertex of the graph has one label in range, and what the cut is a part of, has.
# --------------------------------------------------------------------------

PIC_K = 4


def _pic(sim: DataFrame) -> DataFrame:
    from shopweave.operators.clusters import power_iteration_clusters
    from shopweave.operators.similarity import symmetric_pairs

    return stored(power_iteration_clusters(symmetric_pairs(sim), PIC_K), "pic")


@register("pic_clusters", base_ctes() + _sim_ctes() + """
select id, cast(1 as bigint) as labels, true as in_range from (select src as id from sim union select dst from sim) v""")
def q_pic_clusters(spark, sf):
    from shopweave.operators.clusters import label_check

    return label_check(_pic(_similarity(spark, sf)), PIC_K)


@register("pic_cut_weight", base_ctes() + _sim_norm_ctes() + """
select round(sum(weight), 6) as total_weight, count(*) as edges, true as cut_is_part from simn""")
def q_pic_cut_weight(spark, sf):
    from shopweave.operators.clusters import cut_weight

    sim = stored(_similarity(spark, sf).select("src", "dst", "weight"), "similarity")
    c = cut_weight(stored(G.normalize_out_weights(sim), "similarity-norm"), _pic(sim))
    part = (F.col("cut_weight") >= 0) & (F.col("cut_weight") <= F.col("total_weight") + 1e-9)
    return c.select(round6("total_weight").alias("total_weight"), "edges", part.alias("cut_is_part"))


@register("pic_bipartite", base_ctes() + _sim_ctes() + """
select 'user' as kind, src as id, cast(1 as bigint) as labels, true as in_range from un group by src
union all select 'shop', dst, cast(1 as bigint), true from un group by dst""")
def q_pic_bipartite(spark, sf):
    # Users and shops clustered together on the normalised user→shop graph and
    # its reverse; both id spaces are folded into one (user 2i, shop 2i+1).
    from shopweave.functions.core import fold_shop, fold_user, folded_kind
    from shopweave.operators.clusters import label_check

    us = _user_shop_norm(spark, sf)
    folded = us.select(fold_user("src").alias("src"), fold_shop("dst").alias("dst"), "weight")
    labels = label_check(_pic(G.bidirectional(folded)), PIC_K)
    return labels.select(folded_kind("id").alias("kind"), F.floor(F.col("id") / 2).cast("long").alias("id"), "labels", "in_range")


# The library's own form starts from a number of each id, so SQL says every value of it.
PIC_ROUNDS = 10


def _power_ctes() -> str:
    parts = ["""sp as (select least(src, dst) as a, greatest(src, dst) as b, sum(weight) as weight from sim group by 1, 2),
af as (select src, dst, sum(weight) as weight from (select a as src, b as dst, weight from sp union all select b, a, weight from sp) x where src <> dst group by 1, 2),
sh as (select af.src, af.dst, af.weight / o.tot as w from af join (select src, sum(weight) as tot from af group by src) o on af.src = o.src),
v0 as (select id, v / sum(v) over () as v from (select distinct src as id, cast(('0x' || substr(md5(cast(src as varchar) || '|pic'), 1, 8)) as bigint) / 4294967296.0 as v from af) x)"""]
    for k in range(1, PIC_ROUNDS + 1):
        parts.append(f"v{k} as (select id, u / sum(abs(u)) over () as v from (select sh.src as id, sum(sh.w * v.v) as u from sh join v{k - 1} v on v.id = sh.dst group by sh.src) x)")
    parts.append(f"em as (select id, v * count(*) over () as x from v{PIC_ROUNDS})")
    return ",\n" + ",\n".join(parts)


def _line_ctes(k: int) -> str:
    from shopweave.operators.power_iteration import KMEANS_ROUNDS

    parts = ["f1 as (select min(x) as c from em)"]
    for j in range(2, k + 1):
        parts.append(f"f{j} as (select c from f{j - 1} union all select x as c from (select x, (select min(abs(em.x - c)) from f{j - 1}) as gap from em order by gap desc, x limit 1) y where gap > 0)")
    parts.append(f"c0 as (select row_number() over (order by c) - 1 as j, c from f{k})")
    for r in range(1, KMEANS_ROUNDS + 1):
        parts.append(f"a{r} as (select id, any_value(x) as x, arg_min(j, (abs(x - c), j)) as j from em, c{r - 1} group by id)")
        parts.append(f"c{r} as (select row_number() over (order by m) - 1 as j, m as c from (select avg(x) as m from a{r} group by j) z)")
    parts.append(f"lb as (select id, arg_min(j, (abs(x - c), j)) as j from em, c{KMEANS_ROUNDS} group by id)")
    return ",\n" + ",\n".join(parts)


def _power_pairs(spark, sf) -> DataFrame:
    from shopweave.operators.similarity import symmetric_pairs

    return symmetric_pairs(_similarity(spark, sf))


@register("pic_embedding", base_ctes() + _sim_ctes() + _power_ctes() + """
select id, round(x, 9) as x from em""")
def q_pic_embedding(spark, sf):
    from shopweave.operators.power_iteration import embedding

    return embedding(_power_pairs(spark, sf), PIC_ROUNDS).select("id", round9("x").alias("x"))


@register("pic_labels", base_ctes() + _sim_ctes() + _power_ctes() + _line_ctes(PIC_K) + """
select id, cast(j as integer) as cluster from lb""")
def q_pic_labels(spark, sf):
    from shopweave.operators.power_iteration import power_clusters

    return power_clusters(_power_pairs(spark, sf), PIC_K, PIC_ROUNDS)


# --------------------------------------------------------------------------
# Text layouts, written to the shared folder and read again
# --------------------------------------------------------------------------

def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-{uuid.uuid4().hex}/{name}"


_LOG_SQL = "select user_id, shop_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from "


def _log_text(spark, log: DataFrame) -> DataFrame:
    path = _folder(spark, "log")
    IO.write_log_text(log, path)
    return IO.read_log(spark, path).select("user_id", "shop_id", F.date_format("ts", IO.TIME_FORMAT).alias("ts"))


@register("text_pay_log", base_ctes() + _LOG_SQL + "pay_log")
def q_text_pay_log(spark, sf):
    return _log_text(spark, pay_log(spark, sf))


@register("text_view_log", base_ctes() + _LOG_SQL + "view_log")
def q_text_view_log(spark, sf):
    return _log_text(spark, view_log(spark, sf))


# Lines damaged on purpose: which, and in what way, follows from the row's md5 bucket.
_DAMAGED = [
    ("fields", "user_id || ',' || shop_id"), ("fields", "user_id || ',' || shop_id || ',' || t || ',x'"), ("user", "'x' || user_id || ',' || shop_id || ',' || t"),
    ("shop", "user_id || ',,' || t"), ("time", "user_id || ',' || shop_id || ',' || replace(t, '-', '/')"), ("time", "user_id || ',' || shop_id || ',2000-13-01 00:00:00'"),
]


@register("text_log_checked", base_ctes() + f""",
b as (select *, {_bucket_sql()} as bucket from pay_log)
select coalesce(case {" ".join(f"when bucket = {k} then '{reason}'" for k, (reason, _) in enumerate(_DAMAGED))} end, 'good') as reason,
       count(*) as lines, cast(sum(case when bucket >= {len(_DAMAGED)} then user_id end) as bigint) as users,
       max(case when bucket >= {len(_DAMAGED)} then strftime(ts, '%Y-%m-%d %H:%M:%S') end) as last_ts
from b group by 1""")
def q_text_log_checked(spark, sf):
    # A purchase log with malformed lines: good rows and quarantined lines.
    from shopweave.functions.core import md5_bucket

    rows = pay_log(spark, sf).select("user_id", "shop_id", F.date_format("ts", IO.TIME_FORMAT).alias("t"), md5_bucket(["user_id", "shop_id"]).alias("bucket"))
    line = F.expr("case " + " ".join(f"when bucket = {k} then {text}" for k, (_, text) in enumerate(_DAMAGED)) + " else user_id || ',' || shop_id || ',' || t end")
    path = _folder(spark, "log")
    rows.select(line.alias("value")).write.text(path)
    good, bad = IO.read_log_checked(spark, path)
    bad = IO.quarantine(bad, _folder(spark, "quarantine"))
    kept = good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum("user_id").alias("users"), F.max(F.date_format("ts", IO.TIME_FORMAT)).alias("last_ts"))
    rest = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines")).select("reason", "lines", F.lit(None).cast("long").alias("users"), F.lit(None).cast("string").alias("last_ts"))
    return kept.unionByName(rest)


@register("text_shop", base_ctes() + """
select shop_id, city, location_id, per_pay, score, comment_cnt, shop_level from shop_info""")
def q_text_shop(spark, sf):
    path = _folder(spark, "shop")
    IO.write_shop_text(shop_table(spark, sf), path)
    return IO.read_shop(spark, path).drop("cate1", "cate2", "cate3")


@register("text_pair_counts", base_ctes() + f"""
select user_id, shop_id, count(*) as count from pay_log where ts < timestamp '{SPLIT}' group by user_id, shop_id""")
def q_text_pair_counts(spark, sf):
    path = _folder(spark, "counts")
    IO.write_pair_counts_text(FE.pair_counts(FE.before(pay_log(spark, sf), SPLIT)), path)
    return IO.read_pair_counts_text(spark, path)


@register("text_features", _features_sql("classification"))
def q_text_features(spark, sf):
    path = _folder(spark, "features")
    IO.write_features_text(_features(spark, sf, "classification"), path)
    return IO.read_features(spark, path)


@register("text_edge_lists", base_ctes() + f""",
pe as ({_events_sql(with_view=False)}),
ve as (select user_id, shop_id, {_f(0.5)} * {_tw_sql()} as weight from view_log),
x as (select 'u' || user_id as src, 's' || shop_id as dst, weight from pe
      union all select 'u' || user_id, 's' || shop_id, weight from ve
      union all select 's' || shop_id, 'u' || user_id, weight from pe)
select src, dst, round(sum(weight), 9) as weight from x group by src, dst having sum(weight) <> 0""")
def q_text_edge_lists(spark, sf):
    # Three lists written apart, read as one and merged: bought, viewed, and bought reversed.
    pay, view, _ = _logs(spark, sf)
    bought = G.user_shop_edges(G.weighted_events(pay, None, START, AS_OF), both_directions=False)
    seen = G.user_shop_edges(view.select("user_id", "shop_id", (F.lit(G.VIEW_WEIGHT) * G.time_weight("ts", START, AS_OF)).alias("weight")), both_directions=False)
    paths = [_folder(spark, n) for n in ("bought", "seen", "reversed")]
    for path, e in zip(paths, (bought, seen, G.reverse_edges(bought))):
        IO.write_edges_text(e, path)
    return IO.read_edge_lists(spark, paths, merge=True).select("src", "dst", round9("weight").alias("weight"))


@register("text_user_cities", base_ctes() + f""",
x as (select user_id, shop_id from pay_log union all select user_id, shop_id from view_log),
uc as (select distinct user_id, city from x join shop_info s on x.shop_id = s.shop_id)
select user_id, string_agg(city, ',' order by city) as cities, user_id = {SEED_USER} as is_seed,
       case when user_id = {SEED_USER} then count(*) end as seed_cities from uc group by user_id""")
def q_text_user_cities(spark, sf):
    pay, view, shop = _logs(spark, sf)
    path = _folder(spark, "cities")
    IO.write_user_cities_text(G.user_cities(pay, view, shop), path)
    mine = IO.cities_of(spark, path, SEED_USER).agg(F.count(F.lit(1)).alias("seed_cities")).withColumn("user_id", F.lit(SEED_USER).cast("long"))
    uc = IO.read_user_cities(spark, path).select("user_id", F.array_join("cities", ",").alias("cities"), (F.col("user_id") == SEED_USER).alias("is_seed"))
    return uc.join(mine, "user_id", "left").select("user_id", "cities", "is_seed", "seed_cities")


@register("parquet_view", base_ctes() + f"""
select s.shop_level, count(*) as pairs, cast(sum(n) as bigint) as events
from (select user_id, shop_id, count(*) as n from pay_log where ts < timestamp '{SPLIT}' group by user_id, shop_id) p
join shop_info s on p.shop_id = s.shop_id group by s.shop_level""")
def q_parquet_view(spark, sf):
    # Pair counts written as parquet by shop level, registered as a temp view and queried by name.
    pay, _, shop = _logs(spark, sf)
    counts = FE.pair_counts(FE.before(pay, SPLIT)).join(shop.select("shop_id", "shop_level"), "shop_id")
    path = _folder(spark, "pairs")
    IO.write_parquet(counts, path, ["shop_level"])
    name = f"pair_counts_{uuid.uuid4().hex[:8]}"
    IO.register_view(spark.read.schema(counts.schema).parquet(path), name)
    return spark.sql(f"select shop_level, count(*) as pairs, sum(count) as events from {name} group by shop_level")


# --------------------------------------------------------------------------
# Streaming
# --------------------------------------------------------------------------

@register("stream_pair_counts", base_ctes() + """
select cast(date '1970-01-01' + cast(floor(date_diff('second', timestamp '1970-01-01', ts) / 2592000) * 30 as integer)
            as date) as window_start,
       user_id, shop_id, count(*) as count
from pay_log group by 1, user_id, shop_id""")
def q_stream_pair_counts(spark, sf):
    from shopweave.streaming.counts import run_to_table, stream_pay_log, windowed_pair_counts

    return run_to_table(windowed_pair_counts(stream_pay_log(spark, sf), "30 days", "1 day"))


# The same log delivered year by year, a twentieth of its pairs three years late: those rows come after
# the watermark has closed their windows.
LATE_YEARS = 3
FILES_PER_YEAR = 2
_IS_LATE = f"{_bucket_sql(20, 'late')} = 0 and year(ts) <= 1998"
_WINDOW_START = "cast(date '1970-01-01' + cast(floor(date_diff('second', timestamp '1970-01-01', ts) / 2592000) * 30 as integer) as date)"


def _delivered(spark, sf) -> DataFrame:
    from shopweave.functions.core import md5_bucket
    from shopweave.streaming.counts import counted_arrivals, stream_log_files, windowed_pair_counts

    log = pay_log(spark, sf)
    year = F.year("ts")
    late = (md5_bucket(["user_id", "shop_id"], 20, "late") == 0) & (year <= 1998)
    log = stored(log.select("user_id", "shop_id", "ts", (year + F.when(late, LATE_YEARS).otherwise(0)).alias("delivered")), "delivered")
    path = _folder(spark, "arriving")
    for (y,) in log.select("delivered").distinct().orderBy("delivered").collect():  # a row per year
        log.filter(F.col("delivered") == y).drop("delivered").repartition(FILES_PER_YEAR).write.mode("append").parquet(path)
    events = counted_arrivals(stream_log_files(spark, path, log.drop("delivered").schema, FILES_PER_YEAR))
    return windowed_pair_counts(events, "30 days", "1 day")


@register("stream_late_rows", base_ctes() + f"""
select count(*) as arrived, cast(sum(case when {_IS_LATE} then 1 else 0 end) as bigint) as late, cast(count(distinct year(ts)) as bigint) as batches,
       cast(count(distinct case when not ({_IS_LATE}) then {_WINDOW_START} || '|' || user_id || '|' || shop_id end) as bigint) as groups from pay_log""")
def q_stream_late_rows(spark, sf):
    from shopweave.streaming.counts import run_reported

    table, report = run_reported(_delivered(spark, sf))
    found = table.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("counted"), F.count(F.lit(1)).alias("groups"))
    arrived = F.lit(report["arrived"]).cast("long")
    return found.select(arrived.alias("arrived"), (arrived - F.col("counted")).alias("late"), F.lit(report["batches"]).cast("long").alias("batches"), "groups")


@register("stream_closed_windows", base_ctes() + f""",
x as (select {_WINDOW_START} as window_start, user_id, shop_id from pay_log where not ({_IS_LATE}))
select window_start, user_id, shop_id, count(*) as count from x
where window_start + interval 30 day <= (select max(ts) from pay_log) - interval 1 day group by 1, 2, 3""")
def q_stream_closed_windows(spark, sf):
    from shopweave.streaming.counts import run_closed

    return run_closed(_delivered(spark, sf))[0]
