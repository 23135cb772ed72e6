"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source) and their sizes are words. The budget, a
fraction of all words, is handed down the tree: a node divides its share among
its children by their target weights; a child can use no more than
``max_epochs`` times the words below it, and what it cannot use goes to its
siblings, again by weight, before anything is short further up (water filling:
the children that are full are those whose capacity per weight is smallest).

A leaf with a share of f full passes and a rest takes all its rows f times and,
in pass f + 1, the longest prefix of a seeded order whose words don't exceed
the rest. The order is md5(seed, pass, doc_id), so the prefix is "all rows whose key
is at most the leaf's cutoff": the cutoffs (a row per leaf) are joined to the
rows, and no row has to be moved. Cutoffs are found in two steps: sums over key
ranges of about ``RANGE_ROWS`` rows, then the keys of the one range in which the
rest ends (a task of the second step has the rows of some ranges, whatever a leaf holds). Rows with
equal keys (repeated ``doc_id``) stay or go together. What the prefix leaves of a rest goes to no sibling:
less than the words of the next key's rows per leaf. ``shortfalls`` reports it.

Texts of any length are counted whole. A null domain, lang or source is a value of its own; null text has no words; a
null ``doc_id`` counts as the empty string in the order. Weights that are not
given are 1. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopweave.llm.common import BLANK, Shared, null_key

SEED = 17
BUDGET = 0.6
MAX_EPOCHS = 2
RANGE_ROWS = 4096
DOMAINS = 4
LEVELS = ("domain", "lang", "source")

#: Target weights by level and key (see null_key); others weigh 1. The production mix leans to English and away from group 3.
WEIGHTS = {"domain": {"=group3": 0.5}, "lang": {"=en": 2.0}, "source": {}}


def domain_of(source: Column, domains: int = DOMAINS) -> Column:
    """The documents have no domain column: sources are put into ``domains`` groups by their md5; a null source has a null domain."""
    return F.concat(F.lit("group"), (F.ascii(F.md5(source.cast("string").cast("binary"))) % domains).cast("string"))


def order_key(seed: int, epoch: Column | int, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^" + BLANK[1:-1] + "]+")), F.lit(0)).cast("long")


def weight(level: str, weights: dict[str, float]) -> Column:
    w = F.lit(1.0)
    for key, value in weights.items():
        w = F.when(F.col(level) == key, F.lit(float(value))).otherwise(w)
    return w


def divide(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``share``: the parent's ``have`` divided among siblings by ``w``, none over its ``cap``.

    Siblings are taken by cap/w; while the level that would be reached, were all
    later ones filled alike, is at least a sibling's cap/w, it is full.
    """
    siblings = Window.partitionBy(*parent)
    before = siblings.orderBy(F.col("cap") / F.col("w"), *LEVELS).rowsBetween(Window.unboundedPreceding, -1)
    n = (
        nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap_before") + F.col("cap") / F.col("w") * F.col("w_from") <= F.col("have") + 1e-6)
        .withColumn("used", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(siblings))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(siblings))
    )
    open_share = (F.col("have") - F.col("used")) * F.col("w") / F.col("w_open")
    return n.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(open_share)).drop("cap_before", "w_from", "full", "used", "w_open")


def leaf_budgets(leaves: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS) -> DataFrame:
    """(domain, lang, source, n_rows, n_words, share): a row per leaf; shares are words."""
    have = leaves.agg(F.sum("n_words")).first()[0] or 0
    parent: list[str] = []
    above = None
    for level in LEVELS:
        keys = [*parent, level]
        nodes = leaves.groupBy(*keys).agg((F.sum("n_words") * max_epochs).cast("double").alias("cap"))
        for other in LEVELS[len(keys) :]:
            nodes = nodes.withColumn(other, F.lit(""))
        nodes = nodes.filter("cap > 0").withColumn("w", weight(level, weights.get(level, {})))
        nodes = nodes.withColumn("have", F.lit(float(have) * budget)) if above is None else nodes.join(above, parent)
        nodes = divide(nodes.withColumn("root", F.lit(0)), parent or ["root"])
        above = nodes.select(*keys, F.col("share").alias("have"))
        parent = keys
    return leaves.join(above.withColumnRenamed("have", "share"), list(LEVELS), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))


def sized(docs: DataFrame) -> DataFrame:
    """The frame with its leaf keys and words under names of its own."""
    source = F.col("source").cast("string")
    return docs.select("*", null_key(domain_of(source)).alias("__domain"), null_key("lang").alias("__lang"), null_key(source).alias("__source"), words(F.col("text").cast("string")).alias("__words"))


def cutoffs(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(domain, lang, source, full_epochs, cutoff): a row per leaf; a null cutoff takes nothing in the last pass."""
    shared = Shared(docs.sparkSession, "mix")
    keys = list(LEVELS)
    rows = shared.table(sized(docs).select(F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__words").alias("n"), F.col("doc_id").alias("doc_id")), "rows")
    leaves = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_words"))
    passes = F.when(F.col("n_words") > 0, F.floor((F.col("share") + 1e-6) / F.col("n_words"))).otherwise(0)
    plan = shared.table(
        leaf_budgets(leaves, budget, max_epochs, weights)
        .withColumn("full_epochs", passes.cast("int"))
        .withColumn("rest", F.floor(F.col("share") + 1e-6 - F.col("full_epochs") * F.col("n_words")).cast("long"))
        .withColumn("ranges", F.least(F.lit(1 << 24), F.ceil(F.col("n_rows") / RANGE_ROWS)).cast("long")),
        "plan",
    )
    joined = rows.join(plan.filter("rest > 0").select(*keys, "full_epochs", "rest", "ranges"), keys)
    keyed = joined.withColumn("key", order_key(seed, F.col("full_epochs") + 1, F.col("doc_id")))
    ranged = shared.table(keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32))).select(*keys, "rest", "range", "key", "n"), "ranged")
    so_far = Window.partitionBy(*keys).orderBy("range")
    sums = ranged.groupBy(*keys, "rest", "range").agg(F.sum("n").alias("n"), F.max("key").alias("top")).withColumn("upto", F.sum("n").over(so_far))
    whole = sums.filter("upto <= rest").groupBy(*keys).agg(F.max("top").alias("whole_top"))
    broken = sums.filter("upto > rest").groupBy(*keys).agg(F.min("range").alias("range"), F.min("upto").alias("upto"), F.min_by("n", "range").alias("n_range"))
    inside = ranged.join(broken.select(*keys, "range", (F.col("upto") - F.col("n_range")).alias("base")), [*keys, "range"])
    by_key = inside.groupBy(*keys, "rest", "base", "key").agg(F.sum("n").alias("n"))
    within = by_key.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy(*keys).orderBy("key"))).filter("upto <= rest").groupBy(*keys).agg(F.max("key").alias("part_top"))
    cut = plan.join(whole, keys, "left").join(within, keys, "left").select(*keys, "n_rows", "n_words", "share", "full_epochs", F.coalesce("part_top", "whole_top").alias("cutoff"))
    return shared.table(cut, "cutoffs")  # read plainly, so that Spark can split a leaf with many rows in a join


def mixed(docs: DataFrame, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The chosen rows with all their columns, plus ``__epoch`` (from 1) and ``__words``; a row stands once per pass that takes it."""
    plan = cutoffs(docs, budget, max_epochs, weights, seed).select(*[F.col(k).alias(f"__{k}") for k in LEVELS], F.col("full_epochs").alias("__full"), F.col("cutoff").alias("__cutoff"))
    joined = sized(docs).join(plan, [f"__{k}" for k in LEVELS])
    last = F.col("__cutoff").isNotNull() & (order_key(seed, F.col("__full") + 1, F.col("doc_id")) <= F.col("__cutoff"))
    passes = F.col("__full") + F.when(last, 1).otherwise(0)
    taken = joined.withColumn("__passes", passes).filter("__passes > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], "__epoch", "__words", *[f"__{k}" for k in LEVELS])


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_words): a row per document and pass that takes it."""
    chosen = mixed(docs.select("doc_id", "text", "lang", "source"), **options)
    return chosen.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), F.col("__words").alias("n_words"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The chosen rows with the columns of ``docs``."""
    return mixed(docs, **options).select(*[F.col(f"`{c}`") for c in docs.columns])


def shortfalls(docs: DataFrame, **options) -> DataFrame:
    """(domain, lang, source, share, taken, shortfall): per leaf its share, the words that the mix takes, and what lacks; keys as in ``null_key``."""
    keys = list(LEVELS)
    taken = mixed(docs.select("doc_id", "text", "lang", "source"), **options).groupBy(*[F.col(f"__{k}").alias(k) for k in keys]).agg(F.sum("__words").alias("taken"))
    plan = cutoffs(docs.select("doc_id", "text", "lang", "source"), **options).select(*keys, "share").join(taken, keys, "left")
    return plan.select(*keys, "share", F.coalesce("taken", F.lit(0)).alias("taken"), (F.col("share") - F.coalesce("taken", F.lit(0))).alias("shortfall"))


def _level_sql(level: int) -> str:
    """DuckDB: the shares of one level of the tree, from the level above."""
    keys = ", ".join(LEVELS[: level + 1])
    above = ", ".join(LEVELS[:level])
    w = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS[LEVELS[level]].items())
    w = f"case {LEVELS[level]} {w} else 1.0 end" if w else "1.0"
    have = f"join share{level - 1} using ({above})" if level else f"cross join (select sum(n_words) * {BUDGET} as share from leaves)"
    over = f"partition by {above}" if level else ""
    return f"""
node{level} as (select n.*, share as have, {w} as w from (select {keys}, cast(sum(n_words) * {MAX_EPOCHS} as double) as cap from leaves group by {keys} having sum(n_words) > 0) n {have}),
fill{level} as (
  select *, coalesce(sum(cap) over (win rows between unbounded preceding and 1 preceding), 0)
            + cap / w * (sum(w) over ({over}) - coalesce(sum(w) over (win rows between unbounded preceding and 1 preceding), 0)) <= have + 1e-6 as is_full
  from node{level} window win as ({over} order by cap / w, {keys})),
share{level} as (
  select {keys}, case when is_full then cap else (have - coalesce(sum(cap) filter (where is_full) over ({over}), 0)) * w / sum(w) filter (where not is_full) over ({over}) end as share
  from fill{level})"""


ORACLE_SQL = rf"""
with d as (
  select doc_id, lang as raw_lang, source as raw_source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n,
         'group' || (ascii(md5(source)) % {DOMAINS}) as raw_domain from documents),
k as (select *, coalesce('=' || raw_domain, '~') as domain, coalesce('=' || raw_lang, '~') as lang, coalesce('=' || raw_source, '~') as source from d),
leaves as (select domain, lang, source, sum(n) as n_words from k group by all),{_level_sql(0)},{_level_sql(1)},{_level_sql(2)},
plan as (select *, cast(floor((share + 1e-6) / n_words) as bigint) as f from share2 join leaves using (domain, lang, source)),
rest as (select *, floor(share + 1e-6 - f * n_words) as rest from plan),
keyed as (select k.*, f, rest, md5(concat_ws(':', '{SEED}', cast(f + 1 as varchar), coalesce(cast(doc_id as varchar), ''))) as key from k join rest using (domain, lang, source)),
taken as (select *, sum(n) over (partition by domain, lang, source order by key) <= rest and rest > 0 as last_too from keyed),
passes as (select *, unnest(range(1, f + 1 + cast(last_too as bigint))) as pass from taken)
select doc_id, raw_domain as domain, raw_lang as lang, raw_source as source, cast(pass as int) as epoch, n as n_words from passes
"""
