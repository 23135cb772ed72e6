"""The registered queries of the corpus operators: ``opN_<name>`` over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shopweave.llm import bag_search, bpe, budget, decontaminate, exact_dedup, langid, licenses, minhash, mixing_lm, prefix_trie, quality, repeats, sharding
from shopweave.llm.common import documents


TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), TOKENIZER)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op4_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(documents(spark, sf_dir))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(sharding.shuffled_shards(documents(spark, sf_dir)))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.mix_rows(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hits(decontaminate.removal_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("node_key")


OP7_SQL = r"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by n desc, doc_id) = 1 as kept, text_sha256
from t
"""


OP3_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i : i + 2], ' ') end as g
      from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as nb from s a join s b on a.g = b.g and a.doc_id != b.doc_id group by all),
l as (select p.a, p.b from p join n x on p.a = x.doc_id join n y on p.b = y.doc_id where 100 * nb >= 85 * (x.n + y.n - nb)),
reach as (select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a),
c as (select a, min(b) as low from reach group by a)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(c.low, doc_id)) as component_id, least(doc_id, coalesce(c.low, doc_id)) = doc_id as kept
from documents d left join n using (doc_id) left join c on c.a = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_near_dedup, op4_mixing_lm, op5_sharding, op6_licenses, op7_exact_dedup, op8_mixing, op9_langid, op10_repeats, op11_search, op12_decontaminate, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": OP3_SQL, "op2_quality_rules": quality.ORACLE_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": budget.ORACLE_SQL, "op10_repeats": repeats.ORACLE_SQL,
            "op11_search": bag_search.ORACLE_SQL, "op12_decontaminate": decontaminate.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
