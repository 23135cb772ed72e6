"""Quality rules of single texts and of the hosts they come from.

A text's measures follow the fixed rules below; it fails by itself with under
``MIN_WORDS`` words or when more than ``MAX_REPEAT_PCT`` percent of its words lie
in a three-word window that the text has twice or more. Failures are then
counted by host (the ``source`` column). Small hosts say little by themselves, so
each host's failure rate is shrunk towards the corpus by a beta prior that is
fitted to all hosts' rates by the method of moments. A host whose shrunk rate
is over ``max_rate`` loses all its documents; the verdict is joined back.

Null text has no words and fails. Documents with a null source form a host of
their own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import Shared, null_key, pieces, to_bytes

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
SYMBOLS = b"#*$%&|<>"
MAX_RATE = 0.5
MAX_STRENGTH = 1e6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """The five measures of one UTF-8 text."""
    words = text.split()
    joined = b"".join(words)
    points = len(joined) if joined.isascii() else len(joined.decode())
    symbols = sum(map(text.count, (bytes([c]) for c in SYMBOLS)))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    triples = list(zip(words, words[1:], words[2:]))
    distinct = len(set(triples))
    repeats = 0
    if distinct < len(triples):
        often = {t for t, n in Counter(triples).items() if n > 1}
        covered = -1  # last word counted
        for i, t in enumerate(triples):
            if t in often:
                repeats += i + 2 - max(covered, i - 1)
                covered = i + 2
    return len(words), points, symbols, len(lines) - len(set(lines)), repeats


def document_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, the five measures, base_failed), a row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            columns = list(zip(*map(measure, to_bytes(batch.column("text")))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "source", *MEASURES])

    schema = "doc_id long, source string, " + ", ".join(f"{m} long" for m in MEASURES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, schema).withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta(a, b) whose mean and variance are those of the hosts' failure rates.

    Hosts that all fail alike give the largest strength; without hosts, Beta(1, 1).
    """
    rate = F.col("n_failed") / F.col("n_docs")
    mean, variance = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    if mean is None:
        return 1.0, 1.0
    strength = mean * (1 - mean) / variance - 1 if variance > 0 else MAX_STRENGTH
    strength = min(max(strength, 1e-6), MAX_STRENGTH)
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_kept), a row per host."""
    hosts = measured.groupBy(null_key("source").alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    a, b = beta_prior(hosts)
    rate = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return hosts.withColumn("host_rate", rate).withColumn("host_kept", F.col("host_rate") <= max_rate)


def quality_rules(docs: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """(doc_id, measures, base_failed, kept), a row per row of ``docs``.

    The verdict is joined by host. Verdicts are a written table, so both sides of the
    join are plain and Spark can split a host that has a large share of the rows.
    """
    shared = Shared(docs.sparkSession, "quality")
    measured = shared.table(document_measures(docs), "measures")
    verdicts = shared.table(host_verdicts(measured, max_rate).select("host", "host_kept"), "verdicts")
    joined = measured.withColumn("host", null_key("source")).join(verdicts, "host", "left")
    return joined.select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))


ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t, row_number() over () as r from documents),
tok as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
pos as (select r, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select r, w, unnest(range(1, len(w) - 1)) as i from tok where len(w) >= 3)),
often as (select r, a, b, c from pos group by r, a, b, c having count(*) > 1),
cov as (select r, count(distinct k) as n from (select p.r, p.i + unnest([0, 1, 2]) as k from pos p join often o on p.r = o.r and p.a = o.a and p.b = o.b and p.c = o.c) group by r),
lines as (select r, count(*) - count(distinct line) as n from (select r, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (
  select d.doc_id, d.source, cast(len(tok.w) as bigint) as n_words,
         cast(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(coalesce(lines.n, 0) as bigint) as n_dup_lines,
         cast(coalesce(cov.n, 0) as bigint) as n_repeat_words
  from d join tok using (r) left join lines using (r) left join cov using (r)
),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*) as n, count(*) filter (where base_failed) as bad from f group by source),
p as (select avg(bad / n) as mu, var_pop(bad / n) as va from h),
s as (select mu, least(greatest(case when va > 0 then mu * (1 - mu) / va - 1 else 1e6 end, 1e-6), 1e6) as st from p),
v as (select source, (bad + mu * st) / (n + st) <= 0.5 as ok from h, s)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       not f.base_failed and v.ok as kept
from f join v on f.source is not distinct from v.source
"""
