"""The registered queries of these operators, with their DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    cotraining,
    decontaminate,
    iceberg_terms,
    language_id,
    phrase_dedup,
    pivotal_mix,
    prefix_hash,
    secret_scan,
    setsketch,
    sharding,
    target_resampling,
    template_html,
)
from .words import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Extendible hashing in SQL: a row's shard is the shortest prefix of its bits whose rows fit.
_SHARDS = f"""
with rows as (
  select doc_id, md5(coalesce(text, '')) digest, octet_length(encode(coalesce(text, '')))::bigint n_bytes,
         row_number() over (partition by doc_id, md5(coalesce(text, ''))) - 1 as copy
  from documents),
hashed as (
  select *, ('0x' || substr(md5(concat_ws('|', doc_id, digest, copy)), 1, 15))::bigint bits from rows),
nodes as (
  select doc_id, copy, digest, n_bytes, bits, d depth, bits >> (60 - d) prefix
  from hashed, range(0, 61) t(d)),
sums as (select depth, prefix, sum(n_bytes)::bigint shard_bytes, count(*) shard_rows from nodes group by all),
fit as (
  select n.*, shard_bytes, shard_rows,
         row_number() over (partition by doc_id, digest, copy order by depth) place
  from nodes n join sums using (depth, prefix)
  where shard_bytes <= {sharding.SHARD_BYTES} or shard_rows = 1 or depth = 60)
select doc_id, copy, n_bytes,
       case when depth = 0 then '*' else right(lpad(bin(prefix), 60, '0'), depth::int) end shard,
       depth::int depth, shard_bytes, shard_rows, shard_bytes > {sharding.SHARD_BYTES} over_limit
from fit where place = 1
"""


@query("op1_extendible_shards", _SHARDS)
def _shards(spark, sf_dir):
    """Shard of each document: buckets of at most 1 MiB of text."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query("op2_cotrained_quality")
def _quality(spark, sf_dir):
    """Calibrated quality score of each document from both views."""
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_secret_entropy")
def _secrets(spark, sf_dir):
    """Secret spans of each document."""
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


@query("op4_phrase_automata")
def _phrases(spark, sf_dir):
    """Words of each document without passages that occur earlier."""
    return phrase_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op5_pivotal_mix")
def _mix(spark, sf_dir):
    """Words that the mix takes from each document."""
    return pivotal_mix.mix_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@query("op6_prefix_hashes")
def _fingerprints(spark, sf_dir):
    """Fingerprints of each document and its edited text, and their likeness."""
    return prefix_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op7_setsketch_duplicates")
def _duplicates(spark, sf_dir):
    """Near-duplicate component of each document."""
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_template_text")
def _pages(spark, sf_dir):
    """Main text of each page."""
    return template_html.extract_pages(table(spark, sf_dir, "pages"))


@query("op9_simhash_windows")
def _leaks(spark, sf_dir):
    """Documents that hold a benchmark item, with the place and the similarity."""
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The conversation of the contract: its texts hold marks of other templates and a backslash.
CONTROL_TEXT = "\\### Assistant: </turn> ok"
_CHATS = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
esc as (
  select *, replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') er,
         replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>') et,
         lag(role) over (partition by conv_id order by turn, role, text) as prior
  from turns)
select conv_id, count(*) n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
       sum(length(et) + case when prior is not distinct from role then 8 else length(er) + 12 end)::bigint formatted_chars
from esc group by conv_id
"""


@query("op10_relational_chat", _CHATS)
def _chats(spark, sf_dir):
    """Each conversation as one string, and what is read back from it."""
    own = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    formatted = chat_format.format_conversations(rows).select("conv_id", "formatted")
    read = formatted.select(
        "conv_id", F.length("formatted").cast("long").alias("formatted_chars"), chat_format.read_back("formatted").alias("turns")
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op11_target_resampling")
def _resample(spark, sf_dir):
    """Documents drawn towards the benchmark's distribution of word runs."""
    return target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language_id")
def _languages(spark, sf_dir):
    """Predicted language of each document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


_P = f"(1 + {iceberg_terms.SCALE}::hugeint * (n + 1) // (total + n_terms))::bigint"
_AUDIT = f"""
with d as (
  select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') body
  from documents),
w as (
  select rid, lang, source, unnest(regexp_extract_all(
    translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
kept as (
  select lang, term from (select distinct rid, lang, term from w)
  group by all having count(*) >= {iceberg_terms.MIN_DOCUMENTS}),
v as (select lang, count(*) n_terms from kept group by all),
c as (select lang, source, term, count(*) n from w join kept using (lang, term) group by all),
t as (select lang, source, sum(n) total from c group by all),
g as (
  select lang, source, coalesce(total, 0) total, coalesce(n_terms, 0) n_terms
  from (select distinct lang, source from d) left join t using (lang, source) left join v using (lang)),
lc as (select lang, term, sum(n) n from c group by all),
lg as (select lang, sum(total) total, any_value(n_terms) n_terms from g group by all),
q as (select lang, term, {_P} q from lc join lg using (lang)),
seen as (select lang, source, term, {_P} p from c join g using (lang, source)),
p as (
  select lang, source, term, {_P} p
  from (select g.*, kept.term, coalesce(c.n, 0) n from g join kept using (lang) left join c using (lang, source, term))),
f as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) as val
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
scored as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(val, 0)::bigint as val
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // q from seen join q using (lang, term) where p > q)
select lang, source, part, item, val as "value", "rank"::int as "rank" from (
  select *, row_number() over (partition by lang, source, part order by val desc, item) as "rank" from scored)
where part = 'pair' or "rank" <= {iceberg_terms.TOP_TERMS}
"""


@query("op13_iceberg_terms", _AUDIT)
def _audit(spark, sf_dir):
    """Divergence of the sources of each language, and the terms that make it."""
    return iceberg_terms.audit_sources(table(spark, sf_dir, "documents"))
