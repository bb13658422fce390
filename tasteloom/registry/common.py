"""Registration of queries with their SQL twins, and the SQL views both sides start from."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    """A named sub-query; ``ask`` pulls in the ones a statement mentions. A name is given once."""
    if name in VIEWS:
        raise ValueError(f"the view {name} is registered already")
    VIEWS[name] = body.strip()


def ask(body: str) -> str:
    """The statement with a WITH clause for all views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in needed) + "\n" + body.strip()


_WRITTEN: ContextVar[dict | None] = ContextVar("written", default=None)  # tables of the query that is being built


def written_once(fn):
    """``fn(spark, sf_dir)`` writes a table; further calls while the same query is built read it with fresh columns."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = _WRITTEN.get()
        if held is None:
            return fn(spark, sf_dir)
        if (fn, sf_dir) not in held:
            held[fn, sf_dir] = fn(spark, sf_dir)
        made = held[fn, sf_dir]
        return made.select(*[F.col(c).alias(c) for c in made.columns])

    return run


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is its DuckDB twin, if there is one."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            mine = _WRITTEN.set({}) if _WRITTEN.get() is None else None
            try:
                return fn(configure(spark), sf_dir)
            finally:
                if mine is not None:
                    _WRITTEN.reset(mine)

        QUERIES[name] = run
        if sql is not None:
            STATEMENTS[name] = sql
        return fn

    return register


def oracles() -> dict[str, str]:
    """Complete SQL of every query that has one."""
    return {name: ask(sql) for name, sql in STATEMENTS.items()}


def draw(*keys: str, seed: int = 42) -> str:
    """SQL of ``functions.portable.draw``."""
    return f"('0x'||substr(md5(concat_ws('|',{','.join(keys)},'{seed}')),1,13))::BIGINT"


def digest(*keys: str, seed: int = 42) -> str:
    return f"md5(concat_ws('|',{','.join(keys)},'{seed}'))"


def draw01(*keys: str, seed: int = 42) -> str:
    return f"({draw(*keys, seed=seed)} / 4503599627370496.0::double)"


view(
    "v_inter",
    """select o_custkey user_idx, l_partkey item_idx, ceil(l_quantity / 5) / 2 rating,
       cast(epoch(o_orderdate) as bigint) "timestamp", l_orderkey, l_linenumber, l_suppkey
     from lineitem join orders on l_orderkey = o_orderkey""",
)
TIE = '"timestamp", l_orderkey, l_linenumber, item_idx, l_suppkey'
TIE_DESC = ", ".join(f"{c.strip()} desc" for c in TIE.split(","))
view(
    "v_lab",
    f"""select *, case when age < 1 then 'test' when age < 2 then 'val' else 'train' end split
     from (select *, row_number() over (partition by user_idx order by {TIE_DESC}) - 1 age
           from v_inter)""",
)
view(
    "v_ev",
    """select user_id user_idx, cast(json_extract_string(props, '$.k') as bigint) item_idx,
       least(5.0::double, ceil(value / 10) / 2) rating, ts, event_id from events""",
)
view(
    "v_evlab",
    """select *, case when age < 1 then 'test' when age < 2 then 'val' else 'train' end split
     from (select *, row_number() over (partition by user_idx order by ts desc, event_id desc) - 1 age
           from v_ev)""",
)
view(
    "v_cat",
    """select p_partkey item_idx,
       case when p_partkey % 17 = 0 then p_name
            else concat(p_name, ' (', cast(1950 + p_size as varchar), ')') end title,
       case when p_partkey % 13 = 0 then '(no genres listed)' else concat(p_type, '|', p_brand) end genres
     from part""",
)
view("v_items", "select vec_id item_idx, embedding::double[] embedding, label from embeddings")
# unit mean vector of each user's train and val events, and those (user, item) pairs
view("v_seen", "select distinct user_idx, item_idx from v_evlab where split <> 'test'")
view(
    "v_parts",
    """select user_idx, pos, avg(x) m from (
         select user_idx, unnest(embedding) x, generate_subscripts(embedding, 1) pos
         from v_evlab join v_items using (item_idx) where split <> 'test') group by 1, 2""",
)
view(
    "v_uvec",
    """select user_idx, list(m / n order by pos) embedding from (
         select *, sqrt(sum(m * m) over (partition by user_idx)) n from v_parts) group by 1""",
)
# all user x item scores of the small vector tables
view(
    "v_scores",
    """select user_idx, item_idx, list_dot_product(u.embedding, i.embedding) raw
     from v_uvec u, v_items i""",
)
view(
    "v_evcnt",
    """select i.item_idx, count(e.user_idx) cnt from v_items i
     left join (select * from v_evlab where split = 'train') e using (item_idx) group by 1""",
)
view(
    "v_evprob",
    """select item_idx, cnt, (cnt + 1) / (sum(cnt) over () + count(*) over ())::double prob,
       ln((cnt + 1) / (sum(cnt) over () + count(*) over ())::double + 1e-10) log_prob from v_evcnt""",
)


def report_sql(preds: str, truth: str, n: str, k_list, prefix: str = "", distinct: bool = True) -> str:
    """SQL of ``batch_metrics`` divided by ``n``: rows ``(name, value)``.

    ``preds`` is a relation (query_id, item_idx, rank), ``truth`` one of (query_id, item_idx).
    """
    parts = []
    for k in k_list:
        ideal = f"list_sum(list_transform(range(1, least(n, {k}) + 1), lambda i: 1 / log2(i + 1)))"
        parts.append(
            f"""select '{prefix}HitRate@{k}' as name, sum(case when h{k} > 0 then 1.0 else 0 end) v from q
            union all select '{prefix}Recall@{k}', sum(h{k} / n::double) from q
            union all select '{prefix}NDCG@{k}', sum(g{k} / {ideal}) from q
            union all select '{prefix}MRR@{k}', sum(case when first <= {k} then 1.0::double / first else 0 end) from q"""
        )
    gains = ", ".join(
        f"count(case when rank <= {k} then 1 end) h{k},"
        f"sum(case when rank <= {k} then 1 / log2(rank + 1) else 0 end) g{k}"
        for k in k_list
    )
    return f"""select name, round(v / {n}, 6) as value from (
      with t as (select distinct query_id, item_idx from {truth}),
      q as (select query_id, count(distinct t.item_idx) n, min(rank) as first, {gains}
            from t left join (select query_id, item_idx, rank from {preds}) p using (query_id, item_idx)
            group by 1)
      {' union all '.join(parts)})"""
