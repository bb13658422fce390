"""Queries over popularity and catalogue features."""

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.text import format_title as title_form, year_bucket as bucket
from ..operators import features, prep, splits
from ..sources import views
from .common import query, view
from .sequences import labelled, train_seqs

view(
    "v_icnt",
    """select p_partkey item_idx, count(t.user_idx) cnt from part
       left join (select * from v_lab where split = 'train') t on t.item_idx = p_partkey group by 1""",
)
view(
    "v_iprob",
    """select item_idx, cnt, (cnt + 1) / (sum(cnt) over () + count(*) over ())::double prob from v_icnt""",
)


def train_rows(spark, sf):
    return splits.take_split(labelled(spark, sf), "train")


def n_parts(spark, sf):
    return views.table(spark, sf, "part").count()


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("item_counts", "select item_idx, cnt from v_icnt")
def item_counts(spark, sf):
    return features.item_counts(train_rows(spark, sf), n_parts(spark, sf))


@query(
    "item_probabilities",
    "select item_idx, cnt, round(prob, 9) prob, round(ln(prob + 1e-10), 6) log_prob from v_iprob",
)
def item_probabilities(spark, sf):
    df = features.item_probabilities(train_rows(spark, sf), n_parts(spark, sf), log=True)
    return rounded(df.withColumn("prob", F.round("prob", 9)), "log_prob")


@query(
    "item_probabilities_raw",
    "select item_idx, cnt, round(cnt / (sum(cnt) over ())::double, 9) prob from v_evcnt",
)
def item_probabilities_raw(spark, sf):
    from .sequences import labelled_events

    train = splits.take_split(labelled_events(spark, sf), "train")
    n = views.item_vectors(spark, sf).count()
    df = features.item_probabilities(train, n, smooth=False)
    return df.withColumn("prob", F.round("prob", 9))


@query(
    "sequence_item_probabilities",
    """select item_idx, cnt, round((cnt + 1) / (sum(cnt) over () + count(*) over ())::double, 9) prob from (
         select p_partkey item_idx, count(s.i) cnt from part left join
           (select unnest(seq) i from v_seq) s on s.i = p_partkey + 1 group by 1)""",
)
def sequence_item_probabilities(spark, sf):
    df = features.sequence_item_probabilities(train_seqs(spark, sf), n_parts(spark, sf))
    return df.withColumn("prob", F.round("prob", 9))


view(
    "v_z",
    """select item_idx, (lp - avg(lp) over ()) / (stddev_samp(lp) over () + 1e-6) z from (
         select item_idx, ln(prob + 1e-10) lp from v_iprob)""",
)


@query("popularity_zscore", "select item_idx, round(z, 6) z from v_z")
def popularity_zscore(spark, sf):
    probs = features.item_probabilities(train_rows(spark, sf), n_parts(spark, sf), log=True)
    return rounded(features.popularity_zscore(probs), "z")


view("v_genre", "select distinct unnest(string_split(genres, '|')) g from v_cat")
view(
    "v_vocab",
    """select 'Unknown' g, 0 pos union all
       select g, row_number() over (order by g) from v_genre""",
)


@query("genre_vocabulary", "select g as genre, pos::bigint as pos from v_vocab")
def genre_vocabulary(spark, sf):
    vocab = features.genre_vocabulary(views.catalogue(spark, sf))
    return spark.createDataFrame([(g, i) for i, g in enumerate(vocab)], "genre string, pos long")


@query(
    "genre_multihot",
    """select item_idx, string_agg(case when list_contains(own, g) then '1' else '0' end, ',' order by pos) hot
       from (select item_idx, g, pos, case when genres = '(no genres listed)' then ['Unknown']
             else string_split(genres, '|') end own from v_cat, v_vocab) group by 1""",
)
def genre_multihot(spark, sf):
    cat = views.catalogue(spark, sf)
    hot = features.genre_multihot(cat, features.genre_vocabulary(cat))
    as_text = arrays.joined(F.col("genre_multihot").cast("array<int>"))
    return hot.select("item_idx", as_text.alias("hot"))


YEAR_SQL = """case when y is null then 0 when y < 1970 then 1 when y < 1980 then 2 when y < 1990 then 3
              when y < 2000 then 4 else 5 end"""
view(
    "v_year",
    f"""select item_idx, {YEAR_SQL} b from (select item_idx,
          try_cast(nullif(regexp_extract(title, '\\(([0-9]{{4}})\\)', 1), '') as int) y from v_cat)""",
)


@query("year_bucket", "select item_idx, b::int as year_bucket from v_year")
def year_bucket(spark, sf):
    return views.catalogue(spark, sf).select("item_idx", bucket("title").alias("year_bucket"))


@query(
    "item_metadata",
    """select m.idx item_idx, title, b::int year_bucket, string_agg(case when list_contains(own, g) then '1' else '0' end, ',' order by pos) hot
       from v_itemmap m left join (select item_idx, title, case when genres = '(no genres listed)' then ['Unknown']
             else string_split(genres, '|') end own from v_cat) c on c.item_idx = m.raw_id
       left join v_year y on y.item_idx = m.raw_id, v_vocab group by all""",
)
def item_metadata(spark, sf):
    cat = views.catalogue(spark, sf)
    mapping = prep.id_map(views.interactions(spark, sf), "item_idx", views.INTERACTION_ORDER)
    vocab = features.genre_vocabulary(cat)
    meta = features.item_metadata(mapping, cat.withColumnRenamed("item_idx", "item_id"), vocab)
    as_text = arrays.joined(F.col("genre_multihot").cast("array<int>"))
    return meta.select("item_idx", "title", "year_bucket", as_text.alias("hot"))


@query(
    "genre_mean_pool",
    """with v as (select g, [count(*)::double, avg(p_size), avg(p_retailprice)] e from (
         select unnest(string_split(genres, '|')) g, item_idx from v_cat) join part on p_partkey = item_idx group by 1),
       x as (select item_idx, unnest(string_split(genres, '|')) g from v_cat)
       select item_idx, round(avg(e[1]), 6) a, round(avg(e[2]), 6) b, round(avg(e[3]), 6) c
       from x join v using (g) group by 1""".replace("with v as", "select * from (with v as") + ")",
)
def genre_mean_pool(spark, sf):
    cat = views.catalogue(spark, sf)
    parts = views.table(spark, sf, "part").withColumnRenamed("p_partkey", "item_idx")
    genres = cat.select("item_idx", F.explode(F.split("genres", r"\|")).alias("genre")).join(parts, "item_idx")
    vectors = genres.groupBy("genre").agg(
        F.array(F.count(F.lit(1)).cast("double"), F.avg("p_size"), F.avg("p_retailprice")).alias("embedding")
    )
    pooled = features.genre_mean_pool(cat, vectors)
    cols = [F.round(F.col("genre_embedding")[i], 6).alias(n) for i, n in enumerate("abc")]
    return pooled.select("item_idx", *cols)


@query(
    "format_title",
    """select item_idx, case when item_idx % 3 = 0 then 'The ' || p_name || ' (' || (1950 + p_size)::varchar || ')'
         when item_idx % 3 = 1 then 'An ' || p_name else p_name || ', Of (' || (1950 + p_size)::varchar || ')' end title
       from (select p_partkey item_idx, * from part)""",
)
def format_title(spark, sf):
    parts = views.table(spark, sf, "part").withColumnRenamed("p_partkey", "item_idx")
    year = F.concat(F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    moved = (
        F.when(F.col("item_idx") % 3 == 0, F.concat("p_name", F.lit(", The"), year))
        .when(F.col("item_idx") % 3 == 1, F.concat("p_name", F.lit(", An")))
        .otherwise(F.concat("p_name", F.lit(", Of"), year))
    )
    return parts.select("item_idx", title_form(moved).alias("title"))
