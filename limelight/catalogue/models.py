"""Models of document length (as popularity) from structured columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limelight.catalogue.features import FRAME_SQL, processed
from limelight.catalogue.fixtures import README_SQL, repositories, table
from limelight.catalogue.registry import query
from limelight.operators import modelling as M
from limelight.operators.sampling import with_split
from limelight.operators.terms import MEASURES, HashedTerms, TextMeasures
from limelight.plans.dataset import ModelSearch
from limelight.sources.scratch import materialise, scratch_path

NUMBERS = ["commits", "fork", "archived", "locked"]
CATEGORIES = ["primarylanguage", "license"]


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    columns = ["name", "target", "split", *NUMBERS, *CATEGORIES]
    rows = materialise(processed(spark, sf_dir).select(*columns), "modelling", partition_by="split")
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _search(spark, sf_dir) -> tuple[ModelSearch, DataFrame]:
    search = ModelSearch(*_parts(spark, sf_dir), NUMBERS, CATEGORIES, key="name")
    return search, search.train_models()


def _means_sql(column: str) -> str:
    """Mean target of the training rows of each category, drawn towards the overall mean."""
    return f"""SELECT {column} AS value, (sum(target) + 20 * (SELECT target FROM m)) / (count(*) + 20) AS mean
        FROM train GROUP BY {column}"""


@query(
    f"""WITH f AS ({FRAME_SQL}), train AS (SELECT * FROM f WHERE split = 'train'),
    m AS (SELECT avg(commits) AS commits, avg(fork) AS fork, avg(archived) AS archived, avg(target) AS target FROM train),
    a AS ({_means_sql("primarylanguage")}), b AS ({_means_sql("license")})
    SELECT f.name, f.commits::DOUBLE AS commits, round(coalesce(f.fork, m.fork), 6) AS fork,
           round(coalesce(f.archived, m.archived), 6) AS archived, 0.0::DOUBLE AS locked,
           round(coalesce(a.mean, m.target), 5) AS primarylanguage, round(coalesce(b.mean, m.target), 5) AS license
    FROM m, f LEFT JOIN a ON f.primarylanguage IS NOT DISTINCT FROM a.value
    LEFT JOIN b ON f.license IS NOT DISTINCT FROM b.value
    WHERE f.split = 'test'"""
)
def prepare_features(spark, sf_dir):
    """The feature vector of the test rows, as learnt from the training rows."""
    train, test = _parts(spark, sf_dir)
    preparation = M.prepare_features(train, NUMBERS, CATEGORIES, key="name")
    vector = vector_to_array(M.FEATURES)
    digits = {c: 5 for c in CATEGORIES}
    columns = [F.round(vector[i], digits.get(c, 6)).alias(c) for i, c in enumerate(preparation.feature_names)]
    return preparation.transform(test).select("name", *columns)


@query(
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS c, o_totalprice AS y,
        ('0x' || substring(sha256('split:1:' || o_orderkey), 1, 8))::BIGINT < 3435973837 AS train,
        ('0x' || substring(sha256('encode:1:' || o_orderkey), 1, 8))::BIGINT % 5 AS fold FROM orders),
    t AS (SELECT * FROM o WHERE train),
    everything AS (SELECT c, count(*) AS n, sum(y) AS s FROM t GROUP BY c),
    own AS (SELECT c, fold, count(*) AS n, sum(y) AS s FROM t GROUP BY c, fold),
    folds AS (SELECT f.fold, avg(t.y) AS mean FROM (SELECT DISTINCT fold FROM t) f JOIN t ON t.fold <> f.fold GROUP BY f.fold)
    SELECT o_orderkey, 'train' AS part, round((e.s - own.s + 20 * folds.mean) / (e.n - own.n + 20), 2) AS customer
    FROM t JOIN everything e ON t.c IS NOT DISTINCT FROM e.c
    JOIN own ON t.c IS NOT DISTINCT FROM own.c AND t.fold = own.fold JOIN folds ON t.fold = folds.fold
    UNION ALL
    SELECT o_orderkey, 'test', round(coalesce((e.s + 20 * p.mean) / (e.n + 20), p.mean), 2)
    FROM o CROSS JOIN (SELECT avg(y) AS mean FROM t) p LEFT JOIN everything e ON o.c IS NOT DISTINCT FROM e.c WHERE NOT train"""
)
def prepare_features_many(spark, sf_dir):
    """A category with thousands of values (customers, some unknown): training rows without their own targets."""
    customer = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", customer, F.col("o_totalprice").alias("target"))
    tagged = materialise(with_split(orders, "o_orderkey"), "customers", partition_by="split")
    train, test = (tagged.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    preparation = M.prepare_features(train, [], ["customer"], key="o_orderkey")
    first = F.round(vector_to_array(M.FEATURES)[0], 2).alias("customer")
    parts = (("train", preparation.training_rows()), ("test", preparation.transform(test)))
    done = [rows.select("o_orderkey", F.lit(name).alias("part"), first) for name, rows in parts]
    return done[0].unionByName(done[1])


MEASURES_SQL = r"""SELECT doc_id, readme, len(regexp_extract_all(readme, '(?m)^#+.*', 0))::BIGINT AS headings,
    len(regexp_extract_all(readme, '\S+'))::BIGINT AS words,
    len(regexp_extract_all(readme, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]'))::BIGINT AS emojis,
    CASE WHEN title <> '' AND NOT regexp_matches(title, '(^|[ ])\p{Ll}') THEN 1 ELSE 0 END AS title_case
    FROM (SELECT doc_id, readme, regexp_replace(regexp_extract(readme, '^#+.*', 0), '^[# ]+', '') AS title FROM r)"""


@query(
    f"""WITH r AS (SELECT doc_id, {README_SQL} AS readme FROM documents), x AS ({MEASURES_SQL}),
    w AS (SELECT doc_id, ('0x' || substring(sha256('term:1:' || token), 1, 8))::BIGINT % 256 AS bucket FROM
          (SELECT doc_id, unnest(list_filter(string_split_regex(lower(readme), '[^\\p{{L}}\\p{{N}}]+'),
           lambda t: t <> '')) AS token FROM r)),
    tf AS (SELECT doc_id, bucket, count(*) AS tf FROM w GROUP BY ALL),
    df AS (SELECT bucket, count(*) AS df FROM tf GROUP BY bucket),
    v AS (SELECT doc_id, count(*) AS n_terms, round(sum(tf * ln(((SELECT count(*) FROM r) + 1) / (df + 1))), 4) AS weight,
          round(sum(bucket * tf * ln(((SELECT count(*) FROM r) + 1) / (df + 1))), 2) AS moment
          FROM tf JOIN df USING (bucket) WHERE df < (SELECT count(*) FROM r) GROUP BY doc_id)
    SELECT 'R' || doc_id AS id, headings, words, emojis, title_case, coalesce(n_terms, 0) AS n_terms,
           coalesce(weight, 0) AS weight, coalesce(moment, 0) AS moment FROM x LEFT JOIN v USING (doc_id)"""
)
def feature_frame_text(spark, sf_dir):
    """Measures and weighted terms of every readme, by a pipeline that was saved and loaded again."""
    readmes = repositories(spark, sf_dir).select("id", "readme")
    path = scratch_path(spark, "text-pipeline")
    Pipeline(stages=[TextMeasures("readme"), HashedTerms("readme")]).fit(readmes).write().save(path)
    rows = PipelineModel.load(path).transform(readmes).withColumn("terms", vector_to_array("terms"))
    rows = rows.withColumn("n_terms", F.size(F.filter("terms", lambda w: w > 0)).cast("bigint"))
    total = lambda weigh: F.aggregate(F.transform("terms", weigh), F.lit(0.0), lambda a, b: a + b)
    weight, moment = F.round(total(lambda w: w), 4), F.round(total(lambda w, b: w * b), 2)
    return rows.select("id", *MEASURES, "n_terms", weight.alias("weight"), moment.alias("moment"))


@query()
def leaderboard(spark, sf_dir):
    return _search(spark, sf_dir)[0].get_leaderboard()


@query()
def score(spark, sf_dir):
    return _search(spark, sf_dir)[1].select("name", "target", "prediction")


@query()
def importance(spark, sf_dir):
    return _search(spark, sf_dir)[0].best_model_importance()


@query()
def stacked_score(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    preparation = M.prepare_features(train, NUMBERS, CATEGORIES, key="name")
    rows = materialise(preparation.training_rows().select("name", "target", M.FEATURES), "prepared")
    model = M.stacked(M.candidates(), "name").estimator.fit(rows)
    return model.transform(preparation.transform(test)).select("name", "target", "prediction")


QUANTITIES_SQL = """(SELECT o_orderkey, any_value(o_totalprice) AS price, coalesce(sum(l_quantity), 0) AS q
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
LINE_SQL = f"(SELECT regr_slope(price, q) AS slope, regr_intercept(price, q) AS intercept FROM {QUANTITIES_SQL})"


def _linear(spark, sf_dir) -> tuple[list[M.Trained], DataFrame]:
    """The linear candidate for the price of an order, given its total quantity: known in closed form."""
    ordered = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").join(ordered.agg(F.sum("l_quantity").alias("q")), "o_orderkey", "left")
    rows = rows.select("o_orderkey", F.col("o_totalprice").alias("target"), F.coalesce("q", F.lit(0.0)).alias("q"))
    prepared = materialise(VectorAssembler(inputCols=["q"], outputCol=M.FEATURES).transform(rows), "prepared")
    return M.train_candidates(prepared, M.candidates(), max_models=1), prepared


@query(
    f"""SELECT o_orderkey, round(slope * q + intercept, 4) AS prediction FROM {QUANTITIES_SQL}, {LINE_SQL}"""
)
def score_linear(spark, sf_dir):
    models, rows = _linear(spark, sf_dir)
    return models[0].model.transform(rows).select("o_orderkey", F.round("prediction", 4).alias("prediction"))


@query(
    f"""SELECT 1 AS "rank", 'linear' AS model_id, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae,
    round(1 - avg(e * e) / var_pop(price), 6) AS r2
    FROM (SELECT price, price - slope * q - intercept AS e FROM {QUANTITIES_SQL}, {LINE_SQL})"""
)
def leaderboard_linear(spark, sf_dir):
    board = M.leaderboard(spark, M.rank(*_linear(spark, sf_dir)))
    digits = {"rmse": 4, "mae": 4, "r2": 6}
    return board.drop("params").withColumns({c: F.round(c, d) for c, d in digits.items()})


STACK_FOLD = "('0x' || substring(sha256('fold:1:' || o_orderkey), 1, 8))::BIGINT % 3"


@query(
    f"""WITH t AS (SELECT o_orderkey, price, q, {STACK_FOLD} AS fold FROM {QUANTITIES_SQL}),
    f AS (SELECT a.fold, regr_slope(t.price, t.q) AS slope, regr_intercept(t.price, t.q) AS intercept
          FROM (SELECT DISTINCT fold FROM t) a JOIN t ON t.fold <> a.fold GROUP BY a.fold),
    b AS (SELECT regr_slope(price, f.slope * q + f.intercept) AS slope, regr_intercept(price, f.slope * q + f.intercept)
          AS intercept FROM t JOIN f USING (fold))
    SELECT o_orderkey, round(b.slope * (l.slope * q + l.intercept) + b.intercept, 1) AS prediction FROM t, b, {LINE_SQL} l"""
)
def stacked_linear(spark, sf_dir):
    """Two equal lines stacked: each order's fold is predicted by the lines of the others, the blend is a line over those."""
    _, rows = _linear(spark, sf_dir)
    line = M.candidates()[0]
    model = M.stacked([line, line], "o_orderkey").estimator.fit(rows)
    path = scratch_path(spark, "stack")
    model.save(path)
    return M.StackedModel.load(path).transform(rows).select("o_orderkey", F.round("prediction", 1).alias("prediction"))


@query(
    """SELECT count(*) AS models, true AS falling, true AS best_scores, true AS stacked_is_in FROM range(4)"""
)
def leaderboard_rules(spark, sf_dir):
    """What any leaderboard must keep: ranks without gaps, no better model below a worse one, the stack among them."""
    search = ModelSearch(*_parts(spark, sf_dir), NUMBERS, CATEGORIES, key="name")
    scored = search.train_models(max_models=3, stack=2)
    board = materialise(search.get_leaderboard(), "board")
    following = board.select((F.col("rank") - 1).alias("rank"), F.col("rmse").alias("next"))
    falling = board.join(following, "rank", "left").agg(
        F.count("*").alias("models"), F.min(F.coalesce(F.col("next") >= F.col("rmse"), F.lit(True))).alias("falling"),
        F.max(F.col("model_id") == "stacked").alias("stacked_is_in"), F.min("rmse").alias("rmse"),
    )
    error = F.col("target") - F.col("prediction")
    measured = scored.agg(F.sqrt(F.avg(error * error))).first()[0]
    near = F.abs(measured - F.col("rmse")) <= 1e-9 * F.col("rmse")
    return falling.select("models", "falling", near.alias("best_scores"), "stacked_is_in")
