"""First looks and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from limelight.catalogue.fixtures import table
from limelight.catalogue.registry import query
from limelight.operators import explore, quality


@query(
    """SELECT nullif(lang, 'es') AS primarylanguage, count(*) AS count FROM documents
    GROUP BY 1 ORDER BY count DESC, primarylanguage"""
)
def value_counts(spark, sf_dir):
    languages = table(spark, sf_dir, "documents").select(F.nullif("lang", F.lit("es")).alias("primarylanguage"))
    return explore.value_counts(languages, "primarylanguage")


@query(
    """SELECT 'primarylanguage' AS "column", count(*) AS "values"
    FROM (SELECT DISTINCT nullif(lang, 'es') FROM documents)
    UNION ALL SELECT 'license', count(*) FROM (SELECT DISTINCT source FROM documents)
    UNION ALL SELECT 'stars', count(*) FROM (SELECT DISTINCT n_chars FROM documents)"""
)
def distinct_with_null(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.nullif("lang", F.lit("es")).alias("primarylanguage"),
        F.col("source").alias("license"),
        F.col("n_chars").alias("stars"),
    )
    return explore.distinct_with_null(rows, ["primarylanguage", "license", "stars"])


PROFILE = {
    "o_orderkey": ("bigint", "o_orderkey"),
    "o_custkey": ("bigint", "o_custkey"),
    "o_orderstatus": ("string", "nullif(o_orderstatus, 'P')"),
    "o_totalprice": ("double", "o_totalprice"),
    "o_orderdate": ("timestamp_ntz", "o_orderdate"),
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", '{kind}' AS "type", count(*) AS "rows", count(*) - count(v) AS "nulls",
        count(DISTINCT v) AS "values", min(v)::VARCHAR AS smallest, max(v)::VARCHAR AS largest
        FROM (SELECT {value} AS v FROM orders)"""
        for name, (kind, value) in PROFILE.items()
    )
)
def profile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return explore.profile(orders, list(PROFILE))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return explore.top_k(orders, "o_totalprice", ["o_orderkey"])


@query(
    """SELECT * FROM (SELECT doc_id, nullif(lang, 'es') AS primarylanguage, nullif(source, 'src3') AS license
    FROM documents) WHERE primarylanguage IS NOT NULL AND license IS NOT NULL"""
)
def dropna_any(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.nullif("lang", F.lit("es")).alias("primarylanguage"),
        F.nullif("source", F.lit("src3")).alias("license"),
    )
    return explore.complete_rows(rows)


PK_SQL = """SELECT 'primary key (l_orderkey, l_linenumber)' AS rule, count(*) AS violations,
    coalesce(sum(copies), 0)::BIGINT AS "rows"
    FROM (SELECT count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"""
FK_SQL = """SELECT 'foreign key (doc_id)' AS rule, count(*) AS violations, coalesce(sum(copies), 0)::BIGINT AS "rows"
    FROM (SELECT doc_id, count(*) AS copies FROM documents
          WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id)"""
CHECKS = {
    "not null (l_returnflag)": "nullif(l_returnflag, 'R') IS NULL",
    "check (l_quantity >= 0)": "NOT l_quantity >= 0",
    "check (l_discount < 0.1)": "NOT l_discount < 0.1",
    "check (l_tax > 0)": "NOT l_tax > 0",
}
CHECKS_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, count(*) AS violations, count(*) AS "rows" FROM lineitem WHERE {bad}"""
    for name, bad in CHECKS.items()
)


def _item_rules():
    return [
        quality.NotNull("l_returnflag"),
        quality.Check("l_quantity >= 0", F.col("l_quantity") >= 0),
        quality.Check("l_discount < 0.1", F.col("l_discount") < 0.1),
        quality.Check("l_tax > 0", F.col("l_tax") > 0),
    ]


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))


@query(PK_SQL)
def audit_pk(spark, sf_dir):
    return quality.audit_constraints(_items(spark, sf_dir), [quality.PrimaryKey(["l_orderkey", "l_linenumber"])])


@query(
    f"""{FK_SQL} UNION ALL SELECT 'foreign key (l_orderkey)', count(*), coalesce(sum(copies), 0)::BIGINT
    FROM (SELECT l_orderkey, count(*) AS copies FROM lineitem
          WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey)"""
)
def audit_fk(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    orders = table(spark, sf_dir, "orders")
    found = quality.audit_constraints(documents, [quality.ForeignKey(["doc_id"], labels, ["doc_id"])])
    return found.unionByName(
        quality.audit_constraints(_items(spark, sf_dir), [quality.ForeignKey(["l_orderkey"], orders, ["o_orderkey"])])
    )


@query(CHECKS_SQL)
def audit_checks(spark, sf_dir):
    return quality.audit_constraints(_items(spark, sf_dir), _item_rules())


@query(
    f"""{PK_SQL} UNION ALL {CHECKS_SQL}
    UNION ALL SELECT 'foreign key (l_orderkey)', count(*), coalesce(sum(copies), 0)::BIGINT
    FROM (SELECT l_orderkey, count(*) AS copies FROM lineitem
          WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey)"""
)
def audit_constraints(spark, sf_dir):
    rules = [
        quality.PrimaryKey(["l_orderkey", "l_linenumber"]),
        quality.ForeignKey(["l_orderkey"], table(spark, sf_dir, "orders"), ["o_orderkey"]),
        *_item_rules(),
    ]
    return quality.audit_constraints(_items(spark, sf_dir), rules)
