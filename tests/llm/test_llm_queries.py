"""The subpackage's queries against their SQL, and the cases every result must hold."""

import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(os.path.dirname(__file__))]
import oracle  # noqa: E402

from textloom.llm import queries as Q  # noqa: E402
from textloom.llm import sql as S  # noqa: E402

QUERIES, SQL = Q.queries(), S.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql(spark, db, tmp_path, name):
    assert oracle.differences(spark, db, name, QUERIES[name], SQL[name], str(tmp_path / name)) == ([], [])


def test_survivors_agree_with_found(spark):
    whole, found = Q.p2_survivors(spark, oracle.FOLDER), Q.p2_found(spark, oracle.FOLDER)
    assert whole.count() == found.select("group_id").distinct().count()


def test_pieces(spark):
    p = Q.p3_pieces(spark, oracle.FOLDER)
    assert p.where("length(text) > 1200 or overlap > 120 or (piece > 0 and length(text) <= overlap)").count() == 0
    new = p.groupBy("item_table", "item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, overlap + 1)").alias("new")))), lambda x: x["new"]), "").alias("whole"))
    texts = spark.read.parquet(f"{oracle.FOLDER}/relationships_sample.parquet").select(F.col("id").alias("item_key"), "text")
    both = new.where("item_table = 'relationships_sample'").join(texts, "item_key")
    assert both.count() > 0 and both.where("whole <> text").count() == 0


def test_containers(spark):
    got = Q.p6_containers(spark, oracle.FOLDER).toPandas()
    fill = got.groupby("container").tokens.sum()
    assert fill.max() <= 2048 and (got.groupby("container").fill.first() == fill).all()
    assert fill.sum() / (2048 * len(fill)) > 0.95
    assert not got.duplicated(["doc_id", "part"]).any()


def test_subjects_cover_documents(spark):
    areas = Q.p8_found(spark, oracle.FOLDER)
    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").where(F.col("text").rlike(r"\S"))
    assert areas.select("doc_id").distinct().count() == docs.count() and areas.count() == areas.distinct().count()
