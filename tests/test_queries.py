import pytest

from compare import DATA, of_duck, of_spark
from glossmill.operators import fulltext
from glossmill.plans import queries as lexicon


@pytest.mark.parametrize("name", sorted(lexicon.SQL))
def test_equals_sql(spark, duck, name):
    assert of_spark(lexicon.QUERIES[name](spark, DATA)) == of_duck(duck, lexicon.SQL[name])


def test_every_name_is_known():
    assert set(lexicon.SQL) <= set(lexicon.QUERIES)


def test_stream_debounce_is_the_batch_form_but_for_open_sessions(spark):
    told = {tuple(r) for r in lexicon.QUERIES["stream_debounce"](spark, DATA).selectExpr("user_id", "event_id").collect()}
    batch = lexicon.QUERIES["debounce_events"](spark, DATA)
    last = batch.groupBy("user_id").agg({"ts": "max"}).collect()
    every = {tuple(r) for r in batch.selectExpr("user_id", "event_id").collect()}
    assert told <= every
    assert len(every - told) <= len(last)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_is_a_top_k_over_the_columns_it_needs(spark):
    shown = plan(lexicon.QUERIES["search_combined"](spark, DATA))
    assert "TakeOrderedAndProject" in shown
    assert "p_retailprice" not in shown


def test_stored_index_is_read_by_token(spark, tmp_path):
    index = fulltext.token_table(spark.createDataFrame([(1, "a b")], "id long, x string"), "id", ("x",))
    index.write.parquet(str(tmp_path / "index"))
    shown = plan(fulltext.match(spark.read.parquet(str(tmp_path / "index")), '"a b"'))
    assert "PushedFilters: [In(token, [a,b])]" in shown
