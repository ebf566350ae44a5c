import os
from urllib.parse import urlparse

from glosswork.session import materialize, scratch


def places(df):
    return [urlparse(f).path for f in df.inputFiles()]


def test_tables_of_a_scope_are_deleted_but_for_the_kept(spark):
    with scratch(spark) as tables:
        one, two, three = (materialize(spark.range(5), name) for name in ("one", "two", "three"))
        tables.keep(two)
        tables.drop(three)
        assert all(map(os.path.exists, places(one))) and not any(map(os.path.exists, places(three)))
        gone = places(one)
    assert not any(map(os.path.exists, gone)) and two.count() == 5


def test_a_table_kept_by_an_inner_scope_belongs_to_the_outer_one(spark):
    with scratch(spark):
        with scratch(spark) as inner:
            table = inner.keep(materialize(spark.range(3), "inner"))
        assert table.count() == 3
        gone = places(table)
    assert not any(map(os.path.exists, gone))


def test_writing_leaves_the_setting_as_it_was(spark):
    from glosswork.session import CLEANUP_KEY
    before = spark.conf.get(CLEANUP_KEY, "false")
    shuffled = materialize(spark.range(100).groupBy("id").count(), "shuffled")
    assert spark.conf.get(CLEANUP_KEY, "false") == before and shuffled.count() == 100
