"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as E


def test_entry_schema_and_rows(spark):
    df = E.entry(spark)
    assert df.schema.simpleString() == "struct<entry:bigint,term:bigint,namespace:bigint,prob:double,rank:bigint>"
    assert df.count() > 0


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100
    assert all(callable(f) for f in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
