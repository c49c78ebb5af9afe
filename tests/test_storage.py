"""Intermediate tables are deleted by the mark they were written under, and threads do not touch each other's."""

import os
import threading

from groupwise.storage import drop_tables, mark, stored


def where(df):
    return df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]


def test_marks_nest_and_spare(spark):
    outer = mark()
    a = where(stored(spark.range(3)))
    inner = mark()
    b, c = where(stored(spark.range(4))), where(stored(spark.range(5)))
    drop_tables(spark, inner, spare=1)
    assert [os.path.exists(x) for x in (a, b, c)] == [True, False, True]
    drop_tables(spark, outer)
    assert not any(map(os.path.exists, (a, b, c)))


def test_threads(spark):
    mine = mark()
    a, others = where(stored(spark.range(3))), []

    def other():
        own = mark()
        others.append(where(stored(spark.range(2))))
        drop_tables(spark, own)
        others.append(where(stored(spark.range(2))))

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert os.path.exists(a) and [os.path.exists(x) for x in others] == [False, True]
    drop_tables(spark, mine)
    assert not os.path.exists(a) and os.path.exists(others[1])
