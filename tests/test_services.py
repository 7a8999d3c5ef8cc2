"""Services as arguments: batches, retries, stored answers."""

from __future__ import annotations

import pytest

from lectern.operators import services
from lectern.operators.services import Service
from lectern.sources.store import Store


def test_failed_batches_are_asked_again():
    calls = []

    def flaky(texts):
        calls.append(list(texts))
        if len(calls) < 3:
            raise OSError("busy")
        return [t.upper() for t in texts]

    assert services.ask(Service("s", flaky, wait=0.0), ["a", "b"]) == ["A", "B"] and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        services.ask(Service("s", flaky, attempts=2, wait=0.0), ["a"])
    assert len(calls) == 2
    with pytest.raises(ValueError):
        services.ask(Service("s", lambda texts: texts[1:], wait=0.0), ["a", "b"])


def test_answers_are_kept_by_content(spark, tmp_path):
    def never(texts):
        raise AssertionError(texts)

    def upper(texts):
        assert len(texts) <= 2
        return [t.upper() for t in texts]

    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    store = Store(spark, str(tmp_path))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")]
    got = services.answers(df(rows), Service("s", upper, batch=2), store)
    assert {r.id: r.answer for r in got.collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: ""}
    assert store.table("answers-s").count() == 3
    again = services.answers(df([*rows, (6, "b")]), Service("s", never, attempts=1), store)
    assert {r.id: r.answer for r in again.collect()} == {1: "A", 2: "B", 3: "A", 4: None, 5: "", 6: "B"}
    other = services.answers(df(rows[:1]), Service("t", lambda texts: [[1.0, 2.0] for _ in texts], "array<double>"))
    assert other.first().answer == [1.0, 2.0]
    with pytest.raises(Exception, match="only"):
        def broken(texts):
            raise OSError("only this")
        services.answers(df([(1, "new")]), Service("s", broken, attempts=2, wait=0.0), store).collect()
    assert store.table("answers-s").count() == 3
