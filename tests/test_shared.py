"""Tables in the shared folder belong to the run that made them."""

import os
import threading

from sparsemill.sources import shared


def exists(df):
    return os.path.isdir(df._folder.removeprefix("file:"))


def test_scopes_of_threads(spark):
    """Two runs at a time: each drops what its own scope has made, nested scopes too, and nothing else."""
    outside = shared.materialise(spark.range(3), "outside")
    met, kept, seen = threading.Barrier(2, timeout=60), {}, {}

    def run(name):
        with shared.scope() as made:
            first = shared.materialise(spark.range(5), name)
            with shared.scope() as inner:
                second = shared.materialise(first.selectExpr("id * 2 as id"), name)
            assert inner == [second._folder] and made == [first._folder]
        met.wait()
        kept[name] = second
        if name == "one":
            shared.drop_tables(spark, made + inner)
        met.wait()
        seen[name] = exists(first), exists(second)

    threads = [threading.Thread(target=run, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert seen == {"one": (False, False), "two": (True, True)} and exists(outside)
    assert kept["two"].count() == 5
    shared.drop(kept["two"], outside)
    assert not exists(kept["two"]) and not exists(outside)
    shared.drop(outside)  # gone already: nothing happens
