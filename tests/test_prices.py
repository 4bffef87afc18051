import datetime as dt

import pytest

from hearthframe.schema import PAGES
from hearthframe.streaming import captured, prices

CARD = '<div class="listing__item"><a href="{url}"><p class="card__price">$ {price}</p></a></div>'
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def arrive(spark, folder, *pages):
    """Pages (url, day, price) as one file."""
    rows = [("argenprop", "b", "ph", 1, k, CARD.format(url=u, price=p), dt.datetime(2024, 1, 1) + dt.timedelta(days=d)) for k, (u, d, p) in enumerate(pages)]
    spark.createDataFrame(rows, f"{PAGES}, captured timestamp").coalesce(1).write.mode("append").json(folder)


def run(spark, tmp_path):
    """Runs the query over what has arrived since its checkpoint."""
    out = prices.price_changes(captured.pages(spark, f"{tmp_path}/in"), late="5 days", gone_days=30)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    found = spark.read.parquet(f"{tmp_path}/out").collect()
    start = dt.datetime(2024, 1, 1)
    return sorted(((r.URL.rsplit("/", 1)[1], (r.captured - start).days, r.change, r.old, r.new) for r in found), key=lambda r: (r[0], r[1], r[2] == "gone"))


def test_late_pages_and_a_restart(rocks, tmp_path):
    spark = rocks
    arrive(spark, f"{tmp_path}/in", ("/d/a", 1, "100"), ("/d/a", 3, "120"), ("/d/b", 2, "7"), ("/d/b", 2, "7"))
    run(spark, tmp_path)
    # the query begins again from its checkpoint; a page captured between two known ones is late, but not too late
    arrive(spark, f"{tmp_path}/in", ("/d/a", 2, "110"), ("/d/b", 6, "7"), ("/d/a", 6, "120"))
    run(spark, tmp_path)
    arrive(spark, f"{tmp_path}/in", ("/d/c", 20, "5"))
    first = [("a", 1, "new", None, 100), ("a", 2, "changed", 100, 110), ("a", 3, "changed", 110, 120), ("b", 2, "new", None, 7)]
    assert run(spark, tmp_path) == first
    # a page from before the watermark is left out; after 30 days without a page a URL is gone
    arrive(spark, f"{tmp_path}/in", ("/d/a", 4, "999"), ("/d/b", 30, "8"))
    arrive(spark, f"{tmp_path}/in", ("/d/z", 90, "1"))
    run(spark, tmp_path)
    arrive(spark, f"{tmp_path}/in", ("/d/a", 91, "120"), ("/d/z", 150, "1"))
    later = [("a", 6, "gone", 120, None), ("a", 91, "new", None, 120), ("b", 30, "changed", 7, 8), ("b", 30, "gone", 8, None), ("c", 20, "new", None, 5), ("c", 20, "gone", 5, None)]
    got = run(spark, tmp_path)
    assert [r for r in got if r[0] != "z"] == sorted(first + later, key=lambda r: (r[0], r[1], r[2] == "gone"))
