import json

import pytest

from palimpsest.sources import history, paged


def page(folder, n, items):
    folder.mkdir(exist_ok=True)
    (folder / f"page-{n}.json").write_text(items if isinstance(items, str) else json.dumps(items))


@pytest.fixture
def folder(tmp_path):
    """Five full pages, one of them broken, a short one, and one behind it."""
    at = tmp_path / "h"
    for n in range(7):
        page(at, n, "{broken" if n == 2 else [{"id": n * 10 + i, "é": None} for i in range(1 if n == 5 else 3)])
    return at


def test_read(spark, folder):
    got = paged.read_history(spark, str(folder), 3, pages_per_task=2)
    rows = sorted(map(tuple, got.collect()), key=lambda r: r[:2])
    assert [r[:2] for r in rows] == [(n, i) for n in range(6) for i in range({2: 1, 5: 1}.get(n, 3))]
    assert {(r[0], r[3]) for r in rows if r[3]} == {(2, "no JSON list")} and json.loads(rows[0][2]) == {"id": 0, "é": None}
    plain = history.page_items(history.read_pages(spark, str(folder)), 3)
    assert sorted((r["page"], r["at"], r["error"]) for r in plain.collect()) == sorted((r[0], r[1], r[3]) for r in rows)


def test_tasks_and_ends(spark, tmp_path):
    at = tmp_path / "h"
    paged.register(spark)
    load = lambda: spark.read.format("paged_history").option("path", str(at)).option("pages_per_task", 4).load()
    assert load().count() == 0
    for n in range(10):
        page(at, n, [1, 2])
    assert load().rdd.getNumPartitions() == 3 and load().count() == 20
    page(at, 10, [])
    page(at, 12, [3])  # nothing leads to it
    page(at, 4, '{"a": 1}')
    assert paged.read_history(spark, str(at), 2).where("error IS NULL").count() == 18


def test_stream(spark, folder, tmp_path):
    """A stream takes in pages as they come, goes on from its checkpoint, and ends at the short one."""
    paged.register(spark)
    late = tmp_path / "late"
    for n in range(2):
        page(late, n, [n, n, n])

    def run():
        stream = spark.readStream.format("paged_history").option("path", str(late)).option("page_size", 3).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        return sorted((r["page"], r["at"], r["item"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    seen = run()
    assert seen == [(n, i, str(n), None) for n in range(2) for i in range(3)]
    page(late, 2, "oops")
    page(late, 3, [3])
    page(late, 4, [4, 4, 4])
    run()
    assert run() == seen + [(2, 0, None, "no JSON list"), (3, 0, "3", None)]


def test_a_service(spark):
    class Service(paged.PagedHistory):
        """Pages from somewhere else, one of which fails."""

        @classmethod
        def name(cls):
            return "service_history"

        def body(self, page):
            if page == 1:
                raise OSError("timed out")
            return json.dumps(["x"] * 2) if page < 4 else None

    paged.register(spark, Service)
    rows = spark.read.format("service_history").load().collect()
    assert sorted((r["page"], r["item"], r["error"]) for r in rows if r["error"] or r["at"] == 0) == [(0, '"x"', None), (1, None, "timed out"), (2, '"x"', None), (3, '"x"', None)]
