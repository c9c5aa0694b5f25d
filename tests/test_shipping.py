from concurrent.futures import ThreadPoolExecutor

from offerloom import session


def test_threads_ship_the_package_once(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda _: session.ship_package(spark), range(16)))
    assert len(sent) == 1
