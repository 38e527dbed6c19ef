import datetime

import pytest

from tickloom.session import local_session, tune

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("8", "tests"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def bars_of(spark):
    """Bars from closes: {ticker: [close, ...]} on consecutive days."""

    def build(series: dict):
        rows = []
        for ticker, closes in series.items():
            for i, c in enumerate(closes):
                day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
                price = None if c is None else float(c)
                rows.append((ticker, day, price, price, price, price, 1.0))
        schema = "ticker string, dt date, open double, high double, low double, close double, volume double"
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def walk():
    """Repeatable price walks without a random generator's help."""

    def build(n: int, seed: int = 1):
        state, price, out = seed, 100.0, []
        for _ in range(n):
            state = (state * 48271) % 2147483647
            price *= 1 + (state / 2147483647 - 0.5) * 0.04
            out.append(price)
        return out

    return build
