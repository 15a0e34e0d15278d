"""Daily currency rates as a Spark data source: one request and one partition a day.

    spark.dataSource.register(DailyRates)
    spark.read.format("daily_rates").option("url", "https://.../{day}.xml").option("today", "2024-01-30").option("days", 90).load()
    spark.readStream.format("daily_rates").option("url", ...).option("from", "2024-01-01").load()

``{day}`` in the URL becomes the date, by ``dayFormat`` (strftime). A request that fails is repeated, ``attempts`` times in all (3), after 2, 4, ... seconds and up to one
more at random; after a time-out 20 to 45 seconds go by as well. ``pause`` scales all waits. In a batch a day that cannot be fetched gives no rows unless
``failFast`` is true, so that a backfill goes on past gaps. A stream's offset is the next day to read: a restart reads only new ones; a day that cannot be
fetched fails the batch, which then runs again, unless ``failFast`` is false. ``today`` is the last day, by default this one (UTC).
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import CURRENCIES


class Day(InputPartition):
    def __init__(self, day: date) -> None:
        super().__init__(day)
        self.day = day


class DailyRates(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_rates"

    def schema(self) -> str:
        return "currency string, date date, rate decimal(10,4)"

    def reader(self, schema) -> DataSourceReader:
        return DailyRatesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DailyRatesStream(self.options)


def with_retries(fetch: Callable[[], bytes], attempts: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """What ``fetch`` returns, tried up to ``attempts`` times; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return fetch()
        except OSError as e:
            if k == attempts:
                raise
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            sleep(pause * (2**k + random.uniform(0, 1) + (random.uniform(20, 45) if late else 0)))
    raise ValueError("no attempt was allowed")


class _Source:
    """What batches and streams share: the options, and reading a day."""

    def __init__(self, options: dict, fail: str) -> None:
        self.url = options["url"]
        self.format = options.get("dayFormat", "%Y-%m-%d")
        self.fail = options.get("failFast", fail).lower() == "true"
        self.attempts = int(options.get("attempts", "3"))
        self.pause = float(options.get("pause", "1"))
        self.last = options.get("today")

    def today(self) -> date:
        return date.fromisoformat(self.last) if self.last else datetime.now(timezone.utc).date()

    def read(self, partition: Day) -> Iterator[tuple]:
        from urllib.request import urlopen

        def fetch() -> bytes:
            with urlopen(self.url.replace("{day}", partition.day.strftime(self.format)), timeout=30) as reply:
                return reply.read()

        try:
            body = with_retries(fetch, self.attempts, self.pause)
        except OSError:
            if self.fail:
                raise
            return
        yield from parse_rates(body, partition.day)


class DailyRatesReader(_Source, DataSourceReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options, "false")
        self.days = int(options.get("days", "1"))

    def partitions(self) -> list[InputPartition]:
        return [Day(self.today() - timedelta(days=k)) for k in reversed(range(self.days))]


class DailyRatesStream(_Source, DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        super().__init__(options, "true")
        self.first = options["from"]

    def initialOffset(self) -> dict:
        return {"day": self.first}

    def latestOffset(self) -> dict:
        return {"day": max(self.first, (self.today() + timedelta(days=1)).isoformat())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        return [Day(lo + timedelta(days=k)) for k in range((hi - lo).days)]

    def commit(self, end: dict) -> None:
        """Nothing is kept here: Spark's checkpoint holds the offset."""


def parse_rates(body: bytes, day: date) -> Iterator[tuple]:
    """(currency, day, rate) of the elements of one document; a missing value is 0, a missing nominal 1."""
    import xml.etree.ElementTree as ET

    for item in ET.fromstring(body).iter("Valute"):
        code = (item.findtext("CharCode") or "").strip()
        if code in CURRENCIES:
            value = Decimal((item.findtext("Value") or "0").replace(",", "."))
            yield code, day, (value / Decimal(item.findtext("Nominal") or "1")).quantize(Decimal("0.0001"))
