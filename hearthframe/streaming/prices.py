"""Price changes of listings as their pages arrive: an extension, with state for each URL.

Pages arrive out of order. A page waits in its URL's state until the watermark has passed it, and a timer then takes the
waiting pages in the order in which they were captured; so a late page that is still within the watermark stands where it
belongs, and what was said once is never taken back. Another timer tells that no page has shown a URL for so long.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from hearthframe.operators.unify import lenient_long
from hearthframe.sources.html import raw_listings

_CHANGE = "Portal string, URL string, at long, change string, old long, new long"
_SEEN = "at long, price long"


class PriceChanges(StatefulProcessor):
    """State of one URL: the last page that was taken, and the pages that wait (moments in microseconds, and prices)."""

    def __init__(self, gone_ms: int) -> None:
        self.gone_ms = gone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _SEEN)
        self.waiting = handle.getListState("waiting", _SEEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = sorted({(r.at, r.price) for r in rows}, key=_order)
        self.waiting.appendList(found)
        for at in {_after(at) for at, _ in found}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now, pages = expiredTimerInfo.getExpiryTimeInMs(), sorted({tuple(p) for p in self.waiting.get()}, key=_order)
        due = [p for p in pages if _after(p[0]) <= now]
        last = self.last.get() if self.last.exists() else None
        before = last
        for at, price in due:
            if last is None or last[1] != price:
                yield Row(Portal=key[0], URL=key[1], at=at, change="new" if last is None else "changed", old=last and last[1], new=price)
            last = (at, price)
        if due:
            self.last.update(last)
            self.handle.registerTimer(_after(last[0]) + self.gone_ms)
            if before is not None:
                self.handle.deleteTimer(_after(before[0]) + self.gone_ms)
            rest = pages[len(due) :]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        elif last is not None and now >= _after(last[0]) + self.gone_ms:
            yield Row(Portal=key[0], URL=key[1], at=last[0], change="gone", old=last[1], new=None)
            self.last.clear()


def _order(page: tuple[int, int | None]) -> tuple:
    return page[0], page[1] is not None, page[1] or 0


def _after(at: int) -> int:
    """The first millisecond at which a moment is past."""
    return at // 1000 + 1


def price_changes(stream: DataFrame, late: str = "7 days", gone_days: int = 30) -> DataFrame:
    """Pages as a stream (captured.pages) -> (Portal, URL, captured, change, old, new), as they become sure.

    change is new at a URL's first page, changed where the price differs from the page's before, gone where no page
    captured within gone_days of the last one shows it (a later page is new again). A price that isn't a whole number is
    null; pages of one moment are ordered by price, null first; repeated pages count once; listings without a
    URL are left out, and so are pages later than the watermark. The session needs the RocksDB state store.
    """
    listed = raw_listings(stream.withWatermark("captured", late), carry=("captured",)).where("URL <> ''")
    pages = listed.select("Portal", "URL", "captured", F.unix_micros("captured").alias("at"), lenient_long(F.col("Precio")).alias("price"))
    found = pages.groupBy("Portal", "URL").transformWithState(PriceChanges(gone_days * 86_400_000), _CHANGE, "append", "EventTime")
    return found.select("Portal", "URL", F.timestamp_micros("at").alias("captured"), "change", "old", "new")
