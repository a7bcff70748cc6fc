"""Run parameters. Nothing in the package reads the wall clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class RunParams:
    """`as_of` plays the role of "today" for orders, `as_of_events` for the behaviour profile."""

    as_of: dt.date
    as_of_events: dt.date
    entity: str | None = None
    profile_lag_days: int = 3

    @property
    def profile_day(self) -> dt.date:
        return self.as_of_events - dt.timedelta(days=self.profile_lag_days)

    @property
    def date_until(self) -> dt.date:
        """Last Sunday strictly before the week of `as_of`."""
        return self.as_of - dt.timedelta(days=self.as_of.weekday() + 1)


# Clock values of the test tables: one day after the last order, three days after the last event.
TEST_RUN = RunParams(as_of=dt.date(2001, 8, 2), as_of_events=dt.date(2024, 2, 2))
