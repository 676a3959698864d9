"""The two global axes: sessions (di) and securities (ii). Both only grow at the end."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide.sources import files


class AxesMissing(FileNotFoundError):
    """There is no store at the path."""


class Axes:
    def __init__(self, spark: SparkSession, sessions: list[str], securities: list[int], path: str | None = None):
        self.spark, self.path = spark, path
        self.sessions, self.securities = list(sessions), [int(s) for s in securities]
        self._at = {d: i for i, d in enumerate(self.sessions)}

    # -- persistence
    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Axes:
        path = f"{root}/_axes"
        if not files.exists(spark, f"{path}/sessions.json"):
            raise AxesMissing(f"no store at {root}: {path}/sessions.json is missing; set CROSSTIDE_ROOT or --store, or build the base panels")
        return cls(spark, json.loads(files.read_text(spark, f"{path}/sessions.json")), json.loads(files.read_text(spark, f"{path}/securities.json")), path)

    @classmethod
    def create(cls, spark: SparkSession, root: str, sessions: list[str], securities: list[int], overwrite: bool = False) -> Axes:
        """Write the axes. What exists must be a prefix of what is given: positions never change their meaning."""
        if any(a >= b for a, b in zip(sessions, sessions[1:])):
            raise ValueError("sessions must be strictly increasing")
        if len(set(securities)) != len(securities):
            raise ValueError("securities must be distinct")
        path = f"{root}/_axes"
        for name, new in (("sessions", list(sessions)), ("securities", [int(s) for s in securities])):
            if not overwrite and files.exists(spark, f"{path}/{name}.json"):
                old = json.loads(files.read_text(spark, f"{path}/{name}.json"))
                if old != new[: len(old)]:
                    raise ValueError(f"{path} holds {len(old)} {name} that the new list does not begin with; axes only grow at the end")
        out = cls(spark, sessions, securities, path)
        out._save()
        return out

    def _save(self) -> None:
        if self.path:
            files.write_text(self.spark, f"{self.path}/sessions.json", json.dumps(self.sessions))
            files.write_text(self.spark, f"{self.path}/securities.json", json.dumps(self.securities))

    def ensure_sessions(self, days: list[str]) -> int:
        """Append the days that are new; returns how many. Days before the end are refused."""
        new = sorted(set(days) - set(self._at))
        if new and self.sessions and new[0] <= self.sessions[-1]:
            raise ValueError(f"{new[0]} is not after the last session {self.sessions[-1]}")
        for d in new:
            self._at[d] = len(self.sessions)
            self.sessions.append(d)
        if new:
            self._save()
        return len(new)

    def ensure_securities(self, ids: list[int]) -> int:
        known = set(self.securities)
        new = [i for i in dict.fromkeys(map(int, ids)) if i not in known]
        self.securities += new
        if new:
            self._save()
        return len(new)

    # -- positions
    @property
    def n_sessions(self) -> int:
        return len(self.sessions)

    @property
    def n_securities(self) -> int:
        return len(self.securities)

    def __contains__(self, day: str) -> bool:
        return day in self._at

    def pos(self, day: str) -> int:
        if day not in self._at:
            raise KeyError(f"{day} is not on the session axis")
        return self._at[day]

    def date(self, i: int) -> str:
        return self.sessions[i]

    def slice(self, first: str | None, last: str | None) -> tuple[int, int]:
        """Positions [i0, i1) of the sessions from first to last, both included."""
        return (0 if first is None else bisect_left(self.sessions, first)), (self.n_sessions if last is None else bisect_right(self.sessions, last))

    # -- dimension tables
    def session_table(self, i0: int = 0, i1: int | None = None) -> DataFrame:
        i1 = self.n_sessions if i1 is None else i1
        rows = self.spark.createDataFrame([(i, d) for i, d in enumerate(self.sessions[i0:i1], i0)], "di int, day string")
        return rows.select("di", F.to_date("day").alias("date"))

    def security_table(self) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in self.securities], "ii int")

    def grid(self, i0: int = 0, i1: int | None = None) -> DataFrame:
        """Every security on every session of [i0, i1): the dense frame of outputs on missing days.

        Both axes are dimension tables that the driver holds; each security is
        exploded over a range of session numbers.
        """
        i1 = self.n_sessions if i1 is None else i1
        return self.security_table().select(F.explode(F.sequence(F.lit(i0), F.lit(i1 - 1))).alias("di"), "ii") if i1 > i0 else self.security_table().select(F.lit(0).alias("di"), "ii").limit(0)
