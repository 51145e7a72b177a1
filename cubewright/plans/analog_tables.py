"""Lazy table set for the analog data: raw inputs -> cubes and dimensions.

Nothing here runs a job; each accessor returns a DataFrame whose plan starts
at the parquet scans, so every report's work grows with the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import config as C
from ..functions import timeq as TQ
from ..operators import collapse as CO
from ..operators import cube as CU
from ..sources import analog as A


@dataclass
class AnalogTables:
    spark: SparkSession
    sf_dir: str
    most_recent_quarter: str = C.ANALOG["most_recent_quarter"]
    first_quarter: str = C.ANALOG["first_quarter"]
    _memo: dict = field(default_factory=dict)

    def _get(self, name, fn):
        if name not in self._memo:
            self._memo[name] = fn()
        return self._memo[name]

    def persons(self) -> DataFrame:
        return self._get("persons", lambda: A.persons(self.spark, self.sf_dir))

    def stops(self) -> DataFrame:
        return self._get("stops", lambda: CO.classify_stops(
            CO.collapse_stops(self.persons(), A.PERSON_ORDER,
                              cluster_keys=A.STOP_CLUSTER_KEYS,
                              key_determined=True)))

    def reason_cube(self) -> DataFrame:
        return self._get("reason_cube", lambda: CU.stop_cube_reason(
            self.stops(), self.most_recent_quarter))

    def cube(self) -> DataFrame:
        return self._get("cube", lambda: CU.stop_cube(self.reason_cube()))

    def hin_cube(self) -> DataFrame:
        return self._get("hin_cube", lambda: CU.hin_cube(
            A.persons_on_network(self.spark, self.sf_dir), self.most_recent_quarter))

    def shootings_cube(self) -> DataFrame:
        return self._get("shootings_cube", lambda: CU.shootings_cube(
            A.shootings(self.spark, self.sf_dir), self.most_recent_quarter))

    def population(self) -> DataFrame:
        return self._get("population", lambda: A.population(self.spark, self.sf_dir))

    def division_map(self) -> DataFrame:
        return self._get("division_map", lambda: A.division_map(self.spark, self.sf_dir))

    def spine(self) -> DataFrame:
        return TQ.quarter_spine(self.spark, self.first_quarter, self.most_recent_quarter)

    def spine_labels(self) -> list[str]:
        return TQ.quarters_between_py(self.first_quarter, self.most_recent_quarter)
