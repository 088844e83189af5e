import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from podium import schemas  # noqa: E402
from podium.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4, name="podium-tests")


def at(text):
    return datetime.fromisoformat(text)


class Maker:
    """Small tables from short rows."""

    def __init__(self, spark):
        self.spark = spark

    def scores(self, *rows):
        """(id, user, game, score, time[, metadata])"""
        full = [
            (r[0], r[1], r[2], Decimal(str(r[3])), at(r[4]), r[5] if len(r) > 5 else "{}")
            for r in rows
        ]
        return self.spark.createDataFrame(full, schemas.SCORES)

    def games(self, *rows):
        """(id, name, score type[, active])"""
        born = at("2023-12-01 00:00:00")
        full = [
            (r[0], r[1], f"About {r[1]}", r[2], r[3] if len(r) > 3 else True, born, born)
            for r in rows
        ]
        return self.spark.createDataFrame(full, schemas.GAMES)

    def users(self, *rows):
        """(id, name[, joined])"""
        full = [
            (
                r[0],
                f"u{r[0]}@example.com",
                r[1],
                True,
                False,
                at(r[2] if len(r) > 2 else "2024-01-01 00:00:00"),
            )
            for r in rows
        ]
        return self.spark.createDataFrame(full, schemas.USERS)

    def submissions(self, *rows):
        """(id, user, game, score text, metadata)"""
        full = [(r[0], r[1], r[2], r[3], at("2024-01-05 00:00:00"), r[4]) for r in rows]
        return self.spark.createDataFrame(full, schemas.SUBMISSIONS)


@pytest.fixture(scope="session")
def make(spark):
    return Maker(spark)


def rows(df, *cols):
    """Sorted tuples of a DataFrame."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
