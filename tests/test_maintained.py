"""Late deltas: the maintained tables equal a build from everything, and only touched parts are written."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.plans.maintained import Maintained, changed_days

DAY = dt.date(2023, 3, 1)
BY = ["subject_id"]


def rows_of(days, athletes, seed):
    draw = random.Random(seed)
    workouts = [(a, dt.datetime.combine(DAY, dt.time(9)) + dt.timedelta(d), float(draw.randrange(20, 90)), float(draw.choice([110, 140, 165])), float(draw.randrange(100, 900))) for a in athletes for d in days if draw.random() < 0.6]
    energy = [(a, "active_energy", dt.datetime.combine(DAY, dt.time(12)) + dt.timedelta(d), float(draw.randrange(100, 900))) for a in athletes for d in days if draw.random() < 0.5]
    return workouts, energy


class World:
    def __init__(self, spark, root):
        self.spark, self.workouts, self.energy = spark, [], []
        self.kept = Maintained(spark, str(root), BY, block=16, shards=2)

    def frames(self, workouts, energy):
        return (self.spark.createDataFrame(workouts, "subject_id int, start_ts timestamp, duration double, avg_hr double, energy double"), self.spark.createDataFrame(energy, "subject_id int, type string, start_ts timestamp, value double"))

    def anchors(self):
        return self.spark.createDataFrame([(a, 190.0, 60.0) for a in range(9)], "subject_id int, hr_max double, resting_hr double")

    def add(self, rows, build=False):
        workouts, energy = rows
        self.workouts, self.energy = self.workouts + workouts, self.energy + energy
        return self.kept.update(*self.frames(self.workouts, self.energy), self.anchors(), None if build else changed_days(*self.frames(workouts, energy), BY))

    def same_as_built_anew(self, root):
        anew = Maintained(self.spark, str(root), BY, block=16, shards=2)
        anew.update(*self.frames(self.workouts, self.energy), self.anchors())
        told = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)
        assert told(self.kept.series()) == told(anew.series()) and told(self.kept.loads()) == told(anew.loads())


@pytest.fixture
def world(spark, tmp_path):
    made = World(spark, tmp_path / "kept")
    made.add(rows_of(range(160), (1, 2, 3), 1), build=True)
    return made


def block_of(day):
    return (DAY - dt.date(1970, 1, 1)).days // 16 if day is None else ((DAY - dt.date(1970, 1, 1)).days + day) // 16


def test_a_late_day_touches_its_blocks_alone(world, tmp_path):
    done = world.add(([(2, dt.datetime(2023, 4, 20, 18), 50.0, 150.0, 300.0)], []))
    day = (dt.date(2023, 4, 20) - DAY).days
    assert {b for _, b in done["loads"]} == {block_of(day)} and len({s for s, _ in done["series"]}) == 1
    assert {b for _, b in done["series"]} == set(range(block_of(day), block_of(day + 27) + 1)) and len(done["series"]) == 3
    world.same_as_built_anew(tmp_path / "anew")


@pytest.mark.parametrize("case", ["later", "earlier", "another athlete", "many"])
def test_every_kind_of_delta(world, tmp_path, case):
    world.add({"later": rows_of([165, 199], (1, 3), 5), "earlier": rows_of([-40, -38, -3], (2,), 6), "another athlete": rows_of(range(30, 70), (5,), 7), "many": rows_of(range(0, 160, 9), (1, 2, 3), 8)}[case])
    world.same_as_built_anew(tmp_path / "anew")


def test_an_empty_delta_and_old_updates(world, tmp_path):
    before = world.kept.commits.latest()
    assert world.add(([], [])) == {} and world.kept.commits.latest() == before
    for day in (20, 20, 21):
        world.add(rows_of([day], (1, 2, 3), day))
    assert world.kept.vacuum() > 0
    world.same_as_built_anew(tmp_path / "anew")


def test_readers_see_whole_updates(world, monkeypatch):
    before = sorted(map(tuple, world.kept.series().select("subject_id", "day", "acute_7d", "ctl").collect()))
    with monkeypatch.context() as m:
        m.setattr(world.kept.commits, "commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            world.add(([(1, dt.datetime(2023, 4, 1, 8), 60.0, 160.0, 500.0)], []))
    assert sorted(map(tuple, world.kept.series().select("subject_id", "day", "acute_7d", "ctl").collect())) == before
    assert world.kept.loads().filter(F.col("load").isNull()).count() == 0
