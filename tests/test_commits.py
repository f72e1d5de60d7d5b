import random
import threading
from datetime import datetime

import pytest

from conftest import rows
from featureline.operators.commits import CommitLog, Conflict, alias_history

NOW = datetime(2026, 1, 1)


def by_hand(events):
    stack, undone = [], []
    for _, action, version in sorted(events):
        if action == "set":
            stack, undone = [*stack, version], []
        elif action == "rollback" and len(stack) > 1:
            undone.append(stack.pop())
        elif action == "restore" and undone:
            stack.append(undone.pop())
    return (stack[-1] if stack else None, stack[:-1], undone)


def test_history_equals_a_walk_by_hand(spark):
    rng = random.Random(3)
    made = {n: [(k, rng.choice(["set", "rollback", "rollback", "restore"]), k) for k in rng.sample(range(40), 25)] for n in "abcdef"}
    made["g"] = [(1, "rollback", 0), (2, "restore", 0)]
    df = spark.createDataFrame([(n, *e) for n, events in made.items() for e in events], "name string, at int, action string, version long")
    got = {r.name: (r.version, r.below, r.undone) for r in alias_history(df.repartition(5), ["name"], "at").collect()}
    assert got == {n: by_hand(events) for n, events in made.items()}
    assert alias_history(df.limit(0), ["name"], "at").count() == 0


def test_a_rollback_can_be_rolled_back(spark, folder):
    log = CommitLog(spark, folder)
    assert log.champions().count() == 0 and log.last() == 0
    for k in (1, 2, 3):
        assert log.register("m", f"r{k}", f"path{k}", NOW) == k
        log.set_alias("m", k, NOW)
    assert log.rollback("m", NOW) == 2 and log.rollback("m", NOW) == 1
    with pytest.raises(ValueError, match="nothing to rollback"):
        log.rollback("m", NOW)
    assert log.restore("m", NOW) == 2
    assert rows(log.champions(), "name", "version", "source") == [("m", 2, "path2")]
    log.set_alias("m", 1, NOW)
    with pytest.raises(ValueError, match="nothing to restore"):
        log.restore("m", NOW)
    assert log.rollback("m", NOW) == 2  # back to what stood there, not to the highest number
    assert rows(log.aliases(), "version") == [(2,)]


def test_two_interleaved_writers_never_share_a_version(spark, folder):
    """The first writer has decided when the second one commits; it decides again on the longer log."""
    first, second = CommitLog(spark, folder), CommitLog(spark, folder)
    seen = []

    def decide(log):
        n = log.count()
        seen.append(n)
        if len(seen) == 1:
            assert second.register("m", "other", "p2", NOW) == 1
        return {"action": "register", "name": "m", "version": n + 1, "run_id": "own", "source": "p1", "at": "t"}

    assert first.commit(decide)["version"] == 2 and seen == [0, 1]
    with pytest.raises(Conflict):
        first.append(0, action="set", name="m")
    assert rows(first.read(), "sequence", "version", "run_id") == [(1, 1, "other"), (2, 2, "own")]


def test_writers_at_the_same_time(spark, folder):
    got: list = []
    writers = [threading.Thread(target=lambda w=w: got.extend(CommitLog(spark, folder).register("m", f"{w}-{k}", "p", NOW) for k in range(3)))
               for w in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == list(range(1, 10)) and CommitLog(spark, folder).last() == 9
