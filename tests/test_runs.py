"""The overlay as runs against the whole log resolved at once."""

import random

from veldra.operators import overlay
from veldra.operators.runs import Runs

LOG = "sequence long, id long, op string, v array<float>, attrs array<float>"


def test_runs_give_the_live_view_of_the_whole_log(spark, tmp_path):
    chance = random.Random(11)
    base = spark.createDataFrame([(i, [float(i)], float(i)) for i in range(12)], "id long, v array<float>, a0 float")
    log, top = [], 12
    for sequence in range(1, 241):
        op = chance.choice(["insert", "upsert", "attributes", "erase"])
        hot = chance.random() < 0.7  # most mutations are of few ids
        i = top if op == "insert" else chance.randint(0, 3 if hot else top + 2)
        top += op == "insert"
        log.append((sequence, i, op, [float(chance.randint(0, 99))] if op in ("insert", "upsert") else None, [float(chance.randint(0, 99))] if op != "erase" else None))
    key = lambda r: (r.id, r.v[0], r.a0, r.version, r.from_delta)
    runs = Runs(spark, str(tmp_path / "r"), base, ["a0"])
    for cut in (50, 51, 160, 240):
        runs = Runs(spark, str(tmp_path / "r"), base, ["a0"])  # as after a restart
        assert runs.append(spark.createDataFrame([x for x in log if x[0] <= cut], LOG)) == cut - {50: 0, 51: 50, 160: 51, 240: 160}[cut]
        resolved = overlay.resolve(spark.createDataFrame([x for x in log if x[0] <= cut], LOG), base)
        want = sorted(map(key, overlay.live_view(resolved, base, ["a0"]).collect()))
        assert sorted(map(key, runs.live_view().collect())) == want
        state = overlay.allocator_state(resolved, base).first()
        assert (runs.versions + 1, runs.accepted, runs.high_water) == (state.next_version, state.sequence, cut)
        if cut == 160:
            runs.compact()
            assert len(runs.active) == 1 and sorted(map(key, runs.live_view().collect())) == want
    assert runs.append(spark.createDataFrame(log, LOG)) == 0 and len(runs.active) == 2


def test_a_run_that_no_manifest_names_is_not_there(spark, tmp_path):
    base = spark.createDataFrame([(0, [0.0], 0.0)], "id long, v array<float>, a0 float")
    runs = Runs(spark, str(tmp_path / "r"), base, ["a0"])
    assert runs.append(spark.createDataFrame([], LOG)) == 0 and runs.live_view().count() == 1
    runs._write(spark.createDataFrame([(0, 1, True, None, None, None)], "id long, sequence long, erased boolean, v array<float>, attrs array<float>, version long"))
    assert Runs(spark, str(tmp_path / "r"), base, ["a0"]).live_view().count() == 1
