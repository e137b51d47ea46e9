"""Records and warning moments against a frame-by-frame computation."""

import random

import numpy as np
import pytest

from nearmiss.operators import warnings as wn


def brute_onset(times, flags, impact):
    """Start of the last warning up to the impact; the first frame if it warned throughout."""
    upto = [f for t, f in zip(times, flags) if t <= impact]
    if all(upto):
        return times[0]
    if not any(upto):
        return None
    rises = [i for i in range(1, len(upto)) if upto[i] and not upto[i - 1]]
    return times[rises[-1]] if rises else times[0]


@pytest.mark.parametrize("small", [True, False])
def test_records_by_brute_force(spark, small):
    rnd = random.Random(11)
    frames, meta, targets = [], [], []
    for e in range(6):
        impact = 20000 + 500 * e
        meta.append((e, impact - 2000.0, impact + 1000.0, float(impact), impact - 900.0))
        targets.append((e, e * 10))
        for t in (e * 10, e * 10 + 1, e * 10 + 2):
            for k in range(0 if t % 10 else 3 * e, 260):
                score = rnd.choice([None, float("nan"), float("inf"), float("-inf")]) if rnd.random() < 0.05 else rnd.uniform(0, 10)
                frames.append((e, t, k, k / 10, score, -3.0 if (t % 10 == 2 and e % 2) else 0.0))
    scores = spark.createDataFrame(frames, "event_id long, target_id long, k long, time double, score double, acc_ego double")
    events = wn.danger_window(spark.createDataFrame(
        meta, "event_id long, start_timestamp double, end_timestamp double, impact_timestamp double, reaction_timestamp double"))
    voted = spark.createDataFrame(targets, "event_id long, target_id long")
    ths = [0.5, 2.0, 5.0, 8.0, 9.9, 20.0]
    got = {(r["event_id"], r["threshold"]): r for r in wn.warning_records(
        scores, events, ths, small, targets=voted, with_onset=True).collect()}
    assert len(got) == 6 * len(ths)
    for e, start, _, impact, _ in meta:
        for th in ths:
            def warns(s):
                return s is not None and not np.isnan(s) and (s < th if small else s > th)
            mine = [(f[3], warns(f[4])) for f in frames if f[1] == e * 10]
            lo, hi = min(impact - 4500, start) / 1000, (impact + 500) / 1000
            inside = [f for t, f in mine if lo <= t <= hi]
            row = got[e, th]
            assert row["true_warning"] == int(sum(inside) > 5)
            assert row["true_warning_period"] == pytest.approx(sum(inside) / len(inside))
            want = brute_onset([t for t, _ in mine], [f for _, f in mine], impact / 1000)
            assert row["warning_timestamp"] == (None if want is None else pytest.approx(want * 1000))
            false = quiet = 0
            for t in (e * 10 + 1, e * 10 + 2):
                early = [f for f in frames if f[1] == t and f[3] < start / 1000 - 3]
                part = early[15:65]
                if len(early) >= 35 and min(f[5] for f in part) > -1.5:
                    hit = any(warns(f[4]) for f in part)
                    false, quiet = false + hit, quiet + (not hit)
            assert row["safety_recorded"] == (false + quiet > 0)
            assert (row["num_false_warning"], row["num_true_non_warning"]) == (false, quiet)


def test_vote_notes(spark):
    votes = [(1, m, 10) for m in range(15)] + [(2, m, None) for m in range(15)]
    votes += [(3, m, 30 if m < 4 else None) for m in range(15)] + [(4, m, 40 if m < 8 else 41) for m in range(15)]
    votes += [(5, m, 51 if m < 5 else 50 if m < 9 else None) for m in range(15)]
    df = spark.createDataFrame([(e, str(m), t) for e, m, t in votes], "event_id long, model string, target_id long")
    got = {r["event_id"]: (r["target_id"], r["target_note"]) for r in wn.vote_target(df, 15).collect()}
    assert got[1] == (10, "For: 15, against: 0, abstentions: 0")
    assert got[2] == (-1, "No target is identified by any SSMs")
    assert got[3] == (-1, "The most votes are less than 1/3 of total")
    assert got[4] == (-1, "More than 1/3 votes are not for the most voted target")
    assert got[5] == (51, "For: 5, against: 4, abstentions: 6")
    with pytest.raises(ValueError):
        wn.vote_target(df, 14)


def test_threshold_grids():
    assert len(wn.threshold_grid("intensity")) == 100 and wn.threshold_grid("intensity")[:2] == [-0.06, 0.0]
    tadv = wn.threshold_grid("TAdv")
    assert tadv[0] == 0 and tadv == sorted(set(tadv)) and tadv[-1] == round((152 * 0.0115) ** 7, 2)
    assert wn.threshold_grid("UCD")[0] == -1 and min(wn.threshold_grid("EI")) < 0
