"""Queries on 51 margins a stage against brute force."""

import numpy as np

from harrier.queries import policy


def test_all_margins_of_three_stages(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber").limit(60).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = policy.probabilities(spark, str(tmp_path)).collect()
    p = [np.array([np.nan if r[c] is None else r[c] for r in rows]) for c in policy.P]
    y = np.array([bool(r.y) for r in rows])
    margins = 0.5 * np.arange(51) / 50
    out = [(q <= 0.5 - margins[:, None]) | (q >= 0.5 + margins[:, None]) for q in p]
    have = [[x for x in (r[c] for c in policy.P) if x is not None] for r in rows]
    last = np.array([bool(h) and sum(h) / len(h) >= 0.5 for h in have])
    want = {}
    for i in range(51):
        for j in range(51):
            v = np.where(out[0][i], p[0] >= 0.5, np.where(out[1][j], p[1] >= 0.5, np.where(out[2], p[2] >= 0.5, last)))
            ms = np.where(out[0][i], 1.0, np.where(out[1][j], 51.0, 951.0)).mean()
            for k in range(51):
                tp, fp, fn = int((v[k] & y).sum()), int((v[k] & ~y).sum()), int((~v[k] & y).sum())
                want[i, j, k] = (tp, fp, fn, round(2 * tp / max(1, 2 * tp + fp + fn), 9), ms)
    got = {(r.s0, r.s1, r.s2): r for r in policy.QUERIES["margin_grid_full"](spark, str(tmp_path)).collect()}
    assert len(got) == len(want) == 132_651
    for key, (tp, fp, fn, f1, ms) in want.items():
        r = got[key]
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and abs(r.f1 - f1) < 1e-8 and abs(r.mean_latency_ms - ms) < 1e-5
    picks = {r.budget: r for r in policy.QUERIES["budget_picks_full"](spark, str(tmp_path)).collect()}
    for budget in policy.BUDGETS:
        feasible = {k: w for k, w in want.items() if w[4] <= budget}
        if not feasible:
            assert budget not in picks
            continue
        top = max(w[3] for w in feasible.values())
        ties = {k: w for k, w in feasible.items() if abs(w[3] - top) <= 1e-8 + 1e-5 * top}
        r = picks[budget]
        cheapest = min((round(w[4], 6), *k) for k, w in ties.items())
        assert (r.n_feasible, r.n_ties, r.s0, r.s1, r.s2) == (len(feasible), len(ties), *cheapest[1:])
        assert [r.margin_0, r.margin_1, r.margin_2] == [round(float(margins[k]), 9) for k in cheapest[1:]]
    tied = policy.QUERIES["margin_ties_full"](spark, str(tmp_path)).first()
    assert (tied.s0, tied.s1, tied.s2, tied.n_ties) == (picks[250.0].s0, picks[250.0].s1, picks[250.0].s2, picks[250.0].n_ties)
    exits = {r.step: r for r in policy.QUERIES["exit_composition_full"](spark, str(tmp_path)).collect()}
    assert [exits[i].exit_0 for i in range(51)] == out[0].sum(axis=1).tolist()
    assert policy.QUERIES["outcome_cube_full"](spark, str(tmp_path)).count() == 51 * 4 * 4
