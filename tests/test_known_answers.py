"""Known answers listed in FIXTURES.md (literal semantics, whole range, window 7)."""
import pytest

from evlens.operators import funnel as FN
from evlens.operators import insights as I
from evlens.operators import retention as R
from evlens.plans import fixture as fx
from evlens.sources.canonical import canonical_events

CASES = {
    "/root/testdata/sf0.001": {"funnel": [15, 10, 10, 5], "ret": {"2024-01-01": (15, 14, 14, 0)},
                               "purchase": (7, 8, 6, 8)},
    "/root/testdata/sf0.01": {"funnel": [150, 67, 79, 77],
                              "ret": {"2024-01-01": (134, 122, 120, 0), "2024-01-02": (16, 14, 15, 0)},
                              "purchase": (80, 70, 73, 62)},
    "/root/testdata/sf0.1": {"funnel": [1500, 767, 721, 710],
                             "ret": {"2024-01-01": (1338, 1185, 1201, 0), "2024-01-02": (139, 124, 124, 0)},
                             "purchase": (720, 780, 633, 711)},
}


@pytest.mark.parametrize("sf", list(CASES))
def test_known_answers(spark, sf):
    want = CASES[sf]
    ev = canonical_events(spark, sf, fx.START, fx.END)
    f = FN.funnel(ev, fx.FUNNEL_STEPS, fx.START, fx.END, 7).orderBy("step_index").collect()
    assert [r.users for r in f] == want["funnel"]
    ret = {r.cohort_date.isoformat(): (r.cohort_size, r.d1_users, r.d7_users, r.d30_users)
           for r in R.retention(ev, fx.START, fx.END).collect()}
    for day, vals in want["ret"].items():
        assert ret[day] == vals
    corr = {r.event_name: r for r in I.retention_correlation(ev, fx.START, fx.END, 0, None).collect()}
    p = corr["purchase"]
    did, no, did_ret, no_ret = want["purchase"]
    assert (p.did_event_users, p.no_event_users) == (did, no)
    assert p.d7_retention_with_event == pytest.approx(did_ret / did)
    assert p.d7_retention_without_event == pytest.approx(no_ret / no)
