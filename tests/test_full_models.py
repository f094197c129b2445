"""The registered model queries fit the full learners."""

import pytest

from panelspark import spec
from panelspark.operators import ensemble
from panelspark.plans import catalog, experiment


class Reached(Exception):
    pass


@pytest.mark.parametrize("name", ["m22_stacking", "m24_experiment", "m25_outside_label_run", "m26_fold_probe", "m27_random_label_probe",
                                  "m28_gap_probe", "m29_fit_full", "e2_model_score", "e3_model_attribution", "e3_vector_attribution"])
def test_full_size(spark, sf, monkeypatch, name):
    def stop(*args, **named):
        raise Reached(args, named)

    monkeypatch.setattr(ensemble, "fit_stack", stop)
    for job in ("run_experiment", "fold_probe", "random_label_probe", "gap_probe", "fit_full"):
        monkeypatch.setattr(experiment, job, stop)
    with pytest.raises(Reached) as reached:
        catalog.QUERIES[name](spark, sf)
    args, named = reached.value.args
    whole = [a for a in args if isinstance(a, spec.Settings)]
    stacks = [a for a in args if isinstance(a, spec.StackingSettings)] + [s.stacking for s in whole]
    assert stacks == [spec.StackingSettings()]
    assert all(s.cluster == spec.ClusterSettings() for s in whole) and not named
