"""The boosted queries fit the operator's whole job, not a shortened one."""

import inspect

import pytest

from catalog import models as M
from emberday.models.classifiers import fit_boosted


@pytest.mark.parametrize("name", ["gbt_fit_score", "legacy_boosted"])
def test_boosted_queries_fit_all_rounds(spark, monkeypatch, name):
    asked = {}

    class Reached(Exception):
        pass

    def stop(table, kind, model_name, features=None, **params):
        asked.update(kind=kind, **params)
        raise Reached

    monkeypatch.setattr(M, "holdout_predictions", stop)
    with pytest.raises(Reached):
        M.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked["kind"] == "boosted"
    default = {k: p.default for k, p in inspect.signature(fit_boosted).parameters.items()}
    fit = default | asked
    assert (fit["rounds"], fit["depth"], fit["rate"]) == (500, 6, 0.05)
    assert fit["validation_days"] == (240 if name == "gbt_fit_score" else None)
