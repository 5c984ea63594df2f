import inspect

import pytest
from oracle import DATA

from codekiln.plans import rule_queries


def test_the_query_fits_the_whole_forest(spark, monkeypatch):
    plan, asked = inspect.signature(rule_queries.m.fit_forest), {}
    made = rule_queries.m.synthetic_rows

    def synthetic(session, n, **more):
        asked["rows"] = n
        return made(session, n, **more)

    def fit(*given, **more):
        bound = plan.bind(*given, **more)
        bound.apply_defaults()
        asked["trees"] = bound.arguments["trees"]
        raise InterruptedError

    monkeypatch.setattr(rule_queries.m, "synthetic_rows", synthetic)
    monkeypatch.setattr(rule_queries.m, "fit_forest", fit)
    with pytest.raises(InterruptedError):
        rule_queries.rf_risk_fit(spark, DATA)
    assert asked == {"rows": 480, "trees": 300}
