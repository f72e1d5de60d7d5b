import pytest
from conftest import rows

from featureline.__main__ import main
from featureline.sources.tables import read_predictions


def test_jobs_from_the_command_line(spark, folder):
    base, registry, now = f"{folder}/base", f"{folder}/registry", "2026-01-15T00:00:00+00:00"
    common = ["--base", base, "--now", now]
    assert main(["generate", *common, "--n-customers", "60"]) == 0
    assert main(["check", *common]) == 0
    assert main(["materialize", *common]) == 0
    # No champion yet.
    assert main(["score", *common, "--registry", registry]) == 1
    assert main(["train", *common, "--registry", registry]) == 0
    assert main(["score", *common, "--registry", registry, "--predictions", f"{folder}/out"]) == 0
    out = read_predictions(spark, f"{folder}/out/churn_model")
    assert out.count() == 60 and rows(out.select("model_version").distinct()) == [(1,)]


def test_unknown_job():
    with pytest.raises(SystemExit):
        main(["fly"])
