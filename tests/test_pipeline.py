from dataclasses import replace

from offerloom import schemas
from offerloom.models.boosting import PARAMS_A, PARAMS_B
from offerloom.plans import pipeline
from offerloom.sources.campaign import from_star_schema
from offerloom.sources.tables import read_csv


def test_from_tables_to_submission(spark, tmp_path):
    data = from_star_schema(spark, "/root/testdata/sf0.001")
    encoded = pipeline.prepare_features(data, str(tmp_path / "features"))
    n_rows = data.impressions.count()
    assert encoded.count() == n_rows
    assert encoded.filter("source = 'train' and redemption_status is null").isEmpty()
    codes = [c for c in encoded.columns if c.endswith("_code")]
    for code in codes:
        found = sorted(r[0] for r in encoded.select(code).distinct().collect() if r[0] is not None)
        assert found == list(range(len(found)))
    pipeline.predict(
        encoded,
        data.template,
        str(tmp_path / "submission"),
        replace(PARAMS_A, trees=2, depth=3),
        replace(PARAMS_B, trees=2, depth=3),
        n_folds=2,
        every=1,
    )
    sent = read_csv(spark, str(tmp_path / "submission"), schemas.SUBMISSION)
    assert sent.count() == data.template.count()
    assert sent.filter("redemption_status is null or redemption_status not between 0 and 1").isEmpty()
