import numpy as np

from encephalake.plans import chains


def test_experiment_from_recording_to_comparison(spark, to_samples):
    """A strong rhythm in every second segment is found by the feature classifier."""
    rng = np.random.default_rng(0)
    n, seg = 24, 250
    t = np.arange(n * seg) / 125
    strong = (np.arange(n * seg) // seg) % 2 == 1
    m = rng.normal(0, 5, size=(16, n * seg)) + np.where(strong, 30, 1) * np.sin(2 * np.pi * 10 * t)
    samples = to_samples(m)
    labels = spark.createDataFrame([("T0", i, i % 2 if i else -1) for i in range(n)], "session_id string, seg bigint, label int")
    encoding = chains.encode_recordings(samples)
    assert encoding.count() == 16 * n * seg
    results = chains.evaluate_methods(samples, labels, encoding, trees=2, depth=2)
    rows = {r.method: r for r in results.collect()}
    assert rows["classical"].auc > 0.95 and rows["template"].n_features == 12
    assert rows["template"].n_samples == 7  # the last 30 % of 23 valid segments
    assert chains.compare(results).first().interpretation is not None
