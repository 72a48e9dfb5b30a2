"""A quantile between two equal values is that value, to the last bit."""

from warrantlake.operators import ranges as G


def test_quantiles_between_equal_values_are_that_value(spark):
    values = [0.07, 7.04, 37.13, 61.3, 92.57, 103.52]
    rows = spark.createDataFrame([(v,) for v in values for _ in range(61)], "v double").selectExpr("1 as k", "v")
    shares = {f"q{i}": i / 97 for i in range(98)}
    got = G.quantiles(rows, ["k"], "v", shares).first()
    every = sorted(values * 61)
    for name, share in shares.items():
        place = share * (len(every) - 1)
        low, high = every[int(place)], every[min(int(place) + 1, len(every) - 1)]
        if low == high:
            assert got[name] == low, (name, low)
