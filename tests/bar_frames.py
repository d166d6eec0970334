"""Small bar tables for tests."""


def bar_frame(spark, closes, ticker="A", volumes=None, spread=0.5, start="2020-01-01"):
    """Bars from closes: open at the prior close, high and low ``spread`` away."""
    import pandas as pd

    n = len(closes)
    opens = [closes[0], *closes[:-1]]
    df = pd.DataFrame({
        "ticker": ticker, "date": pd.date_range(start, periods=n).date, "open": opens,
        "high": [max(o, c) + spread for o, c in zip(opens, closes)], "low": [min(o, c) - spread for o, c in zip(opens, closes)],
        "close": closes, "volume": volumes or [1000.0] * n})
    return spark.createDataFrame(df, "ticker string, date date, open double, high double, low double, close double, volume double")
