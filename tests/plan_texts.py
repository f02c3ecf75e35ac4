"""Plans as texts."""


def plan(df):
    return df._jdf.queryExecution().toString()
