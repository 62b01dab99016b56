"""ledgerlens: DataFrame-in, DataFrame-out operators for one large table of
labelled transactions (prepare, explore, profile, balance, split, train,
tune, evaluate, compare, store).

Every operator is a lazy Spark plan; the only values that visit the driver
are bounded: category lists (guarded), min/max scalars, bucket boundaries
of the running-sum helper, and fitted model parameters.
"""

__version__ = "0.1.0"
