"""Streaming use of the preparation and scoring operators.

The reference processes files in batch only; it has no stream, watermark or
state.  What carries over is that its preparation is row-local once the
category labels are fixed: pair code, dummies, drops, casts, the null
filter and model scoring are all stateless, so the very same operators run on
a streaming DataFrame.  Duplicate removal and everything that aggregates
(histograms, profiles, SMOTE, evaluation) stay batch operators.
"""

from .prepare import prepare_stream, read_transactions_stream, score_stream

__all__ = ["prepare_stream", "read_transactions_stream", "score_stream"]
