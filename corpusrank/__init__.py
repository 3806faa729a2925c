"""corpusrank: Spark-native text ranking and evaluation.

Every operator is a function from DataFrames (plus an ``Options`` object) to a
DataFrame.  Nothing is collected to the driver except bounded model state
(vocabulary, SVD basis, learned coefficients).
"""

from corpusrank.config import Options

__all__ = ["Options"]
