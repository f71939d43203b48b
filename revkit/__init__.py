"""revkit: code-review analytics on Spark DataFrames.

Source files and review comments are tables; rules are column expressions;
findings, scores, reports and channel histories are DataFrame jobs.
"""

__version__ = "0.1.0"
