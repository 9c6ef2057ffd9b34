"""quarkframe: nested event analytics on Spark DataFrames.

Rows are events; physics collections are ``array<struct>`` columns. Every
operator is a DataFrame/Column expression that runs on executors; the only
shuffles are the ones a query semantically needs (histogram merge, per-event
merge of hot events split into fragments, metric joins).
"""

__version__ = "0.1.0"
