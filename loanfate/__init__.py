"""loanfate: how personal loans end, computed on Spark.

DataFrame-to-DataFrame operators for cleaning loan files, default and early-repayment
statistics, state and national panels, county allocation, text clusters, repayment
regressions and prediction checks.
"""
