"""ledgerlens: a Spark-native star schema and analytics marts for payment-ledger data.

Layout:
  sources/    staging readers (CSV contract, driver ``events`` projection)
  functions/  Column-level helpers (exact half-up ratios, fee clamp, amount bands)
  operators/  DataFrame -> DataFrame building blocks (star, quality, risk, growth, ...)
  plans/      the ledger model, the query registry and the pipeline that writes marts
  streaming/  incremental (micro-batch) refresh of the star from newly landed staging files
"""

__version__ = "0.1.0"
