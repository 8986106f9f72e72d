"""riskloom — account-risk analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources/    readers, the driver-table `accounts` mapping, profile flattening
  functions/  reusable Column expressions (coercion, text statistics, guards)
  operators/  table-in / table-out operators (cleaning, features, graph,
              sampling, models, fusion, metrics, explanation, output)
  plans/      registered queries (Spark plan + DuckDB oracle) and the flows
  streaming/  Structured Streaming monitor, alerts and history
"""

__version__ = "0.1.0"
