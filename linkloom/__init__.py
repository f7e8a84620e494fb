"""Link-graph and internal-link analytics over Spark DataFrames, many sites per job."""

__version__ = "0.1.0"
