"""admitflow: admission, ledger, saga and request analytics as Spark jobs.

Every public operator takes DataFrames (or a SparkSession and a data
directory) and returns a DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
