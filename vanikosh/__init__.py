"""vanikosh: a Spark-native engine for speech-transcript quality work.

Importing the package starts nothing; every operator takes a SparkSession or a
DataFrame and returns a DataFrame, leaving the physical plan to Catalyst.
"""

__version__ = "0.1.0"
