"""auger: classification and anomaly reports as Spark SQL plans and Spark ML pipelines.

Sub-packages
------------
sources    readers and writers (delimited, ARFF, text, model export)
functions  column expressions (cleaning, encoding, tokens, hashing)
operators  splits, metrics, learners, scoring, nearest neighbours, reports
plans      compositions (training report) and the driver's query catalogue
streaming  scoring of files that arrive in a folder
cli        train / score / outliers for configured jobs (``python -m auger``)
"""

__version__ = "0.1.0"
