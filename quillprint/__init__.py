"""Snippet-authorship analytics on Spark DataFrames.

Sub-packages:

* ``functions``  Column -> Column expressions (text, lexical, score)
* ``operators``  DataFrame -> DataFrame transformations and estimators
* ``sources``    readers and writers
* ``plans``      end-to-end jobs built from the three above
"""

__version__ = "0.1.0"
