"""ledgerloom: a document-analytics engine declared on PySpark DataFrames.

Sub-packages: ``functions`` (column expressions), ``operators`` (relational
operators on DataFrames), ``sources`` (files to elements and facts), ``plans``
(catalogue planning and registered queries), ``streaming``.
"""

__version__ = "0.1.0"
