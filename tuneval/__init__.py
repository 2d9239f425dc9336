"""tuneval: instruction-data and response-evaluation operators on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function (or a Column
expression) so that Catalyst plans the whole job; nothing is pulled
through the driver.
"""

__version__ = "0.1.0"
