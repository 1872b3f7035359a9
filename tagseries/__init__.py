"""tagseries: irregular sensor history on Spark.

Every public operator is a plain ``DataFrame -> DataFrame`` function (usable with
``df.transform``).  Long series are keyed by ``entity`` columns (optional) plus
``tag`` and an integer ``slot`` (bucket start divided by the step); windows over a
single long series are cut into overlapping time blocks so that they never collapse
into one partition.
"""

__version__ = "0.1.0"
